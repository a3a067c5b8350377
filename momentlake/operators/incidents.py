"""Riders down and bikes off the track, from boxes: who stands beside a bike, a bike that lies, and the spans off the track that vouch for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detect import BY, MOTORCYCLE, OFFTRACK_HEIGHT, OFFTRACK_LEAST, PERSON, ego_tracks, height, off_track
from .moments import cooldown

# Fixed values.
BEFORE_ROWS, DOWN_ROWS, BESIDE_ROWS, MOUNTED_ROWS, AGAIN_S = 5, 8, 3, 4, 5.0
WIDER_ALL, WIDER_HALF, LOWER_HALF = 1.5, 1.8, 0.65
MOUNTED, APART, BESIDE_WIDTHS, PERSON_HEIGHT = 0.5, 0.1, 3.0, 0.03
NEAR_S, OFF_BIKE_SCORE, BIKE_DOWN_SCORE, OFF_TRACK_SCORE = 2.0, 2.0, 1.5, 1.0


def _half(values: Column) -> Column:
    """Median of a short list."""
    v, n = F.array_sort(values), F.size(values)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def bikes(points: DataFrame) -> DataFrame:
    """Points of other bikes that are large enough, of tracks with enough of them that begin as a bike, with ``_n``, their place in the track."""
    kept = points.where(height() >= OFFTRACK_HEIGHT).join(ego_tracks(points), list(BY), "left_anti")
    w = Window.partitionBy(*BY)
    order = w.orderBy("t", "x1", "x2", "y1", "y2")
    return kept.withColumns({"_many": F.count("*").over(w), "_first": F.first("cls").over(order), "_n": F.row_number().over(order)}).where((F.col("_many") >= OFFTRACK_LEAST) & (F.col("_first") == MOTORCYCLE))


def bike_down_hits(points: DataFrame) -> DataFrame:
    """``BY``, ``t``: points from which on a bike's box is wider for its height than in the five before, and lower.

    All of the next eight are WIDER_ALL times as wide for their height as the median of the five before, their median is WIDER_HALF times as wide, and LOWER_HALF as high at most.
    One more point must follow.
    """
    w = Window.partitionBy(*BY).orderBy("_n")
    before, after = w.rowsBetween(-BEFORE_ROWS, -1), w.rowsBetween(0, DOWN_ROWS - 1)
    tall = F.col("y2") - F.col("y1")
    shaped = bikes(points).withColumns({"_aspect": (F.col("x2") - F.col("x1")) / F.greatest(tall, F.lit(1.0)), "_tall": F.greatest(tall, F.lit(0.0))})
    framed = shaped.withColumns({
        "_a0": _half(F.collect_list("_aspect").over(before)), "_h0": _half(F.collect_list("_tall").over(before)), "_least": F.min("_aspect").over(after),
        "_a1": _half(F.collect_list("_aspect").over(after)), "_h1": _half(F.collect_list("_tall").over(after)),
    })
    whole = (F.col("_n") > BEFORE_ROWS) & (F.col("_n") + DOWN_ROWS <= F.col("_many"))
    down = (F.col("_least") >= WIDER_ALL * F.col("_a0")) & (F.col("_a1") >= WIDER_HALF * F.col("_a0")) & (F.col("_h1") <= LOWER_HALF * F.col("_h0"))
    return framed.where(whole & down).select(*BY, "t")


def off_bike_hits(points: DataFrame) -> DataFrame:
    """``BY``, ``t``: points at which a bike that was ridden has someone beside it instead, for three points on end.

    Ridden: in four of the five points before, a person's box lies half or more on the bike's. Beside: nobody does, but someone tall enough is within three widths of the bike and hardly on it.
    """
    at = F.bround("t", 3)
    people = points.where(F.col("cls") == PERSON).select(
        "recording_id", at.alias("_t"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("y1").alias("q1"), F.col("y2").alias("q2"), height().alias("_tall")
    )
    rows = bikes(points).withColumn("_t", at)
    wide, high = F.least("x2", "p2") - F.greatest("x1", "p1"), F.least("y2", "q2") - F.greatest("y1", "q1")
    own = F.greatest(F.greatest(F.col("p2") - F.col("p1"), F.lit(0.0)) * F.greatest(F.col("q2") - F.col("q1"), F.lit(0.0)), F.lit(1.0))
    share = F.when((wide > 0) & (high > 0), wide * high / own).otherwise(0.0)
    near = (share < APART) & (F.abs((F.col("p1") + F.col("p2") - F.col("x1") - F.col("x2")) / 2) <= BESIDE_WIDTHS * (F.col("x2") - F.col("x1"))) & (F.col("_tall") >= PERSON_HEIGHT)
    seen = rows.join(people, ["recording_id", "_t"], "left").groupBy(*BY, "_n", "_many", "t").agg(F.coalesce(F.bool_or(share >= MOUNTED), F.lit(False)).alias("_on"), F.coalesce(F.bool_or(near), F.lit(False)).alias("_near"))
    w = Window.partitionBy(*BY).orderBy("_n")
    beside = (~F.col("_on") & F.col("_near")).cast("int")
    framed = seen.withColumns({"_rode": F.sum(F.col("_on").cast("int")).over(w.rowsBetween(-BEFORE_ROWS, -1)), "_beside": F.min(beside).over(w.rowsBetween(0, BESIDE_ROWS - 1))})
    return framed.where((F.col("_n") > BEFORE_ROWS) & (F.col("_n") + BESIDE_ROWS - 1 <= F.col("_many")) & (F.col("_rode") >= MOUNTED_ROWS) & (F.col("_beside") == 1)).select(*BY, "t")


def incidents(points: DataFrame) -> DataFrame:
    """Events ``recording_id``, ``track_id``, ``type``, ``t_start``, ``t_end``, ``score``, ``why`` of boxes with ``offtrack``, the share of grass and gravel under them.

    ``rider_down`` for someone beside the bike (``off_bike``), and for a bike that lies (``bike_down``) within NEAR_S of a span off the track, of any track of the recording up to its own; of one kind and track the next comes
    over AGAIN_S later. ``off_track`` for the other spans: those with a rider down near their start go.
    """
    later = lambda hits: cooldown(hits.distinct(), list(BY), "t", "t", AGAIN_S, strict=True)
    spans = off_track(points).select("recording_id", F.col("track_id").alias("_track"), F.col("t_start").alias("_s"), F.col("t_end").alias("_e"))
    down = lambda hits, why, score: hits.select(*BY, F.lit("rider_down").alias("type"), (F.col("t") - 1).alias("t_start"), (F.col("t") + 1).alias("t_end"), F.lit(score).alias("score"), F.lit(why).alias("why"))
    lying = later(bike_down_hits(points)).join(spans, "recording_id").where((F.col("_track") <= F.col("track_id")) & F.col("t").between(F.col("_s") - NEAR_S, F.col("_e") + NEAR_S)).select(*BY, "t").distinct()
    riders = down(later(off_bike_hits(points)), "off_bike", OFF_BIKE_SCORE).unionByName(down(lying, "bike_down", BIKE_DOWN_SCORE))
    vetoes = riders.select("recording_id", F.col("t_start").alias("_r0"), F.col("t_end").alias("_r1")).distinct()
    near = (spans["recording_id"] == vetoes["recording_id"]) & spans["_s"].between(F.col("_r0") - NEAR_S, F.col("_r1") + NEAR_S)
    left = spans.join(vetoes, near, "left_anti")
    off = left.select("recording_id", F.col("_track").alias("track_id"), F.lit("off_track").alias("type"), F.col("_s").alias("t_start"), F.col("_e").alias("t_end"), F.lit(OFF_TRACK_SCORE).alias("score"), F.lit(None).cast("string").alias("why"))
    return riders.unionByName(off)
