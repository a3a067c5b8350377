"""From moments to what is shown: aggregates over their pieces, reasons to leave one out, listings, votes that carry over.

Moments have ``segments`` (array of recording_id, t_start, t_end); series are long tables (recording_id, t, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import in_range
from .moments import first_reason

# Pace in km/h, shares, and a picture's motion.
MIN_TRACK_KMH, STOPPED_KMH, RIDING_SHARE, KERB_SHARE, VEHICLE_SHARE = 40.0, 15.0, 0.5, 0.04, 0.5
CRASH_AGAIN_S = 15.0


def pieces(moments: DataFrame, by: Sequence[str], moment_id: str) -> DataFrame:
    """A row for each segment of a moment: by, ``moment_id``, ``piece``, ``recording_id``, ``t_start``, ``t_end``."""
    return moments.select(*by, moment_id, F.posexplode("segments").alias("piece", "_s")).select(*by, moment_id, "piece", "_s.*")


def _inside(segments: DataFrame, samples: DataFrame, t: str, pad: float, width: float) -> DataFrame:
    return in_range(segments, samples, ["recording_id"], F.col("t_start") - pad, F.col("t_end") + pad, F.col(t), width)


def weighted_mean(segments: DataFrame, samples: DataFrame, moment_id: str, t: str, value: str, pad: float = 0.0, width: float = 60.0) -> DataFrame:
    """``moment_id`` and ``mean``: the means of the pieces that have samples, weighted by the pieces' seconds. Moments without any are left out."""
    each = _inside(segments, samples, t, pad, width).groupBy(moment_id, "piece", "t_start", "t_end").agg(F.avg(F.col(value).cast("double")).alias("m"))
    seconds = F.col("t_end") - F.col("t_start")
    return each.groupBy(moment_id).agg(F.try_divide(F.sum(F.col("m") * seconds), F.sum(seconds)).alias("mean"))


def pooled_median(segments: DataFrame, samples: DataFrame, moment_id: str, t: str, value: str, width: float = 60.0) -> DataFrame:
    """``moment_id`` and ``median`` of the samples of all its pieces together; moments without any are left out."""
    return _inside(segments, samples, t, 0.0, width).groupBy(moment_id).agg(F.percentile(value, F.lit(0.5)).alias("median"))


def pace(gps: Column, speed: Column, riding: Column, motion: Column, riders: Column, min_kmh: float = MIN_TRACK_KMH, still: float = 2.5, streaming: float = 8.0) -> Column:
    """``stopped``, ``slow`` or ``track``: by the share of time riding where the camera has no speed of its own (``gps``), else by speed, else by the picture.

    A null tells nothing; a moment of which nothing is known is slow.
    """
    unmoving = F.coalesce(motion < still, F.lit(False))
    by_riding = F.when(riding >= RIDING_SHARE, "track").when(unmoving, "stopped").otherwise("slow")
    by_speed = F.when(speed < min(STOPPED_KMH, min_kmh), "stopped").when(speed < min_kmh, "slow").otherwise("track")
    by_picture = F.when(unmoving, "stopped").when((motion >= streaming) & (riders >= 1), "track").otherwise("slow")
    return F.when(riding.isNotNull() & ~F.coalesce(gps, F.lit(False)), by_riding).when(speed.isNotNull(), by_speed).otherwise(by_picture)


def drop_reason(vehicles: Column, riders: Column, kerb: Column, lamp: Column, pace_: Column, min_kmh: float = MIN_TRACK_KMH, max_vehicles: float = VEHICLE_SHARE, exempt: Column | None = None) -> Column:
    """Why a moment is left out, null to keep it: the first that holds of a car in view, nothing in view, a red lamp, standing still, riding slowly.

    ``exempt`` moments are not asked for riders, kerbs and pace. Shares of 0 or less switch a test off.
    """
    free = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    checks = [("car in view", vehicles >= max_vehicles)] if max_vehicles > 0 else []
    checks += [("no rider or kerb in view", ~free & (riders == 0) & (kerb < KERB_SHARE)), ("red signal lamp (session over)", lamp)]
    if min_kmh > 0:
        checks += [("standing still", ~free & (pace_ == "stopped")), (f"below {min_kmh:g} km/h", ~free & (pace_ == "slow"))]
    return first_reason(checks)


def with_reason(moments: DataFrame, reason: Column, why: str = "why") -> DataFrame:
    """``moments`` with ``drop_reason``, which is also added to the list ``why``: rows are carried, not dropped."""
    out = moments.withColumn("drop_reason", reason)
    noted = F.array_append(F.coalesce(F.col(why), F.array().cast("array<string>")), F.concat(F.lit("left out: "), "drop_reason"))
    return out.withColumn(why, F.when(F.col("drop_reason").isNull(), F.col(why)).otherwise(noted))


def listing(moments: DataFrame, score: str, time: str, order: str = "time", day: str | None = None, theme: str | None = None, unrated: str | None = None) -> DataFrame:
    """Moments of a day and theme, those without a vote if ``unrated`` names the vote's column, in order of ``time``, ``score`` or how unsure the score is (none: most)."""
    out = moments if day is None else moments.where(F.col("day") == day)
    out = out if theme is None else out.where(F.col("theme") == theme)
    out = out if unrated is None else out.where(F.coalesce(F.col(unrated), F.lit(0)) == 0)
    unsure = F.coalesce(F.abs(F.col(score) - 0.5), F.lit(1.0))
    return out.orderBy({"time": F.col(time), "score": F.desc_nulls_last(score), "uncertainty": unsure}[order], time)


def inherited_votes(clips: DataFrame, votes: DataFrame, by: Sequence[str], clip_id: str, start: str, end: str, vote: str, least: float = 0.5, width: float = 3600.0) -> DataFrame:
    """Clips without a vote of their own, with that of the clip of their group that shares most with them (``least`` of the union; ties: the lower id): ``clip_id``, ``vote``, ``inherited_from``.

    ``votes``: one row for each clip that has one.
    """
    voted = clips.join(votes.select(clip_id, vote), clip_id)
    bare = clips.join(votes.select(clip_id), clip_id, "left_anti")
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    a = bare.select(*by, clip_id, F.col(start).alias("_a0"), F.col(end).alias("_a1"), bins(start, end).alias("_bin"))
    b = voted.select(*by, F.col(clip_id).alias("inherited_from"), vote, F.col(start).alias("_b0"), F.col(end).alias("_b1"), bins(start, end).alias("_bin"))
    both = F.least("_a1", "_b1") - F.greatest("_a0", "_b0")
    share = F.try_divide(both, F.greatest("_a1", "_b1") - F.least("_a0", "_b0"))
    near = a.join(b, [*by, "_bin"]).where(F.col("_bin") == F.floor(F.greatest("_a0", "_b0") / width)).withColumn("_share", share).where((both > 0) & (F.col("_share") >= least))
    best = Window.partitionBy(clip_id).orderBy(F.desc("_share"), "inherited_from")
    return near.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(clip_id, vote, "inherited_from")


def newer_rows(rows: DataFrame, order: str, seen: int | float | None) -> DataFrame:
    """Rows beyond a watermark, which is the largest ``order`` that was sent before."""
    return rows if seen is None else rows.where(F.col(order) > seen)


def replace_by_key(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``stored`` with all rows of the keys that ``new`` has replaced by its rows. Columns that only one of them has are null in the other's rows."""
    kept = stored.join(new.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def not_together(segments: DataFrame, flagged: DataFrame, by: Sequence[str], moment_id: str) -> DataFrame:
    """Pieces without those whose recording is flagged together with another recording of the same moment.

    ``flagged``: by, ``a``, ``b`` - recordings that mustn't be shown together, in either order.
    """
    pairs = flagged.select(*by, F.explode(F.array(F.struct(F.col("a").alias("recording_id"), F.col("b").alias("_other")), F.struct(F.col("b").alias("recording_id"), F.col("a").alias("_other")))).alias("_p")).select(*by, "_p.*").distinct()
    there = segments.select(*by, moment_id, F.col("recording_id").alias("_other")).distinct()
    bad = segments.select(*by, moment_id, "recording_id").distinct().join(pairs, [*by, "recording_id"]).join(there, [*by, moment_id, "_other"]).select(*by, moment_id, "recording_id").distinct()
    return segments.join(bad, [*by, moment_id, "recording_id"], "left_anti")


def finish_passes(passes: DataFrame, by: Sequence[str], t: str, metres_per_s: Column, clear_m: float = 30.0) -> DataFrame:
    """Passes that no other follows within ``clear_m`` metres at the given speed."""
    after = F.lead(t).over(Window.partitionBy(*by).orderBy(t))
    return passes.withColumn("_next", after).where(F.col("_next").isNull() | (F.col("_next") - F.col(t) > F.lit(clear_m) / F.greatest(metres_per_s, F.lit(1.0)))).drop("_next")


def median_of_three(by: Sequence[str], t: str, tie: str, value: str) -> Column:
    """A value, the one before and the one after it: their median; at the ends the value counts twice."""
    w = Window.partitionBy(*by).orderBy(t, tie)
    own = F.col(value)
    before, after = F.coalesce(F.lag(value).over(w), own), F.coalesce(F.lead(value).over(w), own)
    return F.greatest(F.least(own, before), F.least(F.greatest(own, before), after))


def one_series(df: DataFrame, by: Sequence[str], t: str, tie: str, value: str) -> DataFrame:
    """Overlapping sessions as one series: of rows at one time the first (by ``tie``) stays, rows without a finite time or value go."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    first = F.row_number().over(Window.partitionBy(*by, t).orderBy(tie))
    return df.withColumn("_n", first).where((F.col("_n") == 1) & finite(t) & finite(value)).drop("_n")


def majority(df: DataFrame, by: Sequence[str], value: str, dead: float, least_votes: int = 15, least_share: float = 0.62) -> DataFrame:
    """For each group ``positive`` or ``negative`` if enough values beyond the dead band say so, else null; ``votes``."""
    up, down = F.count_if(F.col(value) > dead), F.count_if(F.col(value) < -dead)
    g = df.groupBy(*by).agg(up.alias("_up"), down.alias("_down")).withColumn("votes", F.col("_up") + F.col("_down"))
    enough = F.col("votes") >= least_votes
    side = F.when(enough & (F.col("_up") >= least_share * F.col("votes")), "positive").when(enough & (F.col("_down") >= least_share * F.col("votes")), "negative")
    return g.withColumn("side", side).drop("_up", "_down")


def first_mode(df: DataFrame, by: Sequence[str], label: str, order: str) -> DataFrame:
    """The label that most rows have, of equals the one seen first; null labels abstain. ``label``, ``n``."""
    seen = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "_first", label)
    return seen.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_first")


def per_second(by: Sequence[str], **series: DataFrame) -> DataFrame:
    """Maps of seconds side by side: by, ``second`` and a column for each series (0 where it has none). Each has by, ``second``, ``value``."""
    parts = [df.select(*by, "second", *(F.col("value").cast("double").alias(n) if n == name else F.lit(None).cast("double").alias(n) for n in series)) for name, df in series.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*by, "second").agg(*(F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in series))
