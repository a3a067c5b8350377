"""Events from boxes and telemetry, and themed moments from events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import in_range, nearest_after, runs
from .moments import cooldown

# Classes of the detector and thresholds of the events.
PERSON, CAR, MOTORCYCLE, BUS, TRUCK = 0, 2, 3, 5, 7
VEHICLES = (CAR, BUS, TRUCK)
MIN_VEHICLE_HEIGHT = 0.08
MIN_BOX_HEIGHT, MIN_POINTS, MIN_TRACK_S = 0.05, 4, 0.6
NEARBY_HEIGHT, NEARBY_AREA, NEARBY_S, SLOPE, SLOPE_POINTS, SLOPE_S = 0.11, 0.01, 0.3, 0.32, 8, 0.25
EDGE, EGO_EDGE_SHARE, EGO_S, EGO_DRIFT, EGO_SIZE, EGO_POINTS = 0.02, 0.6, 2.0, 0.04, 0.1, 5
OFFTRACK_SHARE, ONTRACK_SHARE, OFFTRACK_POINTS, OFFTRACK_HEIGHT, OFFTRACK_LEAST = 0.5, 0.2, 3, 0.06, 6
KERB_SHARE, KERB_FRAMES = 0.04, 4
SWAP_MARGIN, SWAP_HOLD, SWAP_S, SWAP_SHARED = 1.15, 3, 3.0, 6
CRASH_JOLT, CRASH_SPEED, CRASH_STOPPED, CRASH_COOLDOWN_S = 3.0, 30.0, 8.0, 15.0
CRASH_SAMPLES, CRASH_BEFORE_S, CRASH_AFTER_S = 3, 4.0, (3.0, 10.0)
THEMES = ("overtake", "overtaken", "catching_up", "duel", "kneepuck", "crash", "crash_other", "off_track", "own_off_track")
MIN_CATCH_UP_S, MAX_SEGMENT_S = 1.5, 7.0
MOUNTED_OVERLAP, MOUNTED_SHARE, RIDER_HEIGHT = 0.2, 0.3, 0.03
BY = ("recording_id", "track_id")


def height() -> Column:
    return F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0)) / F.greatest(F.col("frame_h"), F.lit(1))


def area() -> Column:
    return F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0)) * F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0))


def centre() -> Column:
    return (F.col("x1") + F.col("x2")) / 2 / F.greatest(F.col("frame_w"), F.lit(1))


def middle() -> Column:
    return (F.col("y1") + F.col("y2")) / 2 / F.greatest(F.col("frame_h"), F.lit(1))


def inside(rect: tuple[float, float, float, float]) -> Column:
    """Whether a box's centre is in a rectangle (left, top, right, bottom, in shares of the frame); its borders count."""
    left, top, right, bottom = rect
    return centre().between(left, right) & middle().between(top, bottom)


def vehicles_in_view(points: DataFrame) -> DataFrame:
    """For each frame whether a vehicle fills enough of it."""
    seen = F.col("cls").isin(*VEHICLES) & (height() >= MIN_VEHICLE_HEIGHT)
    return points.groupBy("recording_id", "t").agg(F.bool_or(seen).alias("seen"))


def ego_tracks(points: DataFrame) -> DataFrame:
    """Tracks that are the camera's own bike: of some points, long, at the frame's edge, moving neither way and of one size."""
    edge = (F.col("x1") <= EDGE * F.col("frame_w")) | (F.col("x2") >= (1 - EDGE) * F.col("frame_w")) | (F.col("y2") >= (1 - EDGE) * F.col("frame_h"))
    high = F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0))
    stats = points.groupBy(*BY).agg(
        F.avg(edge.cast("double")).alias("e"), (F.max("t") - F.min("t")).alias("s"), F.count("*").alias("n"),
        F.stddev_pop(centre()).alias("dx"), F.stddev_pop(middle()).alias("dy"), F.stddev_pop(high).alias("hd"), F.avg(high).alias("h"),
    )
    still = (F.col("dx") < EGO_DRIFT) & (F.col("dy") < EGO_DRIFT) & (F.col("hd") < EGO_SIZE * F.greatest("h", F.lit(1e-6)))
    return stats.where((F.col("n") >= EGO_POINTS) & (F.col("e") >= EGO_EDGE_SHARE) & (F.col("s") >= EGO_S) & still).select(*BY)


def rider_events(points: DataFrame) -> DataFrame:
    """``nearby_rider`` runs, and an ``approaching_rider`` or ``receding_rider`` for each window of points over which the log of the box's area
    has a steep slope (``merge_same_type`` joins them later). Own bikes, small boxes and short tracks are left out."""
    others = points.join(ego_tracks(points), list(BY), "left_anti").where(height() >= MIN_BOX_HEIGHT)
    track = Window.partitionBy(*BY)
    others = others.withColumns({"_count": F.count("*").over(track), "_span": F.max("t").over(track) - F.min("t").over(track)})
    others = others.where((F.col("_count") >= MIN_POINTS) & (F.col("_span") >= MIN_TRACK_S))
    near = (height() >= NEARBY_HEIGHT) | (area() / F.greatest(F.col("frame_w") * F.col("frame_h"), F.lit(1)) >= NEARBY_AREA)
    order = track.orderBy("t")
    marked = others.withColumn("_near", near).withColumn("_run", F.row_number().over(order) - F.row_number().over(Window.partitionBy(*BY, "_near").orderBy("t")))
    runs_ = marked.where("_near").groupBy(*BY, "_run").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.max(height()).alias("score"))
    out = runs_.where(F.col("t_end") - F.col("t_start") >= NEARBY_S).select(*BY, F.lit("nearby_rider").alias("type"), "t_start", "t_end", "score")
    # A track shorter than a window is one window.
    last = order.rowsBetween(1 - SLOPE_POINTS, 0)
    y = F.log(F.greatest(area(), F.lit(1.0)))
    sloped = others.withColumns({"slope": F.regr_slope(y, F.col("t")).over(last), "t_start": F.min("t").over(last), "_n": F.row_number().over(order)})
    whole = (F.col("_n") >= SLOPE_POINTS) | (F.col("_n") == F.col("_count"))
    kind = F.when(F.col("slope") >= SLOPE, "approaching_rider").when(F.col("slope") <= -SLOPE, "receding_rider")
    moving = sloped.where(whole & (F.col("t") - F.col("t_start") >= SLOPE_S)).withColumn("type", kind).where("type IS NOT NULL")
    return out.unionByName(moving.select(*BY, "type", "t_start", F.col("t").alias("t_end"), F.abs("slope").alias("score")))


def off_track(points: DataFrame) -> DataFrame:
    """Runs of points off the track, of tracks that were clearly on it before: ``BY``, ``t_start``, ``t_end``, ``n``.

    Only other bikes' and riders' boxes that are large enough count, and tracks with enough of them; between on and off a run ends, but the track isn't on the road yet.
    """
    size = Window.partitionBy(*BY)
    large = points.where(height() >= OFFTRACK_HEIGHT).join(ego_tracks(points), list(BY), "left_anti").withColumn("_count", F.count("*").over(size)).where(F.col("_count") >= OFFTRACK_LEAST)
    before = Window.partitionBy(*BY).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    was_on = F.coalesce(F.max((F.col("offtrack") < ONTRACK_SHARE).cast("int")).over(before) == 1, F.lit(False))
    marked = large.withColumns({"_off": F.col("offtrack") >= OFFTRACK_SHARE, "_was": was_on}).withColumn("_off", F.col("_off") & F.col("_was"))
    return runs(marked, BY, "t", "_off", "t", min_count=OFFTRACK_POINTS)


def kerbs(samples: DataFrame) -> DataFrame:
    """Runs of frames with enough kerb in them."""
    return runs(samples.withColumn("_kerb", F.col("share") >= KERB_SHARE), ["recording_id"], "t", "_kerb", "t", min_count=KERB_FRAMES)


def mounted(points: DataFrame) -> DataFrame:
    """Bike tracks with the ``share`` of their frames in which a person sits on them, and those frames' number ``n``.

    A person sits on a bike if the middle of its box is above the bike's, its top in the bike's upper half or higher, and enough of it lies on the bike's.
    """
    at = F.bround("t", 3)
    bikes = points.where(F.col("cls") == MOTORCYCLE).select("recording_id", at.alias("f"), "track_id", F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("y1").alias("b1"), F.col("y2").alias("b2"))
    people = points.where(F.col("cls") == PERSON).select("recording_id", at.alias("f"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("y1").alias("q1"), F.col("y2").alias("q2"))
    wide, high = F.least("a2", "p2") - F.greatest("a1", "p1"), F.least("b2", "q2") - F.greatest("b1", "q1")
    own = F.greatest(F.greatest(F.col("p2") - F.col("p1"), F.lit(0.0)) * F.greatest(F.col("q2") - F.col("q1"), F.lit(0.0)), F.lit(1e-9))
    over = ((F.col("p1") + F.col("p2")) / 2).between(F.col("a1"), F.col("a2")) & (F.col("q1") <= (F.col("b1") + F.greatest("b1", "b2")) / 2)
    on = over & (wide > 0) & (high > 0) & (wide * high >= MOUNTED_OVERLAP * own)
    frames = bikes.join(people, ["recording_id", "f"], "left").groupBy("recording_id", "track_id", "f", "a1", "a2", "b1", "b2").agg(F.coalesce(F.bool_or(on), F.lit(False)).alias("on"))
    return frames.groupBy("recording_id", "track_id").agg(F.avg(F.col("on").cast("double")).alias("share"), F.count("*").alias("n"))


def nearest_rider(points: DataFrame) -> DataFrame:
    """``recording_id``, ``second``, ``height``, ``riders``: in each second the height of the nearest other rider, and the most of them in one frame. Riders are bikes with a person on, and not the camera's own."""
    riders = mounted(points).where(F.col("share") >= MOUNTED_SHARE).select(*BY)
    seen = points.where((F.col("cls") == MOTORCYCLE) & (height() >= RIDER_HEIGHT)).join(riders, list(BY), "left_semi").join(ego_tracks(points), list(BY), "left_anti")
    second = F.floor("t").alias("second")
    frames = seen.groupBy("recording_id", second, F.bround("t", 3).alias("_f")).agg(F.max(height()).alias("_h"), F.countDistinct("track_id").alias("_n"))
    return frames.groupBy("recording_id", "second").agg(F.max("_h").alias("height"), F.max("_n").alias("riders"))


def passes(points: DataFrame) -> DataFrame:
    """Pairs of bikes in view together that change places by height: ``a`` < ``b``, ``t_start``, ``t_end``. The order must hold for some frames on each side of the swap."""
    bikes = points.where(F.col("cls") == MOTORCYCLE).select("recording_id", F.bround("t", 3).alias("t"), "track_id", height().alias("h"))
    a, b = bikes.alias("a"), bikes.alias("b")
    both = a.join(b, (F.col("a.recording_id") == F.col("b.recording_id")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.track_id") < F.col("b.track_id")))
    both = both.select(F.col("a.recording_id").alias("recording_id"), F.col("a.t").alias("t"), F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b"), F.col("a.h").alias("ha"), F.col("b.h").alias("hb"))
    pair = ["recording_id", "a", "b"]
    lead = F.when(F.col("ha") >= SWAP_MARGIN * F.col("hb"), 1).when(F.col("hb") >= SWAP_MARGIN * F.col("ha"), -1)
    w = Window.partitionBy(*pair).orderBy("t")
    shared = F.count("*").over(Window.partitionBy(*pair))
    led = both.withColumns({"_lead": lead, "_n": shared}).where((F.col("_n") >= SWAP_SHARED) & F.col("_lead").isNotNull())
    led = led.withColumn("_new", F.coalesce((F.lag("_lead").over(w) != F.col("_lead")).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = led.groupBy(*pair, "_run", "_lead").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n")).where(F.col("n") >= SWAP_HOLD)
    v = Window.partitionBy(*pair).orderBy("_run")
    swap = held.withColumns({"_l0": F.lag("_lead").over(v), "t_start": F.lag("e").over(v)})
    return swap.where((F.col("_l0") != F.col("_lead")) & (F.col("s") - F.col("t_start") <= SWAP_S)).select(*pair, "t_start", F.col("s").alias("t_end"))


def crashes(speed: DataFrame, accel: DataFrame) -> DataFrame:
    """Jolts of several times the usual acceleration with speed before and standstill after, the next one some seconds later at the earliest: ``recording_id``, ``t``.

    ``speed``: recording_id, t, kmh; ``accel``: recording_id, t, ax, ay, az.
    """
    sized = accel.withColumn("g", F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2))
    usual = sized.groupBy("recording_id").agg(F.percentile("g", F.lit(0.5)).alias("usual")).where("usual > 0")
    jolts = sized.join(usual, "recording_id").where(F.col("g") >= CRASH_JOLT * F.col("usual")).select("recording_id", "t").distinct()
    at, since = F.col("ts"), F.col("ts") - F.col("t")
    near = in_range(jolts, speed.withColumnRenamed("t", "ts"), ["recording_id"], F.col("t") - CRASH_BEFORE_S, F.col("t") + CRASH_AFTER_S[1], at, CRASH_BEFORE_S + CRASH_AFTER_S[1])
    before, after = since <= 0, since >= CRASH_AFTER_S[0]
    half = lambda c: F.percentile(F.when(c, F.col("kmh")), F.lit(0.5))
    sides = near.groupBy("recording_id", "t").agg(half(before).alias("before"), half(after).alias("after"), F.count_if(after).alias("n"))
    stopped = (F.col("before") >= CRASH_SPEED) & (F.col("after") <= CRASH_STOPPED) & (F.col("n") >= CRASH_SAMPLES)
    found = sides.where(stopped).select("recording_id", "t", F.row_number().over(Window.partitionBy("recording_id").orderBy("t")).cast("long").alias("ordinal"))
    return found.join(cooldown(found, ["recording_id"], "t", "ordinal", CRASH_COOLDOWN_S), ["recording_id", "ordinal"]).select("recording_id", "t")


def overtakes(events: DataFrame, by: Sequence[str] = ("day",)) -> DataFrame:
    """Handovers between cameras: a rider who approaches the front camera's bike and recedes behind the rear one, or the other way round.

    ``events``: by, ordinal, facing, type, utc_start, utc_end. Gives theme, first, second, utc_start, utc_end.
    """
    rules = (("overtaken", "rear", "approaching_rider", "front", "receding_rider"), ("overtake", "front", "approaching_rider", "rear", "receding_rider"))
    out = None
    for theme, f1, k1, f2, k2 in rules:
        first = events.where((F.col("facing") == f1) & (F.col("type") == k1)).select(*by, F.col("ordinal").alias("first"), F.col("utc_start").alias("_s"), F.col("utc_end").alias("_e"))
        second = events.where((F.col("facing") == f2) & (F.col("type") == k2)).select(*by, F.col("ordinal").alias("second"), F.col("utc_start").alias("_t"), F.col("utc_end").alias("_u"))
        found = nearest_after(first, second, by, "_e", "_t", "first", "second")
        found = found.select(*by, F.lit(theme).alias("theme"), "first", "second", F.col("_s").alias("utc_start"), F.greatest("_e", "_u").alias("utc_end"))
        out = found if out is None else out.unionByName(found)
    return out


def _piece(recording: Column, lo: Column, hi: Column, most: float | None = MAX_SEGMENT_S) -> Column:
    """A span of a recording from 0 on, of at most ``most`` seconds (its last ones)."""
    lo = F.greatest(F.lit(0.0), lo)
    return F.struct(recording.alias("recording_id"), (F.greatest(lo, hi - most) if most else lo).alias("t_start"), hi.alias("t_end"))


def themed_moments(events: DataFrame, by: Sequence[str] = ("day",)) -> DataFrame:
    """Moments: by, ``theme``, ``utc_start``, ``utc_end``, ``score``, ``segments`` and ``ordinals`` (of their events).

    ``events``: by, ordinal, recording_id, facing, type, t_start, t_end, utc_offset, score. Handovers between cameras come first; an event that
    is in none, and not of a type with a theme of its own, is ``action``. ``moments.suppress`` then drops repeats.
    """
    clocked = events.withColumns({"utc_start": F.col("utc_offset") + F.col("t_start"), "utc_end": F.col("utc_offset") + F.col("t_end")})
    pairs = overtakes(clocked, by).select(*by, "theme", "first", "second")
    side = lambda name: clocked.select(*by, F.col("ordinal").alias(name), F.struct("recording_id", "t_start", "t_end", "utc_offset", "score").alias(f"_{name}"))
    both = pairs.join(side("first"), [*by, "first"]).join(side("second"), [*by, "second"])
    a, b = F.col("_first"), F.col("_second")
    handed = both.select(
        *by, "theme", _piece(a["recording_id"], a["t_start"] - 1.0, a["t_end"] + 0.5).alias("_a"), _piece(b["recording_id"], b["t_start"] - 0.3, b["t_start"] + 3.0, None).alias("_b"),
        a["utc_offset"].alias("_u"), b["utc_offset"].alias("_v"), (a["score"] + b["score"]).alias("score"), F.array("first", "second").alias("ordinals"),
    ).select(*by, "theme", (F.col("_u") + F.col("_a.t_start")).alias("utc_start"), (F.col("_v") + F.col("_b.t_end")).alias("utc_end"), "score", F.array("_a", "_b").alias("segments"), "ordinals")
    used = pairs.select(*by, F.explode(F.array("first", "second")).alias("ordinal")).distinct()
    free = clocked.join(used, [*by, "ordinal"], "left_anti")
    long = F.col("t_end") - F.col("t_start")
    # theme: which events, seconds before and after, what the score is multiplied by
    rules = [
        ("catching_up", (F.col("facing") == "front") & (F.col("type") == "approaching_rider") & (long >= MIN_CATCH_UP_S), 1.0, 1.0, long),
        ("duel", F.col("type") == "rider_pass", 2.0, 2.0, F.lit(1.0)),
        ("kneepuck", F.col("type") == "kneepuck_visible", 1.5, 1.5, F.lit(1.0)),
        ("crash_other", F.col("type") == "rider_down", 4.0, 3.0, F.lit(5.0)),
        ("off_track", F.col("type") == "off_track", 2.0, 2.0, F.lit(2.0)),
        ("own_off_track", F.col("type") == "own_off_track", 5.0, 3.0, F.lit(4.0)),
    ]
    chain = lambda value, rest: F.coalesce(*(F.when(check, value(name, before, after, times)) for name, check, before, after, times in rules), rest)
    peak = (F.col("t_start") + F.col("t_end")) / 2
    piece = chain(lambda name, before, after, _: _piece(F.col("recording_id"), F.col("t_start") - before, F.col("t_end") + after, None if name == "own_off_track" else MAX_SEGMENT_S), _piece(F.col("recording_id"), peak - 3.0, peak + 3.0))
    single = free.select(
        *by, chain(lambda name, *_: F.lit(name), F.lit("action")).alias("theme"), piece.alias("_a"), "utc_offset", (F.col("score") * chain(lambda _n, _b, _a, times: times, F.lit(1.0))).alias("score"), F.array("ordinal").alias("ordinals")
    )
    return handed.unionByName(single.select(*by, "theme", (F.col("utc_offset") + F.col("_a.t_start")).alias("utc_start"), (F.col("utc_offset") + F.col("_a.t_end")).alias("utc_end"), "score", F.array("_a").alias("segments"), "ordinals"))
