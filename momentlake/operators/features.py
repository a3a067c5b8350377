"""What was seen and measured over a moment's pieces: the inputs of a learned score, and of the reasons to leave a moment out.

Moments have ``segments`` (array of recording_id, t_start, t_end); series are long tables by recording_id and t. Every measure is a range join of pieces and
samples and one aggregate; a moment without samples has nulls, never zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LANES_END, local_time
from .cascade import pieces
from .intervals import in_range
from .moments import MIN_PIECE_S

# Fixed values.
ACTION_PAD_S = 0.5
MAX_RIDERS, NEAR_HEIGHT, FAR_WEIGHT, KERB_WEIGHT, UNKNOWN_NEAR = 4, 0.15, 0.2, 0.5, 0.5
KERB_SECONDS, VEHICLES_MOST, RIDING_LEAST = 0.25, 0.4, 0.5
STILL_MOTION, TRACK_MOTION, STOPPED_KMH, TRACK_KMH = 4.0, 10.0, 10.0, 40.0
CORNER_DEG_S, LEAST_STEP_S, GRAVITY = 15.0, 0.05, 9.81
PACE_EXEMPT, ACTION_EXEMPT, RUN_UP_S = ("crash",), ("crash", "own_off_track"), {"own_off_track": 6.0}
THEME_WEIGHT, KNEE_BONUS = {"overtake": 1.5, "overtaken": 1.5, "duel": 1.5, "kneepuck": 1.3, "crash_other": 3.0, "off_track": 2.0}, 1.0
UNPLACED_SLACK_S = 60.0


def _met(parts: DataFrame, samples: DataFrame, pad: float, width: float, *columns: str) -> DataFrame:
    """Pieces with the samples in them: the piece's columns, ``_t`` and the samples' ``columns``."""
    s = samples.select("recording_id", F.col("t").cast("double").alias("_t"), *columns).where("_t IS NOT NULL")
    return in_range(parts, s, ["recording_id"], F.col("t_start") - pad, F.col("t_end") + pad, F.col("_t"), width)


def _in_order(order: Column, value: Column) -> Column:
    """A group's known values of ``value`` as an array in the order of ``order``.

    Sums of doubles depend on their order, and a shuffle hands rows on in any: shares that are compared with a limit, or rounded to a text, are summed in one order, or
    a mean that lies on the limit falls now on this side, now on that. A group is the samples of one piece, or the pieces of one moment.
    """
    one = F.struct(order.alias("o"), value.cast("double").alias("v"))
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), one))), lambda x: x["v"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _mean_in_time(value: Column) -> Column:
    """The mean of ``value`` over a group of ``_met``, summed in order of time; null without any."""
    values = _in_order(F.col("_t"), value)
    return F.try_divide(_total(values), F.size(values).cast("double"))


def _by_seconds(each: DataFrame, moment_id: str, name: str) -> DataFrame:
    """Means of pieces (``m``) weighted by their seconds, summed in order of the pieces."""
    seconds = F.col("t_end") - F.col("t_start")
    known = each.where(F.col("m").isNotNull())
    held = known.groupBy(moment_id).agg(_in_order(F.col("piece"), F.col("m") * seconds).alias("_ms"), _in_order(F.col("piece"), seconds).alias("_s"))
    return held.select(moment_id, F.try_divide(_total(F.col("_ms")), _total(F.col("_s"))).alias(name))


def piece_share(parts: DataFrame, samples: DataFrame, moment_id: str, value: str, name: str, pad: float = 0.0, width: float = 60.0) -> DataFrame:
    """``moment_id``, ``name``: the means of a series over the pieces, weighted by the pieces' seconds."""
    each = _met(parts, samples, pad, width, value).groupBy(moment_id, "piece", "t_start", "t_end").agg(_mean_in_time(F.col(value)).alias("m"))
    return _by_seconds(each, moment_id, name)


def action_value(riders: Column, kerb: Column, height: Column) -> Column:
    """How much there is to see in a second: riders by how near the nearest is, and a kerb."""
    near = F.when((riders > 0) & (height > 0), F.least(F.lit(1.0), F.greatest(F.lit(FAR_WEIGHT), height / NEAR_HEIGHT))).otherwise(UNKNOWN_NEAR)
    return F.least(riders, F.lit(MAX_RIDERS)) * near + KERB_WEIGHT * kerb


def action(parts: DataFrame, seconds: DataFrame, moment_id: str, width: float = 60.0) -> DataFrame:
    """What is seen per second (``riders``, ``kerb``, ``height`` of the nearest, ``lamp``), by moment: ``riders`` (most), ``kerb_share`` (longest), ``nearest_rider``,
    ``action_density`` (by the pieces' seconds), ``red_lamp``, ``rider_share``, ``group_share``, ``closing`` (slope of the nearest one's height, from three on)."""
    met = _met(parts, seconds, ACTION_PAD_S, width, "riders", "kerb", "height", "lamp")
    value = action_value(F.col("riders"), F.col("kerb"), F.coalesce("height", F.lit(0.0)))
    density = _by_seconds(met.groupBy(moment_id, "piece", "t_start", "t_end").agg(_mean_in_time(value).alias("m")), moment_id, "action_density")
    near = F.col("height") > 0
    slope = F.when((F.count_if(near) >= 3) & (F.max(F.when(near, F.col("_t"))) > F.min(F.when(near, F.col("_t")))), F.regr_slope(F.when(near, F.col("height")), F.when(near, F.col("_t"))))
    share = lambda c: F.avg(c.cast("double"))
    seen = met.groupBy(moment_id).agg(
        F.max("riders").alias("riders"), F.max("kerb").alias("kerb_share"), F.max("height").alias("nearest_rider"), F.coalesce(F.bool_or(F.coalesce(F.col("lamp"), F.lit(False))), F.lit(False)).alias("red_lamp"),
        share(F.col("riders") >= 1).alias("rider_share"), share(F.col("riders") >= 2).alias("group_share"), slope.alias("closing"),
    )
    return seen.join(density, moment_id, "left")


def motion(parts: DataFrame, speeds: DataFrame, turns: DataFrame, leans: DataFrame, moment_id: str, width: float = 60.0) -> DataFrame:
    """The bike's own riding (``kmh``, ``yaw``, ``lean``): ``speed_kmh`` (median), ``speed_max``, ``speed_min``, ``speed_change``, ``brake_g``, ``accel_g``, ``turn_rate_max``, ``cornering_share``, ``lean_max``.

    Speeds of all pieces are one series by time; those of the pieces' range need two samples at least, and steps of over LEAST_STEP_S for braking and acceleration.
    """
    at = _met(parts, speeds, 0.0, width, "kmh").where("kmh IS NOT NULL")
    by = Window.partitionBy(moment_id).orderBy("_t", "kmh")
    step = F.col("_t") - F.lag("_t").over(by)
    paced = at.withColumn("_g", F.when(step > LEAST_STEP_S, (F.col("kmh") - F.lag("kmh").over(by)) / 3.6 / step / GRAVITY))
    two = F.count("*") >= 2
    first, last = F.min(F.struct("_t", "kmh"))["kmh"], F.max(F.struct("_t", "kmh"))["kmh"]
    speed = paced.groupBy(moment_id).agg(
        F.median("kmh").alias("speed_kmh"), F.when(two, F.max("kmh")).alias("speed_max"), F.when(two, F.min("kmh")).alias("speed_min"), F.when(two, last - first).alias("speed_change"),
        F.greatest(F.lit(0.0), -F.min("_g")).alias("_brake"), F.greatest(F.lit(0.0), F.max("_g")).alias("_push"), F.count("_g").alias("_steps"),
    ).withColumns({"brake_g": F.when(F.col("_steps") > 0, F.col("_brake")), "accel_g": F.when(F.col("_steps") > 0, F.col("_push"))}).drop("_brake", "_push", "_steps")
    rate = F.abs("yaw")
    turn = _met(parts, turns, 0.0, width, "yaw").where("yaw IS NOT NULL").groupBy(moment_id).agg(F.max(rate).alias("turn_rate_max"), F.avg((rate >= CORNER_DEG_S).cast("double")).alias("cornering_share"))
    lean = _met(parts, leans, 0.0, width, "lean").where("lean IS NOT NULL").groupBy(moment_id).agg(F.max(F.abs("lean")).alias("lean_max"))
    return speed.join(turn, moment_id, "full").join(lean, moment_id, "full")


def run_up(moments: DataFrame) -> DataFrame:
    """Moments as the part whose pace tells track from paddock: for the themes of RUN_UP_S the seconds from one before the first piece on, else all pieces."""
    first = F.get("segments", F.lit(0))
    lead = F.coalesce(*(F.when(F.col("theme") == t, F.lit(s)) for t, s in RUN_UP_S.items()))
    lo = F.greatest(F.lit(0.0), first["t_start"] - 1)
    own = F.array(F.struct(first["recording_id"].alias("recording_id"), lo.alias("t_start"), (lo + lead).alias("t_end")))
    plain = F.transform("segments", lambda s: F.struct(s["recording_id"].alias("recording_id"), s["t_start"].cast("double").alias("t_start"), s["t_end"].cast("double").alias("t_end")))
    return moments.withColumn("segments", F.when(lead.isNotNull(), own).otherwise(plain))


def bridge_gate(moments: DataFrame, on_track: DataFrame, moment_id: str) -> DataFrame:
    """``moment_id``, ``gate``: why a moment is off the stretches (``recording_id``, ``spans``: array of lo, hi, in order) that the bridges say were on track; no row where it is on them, or they can't tell.

    The first piece whose recording is known decides, by its middle.
    """
    known = pieces(moments.select(moment_id, "segments"), [], moment_id).join(on_track, "recording_id")
    w = Window.partitionBy(moment_id).orderBy("piece")
    one = known.withColumn("_k", F.row_number().over(w)).where("_k = 1").withColumn("_mid", (F.col("t_start") + F.col("t_end")) / 2)
    head = F.get("spans", F.lit(0))["lo"]
    text = F.when(F.size("spans") == 0, "no bridge passed in the recording: off track").when(F.col("_mid") < head, F.format_string("before the first bridge pass (%.0f s): off track", head)).otherwise("no bridge for 100 s or more: off track")
    return one.where(~F.exists("spans", lambda s: (F.col("_mid") >= s["lo"]) & (F.col("_mid") <= s["hi"]))).select(moment_id, text.alias("gate"))


def unplaced_pace(moments: DataFrame, guesses: DataFrame, log: DataFrame, moment_id: str, width: float = 600.0) -> DataFrame:
    """``moment_id``, ``unplaced``: ``slow`` if the log shows the bike under way at some reading of a recording's clock that can't be placed, else ``stopped``.

    ``guesses``: recording_id, ``shift`` (seconds from its clock to a reading); ``log``: ``utc``, ``kmh``. The first piece on such a recording decides; other moments have no row.
    """
    known = pieces(moments.select(moment_id, "utc_start", "utc_end", "segments"), ["utc_start", "utc_end"], moment_id).join(guesses, "recording_id")
    w = Window.partitionBy(moment_id)
    mine = known.withColumn("_p", F.min("piece").over(w)).where("piece = _p").select(moment_id, (F.col("utc_start") + F.col("shift") - UNPLACED_SLACK_S).alias("_lo"), (F.col("utc_end") + F.col("shift") + UNPLACED_SLACK_S).alias("_hi"))
    fast = log.where(F.col("kmh") >= STOPPED_KMH).select(F.col("utc").alias("_u"))
    rode = in_range(mine, fast, [], F.col("_lo"), F.col("_hi"), F.col("_u"), width).select(moment_id).distinct().withColumn("_rode", F.lit(True))
    return mine.select(moment_id).distinct().join(rode, moment_id, "left").select(moment_id, F.when(F.col("_rode"), "slow").otherwise("stopped").alias("unplaced"))


def pace(least_kmh: float = TRACK_KMH) -> tuple[Column, Column]:
    """``pace`` (``stopped``, ``slow``, ``track``, or null where nothing was stored) and what it is known from, of the columns ``gate``, ``gps``, ``riding_share``, ``speed_kmh``, ``from_log``, ``motion``, ``riders``, ``unplaced``.

    The camera's own speed goes before all. Without it the bridges, then the share of frames on a riding bike, then the log's speed, then the picture: it stands still; it streams past with a
    rider in view; or the clock isn't placed.
    """
    own = F.coalesce(F.col("gps"), F.lit(False))
    still, streams = F.col("motion") < STILL_MOTION, (F.col("motion") >= TRACK_MOTION) & (F.col("riders") >= 1)
    whole = lambda c: F.bround(c, 0).cast("bigint").cast("string")
    rides = F.concat(F.lit("riding "), whole(F.col("riding_share") * 100), F.lit("% of the time"))
    paced = F.concat(F.when(F.coalesce(F.col("from_log"), F.lit(False)), "log").otherwise("GPS"), F.lit(" "), whole(F.col("speed_kmh")), F.lit(" km/h"))
    cases = [
        (F.col("gate").isNotNull() & ~own, F.lit("slow"), F.col("gate")),
        (F.col("riding_share").isNotNull() & ~own, F.when(F.col("riding_share") >= RIDING_LEAST, "track").when(still, "stopped").otherwise("slow"), rides),
        (F.col("speed_kmh").isNotNull(), F.when(F.col("speed_kmh") < min(STOPPED_KMH, least_kmh), "stopped").when(F.col("speed_kmh") < least_kmh, "slow").otherwise("track"), paced),
        (still, F.lit("stopped"), F.lit("no GPS, the picture stands still")),
        (streams, F.lit("track"), F.concat(F.lit("no GPS, a rider in view while the picture streams past (motion "), whole(F.col("motion")), F.lit(")"))),
        (F.col("unplaced").isNotNull(), F.col("unplaced"), F.lit("no GPS, not placed on the log")),
        (F.col("motion").isNull(), F.lit(None).cast("string"), F.lit("pace not stored")),
    ]
    kind, why = F.lit("slow"), F.lit("no GPS, log or bike in view says track")
    for test, value, text in reversed(cases):
        held = F.coalesce(test, F.lit(False))
        kind, why = F.when(held, value).otherwise(kind), F.when(held, text).otherwise(why)
    return kind, why


def measured(moments: DataFrame, moment_id: str, series: dict[str, DataFrame], width: float = 60.0) -> DataFrame:
    """``moments`` with all that the series tell, and ``pace``, ``pace_from``.

    ``series``: ``action``, ``speeds``, ``turns``, ``leans``, ``riding`` (``share``), ``vehicles`` (``share``), ``motion`` (``motion``), and ``cameras`` (recording_id, ``facing``, ``gps``, ``from_log``); of these that are missing nothing is known. Optional: ``gate`` and ``unplaced``
    by moment. Pace is judged on the run-up (``run_up``), the rest on all pieces.
    """
    spark, empty = moments.sparkSession, "recording_id string, t double"
    of = lambda name, columns: series.get(name) if series.get(name) is not None else spark.createDataFrame([], f"{empty}, {columns}")
    parts = pieces(moments.select(moment_id, "segments"), [], moment_id)
    early = pieces(run_up(moments.select(moment_id, "theme", "segments")), [], moment_id)
    seconds = of("action", "riders int, kerb double, height double, lamp boolean")
    out = moments.join(action(parts, seconds, moment_id, width), moment_id, "left")
    out = out.join(motion(parts, of("speeds", "kmh double"), of("turns", "yaw double"), of("leans", "lean double"), moment_id, width), moment_id, "left")
    out = out.join(piece_share(parts, of("vehicles", "share double"), moment_id, "share", "vehicle_share", 0.0, width), moment_id, "left")
    out = out.join(piece_share(parts, of("riding", "share double"), moment_id, "share", "riding_share", 0.0, width), moment_id, "left")
    half = lambda p, name, column: _met(p, of(name, f"{column} double"), 0.0, width, column).groupBy(moment_id).agg(F.median(column).alias(column))
    out = out.join(half(parts, "motion", "motion"), moment_id, "left")
    cameras = series.get("cameras")
    cameras = spark.createDataFrame([], "recording_id string, facing string, gps boolean, from_log boolean") if cameras is None else cameras
    known = parts.join(cameras, "recording_id", "left")
    told = known.groupBy(moment_id).agg(F.array_sort(F.collect_set("facing")).alias("cameras"), F.bool_or(F.coalesce("gps", F.lit(False))).alias("gps"), F.bool_and(F.coalesce("from_log", F.lit(False))).alias("from_log"))
    out = out.join(told, moment_id, "left")
    for name in ("gate", "unplaced"):
        more = series.get(name)
        out = out.withColumn(name, F.lit(None).cast("string")) if more is None else out.join(more.select(moment_id, name), moment_id, "left")
    # Only moments with a run-up of their own are judged by other pieces than their measures.
    judged = out.select(moment_id, "gate", "gps", "from_log", "unplaced")
    judged = judged.join(piece_share(early, of("riding", "share double"), moment_id, "share", "riding_share", 0.0, width), moment_id, "left")
    judged = judged.join(half(early, "speeds", "kmh").withColumnRenamed("kmh", "speed_kmh"), moment_id, "left").join(half(early, "motion", "motion"), moment_id, "left")
    judged = judged.join(_met(early, seconds, ACTION_PAD_S, width, "riders").groupBy(moment_id).agg(F.max("riders").alias("riders")), moment_id, "left")
    kind, why = pace()
    return out.join(judged.select(moment_id, kind.alias("pace"), why.alias("pace_from")), moment_id, "left")


def moment_features(rows: DataFrame, moment_id: str, types: DataFrame | None = None) -> DataFrame:
    """``moment_id`` and ``features``, a JSON object with what is known of each moment of ``measured``, rounded as it is stored; ``types``: ``moment_id``, ``event_types``."""
    out = rows.withColumn("event_types", F.array().cast("array<string>")) if types is None else rows.join(types.select(moment_id, "event_types"), moment_id, "left").withColumn("event_types", F.coalesce("event_types", F.array().cast("array<string>")))
    digits = {
        "kerb_share": 3, "nearest_rider": 3, "action_density": 3, "speed_kmh": 1, "riding_share": 3, "vehicle_share": 3, "motion": 3, "speed_max": 1, "speed_min": 1, "speed_change": 1, "brake_g": 2, "accel_g": 2, "turn_rate_max": 1,
        "cornering_share": 3, "lean_max": 1, "rider_share": 3, "group_share": 3, "closing": 4,
    }
    seconds = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["t_end"] - x["t_start"])
    hour = F.when(F.col("utc_start") >= LANES_END, F.hour(local_time(F.col("utc_start"), "Europe/Copenhagen")))
    fields = [F.col("theme"), F.col("event_types"), F.round(seconds, 2).alias("duration"), F.size("segments").alias("pieces"), F.col("cameras"), F.array_contains("event_types", "kneepuck").alias("kneepuck"), F.col("riders")]
    fields += [F.round(c, n).alias(c) for c, n in digits.items()]
    fields += [F.col("pace"), F.when(F.col("pace").isNotNull(), F.col("pace_from")).alias("pace_from"), F.coalesce("red_lamp", F.lit(False)).alias("red_lamp"), F.coalesce("gps", F.lit(False)).alias("own_gps"), hour.alias("hour")]
    return out.select(moment_id, F.to_json(F.struct(*fields)).alias("features"))


def event_types(moments: DataFrame, events: DataFrame, moment_id: str, width: float = 60.0) -> DataFrame:
    """``moment_id``, ``event_types``: the types of events of its recordings that touch one of its pieces, in order of name."""
    parts = pieces(moments.select(moment_id, "segments"), [], moment_id)
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    e = events.select("recording_id", F.col("t_start").alias("_s"), F.col("t_end").alias("_e"), "type").where("_s <= _e").withColumn("_bin", reach("_s", "_e"))
    met = parts.where("t_start <= t_end").withColumn("_bin", reach("t_start", "t_end")).join(e, ["recording_id", "_bin"]).where((F.col("_e") >= F.col("t_start")) & (F.col("_s") <= F.col("t_end")))
    return met.groupBy(moment_id).agg(F.array_sort(F.collect_set("type")).alias("event_types"))


def day_moments(rows: DataFrame, recordings: DataFrame | None = None, least_kmh: float = TRACK_KMH, most_vehicles: float = VEHICLES_MOST, lamps: bool = False, why: str = "why") -> DataFrame:
    """Moments of ``measured`` through a day's tests in their order: ``drop_reason`` (null: kept), ``why`` with what was found and the reason last, ``score`` by what there is to see, pieces widened.

    A car in view (not asked of the pace-exempt themes); a red lamp, if ``lamps``; no rider and hardly a kerb in view (not of the action-exempt themes), else the score becomes the action a second times the theme's weight, with a bonus for a knee
    down; pace, not asked of its exempt themes; a piece's recording shorter than MIN_PIECE_S (``recordings``: recording_id, ``duration``; of others nothing is known). Kept moments' pieces last MIN_PIECE_S at least, around their
    middle, and the moment's ends move with its first and last piece. Rows are carried through all tests; one that was left out isn't asked again.
    """
    theme = F.col("theme")
    pace_free, action_free = theme.isin(*PACE_EXEMPT), theme.isin(*ACTION_EXEMPT)
    seen = F.col("riders").isNotNull()
    bare = ~action_free & F.coalesce((F.col("riders") == 0) & (F.col("kerb_share") < KERB_SECONDS), F.lit(False))
    slow = F.when(F.col("pace_from").endswith("off track"), "off track by the bridges").otherwise(f"not on track (below {least_kmh:g} km/h or unknown)")
    car = (~pace_free & (F.coalesce("vehicle_share", F.lit(0.0)) >= most_vehicles)) if most_vehicles > 0 else F.lit(False)
    lamp = F.coalesce("red_lamp", F.lit(False)) if lamps else F.lit(False)
    paced = ~pace_free if least_kmh > 0 else F.lit(False)
    reason = F.when(car, "car in view (paddock)").when(lamp, "red signal lamp (session over)").when(bare, "no rider or kerb in view").when(paced & (F.col("pace") == "stopped"), "standing still").when(paced & (F.col("pace") == "slow"), slow)
    out = rows.withColumn("_early", car | lamp).withColumn("_bare", bare).withColumn("drop_reason", reason)
    none = F.array().cast("array<struct<recording_id: string, duration: double>>")
    lengths = out.withColumn("_lengths", none) if recordings is None else _with_lengths(out, recordings)
    length = lambda s: F.get(F.filter("_lengths", lambda r: r["recording_id"] == s["recording_id"]), F.lit(0))["duration"]
    short = F.exists("segments", lambda s: (s["t_end"] - s["t_start"] < MIN_PIECE_S) & F.coalesce(length(s) < MIN_PIECE_S, F.lit(False)))
    out = lengths.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & short, f"recording shorter than {MIN_PIECE_S:g} s").otherwise(F.col("drop_reason")))

    def wide(s: Column) -> Column:
        middle = (s["t_start"] + s["t_end"]) / 2
        lo = F.greatest(F.lit(0.0), middle - MIN_PIECE_S / 2)
        lo = F.when(length(s).isNotNull(), F.least(lo, length(s) - MIN_PIECE_S)).otherwise(lo)
        enough = s["t_end"] - s["t_start"] >= MIN_PIECE_S
        return F.struct(s["recording_id"].alias("recording_id"), F.when(enough, s["t_start"]).otherwise(lo).cast("double").alias("t_start"), F.when(enough, s["t_end"]).otherwise(lo + MIN_PIECE_S).cast("double").alias("t_end"))

    kept = F.col("drop_reason").isNull()
    plain = F.transform("segments", lambda s: F.struct(s["recording_id"].alias("recording_id"), s["t_start"].cast("double").alias("t_start"), s["t_end"].cast("double").alias("t_end")))
    out = out.withColumn("_wide", F.when(kept, F.transform("segments", wide)).otherwise(plain))
    end = lambda c, k, at: F.element_at(c, F.lit(k))[at]
    weight = F.coalesce(*(F.when(theme == t, F.lit(w)) for t, w in THEME_WEIGHT.items()), F.lit(1.0))
    density = F.col("action_density") + F.when(theme == "kneepuck", KNEE_BONUS).otherwise(0.0)
    asked = ~F.col("_early")
    scored = asked & ~F.col("_bare") & ~action_free & F.col("action_density").isNotNull()
    told_pace = asked & ~F.col("_bare") if least_kmh > 0 else F.lit(False)
    notes = [
        F.when(asked & seen, F.concat(F.col("riders").cast("string"), F.lit(" rider(s) in view"), F.when(F.col("kerb_share") >= KERB_SECONDS, ", kerb close by").otherwise(""))),
        F.when(scored, F.concat(F.lit("action "), F.format_string("%.1f", density), F.lit("/s"))),
        F.when(told_pace, F.when(pace_free, "no pace check for this theme").otherwise(F.col("pace_from"))),
        F.when(~kept, F.concat(F.lit("left out: "), "drop_reason")),
    ]
    said = F.concat(F.coalesce(F.col(why), F.array().cast("array<string>")), F.filter(F.array(*notes), lambda x: x.isNotNull()))
    return out.withColumns({
        why: said, "score": F.when(scored, weight * density).otherwise(F.col("score")),
        "utc_start": F.col("utc_start") + end("_wide", 1, "t_start") - end("segments", 1, "t_start"), "utc_end": F.col("utc_end") + end("_wide", -1, "t_end") - end("segments", -1, "t_end"),
    }).withColumn("segments", F.col("_wide")).drop("_wide", "_early", "_bare", "_lengths")


def _with_lengths(moments: DataFrame, recordings: DataFrame) -> DataFrame:
    """``moments`` with ``_lengths``, the durations of their recordings, by sets of recordings: as many rows as there are different sets."""
    ids = F.array_sort(F.array_distinct(F.transform("segments", lambda s: s["recording_id"])))
    sets = moments.withColumn("_ids", ids)
    one = sets.select("_ids").distinct()
    met = one.withColumn("recording_id", F.explode("_ids")).join(recordings.select("recording_id", F.col("duration").cast("double").alias("duration")), "recording_id")
    held = met.groupBy("_ids").agg(F.collect_list(F.struct("recording_id", "duration")).alias("_lengths"))
    return sets.join(held, "_ids", "left").withColumn("_lengths", F.coalesce("_lengths", F.array().cast(held.schema["_lengths"].dataType))).drop("_ids")

