"""A day's shorts as stages over tables: clocks, crashes, which cameras belong together, the tests, the repeats, the plan, and what is stored of it."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LANE_S, LOCAL_ZONE, epoch, local_time, wall_clock
from .cascade import pieces
from .detect import THEMES
from .features import TRACK_MOTION
from .intervals import in_range
from .moments import per_group, plan_shorts, suppress

# Fixed values.
CRASH_GAP_S, CRASH_BEFORE_S, CRASH_AFTER_S, CRASH_SCORE, AFTER_CRASH_S, AFTER_SAMPLES = 15.0, 6.0, 4.0, 10.0, (3.0, 10.0), 3
RUN_UP_S = 6.0
REAR_PROFILES = ("rear", "rear_right", "rear_rotated")
KINDS = ("short", "vertical", "horizontal")


def facing(seen: Column, profile: Column) -> Column:
    """Which way a camera looks: what the scan read, else its mount's name; front, if neither says."""
    return F.coalesce(F.when(seen != "", seen), F.when(profile.isin(*REAR_PROFILES), "rear").otherwise("front"))


def day_clock(recordings: DataFrame, by: Sequence[str], recording_id: str, start: str) -> DataFrame:
    """``recordings`` with ``offset``: their start on the day's clock. Those without any lie in lanes of LANE_S, one each, by id."""
    lane = Window.partitionBy(*by, F.col(start).isNull()).orderBy(recording_id)
    return recordings.withColumn("offset", F.coalesce(F.col(start).cast("double"), (F.row_number().over(lane) - 1) * LANE_S))


def day_bounds(utc: Column, zone: str = LOCAL_ZONE) -> tuple[Column, Column]:
    """First and last moment (to the millisecond) of the local day of UTC seconds, in UTC seconds."""
    day = F.to_date(local_time(utc, zone))
    at = lambda wall: epoch(F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))
    return at(day.cast("timestamp_ntz")), at(day.cast("timestamp_ntz") + F.expr("interval 86399999 milliseconds"))


def paced_span(kind: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The part of an event whose speed tells track from paddock: the seconds before, where the bike itself ran off."""
    own = kind == "own_off_track"
    return F.when(own, F.greatest(F.lit(0.0), start - RUN_UP_S)).otherwise(start), F.when(own, start).otherwise(end)


def sessions_overlapping(spans: DataFrame, sessions: DataFrame, by: Sequence[str], s0: str, s1: str, e0: str, e1: str, width: float = 3600.0) -> DataFrame:
    """``spans`` with each of ``sessions`` of the same ``by`` that it shares time with; touching is not sharing. Other columns' names must differ."""
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    a, b = spans.where(F.col(s0) < F.col(s1)).withColumn("_bin", reach(s0, s1)), sessions.where(F.col(e0) < F.col(e1)).withColumn("_bin", reach(e0, e1))
    met = a.join(b, [*by, "_bin"]).where(F.col("_bin") == F.floor(F.greatest(s0, e0) / width))
    return met.where((F.col(e0) < F.col(s1)) & (F.col(e1) > F.col(s0))).drop("_bin")


def stopped_crashes(crashes: DataFrame, motion: DataFrame, width: float = 60.0) -> DataFrame:
    """``crashes`` (recording_id, ``t``) without those after which the picture (``motion`` by recording_id, t) goes on streaming past: the bike didn't stop, whatever its speed says."""
    after = in_range(crashes.select("recording_id", "t"), motion.select("recording_id", F.col("t").alias("_t"), "motion"), ["recording_id"], F.col("t") + AFTER_CRASH_S[0], F.col("t") + AFTER_CRASH_S[1], F.col("_t"), width)
    goes_on = after.groupBy("recording_id", "t").agg(F.count("motion").alias("_n"), F.median("motion").alias("_m")).where((F.col("_n") >= AFTER_SAMPLES) & (F.col("_m") >= TRACK_MOTION))
    return crashes.join(goes_on.select("recording_id", "t"), ["recording_id", "t"], "left_anti")


def crash_moments(crashes: DataFrame, by: Sequence[str], gap: float = CRASH_GAP_S) -> DataFrame:
    """One moment for each crash of a day, as several cameras feel it: by, ``theme``, ``utc_start``, ``utc_end``, ``score``, ``segments``.

    ``crashes``: by, recording_id, ``facing``, ``t``, ``offset``. In order of time (then id) a crash that starts less than ``gap`` seconds after the last moment is the same; a front camera takes
    it over from another, and what follows is measured from it.
    """
    lo = F.greatest(F.lit(0.0), F.col("t") - CRASH_BEFORE_S)
    found = crashes.select(*by, "recording_id", (F.col("facing") == "front").alias("front"), lo.alias("lo"), (F.col("t") + CRASH_AFTER_S).alias("hi"), (F.col("offset") + lo).alias("start"))

    def step(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["start", "recording_id"], kind="stable")
        kept: list[int] = []
        for n, (at, front) in enumerate(zip(g["start"], g["front"])):
            if not kept or at - g["start"].iloc[kept[-1]] >= gap:
                kept.append(n)
            elif front and not g["front"].iloc[kept[-1]]:
                kept[-1] = n
        return g.iloc[kept][["recording_id", "lo", "hi", "start"]]

    kinds = f"recording_id {crashes.schema['recording_id'].dataType.simpleString()}, lo double, hi double, start double"
    one = per_group(found, by, kinds, step)
    piece = F.struct("recording_id", F.col("lo").alias("t_start"), F.col("hi").alias("t_end"))
    return one.select(*by, F.lit("crash").alias("theme"), F.col("start").alias("utc_start"), (F.col("start") + F.col("hi") - F.col("lo")).alias("utc_end"), F.lit(CRASH_SCORE).alias("score"), F.array(piece).alias("segments"))


def apart(moments: DataFrame, spans: DataFrame, offsets: DataFrame, by: Sequence[str], moment_id: str, why: str = "why", width: float = 60.0) -> DataFrame:
    """``moments`` without the pieces of cameras that were rated as not together with that of the first piece.

    ``spans``: by, recording_id, ``t_start``, ``t_end`` of rated moments' first pieces. A moment whose first piece overlaps one marks the pairs of its camera and its others, and these are kept apart in all moments of the
    day. If the last piece goes, ``utc_end`` is the end of the last that stays, by its camera's ``offsets`` (by, recording_id, ``offset``); ``why`` names the cameras left out.
    """
    first = F.get("segments", F.lit(0))
    parts = pieces(moments.select(*by, moment_id, "segments"), by, moment_id)
    heads = moments.select(*by, moment_id, first["recording_id"].alias("recording_id"), first["t_start"].alias("_a"), first["t_end"].alias("_b"))
    rated = spans.select(*by, "recording_id", F.col("t_start").alias("_s"), F.col("t_end").alias("_e"))
    flagged = sessions_overlapping(heads, rated, [*by, "recording_id"], "_a", "_b", "_s", "_e", width).select(*by, moment_id, F.col("recording_id").alias("_first")).distinct()
    marked = flagged.join(parts, [*by, moment_id]).where(F.col("recording_id") != F.col("_first"))
    pairs = marked.select(*by, F.least("_first", "recording_id").alias("_p"), F.greatest("_first", "recording_id").alias("_q")).distinct()
    own = parts.join(heads.select(*by, moment_id, F.col("recording_id").alias("_first")), [*by, moment_id]).where(F.col("recording_id") != F.col("_first"))
    bad = own.withColumns({"_p": F.least("_first", "recording_id"), "_q": F.greatest("_first", "recording_id")}).join(pairs, [*by, "_p", "_q"], "left_semi")
    out = bad.groupBy(*by, moment_id).agg(F.array_sort(F.collect_set("recording_id")).alias("_out"))
    met = moments.join(out, [*by, moment_id], "left")
    stay = F.filter("segments", lambda s: ~F.array_contains("_out", s["recording_id"]))
    split = met.withColumn("_stay", F.when(F.col("_out").isNotNull(), stay).otherwise(F.col("segments")))
    last = F.element_at("_stay", -1)
    moved = F.col("_out").isNotNull() & F.array_contains("_out", F.element_at("segments", -1)["recording_id"])
    starts = offsets.select(*by, F.col("recording_id").alias("_last"), F.col("offset").alias("_off"))
    split = split.withColumn("_last", last["recording_id"]).join(starts, [*by, "_last"], "left")
    said = F.concat(F.lit("left out camera "), F.array_join("_out", ", "), F.lit(": not together (rated)"))
    return split.withColumns({
        "utc_end": F.when(moved & F.col("_off").isNotNull(), F.col("_off") + last["t_end"]).otherwise(F.col("utc_end")),
        why: F.when(F.col("_out").isNotNull(), F.array_append(F.coalesce(F.col(why), F.array().cast("array<string>")), said)).otherwise(F.col(why)), "segments": F.col("_stay"),
    }).select(*moments.columns)


def build(moments: DataFrame, by: Sequence[str], moment_id: str, limit: float = 50.0, most_action: int = 0) -> tuple[DataFrame, DataFrame]:
    """The plan of a day's tested moments (``features.day_moments``), and all of them with what became of them.

    The plan: by, ``series``, ``bin``, ``moment_id``, ``place``. All: ``moments`` with ``drop_reason``, which says ``repeat`` for kept ones that a better one covers. Moments without a score come last.
    """
    seconds = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["t_end"] - x["t_start"])
    kept = moments.where("drop_reason IS NULL").withColumn("_seconds", seconds)
    rows = kept.select(*by, moment_id, "utc_start", "utc_end", F.coalesce("score", F.lit(float("-inf"))).alias("score"), "theme", "_seconds")
    shown = suppress(rows, by, moment_id, "utc_start", "utc_end", "score", theme="theme", ranks=THEMES, carried=["theme", "utc_start", "_seconds", "score"])
    plan = plan_shorts(shown, by, moment_id, "theme", "utc_start", "_seconds", "score", limit, most_action)
    best = shown.select(*by, moment_id)
    marked = moments.join(best.withColumn("_best", F.lit(True)), [*by, moment_id], "left")
    every = marked.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & F.col("_best").isNull(), "repeat").otherwise(F.col("drop_reason"))).select(*moments.columns)
    return plan, every


def facets(clips: DataFrame, votes: DataFrame, tags: Sequence[str], day: str = "day", theme: str = "theme", tagged: str = "tags") -> DataFrame:
    """One row: ``days`` and ``themes`` of the clips in order, and ``tags``, the given ones first, then the others that votes have."""
    used = votes.select(F.explode(tagged).alias("_t")).where("_t IS NOT NULL").agg(F.array_sort(F.collect_set("_t")).alias("_used"))
    seen = clips.agg(F.array_sort(F.collect_set(day)).alias("days"), F.array_sort(F.collect_set(theme)).alias("themes"))
    given = F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")
    return seen.join(F.broadcast(used), F.lit(True)).select("days", "themes", F.array_distinct(F.concat(given, "_used")).alias("tags"))


def shown_files(files: DataFrame, by: Sequence[str], kind: str = "kind", path: str = "path", size: str = "size", changed: str = "changed") -> DataFrame:
    """The files that are shown of each clip: those of the best kind that it has (KINDS, else all), copies (of one size and time of change) once, the first by path."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))
    ranked = files.withColumn("_rank", F.when(rank > 0, rank).otherwise(len(KINDS) + 1))
    best = ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy(*by))).where("_rank = _best")
    once = Window.partitionBy(*by, size, changed).orderBy(path)
    return best.withColumn("_k", F.row_number().over(once)).where("_k = 1").select(*files.columns)


def events_json(events: DataFrame, clips: DataFrame | None = None, recording_id: str = "recording_id") -> DataFrame:
    """``recording_id``, ``json``: a recording's events (``extra``: a map) in order of time, times to the millisecond and scores to four places, and its clips. ``clips``: recording_id, ``clip`` (a struct), ``t_start``."""
    # Maps have no order, lists of their entries have.
    row = F.struct("t_start", "t_end", "type", "track_id", "score", F.array_sort(F.map_entries("extra")).alias("x"))
    told_as = lambda e: F.struct(e["type"].alias("type"), F.round(e["t_start"], 3).alias("t_start"), F.round(e["t_end"], 3).alias("t_end"), F.round(e["score"], 4).alias("score"), F.col(recording_id).alias("recording_id"), e["track_id"].alias("track_id"), F.map_from_entries(e["x"]).alias("extra"))
    listed = F.transform(F.array_sort(F.collect_list(row)), told_as)
    told = events.groupBy(recording_id).agg(listed.alias("events"))
    if clips is None:
        return told.select(recording_id, F.to_json(F.struct("events", F.array().cast("array<string>").alias("clips"))).alias("json"))
    cut = clips.groupBy(recording_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("t_start", "clip"))), lambda x: x["clip"]).alias("clips"))
    both = told.join(cut, recording_id, "full")
    return both.select(recording_id, F.to_json(F.struct(F.coalesce("events", F.array().cast(told.schema["events"].dataType)).alias("events"), F.coalesce("clips", F.array().cast(cut.schema["clips"].dataType)).alias("clips"))).alias("json"))


def stored(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, ``json``: a day's moments in order of time, with their local clock, why, pieces, and the reason of those left out."""
    piece = F.transform("segments", lambda s: F.struct(s["recording_id"].alias("recording_id"), F.round(s["t_start"], 3).alias("t_start"), F.round(s["t_end"], 3).alias("t_end")))
    one = F.struct("utc_start", "theme", F.struct("theme", wall_clock(F.col("utc_start"), "HH:mm:ss").alias("clock"), F.round("score", 3).alias("score"), "why", piece.alias("pieces"), "drop_reason").alias("m"))
    whole = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, one))), lambda x: x["m"])
    return moments.groupBy(*by).agg(F.to_json(F.struct(whole(F.col("drop_reason").isNull()).alias("moments"), whole(F.col("drop_reason").isNotNull()).alias("left_out"))).alias("json"))
