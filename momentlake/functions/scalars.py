"""Scalar expressions: clocks, labels, keys, boxes. Columns in, a column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Copenhagen"
#: Clocks before this year were never set.
MIN_CREATION_YEAR = 2005
#: Undated recordings lie in lanes of this many seconds, all below LANES_END.
LANE_S, LANES_END = 1e6, 1e9
EXPLORE_MAX = 4294967295.0
COLOURS = ("purple", "green", "white")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a time stamp without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / F.lit(1e6)


def local_time(utc: Column, zone: str) -> Column:
    """Wall-clock time (without zone) of UTC seconds, whatever the session's zone is."""
    wall = F.timestamp_add("MICROSECOND", (utc * 1e6).cast("bigint"), F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), wall)


def rounded(x: Column) -> Column:
    """Half to even, as a whole number."""
    return F.bround(x, 0).cast("bigint")


def date_label(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    """Local calendar day of UTC seconds; ``unknown`` for null and for clocks that were never set."""
    local = local_time(utc, zone)
    return F.coalesce(F.when(F.year(local) >= MIN_CREATION_YEAR, F.to_date(local).cast("string")), F.lit("unknown"))


def creation_utc(local_digits: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC seconds of wall-clock digits (``yyyy-MM-dd HH:mm:ss``); null for clocks that were never set."""
    wall = local_digits.try_cast("timestamp_ntz")
    return F.when(F.year(wall) >= MIN_CREATION_YEAR, epoch(F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)))


def wall_clock(utc: Column, fmt: str = "HH:mm", zone: str = LOCAL_ZONE) -> Column:
    """Local time of day; in an undated lane, the time into the recording."""
    at = F.when(utc < LANES_END, F.pmod(utc, F.lit(LANE_S))).otherwise(utc)
    return F.date_format(F.when(utc < LANES_END, local_time(at, "UTC")).otherwise(local_time(at, zone)), fmt)


def format_time(seconds: Column) -> Column:
    """``MM:SS.mmm``."""
    minutes = F.floor(seconds / 60)
    return F.concat(F.lpad(minutes.cast("string"), 2, "0"), F.lit(":"), F.format_string("%06.3f", seconds - 60 * minutes))


def clip_key(day: Column, recording: Column, duration: Column, start: Column, theme: Column) -> Column:
    """20 hex digits that name a moment; they bear a recording that was measured a little differently."""
    return F.substring(F.sha1(F.concat_ws("|", day, recording, rounded(duration).cast("string"), rounded(start).cast("string"), theme)), 1, 20)


def explore_draw(key: Column) -> Column:
    """A number from 0 to 1 that only depends on the key."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit("explore|"), key)), 1, 8), 16, 10).cast("double") / F.lit(EXPLORE_MAX)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two spans; 0 where they don't overlap."""
    both = F.least(a1, b1) - F.greatest(a0, b0)
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def shorter_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap as a share of the shorter span."""
    both = F.least(a1, b1) - F.greatest(a0, b0)
    short = F.least(a1 - a0, b1 - b0)
    return F.when((both > 0) & (short > 0), both / short).otherwise(F.lit(0.0))


def colour(value: Column, best_day: Column, best_overall: Column) -> Column:
    """``purple`` as good as ever, ``green`` as good as the day's best, else ``white``; with no best, as good as it."""
    overall, day, plain = COLOURS
    return F.when(best_overall.isNull() | (value <= best_overall), overall).when(best_day.isNull() | (value <= best_day), day).otherwise(plain)


def clip_name(recording: Column, start: Column, types: Column) -> Column:
    return F.format_string("%s_%05d_%s.mp4", recording, start.cast("int"), F.array_join(types, "-"))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def recording_parts(file_name: Column) -> tuple[Column, Column, Column]:
    """Prefix, chapter and recording of a camera's file name (``GX010042.MP4``); empty where it isn't one."""
    rule = r"(?i)^(G[HX])(\d{2})(\d{4})"
    return tuple(F.regexp_extract(file_name, rule, k) for k in (1, 2, 3))


def frame_rate(fraction: Column) -> Column:
    """``30000/1001`` as a number; null for a zero or broken denominator."""
    parts = F.split(fraction, "/")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)))


def quarter_turn(degrees: Column) -> Column:
    """The nearest quarter turn, 0 to 270."""
    return F.pmod(F.bround(degrees / 90, 0).cast("int") * 90, F.lit(360))


def unit_angle(a: Column, b: Column) -> Column:
    """Angle in degrees between two arrays as vectors; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
