"""Position tracks: turn rates, times of samples between packet stamps, the stamp of the first sample, times at a distance along the track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import framed_means, numbered
from .series import asof, interpolated

# Fixed values.
METRES_PER_DEGREE = 111_320.0
TURN_LEAST_KMH, TURN_SMOOTH_S = 15.0, 1.0
STAMP_GAP_S, STAMP_MOST_S, FIRST_YEAR = 1.0, 3.0, 2020


def gradient(value: str, t: str, by: Sequence[str], order: str) -> Column:
    """Slope of ``value`` over ``t`` at each row: of the parabola through a row and its two neighbours, at the ends of the line to the one neighbour. Null where two times are equal, and for a lone row."""
    w = Window.partitionBy(*by).orderBy(order)
    x, at = F.col(value), F.col(t)
    before, after = at - F.lag(t).over(w), F.lead(t).over(w) - at
    back, ahead = F.try_divide(x - F.lag(value).over(w), before), F.try_divide(F.lead(value).over(w) - x, after)
    middle = F.try_divide(back * after + ahead * before, before + after)
    return F.when(before.isNull(), ahead).when(after.isNull(), back).otherwise(middle)


def unwrapped(angle: str, by: Sequence[str], order: str) -> Column:
    """An angle in radians without its jumps: the running sum of steps that are each brought to half a turn at most."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.col(angle) - F.lag(angle).over(w)
    turn = 2 * 3.141592653589793
    short = F.pmod(step + turn / 2, F.lit(turn)) - turn / 2
    short = F.when((short == -turn / 2) & (step > 0), turn / 2).otherwise(short)
    return F.when(F.abs(step) < turn / 2, step).otherwise(short)


def yaw_rates(track: DataFrame, by: Sequence[str], t: str, tie: str, lat: str, lon: str, kmh: str, smooth: float = TURN_SMOOTH_S, least: float = TURN_LEAST_KMH) -> DataFrame:
    """``by``, ``t``, ``tie``, ``yaw``: degrees a second, to the right positive, 0 below ``least``.

    Metres north and east of the track's middle are averaged over as many rows as ``smooth`` seconds have on average, their slopes give the heading, whose jumps
    are taken out; its slope is averaged likewise. Tracks of under three rows, or of no length in time, are 0. Rows with a null time or place take
    no part; of rows at one time the first by ``tie`` does.
    """
    group = Window.partitionBy(*by)
    keys = list(by)
    fixed = track.select(*by, t, tie, lat, lon, kmh).where(F.col(t).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    once = numbered(fixed, [*by, t], [tie], "_first").where("_first = 1").drop("_first")
    middle = once.groupBy(*by).agg(F.median(lat).alias("_lat0"), F.median(lon).alias("_lon0"))
    rows = numbered(once.join(middle, keys), by, [t])
    span = F.max(t).over(group) - F.min(t).over(group)
    rows = rows.withColumns({"_many": F.count("*").over(group), "_span": span})
    rows = rows.withColumn("_k", F.greatest(F.lit(1), F.coalesce(F.bround(F.try_divide(smooth * F.col("_many"), F.col("_span")), 0), F.lit(1)).cast("int")))
    north = (F.col(lat) - F.col("_lat0")) * METRES_PER_DEGREE
    east = (F.col(lon) - F.col("_lon0")) * METRES_PER_DEGREE * F.cos(F.radians("_lat0"))
    flat = framed_means(rows.withColumns({"_north": north, "_east": east}), by, "_n", F.col("_k"), ["_north", "_east"])
    heading = flat.withColumn("_h", F.atan2(gradient("_east", t, by, "_n"), gradient("_north", t, by, "_n")))
    whole = heading.withColumn("_d", F.coalesce(unwrapped("_h", by, "_n"), F.lit(0.0))).withColumn("_u", F.sum("_d").over(group.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    rate = F.degrees(gradient("_u", t, by, "_n"))
    turned = whole.withColumn("yaw", F.when(F.col(kmh) < least, 0.0).otherwise(rate))
    mean = framed_means(turned, by, "_n", F.col("_k"), ["yaw"])
    return mean.select(*by, t, tie, F.when((F.col("_many") < 3) | (F.col("_span") <= 0), 0.0).otherwise(F.col("yaw")).alias("yaw"))


def spread(packets: DataFrame, by: Sequence[str], order: str, stamp: str, points: str, gap: float = STAMP_GAP_S, most: float = STAMP_MOST_S) -> DataFrame:
    """A row for each of a packet's ``points`` (an array): ``by``, ``order``, ``place`` (from 0), ``utc``, ``point``, evenly from its stamp to the next packet's.

    Packets without a stamp or without points are left out before. Where the next stamp is not after this one, or over ``most`` seconds away, and
    for the last packet, the gap is ``gap``.
    """
    kept = packets.where(F.col(stamp).isNotNull() & (F.size(points) > 0))
    ahead = F.lead(stamp).over(Window.partitionBy(*by).orderBy(order)) - F.col(stamp)
    step = F.when((ahead > 0) & (ahead <= most), ahead).otherwise(F.lit(float(gap)))
    rows = kept.withColumn("_step", step / F.size(points)).select(*by, order, stamp, "_step", F.posexplode(points).alias("place", "point"))
    return rows.select(*by, order, "place", (F.col(stamp) + F.col("place") * F.col("_step")).alias("utc"), "point")


def start_by_stamps(packets: DataFrame, by: Sequence[str], order: str, stamp: str, durations: DataFrame | None = None, duration: str = "duration", gap: float = STAMP_GAP_S) -> DataFrame:
    """``by``, ``start_utc``: the first stamp, carried back to the first packet.

    Packets before it (without a stamp) are taken to be as far apart as the recording's ``duration`` over their number says, else ``gap``. Groups without any stamp
    have no row.
    """
    known = numbered(packets, by, [order]).groupBy(*by).agg(F.count("*").alias("_many"), F.min(F.when(F.col(stamp).isNotNull(), F.struct(F.col("_n"), F.col(stamp).alias("_t")))).alias("_f")).where("_f IS NOT NULL")
    met = known.withColumn("_d", F.lit(None).cast("double")) if durations is None else known.join(durations.select(*by, F.col(duration).cast("double").alias("_d")), list(by), "left")
    step = F.when((F.col("_d") > 0) & (F.col("_many") > 1), F.col("_d") / F.col("_many")).otherwise(F.lit(float(gap)))
    return met.select(*by, (F.col("_f._t") - (F.col("_f._n") - 1) * step).alias("start_utc"))


def packet_stamp(text: Column) -> Column:
    """UTC seconds of a packet's own stamp (``yyMMddHHmmss``, with or without a fraction); null for others and for years before FIRST_YEAR."""
    raw = F.trim(text)
    digits = F.regexp_extract(raw, r"^(\d{12})(\.\d{1,6})?$", 1)
    at = F.try_to_timestamp(F.concat(F.lit("20"), F.when(digits != "", digits)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    whole = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)
    part = F.coalesce(F.concat(F.lit("0"), F.regexp_extract(raw, r"^\d{12}(\.\d{1,6})$", 1)).try_cast("double"), F.lit(0.0))
    return F.when(F.year(at) >= FIRST_YEAR, whole + part)


def along_track(track: DataFrame, crossings: DataFrame, by: Sequence[str], t: str, lat: str, lon: str, crossing: str, crossing_id: str, metres: float) -> DataFrame:
    """``by``, ``crossing_id``, ``utc``: when the track is ``metres`` further along than at each crossing.

    The way is the running sum of the steps' lengths. A crossing before or after the track is at its end; one whose goal lies beyond the track has no row. Where the
    track stands still at the goal, the last of its times there counts, and times between samples are by equal pace. Degrees may be given as minutes (a
    median over 90). Rows of null time or place, and all but the first place of one time, take no part.
    """
    group = Window.partitionBy(*by)
    kept = track.select(*by, F.col(t).alias("_t"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).where("_t IS NOT NULL AND _lat IS NOT NULL AND _lon IS NOT NULL")
    once = numbered(kept, [*by, "_t"], ["_lat", "_lon"], "_k").where("_k = 1")
    sizes = once.groupBy(*by).agg(F.median(F.abs("_lat")).alias("_a"), F.median(F.abs("_lon")).alias("_o"), F.median("_lat").alias("_m"))
    rows = once.join(sizes, list(by))
    minutes = lambda c, of: F.col(c) / F.when(F.col(of) > 90, 60.0).otherwise(1.0)
    rows = rows.withColumns({"_y": minutes("_lat", "_a"), "_x": minutes("_lon", "_o"), "_y0": minutes("_m", "_a")})
    w = group.orderBy("_t")
    step = F.hypot((F.col("_y") - F.lag("_y").over(w)) * METRES_PER_DEGREE, (F.col("_x") - F.lag("_x").over(w)) * METRES_PER_DEGREE * F.cos(F.radians("_y0")))
    way = rows.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("_way", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*by, "_t", "_way")
    asked = crossings.select(*by, F.col(crossing_id).alias("_id"), F.col(crossing).cast("double").alias("_t")).where("_t IS NOT NULL")
    found = asof(asked, way, by, "_t", "_way", "_id")
    ends = way.groupBy(*by).agg(F.max("_way").alias("_end"))
    goals = found.select(*by, "_id", (interpolated(found, "_t") + metres).alias("_way")).join(ends, list(by)).where(F.col("_way") <= F.col("_end")).drop("_end")
    times = asof(goals, way, by, "_way", "_t", "_id", latest_before=True)
    return times.select(*by, F.col("_id").alias(crossing_id), interpolated(times, "_way").alias("utc"))
