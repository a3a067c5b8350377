"""Laps, sectors, crossings and bests so far."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import colour
from .common import nan_last, per_rows

EARTH_M = 6_371_000.0
# Fixed values of corners: the percentile, what it is where a session has no such values, degrees of lean, rows looked back.
CORNER_SHARE, PLAIN_ACC, LEAST_LEAN, CORNER_ROWS = 0.6, 0.4, 5.0, 25


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def crosses(lat: Column, lon: Column, lat0: Column, lon0: Column, line: tuple[float, float, float, float]) -> Column:
    """Whether the step from (lat0, lon0) to (lat, lon) strictly crosses the line (lat1, lon1, lat2, lon2)."""
    y1, x1, y2, x2 = map(F.lit, line)
    turn = lambda ax, ay, bx, by, cx, cy: (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)
    return (turn(lon0, lat0, x1, y1, x2, y2) != turn(lon, lat, x1, y1, x2, y2)) & (turn(lon0, lat0, lon, lat, x1, y1) != turn(lon0, lat0, lon, lat, x2, y2))


def lap_numbers(df: DataFrame, by: Sequence[str], t: str, tie: str, crossed: Column) -> DataFrame:
    """``df`` with ``lap``: how many crossings there have been, this row's included. Lap 0 is the way out."""
    w = Window.partitionBy(*by).orderBy(t, tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("lap", F.sum(F.coalesce(crossed, F.lit(False)).cast("int")).over(w))


def lap_table(df: DataFrame, by: Sequence[str], t: str, tie: str, crossed: Column) -> DataFrame:
    """Laps: ``lap``, ``t_start``, ``t_end`` (the next lap's start, or the last row), ``n``, ``out_lap``, ``in_lap`` (the last)."""
    rows = lap_numbers(df, by, t, tie, crossed).groupBy(*by, "lap").agg(F.min(t).alias("t_start"), F.max(t).alias("_last"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("lap")
    after = F.lead("t_start").over(w)
    return rows.withColumns({"t_end": F.coalesce(after, "_last"), "out_lap": F.col("lap") == 0, "in_lap": after.isNull()}).drop("_last")


def line_crossings(track: DataFrame, by: Sequence[str], t: str, lat: str, lon: str, line: tuple[float, float, float, float]) -> DataFrame:
    """Interpolated times at which a track changes sides of a line within its ends: ``t_cross``, ``forward``."""
    y1, x1, y2, x2 = line
    w = Window.partitionBy(*by).orderBy(t)
    side = (F.col(lon) - x1) * (y2 - y1) - (F.col(lat) - y1) * (x2 - x1)
    along = ((F.col(lon) - x1) * (x2 - x1) + (F.col(lat) - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)
    step = track.withColumns({"_s": side, "_a": along})
    step = step.withColumns({"_s0": F.lag("_s").over(w), "_a0": F.lag("_a").over(w), "_t0": F.lag(t).over(w)}).where(F.col("_s0") * F.col("_s") < 0)
    part = F.col("_s0") / (F.col("_s0") - F.col("_s"))
    at = F.col("_a0") + part * (F.col("_a") - F.col("_a0"))
    return step.where((at >= 0) & (at <= 1)).select(*by, (F.col("_t0") + part * (F.col(t) - F.col("_t0"))).alias("t_cross"), (F.col("_s") > 0).alias("forward"))


def thirds(df: DataFrame, by: Sequence[str], order: str, tie: str, step: str, t: str) -> DataFrame:
    """For each group the first ``t`` at which a third and two thirds of the way are done: ``t_first``, ``t_second``, ``way``."""
    w = Window.partitionBy(*by).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    done = df.withColumn("_done", F.sum(step).over(w)).withColumn("_way", F.sum(step).over(all_))
    first = lambda k: F.min(F.when(F.col("_done") >= F.col("_way") * k / 3, F.col(t)))
    return done.groupBy(*by).agg(first(1).alias("t_first"), first(2).alias("t_second"), F.max("_done").alias("way"))


def best_so_far(df: DataFrame, by: Sequence[str], day: str, order: str, tie: str, value: str) -> DataFrame:
    """``df`` with ``best_before`` (of all earlier rows), ``best_day`` (of the whole day, later rows included) and ``colour``."""
    before = Window.partitionBy(*by).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({"best_before": F.min(value).over(before), "best_day": F.min(value).over(Window.partitionBy(*by, day))})
    return out.withColumn("colour", colour(F.col(value), F.col("best_day"), F.col("best_before")))


def recent(df: DataFrame, by: Sequence[str], order: str, tie: str, n: int = 4) -> DataFrame:
    """The latest ``n`` rows of each group, with ``rank`` (1 is the latest)."""
    w = Window.partitionBy(*by).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_lap(df: DataFrame, by: Sequence[str], value: str, row_id: str, usable: Column) -> DataFrame:
    """The least usable value of each group, and whose it is; ties go to the lower id."""
    return df.where(usable).groupBy(*by).agg(F.min(F.struct(F.col(value).alias("v"), F.col(row_id).alias("i"))).alias("b")).select(*by, F.col("b.v").alias("best"), F.col("b.i").alias("best_id"))


def track_map(df: DataFrame, by: Sequence[str], lat: str, lon: str) -> DataFrame:
    """``df`` with ``x`` and ``y`` from 0 to 1; y points down."""
    w = Window.partitionBy(*by)
    part = lambda c: (F.col(c) - F.min(c).over(w)) / F.greatest(F.max(c).over(w) - F.min(c).over(w), F.lit(1e-9))
    return df.withColumns({"x": part(lon), "y": 1 - part(lat)})


def corners(df: DataFrame, by: Sequence[str], lap: str, t: str, speed: str, long_acc: str, lean: str, whole: Column) -> DataFrame:
    """Corners of the laps that are ``whole`` (neither out nor in): by, lap, ``corner``, ``t_start``, ``t_end``, ``before``, ``entry``, ``minimum``, ``max_lean``.

    What counts as braking, driving on and leaning are percentiles of the whole session ``by``. A corner begins with braking, or with leaning
    where none came before; it is entered when the bike leans, and left when it drives on, or is upright again and faster than at its slowest.
    These steps depend on order, so a lap is one group, read row by row.
    """
    level = lambda x: F.percentile(x, F.lit(CORNER_SHARE))
    acc = F.col(long_acc)
    session = df.groupBy(*by).agg(
        F.coalesce(level(F.when(acc > 0, acc)), F.lit(PLAIN_ACC)).alias("_drive"), F.coalesce(level(F.when(acc < 0, -acc)), F.lit(PLAIN_ACC)).alias("_brake"), F.greatest(F.lit(LEAST_LEAN), level(F.abs(lean))).alias("_lean")
    )
    keys = [*by, lap]

    def found(at, speeds, accs, leans, drives, brakes, limits):
        known = lambda xs: [math.nan if x is None else float(x) for x in xs]
        v, a, tilt = known(speeds), known(accs), [abs(x) for x in known(leans)]
        drive, brake, least, n = drives[0], brakes[0], limits[0], len(at)
        most = lambda xs: math.nan if any(x != x for x in xs) else max(xs)
        rows, k = [], 1
        while True:
            start = next((j for j in range(k, n) if a[j] < -brake or tilt[j] >= least), n)
            enter = start
            if start < n and a[start] < -brake:
                enter = next((j for j in range(start + 1, n) if tilt[j] >= least), n)
            if enter >= n:
                break
            slowest, out = v[enter], None
            for j in range(enter + 1, n):
                slowest = v[j] if v[j] < slowest or v[j] != v[j] else slowest
                if a[j] > drive or (not tilt[j] >= least and v[j] > slowest):
                    out = j
                    break
            if out is None:
                break
            rows.append((len(rows), at[start], at[out], most(v[max(0, start - CORNER_ROWS) : start + 1]), v[enter], slowest, most(tilt[enter : out + 1])))
            k = out + 1
        return list(zip(*rows)) or [()] * 7

    ride = df.where(whole).join(session, list(by)).select(*keys, F.col(t).cast("double").alias("_t"), F.col(speed).alias("_v"), acc.alias("_a"), F.col(lean).alias("_n"), "_drive", "_brake", "_lean")
    added = {"corner": "int", "t_start": "double", "t_end": "double", "before": "double", "entry": "double", "minimum": "double", "max_lean": "double"}
    return per_rows(ride, keys, [nan_last(ride, "_t")], ["_t", "_v", "_a", "_n", "_drive", "_brake", "_lean"], added, found)
