"""Sampled series: buckets, span aggregates, as-of and interpolation, smoothing, slopes, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import in_range

SPEED_PAD_S, NEAREST_S, MIN_TRACK_KMH, MOVING_PAD_S = 0.5, 5.0, 40.0, 0.15
SLOPE_POINTS = 8


def bucket_median(df: DataFrame, by: Sequence[str], t: str, value: str, width: float = 1.0) -> DataFrame:
    """Median of each bucket, labelled by its middle."""
    k = F.floor(F.col(t) / width)
    return df.groupBy(*by, k.alias("_k")).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count("*").alias("n")).withColumn("t", (F.col("_k") + 0.5) * F.lit(float(width))).drop("_k")


def bucket_share(df: DataFrame, by: Sequence[str], t: str, flag: Column, width: float = 1.0) -> DataFrame:
    """Share of rows with ``flag`` in each bucket."""
    k = F.floor(F.col(t) / width)
    return df.groupBy(*by, k.alias("_k")).agg(F.avg(flag.cast("double")).alias("share")).withColumn("t", (F.col("_k") + 0.5) * F.lit(float(width))).drop("_k")


def bucket_most_distinct(df: DataFrame, by: Sequence[str], t: str, what: str, frame: float, width: float) -> DataFrame:
    """Most distinct values of ``what`` in one frame, for each bucket of frames."""
    frames = df.groupBy(*by, F.floor(F.col(t) / width).alias("_k"), F.floor(F.col(t) / frame).alias("_f")).agg(F.countDistinct(what).alias("_n"))
    return frames.groupBy(*by, "_k").agg(F.max("_n").alias("most")).withColumn("t", (F.col("_k") + 0.5) * F.lit(float(width))).drop("_k")


def span_share(spans: DataFrame, samples: DataFrame, by: Sequence[str], s0: str, s1: str, t: str, value: str, span_id: str, pad: float = 0.5, width: float = 3600.0) -> DataFrame:
    """``span_id``, mean of the samples in the padded span and their number; null and 0 without samples."""
    found = in_range(spans, samples, by, F.col(s0) - pad, F.col(s1) + pad, F.col(t), width).groupBy(span_id).agg(F.avg(F.col(value).cast("double")).alias("share"), F.count("*").alias("n"))
    return spans.select(span_id).join(found, span_id, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def median_or_nearest(spans: DataFrame, samples: DataFrame, by: Sequence[str], s0: str, s1: str, t: str, value: str, span_id: str, least: float = MIN_TRACK_KMH, pad: float = SPEED_PAD_S, reach: float = NEAREST_S, width: float = 3600.0) -> DataFrame:
    """Is a span's median at least ``least``? Without samples in the padded span the nearest to its middle decides, if within ``reach``; else it is kept."""
    middle = (F.col(s0) + F.col(s1)) / 2
    inside = (F.col(t) >= F.col(s0) - pad) & (F.col(t) <= F.col(s1) + pad)
    off = F.abs(F.col(t) - middle)
    near = in_range(spans, samples, by, F.least(F.col(s0) - pad, middle - reach), F.greatest(F.col(s1) + pad, middle + reach), F.col(t), width)
    found = near.groupBy(span_id).agg(
        F.percentile(F.when(inside, F.col(value)), F.lit(0.5)).alias("_median"), F.min(F.when(off <= reach, F.struct(off.alias("o"), F.col(t).alias("t"), F.col(value).alias("v"))))["v"].alias("_near")
    )
    joined = spans.select(span_id).join(found, span_id, "left")
    return joined.select(span_id, F.coalesce("_median", "_near").alias("value")).withColumn("kept", F.coalesce(F.col("value") >= least, F.lit(True)))


def moving_or_nearest(events: DataFrame, samples: DataFrame, by: Sequence[str], s0: str, s1: str, t: str, value: str, event_id: str, threshold: float, pad: float = MOVING_PAD_S, width: float = 3600.0) -> DataFrame:
    """``event_id`` and ``moving``: whether the median of the samples in the padded span is ``threshold`` at least.

    With fewer than two of them the sample of the recording that is nearest to the middle decides (ties: the earlier, then the lower); without any, and
    for a threshold of 0 or less, an event counts as moving.
    """
    if threshold <= 0:
        return events.select(event_id, F.lit(True).alias("moving"))
    inside = in_range(events, samples, by, F.col(s0) - pad, F.col(s1) + pad, F.col(t), width).groupBy(event_id).agg(F.percentile(value, F.lit(0.5)).alias("_median"), F.count(value).alias("_n"))
    known = events.join(inside, event_id, "left").where("_n IS NULL OR _n < 2").select(*by, event_id, ((F.col(s0) + F.col(s1)) / 2).alias(t))
    sides = asof(known, samples, by, t, value, event_id)
    after = F.col("before_t").isNull() | (F.col("after_t") - F.col(t) < F.col(t) - F.col("before_t"))
    nearest = sides.select(event_id, F.when(after, F.col("after_v")).otherwise(F.col("before_v")).alias("_nearest"))
    out = events.select(event_id).join(inside, event_id, "left").join(nearest, event_id, "left")
    return out.select(event_id, F.coalesce(F.when(F.col("_n") >= 2, F.col("_median")).otherwise(F.col("_nearest")) >= threshold, F.lit(True)).alias("moving"))


def asof(probes: DataFrame, points: DataFrame, by: Sequence[str], t: str, value: str, probe_id: str, latest_before: bool = False) -> DataFrame:
    """``probe_id`` with the last point at or before it (``before_t``, ``before_v``) and the first at or after it (``after_t``, ``after_v``).

    One sort of both together; no join on ranges. Points at a probe's time count on both sides; of several at one time the one of the least value counts
    (before the probe the one of the greatest, with ``latest_before``).
    """
    a = points.select(*by, F.col(t).alias("_t"), F.lit(None).cast(probes.schema[probe_id].dataType).alias(probe_id), F.col(value).cast("double").alias("_v"), F.lit(1).alias("_point"))
    b = probes.select(*by, F.col(t).alias("_t"), probe_id, F.lit(None).cast("double").alias("_v"), F.lit(0).alias("_point"))
    both = a.unionByName(b)
    point = F.when(F.col("_point") == 1, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    back = Window.partitionBy(*by).orderBy(F.col("_t"), F.desc("_point"), F.asc("_v") if latest_before else F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col("_t"), F.col("_point"), F.col("_v")).rowsBetween(0, Window.unboundedFollowing)
    out = both.withColumn("_b", F.last(point, ignorenulls=True).over(back)).withColumn("_a", F.first(point, ignorenulls=True).over(ahead)).where("_point = 0")
    return out.select(*by, probe_id, F.col("_t").alias(t), F.col("_b.t").alias("before_t"), F.col("_b.v").alias("before_v"), F.col("_a.t").alias("after_t"), F.col("_a.v").alias("after_v"))


def interpolated(found: DataFrame, t: str) -> Column:
    """Linear between the two sides of ``asof``; the ends are held."""
    part = F.try_divide(F.col(t) - F.col("before_t"), F.col("after_t") - F.col("before_t"))
    return F.coalesce(F.col("before_v") + F.coalesce(part, F.lit(0.0)) * (F.col("after_v") - F.col("before_v")), "before_v", "after_v")


def sliding_slope(df: DataFrame, by: Sequence[str], t: str, size: str, tie: str, points: int = SLOPE_POINTS, log: bool = True) -> DataFrame:
    """Slope of the (logarithm of the) size over the last ``points`` rows, for full windows only."""
    w = Window.partitionBy(*by).orderBy(t, tie).rowsBetween(1 - points, 0)
    y = F.log(F.greatest(F.col(size), F.lit(1.0))) if log else F.col(size)
    return df.withColumn("slope", F.regr_slope(y, F.col(t)).over(w)).withColumn("_n", F.count("*").over(w)).where(F.col("_n") == points).drop("_n")


def rolling_median(df: DataFrame, by: Sequence[str], t: str, value: str, half: float) -> Column:
    """Median of the values from ``half`` before to ``half`` after. Spark has no framed median; the frame's values are sorted instead."""
    micros = round(half * 1e6)  # a range frame takes whole numbers
    w = Window.partitionBy(*by).orderBy(F.round(F.col(t) * 1e6).cast("bigint")).rangeBetween(-micros, micros)
    v = F.array_sort(F.collect_list(value).over(w))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def moving_average(by: Sequence[str], t: str, tie: str, value: str, k: int) -> Column:
    """Mean of ``k`` rows around (for an even k one more before than after); at the ends, of those that there are."""
    w = Window.partitionBy(*by).orderBy(t, tie).rowsBetween(-(k // 2), k - 1 - k // 2)
    return F.avg(value).over(w)


def lag_correlation(a: DataFrame, b: DataFrame, by: Sequence[str], k: str, va: str, vb: str, most: int) -> DataFrame:
    """Correlation of two series at each lag from -most to most steps: ``lag``, ``r`` (null where one of them doesn't vary), ``n``."""
    # corr() fails on a series that doesn't vary.
    r = F.try_divide(F.covar_pop(va, vb), F.stddev_pop(va) * F.stddev_pop(vb))
    shifted = b.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn(k, F.col(k) - F.col("lag"))
    return a.join(shifted, [*by, k]).groupBy(*by, "lag").agg(r.alias("r"), F.count("*").alias("n"))


def offset_grid(a: DataFrame, b: DataFrame, by: Sequence[str], k: str, va: str, vb: str, offsets: Sequence[int]) -> DataFrame:
    """The offset at which the two series differ least, by the median of their differences; ties go to the lower offset. ``offset``, ``cost``, ``n``."""
    shifted = b.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn(k, F.col(k) + F.col("offset"))
    cost = a.join(shifted, [*by, k]).groupBy(*by, "offset").agg(F.percentile(F.abs(F.col(va) - F.col(vb)), F.lit(0.5)).alias("cost"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("cost", "offset")
    return cost.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def landmark_vote(passes: DataFrame, landmarks: DataFrame, by: Sequence[str], t: str, mark: str, search: float = 180.0, tol: float = 0.3) -> DataFrame:
    """For each group the shift that brings most passes within ``tol`` of a landmark: ``shift``, ``pairs``.

    Candidates are the differences of a pass and a landmark of at most ``search`` seconds, rounded to ``tol``; ties go to the
    smaller shift in size, then the lower.
    """
    near = in_range(passes, landmarks, by, F.col(t) - search, F.col(t) + search, F.col(mark), search)
    votes = near.select(*by, F.col(t), (F.bround((F.col(mark) - F.col(t)) / tol, 0)).cast("bigint").alias("_k")).distinct().groupBy(*by, "_k").agg(F.count("*").alias("pairs"))
    w = Window.partitionBy(*by).orderBy(F.desc("pairs"), F.abs(F.col("_k")), "_k")
    return votes.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*by, (F.col("_k") * F.lit(tol)).alias("shift"), "pairs")
