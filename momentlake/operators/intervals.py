"""Intervals: islands, runs, overlap and nearest joins, components.

Joins on ranges go through time bins: one side is repeated in each bin that its range touches, the other has one bin, and
the exact condition is kept, so a range join is an equality join that Spark can shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import iou, shorter_share
from .common import checkpoint_folder

MERGE_GAP_S = 1.0
HANDOVER_BEFORE_S, HANDOVER_AFTER_S = 1.5, 5.0
INHERIT_IOU = 0.5
SAME_FOOTAGE = 0.3


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def islands(df: DataFrame, by: Sequence[str], start: str, end: str, tie: str, gap: float = 0.0, strict: bool = False) -> DataFrame:
    """``df`` with ``island``: rows of one ``by`` group whose start is at most ``gap`` after all that came before (less, if ``strict``)."""
    w = Window.partitionBy(*_cols(by)).orderBy(start, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col(start) - reach >= gap) if strict else (F.col(start) - reach > gap)
    return df.withColumn("_apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("island", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_apart")


def merge_same_type(events: DataFrame, by: Sequence[str], start: str = "t_start", end: str = "t_end", score: str = "score", tie: str = "ordinal", gap: float = MERGE_GAP_S, extra: str | None = None) -> DataFrame:
    """One row for each run of events of a group with gaps of at most ``gap``: span, best score, count; a later event's ``extra`` entries win."""
    aggs = [F.min(start).alias(start), F.max(end).alias(end), F.max(score).alias(score), F.count("*").alias("n")]
    if extra:
        entries = F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("_s"), F.col(tie).alias("_t"), F.map_entries(extra).alias("_e")))), lambda x: x["_e"])
        aggs.append(entries.alias("_extra"))
    out = islands(events, by, start, end, tie, gap).groupBy(*by, "island").agg(*aggs).drop("island")
    if extra:
        flat = F.flatten("_extra")
        last = F.filter(flat, lambda e, i: ~F.exists(F.slice(flat, i + 2, F.size(flat)), lambda later: later["key"] == e["key"]))
        out = out.withColumn(extra, F.map_from_entries(last)).drop("_extra")
    return out


def merge_spans(df: DataFrame, by: Sequence[str], start: str, end: str, tie: str, strict: bool = False, gap: float = 0.0) -> DataFrame:
    """Merged spans of each group. Spans that touch are one, unless ``strict``."""
    return islands(df, by, start, end, tie, gap, strict).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def runs(df: DataFrame, by: Sequence[str], t: str, flag: str, tie: str, min_count: int = 1, min_seconds: float = 0.0, max_gap: float | None = None) -> DataFrame:
    """Runs of rows with ``flag``: ``t_start``, ``t_end``, ``n``. A row without it ends a run, and so does a gap over ``max_gap``."""
    w = Window.partitionBy(*_cols(by)).orderBy(t, tie)
    on = F.coalesce(F.col(flag), F.lit(False))
    broken = ~on | ~F.coalesce(F.lag(on.cast("int")).over(w) == 1, F.lit(False))
    if max_gap is not None:
        broken = broken | (F.col(t) - F.lag(t).over(w) > max_gap)
    marked = df.withColumn("_on", on).withColumn("_new", broken.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.where("_on").groupBy(*by, "_run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count("*").alias("n")).drop("_run")
    return out.where((F.col("n") >= min_count) & (F.col("t_end") - F.col("t_start") >= min_seconds))


def runs_after(df: DataFrame, by: Sequence[str], t: str, value: str, tie: str, high: float, low: float, min_seconds: float, before_seconds: float) -> DataFrame:
    """Runs of values of at least ``high`` that last ``min_seconds``, right after a run of at most ``low`` that lasted ``before_seconds``. A value between ends both."""
    w = Window.partitionBy(*_cols(by)).orderBy(t, tie)
    state = F.when(F.col(value) >= high, 2).when(F.col(value) <= low, 1).otherwise(0)
    marked = df.withColumn("_state", state)
    marked = marked.withColumn("_new", F.coalesce((F.lag("_state").over(w) != F.col("_state")).cast("int"), F.lit(1)))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy(*by, "_run", "_state").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count("*").alias("n"))
    v = Window.partitionBy(*_cols(by)).orderBy("_run")
    road = (F.lag("_state").over(v) == 1) & (F.lag("t_end").over(v) - F.lag("t_start").over(v) >= before_seconds)
    return spans.withColumn("_road", road).where((F.col("_state") == 2) & (F.col("t_end") - F.col("t_start") >= min_seconds) & F.col("_road")).drop("_run", "_state", "_road")


def in_range(spans: DataFrame, points: DataFrame, by: Sequence[str], lo: Column, hi: Column, t: Column, width: float) -> DataFrame:
    """Rows of ``spans`` with each row of ``points`` of the same ``by`` whose ``t`` is in [lo, hi]. Other columns' names must differ.

    ``width``: seconds of a bin; about the usual length of a span is right.
    """
    bins = F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    a = spans.where(lo <= hi).withColumn("_bin", bins)
    b = points.withColumn("_bin", F.floor(t / width))
    return a.join(b, [*by, "_bin"]).where((t >= lo) & (t <= hi)).drop("_bin")


def nearest_after(firsts: DataFrame, seconds: DataFrame, by: Sequence[str], at: str, t: str, first_id: str, second_id: str, before: float = HANDOVER_BEFORE_S, after: float = HANDOVER_AFTER_S) -> DataFrame:
    """Each of ``firsts`` with the one of ``seconds`` that begins nearest to its ``at``, from ``before`` seconds before to ``after`` after it.

    One of ``seconds`` may serve several. Ties go to the lower ``second_id``.
    """
    found = in_range(firsts, seconds, by, F.col(at) - before, F.col(at) + after, F.col(t), before + after)
    w = Window.partitionBy(first_id).orderBy(F.abs(F.col(t) - F.col(at)), second_id)
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlap_pairs(df: DataFrame, by: Sequence[str], start: str, end: str, row_id: str, least: float = INHERIT_IOU, share: str = "iou", width: float = 3600.0) -> DataFrame:
    """Pairs ``a`` < ``b`` of rows of a group whose overlap is at least ``least`` (of the union, of the shorter span with ``share="shorter"``, in seconds with ``share="seconds"``)."""
    binned = df.select(*by, F.col(row_id).alias("i"), F.col(start).alias("s"), F.col(end).alias("e")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    a, b = binned.alias("a"), binned.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, "_bin")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    # Both spans are in the bin where the later one begins; a pair is taken there only.
    there = F.col("a._bin") == F.floor(F.greatest("a.s", "b.s") / width)
    value = {"iou": iou, "shorter": shorter_share, "seconds": lambda a0, a1, b0, b1: F.least(a1, b1) - F.greatest(a0, b0)}[share](F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e"))
    pairs = a.join(b, cond & (F.col("a.i") < F.col("b.i")) & there & (value >= least) & (value > 0))
    return pairs.select(*(F.col(f"a.{c}").alias(c) for c in by), F.col("a.i").alias("a"), F.col("b.i").alias("b"), value.alias("overlap"))


def best_overlap(spans: DataFrame, sources: DataFrame, by: Sequence[str], s0: str, s1: str, c0: str, c1: str, span_id: str, source_id: str, least_share: float = 0.6, width: float = 3600.0) -> DataFrame:
    """Each span with the source that covers most of it, if that is at least ``least_share`` of it; ties go to the lower id."""
    touching = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s0) / width), F.floor(F.col(s1) / width)))).join(
        sources.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(c0) / width), F.floor(F.col(c1) / width)))), [*by, "_bin"]
    )
    touching = touching.where(F.col("_bin") == F.floor(F.greatest(s0, c0) / width))
    both = F.least(s1, c1) - F.greatest(s0, c0)
    w = Window.partitionBy(span_id).orderBy(F.desc("covered"), source_id)
    return touching.withColumn("covered", both).where((both > 0) & (both >= least_share * (F.col(s1) - F.col(s0)))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_bin")


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node that links reach) for every node of ``pairs``; labels spread and jump until they stay, each round checkpointed."""
    checkpoint_folder(pairs.sparkSession)
    both = pairs.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(pairs.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct().checkpoint()
    labels = both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")).checkpoint()
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "root": "_near"}), "other").groupBy("node").agg(F.min("_near").alias("_near"))
        spread = labels.join(near, "node").select("node", F.least("root", "_near").alias("root"), F.col("root").alias("_old"))
        jumped = spread.join(labels.select(F.col("node").alias("_n"), F.col("root").alias("_far")), F.col("root") == F.col("_n"), "left").select("node", F.least("root", F.coalesce("_far", "root")).alias("root"), "_old").checkpoint()
        labels = jumped.drop("_old")
        if jumped.where("root <> _old").isEmpty():
            return labels
