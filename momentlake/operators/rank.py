"""Latest rows, gates, bands, blends, keyed updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import explore_draw
from .common import checkpoint_folder

EXPLORE = 0.1
NEVER_SKIP = ("crash", "own_off_track")
BLEND_FROM, BLEND_FULL = 30, 200
ROUND_SIZE = 15
#: Patterns that are tried on each row; more are joined by their text.
FEW_PATTERNS = 1000


def latest(df: DataFrame, by: Sequence[str], order: str, tie: str) -> DataFrame:
    """The latest row of each group, ties by the higher ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def vote_stats(votes: DataFrame, by: Sequence[str], order: str, tie: str, vote: str) -> DataFrame:
    """One row: how many groups' latest votes are up, down and cleared."""
    return latest(votes, by, order, tie).agg(*(F.count_if(c).alias(n) for n, c in (("up", F.col(vote) > 0), ("down", F.col(vote) < 0), ("cleared", F.col(vote) == 0))))


def tagged(votes: DataFrame, by: Sequence[str], order: str, tie: str, tags: str, tag: str) -> DataFrame:
    """Groups whose latest vote has ``tag``."""
    return latest(votes, by, order, tie).where(F.array_contains(tags, tag))


def gate(df: DataFrame, by: Sequence[str], key: str, score: str, theme: str | None = None, min_score: float = 0.0, top: float = 0.0, explore: float = EXPLORE, exempt: Sequence[str] = NEVER_SKIP) -> DataFrame:
    """``df`` with ``kept`` and ``reason``. Rows without a score, exempt themes and explored rows stay.

    ``top``: percent of a group's scored rows, rounded up; ties by key. 0 is no limit.
    """
    w = Window.partitionBy(*by, F.col(score).isNull()).orderBy(F.desc(score), key)
    rank, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by, F.col(score).isNull()))
    free = F.col(score).isNull()
    if theme and exempt:
        free = free | F.coalesce(F.col(theme).isin(*exempt), F.lit(False))
    low = F.col(score) < min_score
    late = (rank > F.ceil(n * F.lit(min(top, 100.0)) / 100)) if top > 0 else F.lit(False)
    marked = df.withColumns({"_free": free, "_low": low, "_late": late, "_draw": explore_draw(F.col(key).cast("string")) < explore})
    reason = F.when(F.col("_free"), "exempt").when(~F.col("_low") & ~F.col("_late"), "score").when(F.col("_draw"), "explored").when(F.col("_low"), "low").otherwise("late")
    return marked.withColumn("reason", reason).withColumn("kept", F.col("reason").isin("exempt", "score", "explored")).drop("_free", "_low", "_late", "_draw")


def rank_share(by: Sequence[str], score: str, tie: str) -> Column:
    """Place of a row in its group's scores, 0 to 1; 0.5 for the only one."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    return F.when(n > 1, (F.row_number().over(w.orderBy(score, tie)) - 1) / F.nullif(n - 1, F.lit(0))).otherwise(F.lit(0.5))


def blend_weight(votes: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (votes - BLEND_FROM) / F.lit(float(BLEND_FULL - BLEND_FROM))))


def _places(df: DataFrame, score: str, tie: str) -> DataFrame:
    """``df`` with ``_i``, the 0-based place of a row among all, and ``_n``, their number: places in ranges of the ranking, moved by the rows in the ranges before."""
    checkpoint_folder(df.sparkSession)
    # Written first: ranges are sampled, and must be the same for the counts and the places.
    ranged = df.repartitionByRange(F.desc(score), F.col(tie)).withColumn("_p", F.spark_partition_id()).checkpoint()
    before, total = [], 0
    for r in ranged.groupBy("_p").count().orderBy("_p").collect():  # a row for each range
        before.append((r["_p"], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(before, "_p int, _before long")
    w = Window.partitionBy("_p").orderBy(F.desc(score), tie)
    placed = ranged.withColumn("_i", F.row_number().over(w) - 1).join(F.broadcast(starts), "_p")
    return placed.withColumns({"_i": F.col("_i") + F.col("_before"), "_n": F.lit(total).cast("long")}).drop("_p", "_before")


def bands(df: DataFrame, by: Sequence[str], score: str, tie: str, size: int = ROUND_SIZE) -> DataFrame:
    """``df`` with ``band`` (0-based, by place, best first) and ``third``. Bands are cut at even places of the ranking.

    Without ``by`` all rows are one group, and no task holds it.
    """
    if by:
        w = Window.partitionBy(*by)
        out = df.withColumns({"_i": F.row_number().over(w.orderBy(F.desc(score), tie)) - 1, "_n": F.count("*").over(w)})
    else:
        out = _places(df, score, tie)
    part = F.when(F.col("_n") > 1, F.col("_i") / F.nullif(F.col("_n") - 1, F.lit(0))).otherwise(F.lit(0.0))
    out = out.withColumn("band", (F.ceil(F.lit(size) * (F.col("_i") + 1) / F.col("_n")) - 1).cast("int"))
    return out.withColumn("third", F.when(part < 1 / 3, "high").when(part < 2 / 3, "medium").otherwise("low")).drop("_i", "_n")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Rows of both by key; the one of higher version stays, of equal version the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def first_of(df: DataFrame, fingerprint: Sequence[str], order: str) -> DataFrame:
    """Rows that are the first of their fingerprint. A row with a null in it is no one's duplicate."""
    w = Window.partitionBy(*fingerprint).orderBy(order)
    blank = F.lit(False)
    for c in fingerprint:
        blank = blank | F.col(c).isNull()
    return df.withColumn("_n", F.row_number().over(w)).withColumn("_blank", blank).where("_n = 1 OR _blank").drop("_n", "_blank")


def offsets(df: DataFrame, by: Sequence[str], order: str, length: str) -> DataFrame:
    """``df`` with ``offset``: the lengths of the rows before it in its group. A null length doesn't move it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0.0)))


def chapter_at(chapters: DataFrame, probes: DataFrame, by: Sequence[str], offset: str, length: str, at: str, probe_id: str, order: str) -> DataFrame:
    """The chapter that is on at each probe's time: half-open spans; before 0 the first, at or after the end the last."""
    w = Window.partitionBy(*by)
    ends = chapters.withColumns({"_first": F.col(order) == F.min(order).over(w), "_last": F.col(order) == F.max(order).over(w)})
    inside = (F.col("_first") | (F.col(at) >= F.col(offset))) & (F.col("_last") | (F.col(at) < F.col(offset) + F.coalesce(length, F.lit(0.0))))
    pick = Window.partitionBy(probe_id).orderBy(F.desc(order))
    return probes.join(ends, list(by)).where(inside).withColumn("_n", F.row_number().over(pick)).where("_n = 1").drop("_n", "_first", "_last")


def longest_match(df: DataFrame, patterns: DataFrame, text: str, row_id: str, pattern: str = "pattern", value: str = "value", few: int = FEW_PATTERNS) -> DataFrame:
    """``row_id`` and the ``value`` of the longest pattern that ``text`` contains (ties: the pattern that sorts first).

    Up to ``few`` patterns are broadcast and tried on each row; more are met by their text, with every part of a row's text that has the length of a pattern.
    """
    listed = patterns.select(F.col(pattern).alias(pattern), F.col(value).alias(value)).where(F.length(pattern) > 0)
    if listed.limit(few + 1).count() <= few:
        found = df.join(F.broadcast(listed), F.contains(F.col(text), F.col(pattern)))
    else:
        lengths = [r["n"] for r in listed.select(F.length(pattern).alias("n")).distinct().collect()]  # no more than the longest pattern has letters
        parts = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))
        every = F.array_distinct(F.flatten(F.filter(F.array(*map(parts, lengths)), lambda x: x.isNotNull())))
        found = df.withColumn("_part", F.explode(every)).join(listed, F.col("_part") == F.col(pattern))
    return found.groupBy(row_id).agg(F.min(F.struct((-F.length(pattern)).alias("n"), F.col(pattern).alias("p"), F.col(value).alias("v"))).alias("b")).select(row_id, F.col("b.p").alias(pattern), F.col("b.v").alias(value))
