"""Audit of how document filters interact: what each removes, at each step, in every order they can be applied in.

A row's failures are a mask of five bits. Rows are counted by part and mask, at most 32 cells a part, and every order of the filters is read
from the cells: a filter at some step removes the cells that hold its bit and none of the bits before it. So
orders cost nothing but cells, however many rows there are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the five conditions.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"


def own_mask(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 of conditions A to D, which one text decides alone. Null counts as empty: it fails A only."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, BLANKS), lambda w: w != "")
    # One element, so that the words are made once for both counts.
    counts = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), F.lit(0))
    few = F.get(F.transform(F.array(counts), lambda c: F.when(c["n"] < LEAST_WORDS, 1).otherwise(0) + F.when(100 * c["d"] < LEAST_DISTINCT * c["n"], 2).otherwise(0)), F.lit(0))
    loud = 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(t)
    return few + F.when(loud, 4).otherwise(0) + F.when(F.rlike(t, F.lit(MARKS)), 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: the rows of each part by what they fail, and how many of these the labels call good and toxic.

    Condition E is a text that a smaller ``doc_id`` has too, anywhere in the table. Texts meet by SHA-256, so that whole texts are read once and never
    shuffled; equal rows are summed before they meet, so that a text of a third of all rows is a few sums. A row that is there twice counts
    twice, and both are first if one is. A row without an id has no labels and doesn't fail E. Of several labels of one id any 1 counts.
    """
    said = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("_good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("_toxic")
    )
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("_text"), own_mask(F.col(text)).alias("_mask"))
    known = rows.join(said, "_id", "left").fillna(0, ["_good", "_toxic"])
    alike = ["_text", "part", "_mask", "_good", "_toxic"]
    each = known.groupBy("_id", *alike).agg(F.count("*").alias("_n"))  # lies as the join left it
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n")))
    sums = each.groupBy(*alike).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_id").isNotNull(), F.col("_n")).otherwise(0)).alias("_with_id"), first.alias("_first"))
    least = F.min("_first._id").over(Window.partitionBy("_text"))
    firsts = F.when(F.col("_first._id") == F.col("_least"), F.col("_first._n")).otherwise(0)
    sums = sums.withColumn("_least", least).withColumn("_late", F.col("_with_id") - firsts)
    bit = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("_mask").alias("m"), (F.col("n") - F.col("_late")).alias("k")), F.struct((F.col("_mask") + bit).alias("m"), F.col("_late").alias("k"))))
    split = sums.select("part", both.alias("_c"), "_good", "_toxic").where("_c.k > 0")
    return split.groupBy("part", F.col("_c.m").alias("mask")).agg(F.sum("_c.k").alias("n"), F.sum(F.col("_c.k") * F.col("_good")).alias("good"), F.sum(F.col("_c.k") * F.col("_toxic")).alias("toxic"))


def audit(counted: DataFrame, filters: Sequence[str] = FILTERS, part: str = "part") -> DataFrame:
    """Every order of the filters over cells (``part``, ``mask``, ``n``, ``good``, ``toxic``): a row for each part, ``filter_order`` and ``step``.

    The step's filter is that letter of the order; its bit in ``mask`` is its place in ``filters``. ``kept`` and ``removed``: rows after and in this
    step; ``redundant``: rows that fail the filter and were removed before; ``unique_fails``: rows that fail nothing else;
    ``good_lost``, ``toxic_lost``: labelled rows removed here; ``shapley``: what the filter removes, over all orders. A row that
    fails k filters is removed by each of them in one order of k, so it counts n! / k times for each. No cells, no rows.
    """
    n = len(filters)
    steps = []
    for order in permutations(range(n)):
        before = 0
        for k, f in enumerate(order):
            steps.append({"o": "".join(filters[x] for x in order), "k": k + 1, "b": before, "f": 1 << f})
            before |= 1 << f
    whole = counted.groupBy(part).agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_cells"))  # at most 2 ^ n of them
    s = F.col("_s")
    out = whole.withColumn("_s", F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<o: string, k: int, b: int, f: int>>")))

    def total(what: str, test) -> Column:
        return F.aggregate(F.filter("_cells", test), F.lit(0).cast("long"), lambda acc, c: acc + c[what])

    here = lambda c: (c["mask"].bitwiseAND(s["f"]) != 0) & (c["mask"].bitwiseAND(s["b"]) == 0)
    share = F.aggregate(F.filter("_cells", lambda c: c["mask"].bitwiseAND(s["f"]) != 0), F.lit(0).cast("long"), lambda acc, c: acc + c["n"] * (F.lit(factorial(n)) / F.bit_count(c["mask"])).cast("long"))
    return out.select(
        part, s["o"].alias("filter_order"), s["k"].alias("step"),
        total("n", lambda c: c["mask"].bitwiseAND(s["b"].bitwiseOR(s["f"])) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda c: (c["mask"].bitwiseAND(s["f"]) != 0) & (c["mask"].bitwiseAND(s["b"]) != 0)).alias("redundant"),
        total("n", lambda c: c["mask"] == s["f"]).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )
