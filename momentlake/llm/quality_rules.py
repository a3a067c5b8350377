"""Quality rules: counted rules, and a log-likelihood ratio of hashed n-grams.

Two multinomials over buckets of hashed words and word pairs are estimated, one from trusted documents,
one from the whole corpus. A document's verdict is the mean, over its n-grams, of the log of the ratio of
the two probabilities, against a fixed threshold. Everything is DataFrame expressions: one pass counts
n-grams (summed on the map side, a row for each bucket is all that is shuffled), one pass judges each row where it lies.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Buckets of hashed n-grams.
BUCKETS = 1 << 14
#: Trusted documents that the target multinomial is estimated from, at most (those whose hashed ids are least).
TRUSTED_ROWS = 20_000
#: N-grams that the corpus lends to the trusted counts.
PRIOR = 4 * BUCKETS
#: Least mean log-likelihood ratio of a document that is kept.
THRESHOLD = -0.08
#: White space between words.
BLANKS = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words in a window whose repetition counts.
SPAN = 5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20


def words_of(text: Column) -> Column:
    """The words of a text between white space; none for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def without(text: Column, letters: str) -> Column:
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def buckets_of(hashes: Column) -> Column:
    """The buckets of the words' hashes and of each two neighbours'."""
    pairs = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    double = F.transform(F.slice(pairs, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    return F.concat(single, double)


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row, ``ratios``: the log ratio of trusted to corpus probability for each bucket. The corpus counts are
    smoothed by one, the trusted ones by PRIOR n-grams of the corpus, so that few trusted rows say little.

    ``trusted_ids``: one column of ids; null ids are none, repeated ones count once. At most ``rows`` of
    them are used, which bounds what is broadcast. The corpus counts are of all rows.
    """
    picked = trusted_ids.toDF("_id").where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows).withColumn("_trusted", F.lit(1))
    hashed = docs.select(docs[doc_id].alias("_id"), F.transform(words_of(docs[text]), lambda w: F.xxhash64(w)).alias("_hashes"))
    grams = hashed.join(F.broadcast(picked), "_id", "left").select("_trusted", F.explode(buckets_of(F.col("_hashes"))).alias("_bucket"))
    counted = grams.groupBy("_bucket").agg(F.count("*").alias("_raw"), F.count("_trusted").alias("_target"))
    full = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("_bucket")).join(F.broadcast(counted), "_bucket", "left")
    row = full.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("_bucket", F.coalesce("_raw", F.lit(0)).alias("r"), F.coalesce("_target", F.lit(0)).alias("t")))).alias("c"),
        F.coalesce(F.sum("_raw"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum("_target"), F.lit(0)).alias("target"),
    )
    corpus = lambda x: (x["r"] + 1) / (F.col("raw") + BUCKETS)
    target = lambda x: (x["t"] + PRIOR * corpus(x)) / (F.col("target") + PRIOR)
    return row.select(F.transform("c", lambda x: F.log(target(x)) - F.log(corpus(x))).alias("ratios"))


def judge(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the counts of the base rules, ``base_failed``, ``llr`` and ``kept`` (such columns are replaced).

    A null or empty text has no words: it fails the base rules. Each row is judged by itself, repeated rows
    alike; an empty table gives no rows. No shuffle, and no row leaves its task.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    kept = docs.drop(*new)
    own = [F.col(f"`{c}`") for c in kept.columns]
    words, hashes, spans, ordered, starts = (free_name(kept, c) for c in ("_words", "_hashes", "_spans", "_ordered", "_starts"))
    whole = F.coalesce(kept[text], F.lit(""))

    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = kept.select(*own, words_of(kept[text]).alias(words))
    step = step.select(*own, F.size(words).alias("n_words"), F.transform(words, lambda w: F.xxhash64(w)).alias(hashes))
    window = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(SPAN)))
    step = step.select(
        *own, "n_words", hashes, F.when(F.size(hashes) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(hashes) - SPAN), window)).otherwise(F.array().cast("array<bigint>")).alias(spans)
    )
    # Only texts in which a window comes twice are sorted.
    twice = F.size(F.array_distinct(spans)) < F.size(spans)
    step = step.select(*own, "n_words", hashes, F.when(twice, F.array_sort(F.transform(spans, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias(ordered))
    same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
    step = step.select(
        *own, "n_words", hashes, F.when(F.col(ordered).isNotNull(), F.sort_array(F.transform(F.filter(ordered, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0))))), lambda x: x["i"]))).alias(starts)
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-SPAN).alias("at"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(SPAN), i - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    ratio = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded into one literal
    at = lambda h: F.get(ratio, F.pmod(h, F.lit(BUCKETS)).cast("int"))
    gain = F.aggregate(
        hashes,
        F.struct(F.lit(None).cast("bigint").alias("before"), F.lit(0.0).alias("sum")),
        lambda acc, h: F.struct(h.alias("before"), (acc["sum"] + at(h) + F.when(acc["before"].isNull(), F.lit(0.0)).otherwise(at(F.xxhash64(acc["before"], h)))).alias("sum")),
        lambda acc: acc["sum"],
    )
    step = step.select(
        *own,
        F.col("n_words").cast("long").alias("n_words"),
        F.length(without(whole, BLANKS)).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.col("n_words") > 0, gain / (2 * F.col("n_words") - 1)).alias("llr"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    step = step.withColumn("base_failed", failed)
    # The last term is true for every row. It isn't deterministic to the optimizer, so that a caller's filter on these columns stays
    # above them: pushed below, it would repeat the lambdas inside each other until the plan can't be compiled.
    here = F.spark_partition_id() >= 0
    return step.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)) & here)


def quality(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``judge`` with the ratios of ``docs`` itself: BUCKETS numbers, which pass through the driver."""
    return judge(docs, log_ratios(docs, trusted_ids, text, doc_id).first()["ratios"], text)
