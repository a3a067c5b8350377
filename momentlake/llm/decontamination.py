"""Benchmark decontamination: test n-grams found in training documents.

The normalised n-grams of all test items are a hash set, filed under a 64-bit hash of their words' hashes, that every executor gets if
their counted size allows. The scan of a document hashes each of its token windows, probes the set and compares the words
behind each hit, inside one stage; what leaves it are true hits and one row for each document. A larger set is
met by a shuffle instead, of (row, start, hash) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

NGRAM = 13
#: A document is contaminated if this many times its hit words are at least its words.
SHARE = 20
#: Bytes of n-grams (their counted characters, and 32 for each word and n-gram) up to which they are broadcast.
BROADCAST_BYTES = 128 << 20
#: Digests of contaminated texts up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: Everything that isn't a digit, an ASCII letter or beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    whole = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.array_remove(F.split(lower, NOT_WORD), "")


def ngrams(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """``_item``, ``_gram`` (array of words), ``_n`` (their number) and ``_filed`` (the hash that windows have).

    A window of ``n`` words each, or the whole item if it has fewer; items without words have none.
    """
    words = items.select(items[item_id].cast("string").alias("_item"), normal_words(items[text]).alias("_words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - n, F.lit(0)))
    grams = words.where(F.size("_words") > 0).select("_item", F.explode(F.transform(starts, lambda i: F.slice("_words", i + 1, n))).alias("_gram")).distinct()
    return grams.select("_item", "_gram", F.size("_gram").alias("_n"), F.xxhash64("_gram").alias("_filed"))


def probes(scanned: DataFrame, lengths: list[int], base: bool) -> DataFrame:
    """``scanned`` once for each of its token windows: ``_start``, the place of its first word, and ``_key``, its hash. With ``base`` also once with
    a null key and start -1, for the row itself. A window at a text's end may be short; comparing words settles that."""
    words = F.concat(F.array(F.lit("")), "_words") if base else F.col("_words")
    placed = scanned.select("*", F.posexplode(words).alias("_pos", "_word")).withColumn("_start", F.col("_pos") - int(base))
    keys = [F.when(F.col("_start") >= 0, F.xxhash64(F.slice("_words", F.greatest(F.col("_start"), F.lit(0)) + 1, n))) for n in lengths]
    if len(keys) == 1:
        return placed.withColumn("_key", keys[0])
    every = F.array(*keys) if keys else F.array(F.lit(None).cast("bigint"))
    return placed.withColumn("_key", F.explode(F.when(F.col("_start") < 0, F.slice(every, 1, 1)).otherwise(every)))


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", n: int = NGRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without ``text``, each row with ``n_words``, ``spans`` (sorted, merged (start, end) word ranges that
    n-grams cover), ``n_hit``, ``items`` (ids as strings, sorted), ``n_items`` and ``contaminated``; columns of ``docs`` with these names are replaced.

    Null and empty texts have no words and no hits; so have all documents if no item has words. Rows are judged each by itself, also
    those with equal ids. An empty table gives no rows. A text of any length is one row and is scanned whole.
    """
    new = ["n_words", "spans", "n_hit", "items", "n_items", "contaminated"]
    kept = docs.drop(*(c for c in new if c != text))
    own = [c for c in kept.columns if c != text]
    # The caller's columns travel in one struct, so that none of their names can meet one of those below.
    carried = F.struct(F.lit(True).alias("base"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)))
    grams = ngrams(items, item_id, item_text, n)
    sizes = grams.groupBy("_n").agg(F.sum(F.length(F.concat_ws("", "_gram")) + 32 * F.col("_n") + 32).alias("bytes")).orderBy("_n").collect()  # n rows at most
    lengths, small = [r["_n"] for r in sizes], sum(r["bytes"] for r in sizes) <= broadcast_bytes
    scanned = kept.select(F.monotonically_increasing_id().alias("_row"), carried.alias("_own"), normal_words(kept[text]).alias("_words"))
    base = F.struct("_own", F.size("_words").cast("long").alias("n_words"))
    if small:
        same = (F.col("_key") == F.col("_filed")) & (F.slice("_words", F.greatest(F.col("_start"), F.lit(0)) + 1, F.size("_gram")) == F.col("_gram"))
        hits = probes(scanned, lengths, True).join(F.broadcast(grams), same, "left").where(F.col("_item").isNotNull() | (F.col("_start") < 0))
        slim = hits.select("_row", F.when(F.col("_start") < 0, base).alias("_base"), _span().alias("_span"), "_item")
    else:
        scanned = cut(scanned)  # three branches read it: its rows are numbered once
        met = probes(scanned.select("_row", "_words"), lengths, False).select("_row", "_start", "_key").join(grams.select(F.col("_filed").alias("_key")).distinct(), "_key", "left_semi")
        found = met.join(scanned.select("_row", "_words"), "_row").select("_row", "_start", "_key", F.slice("_words", F.col("_start") + 1, n).alias("_own_gram"))
        hits = found.join(grams, (F.col("_key") == F.col("_filed")) & (F.slice("_own_gram", 1, F.size("_gram")) == F.col("_gram")))
        none = F.lit(None).cast("struct<start:int,end:int>")
        slim = scanned.select("_row", base.alias("_base"), none.alias("_span"), F.lit(None).cast("string").alias("_item"))
        slim = slim.unionByName(hits.select("_row", F.lit(None).alias("_base"), _span().alias("_span"), "_item"))
    summed = slim.groupBy("_row").agg(F.first("_base", ignorenulls=True).alias("_base"), F.array_sort(F.collect_set("_span")).alias("_found"), F.array_sort(F.collect_set("_item")).alias("items"))
    at = F.array_sort(F.array_distinct(F.flatten(F.transform("_found", lambda x: F.sequence(x["start"], x["end"] - 1)))))
    summed = summed.select("_base", "items", at.alias("_at"))
    first = F.filter("_at", lambda x, i: F.coalesce(F.get("_at", i - 1) != x - 1, F.lit(True)))
    last = F.filter("_at", lambda x, i: F.coalesce(F.get("_at", i + 1) != x + 1, F.lit(True)))
    spans = F.zip_with(first, last, lambda x, y: F.struct(x.alias("start"), (y + 1).alias("end")))
    names = [F.col("_base._own")[f"c{k}"].alias(c) for k, c in enumerate(own)]
    counted = summed.select(*names, F.col("_base.n_words").alias("n_words"), spans.alias("spans"), F.size("_at").cast("long").alias("n_hit"), "items", F.size("items").cast("long").alias("n_items"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def _span() -> Column:
    return F.when(F.col("_item").isNotNull(), F.struct(F.col("_start").alias("start"), (F.col("_start") + F.size("_gram")).alias("end")))


def digest(items: Column) -> Column:
    """The sha256 of ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """``docs`` without contaminated rows; its columns stay as they are.

    Rows are matched by a digest of their text, so repeated ids are no matter. The digests to drop are written and counted first;
    up to BROADCAST_ROWS of them go to every executor, more are met by a shuffle.
    """
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256)))
    bad = find_hits(keyed.select(F.col(key).alias("_digest"), F.col(f"`{text}`").alias("_text_")), items, "_text_", **names).where("contaminated").select(F.col("_digest").alias(key)).distinct()
    bad = cut(bad)
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return keyed.join(bad, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def without_spans(docs: DataFrame, items: DataFrame, text: str = "text", mask: str = " ", **names: str) -> DataFrame:
    """``docs`` with what ``find_hits`` gives instead of ``text``, and ``clean_words`` (replaced if there): the normalised words of ``text`` outside hit spans, in order."""
    kept = docs.drop(*(c for c in ("clean_words",) if c != text))
    whole = free_name(kept, "_whole")
    found = find_hits(kept.withColumn(whole, F.col(f"`{text}`")), items, text, **names)
    outside = F.filter(normal_words(F.col(whole)), lambda w, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    return found.withColumn("clean_words", F.concat_ws(mask, outside)).drop(whole)
