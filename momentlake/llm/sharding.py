"""Sharding: extendible hashing into shards under a byte limit.

A directory maps the first bits of a hash to shards. A shard that is over the limit is split on one more
bit, and only that shard; the directory doubles when a shard needs more bits than it has. Which shards
must be split follows from the bytes under each prefix, and those are summed on the map side, so
rows are hashed where they lie; what moves is a row for each prefix, and then only the directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Bits that one round of splitting looks at: a directory, or a part of it, has 2 to this entries.
ROUND_BITS = 12
#: A hash has so many; rows that agree in all of them share a shard, whatever its size.
HASH_BITS = 60


def hash_bits(*columns: Column) -> Column:
    """The hash of columns (nulls as empty strings) as a string of HASH_BITS zeros and ones."""
    joined = F.concat_ws("\n", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.lpad(F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def split(sizes: DataFrame, limit: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Shards, and prefixes that need a longer hash, of ``sizes``: ``prefix`` (``bits`` long), ``n_bytes``, ``n_rows``.

    A prefix is split while the bytes under it are over ``limit``: each shard's parent is over it, the shard isn't.
    """
    top = bits - ROUND_BITS
    levels = sizes.select(F.explode(F.sequence(F.lit(top), F.lit(bits))).alias("depth"), "prefix", "n_bytes", "n_rows")
    sums = levels.groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))
    over = sums.where(F.col("n_bytes") > limit)
    parents = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"))
    below = sums.where(F.col("depth") > top).withColumn("_parent", F.expr("substring(prefix, 1, depth - 1)")).join(parents, ["depth", "_parent"], "left_semi").select(sums.columns)
    reached = sums.where(F.col("depth") == top).unionByName(below)
    last = F.lit(bits == HASH_BITS) & (F.col("depth") == bits)
    return reached.where((F.col("n_bytes") <= limit) | last), over.where((F.col("depth") == bits) & ~last).select("prefix")


def shard(rows: DataFrame, limit: int, bits: str, n_bytes: str = "n_bytes") -> DataFrame:
    """``rows`` with ``shard`` (the hash prefix that all its rows share), ``depth`` (its bits), ``shard_bytes`` and ``shard_rows``
    (such columns are replaced).

    ``bits``: the column made by ``hash_bits``; ``n_bytes``: each row's size, null as 0. Every shard has at most ``limit`` bytes,
    unless its rows agree in all HASH_BITS bits (equal rows, or one row that is larger). Splitting goes on in rounds of
    ROUND_BITS bits; each round after the first reads only rows under prefixes that are still too large.
    An empty table gives no rows.
    """
    if limit < 1:
        raise ValueError("a shard needs at least one byte")
    kept = rows.drop("shard", "depth", "shard_bytes", "shard_rows")
    own = [F.col(f"`{c}`") for c in kept.columns]
    found, prefix = (free_name(kept, c) for c in ("_found", "_prefix"))
    todo = kept.select(F.col(bits).alias("_bits"), F.coalesce(n_bytes, F.lit(0)).cast("long").alias("_bytes"))
    out = kept.withColumn(found, F.lit(None).cast("struct<shard:string,depth:int,shard_bytes:bigint,shard_rows:bigint>"))
    for n in range(ROUND_BITS, HASH_BITS + 1, ROUND_BITS):
        sizes = cut(todo.groupBy(F.substring("_bits", 1, n).alias("prefix")).agg(F.sum("_bytes").alias("n_bytes"), F.count("*").alias("n_rows")))
        done, over = split(sizes, limit, n)
        spare = F.lit(n) - F.col("depth")
        # The directory: 2 to the missing bits entries for each shard, so that one look at n bits finds it.
        each = F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {n} - depth) - 1"))
        entries = done.select(
            F.explode(F.transform(each, lambda i: F.concat("prefix", F.when(spare > 0, F.lpad(F.conv(i.cast("string"), 10, 2), spare, F.lit("0"))).otherwise("")))).alias(prefix),
            F.struct(F.col("prefix").alias("shard"), F.col("depth"), F.col("n_bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows")).alias("_entry"),
        )
        entries = F.broadcast(entries) if n == ROUND_BITS else entries  # at most 2 to ROUND_BITS rows in the first round
        out = out.withColumn(prefix, F.substring(bits, 1, n)).join(entries, prefix, "left").withColumn(found, F.coalesce(found, "_entry")).drop(prefix, "_entry")
        over = cut(over)
        if over.isEmpty():
            break
        todo = todo.withColumn("prefix", F.substring("_bits", 1, n)).join(over, "prefix", "left_semi").drop("prefix")
    return out.select(*own, f"{found}.*")
