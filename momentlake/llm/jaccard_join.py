"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact verification counts links.

Equal texts are one class first. In each of TREES trees a class has a signature, the least hashes over its set of word shingles under
DEPTH hash functions, one after the other. A tree is the trie of its signatures: classes with one prefix are a node, and candidates
of each other. The forest is walked from the longest prefixes to shorter ones. What a round finds says, by the links'
similarities, how many links prefixes of that length miss; prefixes are shortened until the recall reckoned in this
way is RECALL. A node that has been verified is not verified again, nor is a pair counted again that has met before.

Candidates are compared exactly, set against set, in blocks: a node is cut into blocks of at most BLOCK classes and about BLOCK_WORDS
words, and each two blocks are one task, so no task grows with a node. What leaves a task is, for each class, the number of its links,
and a spanning forest of them - never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
#: The share of links that the forest is walked for.
RECALL = 0.9995
#: Links at the threshold that are taken to be there besides those found, so that few links don't decide.
PRIOR_LINKS = 20
#: Classes and words in a block; two blocks meet in a task.
BLOCK, BLOCK_WORDS = 256, 1_000_000
#: Classes with copies or links up to which they are broadcast to the rows.
BROADCAST_ROWS = 500_000
#: Links are counted by similarity, in so many steps from the threshold to 1.
STEPS = 8
_SEED = 20_240_229


def meeting(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """The chance that two texts share a prefix of ``depth`` in one of the trees."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def recall_of(depth: int, found: np.ndarray, reached: int | None, threshold: float = THRESHOLD) -> float:
    """The recall of prefixes of ``depth``, by the links found with prefixes of ``reached`` (by steps of similarity).

    A link that is met with chance p stands for 1 / p links. PRIOR_LINKS links at the threshold are added.
    """
    at = np.append(threshold + (np.arange(STEPS) + 0.5) * (1 - threshold) / STEPS, threshold)
    there = np.append(found / meeting(at[:-1], reached) if reached else np.zeros(STEPS), PRIOR_LINKS)
    return float((there * meeting(at, depth)).sum() / there.sum())


def _multipliers(n: int) -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    return rng.integers(1, 1 << 63, (n, 2), dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of several texts, flat, and each text's first place in them.

    ``words``: 64-bit hashes of all words, flat; a text is words[start:end]. A text of fewer words than ``size``, but not none, has one shingle.
    """
    words = words.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    spread = np.uint64(0x9E3779B97F4A7C15)
    full = np.zeros(len(words) + 1, np.uint64)[: len(words)]
    for k in range(size):
        full = (full * spread) ^ padded[k : k + len(words)]
        full ^= full >> np.uint64(29)
    counts = np.maximum(ends - starts - size + 1, np.minimum(ends - starts, 1))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(starts - firsts[:-1], counts) + np.arange(firsts[-1])
    out = full[at] if len(at) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((ends - starts > 0) & (ends - starts < size)):
        h = np.full(1, ends[i] - starts[i], np.uint64)
        for w in words[starts[i] : ends[i]]:
            h = (h * spread) ^ w
            h ^= h >> np.uint64(29)
        out[firsts[i]] = h[0]
    return out, firsts


def signatures(flat: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Texts x (2 TREES): the DEPTH least hashes of each tree, 16 bits of each, in two numbers. Texts must have shingles."""
    out = np.zeros((len(firsts) - 1, 2 * TREES), np.uint64)
    mult = _multipliers(TREES * DEPTH)
    for t in range(TREES):
        for k in range(DEPTH):
            a, b = mult[t * DEPTH + k]
            h = flat * a
            h ^= h >> np.uint64(32)
            h *= b
            at = 2 * t + k // 4
            out[:, at] = (out[:, at] << np.uint64(16)) | (np.minimum.reduceat(h, firsts[:-1]) & np.uint64(0xFFFF))
    return out.view(np.int64)


def _masks(depth: int) -> tuple[int, int]:
    """What is left of a tree's two numbers by a prefix of ``depth``, as signed numbers."""
    mask = lambda k: (((1 << 16 * k) - 1) << 16 * (4 - k)) - (1 << 64 if k else 0)
    return mask(min(depth, 4)), mask(max(depth - 4, 0))


def nodes(signature: Column, depth: int) -> Column:
    """The node of each tree that a class is in: a hash of the tree's number and the prefix."""
    high, low = _masks(depth)
    return F.array(*(F.xxhash64(F.lit(t), F.get(signature, F.lit(2 * t)).bitwiseAND(F.lit(high)), F.get(signature, F.lit(2 * t + 1)).bitwiseAND(F.lit(low))) for t in range(TREES)))


def _share(signatures: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Whether each two classes share a prefix of ``depth`` in a tree."""
    high, low = (signatures[:, 2 * tree + k] & np.int64(m) for k, m in enumerate(_masks(depth)))
    return (high[:, None] == high[None, :]) & (low[:, None] == low[None, :])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).view(np.int64) if len(column.values) else np.zeros(0, np.int64), ends[:-1], ends[1:]


def _pieces(b: pa.RecordBatch, most_words: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many words in its first column, so that long texts need no more memory than short ones."""
    lengths = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
    at = 0
    while at < b.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), most_words, side="right")))
        yield b.slice(at, n)
        at += n


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words between white space."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """``_class`` (md5 of the text, binary) with ``copy_id`` (least id of the texts equal to it), ``class_id`` (least id of all
    texts that links reach from it), ``n_links`` (other classes whose shingle sets have at least ``threshold`` of
    Jaccard similarity with its own) ``n_rows`` (rows with this text and id ``copy_id``) and ``n_all`` (rows with this text).

    Null and empty texts are one class; texts without words have no links. A text of fewer than ``size`` words is one
    shingle. A null id is no text's least id while another row of the text has one, and a text without any id has links
    like others; ``keeper`` is the ``_class`` of the text that ``class_id`` is taken from. An empty table gives no rows. Texts of
    any length are read whole.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole):
                words, starts, ends = _flat(b.column(0))
                some = ends > starts
                flat, firsts = shingles(words, starts[some], ends[some], size)
                offsets = np.concatenate([[0], np.cumsum(some)]).astype(np.int32) * (2 * TREES)
                own = signatures(flat, firsts) if some.any() else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(offsets, own.ravel())  # empty for texts without words
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(ends - starts, pa.int64()), lists], ["_class", "_id", "_size", "_signature"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    whole_text = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(class_of(docs[text]).alias("_class"), docs[doc_id].alias("_id"), whole_text.alias("_text"))
    signed = rows.select(word_hashes(F.col("_text")).alias("_words"), "_class", "_id").mapInArrow(sign, f"_class binary, _id {id_type}, _size long, _signature array<bigint>")
    # A class's rows are summed on the map side first, so a text that a third of all rows share is no burden.
    counted = signed.groupBy("_class", "_size", "_signature", "_id").agg(F.count("*").alias("n"))
    reps = counted.groupBy("_class", "_size", "_signature").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "n")).alias("least"), F.sum("n").alias("n_all"))
    reps = cut(reps.select("_class", "_size", "_signature", F.col("least._id").alias("copy_id"), F.col("least.n").alias("n_rows"), "n_all"))
    depth, before, verified, links = DEPTH, None, None, None
    while True:
        found, verified = _verified(rows, reps, depth, before, verified, threshold, size)
        links = found if links is None else links.unionByName(found)
        sums = links.agg(*(F.coalesce(F.sum(F.get("steps", F.lit(k))), F.lit(0)).alias(str(k)) for k in range(STEPS))).first()
        steps = np.array(sums, float) / 2  # each link is two classes'
        if depth == 1 or recall_of(depth, steps, depth, threshold) >= RECALL:
            break
        before, depth = depth, max([k for k in range(1, depth) if recall_of(k, steps, depth, threshold) >= RECALL], default=1)
    roots = components(links.select(F.col("_class").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("_class").agg(F.sum("links").alias("n_links"))
    grouped = roots.join(reps.select(F.col("_class").alias("node"), "copy_id"), "node")
    firsts_ = grouped.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNull(), "copy_id", "node")).alias("least")).select("root", F.col("least.copy_id").alias("class_id"), F.col("least.node").alias("keeper"))
    ids = grouped.select("node", "root").join(firsts_, "root").select(F.col("node").alias("_class"), "class_id", "keeper")
    out = reps.select("_class", "copy_id", "n_rows", "n_all").join(counts, "_class", "left").join(ids, "_class", "left")
    return out.select("_class", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_rows", "n_all", F.coalesce("keeper", "_class").alias("keeper"))


def class_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _verified(rows: DataFrame, reps: DataFrame, depth: int, before: int | None, verified: DataFrame | None, threshold: float, size: int) -> tuple[DataFrame, DataFrame]:
    """A round: links between classes that share a node of ``depth`` and have not met at ``before``, and what nodes have been verified so far.

    Links: ``_class``, ``links`` (their number), ``other`` (a class that they reach, the least), ``steps`` (their number by similarity). What is
    shuffled for all classes is a node's hash, the class and its size; words travel only for classes with candidates.
    """
    entries = reps.where("size(_signature) > 0").select("_class", "_size", F.posexplode(nodes(F.col("_signature"), depth)).alias("tree", "node"))
    groups = entries.groupBy("node").agg(
        F.count("*").alias("n"), F.sum("_size").alias("words"), F.min("tree").alias("tree"), F.bit_xor(F.xxhash64("_class")).alias("x"), F.bit_xor(F.xxhash64("_class", F.lit(1))).alias("y")
    )
    # Nodes of the same classes in several trees are kept once, in the first tree: it is where their pairs first meet.
    groups = groups.where("n > 1").groupBy("n", "x", "y").agg(F.first("words").alias("words"), F.min(F.struct("tree", "node")).alias("g")).select("n", "x", "y", "words", "g.*")
    if verified is not None:
        groups = groups.join(verified, ["n", "x", "y"], "left_anti")
    groups = cut(groups)
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    members = entries.select("_class", "node").join(groups.select("node", "tree", blocks.alias("_blocks")), "node")
    members = members.select("_class", "node", "tree", F.pmod(F.xxhash64("_class", F.lit(2)), F.col("_blocks")).cast("int").alias("_mine"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    tasks = cut(members.select("_class", "node", "tree", "_mine", F.least("_mine", "_other").alias("_low"), F.greatest("_mine", "_other").alias("_high")))
    # One text of each class that has candidates; only these go to the tasks. Texts needn't be shuffled while such classes are few.
    wanted = cut(tasks.select("_class").distinct().join(reps.select("_class", F.col("copy_id").alias("_id"), "_signature"), "_class"))
    ids = wanted.select(F.col("_class").alias("_c"), F.col("_id").alias("_i"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    own = rows.join(ids, (F.col("_class") == F.col("_c")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi")
    words = own.select("_class", word_hashes(F.col("_text")).alias("_words")).groupBy("_class").agg(F.first("_words").alias("_words"))
    sets = words.join(wanted.select("_class", "_signature"), "_class")

    def verify(group: pa.Table) -> pa.Table:
        g = group.combine_chunks().to_batches()[0]
        col = {c: g.column(c) for c in g.schema.names}
        flat, firsts = shingles(*_flat(col["_words"]), size)
        own = col["_signature"].flatten().to_numpy(zero_copy_only=False).reshape(g.num_rows, 2 * TREES)
        mine = col["_mine"].to_numpy() if col["_low"][0] != col["_high"][0] else None
        links, root, steps = link_counts(flat, firsts, own, col["tree"][0].as_py(), depth, before, mine, threshold)
        some = np.flatnonzero(links)
        return pa.table({"_class": col["_class"].take(some), "links": pa.array(links[some], pa.int64()), "other": col["_class"].take(root[some]), "steps": pa.array(steps[some].tolist(), pa.list_(pa.int64()))})

    found = cut(tasks.join(sets, "_class").groupBy("node", "_low", "_high").applyInArrow(verify, "_class binary, links long, other binary, steps array<bigint>"))
    seen = groups.select("n", "x", "y")
    return found, seen if verified is None else verified.unionByName(seen)


def link_counts(flat: np.ndarray, firsts: np.ndarray, signatures: np.ndarray, tree: int, depth: int, before: int | None, mine: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links among the texts of one task: each text's number of them, the first text that it reaches by them, and their number by steps of similarity.

    A pair that shares a prefix of ``depth`` in a tree before ``tree``, or one of ``before`` in any, was counted there.
    ``mine``: each text's block if two blocks meet (pairs within a block are another task's), else None.
    """
    n = len(firsts) - 1
    owner = np.repeat(np.arange(n), np.diff(firsts))
    order = np.lexsort((owner, flat))
    shingle, owner = flat[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    sizes = np.bincount(owner, minlength=n)
    column = np.cumsum(np.concatenate([[False], shingle[1:] != shingle[:-1]])) if len(shingle) else np.zeros(0, int)
    held = np.bincount(column)
    common = held[column] > 1
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    shared = np.zeros((n, n), np.float32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, 4096):  # common shingles, so many at a time
        here = (column >= at) & (column < at + 4096)
        has = np.zeros((n, 4096), np.float32)
        has[owner[here], column[here] - at] = 1
        shared += has @ has.T
    union = sizes[:, None] + sizes[None, :] - shared
    linked = (shared > 0) & (shared >= threshold * union - 1e-6)
    np.fill_diagonal(linked, False)
    if mine is not None:
        linked &= mine[:, None] != mine[None, :]
    if linked.any():
        for t in range(tree):
            linked &= ~_share(signatures, t, depth)
        for t in range(TREES if before else 0):
            linked &= ~_share(signatures, t, before)
    step = np.clip((shared / np.maximum(union, 1) - threshold) / max(1 - threshold, 1e-9) * STEPS, 0, STEPS - 1).astype(int)
    steps = np.stack([(linked & (step == k)).sum(1) for k in range(STEPS)], 1)
    root = np.arange(n)
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], n).min(1, initial=n))
        if (least == root).all():
            break
        root = least
    return linked.sum(1), root, steps


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options: float) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``class_id``, ``n_links``, ``copy_id``; see ``near_duplicates``. Other columns are left out."""
    found = cut(near_duplicates(docs, text, doc_id, **options))  # written, so that both sides are plain shuffles and hot classes are split
    keyed = docs.select(F.col(f"`{doc_id}`").alias(doc_id), class_of(docs[text]).alias("_class"))
    return keyed.join(found.withColumnRenamed("_class", "_c"), F.col("_class") == F.col("_c")).select(keyed[doc_id], "class_id", "n_links", "copy_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options: float) -> DataFrame:
    """``docs`` with one row of each group: that of the least id (a null one if no row of the group has another). Columns stay as they are.

    Rows with one id and one text are one row; which of them stays, if their other columns differ, is by the least hash of the whole row.
    """
    found = cut(near_duplicates(docs, text, doc_id, **options).select("_class", "keeper", "copy_id", "n_rows", "n_all"))
    key, own = free_name(docs, "_class_key"), [F.col(f"`{c}`") for c in docs.columns]
    of = free_name(docs, "_of")
    # Texts without copies and links stay; the others are written and counted, so that texts needn't be shuffled while these are few.
    several = found.where("_class <> keeper OR n_all > 1").select(F.col("_class").alias(key), F.struct("keeper", "copy_id", "n_rows").alias(of))
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    keyed = docs.withColumn(key, class_of(docs[text])).join(several, key, "left")
    least = (F.col(of)["keeper"] == F.col(key)) & F.col(of)["copy_id"].eqNullSafe(F.col(f"`{doc_id}`"))
    kept = keyed.where(F.col(of).isNull() | least)
    if found.where("_class = keeper AND n_rows > 1").isEmpty():
        return kept.select(*own)
    twice = F.coalesce(F.col(of)["n_rows"] > 1, F.lit(False))
    row = F.struct(*own)
    once = kept.where(twice).groupBy(key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row"))
    return kept.where(~twice).select(*own).unionByName(once.select(*(F.col("_row")[c].alias(c) for c in docs.columns)))
