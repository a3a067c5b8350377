"""Approximate nearest neighbours in partitions that are learned.

The neighbour graph of a bounded sample is cut into parts of equal size with few links between them; a small classifier then learns in
which parts a vector's neighbours lie. Every row lies in its most probable part, a query goes to its several most probable ones, and all rows
there are scored exactly. How probable a part must be is measured on sample rows that the classifier hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import BLOCK, cell_count, finite, matrix, meet, stretches

#: Rows that the index is fitted on, at most, and the share of them held back to measure recall.
SAMPLE_ROWS, HELD_BACK = 8192, 0.125
#: Rows of a part that are aimed at, and most parts. Links of a row in the graph, and how far parts' sizes may differ.
PART_ROWS, MOST_PARTS, LINKS, SLACK = 1024, 64, 64, 0.05
#: Steps towards an eigenvector, and of evening out the parts that rows are filed in.
STEPS, EVENING = 15, 60
#: Recall asked of the held-back rows.
TARGET = 0.93
HIDDEN, EPOCHS, BATCH, RATE = 256, 6, 256, 3e-3


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def scored(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """A layer of rectified units, then a number for each part."""
    w1, b1, w2, b2 = layers
    return np.maximum(unit(x) @ w1 + b1, 0) @ w2 + b2


@dataclass
class Router:
    """Two small networks: one says in which part a vector is filed, the other in which parts its neighbours are.

    ``mass``: the probability that the parts searched must reach together. ``shares``: how much of the rows each part holds.
    """

    files: list[np.ndarray]
    asks: list[np.ndarray]
    mass: float
    shares: np.ndarray
    recall: float

    def part(self, x: np.ndarray) -> np.ndarray:
        return scored(self.files, x).argmax(axis=1)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a vector's number and a part to search: the most probable parts until they reach ``mass``."""
        return probed(softmax(scored(self.asks, x)), self.mass)


def unit(x: np.ndarray) -> np.ndarray:
    """Directions: where a query's neighbours lie by inner product doesn't depend on its length."""
    most = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(most > 0, most, 1)  # squares of very large or small components would leave the doubles
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def probed(p: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-p, axis=1, kind="stable")
    reached = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    wanted = np.concatenate([np.zeros((len(p), 1)), reached[:, :-1]], axis=1) < mass
    rows, places = np.nonzero(wanted)
    return rows, order[rows, places]


def neighbours(queries: np.ndarray, rows: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Places of the k rows of the largest inner product with each query; not the row of its own place, if ``own``."""
    out = np.empty((len(queries), min(k, len(rows) - own)), dtype=np.int64)
    for i in range(0, len(queries), 512):
        s = queries[i : i + 512] @ rows.T
        if own:
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(links: np.ndarray, x: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """A part for each node of a graph (``links``: neighbours of each), parts of nearly equal size with few links between them.

    Halves are cut again and again: the second eigenvector of the half's graph, found from the vectors' main direction on, orders its nodes, and the median cuts them. Then nodes move to the part that most
    of their neighbours lie in, while no part grows beyond SLACK over its share.
    """
    n = len(links)
    of = np.zeros(n, dtype=np.int64)
    for level in range(int(np.log2(parts))):
        halved = of.copy()
        for part in range(1 << level):
            inside = np.flatnonzero(of == part)
            place = np.full(n, -1)
            place[inside] = np.arange(len(inside))
            a = np.repeat(np.arange(len(inside)), links.shape[1])
            b = place[links[inside]].ravel()
            a, b = np.concatenate([a[b >= 0], b[b >= 0]]), np.concatenate([b[b >= 0], a[b >= 0]])
            root = np.sqrt(np.maximum(np.bincount(a, minlength=len(inside)), 1))
            about = x[inside] - x[inside].mean(axis=0)
            v = about @ np.linalg.eigh(about.T @ about)[1][:, -1] * root
            flat = root / np.linalg.norm(root)
            for _ in range(STEPS):
                v = v - flat * (flat @ v)
                v = 0.5 * v + 0.5 * np.bincount(a, (v / root)[b], len(inside)) / root
                v /= max(np.linalg.norm(v), 1e-300)
            order = np.argsort(v / root, kind="stable")
            halved[inside] = 2 * part
            halved[inside[order[len(order) // 2 :]]] = 2 * part + 1
        of = halved
    most = int(np.ceil(n / parts * (1 + SLACK)))
    sizes = np.bincount(of, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (np.repeat(np.arange(n), links.shape[1]), of[links].ravel()), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), of]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if sizes[best[i]] < most:
                sizes[best[i]] += 1
                sizes[of[i]] -= 1
                of[i] = best[i]
                moved += 1
        if not moved:
            break
    return of


def learned(x: np.ndarray, wanted: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Weights that give each vector's distribution over parts, by Adam on the cross entropy."""
    d, m = x.shape[1], wanted.shape[1]
    layers = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, m)) * np.sqrt(1 / HIDDEN), np.zeros(m)]
    x = x * np.sqrt(d)
    first, second, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            at = order[i : i + BATCH]
            h = np.maximum(x[at] @ layers[0] + layers[1], 0)
            z = h @ layers[2] + layers[3]
            p = (softmax(z) - wanted[at]) / len(at)
            back = (p @ layers[2].T) * (h > 0)
            t += 1
            for k, g in enumerate([x[at].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0)]):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return [layers[0] * np.sqrt(d), *layers[1:]]


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 1) -> Router | None:
    """The router for so many rows, from a sample of them. None where one part holds all: then nothing is approximate."""
    parts = 1 << max(0, min(int(np.log2(MOST_PARTS)), int(np.log2(max(1, rows // PART_ROWS)))))
    while parts > 1 and len(sample) < 32 * parts:
        parts //= 2
    if parts == 1:
        return None
    rng = np.random.default_rng(seed)
    x = sample / np.abs(sample).max()
    held = max(64, int(len(x) * HELD_BACK))
    seen, back = x[held:], x[:held]
    links = neighbours(seen, seen, LINKS, own=True)

    def spread(of: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(seen), parts))
        np.add.at(votes, (np.repeat(np.arange(len(seen)), links.shape[1]), of[links].ravel()), 1)
        return votes / votes.sum(axis=1, keepdims=True)

    of = balanced_parts(links, seen, parts)
    own = np.zeros((len(seen), parts))
    own[np.arange(len(seen)), of] = 1
    files = learned(unit(seen), 0.5 * own + 0.5 * spread(of), rng)
    for _ in range(EVENING):  # the last biases lean against parts that attract too much
        share = np.bincount(scored(files, seen).argmax(axis=1), minlength=parts) / len(seen)
        files[3] = files[3] - 0.1 * np.clip(np.log(np.maximum(share, 0.1 / parts) * parts), -2, 2)
    filed = scored(files, seen).argmax(axis=1)
    router = Router(files, learned(unit(seen), spread(filed), rng), 1.0, np.bincount(scored(files, x).argmax(axis=1), minlength=parts) / len(x), 1.0)
    truth = filed[neighbours(back, seen, k)]
    p = softmax(scored(router.asks, back))
    for mass in np.arange(0.3, 1.0, 0.02):
        q, part = probed(p, mass)
        hit = np.zeros(p.shape, dtype=bool)
        hit[q, part] = True
        found = np.take_along_axis(hit, truth, axis=1).mean()
        if found >= TARGET:
            router.mass, router.recall = float(mass), float(found)
            break
    return router


@dataclass
class Index:
    """Routers by length of vectors, and the rows that they were fitted on: ids and vectors."""

    routers: dict[int, Router]
    samples: dict[int, tuple[np.ndarray, np.ndarray]]


def once(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id, equal ones once."""
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        order = np.array(list({(i, rows[j].tobytes()): j for i, j in zip(ids[order], order)}.values()))
    return ids[order], rows[order]


def best_of(ids: np.ndarray, rows: np.ndarray, asks: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and the ids and scores of its k best rows, none under its floor.

    A product's last bits depend on where a row lies in it. What comes near the k-th is summed again, in one order for all.
    """
    step = max(1, BLOCK // len(ids))
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.abs(queries).sum(axis=1) * np.abs(rows).max()
        for i in range(0, len(queries), step):
            for q, s in enumerate(queries[i : i + step] @ rows.T, i):
                sure = np.isfinite(bound[q])
                near = np.flatnonzero((ids != asks[q]) & (s >= floors[q] - 1e-12 * bound[q])) if floors is not None and sure else np.flatnonzero(ids != asks[q])
                if len(near) > k and sure:
                    near = near[s[near] >= np.partition(s[near], len(near) - k)[len(near) - k] - 1e-12 * bound[q]]
                exact = (rows[near] * queries[q]).sum(axis=1)
                best = np.lexsort((ids[near], -exact))[:k]
                yield q, ids[near][best], exact[best]


def _answers(asks: np.ndarray, found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    out = [(np.full(len(i), asks[q]), i, s) for q, i, s in found]
    query, ids, score = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def _shown(part: pa.RecordBatch, routers: dict[int, Router], cells: dict[int, np.ndarray], asks: bool, salt: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with the cell that they are filed in, or queries with every cell that they are to meet. ``cells``: the first cell of each part, and one past the last."""
    dims = part.column("_dim").to_numpy()
    for dim in np.unique(dims):
        mine = np.flatnonzero(dims == dim)
        some = part.take(pa.array(mine))
        first = cells[int(dim)]
        if (router := routers.get(int(dim))) is None:
            row, of = np.arange(len(mine)), np.zeros(len(mine), dtype=np.int64)
        else:
            x = matrix(some.column("_vector"), int(dim))
            row, of = router.probes(x) if asks else (np.arange(len(x)), router.part(x))
        many = first[of + 1] - first[of]
        if asks:
            place = np.repeat(first[of], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row = np.repeat(row, many)
        else:
            place = first[of] + salt[mine] % many
        out = some.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("_id", "_dim", "_vector")), pa.array(place, pa.int32()), *(out.column(c) for c in ("_floor",) if asks)], names=["_id", "_dim", "_vector", "_cell", *(["_floor"] if asks else [])])


def _nearest(k: int):
    def hold(part: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
        return once(part.column("_id").to_numpy(), matrix(part.column("_vector"), dim))  # equal rows lie in one cell

    def answer(held: tuple, part: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        asks = part.column("_id").to_numpy()
        return _answers(asks, best_of(*held, asks, matrix(part.column("_vector"), dim), k, part.column("_floor").to_numpy()))

    return hold, answer


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``_id``, ``_dim`` and ``_vector`` (doubles) of the rows that take part."""
    kept = df.where(F.col(vec_id).isNotNull() & finite(F.col(vector)) & F.exists(vector, lambda x: x != 0))
    return kept.select(F.col(vec_id).cast("long").alias("_id"), F.size(vector).alias("_dim"), F.col(vector).alias("_vector"))


def fitted(rows: DataFrame, total: int, k: int, most: int = SAMPLE_ROWS) -> Index:
    """A router for each length of vectors, from at most ``most`` rows in all: those whose ids have the least hashes."""
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(most).collect()
    index = Index({}, {})
    for dim in sorted({r["_dim"] for r in sample}):
        mine = [r for r in sample if r["_dim"] == dim]
        vectors = np.array([r["_vector"] for r in mine], dtype=np.float64)
        index.samples[dim] = once(np.array([r["_id"] for r in mine]), vectors)
        if router := fit(vectors, round(total * len(mine) / len(sample)), k):
            index.routers[dim] = router
    return index


def nearest(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", index: Index | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k rows of the largest inner product found for each query, ties to the smaller id.

    Rows with a null id, or a vector that is null, empty, zero or holds null or non-finite components take no part; vectors of another
    length never meet. Rows with the query's own id are no candidates. Equal rows are one; an id with several vectors is a candidate for each, and a query
    for each, whose answers are one. Scores are sums of products as doubles, in one order for all pairs. Few rows (under 2 * PART_ROWS of a
    length) are one part, searched whole. All rows are filed; parts larger than a cell are dealt over several, all of which a query of that part meets.

    The rows that the index was fitted on are candidates of every query, which meets them first: what scores less than
    its k-th best there can't be among its k nearest, and isn't handed on from the cells.
    """
    rows = usable(df, vec_id, vector)
    total = df.count()
    index = fitted(rows, total, k) if index is None else index
    count = cell_count(total)
    size = -(-total // count) if total else 1
    cells = {d: np.concatenate([[0], np.cumsum(np.maximum(1, np.ceil(r.shares * total / size)).astype(np.int64))]) for d, r in index.routers.items()}

    def place(asks: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    plain = {int(d): np.array([0, count]) for d in np.unique(batch.column("_dim").to_numpy()) if int(d) not in cells}
                    yield from _shown(batch, index.routers, cells | plain, asks, batch.column("_salt").to_numpy())

        return step

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's best of the fitted rows."""
        for batch in batches:
            for (dim,), part in stretches(batch, ["_dim"]):
                if dim in index.samples:
                    asks = part.column("_id").to_numpy()
                    yield _answers(asks, best_of(*index.samples[dim], asks, matrix(part.column("_vector"), dim), k))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, -np.inf)
            dims, asks = batch.column("_dim").to_numpy(), batch.column("_id").to_numpy()
            for dim in {int(d) for d in np.unique(dims)} & index.samples.keys():
                mine = np.flatnonzero(dims == dim)
                vectors = matrix(batch.column("_vector").take(pa.array(mine)), dim)
                for q, _, s in best_of(*index.samples[dim], asks[mine], vectors, k):
                    if len(s) == k:
                        out[mine[q]] = s[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "_floor"])

    kind = df.schema[vector].dataType.simpleString()
    schema = f"_id long, _dim int, _vector {kind}, _cell int"
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)))
    asked = usable(df.where(is_query), vec_id, vector)
    floored = asked.withColumn("_salt", F.lit(0).cast("long")).mapInArrow(floors, f"_id long, _dim int, _vector {kind}, _salt long, _floor double")
    most = max([count, *(int(c[-1]) for c in cells.values())])
    hold, answer = _nearest(k)
    answers = "query_id long, vec_id long, score double"
    met = meet(salted.mapInArrow(place(False), schema), floored.mapInArrow(place(True), f"{schema}, _floor double"), most, hold, answer, answers)
    every = met.unionByName(asked.mapInArrow(first, answers))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = every.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"])
    return once.select("query_id", "rank", "vec_id", "score")
