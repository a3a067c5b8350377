"""Hard negatives: for each anchor and positive, the rows of other labels that score best inside a window under the positive.

Scores are whole numbers, so the k-th best of a window is found as in a radix sort: tasks count the scores of their rows by the leading digit of
their distance from the window's top, Spark adds the counts up, and the digit that holds the k-th score is refined by the
next pass. Only counts travel until a window's floor is known; then the rows at or above it are fetched, and no others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import BLOCK, cell_count, finite, matrix, meet

POSITIVES, NEGATIVES, LOWEST_PERCENT, SCALE = 5, 5, 80, 256
#: Bits of a digit; a window is refined while more rows than this lie at or above its floor.
DIGIT_BITS, FEW = 5, 20


def whole_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly; what 64 bits can't hold is the nearest number that they can."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    ints = np.frompyfunc(int, 1, 1)
    return np.clip(ints(a) @ ints(b).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def whole_rows(df: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """``_id``, ``_label``, ``_dim``, and the floor of each component times SCALE: ``_short`` where 16 bits hold them all, else ``_long``."""
    taken = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & finite(F.col(vector)))
    # As doubles: floor() would make 64-bit numbers, which can't hold all of them.
    big = F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * SCALE) < 2.0**52, F.floor(x.cast("double") * SCALE).cast("double")).otherwise(x.cast("double") * SCALE))
    sized = taken.select(F.col(vec_id).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"), F.size(vector).alias("_dim"), big.alias("_big"))
    fits = F.forall("_big", lambda x: F.abs(x) <= 32767)
    return sized.select("_id", "_label", "_dim", F.when(fits, F.col("_big").cast("array<smallint>")).alias("_short"), F.when(~fits, F.col("_big")).alias("_long"))


def _vectors(part: pa.Table | pa.RecordBatch, dim: int) -> np.ndarray:
    short, long = part.column("_short"), part.column("_long")
    if long.null_count == part.num_rows:
        return matrix(short, dim)
    out, missing = np.empty((part.num_rows, dim)), short.is_null().to_numpy(zero_copy_only=False) if isinstance(short, pa.Array) else short.combine_chunks().is_null().to_numpy(zero_copy_only=False)
    out[~missing], out[missing] = matrix(short, dim), matrix(long, dim)
    return out


def _hold(part: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = part.column("_id").to_numpy(), part.column("_label").to_numpy()
    order = np.lexsort((ids, labels))
    return ids[order], labels[order], _vectors(part, dim)[order]


def _blocks(held: tuple, part: pa.RecordBatch, dim: int):
    """Anchors' numbers from and to, and their scores with all rows held."""
    step, vectors = max(1, BLOCK // len(held[0])), _vectors(part, dim)
    for i in range(0, len(vectors), step):
        yield i, whole_scores(vectors[i : i + step], held[2])


def _positives(k: int):
    def answer(held: tuple, part: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        ids, labels, _ = held
        anchors, own = part.column("_id").to_numpy(), part.column("_label").to_numpy()
        lo, hi = np.searchsorted(labels, own, "left"), np.searchsorted(labels, own, "right")
        out: list[tuple] = []
        for start, scores in _blocks(held, part, dim):
            for j, row in enumerate(scores):
                a, b = lo[start + j], hi[start + j]
                other = np.flatnonzero(ids[a:b] != anchors[start + j]) + a
                if len(other) > k:  # the least score that can count; equal ones stay, by id
                    other = other[row[other] >= np.partition(row[other], len(other) - k)[len(other) - k]]
                best = other[np.lexsort((ids[other], -row[other]))[:k]]
                out += [(anchors[start + j], i, s) for i, s in zip(ids[best], row[best])]
        columns = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score"])

    return answer


def _in_windows(held: tuple, part: pa.RecordBatch, dim: int):
    """For each block: places of windows, and ids and scores of the other labels' rows inside them."""
    ids, labels, _ = held
    own = part.column("_label").to_numpy()
    floors, tops = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_lo", "_hi"))
    many = part.column("_w").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(many)])[:-1]
    least, most = np.minimum.reduceat(floors, first), np.maximum.reduceat(tops, first)
    for start, scores in _blocks(held, part, dim):
        mine = slice(start, start + len(scores))
        a, r = np.nonzero((scores >= least[mine, None]) & (scores <= most[mine, None]) & (labels[None, :] != own[mine, None]))
        s, a = scores[a, r], a + start
        each = many[a]
        pair = np.repeat(np.arange(len(a)), each)
        place = first[a][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        s = s[pair]
        inside = (s >= floors[place]) & (s <= tops[place])
        yield place[inside], ids[r][pair][inside], s[inside]


def _names_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and window of each place."""
    return np.repeat(part.column("_id").to_numpy(), part.column("_w").value_lengths().to_numpy(zero_copy_only=False)), part.column("_w").flatten().to_numpy(zero_copy_only=False)


def _counts(held: tuple, part: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    """Rows of each window by digit; digit 0 is next to the window's top."""
    tops, shifts = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_hi", "_shift"))
    places, digits, numbers = [], [], []
    for place, _, s in _in_windows(held, part, dim):
        key, n = np.unique((place << DIGIT_BITS) | ((tops[place] - s) >> shifts[place]), return_counts=True)
        places.append(key >> DIGIT_BITS)
        digits.append(key & ((1 << DIGIT_BITS) - 1))
        numbers.append(n)
    anchors, windows = _names_of(part)
    place = np.concatenate(places)
    return pa.RecordBatch.from_arrays([pa.array(anchors[place], pa.int64()), pa.array(windows[place], pa.int32()), pa.array(np.concatenate(digits), pa.int64()), pa.array(np.concatenate(numbers), pa.int64())], names=["anchor_id", "_w", "_digit", "_n"])


def _gathered(k: int):
    def answer(held: tuple, part: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        found = []
        for place, ids, s in _in_windows(held, part, dim):
            order = np.lexsort((ids, -s, place))
            place, ids, s = place[order], ids[order], s[order]
            nth = np.arange(len(place)) - np.searchsorted(place, place, "left")
            found.append((place[nth < k], ids[nth < k], s[nth < k]))  # of one cell's rows no more can be among the first k of all
        place, ids, s = (np.concatenate(x) for x in zip(*found))
        anchors, windows = _names_of(part)
        return pa.RecordBatch.from_arrays([pa.array(anchors[place], pa.int64()), pa.array(windows[place], pa.int32()), pa.array(ids, pa.int64()), pa.array(s, pa.int64())], names=["anchor_id", "_w", "negative_id", "negative_score"])

    return answer


def _bits(x: Column) -> Column:
    """Bits that a whole number from 0 takes."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def _narrowed(state: DataFrame, counts: DataFrame, k: int, few: int) -> DataFrame:
    """Open windows with the part of them that holds the k-th score. Windows that no row is in end here."""
    key = ["anchor_id", "_w"]
    by = Window.partitionBy(*key)
    met = state.join(counts.groupBy(*key, "_digit").agg(F.sum("_n").alias("_n")), key)
    met = met.withColumns({"_upto": F.col("_above") + F.sum("_n").over(by.orderBy("_digit")), "_all": F.col("_above") + F.sum("_n").over(by)})
    holds = F.col("_upto") >= k
    one = met.withColumn("_r", F.row_number().over(by.orderBy(F.desc(holds), "_digit"))).where("_r = 1")
    shift = F.col("_shift")
    top = F.col("_hi") - F.call_function("shiftleft", F.col("_digit"), shift)
    floor = F.greatest(F.col("_lo"), top - F.call_function("shiftleft", F.lit(1).cast("long"), shift) + 1)
    whole = F.col("_all") <= few  # nothing to refine
    done = whole | (F.col("_upto") <= few) | (shift == 0)
    return one.select(
        "anchor_id", "_w", "positive_id", "positive_score",
        F.when(whole, F.col("_lo")).otherwise(floor).alias("_lo"), F.when(done, F.col("positive_score")).otherwise(top).alias("_hi"),
        F.when(done, F.col("_above")).otherwise(F.col("_upto") - F.col("_n")).alias("_above"), (~done).alias("_open"),
    )


def hard_negatives(df: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LOWEST_PERCENT, few: int = FEW) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows where ``is_anchor``; the positives of one are its best ``positives`` other rows of its label, and the negatives of both its best
    ``negatives`` rows of other labels whose score is from ``percent`` to 100 percent of the positive's. Scores are inner products of the components
    times SCALE, rounded down; ties go to the smaller id. Rows with a null id, label or vector, without components, or with a null or non-finite one take no
    part, and vectors of another length than the anchor's don't meet it. An id that several rows have is one anchor (the least label, then vector)
    and as many candidates; no row is a positive of an anchor with its own id. No anchors or no rows, no result. Under a negative positive
    score there is no window. All rows are read once for the positives, once for each digit and once to gather; nothing is
    collected but whether a window is still open.
    """
    rows = whole_rows(df, vec_id, label, vector)
    cells = cell_count(df.count())
    dealt = rows.withColumn("_cell", F.pmod(F.xxhash64("_id"), F.lit(cells)).cast("int"))
    picked = whole_rows(df.where(is_anchor), vec_id, label, vector)
    anchors = cut(picked.groupBy("_id").agg(F.min(F.struct("_label", "_dim", "_short", "_long")).alias("_a")).select("_id", "_a.*"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_cell")
    near = meet(dealt, anchors.select("*", everywhere), cells, _hold, _positives(positives), "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    ranked = near.withColumn("_w", F.row_number().over(best)).where(F.col("_w") <= positives)
    score = F.col("positive_score")
    # The least whole number at or over percent * score / 100, without leaving 64 bits.
    least = score - (F.expr("positive_score div 100") * (100 - percent) + F.expr(f"((positive_score % 100) * {100 - percent}) div 100"))
    state = cut(ranked.where("positive_score >= 0").select("anchor_id", "_w", "positive_id", "positive_score", least.alias("_lo"), score.alias("_hi"), F.lit(0).cast("long").alias("_above"), F.lit(True).alias("_open")))

    def asked(windows: DataFrame, hi: str) -> DataFrame:
        packed = windows.groupBy(F.col("anchor_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("_w", "_lo", F.col(hi).alias("_hi"), "_shift"))).alias("_s"))
        return anchors.join(packed, "_id").select("_id", "_label", "_dim", "_short", "_long", F.col("_s._w").alias("_w"), F.col("_s._lo").alias("_lo"), F.col("_s._hi").alias("_hi"), F.col("_s._shift").alias("_shift"), everywhere)

    shifted = lambda x: x.withColumn("_shift", F.greatest(F.lit(0), _bits(F.col("_hi") - F.col("_lo")) - DIGIT_BITS))
    while not state.where("_open").isEmpty():
        now = shifted(state.where("_open"))
        counts = meet(dealt, asked(now, "_hi"), cells, _hold, _counts, "anchor_id long, _w int, _digit long, _n long")
        state = cut(state.where("NOT _open").unionByName(_narrowed(now, counts, negatives, few)))
    gathered = meet(dealt, asked(shifted(state), "positive_score"), cells, _hold, _gathered(negatives), "anchor_id long, _w int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "_w").orderBy(F.desc("negative_score"), "negative_id")
    first = gathered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return first.join(state, ["anchor_id", "_w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
