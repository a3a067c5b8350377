"""The filter audit, hard negatives and nearest neighbours against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlake.llm import nearest as near
from momentlake.llm.filter_audit import audit, cells, own_mask
from momentlake.llm.hard_negatives import hard_negatives, whole_scores
from momentlake.llm.vectors import cell_count

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, label int, embedding array<float>"


# ---- filter audit


def audit_by_hand(docs, labels):
    def fails(i, text):
        words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        t = text or ""
        return {
            x
            for x, bad in zip(
                "ABCDE",
                (
                    len(words) < 50,
                    100 * len(set(words)) < 65 * len(words),
                    100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                    any(c in "#$%&*|" for c in t),
                    i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
                ),
            )
            if bad
        }

    rows = [(p or "", fails(i, t), any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)) for i, t, p in docs]
    out = []
    for part in {p for p, *_ in rows}:
        mine = [r for r in rows if r[0] == part]
        gone = {f: 0 for f in "ABCDE"}
        here = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [r for r in mine if not r[1] & set(order[:k])]
                removed = [r for r in left if f in r[1]]
                gone[f] += len(removed)
                failing = [r for r in mine if f in r[1]]
                here.append(("".join(order), k + 1, f, len(left) - len(removed), len(removed), len(failing) - len(removed), sum(r[1] == {f} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed)))
        out += [(part, o, k, *rest, gone[f]) for o, k, f, *rest in here]
    return sorted(out)


def test_audit_is_what_every_order_does(spark):
    plain = " ".join(f"word{k}" for k in range(60))
    docs = [
        (1, plain, "a"), (2, plain, "b"), (2, plain, "b"), (3, plain, None), (None, plain, "a"), (4, "", "a"), (5, None, "a"), (6, "SHOUT " * 70, "a"), (7, plain + " # | one", "b"),
        (8, "a\x0bb\x0cc\td\ne  f" * 20, "b"), (9, "é" * 3 + "A", "c"), (10, plain + " " + "x " * 30000, "c"), (11, plain + " " + "x " * 30000, "c"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (11, 1, 0)]
    d = spark.createDataFrame(docs, DOCS).withColumn("_n", F.lit("clash")).withColumn("part", F.lit(1))
    found = audit(cells(d, spark.createDataFrame(labels, LABELS)))
    assert sorted(map(tuple, found.collect())) == audit_by_hand(docs, labels)
    assert found.count() == 4 * 600


def test_audit_of_nothing(spark):
    assert audit(cells(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))).count() == 0


def test_masks(spark):
    texts = [(None, 1), ("", 1), ("A" * 3 + "b" * 57, 1), ("A" * 4 + "b" * 57, 5), ("a|", 9), (" ".join(["x", "y"] * 30), 2)]
    got = spark.createDataFrame(texts, "text string, want int").select(own_mask(F.col("text")).alias("m"), "want").collect()
    assert [r["m"] for r in got] == [r["want"] for r in got]


# ---- hard negatives


def negatives_by_hand(rows, anchor, positives=5, negatives=5, percent=80):
    clean = [(i, y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v in sorted(clean):
        if anchor(i):
            anchors.setdefault(i, (y, v))
    out = []
    for a, (y, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, z, w in clean if len(w) == len(v))
        best = [(-s, i) for s, i, z in scored if z == y and i != a][:positives]
        for ps, p in best:
            inside = [(-s, i) for s, i, z in scored if z != y and percent * ps <= -100 * s <= 100 * ps][:negatives]
            out += [(a, p, k, i, ps, s) for k, (s, i) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("few", [20, 5])
def test_hard_negatives(spark, few):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(4)), [float(x) for x in (rng.standard_normal(8) + 1).astype(np.float32)]) for i in range(900)]
    rows += [(2000 + i, int(i % 3), [1.0] * 8) for i in range(400)]  # one vector, many times
    rows += [(7, 1, None), (8, None, [1.0] * 8), (None, 1, [1.0] * 8), (9, 1, [float("nan")] + [1.0] * 7), (10, 1, [None] + [1.0] * 7), (11, 1, []), (3000, 1, [1.0, 2.0]), (3001, 2, [1.0, 2.0]), (3002, 1, [1.0, 2.0])]
    rows += [rows[100], rows[100], (5, 2, [float("inf")] * 8), (5000, 3, [1e30] * 8)]
    df = spark.createDataFrame([(i, y, v) for i, y, v in rows], VECTORS).withColumn("_w", F.lit(1))
    got = hard_negatives(df, F.col("vec_id") % 100 == 0, few=few)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    mine = sorted(map(tuple, got.collect()))
    want = negatives_by_hand(rows, lambda i: i % 100 == 0)
    small = lambda rows: [r for r in rows if r[0] != 5000]  # noqa: E731  its scores don't fit in 64 bits
    assert small(mine) == small(want)
    assert len(want) > 100


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2.0**40 + 1, 3.0]])
    assert whole_scores(a, np.array([[2.0**20 + 1, 7.0]]))[0, 0] == (2**40 + 1) * (2**20 + 1) + 21
    assert whole_scores(np.array([[1e300]]), np.array([[1e300]]))[0, 0] == 2**63 - 1


def test_no_anchor_no_row_no_window(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(100, 1, [1.0, 0.0]), (101, 1, [-1.0, 0.0]), (102, 2, [-1.0, 0.0])], VECTORS)
    assert hard_negatives(few, F.col("vec_id") % 100 == 0).count() == 0  # the positive's score is negative
    assert hard_negatives(few, F.lit(False)).count() == 0


# ---- nearest neighbours


def nearest_by_hand(rows, asks, k):
    clean = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in clean:
        if asks(q):
            out[q] = sorted({(-float((v * w).sum()), i) for i, w in clean if i != q and len(w) == len(v)})[:k]
    return out


def test_nearest_is_exact_in_one_part(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(100)]
    rows += [(2, None), (3, [0.0] * 6), (4, [None] * 6), (6, [float("nan")] * 6), (None, [1.0] * 6), (7, []), (4000, [1.0, 2.0]), (4001, [2.0, 1.0]), (4002, [1e200, 1e200])]
    rows += [rows[5], rows[5], (5, [3.0] * 6), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_cell", F.lit("clash"))
    got = {}
    for r in near.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    want = nearest_by_hand(rows, lambda i: i % 20 == 0, 5)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [x[0] for x in sorted(found)] == list(range(1, len(want[q]) + 1))
        assert [x[2] for x in sorted(found)] == [i for _, i in want[q]]
        assert np.allclose([x[1] for x in sorted(found)], [s for s, _ in want[q]])


def test_learned_parts_find_nine_of_ten(spark, monkeypatch):
    """Groups of vectors around centres: several parts, rows of all of them filed, recall against brute force."""
    monkeypatch.setattr(near, "PART_ROWS", 256)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(40, size=4000)] + 0.4 * rng.standard_normal((4000, 16))
    x[:1200] = x[0]  # a third of all rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = near.fitted(near.usable(df, "vec_id", "embedding"), 4000, 20, most=3000)
    router = index.routers[16]
    assert len(router.shares) == 8 and router.recall >= near.TARGET
    got = {}
    for r in near.nearest(df, F.col("vec_id") % 20 == 0, index=index).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    s = x[::20] @ x.T
    hits = []
    for row, q in zip(s, range(0, 4000, 20)):
        row[q] = -np.inf
        floor = np.sort(row)[-20] - 1e-9
        hits.append(np.mean([row[i] >= floor for _, i in got[q]]))
        assert len(got[q]) == 20 and sorted(got[q]) == sorted(got[q], key=lambda y: (y[0], y[1]))
    assert np.mean(hits) >= 0.9
    copies = [i for _, i in sorted(got[0]) if i < 1200]
    assert len(copies) > 5 and copies == [*range(1, len(copies) + 1)]  # ties go to the smaller ids, though the copies lie in several cells
    row, part = router.probes(x[::20])
    searched = np.bincount(part, minlength=8) @ np.bincount(router.part(x), minlength=8) / (200 * 4000)
    assert searched < 0.7  # of pairs


def test_parts_are_balanced():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1024, 8))
    links = near.neighbours(x, x, 16, own=True)
    of = near.balanced_parts(links, x, 8)
    assert np.bincount(of).max() <= np.ceil(128 * (1 + near.SLACK))
    assert (of[links] == of[:, None]).mean() > 2 / 8


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert near.nearest(one, F.col("vec_id") % 20 == 0).count() == 0


def test_cells_hold_at_most_their_rows():
    assert [cell_count(n) for n in (0, 1, 512, 513)] == [1, 1, 1, 2]
    assert cell_count(10**9) == -(-(10**9) // (1 << 16))
