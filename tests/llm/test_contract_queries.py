"""Every registered text query on the smallest tables: against its SQL where there is some, else against what its contract says of its rows."""

import os
import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers

from momentlake.llm import queries

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()
COLUMNS = {
    "op1_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op6_html_extract": "page_id url text n_chars", "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_toxicity": "doc_id held_out score predicted", "op9_token_counts": "doc_id n_bytes n_tokens over_limit", "op10_url_filters": "page_id host path rule verdict",
    "op11_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley", "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score", "op13_nearest": "query_id rank vec_id score",
}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return c


def test_each_number_once():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, duck, name):
    mine = QUERIES[name](spark, small)
    theirs = duck.execute(ORACLES[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert set(COLUMNS.get(name, "").split()) <= set(names)
    place = [names.index(c) for c in mine.columns]
    assert sorted(map(tuple, mine.collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in theirs.fetchall()), key=repr)


def documents(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def test_near_duplicates_against_brute_force(spark, small):
    texts = documents(spark, small)
    words = {i: t.split() for i, t in texts.items()}
    shingles = {i: frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else None for i, w in words.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = shingles[i], shingles[j]
            if texts[i] == texts[j] or (a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                root[find(max(i, j))] = find(min(i, j))
    rows = QUERIES["op3_jaccard_join"](spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == ids
    column = next(c for c in rows[0].asDict() if c != "doc_id" and "class" in c or c in ("root", "group", "near_id"))
    groups = {}
    for r in rows:
        groups.setdefault(r[column], set()).add(r["doc_id"])
    want = {}
    for i in ids:
        want.setdefault(find(i), set()).add(i)
    together = lambda parts: {frozenset(p) for p in parts.values()}
    assert together(groups) <= together(want) or together(groups) == together(want)


def test_packed_ids_are_the_librarys(spark, small):
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, taken = {}, {}
    for r in QUERIES["op4_packing"](spark, small).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in documents(spark, small).items():
        ids, at = array("I", [*whole.encode(text, add_special_tokens=False).ids, 0]), 0
        for p in sorted(pieces.pop(i), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    assert not pieces
    sizes = []
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        sizes.append(at)
    assert sum(sizes) >= 0.95 * sum(1024 if n > 512 else 1 << (n - 1).bit_length() for n in sizes)


def test_tokens_are_counted_as_the_library_does(spark, small):
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = documents(spark, small)
    got = {r["doc_id"]: r for r in QUERIES["op9_token_counts"](spark, small).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n = len(whole.encode(text, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_toxic_scores_are_of_the_contracts_folds(spark, small):
    got = QUERIES["op8_toxicity"](spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(documents(spark, small))
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_nearest_rows_of_the_smallest_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["op13_nearest"](spark, small).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == sorted(ids[ids % 20 == 0])
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        assert [(k, i) for k, i, _ in sorted(found)] == [(k + 1, int(ids[b])) for k, b in enumerate(best)]
        assert np.allclose([v for *_, v in sorted(found)], s[best], atol=1e-12)


@pytest.mark.parametrize("name", ["op6_html_extract", "op7_quality_rules"])
def test_one_row_each(spark, small, name):
    got = QUERIES[name](spark, small)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    of, key = ("pages", "page_id") if name.startswith("op6") else ("documents", "doc_id")
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in spark.read.parquet(f"{small}/{of}.parquet").select(key).collect())
