"""The text operators against brute force, round trips and held-out rows, with nulls, empty and repeated rows."""

import collections
import hashlib
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from momentlake.llm import chat_format, decontamination, graph, html_extract, jaccard_join, packing, quality_rules, sharding, token_counts, toxicity, url_filters

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  ", "a  b", "Hello, WORLD's don't we'll 're 'rx", "ΑΣ ΟΔΟΣ Σ İx", "a<|endoftext|>b <|startoftext|>", "e\u0301 日本語 12345 ½²", "\x1cfoo\x1dbar", "🙂🏽 x", "a" * 300, "x\n\n y\t z "]
DOCS = "doc_id long, text string"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def by_id(df, column, key="doc_id"):
    return {r[key]: r[column] for r in df.collect()}


# -- token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.mark.parametrize("text", ODD)
def test_counts_equal_the_library(library, text):
    assert token_counts.counter(WORD_BPE).count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=60) | st.text(alphabet="the 'sdlrvemtion.,!0", max_size=80))
def test_counts_equal_the_library_on_any_text(text):
    assert token_counts.counter(WORD_BPE).count(text) == len(Tokenizer_of(WORD_BPE).encode(text, add_special_tokens=False).ids)


_open = {}


def Tokenizer_of(path):
    if path not in _open:
        _open[path] = Tokenizer.from_file(path)
    return _open[path]


@pytest.mark.parametrize("word", ["thintionhereread", "étreaux", "don't", "'re", "x'll", "<|endoftext|>x", "a1b2", "!!??"])
def test_prefix_tables_equal_the_library(library, word):
    table = token_counts.counter(WORD_BPE).table(word)
    assert list(table) == [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(len(word) + 1)]


def test_budgets_keep_the_longest_prefix(library):
    c = token_counts.counter(WORD_BPE)
    text = "The antidisestablishment of tokenization, don't stop"
    for budget in range(20):
        kept, n = c.keep(text, budget)
        assert n == len(library.encode(kept, add_special_tokens=False).ids) <= budget and text.startswith(kept)
        assert kept == text or len(library.encode(text[: len(kept) + 1].rstrip(), add_special_tokens=False).ids) > budget or text[len(kept)] == " "


def test_token_count_rows(spark, library):
    texts = [*ODD, None, "same", "same"]
    df = docs_of(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = by_id(token_counts.token_counts(df, WORD_BPE, limit=5), "n_tokens")
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert token_counts.token_counts(df.limit(0), WORD_BPE).collect() == []


# -- packing


def test_word_ids_equal_the_library():
    whole = Tokenizer.from_file(BYTE_BPE)
    for t in ODD:
        assert packing.word_ids(BYTE_BPE).encode(t) == array("I", whole.encode(t, add_special_tokens=False).ids).tobytes()


def test_packing_tiles_documents_and_sequences(spark):
    rng = np.random.default_rng(1)
    texts = ["the and of " * int(rng.integers(0, 900)) for _ in range(60)] + [None, "", "twice", "twice"]
    rows = packing.pack_documents(docs_of(spark, texts).withColumn("length", F.lit(1)), BYTE_BPE).collect()
    whole = Tokenizer.from_file(BYTE_BPE)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids, at = [*whole.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(array("I", piece).tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
        assert len(pieces) <= 64


def test_fill_keeps_all_limits():
    rng = np.random.default_rng(2)
    lengths, loss = rng.integers(1, 300, 400), rng.choice([0.0, 0.3, 1.0], 400)
    limits = (512, 8, 256)
    done = np.zeros(400, int)
    for seq in packing.fill(lengths, loss, limits):
        assert sum(n for *_, n in seq) <= 512 and len(seq) <= 8 and sum(n * loss[i] for i, _, n in seq) <= 256 + len(seq)
        for i, _, n in seq:
            done[i] += n
    assert (done == lengths).all()


def test_examples_are_packed_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1, 400)), int(rng.integers(1, 4)), int(rng.integers(0, 300))) for i in range(200)] + [(999, 5000, 1, 10), (1000, None, None, None)]
    got = packing.pack_examples(spark.createDataFrame(rows, "id int, tokens int, segments int, loss int"), "id", "tokens", "segments", "loss", (1024, 8, 512)).collect()
    assert len(got) == 202
    sums = collections.defaultdict(lambda: np.zeros(3))
    for r in got:
        if r["id"] != 999:
            sums[r["sequence_id"]] += (r["tokens"] or 0, r["segments"] or 0, r["loss"] or 0)
    assert all((s <= (1024, 8, 512)).all() for s in sums.values())


# -- sharding


def test_shards_fit_and_are_minimal(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 90).alias("n_bytes"), sharding.hash_bits(F.col("id")).alias("bits"))
    rows = sharding.shard(df.withColumn("shard", F.lit(0)), 700, "bits").collect()
    assert len(rows) == 3000
    total = collections.Counter()
    for r in rows:
        assert r["bits"].startswith(r["shard"]) and len(r["shard"]) == r["depth"]
        total[r["shard"]] += r["n_bytes"] or 0
    assert max(total.values()) <= 700 and all(r["shard_bytes"] == total[r["shard"]] for r in rows)
    for s in total:  # the parent is over the limit
        assert not s or sum(n for t, n in total.items() if t.startswith(s[:-1])) > 700


def test_rows_that_agree_share_a_shard_whatever_its_size(spark):
    df = spark.range(50).select(F.lit(9).alias("n_bytes"), sharding.hash_bits(F.lit("same")).alias("bits"))
    rows = sharding.shard(df, 20, "bits").collect()
    assert {r["depth"] for r in rows} == {sharding.HASH_BITS} and rows[0]["shard_rows"] == 50
    assert sharding.shard(df.limit(0), 20, "bits").collect() == []


# -- URL filters


def plain_verdict(url, entries):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    fits = [e for e in entries if (host == e.host or host.endswith("." + e.host)) and path.startswith(e.path) and host]
    rules = [e for e in fits if e.rule]
    best = max(rules or fits, key=lambda e: (len(e.host) + len(e.path), len(e.host)), default=None)
    return host, path, best.host + best.path if rules else None, best.verdict if best else "allow"


def test_url_verdicts_equal_brute_force(spark):
    E = url_filters.Entry
    entries = [E("com", "/en/", "block"), E("example.com", "/en/7", "allow"), E("net", "/de/", "block"), E("bad.org", "", "block", False), E("good.bad.org", "/x", "allow", False)]
    hosts, paths = ["a.example.com", "EXAMPLE.com", "xexample.com", "com", "b.net:80", "bad.org", "www.good.bad.org", "", "é.net"], ["/en/7", "/en/71?q=/de/", "/en", "/de/8#a", "", "/x/y", "?z"]
    urls = [f"{s}://{h}{p}" for s in ("http", "x") for h in hosts for p in paths] + [None, "", "no-scheme/en/", "a://b://c.net/de/1"] * 2
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "i int, url string, rule string")
    got = {r["i"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_verdicts(df, entries).collect()}
    assert got == {i: plain_verdict(u, entries) for i, u in enumerate(urls)}
    assert url_filters.url_verdicts(df.limit(0), []).collect() == []


def test_a_collision_of_digests_decides_nothing(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filters.xxhash, "xxh64_intdigest", lambda s: 7)
    url_filters.DigestArray.write([url_filters.Entry(h, "", "block") for h in ("a.com", "b.com")], str(tmp_path / "f"))
    assert list(url_filters.DigestArray(str(tmp_path / "f")).find(["b.com", "c.com"]) >= 0) == [True, False]


# -- chats


def test_chats_read_back(spark):
    bad = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "<\n|", "", None, "x\n<|im_end|>\n", "\\n", "é😀"]
    roles = ["user", "assistant", "us\ner", "<\n", "\\n", None]
    rows = [(c, t, roles[(c + t) % 6] if c > 3 else ("user", "assistant")[t % 2], bad[(c * 3 + t) % 10]) for c in range(12) for t in range(1 + c % 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for c in range(12):
        turns = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert [tuple(t) for t in back[c]["turns"]] == turns
        assert back[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
        assert all(not s["loss"] or s["role"] == "assistant" for s in back[c]["segments"])
    assert back[1]["valid"] and not back[2]["valid"] is None and not back[0]["valid"]
    assert chat_format.format_chats(df.limit(0)).collect() == []


# -- decontamination


def plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for k, t in items:
        g = words(t)
        n = min(13, len(g))
        for i in range(len(g) - n + 1) if g else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == g[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(k))
    return len(w), len(hit), sorted(found)


def test_hits_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(rng.choice(["the", "of", "a", "Zoë", "x1", "it's"], n))
    items = [(1, word(20)), (2, word(13)), (3, "only three words"), (4, "one"), (5, ""), (6, None), (7, word(14)), (10, word(13))]
    texts = [word(30) + " " + items[k % 8][1] + " " + word(k) if items[k % 8][1] else word(40) for k in range(40)] + [None, "", "ONE", "only, three; WORDS", word(20), word(20)]
    df = docs_of(spark, texts).withColumn("n_words", F.lit("clash"))
    got = decontamination.find_hits(df, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, found = plain_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, found)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    clean = decontamination.without_contaminated(df, spark.createDataFrame(items, "item_id int, text string"))
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in got if not r["contaminated"]}


def test_no_items_and_no_documents(spark):
    df, none = docs_of(spark, ["a b", None]), spark.createDataFrame([], "item_id int, text string")
    assert by_id(decontamination.find_hits(df, none), "n_hit") == {0: 0, 1: 0}
    assert decontamination.find_hits(df.limit(0), none).collect() == []
    spans = decontamination.without_spans(docs_of(spark, ["x one two y"]), spark.createDataFrame([(1, "one two")], "item_id int, text string"))
    assert spans.first()["clean_words"] == "x y"


# -- quality


def plain_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_base_rules_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "bb", "ü#", "|"], int(rng.integers(0, 40)))).replace("a bb", "a\nbb") for _ in range(60)]
    texts += [None, "", " \n\t", "x\x0by\xa0z", "l\nl\n \n \nl", "w " * 3000, *["the same five words here the same five words here"] * 2]
    got = quality_rules.judge(docs_of(spark, texts).withColumn("kept", F.lit("clash")), [0.0] * quality_rules.BUCKETS).collect()
    assert len(got) == len(texts)
    for r in got:
        n = plain_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and r["kept"] == (not r["base_failed"])


def test_ratio_tells_junk(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PRIOR", 100)  # the corpus has some thousand n-grams
    rng = np.random.default_rng(6)
    good = [" ".join(rng.choice(["river", "stone", "house", "light", "green"], 40)) for _ in range(60)]
    junk = [" ".join(w + "%%%" for w in rng.choice(["river", "stone", "house"], 40)) for _ in range(12)]
    docs = docs_of(spark, good + junk)
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(None,), (3,), (9999,)], "doc_id long")
    kept = by_id(quality_rules.quality(docs, trusted), "kept")
    fails = [i for i, t in enumerate(good + junk) if 100 * plain_base(t)[4] > 20 * 40]
    assert all(kept[i] for i in range(60) if i not in fails) and not any(kept[i] for i in range(60, 72))
    assert quality_rules.quality(docs.limit(0), trusted.limit(0)).collect() == []


# -- near duplicates


def plain_links(texts, threshold=0.8):
    def sets(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    distinct = list(dict.fromkeys(t or "" for t in texts))
    s = [sets(t) for t in distinct]
    links = {i: {j for j in range(len(s)) if i != j and s[i] & s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j])} for i in range(len(s))}
    group = list(range(len(s)))
    for _ in s:
        group = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(s))]
    first = {t: i for i, t in reversed(list(enumerate(t or "" for t in texts)))}
    return {k: (first[distinct[group[distinct.index(t or "")]]], len(links[distinct.index(t or "")]), first[t or ""]) for k, t in enumerate(texts)}


def near_texts():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(12):
        base = list(rng.choice(words, 120))
        for k in range(1 + g * 3):
            t = list(base)
            for p in rng.integers(0, 120, int(rng.integers(0, 4))):
                t[p] = f"n{g}-{k}-{p}"
            texts.append(" ".join(t))
    return texts + texts[5:25] + [None, "", "a b", "a b", "a  b", "a b c"]


def test_links_equal_brute_force(spark, monkeypatch):
    texts = near_texts()
    want = plain_links(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_id"]) for r in jaccard_join.jaccard_join(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    missed = [i for i in want if got[i] != want[i]]
    assert len(missed) <= 2, [(got[i], want[i]) for i in missed]  # the forest's recall is 0.9995 a pair


def test_blocks_lose_and_repeat_nothing():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.choice(60, 40)).astype(np.uint64) for _ in range(30)]
    flat, firsts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    own = rng.integers(0, 3, (30, 2 * jaccard_join.TREES)) << 48  # prefixes of one hash decide
    met = lambda i, j, trees: any(own[i, 2 * t] == own[j, 2 * t] for t in trees)
    similar = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))
    want = np.array([sum(i != j and similar(i, j) and not met(i, j, range(2)) for j in range(30)) for i in range(30)])
    count = lambda at, mine: jaccard_join.link_counts(np.concatenate([sets[i] for i in at]), np.concatenate([[0], np.cumsum([len(sets[i]) for i in at])]), own[at], 2, 1, None, mine, 0.5)
    links, _, steps = count(np.arange(30), None)
    assert (links == want).all() and (steps.sum(1) == want).all()
    half = np.arange(30) % 2
    split = np.zeros(30, int)
    for k in (0, 1):
        at = np.flatnonzero(half == k)
        split[at] += count(at, None)[0]
    assert (split + count(np.arange(30), half)[0] == want).all()
    late = jaccard_join.link_counts(flat, firsts, own, 0, 1, 1, None, 0.5)[0]  # what has met in an earlier round isn't counted again
    assert (late == [sum(i != j and similar(i, j) and not met(i, j, range(jaccard_join.TREES)) for j in range(30)) for i in range(30)]).all()


def test_one_of_each_group_stays(spark):
    texts = near_texts()
    df = docs_of(spark, texts).unionAll(docs_of(spark, texts).limit(3)).withColumn("_class", F.lit("clash"))
    kept = jaccard_join.one_of_each(df)
    want = {c for c, _, _ in plain_links(texts).values()}
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and len(got) == len(set(got)) and len(want ^ set(got)) <= 2
    assert jaccard_join.jaccard_join(df.limit(0)).collect() == []


def test_null_ids_lose_no_links(spark):
    base = [f"w{i}" for i in range(60)]
    near, other, far = " ".join(base), " ".join([*base, "more"]), " ".join(f"x{i}" for i in range(60))
    more = " ".join(f"y{i}" for i in range(60))
    df = spark.createDataFrame([(None, near), (5, near), (3, other), (None, far), (None, f"{far} more"), (None, more), (None, more)], DOCS)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_join(df).collect()), key=repr)
    assert got == sorted([(None, 3, 1, 5), (5, 3, 1, 5), (3, 3, 1, 3), (None, None, 1, None), (None, None, 1, None), (None, None, 0, None), (None, None, 0, None)], key=repr)
    kept = [tuple(r) for r in jaccard_join.one_of_each(df).collect()]
    assert len(kept) == 3 and (3, other) in kept and (None, more) in kept


def test_prefixes_are_nodes_of_a_trie(spark):
    flat, firsts = jaccard_join.shingles(np.arange(80, dtype=np.int64), np.array([0, 40]), np.array([40, 80]))
    own = jaccard_join.signatures(flat, firsts)
    own[1] = own[0]
    own[1, 1] ^= 1  # the last hash of the first tree
    own[1, 2] ^= 1 << 48  # the first one of the second
    df = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(own)], "i int, s array<bigint>")
    for depth in (8, 7, 4, 1):
        a, b = (r["n"] for r in df.select("i", jaccard_join.nodes(F.col("s"), depth).alias("n")).orderBy("i").collect())
        same = [x == y for x, y in zip(a, b)]
        assert same == [jaccard_join._share(own, t, depth)[0, 1] for t in range(jaccard_join.TREES)] == [depth < 8, False, *[True] * (jaccard_join.TREES - 2)]


def test_prefixes_are_shortened_as_links_ask_for():
    none, close, far = np.zeros(jaccard_join.STEPS), np.eye(jaccard_join.STEPS)[-1] * 1e6, np.eye(jaccard_join.STEPS)[0] * 1e6
    longest = lambda found: max(k for k in range(1, 9) if jaccard_join.recall_of(k, found, 8) >= jaccard_join.RECALL)
    assert longest(none) == longest(far) == 5 and longest(close) == 8
    assert jaccard_join.recall_of(5, none, None) == pytest.approx(1 - (1 - 0.8**5) ** jaccard_join.TREES)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 51), (52, 51), (60, 60)] + [(100, x) for x in range(101, 130)]
    found = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(31)} == {0} and found[52] == 50 and {found[x] for x in range(100, 130)} == {100}


# -- toxicity


def toy(spark):
    rng = np.random.default_rng(9)
    clean = [" ".join("".join(rng.choice(list("thernaolis"), int(rng.integers(3, 9)))) for _ in range(30)) for _ in range(300)]
    texts = [t if i % 4 else t + " " + ["idiot", "scumbag", "moron"][i // 4 % 3] + " end" for i, t in enumerate(clean)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_on_held_out_rows_and_disguises(spark):
    docs, labels = toy(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.withColumn("score", F.lit("clash")), model).withColumn("held", toxicity.fold_of(F.col("doc_id")) == 1).where("held").collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got]) >= 0.95
    odd = docs_of(spark, ["what an i d i o t he is", "you i-d-i-o-t", "mooron", "the other stone", None, "", "idiot idiot"])
    scores = by_id(toxicity.score(odd, model), "score")
    assert min(scores[i] for i in (0, 1, 6)) >= 0.7 > max(scores[i] for i in (3, 4, 5)) and scores[2] > scores[3]
    assert all(0 <= s <= 1 for s in scores.values()) and toxicity.score(odd.limit(0), model).collect() == []


def test_held_out_labels_teach_nothing(spark):
    docs, labels = toy(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.landmarks == b.landmarks and np.allclose(a.weights, b.weights) and (a.first, a.curve) == (b.first, b.curve)


def test_no_labels_call_nothing_toxic(spark):
    docs, labels = toy(spark)
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").isEmpty()


def test_no_word_is_kept_from_the_kernel(spark):
    model = toxicity.train(*toy(spark))
    words = ["ixdioxt", "sxcuxmbxag", "mxorxon", "ixdixoxt", "stone", "the", "zzz", "ölpreis"]  # gaps on gaps, and words that share nothing
    want = np.clip(toxicity.kernel(words, model.landmarks) @ model.weights + model.bias, toxicity.FLOOR, toxicity.CLIP)
    got = model.margins(words)
    assert np.allclose(got, want, atol=1e-5)
    assert got[:4].min() > max(toxicity.FLOOR, got[4:].max())
    scores = by_id(toxicity.score(docs_of(spark, ["you ixdioxt", "the stone"]), model), "score")
    assert scores[0] > scores[1]


def test_kernel_equals_its_definition():
    from itertools import combinations

    def plain(s, t, n):
        total = 0.0
        for i in combinations(range(len(s)), n):
            for j in combinations(range(len(t)), n):
                if all(s[a] == t[b] for a, b in zip(i, j)):
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    words = ["idiot", "idxiot", "abc", "stone", "iot"]
    want = [[np.mean([plain(a, b, n) / np.sqrt(plain(a, a, n) * plain(b, b, n)) if plain(a, a, n) * plain(b, b, n) else 0 for n in toxicity.ORDERS]) ** toxicity.POWER for b in words] for a in words]
    assert np.allclose(toxicity.kernel(words, words), want, atol=1e-5)


# -- HTML


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav>
<div class="ad">Buy this now.</div><article><h1>A title &amp; more</h1><p><b>First   paragraph<br>goes on.<p>Second one is <i>here</i>, it has some words.</p></article><footer>&copy; nobody</footer></body></html>"""


@pytest.mark.parametrize("page", ["<svg " * 200_000, '<a "' * 250_000, '<a "' * 250_000 + ">", "<a " * 300_000 + '">', "<a" * 400_000 + ' ">', "<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<div>t" * 100_000, "<!--" * 200_000, "<script>" + "</script " * 100_000])
def test_broken_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    html_extract.blocks_of(page)
    assert time.process_time() - began < 8  # 0.1 to 2 seconds; the square of the length would be hours


def test_broken_markup_is_text():
    texts = lambda page: [b.text for b in html_extract.blocks_of(page)]
    assert texts("<p>a <b c") == ["a <b c"] and texts("<p>a <b c='>") == ["a <b c='>"] and texts("a <!-- b") == ["a"] and texts("x<svg>y") == ["x"]
    assert texts("<p title='a > b'>c") == ["c"] and texts("1 < 2 <p>3") == ["1 < 2", "3"]
    # However many inline elements lie between, a paragraph ends at the next one.
    nested = html_extract.blocks_of("<article><p>" + "<b>" * 30 + "one" + "<p>two")
    assert [b.text for b in nested] == ["one", "two"] and nested[0].depth == nested[1].depth


def test_blocks_of_a_page():
    assert [b.text for b in html_extract.blocks_of(PAGE)] == ["Home", "Blog", "Buy this now.", "A title & more", "First paragraph goes on.", "Second one is here, it has some words.", "© nobody"]
    assert html_extract.blocks_of(None) == html_extract.blocks_of("") == [] and html_extract.blocks_of("<p>a < b<!-- x")[0].text == "a < b"


def test_extraction_on_layouts_it_has_not_seen(spark):
    network = html_extract.train([PAGE.replace("words", f"words {i}") for i in range(40)])
    good = total = 0
    for page, truth in html_extract.composed(["A sentence of some length, as texts have.", "Words and more words follow here.", "Short."], ["Home", "About"], 60, seed=123):
        blocks = html_extract.blocks_of(page)
        main = {t for t, m in truth if m} - {t for t, m in truth if not m}
        other = {t for t, m in truth if not m} - {t for t, m in truth if m}
        for b, p in zip(blocks, network.label([blocks])[0]):
            if b.text in main or b.text in other:
                good, total = good + ((p >= 0.5) == (b.text in main)), total + 1
    assert good / total >= 0.95
    df = spark.createDataFrame([(1, PAGE, "clash"), (2, None, "x"), (3, "", "x"), (4, PAGE, "x")], "page_id int, html string, text string")
    got = by_id(html_extract.extract(df, network), "text", "page_id")
    assert got[1] == got[4] == "A title & more\n\nFirst paragraph goes on.\n\nSecond one is here, it has some words." and got[2] == got[3] == ""
    assert html_extract.extract(df.limit(0), network).collect() == []


def test_blocks_are_read_whole(monkeypatch):
    page = "<article class='a b c d e f g h'>" + "<div>" * 14 + "<p>" + "w " * 30 + "last</p>"
    block = html_extract.blocks_of(page)[0]
    assert {html_extract.zlib.crc32(n.encode()) % html_extract.PATH_BUCKETS for n in ("article", ".h", "p")} <= set(block.path)
    assert html_extract._word_bucket("last") == html_extract.features([block])[2][-1] and len(html_extract.features([block])[2]) == 31
    net = html_extract.Network()
    net.p = {k: v * 4 for k, v in net.p.items()}  # far-reaching states
    pages = [html_extract.blocks_of("".join(f"<p class='c{i * k % 7}'>text {i} of {k}</p>" for i in range(n))) for k, n in enumerate([3, 40, 17, 0, 16])]
    whole = net.label(pages)
    monkeypatch.setattr(html_extract, "STRETCH", 8)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole, net.label(pages)))
    assert [len(p) for p in whole] == [3, 40, 17, 0, 16]


def test_backward_pass_equals_differences():
    net = html_extract.Network(3)
    blocks = html_extract.blocks_of(PAGE)
    labels = np.array([0, 0, 0, 1, 1, 1, 0], np.float32)
    feats = html_extract.features(blocks)

    def loss():
        p = net.forward(*net._batch([feats]))[0][:, 0]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for k in ("hf", "xb", "path"):
        net.p = {n: v.astype(np.float64) for n, v in net.p.items()}
        at = np.unravel_index(5, net.p[k].shape) if k != "path" else (int(feats[0][0]), 1)
        before, eps = net.p[k][at], 1e-3
        net.p[k][at] = before + eps
        up = loss()
        net.p[k][at] = before - eps
        slope = (up - loss()) / (2 * eps)
        net.p[k][at] = before
        moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in net.p.items()}
        kept = {n: v.copy() for n, v in net.p.items()}
        net._step([(feats, labels)], moments, 1, 0.0)
        net.p = kept
        assert moments[k][0][at] / 0.1 == pytest.approx(slope, rel=0.1, abs=2e-4)


def test_digest_of_items(spark):
    assert spark.range(1).select(decontamination.digest(F.array(F.lit("10"), F.lit("2"))).alias("x")).first()["x"] == hashlib.sha256(b"10,2").hexdigest()


# -- what the operators have in common


def test_scores_equal_the_machine_by_hand(spark):
    """Twenty texts: kernels by their definition, the hyperplane, the largest margins and the curves."""
    from itertools import combinations

    docs, labels = toy(spark)
    model = toxicity.train(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(17).collect()] + ["Idiot, idiot!", "a b", "mo-ron ixdiot"]

    def phi(s, n):
        out = collections.Counter()
        for at in combinations(range(len(s)), n):
            out["".join(s[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    def like(s, t):
        total = 0.0
        for n in toxicity.ORDERS:
            a, b = phi(s, n), phi(t, n)
            norm = np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            total += sum(a[k] * b[k] for k in a) / norm if norm else 0.0
        return (total / len(toxicity.ORDERS)) ** toxicity.POWER

    def margin(word):
        strings = toxicity.strings_of(word)
        values = [sum(w * like(s, m) for w, m in zip(model.weights, model.landmarks)) + model.bias for s in strings]
        return max([min(max(v, toxicity.FLOOR), toxicity.CLIP) for v in values], default=toxicity.FLOOR)

    want = []
    for text in texts:
        by_string = {}
        for w in toxicity.words_in(text):
            key = "".join(re.findall(r"[^\W\d_]+", w.lower()))
            by_string[key] = max(by_string.get(key, -9.0), margin(w))
        tops = (sorted(by_string.values(), reverse=True) + [toxicity.FLOOR] * 3)[: toxicity.TOP]
        z = max(model.first[0] * tops[0] + model.first[1], float(np.dot(model.curve[:-1], tops)) + model.curve[-1])
        want.append(1 / (1 + np.exp(-z)))
    got = by_id(toxicity.score(docs_of(spark, texts), model), "score")
    assert np.allclose([got[i] for i in range(20)], want, atol=1e-3)


def test_inserted_letters_are_tolerated(spark):
    model = toxicity.train(*toy(spark))
    words = [w[:i] + x + w[i:] for w in ("idiot", "scumbag") for i in range(2, len(w)) for x in "kw"]
    scores = by_id(toxicity.score(docs_of(spark, [f"then {w} here" for w in words] + ["then stone here", "the others"]), model), "score")
    assert np.mean([scores[i] >= toxicity.PREDICT_FROM for i in range(len(words))]) >= 0.7 and max(scores[len(words)], scores[len(words) + 1]) < toxicity.PREDICT_FROM


def test_a_long_word_is_counted_in_proportion(library):
    import tracemalloc

    word = "abcdefghij" * 20_000
    tracemalloc.start()
    n = token_counts.PrefixCounter(WORD_BPE).count(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(library.encode(word, add_special_tokens=False).ids) and peak < 200_000_000


def test_the_stored_index_answers_questions(spark, library):
    texts = ["The  antidisestablishment of\ttokenization, don't stop", "", None, "one"]
    df = token_counts.prefix_index(docs_of(spark, texts).withColumn("prefix_index", F.lit("clash")), WORD_BPE)
    asked = df.select("doc_id", "text", *(token_counts.cut_at(F.col("prefix_index"), F.lit(b)).alias(f"b{b}") for b in range(16)), token_counts.count_at(F.col("prefix_index"), F.length("text")).alias("all")).collect()
    for r in asked:
        whole = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["all"] or 0) == len(whole)
        for b in range(16):
            head = (r["text"] or "")[: r[f"b{b}"]]
            rest = (r["text"] or "")[len(head) :].split()
            assert len(library.encode(head, add_special_tokens=False).ids) <= b
            assert not rest or len(library.encode(head + " " + rest[0], add_special_tokens=False).ids) > b


def test_a_long_list_of_hosts_and_a_join_beyond_the_limit(spark):
    E = url_filters.Entry
    entries = [E(f"h{i}.example.{('com', 'net')[i % 2]}", ("", "/a", "/ab/")[i % 3], ("block", "allow")[i % 5 == 0], i % 7 == 0) for i in range(100_000)]
    urls = [f"https://{('www.', '')[i % 2]}H{i * 37 % 120_000}.example.com{('/', '/a/b', '/ab/c', '')[i % 4]}" for i in range(400)] + [None, "", "x"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "i int, url string, rule string")
    cols = ("i", "host", "path", "rule", "verdict")
    listed = sorted(tuple(r) for r in url_filters.url_verdicts(df, entries).select(*cols).collect())
    joined = sorted(tuple(r) for r in url_filters.url_verdicts(df, entries, max_bytes=10).select(*cols).collect())
    assert listed == joined and len({r[4] for r in listed}) == 2 and any(r[3] for r in listed)
    some = [e for e in entries if any(e.host in r[1] for r in listed if r[0] < 40)]
    assert [r[1:] for r in listed[:40]] == [plain_verdict(u, some) for u in urls[:40]]


def test_more_n_grams_than_are_broadcast(spark):
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(rng.choice(["the", "of", "a", "Zoë", "x1"], n))
    items = [(1, word(20)), (2, word(14)), (3, "only three words"), (4, "one")]
    texts = [word(30) + " " + items[k % 4][1] + " " + word(k) for k in range(20)] + [None, "", "ONE", "only, three; WORDS", "one " * 40]
    df, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id int, text string")
    cols = ("doc_id", "n_words", "n_hit", "items", "spans")
    small, large = (sorted(tuple(r) for r in decontamination.find_hits(df, bench, broadcast_bytes=b).select(*cols).collect()) for b in (1 << 27, 0))
    assert small == large
    for i, n, hit, found, spans in small:
        assert (n, hit, found) == plain_hits(texts[i], items) and sum(b - a for a, b in spans) == hit


def test_a_long_conversation_is_formatted(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|t"), F.col("id")).alias("text"))
    r = chat_format.read_back(chat_format.format_chats(df)).selectExpr("valid", "size(turns) n", "loss_text").first()
    assert r["valid"] and r["n"] == 20_000 and r["loss_text"] == "".join(f"<|t{i}" for i in range(1, 20_000, 2))


def test_the_role_machine(spark):
    rows = [(1, "system user assistant"), (2, "user assistant user"), (3, "assistant user assistant"), (4, "user user assistant"), (5, "user assistant user assistant"), (6, "user system assistant")]
    df = spark.createDataFrame([(c, k, r, "") for c, roles in rows for k, r in enumerate(roles.split())], "conv_id int, turn int, role string, text string")
    assert by_id(chat_format.format_chats(df), "valid", "conv_id") == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_ratio_by_hand(spark):
    """The mean over words and neighbours of the log of two smoothed shares."""
    texts = ["aa bb cc dd ee ff gg hh ii jj kk", "aa bb aa bb xx yy zz xx yy qq", None]
    docs, trusted = docs_of(spark, texts), spark.createDataFrame([(0,)], "doc_id long")
    table = {w: h for w, h in docs.select(F.explode(quality_rules.words_of(F.col("text"))).alias("w")).distinct().select("w", F.xxhash64("w")).collect()}
    pairs = {(a, b): h for a, b, h in spark.createDataFrame([(a, b, table[a], table[b]) for t in texts if t for a, b in zip(t.split(), t.split()[1:])], "a string, b string, x long, y long").select("a", "b", F.xxhash64("x", "y")).collect()}
    grams = [[h % quality_rules.BUCKETS for h in [*(table[w] for w in t.split()), *(pairs[p] for p in zip(t.split(), t.split()[1:]))]] if t else [] for t in texts]
    raw, target = collections.Counter(g for gs in grams for g in gs), collections.Counter(grams[0])
    corpus = lambda g: (raw[g] + 1) / (sum(raw.values()) + quality_rules.BUCKETS)
    gain = lambda g: np.log((target[g] + quality_rules.PRIOR * corpus(g)) / (sum(target.values()) + quality_rules.PRIOR)) - np.log(corpus(g))
    got = by_id(quality_rules.quality(docs, trusted), "llr")
    assert got[2] is None and all(got[i] == pytest.approx(np.mean([gain(g) for g in grams[i]]), abs=1e-9) for i in (0, 1))


def test_long_words_are_not_remembered():
    ids = packing.word_ids(BYTE_BPE)
    long = ["".join(chr(97 + (i * k) % 26) for i in range(20_000)) for k in range(1, 8)]
    text = " ".join([*long, "short"])
    assert array("I", ids.encode(text)).tolist() == ids.whole.encode(text, add_special_tokens=False).ids
    assert all(len(w) <= packing.REMEMBERED_LETTERS for known in (ids.first, ids.later) for w in known)
