"""The queries of the text operators, as ``__spark_entry__`` registers them, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract
from .chat_format import format_chats, read_back
from .common import table
from .decontamination import digest, find_hits
from .filter_audit import audit, cells
from .hard_negatives import hard_negatives
from .jaccard_join import jaccard_join
from .nearest import nearest
from .packing import pack_documents
from .quality_rules import quality
from .sharding import hash_bits, shard
from .token_counts import token_counts
from .toxicity import fold_of, score, train
from .url_filters import Entry, url_verdicts

#: What the contracts of the queries fix.
COUNT_LIMIT = 2048
SEQUENCE_TOKENS = 1024
SHARD_BYTES = 8 << 20
URL_RULES = [Entry("com", "/en/", "block"), Entry("example.com", "/en/7", "allow"), Entry("net", "/de/", "block"), Entry("example.net", "/de/8", "block"), Entry("org", "/es/", "block")]
#: Hosts of advertisers and link farms; each is listed with its subdomains.
URL_HOSTS = [f"{name}.example.{end}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest(F.col("items")).alias("items_sha256"), "contaminated")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    back = read_back(format_chats(turns.unionByName(own.select(*(F.col(f.name).cast(f.dataType) for f in turns.schema)))))
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.size(F.filter("segments", lambda x: x["loss"])).cast("long").alias("loss_segments"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=SEQUENCE_TOKENS)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(docs["doc_id"], docs["text"]).alias("bits"))
    return shard(sized, SHARD_BYTES, "bits").drop("bits")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    network = html_extract.train(html_extract.sample(pages, "html"))
    return html_extract.extract(pages, network).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(docs, trusted).drop("text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=COUNT_LIMIT)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", "over_limit")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, [*URL_RULES, *(Entry(h, "", "block", rule=False) for h in URL_HOSTS)]).drop("url")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_chat_format, op3_jaccard_join, op4_packing, op5_sharding, op6_html_extract, op7_quality_rules, op8_toxicity, op9_token_counts, op10_url_filters, op11_filter_audit, op12_hard_negatives, op13_nearest)}


def oracle_sql() -> dict[str, str]:
    """Those that DuckDB can compute from the tables. The others are tested against brute force."""
    return {"op1_decontamination": OP1_SQL, "op2_chat_format": OP2_SQL, "op5_sharding": OP5_SQL, "op10_url_filters": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_hard_negatives": OP12_SQL}


_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""
OP1_SQL = f"""
with i as (select item_id, {_WORDS} w from benchmark),
g as (select distinct item_id, least(len(w), 13) n, w[p + 1 : p + least(len(w), 13)] gram
      from (select item_id, w, unnest(range(greatest(len(w) - 12, 1))) p from i where len(w) > 0)),
d as (select doc_id, {_WORDS} w from documents),
p as (select doc_id, n, p, w[p + 1 : p + n] gram from (select doc_id, w, n, unnest(range(len(w) - n + 1)) p from d, (select distinct n from g) where len(w) >= n)),
h as (select doc_id, p, p.n, item_id from p join g on p.gram = g.gram),
c as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(p, p + n)) k from h) group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, cast(item_id as varchar) item from h) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""
OP2_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
           union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
m as (select *, coalesce(lag(r) over w, '') b, lead(r) over w is null z from c window w as (partition by conv_id order by turn, r, t)),
e as (select *, length(replace(replace(t, '\', '\\'), '<|', '<\|')) nt, length(replace(replace(replace(r, '\', '\\'), '<|', '<\|'), chr(10), '\n')) nr from m)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
       coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
       sum(12 + nr + 1 + nt + 11)::bigint formatted_chars,
       bool_and(b || '>' || r in ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') and (not z or r = 'assistant')) valid,
       count(*) filter (r = 'assistant') loss_segments
from e group by conv_id
""".replace("\\\\", "\\")
OP5_SQL = f"""
with d as (select doc_id, coalesce(strlen(text), 0)::bigint n_bytes,
                  to_base(('0x' || md5(cast(doc_id as varchar) || chr(10) || coalesce(text, ''))[1:15])::bigint, 2, 60) bits from documents),
l as (select doc_id, n_bytes, k::int depth, bits[1:k] shard from d, (select unnest(range(61)) k)),
s as (select depth, shard, sum(n_bytes)::bigint shard_bytes, count(*) shard_rows from l group by all),
r as (select l.*, shard_bytes, shard_rows, row_number() over (partition by doc_id order by depth) k from l join s using (depth, shard) where shard_bytes <= {SHARD_BYTES} or depth = 60)
select doc_id, n_bytes, shard, depth, shard_bytes, shard_rows from r where k = 1
"""
OP11_SQL = r"""
with l as (select doc_id, coalesce(max((quality = 1)::int), 0) good, coalesce(max((toxic = 1)::int), 0) toxic from labels group by doc_id),
d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') w from documents),
f as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
             [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
              coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)] x from d left join l using (doc_id)),
c as (select part, x, count(*) n, sum(good) good, sum(toxic) toxic from f group by all),
a as (select unnest(range(5)) i),
o as (select [a.i, b.i, c.i, d.i, e.i] p from a, a b, a c, a d, a e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select list_aggregate(list_transform(p, lambda i: 'ABCDE'[i + 1]), 'string_agg', '') filter_order, k step, p[k] f, p[1:k - 1] b from o, (select unnest(range(1, 6)) k)),
r as (select part, filter_order, step::int step, s.f, x[s.f + 1] fails, list_bool_or(list_transform(b, lambda i: x[i + 1])) gone, x, n, good, toxic from c, s),
t as (select part, filter_order, step, f, coalesce(sum(n) filter (not fails and not coalesce(gone, false)), 0)::bigint kept, coalesce(sum(n) filter (fails and not coalesce(gone, false)), 0)::bigint removed,
             coalesce(sum(n) filter (fails and gone), 0)::bigint redundant, coalesce(sum(n) filter (fails and len(list_filter(x, lambda y: y)) = 1), 0)::bigint unique_fails,
             coalesce(sum(good) filter (fails and not coalesce(gone, false)), 0)::bigint good_lost, coalesce(sum(toxic) filter (fails and not coalesce(gone, false)), 0)::bigint toxic_lost from r group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint shapley from t
"""
_CLEAN = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
OP12_SQL = f"""
with v as (select vec_id i, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings where label is not null and {_CLEAN}),
s as (select a.i a, b.i, a.l = b.l same, list_dot_product(a.e, b.e)::bigint s from v a join v b on a.i % 100 = 0 and a.i <> b.i and len(a.e) = len(b.e)),
p as (select a, i p, s ps from (select *, row_number() over (partition by a order by s desc, i) k from s where same) where k <= 5),
n as (select p.a, p, ps, i n, s, row_number() over (partition by p.a, p order by s desc, i) k from p join s on p.a = s.a and not same and 80 * ps <= 100 * s and 100 * s <= 100 * ps)
select a anchor_id, p positive_id, k::int "rank", n negative_id, ps positive_score, s negative_score from n where k <= 5
"""
_RULES = ", ".join(f"('{e.host}', '{e.path}', '{e.verdict}')" for e in URL_RULES)
OP10_SQL = f"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
r as (select * from (values {_RULES}) t(h, s, v)),
b as (select unnest([{", ".join(f"'{h}'" for h in URL_HOSTS)}]) h),
m as (select page_id, h || s rule, v from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s)
      qualify row_number() over (partition by page_id order by length(h || s) desc, length(h) desc) = 1)
select page_id, host, path, rule, coalesce(v, case when exists (select 1 from b where host = h or ends_with(host, '.' || h)) then 'block' else 'allow' end) verdict
from p left join m using (page_id)
"""
