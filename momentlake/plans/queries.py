"""The operators on the driver's tables: a user is a recording, an event type a type, a value a score or a speed."""

from __future__ import annotations

import struct as _struct
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import intervals as I
from ..operators import laps as L
from ..operators import cascade, detect, learn, moments, rank, series
from ..sources import records
from ..streaming import sessions as streams

HOUR, DAY = 3600.0, 86400.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """r, y, i, t, e, v: recording, type, id, start, end, value."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("r"), F.col("event_type").alias("y"), F.col("event_id").alias("i"), S.epoch(F.col("ts")).alias("t"), (S.epoch(F.col("ts")) + F.col("value") * 60).alias("e"), F.col("value").alias("v"), *extra
    )


EV = "ev as (select user_id r, event_type y, event_id i, epoch(ts) t, epoch(ts) + value * 60 e, value v from events)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    """c, k, o, p, st: customer, id, day as a number, price, status."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), (S.epoch(F.col("o_orderdate")) / DAY).alias("o"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("st"))


ORD = "od as (select o_custkey c, o_orderkey k, epoch(o_orderdate) / 86400 o, o_totalprice p, o_orderstatus st from orders)"


@query(f"""with {EV}, m as (select *, max(e) over (partition by r, y order by t, i rows between unbounded preceding and 1 preceding) pm from ev),
g as (select *, sum(case when t > pm + 3600 then 1 else 0 end) over (partition by r, y order by t, i rows unbounded preceding) k from m)
select r, y, min(t) t, max(e) e, max(v) v, count(*) n from g group by r, y, k""")
def merge_same_type(spark, d):
    """Runs of one type, gaps of an hour bridged."""
    return I.merge_same_type(events(spark, d), ["r", "y"], "t", "e", "v", "i", HOUR)


def _spans(strict: str) -> str:
    return f"""with {ORD}, s as (select c, k, o, o + 30 e from od), m as (select *, max(e) over (partition by c order by o, k rows between unbounded preceding and 1 preceding) pm from s),
g as (select *, sum(case when o {strict} pm then 1 else 0 end) over (partition by c order by o, k rows unbounded preceding) j from m)
select c, min(o) o, max(e) e, count(*) n from g group by c, j"""


@query(_spans(">="))
def clusters_strict(spark, d):
    return I.merge_spans(orders(spark, d).withColumn("e", F.col("o") + 30), ["c"], "o", "e", "k", strict=True)


@query(_spans(">"))
def merged_spans(spark, d):
    return I.merge_spans(orders(spark, d).withColumn("e", F.col("o") + 30), ["c"], "o", "e", "k")


@query(f"""with {EV}, f as (select *, v >= 20 w from ev), n as (select *, row_number() over (partition by r order by t, i) - row_number() over (partition by r, w order by t, i) g from f)
select r, min(t) t_start, max(t) t_end, count(*) n from n where w group by r, g having count(*) >= 3""")
def runs_min_count(spark, d):
    return I.runs(events(spark, d).withColumn("w", F.col("v") >= 20), ["r"], "t", "w", "i", min_count=3)


@query(f"""with {EV}, f as (select *, v >= 20 w, lag(v >= 20) over (partition by r order by t, i) pw, lag(t) over (partition by r order by t, i) pt from ev),
g as (select *, sum(case when w and pw and t - pt <= 43200 then 0 else 1 end) over (partition by r order by t, i rows unbounded preceding) k from f)
select r, min(t) t_start, max(t) t_end, count(*) n from g where w group by r, k having count(*) >= 2""")
def puck_runs(spark, d):
    """Runs that a gap of over half a day also ends."""
    return I.runs(events(spark, d).withColumn("w", F.col("v") >= 20), ["r"], "t", "w", "i", min_count=2, max_gap=DAY / 2)


@query(f"""with {EV}, s as (select *, case when v >= 20 then 2 when v <= 12 then 1 else 0 end st from ev),
n as (select *, case when lag(st) over (partition by r order by t, i) = st then 0 else 1 end c from s),
g as (select *, sum(c) over (partition by r order by t, i rows unbounded preceding) k from n),
p as (select r, k, st, min(t) t_start, max(t) t_end, count(*) n from g group by r, k, st),
q as (select *, lag(st) over (partition by r order by k) ps, lag(t_end) over (partition by r order by k) - lag(t_start) over (partition by r order by k) pl from p)
select r, t_start, t_end, n from q where st = 2 and t_end - t_start >= 3600 and ps = 1 and pl >= 3600""")
def own_off_track_runs(spark, d):
    return I.runs_after(events(spark, d), ["r"], "t", "v", "i", high=20, low=12, min_seconds=HOUR, before_seconds=HOUR)


@query(f"with {EV} select r, median(v) median, count(*) n, (floor(t / 86400) + 0.5) * 86400 t from ev group by r, floor(t / 86400)")
def per_second_median(spark, d):
    return series.bucket_median(events(spark, d), ["r"], "t", "v", DAY)


@query(f"with {EV} select r, round(avg(case when v >= 20 then 1.0::double else 0 end), 6) share, (floor(t / 86400) + 0.5) * 86400 t from ev group by r, floor(t / 86400)")
def per_second_share(spark, d):
    return series.bucket_share(events(spark, d), ["r"], "t", F.col("v") >= 20, DAY).withColumn("share", F.round("share", 6))


@query(f"with {EV}, f as (select y, floor(t / 86400) k, floor(t / 3600) h, count(distinct r) n from ev group by all) select y, max(n) most, (k + 0.5) * 86400 t from f group by y, k")
def riders_per_bucket(spark, d):
    return series.bucket_most_distinct(events(spark, d), ["y"], "t", "r", HOUR, DAY)


@query(f"""with {EV} select ai, bi from (select a.i ai, b.i bi, row_number() over (partition by a.i order by abs(b.t - a.e), b.i) n
from ev a join ev b on a.r = b.r and a.y = 'click' and b.y = 'view' and b.t between a.e - 5400 and a.e + 18000) where n = 1""")
def handover_interval_nearest(spark, d):
    e = events(spark, d)
    first = e.where("y = 'click'").select("r", F.col("i").alias("ai"), F.col("e").alias("ae"))
    second = e.where("y = 'view'").select("r", F.col("i").alias("bi"), F.col("t").alias("bt"))
    return I.nearest_after(first, second, ["r"], "ae", "bt", "ai", "bi", 5400, 18000).select("ai", "bi")


@query(f"""with {EV}, w as (select r, i, t s, t + 7200 + v * 60 e from ev), p as (select a.r, a.i a, b.i b, least(a.e, b.e) - greatest(a.s, b.s) o, greatest(a.e, b.e) - least(a.s, b.s) u
from w a join w b on a.r = b.r and a.i < b.i) select r, a, b, round(o / u, 6) overlap from p where o > 0 and o / u >= 0.5""")
def overlap_iou_pairs(spark, d):
    e = events(spark, d).withColumn("w", F.col("e") + 7200)
    return I.overlap_pairs(e, ["r"], "t", "w", "i", 0.5, width=4 * HOUR).withColumn("overlap", F.round("overlap", 6))


@query(f"""with {EV}, w as (select r, i, y, t s, t + 7200 + v * 60 e from ev) select ai, bi, round(o, 6) covered from (
select a.i ai, b.i bi, least(a.e, b.e) - greatest(a.s, b.s) o, row_number() over (partition by a.i order by least(a.e, b.e) - greatest(a.s, b.s) desc, b.i) n
from w a join w b on a.r = b.r and a.y = 'click' and b.y = 'view' where least(a.e, b.e) - greatest(a.s, b.s) > 0 and least(a.e, b.e) - greatest(a.s, b.s) >= 0.6 * (a.e - a.s)) where n = 1""")
def best_overlap_source(spark, d):
    e = events(spark, d).withColumn("w", F.col("e") + 7200)
    a = e.where("y = 'click'").select("r", F.col("i").alias("ai"), F.col("t").alias("s0"), F.col("w").alias("s1"))
    b = e.where("y = 'view'").select("r", F.col("i").alias("bi"), F.col("t").alias("c0"), F.col("w").alias("c1"))
    return I.best_overlap(a, b, ["r"], "s0", "s1", "c0", "c1", "ai", "bi", width=4 * HOUR).select("ai", "bi", F.round("covered", 6).alias("covered"))


@query(f"""with {EV} select a.i w, count(*) n, sum(b.i)::bigint ids from ev a join ev b on a.r = b.r and a.y = 'purchase' and b.t >= a.t - 21600 and b.t <= a.t + 21600 group by a.i""")
def windows_for(spark, d):
    """Events in a window of six hours to each side of a purchase."""
    e = events(spark, d)
    a = e.where("y = 'purchase'").select("r", F.col("i").alias("w"), F.col("t").alias("wt"))
    found = I.in_range(a, e.select("r", "i", "t"), ["r"], F.col("wt") - 6 * HOUR, F.col("wt") + 6 * HOUR, F.col("t"), 12 * HOUR)
    return found.groupBy("w").agg(F.count("*").alias("n"), F.sum("i").alias("ids"))


_ASOF = f"""with {EV}, a as (select * from ev where y = 'click'), b as (select * from ev where y = 'view'),
p as (select a.r, a.i, a.t, b.t bt, b.v bv from a asof left join b on a.r = b.r and a.t >= b.t), q as (select a.i, b.t nt, b.v av from a asof left join b on a.r = b.r and a.t <= b.t)"""


def _sides(spark, d):
    e = events(spark, d)
    return series.asof(e.where("y = 'click'"), e.where("y = 'view'"), ["r"], "t", "v", "i")


@query(_ASOF + " select i, bt before_t, bv before_v from p")
def asof_backward(spark, d):
    return _sides(spark, d).select("i", "before_t", "before_v")


@query(_ASOF + " select p.i, round(coalesce(bv + coalesce((t - bt) / nullif(nt - bt, 0), 0) * (av - bv), bv, av), 6) x from p join q using (i)")
def interp_linear(spark, d):
    found = _sides(spark, d)
    return found.select("i", F.round(series.interpolated(found, "t"), 6).alias("x"))


@query(f"""with {EV}, a as (select r, i, t s, e from ev where y = 'click'), b as (select r, t, v from ev where y = 'view'),
m as (select a.i, median(v) x from a join b on a.r = b.r and b.t between a.s - 1800 and a.e + 1800 group by a.i),
n as (select i, v x from (select a.i, v, row_number() over (partition by a.i order by abs(b.t - (s + e) / 2), b.t, v) k from a join b on a.r = b.r and abs(b.t - (s + e) / 2) <= 18000) where k = 1)
select i, round(coalesce(m.x, n.x), 6) "value", coalesce(coalesce(m.x, n.x) >= 15, true) kept from a left join m using (i) left join n using (i)""")
def on_track_median_default(spark, d):
    e = events(spark, d)
    a = e.where("y = 'click'").select("r", "i", F.col("t").alias("s0"), F.col("e").alias("s1"))
    b = e.where("y = 'view'").select("r", F.col("t").alias("bt"), F.col("v").alias("bv"))
    return series.median_or_nearest(a, b, ["r"], "s0", "s1", "bt", "bv", "i", least=15, pad=1800, reach=5 * HOUR, width=6 * HOUR).withColumn("value", F.round("value", 6))


@query(f"""with {EV}, a as (select r, i, t s, e from ev where y = 'click'), b as (select r, t, v from ev),
m as (select a.i, avg(v) share, count(*) n from a join b on a.r = b.r and b.t between a.s - 43200 and a.e + 43200 group by a.i)
select i, round(share, 6) share, coalesce(n, 0) n from a left join m using (i)""")
def span_share_padded(spark, d):
    e = events(spark, d)
    a = e.where("y = 'click'").select("r", "i", F.col("t").alias("s0"), F.col("e").alias("s1"))
    b = e.select("r", F.col("t").alias("bt"), F.col("v").alias("bv"))
    return series.span_share(a, b, ["r"], "s0", "s1", "bt", "bv", "i", pad=DAY / 2, width=DAY).withColumn("share", F.round("share", 6))


def _votes(spark, d):
    vote = F.pmod(F.length("text"), F.lit(3)) - 1
    return table(spark, d, "conversations").select("conv_id", "turn", "role", vote.alias("vote"), F.split(F.lower("text"), " ").alias("tags"))


_VOTES = "vo as (select conv_id, turn, role, length(text) % 3 - 1 vote, string_split(lower(text), ' ') tags from conversations), la as (select * from (select *, row_number() over (partition by conv_id order by turn desc, role desc) n from vo) where n = 1)"


@query(f"with {_VOTES} select conv_id, turn, role, vote from la")
def latest_vote(spark, d):
    return rank.latest(_votes(spark, d), ["conv_id"], "turn", "role").drop("tags")


@query(f"with {_VOTES} select count(*) filter (vote > 0) up, count(*) filter (vote < 0) down, count(*) filter (vote = 0) cleared from la")
def votes_stats(spark, d):
    return rank.vote_stats(_votes(spark, d), ["conv_id"], "turn", "role", "vote")


@query(f"with {_VOTES} select conv_id, turn from la where list_contains(tags, 'the')")
def tagged(spark, d):
    return rank.tagged(_votes(spark, d), ["conv_id"], "turn", "role", "tags", "the").select("conv_id", "turn")


@query("select doc_id, sha1(concat_ws('|', lang, source, round_even(n_chars / 8, 0)::bigint::varchar, round_even(doc_id / 2, 0)::bigint::varchar, 'action'))[1:20] \"key\" from documents")
def clip_key(spark, d):
    return table(spark, d, "documents").select("doc_id", S.clip_key(F.col("lang"), F.col("source"), F.col("n_chars") / 8, F.col("doc_id") / 2, F.lit("action")).alias("key"))


@query("select doc_id, round(('0x' || sha1('explore|' || doc_id)[1:8])::bigint / 4294967295.0::double, 9) draw from documents")
def explore_draw(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(S.explore_draw(F.col("doc_id").cast("string")), 9).alias("draw"))


@query(f"""with {EV}, k as (select r, i, y, v, row_number() over (partition by r order by v desc, i) n, count(*) over (partition by r) m from ev),
g as (select *, y = 'purchase' fr, v < 2 lo, n > ceil(m * 20.0 / 100) la, ('0x' || sha1('explore|' || i)[1:8])::bigint / 4294967295.0::double < 0.1 dr from k)
select r, i, case when fr then 'exempt' when not lo and not la then 'score' when dr then 'explored' when lo then 'low' else 'late' end reason,
       fr or (not lo and not la) or dr kept from g""")
def gate_top_pct(spark, d):
    return rank.gate(events(spark, d), ["r"], "i", "v", "y", min_score=2, top=20, exempt=["purchase"]).select("r", "i", "reason", "kept")


_LABELLED = "la as (select distinct doc_id, quality, toxic, n_chars, lang, source from documents join labels using (doc_id))"


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source").join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic", "n_chars", "lang", "source").distinct()


@query(f"""with {_LABELLED}, k as (select *, (row_number() over (partition by lang order by n_chars, doc_id) - 1) / nullif(count(*) over (partition by lang) - 1, 0) p from la)
select doc_id, round(coalesce(p, 0.5), 6) place, round(0.25 * quality + 0.75 * coalesce(p, 0.5), 6) blend from k""")
def rank_blend(spark, d):
    x = _labelled(spark, d).withColumn("place", rank.rank_share(["lang"], "n_chars", "doc_id"))
    return x.select("doc_id", F.round("place", 6).alias("place"), F.round(0.25 * F.col("quality") + 0.75 * F.col("place"), 6).alias("blend"))


@query(f"""with {_LABELLED}, k as (select *, row_number() over (order by n_chars desc, doc_id) - 1 i, count(*) over () n from la)
select doc_id, (ceil(15 * (i + 1) / n) - 1)::int band, case when i / greatest(n - 1, 1) < 1 / 3 then 'high' when i / greatest(n - 1, 1) < 2 / 3 then 'medium' else 'low' end third from k""".replace("15 * (i + 1) / n", "15 * (i + 1)::double / n"))
def draw_bands(spark, d):
    """Rating rounds are drawn from one person's moments; here the labelled documents stand for them, as one group."""
    return rank.bands(_labelled(spark, d), [], "n_chars", "doc_id").select("doc_id", "band", "third")


@query(f"""with {EV}, s as (select r, i, regr_slope(ln(greatest(v * 100, 1)), t / 3600) over w slope, count(*) over w n from ev window w as (partition by r order by t, i rows between 7 preceding and current row))
select i, round(slope, 6) slope from s where n = 8""")
def sliding_log_slope(spark, d):
    e = events(spark, d).withColumns({"h": F.col("t") / HOUR, "a": F.col("v") * 100})
    return series.sliding_slope(e, ["r"], "h", "a", "i").select("i", F.round("slope", 6).alias("slope"))


@query(f"with {EV} select r, y, round(regr_slope(v, t / 3600), 6) slope, count(*) n from ev group by r, y having count(*) >= 3")
def closing_slope(spark, d):
    g = events(spark, d).groupBy("r", "y").agg(F.round(F.regr_slope("v", F.col("t") / HOUR), 6).alias("slope"), F.count("*").alias("n"))
    return g.where("n >= 3")


@query(f"with {EV} select i, round(median(v) over (partition by r order by t range between 86400 preceding and 86400 following), 6) m from ev")
def rolling_median_range(spark, d):
    e = events(spark, d)
    return e.select("i", F.round(series.rolling_median(e, ["r"], "t", "v", DAY), 6).alias("m"))


@query(f"with {EV} select i, round(avg(v) over (partition by r order by t, i rows between 2 preceding and 2 following), 6) m from ev")
def moving_average(spark, d):
    return events(spark, d).select("i", F.round(series.moving_average(["r"], "t", "i", "v", 5), 6).alias("m"))


@query(f"""with {EV}, l as (select *, v - lag(v) over w dv, t - lag(t) over w dt from ev window w as (partition by r order by t, i)),
g as (select r, max(v) most, min(v) least, arg_max(v, (t, i)) - arg_min(v, (t, i)) change, min(case when dt > 0.05 then dv / dt * 3600 end) brake, max(case when dt > 0.05 then dv / dt * 3600 end) push from l group by r)
select r, most, least, round(change, 6) change, round(brake, 6) brake, round(push, 6) push from g""")
def motion_features(spark, d):
    by = Window.partitionBy("r").orderBy("t", "i")
    l = events(spark, d).withColumns({"dv": F.col("v") - F.lag("v").over(by), "dt": F.col("t") - F.lag("t").over(by)})
    rate = F.when(F.col("dt") > 0.05, F.col("dv") / F.col("dt") * HOUR)
    at = F.struct("t", "i")
    return l.groupBy("r").agg(
        F.max("v").alias("most"), F.min("v").alias("least"), F.round(F.max_by("v", at) - F.min_by("v", at), 6).alias("change"), F.round(F.min(rate), 6).alias("brake"), F.round(F.max(rate), 6).alias("push")
    )


_LAPS = f"{ORD}, lp as (select *, sum(case when st = 'F' then 1 else 0 end) over (partition by c order by o, k rows unbounded preceding) lap from od)"


@query(f"""with {_LAPS}, g as (select c, lap, min(o) t_start, max(o) la, count(*) n from lp group by c, lap)
select c, lap::bigint lap, t_start, n, coalesce(lead(t_start) over w, la) t_end, lap = 0 out_lap, lead(t_start) over w is null in_lap from g window w as (partition by c order by lap)""")
def lap_segments(spark, d):
    return L.lap_table(orders(spark, d), ["c"], "o", "k", F.col("st") == "F")


@query(f"""with {_LAPS}, s as (select *, sum(p) over (partition by c, lap order by o, k rows unbounded preceding) dn, sum(p) over (partition by c, lap) w from lp)
select c, lap::bigint lap, min(case when dn >= w / 3 then o end) t_first, min(case when dn >= w * 2 / 3 then o end) t_second, round(max(dn), 2) way from s group by c, lap""")
def sectors_thirds(spark, d):
    numbered = L.lap_numbers(orders(spark, d), ["c"], "o", "k", F.col("st") == "F")
    return L.thirds(numbered, ["c", "lap"], "o", "k", "p", "o").withColumn("way", F.round("way", 2))


@query(f"""with {ORD}, b as (select *, min(p) over (partition by c order by o, k rows between unbounded preceding and 1 preceding) bb, min(p) over (partition by c, floor(o / 365)) bd from od)
select k, bb best_before, bd best_day, case when bb is null or p <= bb then 'purple' when p <= bd then 'green' else 'white' end colour from b""")
def best_so_far_colour(spark, d):
    """Best before and best of the year, by customer."""
    o = orders(spark, d).withColumn("day", F.floor(F.col("o") / 365))
    return L.best_so_far(o, ["c"], "day", "o", "k", "p").select("k", "best_before", "best_day", "colour")


@query(f"with {ORD} select c, k, rank from (select c, k, row_number() over (partition by c order by o desc, k desc) rank from od) where rank <= 4")
def recent_laps(spark, d):
    return L.recent(orders(spark, d), ["c"], "o", "k").select("c", "k", "rank")


@query(f"with {ORD} select c, min(p) best, arg_min(k, (p, k)) best_id from od where st = 'F' group by c")
def best_lap(spark, d):
    return L.best_lap(orders(spark, d), ["c"], "p", "k", F.col("st") == "F")


@query(f"with {ORD} select c, floor(o / 365)::bigint \"day\", min(p) best, arg_min(k, (p, k)) best_id from od group by c, floor(o / 365)")
def day_best(spark, d):
    return L.best_lap(orders(spark, d).withColumn("day", F.floor(F.col("o") / 365)), ["c", "day"], "p", "k", F.lit(True))


@query("""with b as (select c_nationkey g, c_custkey k, c_acctbal a, c_custkey::double x from customer)
select k, round((x - min(x) over w) / greatest(max(x) over w - min(x) over w, 1e-9), 6) x, round(1 - (a - min(a) over w) / greatest(max(a) over w - min(a) over w, 1e-9), 6) y from b window w as (partition by g)""")
def track_map_normalise(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("la"), F.col("c_custkey").cast("double").alias("lo"))
    return L.track_map(c, ["g"], "la", "lo").select("k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings), f as (select label, arg_min(e, vec_id) f from v group by label)
select vec_id, round(degrees(acos(greatest(-1, least(1, list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))))))), 4) angle from v join f using (label)""")
def unit_vector_angle(spark, d):
    """The angle of each vector to the first of its label."""
    v = table(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    return v.join(first, "label").select("vec_id", F.round(S.unit_angle(F.col("embedding"), F.col("f")), 4).alias("angle"))


_HOURLY = f"{EV}, ho as (select y, floor(t / 3600)::bigint k, sum(v) v from ev group by all)"


def _hourly(spark, d, y, name):
    return events(spark, d).where(F.col("y") == y).groupBy(F.floor(F.col("t") / HOUR).alias("k")).agg(F.sum("v").alias(name))


@query(f"""with {_HOURLY}, l as (select unnest(range(-6, 7)) lag) select lag::int lag, round(corr(a.v, b.v), 6) r, count(*) n
from l, ho a, ho b where a.y = 'click' and b.y = 'view' and a.k = b.k - lag group by lag""")
def lag_correlation(spark, d):
    return series.lag_correlation(_hourly(spark, d, "click", "va"), _hourly(spark, d, "view", "vb"), [], "k", "va", "vb", 6).withColumn("r", F.round("r", 6))


_DAILY = f"{EV}, da as (select r, y, floor(t / 86400)::bigint k, max(v) v from ev group by all)"


@query(f"""with {_DAILY}, o as (select unnest(range(-3, 4)) o), c as (select a.r, o, median(abs(a.v - b.v)) cost, count(*) n from o, da a join da b on a.r = b.r where a.y = 'click' and b.y = 'view' and a.k = b.k + o group by a.r, o)
select r, o::int "offset", round(cost, 6) cost, n from (select *, row_number() over (partition by r order by cost, o) q from c) where q = 1""")
def clock_offset_grid(spark, d):
    e = events(spark, d).withColumn("k", F.floor(F.col("t") / DAY)).groupBy("r", "y", "k").agg(F.max("v").alias("v"))
    a, b = e.where("y = 'click'").select("r", "k", F.col("v").alias("va")), e.where("y = 'view'").select("r", "k", F.col("v").alias("vb"))
    return series.offset_grid(a, b, ["r"], "k", "va", "vb", range(-3, 4)).select("r", "offset", F.round("cost", 6).alias("cost"), "n")


@query(f"""with {_DAILY}, s as (select unnest(range(-5, 6)) s), c as (select a.r, s, corr(a.v, b.v) x, count(*) n from s, da a join da b on a.r = b.r where a.y = 'click' and b.y = 'view' and a.k = b.k - s group by a.r, s)
select r, s::int lag, round(x, 6) score, n from (select *, row_number() over (partition by r order by round(x, 6) desc, s) q from c where n >= 3 and x is not null and not isnan(x)) where q = 1""")
def template_match_start(spark, d):
    """The start at which two daily series of a user agree best."""
    e = events(spark, d).withColumn("k", F.floor(F.col("t") / DAY)).groupBy("r", "y", "k").agg(F.max("v").alias("v"))
    a, b = e.where("y = 'click'").select("r", "k", F.col("v").alias("va")), e.where("y = 'view'").select("r", "k", F.col("v").alias("vb"))
    c = series.lag_correlation(a.withColumnRenamed("r", "u"), b.withColumnRenamed("r", "u"), ["u"], "k", "va", "vb", 5)
    best = c.where("n >= 3 AND r IS NOT NULL AND NOT isnan(r)").withColumn("score", F.round("r", 6))
    w = Window.partitionBy("u").orderBy(F.desc("score"), "lag")
    return best.withColumn("q", F.row_number().over(w)).where("q = 1").select(F.col("u").alias("r"), "lag", "score", "n")


@query(f"""with {EV}, c as (select a.r, a.t, round_even((b.t - a.t) / 600, 0)::bigint k from ev a join ev b on a.r = b.r and a.y = 'click' and b.y = 'view' and abs(b.t - a.t) <= 14400),
v as (select r, k, count(*) pairs from (select distinct r, t, k from c) group by r, k)
select r, k * 600.0::double shift, pairs from (select *, row_number() over (partition by r order by pairs desc, abs(k), k) n from v) where n = 1""")
def landmark_vote(spark, d):
    e = events(spark, d)
    a, b = e.where("y = 'click'").select("r", "t"), e.where("y = 'view'").select("r", F.col("t").alias("m"))
    return series.landmark_vote(a, b, ["r"], "t", "m", 4 * HOUR, 600.0)


@query("select doc_id from (select doc_id, row_number() over (partition by lang, source, n_chars order by doc_id) n, lang is null or source is null or n_chars is null b from documents) where n = 1 or b")
def duplicate_recordings(spark, d):
    return rank.first_of(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source", "n_chars"], "doc_id").select("doc_id")


_CH = "ch as (select l_orderkey r, l_linenumber c, l_quantity q, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey rows between unbounded preceding and 1 preceding), 0) f from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate))"


def _chapters(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate")
    once = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.row_number().over(w).alias("n")).where("n = 1")
    return rank.offsets(once.select(F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c"), F.col("l_quantity").alias("q")), ["r"], "c", "q")


@query(f"with {_CH} select r, c, q, f \"offset\" from ch")
def chapter_offsets(spark, d):
    return _chapters(spark, d)


@query(f"""with {_CH}, p as (select o_orderkey r, o_totalprice / 2000 a from orders), e as (select *, min(c) over (partition by r) lo, max(c) over (partition by r) hi from ch)
select r, c from (select p.r, c, row_number() over (partition by p.r order by c desc) n from p join e on p.r = e.r where (c = lo or a >= f) and (c = hi or a < f + q)) where n = 1""")
def chapter_at(spark, d):
    probes = table(spark, d, "orders").select(F.col("o_orderkey").alias("r"), (F.col("o_totalprice") / 2000).alias("a"), F.col("o_orderkey").alias("p"))
    return rank.chapter_at(_chapters(spark, d), probes, ["r"], "offset", "q", "a", "p", "c").select("r", "c")


_PATTERNS = [("src1", "front"), ("src1", "front"), ("src12", "rear"), ("rc1", "side"), ("src", "any"), ("src19", "helmet")]


@query("""with p as (select * from (values ('src1', 'front'), ('src12', 'rear'), ('rc1', 'side'), ('src', 'any'), ('src19', 'helmet')) t(pattern, v))
select doc_id, pattern, v "value" from (select doc_id, pattern, v, row_number() over (partition by doc_id order by length(pattern) desc, pattern) n from documents join p on contains(source, pattern)) where n = 1""")
def override_longest_match(spark, d):
    patterns = spark.createDataFrame(_PATTERNS, "pattern string, value string")
    return rank.longest_match(table(spark, d, "documents").select("doc_id", "source"), patterns, "source", "doc_id")


@query("select event_id, (props ->> 'k')::int k, (props ->> 'k')::int % 7 = 0 lucky from events")
def json_features(spark, d):
    p = F.from_json("props", "k int")
    return table(spark, d, "events").select("event_id", p["k"].alias("k"), (p["k"] % 7 == 0).alias("lucky"))


_LOCAL = "timezone('Europe/Copenhagen', timezone('UTC', ts))"


@query(f"select event_id, strftime({_LOCAL}, '%Y-%m-%d') \"day\" from events")
def date_label_local(spark, d):
    return events(spark, d).select(F.col("i").alias("event_id"), S.date_label(F.col("t")).alias("day"))


@query(f"select event_id, strftime({_LOCAL}, '%H:%M') clock from events")
def wall_clock_format(spark, d):
    return events(spark, d).select(F.col("i").alias("event_id"), S.wall_clock(F.col("t")).alias("clock"))


@query("select event_id, lpad(floor(value * 10 / 60)::int::varchar, 2, '0') || ':' || printf('%06.3f', value * 10 - 60 * floor(value * 10 / 60)) shown from events")
def format_time(spark, d):
    return table(spark, d, "events").select("event_id", S.format_time(F.col("value") * 10).alias("shown"))


@query("""with n as (select o_orderkey k, o_totalprice + 1 p, o_orderdate + interval 1 day v from orders where o_orderkey % 3 = 0), b as (select o_orderkey k, o_totalprice p, o_orderdate v from orders)
select k, p from (select *, row_number() over (partition by k order by v desc) q from (select * from n union all select * from b)) where q = 1""")
def upsert_newest_wins(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderdate").alias("v"))
    new = old.where("k % 3 = 0").select("k", (F.col("p") + 1).alias("p"), (F.col("v") + F.expr("interval 1 day")).alias("v"))
    return rank.upsert(old, new, ["k"], "v").select("k", "p")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def anti_new_sessions(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def semi_known(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


_WEIGHTS = {"size": 0.8, "quality": 1.1, "lang=en": -0.4, "lang=fr": 0.3, "missing:size": -2.0, "long": 0.2}
_FEATURED = f"{_LABELLED}, fe as (select *, case when n_chars < 100 then null else n_chars / 10000.0::double end size from la)"


def _featured(spark, d):
    x = _labelled(spark, d).withColumn("size", F.when(F.col("n_chars") >= 100, F.col("n_chars") / 10000)).withColumn("long", F.col("n_chars") > 5000)
    return x.withColumn("features", learn.feature_map(["size", "quality"], ["long"], ["lang"]))


@query(f"""with {_FEATURED}, e as (select doc_id, unnest([case when size is null then 'missing:size' else 'size' end, 'quality', case when n_chars > 5000 then 'long' end, 'lang=' || lang]) name,
unnest([coalesce(size, 1), quality, 1, 1]) x from fe) select doc_id, name, round(x, 6) x from e where name is not null""")
def feature_vector(spark, d):
    return _featured(spark, d).select("doc_id", F.explode("features").alias("name", "x")).withColumn("x", F.round("x", 6))


_SCORED = f"""{_FEATURED}, sc as (select *, 1 / (1 + exp(-(-0.7::double + coalesce(0.8 * size, -2.0) + 1.1 * quality + case lang when 'en' then -0.4 when 'fr' then 0.3 else 0 end + case when n_chars > 5000 then 0.2 else 0 end))) p from fe)"""


@query(f"with {_SCORED} select doc_id, round(p, 6) p from sc")
def model_score(spark, d):
    return _featured(spark, d).select("doc_id", F.round(learn.linear_score(F.col("features"), _WEIGHTS, -0.7), 6).alias("p"))


@query(f"""with {_SCORED}, s as (select lang, toxic y, round(p, 6) p from sc), c as (select a.lang, avg(case when a.p > b.p then 1.0::double when a.p = b.p then 0.5 else 0 end) x from s a join s b on a.lang = b.lang and a.y = 1 and b.y = 0 group by a.lang)
select lang, round(x, 6) auc, count(*) filter (y = 1) positives, count(*) filter (y = 0) negatives from s left join c using (lang) group by lang, x""")
def auc(spark, d):
    x = _featured(spark, d).withColumn("p", F.round(learn.linear_score(F.col("features"), _WEIGHTS, -0.7), 6))
    return learn.auc(x, "p", "toxic", ["lang"]).withColumn("auc", F.round("auc", 6))


@query(f"""with recursive {EV}, w as (select r, i, t s, t + 7200 + v * 60 e from ev), p as (select a.i a, b.i b from w a join w b on a.r = b.r and a.i < b.i
where least(a.e, b.e) - greatest(a.s, b.s) >= 0.3 * least(a.e - a.s, b.e - b.s)), u as (select a, b from p union select b, a from p), c as (select a n, a m from u union select c.n, u.b from c join u on c.m = u.a)
select n node, min(m) root from c group by n""")
def same_footage_components(spark, d):
    e = events(spark, d).withColumn("w", F.col("e") + 7200)
    return I.components(I.overlap_pairs(e, ["r"], "t", "w", "i", 0.3, share="shorter", width=4 * HOUR))


@query(f"""with recursive {EV}, e as (select r, i, t / 3600 s, t / 3600 + v / 60 e, v from ev), w0 as (select *, greatest(0, (s + e) / 2 - 10) lo, greatest((s + e) / 2 + 10, greatest(0, (s + e) / 2 - 10) + 1) hi from e),
w as (select r, i, v, lo + greatest(0, hi - lo - 24) / 2 lo, hi - greatest(0, hi - lo - 24) / 2 hi, row_number() over (partition by r order by v desc, s, i) n from w0),
o as (select w.r, w.n, w.lo, w.hi, list(e.i) m from w join e on e.r = w.r and e.e >= w.lo and e.s <= w.hi group by all),
x as (select r, n, [{{'lo': lo, 'hi': hi, 'm': m}}] spans from o where n = 1 union all
      select r, n, case when pl is not null then list_transform(spans, lambda q, j: case when j = pl then {{'lo': least(q.lo, lo), 'hi': greatest(q.hi, hi), 'm': list_distinct(list_concat(q.m, m))}} else q end)
                        when len(spans) < 12 then list_append(spans, {{'lo': lo, 'hi': hi, 'm': m}}) else spans end from (
        select o.r, o.n, o.lo, o.hi, o.m, x.spans, list_position(list_transform(x.spans, lambda q: greatest(o.lo, q.lo) - least(o.hi, q.hi) <= 8 and greatest(o.hi, q.hi) - least(o.lo, q.lo) <= 40), true) pl from x join o on o.r = x.r and o.n = x.n + 1)),
z as (select r, unnest(spans) q from x qualify n = max(n) over (partition by r))
select z.r, round(q.lo, 6) w_start, round(q.hi, 6) w_end, max(e.v) w_score, count(*) n_events from z join e on e.r = z.r and list_contains(q.m, e.i) group by z.r, q.lo, q.hi""")
def clip_windows_greedy(spark, d):
    e = events(spark, d).withColumns({"t": F.col("t") / HOUR, "e": F.col("e") / HOUR})
    found = moments.clip_windows(e, ["r"], "t", "e", "v", "i")
    return found.select("r", F.round("w_start", 6).alias("w_start"), F.round("w_end", 6).alias("w_end"), "w_score", "n_events")


@query(f"""with recursive {EV}, o as (select r, i, v, row_number() over (partition by r order by v desc, i) n from ev),
x as (select r, n, i, 0 bin, v used from o where n = 1 union all
      select o.r, o.n, o.i, case when x.used > 0 and x.used + o.v > 50 then x.bin + 1 else x.bin end, case when x.used > 0 and x.used + o.v > 50 then o.v else x.used + o.v end from x join o on o.r = x.r and o.n = x.n + 1)
select r, i, bin::int bin from x""")
def pack_next_fit(spark, d):
    return moments.pack_next_fit(events(spark, d), ["r"], "i", "v", "v")


@query(f"""with recursive {EV}, o as (select r, i, t s, t + 7200 + v * 60 e, row_number() over (partition by r order by v desc, i) n from ev),
x as (select r, n, i, true keeps, [{{'s': s, 'e': e}}] kept from o where n = 1 union all
      select r, n, i, keeps, case when keeps then list_append(kept, {{'s': s, 'e': e}}) else kept end from (
        select o.r, o.n, o.i, o.s, o.e, x.kept, len(list_filter(x.kept, lambda k: least(o.e, k.e) - greatest(o.s, k.s) > 0.5 * least(o.e - o.s, k.e - k.s))) = 0 keeps from x join o on o.r = x.r and o.n = x.n + 1))
select r, i from x where keeps""")
def dedupe_nms(spark, d):
    return moments.suppress(events(spark, d).withColumn("w", F.col("e") + 7200), ["r"], "i", "t", "w", "v")


@query(f"""with recursive {EV}, a as (select r, floor(t / 86400)::bigint k, y, max(v) v from ev group by all),
f as (select r, k, arg_min(y, (-v, y)) best, max(v) most, row_number() over (partition by r order by k) n from a group by r, k),
x as (select r, n, k, best "now" from f where n = 1 union all
      select f.r, f.n, f.k, case when h.v is null or h.v < 0.5 * f.most then f.best else x."now" end from x join f on f.r = x.r and f.n = x.n + 1 left join a h on h.r = f.r and h.k = f.k and h.y = x."now")
select r, k, "now" y from x""")
def hysteresis_focus(spark, d):
    e = events(spark, d).withColumn("k", F.floor(F.col("t") / DAY))
    return moments.focus(e.groupBy("r", "k", "y").agg(F.max("v").alias("v")), ["r"], "k", "y", "v")


@query(f"""with recursive {EV}, o as (select r, i, t / 3600 h, v x, row_number() over (partition by r order by t, i) n, count(*) over (partition by r) m from ev),
f as (select r, n, i, h, m, x from o where n = 1 union all select o.r, o.n, o.i, o.h, o.m, f.x + (1 - pow(2.718281828459045::double, -abs(o.h - f.h) / 24)) * (o.x - f.x) from f join o on o.r = f.r and o.n = f.n + 1),
b as (select r, n, i, h, x from f where n = m union all select f.r, f.n, f.i, f.h, b.x + (1 - pow(2.718281828459045::double, -abs(f.h - b.h) / 24)) * (f.x - b.x) from b join f on f.r = b.r and f.n = b.n - 1),
l as (select r, n, i, h, x from b where n = 1 union all select b.r, b.n, b.i, b.h, l.x + least(0.6 * (b.h - l.h), greatest(-0.6 * (b.h - l.h), b.x - l.x)) from l join b on b.r = l.r and b.n = l.n + 1)
select r, i, round(x, 6) smooth from l""")
def ema_rate_limit(spark, d):
    e = events(spark, d).withColumn("h", F.col("t") / HOUR)
    return moments.smooth_limited(e, ["r"], "h", "i", "v", tau=24.0, rate=0.6).withColumn("smooth", F.round("smooth", 6))


@query("select user_id r, round(value, 6) x, event_id i from events")
def klv_decode(spark, d):
    """Events' values written as big-endian records, one blob for each event, and read back."""
    pack = lambda key, kind, size, body: key.encode() + bytes([kind, size]) + (len(body) // size).to_bytes(2, "big") + body + b"\0" * (-len(body) % 4)

    def write(frames):
        for f in frames:
            f["blob"] = [pack("DEVC", 0, 1, pack("SCAL", ord("s"), 2, _struct.pack(">h", 2)) + pack("GPS5", ord("d"), 8, _struct.pack(">d", 2 * v))) for v in f["value"]]
            yield f[["event_id", "blob"]]

    e = table(spark, d, "events").select("event_id", "user_id", "value")
    blobs = e.select("event_id", "value").mapInPandas(write, "event_id long, blob binary")
    found = records.klv_rows(blobs, "event_id", "blob").where("key = 'GPS5'").select("event_id", F.round(F.get("numbers", F.lit(0)), 6).alias("x"))
    return found.join(e.select("event_id", "user_id"), "event_id").select(F.col("user_id").alias("r"), "x", F.col("event_id").alias("i"))


@query("""with c as (select user_id r, event_id i, ts, value, row_number() over (partition by user_id order by ts, event_id) - 1 n, min(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) z,
first_value(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) over (partition by user_id order by ts, event_id) f, hour(ts) * 3600 + minute(ts) * 60 + second(ts) s from events)
select r::varchar path, n ordinal, epoch(timestamp '2026-08-15') + s + case when s < f then 86400 else 0 end utc, round(value, 4) velocity from c""")
def vbo_parse(spark, d):
    """A VBO text for each user, made of the user's events by time of day, and read back."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    line = F.concat_ws(" ", F.date_format("ts", "HHmmss"), F.format_string("%.4f", "value"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("l")))), lambda x: x["l"]), "\n")
    head = "File created on 15/08/2026 at 09:00:00\n\n[column names]\ntime velocity\n\n[data]\n"
    files = e.groupBy("user_id").agg(F.concat(F.lit(head), body).alias("value")).select(F.col("user_id").cast("string").alias("path"), "value")
    return records.vbo_rows(files).select("path", F.col("ordinal").cast("long").alias("ordinal"), "utc", F.round(F.try_element_at("fields", F.lit("velocity")), 4).alias("velocity"))


_SESSIONS = """with e as (select user_id r, ts, value v, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 12 hour then 0 else 1 end c from events),
g as (select *, sum(c) over (partition by r order by ts rows unbounded preceding) k from e) select r, epoch(min(ts)) s, epoch(max(ts)) + 43200 e, count(*) n, max(v) best from g group by r, k"""


def _session_rows(x: DataFrame) -> DataFrame:
    return x.select("r", (F.unix_micros("start") / 1e6).alias("s"), (F.unix_micros("end") / 1e6).alias("e"), "n", "best")


def _stamped(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_id").alias("r"), F.timestamp_micros((S.epoch(F.col("ts")) * 1e6).cast("bigint")).alias("ts"), F.col("value").alias("v"))


@query(_SESSIONS)
def session_window_batch(spark, d):
    return _session_rows(streams.sessions(_stamped(table(spark, d, "events")), ["r"], "ts", "v"))


@query(_SESSIONS)
def stream_sessions(spark, d):
    """The same from a stream over the file, drained; complete mode gives open sessions too."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).format("parquet").load(f"{d}/events.parquet*")
    found = streams.drained(spark, streams.sessions(_stamped(stream), ["r"], "ts", "v"), f"sessions_{uuid.uuid4().hex}", "complete")
    return _session_rows(found)


@query(f"""with {EV}, a as (select r, i, t s, e from ev where y = 'click'), b as (select r, t, v from ev where y = 'view'),
m as (select a.i, median(v) x, count(*) n from a join b on a.r = b.r and b.t between a.s - 7200 and a.e + 7200 group by a.i),
n as (select i, v x from (select a.i, v, row_number() over (partition by a.i order by abs(b.t - (s + e) / 2), b.t, v) k from a join b on a.r = b.r) where k = 1)
select i, coalesce(case when m.n >= 2 then m.x else n.x end >= 15, true) moving from a left join m using (i) left join n using (i)""")
def event_is_moving(spark, d):
    e = events(spark, d)
    a = e.where("y = 'click'").select("r", "i", F.col("t").alias("s0"), F.col("e").alias("s1"))
    b = e.where("y = 'view'").select("r", F.col("t").alias("bt"), F.col("v").alias("bv"))
    return series.moving_or_nearest(a, b, ["r"], "s0", "s1", "bt", "bv", "i", 15, pad=7200, width=DAY / 4)


_BOXES = f"{EV}, bx as (select r recording_id, y track_id, t / 3600 t, 30.0::double x1, 30 + v x2, 20.0::double y1, 20 + v y2, 100 w, 100 h, i from ev)"


def _boxes(spark, d):
    """Boxes whose sides are an event's value, a track for each user and type, an hour for a second."""
    return events(spark, d).select(
        F.col("r").alias("recording_id"), F.col("y").alias("track_id"), (F.col("t") / HOUR).alias("t"), F.lit(30.0).alias("x1"), (30 + F.col("v")).alias("x2"), F.lit(20.0).alias("y1"), (20 + F.col("v")).alias("y2"),
        F.lit(100).alias("frame_w"), F.lit(100).alias("frame_h"), F.lit(3).alias("cls"),
    )


@query(f"""with {_BOXES}, g as (select recording_id, track_id, count(*) n, max(t) - min(t) s, avg(case when x1 <= 2 or x2 >= 98 or y2 >= 98 then 1.0::double else 0 end) e, stddev_pop((x1 + x2) / 200) dx, stddev_pop((y1 + y2) / 200) dy, stddev_pop(y2 - y1) hd, avg(y2 - y1) hm from bx group by all)
select recording_id, track_id from g where n >= 5 and s >= 2 and e >= 0.6 and dx < 0.04 and dy < 0.04 and hd < 0.1 * greatest(hm, 1e-6)""")
def ego_tracks(spark, d):
    """Boxes moved to the left edge and made of nearly one size."""
    return detect.ego_tracks(_boxes(spark, d).withColumns({"x1": F.lit(1.0), "x2": 21 + F.col("x2") / 100, "y2": 60 + F.col("y2") / 100}))


ORACLES["ego_tracks"] = ORACLES["ego_tracks"].replace("from bx group", "from (select * replace (1.0::double as x1, 21 + x2 / 100 as x2, 60 + y2 / 100 as y2) from bx) group")


@query(f"""with {_BOXES}, o as (select *, count(*) over k n, max(t) over k - min(t) over k s from bx where (y2 - y1) / h >= 0.05 window k as (partition by recording_id, track_id)),
p as (select *, (y2 - y1) / h >= 0.11 or (x2 - x1) * (y2 - y1) / (w * h) >= 0.01 near from o where n >= 4 and s >= 0.6),
q as (select *, row_number() over (partition by recording_id, track_id order by t) - row_number() over (partition by recording_id, track_id, near order by t) run from p),
a as (select recording_id, track_id, 'nearby_rider' "type", min(t) t_start, max(t) t_end, max((y2 - y1) / h) score from q where near group by recording_id, track_id, run having max(t) - min(t) >= 0.3),
l as (select *, regr_slope(ln(greatest((x2 - x1) * (y2 - y1), 1)), t) over f sl, min(t) over f t0, row_number() over (partition by recording_id, track_id order by t) m from p window f as (partition by recording_id, track_id order by t rows between 7 preceding and current row)),
b as (select recording_id, track_id, case when sl >= 0.32 then 'approaching_rider' else 'receding_rider' end "type", t0 t_start, t t_end, abs(sl) score from l where (m >= 8 or m = n) and t - t0 >= 0.25 and abs(sl) >= 0.32)
select recording_id, track_id, "type", round(t_start, 6) t_start, round(t_end, 6) t_end, round(score, 6) score from (select * from a union all select * from b)""")
def rider_events(spark, d):
    found = detect.rider_events(_boxes(spark, d))
    return found.select("recording_id", "track_id", "type", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), F.round("score", 6).alias("score"))


_CAMS = f"""{EV}, ca as (select r "day", i ordinal, case when i % 2 = 0 then 'front' else 'rear' end facing, case y when 'click' then 'approaching_rider' when 'view' then 'receding_rider' when 'purchase' then 'own_off_track' else 'rider_pass' end "type", t / 3600 s, t / 3600 + v / 10 e, v score from ev)"""


def _cameras(spark, d):
    kind = F.when(F.col("y") == "click", "approaching_rider").when(F.col("y") == "view", "receding_rider").when(F.col("y") == "purchase", "own_off_track").otherwise("rider_pass")
    facing = F.when(F.col("i") % 2 == 0, "front").otherwise("rear")
    return events(spark, d).select(
        F.col("r").alias("day"), F.col("i").alias("ordinal"), facing.alias("recording_id"), facing.alias("facing"), kind.alias("type"), (F.col("t") / HOUR).alias("t_start"), (F.col("t") / HOUR + F.col("v") / 10).alias("t_end"), F.lit(0.0).alias("utc_offset"), F.col("v").alias("score")
    )


@query(f"""with {_CAMS}, h as (select a."day", case when a.facing = 'front' then 'overtake' else 'overtaken' end theme, a.ordinal x, b.ordinal z, a.s, a.e, b.s bs, a.score + b.score score, row_number() over (partition by a.ordinal order by abs(b.s - a.e), b.ordinal) k
from ca a join ca b on a."day" = b."day" and a."type" = 'approaching_rider' and b."type" = 'receding_rider' and a.facing <> b.facing and b.s between a.e - 1.5 and a.e + 5),
u as (select * from h where k = 1), us as (select x o from u union select z from u),
f as (select *, case when facing = 'front' and "type" = 'approaching_rider' and e - s >= 1.5 then 'catching_up' when "type" = 'rider_pass' then 'duel' when "type" = 'own_off_track' then 'own_off_track' else 'action' end theme from ca where ordinal not in (select o from us)),
g as (select *, case theme when 'catching_up' then s - 1 when 'duel' then s - 2 when 'own_off_track' then s - 5 else (s + e) / 2 - 3 end lo, case theme when 'catching_up' then e + 1 when 'duel' then e + 2 when 'own_off_track' then e + 3 else (s + e) / 2 + 3 end hi from f)
select "day", theme, round(greatest(s - 1, e + 0.5 - 7), 6) utc_start, round(bs + 3, 6) utc_end, round(score, 6) score, x "first" from u
union all select "day", theme, round(case when theme = 'own_off_track' then lo else greatest(lo, hi - 7) end, 6), round(hi, 6), round(score * case theme when 'catching_up' then e - s when 'own_off_track' then 4 else 1 end, 6), ordinal from g""")
def themed_moments(spark, d):
    found = detect.themed_moments(_cameras(spark, d))
    return found.select("day", "theme", F.round("utc_start", 6).alias("utc_start"), F.round("utc_end", 6).alias("utc_end"), F.round("score", 6).alias("score"), F.get("ordinals", F.lit(0)).alias("first"))


_KEPT = ORACLES["themed_moments"].split('select "day", theme, round(')[0].replace("with ", "with recursive ", 1).rstrip() + """,
th as (select "day", theme, greatest(s - 1, e + 0.5 - 7) a, bs + 3 b, score, x id, (e + 0.5 - greatest(s - 1, e + 0.5 - 7)) + ((bs + 3) - (bs - 0.3)) secs from u
       union all select "day", theme, case when theme = 'own_off_track' then lo else greatest(lo, hi - 7) end, hi, score * case theme when 'catching_up' then e - s when 'own_off_track' then 4 else 1 end, ordinal, hi - case when theme = 'own_off_track' then lo else greatest(lo, hi - 7) end from g),
od as (select *, row_number() over (partition by "day" order by case theme when 'action' then 99 else list_position(['overtake', 'overtaken', 'catching_up', 'duel', 'own_off_track'], theme) end, score desc, id) n from th),
xs as (select "day", n, id, true keeps, [{'t': theme, 's': a, 'e': b}] kept from od where n = 1 union all
       select "day", n, id, keeps, case when keeps then list_append(kept, {'t': theme, 's': a, 'e': b}) else kept end from (
         select o."day", o.n, o.id, o.theme, o.a, o.b, x.kept, len(list_filter(x.kept, lambda k: (k.t = o.theme or o.theme = 'action') and least(o.b, k.e) - greatest(o.a, k.s) > 0.5 * least(o.b - o.a, k.e - k.s))) = 0 keeps from xs x join od o on o."day" = x."day" and o.n = x.n + 1)),
km as (select od.* from od join xs on od."day" = xs."day" and od.n = xs.n where keeps)"""


def _deduped(spark, d):
    m = detect.themed_moments(_cameras(spark, d)).withColumn("id", F.get("ordinals", F.lit(0)))
    return moments.suppress(m, ["day"], "id", "utc_start", "utc_end", "score", theme="theme", ranks=detect.THEMES, carried=["theme", "score"])


@query(_KEPT + ' select "day", theme, id, round(score, 6) score from km')
def dedupe_themes(spark, d):
    return _deduped(spark, d).select("day", "theme", "id", F.round("score", 6).alias("score"))


@query(_KEPT + """, ml as (select "day", 'action' series, id, secs, a, row_number() over (partition by "day" order by score desc, id) n from km
union all select "day", theme, id, secs, a, row_number() over (partition by "day", theme order by a, id) from km where theme <> 'action' qualify count(*) over (partition by "day", theme) >= case theme when 'own_off_track' then 1 else 2 end),
pk as (select "day", series, n, id, a, 0 bin, secs used from ml where n = 1 union all
       select m."day", m.series, m.n, m.id, m.a, case when p.used > 0 and p.used + m.secs > 50 then p.bin + 1 else p.bin end, case when p.used > 0 and p.used + m.secs > 50 then m.secs else p.used + m.secs end from pk p join ml m on m."day" = p."day" and m.series = p.series and m.n = p.n + 1)
select "day", series, bin::int bin, id, row_number() over (partition by "day", series, bin order by a, id)::int place from pk""")
def plan_shorts(spark, d):
    """Deduped moments of a user's day as series of shorts."""
    m = detect.themed_moments(_cameras(spark, d)).withColumns({"id": F.get("ordinals", F.lit(0)), "seconds": F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["t_end"] - x["t_start"])})
    kept = moments.suppress(m, ["day"], "id", "utc_start", "utc_end", "score", theme="theme", ranks=detect.THEMES, carried=["theme", "utc_start", "seconds", "score"])
    return moments.plan_shorts(kept, ["day"], "id", "theme", "utc_start", "seconds", "score")


@query()
def corners(spark, d):
    """A customer's orders as a ride: prices as speed, price changes as acceleration and lean; laps end with orders of status F."""
    o = orders(spark, d)
    w = Window.partitionBy("c").orderBy("o", "k")
    ride = o.withColumns({"a": F.coalesce(F.col("p") - F.lag("p").over(w), F.lit(0.0)) / 1e4, "tilt": F.col("p") / 1e4})
    numbered = L.lap_numbers(ride, ["c"], "o", "k", F.col("st") == "F").withColumn("lap", F.floor(F.col("lap") / 4))
    return L.corners(numbered, ["c"], "lap", "o", "p", "a", "tilt", F.lit(True))


def _pieces(spark, d):
    """A purchase and the two hours before it as two pieces of a moment."""
    e = events(spark, d).where("y = 'purchase'")
    piece = lambda a, b: F.struct(F.col("r").alias("recording_id"), a.alias("t_start"), b.alias("t_end"))
    return cascade.pieces(e.select("i", F.array(piece(F.col("t") - 3 * HOUR, F.col("t") - HOUR), piece(F.col("t"), F.col("t") + 6 * HOUR)).alias("segments")), [], "i")


_PIECES = f"{EV}, pc as (select r, i, 0 piece, t - 10800 a, t - 3600 b from ev where y = 'purchase' union all select r, i, 1, t, t + 21600 from ev where y = 'purchase')"


def _samples(spark, d):
    return events(spark, d).where("y <> 'purchase'").select(F.col("r").alias("recording_id"), F.col("t").alias("at"), F.col("v").alias("x"))


@query(f"""with {_PIECES}, m as (select pc.i, piece, b - a s, avg(v) x from pc join ev on pc.r = ev.r and ev.y <> 'purchase' and ev.t between a and b group by all) select i, round(sum(x * s) / sum(s), 6) mean from m group by i""")
def weighted_segment_mean(spark, d):
    return cascade.weighted_mean(_pieces(spark, d), _samples(spark, d), "i", "at", "x", width=4 * HOUR).withColumn("mean", F.round("mean", 6))


@query(f"""with {_PIECES} select pc.i, round(median(v), 6) median from pc join ev on pc.r = ev.r and ev.y <> 'purchase' and ev.t between a and b group by pc.i""")
def pooled_segment_median(spark, d):
    return cascade.pooled_median(_pieces(spark, d), _samples(spark, d), "i", "at", "x", width=4 * HOUR).withColumn("median", F.round("median", 6))


@query(f"""with {EV}, x as (select i, case when i % 5 <> 0 then v * 3 end speed, case when i % 3 = 0 then v / 40 end riding, case when i % 4 <> 0 then v end motion, i % 2 riders, i % 7 = 0 gps, v / 50 vehicles, (i % 11) / 100.0 kerb, i % 13 = 0 lamp from ev),
p as (select *, case when riding is not null and not gps then case when riding >= 0.5 then 'track' when motion < 2.5 then 'stopped' else 'slow' end when speed is not null then case when speed < 15 then 'stopped' when speed < 40 then 'slow' else 'track' end
when motion < 2.5 then 'stopped' when motion >= 8 and riders >= 1 then 'track' else 'slow' end pace from x)
select i, pace, case when vehicles >= 0.5 then 'car in view' when riders = 0 and kerb < 0.04 then 'no rider or kerb in view' when lamp then 'red signal lamp (session over)' when pace = 'stopped' then 'standing still' when pace = 'slow' then 'below 40 km/h' end drop_reason from p""")
def drop_reasons(spark, d):
    """Pace and reason to leave out, of events whose values stand for speed, riding, motion and shares."""
    i, v = F.col("i"), F.col("v")
    x = events(spark, d).select("i", F.when(i % 5 != 0, v * 3).alias("speed"), F.when(i % 3 == 0, v / 40).alias("riding"), F.when(i % 4 != 0, v).alias("motion"), (i % 2).alias("riders"), (i % 7 == 0).alias("gps"), (v / 50).alias("vehicles"), ((i % 11) / 100).alias("kerb"), (i % 13 == 0).alias("lamp"))
    x = x.withColumn("pace", cascade.pace(F.col("gps"), F.col("speed"), F.col("riding"), F.col("motion"), F.col("riders")))
    reason = cascade.drop_reason(F.col("vehicles"), F.col("riders"), F.col("kerb"), F.col("lamp"), F.col("pace"))
    return cascade.with_reason(x.withColumn("why", F.array().cast("array<string>")), reason).select("i", "pace", "drop_reason")


@query(f"""with {EV}, w as (select r, i, t s, t + 7200 + v * 60 e, i % 3 - 1 vote from ev), o as (select a.i, b.vote, b.i inherited_from, row_number() over (partition by a.i order by (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) desc, b.i) n
from w a join w b on a.r = b.r and a.i % 3 = 1 and b.i % 3 <> 1 and least(a.e, b.e) > greatest(a.s, b.s) and (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) >= 0.5) select i, vote, inherited_from from o where n = 1""")
def inherited_votes(spark, d):
    e = events(spark, d).withColumn("w", F.col("e") + 7200)
    votes = e.where("i % 3 <> 1").select("i", (F.col("i") % 3 - 1).alias("vote"))
    return cascade.inherited_votes(e.select("r", "i", "t", "w"), votes, ["r"], "i", "t", "w", "vote", width=4 * HOUR)


@query("""with n as (select o_orderkey k, o_totalprice + 1 p, o_custkey c from orders where o_custkey % 5 = 0 and o_orderkey % 2 = 0), b as (select o_orderkey k, o_totalprice p, o_custkey c from orders)
select k, p, c from b where c not in (select c from n) union all select k, p, c from n""")
def replace_by_key(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_custkey").alias("c"))
    return cascade.replace_by_key(old, old.where("c % 5 = 0 AND k % 2 = 0").withColumn("p", F.col("p") + 1), ["c"])


@query(f"with {EV}, n as (select *, lead(t) over (partition by r, y order by t) x from ev) select i from n where x is null or x - t > 30000 / greatest(v, 1)")
def finish_passes(spark, d):
    return cascade.finish_passes(events(spark, d), ["r", "y"], "t", F.col("v"), 30000.0).select("i")


@query(f"with {EV}, l as (select i, v, coalesce(lag(v) over w, v) a, coalesce(lead(v) over w, v) b from ev window w as (partition by r order by t, i)) select i, list_sort([v, a, b])[2] m from l")
def median_of_three(spark, d):
    return events(spark, d).select("i", cascade.median_of_three(["r"], "t", "i", "v").alias("m"))


@query(f"with {EV}, n as (select r, y, count(*) n, min(i) f from ev group by r, y) select r, y, n from (select *, row_number() over (partition by r order by n desc, f, y) k from n) where k = 1")
def first_mode(spark, d):
    return cascade.first_mode(events(spark, d), ["r"], "y", "i")


@query(f"with {EV}, g as (select r, count(*) filter (v > 25) u, count(*) filter (v < 15) d from ev group by r) select r, u + d votes, case when u + d >= 5 and u >= 0.62 * (u + d) then 'positive' when u + d >= 5 and d >= 0.62 * (u + d) then 'negative' end side from g")
def facing_majority(spark, d):
    return cascade.majority(events(spark, d).withColumn("f", F.col("v") - 20), ["r"], "f", 5.0, 5)


@query(f"with {EV}, g as (select r, floor(t / 86400)::bigint \"second\", max(v) filter (y = 'click') riders, max(v) filter (y = 'view') kerbs from ev where y in ('click', 'view') group by all) select r, \"second\", coalesce(riders, 0) riders, coalesce(kerbs, 0) kerbs from g")
def per_second_side_by_side(spark, d):
    most = lambda y: events(spark, d).where(F.col("y") == y).groupBy("r", F.floor(F.col("t") / DAY).alias("second")).agg(F.max("v").alias("value"))
    return cascade.per_second(["r"], riders=most("click"), kerbs=most("view"))


_FLAG = f"""with {EV}, m as (select *, max(e) over (partition by r, y order by t, i rows between unbounded preceding and 1 preceding) pm from ev),
g as (select *, sum(case when t > pm + 3600 then 1 else 0 end) over (partition by r, y order by t, i rows unbounded preceding) k from m),
s as (select r, y, min(t) t, max(e) e, max(v) v, min(i) i from g group by r, y, k),
j as (select a.r, a.i, a.v, count(b.i) n from s a left join s b on a.r = b.r and b.y = 'view' and b.t between a.e - 5400 and a.e + 18000 where a.y = 'click' group by a.r, a.i, a.v)
select r, i, round(v, 6) v, n, place from (select *, row_number() over (partition by r order by v desc, i) place from j) where place <= 3"""


@query(_FLAG)
def flagship_top_moments(spark, d):
    """Islands of each type; how many views come near each click island's end; the best three of each user."""
    e = events(spark, d)
    s = I.islands(e, ["r", "y"], "t", "e", "i", HOUR).groupBy("r", "y", "island").agg(F.min("t").alias("t"), F.max("e").alias("e"), F.max("v").alias("v"), F.min("i").alias("i"))
    a = s.where("y = 'click'").select("r", "i", "v", F.col("e").alias("ae"))
    b = s.where("y = 'view'").select("r", F.col("t").alias("bt"))
    near = I.in_range(a.select("r", "i", "ae"), b, ["r"], F.col("ae") - 5400, F.col("ae") + 18000, F.col("bt"), 6 * HOUR).groupBy("i").agg(F.count("*").alias("n"))
    w = Window.partitionBy("r").orderBy(F.desc("v"), "i")
    return a.join(near, "i", "left").select("r", "i", F.round("v", 6).alias("v"), F.coalesce("n", F.lit(0)).alias("n"), F.row_number().over(w).alias("place")).where("place <= 3")


from . import day as _day  # noqa: E402, F401  their queries register themselves
from . import moments_day as _moments_day  # noqa: E402, F401
from . import shorts_day as _shorts_day  # noqa: E402, F401
