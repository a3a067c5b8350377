"""Queries of a day's alignment, telemetry and incidents on the driver's tables: a user is a recording, an event a sample, a clip or a clock."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, detect, incidents, linking, mount, telemetry, votes
from ..operators import intervals as I
from ..operators.common import checkpoint_folder
from ..sources import records, tail
from ..streaming import sessions as streams
from .queries import DAY, EV, HOUR, _DAILY, _HOURLY, _hourly, events, query, table

_CLOCKS = f"""{EV}, k as (select r, i, t, t + 43200 + v * 60 w, case when i % 11 = 0 then (i % 7) / 2.0::double end lg, i % 5 fx from ev),
m as (select *, max(w) over (partition by r order by t, i rows between unbounded preceding and 1 preceding) pm from k),
o as (select *, sum(case when t >= pm then 1 else 0 end) over (partition by r order by t, i rows unbounded preceding)::bigint outing from m),
f as (select *, first_value(i) over (partition by r, outing order by lg is null, fx desc, w - t desc, i) reference from o)"""


@query(f"""with recursive {_CLOCKS}, l1 as (select a.i a, b.i b, ((a.i * 31 + b.i * 17) % 41 - 20) / 10.0::double shift from k a join k b on a.r = b.r and a.i < b.i where least(a.w, b.w) - greatest(a.t, b.t) >= 3600 and (a.i * 7 + b.i) % 3 <> 0),
l as (select a, b, shift from l1 union all select b, a, -shift from l1),
u as (select i, 0 hop from f where lg is not null or i = reference union select l.b, u.hop + 1 from u join l on u.i = l.a where u.hop < 40),
h as (select i, min(hop) hop from u group by i),
p as (select h.i, h.hop, min(l.a) parent from h join l on l.b = h.i join h g on g.i = l.a and g.hop = h.hop - 1 group by h.i, h.hop),
x as (select f.i, 0 hop, coalesce(lg, 0) off, f.i::varchar path from f join h on f.i = h.i and h.hop = 0
      union all select p.i, p.hop, x.off + l.shift, x.path || '>' || p.i from x join p on p.parent = x.i join l on l.a = x.i and l.b = p.i)
select f.r, f.i, outing, reference, round(coalesce(off, 0), 6) "offset", case when lg is not null then 'log' when f.i = reference then 'reference' when x.i is not null then 'pairs' else 'clock' end source, coalesce(path, f.i::varchar) path
from f left join x on f.i = x.i""")
def align_outings(spark, d):
    """Events as cameras' clocks of half a day and more; pairs that overlap for an hour have a measured shift, but for every third."""
    e = events(spark, d)
    i = F.col("i")
    k = e.select("r", "i", "t", (F.col("t") + 43200 + F.col("v") * 60).alias("w"), F.when(i % 11 == 0, (i % 7) / 2).alias("lg"), (i % 5).alias("fx"))
    pairs = I.overlap_pairs(k, ["r"], "t", "w", "i", 3600, share="seconds", width=DAY / 2).where("(a * 7 + b) % 3 <> 0")
    measured = pairs.select("a", "b", ((F.expr("(a * 31 + b * 17) % 41") - 20) / 10).alias("shift"))
    found = align.align(k, measured, ["r"], "i", "t", "w", "fx", "lg", least_overlap=3600, width=DAY / 2)
    return found.select("r", "i", "outing", "reference", F.round("offset", 6).alias("offset"), "source", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


_LANDMARKS = f"""{EV}, ps as (select distinct r, t from ev where y = 'click'), sp as (select r, min(t) p0, max(t) p1, count(*) passes from ps group by r),
mk as (select distinct ev.r, ev.t from ev join sp on ev.r = sp.r where y = 'view' and ev.t >= p0 - 14401 and ev.t <= p1 + 14401),
st as (select distinct ps.r, ps.t f, mk.t g, mk.t - ps.t s from ps join mk on ps.r = mk.r and abs(mk.t - ps.t) <= 14400),
ne as (select st.r, f, g, s, q.t pt, min(abs(q.t + s - mk.t)) d, arg_min(mk.t, (abs(q.t + s - mk.t), mk.t)) u from st join ps q on q.r = st.r join mk on mk.r = st.r and abs(q.t + s - mk.t) <= 600 group by all),
go as (select r, f, g, s, count(*) n, round(avg(d), 6) err, median(u - pt) mid, list(u - pt) off from ne group by all),
ra as (select *, row_number() over (partition by r order by n desc, err, f, g) k, first_value(s) over (partition by r order by n desc, err, f, g) best from go),
ri as (select r, coalesce(max(n) filter (abs(s - best) > 3600), 0) rival from ra group by r),
lm as (select ra.r, n, passes, rival, mid found, round(list_max(list_transform(off, lambda x: abs(x - mid))), 3) spread,
       case when n < 2 then ' (need 2)' when rival >= 2 and n < rival + 1 then ' (ambiguous)' end why from ra join ri on ra.r = ri.r join sp on sp.r = ra.r where k = 1)"""


def _matched(spark, d):
    e = events(spark, d)
    marks = e.where("y = 'view'").select("r", F.col("t").alias("m"))
    return align.landmark_match(e.where("y = 'click'").select("r", "t"), marks, e.select("r", F.lit(0.0).alias("g")), ["r"], "t", "m", "g", search=4 * HOUR, tol=600.0, rival_s=HOUR)


@query(f'''with {_LANDMARKS} select r, case when why is null then round(found, 3) end "start", n, passes, rival, spread from lm''')
def landmark_match(spark, d):
    """Clicks laid on views: residuals, the runner-up, the median of the pairs."""
    return _matched(spark, d).select("r", F.round("start", 3).alias("start"), "n", "passes", "rival", F.round("spread", 3).alias("spread"))


@query(f"""with {_LANDMARKS}, re as (select distinct r from ev), gp as (select r, min(t) s, count(*) n from ev where y = 'purchase' and v >= 25 group by r), mo as (select r, arg_min(t, (-v, t)) s from ev where v >= 30 and y <> 'purchase' group by r)
select re.r, case when gp.n >= 6 then 'gps' when re.r % 3 <> 0 and lm.found is not null and why is null then 'bridge' when mo.s is not null then 'motion' else 'clock' end source,
       round(case when gp.n >= 6 then gp.s when re.r % 3 <> 0 and lm.found is not null and why is null then found else mo.s end, 3) "start",
       case when gp.n >= 6 then '' else 'gps: ' || case when gp.n is not null then gp.n || ' fixes' else 'nothing found' end
         || case when re.r % 3 = 0 or (lm.found is not null and why is null) then '' else '; bridge: ' || case when lm.found is null then 'nothing found' else printf('%d of %d', lm.n, passes) || why end end
         || case when (re.r % 3 <> 0 and lm.found is not null and why is null) or mo.s is not null then '' else '; motion: nothing found' end end refused
from re left join gp on re.r = gp.r left join lm on lm.r = re.r left join mo on mo.r = re.r""")
def placements(spark, d):
    """How each user's start is known: enough purchases, else clicks on views (not asked for every third user), else the highest value, else its clock."""
    e = events(spark, d)
    gps = e.where("y = 'purchase' AND v >= 25").groupBy("r").agg(F.min("t").alias("s"), F.count("*").alias("n")).select("r", F.when(F.col("n") >= 6, F.col("s")).alias("start"), F.format_string("%d fixes", "n").alias("reason"))
    short = F.regexp_replace(F.regexp_replace("reason", " landmark passes", ""), r", spread [^(]* \(|, spread .*$", " (")
    bridge = _matched(spark, d).select("r", "start", F.regexp_replace(short, r" \($", "").alias("reason"))
    motion = e.where("v >= 30 AND y <> 'purchase'").groupBy("r").agg(F.min(F.struct(-F.col("v"), "t"))["t"].alias("start")).withColumn("reason", F.lit("peak"))
    found = align.placed(e.select("r").distinct(), "r", [("gps", gps, None), ("bridge", bridge, F.col("r") % 3 != 0), ("motion", motion, None)])
    return found.select("r", "source", F.round("start", 3).alias("start"), F.array_join("refused", "; ").alias("refused"))


@query(f"""with {_HOURLY}, l as (select unnest(range(-6, 7)) lag) select lag::int lag, round(corr(a.v, b.v), 6) r, count(*) n
from l, ho a, ho b where a.y = 'click' and b.y = 'view' and a.k = b.k + lag group by lag""")
def lag_correlation_blocks(spark, d):
    """Hourly sums of two types, correlated in blocks of 256 hours."""
    return align.lag_correlation_blocks(_hourly(spark, d, "click", "va"), _hourly(spark, d, "view", "vb"), [], "k", "va", "vb", 6, block=256).withColumn("r", F.round("r", 6))


@query(f"""with {_DAILY}, l as (select unnest(range(-5, 6)) lag), c as (select a.r, lag, round(corr(a.v, b.v), 6) x, count(*) n from l, da a join da b on a.r = b.r where a.y = 'click' and b.y = 'view' and a.k = b.k + lag group by a.r, lag),
g as (select r, lag, x, first_value(lag) over (partition by r order by x desc, lag) best from c where n >= 4 and x is not null and not isnan(x))
select r, best::int lag, max(x) peak, coalesce(max(x) filter (abs(lag - best) > 1), 0) runner_up, max(x) >= 0.3 and max(x) >= 1.2 * greatest(coalesce(max(x) filter (abs(lag - best) > 1), 0), 1e-6) accepted from g group by r, best""")
def best_lags(spark, d):
    """The lag in days at which a user's clicks and views agree best, and the best of the others."""
    e = events(spark, d).withColumn("k", F.floor(F.col("t") / DAY)).groupBy("r", "y", "k").agg(F.max("v").alias("v"))
    a, b = e.where("y = 'click'").select("r", "k", F.col("v").alias("va")), e.where("y = 'view'").select("r", "k", F.col("v").alias("vb"))
    c = align.lag_correlation_blocks(a.withColumnRenamed("r", "u"), b.withColumnRenamed("r", "u"), ["u"], "k", "va", "vb", 5).where("n >= 4").withColumn("r", F.round("r", 6))
    return align.best_lag(c, ["u"], 1).withColumnRenamed("u", "r")


@query(f"""with {EV}, n as (select r, v, row_number() over (partition by r order by t, i) - 1 n from ev), s as (select r, n // 4 k, ln(sqrt(avg(v * v)) + 1e-4) l, count(*) c from n group by all),
w as (select *, count(*) over (partition by r) m from s where c = 4) select r, k, round(l - sum(l) over (partition by r order by k rows between 2 preceding and 1 following) / 4, 6) level from w where m >= 8""")
def envelopes(spark, d):
    """A user's values as sound: sixteen samples a second, four steps a second."""
    w = Window.partitionBy("r").orderBy("t", "i")
    e = events(spark, d).select("r", "v", (F.row_number().over(w) - 1).alias("n"))
    return align.envelope(e, ["r"], "n", "v", rate=16, hz=4, least=2).withColumn("level", F.round("level", 6))


_TRACK = f"{EV}, tr as (select r, i, t / 86400 t, 56 + v / 1000 lat, 10 + (i % 97) / 1000.0::double lon, v * 2 kmh from ev)"


def _track(spark, d):
    i, v = F.col("i"), F.col("v")
    return events(spark, d).select("r", "i", (F.col("t") / DAY).alias("t"), (56 + v / 1000).alias("lat"), (10 + (i % 97) / 1000).alias("lon"), (v * 2).alias("kmh"))


def _sql_gradient(x: str, t: str = "t") -> str:
    b, a = f"({t} - lag({t}) over w)", f"(lead({t}) over w - {t})"
    back, ahead = f"({x} - lag({x}) over w) / nullif({b}, 0)", f"(lead({x}) over w - {x}) / nullif({a}, 0)"
    return f"case when {b} is null then {ahead} when {a} is null then {back} else ({back} * {a} + {ahead} * {b}) / nullif({a} + {b}, 0) end"


@query(f"""with {_TRACK}, q as (select distinct on (r, t) * from tr order by r, t, i), g as (select *, row_number() over (partition by r order by t) n, count(*) over (partition by r) many, max(t) over (partition by r) - min(t) over (partition by r) span,
median(lat) over (partition by r) la, median(lon) over (partition by r) lo from q),
k as (select *, greatest(1, round_even(3 * many / nullif(span, 0), 0))::bigint k, (lat - la) * 111320 no, (lon - lo) * 111320 * cos(radians(la)) ea from g),
s as (select *, avg(no) over f sn, avg(ea) over f se from k window f as (partition by r order by n rows between k // 2 preceding and k - 1 - k // 2 following)),
h as (select *, atan2({_sql_gradient('se')}, {_sql_gradient('sn')}) h from s window w as (partition by r order by n)),
d as (select *, h - lag(h) over (partition by r order by n) d from h),
u as (select *, sum(coalesce(d - 2 * pi() * floor((d + pi()) / (2 * pi())), 0)) over (partition by r order by n rows unbounded preceding) u from d),
y as (select *, case when kmh < 15 then 0 else degrees({_sql_gradient('u')}) end y from u window w as (partition by r order by n))
select i, case when many < 3 or span <= 0 then 0 else round(avg(y) over (partition by r order by n rows between k // 2 preceding and k - 1 - k // 2 following), 4) end yaw from y""")
def yaw_rates(spark, d):
    """Turn rates of users' tracks, days for seconds, means over three days."""
    return telemetry.yaw_rates(_track(spark, d), ["r"], "t", "i", "lat", "lon", "kmh", smooth=3.0).select("i", F.round("yaw", 4).alias("yaw"))


@query(f"""with {EV}, p as (select r, i, t / 43200 s, 1 + i % 5 n, row_number() over (partition by r order by t, i) o from ev where i % 9 <> 0),
g as (select *, lead(s) over (partition by r order by o) - s gap from p), x as (select *, unnest(range(n)) j from g)
select r, i, j::int place, round(s + j * case when gap > 0 and gap <= 3 then gap else 1.0::double end / n, 6) utc from x""")
def packet_times(spark, d):
    """Events as packets of one to five samples, half days for seconds; every ninth has no stamp."""
    e = events(spark, d)
    i = F.col("i")
    w = Window.partitionBy("r").orderBy("t", "i")
    points = F.transform(F.sequence(F.lit(0), (i % 5).cast("int")), lambda j: F.struct(i.alias("i"), j.alias("j")))
    packets = e.select("r", F.row_number().over(w).alias("o"), F.when(i % 9 != 0, F.col("t") / (12 * HOUR)).alias("s"), points.alias("points"))
    return telemetry.spread(packets, ["r"], "o", "s", "points").select("r", F.col("point.i").alias("i"), "place", F.round("utc", 6).alias("utc"))


@query(f"""with {EV}, p as (select r, case when y = 'purchase' then t end s, row_number() over (partition by r order by t, i) o, count(*) over (partition by r) many, max(t) over (partition by r) - min(t) over (partition by r) du from ev)
select r, round(min(s) - (arg_min(o, o) filter (s is not null) - 1) * case when any_value(du) > 0 and any_value(many) > 1 then any_value(du) / any_value(many) else 1 end, 3) start_utc from p group by r having count(s) > 0""")
def stamps_carried_back(spark, d):
    """Only purchases have a stamp; a user's first one is carried back to the user's first event."""
    e = events(spark, d)
    w = Window.partitionBy("r").orderBy("t", "i")
    packets = e.select("r", F.row_number().over(w).alias("o"), F.when(F.col("y") == "purchase", F.col("t")).alias("s"))
    spans = e.groupBy("r").agg((F.max("t") - F.min("t")).alias("duration"))
    return telemetry.start_by_stamps(packets, ["r"], "o", "s", spans).select("r", F.round("start_utc", 3).alias("start_utc"))


@query(f"""with {_TRACK}, q as (select distinct on (r, t) r, t, lat, lon from tr order by r, t, lat, lon), m as (select *, median(lat) over (partition by r) y0 from q),
s as (select r, t, sqrt(((lat - lag(lat) over w) * 111320) ** 2 + ((lon - lag(lon) over w) * 111320 * cos(radians(y0))) ** 2) d from m window w as (partition by r order by t)),
y as (select r, t, sum(coalesce(d, 0)) over (partition by r order by t rows unbounded preceding) way from s), e as (select r, max(way) fin from y group by r),
c as (select r, i, t / 86400 t from ev where y = 'purchase'),
b as (select c.r, c.i, c.t, y.t t0, y.way w0 from c asof left join y on c.r = y.r and c.t >= y.t), a as (select c.i, y.t t1, y.way w1 from c asof left join y on c.r = y.r and c.t <= y.t),
g as (select b.r, b.i, w0 + coalesce((b.t - t0) / nullif(t1 - t0, 0), 0) * (w1 - w0) + 5000 way from b join a using (i)), h as (select g.* from g join e on g.r = e.r where way <= fin),
p as (select h.r, h.i, h.way, y.t t0, y.way w0 from h asof left join y on h.r = y.r and h.way >= y.way), n as (select h.i, y.t t1, y.way w1 from h asof left join y on h.r = y.r and h.way <= y.way)
select i, round(t0 + coalesce((way - w0) / nullif(w1 - w0, 0), 0) * (t1 - t0), 6) utc from p join n using (i)""")
def along_track(spark, d):
    """When a user's track is five kilometres further than at each purchase."""
    crossings = events(spark, d).where("y = 'purchase'").select("r", "i", (F.col("t") / DAY).alias("c"))
    return telemetry.along_track(_track(spark, d), crossings, ["r"], "t", "lat", "lon", "c", "i", 5000.0).select("i", F.round("utc", 6).alias("utc"))


_SHAPES = f"""{EV}, sh as (select r recording_id, y track_id, i, t / 3600 t, 30.0::double x1, 30 + case when i % 4 < 2 then v else 3 * v end x2, 20.0::double y1, 20 + case when i % 4 < 2 then 2 * v else v / 2 end y2, 3 cls, (i % 10) / 10.0::double offtrack from ev),
eg as (select recording_id, track_id from sh group by all having count(*) >= 5 and max(t) - min(t) >= 2 and avg(case when x1 <= 2 or x2 >= 98 or y2 >= 98 then 1.0::double else 0 end) >= 0.6 and stddev_pop((x1 + x2) / 200) < 0.04 and stddev_pop((y1 + y2) / 200) < 0.04 and stddev_pop(y2 - y1) < 0.1 * greatest(avg(y2 - y1), 1e-6)),
la as (select *, count(*) over (partition by recording_id, track_id) many, row_number() over (partition by recording_id, track_id order by t, x1, x2, y1, y2) n from sh where (y2 - y1) / 100 >= 0.06 and not exists (select 1 from eg where eg.recording_id = sh.recording_id and eg.track_id = sh.track_id)),
bi as (select * from la where many >= 6)"""


def _shapes(spark, d):
    """Boxes of a user's events, a track for each type: tall or wide by id, an hour for a second."""
    i, v = F.col("i"), F.col("v")
    tall = i % 4 < 2
    return events(spark, d).select(
        F.col("r").alias("recording_id"), F.col("y").alias("track_id"), (F.col("t") / HOUR).alias("t"), F.lit(30.0).alias("x1"), (30 + F.when(tall, v).otherwise(3 * v)).alias("x2"), F.lit(20.0).alias("y1"), (20 + F.when(tall, 2 * v).otherwise(v / 2)).alias("y2"),
        F.lit(100).alias("frame_w"), F.lit(100).alias("frame_h"), F.lit(3).alias("cls"), ((i % 10) / 10).alias("offtrack"),
    )


_LYING = _SHAPES.replace("30 + case when i % 4 < 2 then v else 3 * v end x2", "case when floor(t / 1209600) % 2 = 0 then 40.0::double else 70 end x2").replace("20 + case when i % 4 < 2 then 2 * v else v / 2 end y2", "case when floor(t / 1209600) % 2 = 0 then 60 else 40 end + (i % 10) / 10.0::double y2")


def _lying(spark, d):
    """Shapes that change for long: tall in one fortnight, wide in the next."""
    tall = F.floor(F.col("t") * HOUR / (14 * DAY)) % 2 == 0
    return _shapes(spark, d).withColumns({"x2": F.when(tall, 40.0).otherwise(70.0), "y2": F.when(tall, 60.0).otherwise(40.0) + F.col("offtrack")})


@query(f"""with {_LYING}, a as (select *, (x2 - x1) / greatest(y2 - y1, 1) a, y2 - y1 h from bi),
f as (select *, list(a) over b la, list(h) over b lh, list(a) over f fa, list(h) over f fh from a window b as (partition by recording_id, track_id order by n rows between 5 preceding and 1 preceding), f as (partition by recording_id, track_id order by n rows between current row and 7 following))
select recording_id, track_id, round(t, 6) t from f where n > 5 and n + 8 <= many and list_min(fa) >= 1.5 * list_median(la) and list_median(fa) >= 1.8 * list_median(la) and list_median(fh) <= 0.65 * list_median(lh)""")
def bike_down_hits(spark, d):
    """Points from which on boxes lie, before the cooldown."""
    return incidents.bike_down_hits(_lying(spark, d)).select("recording_id", "track_id", F.round("t", 6).alias("t"))


@query(f"""with {_SHAPES}, w as (select *, offtrack >= 0.5 f, coalesce(max((offtrack < 0.2)::int) over (partition by recording_id, track_id order by t rows between unbounded preceding and 1 preceding) = 1, false) was from bi),
n as (select *, row_number() over (partition by recording_id, track_id order by t) - row_number() over (partition by recording_id, track_id, f and was order by t) g from w)
select recording_id, track_id, round(min(t), 6) t_start, round(max(t), 6) t_end, count(*) n from n where f and was group by recording_id, track_id, g having count(*) >= 3""")
def off_track_spans(spark, d):
    found = detect.off_track(_shapes(spark, d))
    return found.select("recording_id", "track_id", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "n")


_MOUNT = """fr as (select label r, vec_id i, vec_id / 10.0::double t, list_transform(embedding, lambda x: x > -0.05) fx, abs(embedding[1]) * 4 st from embeddings),
vo as (select r, p, avg((fx[p])::int) s, count(*) n from (select r, fx, unnest(range(1, 65)) p from fr where st >= 0.3) group by r, p), ow as (select r, p from vo where n >= 25 and p > 32 and s >= 0.6),
en as (select r from ow group by r having count(*) >= 2),
ho as (select fr.r, i, t, st >= 0.3 and avg((fx[p])::int) >= 0.5 rides from fr join ow on fr.r = ow.r join en on en.r = fr.r group by fr.r, i, t, st)"""


@query(f"with {_MOUNT} select r, (floor(t) + 0.5) t, round(avg(rides::int), 6) share from ho group by r, floor(t)")
def riding_shares(spark, d):
    """Vectors as pictures: a label is a recording, a component a block, ten vectors a second."""
    e = table(spark, d, "embeddings")
    frames = e.select(F.col("label").alias("r"), (F.col("vec_id") / 10).alias("t"), F.transform("embedding", lambda x: x.cast("double") > -0.05).alias("fx"), (F.abs(F.get("embedding", F.lit(0)).cast("double")) * 4).alias("st"))
    return mount.riding(frames, ["r"], "t", "fx", "st").withColumn("share", F.round("share", 6))


@query(f"""with {EV}, cl as (select r, i, t s, t + 7200 + v * 60 e from ev), vo as (select i * 10 q, i, i % 3 - 1 vote, i % 5 <> 0 sp from ev where i % 4 = 1),
pa as (select a.i a, b.i b from cl a join cl b on a.r = b.r and a.i <> b.i where least(a.e, b.e) > greatest(a.s, b.s) and (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) >= 0.5),
al as (select q, i + 1 o from vo union all select q, i - 2 from vo), re as (select q, vote, i, null::bigint f from vo
union all select distinct q, vote, o, f from (select q, vote, b o, i f from vo join pa on a = i where sp union all select vo.q, vote, o, i from vo join al on al.q = vo.q where o in (select i from ev)))
select q, i, vote, f inherited_from from re""")
def spread_votes(spark, d):
    """A vote on every fourth event reaches what overlaps it (unless its id ends in 0 or 5) and two neighbours by id."""
    e = events(spark, d)
    i = F.col("i")
    clips = e.select("r", "i", "t", (F.col("t") + 7200 + F.col("v") * 60).alias("w"))
    votes_ = e.where("i % 4 = 1").select((i * 10).alias("q"), "i", (i % 3 - 1).alias("vote"), (i % 5 != 0).alias("sp"))
    also = votes_.select("q", (i + 1).alias("i")).unionByName(votes_.select("q", (i - 2).alias("i")))
    return votes.spread_votes(votes_, clips, ["r"], "i", "t", "w", "q", also, "sp", width=4 * HOUR).select("q", "i", "vote", "inherited_from")


@query("""with f as (select doc_id, lang, '/out/' || source || '/' || lang || '/d' || doc_id || '.mp4' path from documents), o as (select distinct lang, '/out/' || source folder, 'd' || substr(doc_id::varchar, 1, 1) prefix from documents where doc_id % 50 = 0)
select doc_id from f where not exists (select 1 from o where o.lang = f.lang and starts_with(path, folder || '/') and starts_with(split_part(path, '/', 5), prefix))""")
def forgotten_files(spark, d):
    """Files of documents in folders of their source; every fiftieth takes away those of its source and language whose number begins alike."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    files = docs.select("doc_id", "lang", F.concat(F.lit("/out/"), "source", F.lit("/"), "lang", F.lit("/d"), "doc_id", F.lit(".mp4")).alias("path"))
    orders = docs.where("doc_id % 50 = 0").select("lang", F.concat(F.lit("/out/"), "source").alias("folder"), F.concat(F.lit("d"), F.substring(F.col("doc_id").cast("string"), 1, 1)).alias("name_prefix"))
    return votes.forget(files, orders, ["lang"]).select("doc_id")


@query("select distinct conv_id, turn, role, (length(text) % 3 - 1)::int vote from conversations where conv_id is not null and text is not null")
def received_votes(spark, d):
    """Votes written as change files by the executors, and read from there by a stream that takes whole lines."""
    folder = f"{checkpoint_folder(spark)}/changes-{uuid.uuid4().hex}"
    said = table(spark, d, "conversations").where("conv_id IS NOT NULL AND text IS NOT NULL").select("conv_id", "turn", "role", (F.pmod(F.length("text"), F.lit(3)) - 1).alias("vote"))
    said.select(F.to_json(F.struct("conv_id", "turn", "role", "vote"), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)
    tail.register(spark)
    lines = spark.readStream.format("appended_lines").option("ending", ".txt").load(folder)
    got = streams.drained(spark, lines, f"votes_{uuid.uuid4().hex}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in said.schema)
    return records.vote_lines(got, schema, unique=("conv_id", "turn", "role", "vote"))


def _hits(spark, d):
    """A user's events as lines in the picture, an hour for a frame."""
    i, v = F.col("i"), F.col("v")
    return events(spark, d).select("r", F.floor(F.col("t") / HOUR).alias("f"), F.floor(F.col("t") / HOUR).cast("double").alias("t"), F.least(v / 50, F.lit(1.0)).alias("row"), ((i % 5) * 2.0).alias("angle"), ((i % 10) / 10).alias("run"))


@query()
def line_passes(spark, d):
    return linking.line_passes(_hits(spark, d), ["r"], "f", "t", "row", "angle", "run", fps=1.0, gap=48.0)


@query()
def edge_passes(spark, d):
    h = _hits(spark, d)
    last = F.max("f").over(Window.partitionBy("r"))
    first = F.min("f").over(Window.partitionBy("r"))
    framed = h.withColumn("_first", first).withColumns({"last": last - F.col("_first"), "f": F.col("f") - F.col("_first")}).drop("_first")
    return linking.edge_passes(framed, ["r"], "f", "t", "row", "angle", "run", "last", fps=0.05, gap=96.0, rise_s=120.0, same=12.0)


@query(f"""with recursive {_LYING}, w as (select *, offtrack >= 0.5 f, coalesce(max((offtrack < 0.2)::int) over (partition by recording_id, track_id order by t rows between unbounded preceding and 1 preceding) = 1, false) was from bi),
nn as (select *, row_number() over (partition by recording_id, track_id order by t) - row_number() over (partition by recording_id, track_id, f and was order by t) g from w),
sp as (select recording_id, track_id, min(t) s, max(t) e from nn where f and was group by recording_id, track_id, g having count(*) >= 3),
a as (select *, (x2 - x1) / greatest(y2 - y1, 1) a, y2 - y1 h from bi),
fr as (select *, list(a) over b la, list(h) over b lh, list(a) over f fa, list(h) over f fh from a window b as (partition by recording_id, track_id order by n rows between 5 preceding and 1 preceding), f as (partition by recording_id, track_id order by n rows between current row and 7 following)),
hi as (select recording_id, track_id, t, row_number() over (partition by recording_id, track_id order by t) k from fr where n > 5 and n + 8 <= many and list_min(fa) >= 1.5 * list_median(la) and list_median(fa) >= 1.8 * list_median(la) and list_median(fh) <= 0.65 * list_median(lh)),
x as (select recording_id, track_id, k, t, t la, true keeps from hi where k = 1 union all select h.recording_id, h.track_id, h.k, h.t, case when h.t - x.la > 5 then h.t else x.la end, h.t - x.la > 5 from x join hi h on h.recording_id = x.recording_id and h.track_id = x.track_id and h.k = x.k + 1),
ri as (select distinct x.recording_id, x.track_id, x.t from x join sp on sp.recording_id = x.recording_id and sp.track_id <= x.track_id and x.t between s - 2 and e + 2 where keeps)
select recording_id, track_id, 'rider_down' "type", round(t - 1, 6) t_start, round(t + 1, 6) t_end, 1.5::double score, 'bike_down' why from ri
union all select recording_id, track_id, 'off_track', round(s, 6), round(e, 6), 1.0::double, null from sp where not exists (select 1 from ri where ri.recording_id = sp.recording_id and s between t - 3 and t + 3)""")
def incident_events(spark, d):
    """Riders down and bikes off the track, of shapes that lie every other fortnight."""
    found = incidents.incidents(_lying(spark, d))
    return found.select("recording_id", "track_id", "type", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "score", "why")
