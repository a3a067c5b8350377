"""Queries of a day's shorts: crashes of several cameras, the tested moments' plan, sessions, files and what a page lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, features, shorts
from .moments_day import _REASONED, _measured
from .queries import DAY, EV, HOUR, events, query, table

_BUILT = "with recursive " + _REASONED + """,
kp as materialized (select r, i, theme, case when theme not in ('crash', 'own_off_track') and action_density is not null then (case theme when 'overtake' then 1.5 when 'kneepuck' then 1.3 else 1.0 end) * (action_density + case when theme = 'kneepuck' then 1 else 0 end) else v end score,
  least(lo, len - 8) a, h + 60 b, (least(lo, len - 8) + 8) - least(lo, len - 8) + ((h + 60) - h) secs from wi where keeps),
od as materialized (select *, row_number() over (partition by r order by case theme when 'action' then 99 else list_position(['overtake', 'overtaken', 'catching_up', 'duel', 'kneepuck', 'crash', 'crash_other', 'off_track', 'own_off_track'], theme) end, score desc, i) n from kp),
xs as (select r, n, i, true best, [{'t': theme, 's': a, 'e': b}] kept from od where n = 1 union all
       select r, n, i, best, case when best then list_append(kept, {'t': theme, 's': a, 'e': b}) else kept end from (
         select o.r, o.n, o.i, o.theme, o.a, o.b, x.kept, len(list_filter(x.kept, lambda k: (k.t = o.theme or o.theme = 'action') and least(o.b, k.e) - greatest(o.a, k.s) > 0.5 * least(o.b - o.a, k.e - k.s))) = 0 best from xs x join od o on o.r = x.r and o.n = x.n + 1)),
km as materialized (select od.* from od join xs on od.r = xs.r and od.n = xs.n where best)"""


def _built(spark, d):
    lengths = events(spark, d).groupBy(F.col("r").cast("string").alias("recording_id")).agg((F.max("t") / HOUR - 5).alias("duration"))
    tested = features.day_moments(_measured(spark, d), lengths)
    days = tested.withColumn("day", F.get("segments", F.lit(0))["recording_id"].cast("long"))
    return shorts.build(days, ["day"], "i", limit=200.0)


@query(_BUILT + """, ml as materialized (select r, 'action' series, i, secs, a, row_number() over (partition by r order by score desc, i) n from km
union all select r, theme, i, secs, a, row_number() over (partition by r, theme order by a, i) from km where theme <> 'action' qualify count(*) over (partition by r, theme) >= case when theme in ('own_off_track', 'crash') then 1 else 2 end),
pk as (select r, series, n, i, a, 0 bin, secs used from ml where n = 1 union all
       select m.r, m.series, m.n, m.i, m.a, case when p.used > 0 and p.used + m.secs > 200 then p.bin + 1 else p.bin end, case when p.used > 0 and p.used + m.secs > 200 then m.secs else p.used + m.secs end from pk p join ml m on m.r = p.r and m.series = p.series and m.n = p.n + 1)
select r "day", series, bin::int bin, i, row_number() over (partition by r, series, bin order by a, i)::int place from pk""")
def built_shorts(spark, d):
    """From events to the shorts' plan: measures, a day's tests, repeats, packing."""
    return _built(spark, d)[0]


@query(_BUILT + """ select wi.r "day", wi.i, case when wi.reason is not null then wi.reason when km.i is null then 'repeat' end drop_reason from wi left join km on km.r = wi.r and km.i = wi.i""")
def what_became_of_moments(spark, d):
    return _built(spark, d)[1].select("day", "i", "drop_reason")


_CRASHED = f"""with recursive {EV}, o as (select floor(t / 86400)::bigint "day", r, t, greatest(0, t - 6) s, r % 2 = 0 fr, row_number() over (partition by floor(t / 86400) order by greatest(0, t - 6), r) n from ev where y = 'error' and v >= 20),
x as (select "day", n, [{{'r': r, 's': s, 'f': fr, 't': t}}] k from o where n = 1 union all
      select o."day", o.n, case when o.s - x.k[-1].s >= 7200 then list_append(x.k, {{'r': o.r, 's': o.s, 'f': o.fr, 't': o.t}}) when o.fr and not x.k[-1].f then list_append(x.k[:len(x.k) - 1], {{'r': o.r, 's': o.s, 'f': o.fr, 't': o.t}}) else x.k end from x join o on o."day" = x."day" and o.n = x.n + 1),
z as (select "day", unnest(k) q from x qualify n = max(n) over (partition by "day"))"""


@query(_CRASHED + """ select "day", q.r recording_id, round(q.s, 3) utc_start, round(q.s + 10, 3) utc_end from z""")
def crash_moments(spark, d):
    """Errors of high value as crashes that several users feel; within two hours they are one, and even users take over."""
    e = events(spark, d).where("y = 'error' AND v >= 20")
    felt = e.select(F.floor(F.col("t") / DAY).alias("day"), F.col("r").alias("recording_id"), F.when(F.col("r") % 2 == 0, "front").otherwise("rear").alias("facing"), "t", F.lit(0.0).alias("offset"))
    found = shorts.crash_moments(felt, ["day"], gap=2 * HOUR)
    return found.select("day", F.get("segments", F.lit(0))["recording_id"].alias("recording_id"), F.round("utc_start", 3).alias("utc_start"), F.round("utc_end", 3).alias("utc_end"))


@query(f"""with {EV}, a as (select r, i, t s, t + 7200 e from ev where y = 'click'), b as (select r, i j, t - 3600 s, t + 10800 e from ev where y = 'purchase') select i, j from a join b on a.r = b.r and b.s < a.e and b.e > a.s""")
def sessions_overlapping(spark, d):
    e = events(spark, d)
    a = e.where("y = 'click'").select("r", "i", F.col("t").alias("s0"), (F.col("t") + 7200).alias("s1"))
    b = e.where("y = 'purchase'").select("r", F.col("i").alias("j"), (F.col("t") - 3600).alias("e0"), (F.col("t") + 10800).alias("e1"))
    return shorts.sessions_overlapping(a, b, ["r"], "s0", "s1", "e0", "e1", width=4 * HOUR).select("i", "j")


_LOCAL_DAY = "date_trunc('day', timezone('Europe/Copenhagen', timezone('UTC', ts)))"


@query(f"select event_id i, epoch(timezone('Europe/Copenhagen', {_LOCAL_DAY})) day_start, epoch(timezone('Europe/Copenhagen', {_LOCAL_DAY} + interval 86399999 milliseconds)) day_end from events")
def day_bounds(spark, d):
    first, last = shorts.day_bounds(F.col("t"))
    return events(spark, d).select("i", first.alias("day_start"), last.alias("day_end"))


@query("""with f as (select doc_id, source, lang, ['short', 'vertical', 'horizontal', 'poster'][doc_id % 4 + 1] kind, '/f' || doc_id path, n_chars % 5 size, doc_id % 3 changed from documents),
k as (select *, coalesce(list_position(['short', 'vertical', 'horizontal'], kind), 4) rk from f), b as (select *, min(rk) over (partition by source, lang) best from k)
select doc_id from (select doc_id, row_number() over (partition by source, lang, size, changed order by path) n from b where rk = best) where n = 1""")
def shown_files(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("short", "vertical", "horizontal", "poster"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(spark, d, "documents").select("doc_id", "source", "lang", kinds.alias("kind"), F.concat(F.lit("/f"), "doc_id").alias("path"), (F.col("n_chars") % 5).alias("size"), (F.col("doc_id") % 3).alias("changed"))
    return shorts.shown_files(files, ["source", "lang"]).select("doc_id")


@query("""select array_to_string(list_sort(list_distinct(list(lang))), ',') "days", array_to_string(list_sort(list_distinct(list(source))), ',') "themes",
(select array_to_string(list_concat(['keep', 'user'], list_filter(list_sort(list_distinct(list(role))), lambda x: x not in ('keep', 'user'))), ',') from conversations) "tags" from documents""")
def facets(spark, d):
    votes = table(spark, d, "conversations").select(F.array("role").alias("tags"))
    found = shorts.facets(table(spark, d, "documents"), votes, ["keep", "user"], day="lang", theme="source")
    return found.select(*(F.array_join(c, ",").alias(c) for c in ("days", "themes", "tags")))


_RODE = f"""with {EV}, bx as (select r recording_id, y track_id, floor(t / 21600) t, 30.0::double + i % 20 x1, 35 + i % 20 + v x2, 20.0::double + i % 10 y1, 20 + i % 10 + 2 * v y2, case when y in ('click', 'view', 'error') then 3 else 0 end cls from ev),
eg as (select recording_id, track_id from bx group by all having count(*) >= 5 and max(t) - min(t) >= 2 and avg(case when x1 <= 2 or x2 >= 98 or y2 >= 98 then 1.0::double else 0 end) >= 0.6 and stddev_pop((x1 + x2) / 200) < 0.04 and stddev_pop((y1 + y2) / 200) < 0.04 and stddev_pop(y2 - y1) < 0.1 * greatest(avg(y2 - y1), 1e-6)),
b as (select distinct recording_id, track_id, t, x1 a1, x2 a2, y1 b1, y2 b2 from bx where cls = 3),
o as (select b.*, coalesce(bool_or((p.x1 + p.x2) / 2 between a1 and a2 and p.y1 <= (b1 + b2) / 2 and least(a2, p.x2) > greatest(a1, p.x1) and least(b2, p.y2) > greatest(b1, p.y1)
  and (least(a2, p.x2) - greatest(a1, p.x1)) * (least(b2, p.y2) - greatest(b1, p.y1)) >= 0.2 * greatest((p.x2 - p.x1) * (p.y2 - p.y1), 1e-9)), false) rides from b left join bx p on p.recording_id = b.recording_id and p.t = b.t and p.cls = 0 group by all),
m as (select recording_id, track_id from o group by all having avg(rides::int) >= 0.3),
f as (select bx.recording_id, bx.t, max((y2 - y1) / 100) h, count(distinct bx.track_id) n from bx join m using (recording_id, track_id) where cls = 3 and (y2 - y1) / 100 >= 0.03 and (recording_id, track_id) not in (select (recording_id, track_id) from eg) group by all)"""


@query(_RODE + ' select recording_id, t::bigint "second", round(h, 6) height, n riders from f')
def nearest_riders(spark, d):
    """Other riders in view and the nearest one's height: types as tracks, a quarter of a day as a second, people in the other types."""
    i, v = F.col("i"), F.col("v")
    x, y = 30.0 + i % 20, 20.0 + i % 10
    boxes = events(spark, d).select(
        F.col("r").alias("recording_id"), F.col("y").alias("track_id"), F.floor(F.col("t") / (6 * HOUR)).cast("double").alias("t"), x.alias("x1"), (35 + i % 20 + v).alias("x2"), y.alias("y1"), (20 + i % 10 + 2 * v).alias("y2"),
        F.lit(100).alias("frame_w"), F.lit(100).alias("frame_h"), F.when(F.col("y").isin("click", "view", "error"), 3).otherwise(0).alias("cls"),
    )
    return detect.nearest_rider(boxes).select("recording_id", "second", F.round("height", 6).alias("height"), "riders")
