"""Queries of what moments show and why they are left out: a user is a recording, a purchase a moment of two pieces, the other events its samples, an hour a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features
from .queries import EV, HOUR, events, query

_THEMES = ("overtake", "own_off_track", "crash", "kneepuck", "action")


def _moments(spark, d):
    e = events(spark, d).where("y = 'purchase'")
    i, h = F.col("i"), F.col("t") / HOUR
    rec = F.col("r").cast("string")
    piece = lambda a, b: F.struct(rec.alias("recording_id"), a.alias("t_start"), b.alias("t_end"))
    theme = F.element_at(F.array(*map(F.lit, _THEMES)), (i % 5 + 1).cast("int"))
    return e.select("i", theme.alias("theme"), (h - 30).alias("utc_start"), (h + 60).alias("utc_end"), F.col("v").alias("score"), F.array().cast("array<string>").alias("why"), F.array(piece(h - 30, h - 26), piece(h, h + 60)).alias("segments"))


def _series(spark, d):
    e = events(spark, d).withColumns({"recording_id": F.col("r").cast("string"), "t": F.col("t") / HOUR})
    of = lambda y, **c: e.where(F.col("y") == y).select("recording_id", "t", *(v.alias(k) for k, v in c.items()))
    i, v, r = F.col("i"), F.col("v"), F.col("r")
    cameras = e.select("r", "recording_id").distinct().select("recording_id", F.when(r % 2 == 0, "front").otherwise("rear").alias("facing"), (r % 5 == 0).alias("gps"), (r % 3 == 0).alias("from_log"))
    return {
        "action": of("click", riders=(i % 3).cast("int"), kerb=(i % 10) / 10, height=v / 200, lamp=i % 29 == 0), "speeds": of("view", kmh=v * 3), "turns": of("error", yaw=v - 20), "leans": of("signup", lean=v - 25),
        "riding": of("view", share=v / 37, r=r).where("r % 4 = 1").drop("r"), "vehicles": of("click", share=(i % 7) / 11), "motion": of("view", motion=v / 3), "cameras": cameras,
    }


def _range(name: str, y: str, value: str, pad: float = 0, more: str = "") -> str:
    return f"{name} as (select p.*, e.t / 3600 st, e.i ei, {value} x from pi p join ev e on e.r = p.r and e.y = '{y}'{more} and e.t / 3600 between a - {pad} and b + {pad})"


_MEASURED = f"""{EV}, mo as (select r, i, t / 3600 h, v, ['overtake', 'own_off_track', 'crash', 'kneepuck', 'action'][i % 5 + 1] theme from ev where y = 'purchase'),
pi as (select r, i, theme, 0 k, h - 30 a, h - 26 b from mo union all select r, i, theme, 1, h, h + 60 from mo),
ru as (select r, i, theme, 0 k, greatest(0, h - 31) a, greatest(0, h - 31) + 6 b from mo where theme = 'own_off_track' union all select r, i, theme, k, a, b from pi where theme <> 'own_off_track'),
{_range('ac', 'click', 'e.v', 0.5)},
av as (select *, ei % 3 ri, (ei % 10) / 10.0::double ke, x / 200 he from ac),
ad as (select i, sum(m * (b - a)) / sum(b - a) action_density from (select i, k, a, b, avg(least(ri, 4) * case when ri > 0 and he > 0 then least(1, greatest(0.2, he / 0.15)) else 0.5 end + 0.5 * ke) m from av group by all) group by i),
aa as (select i, max(ri)::int riders, max(ke) kerb_share, max(he) nearest_rider, bool_or(ei % 29 = 0) red_lamp, avg((ri >= 1)::int) rider_share, avg((ri >= 2)::int) group_share, case when count(*) filter (he > 0) >= 3 and max(st) filter (he > 0) > min(st) filter (he > 0) then regr_slope(he, st) filter (he > 0) end closing from av group by i),
{_range('sp', 'view', 'e.v * 3')},
sg as (select *, case when st - lag(st) over w > 0.05 then (x - lag(x) over w) / 3.6 / (st - lag(st) over w) / 9.81 end g from sp window w as (partition by i order by st, x)),
sa as (select i, median(x) speed_kmh, case when count(*) >= 2 then max(x) end speed_max, case when count(*) >= 2 then min(x) end speed_min, case when count(*) >= 2 then arg_max(x, (st, x)) - arg_min(x, (st, x)) end speed_change, case when count(g) > 0 then greatest(0, -min(g)) end brake_g, case when count(g) > 0 then greatest(0, max(g)) end accel_g from sg group by i),
{_range('tu', 'error', 'abs(e.v - 20)')}, ta as (select i, max(x) turn_rate_max, avg((x >= 15)::int) cornering_share from tu group by i),
{_range('le', 'signup', 'abs(e.v - 25)')}, la as (select i, max(x) lean_max from le group by i),
{_range('ve', 'click', '(e.i % 7) / 11.0::double')}, va as (select i, sum(m * (b - a)) / sum(b - a) vehicle_share from (select i, k, a, b, avg(x) m from ve group by all) group by i),
{_range('rd', 'view', 'e.v / 37', 0, ' and e.r % 4 = 1')}, ra as (select i, sum(m * (b - a)) / sum(b - a) riding_share from (select i, k, a, b, avg(x) m from rd group by all) group by i),
{_range('mt', 'view', 'e.v / 3')}, ma as (select i, median(x) motion from mt group by i),
rr as (select i, sum(m * (b - a)) / sum(b - a) riding from (select p.i, k, a, b, avg(e.v / 37) m from ru p join ev e on e.r = p.r and e.r % 4 = 1 and e.y = 'view' and e.t / 3600 between a and b group by all) group by i),
rs as (select p.i, median(e.v * 3) speed, median(e.v / 3) mot from ru p join ev e on e.r = p.r and e.y = 'view' and e.t / 3600 between a and b group by p.i),
rc as (select p.i, max(e.i % 3) rid from ru p join ev e on e.r = p.r and e.y = 'click' and e.t / 3600 between a - 0.5 and b + 0.5 group by p.i),
al as (select mo.*, aa.* exclude (i), action_density, sa.* exclude (i), turn_rate_max, cornering_share, lean_max, vehicle_share, riding_share, motion,
  case when riding is not null and mo.r % 5 <> 0 then case when riding >= 0.5 then 'track' when mot < 4 then 'stopped' else 'slow' end when speed is not null then case when speed < 10 then 'stopped' when speed < 40 then 'slow' else 'track' end when mot < 4 then 'stopped' when mot >= 10 and rid >= 1 then 'track' when mot is null then null else 'slow' end pace,
  case when riding is not null and mo.r % 5 <> 0 then 'riding ' || round_even(riding * 100, 0)::bigint || '% of the time' when speed is not null then case when mo.r % 3 = 0 then 'log' else 'GPS' end || ' ' || round_even(speed, 0)::bigint || ' km/h' when mot is null then 'pace not stored' else '?' end pace_from
  from mo left join aa using (i) left join ad using (i) left join sa using (i) left join ta using (i) left join la using (i) left join va using (i) left join ra using (i) left join ma using (i) left join rr using (i) left join rs using (i) left join rc using (i))"""
_NUMBERS = "kerb_share nearest_rider rider_share group_share closing action_density speed_kmh speed_max speed_min speed_change brake_g accel_g turn_rate_max cornering_share lean_max vehicle_share riding_share motion".split()


def _measured(spark, d):
    return features.measured(_moments(spark, d), "i", _series(spark, d), width=24.0)


@query(f"with {_MEASURED} select i, riders, coalesce(red_lamp, false) red_lamp, pace, pace_from, {', '.join(f'round({c}, 6) {c}' for c in _NUMBERS)} from al")
def moment_measures(spark, d):
    """All that the series tell of each moment."""
    return _measured(spark, d).select("i", "riders", F.coalesce("red_lamp", F.lit(False)).alias("red_lamp"), "pace", "pace_from", *(F.round(c, 6).alias(c) for c in _NUMBERS))


_REASONED = f"""{_MEASURED}, re as (select *, theme <> 'crash' and coalesce(vehicle_share, 0) >= 0.4 car, theme not in ('crash', 'own_off_track') and coalesce(riders = 0 and kerb_share < 0.25, false) bare from al),
du as (select r, max(t / 3600) - 5 len from ev group by r),
dr as (select re.*, len, case when car then 'car in view (paddock)' when bare then 'no rider or kerb in view' when theme <> 'crash' and pace = 'stopped' then 'standing still' when theme <> 'crash' and pace = 'slow' then 'not on track (below 40 km/h or unknown)' end reason from re join du using (r)),
wi as (select *, reason is null keeps, greatest(0, h - 28 - 4) lo from dr)"""


@query(f"""with {_REASONED} select i, theme, reason drop_reason, round(case when not car and not bare and theme not in ('crash', 'own_off_track') and action_density is not null then (case theme when 'overtake' then 1.5 when 'kneepuck' then 1.3 else 1.0 end) * (action_density + case when theme = 'kneepuck' then 1 else 0 end) else v end, 6) score,
round(case when keeps then least(lo, len - 8) else h - 30 end, 6) first_start, round(case when keeps then least(lo, len - 8) else h - 30 end, 6) utc_start, round(h + 60, 6) utc_end,
array_to_string(list_filter([case when not car and riders is not null then riders || ' rider(s) in view' || case when kerb_share >= 0.25 then ', kerb close by' else '' end end,
  case when not car and not bare then case when theme = 'crash' then 'no pace check for this theme' else pace_from end end, 'left out: ' || reason], lambda x: x is not null), '; ') why from wi""")
def day_moments(spark, d):
    """A day's tests in their order, with what each said; recordings end five hours before their last event, pieces of four hours are widened to eight."""
    lengths = events(spark, d).groupBy(F.col("r").cast("string").alias("recording_id")).agg((F.max("t") / HOUR - 5).alias("duration"))
    found = features.day_moments(_measured(spark, d), lengths)
    said = F.array_join(F.filter("why", lambda x: ~x.startswith("action ")), "; ")
    return found.select("i", "theme", "drop_reason", F.round("score", 6).alias("score"), F.round(F.get("segments", F.lit(0))["t_start"], 6).alias("first_start"), F.round("utc_start", 6).alias("utc_start"), F.round("utc_end", 6).alias("utc_end"), said.alias("why"))
