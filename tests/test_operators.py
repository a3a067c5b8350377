"""Operators on rows made by hand: boundaries, ties and defaults."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlake.functions import scalars as S
from momentlake.operators import align, cascade, detect, intervals, laps, learn, moments, rank, series
from momentlake.operators.common import per_rows
from momentlake.streaming import sessions
from momentlake.sources import records


def values(df, *columns):
    return [tuple(r) for r in df.orderBy(*columns).select(*columns).collect()]


def test_islands_bridge_a_gap_of_exactly_the_limit(spark):
    e = spark.createDataFrame([("r", 1.0, 2.0, 0.1, 1), ("r", 3.0, 4.0, 0.5, 2), ("r", 5.01, 6.0, 0.2, 3)], "r string, t_start double, t_end double, score double, ordinal int")
    assert values(intervals.merge_same_type(e, ["r"]), "t_start", "t_end", "score", "n") == [(1.0, 4.0, 0.5, 2), (5.01, 6.0, 0.2, 1)]


def test_later_extra_wins(spark):
    e = spark.createDataFrame([(1, 0.0, 1.0, 1.0, {"a": "x", "b": "y"}), (2, 0.5, 2.0, 1.0, {"a": "z"})], "ordinal int, t_start double, t_end double, score double, extra map<string,string>").withColumn("r", F.lit(1))
    assert intervals.merge_same_type(e, ["r"], extra="extra").first()["extra"] == {"a": "z", "b": "y"}


@pytest.mark.parametrize(("strict", "n"), [(True, 2), (False, 1)])
def test_touching_spans(spark, strict, n):
    s = spark.createDataFrame([(1, 0.0, 5.0, 1), (1, 5.0, 9.0, 2)], "r int, a double, b double, k int")
    assert intervals.merge_spans(s, ["r"], "a", "b", "k", strict=strict).count() == n


def test_run_needs_road_right_before(spark):
    points = [(t / 10, 0.0 if t < 40 else 0.9) for t in range(60)]
    make = lambda p: spark.createDataFrame([(1, a, b, i) for i, (a, b) in enumerate(p)], "r int, t double, v double, i int")
    go = lambda p: intervals.runs_after(make(p), ["r"], "t", "v", "i", high=0.5, low=0.2, min_seconds=0.8, before_seconds=3.0)
    assert [r["t_start"] for r in go(points).collect()] == [4.0]
    assert go([(t, 0.35 if t == 3.9 else v) for t, v in points]).isEmpty()


def test_one_second_event_may_serve_two(spark):
    a = spark.createDataFrame([("d", 10.0, 1), ("d", 11.0, 2), ("d", 99.0, 3)], "d string, e double, a int")
    b = spark.createDataFrame([("d", 12.0, 7), ("d", 8.4, 8)], "d string, t double, b int")
    assert values(intervals.nearest_after(a, b, ["d"], "e", "t", "a", "b").select("a", "b"), "a", "b") == [(1, 7), (2, 7)]


def test_overlap_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    spans = [(int(rng.integers(3)), float(s := rng.uniform(0, 400)), float(s + rng.uniform(0, 60)), i) for i, _ in enumerate(range(80))]
    df = spark.createDataFrame(spans, "r int, s double, e double, i int")
    for share, least in (("iou", 0.5), ("shorter", 0.3)):
        want = set()
        for ra, sa, ea, ia in spans:
            for rb, sb, eb, ib in spans:
                both = min(ea, eb) - max(sa, sb)
                whole = max(ea, eb) - min(sa, sb) if share == "iou" else min(ea - sa, eb - sb)
                if ra == rb and ia < ib and both > 0 and both / whole >= least:
                    want.add((ia, ib))
        for width in (7.0, 50.0, 1000.0):
            found = intervals.overlap_pairs(df, ["r"], "s", "e", "i", least, share, width)
            assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(want)


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = dict(intervals.components(pairs).collect())
    assert {found[i] for i in range(41)} == {0} and found[101] == 100


def test_asof_counts_equal_times_on_both_sides_and_holds_ends(spark):
    p = spark.createDataFrame([(1, 5.0, 1), (1, 0.0, 2), (1, 20.0, 3), (1, 10.0, 4), (2, 1.0, 5)], "r int, t double, i int")
    s = spark.createDataFrame([(1, 5.0, 10.0), (1, 15.0, 30.0)], "r int, t double, v double")
    found = series.asof(p, s, ["r"], "t", "v", "i")
    assert values(found.select("i", series.interpolated(found, "t").alias("x")), "i", "x") == [(1, 10.0), (2, 10.0), (3, 30.0), (4, 20.0), (5, None)]


def test_span_without_samples_is_kept_unless_a_near_one_is_slow(spark):
    a = spark.createDataFrame([("r", 1, 10.0, 11.0), ("r", 2, 100.0, 101.0), ("r", 3, 30.0, 31.0)], "r string, i int, s double, e double")
    b = spark.createDataFrame([("r", 13.0, 20.0), ("r", 30.2, 90.0), ("r", 30.6, 100.0)], "r string, t double, v double")
    assert values(series.median_or_nearest(a, b, ["r"], "s", "e", "t", "v", "i", width=4.0), "i", "kept") == [(1, False), (2, True), (3, True)]


def test_slope_windows_are_full(spark):
    df = spark.createDataFrame([(1, float(i), math.exp(i) * 10, i) for i in range(9)], "r int, t double, a double, i int")
    assert [(i, round(s, 9)) for i, s in values(series.sliding_slope(df, ["r"], "t", "a", "i"), "i", "slope")] == [(7, 1.0), (8, 1.0)]


def test_laps(spark):
    steps = [(0.0, 0.5), (1.0, 1.5), (2.0, 0.5), (3.0, 1.5)]
    df = spark.createDataFrame([(1, t, y, int(t)) for t, y in steps], "r int, t double, lat double, k int").withColumn("crossed", F.col("k").isin(1, 3))
    assert values(laps.lap_table(df, ["r"], "t", "k", F.col("crossed")), "lap", "t_start", "t_end", "out_lap", "in_lap") == [(0, 0.0, 1.0, True, False), (1, 1.0, 3.0, False, False), (2, 3.0, 3.0, False, True)]


def test_crossing_is_interpolated_and_must_meet_the_line(spark):
    track = spark.createDataFrame([(1, 0.0, 0.0, -1.0), (1, 1.0, 0.0, 3.0), (2, 0.0, 9.0, -1.0), (2, 1.0, 9.0, 1.0)], "r int, t double, lat double, lon double")
    assert values(laps.line_crossings(track, ["r"], "t", "lat", "lon", (-1.0, 0.0, 1.0, 0.0)), "r", "t_cross") == [(1, 0.25)]


def test_gate_rounds_up_and_spares_the_exempt(spark):
    rows = [(f"k{i:02d}", i / 10, "x") for i in range(10)] + [("crash", 0.0, "crash"), ("none", None, "x")]
    kept = rank.gate(spark.createDataFrame(rows, "k string, s double, y string").withColumn("d", F.lit(1)), ["d"], "k", "s", "y", top=15, explore=0.0).where("kept")
    assert sorted(r["k"] for r in kept.collect()) == ["crash", "k08", "k09", "none"]


def test_bands_by_place(spark):
    df = rank.bands(spark.createDataFrame([(1, float(i), i) for i in range(150)], "g int, s double, i int"), ["g"], "s", "i")
    assert {r["band"]: r["count"] for r in df.groupBy("band").count().collect()} == {b: 10 for b in range(15)}
    assert values(df.where("i in (0, 75, 149)"), "i", "third") == [(0, "low"), (75, "medium"), (149, "high")]


def test_upsert_and_first_of(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 5, "old")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 5, "new"), (2, 4, "new"), (3, 1, "new")], "k int, v int, x string")
    assert values(rank.upsert(old, new, ["k"], "v"), "k", "x") == [(1, "new"), (2, "old"), (3, "new")]
    twice = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, f string")
    assert [i for (i,) in values(rank.first_of(twice, ["f"], "i"), "i")] == [1, 3, 4]


def test_windows_join_the_first_that_fits(spark):
    e = spark.createDataFrame([("r", 20.0, 22.0, 0.4, 1), ("r", 21.0, 24.0, 0.9, 2), ("q", 360.0, 360.0, 0.5, 3), ("q", 404.0, 404.0, 0.5, 4)], "r string, s double, e double, v double, i int")
    found = moments.clip_windows(e, ["r"], "s", "e", "v", "i", duration=1000.0)
    assert values(found, "r", "n_events") == [("q", 1), ("q", 1), ("r", 2)]
    best = found.where("r = 'r'").first()
    assert best["w_start"] <= 12.5 and best["w_end"] >= 32.5 and best["w_score"] == 0.9


def test_packing_suppression_and_cooldown(spark):
    m = spark.createDataFrame([("d", i, 8.0, float(30 - i)) for i in range(30)], "d string, i int, s double, v double")
    assert moments.pack_next_fit(m, ["d"], "i", "s", "v", 40.0).select("bin").distinct().count() == 6
    spans = spark.createDataFrame([("d", 1, 0.0, 10.0, 3.0), ("d", 2, 5.0, 15.0, 2.0), ("d", 3, 5.1, 15.1, 1.0), ("d", 4, 4.9, 14.0, 0.5)], "d string, i int, a double, b double, v double")
    assert [i for (i,) in values(moments.suppress(spans, ["d"], "i", "a", "b", "v"), "i")] == [1, 2]
    hits = spark.createDataFrame([("d", t, int(t)) for t in (0.0, 4.0, 6.0, 11.0, 12.0)], "d string, t double, i int")
    assert [i for (i,) in values(moments.cooldown(hits, ["d"], "t", "i", 5.0), "i")] == [0, 6, 11]  # exactly 5 seconds are enough


def test_focus_holds_its_subject(spark):
    frames = spark.createDataFrame([("r", 0, "a", 10.0), ("r", 0, "b", 5.0), ("r", 1, "a", 6.0), ("r", 1, "b", 10.0), ("r", 2, "a", 4.0), ("r", 2, "b", 10.0)], "r string, t int, s string, v double")
    assert values(moments.focus(frames, ["r"], "t", "s", "v"), "t", "s") == [(0, "a"), (1, "a"), (2, "b")]


def test_learned_score():
    rng = np.random.default_rng(0)
    riders = rng.integers(0, 6, 40).astype(float)
    x, y = np.column_stack([riders, rng.normal(size=40)]), (riders >= 3).astype(float)
    p = learn.cross_validate(x, y)
    assert ((p > 0.5) == y).mean() >= 0.8
    assert learn.explain(learn.fit(x, y), ["riders", "noise"])[0][0] == "riders"


def test_detectors(spark):
    box = lambda k, t, h, cls=3, x=300.0: ("r", k, t, x, 200.0, x + h * 360 * 0.6, 200.0 + h * 360, 0.9, cls, 640, 360, 0.0)
    ddl = "recording_id string, track_id int, t double, x1 double, y1 double, x2 double, y2 double, conf double, cls int, frame_w int, frame_h int, offtrack double"
    growing = spark.createDataFrame([box(1, 0.2 * i, 0.08 + 0.03 * i) for i in range(12)], ddl)
    assert {"nearby_rider", "approaching_rider"} <= {r["type"] for r in detect.rider_events(growing).collect()}
    own = spark.createDataFrame([("r", 2, 0.2 * i, 200.0, 250.0, 400.0, 360.0, 0.9, 3, 640, 360, 0.0) for i in range(20)], ddl)
    assert detect.ego_tracks(own).count() == 1 and detect.rider_events(own).isEmpty()
    swap = [box(1, 0.2 * i, 0.3 if i < 12 else 0.15) for i in range(25)] + [box(2, 0.2 * i, 0.2 if i < 12 else 0.25, x=100.0) for i in range(25)]
    assert values(detect.passes(spark.createDataFrame(swap, ddl)), "a", "b") == [(1, 2)]
    speed = [("r", t / 10, 90.0 if t < 300 else 0.0) for t in range(600)]
    jolt = [("r", t / 200, 0.0, 0.0, 5.0 if t == 5980 else 1.0) for t in range(12000)]
    found = detect.crashes(spark.createDataFrame(speed, "recording_id string, t double, kmh double"), spark.createDataFrame(jolt, "recording_id string, t double, ax double, ay double, az double"))
    assert values(found, "t") == [(29.9,)]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(S.date_label(F.lit(None).cast("double"))) == "unknown" and get(S.date_label(F.lit(1785571200.0))) == "2026-08-01"
    assert get(S.format_time(F.lit(75.5))) == "01:15.500"
    assert get(S.iou(F.lit(0.0), F.lit(10.0), F.lit(5.0), F.lit(15.0))) == pytest.approx(1 / 3)
    key = lambda d, s: get(S.clip_key(F.lit("d"), F.lit("r"), F.lit(d), F.lit(s), F.lit("x")))
    assert key(612.4, 10.2) == key(612.0, 9.8) != key(614.0, 9.8)
    assert get(S.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01) and get(S.frame_rate(F.lit("1/0"))) is None
    assert get(S.quarter_turn(F.lit(-90))) == 270 and [get(c) for c in S.recording_parts(F.lit("GX020042.MP4"))] == ["GX", "02", "0042"]


def test_vbo_passes_midnight_and_bears_damage(spark):
    text = "File created on 14/08/2026 at 23:59\n\n[header]\nx\n\n[column names]\nsats time velocity\n\n[data]\n5 235959.50 88.5\n5 000001.00 oops\n"
    got = records.vbo_rows(spark.createDataFrame([("f", text), ("empty", "")], "path string, value string")).orderBy("ordinal").collect()
    assert [r["utc"] for r in got] == [1786751999.5, 1786752001.0] and got[0]["fields"]["velocity"] == 88.5 and got[1]["fields"]["velocity"] is None


def test_klv_and_json_lines(spark):
    import struct

    item = lambda key, kind, size, body: key + bytes([kind, size]) + (len(body) // size).to_bytes(2, "big") + body + b"\0" * (-len(body) % 4)
    blob = item(b"DEVC", 0, 1, item(b"SCAL", ord("l"), 4, struct.pack(">2i", 10, 100)) + item(b"GPS5", ord("l"), 8, struct.pack(">4i", 555, 1320, 556, 1330)) + item(b"GPSU", ord("U"), 16, b"260815094244.950"))
    got = records.klv_rows(spark.createDataFrame([(1, blob), (2, None), (3, blob[:20])], "i int, b binary"), "i", "b")
    assert [list(r["numbers"]) for r in got.where("key = 'GPS5' AND i = 1").orderBy("row").collect()] == [[55.5, 13.2], [55.6, 13.3]]
    assert got.where("key = 'GPSU'").first()["text"] == "260815094244.950"
    line = '{"key": "k", "machine_id": "m", "voted_at": "t", "vote": 1}'
    lines = spark.createDataFrame([(line,), (line,), ('{"key": "k", "vo',), ("",)], "value string")
    assert records.vote_lines(lines, "key string, machine_id string, voted_at string, vote int").count() == 1


def test_bands_of_all_rows_are_no_task_s_alone(spark):
    df = spark.createDataFrame([(i, i * 7 % 50, 1) for i in range(400)], "k long, s long, g int")
    got = rank.bands(df, [], "s", "k")
    want = rank.bands(df, ["g"], "s", "k")
    assert sorted(map(tuple, got.select("k", "band", "third").collect())) == sorted(map(tuple, want.select("k", "band", "third").collect()))
    plan = got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(g" not in plan
    assert rank.bands(df.limit(0), [], "s", "k").collect() == []


def test_a_drained_stream_is_read_from_files(spark, tmp_path):
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).write.parquet(f"{tmp_path}/in/{i}")
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    rows = sessions.drained(spark, source(), "rows_once")
    assert sorted(r["id"] for r in rows.collect()) == list(range(20)) and rows.inputFiles()
    total = sessions.drained(spark, source().groupBy().count(), "counted", "complete")
    assert [r["count"] for r in total.collect()] == [20] and total.inputFiles()


def test_windows_hold_every_event_that_touches_them(spark):
    """A window's width doesn't depend on its event's length, and a window near the start is a second long at least."""
    rows = [("d", 1, 50.0, 52.0, 5.0), ("d", 2, 44.0, 45.0, 1.0), ("d", 3, 0.0, 0.0, 2.0), ("d", 4, 90.0, 99.0, 3.0)]
    e = spark.createDataFrame(rows, "d string, i int, s double, e double, v double")
    found = sorted(tuple(r) for r in moments.clip_windows(e, ["d"], "s", "e", "v", "i", duration=100.0, pad=6.0).select("w_start", "w_end", "w_score", "n_events").collect())
    assert found == [(0.0, 6.0, 2.0, 1), (38.5, 57.0, 5.0, 2), (88.5, 100.0, 3.0, 1)]
    short = moments.clip_windows(e, ["d"], "s", "e", "v", "i", duration=100.0, pad=6.0, max_len=1.0, merge_gap=0.0)
    assert max(r["w_end"] - r["w_start"] for r in short.collect()) <= 1.0


def test_themes_only_suppress_action(spark):
    rows = [(1, "duel", 0.0, 10.0, 1.0), (2, "overtake", 0.0, 10.0, 0.5), (3, "action", 1.0, 9.0, 9.0), (4, "duel", 1.0, 9.0, 0.5), (5, "action", 20.0, 30.0, 1.0)]
    m = spark.createDataFrame([("d", *r) for r in rows], "d string, i int, theme string, a double, b double, v double")
    assert [i for (i,) in values(moments.suppress(m, ["d"], "i", "a", "b", "v", theme="theme", ranks=detect.THEMES), "i")] == [1, 2, 5]


def test_shorts_of_themes_with_enough_moments(spark):
    rows = [(1, "duel", 30.0, 2.0), (2, "duel", 10.0, 1.0), (3, "overtake", 0.0, 9.0), (4, "off_track", 40.0, 0.1)]
    m = spark.createDataFrame([("d", i, t, s, 30.0, v) for i, t, s, v in rows], "d string, i int, theme string, s double, n double, v double")
    got = sorted((r["series"], r["bin"], r["i"], r["place"]) for r in moments.plan_shorts(m, ["d"], "i", "theme", "s", "n", "v", limit=60.0).collect())
    assert set(got) == {
        ("action", 0, 3, 1), ("action", 0, 1, 2), ("action", 1, 2, 1), ("action", 1, 4, 2), ("duel", 0, 2, 1), ("duel", 0, 1, 2), ("off_track", 0, 4, 1)
    }


def test_corners_by_brake_and_lean(spark):
    """Braking, then leaning, then driving on; a whole session sets the levels."""
    acc = [0, 0, -1, -2, 0, 0, 0, 1, 0.1, 0.1, 0, 0]
    lean = [0, 0, 0, 10, 40, 50, 45, 30, 2, 1, 0, 0]
    speed = [90, 100, 95, 80, 60, 50, 55, 70, 80, 90, 95, 99]
    df = spark.createDataFrame([("s", 1, float(k), float(v), float(a), float(n)) for k, (v, a, n) in enumerate(zip(speed, acc, lean))], "s string, lap int, t double, v double, a double, n double")
    (c,) = laps.corners(df, ["s"], "lap", "t", "v", "a", "n", F.lit(True)).collect()
    assert (c["t_start"], c["t_end"], c["before"], c["entry"], c["minimum"], c["max_lean"]) == (3.0, 7.0, 100.0, 60.0, 50.0, 50.0)


def test_labels_do_not_depend_on_the_sessions_zone(spark):
    df = spark.createDataFrame([(1_700_000_000.0, "2023-11-14 23:13:20"), (5.0, "1999-01-01 00:00:00"), (None, "no clock")], "u double, w string")
    shown = df.select(S.date_label(F.col("u")), S.wall_clock(F.col("u")), S.creation_utc(F.col("w")))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = []
        for z in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            seen.append([tuple(r) for r in shown.collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seen[0] == seen[1] == seen[2] == [("2023-11-14", "23:13", 1_700_000_000.0), ("unknown", "00:00", None), ("unknown", None, None)]


def test_many_patterns_match_as_few_do(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["src12", "xsrc1y", "rc", "", None, "aaaa"])], "i int, t string")
    patterns = spark.createDataFrame([("src1", "a"), ("src12", "b"), ("rc", "c"), ("a", "d"), ("aa", "e"), ("", "f")], "pattern string, value string")
    few, many = (sorted(tuple(r) for r in rank.longest_match(df, patterns, "t", "i", few=n).collect()) for n in (100, 0))
    assert few == many == [(0, "src12", "b"), (1, "src1", "a"), (2, "rc", "c"), (5, "aa", "e")]


def test_reasons_are_noted_and_rows_stay(spark):
    df = spark.createDataFrame([(1, 0.9, ["a"]), (2, 0.1, ["b"]), (3, None, None)], "i int, v double, why array<string>")
    out = cascade.with_reason(df, cascade.drop_reason(F.col("v"), F.lit(1), F.lit(0.0), F.lit(False), F.lit("track")))
    assert sorted((r["i"], r["drop_reason"], r["why"]) for r in out.collect()) == [(1, "car in view", ["a", "left out: car in view"]), (2, None, ["b"]), (3, None, None)]


def test_recordings_that_must_not_be_together(spark):
    pieces = spark.createDataFrame([("d", 1, "x"), ("d", 1, "y"), ("d", 2, "x"), ("d", 2, "z")], "d string, m int, recording_id string")
    flagged = spark.createDataFrame([("d", "y", "x")], "d string, a string, b string")
    assert sorted((r["m"], r["recording_id"]) for r in cascade.not_together(pieces, flagged, ["d"], "m").collect()) == [(2, "x"), (2, "z")]


def test_steps_take_groups_from_sorted_rows(spark):
    """A group isn't a pandas frame of its own: the steps that depend on order read a task's sorted rows, group after group."""
    m = spark.createDataFrame([(0, 1, "duel", 0.0, 5.0, 1.0)], "d int, i int, theme string, a double, b double, v double")
    series = lambda v: m.select("d", F.col("i").alias("k"), F.col("v").alias(v))
    made = [
        moments.suppress(m, ["d"], "i", "a", "b", "v"), moments.plan_shorts(m, ["d"], "i", "theme", "a", "b", "v"), moments.pack_next_fit(m, ["d"], "i", "b", "v"), moments.focus(m, ["d"], "a", "theme", "v"),
        moments.smooth_limited(m, ["d"], "a", "i", "v"), moments.cooldown(m, ["d"], "a", "i", 5.0), laps.corners(m, ["d"], "i", "a", "v", "v", "v", F.lit(True)), align.lag_correlation_blocks(series("x"), series("y"), ["d"], "k", "x", "y", 1),
    ]
    for df in made:
        df.collect()
        plan = df._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMap" not in plan


def test_groups_over_several_batches_stay_whole(spark):
    df = spark.createDataFrame([(g, float(n)) for g in (None, 1, 2, 3) for n in range(7)], "g int, x double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = per_rows(df, ["g"], [F.col("x").desc()], ["x"], {"n": "int", "first": "x"}, lambda xs: ([len(xs)], [xs[0]])).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == [(1, 7, 6.0), (2, 7, 6.0), (3, 7, 6.0), (None, 7, 6.0)]
