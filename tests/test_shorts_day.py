"""A day's stages by hand: clocks, crashes, cameras kept apart, plans, and what is stored."""

import json

from pyspark.sql import functions as F

from momentlake.operators import detect, shorts

PIECES = "array<struct<recording_id: string, t_start: double, t_end: double>>"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_clocks_and_facing(spark):
    recs = spark.createDataFrame([("d", "b", None, "", "rear_left"), ("d", "a", None, None, "rear_right"), ("d", "c", 5.0, "rear", "front"), ("e", "x", None, "front", "rear")], "day string, id string, start double, seen string, profile string")
    got = {r["id"]: (r["offset"], r["f"]) for r in shorts.day_clock(recs, ["day"], "id", "start").withColumn("f", shorts.facing(F.col("seen"), F.col("profile"))).collect()}
    assert got == {"a": (0.0, "rear"), "b": (1e6, "front"), "c": (5.0, "rear"), "x": (0.0, "front")}


def test_day_bounds_over_a_change_of_clocks(spark):
    first, last = shorts.day_bounds(F.col("t"))
    got = spark.createDataFrame([(1774785600.0,), (1761480000.0,), (None,)], "t double").select((last - first).alias("n"), ((F.col("t") >= first) & (F.col("t") <= last)).alias("inside")).collect()  # the last Sundays of March 2026 and October 2025
    assert [(None if r["n"] is None else round(r["n"], 3), r["inside"]) for r in got] == [(23 * 3600 - 0.001, True), (25 * 3600 - 0.001, True), (None, None)]


def test_paced_span(spark):
    lo, hi = shorts.paced_span(F.col("k"), F.col("a"), F.col("b"))
    assert rows(spark.createDataFrame([("own_off_track", 10.0, 12.0), ("own_off_track", 2.0, 3.0), ("duel", 1.0, 2.0)], "k string, a double, b double").select("k", lo, hi)) == [("duel", 1.0, 2.0), ("own_off_track", 0.0, 2.0), ("own_off_track", 4.0, 10.0)]


def test_touching_sessions_do_not_overlap(spark):
    a = spark.createDataFrame([("r", 1, 0.0, 10.0), ("r", 2, 20.0, 20.0)], "r string, i int, s0 double, s1 double")
    b = spark.createDataFrame([("r", 1, 10.0, 30.0), ("r", 2, -5.0, 0.1), ("r", 3, -5.0, 0.0), ("q", 4, 0.0, 10.0), ("r", 5, -100.0, 100.0)], "r string, j int, e0 double, e1 double")
    assert rows(shorts.sessions_overlapping(a, b, ["r"], "s0", "s1", "e0", "e1", width=7.0), "i", "j") == [(1, 2), (1, 5)]


def test_a_crash_that_rides_on_is_none(spark):
    crashes = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 10.0), ("d", 10.0)], "recording_id string, t double")
    motion = spark.createDataFrame([(r, 10.0 + s, m) for r, ms in {"a": [12, 12, 12], "b": [12, 12], "c": [12, 9, 9]}.items() for s, m in zip((3, 6, 10), ms)], "recording_id string, t double, motion int")
    assert rows(shorts.stopped_crashes(crashes, motion), "recording_id") == [("b",), ("c",), ("d",)]


def test_one_moment_for_a_crash_of_several_cameras(spark):
    felt = [("d", "A", "rear", 10.0, 100.0), ("d", "B", "front", 14.0, 101.0), ("d", "C", "front", 16.0, 101.0), ("d", "D", "rear", 30.0, 100.5), ("d", "E", "rear", 2.0, 500.0), ("e", "F", "rear", 3.0, 0.0)]
    got = shorts.crash_moments(spark.createDataFrame(felt, "day string, recording_id string, facing string, t double, offset double"), ["day"]).collect()
    # A at 104 gives way to B at 109; C at 111 is B's; D at 124.5 lies 15.5 after B.
    assert sorted((r["day"], r["segments"][0][0], r["utc_start"], r["utc_end"], r["theme"], r["score"]) for r in got) == [
        ("d", "B", 109.0, 119.0, "crash", 10.0), ("d", "D", 124.5, 134.5, "crash", 10.0), ("d", "E", 500.0, 506.0, "crash", 10.0), ("e", "F", 0.0, 7.0, "crash", 10.0),
    ]


def test_cameras_that_do_not_belong_together(spark):
    m = spark.createDataFrame(
        [("d", 1, 0.0, 30.0, ["x"], [("A", 0.0, 5.0), ("B", 3.0, 9.0)]), ("d", 2, 50.0, 80.0, [], [("B", 50.0, 55.0), ("A", 51.0, 60.0)]), ("d", 3, 50.0, 80.0, [], [("A", 50.0, 55.0), ("C", 51.0, 60.0)]), ("d", 4, 9.0, 80.0, [], [("C", 5.0, 55.0), ("A", 51.0, 60.0), ("B", 1.0, 2.0)]), ("e", 5, 0.0, 30.0, [], [("A", 0.0, 5.0), ("B", 3.0, 9.0)])],
        f"day string, id int, utc_start double, utc_end double, why array<string>, segments {PIECES}",
    )
    spans = spark.createDataFrame([("d", "A", 4.0, 20.0), ("d", "C", 55.0, 60.0)], "day string, recording_id string, t_start double, t_end double")
    offsets = spark.createDataFrame([("d", "A", 1000.0), ("d", "B", 2000.0)], "day string, recording_id string, offset double")
    got = {r["id"]: r for r in shorts.apart(m, spans, offsets, ["day"], "id").collect()}
    assert {i: [s[0] for s in r["segments"]] for i, r in got.items()} == {1: ["A"], 2: ["B"], 3: ["A", "C"], 4: ["C", "A", "B"], 5: ["A", "B"]}
    assert got[1]["utc_end"] == 1005.0 and got[1]["why"] == ["x", "left out camera B: not together (rated)"] and got[2]["utc_end"] == 2055.0
    assert got[3]["utc_end"] == 80.0 and got[4]["why"] == []


def test_plan_and_repeats(spark):
    m = spark.createDataFrame(
        [(("d"), i, t, float(a), float(b), s, [("A", float(a), float(b))], r) for i, t, a, b, s, r in [(1, "duel", 0, 10, 5.0, None), (2, "duel", 1, 11, 4.0, None), (3, "action", 2, 9, 9.0, None), (4, "duel", 40, 50, 1.0, None), (5, "action", 70, 80, None, None), (6, "crash", 0, 10, 1.0, "standing still")]],
        f"day string, id int, theme string, utc_start double, utc_end double, score double, segments {PIECES}, drop_reason string",
    )
    plan, every = shorts.build(m, ["day"], "id", limit=20.0)
    assert rows(every, "id", "drop_reason") == [(1, None), (2, "repeat"), (3, "repeat"), (4, None), (5, None), (6, "standing still")]
    assert rows(plan, "series", "bin", "id", "place") == [("action", 0, 1, 1), ("action", 0, 4, 2), ("action", 1, 5, 1), ("duel", 0, 1, 1), ("duel", 0, 4, 2)]
    told = json.loads(shorts.stored(every.withColumn("why", F.array(F.lit("w"))), ["day"]).collect()[0]["json"])
    assert [x["theme"] for x in told["moments"]] == ["duel", "duel", "action"] and [x["drop_reason"] for x in told["left_out"]] == ["standing still", "repeat", "repeat"]
    assert told["moments"][0]["pieces"] == [{"recording_id": "A", "t_start": 0.0, "t_end": 10.0}]


def test_events_as_json(spark):
    e = spark.createDataFrame([("A", "duel", "7", 1.23456, 2.0, 0.123456, {"k": "v"}), ("A", "action", None, 0.5, 1.0, 1.0, {})], "recording_id string, type string, track_id string, t_start double, t_end double, score double, extra map<string,string>")
    clips = spark.createDataFrame([("A", 3.0, ("a.mp4",)), ("B", 1.0, ("b.mp4",))], "recording_id string, t_start double, clip struct<path: string>")
    got = {r["recording_id"]: json.loads(r["json"]) for r in shorts.events_json(e, clips).collect()}
    assert got["A"]["events"] == [{"type": "action", "t_start": 0.5, "t_end": 1.0, "score": 1.0, "recording_id": "A", "extra": {}}, {"type": "duel", "t_start": 1.235, "t_end": 2.0, "score": 0.1235, "recording_id": "A", "track_id": "7", "extra": {"k": "v"}}]
    assert got["A"]["clips"] == [{"path": "a.mp4"}] and got["B"] == {"events": [], "clips": [{"path": "b.mp4"}]}
    assert json.loads(shorts.events_json(e).collect()[0]["json"])["clips"] == []


def test_files_and_facets(spark):
    files = spark.createDataFrame([("k", "vertical", "/v1", 5, 9), ("k", "short", "/s2", 5, 9), ("k", "short", "/s1", 5, 9), ("k", "short", "/s3", 5, 8), ("m", "other", "/o", 1, 1), ("m", "poster", "/p", 1, 1)], "key string, kind string, path string, size int, changed int")
    assert rows(shorts.shown_files(files, ["key"]), "path") == [("/o",), ("/s1",), ("/s3",)]
    clips = spark.createDataFrame([("2", "duel"), ("1", "duel"), ("1", "crash")], "day string, theme string")
    votes = spark.createDataFrame([(["zeta", "good"],), (None,), (["alpha"],)], "tags array<string>")
    assert rows(shorts.facets(clips, votes, ["good", "best"])) == [(["1", "2"], ["crash", "duel"], ["good", "best", "alpha", "zeta"])]


def test_riders_are_bikes_with_someone_on(spark):
    def box(t, track, cls, x, y, w, h):
        return ("A", track, float(t), x - w / 2, x + w / 2, y - h / 2, y + h / 2, 1000, 1000, cls)

    data = [box(t / 5, 1, 3, 500, 500, 100, 200) for t in range(10)] + [box(t / 5, 2, 0, 500, 440, 60, 120) for t in range(3)]
    data += [box(t / 5, 3, 3, 200, 500, 100, 300) for t in range(10)] + [box(t / 5, 4, 0, 260, 560, 60, 120) for t in range(10)]  # beside, and too low
    data += [box(t / 5, 5, 3, 800, 500, 50, 100) for t in range(5)] + [box(t / 5, 6, 0, 800, 470, 30, 60) for t in range(5)]
    df = spark.createDataFrame(data, "recording_id string, track_id int, t double, x1 double, x2 double, y1 double, y2 double, frame_w int, frame_h int, cls int")
    assert {r["track_id"]: round(r["share"], 2) for r in detect.mounted(df).collect()} == {1: 0.3, 3: 0.0, 5: 1.0}
    assert [(k, round(h, 3), n) for _, k, h, n in rows(detect.nearest_rider(df))] == [(0, 0.2, 2), (1, 0.2, 1)]
