"""Moments' features and the day's tests, by hand."""

import json
from functools import reduce
from itertools import permutations
from operator import add

import pytest
from pyspark.sql import functions as F

from momentlake.operators import features

MOMENTS = "id int, theme string, utc_start double, utc_end double, score double, why array<string>, segments array<struct<recording_id: string, t_start: double, t_end: double>>"


def moment(i, theme="action", spans=(("A", 0.0, 10.0),), utc=1_700_000_000.0, score=1.0):
    return (i, theme, utc, utc + spans[-1][2] - spans[0][1], score, [], list(spans))


def table(spark, rows, columns):
    return spark.createDataFrame([("A", float(t), *x) for t, *x in rows], f"recording_id string, t double, {columns}")


@pytest.fixture
def ride(spark):
    """150 km/h down to 60 in three seconds, a corner, a rider who grows in the frame; samples outside the moment."""
    return {
        "speeds": table(spark, [(0, 150.0), (1, 120.0), (2, 90.0), (3, 60.0), (4, 60.0), (5, 65.0), (20, 200.0)], "kmh double"),
        "turns": table(spark, [(1, 2.0), (4, -30.0), (5, 25.0), (6, 5.0)], "yaw double"),
        "leans": table(spark, [(4, -48.0), (5, 41.0), (30, 60.0)], "lean double"),
        "action": table(spark, [(t + 0.5, 2 if t > 6 else 1 if t > 2 else 0, 0.0, 0.02 * t if t > 2 else 0.0, False) for t in range(10)], "riders int, kerb double, height double, lamp boolean"),
        "cameras": spark.createDataFrame([("A", "front", True, False)], "recording_id string, facing string, gps boolean, from_log boolean"),
    }


def test_motion_and_riders(spark, ride):
    m = spark.createDataFrame([moment(1)], MOMENTS)
    got = features.measured(m, "id", ride).collect()[0]
    assert (got["speed_max"], got["speed_min"], got["speed_change"]) == (150.0, 60.0, -85.0)
    assert 0.8 < got["brake_g"] < 0.9 and got["accel_g"] > 0
    assert got["turn_rate_max"] == 30 and got["cornering_share"] == 0.5 and got["lean_max"] == 48
    assert got["rider_share"] == 0.7 and got["group_share"] == 0.3 and abs(got["closing"] - 0.02) < 1e-6
    assert (got["pace"], got["pace_from"]) == ("track", "GPS 78 km/h")  # 77.5
    kinds = features.event_types(m, spark.createDataFrame([("A", 9.0, 12.0, "kneepuck"), ("A", 11.0, 12.0, "crash"), ("B", 1.0, 2.0, "off_track"), ("A", 1.0, 2.0, "kerb")], "recording_id string, t_start double, t_end double, type string"), "id")
    told = json.loads(features.moment_features(features.measured(m, "id", ride), "id", kinds).collect()[0]["features"])
    assert told["event_types"] == ["kerb", "kneepuck"] and told["kneepuck"] and told["duration"] == 10.0 and told["pieces"] == 1 and told["cameras"] == ["front"]
    assert told["speed_kmh"] == 77.5 and told["riders"] == 2 and told["own_gps"] and told["hour"] == 23 and "riding_share" not in told


def test_nothing_stored_is_null(spark):
    got = features.measured(spark.createDataFrame([moment(1), moment(2, spans=(("A", 0.0, 1.0),))], MOMENTS), "id", {}).collect()
    assert all(r["speed_max"] is None and r["riders"] is None and r["pace"] is None and r["pace_from"] == "pace not stored" for r in got)
    assert features.measured(spark.createDataFrame([], MOMENTS), "id", {}).count() == 0


def test_pace_by_what_is_known(spark):
    cases = [
        ("slow", "off: off track", {"gate": "off: off track"}), ("track", "GPS 41 km/h", {"gate": "off: off track", "gps": True, "speed_kmh": 41.0}), ("track", "riding 50% of the time", {"riding_share": 0.5, "speed_kmh": 1.0}),
        ("stopped", "riding 10% of the time", {"riding_share": 0.1, "motion": 3.9}), ("slow", "riding 10% of the time", {"riding_share": 0.1, "motion": 4.0}), ("stopped", "log 10 km/h", {"speed_kmh": 9.9, "from_log": True}),
        ("slow", "GPS 10 km/h", {"speed_kmh": 10.0}), ("stopped", "no GPS, the picture stands still", {"motion": 3.0, "unplaced": "slow"}), ("slow", "no GPS, not placed on the log", {"motion": 12.0, "unplaced": "slow"}),
        ("track", "no GPS, a rider in view while the picture streams past (motion 12)", {"motion": 12.0, "riders": 1}), ("slow", "no GPS, log or bike in view says track", {"motion": 12.0, "riders": 0}), (None, "pace not stored", {}),
    ]
    names = ["gate", "gps", "riding_share", "speed_kmh", "from_log", "motion", "riders", "unplaced"]
    df = spark.createDataFrame([tuple(c[2].get(n) for n in names) + c[:2] for c in cases], "gate string, gps boolean, riding_share double, speed_kmh double, from_log boolean, motion double, riders int, unplaced string, want string, text string")
    kind, why = features.pace()
    got = df.select(kind.alias("k"), why.alias("w"), "want", "text").collect()
    assert [(r["k"], r["w"]) for r in got] == [(r["want"], r["text"]) for r in got]


def day(spark, rows, lengths=None):
    columns = "vehicle_share double, red_lamp boolean, riders int, kerb_share double, action_density double, pace string, pace_from string"
    df = spark.createDataFrame([(*m, *x) for m, x in rows], f"{MOMENTS}, {columns}")
    recordings = None if lengths is None else spark.createDataFrame(lengths, "recording_id string, duration double")
    return lambda **k: {r["id"]: r for r in features.day_moments(df, recordings, **k).collect()}


def test_a_days_tests_in_their_order(spark):
    fast, slow, still = ("track", "GPS 90 km/h"), ("slow", "GPS 30 km/h"), ("stopped", "GPS 1 km/h")
    run = day(spark, [
        (moment(1), (0.4, True, 0, 0.0, 0.1, *still)), (moment(2, "crash"), (0.9, True, 0, 0.0, 0.1, *still)), (moment(3), (0.39, True, 0, 0.24, 0.1, *still)), (moment(4), (None, False, 1, 0.0, 1.0, *still)),
        (moment(5, "own_off_track"), (None, False, 0, 0.0, 0.7, *slow)), (moment(6, "kneepuck"), (None, False, 0, 0.25, 1.0, *fast)), (moment(7), (None, None, None, None, None, None, "pace not stored")),
        (moment(8, "duel"), (None, False, 3, 0.0, 2.0, "slow", "no bridge for 100 s or more: off track")), (moment(9), (0.1, True, 1, 0.0, 1.0, *fast)),
    ])
    got = run()
    assert {i: r["drop_reason"] for i, r in got.items()} == {
        1: "car in view (paddock)", 2: None, 3: "no rider or kerb in view", 4: "standing still", 5: "not on track (below 40 km/h or unknown)", 6: None, 7: None, 8: "off track by the bridges", 9: None,
    }
    assert got[1]["why"] == ["left out: car in view (paddock)"] and got[1]["score"] == 1.0
    assert got[2]["why"] == ["0 rider(s) in view", "no pace check for this theme"] and got[2]["score"] == 1.0
    assert got[3]["why"] == ["0 rider(s) in view", "left out: no rider or kerb in view"]
    assert got[6]["why"] == ["0 rider(s) in view, kerb close by", "action 2.0/s", "GPS 90 km/h"] and got[6]["score"] == pytest.approx(2.6)
    assert got[8]["score"] == pytest.approx(3.0) and got[7]["why"] == ["pace not stored"]
    lamps = run(lamps=True)
    assert lamps[9]["drop_reason"] == "red signal lamp (session over)" and lamps[1]["drop_reason"] == "car in view (paddock)"
    free = run(least_kmh=0, most_vehicles=0)
    assert free[1]["drop_reason"] == "no rider or kerb in view" and free[4]["drop_reason"] is None and free[4]["why"] == ["1 rider(s) in view", "action 1.0/s"]


def test_pieces_are_widened_inside_their_recording(spark):
    seen = (None, False, 1, 0.0, 1.0, "track", "GPS 90 km/h")
    run = day(spark, [(moment(1, spans=(("A", 1.0, 3.0),)), seen), (moment(2, spans=(("A", 18.0, 19.0), ("B", 5.0, 25.0))), seen), (moment(3, spans=(("C", 0.0, 3.0),)), seen), (moment(4, spans=(("D", 50.0, 52.0),)), seen)], [("A", 20.0), ("B", 30.0), ("C", 7.9)])
    got = run()
    spans = {i: [tuple(s) for s in r["segments"]] for i, r in got.items()}
    assert spans == {1: [("A", 0.0, 8.0)], 2: [("A", 12.0, 20.0), ("B", 5.0, 25.0)], 3: [("C", 0.0, 3.0)], 4: [("D", 47.0, 55.0)]}
    assert got[3]["drop_reason"] == "recording shorter than 8 s" and got[3]["why"][-1] == "left out: recording shorter than 8 s"
    base = 1_700_000_000.0
    assert (got[1]["utc_start"] - base, got[1]["utc_end"] - base) == (-1.0, 7.0) and (got[2]["utc_start"] - base, got[2]["utc_end"] - base) == (-6.0, 7.0)


def test_bridges_and_unplaced_clocks(spark):
    m = spark.createDataFrame([moment(1, spans=(("A", 0.0, 10.0),)), moment(2, spans=(("Z", 0.0, 1.0), ("A", 100.0, 110.0))), moment(3, spans=(("A", 300.0, 310.0),)), moment(4, spans=(("B", 0.0, 5.0),)), moment(5, spans=(("Z", 0.0, 5.0),))], MOMENTS)
    on = spark.createDataFrame([("A", [(90.0, 120.0), (200.0, 210.0)]), ("B", [])], "recording_id string, spans array<struct<lo: double, hi: double>>")
    assert {r["id"]: r["gate"] for r in features.bridge_gate(m, on, "id").collect()} == {1: "before the first bridge pass (90 s): off track", 3: "no bridge for 100 s or more: off track", 4: "no bridge passed in the recording: off track"}
    guesses = spark.createDataFrame([("A", 0.0), ("A", 7200.0), ("B", 0.0)], "recording_id string, shift double")
    log = spark.createDataFrame([(1_700_007_200.0, 50.0), (1_700_000_000.0, 3.0)], "utc double, kmh double")
    assert {r["id"]: r["unplaced"] for r in features.unplaced_pace(m, guesses, log, "id").collect()} == {1: "slow", 2: "slow", 3: "slow", 4: "stopped"}
    assert features.run_up(m.withColumn("theme", F.lit("own_off_track"))).where("id = 3").collect()[0]["segments"][0][1:] == (299.0, 305.0)


def test_means_are_summed_in_time(spark):
    """Shares on the limit (0.4) don't hang on the order in which rows come: doubles are added in order of time."""
    values = [x / 11 for x in (5, 5, 5, 1, 6)]
    added = lambda vs: reduce(add, vs, 0.0) / 5
    assert added(values) < 0.4 <= added(values[::-1])
    orders = list(enumerate(permutations(range(5))))
    moments = spark.createDataFrame([(n, 0, str(n), 0.0, 60.0) for n, _ in orders], "i int, piece int, recording_id string, t_start double, t_end double")
    samples = spark.createDataFrame([(str(n), float(t), values[t]) for n, order in orders for t in order], "recording_id string, t double, share double")
    assert {r["s"] for r in features.piece_share(moments, samples, "i", "share", "s").collect()} == {added(values)}
