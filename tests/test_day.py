"""Alignment, telemetry, linking, incidents, votes and change files, by hand, by numpy or by brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlake.operators import align, detect, incidents, linking, moments, mount, series, telemetry, votes
from momentlake.operators.common import framed_means
from momentlake.sources import records, tail
from momentlake.streaming import sessions as streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# ---- clocks

CLOCKS = "day string, id long, s double, e double, fixes int, logged double"


def test_offsets_follow_chains_from_the_reference(spark):
    clocks = spark.createDataFrame(
        [("a", 1, 0.0, 100.0, 5, None), ("a", 2, 50.0, 150.0, 9, None), ("a", 3, 120.0, 300.0, 1, None), ("a", 4, 140.0, 310.0, None, None), ("a", 5, 310.0, 320.0, 3, None), ("b", 6, 0.0, 50.0, 0, 2.5), ("b", 7, 20.0, 70.0, 99, None), ("b", 8, 65.0, 90.0, 1, None)],
        CLOCKS,
    )
    measured = spark.createDataFrame([(1, 2, 1.0), (2, 1, 9.0), (3, 2, -0.5), (4, 3, 2.0), (2, 4, 7.0), (6, 7, 1.0), (7, 8, 4.0), (6, 7, 3.0)], "a long, b long, shift double")
    got = {r["id"]: r for r in align.align(clocks, measured, ["day"], "id", "s", "e", "fixes", "logged").collect()}
    assert {i: r["outing"] for i, r in got.items()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0, 8: 0}  # 5 only touches 4
    assert {i: (r["reference"], r["source"], r["offset"], r["path"]) for i, r in got.items()} == {
        1: (2, "pairs", 9.0, [2, 1]), 2: (2, "reference", 0.0, [2]), 3: (2, "pairs", 0.5, [2, 3]), 4: (2, "pairs", 7.0, [2, 4]), 5: (5, "reference", 0.0, [5]),
        6: (6, "log", 2.5, [6]), 7: (6, "pairs", 3.5, [6, 7]), 8: (6, "clock", 0.0, [8]),  # 7 and 8 overlap for five seconds only
    }
    none = align.align(clocks.limit(0), measured, ["day"], "id", "s", "e", "fixes", "logged")
    assert none.count() == 0


def test_first_source_that_accepts_wins(spark):
    recs = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None), (None, True)], "id long, ok boolean")
    a = spark.createDataFrame([(1, 5.0, "fine"), (2, None, "too few"), (3, None, "too few"), (2, None, "a few")], "id long, start double, reason string")
    b = spark.createDataFrame([(1, 6.0, "late"), (2, 7.0, "line"), (3, 8.0, "line"), (4, 8.0, "line")], "id long, start double, reason string")
    got = {r["id"]: tuple(r)[1:] for r in align.placed(recs, "id", [("gps", a, None), ("line", b, F.col("ok")), ("motion", b.limit(0), None)]).collect()}
    assert got == {
        1: ("gps", 5.0, "fine", []), 2: ("line", 7.0, "line", ["gps: a few"]), 3: ("clock", None, None, ["gps: too few", "motion: nothing found"]), 4: ("clock", None, None, ["gps: nothing found", "motion: nothing found"]),
        None: ("clock", None, None, ["gps: nothing found", "line: nothing found", "motion: nothing found"]),
    }


def landmarks_by_hand(p, marks, guesses, search, tol, rival_s):
    p, marks = sorted(set(p)), sorted(set(marks))
    marks = [u for u in marks if min(guesses) - search + p[0] - 1 <= u <= max(guesses) + search + p[-1] + 1]
    tries = [(u - t, t, u) for t in p for u in marks if any(abs(u - t - g) <= search for g in guesses)]
    if not tries:
        return None
    scored = []
    for s, t, u in tries:
        near = [(min((abs(q + s - m), m) for m in marks), q) for q in p]
        near = [(d, m, q) for (d, m), q in near if d <= tol]
        scored.append((-len(near), round(sum(d for d, _, _ in near) / len(near), 6), t, u, s, [m - q for _, m, q in near]))
    best = min(scored)
    rival = max([-x[0] for x in scored if abs(x[4] - best[4]) > rival_s], default=0)
    start = float(np.median(best[5]))
    ok = -best[0] >= 2 and not (rival >= 2 and -best[0] < rival + 1)
    return -best[0], len(p), rival, round(start, 6) if ok else None, round(max(abs(x - start) for x in best[5]), 6)


def test_landmarks_by_residuals(spark):
    rng = random.Random(7)
    laps = np.cumsum([90 + rng.uniform(-2, 2) for _ in range(12)])
    cases = {
        1: ([float(x) + rng.uniform(-0.05, 0.05) for x in laps[3:9]], [float(x) + 1000 for x in laps], [1010.0]),
        2: ([10.0], [1012.0], [1000.0]),  # one pair proves nothing
        3: ([0.0, 100.0], [1000.0, 1100.0, 1200.0], [1000.0]),  # two starts do as well
        4: ([0.0, 50.149], [1000.0, 1049.851, 1050.3], [1000.0]),  # bins would part pairs that residuals join
        5: ([0.0, 7.0], [5000.0], [0.0]),
        6: ([5.0, 5.0, 60.0], [105.1, 160.2, 160.2], [100.0, 130.0]),
    }
    p = spark.createDataFrame([(r, x) for r, (ps, _, _) in cases.items() for x in ps] + [(9, None)], "r int, t double")
    m = spark.createDataFrame([(r, x) for r, (_, ms, _) in cases.items() for x in ms], "r int, u double")
    g = spark.createDataFrame([(r, x) for r, (_, _, gs) in cases.items() for x in gs], "r int, g double")
    got = {r["r"]: (r["n"], r["passes"], r["rival"], None if r["start"] is None else round(r["start"], 6), round(r["spread"], 6)) for r in align.landmark_match(p, m, g, ["r"], "t", "u", "g").collect()}
    want = {r: x for r, c in cases.items() if (x := landmarks_by_hand(*c, 180.0, 0.3, 1.0))}
    assert got == want
    assert abs(got[1][3] - 1000) < 0.1 and got[2][3] is None and got[3][3] is None and 5 not in got


def test_blocks_of_lags_are_the_exploded_ones(spark):
    rng = np.random.default_rng(1)
    a = [("u", int(k), float(v)) for k, v in zip(range(-300, 700), rng.standard_normal(1000) + 1e6) if rng.random() < 0.9]
    b = [("u", k - 13, v + 0.3 * rng.standard_normal()) for _, k, v in a if rng.random() < 0.8] + [("w", 0, 1.0), ("w", 1, 1.0)]
    left, right = spark.createDataFrame(a + [("w", 0, 2.0), ("w", 1, 3.0), ("w", 5, None)], "g string, k long, a double"), spark.createDataFrame(b, "g string, k long, b double")
    found = align.lag_correlation_blocks(left, right, ["g"], "k", "a", "b", 20, block=128)
    slow = series.lag_correlation(right, left, ["g"], "k", "b", "a", 20)
    shape = lambda df: {(r["g"], r["lag"]): (None if r["r"] is None or math.isnan(r["r"]) else round(r["r"], 6), r["n"]) for r in df.collect()}
    got, want = shape(found), shape(slow)
    assert {k: v for k, v in got.items() if k[0] == "u"} == {k: v for k, v in want.items() if k[0] == "u"} and len(got) > 41
    assert all(v[0] is None for k, v in got.items() if k[0] == "w")
    best = align.best_lag(found, ["g"], 3).collect()
    assert [(r["g"], r["lag"], r["accepted"]) for r in best] == [("u", 13, True)]
    assert best[0]["runner_up"] == max(v[0] for (g, lag), v in want.items() if g == "u" and abs(lag - 13) > 3) or abs(best[0]["runner_up"]) < 0.2


def test_sound_gives_the_lag(spark):
    rng = np.random.default_rng(2)
    rate, hz = 400, 50
    loud = np.repeat(np.exp(rng.standard_normal(900)), rate // hz) * rng.standard_normal(7200)
    series_of = lambda x, name: spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "g int, n long, x double").transform(lambda df: align.envelope(df, ["g"], "n", "x", rate=rate, hz=hz))
    found = align.sound_lag(series_of(loud[: 800 * 8], "a"), series_of(loud[160 : 800 * 8], "b"), ["g"], hz=hz).collect()
    assert [(round(r["seconds"], 3), r["accepted"]) for r in found] == [(0.4, True)]
    level = np.log(np.sqrt((loud[: 50 * 5 * 8].reshape(-1, 8) ** 2).mean(axis=1)) + 1e-4)
    want = level - np.convolve(level, np.ones(50) / 50, mode="same")
    got = [r["level"] for r in series_of(loud[: 50 * 5 * 8 + 3], "c").orderBy("k").collect()]
    assert np.allclose(got, want)
    assert series_of(loud[:100], "d").count() == 0


# ---- telemetry


def test_frames_of_a_width_by_group(spark):
    df = spark.createDataFrame([(g, n + 1, float(n * n) if n != 2 else None, g) for g in (1, 2, 3, 9) for n in range(6)], "g int, n int, x double, k int")
    got = {(r["g"], r["n"]): r["x"] for r in framed_means(df, ["g"], "n", F.col("k"), ["x"]).collect()}
    for g in (1, 2, 3, 9):
        for n in range(6):
            inside = [float(m * m) for m in range(max(0, n - g // 2), min(6, n + g - g // 2)) if m != 2]
            assert got[g, n + 1] is None if not inside else abs(got[g, n + 1] - np.mean(inside)) < 1e-9


def yaw_by_numpy(t, lat, lon, kmh, smooth):
    def mean(x, k):
        return x if k <= 1 else np.convolve(x, np.ones(k), mode="same") / np.convolve(np.ones(len(x)), np.ones(k), mode="same")

    k = max(1, int(round(smooth * len(t) / (t[-1] - t[0]))))
    north = mean((lat - np.median(lat)) * 111_320.0, k)
    east = mean((lon - np.median(lon)) * 111_320.0 * np.cos(np.radians(np.median(lat))), k)
    heading = np.unwrap(np.arctan2(np.gradient(east, t), np.gradient(north, t)))
    yaw = np.degrees(np.gradient(heading, t))
    yaw[kmh < 15] = 0
    return mean(yaw, k)


def test_yaw_of_laps(spark):
    rng = np.random.default_rng(3)
    data, want = [], {}
    for g, rate in ((1, 10), (2, 4), (3, 1)):
        t = np.cumsum(rng.uniform(0.5, 1.5, 200)) / rate
        angle = t / 5
        lat, lon = 56 + 0.001 * np.sin(angle) + 1e-6 * rng.standard_normal(200), 10 + 0.002 * np.cos(angle)
        kmh = rng.uniform(10, 100, 200)
        want[g] = yaw_by_numpy(t, lat, lon, kmh, 1.0)
        data += [(g, i, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(t, lat, lon, kmh))]
    data += [(4, 0, 0.0, 56.0, 10.0, 50.0), (4, 1, 1.0, 56.1, 10.0, 50.0), (5, 0, 1.0, 56.0, None, 50.0)]
    df = spark.createDataFrame(data, "g int, i int, t double, lat double, lon double, v double")
    got = telemetry.yaw_rates(df, ["g"], "t", "i", "lat", "lon", "v").orderBy("g", "t").collect()
    for g in want:
        assert np.allclose([r["yaw"] for r in got if r["g"] == g], want[g], atol=1e-4)
    assert [r["yaw"] for r in got if r["g"] == 4] == [0.0, 0.0] and not [r for r in got if r["g"] == 5]


def test_a_right_hand_bend_is_positive(spark):
    df = spark.createDataFrame([(1, i, i / 10, 56 + 1e-4 * math.sin(i / 30), 10 - 2e-4 * math.cos(i / 30), 60.0) for i in range(100)], "g int, i int, t double, lat double, lon double, v double")
    mid = [r["yaw"] for r in telemetry.yaw_rates(df, ["g"], "t", "i", "lat", "lon", "v").orderBy("t").collect()][20:80]
    assert all(5 < y < 40 for y in mid)


def test_samples_between_stamps(spark):
    packets = spark.createDataFrame([(1, 0, None, ["x"]), (1, 1, 10.0, ["a", "b"]), (1, 2, 11.0, ["c", "d", "e", "f"]), (1, 3, 15.0, []), (1, 4, 20.0, ["g", "h"]), (1, 5, 19.0, ["i"])], "g int, o int, s double, p array<string>")
    got = [(r["point"], r["utc"]) for r in telemetry.spread(packets, ["g"], "o", "s", "p").orderBy("o", "place").collect()]
    assert got == [("a", 10.0), ("b", 10.5), ("c", 11.0), ("d", 11.25), ("e", 11.5), ("f", 11.75), ("g", 20.0), ("h", 20.5), ("i", 19.0)]
    assert rows(telemetry.start_by_stamps(packets, ["g"], "o", "s")) == [(1, 9.0)]
    long = spark.createDataFrame([(1, 12.0)], "g int, duration double")
    assert rows(telemetry.start_by_stamps(packets, ["g"], "o", "s", long)) == [(1, 8.0)]
    assert rows(telemetry.start_by_stamps(packets.withColumn("s", F.lit(None).cast("double")), ["g"], "o", "s")) == []


def test_packet_stamps(spark):
    texts = [("240815093001.250", 1723714201.25), ("240815093001", 1723714201.0), (" 240815093001.5 ", 1723714201.5), ("150101000000.000", None), ("241315093001", None), ("x", None), ("", None), (None, None)]
    got = spark.createDataFrame(texts, "s string, want double").select(telemetry.packet_stamp(F.col("s")).alias("at"), "want").collect()
    assert [r["at"] for r in got] == [r["want"] for r in got]


def test_along_track_inverts_the_way(spark):
    rng = np.random.default_rng(4)
    t = np.arange(300) / 10
    step = rng.uniform(0, 1e-5, 300) * (rng.random(300) < 0.8)  # stands still now and then
    lat, lon = 56 + np.cumsum(step), 10 + 0.5 * np.cumsum(step)
    asked = [(k, float(x)) for k, x in enumerate([0.33, 5.0, 12.345, 29.0, -3.0, 99.0])]
    way = np.r_[0, np.cumsum(np.hypot(np.diff(lat) * 111_320, np.diff(lon) * 111_320 * np.cos(np.radians(np.median(lat)))))]
    want = {k: float(np.interp(goal, way, t)) for k, c in asked if (goal := float(np.interp(c, t, way)) + 20) <= way[-1]}
    for scale in (1.0, 60.0):  # degrees, and minutes
        df = spark.createDataFrame([(1, float(a), float(b * scale), float(c * scale)) for a, b, c in zip(t, lat, lon)], "g int, t double, lat double, lon double")
        lon_too = df.withColumn("lon", F.col("lon") / (scale if scale > 1 else 1.0)) if scale > 1 else df
        crossings = spark.createDataFrame([(1, k, c) for k, c in asked] + [(2, 9, 1.0), (1, 8, None)], "g int, k int, c double")
        got = {r["k"]: r["utc"] for r in telemetry.along_track(lon_too, crossings, ["g"], "t", "lat", "lon", "c", "k", 20.0).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


# ---- linking


def passes_by_hand(hits, fps, gap):
    frames = sorted({(f, t) for f, t, *_ in hits})
    at = {f: [h for h in hits if h[0] == f] for f, _ in frames}
    lag = max(1, round(0.2 * fps))
    tracks = []
    for f, t in frames:
        still = lambda h: any(abs(h[2] - o[2]) <= 0.015 and abs(h[3] - o[3]) <= 2 for side in (f - lag, f + lag) for o in at.get(side, []))  # noqa: B023, E731
        used = []
        for h in sorted((h for h in at[f] if not still(h)), key=lambda h: (-h[2], -h[4])):
            open_ = [x for x in tracks if x not in used and t - x[-1][1] <= gap and x[-1][2] <= h[2] + 0.02]
            if open_:
                best = max(x[-1][2] for x in open_)
                track = [x for x in open_ if x[-1][2] == best][-1]
                track.append(h)
            else:
                track = [h]
                tracks.append(track)
            used.append(track)
    return sorted((round(x[-1][1] + 0.5 / fps, 6), x[-1][2], max(h[4] for h in x)) for x in tracks if len(x) >= 2 and x[-1][2] - x[0][2] >= 0.015)


def test_lines_are_followed(spark):
    rng = random.Random(11)
    data = []
    for r in range(4):
        for f in range(60):
            data += [(r, f, f / 25, round(rng.choice([0.4, 0.5, 0.7]) + (f % 12) / 30, 3), float(rng.choice([0, 2, 8])), rng.random()) for _ in range(rng.randrange(4))]
        data += [(r, f, f / 25, 0.95, 0.0, 0.5) for f in range(60)]  # the bike's own
    df = spark.createDataFrame(data, "r int, f int, t double, row double, angle double, run double")
    got = linking.line_passes(df.repartition(5), ["r"], "f", "t", "row", "angle", "run", fps=25.0)
    for r in range(4):
        mine = sorted((round(x["t"], 6), x["row"], x["run"]) for x in got.where(F.col("r") == r).collect())
        assert mine == passes_by_hand([h[1:] for h in data if h[0] == r], 25.0, 0.13) and mine
    assert linking.line_passes(df.limit(0), ["r"], "f", "t", "row", "angle", "run", fps=25.0).count() == 0


def test_an_edge_leaves_the_top_once(spark):
    rising = [(1, f, f / 12.5, 0.5 - 0.04 * f, 0.0, 0.4) for f in range(12)]  # to 0.06, then gone
    own = [(1, f, f / 12.5, 0.3, 0.0, 0.9) for f in range(40)]
    falling = [(1, 20 + f, (20 + f) / 12.5, 0.1 + 0.04 * f, 9.0, 0.4) for f in range(8)]
    again = [(1, 12 + f, (12 + f) / 12.5, 0.4 - 0.1 * f, 3.0, 0.4) for f in range(4)]  # half a second later at most
    df = spark.createDataFrame(rising + own + falling + again, "r int, f int, t double, row double, angle double, run double").withColumn("last", F.lit(40))
    got = linking.edge_passes(df, ["r"], "f", "t", "row", "angle", "run", "last", fps=12.5)
    assert [(r, round(t, 3)) for r, t in rows(got)] == [(1, round(11 / 12.5 + 0.04, 3))]


def test_cooldowns_agree(spark):
    hits = spark.createDataFrame([(1, float(t)) for t in (0, 5, 6, 11, 16, 30)], "d int, t double")
    for strict, want in ((False, [0, 5, 11, 16, 30]), (True, [0, 6, 16, 30])):
        assert [t for _, t in sorted(rows(moments.cooldown(hits, ["d"], "t", "t", 5.0, strict)))] == want


# ---- incidents

BOX = "recording_id int, track_id int, t double, x1 double, x2 double, y1 double, y2 double, frame_w int, frame_h int, cls int, offtrack double"


def box(t, w, h, track=1, cls=3, off=0.0, x=500.0, y=500.0, rec=1):
    return (rec, track, float(t), x - w / 2, x + w / 2, y - h / 2, y + h / 2, 1000, 1000, cls, off)


def spans_by_hand(points):
    out, run, was = [], [], False
    for p in [*points, None]:
        if p is not None and p[10] >= 0.5:
            run.append(p[2])
            continue
        if was and len(run) >= 3:
            out.append((run[0], run[-1]))
        run = []
        was = was or (p is not None and p[10] < 0.2)
    return out


def test_off_track_needs_the_road_before(spark):
    cases = {1: [0.3, 0.3, 0.9, 0.9, 0.9, 0.3], 2: [0.1, 0.3, 0.9, 0.9, 0.9, 0.3], 3: [0.1, 0.9, 0.9, 0.3, 0.9, 0.9, 0.9, 0.9], 4: [0.9, 0.9, 0.9, 0.1, 0.9, 0.9], 5: [0.1, 0.9, 0.9, 0.9]}
    data = [box(t, 50, 100, track=k, off=o) for k, os in cases.items() for t, o in enumerate(os)] + [box(t, 20, 40, track=6, off=o) for t, o in enumerate(cases[2])]
    got = rows(detect.off_track(spark.createDataFrame(data, BOX)), "track_id", "t_start", "t_end")
    want = [(k, *s) for k in cases if len(cases[k]) >= 6 for s in spans_by_hand([p for p in data if p[1] == k])]
    assert got == sorted(want) == [(2, 2.0, 4.0), (3, 4.0, 7.0)]


def down_by_hand(points):
    shape = lambda p: ((p[4] - p[3]) / max(1.0, p[6] - p[5]), p[6] - p[5])
    hits = []
    for i in range(5, len(points) - 8):
        a0, h0 = (float(np.median([shape(p)[k] for p in points[i - 5 : i]])) for k in (0, 1))
        after = [shape(p) for p in points[i : i + 8]]
        if all(a >= 1.5 * a0 for a, _ in after) and np.median([a for a, _ in after]) >= 1.8 * a0 and np.median([h for _, h in after]) <= 0.65 * h0:
            hits.append(points[i][2])
    return hits


def test_bikes_that_lie(spark):
    rng = random.Random(5)
    data = []
    for k in range(30):
        turn = rng.randrange(3, 20)
        data += [box(t / 5, rng.uniform(80, 120) if t < turn else rng.uniform(220, 300), rng.uniform(180, 220) if t < turn else rng.uniform(80, 150), track=k, cls=3 if k else 0) for t in range(24)]
    got = rows(incidents.bike_down_hits(spark.createDataFrame(data, BOX)), "track_id", "t")
    want = sorted((k, t) for k in range(1, 30) for t in down_by_hand([p for p in data if p[1] == k]))
    assert sorted(got) == want and want


def test_rider_beside_the_bike(spark):
    bike = [box(t / 5, 60, 100, track=1) for t in range(20)]
    rider = [box(t / 5, 50, 90, track=2, cls=0, y=480.0) for t in range(9)] + [box(t / 5, 40, 100, track=2, cls=0, x=600.0) for t in range(9, 20)]
    far = [box(t / 5, 40, 100, track=3, cls=0, x=900.0) for t in range(20)]
    df = spark.createDataFrame(bike + rider + far, BOX)
    assert rows(incidents.off_bike_hits(df), "track_id", "t") == [(1, 1.8), (1, 2.0)]
    found = rows(incidents.incidents(df), "track_id", "type", "t_start", "score", "why")
    assert found == [(1, "rider_down", pytest.approx(0.8), 2.0, "off_bike")]  # the second within the cooldown


def test_a_lying_bike_needs_a_span_off_the_track(spark):
    def ride(rec, offs):
        return [box(t / 5, 100 if t < 10 else 260, 200 if t < 10 else 100, track=1, off=o, rec=rec) for t, o in enumerate(offs)]

    off = [0.0] * 9 + [0.9] * 4 + [0.0] * 11
    late = [0.0] * 24 + [0.9] * 4 + [0.0]
    lying = lambda rec, offs: ride(rec, offs)
    df = spark.createDataFrame(lying(1, off) + lying(2, [0.0] * 24) + lying(3, late[:24] + late[24:]), BOX)
    found = rows(incidents.incidents(df), "recording_id", "type", "why")
    assert found == [(1, "rider_down", "bike_down"), (3, "off_track", None)]
    assert incidents.incidents(df.limit(0)).count() == 0


# ---- blocks that hold still


def test_riding_by_still_blocks(spark):
    rng = random.Random(9)
    own = {40, 41, 55}
    data = []
    for r in (1, 2, 3):
        for f in range(60):
            fixed = [(k in own and rng.random() < 0.9 and r == 1) or (k == 3 and True) or rng.random() < 0.1 for k in range(64)]
            data.append((r, f / 10, fixed, rng.choice([0.1, 0.5]) if r != 3 else 0.1))
    df = spark.createDataFrame(data + [(4, 0.0, None, 0.9)], "r int, t double, fixed array<boolean>, stream double")
    got = mount.riding(df, ["r"], "t", "fixed", "stream").orderBy("t").collect()
    moving = [f for r, _, f, s in data if r == 1 and s >= 0.3]
    blocks = [k for k in range(32, 64) if np.mean([f[k] for f in moving]) >= 0.6]
    assert set(blocks) == own and {r["r"] for r in got} == {1}
    for k, r in enumerate(got):
        want = np.mean([s >= 0.3 and np.mean([f[b] for b in blocks]) >= 0.5 for q, t, f, s in data if q == 1 and int(t) == k])
        assert r["t"] == k + 0.5 and abs(r["share"] - want) < 1e-9


# ---- votes and files


def test_votes_reach_the_same_footage_once(spark):
    clips = spark.createDataFrame([("r", "a", 0.0, 10.0), ("r", "b", 1.0, 11.0), ("r", "c", 9.0, 19.0), ("q", "d", 0.0, 10.0)], "rec string, key string, s double, e double")
    cast = spark.createDataFrame([(1, "a", 1, True), (2, "b", -1, False), (3, "x", 1, True), (4, "d", 0, None)], "v int, key string, vote int, spread boolean")
    also = spark.createDataFrame([(1, "b"), (1, "d"), (1, "d"), (1, "a"), (2, "zz"), (2, "c")], "v int, key string")
    got = rows(votes.spread_votes(cast, clips, ["rec"], "key", "s", "e", "v", also, "spread"), "v", "key", "vote", "inherited_from")
    assert got == sorted([(1, "a", 1, None), (1, "b", 1, "a"), (1, "d", 1, "a"), (2, "b", -1, None), (2, "c", -1, "b"), (4, "d", 0, None)], key=repr)
    assert votes.spread_votes(cast.limit(0), clips, ["rec"], "key", "s", "e", "v").count() == 0


def test_files_forgotten_by_folder_and_name(spark):
    files = spark.createDataFrame([("m", p) for p in ("/o/a/x1.mp4", "/o/a/y1.mp4", "/o/a/b/x2.mp4", "/o/ab/x3.mp4", "/x4.mp4")] + [("n", "/o/a/x1.mp4")], "kind string, path string")
    orders = spark.createDataFrame([("m", "/o/a/", "x"), ("m", "/o/ab", "y"), ("n", "/p", "")], "kind string, folder string, name_prefix string")
    assert rows(votes.forget(files, orders, ["kind"])) == sorted([("m", "/o/a/y1.mp4"), ("m", "/o/ab/x3.mp4"), ("m", "/x4.mp4"), ("n", "/o/a/x1.mp4")], key=repr)


def test_a_half_line_waits_for_its_other_half(spark, tmp_path):
    folder = tmp_path / "changes"
    folder.mkdir()
    line = lambda k, vote=1: json.dumps({"key": k, "machine_id": "m", "voted_at": "t", "vote": vote}).encode()
    tail.register(spark)
    schema = "key string, machine_id string, voted_at string, vote int"

    def read():
        stream = spark.readStream.format("appended_lines").load(str(folder))
        out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        out.awaitTermination()
        return sorted(r["key"] for r in records.vote_lines(spark.read.parquet(str(tmp_path / "out")), schema).collect()), spark.read.parquet(str(tmp_path / "out")).count()

    whole = line("later")
    (folder / "a.jsonl").write_bytes(line("one") + b"\n\n" + b"\xff\xfe broken\n" + b"{half\n" + line("two") + b"\r\n" + whole[:20])
    (folder / "b.jsonl").write_bytes(b"")
    (folder / "c.txt").write_bytes(line("no") + b"\n")
    assert read() == (["one", "two"], 3)  # the line that isn't JSON is handed on, and dropped by vote_lines
    assert read() == (["one", "two"], 3)  # nothing new
    with (folder / "a.jsonl").open("ab") as f:
        f.write(whole[20:] + b"\n" + line("one") + b"\n")
    (folder / "b.jsonl").write_bytes(line("other") + b"\n")
    assert read() == (["later", "one", "other", "two"], 6)  # a vote sent twice counts once


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_stretches_share_out_all_lines(tmp_path, size):
    lines = [("x" * (k * 7 % 50)).encode() + str(k).encode() for k in range(200)]
    path = tmp_path / "f.jsonl"
    path.write_bytes(b"\n".join(lines) + b"\nunfinished")
    reader = tail._BatchReader({"path": str(tmp_path), "task_bytes": str(size)})
    parts = reader.partitions()
    got = [x for p in parts for x in reader.read(p)]
    assert [v.encode() for _, _, v in got] == lines
    data = path.read_bytes()
    assert all(data[at : at + len(v)] == v.encode() for _, at, v in got)


def test_cooled_stream_keeps_the_rule():
    assert "strict" in streams.cooled.__code__.co_varnames
