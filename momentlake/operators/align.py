"""Clocks laid on each other: outings, their reference camera, offsets along chains of overlapping cameras, lags of two series, landmarks, and
the cascade that decides how a recording's start is known."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import per_rows, written
from .intervals import in_range, islands, overlap_pairs

# Fixed values.
LEAST_OVERLAP_S = 10.0
ENVELOPE_HZ, SOUND_HZ, LEAST_ENVELOPE_S = 50, 4000, 4
SOUND_SEARCH_S, RUNNER_UP_S, LEAST_PEAK, LEAST_MARGIN = 1.0, 0.15, 0.3, 1.2
LANDMARK_SEARCH_S, LANDMARK_TOL_S, LANDMARK_PAIRS, LANDMARK_MARGIN, LANDMARK_RIVAL_S = 180.0, 0.3, 2, 1, 1.0


def outings(clocks: DataFrame, by: Sequence[str], clock_id: str, start: str, end: str) -> DataFrame:
    """``clocks`` with ``outing``: recordings that overlap, directly or through others, are one; those that only touch are not."""
    return islands(clocks, by, start, end, clock_id, strict=True).withColumnRenamed("island", "outing")


def references(clocks: DataFrame, by: Sequence[str], clock_id: str, start: str, end: str, fixes: str, logged: str) -> DataFrame:
    """``by``, ``outing``, ``reference``: the camera that the others follow. One with a place on the log before one without, then most fixes, then the longest, then the lower id."""
    w = Window.partitionBy(*by, "outing").orderBy(F.col(logged).isNull(), F.desc(F.coalesce(fixes, F.lit(0))), F.desc(F.col(end) - F.col(start)), clock_id)
    return clocks.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*by, "outing", F.col(clock_id).alias("reference"))


def align(clocks: DataFrame, measured: DataFrame, by: Sequence[str], clock_id: str, start: str, end: str, fixes: str, logged: str, least_overlap: float = LEAST_OVERLAP_S, width: float = 3600.0) -> DataFrame:
    """How far every camera's clock is off: ``clock_id``, ``outing``, ``reference``, ``offset``, ``source``, ``path``.

    ``logged``: seconds that a log of absolute time adds to the clock, null without. ``measured``: ``a``, ``b``, ``shift``, seconds to add to b's clock so that it
    lies on a's, for pairs in any order and direction; of several for one direction the least counts, and a pair that is measured one way
    is known the other way. Pairs that overlap for less than ``least_overlap`` aren't used.

    A camera on the log has its own offset (``log``). The outing's reference without one keeps its clock (``reference``). The others follow the fewest
    measured pairs to a camera that is placed, among equals through the lower id (``pairs``); ``path`` lists the ids from there to the camera. Those
    that no pair reaches keep their clock (``clock``, offset 0, a path of their own). The rounds are as many as the longest path has pairs; each is
    written to the shared folder, and only new cameras spread in the next.
    """
    known = written(outings(clocks.select(*by, clock_id, start, end, fixes, logged), by, clock_id, start, end))
    chosen = references(known, by, clock_id, start, end, fixes, logged)
    near = overlap_pairs(known, by, start, end, clock_id, least_overlap, share="seconds", width=width).select("a", "b")
    one = measured.groupBy("a", "b").agg(F.min("shift").alias("shift"))
    back = one.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("shift")).alias("_back"))
    both = one.join(back, ["a", "b"], "full").select("a", "b", F.coalesce("shift", "_back").alias("shift"))
    links = written(both.join(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_semi"))
    rows = known.join(chosen, [*by, "outing"])
    me = F.col(clock_id)
    seeds = rows.where(F.col(logged).isNotNull() | (me == F.col("reference"))).select(
        me.alias("id"), F.coalesce(logged, F.lit(0.0)).cast("double").alias("offset"), F.when(F.col(logged).isNotNull(), "log").otherwise("reference").alias("source"), F.array(me).alias("path")
    )
    placed = newest = written(seeds)
    while not newest.isEmpty():
        step = newest.join(links, newest["id"] == links["a"]).select(F.col("b").alias("id"), F.col("a").alias("_from"), (F.col("offset") + F.col("shift")).alias("offset"), "path")
        first = Window.partitionBy("id").orderBy("_from")
        fresh = step.join(placed.select("id"), "id", "left_anti").withColumn("_k", F.row_number().over(first)).where("_k = 1")
        newest = written(fresh.select("id", "offset", F.lit("pairs").alias("source"), F.concat("path", F.array("id")).alias("path")))
        placed = placed.unionByName(newest)
    found = placed.withColumnRenamed("id", clock_id)
    out = rows.select(*by, clock_id, "outing", "reference").join(found, clock_id, "left")
    return out.select(*by, clock_id, "outing", "reference", F.coalesce("offset", F.lit(0.0)).alias("offset"), F.coalesce("source", F.lit("clock")).alias("source"), F.coalesce("path", F.array(me)).alias("path"))


def placed(recordings: DataFrame, recording_id: str, sources: Sequence[tuple[str, DataFrame, Column | None]], otherwise: str = "clock", start: str = "start", reason: str = "reason") -> DataFrame:
    """How each recording's start is known: ``recording_id``, ``source``, ``start``, ``reason``, ``refused``.

    ``sources``: name, a table of ``recording_id``, ``start`` and ``reason``, and a condition on the recording's columns for the source to be asked at all
    (null: always). They are asked in order, each only about recordings that none before has placed; a null start refuses, with its reason. ``refused`` has
    ``name: reason`` of those asked in vain, in order (no row: ``nothing found``). What is left is ``otherwise``, with a null start. Of several rows of one source
    the one with a start, then the least, counts. A null id is placed by no source.
    """
    left, done = recordings.withColumn("_refused", F.array().cast("array<string>")), []
    shape = [recording_id, "source", start, reason, "refused"]
    for name, found, needs in sources:
        one = found.groupBy(recording_id).agg(F.min(F.struct(F.col(start).isNull().alias("n"), F.col(start).cast("double").alias("s"), F.col(reason).alias("r"))).alias("_f"))
        asked = left if needs is None else left.withColumn("_asks", F.coalesce(needs, F.lit(False)))
        met = asked.join(one, recording_id, "left")
        takes = F.col("_f.s").isNotNull() & (F.lit(True) if needs is None else F.col("_asks"))
        done.append(met.where(takes).select(recording_id, F.lit(name).alias("source"), F.col("_f.s").alias(start), F.col("_f.r").alias(reason), F.col("_refused").alias("refused")))
        word = F.concat(F.lit(f"{name}: "), F.coalesce("_f.r", F.lit("nothing found")))
        in_vain = F.concat("_refused", F.array(word))
        kept = in_vain if needs is None else F.when(F.col("_asks"), in_vain).otherwise(F.col("_refused"))
        left = met.where(~F.coalesce(takes, F.lit(False))).withColumn("_refused", kept).select(*recordings.columns, "_refused")
    done.append(left.select(recording_id, F.lit(otherwise).alias("source"), F.lit(None).cast("double").alias(start), F.lit(None).cast("string").alias(reason), F.col("_refused").alias("refused")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*shape)


def landmark_match(passes: DataFrame, landmarks: DataFrame, guesses: DataFrame, by: Sequence[str], t: str, mark: str, guess: str, search: float = LANDMARK_SEARCH_S, tol: float = LANDMARK_TOL_S, least: int = LANDMARK_PAIRS, margin: int = LANDMARK_MARGIN, rival_s: float = LANDMARK_RIVAL_S) -> DataFrame:
    """Where a recording's passes lie on the log's landmarks: ``by``, ``start`` (null if refused), ``n``, ``passes``, ``rival``, ``spread``, ``reason``.

    Every pass and landmark within ``search`` of a guess give a start. A start is as good as the passes that it brings within ``tol`` of a landmark, then as their
    mean distance is small, then by the earlier pass and landmark. ``rival`` is the most passes that a start over ``rival_s`` away brings there. The pairs of the best
    give the start as the median of their differences, ``spread`` the largest distance from it. It is refused under ``least`` pairs, and where a rival of two or
    more comes within ``margin``. Groups without passes, guesses or landmarks in reach have no row. Repeated passes and landmarks count once.
    """
    p = passes.select(*by, F.col(t).cast("double").alias("_p")).where("_p IS NOT NULL").distinct()
    g = guesses.select(*by, F.col(guess).cast("double").alias("_g")).where("_g IS NOT NULL").distinct()
    marks = landmarks.select(*by, F.col(mark).cast("double").alias("_u")).where("_u IS NOT NULL").distinct()
    span = p.groupBy(*by).agg(F.min("_p").alias("_p0"), F.max("_p").alias("_p1"), F.count("*").alias("passes")).join(g.groupBy(*by).agg(F.min("_g").alias("_g0"), F.max("_g").alias("_g1")), list(by))
    marks = marks.join(span, list(by)).where((F.col("_u") >= F.col("_g0") - search + F.col("_p0") - 1) & (F.col("_u") <= F.col("_g1") + search + F.col("_p1") + 1)).select(*by, "_u")
    around = p.join(g, list(by))
    middle = F.col("_p") + F.col("_g")
    tries = in_range(around, marks, by, middle - search, middle + search, F.col("_u"), search).where(F.abs(F.col("_u") - F.col("_p") - F.col("_g")) <= search)
    starts = tries.select(*by, F.col("_p").alias("_from"), F.col("_u").alias("_to"), (F.col("_u") - F.col("_p")).alias("_s")).distinct()
    at = starts.join(p, list(by)).withColumn("_at", F.col("_p") + F.col("_s"))
    # Reaches a little further than tol: which side of it a distance lies on is decided by the distance alone.
    met = in_range(at, marks, by, F.col("_at") - 1.001 * tol, F.col("_at") + 1.001 * tol, F.col("_u"), 4 * tol).withColumn("_d", F.abs(F.col("_at") - F.col("_u"))).where(F.col("_d") <= tol)
    near = met.groupBy(*by, "_from", "_to", "_s", "_p").agg(F.min(F.struct("_d", "_u")).alias("_m"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_p").alias("t"), F.col("_m._u").alias("u"))))
    good = near.groupBy(*by, "_from", "_to", "_s").agg(F.count("*").alias("n"), F.avg("_m._d").alias("_err"), pairs.alias("_pairs"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.round("_err", 6), "_from", "_to")  # to a microsecond: sums of many tasks differ in their last digits
    ranked = good.withColumn("_k", F.row_number().over(order)).withColumn("_best", F.first("_s").over(order))
    rival = F.coalesce(F.max(F.when(F.abs(F.col("_s") - F.col("_best")) > rival_s, F.col("n"))), F.lit(0))
    best = ranked.groupBy(*by).agg(F.min(F.when(F.col("_k") == 1, F.struct("n", "_pairs"))).alias("_b"), rival.alias("rival"))
    off = F.array_sort(F.transform("_b._pairs", lambda x: x["u"] - x["t"]))
    n = F.col("_b.n")
    half = lambda k: F.get(off, F.floor(k).cast("int"))
    start = (half((n - 1) / 2) + half(n / 2)) / 2
    out = best.join(span.select(*by, "passes"), list(by)).select(*by, n.alias("n"), "passes", "rival", start.alias("_start"), off.alias("_off"))
    out = out.withColumn("spread", F.array_max(F.transform("_off", lambda x: F.abs(x - F.col("_start")))))
    refused = F.when(F.col("n") < least, F.lit(f" (need {least})")).when((F.col("rival") >= 2) & (F.col("n") < F.col("rival") + margin), " (ambiguous)")
    text = F.concat(F.format_string("%d of %d landmark passes, spread %.2f s, next best %d", "n", "passes", "spread", "rival"), F.coalesce(refused, F.lit("")))
    return out.select(*by, F.when(refused.isNull(), F.col("_start")).alias("start"), "n", "passes", "rival", "spread", text.alias("reason"))


def envelope(samples: DataFrame, by: Sequence[str], n: str, value: str, rate: int = SOUND_HZ, hz: int = ENVELOPE_HZ, least: float = LEAST_ENVELOPE_S) -> DataFrame:
    """``by``, ``k``, ``level``: the logarithm of the sound's strength in each of ``hz`` steps a second, less its mean over a second around.

    ``n`` counts the samples from 0. What doesn't fill the last step is left out, and so is a series of under ``least`` seconds. At the ends silence counts as zero,
    not as no rows.
    """
    hop = rate // hz
    steps = samples.groupBy(*by, F.floor(F.col(n) / hop).alias("k")).agg(F.avg(F.col(value) * F.col(value)).alias("_p"), F.count("*").alias("_c"))
    whole = steps.where(F.col("_c") == hop).withColumn("_l", F.log(F.sqrt("_p") + 1e-4))
    group = Window.partitionBy(*by)
    around = group.orderBy("k").rangeBetween(-(hz // 2), hz - 1 - hz // 2)
    out = whole.withColumns({"level": F.col("_l") - F.sum("_l").over(around) / hz, "_n": F.count("*").over(group)})
    return out.where(F.col("_n") >= hz * least).select(*by, "k", "level")


def block_sums(a: np.ndarray, b: np.ndarray, most: int) -> dict[str, np.ndarray]:
    """Sums over b's places of pairs (a[place + lag], b[place]) at each lag from -most to most, by Fourier transforms; NaN is no value.

    ``a`` reaches ``most`` further than ``b`` on both sides.
    """
    size = 1 << int(np.ceil(np.log2(len(a) + len(b))))
    spectrum = lambda x: np.fft.rfft(x, size)
    has_a, has_b = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(has_a, a, 0.0), np.where(has_b, b, 0.0)
    fa = {"1": spectrum(has_a.astype(float)), "x": spectrum(x), "xx": spectrum(x * x)}
    fb = {"1": np.conj(spectrum(has_b.astype(float))), "y": np.conj(spectrum(y)), "yy": np.conj(spectrum(y * y))}
    lag = lambda p, q: np.fft.irfft(fa[p] * fb[q], size)[: 2 * most + 1]
    return {"n": np.rint(lag("1", "1")), "sa": lag("x", "1"), "sb": lag("1", "y"), "saa": lag("xx", "1"), "sbb": lag("1", "yy"), "sab": lag("x", "y")}


def lag_correlation_blocks(a: DataFrame, b: DataFrame, by: Sequence[str], k: str, va: str, vb: str, most: int, block: int = 4096) -> DataFrame:
    """``lag_correlation`` by blocks: ``by``, ``lag``, ``r``, ``n``, the correlation of a at a step + lag with b at the step, over the steps where both are.

    The second series is cut into blocks of ``block`` steps, the first into the same with ``most`` steps more on both sides; each block gives a row for each
    lag, whatever its rows, and the rows of a lag are added up. A step of a series should have one row; of several the last counts. Values are shifted
    by each block's means while summing, so that large ones lose no digits.
    """
    key = [*by, "_block"]
    b0 = b.select(*by, F.col(k).cast("long").alias("_k"), F.col(vb).cast("double").alias("_v")).where("_k IS NOT NULL AND _v IS NOT NULL").withColumn("_block", F.floor(F.col("_k") / block))
    reach = F.explode(F.sequence(F.floor((F.col("_k") - most) / block), F.floor((F.col("_k") + most) / block)))
    a0 = a.select(*by, F.col(k).cast("long").alias("_k"), F.col(va).cast("double").alias("_v")).where("_k IS NOT NULL AND _v IS NOT NULL").withColumn("_block", reach)
    # One point for each series to measure from: the same in all blocks, or their sums wouldn't add up.
    zero = a0.groupBy(*by).agg(F.avg("_v").alias("_za")).join(b0.groupBy(*by).agg(F.avg("_v").alias("_zb")), list(by)) if by else a0.agg(F.avg("_v").alias("_za")).join(b0.agg(F.avg("_v").alias("_zb")), F.lit(True))
    less = lambda x, z: (x.join(zero, list(by)) if by else x.join(F.broadcast(zero), F.lit(True))).withColumn("_v", F.col("_v") - F.col(z)).select(*key, "_k", "_v")
    sums = ["n", "sa", "sb", "saa", "sbb", "sab"]

    def step(second, steps, values):
        """A block's sums over the steps that its second series has: of a sparse block only their range is transformed."""
        cut = second.index(True) if second[-1] else len(second)
        if cut in (0, len(second)):
            return [[]] * 7
        low, high = min(steps[cut:]), max(steps[cut:])
        x, y = np.full(high - low + 1 + 2 * most, np.nan), np.full(high - low + 1, np.nan)
        for k, v in zip(steps[:cut], values[:cut]):
            if low - most <= k <= high + most:
                x[k - low + most] = v
        for k, v in zip(steps[cut:], values[cut:]):
            y[k - low] = v
        found = block_sums(x, y, most)
        met = np.flatnonzero(found["n"] > 0)
        return [(met - most).tolist(), *(found[c][met].tolist() for c in sums)]

    both = less(a0, "_za").withColumn("_second", F.lit(False)).unionByName(less(b0, "_zb").withColumn("_second", F.lit(True)))
    blocks = per_rows(both, key, [F.col("_second"), F.col("_k")], ["_second", "_k", "_v"], {"lag": "int"} | dict.fromkeys(sums, "double"), step)
    order = [*by, "lag", *sums]
    s = blocks.groupBy(*by, "lag").agg(*(F.sum(c).alias(c) for c in order[len(by) + 1 :]))
    n = F.col("n")
    spread = lambda total, square: F.col(square) - F.col(total) * F.col(total) / n
    r = (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(F.greatest(spread("sa", "saa"), F.lit(0.0)) * F.greatest(spread("sb", "sbb"), F.lit(0.0)))
    flat = (spread("sa", "saa") <= 1e-12 * F.col("saa")) | (spread("sb", "sbb") <= 1e-12 * F.col("sbb"))
    return s.select(*by, "lag", F.when(~flat, r).alias("r"), n.cast("long").alias("n"))


def best_lag(scores: DataFrame, by: Sequence[str], away: int, least_peak: float = LEAST_PEAK, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """``by``, ``lag``, ``peak``, ``runner_up``, ``accepted`` of correlations by ``lag`` (``r``): the best, ties to the lower lag, and the best of those more than ``away`` steps from it (0 without any).

    Accepted if the peak is high enough and stands out by ``least_margin``. Groups without any correlation have no row.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("r"), "lag")
    known = scores.where("r IS NOT NULL AND NOT isnan(r)").withColumns({"_best": F.first("lag").over(w), "_peak": F.first("r").over(w)})
    far = F.abs(F.col("lag") - F.col("_best")) > away
    out = known.groupBy(*by).agg(F.max("_best").alias("lag"), F.max("_peak").alias("peak"), F.coalesce(F.max(F.when(far, F.col("r"))), F.lit(0.0)).alias("runner_up"))
    return out.withColumn("accepted", (F.col("peak") >= least_peak) & (F.col("peak") >= least_margin * F.greatest(F.col("runner_up"), F.lit(1e-6))))


def sound_lag(reference: DataFrame, other: DataFrame, by: Sequence[str], k: str = "k", value: str = "level", search: float = SOUND_SEARCH_S, hz: int = ENVELOPE_HZ) -> DataFrame:
    """``best_lag`` of two envelopes, in seconds (``seconds``): what to add to the other's clock.

    Only steps of the other that meet the reference at every lag are compared. Pairs that are too short for that, and LEAST_ENVELOPE_S more, have no row.
    """
    most = round(search * hz)
    lengths = reference.groupBy(*by).agg(F.count("*").alias("_na")).join(other.groupBy(*by).agg(F.count("*").alias("_nb")), list(by)).select(*by, F.least("_na", "_nb").alias("_n")).where(F.col("_n") > 2 * most + hz * LEAST_ENVELOPE_S)
    core = other.join(lengths, list(by)).where((F.col(k) >= most) & (F.col(k) < F.col("_n") - most)).select(*by, k, F.col(value).alias("_b"))
    long = reference.join(lengths, list(by)).where(F.col(k) < F.col("_n")).select(*by, k, F.col(value).alias("_a"))
    found = best_lag(lag_correlation_blocks(long, core, by, k, "_a", "_b", most), by, round(RUNNER_UP_S * hz))
    return found.withColumn("seconds", F.col("lag") / hz)
