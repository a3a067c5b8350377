"""Order-dependent choices: windows around peaks, packing, suppression, hysteresis, smoothing with limits.

Each next step depends on the last, so a group (a recording, or a day) is handled by one ordered pass; groups are
dealt out by Spark and are independent of each other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Sequence
from itertools import groupby
from math import isnan, nan

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nan_last, per_rows

PAD_S, MAX_LEN_S, MAX_CLIPS, MERGE_GAP_S, LONGEST_S = 10.0, 24.0, 12, 8.0, 40.0
PACK_S = 50.0
MAX_OVERLAP = 0.5
SWITCH_RATIO = 0.5
SMOOTH_TAU_S, MAX_PAN_PER_S = 0.35, 0.6
MIN_PIECE_S = 8.0
# Moments that a theme needs for shorts of its own, of which themes with other numbers.
LEAST_MOMENTS, LEAST_BY_THEME = 2, {"crash": 1, "crash_other": 1, "off_track": 1, "own_off_track": 1}


def per_group(df: DataFrame, by: Sequence[str], added: str, step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``step`` for each group of ``df``; what it returns has the group's columns and those of ``added`` (DDL)."""
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = step(g.reset_index(drop=True))
        for c, v in zip(reversed(by), reversed(key)):
            out.insert(0, c, v)
        return out

    return df.groupBy(*by).applyInPandas(run, f"{keys}, {added}")


def clip_windows(events: DataFrame, by: Sequence[str], start: str, end: str, score: str, tie: str, duration: float | None = None, pad: float = PAD_S, max_len: float = MAX_LEN_S, max_clips: int = MAX_CLIPS, merge_gap: float = MERGE_GAP_S) -> DataFrame:
    """Windows around the best peaks: ``w_start``, ``w_end``, ``w_score``, ``n_events``.

    Best first, a peak has a window of ``pad`` seconds to each side (a second at least, ``max_len`` in all at most), which holds every event that touches
    it. It joins the first window that it is near enough to and that stays short enough, else it is one of its own, up to ``max_clips``.
    """
    longest, half = max(max_len, LONGEST_S), min(pad, max(1.0, max_len / 2))
    end_of_all = float("inf") if duration is None else duration

    def step(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([score, start, tie], ascending=[False, True, True], kind="stable")
        s, e, v = (g[c].to_numpy(float) for c in (start, end, score))
        lo = np.maximum(0.0, (s + e) / 2 - half)
        hi = np.minimum(end_of_all, np.maximum((s + e) / 2 + half, lo + 1.0))
        over = np.maximum(0.0, hi - lo - max_len) / 2
        lo, hi = lo + over, hi - over
        spans: list[list[float]] = []
        members: list[np.ndarray] = []
        for k in range(len(g)):
            touched = (e >= lo[k]) & (s <= hi[k])
            touched[k] |= not touched.any()
            joined = np.array(spans).reshape(-1, 2)
            fits = (np.maximum(lo[k], joined[:, 0]) - np.minimum(hi[k], joined[:, 1]) <= merge_gap) & (np.maximum(hi[k], joined[:, 1]) - np.minimum(lo[k], joined[:, 0]) <= longest)
            if fits.any():
                w = int(fits.argmax())
                spans[w] = [min(lo[k], spans[w][0]), max(hi[k], spans[w][1])]
                members[w] = members[w] | touched
            elif len(spans) < max_clips:
                spans.append([lo[k], hi[k]])
                members.append(touched)
        rows = sorted((a, b, v[m].max(), int(m.sum())) for (a, b), m in zip(spans, members))
        out = pd.DataFrame(rows, columns=["w_start", "w_end", "w_score", "n_events"])
        return out.astype({"w_start": float, "w_end": float, "w_score": float, "n_events": "int64"})

    return per_group(events, by, "w_start double, w_end double, w_score double, n_events long", step)


def _numbers(values: Iterable) -> list:
    return [nan if v is None else v for v in values]


def _bins(seconds: Iterable[float], limit: float) -> list[int]:
    bins, k, used = [], 0, 0.0
    for s in seconds:
        if used > 0 and used + s > limit:
            k, used = k + 1, 0.0
        used += s
        bins.append(k)
    return bins


def pack_next_fit(moments: DataFrame, by: Sequence[str], moment_id: str, seconds: str, score: str, limit: float = PACK_S, best_first: bool = True) -> DataFrame:
    """``moment_id`` and ``bin``: best first (or least first) into the open bin, a new one when it is full. A moment over the limit has a bin of its own."""
    rows = moments.select(*by, moment_id, F.col(seconds).alias("_s"), F.col(score).alias("_v"))
    order = [nan_last(rows, "_v", best_first), F.col(moment_id).asc_nulls_last()]
    return per_rows(rows, by, order, [moment_id, "_s", "_v"], {moment_id: moment_id, "bin": "int"}, lambda ids, s, _: (ids, _bins(_numbers(s), limit)))


def plan_shorts(moments: DataFrame, by: Sequence[str], moment_id: str, theme: str, start: str, seconds: str, score: str, limit: float = PACK_S, most_action: int = 0) -> DataFrame:
    """Which moments each short shows: by, ``series``, ``bin``, ``moment_id``, ``place`` (by time).

    The series ``action`` has all moments, best first, in ``most_action`` shorts at most (0: in all). Each theme with enough moments has a series in order of time.
    All series of a group are packed in one pass over its moments.
    """
    rows = moments.select(*by, moment_id, F.col(theme).alias("_theme"), F.col(start).alias("_start"), F.col(seconds).alias("_seconds"), F.col(score).alias("_score"))

    def step(ids, themes, starts, lengths, _scores):
        starts, lengths = _numbers(starts), _numbers(lengths)
        in_time = sorted(range(len(ids)), key=lambda k: (isnan(starts[k]), 0.0 if isnan(starts[k]) else starts[k], ids[k]))
        at = {k: n for n, k in enumerate(in_time)}
        series = [("action", list(range(len(ids))))]
        own: dict[str, list[int]] = {}
        for k in in_time:
            if themes[k] is not None and themes[k] != "action":
                own.setdefault(themes[k], []).append(k)
        series += [(t, ks) for t, ks in own.items() if len(ks) >= LEAST_BY_THEME.get(t, LEAST_MOMENTS)]
        out = []
        for name, ks in series:
            shorts: dict[int, list[int]] = {}
            for k, short in zip(ks, _bins((lengths[k] for k in ks), limit)):
                shorts.setdefault(short, []).append(k)
            for short, shown in shorts.items():
                if name != "action" or most_action <= 0 or short < most_action:
                    out += [(name, short, ids[k], place) for place, k in enumerate(sorted(shown, key=at.get), 1)]
        return list(zip(*out)) or [()] * 4

    order = [nan_last(rows, "_score", True), F.col(moment_id).asc_nulls_last()]
    return per_rows(rows, by, order, [moment_id, "_theme", "_start", "_seconds", "_score"], {"series": "string", "bin": "int", moment_id: moment_id, "place": "int"}, step)


def suppress(moments: DataFrame, by: Sequence[str], moment_id: str, start: str, end: str, score: str, most: float = MAX_OVERLAP, theme: str | None = None, ranks: Sequence[str] = (), carried: Sequence[str] = ()) -> DataFrame:
    """``moment_id`` (and the columns ``carried``) of the rows that stay: best first, a row goes if more than ``most`` of the shorter of it and a kept one is shared.

    With ``theme`` the order is that of ``ranks`` first, ``action`` last of all; a row only goes for one of its own theme, but ``action`` for any.
    """
    late = F.lit(0)
    if theme:
        late = F.when(F.col(theme) == "action", len(ranks) + 1)
        for i, t in enumerate(ranks):
            late = late.when(F.col(theme) == t, i)
        late = late.otherwise(len(ranks))
    rows = moments.select(
        *by, moment_id, F.col(start).cast("double").alias("_from"), F.col(end).cast("double").alias("_to"), (F.col(theme) if theme else F.lit(None).cast("string")).alias("_theme"), F.col(score).alias("_by"), late.alias("_late"), *(F.col(c).alias(f"_c_{c}") for c in carried)
    )

    def step(ids, starts, ends, themes, _scores, _late, *more):
        kept: dict[object, list[tuple[float, float]]] = {}
        longest: dict[object, float] = {}
        stay = []
        for n, (s, e, t) in enumerate(zip(_numbers(starts), _numbers(ends), themes)):
            clash = False
            for other in kept if theme and t == "action" else [t] if t in kept else []:
                spans = kept[other]  # in order of start: only those near enough to be shared are looked at
                for a, b in spans[bisect_left(spans, (s - longest[other],)) : bisect_left(spans, (e,))]:
                    clash = clash or min(e, b) - max(s, a) > most * min(e - s, b - a)
            if not clash:
                insort(kept.setdefault(t, []), (s, e))
                longest[t] = max(longest.get(t, 0.0), e - s)
                stay.append(n)
        return [[c[n] for n in stay] for c in (ids, *more)]

    order = [F.col("_late"), nan_last(rows, "_by", True), F.col(moment_id).asc_nulls_last()]
    held = [f"_c_{c}" for c in carried]
    out = per_rows(rows, by, order, [moment_id, "_from", "_to", "_theme", "_by", "_late", *held], {moment_id: moment_id} | {c: c for c in held}, step)
    return out.withColumnsRenamed(dict(zip(held, carried)))


def focus(candidates: DataFrame, by: Sequence[str], t: str, subject: str, area: str, ratio: float = SWITCH_RATIO) -> DataFrame:
    """For each time the subject to follow: the last one while its area is at least ``ratio`` of the largest, else the largest."""
    rows = candidates.select(*by, t, subject, F.col(area).alias("_area")).where(F.col(t).isNotNull())

    def step(times, subjects, areas):
        found, now = [], None
        for at, frame in groupby(zip(times, subjects, _numbers(areas)), key=lambda r: r[0]):
            frame = list(frame)
            held = next((a for _, s, a in frame if s == now), None)
            if now is None or held is None or held < ratio * frame[0][2]:
                now = frame[0][1]
            found.append((at, now))
        return list(zip(*found))

    return per_rows(rows, by, [F.col(t), nan_last(rows, "_area", True), F.col(subject).asc_nulls_last()], [t, subject, "_area"], {t: t, subject: subject}, step)


def smooth_limited(series: DataFrame, by: Sequence[str], t: str, tie: str, value: str, tau: float = SMOOTH_TAU_S, rate: float = MAX_PAN_PER_S) -> DataFrame:
    """``tie`` and ``smooth``: an exponential mean run forwards and then backwards, its change held to ``rate`` a second."""
    rows = series.select(*by, F.col(tie), F.col(t).alias("_at"), F.col(value).cast("double").alias("_x"))

    def step(ties, times, values):
        times, x = _numbers(times), _numbers(values)
        for order in (range(1, len(x)), range(len(x) - 2, -1, -1)):
            back = -1 if order.step > 0 else 1
            for i in order:
                a = 1 - 2.718281828459045 ** (-abs(times[i] - times[i + back]) / tau)
                x[i] = x[i + back] + a * (x[i] - x[i + back])
        for i in range(1, len(x)):
            most = rate * (times[i] - times[i - 1])
            x[i] = x[i - 1] + min(most, max(-most, x[i] - x[i - 1]))
        return ties, x

    return per_rows(rows, by, [nan_last(rows, "_at"), F.col(tie).asc_nulls_last()], [tie, "_at", "_x"], {tie: tie, "smooth": "double"}, step)


def cooldown(hits: DataFrame, by: Sequence[str], t: str, tie: str, seconds: float, strict: bool = False) -> DataFrame:
    """The hits that come ``seconds`` or more after the last accepted one of their group, with ``strict`` more than that: ``by`` and ``tie``."""
    rows = hits.select(*by, F.col(tie), F.col(t).alias("_at"))

    def step(ties, times):
        kept, last = [], None
        for n, at in enumerate(_numbers(times)):
            if last is None or (at - last > seconds if strict else at - last >= seconds):
                kept.append(ties[n])
                last = at
        return (kept,)

    return per_rows(rows, by, [nan_last(rows, "_at"), F.col(tie).asc_nulls_last()], [tie, "_at"], {tie: tie}, step)


def widen(start: Column, end: Column, duration: Column, least: float = MIN_PIECE_S) -> tuple[Column, Column]:
    """A span widened to ``least`` around its middle, inside 0 and ``duration``."""
    half = F.greatest(end - start, F.lit(least)) / 2
    lo = F.greatest(F.lit(0.0), F.least((start + end) / 2 - half, duration - 2 * half))
    return lo, F.least(duration, lo + 2 * half)


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, null if none does; a check that is null doesn't hold. Their order is the meaning."""
    out = None
    for name, check in checks:
        held = F.coalesce(check, F.lit(False))
        out = F.when(held, name) if out is None else out.when(held, name)
    return F.lit(None).cast("string") if out is None else out
