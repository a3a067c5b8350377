"""Lines and edges that move through the picture, followed from frame to frame.

Assigning a frame's hits to open tracks depends on what the frames before have taken, so a recording is read in order. What is carried from
frame to frame is its open tracks only: a recording may be as long as it likes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import cooldown

# Of lines on the road, and of a bridge's edge overhead.
STILL_ROW, STILL_LAG_S, TRACK_BACK = 0.015, 0.2, 0.02
LINE_GAP_S, LINE_ANGLE = 0.13, 2.0
EDGE_GAP_S, EDGE_ANGLE, EDGE_RISE, EDGE_RISE_S, EDGE_EXIT_ROW, EDGE_SAME_S = 0.3, 3.0, 0.1, 0.4, 0.15, 0.5


@dataclass
class Track:
    """A thing that is followed: where and when it was first and last seen, its longest run, and its rows of late."""

    first_row: float
    at: float
    row: float
    run: float
    seen: int = 1
    late: list[tuple[float, float]] = field(default_factory=list)

    def take(self, at: float, row: float, run: float) -> None:
        self.at, self.row, self.run, self.seen = at, row, max(self.run, run), self.seen + 1


def moving_hits(hits: DataFrame, by: Sequence[str], frame: str, row: str, angle: str, lag: int, angle_tol: float, both: bool, last_frame: str | None = None) -> DataFrame:
    """``hits`` without those that are where another hit was ``lag`` frames before or after: parts of the bike itself.

    With ``both``, a hit must have such others on both sides to go, or on the one side that has a frame (frames run from 0 to the column ``last_frame``).
    """
    key = list(by)
    at = hits.select(*key, F.col(frame).alias("_f"), F.col(row).alias("_r"), F.col(angle).alias("_a"))
    sides = hits.select(*key, frame, row, angle).distinct().withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("_f", F.col(frame) + F.col("_side") * lag)
    alike = (F.abs(F.col(row) - F.col("_r")) <= STILL_ROW) & (F.abs(F.col(angle) - F.col("_a")) <= angle_tol)
    met = sides.join(at, [*key, "_f"]).where(alike).groupBy(*key, frame, row, angle).agg(F.bool_or(F.col("_side") == -1).alias("_before"), F.bool_or(F.col("_side") == 1).alias("_after"))
    found = hits.join(met, [*key, frame, row, angle], "left")
    before, after = F.coalesce("_before", F.lit(False)), F.coalesce("_after", F.lit(False))
    if both:
        has_before, has_after = F.col(frame) >= lag, F.col(frame) + lag <= F.col(last_frame)
        still = (has_before | has_after) & (before | ~has_before) & (after | ~has_after)
    else:
        still = before | after
    return found.where(~still).drop("_before", "_after")


def followed(hits: DataFrame, by: Sequence[str], t: str, row: str, run: str, upwards: bool, ended: Callable[[Track, float], bool], keep: float = 0.0) -> DataFrame:
    """Tracks of ``hits``: ``by``, ``t``, ``row`` (last seen), ``first_row``, ``run`` (longest), ``seen``, ``rose`` (rows climbed in the last ``keep`` seconds).

    In each frame the foremost hit first (the lowest in the picture, or the highest for ``upwards``) takes the foremost open track that it can have come from, which may lie TRACK_BACK
    behind it the wrong way; else it opens one. ``ended`` tells whether a track is closed at some time. Of equal tracks the one opened last is taken.
    """
    key, sign = list(by), -1.0 if upwards else 1.0
    kinds = {c: hits.schema[c].dataType.simpleString() for c in key}
    sorted_hits = hits.select(*key, F.col(t).cast("double").alias("_t"), (F.col(row).cast("double") * sign).alias("_row"), F.col(run).cast("double").alias("_run")).where("_t IS NOT NULL AND _row IS NOT NULL")
    dealt = sorted_hits.repartition(*key).sortWithinPartitions(*key, "_t", F.desc("_row"), F.desc("_run"))
    names = [*key, "t", "row", "first_row", "run", "seen", "rose"]

    def closed(group: tuple, track: Track) -> tuple:
        climbed = track.row - min((r for at, r in track.late if at >= track.at - keep), default=track.row)
        return (*group, track.at, sign * track.row, sign * track.first_row, track.run, track.seen, climbed)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, open_, now, taken = None, [], None, []
        for rows in frames:
            out = []
            for *g, at, place, length in rows.itertuples(index=False, name=None):
                if tuple(g) != group:
                    out += [closed(group, x) for x in open_]
                    group, open_, now, taken = tuple(g), [], None, []
                if at != now:
                    out += [closed(group, x) for x in open_ if ended(x, at)]
                    open_ = [x for x in open_ if not ended(x, at)]
                    now, taken = at, []
                free = [x for x in open_ if x not in taken and x.row <= place + TRACK_BACK]
                if free:
                    track = max(reversed(free), key=lambda x: x.row)
                    track.take(at, place, length)
                else:
                    track = Track(place, at, place, length)
                    open_.append(track)
                taken.append(track)
                if upwards:
                    track.late = [(s, r) for s, r in track.late if s >= at - keep] + [(at, place)]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([closed(group, x) for x in open_], columns=names)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", t double, row double, first_row double, run double, seen int, rose double"
    return dealt.mapInPandas(walk, schema)


def _lag(fps: float) -> int:
    return max(1, round(STILL_LAG_S * fps))


def line_passes(hits: DataFrame, by: Sequence[str], frame: str, t: str, row: str, angle: str, run: str, fps: float, gap: float = LINE_GAP_S) -> DataFrame:
    """``by``, ``t``, ``row``, ``run``: lines that come down the picture and leave it, half a frame after they were last seen. ``frame``: a frame's number, ``row``: share of the height from the top.

    Lines that hold their place before or after are the bike's own. A line is followed while it comes down, for gaps of up to ``gap`` seconds; it counts once it was seen in two frames
    and came down STILL_ROW.
    """
    moving = moving_hits(hits, by, frame, row, angle, _lag(fps), LINE_ANGLE, both=False)
    found = followed(moving, by, t, row, run, upwards=False, ended=lambda x, at: at - x.at > gap)
    return found.where((F.col("seen") >= 2) & (F.col("row") - F.col("first_row") >= STILL_ROW)).select(*by, (F.col("t") + 0.5 / fps).alias("t"), "row", "run")


def edge_passes(hits: DataFrame, by: Sequence[str], frame: str, t: str, row: str, angle: str, run: str, last_frame: str, fps: float, gap: float = EDGE_GAP_S, rise_s: float = EDGE_RISE_S, same: float = EDGE_SAME_S) -> DataFrame:
    """``by``, ``t``: times at which an edge has risen out of the picture's top, each over ``same`` seconds after the one before.

    An edge that holds its place before and after is the bike's own. It is followed while it rises; it ends after ``gap`` seconds, or near the top after a frame and a half without it, and counts if it was
    seen twice, was last seen near the top, and rose EDGE_RISE in its last ``rise_s`` seconds.
    """
    moving = moving_hits(hits, by, frame, row, angle, _lag(fps), EDGE_ANGLE, both=True, last_frame=last_frame)
    gone = lambda x, at: at - x.at > gap or (-x.row <= EDGE_EXIT_ROW and at - x.at > 1.5 / fps)
    found = followed(moving, by, t, row, run, upwards=True, ended=gone, keep=rise_s)
    near: Column = (F.col("seen") >= 2) & (F.col("row") <= EDGE_EXIT_ROW) & (F.col("rose") >= EDGE_RISE)
    times = found.where(near).select(*by, (F.col("t") + 0.5 / fps).alias("t")).distinct()
    return cooldown(times, by, "t", "t", same, strict=True)
