"""A camera riding on a bike, told by the blocks of the picture that hold still while the rest streams past."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
GRID, STREAMING, FIXED_SHARE, LEAST_BLOCKS, HELD, LEAST_FRAMES = 8, 0.3, 0.6, 2, 0.5, 25


def shares_by_place(rows: DataFrame, by: Sequence[str], flags: str, places: int, where: Column) -> DataFrame:
    """``by``, ``shares`` (one for each place of the list column ``flags``), ``n``: how often a flag is set in the rows where ``where`` holds. One sum for each place, no row for each."""
    kept = rows.where(where)
    mean = lambda k: F.avg(F.get(flags, F.lit(k)).cast("double"))
    return kept.groupBy(*by).agg(F.array(*(mean(k) for k in range(places))).alias("shares"), F.count("*").alias("n"))


def riding(frames: DataFrame, by: Sequence[str], t: str, fixed: str, stream: str, grid: int = GRID, least_frames: int = LEAST_FRAMES, width: float = 1.0) -> DataFrame:
    """``by``, ``t`` (a second's middle), ``share``: how many of a second's frames ride on a moving bike. ``fixed``: which of grid * grid blocks hold still, ``stream``: the share that streams.

    The bike's own blocks lie in the lower half and hold still in FIXED_SHARE or more of the frames that stream. A recording with few such frames, or under LEAST_BLOCKS of such blocks, has no row. A frame rides if it
    streams and HELD of the bike's blocks hold still. A block that is null counts for neither.
    """
    moving = F.coalesce(F.col(stream) >= STREAMING, F.lit(False))
    votes = shares_by_place(frames, by, fixed, grid * grid, moving).where(F.col("n") >= least_frames)
    lower = int(grid * 0.5) * grid
    own = F.filter(F.sequence(F.lit(lower), F.lit(grid * grid - 1)), lambda k: F.coalesce(F.get("shares", k) >= FIXED_SHARE, F.lit(False)))
    bikes = votes.withColumn("_own", own).where(F.size("_own") >= LEAST_BLOCKS).select(*by, "_own")
    held = F.transform("_own", lambda k: F.get(fixed, k).cast("int"))
    known = F.filter(held, lambda x: x.isNotNull())
    holds = F.try_divide(F.aggregate(known, F.lit(0), lambda s, x: s + x), F.size(known)) >= HELD
    rides = frames.join(bikes, list(by)).withColumn("_rides", (moving & F.coalesce(holds, F.lit(False))).cast("double"))
    second = rides.groupBy(*by, F.floor(F.col(t) / width).alias("_k")).agg(F.avg("_rides").alias("share"))
    return second.select(*by, ((F.col("_k") + 0.5) * F.lit(float(width))).alias("t"), "share")
