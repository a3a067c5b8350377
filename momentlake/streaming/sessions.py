"""Streaming forms: session islands and votes taken once. They give what the batch operators give on the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.common import checkpoint_folder


def sessions(events: DataFrame, by: Sequence[str], ts: str, value: str, gap: str = "12 hours") -> DataFrame:
    """Runs of events with less than ``gap`` between them: start, end (``gap`` after the last), count, best value. For batch and stream."""
    w = F.session_window(F.col(ts), gap)
    return events.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.max(value).alias("best")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "best")


def stream_sessions(events: DataFrame, by: Sequence[str], ts: str, value: str, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """``sessions`` of a stream; a session is given out when the watermark has passed its end."""
    return sessions(events.withWatermark(ts, late), by, ts, value, gap)


def votes_once(votes: DataFrame, ts: str, key: Sequence[str], late: str = "1 day") -> DataFrame:
    """Each vote of a stream once, though several machines send it."""
    return votes.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def cooled(hits: DataFrame, by: str, t: str, seconds: float, strict: bool = False) -> DataFrame:
    """Hits of a stream that come ``seconds`` or more after the last accepted one of their key, with ``strict`` more than that: ``moments.cooldown`` of a stream. Rows of a key must come in order."""
    kind = hits.schema[by].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in sorted(x for f in frames for x in f[t]):
            if last is None or (at - last > seconds if strict else at - last >= seconds):
                last = float(at)
                out.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({by: [key[0]] * len(out), t: pd.Series(out, dtype=float)})

    return hits.groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, `{t}` double", "last double", "append", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream over finite input gives, written to the shared folder by the executors, batch by batch, and read from there."""
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    batches: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/{batch}")  # a batch that is tried again replaces itself
        batches.append(batch)

    query = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    # In complete mode each batch gives all rows anew.
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/rows/{b}" for b in (batches[-1:] if mode == "complete" else sorted(set(batches)))))
