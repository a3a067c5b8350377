"""What several operators share: the checkpoint folder, and frames of rows whose width differs by group."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir; only a session without one (as in tests) gets one of this machine's own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="momentlake-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "_n") -> DataFrame:
    """``df`` with each row's place in its group, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
_BATCH_ROWS = 8192


def per_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], columns: Sequence[str], added: dict[str, str], step: Callable) -> DataFrame:
    """``step`` for each group of ``df``, its rows in ``order``: ``step(*columns)`` gets the group's columns as tuples and returns as many lists as ``added`` has, which maps names to a kind (of ``_KINDS``) or to the column whose type they have.

    Spark deals the groups out and sorts them; a task reads its rows as they come, one group at a time. So a small group costs what its rows cost, and not a
    pandas frame of its own: there are far more groups than rows in each.
    """
    n, names = len(by), [*by, *added]
    kinds = [df.schema[c].dataType.simpleString() for c in by] + [k if k in _KINDS else df.schema[k].dataType.simpleString() for k in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                types[:] = [b.schema.field(c).type for c in by] + [_KINDS[k] if k in _KINDS else b.schema.field(k).type for k in added.values()]
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[list] = [[] for _ in names]
        for key, group in groupby(rows(), key=lambda r: r[:n]):
            found = step(*list(zip(*group))[n:])
            for c, v in zip(out, key):
                c.extend([v] * len(found[0]))
            for c, values in zip(out[n:], found):
                c.extend(values)
            if len(out[0]) >= _BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], names)

    dealt = df.select(*by, *columns).repartition(*map(F.col, by)).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds)))


def nan_last(df: DataFrame, column: str, down: bool = False) -> Column:
    """The order by ``column`` with nulls and NaN at the end, whichever way."""
    c = F.col(column)
    known = F.when(~F.isnan(c), c) if df.schema[column].dataType.typeName() in ("double", "float") else c
    return known.desc_nulls_last() if down else known.asc_nulls_last()


def framed_means(df: DataFrame, by: Sequence[str], n: str, width: Column, values: Sequence[str]) -> DataFrame:
    """``values`` replaced by their means over ``width`` rows around each (for an even width one more before than after), at the ends over those that there are.

    ``n``: the row's place in its group, from 1. A window's frame is one for all groups, so a width that differs by group is taken from running
    sums, which are met by place. Null values count as no rows.
    """
    w = Window.partitionBy(*by).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.withColumns({f"_s_{v}": F.coalesce(F.sum(v).over(w), F.lit(0.0)) for v in values} | {f"_c_{v}": F.count(v).over(w) for v in values} | {"_w": width, "_last": F.count("*").over(Window.partitionBy(*by))})
    held = [c for v in values for c in (f"_s_{v}", f"_c_{v}")]
    ends = sums.select(*by, F.col(n).alias("_at"), F.struct(*held).alias("_e"))
    half = F.floor(F.col("_w") / 2)
    asked = sums.withColumns({"_hi": F.least(F.col(n) + F.col("_w") - 1 - half, F.col("_last")).cast("int"), "_lo": (F.col(n) - half - 1).cast("int")})
    out = asked.join(ends.withColumnsRenamed({"_at": "_hi", "_e": "_top"}), [*by, "_hi"]).join(ends.withColumnsRenamed({"_at": "_lo", "_e": "_below"}), [*by, "_lo"], "left")
    less = lambda c: F.coalesce(F.col(f"_below.{c}"), F.lit(0))
    means = {v: F.try_divide(F.col(f"_top._s_{v}") - less(f"_s_{v}"), F.col(f"_top._c_{v}") - less(f"_c_{v}")) for v in values}
    return out.withColumns(means).select(*df.columns)
