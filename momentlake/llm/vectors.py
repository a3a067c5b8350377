"""Vectors met in blocks: a stated set of queries against all rows, as numpy products inside tasks.

Rows are dealt into cells. Queries go to every cell that they must meet, rows come first in each cell, so a task holds the rows of one cell and
lets queries stream past. No two rows are ever paired by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a cell holds at most, and at least while there are enough for that; numbers of a block of products.
CELL_ROWS, LEAST_CELL, BLOCK = 1 << 16, 512, 1 << 19
#: Cells that are aimed at between the two.
CELLS = 48


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    d = lambda x: F.abs(x.cast("double"))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda x: F.coalesce(d(x) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(x.cast("double")), F.lit(True)))


def cell_count(rows: int) -> int:
    """Cells for so many rows: enough for many tasks, none over CELL_ROWS on average."""
    size = min(CELL_ROWS, max(LEAST_CELL, rows // CELLS))
    return max(1, -(-rows // size))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of ``dim`` numbers as rows of doubles. Null lists are left out."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def stretches(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal whole numbers in ``names``."""
    values = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)
    ends = [*(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), len(values)]
    start = 0
    for end in map(int, ends):
        if end > start:
            yield tuple(values[start].tolist()), batch.slice(start, end - start)
        start = end


def meet(rows: DataFrame, queries: DataFrame, cells: int, hold: Callable[[pa.Table, int], Any], answer: Callable[[Any, pa.RecordBatch, int], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``answer(hold(rows of a cell), queries of that cell)`` gives, for all cells.

    Both sides have ``_dim`` (a vector's length: only equal ones meet) and ``_cell``; columns that only one side has are null on the other.
    Queries come in batches as Arrow has them; a cell without rows answers nothing.
    """
    key = ["_dim", "_cell"]
    both = rows.withColumn("_query", F.lit(0)).unionByName(queries.withColumn("_query", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(cells, *key).sortWithinPartitions(*key, "_query")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for batch in batches:
            for (dim, cell, query), part in stretches(batch, [*key, "_query"]):
                if (dim, cell) != now:
                    now, parts, held = (dim, cell), [], None
                if not query:
                    parts.append(part)
                elif parts:
                    if held is None:
                        held = hold(pa.Table.from_batches(parts), dim)
                    out = answer(held, part, dim)
                    if out is not None and out.num_rows:
                        yield out

    return dealt.mapInArrow(walk, schema)
