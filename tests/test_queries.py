"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from momentlake.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return c


def rows(columns, values):
    """Rows with columns by name, floats to nine places, in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, small, duck, name):
    mine = QUERIES[name](spark, small)
    theirs = duck.execute(ORACLES[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows(mine.columns, mine.collect()) == rows(names, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
