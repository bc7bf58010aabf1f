"""Every core query with an SQL oracle gives the oracle's rows; the others run and keep their schema."""

import math
import os

import duckdb
import pytest

from broadsheet.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in os.listdir(data):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{data}/{t}'")
    return c


def _cell(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else None if isinstance(v, float) else v


def _near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-5 * max(1, abs(a))
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = [[_cell(r[c]) for c in cols] for r in df.collect()]
    q = duck.execute(SQL[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == cols
    want = [[_cell(r[names.index(c)]) for c in cols] for r in q.fetchall()]
    key = lambda r: tuple(f"{v:.3f}" if isinstance(v, float) else str(v) for v in r)
    got.sort(key=key)
    want.sort(key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(map(_near, a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.limit(5).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())
