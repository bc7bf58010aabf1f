"""The pN_ queries on the smallest tables: those with SQL give its rows, the others run over whole tables with their columns."""

import os

import duckdb
import pytest

from broadsheet.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in os.listdir(data):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{data}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    q = duck.execute(SQL[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == cols
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in q.fetchall())


COLUMNS = {"p1_found": ["article_id"], "p2_found": ["article_id", "title_id"], "p3_found": ["article_id", "topic"], "p6_found": ["article_id", "kind", "piece"]}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0
    if name in COLUMNS:
        assert df.distinct().count() == df.count()
