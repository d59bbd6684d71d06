"""Every query with SQL against DuckDB on the smallest tables; every other one must run."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans.catalog import QUERIES
from quillspark.plans.oracles import ORACLES
from quillspark.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(want.fetchall(), names)


def test_entry(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
