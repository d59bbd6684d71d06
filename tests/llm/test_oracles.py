import duckdb
import pytest

from quillspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = c.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, want.fetchall()))
