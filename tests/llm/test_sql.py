"""The queries that SQL can express, against it, over the smallest driver tables."""

import duckdb
import pytest

from spectraloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    columns = sorted(df.columns)
    rounded = lambda x: round(x, 6) if isinstance(x, float) else x
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(rounded(v) for v in r) for r in found.select(*columns).fetchall()), key=str)
    assert got == want
