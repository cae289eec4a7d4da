"""Every query of the library against its SQL over the smallest driver tables."""

import math

import duckdb
import pytest

from spectraloom.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return int(x) if isinstance(x, bool) else x


def table_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(([plain(r[i]) for i in at] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE_SQL:
        found = duck.sql(ORACLE_SQL[name])
        assert got == table_of(found.columns, found.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_library_does_not_need_the_training_data_part():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "spectraloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+spectraloom\.llm|corpus_pipeline", path.read_text()), path
