"""Queries over all their rows against their SQL, on tables with nulls in the columns they read."""

import duckdb
import pytest

from spectraloom.plans import ORACLE_SQL, QUERIES
from test_queries import SF, TABLES, table_of

#: Queries whose results change where a cell, a level or a price is missing.
NAMES = ["asof_interpolate", "drift_rates", "field_boundaries", "fill_gaps", "harmonic_fit", "level_timeline", "lineage_union", "poisson_novelty", "provenance_chain", "softmax_scores"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables; of the events some have no cell or no level, of the parts one size has no price."""
    at = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    changed = {
        "events": "SELECT * REPLACE (CASE WHEN event_id % 11 = 0 THEN '{}' ELSE props END AS props, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value)",
        "part": "SELECT * REPLACE (CASE WHEN p_size IN (1, 20, 21) THEN NULL ELSE p_retailprice END AS p_retailprice)",
    }
    for t in TABLES:
        c.execute(f"COPY ({changed.get(t, 'SELECT *')} FROM read_parquet('{SF}/{t}.parquet')) TO '{at}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    return str(at), c


@pytest.mark.parametrize("name", NAMES)
def test_query_takes_all_rows(spark, odd, name):
    at, duck = odd
    df = QUERIES[name](spark, at)
    found = duck.sql(ORACLE_SQL[name])
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of(found.columns, found.fetchall())
