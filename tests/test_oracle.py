"""Every registered query against its DuckDB oracle on the smallest driver tables,
plus the driver contract (entry, key agreement, column names)."""

import os
import sys

import pytest

from table_fixtures import SF_SMOKE

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and "median_los" in df.columns


def test_every_oracle_key_is_a_query():
    from __spark_entry__ import oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from compare import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return con


def _keys():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, duck, key):
    from __spark_entry__ import oracle_sql, queries
    from compare import digest
    df = queries()[key](spark, SF_SMOKE)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]
