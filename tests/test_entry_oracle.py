"""Driver contract: entry runs; every query has matching oracle SQL (small SF)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tenderlake.plans.registry import REGISTRY
from tenderlake.sources.tables import TABLES

sys_path = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "similarity_score" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


LIBRARY = [n for n in E.oracle_sql() if n in REGISTRY]


@pytest.mark.parametrize("name", LIBRARY)
def test_against_duckdb(spark, sf, name):
    import sys
    sys.path.insert(0, os.path.join(sys_path, "tools"))
    from check_oracle import digest
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sdf = E.queries()[name](spark, sf)
    rel = con.sql(E.oracle_sql()[name])
    s_rows = [tuple(r) for r in sdf.collect()]
    o_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert digest(sdf.columns, s_rows)[0] == digest(rel.columns, o_rows)[0]
