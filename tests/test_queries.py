"""Every registered query of the reference's operators against its SQL, by value."""

import os
import re

import duckdb
import pandas as pd
import pytest
from tidewave.plans import catalog as registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iuf" or str(df[c].dtype) == "Int64":
            df[c] = df[c].astype(float).round(6) + 0.0
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_against_sql(spark, con, name):
    pd.testing.assert_frame_equal(normal(registry.QUERIES[name](spark, DIR).toPandas()), normal(con.execute(registry.ORACLES[name]).df()))


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


@pytest.mark.parametrize("name", ["q_ccg_counts", "q_acg", "q_ccg_2d", "q_align_times", "q_in_periods", "q_cisi_nearest", "q_corr_index"])
def test_no_nested_loop_joins(spark, name):
    plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().toString()
    assert not re.search("BroadcastNestedLoopJoin|CartesianProduct", plan)


def test_entry_and_its_keys(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
