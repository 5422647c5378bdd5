"""Every registered query against its DuckDB statement on whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from rastergrid.plans.oracles import ORACLES
from rastergrid.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got = got[columns].sort_values(columns).reset_index(drop=True)
    want = want[columns].sort_values(columns).reset_index(drop=True)
    assert len(got) == len(want)
    for c in columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), f"{c}: {got[~same].head()} {want[~same].head()}"


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["fid", "band", "gc", "gr", "value"]
