"""A subset of registered queries against their DuckDB oracles at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SUBSET = ["column_missing", "column_types", "assoc_spearman", "assoc_purity", "metric_choice", "profile_orders",
          "attempt_history", "split_stratified", "eval_ranking", "native_types"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    a = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(E.oracle_sql()[name])
    b = rows_of([d[0] for d in res.description], res.fetchall())
    assert a == b


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 6
    assert "inferred_type" in df.columns
