"""Profiles of odd tables, of every given table, and what a profile leaves behind."""

import os

import pytest
from pyspark.sql import functions as F

from factsheet import ProfileRefused, profile_table
from factsheet.operators.stats import duplicate_row_count
from factsheet.plans.profile import column_facts
from factsheet.session import checkpoint_folder, scratch_scope, store

SF = "/root/testdata/sf0.001"
TARGETS = {"region": "r_name", "nation": "n_regionkey", "customer": "c_mktsegment", "supplier": "s_nationkey",
           "part": "p_size", "orders": "o_orderstatus", "lineitem": "l_returnflag", "events": "event_type",
           "documents": "lang", "embeddings": "label", "pages": "page_id", "benchmark": "item_id", "labels": "toxic",
           "conversations": "role"}


@pytest.mark.parametrize("name", sorted(TARGETS))
def test_invariants_of_every_table(spark, name):
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    n = df.count()
    try:
        p = profile_table(df, TARGETS[name])
    except ProfileRefused as e:
        assert e.code in ("TARGET_TYPE_UNSUPPORTED", "TARGET_SINGLE_VALUE", "TARGET_ALL_NULL")
        return
    ds, cols = p.dataset.collect()[0], p.columns.collect()
    p.release()
    assert ds["n_rows"] == n and ds["n_columns"] == len(df.columns) == len(cols)
    assert 0 <= ds["duplicate_row_count"] < max(n, 1)
    for r in cols:
        assert 0 <= r["missing_count"] <= n and 0 <= r["missing_pct"] <= 1
        assert r["unique_count"] <= n - r["missing_count"]
        assert r["top_value_pct"] is None or 0 < r["top_value_pct"] <= 1
        assert r["target_association"] is None or 0 <= r["target_association"] <= 1
        assert (r["name"] == TARGETS[name]) <= (r["target_association"] is None)
        assert r["min"] is None or r["min"] <= r["median"] <= r["max"]
        assert r["sample_values"] is None or all(len(v) <= 40 for v in r["sample_values"])


def test_release_leaves_nothing(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    p = profile_table(df, "l_extendedprice")
    assert p.columns.count() == len(df.columns)
    paths = list(p.scratch.paths)
    assert paths
    p.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    assert not any(os.path.exists(x.removeprefix("file:")) for x in paths)


def test_stored_tables_belong_to_their_scope(spark):
    with scratch_scope(spark) as scope:
        df = store(spark.range(5).repartition(3), "scope")
        assert df.count() == 5 and len(scope.paths) == 1
    scope.release()
    assert scope.paths == []


def test_checkpoint_folder_is_refused_on_a_cluster_without_one():
    assert checkpoint_folder("hdfs://x/y", "yarn") == "hdfs://x/y"
    assert checkpoint_folder(None, "local[4]") is None and checkpoint_folder(None, "local") is None
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            checkpoint_folder(None, master)


def test_odd_column_names_and_map_columns(spark):
    df = spark.createDataFrame(
        [(i, f"v{i % 3}", i % 2, {"k": i % 4}, float(i), i) for i in range(60)],
        "`a``b` long, `c.d` string, _n int, _h map<string,int>, `__salt` double, n long")
    p = profile_table(df.unionByName(df.limit(5)), "_n")
    assert p.columns.count() == 6
    assert p.dataset.collect()[0]["duplicate_row_count"] == 5
    p.release()
    assert duplicate_row_count(df).collect()[0][0] == 0


def test_long_texts_are_compared_whole_and_read_as_written(spark):
    head = "x" * 100
    rows = [(head + str(i % 4), "1" * 80, " " * 70 + "2020-01-02" + " " * 20, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "t string, number string, date string, y int")
    with scratch_scope(spark) as scope:
        cf = column_facts(df, "y")
        got = {r["name"]: r for r in cf.stats.collect()}
        longest = cf.freq.agg(F.max(F.length("ks")), F.max(F.length("head"))).first()
    scope.release()
    assert got["t"]["unique_count"] == 4 and got["number"]["num_count"] == 40 and got["date"]["dt_count"] == 40
    assert longest[0] <= 64 and longest[1] <= 40
    p = profile_table(df, "y")
    values = {r["name"]: r["sample_values"] for r in p.columns.collect()}
    p.release()
    assert values["t"] is None or all(v == head[:40] for v in values["t"])


def test_wide_decimals_keep_their_digits(spark):
    df = spark.sql("SELECT CAST(100000000000000000000000000000000000 + id AS DECIMAL(38,0)) AS d, id % 2 AS y FROM range(50)")
    with scratch_scope(spark) as scope:
        got = {r["name"]: r["unique_count"] for r in column_facts(df, "y").stats.collect()}
    scope.release()
    assert got["d"] == 50


def _jobs(spark, group, df, target):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        p = profile_table(df, target)
        p.dataset.collect(), p.columns.collect()
        p.release()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc._jsc.clearJobGroup()


def test_jobs_do_not_grow_with_columns(spark):
    rows = spark.range(400)
    target = F.when(F.col("id") % 3 == 0, "yes").otherwise("no").alias("t")

    def wide(times):
        return rows.select(target, *(c.alias(f"{n}{i}") for i in range(times) for n, c in (
            ("x", F.col("id") * (i + 1) + 0.5), ("level", F.concat(F.col("id") % (i + 3), F.lit("a"))),
            ("word", F.concat(F.lit("w"), F.col("id") % (i + 4))))))

    few, many = _jobs(spark, "few", wide(1), "t"), _jobs(spark, "many", wide(6), "t")
    assert many <= few <= 30


def test_pairs_are_made_in_generated_code(spark):
    from factsheet.operators.association import _exploded

    df = spark.createDataFrame([(1.0, "a", "x"), (None, "b", "x"), (2.0, None, None)], "f double, g string, t string")
    long = _exploded(df, {0: {"x": F.col("f")}, 1: {"fs": F.col("g")}}, {"x": "double", "fs": "string"}, {"t": F.col("t")})
    assert sorted(map(tuple, long.collect()), key=str) == [(0, 1.0, None, "x"), (1, None, "a", "x"), (1, None, "b", "x")]
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(long._jdf.queryExecution(), "formatted")
    assert "* Generate" in plan
