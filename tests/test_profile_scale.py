"""What grows with the input: stored rows, sizes of shuffled keys, splits; results next to pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factsheet.operators import association as A
from factsheet.operators import stats as S
from factsheet.operators.columns import column_specs
from factsheet.session import scratch_scope, small_splits


def test_spearman_stores_no_pairs(spark):
    """Ranks meet the rows without a stored table of pairs; hot target values, nulls on either side, a constant feature."""
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({"a": rng.permutation(n).astype(float), "b": rng.integers(0, 40, n).astype(float), "k": 1.0,
                        "t": np.where(rng.random(n) < 0.4, 7.0, rng.random(n))})
    pdf.loc[rng.random(n) < 0.3, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "t"] = np.nan
    pdf["t"] += pdf["b"].fillna(0) / 100
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])
    with scratch_scope(spark) as scope:
        got = {r["ordinal"]: r["association"] for r in A.associations(
            df, {0: "spearman", 1: "spearman", 2: "spearman"}, {i: F.col(c) for i, c in enumerate("abk")}, {},
            F.col("t"), None, classification=False).collect()}
    stored = [spark.read.parquet(p).count() for p in scope.paths]
    scope.release()
    for i, c in enumerate("ab"):
        pairs = pdf[[c, "t"]].dropna()
        assert got[i] == pytest.approx(abs(pairs[c].rank().corr(pairs["t"].rank())), abs=1e-9)
    assert got[2] is None
    values = pdf["t"].nunique() + sum(pdf.dropna(subset="t")[c].nunique() for c in "abk")
    pairs = sum(len(pdf[[c, "t"]].dropna().drop_duplicates()) for c in "abk")
    assert max(stored) <= values < pairs


def test_only_rows_with_a_shared_hash_are_compared_whole(spark):
    """Null and value changing places hash alike without the null marks; equal rows, long texts, NaN and signed zeros count."""
    rows = [(i, f"v{i}", float(i)) for i in range(300)] + [(None, "a", None), (None, None, 1.0), (None, None, None)] * 2 + [
        (1000, "x" * 100, 0.0), (1000, "x" * 100, -0.0), (1001, "y", float("nan")), (1001, "y", float("nan"))]
    df = spark.createDataFrame(rows, "a long, b string, c double")
    with scratch_scope(spark) as scope:
        got = S.duplicate_row_count(df).collect()[0][0]
    stored = spark.read.parquet(scope.paths[0]).count()
    scope.release()
    assert got == df.count() - df.distinct().count() == 5
    assert stored == 5


def test_counting_reads_small_splits(spark, tmp_path):
    """The counting pass reads splits of bounded size and leaves the session as it was."""
    path, key = str(tmp_path / "t"), "spark.sql.files.maxPartitionBytes"
    spark.range(20000).selectExpr("id", "cast(id % 7 AS double) AS x").repartition(8).write.parquet(path)
    before = spark.conf.get(key)
    spark.conf.set(key, "1g")
    try:
        with small_splits(spark):
            assert int(spark.conf.get(key)) == 16 << 20
        assert spark.conf.get(key) == "1g"
        spark.conf.set(key, "1000")
        with small_splits(spark):
            assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)
    spec = column_specs(spark.read.parquet(path))
    assert "long" not in S.raw_frequencies(spark.read.parquet(path), spec)._jdf.queryExecution().optimizedPlan().toString()


ODD = ["12", "-12", "+5", " 7 ", "1.5", ".5", "1.", "1e5", "1E-5", "-1.5e+3", "inf", "-Infinity", "nan", "1-2", "2020-01-05", "5-", "$5", "1,000", "12%", "abc",
       "True", "true", "FALSE", "tRue", "t", "", "  ", " 3", "9" * 18, "9" * 19, "9" * 25, "-" + "9" * 19, "1_0", "0x1F", "1d", "1" * 70, " " * 70 + "8",
       "1" * 63 + "x", "e", "Infinit", "é", "1 2", "+", "-", "1+", "5" * 20 + ".5", None]


def test_fast_paths_agree_with_the_rules(spark):
    """Numbers and value kinds told early are those that the whole rules give."""
    from factsheet.functions import scalar as G
    from factsheet.sources import csv as C

    df = spark.createDataFrame([(v,) for v in ODD], "v string")
    s, v = G.clean_number_text("v"), G.strip("v")
    d = s.cast("double")
    number = F.when(s.rlike(G.NUMBER_RE) & ((F.abs(d) != float("inf")) | s.rlike(G._INF_RE)), d)
    dec = v.try_cast("decimal(38,0)")
    size = F.when(v.try_cast("bigint").isNotNull(), C.INT64).when(
        dec.between(F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)")), C.UINT64).otherwise(C.HUGE)
    kinds = F.when(F.col("v").isNull(), C.GAP).when(
        v.rlike(C.INT_RE), size.bitwiseOR(F.when(F.startswith(v, F.lit("-")), C.NEGATIVE).otherwise(0))).when(
        v.rlike(C.NUMBER_RE), C.REAL).when(F.col("v").isin(*C.PANDAS_BOOL_TOKENS), C.BOOL).otherwise(C.TEXT)
    got = df.select("v", G.parse_number("v").alias("a"), number.alias("b"), C.value_kinds(F.col("v")).alias("c"), kinds.alias("d")).collect()
    assert [(r.v, r.a, r.c) for r in got] == [(r.v, r.b, r.d) for r in got]


def test_csv_is_parsed_once_for_what_follows(spark, tmp_path):
    """What load_csv returns is read from a typed table, not parsed again by every job."""
    from factsheet.sources import csv as C

    (tmp_path / "t.csv").write_text("a b,c;d,e\n1,x,2.5\n2,,3\n")
    df = C.load_csv(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in df.orderBy("a b").collect()] == [(1, "x", 2.5), (2, None, 3.0)]
    assert df.columns == ["a b", "c;d", "e"] and not any(f.endswith(".csv") for f in df.inputFiles())


def test_eta_makes_no_row_per_feature(spark):
    """Numeric features are aggregated side by side, more of them than one aggregate holds; nulls on either side."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({f"x{i}": rng.normal(size=600) for i in range(10)} | {"y": rng.integers(0, 3, 600)})
    pdf["x3"] += pdf["y"] * 2
    pdf.loc[:200, "x4"] = np.nan
    pdf["x9"] = 1.0
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(f"x{i}"), F.col(f"x{i}")).alias(f"x{i}") for i in range(10)],
                                           F.when(F.col("x0") < 2, F.col("y")).alias("y"))
    out = A.associations(df, {i: "eta_num" for i in range(10)}, {i: F.col(f"x{i}") for i in range(10)}, {}, None,
                         (F.col("y"), None, None), classification=True)
    got = {r["ordinal"]: r["association"] for r in out.collect()}
    for i in range(9):
        p = pdf[pdf["x0"] < 2][[f"x{i}", "y"]].dropna()
        x, m = p[f"x{i}"], p.groupby("y")[f"x{i}"].transform("mean")
        assert got[i] == pytest.approx((((m - x.mean()) ** 2).sum() / ((x - x.mean()) ** 2).sum()) ** 0.5, abs=1e-9)
    assert got[9] is None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate [tl")
