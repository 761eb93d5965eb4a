"""Operators checked against brute force on small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factsheet.operators import evaluate as E
from factsheet.operators import prep as P
from factsheet.operators import ranking as RK
from factsheet.operators.ranking import average_ranks, exact_medians


def test_ranks_and_medians_across_partitions(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 5000), "v": rng.integers(0, 300, 5000).astype(float)})
    freq = spark.createDataFrame(pdf).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    ranks = {(r["g"], r["v"]): r["rank"] for r in average_ranks(freq, ["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        expect = sub["v"].rank()
        for v, rk in zip(sub["v"], expect):
            assert ranks[(g, v)] == pytest.approx(rk)
    med = {r["g"]: r["median"] for r in exact_medians(freq, ["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        assert med[g] == pytest.approx(sub["v"].median())


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(3000)], "k long, cls string")
    out = P.split_stratified(df, ["k"], "cls", 5).groupBy("cls", "fold").count().collect()
    for cls in ("a", "b"):
        counts = [r["count"] for r in out if r["cls"] == cls]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_metrics_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 500)
    s = np.round(rng.random(500) + y * 0.3, 2)
    pdf = pd.DataFrame({"y": y, "s": s, "p": (s > 0.6).astype(int)})
    df = spark.createDataFrame(pdf)
    m = E.classification_metrics(df, "y", "p", positive=1).collect()[0]
    tp = ((pdf.y == 1) & (pdf.p == 1)).sum()
    f1 = 2 * tp / ((pdf.y == 1).sum() + (pdf.p == 1).sum())
    assert m["accuracy"] == pytest.approx((pdf.y == pdf.p).mean())
    assert m["f1"] == pytest.approx(f1)
    r = E.ranking_metrics(df, "y", "s").collect()[0]
    ranks = pdf.s.rank()
    P_, N_ = (pdf.y == 1).sum(), (pdf.y == 0).sum()
    auc = (ranks[pdf.y == 1].sum() - P_ * (P_ + 1) / 2) / (P_ * N_)
    assert r["roc_auc"] == pytest.approx(auc)
    d = pdf.sort_values("s", ascending=False)
    ap = 0.0
    for sc, grp in d.groupby("s", sort=False):
        at = d[d.s >= sc]
        ap += grp.y.sum() / P_ * at.y.sum() / len(at)
    assert r["pr_auc"] == pytest.approx(ap)


def test_hot_values_spread_and_null_keys_count(spark):
    """Half of the rows hold one value, and one key is null: totals are whole, and no partition gathers the value."""
    from factsheet.operators import ranking as RK

    rows = [(None if i % 5 == 0 else 1, 7.0 if i % 2 else float(i), float(i)) for i in range(4000)]
    pc = spark.createDataFrame(rows, "g int, f double, t double").withColumn("n", F.lit(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = RK.attach_average_rank(pc, ["g"], "f", "n", "rf")
        want = pd.DataFrame(rows, columns=["g", "f", "t"])
        want["rank"] = want.fillna({"g": -1}).groupby("g")["f"].rank()
        expect = {t: r for t, r in zip(want["t"], want["rank"])}
        collected = got.collect()
        assert len(collected) == 4000 and all(r["rf"] == expect[r["t"]] for r in collected)
        assert {r["rf_total"] for r in collected if r["g"] is None} == {800}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("limit", [1, 40])
def test_prefix_counts_agree_with_pandas(spark, limit):
    """Any number of ranges gives pandas' average ranks."""
    from factsheet.operators import ranking as RK

    spark.conf.set("spark.sql.shuffle.partitions", str(limit))
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 3000), "v": rng.integers(0, 500, 3000).astype(float),
                        "w": rng.integers(0, 50, 3000).astype(float)})
    sdf = spark.createDataFrame(pdf).repartition(5)
    freq = sdf.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["g"], r["v"]): r["rank"] for r in RK.average_ranks(freq, ["g"]).collect()}
    med = {r["g"]: r["median"] for r in RK.exact_medians(freq, ["g"]).collect()}
    pc = sdf.groupBy("g", "v", "w").agg(F.count(F.lit(1)).alias("n"))
    att = RK.attach_average_rank(pc, ["g"], "w", "n", "rw").collect()
    for g, sub in pdf.groupby("g"):
        exp = dict(zip(sub["v"], sub["v"].rank()))
        for v, rk in exp.items():
            assert got[(g, v)] == pytest.approx(rk)
        assert med[g] == pytest.approx(sub["v"].median())
        expw = dict(zip(sub["w"], sub["w"].rank()))
        for r in att:
            if r["g"] == g:
                assert r["rw"] == pytest.approx(expw[r["w"]])
                assert r["rw_total"] == len(sub)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_hot_values_stay_where_they_are(spark):
    """A value with half the rows: its rows are not dealt by the value, and ranks equal those of a plain sort."""
    df = spark.range(40000).selectExpr("1 AS g", "cast(if(id % 2 = 0, 7, id) AS double) AS w", "1L AS n").repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        out = RK.attach_average_rank(df, ["g"], "w", "n", "rw").withColumn("task", F.spark_partition_id())
        rows = out.toPandas()
        per_task = rows[rows["w"] == 7].groupby("task").size()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert per_task.max() <= 3 * 20000 / 8
    want = rows["w"].rank(method="average")
    assert (rows["rw"] == want).all() and (rows["rw_total"] == 40000).all()


def test_medians_read_only_the_middle(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    data = [(k, float(v), int(n)) for k in range(4) for v, n in zip(sorted(set(rng.integers(-50, 50, 60).tolist())), rng.integers(1, 9, 60))]
    got = {r.g: r.median for r in RK.exact_medians(spark.createDataFrame(data, "g int, v double, n long"), ["g"]).collect()}
    for k in range(4):
        assert got[k] == np.median(np.repeat([v for g, v, _ in data if g == k], [n for g, _, n in data if g == k]))
