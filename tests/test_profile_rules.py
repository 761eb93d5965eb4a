"""Profile behaviour on fixture-shaped frames (one named property per case)."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from factsheet import ProfileRefused, profile_table


def _df(spark, cols: dict, schema: str):
    rows = list(zip(*cols.values()))
    return spark.createDataFrame(rows, schema)


def _cols(p):
    return {r["name"]: r.asDict() for r in p.columns.collect()}


def test_constant_text_is_boolean_and_constant(spark):
    rng = random.Random(1)
    n = 60
    df = _df(spark, {"id": list(range(n)), "flag_col": ["N"] * n, "feature": [rng.gauss(0, 1) for _ in range(n)],
                     "target": [i % 5 < 3 for i in range(n)]},
             "id long, flag_col string, feature double, target boolean")
    p = profile_table(df, "target", duplicates=False)
    c = _cols(p)
    assert c["flag_col"]["inferred_type"] == "boolean"
    assert c["flag_col"]["flags"] == ["constant"]
    assert c["flag_col"]["target_association"] in (None, 0.0)
    assert c["id"]["flags"] == ["id_like"]
    ds = p.dataset.collect()[0]
    assert ds.problem_type == "binary_classification" and ds.task_confidence == 0.95
    assert ds.class_balance_ratio == 1.5 and ds.primary_metric == "accuracy"


def test_quasi_constant_never_on_target(spark):
    n = 200
    df = _df(spark, {"mostly_same": ["North"] * 199 + ["South"], "target": ["a"] * 199 + ["b"],
                     "x": [float(i % 7) for i in range(n)]}, "mostly_same string, target string, x double")
    c = _cols(profile_table(df, "target", duplicates=False))
    assert "quasi_constant" in c["mostly_same"]["flags"]
    assert "quasi_constant" not in c["target"]["flags"]
    assert c["mostly_same"]["sample_values"] == ["North", "South"]
    assert c["mostly_same"]["top_value_pct"] == pytest.approx(0.995)


def test_numeric_as_string_uses_cleaned_values(spark):
    rng = random.Random(7)
    vals = [round(rng.uniform(50, 9900), 2) for _ in range(70)]
    text = [f"${v:,.2f}" for v in vals]
    df = _df(spark, {"price": text, "target": [i % 2 for i in range(70)]}, "price string, target int")
    c = _cols(profile_table(df, "target", duplicates=False))["price"]
    assert c["inferred_type"] == "numeric_continuous"
    assert c["flags"][0] == "numeric_as_string"
    assert c["parse_rate"] == 1.0
    assert c["mean"] == pytest.approx(float(np.mean(vals)))
    assert c["median"] == pytest.approx(float(np.median(vals)))
    assert c["std"] == pytest.approx(float(np.std(vals, ddof=1)))


def test_discrete_boundary_20_vs_21(spark):
    df = _df(spark, {"a20": [i % 20 for i in range(200)], "a21": [i % 21 for i in range(200)],
                     "target": [i % 2 for i in range(200)]}, "a20 int, a21 int, target int")
    c = _cols(profile_table(df, "target", duplicates=False))
    assert c["a20"]["inferred_type"] == "numeric_discrete"
    assert c["a21"]["inferred_type"] == "numeric_continuous"


def test_datetime_formats_and_na_tokens(spark):
    base = pd.date_range("2020-01-01", periods=50, freq="7D")
    df = _df(spark, {"iso": [d.strftime("%Y-%m-%d") for d in base],
                     "us": [f"{d.month}/{d.day}/{d.year}" for d in base],
                     "long": [d.strftime("%B %d, %Y") for d in base],
                     "target": [i % 2 for i in range(50)]}, "iso string, us string, long string, target int")
    c = _cols(profile_table(df, "target", duplicates=False))
    for k in ("iso", "us", "long"):
        assert c[k]["inferred_type"] == "datetime" and c[k]["parse_rate"] == 1.0, k


def test_refusals(spark):
    df = _df(spark, {"f": [1.0, 2.0, 3.0], "t": ["yes", "yes", "yes"], "e": [None, None, None],
                     "name": ["a", "b", "c"]}, "f double, t string, e string, name string")
    with pytest.raises(ProfileRefused) as e:
        profile_table(df, "t")
    assert e.value.code == "TARGET_SINGLE_VALUE"
    with pytest.raises(ProfileRefused) as e:
        profile_table(df, "e")
    assert e.value.code == "TARGET_ALL_NULL"
    with pytest.raises(ProfileRefused) as e:
        profile_table(df, "missing")
    assert e.value.code == "TARGET_NOT_FOUND"
    with pytest.raises(ProfileRefused) as e:
        profile_table(df, "name")
    assert e.value.code == "TARGET_TYPE_UNSUPPORTED"


def test_override_matrix(spark):
    df = _df(spark, {"rating": [1 + i % 5 for i in range(40)], "x": [float(i) for i in range(40)]},
             "rating int, x double")
    p = profile_table(df, "rating", duplicates=False)
    assert p.dataset.collect()[0].task_confidence == 0.65
    p = profile_table(df, "rating", override="regression", duplicates=False)
    ds = p.dataset.collect()[0]
    assert ds.problem_type == "regression" and ds.task_confidence == 1.0 and ds.task_overridden
    with pytest.raises(ProfileRefused):
        profile_table(df, "x", override="binary_classification")


def _spearman(f, t):
    d = pd.DataFrame({"f": f, "t": t}).dropna()
    r = d.rank()
    return abs(r["f"].corr(r["t"]))


def _eta(x, g):
    d = pd.DataFrame({"x": x, "g": g}).dropna()
    m = d["x"].mean()
    tot = ((d["x"] - m) ** 2).sum()
    b = d.groupby("g")["x"].apply(lambda v: len(v) * (v.mean() - m) ** 2).sum()
    return math.sqrt(max(0.0, min(1.0, b / tot)))


def _purity(c, k):
    d = pd.DataFrame({"c": c, "k": k}).dropna()
    base = d["k"].value_counts(normalize=True).max()
    w = d.groupby("c")["k"].apply(lambda v: v.value_counts(normalize=True).max() * len(v)).sum() / len(d)
    return max(0.0, min(1.0, (w - base) / (1 - base)))


def test_association_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 400
    y = rng.lognormal(3, 1, n).round(1)
    f1 = np.where(rng.random(n) < 0.2, np.nan, y * 2 + rng.normal(0, 30, n))
    f2 = rng.integers(0, 6, n).astype(float)
    cat = np.array(["a", "b", "c", "d"])[rng.integers(0, 4, n)]
    pdf = pd.DataFrame({"y": y, "f1": f1, "f2": f2, "cat": cat})
    df = spark.createDataFrame(pdf)
    c = _cols(profile_table(df, "y", duplicates=False))
    assert c["f1"]["association_method"] == "spearman"
    assert c["f1"]["target_association"] == pytest.approx(_spearman(f1, y), abs=1e-9)
    assert c["f2"]["target_association"] == pytest.approx(_spearman(f2, y), abs=1e-9)
    assert c["cat"]["association_method"] == "eta"
    assert c["cat"]["target_association"] == pytest.approx(_eta(y, cat), abs=1e-9)
    cls = np.where(y > np.median(y), "hi", "lo")
    pdf2 = pd.DataFrame({"cls": cls, "f1": f1, "cat": cat, "leak": np.where(rng.random(n) < 0.01, "x", cls)})
    c2 = _cols(profile_table(spark.createDataFrame(pdf2), "cls", duplicates=False))
    assert c2["f1"]["target_association"] == pytest.approx(_eta(f1, cls), abs=1e-9)
    assert c2["cat"]["target_association"] == pytest.approx(_purity(cat, cls), abs=1e-9)
    assert "potential_leakage" in c2["leak"]["flags"]


def test_association_invariants_on_driver_tables(spark):
    from factsheet.plans import inputs as I

    for name, target in [("orders", "o_orderstatus"), ("lineitem", "l_extendedprice"), ("customer", "c_acctbal")]:
        df = I.table(spark, "/root/testdata/sf0.001", name)
        for r in profile_table(df, target, duplicates=False).columns.collect():
            a = r["target_association"]
            assert (a is None) == (r["association_method"] == "none")
            assert a is None or 0.0 <= a <= 1.0
            if "id_like" in r["flags"]:
                assert r["sample_values"] is None
