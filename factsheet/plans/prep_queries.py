"""Queries for plan-step operators (K1-K16) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from factsheet.operators import evaluate as E
from factsheet.operators import prep as P
from factsheet.plans import inputs as I
from factsheet.plans.oracle import VIEWS, parsed_number

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r(x, d=6):
    return F.round(x if not isinstance(x, str) else F.col(x), d)


def _bucket_sql(key: str, b: int) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % {b})"


_LKEY = "concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR))"


def _lkey():
    return F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))


@q("prep_coerce")
def prep_coerce(spark, sf):
    """K1 the written price text of every order back to a number."""
    df = I.orders_text(spark, sf).select("o_orderkey", "price_text")
    return P.coerce_numbers(df, ["price_text"]).select("o_orderkey", r("price_text", 2).alias("price"))


ORACLE["prep_coerce"] = (f"SELECT o_orderkey, round({parsed_number('price_text')}, 2) AS price "
                         f"FROM ({VIEWS['orders_text']})")


@q("prep_drop")
def prep_drop(spark, sf):
    """K2 declared columns dropped from orders."""
    return P.drop_columns(I.table(spark, sf, "orders"), ["o_custkey", "o_orderdate", "o_not_there"])


ORACLE["prep_drop"] = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@q("split_holdout")
def split_holdout(spark, sf):
    """K9 80/20 hold-out split of orders by md5 bucket of the order key."""
    return P.split_holdout(I.table(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey"))


ORACLE["split_holdout"] = (f"SELECT o_orderkey, CASE WHEN {_bucket_sql('o_orderkey', 100)} < 80 THEN 'train' "
                           f"ELSE 'test' END AS split FROM orders")


@q("split_kfold")
def split_kfold(spark, sf):
    """K10 five folds of orders by md5 bucket of the order key."""
    return P.split_kfold(I.table(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey"), 5)


ORACLE["split_kfold"] = f"SELECT o_orderkey, CAST({_bucket_sql('o_orderkey', 5)} AS INTEGER) AS fold FROM orders"


@q("split_stratified")
def split_stratified(spark, sf):
    """K11 five stratified folds of lineitem by return flag (hash order within each class)."""
    li = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return P.split_stratified(li, ["l_orderkey", "l_linenumber"], "l_returnflag", 5)


ORACLE["split_stratified"] = (
    f"SELECT l_orderkey, l_linenumber, l_returnflag, CAST((row_number() OVER (PARTITION BY l_returnflag "
    f"ORDER BY md5({_LKEY}), {_LKEY}) - 1) % 5 AS INTEGER) AS fold FROM lineitem")

_TRAIN_LI = f"{_bucket_sql(_LKEY, 100)} < 80"


def _li_train(spark, sf):
    li = I.lineitem_nulls(spark, sf)
    return li, P.split_holdout(li, _lkey()).where(F.col("split") == "train")


@q("prep_impute")
def prep_impute(spark, sf):
    """K3 missing l_tax filled with the training-split median."""
    li, train = _li_train(spark, sf)
    out = P.impute_median(li.select("l_orderkey", "l_linenumber", "l_tax"), train, ["l_tax"])
    return out.select("l_orderkey", "l_linenumber", r("l_tax").alias("l_tax"))


ORACLE["prep_impute"] = (
    f"WITH v AS ({VIEWS['lineitem_nulls']}) SELECT l_orderkey, l_linenumber, round(coalesce(l_tax, "
    f"(SELECT median(l_tax) FROM v WHERE {_TRAIN_LI})), 6) AS l_tax FROM v")


@q("prep_scale")
def prep_scale(spark, sf):
    """K4 l_quantity and l_extendedprice standardised with training mean and population std."""
    li, train = _li_train(spark, sf)
    cols = ["l_quantity", "l_extendedprice"]
    out = P.standard_scale(li.select("l_orderkey", "l_linenumber", *cols), train, cols)
    return out.select("l_orderkey", "l_linenumber", *[r(c, 5).alias(c) for c in cols])


ORACLE["prep_scale"] = (
    f"WITH v AS ({VIEWS['lineitem_nulls']}), s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, "
    f"avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se FROM v WHERE {_TRAIN_LI}) "
    f"SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT mq FROM s)) / (SELECT sq FROM s), 5) AS l_quantity, "
    f"round((l_extendedprice - (SELECT me FROM s)) / (SELECT se FROM s), 5) AS l_extendedprice FROM v")


@q("prep_indicator")
def prep_indicator(spark, sf):
    """K6 missing-value indicator for l_tax."""
    li = I.lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_tax")
    return P.missing_indicator(li, ["l_tax"]).select("l_orderkey", "l_linenumber", "l_tax_missing")


ORACLE["prep_indicator"] = (f"SELECT l_orderkey, l_linenumber, CAST(l_tax IS NULL AS INTEGER) AS l_tax_missing "
                            f"FROM ({VIEWS['lineitem_nulls']})")


@q("prep_freq")
def prep_freq(spark, sf):
    """K7 frequency encoding of the customer of each order."""
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return P.frequency_encode(o, "o_custkey").select("o_orderkey", r("o_custkey_freq").alias("o_custkey_freq"))


ORACLE["prep_freq"] = ("SELECT o_orderkey, round(COUNT(*) OVER (PARTITION BY o_custkey) / "
                       "(SELECT COUNT(*) FROM orders), 6) AS o_custkey_freq FROM orders")


@q("prep_onehot")
def prep_onehot(spark, sf):
    """K5 sparse one-hot of part type: own feature from 20 training rows, rarer ones grouped."""
    part = I.table(spark, sf, "part").select("p_partkey", "p_type")
    train = P.split_holdout(part, F.col("p_partkey")).where(F.col("split") == "train")
    return P.one_hot_long(part, train, "p_partkey", "p_type")


ORACLE["prep_onehot"] = (
    f"WITH lv AS (SELECT p_type AS lvl, COUNT(*) AS c FROM part WHERE {_bucket_sql('p_partkey', 100)} < 80 "
    f"AND p_type IS NOT NULL GROUP BY p_type) SELECT p.p_partkey, CASE WHEN lv.c >= 20 THEN lv.lvl "
    f"WHEN lv.c IS NOT NULL THEN '__rare__' END AS feature FROM part p LEFT JOIN lv ON p.p_type = lv.lvl")


@q("prep_sparse_vectors")
def prep_sparse_vectors(spark, sf):
    """K5 sparse one-hot rows of all orders: priority and customer, some missing; customers with few training rows share an index."""
    o = I.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"))
    train = P.split_holdout(o, F.col("o_orderkey")).where(F.col("split") == "train")
    rows = P.sparse_vectors(o, train, ["o_orderkey"], ["o_orderpriority", "o_custkey"], min_rows=9)
    return rows.select("o_orderkey", "size", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


ORACLE["prep_sparse_vectors"] = (
    f"WITH b AS (SELECT o_orderkey, o_orderpriority AS p, CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS k, "
    f"{_bucket_sql('o_orderkey', 100)} < 80 AS learn FROM orders), "
    f"lv AS (SELECT 0 AS col, p AS lvl, COUNT(*) AS n FROM b WHERE learn AND p IS NOT NULL GROUP BY p "
    f"UNION ALL SELECT 1, k, COUNT(*) FROM b WHERE learn AND k IS NOT NULL GROUP BY k), "
    f"ix AS (SELECT col, lvl, dense_rank() OVER (ORDER BY col, n < 9, CASE WHEN n >= 9 THEN encode(lvl) END) - 1 AS i FROM lv) "
    f"SELECT o_orderkey, CAST((SELECT MAX(i) + 1 FROM ix) AS INTEGER) AS size, concat_ws(',', x.i, y.i) AS indices FROM b "
    f"LEFT JOIN ix x ON x.col = 0 AND x.lvl = b.p LEFT JOIN ix y ON y.col = 1 AND y.lvl = b.k")


@q("prep_target_encode")
def prep_target_encode(spark, sf):
    """K8 out-of-fold smoothed mean order price per customer (five folds); some customers and prices are missing."""
    o = I.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    te = P.target_encode_oof(o, "o_orderkey", "o_custkey", "o_totalprice", k=5)
    return te.select("o_orderkey", "fold", r("o_custkey_te", 3).alias("o_custkey_te"))


# by definition: what the other folds hold of the same level, missing levels being one
ORACLE["prep_target_encode"] = (
    f"WITH b AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS lvl, "
    f"CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS y, CAST({_bucket_sql('o_orderkey', 5)} AS INTEGER) AS fold "
    f"FROM orders), f AS (SELECT DISTINCT fold FROM b), "
    f"p AS (SELECT f.fold, AVG(b.y) AS prior FROM f JOIN b ON b.fold <> f.fold GROUP BY f.fold), "
    f"g AS (SELECT f.fold, b.lvl, coalesce(SUM(b.y) FILTER (WHERE b.fold <> f.fold), 0) AS s, "
    f"COUNT(b.y) FILTER (WHERE b.fold <> f.fold) AS c FROM f, b GROUP BY f.fold, b.lvl) "
    f"SELECT b.o_orderkey, b.fold, round((g.s + 20.0 * p.prior) / (g.c + 20.0), 3) AS o_custkey_te "
    f"FROM b LEFT JOIN g ON g.fold = b.fold AND g.lvl IS NOT DISTINCT FROM b.lvl LEFT JOIN p ON p.fold = b.fold")


@q("eval_classification")
def eval_classification(spark, sf):
    """K12 accuracy, f1 and f1_macro of the rule 'value > 100' against the big-error flag."""
    e = I.events_flagged(spark, sf).withColumn("pred", (F.col("value") > 100).cast("int"))
    m = E.classification_metrics(e, "big_error", "pred", positive=1)
    return m.select(*[r(c).alias(c) for c in m.columns])


ORACLE["eval_classification"] = (
    f"WITH e AS ({VIEWS['events_flagged']}), c AS (SELECT CAST(big_error AS VARCHAR) AS y, "
    f"CAST(CAST(value > 100 AS INTEGER) AS VARCHAR) AS p, COUNT(*) AS n FROM e GROUP BY 1, 2), "
    f"k AS (SELECT cls, SUM(ny) AS ny, SUM(np) AS np, SUM(tp) AS tp FROM ("
    f"SELECT y AS cls, n AS ny, 0 AS np, CASE WHEN y = p THEN n ELSE 0 END AS tp FROM c UNION ALL "
    f"SELECT p AS cls, 0, n, 0 FROM c) GROUP BY cls) "
    f"SELECT round(SUM(tp) / SUM(ny), 6) AS accuracy, "
    f"round(MAX(CASE WHEN cls = '1' THEN 2.0 * tp / (ny + np) END), 6) AS f1, "
    f"round(AVG(CASE WHEN ny + np > 0 THEN 2.0 * tp / (ny + np) ELSE 0 END), 6) AS f1_macro FROM k")


@q("eval_ranking")
def eval_ranking(spark, sf):
    """K13 roc_auc and average precision of the event value as a score for the big-error flag."""
    m = E.ranking_metrics(I.events_flagged(spark, sf), "big_error", "value", positive=1)
    return m.select(r("roc_auc").alias("roc_auc"), r("pr_auc").alias("pr_auc"))


ORACLE["eval_ranking"] = (
    f"WITH e AS ({VIEWS['events_flagged']}), d AS (SELECT value AS s, COUNT(*) AS n, SUM(big_error) AS pn "
    f"FROM e GROUP BY value), "
    f"rk AS (SELECT *, SUM(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, "
    f"SUM(n) OVER (ORDER BY s DESC) AS at_n, SUM(pn) OVER (ORDER BY s DESC) AS at_p FROM d), "
    f"t AS (SELECT SUM(pn) AS P, SUM(n) - SUM(pn) AS N, SUM(pn * (coalesce(before, 0) + (n + 1) / 2.0)) AS rsum, "
    f"SUM(pn * at_p / at_n) AS ap FROM rk) "
    f"SELECT round((rsum - P * (P + 1) / 2.0) / (P * N), 6) AS roc_auc, round(ap / P, 6) AS pr_auc FROM t")


@q("eval_regression")
def eval_regression(spark, sf):
    """K14 rmse, mae, r2 of the summed line prices as a prediction of each order's total price."""
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    li = I.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("pred"))
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    m = E.regression_metrics(j, "o_totalprice", "pred")
    return m.select(r("rmse", 3).alias("rmse"), r("mae", 3).alias("mae"), r("r2").alias("r2"))


ORACLE["eval_regression"] = (
    "WITH j AS (SELECT o.o_totalprice AS y, l.pred AS p FROM orders o JOIN (SELECT l_orderkey, "
    "SUM(l_extendedprice) AS pred FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey) "
    "SELECT round(sqrt(avg((y - p) ^ 2)), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae, "
    "round(1 - SUM((y - p) ^ 2) / (var_pop(y) * COUNT(*)), 6) AS r2 FROM j")

_SKEW = [("lineitem", "l_extendedprice"), ("orders", "o_totalprice"), ("part", "p_retailprice"),
         ("events", "value"), ("customer", "c_acctbal")]


@q("target_skew")
def target_skew(spark, sf):
    """K15 bias-corrected skewness of regression targets and the |skew| > 2 advisory."""
    out = None
    for t, c in _SKEW:
        s = E.target_skew(I.table(spark, sf, t), c).select(
            F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), (r("skew") + 0.0).alias("skew"),
            "advisory")
        out = s if out is None else out.unionByName(s)
    return out


ORACLE["target_skew"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, round(skewness({c}), 6) + 0.0 AS skew, "
    f"abs(skewness({c})) > 2.0 AS advisory FROM {t}" for t, c in _SKEW)


@q("value_distribution")
def value_distribution(spark, sf):
    """K16 ten equal-width bins of the line extended price."""
    return E.value_distribution(I.table(spark, sf, "lineitem"), "l_extendedprice", 10)


ORACLE["value_distribution"] = (
    "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) "
    "SELECT CAST(least(floor((l_extendedprice - (SELECT lo FROM m)) / ((SELECT hi FROM m) - (SELECT lo FROM m)) * 10), 9) "
    "AS INTEGER) AS bucket, COUNT(*) AS n FROM lineitem GROUP BY 1")
