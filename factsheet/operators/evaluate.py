"""Scoring of a prediction table the user supplies (K12-K16); nothing is invented."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsheet import thresholds as T
from factsheet.functions.scalar import col_
from factsheet.operators.ranking import prefix_counts


def classification_metrics(df: DataFrame, label: str, pred: str, positive=None) -> DataFrame:
    """Accuracy, f1 for ``positive`` (binary), f1_macro over the classes seen in labels or predictions.

    One shuffle to a confusion table (classes x classes rows), then small aggregates.
    """
    conf = (df.where(col_(label).isNotNull() & col_(pred).isNotNull())
            .groupBy(col_(label).cast("string").alias("y"), col_(pred).cast("string").alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))
    per_y = conf.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("ny"),
                                                     F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("tp"))
    per_p = conf.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("np"))
    cls = per_y.join(per_p, "cls", "full").fillna(0, ["ny", "np", "tp"])
    f1 = F.when(F.col("ny") + F.col("np") > 0, 2.0 * F.col("tp") / (F.col("ny") + F.col("np"))).otherwise(0.0)
    pos = F.lit(None if positive is None else str(positive))
    return cls.agg(
        (F.sum("tp") / F.sum("ny")).alias("accuracy"),
        F.max(F.when(F.col("cls") == pos, f1)).alias("f1"),
        F.avg(f1).alias("f1_macro"))


def ranking_metrics(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """roc_auc (rank formula, ties averaged) and pr_auc (average precision).

    Scores are counted per distinct value; ranks and the 'at or above'
    counts come from one pass of prefix counts that carries rows and positives.
    """
    d = (df.where(col_(label).isNotNull() & col_(score).isNotNull())
         .groupBy(col_(score).cast("double").alias("s"))
         .agg(F.count(F.lit(1)).alias("n"), F.sum((col_(label) == F.lit(positive)).cast("long")).alias("pn")))
    both = prefix_counts(d, [], "s", ("n", "pn"))
    at_n, at_p = F.col("n_total") - F.col("n_before"), F.col("pn_total") - F.col("pn_before")  # rows at or above
    sums = both.agg(
        F.max("pn_total").alias("P"), (F.max("n_total") - F.max("pn_total")).alias("N"),
        F.sum(F.col("pn") * (F.col("n_before") + (F.col("n") + 1) / 2.0)).alias("rsum"),
        F.sum(F.col("pn") * at_p / at_n).alias("ap"))
    P, N = F.col("P"), F.col("N")
    return sums.select(
        F.when((P > 0) & (N > 0), (F.col("rsum") - P * (P + 1) / 2.0) / (P * N)).cast("double").alias("roc_auc"),
        F.when(P > 0, F.col("ap") / P).cast("double").alias("pr_auc"))


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Rmse, mae, r2 in one aggregate."""
    y, p = col_(label).cast("double"), col_(pred).cast("double")
    ok = df.where(y.isNotNull() & p.isNotNull())
    return ok.agg(F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
                  (1.0 - F.sum(F.pow(y - p, 2)) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))


def target_skew(df: DataFrame, col: str) -> DataFrame:
    """Bias-corrected skewness and whether it exceeds the advisory threshold."""
    x = col_(col).cast("double")
    n = F.count(x)
    g = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return df.agg(g.alias("skew")).select("skew", (F.abs("skew") > T.TARGET_SKEW_THRESHOLD).alias("advisory"))


def value_distribution(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max] (the top edge falls in the last bin)."""
    x = col_(col).cast("double")
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).collect()[0]
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bucket int, n bigint")
    width = (hi - lo) or 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width) * bins), F.lit(bins - 1)).cast("int")
    return df.where(x.isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
