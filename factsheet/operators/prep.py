"""Plan steps as DataFrame operators (K1-K11): coercion, imputation, scaling,
encodings and splits. Statistics are learned on the training rows only and
applied to every row; learned values are one row per column (or per level),
so nothing grows on the driver with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsheet import thresholds as T
from factsheet.functions.scalar import col_, md5_bucket, parse_number
from factsheet.operators.ranking import exact_medians, prefix_counts
from factsheet.session import store

RARE = "__rare__"


def split_holdout(df: DataFrame, key: Column, test_pct: int = 20) -> DataFrame:
    """K9: 'train' / 'test' by md5 bucket of the key (test_pct of 100 buckets)."""
    return df.withColumn("split", F.when(md5_bucket(key, 100) < 100 - test_pct, "train").otherwise("test"))


def split_kfold(df: DataFrame, key: Column, k: int = 5) -> DataFrame:
    """Fold in [0, k) by md5 bucket of the key."""
    return df.withColumn("fold", md5_bucket(key, k))


def split_stratified(df: DataFrame, keys: list[str], target: str, k: int = 5) -> DataFrame:
    """Within each class, rows ordered by the hash of their key are dealt
    round-robin into k folds. Returns ``(keys..., target, fold)`` per input row.

    Positions inside a class come from range-partitioned prefix counts, so a
    class holding a third of the rows never lands in one task. Rows sharing a
    key are interchangeable and take consecutive positions.
    """
    key_text = F.concat_ws("-", *[col_(c).cast("string") for c in keys])
    base = df.select(col_(target).alias("_cls"), F.md5(key_text).alias("_h"), key_text.alias("_k"),
                     *[col_(c).alias(c) for c in keys])
    grouped = base.groupBy("_cls", "_h", "_k", *keys).agg(F.count(F.lit(1)).alias("_n"))
    pos = prefix_counts(grouped, ["_cls"], ["_h", "_k", *keys], count="_n")
    dealt = pos.select("_cls", *keys, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"),
                       "before")
    return dealt.select(*keys, F.col("_cls").alias(target),
                        ((F.col("before") + F.col("_i")) % k).cast("int").alias("fold"))


def coerce_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """K1: text columns to doubles with the profiler's cleaning rule (unparseable -> null)."""
    return df.select(*[parse_number(c).alias(c) if c in cols else col_(c) for c in df.columns])


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """K2: drop declared columns (names that do not exist are ignored)."""
    return df.drop(*cols)


def learn_medians(train: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of the training rows, one per column (collected: one row per column)."""
    structs = [F.struct(F.lit(i).alias("ordinal"), col_(c).cast("double").alias("v")) for i, c in enumerate(cols)]
    long = train.select(F.inline(F.array(*structs))).where(F.col("v").isNotNull())
    freq = long.groupBy("ordinal", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["ordinal"]: r["median"] for r in exact_medians(freq, ["ordinal"]).collect()}
    return {c: got.get(i) for i, c in enumerate(cols)}


def impute_median(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """K3: nulls filled with the training-split median of each column."""
    med = learn_medians(train, cols)
    return df.select(*[F.coalesce(col_(c), F.lit(med[c])).alias(c) if c in cols else col_(c) for c in df.columns])


def standard_scale(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """K4: (x - mean) / population std of the training rows; zero std divides by 1."""
    stats = train.agg(*[x for c in cols for x in (F.avg(col_(c)).alias(f"m{c}"),
                                                   F.stddev_pop(col_(c)).alias(f"s{c}"))]).collect()[0]
    out = []
    for c in df.columns:
        if c in cols:
            m, s = stats[f"m{c}"], stats[f"s{c}"]
            s = 1.0 if not s else s
            out.append(((col_(c) - F.lit(m)) / F.lit(s)).alias(c))
        else:
            out.append(col_(c))
    return df.select(*out)


def missing_indicator(df: DataFrame, cols: list[str]) -> DataFrame:
    """K6: one 0/1 column per input column marking missing values."""
    return df.select("*", *[col_(c).isNull().cast("int").alias(f"{c}_missing") for c in cols])


def frequency_encode(df: DataFrame, col: str) -> DataFrame:
    """K7: each level replaced by its share of rows (null level -> null).

    One counting pass: the stored counts, nulls among them, give the levels and the row count.
    """
    counts = store(df.groupBy(col_(col).alias("_lvl")).agg(F.count(F.lit(1)).alias("_c")), "level-counts")
    n = counts.agg(F.sum("_c")).collect()[0][0]
    return (df.join(counts, col_(col) == F.col("_lvl"), "left")
            .withColumn(f"{col}_freq", F.col("_c") / F.lit(n)).drop("_lvl", "_c"))


def one_hot_long(df: DataFrame, train: DataFrame, key: str, col: str,
                 min_rows: int = T.RARE_LEVEL_MIN_ROWS) -> DataFrame:
    """K5 in sparse (long) form: ``(key, feature)``, one row per input row.

    Levels with at least ``min_rows`` training rows keep their own feature;
    rarer training levels share ``__rare__``; levels never seen in training
    (and nulls) have a null feature, i.e. all zeros.
    """
    levels = train.where(col_(col).isNotNull()).groupBy(col_(col).alias("_lvl")).agg(
        F.count(F.lit(1)).alias("_c"))
    feat = F.when(F.col("_c") >= min_rows, F.col("_lvl").cast("string")).when(F.col("_c").isNotNull(), F.lit(RARE))
    return (df.select(col_(key).alias(key), col_(col).alias("_v"))
            .join(levels, F.col("_v") == F.col("_lvl"), "left")
            .select(key, feat.alias("feature")))


def level_dictionary(train: DataFrame, cols: list[str], min_rows: int = T.RARE_LEVEL_MIN_ROWS) -> DataFrame:
    """K5 dictionary: ``(ordinal, level, index)`` of every training level of the columns.

    A level with at least ``min_rows`` training rows has an index of its own, the rarer ones of a column
    share one behind them. Indices count from 0 in the order of columns, then of levels, so equal training
    rows give equal indices however they are split; they come from range-sorted prefix counts, so the
    number of levels isn't bounded by a task. Null levels have no entry.
    """
    structs = [F.struct(F.lit(i).alias("ordinal"), col_(c).cast("string").alias("level")) for i, c in enumerate(cols)]
    counts = train.select(F.inline(F.array(*structs))).where(F.col("level").isNotNull()).groupBy("ordinal", "level").agg(
        F.count(F.lit(1)).alias("rows"))
    levels = store(counts.select("ordinal", "level", (F.col("rows") < min_rows).cast("int").alias("rare")), "levels")
    own = F.when(F.col("rare") == 0, F.col("level"))
    features = levels.select("ordinal", "rare", own.alias("own")).distinct().withColumn("n", F.lit(1)).withColumn("all", F.lit(0))
    placed = prefix_counts(features, ["all"], ["ordinal", "rare", "own"]).select(
        F.col("ordinal").alias("_o"), F.col("rare").alias("_r"), F.col("own").alias("_own"), F.col("before").cast("int").alias("index"))
    same = F.col("ordinal") == F.col("_o")
    frequent = levels.where("rare = 0").join(placed.where("_r = 0"), same & (F.col("level") == F.col("_own")))
    # one row a column that has rare levels
    rare = levels.where("rare = 1").join(F.broadcast(placed.where("_r = 1")), same)
    return frequent.unionByName(rare).select("ordinal", "level", "index")


def sparse_vectors(df: DataFrame, train: DataFrame, keys: list[str], cols: list[str],
                   min_rows: int = T.RARE_LEVEL_MIN_ROWS) -> DataFrame:
    """K5: one-hot rows as sparse vectors, ``(keys..., size, indices)``, one per input row.

    ``size`` is the number of features, ``indices`` the ascending places of the ones (at most one a column).
    Nulls and levels that the training rows don't have add no index; without any training level the size is 0.
    Repeated rows are encoded each. A column joins the dictionary by its level, whose rows are unique, so a hot
    level costs no more than the rows it has and can be split.
    """
    levels = store(level_dictionary(train, cols, min_rows), "level-index")
    size = levels.agg(F.coalesce(F.max("index") + 1, F.lit(0))).collect()[0][0]
    rows = df.select(*(col_(k).alias(k) for k in keys), *(col_(c).cast("string").alias(f"__v{i}") for i, c in enumerate(cols)))
    for i in range(len(cols)):
        own = levels.where(F.col("ordinal") == i).select(F.col("level").alias(f"__l{i}"), F.col("index").alias(f"__i{i}"))
        rows = rows.join(own, F.col(f"__v{i}") == F.col(f"__l{i}"), "left")
    found = F.array_compact(F.array(*(F.col(f"__i{i}") for i in range(len(cols)))))
    return rows.select(*(F.col(f"`{k}`") for k in keys), F.lit(size).cast("int").alias("size"), found.alias("indices"))


def target_encode_oof(df: DataFrame, key: str, col: str, target: str, k: int = 5,
                      m: float = T.TARGET_ENCODE_SMOOTHING) -> DataFrame:
    """K8: out-of-fold smoothed target mean of a level, one row per input row.

    A row in fold f gets (S_l - s_fl + m * prior_f) / (C_l - c_fl + m), where
    S/C are the level's target sum/count over all folds, s/c over fold f, and
    prior_f is the target mean outside fold f (null where no target is left there).
    Null is a level of its own; rows without target add nothing but are encoded.
    Per-fold sums are subtracted from totals instead of re-aggregating k times.
    """
    rows = split_kfold(df.select(col_(key).alias(key), col_(col).alias("_lvl"), col_(target).cast("double")
                                 .alias("_y")), F.col(key), k)
    sums = F.coalesce(F.sum("_y"), F.lit(0.0)), F.count("_y")
    per_fl = rows.groupBy("fold", "_lvl").agg(sums[0].alias("_s"), sums[1].alias("_c"))
    per_l = per_fl.groupBy(F.col("_lvl").alias("_of")).agg(F.sum("_s").alias("_S"), F.sum("_c").alias("_C"))
    levels = per_fl.join(per_l, F.col("_lvl").eqNullSafe(F.col("_of"))).select(
        F.col("fold").alias("_in"), "_of", (F.col("_S") - F.col("_s")).alias("_sum"), (F.col("_C") - F.col("_c")).alias("_n"))
    per_f = {r["fold"]: (r["s"], r["c"]) for r in rows.groupBy("fold").agg(
        sums[0].alias("s"), sums[1].alias("c")).collect()}  # k rows
    total = [sum(x[i] for x in per_f.values()) for i in range(2)]
    prior = F.coalesce(F.lit(None).cast("double"), *[F.when(
        F.col("fold") == f, F.lit((total[0] - s) / (total[1] - c) if total[1] > c else None).cast("double"))
        for f, (s, c) in per_f.items()])
    enc = (F.col("_sum") + F.lit(m) * prior) / (F.col("_n") + F.lit(m))
    return rows.join(levels, (F.col("fold") == F.col("_in")) & F.col("_lvl").eqNullSafe(F.col("_of"))).select(
        key, "fold", enc.alias(f"{col}_te"))
