"""Feature-to-target association (D10-D13, E1, C2, B5) as long-form jobs.

Each routed feature contributes rows ``(ordinal, ...)`` to one generate over
the scan; rows where the feature or the target is null are dropped first
(pairwise-complete, C2). Every statistic is an algebraic aggregate keyed by
the ordinal, so the number of jobs does not depend on the number of columns:

* eta (correlation ratio): groups ``(ordinal, group)`` -> count, mean, var_pop;
  then per ordinal ``between`` and ``within`` sums of squares from one aggregate,
  ``eta = sqrt(clamp(between / (between + within)))``.
* purity: counts ``(ordinal, level, class)`` -> per level the majority count,
  per ordinal ``(sum majority / N - baseline) / (1 - baseline)`` clamped,
  baseline being the majority class share among the paired rows.
* Spearman: average ranks of the target within each ordinal's pairs come from the
  range-partitioned prefix counts and are joined to the rows; their sums by ``(ordinal, f)``,
  ranked in the same way by f, give the Pearson correlation of the ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsheet.functions.scalar import md5_bucket
from factsheet.operators.ranking import attach_centred_ranks, centred_rank, prefix_counts
from factsheet.session import keep, store


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def _key3(key: tuple) -> list[Column]:
    kl, kd, ks = key
    return [kl if kl is not None else _null("bigint"), kd if kd is not None else _null("double"),
            ks if ks is not None else _null("string")]


def _exploded(df: DataFrame, features: dict[int, dict[str, Column | None]], types: dict[str, str],
              target: dict[str, Column]) -> DataFrame:
    """``(ordinal, *types, *target)``: a row per feature and input row where both have a value.

    ``features`` gives each ordinal its fields of ``types``; one it has not is null. Values are worked out once a row,
    in a projection of their own, and null structs are dropped behind the generate: that keeps the array
    in generated code (``array_compact`` would have it interpreted).
    """
    values = {(o, k): f"f{o}_{k}" for o, parts in features.items() for k, c in parts.items() if c is not None}
    once_a_row = df.select(*(features[o][k].alias(name) for (o, k), name in values.items()),
                           *(c.alias(k) for k, c in target.items()))
    present = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in target])
    structs = []
    for o in features:
        own = {k: F.col(values[o, k]) if (o, k) in values else _null(t) for k, t in types.items()}
        some = reduce(lambda a, b: a | b, [own[k].isNotNull() for k in types if (o, k) in values])
        structs.append(F.when(some & present, F.struct(F.lit(o).alias("ordinal"), *(c.alias(k) for k, c in own.items()))))
    return once_a_row.select(F.explode(F.array(*structs)).alias("r"), *target).where(
        F.col("r").isNotNull()).select("r.*", *target)


def association_sample(df: DataFrame, key: Column, percent: int) -> DataFrame:
    """The rows whose key falls in the first ``percent`` of 100 md5 buckets, at every size."""
    return df.where(md5_bucket(key, 100) < percent)


def group_stats_eta(pairs: DataFrame) -> DataFrame:
    """``pairs(ordinal, x, gl, gd, gs)`` -> ``(ordinal, association)`` by eta."""
    g = pairs.groupBy("ordinal", "gl", "gd", "gs").agg(
        F.count(F.lit(1)).alias("gn"), F.avg("x").alias("gmean"),
        F.var_pop("x").alias("gvar"), F.min("x").alias("gmin"), F.max("x").alias("gmax"))
    return eta_from_groups(g)


def eta_from_groups(g: DataFrame) -> DataFrame:
    """``between = sum n mean^2 - N grand^2`` and ``within = sum n var``, one aggregate per ordinal.

    The callers shift ``x`` by its column's mean first, so ``grand`` is near zero and
    the difference loses no digits; eta does not change under a shift.
    """
    n, m = F.col("gn"), F.col("gmean")
    s = g.groupBy("ordinal").agg(
        F.sum(n).alias("N"), F.count(F.lit(1)).alias("groups"), F.sum(n * m).alias("sum"),
        F.sum(n * m * m).alias("squares"), F.sum(n * F.col("gvar")).alias("within"),
        F.min("gmin").alias("xmin"), F.max("gmax").alias("xmax"))
    between = F.greatest(F.col("squares") - F.col("sum") * F.col("sum") / F.col("N"), F.lit(0.0))
    total = between + F.col("within")
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), between / total))
    ok = (F.col("N") >= 2) & (F.col("groups") >= 2) & (F.col("xmin") < F.col("xmax")) & (total > 0)
    return s.select("ordinal", F.when(ok, F.sqrt(ratio)).alias("association"))


#: Features whose statistics one aggregate holds: its generated code stays small.
SIDE_BY_SIDE = 8


def class_stats(df: DataFrame, features: dict[int, Column], target_key: tuple) -> DataFrame:
    """``(ordinal, gn, gmean, gvar, gmin, gmax)`` of numeric features for every class of the target.

    Features are aggregated side by side, a row per class; no row per feature and input row is made.
    """
    out: list[DataFrame] = []
    for i in range(0, len(features), SIDE_BY_SIDE):
        some = dict([*features.items()][i:i + SIDE_BY_SIDE])
        rows = df.select(*(k.alias(x) for x, k in zip(("tl", "td", "ts"), _key3(target_key))),
                         *(c.alias(f"x{o}") for o, c in some.items()))
        rows = rows.where(F.col("tl").isNotNull() | F.col("td").isNotNull() | F.col("ts").isNotNull())
        g = rows.groupBy("tl", "td", "ts").agg(*(
            f(f"x{o}").alias(f"{k}{o}") for o in some for k, f in (
                ("gn", F.count), ("gmean", F.avg), ("gvar", F.var_pop), ("gmin", F.min), ("gmax", F.max))))
        out.append(g.select(F.inline(F.array(*(F.struct(F.lit(o).alias("ordinal"), *(
            F.col(f"{k}{o}").alias(k) for k in ("gn", "gmean", "gvar", "gmin", "gmax"))) for o in some)))))
    return reduce(DataFrame.unionByName, out).where("gn > 0")


def purity_from_counts(c: DataFrame) -> DataFrame:
    """``c(ordinal, fl, fd, fs, tl, td, ts, n)`` -> ``(ordinal, association)``."""
    none = F.lit(None).cast("long")
    level = c.groupBy("ordinal", "fl", "fd", "fs").agg(F.max("n").alias("maj"), F.sum("n").alias("ln")).select(
        "ordinal", "maj", "ln", none.alias("cn"))
    cls = c.groupBy("ordinal", "tl", "td", "ts").agg(F.sum("n").alias("cn")).select(
        "ordinal", none.alias("maj"), none.alias("ln"), "cn")
    j = level.unionByName(cls).groupBy("ordinal").agg(
        F.sum("maj").alias("maj"), F.sum("ln").alias("N"), F.max("cn").alias("cmax"), F.count("cn").alias("classes"))
    base = F.col("cmax") / F.col("N")
    weighted = F.col("maj") / F.col("N")
    val = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (weighted - base) / (F.lit(1.0) - base)))
    ok = (F.col("N") >= 2) & (F.col("classes") >= 2) & (base < 1.0)
    return j.select("ordinal", F.when(ok, val).alias("association"))


def spearman_from_columns(df: DataFrame, features: dict[int, Column], target: Column) -> DataFrame:
    """``(ordinal, association)`` of numeric features with a numeric target, over each one's pairs.

    With centred ranks ``2 rank - N - 1``, the sum of products over pairs is, per value of a feature, its centred rank
    times the sum of its rows' target ranks. So input rows, all features side by side, meet the target's ranks
    once, are summed up by ``(ordinal, f)``, and only these sums are ranked by ``f``; pairs are never stored.
    """
    rows = df.select(target.alias("t"), *(c.alias(f"f{o}") for o, c in features.items())).where(F.col("t").isNotNull())
    # a target value counts once for every feature that has a value beside it
    of_target = store(rows.groupBy("t").agg(
        F.count(F.lit(1)).alias("rows"), *(F.count(f"f{o}").alias(f"n{o}") for o in features)), "rank-values")
    near = attach_centred_ranks(rows, of_target, "t", "rows", {f"n{o}": f"r{o}" for o in features})
    structs = [F.when(F.col(f"f{o}").isNotNull(), F.struct(F.lit(o).alias("ordinal"), F.col(f"f{o}").alias("f"),
                                                           F.col(f"r{o}").alias("r"))) for o in features]
    sums = near.select(F.explode(F.array(*structs)).alias("p")).where(F.col("p").isNotNull()).select("p.*").groupBy(
        "ordinal", "f").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    rf = centred_rank("n", "before", "total")
    s = prefix_counts(sums, ["ordinal"], "f", "n", carry=("r", "rr")).groupBy("ordinal").agg(
        F.sum("n").alias("N"), F.sum(rf * F.col("r")).alias("sft"), F.sum(F.col("n") * rf * rf).alias("sff"),
        F.sum("rr").alias("stt"))
    rho = F.col("sft") / F.sqrt(F.col("sff") * F.col("stt"))
    # a constant side has every centred rank equal to 0
    ok = (F.col("N") >= 2) & (F.col("sff") > 0) & (F.col("stt") > 0)
    return s.select("ordinal", F.when(ok, F.abs(rho)).alias("association"))


def associations(df: DataFrame, routes: dict[int, str], feature_num: dict[int, Column],
                 feature_key: dict[int, tuple], target_num: Column | None,
                 target_key: tuple | None, classification: bool, target_mean: Column | None = None) -> DataFrame:
    """D13 dispatch: ``(ordinal, association, association_method)`` for routed columns.

    ``routes`` maps ordinal -> 'eta_num' (numeric feature, class target),
    'eta_cat' (level feature, numeric target), 'purity', or 'spearman'.
    """
    spark = df.sparkSession
    parts: list[DataFrame] = []
    eta_num = [o for o, r in routes.items() if r == "eta_num"]
    eta_cat = [o for o, r in routes.items() if r == "eta_cat"]
    pur = [o for o, r in routes.items() if r == "purity"]
    spr = [o for o, r in routes.items() if r == "spearman"]

    level = {"fl": "bigint", "fd": "double", "fs": "string"}
    if classification and eta_num:
        g = class_stats(df, {o: feature_num[o] for o in eta_num}, target_key)
        parts.append(eta_from_groups(g).withColumn("association_method", F.lit("eta")))

    if classification and pur:
        long = _exploded(df, {o: dict(zip(level, feature_key[o])) for o in pur}, level,
                         dict(zip(("tl", "td", "ts"), _key3(target_key))))
        gp = long.groupBy("ordinal", "fl", "fd", "fs", "tl", "td", "ts").agg(F.count(F.lit(1)).alias("n"))
        parts.append(purity_from_counts(keep(gp)).withColumn("association_method", F.lit("purity")))

    if not classification and eta_cat:
        long = _exploded(df, {o: dict(zip(("gl", "gd", "gs"), feature_key[o])) for o in eta_cat},
                         {"gl": "bigint", "gd": "double", "gs": "string"},
                         {"x": target_num - (F.lit(0.0) if target_mean is None else target_mean)})
        parts.append(group_stats_eta(long).withColumn("association_method", F.lit("eta")))

    if not classification and spr:
        parts.append(spearman_from_columns(df, {o: feature_num[o] for o in spr}, target_num).withColumn(
            "association_method", F.lit("spearman")))

    if not parts:
        return spark.createDataFrame([], "ordinal int, association double, association_method string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
