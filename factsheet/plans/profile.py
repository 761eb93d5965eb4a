"""The whole profile of one table for one target, as two Spark tables.

Plan shape (constant number of jobs whatever the column count):

1. raw value counts: one scan, one shuffle counting ``(ordinal, value)`` for every column
2. facts (parse tests, numeric sums) on those distinct values; text-coerced
   columns re-keyed by their number from the same table
3. driver settles types and task from one small row per column
4. association: at most two long-form shuffles keyed by ordinal
5. medians and Spearman ranks from two-pass prefix counts over the value frequencies
6. duplicates: one whole-row aggregate
7. small per-column results joined by ordinal

Only per-column summaries reach the driver (one row per column), never data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from factsheet import thresholds as T
from factsheet.errors import ProfileRefused
from factsheet.functions.scalar import parse_number
from factsheet.operators import rules as R
from factsheet.operators.association import association_sample, associations
from factsheet.operators.columns import (
    NUMERIC_STORAGE, STRING, column_specs, effective_key, key_number, key_text, normalised, raw_key,
)
from factsheet.operators.ranking import exact_medians
from factsheet.session import Scratch, keep, local_rows, scratch_scope, small_splits
from factsheet.operators.stats import (
    duplicate_row_count, effective_frequencies, facts_from_frequencies, frequency_summary, raw_frequencies,
)

STATS_SCHEMA = ST.StructType([
    ST.StructField("ordinal", ST.IntegerType()),
    ST.StructField("name", ST.StringType()),
    ST.StructField("storage", ST.StringType()),
    ST.StructField("storage_type", ST.StringType()),
    ST.StructField("is_target", ST.BooleanType()),
    ST.StructField("n_rows", ST.LongType()),
    ST.StructField("non_null", ST.LongType()),
    ST.StructField("vmin", ST.IntegerType()),
    ST.StructField("vmax", ST.IntegerType()),
    ST.StructField("b01", ST.BooleanType()),
    ST.StructField("dt_count", ST.LongType()),
    ST.StructField("num_count", ST.LongType()),
    ST.StructField("nmin", ST.DoubleType()),
    ST.StructField("nmax", ST.DoubleType()),
    ST.StructField("nmean", ST.DoubleType()),
    ST.StructField("nstd", ST.DoubleType()),
    ST.StructField("stage", ST.StringType()),
    ST.StructField("unique_count", ST.LongType()),
    ST.StructField("top_n", ST.LongType()),
    ST.StructField("eff_non_null", ST.LongType()),
])

OUTCOME_SCHEMA = ST.StructType([
    ST.StructField("task", ST.StringType()),
    ST.StructField("conf", ST.DoubleType()),
    ST.StructField("refusal", ST.StringType()),
    ST.StructField("inferred", ST.StringType()),
    ST.StructField("cmax", ST.LongType()),
    ST.StructField("cmin", ST.LongType()),
    ST.StructField("classes", ST.LongType()),
])

COLUMN_PROFILE_COLUMNS = [
    "dataset_id", "ordinal", "name", "inferred_type", "storage_type", "missing_count", "missing_pct",
    "unique_count", "unique_pct", "top_value_pct", "sample_values", "min", "max", "mean", "std",
    "median", "parse_rate", "target_association", "association_method", "flags",
]
DATASET_PROFILE_COLUMNS = [
    "dataset_id", "source_name", "n_rows", "n_columns", "target_column", "problem_type",
    "task_confidence", "primary_metric", "secondary_metrics", "class_balance_ratio",
    "duplicate_row_count", "profiled_on_sample", "sample_percent", "task_overridden",
]


@dataclass
class ColumnFacts:
    """The per-column statistics table before association (one row per column)."""

    stats: DataFrame          # STATS_SCHEMA + inferred_type, parse_rate, missing/unique shares
    freq: DataFrame           # (ordinal, kl, kd, ks, n), persisted
    n_rows: int
    types: dict[int, str]     # ordinal -> inferred type
    stage: dict[int, str]
    specs: list
    df: DataFrame             # normalised input
    summary: dict | None = None  # ordinal -> frequency summary row
    means: dict | None = None    # ordinal -> mean of its numbers


@dataclass
class Profile:
    dataset: DataFrame
    columns: DataFrame
    facts: ColumnFacts
    scratch: Scratch | None = None

    def materialize(self, path: str | None = None) -> "Profile":
        """Compute both tables once (optionally written to ``path``) and free the intermediates."""
        if path is not None:
            from factsheet.operators.catalog import read_profile, write_profile

            write_profile(self.dataset, self.columns, path)
            ds_id = self.dataset.select("dataset_id").first()[0]
            ds, cols = read_profile(self.dataset.sparkSession, path, ds_id)
        else:
            ds, cols = self.dataset.checkpoint(), self.columns.checkpoint()
        self.release()
        return Profile(ds, cols, self.facts)

    def release(self) -> None:
        """Free every cached and written intermediate of this profile."""
        if self.scratch is not None:
            self.scratch.release()


def _spec_row(spec, n_rows: int, f: dict, is_target: bool) -> dict:
    return {
        "ordinal": spec.ordinal, "name": spec.name, "storage": spec.storage,
        "storage_type": spec.storage_type, "is_target": is_target, "n_rows": n_rows,
        "non_null": f.get("nn", 0), "vmin": f.get("vmin"), "vmax": f.get("vmax"), "b01": f.get("b01"),
        "dt_count": f.get("dt"), "num_count": f.get("num"), "nmin": f.get("min"), "nmax": f.get("max"),
        "nmean": f.get("mean"), "nstd": f.get("std"), "stage": None, "unique_count": None,
        "top_n": None, "eff_non_null": None,
    }


def with_derived(stats: DataFrame, th: T.Thresholds = T.DEFAULTS) -> DataFrame:
    """Add the type, parse rate and share columns to a stats table."""
    c = F.col
    return (stats
            .withColumn("inferred_type", R.inferred_type(th))
            .withColumn("parse_rate", R.parse_rate())
            .withColumn("missing_count", c("n_rows") - c("non_null"))
            .withColumn("missing_pct", F.when(c("n_rows") > 0, (c("n_rows") - c("non_null")) / c("n_rows")))
            .withColumn("unique_pct", F.when(c("n_rows") > 0, c("unique_count") / c("n_rows")))
            .withColumn("top_value_pct", F.when(c("eff_non_null") > 0, c("top_n") / c("eff_non_null"))))


def column_facts(df: DataFrame, target: str | None = None, th: T.Thresholds = T.DEFAULTS) -> ColumnFacts:
    """Jobs 1-3: raw value counts (one scan, one shuffle), facts and ladder on
    the distinct values, effective frequencies, final types."""
    spark = df.sparkSession
    specs = column_specs(df)
    ndf = normalised(df, specs)
    freq_all = keep(raw_frequencies(ndf, specs))
    with small_splits(spark):  # the first pass over the counts makes them
        n_rows, facts = facts_from_frequencies(freq_all, specs)
    rows = [_spec_row(s, n_rows, facts[s.ordinal], s.name == target) for s in specs]
    stage_df = local_rows(spark, rows, STATS_SCHEMA).withColumn("stage", R.ladder_stage(th))
    stage = {r["ordinal"]: r["stage"] for r in stage_df.select("ordinal", "stage").collect()}
    coerced = {o for o, s in stage.items() if s == "coerced"}
    freq = effective_frequencies(freq_all, coerced)
    if coerced:
        freq = keep(freq)
        summary = {r["ordinal"]: r.asDict() for r in frequency_summary(freq).collect()}
    else:  # effective values are the raw values: the facts pass already summarised them
        summary = {o: f["raw_summary"] for o, f in facts.items() if f["raw_summary"]["unique_count"] > 0}
    for row in rows:
        o = row["ordinal"]
        row["stage"] = stage[o]
        s = summary.get(o)
        row["unique_count"] = int(s["unique_count"]) if s else 0
        row["top_n"] = int(s["top_n"]) if s else None
        row["eff_non_null"] = int(s["eff_non_null"]) if s else 0
    stats = with_derived(local_rows(spark, rows, STATS_SCHEMA), th)
    types = {r["ordinal"]: r["inferred_type"] for r in stats.select("ordinal", "inferred_type").collect()}
    means = {r["ordinal"]: r["nmean"] for r in rows}
    return ColumnFacts(stats, freq, n_rows, types, stage, specs, ndf, summary, means)


def numeric_medians(cf: ColumnFacts) -> DataFrame:
    """D5 exact medians of every numeric-typed column, from the frequency table."""
    numeric = [o for o, t in cf.types.items() if t in ("numeric_discrete", "numeric_continuous")]
    if not numeric:
        return cf.df.sparkSession.createDataFrame([], "ordinal int, median double")
    f = cf.freq.where(F.col("ordinal").isin(numeric)).select("ordinal", key_number().alias("v"), "n")
    return exact_medians(f, ["ordinal"])


def level_names(freq: DataFrame, ordinals: list[int], top: int = T.SAMPLE_VALUES_TOP) -> DataFrame:
    """Top levels by count (ties by value), each cut to 40 characters.

    ``row_number`` per ordinal with a limit becomes a group limit applied on
    both sides of the shuffle, so no task sees more than ``top`` rows per column.
    """
    if not ordinals:
        return freq.sparkSession.createDataFrame([], "ordinal int, sample_values array<string>")
    ranked = (freq.where(F.col("ordinal").isin(ordinals))
              .select("ordinal", "n", F.coalesce("head", key_text()).alias("v"))
              .withColumn("rn", F.row_number().over(Window.partitionBy("ordinal")
                                                     .orderBy(F.col("n").desc(), F.col("v").asc())))
              .where(F.col("rn") <= top))
    return ranked.groupBy("ordinal").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "v"))),
                    lambda s: F.substring(s["v"], 1, T.SAMPLE_VALUE_MAX_CHARS)).alias("sample_values"))


def target_outcome(cf: ColumnFacts, target: str, override: str | None) -> dict:
    """B3 + H13/H14 + D7 + H15 for the target; raises ProfileRefused."""
    spec = next((s for s in cf.specs if s.name == target), None)
    if spec is None:
        raise ProfileRefused("TARGET_NOT_FOUND", f"The table has no column named '{target}'.",
                             {"target_column": target})
    trow = cf.stats.where(F.col("ordinal") == spec.ordinal)
    req = F.lit(override).cast("string")
    task, conf, refusal = R.override_outcome(req)
    first = trow.select("non_null", "inferred_type", "unique_count", "stage", task.alias("task"),
                        conf.alias("conf"), refusal.alias("refusal"), R.inferred_task().alias("inferred")
                        ).collect()[0]
    if first["non_null"] == 0:
        raise ProfileRefused("TARGET_ALL_NULL", f"Every value of '{target}' is missing.", {"target_column": target})
    raw_distinct = first["unique_count"]
    if first["stage"] == "coerced":
        # the raw-value check runs on the text as written
        k = raw_key(spec)
        raw_distinct = cf.df.select(k[2]).where(k[2].isNotNull()).distinct().limit(2).count()
    if raw_distinct < 2:
        raise ProfileRefused("TARGET_SINGLE_VALUE", f"All values of '{target}' are the same.",
                             {"target_column": target})
    if first["inferred_type"] not in ("numeric_discrete", "numeric_continuous", "boolean", "categorical"):
        raise ProfileRefused("TARGET_TYPE_UNSUPPORTED",
                             f"A target of type {first['inferred_type']} can't be modelled: '{target}'.",
                             {"target_column": target, "inferred_type": first["inferred_type"]})
    cls = cf.summary.get(spec.ordinal) or {"top_n": None, "min_n": None, "unique_count": 0}
    cls = {"cmax": cls["top_n"], "cmin": cls["min_n"], "classes": cls["unique_count"]}
    # the metric rules run on the one-row outcome, a local relation: folded without a job
    t = local_rows(cf.df.sparkSession, [{"task": first["task"], "conf": first["conf"], "refusal": first["refusal"],
                                         "inferred": first["inferred"], **cls}], OUTCOME_SCHEMA)
    t = t.withColumn("ratio", R.class_balance(F.col("task"), F.col("cmax"), F.col("cmin"), F.col("classes")))
    t = t.withColumn("primary", R.primary_metric(F.col("task"), F.col("ratio")))
    t = t.withColumn("secondary", R.secondary_metrics(F.col("task"), F.col("primary")))
    out = t.collect()[0].asDict()
    if out["refusal"]:
        raise ProfileRefused(out["refusal"], f"The requested task {override} doesn't fit the values of '{target}'.",
                             {"target_column": target, "requested": override or "", "inferred": out["inferred"]})
    if out["task"] == "binary_classification" and out["ratio"] is None:
        raise ProfileRefused("TARGET_SINGLE_VALUE", f"Read as numbers, all values of '{target}' are the same.",
                             {"target_column": target})
    out["ordinal"] = spec.ordinal
    out["overridden"] = override is not None
    return out


def feature_routes(cf: ColumnFacts, target_ordinal: int, task: str) -> dict[int, str]:
    regression = task == "regression"
    routes = {}
    for o, t in cf.types.items():
        if o == target_ordinal:
            continue
        if t in ("numeric_discrete", "numeric_continuous"):
            routes[o] = "spearman" if regression else "eta_num"
        elif t in ("boolean", "categorical"):
            routes[o] = "eta_cat" if regression else "purity"
    return routes


def effective_number(spec, coerced: bool) -> Column:
    if coerced and spec.storage == STRING:
        return parse_number(spec.ref)
    return spec.ref.cast("double")


def target_associations(cf: ColumnFacts, t: dict, sample_key: Column | None, sample_percent: int) -> DataFrame:
    """D13 over the whole table, or over the B5 sample when a key to sample by is given."""
    routes = feature_routes(cf, t["ordinal"], t["task"])
    specs = {s.ordinal: s for s in cf.specs}
    tspec = specs[t["ordinal"]]
    coerced = {o for o, s in cf.stage.items() if s == "coerced"}
    base = cf.df if sample_key is None else association_sample(cf.df, sample_key, sample_percent)
    shift = lambda o: F.lit(float(cf.means.get(o) or 0.0))  # noqa: E731  (see eta_from_groups)
    feature_num = {o: effective_number(specs[o], o in coerced) - shift(o) if r == "eta_num"
                   else effective_number(specs[o], o in coerced) for o, r in routes.items()}
    feature_key = {o: effective_key(specs[o], o in coerced) for o in routes}
    target_num = effective_number(tspec, t["ordinal"] in coerced)
    target_key = effective_key(tspec, t["ordinal"] in coerced)
    return associations(base, routes, feature_num, feature_key, target_num, target_key,
                        classification=t["task"] != "regression", target_mean=shift(t["ordinal"]))


def assemble_columns(cf: ColumnFacts, assoc: DataFrame, medians: DataFrame, levels: DataFrame,
                     dataset_id: str, th: T.Thresholds = T.DEFAULTS) -> DataFrame:
    """Join the small per-column results (each at most one row per column) and apply H4-H12."""
    c = F.col
    numeric = c("inferred_type").isin("numeric_discrete", "numeric_continuous")
    parts = [assoc.select("ordinal", "association", "association_method"), medians.select("ordinal", "median"),
             levels.select("ordinal", "sample_values")]
    found = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    # every part has at most one row per column
    found = found.groupBy("ordinal").agg(*(F.max(x).alias(x) for x in found.columns[1:]))
    j = cf.stats.join(F.broadcast(found), "ordinal", "left")
    j = j.withColumn("association", F.when(~c("is_target"), c("association")))
    j = j.withColumn("flags", R.flags(th))
    j = j.withColumn("sample_values", F.when(R.shows_levels(th), c("sample_values")))
    all_missing = c("non_null") == 0
    std = F.when(c("num_count") == 1, F.lit(0.0)).otherwise(c("nstd"))
    return j.select(
        F.lit(dataset_id).alias("dataset_id"),
        "ordinal", "name", "inferred_type", "storage_type",
        c("missing_count").cast("bigint").alias("missing_count"),
        F.when(all_missing, F.lit(1.0)).otherwise(c("missing_pct")).alias("missing_pct"),
        c("unique_count").cast("bigint").alias("unique_count"),
        F.coalesce(c("unique_pct"), F.lit(0.0)).alias("unique_pct"),
        F.when(~all_missing, c("top_value_pct")).alias("top_value_pct"),
        "sample_values",
        F.when(numeric, c("nmin")).alias("min"),
        F.when(numeric, c("nmax")).alias("max"),
        F.when(numeric, c("nmean")).alias("mean"),
        F.when(numeric, std).alias("std"),
        F.when(numeric, c("median")).alias("median"),
        "parse_rate",
        c("association").alias("target_association"),
        F.when(c("association").isNotNull(), c("association_method")).otherwise(F.lit("none"))
        .alias("association_method"),
        "flags",
    )


def profile_table(df: DataFrame, target: str, *, dataset_id: str = "dataset", source_name: str | None = None,
                  override: str | None = None, sample_key: Column | None = None, sample_percent: int = 100,
                  thresholds: T.Thresholds = T.DEFAULTS, duplicates: bool = True) -> Profile:
    """Profile ``df`` for ``target``. Returns (dataset_profile, column_profile) DataFrames.

    Association is measured on every row; with ``sample_key`` (B5) on the rows whose
    key falls in the first ``sample_percent`` of 100 hash buckets, whatever the size.
    """
    with scratch_scope(df.sparkSession) as scratch:
        p = _profile(df, target, dataset_id, source_name, override, sample_key, sample_percent, thresholds, duplicates)
    return Profile(p.dataset, p.columns, p.facts, scratch)


def _profile(df: DataFrame, target: str, dataset_id: str, source_name: str | None, override: str | None,
             sample_key: Column | None, sample_percent: int, thresholds: T.Thresholds, duplicates: bool) -> Profile:
    if target not in df.columns:
        raise ProfileRefused("TARGET_NOT_FOUND", f"The table has no column named '{target}'.",
                             {"target_column": target})
    cf = column_facts(df, target, thresholds)
    t = target_outcome(cf, target, override)
    assoc = target_associations(cf, t, sample_key, sample_percent)
    medians = numeric_medians(cf)
    pre = cf.stats.withColumn("association", F.lit(None).cast("double")).withColumn("flags", R.flags(thresholds))
    show = [r["ordinal"] for r in pre.where(R.shows_levels(thresholds)).select("ordinal").collect()]
    levels = level_names(cf.freq, show)
    columns = assemble_columns(cf, assoc, medians, levels, dataset_id, thresholds)
    spark = df.sparkSession
    dup = duplicate_row_count(cf.df) if duplicates else spark.range(1).select(
        F.lit(None).cast("bigint").alias("duplicate_row_count"))
    ds = dup.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(source_name).cast("string").alias("source_name"),
        F.lit(cf.n_rows).cast("bigint").alias("n_rows"),
        F.lit(len(cf.specs)).alias("n_columns"),
        F.lit(target).alias("target_column"),
        F.lit(t["task"]).alias("problem_type"),
        F.lit(t["conf"]).cast("double").alias("task_confidence"),
        F.lit(t["primary"]).alias("primary_metric"),
        F.array(*[F.lit(m) for m in t["secondary"]]).cast("array<string>").alias("secondary_metrics"),
        F.lit(t["ratio"]).cast("double").alias("class_balance_ratio"),
        "duplicate_row_count",
        F.lit(sample_key is not None).alias("profiled_on_sample"),
        F.lit(None if sample_key is None else sample_percent).cast("int").alias("sample_percent"),
        F.lit(t["overridden"]).alias("task_overridden"),
    )
    return Profile(ds, columns, cf)
