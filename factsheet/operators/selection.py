"""Column selection over a column profile (E3, B4, B7) and profile JSON.

``prompt_json`` is the whole chain: exclusions leave first, the budget is filled from what
is left, and the document says how many columns it omits and which were excluded.

All inputs are column-profile tables: one row per column of each dataset, so
every window here is bounded by a dataset's column count, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from factsheet import thresholds as T


def column_budget(columns: DataFrame, target_column: str, budget: int = T.PROMPT_MAX_COLUMNS) -> DataFrame:
    """Keep the target, then flagged columns in file order, then the rest by
    association (null = 0) descending; at most ``budget``; output in file order.

    Adds ``kept`` and ``omitted`` (columns left out per dataset).
    """
    c = F.col
    tier = (F.when(c("name") == target_column, 0)
            .when(F.size(c("flags")) > 0, 1).otherwise(2))
    score = F.when(tier == 2, F.coalesce(c("target_association"), F.lit(0.0))).otherwise(F.lit(0.0))
    w = Window.partitionBy("dataset_id").orderBy(tier, score.desc(), c("ordinal"))
    ranked = columns.withColumn("_rank", F.row_number().over(w))
    ranked = ranked.withColumn("kept", c("_rank") <= budget)
    om = Window.partitionBy("dataset_id")
    return ranked.withColumn("omitted", F.sum(F.when(~c("kept"), 1).otherwise(0)).over(om)).drop("_rank")


def validate_exclusions(columns: DataFrame, requested: DataFrame, target_column: str) -> DataFrame:
    """Each requested name -> 'excluded' (in profile order), 'unknown', or 'target'."""
    known = columns.select(F.col("name").alias("requested"), "ordinal")
    j = requested.select("requested").distinct().join(known, "requested", "left")
    status = (F.when(F.col("ordinal").isNull(), "unknown")
              .when(F.col("requested") == target_column, "target").otherwise("excluded"))
    return j.select("requested", "ordinal", status.alias("status"))


def search_columns(columns: DataFrame, text: str) -> DataFrame:
    """Trimmed, lower-cased substring match over column names, keeping ordinals."""
    needle = text.strip().lower()
    return columns.where(F.lower(F.col("name")).contains(needle))


def profile_json(dataset: DataFrame, columns: DataFrame) -> DataFrame:
    """One JSON document per dataset (nulls dropped), columns nested in file order."""
    nested = columns.groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in columns.columns if c != "dataset_id"])))
        .alias("columns"))
    return dataset.join(nested, "dataset_id").select(
        "dataset_id", F.to_json(F.struct(*[F.col(c) for c in dataset.columns], "columns")).alias("profile_json"))


def parse_profile_json(docs: DataFrame, schema: str) -> DataFrame:
    """JSON back to typed rows; rows that do not fit the schema come back null."""
    return docs.select("dataset_id", F.from_json("profile_json", schema).alias("profile"))


def prompt_json(dataset: DataFrame, columns: DataFrame, exclusions: DataFrame | None = None,
                budget: int = T.PROMPT_MAX_COLUMNS) -> DataFrame:
    """Per dataset one JSON document of its profile with the columns that fit the budget.

    ``dataset`` has one row per dataset with ``target_column``; ``exclusions`` has ``dataset_id``,
    ``requested`` and ``place`` (order of the request). Excluded columns make room for others; the target and unknown
    names can't be excluded and are listed in ``refused`` instead. Columns stand in file order, nulls are dropped;
    ``columns_omitted_from_this_prompt`` and ``columns_excluded_by_user`` appear only where there are any.
    ``n_columns`` stays the file's.
    """
    spark = columns.sparkSession
    if exclusions is None:
        exclusions = spark.createDataFrame([], "dataset_id string, requested string, place int")
    targets = dataset.select("dataset_id", F.col("target_column").alias("_target"))
    known = columns.join(targets, "dataset_id")
    asked = exclusions.groupBy("dataset_id", "requested").agg(F.min("place").alias("place"))
    judged = asked.join(known.select("dataset_id", F.col("name").alias("requested"), "_target"), ["dataset_id", "requested"], "left").withColumn(
        "ok", F.col("_target").isNotNull() & (F.col("requested") != F.col("_target")))
    names = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", "requested")))), lambda x: x["requested"])
    lists = judged.groupBy("dataset_id").agg(names(F.col("ok")).alias("excluded"), names(~F.col("ok")).alias("refused"))
    gone = judged.where("ok").select("dataset_id", F.col("requested").alias("name"))
    left = known.join(gone, ["dataset_id", "name"], "left_anti")
    tier = F.when(F.col("name") == F.col("_target"), 0).when(F.size("flags") > 0, 1).otherwise(2)
    score = F.when(tier == 2, F.coalesce("target_association", F.lit(0.0))).otherwise(F.lit(0.0))
    per = Window.partitionBy("dataset_id")  # rows of one dataset: its columns
    ranked = left.withColumn("_rank", F.row_number().over(per.orderBy(tier, score.desc(), "ordinal"))).withColumn(
        "_omitted", F.greatest(F.count(F.lit(1)).over(per) - budget, F.lit(0)))
    own = [c for c in columns.columns if c != "dataset_id"]
    nested = ranked.where(F.col("_rank") <= budget).groupBy("dataset_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*own).alias("c")))), lambda x: x["c"]).alias("columns"),
        F.max("_omitted").alias("_omitted"))
    facts = [F.col(f"d.{c}") for c in dataset.columns if c not in ("dataset_id", "columns")]
    joined = dataset.alias("d").join(nested.alias("n"), "dataset_id", "left").join(lists.alias("l"), "dataset_id", "left")
    document = F.struct(*facts, F.col("n.columns").alias("columns"),
                        F.when(F.col("n._omitted") > 0, F.col("n._omitted")).alias("columns_omitted_from_this_prompt"),
                        F.when(F.size("l.excluded") > 0, F.col("l.excluded")).alias("columns_excluded_by_user"))
    return joined.select("dataset_id", F.to_json(document).alias("profile_json"), F.coalesce("l.refused", F.array().cast("array<string>")).alias("refused"))


def _json_fault(value: Column, kind: ST.DataType, path: Column, required: bool) -> Column:
    """The path of the first part of a JSON value that doesn't fit ``kind``; null where all fits."""
    absent = value.isNull() | F.is_variant_null(value)
    if isinstance(kind, ST.StructType):
        shape = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
        parts = [_json_fault(F.try_variant_get(value, f"$['{f.name}']", "variant"), f.dataType, F.concat(path, F.lit(f".{f.name}")), not f.nullable)
                 for f in kind.fields]
        inner = F.when(~shape, path).otherwise(F.coalesce(*parts))
    elif isinstance(kind, ST.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        faults = F.transform(items, lambda x, i: _json_fault(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")),
                                                             not kind.containsNull))
        inner = F.when(items.isNull(), path).otherwise(F.get(F.filter(faults, lambda x: x.isNotNull()), F.lit(0)))
    else:
        inner = F.when(F.try_variant_get(value, "$", kind.simpleString()).isNull(), path)
    return F.when(absent, path if required else F.lit(None).cast("string")).otherwise(inner)


def _nullable(kind: ST.DataType) -> ST.DataType:
    """The same type with everything nullable."""
    if isinstance(kind, ST.StructType):
        return ST.StructType([ST.StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    return ST.ArrayType(_nullable(kind.elementType)) if isinstance(kind, ST.ArrayType) else kind


def check_json(docs: DataFrame, schema: ST.StructType, text: str = "profile_json") -> DataFrame:
    """``docs`` with ``profile`` (typed; null where refused), ``status`` and ``failed_path``.

    ``status``: valid, missing (null text), malformed (no JSON) or mismatch, with the path of the first
    part that doesn't fit, in the order of the schema. Fields the schema calls not nullable must be there;
    fields it doesn't name are ignored. A value fits a type if it can be cast to it.
    """
    value = F.try_parse_json(F.col(text))
    fault = _json_fault(value, schema, F.lit("$"), True)
    status = F.when(F.col(text).isNull(), "missing").when(value.isNull(), "malformed").when(F.col("failed_path").isNotNull(), "mismatch").otherwise("valid")
    loose = _nullable(schema)  # what must be there is checked above
    return docs.withColumn("failed_path", F.when(value.isNotNull(), fault)).withColumn("status", status).withColumn(
        "profile", F.when(F.col("status") == "valid", F.from_json(text, loose)))
