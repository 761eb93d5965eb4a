"""Inputs of the registered queries: the driver's tables and views Spark derives from them.

The driver's tables hold no nulls and no text-typed numbers or dates, so some
queries read a view that derives such columns from existing ones (the same
derivation is written in each query's SQL oracle). The views only shape input
rows; every statistic is computed by the library on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with ``l_tax`` missing on line numbers 1-4 (about 57 % of rows)."""
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("l_tax", F.when(F.col("l_linenumber") > 4, F.col("l_tax")))


def documents_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to their labels (quality, toxic); labels cover some documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with text-typed columns as a CSV export would carry them.

    * ``price_text``: the total price written '$1,234.56'
    * ``date_mixed``: the order date in a format chosen by order priority,
      except 5-LOW rows, which hold the priority text itself (not a date)
    * ``date_iso``: the order date as 'yyyy-MM-dd'
    * ``status_yn``: 'Yes' / 'no' by order status F
    * ``status_01``: 1 / 0 by order status F
    * ``leak``: the status itself, changed on a few urgent orders
    """
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    d = F.col("o_orderdate")
    mixed = (F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd"))
             .when(p == "2-HIGH", F.date_format(d, "MM/dd/yyyy"))
             .when(p == "3-MEDIUM", F.date_format(d, "MMMM d, yyyy"))
             .when(p == "4-NOT SPECIFIED", F.date_format(d, "yyyyMMdd"))
             .otherwise(p))
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price_text"),
        mixed.alias("date_mixed"),
        F.date_format(d, "yyyy-MM-dd").alias("date_iso"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no").alias("status_yn"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("status_01"),
        F.when((p == "1-URGENT") & (F.col("o_custkey") < 5), F.lit("F"))
        .otherwise(F.col("o_orderstatus")).alias("leak"),
    )


def events_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the rare-outcome flag ``big_error`` (error events with value > 100)."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("big_error", ((F.col("event_type") == "error") & (F.col("value") > 100)).cast("int"))


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events read as a log of generation attempts: one row per attempt of a dataset.

    dataset_id = user_id, attempt_id = event_id, created_at = ts; error events
    carry no input tokens, only purchases carry output tokens.
    """
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(
        F.col("user_id").alias("dataset_id"), F.col("event_id").alias("attempt_id"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") != "error", F.floor(v)).cast("bigint").alias("input_tokens"),
        F.when(F.col("event_type") == "purchase", F.floor(v / 2)).cast("bigint").alias("output_tokens"),
        F.floor(v * 100).cast("bigint").alias("latency_ms"))
