"""Profile sink, dataset catalogue, retention and usage.

Tables are plain Parquet folders in the shared storage; every operation is a
DataFrame job (filter, anti join, aggregate, dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsheet import thresholds as T
from factsheet.functions.scalar import cutoff
from factsheet.operators.ranking import prefix_counts


def write_profile(dataset: DataFrame, columns: DataFrame, path: str) -> None:
    """Store a profile; the last write for a dataset_id wins (other ids untouched)."""
    spark = dataset.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        (dataset.withColumn("state", F.lit("complete")).write.mode("overwrite")
         .partitionBy("dataset_id").parquet(f"{path}/dataset_profile"))
        columns.write.mode("overwrite").partitionBy("dataset_id").parquet(f"{path}/column_profile")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def read_profile(spark, path: str, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """Read one stored profile back (partition pruning on dataset_id)."""
    ds = spark.read.parquet(f"{path}/dataset_profile").where(F.col("dataset_id") == dataset_id)
    cols = spark.read.parquet(f"{path}/column_profile").where(F.col("dataset_id") == dataset_id)
    return ds, cols


def lookup(catalogue: DataFrame, requested: DataFrame, as_of: str, ttl_hours: int = T.DATASET_TTL_HOURS,
           key: str = "dataset_id", created: str = "created_at") -> DataFrame:
    """A10: requested ids with ``found``; unknown and expired ids look the same (not found)."""
    live = catalogue.where(F.col(created) >= cutoff(as_of, ttl_hours)).select(key).distinct()
    return (requested.select(key).distinct()
            .join(live.withColumn("found", F.lit(True)), key, "left")
            .select(key, F.coalesce(F.col("found"), F.lit(False)).alias("found")))


def expire(catalogue: DataFrame, as_of: str, ttl_hours: int = T.DATASET_TTL_HOURS,
           created: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """Split the catalogue into (kept, expired) at ``as_of - ttl`` (UTC)."""
    limit = cutoff(as_of, ttl_hours)
    expired = catalogue.where(F.col(created) < limit)
    kept = catalogue.where(~(F.col(created) < limit) | F.col(created).isNull())
    return kept, expired


def orphan_files(files: DataFrame, catalogue: DataFrame, key: str, mtime: str | None = None,
                 as_of: str | None = None, ttl_hours: int = T.DATASET_TTL_HOURS) -> DataFrame:
    """Stored files no catalogue row references, older than the TTL when times are given."""
    out = files.join(catalogue.select(key).distinct(), key, "left_anti")
    if mtime is not None and as_of is not None:
        out = out.where(F.col(mtime) < cutoff(as_of, ttl_hours))
    return out


def stored_files(spark, path: str, names: str = "*") -> DataFrame:
    """``stored_path``, ``modified_at`` and ``bytes`` of all files below ``path`` whose names match a glob.

    Spark lists many folders in tasks; contents are not read. Paths are full URIs, as a catalogue
    should hold them. A folder that doesn't exist has no files.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "stored_path string, modified_at timestamp, bytes bigint")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    return files.select(F.col("path").alias("stored_path"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"))


def remove_files(files: DataFrame, path: str = "stored_path") -> int:
    """Delete the named files, one after the other as their names arrive; returns how many there were."""
    jvm, conf = files.sparkSession._jvm, files.sparkSession._jsc.hadoopConfiguration()
    removed = 0
    for row in files.select(path).distinct().toLocalIterator():
        name = jvm.org.apache.hadoop.fs.Path(row[0])
        removed += bool(name.getFileSystem(conf).delete(name, False))
    return removed


def usage_rollup(attempts: DataFrame, key: str = "dataset_id", tokens: tuple[str, ...] = ("input_tokens",
                 "output_tokens"), latency: str = "latency_ms") -> DataFrame:
    """Attempts, token sums (null counts as 0) and total latency per dataset."""
    aggs = [F.count(F.lit(1)).alias("attempts")]
    aggs += [F.sum(F.coalesce(F.col(t), F.lit(0))).cast("bigint").alias(f"total_{t}") for t in tokens]
    aggs += [F.sum(F.coalesce(F.col(latency), F.lit(0))).cast("bigint").alias(f"total_{latency}")]
    return attempts.groupBy(key).agg(*aggs)


def attempt_history(attempts: DataFrame, key: str = "dataset_id", order: tuple[str, ...] = ("created_at",
                    "attempt_id")) -> DataFrame:
    """Each attempt's position in its dataset's history, ordered by creation time.

    Positions come from range-partitioned prefix counts, so a dataset with a
    third of all attempts is spread over many tasks instead of one window task.
    """
    ranked = prefix_counts(attempts.select(key, *order).withColumn("n", F.lit(1)), [key], list(order))
    return ranked.select(key, *order, (F.col("before") + 1).alias("seq"))
