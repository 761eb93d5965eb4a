"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factsheet.session import scratch_path

#: Rows of one Arrow batch on the way to Python: texts may be long, so batches stay small.
BATCH_ROWS = 500

#: The white space of the word contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not this table, and
    row ids or partition numbers made before it stay as they are.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove a table made by ``stored`` that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, rows: DataFrame, row: str = "_row") -> DataFrame:
    """The rows of a stored table whose number is not among ``rows``, with all columns."""
    number = free_name(docs, "_number")
    gone = stored(rows.select(F.col(row).alias(free_name(docs, "_gone"))), "gone")
    return with_row(docs, number).join(gone, F.col(number) == F.col(gone.columns[0]), "left_anti").drop(number)


def fixed_splits(spark: SparkSession) -> None:
    """From now on the session cuts a table into the same splits at every scan.

    Spark sizes splits by the cores it has when a scan is planned, so without this an
    executor that joins or is lost between two scans would change them, and row numbers.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows of a stored table; a further scan of it in the session gives the same numbers again."""
    fixed_splits(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id())


def partition_offsets(totals: DataFrame, part: str, size: str, out: str = "_offset") -> DataFrame:
    """Exclusive prefix sums over partition totals (one row per partition of a table).

    The window is global, but it sees one row per partition, never the rows of them.
    """
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long").alias(out))


#: Keys with over one part in so many of all rows count as hot; there are fewer of them than this.
HOT_KEYS = 1000


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per value of ``key`` (null equals null).

    ``weight`` says how many rows a key has. The hot keys, fewer than ``HOT_KEYS`` by their
    definition, are broadcast, so their rows stay where they are; all others are joined
    by key, each at most a thousandth of the rows. Both are read twice: pass stored tables.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    mine, found = free_name(rows, "_key"), free_name(rows, "_hot")
    facts = facts.withColumnRenamed(key, mine)
    match = F.col(key).eqNullSafe(F.col(mine))
    hot = facts.where(F.col(weight) * HOT_KEYS > total)
    rest = facts.where(F.col(weight) * HOT_KEYS <= total)
    near = rows.join(F.broadcast(hot), match).drop(mine, weight)
    marked = rows.join(F.broadcast(hot.select(mine, F.lit(True).alias(found))), match, "left").where(F.col(found).isNull()).drop(mine, found)
    return near.unionByName(marked.join(rest, match).drop(mine, weight))
