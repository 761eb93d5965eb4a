"""Spark session settings the profiler relies on, and the checkpoint folder.

Only settings whose absence would change results or plan shape are forced:
case-sensitive names (column names are kept verbatim, so ``Id`` and ``id`` are
two columns), UTC session time, AQE with skew-join splitting. Everything else
is left to the cluster's own configuration.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import wraps

import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

REQUIRED_CONF = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to an existing session."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "factsheet") -> SparkSession:
    """A local session for tests and the benchmark (UI off, no ports beyond Spark's own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.openCostInBytes", "1m")  # small local files still use several cores
        .config("spark.sql.ansi.enabled", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_folder(configured: str | None, master: str) -> str | None:
    """The folder to use: the configured one, or None (make one) where driver and executors are one machine.

    On a cluster without ``spark.checkpoint.dir`` there is no folder that every
    executor can read, so that is refused.
    """
    if configured:
        return configured
    if master == "local" or master.startswith("local["):
        return None
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach; it is read from the session and used as is. Only when it is unset
    in local mode is a fresh scratch folder created under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = checkpoint_folder(sc.getConf().get("spark.checkpoint.dir", None), sc.master)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="factsheet-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def once(build):
    """Build an expression once per Spark context and set of (hashable) arguments.

    Expressions name their columns, so one object serves every plan; putting a large one together
    costs a second of calls to the JVM.
    """
    built: dict = {}

    @wraps(build)
    def get(*args):
        key = (id(SparkContext._active_spark_context), *args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return get


@dataclass
class Scratch:
    """Written tables and cached DataFrames that one result rests on."""

    spark: SparkSession
    paths: list[str] = field(default_factory=list)
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Free the caches and delete the written tables; the result can't be computed again."""
        for df in self.cached:
            df.unpersist()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.cached, self.paths = [], []


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Collects what is stored or kept inside, so that the caller can release it with the result."""
    scope = Scratch(spark)
    token = _scratch.set(scope)
    try:
        yield scope
    finally:
        _scratch.reset(token)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: its rows, partition
    numbers included, stay as they are whatever happens to the executors that made them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if (scope := _scratch.get()) is not None:
        scope.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Cache ``df`` until its scope is released."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if (scope := _scratch.get()) is not None:
        scope.cached.append(df)
    return df


#: Input read at once where a task's memory grows with its split.
SPLIT_BYTES = 16 << 20


@contextmanager
def small_splits(spark: SparkSession):
    """Files scanned by jobs run inside are read in splits of ``SPLIT_BYTES`` at most, so that
    what a task gathers from its split is bounded, whatever the size of the input."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    digits = before.rstrip("bB")
    if digits.isdigit() and int(digits) <= SPLIT_BYTES:  # smaller already
        yield
        return
    spark.conf.set(key, str(SPLIT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def local_rows(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A few driver-made rows as a local relation: expressions over it are folded without a job."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)
