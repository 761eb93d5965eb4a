"""Dataset catalogue as an append log of Parquet folders under one atomic pointer.

A change is written as a folder of its own and becomes visible when the next commit file, which
lists all live folders in their order, is put in place under a name that must not exist yet. Two
writers can't both take a number: an append that lost adds its folder to the newer list, an expiry
that lost starts over. What a killed writer leaves behind is in no commit and is never read.
Readers merge on read: of several facts about a dataset the one in the latest folder counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from factsheet import thresholds as T
from factsheet.functions.scalar import cutoff
from factsheet.session import local_rows

FACTS = ("filename", "stored_path", "n_rows", "n_columns", "columns_json", "created_at")
PROFILE = ("profile_json", "task_overridden")
ROWS = ("dataset_id string, filename string, stored_path string, n_rows bigint, n_columns bigint, columns_json string, "
        "created_at timestamp, profile_json string, task_overridden boolean, has_facts boolean, has_profile boolean")
TRIES = 20


class Catalogue:
    """Datasets and their profiles below ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._log = self._path(f"{self.path}/commits")
        self._fs = self._log.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._log.toUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # --- the pointer ------------------------------------------------------------------------------------------------
    def head(self) -> tuple[int, list[str]]:
        """The latest commit's number and its live folders; (0, []) before the first."""
        if not self._fs.exists(self._log):
            return 0, []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._log)]
        numbers = sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())
        if not numbers:
            return 0, []
        text = self.spark.read.text(f"{self.path}/commits/{numbers[-1]:012d}.json", wholetext=True).first()[0]
        return numbers[-1], json.loads(text)

    def _publish(self, number: int, folders: list[str]) -> bool:
        """Put a commit in place unless its number is taken."""
        draft, final = (self._path(self._log, n) for n in (f"draft-{uuid.uuid4().hex}", f"{number:012d}.json"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        try:
            self._context.rename(draft, final, self._no_overwrite)
            return True
        except Exception:
            if self._fs.exists(final):
                self._fs.delete(draft, False)
                return False
            raise

    def _append(self, rows: DataFrame) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _schema()]).write.parquet(f"{self.path}/{folder}")
        for _ in range(TRIES):
            number, folders = self.head()
            if self._publish(number + 1, [*folders, folder]):
                return number + 1
        raise RuntimeError(f"no commit in {TRIES} tries")

    # --- writing ----------------------------------------------------------------------------------------------------
    def insert(self, datasets: DataFrame) -> int:
        """A10: datasets with the columns ``dataset_id`` and ``FACTS``; a repeated id takes the latest facts."""
        return self._append(datasets.select("dataset_id", *FACTS, *[F.lit(None).alias(c) for c in PROFILE],
                                            F.lit(True).alias("has_facts"), F.lit(False).alias("has_profile")))

    def save_profiles(self, profiles: DataFrame) -> int:
        """``dataset_id`` and ``PROFILE``; the last one saved counts. Unknown ids change nothing."""
        return self._append(profiles.select("dataset_id", *[F.lit(None).alias(c) for c in FACTS], *PROFILE,
                                            F.lit(False).alias("has_facts"), F.lit(True).alias("has_profile")))

    # --- reading ----------------------------------------------------------------------------------------------------
    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _schema())
        rows = self.spark.read.schema(_schema()).parquet(*[f"{self.path}/{f}" for f in folders])
        order = ST.StructType([ST.StructField("folder", ST.StringType()), ST.StructField("place", ST.IntegerType())])
        places = local_rows(self.spark, [{"folder": f.split("/")[-1], "place": k} for k, f in enumerate(folders)], order)
        # one row per live folder
        tagged = rows.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).join(
            F.broadcast(places), "folder")
        latest = [F.max_by(F.struct(*names), F.when(F.col(has), F.col("place"))).alias(part)
                  for names, has, part in ((FACTS, "has_facts", "facts"), (PROFILE, "has_profile", "profile"))]
        return tagged.groupBy("dataset_id").agg(*latest).where(F.col("facts").isNotNull()).select(
            "dataset_id", "facts.*", "profile.*", F.lit(True).alias("has_facts"), F.col("profile").isNotNull().alias("has_profile"))

    def snapshot(self) -> DataFrame:
        """Every dataset as of the latest commit, ``state`` complete once it has a profile, else pending."""
        merged = self._read(self.head()[1])
        state = F.when(F.col("has_profile"), "complete").otherwise("pending")
        return merged.select("dataset_id", *FACTS, *PROFILE, state.alias("state"))

    def get(self, dataset_ids: DataFrame, as_of: str, ttl_hours: int = T.DATASET_TTL_HOURS) -> DataFrame:
        """A10: the live rows of the asked ids; unknown and expired ids are both absent."""
        live = self.snapshot().where(F.col("created_at") >= cutoff(as_of, ttl_hours))
        return live.join(dataset_ids.select("dataset_id").distinct(), "dataset_id", "left_semi")

    # --- expiry -----------------------------------------------------------------------------------------------------
    def expire(self, as_of: str, ttl_hours: int = T.DATASET_TTL_HOURS) -> tuple[int, DataFrame]:
        """Rewrite the catalogue without datasets created before ``as_of - ttl``.

        Returns how many went and their rows (``dataset_id``, ``stored_path``), so that their files can be
        removed. All live folders become one. If another writer commits meanwhile, it starts over.
        Without a catalogue there is nothing to expire.
        """
        old = F.coalesce(F.col("created_at") < cutoff(as_of, ttl_hours), F.lit(False))
        for _ in range(TRIES):
            number, folders = self.head()
            merged = self._read(folders)
            gone = merged.where(old).select("dataset_id", "stored_path")
            n = gone.count()
            if n == 0:
                return 0, gone
            folder = f"data/{uuid.uuid4().hex}"
            merged.where(~old).select(_schema().names).write.parquet(f"{self.path}/{folder}")
            if self._publish(number + 1, [folder]):
                return n, gone
        raise RuntimeError(f"no commit in {TRIES} tries")


def _schema() -> ST.StructType:
    return ST.StructType.fromDDL(ROWS)
