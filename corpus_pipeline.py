"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works
on all that its predecessor kept, and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``docs``, whatever they are. ``run`` applies them to the ``documents`` table.

Null, empty and very long texts, repeated rows, empty tables and extra columns go
through every stage as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsheet.llm import common
from factsheet.llm.exact_dedup import drop_exact_duplicates
from factsheet.llm.mixing import mixed_documents
from factsheet.llm.packing import pack_documents
from factsheet.llm.queries import remainder, tokenizer_path
from factsheet.llm.simhash import drop_near_duplicates
from factsheet.llm.toxicity import drop_toxic, train


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorization machine scores at 0.5 or more go."""
    machine = train(docs, common.table(spark, sf_dir, "labels"), learn_from=remainder("doc_id", 5) != 0)
    return drop_toxic(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the row with the smallest id stays."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash fingerprints (three-word shingles, three bits), the smallest id stays."""
    return drop_near_duplicates(docs, shingle=3, most=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weighted mix of sources takes it, up to three times."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 token ids, with their ids and checksums."""
    pieces = pack_documents(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "ids")


STAGES = [("toxicity", drop_toxic_documents), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies),
          ("source_mix", mix), ("packing", pack)]

#: Scores, fingerprints and tokens have no SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
