"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a keyed hash and offered up to ``most``
times. A copy's virtual finish time is its source's words up to and with it, divided
by the source's target; served in the order of these times, the sources advance
side by side in proportion to their targets. The queue is sorted globally by range
and cut where its words reach the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, free_name, partition_offsets, stored, with_row

#: Sources are a dimension that people weigh by name; more than this is refused, not cut.
MOST_SOURCES = 100_000
SEED = "mix"


@dataclass(frozen=True)
class Target:
    source: str | None
    words: int
    weight: float
    target: float


def share_targets(words: dict[str | None, int], weights: dict[str | None, float], share: float = 1.0,
                  most: int = 3) -> list[Target]:
    """Share ``share`` of all words by weight; no source gets over ``most`` times its own.

    What a source can't take is shared again among the others by weight. The sources
    at their limit are the first in the order of limit over weight, so one pass in
    that order settles it.
    """
    order = sorted(words, key=lambda s: (most * words[s] / weights[s], s is None, s or ""))
    left, weight, out = share * sum(words.values()), sum(weights.values()), {}
    level = None
    for s in order:
        if level is None and weights[s] * (left / weight) > most * words[s]:
            out[s] = float(most * words[s])
            left, weight = left - most * words[s], weight - weights[s]
        else:
            level = left / weight if level is None else level
            out[s] = weights[s] * level
    return [Target(s, words[s], weights[s], out[s]) for s in order]


def cycled_weights(sources, weights=(1, 2, 3)) -> dict[str | None, float]:
    """Sources by code point, null last, weigh the given weights in turn."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def mix_sources(docs: DataFrame, weights=cycled_weights, *, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", share: float = 1.0, most: int = 3, seed: str = SEED) -> DataFrame:
    """What a mix of ``share`` of all words takes from each document.

    ``weights`` maps the set of sources to a dict of weights. One row per input row:
    ``doc_id``, ``size`` (words; null text: 0), ``source_size``, ``target`` (of its
    source), ``taken`` (words that the mix takes, copies counted) and ``_row``. Copies are taken
    whole, but for the one at the cut. Reruns agree: the shuffle is a hash of the id.

    Null sources are one source; null ids are shuffled as one id, ties go by id and
    row; repeated rows are documents of their own; empty texts and sources without
    words take nothing; an empty table gives an empty result; other columns are not
    read. ``docs`` must be a stored table, or come out in the same order each time.

    A hot source, or one id on many rows, is split by range: rows are range-sorted by source,
    hash, id and row, and each source's totals per range summed first; the queue's order is a
    range partitioning by finish time.
    """
    spark = docs.sparkSession
    sized = stored(with_row(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))).withColumn(
        "shuffled", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    words = {r["source"]: r["words"] for r in totals}
    targets = share_targets(words, weights(words), share, most) if words else []
    budget = min(round(share * sum(words.values())), most * sum(words.values()))
    sources = spark.createDataFrame(
        [(t.source, t.words, t.target) for t in targets],
        T.StructType([T.StructField("of", T.StringType()), T.StructField("source_size", T.LongType()),
                      T.StructField("target", T.DoubleType())]))

    # words of the source up to a document, in the shuffled order: rows sorted by range on source, hash, id and
    # row number, so a hot source or an id that many rows hold lies in many ranges; words of a source's
    # earlier ranges (its offset in one, from totals per source and range), then those inside the range
    line = [F.col("source").asc_nulls_last(), "shuffled", F.col("doc_id").asc_nulls_last(), "_row"]
    lined = stored(sized.repartitionByRange(*line).withColumn("part", F.spark_partition_id()), "mix-line")
    # a row per source and range that holds it: at most the ranges and the sources together
    sums = lined.groupBy("source", "part").agg(F.sum("size").alias("n"))
    parts = sums.select(F.col("source").alias("of_part"), F.col("part").alias("p_part"), F.coalesce(F.sum("n").over(
        Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "part").orderBy(*line[1:]).rowsBetween(Window.unboundedPreceding, 0)
    queued = lined.withColumn("n", F.sum("size").over(inside)).join(
        parts, F.col("source").eqNullSafe(F.col("of_part")) & (F.col("part") == F.col("p_part"))).select(
        "doc_id", "_row", "source", "size", (F.col("before") + F.col("n")).alias("up_to")).join(
        F.broadcast(sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    # the queue: each copy's finish time, sorted globally, with the words before it
    finish = F.try_divide(F.col("copy") * F.col("source_size") + F.col("up_to"), F.col("target")).alias("finish")
    copies = queued.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).select(
        "_row", "doc_id", "size", "copy", finish)
    order = ["finish", F.col("doc_id").asc_nulls_last(), "_row", "copy"]
    ranged = stored(copies.repartitionByRange(*order).withColumn("at", F.spark_partition_id()), "mix-queue")
    offsets = partition_offsets(ranged.groupBy("at").agg(F.sum("size").alias("n")), "at", "n")
    ahead = Window.partitionBy("at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of the queue: bounded by the number of partitions
    served = ranged.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0))).join(
        F.broadcast(offsets), "at").withColumn("ahead", F.col("ahead") + F.col("_offset"))
    taken = served.where(F.col("ahead") < budget).groupBy("_row").agg(
        F.sum(F.least("size", F.lit(budget) - F.col("ahead"))).alias("taken"))
    return queued.join(taken, "_row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "_row")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, each as often as it was taken.

    The copy at the cut counts as whole when at least half of it is taken.
    """
    mix = mix_sources(docs, **options)
    number, row, times = (free_name(docs, x) for x in ("_number", "_mix_row", "_mix_times"))
    copies = mix.where("taken > 0").select(
        F.col("_row").alias(row), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    found = with_row(docs, number).join(copies, F.col(number) == F.col(row))
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    return found.select(*names, F.explode(F.sequence(F.lit(1), F.col(times))).alias(free_name(docs, "_copy"))).select(*names)
