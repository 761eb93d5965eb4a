"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their longer prefixes, hashed into buckets. Every
bucket that enough labelled texts have is a feature of the machine; it learns a weight
for each and, by factors, a weight for each pair: an insult together with a group that
is mentioned can weigh more than either does alone, and terms that say nothing alone
can tell together. Features with little evidence, which tell nothing alone and stand in
few texts, count and learn less, so that rows aren't learnt by heart; none is left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+")
CHUNKS_KEPT = 300_000
#: A bucket is a feature if so many labelled texts have it.
LEAST_TEXTS = 3
#: A feature has its full weight from this chi-square statistic on; without any, half of it in so many texts.
FULL_CHI, HALF_TEXTS = 30.0, 1000
#: Features of the texts that are worked on at once.
AT_ONCE = 400_000


def terms(word: str) -> list[str]:
    """A lower-cased word, and its prefixes as terms of their own."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8")) % BUCKETS


class Buckets(dict):
    """chunk between white space -> the features of its words; ``wanted``: of every bucket, or -1; None: all buckets."""

    def __init__(self, wanted: np.ndarray | None = None):
        super().__init__()
        self.wanted = None if wanted is None else memoryview(wanted)

    def __missing__(self, chunk: str):
        found = {bucket(t) for w in WORDS.findall(chunk.lower()) for t in terms(w)}
        if self.wanted is not None:
            found = {k for k in map(self.wanted.__getitem__, found) if k >= 0}
        out = tuple(found)
        if len(chunk) <= 64:
            if len(self) >= CHUNKS_KEPT:
                self.clear()
            self[chunk] = out
        return out

    def of(self, text: str | None) -> set[int]:
        return set().union(*map(self.__getitem__, set(text.split()))) if text else set()


@dataclass
class Machine:
    """``wanted``: feature of every bucket, or -1; ``bias``; ``weight`` (features); ``factor`` (features x rank)."""

    wanted: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    @cached_property
    def table(self) -> np.ndarray:
        """Weight, factors and sum of squared factors of every feature side by side."""
        return np.column_stack([self.weight, self.factor, (self.factor ** 2).sum(axis=1)]).astype(np.float32)

    def score(self, rows: list[set[int]]) -> np.ndarray:
        """The probability of each row's set of features."""
        sizes, raw = np.array([len(r) for r in rows], dtype=np.int64), np.full(len(rows), self.bias)
        for own in _portions(sizes):
            has = np.flatnonzero(sizes[own]) + own.start
            if len(has):
                n = sizes[has]
                flat = np.fromiter((f for k in has for f in sorted(rows[k])), dtype=np.int64, count=int(n.sum()))
                sums = np.add.reduceat(self.table[flat], np.cumsum(n) - n, axis=0).astype(np.float64)
                x = 1 / np.sqrt(1 + np.log(n))  # the same for all features of a row, so the sums come first
                raw[has] += sums[:, 0] * x + 0.5 * ((sums[:, 1:-1] ** 2).sum(axis=1) - sums[:, -1]) * x ** 2
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))


def _portions(sizes: np.ndarray, most: int = 1 << 62) -> Iterator[slice]:
    """Slices of rows with about ``AT_ONCE`` features and at most ``most`` rows each."""
    at = total = 0
    for k, n in enumerate(sizes.tolist()):
        if k > at and (total + n > AT_ONCE or k - at >= most):
            yield slice(at, k)
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def _sum_rows(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; empty runs give zero."""
    ends = np.cumsum(sizes)
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return total[ends] - total[ends - sizes]


def _raw(bias, weight, factor, flat, sizes, counts=None):
    """Bias + weights + half of (square of sums - sum of squares) of the factors; x is 1 / sqrt(1 + log n), times ``counts``."""
    scale = 1 / np.sqrt(1 + np.log(np.maximum(sizes, 1)))
    x = np.repeat(scale, sizes) if counts is None else np.repeat(scale, sizes) * counts[flat]
    vx = factor[flat] * x[:, None]
    sums = _sum_rows(vx, sizes)
    pairs = 0.5 * (sums ** 2 - _sum_rows(vx ** 2, sizes)).sum(axis=1)
    return bias + _sum_rows(weight[flat] * x, sizes) + pairs, x, (vx, sums)


def evidence(pos: np.ndarray, neg: np.ndarray, all_pos: int, all_neg: int) -> np.ndarray:
    """What features count, over 0 to 1, from the texts of either class that have them."""
    n, total = pos + neg, all_pos + all_neg
    chi = (pos * float(all_neg) - neg * float(all_pos)) ** 2 / (n * (total + 1.0 - n)) * (total / (float(all_pos) * all_neg))
    return np.maximum(np.minimum(1, chi / FULL_CHI), n / (n + HALF_TEXTS)).astype(np.float32)


def fit_machine(wanted: np.ndarray, counts: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, *, rank: int = 8,
                epochs: int = 12, batch: int = 256, rate: float = 0.03, decay: float = 1e-3, seed: int = 11) -> Machine:
    """Adaptive gradient descent on the logistic loss of a bounded sample; a step changes the features of its rows only.

    ``counts``: what each feature counts. The machine's weights and factors hold it already.
    """
    rng = np.random.default_rng(seed)
    n = int(wanted.max()) + 1
    prior = np.clip(labels.mean() if len(labels) else 0.0, 1e-4, 1 - 1e-4)
    # the weights and factors of a feature side by side; the bias by itself
    bias, table = np.log(prior / (1 - prior)), np.zeros((n, 1 + rank), np.float32)
    table[:, 1:] = rng.normal(0, 0.05, (n, rank))
    first, second, steps = np.zeros_like(table), np.zeros_like(table), np.zeros(n, np.int32)
    bias_first = bias_second = 0.0
    sizes, step = np.array([len(r) for r in rows], dtype=np.int64), 0
    for _ in range(epochs if n and 0 < labels.sum() < len(labels) else 0):
        order = rng.permutation(len(rows))
        for part in _portions(sizes[order], batch):
            own = order[part]
            flat, size = np.concatenate([rows[k] for k in own]), sizes[own]
            used, flat = np.unique(flat, return_inverse=True)
            now = table[used]
            raw, x, (vx, sums) = _raw(bias, now[:, 0], now[:, 1:], flat, size, counts[used])
            g = (1 / (1 + np.exp(-np.clip(raw, -60, 60))) - labels[own]) / len(own)
            gx = np.repeat(g, size) * x
            grad = decay * now / len(own)
            grad[:, 0] += np.bincount(flat, gx, len(used))
            gv = gx[:, None] * (np.repeat(sums, size, axis=0) - vx)
            for c in range(rank):
                grad[:, 1 + c] += np.bincount(flat, gv[:, c], len(used))
            step += 1
            bias_first += 0.1 * (g.sum() - bias_first)
            bias_second += 0.01 * (g.sum() ** 2 - bias_second)
            bias -= rate * (bias_first / (1 - 0.9 ** step)) / (np.sqrt(bias_second / (1 - 0.99 ** step)) + 1e-8)
            steps[used] += 1
            m, v, t = first[used], second[used], steps[used][:, None]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            first[used], second[used] = m, v
            table[used] = now - rate * counts[used][:, None] * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    table *= counts[:, None]
    return Machine(wanted, float(bias), table[:, 0].copy(), table[:, 1:].copy())


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str,
                    learn_from: Column, rows: int) -> DataFrame:
    """``id``, ``y`` and the buckets of a text ``f`` (packed, ascending) of at most ``rows`` labelled ids, by a hash of the id.

    Of the rows of one id only one counts, the one with the least packed buckets.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn_from).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(
        F.col("doc_id").alias("id"), F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
    # at most ``rows`` ids and labels are broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")
    schema = T.StructType([texts.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("f", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            f = [np.array(sorted(buckets.of(t)), dtype="<i4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], names=schema.names)

    return texts.mapInArrow(encode, schema).groupBy("id", "y").agg(F.min("f").alias("f"))


def _lists(packed: pa.ChunkedArray) -> list[np.ndarray]:
    """The packed numbers of each row, as views of Arrow's own memory."""
    out = []
    for c in packed.chunks:
        offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1] // 4
        numbers = np.frombuffer(c.buffers()[2] or b"", "<i4")
        out += [numbers[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", learn_from: Column | None = None, sample_rows: int = 20_000,
          least_texts: int = LEAST_TEXTS, **fitting) -> Machine:
    """Fit a machine on at most ``sample_rows`` labelled ids, one row of each.

    The sampled texts are read and encoded once and stored. Spark counts, per bucket, the texts of either
    class that have it; every bucket that ``least_texts`` of them have is a feature, at most ``BUCKETS``.
    The driver gets the sample's features as one Arrow table, four bytes for each different term of a sampled text.
    Without labelled rows, or with one class only, the machine answers the share of class 1 for every text.
    """
    small_batches(docs.sparkSession)
    sample = stored(labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col,
                                    learn_from=F.lit(True) if learn_from is None else learn_from, rows=sample_rows), "toxicity-sample")
    counted = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("pos", T.LongType()),
                            T.StructField("neg", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            for y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y, np.frombuffer(f, "<i4")] += 1
                n[y, BUCKETS] += 1  # texts of the class
        has = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[1, has]), pa.array(n[0, has])],
                                         names=counted.names)

    seen = sample.select("y", "f").mapInArrow(count, counted).groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    seen = stored(seen, "toxicity-buckets")
    totals = seen.where(F.col("bucket") == BUCKETS).first()
    pos, neg = (totals["pos"], totals["neg"]) if totals else (0, 0)
    wanted, counts = np.full(BUCKETS, -1, np.int32), np.zeros(0, np.float32)
    if pos and neg:  # at most ``BUCKETS`` rows of numbers
        best = seen.where((F.col("bucket") < BUCKETS) & (F.col("pos") + F.col("neg") >= least_texts)).toArrow().sort_by("bucket")
        wanted[best["bucket"].to_numpy()] = np.arange(len(best))
        counts = evidence(best["pos"].to_numpy(), best["neg"].to_numpy(), pos, neg)
    if wanted.max() < 0:
        share = pos / (pos + neg) if pos + neg else 0.0
        return fit_machine(wanted, counts, [], np.full(1, share), **fitting)
    rows_type = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("f", T.BinaryType())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [wanted[np.frombuffer(x, "<i4")] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[x >= 0].astype("<i4").tobytes() for x in f], pa.binary())],
                                             names=rows_type.names)

    # the machine must not depend on the order in which tasks end
    rows = sample.orderBy(F.xxhash64("id"), "id").select("y", "f").mapInArrow(features, rows_type).toArrow()
    return fit_machine(wanted, counts, _lists(rows["f"]), rows["y"].to_numpy().astype(np.float64), **fitting)


def score_column(machine: Machine, spark, text: Column) -> Column:
    """The machine's score of a text column, for whole texts; null and empty texts get the score of no terms."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(machine)

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets(sent.value.wanted)
        for s in parts:
            yield pd.Series(sent.value.score([buckets.of(t) for t in s]), dtype="float64")

    return score(text)


def score_toxicity(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.5) -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more) of every row.

    Null and empty texts get the score of a text without terms; null ids stay null;
    repeated rows get equal scores; an empty table gives an empty result; other columns
    are not read. One map over the rows, with no shuffle; the broadcast machine is
    bounded by its number of features.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(sent.value.wanted)
        for b in batches:
            scores = sent.value.score([buckets.of(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=schema.names)

    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, machine: Machine, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    text = F.col(f"`{text_col}`")
    return docs.where(score_column(machine, docs.sparkSession, text) < threshold)
