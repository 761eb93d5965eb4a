"""Concatenate-and-cut packing of token ids into fixed windows.

Pass 1 encodes every text once, in the order of its partition, and stores the ids
with their place inside the partition. The partition totals' prefix sums give each
partition its place in the one long stream of ids. Pass 2 cuts each document's ids
where the stream crosses a multiple of the window: the pieces on either side of a
cut are the boundary records, so no task needs its neighbour's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partition_offsets, small_batches, stored
from .tokens import coder, load_tokenizer, splits_at_space, whole_tokens


def encode_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = 2) -> DataFrame:
    """Pass 1: ``id_col``, ``part``, ``place`` (ids before it in its partition), ``n``, ``ids`` (packed)."""
    spark = docs.sparkSession
    small_batches(spark)
    whole = spark.sparkContext.broadcast(whole_tokens(tokenizer) if splits_at_space(tokenizer) else {})
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("part", T.IntegerType()),
        T.StructField("place", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    names = [id_col, "part", "place", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(tokenizer, whole.value, False)
        part, place = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, n = encode.ids(b.column(1), end_id)
            ends = np.concatenate([[0], np.cumsum(n)]) * ids.dtype.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
            before = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n),
                 packed], names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack all documents into sequences of ``window`` ids; one row per piece.

    A document's ids are its tokens and then ``end_id``. Columns: ``id_col``, ``start``
    (its document's ids before the piece), ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset`` (place in the sequence; gapless from 0) and ``ids`` (the piece's ids as
    little-endian unsigned 32-bit numbers). Only the last sequence can be short.

    Null texts count as empty and give one piece with ``end_id`` alone; a null id stays
    null; repeated rows are packed each on their own; an empty table gives no piece;
    columns beyond the two named are not read. Texts are encoded whole, in one pass.
    """
    spark = docs.sparkSession
    coded = stored(encode_documents(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id), "packing")
    totals = coded.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per partition of the input: small against any input, and so sent to every task
    placed = coded.join(F.broadcast(partition_offsets(totals, "part", "n")), "part")
    width = np.dtype("<u2" if load_tokenizer(tokenizer).get_vocab_size() <= 1 << 16 else "<u4")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(
        T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")),
        T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out, ids = [], [[] for _ in range(5)], []
            for k, (at, x) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                own = np.frombuffer(x, dtype=width).astype("<u4")
                start, n = 0, len(own)
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    rows.append(k)
                    for c, v in zip(out, (start, length, n, sequence, offset)):
                        c.append(v)
                    ids.append(own[start:start + length].tobytes())
                    start += length
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in out),
                 pa.array(ids, pa.binary())], names=schema.names)

    small_batches(spark)
    return placed.select(id_col, (F.col("_offset") + F.col("place")).alias("at"), "ids").mapInArrow(cut, schema)
