"""Comparing the members of many groups, some of them huge, in bounded pages.

Rows are range-sorted by (group key, rank): a large group spreads over as many
partitions as its rows need. A task compares small groups as they stream past. A group that is
longer than a page, or that touches the edge of a partition and so may go on in the
next, is written as pages: each page is compared with itself at once, and pairs of
pages of one group, pruned by what their headers say, are compared afterwards, dealt
out by pair. So no task holds more than two pages of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

#: What a comparison may emit: links (a, b) of kind 0 and numbers (a: of what, b: how many) of kind 1.
LINK, NUMBER, PAGE = 0, 1, 2
OUT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
HEAD = [T.StructField("key", T.StringType()), T.StructField("page", T.LongType()),
        T.StructField("head_mask", T.LongType()), T.StructField("head_bits", T.LongType()),
        T.StructField("rows", T.BinaryType())]
Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # kind, a, b


def _pack(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpack(x: bytes) -> pa.Table:
    return pa.ipc.open_stream(x).read_all()


def _batch(found: Found, heads: list[tuple] = ()) -> pa.RecordBatch:
    kind, a, b = found
    none = len(kind)
    more = np.zeros(len(heads), np.int64)
    cols = [np.concatenate([kind, more + PAGE]), np.concatenate([a, more]), np.concatenate([b, more])]
    lists = [[None] * none + [h[i] for h in heads] for i in range(5)]
    arrays = [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
              pa.array(lists[0], pa.string()), *(pa.array(x, pa.int64()) for x in lists[1:4]), pa.array(lists[4], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "a", "b", *(f.name for f in HEAD)])


EMPTY: Found = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))


def compare_groups(keyed: DataFrame, inside: Callable[[pa.Table, np.ndarray], Found],
                   across: Callable[[pa.Table, pa.Table], Found],
                   head: Callable[[pa.Table], tuple[int, int]], *, most_difference: int,
                   page_rows: int = 2048, held_rows: int = 16_384) -> DataFrame:
    """Compare all rows of ``keyed`` (``key``, ``rank``, more) that share a key.

    ``inside(rows, group_numbers)`` compares rows of equal group number (sorted by
    key and rank), ``across(rows, rows)`` two pages of one group; both return found
    (kind, a, b). ``head`` gives a page's shared bits (mask, bits): pairs of pages
    whose shared bits differ in more than ``most_difference`` places are left out.
    Returns ``kind``, ``a``, ``b``.
    """
    spark = keyed.sparkSession
    small_batches(spark, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state = {"page": 0, "first": True, "open": False}

        def pages(rows: pa.Table):
            for at in range(0, len(rows), page_rows):
                page = rows.slice(at, page_rows).combine_chunks()
                mask, bits = head(page)
                found = inside(page, np.zeros(len(page), np.int64))
                yield _batch(found, [(page["key"][0].as_py(), (part << 32) + state["page"], mask, bits, _pack(page))])
                state["page"] += 1

        def settle(rows: pa.Table, last: bool):
            """Yields results; returns the rows of the group that may go on."""
            keys = rows["key"].combine_chunks()
            change = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(rows)]])
            done = len(starts) if last else len(starts) - 1
            paged = ends - starts > page_rows
            if state["first"] or state["open"]:
                paged[0] = True
            if last:
                paged[-1] = True
            if done:
                state["first"] = state["open"] = False
            small = np.repeat(~paged[:done], (ends - starts)[:done])
            if small.any():
                number = np.repeat(np.arange(done), (ends - starts)[:done])[small]
                yield _batch(inside(rows.slice(0, len(small)).filter(pa.array(small)).combine_chunks(), number))
            for g in np.flatnonzero(paged[:done]):
                yield from pages(rows.slice(starts[g], ends[g] - starts[g]))
            rest = rows.slice(starts[-1]) if not last else rows.slice(len(rows))
            whole = len(rest) // page_rows * page_rows
            if whole:
                state["open"], state["first"] = True, False
                yield from pages(rest.slice(0, whole))
                rest = rest.slice(whole)
            state["rest"] = rest

        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= held_rows:
                yield from settle(pa.Table.from_batches(held), False)
                held, n = state["rest"].to_batches(), 0
        if held and sum(b.num_rows for b in held):
            yield from settle(pa.Table.from_batches(held), True)

    rest = [c for c in keyed.columns if c not in ("key", "rank")]
    ranged = keyed.repartitionByRange("key", "rank").sortWithinPartitions("key", "rank")
    first = stored(ranged.select("key", *rest).mapInArrow(run, T.StructType([*OUT.fields, *HEAD])), "pages")
    heads = first.where(F.col("kind") == PAGE).select("key", "page", "head_mask", "head_bits")
    left, right = (heads.select(F.col("key"), *(F.col(c).alias(f"{c}_{s}") for c in heads.columns[1:])) for s in "ab")
    shared = F.col("head_mask_a").bitwiseAND(F.col("head_mask_b"))
    pairs = left.join(right, "key").where(
        (F.col("page_a") < F.col("page_b"))
        & (F.bit_count(F.col("head_bits_a").bitwiseXOR(F.col("head_bits_b")).bitwiseAND(shared)) <= most_difference)
    ).select("page_a", "page_b")
    rows = first.where(F.col("kind") == PAGE).select("page", "rows")
    both = pairs.join(rows.toDF("page_a", "rows_a"), "page_a").join(rows.toDF("page_b", "rows_b"), "page_b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1)):
                kind, a, c = across(_unpack(x.as_py()), _unpack(y.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(c, pa.int64())],
                                                 names=OUT.names)

    later = both.select("rows_a", "rows_b").mapInArrow(meet, OUT)
    return first.where(F.col("kind") != PAGE).select(*OUT.names).unionByName(later)
