"""SimHash near-duplicates with a Gray-order hierarchical index.

Distinct fingerprints are dealt into groups that share two of five bit blocks: of any
two fingerprints that differ in at most three bits, two blocks at least are the same, so each such
pair meets in some group. Inside a group the fingerprints stand in the order of their
Gray rank, where neighbours share long bit patterns. The bits that a run of
neighbours shares go into an upper node, once; the search goes down pairs of nodes,
adds up the differences of the shared bits as they come to light, and drops a pair of
nodes, with all below, once the sum is over the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, with_row, without_rows
from .components import components, roots
from .pages import EMPTY, LINK, compare_groups

BITS, BLOCKS, SPREAD = 64, (13, 13, 13, 13, 12), 16
#: Groups up to this size are compared by shifting; larger ones by the tree.
SHIFTED = 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, at_once: int = 1 << 16) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    import xxhash

    # bytes are lower-cased in A-Z only and split at space and U+0009 to U+000D only
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    hashes = map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, at_once):
        h = np.fromiter(hashes, dtype="<u8", count=min(at_once, n - start))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """``doc_id``, ``_row`` and ``bits`` (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("_row", T.LongType()),
                           T.StructField("bits", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([fingerprint(t, shingle, seed) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits.view(np.int64))], names=schema.names)

    rows = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", "_row", "text").mapInArrow(run, schema)


def gray_rank(bits: Column) -> Column:
    """The place of a 64-bit pattern in the Gray code: the exclusive-or of all its right shifts."""
    for k in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, k))
    return bits


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bottom up: of each node its mask of shared bits and their pattern."""
    every, some, levels = fp, fp, []
    while True:
        at = np.arange(0, len(every), SPREAD)
        every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
        mask = ~(every ^ some)
        levels.append((mask, every & mask))
        if len(at) == 1:
            return levels


def _children(i: np.ndarray, j: np.ndarray, n_i: int, n_j: int, same: bool):
    """All pairs of children of the node pairs (i, j); of one tree's, each pair once."""
    step = np.arange(SPREAD)
    a = (i[:, None, None] * SPREAD + step[None, :, None] + np.zeros_like(step)[None, None, :]).ravel()
    b = (j[:, None, None] * SPREAD + step[None, None, :] + np.zeros_like(step)[None, :, None]).ravel()
    parent = np.repeat(np.arange(len(i)), SPREAD * SPREAD)
    ok = (a < n_i) & (b < n_j)
    if same:
        ok &= a <= b
    return a[ok], b[ok], parent[ok]


def tree_links(x: np.ndarray, y: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in x, j in y) that differ in at most ``most`` bits; y None: pairs i < j in x.

    Both arrays are in Gray order. ``sum_`` is the difference added up on the way down
    and ``known`` the bits that it covers; a child pair adds only bits new to it.
    """
    same = y is None
    y = x if same else y
    up, vp = _levels(x), _levels(y)
    while len(up) < len(vp):
        up.append(up[-1])
    while len(vp) < len(up):
        vp.append(vp[-1])
    i = j = np.zeros(1, np.int64)
    sum_, known = np.zeros(1, np.int64), np.zeros(1, np.uint64)
    for level in range(len(up) - 1, -1, -1):
        (mask_i, bits_i), (mask_j, bits_j) = up[level], vp[level]
        if level < len(up) - 1:
            i, j, parent = _children(i, j, len(mask_i), len(mask_j), same)
            sum_, known = sum_[parent], known[parent]
        shared = mask_i[i] & mask_j[j]
        sum_ = sum_ + np.bitwise_count((bits_i[i] ^ bits_j[j]) & shared & ~known)
        known = known | shared
        ok = sum_ <= most
        i, j, sum_, known = i[ok], j[ok], sum_[ok], known[ok]
    found_i, found_j = [], []
    for at in range(0, len(i), 4096):  # leaves: the fingerprints of a few thousand node pairs at a time
        a, b, _ = _children(i[at:at + 4096], j[at:at + 4096], len(x), len(y), False)
        ok = np.bitwise_count(x[a] ^ y[b]) <= most
        if same:
            ok &= a < b
        found_i.append(a[ok])
        found_j.append(b[ok])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64),) * 2


def _forest(fp: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Links that join what (i, j) join: one fewer than nodes, however many pairs there are."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    p = roots(len(used), at[:len(i)], at[len(i):])
    own = np.flatnonzero(p != np.arange(len(used)))
    a, b = fp[used[p[own]]].view(np.int64), fp[used[own]].view(np.int64)
    return np.full(len(a), LINK, np.int32), a, b


def _prints(t: pa.Table) -> np.ndarray:
    return t["bits"].to_numpy().view(np.uint64)


def simhash_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``bits`` that join all pairs within ``most`` bits (3 or less)."""
    if most > len(BLOCKS) - 2:
        raise ValueError("two clean blocks of five need a distance of 3 or less")
    at = np.concatenate([[0], np.cumsum(BLOCKS)])
    bits = F.col("bits")
    block = [F.shiftrightunsigned(bits, int(at[i])).bitwiseAND(F.lit((1 << w) - 1)) for i, w in enumerate(BLOCKS)]
    keys = [F.concat(F.lit(chr(65 + t)), F.lpad(F.hex(block[a] * F.lit(1 << 13) + block[b]), 7, "0"))
            for t, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))]
    keyed = prints.select(F.explode(F.array(*keys)).alias("key"), gray_rank(bits).alias("rank"), "bits")

    def inside(rows: pa.Table, group: np.ndarray):
        fp = _prints(rows)
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([start, [len(fp)]]))
        i_s, j_s = [], []
        small = np.repeat(size <= SHIFTED, size)
        for d in range(1, SHIFTED):
            at = np.flatnonzero((group[:-d] == group[d:]) & small[:-d]) if d < len(fp) else np.empty(0, np.int64)
            if not len(at):
                break
            at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= most]
            i_s.append(at)
            j_s.append(at + d)
        for s, n in zip(start[size > SHIFTED], size[size > SHIFTED]):
            i, j = tree_links(fp[s:s + n], None, most)
            i_s.append(i + s)
            j_s.append(j + s)
        if not i_s or not sum(map(len, i_s)):
            return EMPTY
        return _forest(fp, np.concatenate(i_s), np.concatenate(j_s))

    def across(x: pa.Table, y: pa.Table):
        a, b = _prints(x), _prints(y)
        i, j = tree_links(a, b, most)
        return _forest(np.concatenate([a, b]), i, j + len(a)) if len(i) else EMPTY

    def head(page: pa.Table):
        fp = _prints(page)
        every, some = np.bitwise_and.reduce(fp), np.bitwise_or.reduce(fp)
        mask = ~(every ^ some)
        return int(mask.view(np.int64)), int((every & mask).view(np.int64))

    return compare_groups(keyed, inside, across, head, most_difference=most).select("a", "b")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   seed: int = 42, most: int = 3) -> DataFrame:
    """Near-duplicate groups: texts whose fingerprints link, directly or over others.

    One row per input row: ``doc_id``, ``fingerprint`` (16 lowercase hex digits),
    ``component_id`` (smallest id reachable), ``kept`` (one row per component: its
    smallest id, of repeated ids the first row) and ``_row``.

    Null, empty and blank texts have fingerprint zero and link like any other. Null
    ids stand behind all others; a component without ids has a null ``component_id``.
    Repeated rows fall into one component. An empty table gives an empty result;
    columns beyond the two named are not read. ``docs`` must be a stored table, or come
    out in the same order each time. Copies are combined by fingerprint first.
    """
    rows = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    prints = stored(rows.groupBy("bits").agg(first.alias("first")), "distinct-fingerprints")
    found = components(simhash_links(prints.select("bits"), most))
    labelled = prints.join(found.withColumnRenamed("id", "bits"), "bits", "left").select(
        "bits", "first", F.coalesce("component", "bits").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("first"))
    named = labelled.select("bits", "component").join(least, "component").select("bits", "first")
    return rows.join(named, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"),
        (F.col("_row") == F.col("first.row")).alias("kept"), "_row")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``simhash_groups``)."""
    return without_rows(docs, simhash_groups(docs, **options).where(~F.col("kept")))
