"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine, components.

Each distinct vector of a label gets a key of ``bits`` signs in each of ``tables``
tables; vectors that share a key are compared by exact cosine in double precision.
A pair at cosine c shares a sign with probability p = 1 - arccos(c) / pi, and so meets
in some table with probability 1 - (1 - p ** bits) ** tables: 0.974 at c = 0.93 for 14
signs and 20 tables, more above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, with_row
from .components import components, roots
from .pages import EMPTY, LINK, NUMBER, compare_groups

TABLES, SIGNS, SEED = 20, 14, 20240229
PAGE_ROWS = 512


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def signatures(x: np.ndarray, tables: int = TABLES, bits: int = SIGNS, seed: int = SEED) -> np.ndarray:
    """The key of each row of ``x`` in each table."""
    signs = x @ hyperplanes(x.shape[1], tables, bits, seed) >= 0
    return signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by the largest entry first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(v):
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _table_rows(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """A row per vector and table: its key there, and what the comparison needs."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("rank", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("table", T.IntegerType()),
                           T.StructField("vector", T.BinaryType()), T.StructField("keys", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = flat[np.repeat(sizes == dim, sizes)].reshape(-1, dim)
                # float vectors travel as floats: that is their exact value
                raw = x.astype("<f4") if x.dtype == np.float32 else x.astype("<f8")
                keys = signatures(unit(x.astype(np.float64)), tables, bits, seed).astype("<u4")
                labels, ids, n = (b.column(c).take(pa.array(own)) for c in range(3))
                vectors = pa.array([r.tobytes() for r in raw], pa.binary())
                packed = pa.array([r.tobytes() for r in keys], pa.binary())
                for t in range(tables):
                    key = pa.array([f"{t}:{dim}:{k}:{lab}" for k, lab in zip(keys[:, t].tolist(), labels.to_pylist())])
                    yield pa.RecordBatch.from_arrays([key, ids, n, pa.array(np.full(len(own), t, np.int32)), vectors, packed],
                                                     names=schema.names)

    return classes.select("label", "class", "n", "embedding").mapInArrow(run, schema)


def _read(t: pa.Table):
    """Vectors at length one, keys in all tables, number of the table, class ids and sizes."""
    raw = t["vector"].to_pylist()
    keys = np.frombuffer(b"".join(t["keys"].to_pylist()), "<u4").reshape(len(raw), -1)
    return raw, keys, t["table"].to_numpy(), t["class"].to_numpy(), t["n"].to_numpy()


def _vectors(raw: list[bytes], wide: bool) -> np.ndarray:
    return unit(np.frombuffer(b"".join(raw), "<f8" if wide else "<f4").astype(np.float64).reshape(len(raw), -1))


def embedding_links(classes: DataFrame, threshold: float = 0.93, *, tables: int = TABLES, bits: int = SIGNS,
                    seed: int = SEED) -> DataFrame:
    """Of distinct vectors (``label`` text, ``class``, ``n`` copies, ``embedding``): found links.

    Returns ``kind``, ``a``, ``b``: links that join what pairs at ``threshold`` or more
    join, and per class how many vectors it links with directly. A pair counts in the
    first table in which it shares a key, so it counts once.
    """
    wide = classes.schema["embedding"].dataType.elementType != T.FloatType()

    def compare(x, y, same: bool):
        """Positions of linked pairs, and those of them that no earlier table has found."""
        (v, keys_x, table, _, _), (w, keys_y, *_) = x, y
        near = _vectors(v, wide) @ _vectors(w, wide).T >= threshold
        if same:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        earlier = (keys_x[i] == keys_y[j])[:, :table[0]].any(axis=1) if len(i) else np.empty(0, bool)
        return i[~earlier], j[~earlier]

    def told(ids, n, i, j):
        if not len(i):
            return EMPTY
        links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        linked = np.flatnonzero(links)
        p = roots(len(ids), i, j)
        own = np.flatnonzero(p != np.arange(len(ids)))
        return (np.concatenate([np.full(len(own), LINK), np.full(len(linked), NUMBER)]).astype(np.int32),
                np.concatenate([ids[p[own]], ids[linked]]), np.concatenate([ids[own], links[linked].astype(np.int64)]))

    def inside(rows: pa.Table, group: np.ndarray):
        raw, keys, table, ids, n = _read(rows)
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        stop = np.concatenate([start[1:], [len(group)]])
        i_s, j_s = [], []
        for s, e in zip(start, stop):
            if e - s > 1:
                part = (raw[s:e], keys[s:e], table[s:e], None, None)
                i, j = compare(part, part, True)
                i_s.append(i + s)
                j_s.append(j + s)
        return told(ids, n, np.concatenate(i_s), np.concatenate(j_s)) if i_s else EMPTY

    def across(x: pa.Table, y: pa.Table):
        a, b = _read(x), _read(y)
        i, j = compare(a, b, False)
        return told(np.concatenate([a[3], b[3]]), np.concatenate([a[4], b[4]]), i, j + len(a[3]))

    keyed = _table_rows(classes, tables, bits, seed).withColumn("class", F.col("rank"))
    # a page's header has nothing to prune by: all members of a group share its signs
    return compare_groups(keyed, inside, across, lambda page: (0, 0), most_difference=0, page_rows=PAGE_ROWS, held_rows=4096)


def embedding_groups(vectors: DataFrame, threshold: float = 0.93, *, id_col: str = "vec_id",
                     vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES,
                     bits: int = SIGNS, seed: int = SEED) -> DataFrame:
    """Links among vectors of equal label at cosine ``threshold`` or more, and their components.

    One row per input row: ``vec_id``, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id reachable) and ``kept`` (id equals component id).

    Vectors that are null, empty, zero, or hold null or non-finite entries, and those
    without label, link with nothing. Vectors of different length are not compared.
    Repeated rows are vectors of their own that link with each other; null ids count as
    vectors, but name a component only where it has no other id (then null, and ``kept``
    is true). An empty table gives an empty result; columns beyond the three named are
    not read. ``vectors`` must be a stored table, or come out in the same order each time.

    Equal vectors of a label become one class first, combined before the shuffle, so
    a vector copied many times is compared once; large groups are compared in pages.
    """
    small_batches(vectors.sparkSession)
    rows = with_row(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                                   F.col(vector_col).alias("embedding")))
    usable = F.col("label").isNotNull() & _usable(F.col("embedding"))
    sorted_out = rows.withColumn("usable", usable)
    key = ["label", "embedding"]
    classes = stored(sorted_out.where("usable").groupBy(*key).agg(
        F.min("_row").alias("class"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "vector-classes")
    found = stored(embedding_links(classes, threshold, tables=tables, bits=bits, seed=seed), "vector-links")
    groups = components(found.where(F.col("kind") == LINK).select("a", "b"))
    numbers = found.where(F.col("kind") == NUMBER).groupBy("a").agg(F.sum("b").alias("links"))
    labelled = classes.join(groups, F.col("class") == F.col("id"), "left").join(
        numbers, F.col("class") == F.col("a"), "left").select(
        *key, F.coalesce("component", "class").alias("component"), "least",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.drop("least").join(least, "component").select(*key, "n_links", "component_id")
    linked = sorted_out.where("usable").select("vec_id", *key).join(named, key).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = sorted_out.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                  F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
