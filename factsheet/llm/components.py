"""Connected components of a distributed edge list, and forests of small ones in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` positions reaches over the links (i, j)."""
    p = np.arange(n)
    while len(i):
        low = np.minimum(p[i], p[j])
        q = p.copy()
        np.minimum.at(q, p[i], low)
        np.minimum.at(q, p[j], low)
        while not np.array_equal(q, q[q]):
            q = q[q]
        if np.array_equal(p, q):
            break
        p = q
    return p


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger, then smaller, neighbours move to the least node near it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    # now a > b in every edge
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id it reaches) of every node of the edges (a, b).

    Alternates the large-star and small-star steps until nothing changes: a number
    of rounds that grows with the logarithm of the longest chain. Each round is
    written to the shared checkpoint folder; a node with very many neighbours is
    combined before the shuffle and joined by key, never gathered in one row.
    Self-links are ignored; no edges give no rows.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, before = mark, now
        now = stored(_stars(now), "edges")
        drop_stored(before)
    leaves = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
