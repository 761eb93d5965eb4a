"""Prefix trie of conversations by van Emde Boas recursion.

A sequence is cut at half its (padded) depth; the cut prefix is named, the upper half and the
forest below the names are cut again in the same step, down to single turns. A depth is
so reached through the cuts that the bits of its number tell: the prefix of m turns is the
prefix of m less its lowest set bit, and one block of that many turns. Blocks are digested
bottom up in pairs, names made top down, and every step holds half the rows of the one before.

Totals over subtrees are grafted the other way. Going up, a node adds to its own the totals of
the lower half below it, for blocks of 1, 2, 4 ... depths. Going down from the longest blocks to
the shortest, a node adds what the finished nodes at its block's end hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, join_by_key, stored

NAME_BYTES = 16
ROOT = b"\0" * NAME_BYTES
#: Ids that one piece of a list of ends holds at most.
PIECE_IDS = 4096


def digest(column: Column) -> Column:
    """The first 16 bytes of SHA-256: names of 2^32 prefixes collide with a chance of 2^-64."""
    return F.substring(F.unhex(F.sha2(column, 256)), 1, NAME_BYTES)


def turn_token(role: Column, text: Column) -> Column:
    """One name for a role and a text; null counts as empty."""
    part = lambda c: F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256)
    return F.unhex(F.sha2(F.concat(part(role), part(text)), 256))


def placed_turns(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv``, ``pos`` (from 0), ``token`` and ``words`` of every turn; texts are not shuffled.

    Turns stand in the order of their number, null first, equal numbers in the order of
    their token. Rows without conversation id belong to none and are left out. A conversation
    that holds a large share of all rows spreads over the ranges of one sort; a range needs
    only the number of its first conversation's turns before it.
    """
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        turn_token(F.col(role_col), F.col(text_col)).alias("token"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), "token", "row"]
    ranged = stored(rows.repartitionByRange("conv", *order).withColumn("at", F.spark_partition_id()), "turn-ranges")
    counts = ranged.groupBy("conv", "at").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a range can have turns before it: at most one row per range
    before = counts.withColumn("before", F.sum("n").over(w)).where("before > 0").select("conv", "at", "before")
    inside = Window.partitionBy("conv", "at").orderBy(*order)
    return ranged.withColumn("place", F.row_number().over(inside)).join(F.broadcast(before), ["conv", "at"], "left").select(
        "conv", (F.coalesce("before", F.lit(0)) + F.col("place") - 1).cast("long").alias("pos"),
        F.substring("token", 1, NAME_BYTES).alias("token"), "words")


def rebuilt_turns(placed: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another one.

    Conversation c takes its first h = crc32(c) mod ``most`` turns from conversation c - c % ``every``
    (all if it has fewer, none if there is none) and goes on with its own turns after its first h.
    Returns the turns (``conv``, ``pos``, ``token``, ``words``, ``last``) and all ``conv`` with ``turns``.
    """
    placed = stored(placed, "turns-placed")
    taken = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most))
    own = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = own.select("conv", "n", taken.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    has = own.select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("of_base"))
    facts = stored(convs.join(has, "base", "left").withColumn(
        "lent", F.least(F.coalesce("of_base", F.lit(0)), "h")).withColumn(
        "turns", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("of_base"), "turn-facts")
    heads = placed.where((F.col("conv") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv", "base")
    # at most 2 * every conversations share a base, each takes under ``most`` turns
    lent = facts.where("lent > 0").join(heads, "base").where("pos < lent").select(
        "conv", "pos", "token", "words", (F.col("pos") == F.col("turns") - 1).alias("last"))
    kept = join_by_key(placed, facts.select("conv", "n", "h", "lent", "turns"), "conv", "n").where("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "token", "words",
        (F.col("pos") - F.col("h") + F.col("lent") == F.col("turns") - 1).alias("last"))
    return lent.unionByName(kept), facts.select("conv", "turns")


def _low_bit(depth: Column) -> Column:
    """The number of the lowest set bit."""
    return F.log2(depth.bitwiseAND(-depth).cast("double")).cast("int")


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Digests of aligned blocks of 1, 2, 4 ... turns: ``conv``, ``i`` (place among blocks), ``block``."""
    out = [turns.select("conv", F.col("pos").alias("i"), F.col("token").alias("block"))]
    for _ in range(1, levels):
        half = F.col("i") % 2
        pairs = out[-1].groupBy("conv", F.expr("i div 2").alias("i")).agg(
            F.max(F.when(half == 0, F.col("block"))).alias("left"), F.max(F.when(half == 1, F.col("block"))).alias("right"))
        out.append(stored(pairs.where(F.col("right").isNotNull()).select(
            "conv", "i", digest(F.concat("left", "right")).alias("block")), "trie-blocks"))
    return out


def _names(blocks: list[DataFrame]) -> DataFrame:
    """``conv``, ``depth``, ``name`` of every prefix: the cut prefixes of the longest blocks first."""
    known = None
    for k in reversed(range(len(blocks))):
        cut = blocks[k].where(F.col("i") % 2 == 0).select(
            "conv", ((F.col("i") + 1) * (1 << k)).alias("depth"), (F.col("i") * (1 << k)).alias("above"), "block")
        first = cut.where("above = 0").select("conv", "depth", digest(F.concat(F.lit(ROOT), "block")).alias("name"))
        if known is not None:
            upper = known.select("conv", F.col("depth").alias("above"), F.col("name").alias("upper"))
            first = first.unionByName(cut.where("above > 0").join(upper, ["conv", "above"]).select(
                "conv", "depth", digest(F.concat("upper", "block")).alias("name")))
        first = stored(first, "trie-names")
        known = first if known is None else known.unionByName(first)
    return known


def _graft(nodes: DataFrame, levels: int, totals: list[str]) -> DataFrame:
    """``name`` and the sums of ``totals`` over each node's subtree.

    ``nodes``: ``name``, ``low`` (number of the depth's lowest set bit; ``levels`` for the root),
    ``ups`` (ancestors 1, 2, 4 ... depths above, up to that bit) and the totals of the node alone.
    """
    both = [F.sum(t).alias(t) for t in totals]
    same = [F.max("low").alias("low"), F.max("ups").alias("ups")]

    def added(base: DataFrame, more: DataFrame) -> DataFrame:
        more = more.select("name", F.lit(None).cast("int").alias("low"), F.lit(None).cast("array<binary>").alias("ups"), *totals)
        return base.unionByName(more).groupBy("name").agg(*same, *both).where(F.col("low").isNotNull())

    now, up = nodes, []
    for k in range(levels):  # up: the lower halves of blocks of 2^(k+1) depths join their upper nodes
        up.append(now.where(F.col("low") == k))
        lower = up[-1].select(F.col("ups")[k].alias("name"), *totals)
        now = stored(added(now.where(F.col("low") > k), lower), "trie-up")
    done = now  # the root
    for k in reversed(range(levels)):  # down: what lies behind a block's end
        beyond = done.where((F.col("low") > k) & (F.col("low") < levels)).select(F.col("ups")[k].alias("name"), *totals)
        done = done.unionByName(stored(added(up[k], beyond), "trie-down"))
    return done.select("name", *totals)


def _end_digests(ends: DataFrame) -> DataFrame:
    """``name`` and the SHA-256 of its conversations' ids, ascending, joined by commas.

    The ids are range-sorted by (name, id). Names that lie inside a range are hashed as
    they stream past; those at its ends may go on in the next one, so their ids leave as joined pieces
    that are hashed in order, one piece after the other, in a second, much smaller step.
    """
    schema = T.StructType([T.StructField("name", T.BinaryType()), T.StructField("first", T.LongType()),
                           T.StructField("ids", T.StringType()), T.StructField("sha", T.StringType())])

    def joined(ids: list[int]) -> str:
        return ",".join(map(str, ids))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, piece = None, [], True  # piece: the name's ids leave unhashed
        for b in batches:
            out = []
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n != name:
                    if held:
                        out.append((name, held, piece))
                    name, held, piece = n, [], name is None
                held.append(c)
                if len(held) == PIECE_IDS:
                    out.append((name, held, True))
                    held, piece = [], True
            yield batch(out)
        if held:
            yield batch([(name, held, True)])

    def batch(out: list[tuple[bytes, list[int], bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([n for n, _, _ in out], pa.binary()), pa.array([ids[0] for _, ids, _ in out], pa.int64()),
             pa.array([joined(ids) if piece else None for _, ids, piece in out], pa.string()),
             pa.array([None if piece else hashlib.sha256(joined(ids).encode()).hexdigest() for _, ids, piece in out], pa.string())],
            names=schema.names)

    parts = stored(ends.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInArrow(cut, schema), "trie-ends")
    out = T.StructType([schema["name"], schema["sha"]])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha = None, None
        for b in batches:
            names, shas = [], []
            for n, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if n != name:
                    if name is not None:
                        names.append(name)
                        shas.append(sha.hexdigest())
                    name, sha = n, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(shas, pa.string())], names=out.names)
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=out.names)

    pieces = parts.where("sha IS NULL").select("name", "first", "ids").repartition("name").sortWithinPartitions("name", "first")
    return parts.where("sha IS NOT NULL").select("name", "sha").unionByName(pieces.mapInArrow(join, out))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the given sequences, the empty one included.

    ``turns``: ``conv``, ``pos`` (0, 1 ... without gaps), ``token`` (binary), ``words``, ``last`` (whether it is
    the sequence's last); ``convs``: every ``conv``, with its number of ``turns`` (0 where it has none).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's ``conv_id``; root:
    null), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in the subtree), ``saved_tokens``
    (summed over the subtree: a node's members but one times the words of its last turn) and
    ``ends_sha256`` (of the ids of members that end here, ascending, joined by commas).
    No conversation, no node.
    """
    turns = stored(turns, "trie-turns")
    deepest = turns.agg(F.max("pos")).first()[0]
    levels = 0 if deepest is None else (deepest + 1).bit_length()
    root_ends = convs.where("turns = 0").select(F.lit(ROOT).alias("name"), "conv")
    members = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
    root = members.where("n_convs > 0").select(
        F.lit(ROOT).alias("name"), "conv", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    if levels:
        names = _names(_blocks(turns, levels))
        known = stored(names.join(turns.select("conv", (F.col("pos") + 1).alias("depth"), "words", "last"), ["conv", "depth"]), "trie-prefixes")
        nodes = known.groupBy("name").agg(F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
                                          F.max("words").alias("words"))
        ends = known.where("last").select("name", "conv").unionByName(root_ends)
        # a node's ancestors 1, 2, 4 ... depths above it, as its smallest member's prefixes: at most one per bit
        nodes = stored(nodes.withColumn("low", _low_bit(F.col("depth"))), "trie-nodes")
        steps = nodes.select("name", "conv", "depth", F.explode(F.sequence(F.lit(0), F.col("low"))).alias("k")).withColumn(
            "above", (F.col("depth") - F.expr("shiftleft(1L, k)")))
        upper = known.select("conv", F.col("depth").alias("above"), F.col("name").alias("up"))
        ups = steps.join(upper, ["conv", "above"], "left").groupBy("name").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("up", F.lit(ROOT)).alias("up")))), lambda x: x["up"]).alias("ups"))
        nodes = nodes.join(ups, "name").select("name", "conv", "depth", "n_convs", "words", "low", "ups").unionByName(
            root.select("*", F.lit(levels).alias("low"), F.lit(None).cast("array<binary>").alias("ups")))
    else:
        ends = root_ends
        nodes = root.select("*", F.lit(0).alias("low"), F.lit(None).cast("array<binary>").alias("ups"))
    nodes = stored(nodes, "trie-linked")
    children = nodes.where(F.col("ups").isNotNull()).groupBy(F.col("ups")[0].alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-counted")
    own = nodes.select("name", "low", "ups", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = _graft(own, levels, ["n_leaves", "saved_tokens"])
    told = nodes.join(totals, "name").join(_end_digests(ends), "name", "left").select(
        "conv", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.col("ups")[0].alias("parent"))
    told = stored(told, "trie-told")
    parents = stored(nodes.where("n_children > 0").select("name", F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("weight")), "trie-parents")
    below = join_by_key(told.where("parent IS NOT NULL"), parents.withColumnRenamed("name", "parent"), "parent", "weight")
    top = told.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(top).select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, *, every: int = 20, most: int = 4, **columns) -> DataFrame:
    """The prefix trie of conversations rebuilt by ``rebuilt_turns``; see ``prefix_trie`` for its rows.

    Null turns come first, null roles and texts count as empty, rows without conversation id
    are left out, equal turn numbers stand in the order of their role's and text's digest, repeated rows are
    turns of their own; an empty table gives no node; columns beyond the four named are not read.
    """
    turns, convs = rebuilt_turns(placed_turns(conversations, **columns), every, most)
    return prefix_trie(turns, convs)
