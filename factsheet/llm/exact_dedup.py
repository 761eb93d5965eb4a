"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so, each distinct chunk gets an identifier
that is verified to stand for one content only, and texts are compared by their
ordered lists of identifiers. A chunk's content moves through one shuffle, once per
task and distinct content; after that only identifiers move, however long the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored, with_row, without_rows

CHUNK_LEAST, CHUNK_MOST = 1024, 8192
#: Marks after which a chunk may end: visible ASCII characters whose code is 1 modulo 4.
MARKS = "".join(f"\\x{c:02x}" for c in range(0x21, 0x7F) if c % 4 == 1)


def chunk_pattern(least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> str:
    """From ``least`` characters on, a chunk ends after three marks in a row, or at ``most``."""
    return rf"(?s).{{{least},{most}}}?(?<=[{MARKS}]{{3}})|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _identifier(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def chunk_recipes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64,
                  least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> DataFrame:
    """One row per input row: ``doc_id``, ``_row``, ``text_sha256``, ``recipe``, ``variants``.

    ``recipe`` lists the 64-bit identifiers of the text's chunks in order. Verification
    compares contents: an identifier that two different chunks share is found by counting
    distinct contents per identifier, and ``variants`` then tells those contents apart
    (null where no chunk of the text has such an identifier, which is the usual case).
    ``id_bits`` narrows the identifiers, so that tests meet shared ones.
    """
    pieces = F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0))
    texts = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select(
        "doc_id", "_row", normalised(F.col("text")).alias("norm")).select(
        "doc_id", "_row", "norm", pieces.alias("chunks"))
    recipes = stored(texts.select(
        "doc_id", "_row", F.sha2(F.col("norm"), 256).alias("text_sha256"),
        F.transform("chunks", lambda c: _identifier(c, id_bits)).alias("recipe")), "recipes")
    places = texts.select("_row", F.posexplode("chunks").alias("pos", "chunk")).withColumn(
        "h", _identifier(F.col("chunk"), id_bits))
    contents = places.select("h", "chunk").distinct()
    shared = stored(contents.groupBy("h").count().where("count > 1").select("h"), "shared")
    if shared.isEmpty():
        return recipes.withColumn("variants", F.lit(None).cast("array<struct<pos:int,variant:int>>"))
    variant = F.dense_rank().over(Window.partitionBy("h").orderBy("chunk"))
    told = contents.join(shared, "h", "left_semi").select("h", "chunk", variant.alias("variant"))
    variants = places.join(told, ["h", "chunk"]).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("pos", "variant"))).alias("variants"))
    return recipes.join(variants, "_row", "left")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **chunking) -> DataFrame:
    """Group texts that are equal after each run of white space becomes one space.

    One row per input row: ``doc_id``, ``keep_id`` (smallest id of the group),
    ``group_size``, ``kept``, ``text_sha256`` (of the normalised text) and ``_row``
    (number of the row in the scan of ``docs``, which must be a stored table or
    otherwise come out in the same order each time).

    Null text counts as empty, so null and empty texts are one group. Of rows that
    repeat both id and text the first stays. Null ids stand behind all others: such a
    row stays only where its group has no id, and ``keep_id`` is then null. An empty
    table gives an empty result; columns beyond the two named are not read.

    A group of any size is one key: counts combine before the shuffle, and the join
    that hands the group's result to its rows is an equi-join whose large partitions
    Spark may split.
    """
    rows = chunk_recipes(docs, id_col=id_col, text_col=text_col, **chunking)
    key = ["recipe", "variants"]
    # variants is null or a list; an equi-join needs it non-null
    rows = rows.withColumn("variants", F.coalesce("variants", F.array().cast(rows.schema["variants"].dataType)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    joined = rows.join(groups, key)
    return joined.select(
        "doc_id", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("first.row")).alias("kept"), "text_sha256", "_row")


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **chunking) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``exact_duplicates``)."""
    found = exact_duplicates(docs, id_col=id_col, text_col=text_col, **chunking)
    return without_rows(docs, found.where(~F.col("kept")))
