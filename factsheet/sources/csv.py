"""CSV admission (A1-A7): header check, scan, malformed rows, shape, size, native types.

The load chain runs header -> parse -> shape -> size and the first failure
wins. Only header lines and one-row aggregates reach the driver.

Quotes are followed as a parser does, in parallel: every line is a function from "starts
inside a quoted field or not" to "ends inside or not"; functions of lines compose to
functions of file blocks, those to the state at each block's start, and that gives the state
at each line. A quote opens a field only at the field's start; elsewhere it is a character.
"""

from __future__ import annotations

import csv as _csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from factsheet import thresholds as T
from factsheet.errors import ProfileRefused
from factsheet.functions.scalar import NUMBER_RE, WS_CLASS, col_, strip
from factsheet.session import local_rows, store

OVERFLOW = "_overflow"
INT_RE = r"^[+-]?[0-9]+$"
PANDAS_BOOL_TOKENS = ("True", "TRUE", "true", "False", "FALSE", "false")


# Whole and decimal numbers without sign or space, and what neither a number nor a truth value can hold.
PLAIN_INT, PLAIN_REAL = r"^[0-9]{1,18}$", r"^[0-9]{1,18}\.[0-9]{1,18}$"
NO_NUMBER = f"[^0-9.+\\-eEiInNfFtTyYrRuUaAlLsS{WS_CLASS}]|[0-9][+-]"
BLANK_LINE = r"^[ \t]*\r?$"


def overflow_name(names: list[str]) -> str:
    """A name for the field that catches what a row has beyond its header: no column has it in any case."""
    taken = {n.lower() for n in names}
    out = OVERFLOW
    while out.lower() in taken:
        out += "_"
    return out


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their file and block, and a number that orders the lines of a block; a byte order mark is removed."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    marked = (F.col("block") == 0) & F.startswith("value", F.lit("\ufeff"))
    return lines.withColumn("value", F.when(marked, F.substr("value", F.lit(2))).otherwise(F.col("value")))


def quote_steps(line: Column) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted field when it starts outside one, and when it starts inside.

    Pieces between commas: inside, a piece ends the field if a quote is left after doubled quotes are
    taken out; outside, only a piece that begins with a quote opens a field.
    """
    def closes(piece: Column) -> Column:
        return F.contains(F.replace(piece, F.lit('""'), F.lit("")), F.lit('"'))

    def step(inside: Column, piece: Column) -> Column:
        opened = F.startswith(piece, F.lit('"')) & ~closes(F.substr(piece, F.lit(2)))
        return F.when(inside, ~closes(piece)).otherwise(opened)

    pieces, has = F.split(line, ","), F.contains(line, F.lit('"'))
    return tuple(F.when(has, F.aggregate(pieces, F.lit(start), step)).otherwise(F.lit(start)) for start in (False, True))


def _xor(a: Column, b: Column) -> Column:
    return a != b


def _state_before(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Prefix scan of two-state functions: ``flipped`` and ``fixed`` such that the state before a row is
    ``coalesce(fixed, state at the group's start) xor flipped``. ``own`` is what a constant row fixes, seen from the group's start."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swaps, constant = F.col("from_out") & ~F.col("from_in"), F.col("from_out") == F.col("from_in")
    rows = rows.withColumn("flipped", F.coalesce(F.sum(swaps.cast("int")).over(before), F.lit(0)) % 2 == 1)
    rows = rows.withColumn("own", F.when(constant, _xor(F.col("from_out"), F.col("flipped"))))
    return rows.withColumn("fixed", F.last("own", ignorenulls=True).over(before))


def _composed(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """One function per group of ``_state_before`` rows."""
    swaps = F.col("from_out") & ~F.col("from_in")
    totals = rows.groupBy(*group).agg((F.sum(swaps.cast("int")) % 2 == 1).alias("flips"), F.max_by(
        "own", F.when(F.col("own").isNotNull(), F.col(order))).alias("fixes"))
    return totals.select(*group, *[_xor(F.coalesce("fixes", F.lit(start)), F.col("flips")).alias(name)
                                   for name, start in (("from_out", False), ("from_in", True))])


def quote_blocks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``inside`` at the start of every file block (that has a quote), and the function of each whole file.

    Only lines with a quote are shuffled, without their text.
    """
    steps = quote_steps(F.col("value"))
    quoted = lines.where(F.contains("value", F.lit('"'))).select(
        "file", "block", "line", *[c.alias(n) for c, n in zip(steps, ("from_out", "from_in"))])
    blocks = _composed(_state_before(quoted, ["file", "block"], "line"), ["file", "block"], "line")
    scanned = _state_before(blocks, ["file"], "block")
    starts = scanned.select("file", "block", _xor(F.coalesce("fixed", F.lit(False)), F.col("flipped")).alias("inside"))
    return starts, _composed(scanned, ["file"], "block")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block``, ``line`` (of the first line) and ``record`` of every CSV record; fields may span lines and blocks.

    Blank lines between records are left out. Records on one line stay where they are after the scan;
    the lines of longer ones meet by the record's number. A file's last field must be closed (``text_faults``).
    """
    lines = file_lines(spark, path)
    steps = [c.alias(n) for c, n in zip(quote_steps(F.col("value")), ("from_out", "from_in"))]
    # a table of its own: line numbers stay as they are whatever happens to the executors
    stepped = store(lines.select("*", *steps), "csv-lines")
    blocks = _composed(_state_before(stepped, ["file", "block"], "line"), ["file", "block"], "line")
    starts = _state_before(blocks, ["file"], "block").select(
        "file", "block", _xor(F.coalesce("fixed", F.lit(False)), F.col("flipped")).alias("inside"))
    state = _xor(F.coalesce("fixed", "inside"), F.col("flipped"))
    told = _state_before(stepped, ["file", "block"], "line").join(starts, ["file", "block"]).select(
        "file", "block", "line", "value", state.alias("goes_on"),
        F.when(state, F.col("from_in")).otherwise(F.col("from_out")).alias("open"))
    whole = told.where(~F.col("goes_on") & ~F.col("open")).select("file", "block", "line", F.col("value").alias("record"))
    # the number of a record: beginnings of open records up to it, counted per block first
    parts = store(told.where(F.col("goes_on") | F.col("open")).withColumn(
        "begins", (~F.col("goes_on")).cast("int")), "csv-open-lines")
    counts = parts.groupBy("file", "block").agg(F.sum("begins").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("n", F.sum("begins").over(upto)).join(offsets, ["file", "block"]).withColumn(
        "number", F.col("n") + F.col("before"))
    joined = numbered.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("x")).select(
        "file", F.col("x")[0]["block"].alias("block"), F.col("x")[0]["line"].alias("line"),
        F.array_join(F.transform("x", lambda r: r["value"]), "\n").alias("record"))
    found = whole.unionByName(joined).where(~F.col("record").rlike(BLANK_LINE))
    return found.withColumn("record", F.regexp_replace("record", "\r$", ""))


def _first_lines(lines: DataFrame, text: str) -> DataFrame:
    """The first row of every file that is no blank line."""
    return lines.where(~F.col(text).rlike(BLANK_LINE)).groupBy("file").agg(
        F.min_by(F.struct("block", "line", F.col(text).alias("text")), F.struct("block", "line")).alias("first")).select("file", "first.*")


def _split_header(headers: DataFrame) -> list[str] | None:
    found = [r["text"] for r in headers.select(F.regexp_replace("text", "\r$", "").alias("text")).distinct().orderBy("text").limit(2).collect()]
    if len(found) > 1:
        raise ProfileRefused("UNPARSEABLE_CSV", "The files start with different headers.")
    return next(_csv.reader(io.StringIO(found[0])), []) if found else None


def read_header(spark: SparkSession, path: str) -> list[str] | None:
    """A3: the header that all files share, split as CSV; None where there is no line at all.

    A file's header is its first line that is not blank, as the parser has it.
    """
    return _split_header(_first_lines(file_lines(spark, path), "value"))


def text_faults(spark: SparkSession, path: str, multiline: bool = False) -> dict:
    """A5 on raw bytes: lines that are not UTF-8, and quoted fields left open.

    Without ``multiline`` a field must end on its line; with it, before the end of its file.
    """
    lines = file_lines(spark, path)
    bad = F.count_if(~F.is_valid_utf8("value"))
    if not multiline:
        row = lines.agg(bad.alias("bad"), F.count_if(quote_steps(F.col("value"))[0]).alias("open")).first()
        return {"not_utf8": row["bad"] or 0, "open_quotes": row["open"] or 0}
    _, files = quote_blocks(lines)
    left = files.agg(F.count_if("from_out").alias("open")).first()["open"]
    return {"not_utf8": lines.agg(bad.alias("bad")).first()["bad"] or 0, "open_quotes": left or 0}


def duplicate_header_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """A3: ``name``, ``n`` and ``first`` position of names that appear more than once."""
    schema = ST.StructType([ST.StructField("pos", ST.IntegerType()), ST.StructField("name", ST.StringType())])
    df = local_rows(spark, [{"pos": i, "name": n} for i, n in enumerate(names)], schema)
    return (df.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
            .where("n > 1").orderBy("first"))


def duplicate_headers(spark: SparkSession, names: list[str]) -> list[str]:
    """A3: names appearing more than once, each named once, in order of first appearance."""
    return [r["name"] for r in duplicate_header_table(spark, names).collect()]


_CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _text_schema(names: list[str]) -> ST.StructType:
    return ST.StructType([ST.StructField(n, ST.StringType()) for n in [*names, overflow_name(names)]])


def _without_null_tokens(names: list[str]) -> list[Column]:
    return [*[F.when(~col_(n).isin(*T.NA_TOKENS), col_(n)).alias(n) for n in names], col_(overflow_name(names))]


def _behind_headers(found: DataFrame) -> DataFrame:
    first = _first_lines(found, "record").select("file", "block", "line")
    return found.join(first, ["file", "block", "line"], "left_anti")


def parse_records(found: DataFrame, names: list[str]) -> DataFrame:
    """The fields of ``records`` as text, as ``scan`` gives them."""
    fields = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in [*names, overflow_name(names)])
    return found.select(F.from_csv("record", fields, _CSV_OPTIONS).alias("_fields")).select("_fields.*").select(*_without_null_tokens(names))


def scan(spark: SparkSession, path: str, names: list[str], multiline: bool = False, header: bool = True) -> DataFrame:
    """A1: all columns as text, one overflow field to catch rows longer than the header,
    short rows padded with nulls, the default null tokens read as null, blank lines skipped."""
    if multiline:
        found = store(records(spark, path), "csv-records")
        return parse_records(_behind_headers(found) if header else found, names)
    df = (spark.read.option("header", header).option("encoding", "UTF-8").options(**_CSV_OPTIONS)
          .option("enforceSchema", True).schema(_text_schema(names)).csv(path))
    return df.select(*_without_null_tokens(names))


def malformed_count(df: DataFrame) -> int:
    """A5: rows with more fields than the header (short rows are accepted); the last column is the overflow."""
    return df.where(col_(df.columns[-1]).isNotNull()).count()


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total bytes of the input files, from file metadata (contents not read)."""
    files = spark.read.format("binaryFile").load(path).select("length")
    return int(files.agg(F.coalesce(F.sum("length"), F.lit(0))).collect()[0][0])


def shape_refusal(n_columns: int, has_rows: bool, max_cols: int | None = None) -> str | None:
    """A4 in fixed order: no columns, no rows, one column, too many columns."""
    if n_columns == 0:
        return "EMPTY_DATASET"
    if not has_rows:
        return "HEADER_ONLY"
    if n_columns == 1:
        return "SINGLE_COLUMN"
    if max_cols is not None and n_columns > max_cols:
        return "TOO_MANY_COLUMNS"
    return None


def shape_status(df: DataFrame, max_cols: int | None = None) -> DataFrame:
    """A4 as a one-row table: column count, row count, refusal code or 'ok'."""
    n_cols = len(df.columns)
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    code = F.when(F.lit(n_cols) == 0, "EMPTY_DATASET").when(F.col("n_rows") == 0, "HEADER_ONLY") \
        .when(F.lit(n_cols) == 1, "SINGLE_COLUMN").when(F.lit(max_cols is not None and n_cols > max_cols), "TOO_MANY_COLUMNS") \
        .otherwise("ok")
    return counted.select(F.lit(n_cols).alias("n_columns"), "n_rows", code.alias("status"))


#: What a value of a column can be; a column is the union of its values' kinds.
INT64, UINT64, HUGE, NEGATIVE, REAL, BOOL, TEXT, GAP = (1 << k for k in range(8))


def value_kinds(v: Column) -> Column:
    """A2: the kinds of one text as a CSV reader sees it. Joined by ``bit_or``, they are a lattice:
    partial results merge in any order, and a column's type is a function of the union."""
    # most values tell their kind as they are written; only the others are stripped and tried
    plain = (F.when(v.rlike(PLAIN_INT), INT64).when(v.rlike(PLAIN_REAL), REAL).when(v.rlike(NO_NUMBER), TEXT))
    s = strip(v)
    whole = s.rlike(INT_RE)
    size = F.when(s.try_cast("bigint").isNotNull(), INT64).when(
        s.try_cast("decimal(38,0)").between(F.lit("9223372036854775808").cast("decimal(38,0)"),
                                            F.lit("18446744073709551615").cast("decimal(38,0)")), UINT64).otherwise(HUGE)
    negative = F.when(F.startswith(s, F.lit("-")), NEGATIVE).otherwise(0)
    return F.when(v.isNull(), GAP).when(plain.isNotNull(), plain).when(whole, size.bitwiseOR(negative)).when(s.rlike(NUMBER_RE), REAL).when(
        v.isin(*PANDAS_BOOL_TOKENS), BOOL).otherwise(TEXT)


def column_type(kinds: Column) -> Column:
    """A2: the type of a column whose values have these kinds together.

    Whole numbers are int64; with gaps float64; beyond its range uint64, if none is negative and
    none missing, else text; any decimal number makes them float64. Truth values with gaps are text.
    """
    has = lambda bits: kinds.bitwiseAND(bits) != 0
    return (F.when(~has(0xFF ^ GAP), "float64").when(has(TEXT), "object")
            .when(has(BOOL), F.when(has(0xFF ^ BOOL), "object").otherwise("bool"))
            .when(has(REAL), "float64").when(has(HUGE), "object")
            .when(has(UINT64), F.when(has(NEGATIVE | GAP), "object").otherwise("uint64"))
            .when(has(GAP), "float64").otherwise("int64"))


def _native_kinds(df: DataFrame) -> DataFrame:
    """Per position of a column: its values' kinds together, and its type. The plan's size doesn't
    depend on the number of columns; kinds combine before the one shuffle."""
    kinds = df.select(F.posexplode(F.array(*[col_(n) for n in df.columns])).alias("pos", "v")).groupBy("pos").agg(
        F.bit_or(value_kinds(F.col("v"))).alias("kinds"))
    return kinds.select("pos", "kinds", column_type(F.col("kinds")).alias("native_type"))


def native_types(df: DataFrame) -> DataFrame:
    """A2: the type a CSV reader would give each text column, by whole-column parse (``column_type``).
    A table without rows gives no types."""
    names = F.array(*[F.lit(n) for n in df.columns])
    return _native_kinds(df).select(F.get(names, F.col("pos")).alias("column_name"), "native_type")


CASTS = {"int64": "bigint", "uint64": "decimal(20,0)", "float64": "double", "bool": "boolean"}


def load_csv(spark: SparkSession, path: str, max_bytes: int | None = None, max_cols: int | None = None,
             multiline: bool = False) -> DataFrame:
    """Header -> parse -> shape -> size; raises ProfileRefused with the first failure.

    Columns come back with their native types (A2): int64 as bigint, uint64 as decimal(20,0), float64 as
    double, bool as boolean, the rest as text. ``multiline`` allows quoted fields
    that span lines; without it a line that leaves a quote open is refused.
    """
    if multiline and text_faults(spark, path, True)["open_quotes"]:
        raise ProfileRefused("UNPARSEABLE_CSV", "A quoted field is not closed.")
    found = store(records(spark, path), "csv-records") if multiline else None
    names = _split_header(_first_lines(found, "record")) if multiline else read_header(spark, path)
    if names is None:
        raise ProfileRefused("EMPTY_DATASET", "No line was found in the input.")
    dups = duplicate_headers(spark, names)
    if dups:
        raise ProfileRefused("DUPLICATE_COLUMNS", "Some column names repeat.", {"columns": ",".join(dups)})
    faults = text_faults(spark, path, multiline)
    if faults["not_utf8"]:
        raise ProfileRefused("UNPARSEABLE_CSV", "The input holds bytes that are not UTF-8.")
    if faults["open_quotes"]:
        raise ProfileRefused("UNPARSEABLE_CSV", "A quoted field is not closed" + (
            "." if multiline else " on its line; pass multiline=True where fields span lines."))
    df = parse_records(_behind_headers(found), names) if multiline else scan(spark, path, names)
    kinds = {r["pos"]: r for r in _native_kinds(df).collect()}  # one row per column; the last is the overflow
    if kinds and kinds[len(names)]["kinds"] != GAP:
        raise ProfileRefused("UNPARSEABLE_CSV", "Some rows have more fields than the header.")
    code = shape_refusal(len(names), bool(kinds), max_cols)
    if code:
        raise ProfileRefused(code, f"The shape of the input is not accepted ({code}).")
    if max_bytes is not None and input_bytes(spark, path) > max_bytes:
        raise ProfileRefused("FILE_TOO_LARGE", "The input is larger than the size limit.")
    types = [kinds[i]["native_type"] for i in range(len(names))]
    typed = df.select(*[
        ((F.lower(col_(n)) == "true") if t == "bool" else strip(col_(n)).cast(CASTS[t]) if t in CASTS else col_(n)).alias(n)
        for n, t in zip(names, types)])
    # parsed and cast once; who reads it picks its columns
    return store(typed.toDF(*(f"c{i}" for i in range(len(names)))), "csv-typed").toDF(*names)
