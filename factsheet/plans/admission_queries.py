"""Queries for CSV admission and source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factsheet import thresholds as T
from factsheet.sources import csv as C
from factsheet.plans import inputs as I
from factsheet.plans.oracle import NUMBER_RE, SCHEMAS, lit, profile_sql
from factsheet.plans.profile import profile_table
from factsheet.session import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_SHAPE_TABLES = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "labels"]
_NATIVE_TABLES = ["orders", "customer", "part", "nation", "events"]


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@q("csv_scan")
def csv_scan(spark, sf):
    """A1/A7 orders exported as CSV by Spark to the shared folder, then admitted and scanned as text."""
    path = scratch_path(spark, "orders-csv")
    I.table(spark, sf, "orders").write.option("header", True).csv(path)
    df = C.load_csv(spark, f"{path}/*.csv")
    return df.select("o_orderkey", "o_orderstatus", "o_totalprice")


@q("csv_profile")
def csv_profile(spark, sf):
    """A1-A7, H20 orders with quoted text, written as CSV, admitted with native types and profiled."""
    path = scratch_path(spark, "orders-quoted-csv")
    (I.orders_text(spark, sf).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    p = profile_table(C.load_csv(spark, f"{path}/*.csv"), "o_orderstatus", duplicates=False)
    c = F.col
    return p.columns.select(
        c("name").alias("column_name"), "inferred_type", "missing_count", "unique_count",
        F.round("top_value_pct", 6).alias("top_value_pct"), F.round("parse_rate", 6).alias("parse_rate"),
        F.round("target_association", 6).alias("target_association"), "association_method")


@q("malformed_rows")
def malformed_rows(spark, sf):
    """A5 orders written as lines in which urgent orders have a field too many: rows the scan finds malformed."""
    path = scratch_path(spark, "orders-ragged-csv")
    c = F.col
    key, more = c("o_orderkey").cast("string"), F.when(c("o_orderpriority") == "1-URGENT", F.lit("more"))
    I.table(spark, sf, "orders").select(F.concat_ws(",", key, "o_orderstatus", "o_orderpriority", more)).write.text(path)
    df = C.scan(spark, path, ["o_orderkey", "o_orderstatus", "o_orderpriority"], header=False)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(df.columns[-1]).alias("malformed"))


#: Comments as people's tools write them into a CSV field, by the order's key modulo 6.
_SHAPES = ("'plain ' || o_orderpriority",
           "'5\" pipe ' || o_orderpriority",  # a quote inside an unquoted field
           "'\"two\nlines, ' || o_orderpriority || '\"'",
           "'\"said \"\"' || o_orderpriority || '\"\", then\n\n\"\"left\"\"\"'",  # doubled quotes, an empty line inside
           "''", "'n/a'")
_SHAPE_VALUES = ("'plain ' || o_orderpriority", "'5\" pipe ' || o_orderpriority", "'two' || chr(10) || 'lines, ' || o_orderpriority",
                 "'said \"' || o_orderpriority || '\", then' || chr(10) || chr(10) || '\"left\"'", "NULL", "NULL")


@q("csv_records")
def csv_records(spark, sf):
    """A1/A5 orders written as raw CSV text with quotes inside fields, fields over several lines and blank lines, read back in parallel."""
    path = scratch_path(spark, "shapes-csv")
    shape = "CASE o_orderkey % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_SHAPES)) + " END"
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.expr(shape), F.col("o_orderstatus"))
    # every seventh record has a blank line behind it
    I.table(spark, sf, "orders").select(F.concat(line, F.when(F.col("o_orderkey") % 7 == 0, "\n  ").otherwise(""))).write.text(path)
    df = C.scan(spark, path, ["o_orderkey", "note", "o_orderstatus"], multiline=True, header=False)
    return df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "note", "o_orderstatus")


ORACLE["csv_records"] = ("SELECT o_orderkey, CASE o_orderkey % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_SHAPE_VALUES))
                         + " END AS note, o_orderstatus FROM orders")


@q("duplicate_headers")
def duplicate_headers(spark, sf):
    """A3 a header of the nations' region names in the order of the nations: names that repeat, in order."""
    path = scratch_path(spark, "header-csv")
    n, r = I.table(spark, sf, "nation"), I.table(spark, sf, "region")
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy().agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "r_name"))), lambda x: x["r_name"]), ",").alias("h"))
    named.coalesce(1).write.text(path)
    names = C.read_header(spark, path)
    return C.duplicate_header_table(spark, names).select(F.col("name").alias("column_name"), F.col("n").cast("int").alias("times"))


@q("native_types")
def native_types(spark, sf):
    """A2 CSV-reader types of every column of five tables written as text."""
    out = None
    for t in _NATIVE_TABLES:
        df = I.table(spark, sf, t)
        text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        r = C.native_types(text).select(F.lit(t).alias("table_name"), "column_name", "native_type")
        out = r if out is None else out.unionByName(r)
    return out


#: Text columns made from an order's key ``k``: long integers, gaps, signs and mixtures.
_WIDE = {
    "whole": "k::VARCHAR", "signed": "'-' || k::VARCHAR", "spaced": "'  +' || k::VARCHAR || ' '",
    "gaps": "CASE WHEN k % 5 > 0 THEN k::VARCHAR END", "empty": "NULL::VARCHAR",
    "twenty": "CASE WHEN k % 3 = 0 THEN '18446744073709551615' ELSE k::VARCHAR END",
    "twenty_signed": "CASE WHEN k % 3 = 0 THEN '18446744073709551615' WHEN k % 3 = 1 THEN '-1' ELSE k::VARCHAR END",
    "twenty_gaps": "CASE WHEN k % 3 = 0 THEN '9223372036854775808' WHEN k % 3 = 1 THEN NULL ELSE k::VARCHAR END",
    "over_twenty": "CASE WHEN k % 3 = 0 THEN '18446744073709551616' ELSE k::VARCHAR END",
    "twenty_three": "'99999999999999999' || (100000 + k % 800000)::VARCHAR", "least": "CASE WHEN k % 2 = 0 THEN '-9223372036854775808' ELSE k::VARCHAR END",
    "below_least": "CASE WHEN k % 2 = 0 THEN '-9223372036854775809' ELSE k::VARCHAR END",
    "huge_real": "CASE WHEN k % 2 = 0 THEN '99999999999999999999999' ELSE k::VARCHAR || '.5' END",
    "truth": "CASE WHEN k % 2 = 0 THEN 'True' ELSE 'false' END", "truth_gaps": "CASE WHEN k % 2 = 0 THEN 'TRUE' END",
    "truth_number": "CASE WHEN k % 2 = 0 THEN 'True' ELSE '1' END", "word": "CASE WHEN k % 7 = 0 THEN 'x' ELSE k::VARCHAR END",
}


@q("native_types_wide")
def native_types_wide(spark, sf):
    """A2 types of long integer, signed, missing and mixed text columns made from every order's key."""
    text = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select(
        *[F.expr(v.replace("VARCHAR", "STRING")).alias(n) for n, v in _WIDE.items()])
    return C.native_types(text)


def _wide_sql() -> str:
    """The reader's rule in words: whole numbers that all fit, then what gaps and signs make of them, then the rest."""
    v, out = "trim(v)", []
    made = ", ".join(f"{e} AS {n}" for n, e in _WIDE.items())
    for n in _WIDE:
        out.append(f"SELECT '{n}' AS column_name, {n} AS v FROM made")
    return f"""WITH made AS (SELECT {made} FROM (SELECT o_orderkey AS k FROM orders)), cells AS ({' UNION ALL '.join(out)}),
facts AS (SELECT column_name, count(*) AS n, count(v) AS filled, count(*) FILTER (WHERE regexp_matches({v}, '^[+-]?[0-9]+$')) AS wholes,
  count(*) FILTER (WHERE regexp_matches({v}, {lit(NUMBER_RE)})) AS numbers,
  count(*) FILTER (WHERE v IN ('True','TRUE','true','False','FALSE','false')) AS truths,
  max(CASE WHEN regexp_matches({v}, '^[+-]?[0-9]+$') THEN TRY_CAST({v} AS HUGEINT) END) AS most,
  min(CASE WHEN regexp_matches({v}, '^[+-]?[0-9]+$') THEN TRY_CAST({v} AS HUGEINT) END) AS least FROM cells GROUP BY column_name)
SELECT column_name, CASE WHEN filled = 0 THEN 'float64' WHEN truths = n THEN 'bool' WHEN numbers < filled THEN 'object'
  WHEN wholes < filled THEN 'float64' WHEN least < -9223372036854775808 OR most > 18446744073709551615 THEN 'object'
  WHEN most <= 9223372036854775807 THEN CASE WHEN filled < n THEN 'float64' ELSE 'int64' END
  WHEN least < 0 OR filled < n THEN 'object' ELSE 'uint64' END AS native_type FROM facts"""


ORACLE["native_types_wide"] = _wide_sql()


def _native_sql(t: str) -> str:
    parts = []
    for c, _s in SCHEMAS[t]:
        v = f"trim(CAST({c} AS VARCHAR))"
        parts.append(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, CASE WHEN COUNT({c}) = 0 THEN 'float64' "
            f"WHEN COUNT(CASE WHEN regexp_matches({v}, '^[+-]?[0-9]+$') THEN TRY_CAST({v} AS BIGINT) END) = COUNT({c}) "
            f"AND COUNT({c}) = COUNT(*) THEN 'int64' "
            f"WHEN COUNT(CASE WHEN regexp_matches({v}, {lit(NUMBER_RE)}) THEN 1 END) = COUNT({c}) THEN 'float64' "
            f"WHEN COUNT(CASE WHEN CAST({c} AS VARCHAR) IN ('True','TRUE','true','False','FALSE','false') THEN 1 END) "
            f"= COUNT(*) THEN 'bool' ELSE 'object' END AS native_type FROM {t}")
    return " UNION ALL ".join(parts)


ORACLE["native_types"] = " UNION ALL ".join(_native_sql(t) for t in _NATIVE_TABLES)


@q("shape_check")
def shape_check(spark, sf):
    """A4 column count, row count and refusal code of every table, one column of region, and empty lineitem."""
    cases = [(t, I.table(spark, sf, t)) for t in _SHAPE_TABLES]
    cases.append(("region_names", I.table(spark, sf, "region").select("r_name")))
    cases.append(("lineitem_negative_qty", I.table(spark, sf, "lineitem").where(F.col("l_quantity") < 0)))
    out = None
    for name, df in cases:
        r = C.shape_status(df, T.MAX_COLS).select(F.lit(name).alias("table_name"), "n_columns", "n_rows", "status")
        out = r if out is None else out.unionByName(r)
    return out


def _shape_sql(name: str, src: str, ncols: int) -> str:
    return (f"SELECT '{name}' AS table_name, {ncols} AS n_columns, COUNT(*) AS n_rows, CASE WHEN COUNT(*) = 0 "
            f"THEN 'HEADER_ONLY' WHEN {ncols} = 1 THEN 'SINGLE_COLUMN' WHEN {ncols} > 1000 THEN 'TOO_MANY_COLUMNS' "
            f"ELSE 'ok' END AS status FROM {src}")


_NCOLS = {"supplier": 4, "labels": 3}
ORACLE["shape_check"] = " UNION ALL ".join(
    [_shape_sql(t, t, len(SCHEMAS[t]) if t in SCHEMAS else _NCOLS[t]) for t in _SHAPE_TABLES]
    + [_shape_sql("region_names", "region", 1),
       _shape_sql("lineitem_negative_qty", "(SELECT * FROM lineitem WHERE l_quantity < 0)", 11)])


@q("input_bytes")
def input_bytes(spark, sf):
    """A6 total input bytes of every driver table, from file metadata."""
    rows = []
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        rows.append((t, C.input_bytes(spark, f"{sf.rstrip('/')}/{t}.parquet")))
    return spark.createDataFrame(rows, "table_name string, input_bytes bigint")


ORACLE["csv_scan"] = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
ORACLE["csv_profile"] = profile_sql("orders_text", "o_orderstatus") + (
    "SELECT column_name, inferred_type, missing_count, unique_count, round(top_value_pct, 6) AS top_value_pct, "
    "round(parse_rate, 6) AS parse_rate, round(target_association, 6) AS target_association, association_method FROM prof")
ORACLE["malformed_rows"] = (
    "SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS malformed FROM orders")
ORACLE["duplicate_headers"] = (
    "SELECT r_name AS column_name, CAST(COUNT(*) AS INTEGER) AS times FROM nation JOIN region "
    "ON n_regionkey = r_regionkey GROUP BY r_name HAVING COUNT(*) > 1")
