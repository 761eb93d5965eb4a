"""The two data passes every profile is built from.

1. ``raw_frequencies``: the raw values of all columns unpivoted into long
   form and counted by ``(ordinal, value)`` in one shuffle, nulls included.
   Map-side partial aggregation collapses hot values before the shuffle, so a
   value holding a third of the rows costs one row per map task.
2. ``facts_from_frequencies``: per column, the non-null count, the boolean
   vocabulary test, the datetime and number parse counts and min / max / mean
   / sample std of the numbers, computed on the distinct values weighted by
   their counts (each parse runs once per distinct value, not once per row).

D1 missing, D2 distinct, D3 frequency table, D4 top share, D6 duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from factsheet import thresholds as T
from factsheet.functions.scalar import WS_CLASS, col_, is_long, parse_datetime, parse_number, strip, strip_fold, text_key
from factsheet.session import once, store
from factsheet.operators.columns import (
    BOOLEAN, DATETIME, NUMERIC_STORAGE, STRING, ColumnSpec, effective_key, key_is_null, key_number, key_struct,
)

def _vocab_id(c: Column) -> Column:
    """Which boolean vocabulary a value falls in (1-based), 0 for none.

    The vocabularies are disjoint pairs, so the position of the normalised
    value in their concatenation identifies the pair: (position + 1) div 2.
    """
    words = F.array(*[F.lit(w) for pair in T.BOOLEAN_VOCABULARIES for w in pair])
    pos = F.array_position(words, strip_fold(c))
    return F.when(c.isNotNull(), F.floor((pos + 1) / 2).cast("int"))


FREQ_SCHEMA = "ordinal int, kl bigint, kd double, ks string, head string, trimmed string, lx double, n bigint"
#: What the facts need of a long text besides its key: its first characters, what is left without the white
#: space around it if that is short (only then it can be a date), and its number.
LONG = ("head", "trimmed", "lx")
LONG_TYPE = "struct<head:string,trimmed:string,lx:double>"


def _long_parts(spec: ColumnSpec) -> Column:
    """A struct of ``LONG``, null where the value is no long text."""
    if spec.storage != STRING:
        return F.lit(None).cast(LONG_TYPE)
    text = spec.ref.cast("string")
    # only white space at an end can make a text shorter
    padded = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1)).rlike(f"[{WS_CLASS}]")
    inner = F.when(padded, strip(text))
    return F.when(is_long(text), F.struct(F.substring(text, 1, T.SAMPLE_VALUE_MAX_CHARS).alias("head"),
                                          F.when(~is_long(inner), inner).alias("trimmed"), parse_number(text).alias("lx")))


def raw_frequencies(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Every column's raw values counted in one shuffle, nulls included.

    ``(ordinal, kl, kd, ks, head, trimmed, lx, n)``; the all-null key row of an ordinal
    counts its missing values, so per ordinal ``sum(n)`` is the row count. A long
    text goes by its digest, with its parsed forms beside it (they follow from the
    text, so they are part of the key), and never enters the shuffle itself.
    """
    if not specs:
        return df.sparkSession.createDataFrame([], FREQ_SCHEMA)
    # one field for the parts of a long text, none in a table without texts: less to hold for each counted value
    texts = any(s.storage == STRING for s in specs)
    structs = [key_struct(s.ordinal, effective_key(s, False), {"long": _long_parts(s)} if texts else None) for s in specs]
    counted = (df.select(F.inline(F.array(*structs)))
               .groupBy("ordinal", "kl", "kd", "ks", *(["long"] if texts else [])).agg(F.count(F.lit(1)).alias("n")))
    long = F.col("long") if texts else F.lit(None).cast(LONG_TYPE)
    return counted.select("ordinal", "kl", "kd", "ks", *(long[x].alias(x) for x in LONG), "n")


@once
def _text_facts() -> tuple[Column, Column, Column]:
    """Of a counted text: its number, whether it is a date, and its boolean vocabulary."""
    ks, long = F.col("ks"), F.col("head").isNotNull()
    return (F.when(long, F.col("lx")).otherwise(parse_number(ks)),
            parse_datetime(F.when(long, F.col("trimmed")).otherwise(ks)).isNotNull(), _vocab_id(ks))


def facts_from_frequencies(freq_all: DataFrame, specs: list[ColumnSpec]) -> tuple[int, dict[int, dict]]:
    """The wide facts computed on distinct values weighted by their counts.

    Parse tests, the boolean vocabulary test and the numeric sums run once
    per distinct value instead of once per row. Returns (rows, facts by ordinal).
    """
    strings = [s.ordinal for s in specs if s.storage == STRING]
    numerics = [s.ordinal for s in specs if s.storage in NUMERIC_STORAGE]
    o = F.col("ordinal")
    n = F.col("n")
    present = ~key_is_null()
    is_str, is_num = o.isin(strings) if strings else F.lit(False), o.isin(numerics) if numerics else F.lit(False)
    number, date, vocabulary = _text_facts()
    x = F.when(is_str, number).when(is_num, key_number())
    dt = F.when(is_str & present, date)
    base = freq_all.select("ordinal", "n", present.alias("present"), x.alias("x"), dt.alias("dt"),
                           F.when(is_str & present, vocabulary).alias("vid"),
                           F.when(is_num & present, key_number().isin(0, 1)).alias("b01"))
    agg = base.groupBy("ordinal").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("present"), n)).alias("nn"),
        F.min("vid").alias("vmin"), F.max("vid").alias("vmax"),
        F.bool_and("b01").alias("b01"),
        F.sum(F.when(F.col("dt"), n).otherwise(F.when(F.col("dt").isNotNull(), 0))).alias("dt"),
        F.sum(F.when(F.col("x").isNotNull(), n)).alias("num"),
        F.min("x").alias("min"), F.max("x").alias("max"),
        (F.sum(n * F.col("x")) / F.sum(F.when(F.col("x").isNotNull(), n))).alias("mean"),
        # the raw-value frequency summary, valid as is for every column not re-keyed by coercion
        F.count(F.when(F.col("present"), 1)).alias("raw_unique"),
        F.max(F.when(F.col("present"), n)).alias("raw_top"),
        F.min(F.when(F.col("present"), n)).alias("raw_min"))
    rows = {r["ordinal"]: r.asDict() for r in agg.collect()}
    # sample std from the distinct values: sum n (x - mean)^2 / (N - 1)
    means = [(k, r["mean"]) for k, r in rows.items() if r["mean"] is not None and r["num"]]
    if means:
        mean_map = F.create_map(*[v for k, m in means for v in (F.lit(k), F.lit(float(m)))])
        dev = base.where(F.col("x").isNotNull() & o.isin([k for k, _ in means])).groupBy("ordinal").agg(
            F.sum(n * F.pow(F.col("x") - F.element_at(mean_map, o), 2)).alias("ss"))
        for r in dev.collect():
            cnt = rows[r["ordinal"]]["num"]
            rows[r["ordinal"]]["std"] = (r["ss"] / (cnt - 1)) ** 0.5 if cnt and cnt > 1 else None
    n_rows = 0
    facts: dict[int, dict] = {}
    for s in specs:
        r = rows.get(s.ordinal, {})
        n_rows = max(n_rows, int(r.get("n_rows") or 0))
        f = {"nn": int(r.get("nn") or 0), "raw_summary": {
            "ordinal": s.ordinal, "unique_count": int(r.get("raw_unique") or 0), "top_n": r.get("raw_top"),
            "min_n": r.get("raw_min"), "eff_non_null": int(r.get("nn") or 0)}}
        if s.storage == STRING:
            f.update(vmin=r.get("vmin"), vmax=r.get("vmax"), dt=int(r.get("dt") or 0))
        if s.storage in NUMERIC_STORAGE:
            f.update(b01=r.get("b01"))
        if s.storage == STRING or s.storage in NUMERIC_STORAGE:
            f.update(num=int(r.get("num") or 0), min=r.get("min"), max=r.get("max"), mean=r.get("mean"),
                     std=r.get("std"))
        facts[s.ordinal] = f
    return n_rows, facts


def effective_frequencies(freq_all: DataFrame, coerced: set[int]) -> DataFrame:
    """D3 from the raw counts: non-null values, text-coerced columns re-keyed by their number."""
    present = freq_all.where(~key_is_null())
    if not coerced:
        return present
    o = F.col("ordinal")
    keep = present.where(~o.isin(list(coerced)))
    num = (present.where(o.isin(list(coerced)))
           .select("ordinal", F.lit(None).cast("bigint").alias("kl"),
                   F.when(F.col("head").isNotNull(), F.col("lx")).otherwise(parse_number(F.col("ks"))).alias("kd"),
                   *(F.lit(None).cast(t).alias(c) for c, t in (("ks", "string"), ("head", "string"), ("trimmed", "string"),
                                                              ("lx", "double"))), "n")
           .where(F.col("kd").isNotNull())
           .groupBy("ordinal", "kl", "kd", "ks", *LONG).agg(F.sum("n").alias("n")))
    return keep.unionByName(num)


def frequency_summary(freq: DataFrame) -> DataFrame:
    """D2/D4 per ordinal: distinct count, largest count, effective non-null count."""
    return freq.groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.max("n").alias("top_n"),
        F.min("n").alias("min_n"),
        F.sum("n").alias("eff_non_null"),
    )


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (nulls compare equal), as a one-row DataFrame.

    Equal rows have equal hashes, so a row whose 64-bit hash is alone has no equal: only the
    hashes are shuffled for all rows. Rows that share a hash are then grouped whole (partial
    aggregation first, so heavily repeated rows collapse map-side) and the group sizes summed.
    Map-typed columns are not groupable and are compared by their JSON text; long
    texts are compared by their digest.
    """
    cols, texts = [], set()
    for i, f in enumerate(df.schema.fields):
        c = col_(f.name)
        if _has_map(f.dataType):
            c = F.to_json(c)
        if _has_map(f.dataType) or isinstance(f.dataType, ST.StringType):
            texts.add(f"c{i}")
        cols.append(c.alias(f"c{i}"))
    rows, names = df.select(*cols), [f"c{i}" for i in range(len(cols))]
    if names:
        # a null leaves the hash as it is, so which values are null is hashed too
        hashed = rows.withColumn("h", F.xxhash64(*names, *[F.col(x).isNull() for x in names]))
        shared = store(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "shared-hashes")
        rows = hashed.join(shared, "h", "left_semi")
    grouped = rows.select(*[(text_key(F.col(x)) if x in texts else F.col(x)).alias(x) for x in names]).groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"))
    return grouped.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).cast("bigint")
                       .alias("duplicate_row_count"))


def _has_map(dt) -> bool:
    if isinstance(dt, ST.MapType):
        return True
    if isinstance(dt, ST.ArrayType):
        return _has_map(dt.elementType)
    if isinstance(dt, ST.StructType):
        return any(_has_map(f.dataType) for f in dt.fields)
    return False


__all__ = [
    "raw_frequencies", "facts_from_frequencies", "effective_frequencies", "frequency_summary",
    "duplicate_row_count",
    "BOOLEAN", "DATETIME",
]
