"""Storage classes of input columns and the value keys each one is counted by.

Every column of the input is given an ordinal (its position) and a storage
class read from the Spark schema. Values are carried in long form as three
nullable keys ``(kl bigint, kd double, ks string)``, exactly one set per row,
so one shuffle can count values of every column at once without losing
precision: integers stay exact in ``kl``, floating and coerced numbers are
compared as doubles in ``kd`` (Spark's grouping merges -0.0 with 0.0 and all
NaN), everything else compares as text in ``ks``: decimals by their exact text, long
texts by their digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from factsheet.functions.scalar import col_, parse_number, text_key

INTEGRAL = "integral"
FLOATING = "floating"
DECIMAL = "decimal"
BOOLEAN = "boolean"
STRING = "string"
DATETIME = "datetime"
COMPLEX = "complex"
BINARY = "binary"
NUMERIC_STORAGE = (INTEGRAL, FLOATING, DECIMAL)


@dataclass(frozen=True)
class ColumnSpec:
    ordinal: int
    name: str
    storage: str          # one of the classes above
    storage_type: str     # Spark type name as reported in the profile

    @property
    def ref(self) -> Column:
        return col_(self.name)


def storage_class(dt: ST.DataType) -> str:
    if isinstance(dt, (ST.ByteType, ST.ShortType, ST.IntegerType, ST.LongType)):
        return INTEGRAL
    if isinstance(dt, (ST.FloatType, ST.DoubleType)):
        return FLOATING
    if isinstance(dt, ST.DecimalType):
        return DECIMAL
    if isinstance(dt, ST.BooleanType):
        return BOOLEAN
    if isinstance(dt, (ST.StringType, ST.VarcharType, ST.CharType)):
        return STRING
    if isinstance(dt, (ST.DateType, ST.TimestampType, ST.TimestampNTZType)):
        return DATETIME
    if isinstance(dt, ST.BinaryType):
        return BINARY
    return COMPLEX


def column_specs(df: DataFrame) -> list[ColumnSpec]:
    return [
        ColumnSpec(i, f.name, storage_class(f.dataType), f.dataType.simpleString())
        for i, f in enumerate(df.schema.fields)
    ]


def normalised(df: DataFrame, specs: list[ColumnSpec] | None = None) -> DataFrame:
    """NaN -> null on floating columns; every other column unchanged.

    A pure projection: Catalyst keeps it inside the scan's codegen stage and
    still prunes and pushes filters through it.
    """
    specs = specs or column_specs(df)
    cols = []
    for s in specs:
        if s.storage == FLOATING:
            cols.append(F.when(~F.isnan(s.ref), s.ref).alias(s.name))
        else:
            cols.append(s.ref)
    return df.select(*cols)


def raw_key(spec: ColumnSpec) -> tuple[Column | None, Column | None, Column | None]:
    """Value key of the raw (non-coerced) values of a column."""
    c = spec.ref
    if spec.storage == INTEGRAL:
        return c.cast("bigint"), None, None
    if spec.storage == FLOATING:
        return None, c.cast("double"), None
    if spec.storage == DECIMAL:  # one scale per column, so the text is canonical and exact
        return None, None, c.cast("string")
    if spec.storage == DATETIME:
        return F.unix_micros(c.cast("timestamp")), None, None
    if spec.storage == COMPLEX:
        return None, None, text_key(F.to_json(c))
    if spec.storage == BINARY:
        return None, None, text_key(F.hex(c))
    return None, None, text_key(c.cast("string"))


def effective_key(spec: ColumnSpec, coerced: bool) -> tuple[Column | None, Column | None, Column | None]:
    """B2: text-coerced numeric columns are counted by their cleaned number."""
    if coerced and spec.storage == STRING:
        return None, parse_number(spec.ref), None
    return raw_key(spec)


def key_struct(ordinal: int, key: tuple, extra: dict[str, Column] | None = None) -> Column:
    kl, kd, ks = key
    fields = [
        F.lit(ordinal).alias("ordinal"),
        (kl if kl is not None else F.lit(None).cast("bigint")).alias("kl"),
        (kd if kd is not None else F.lit(None).cast("double")).alias("kd"),
        (ks if ks is not None else F.lit(None).cast("string")).alias("ks"),
    ]
    for name, c in (extra or {}).items():
        fields.append(c.alias(name))
    return F.struct(*fields)


def key_is_null(prefix: str = "") -> Column:
    return F.col(prefix + "kl").isNull() & F.col(prefix + "kd").isNull() & F.col(prefix + "ks").isNull()


def key_text(prefix: str = "") -> Column:
    """A key as text: the value itself, or the digest of a long one."""
    return F.coalesce(
        F.col(prefix + "kl").cast("string"),
        F.col(prefix + "kd").cast("string"),
        F.col(prefix + "ks"),
    )


def key_number(prefix: str = "") -> Column:
    """The number of a numeric key (decimals are keyed by their text)."""
    return F.coalesce(F.col(prefix + "kd"), F.col(prefix + "kl").cast("double"), F.col(prefix + "ks").try_cast("double"))
