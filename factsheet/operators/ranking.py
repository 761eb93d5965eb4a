"""Order statistics over value-frequency tables, in two passes of prefix sums.

A window ``partition by column order by value`` would put every distinct value
of a column in one task. Here a frequency table ``(key..., v, n)`` is range-sorted
on ``(key..., v)`` and written with the number of its range. Pass one sums each key's
counts per range; prefix sums over these totals (a key has at most one per range)
give every range its offset. Pass two adds the running sum inside the range. So each
row gets the number of values of its key strictly below it, and from that:

* E1 average rank = before + (n + 1) / 2 (ties share the mean of their ranks);
* D5 exact median = the value(s) covering positions (N-1)//2 and N//2.

Everything is a DataFrame plan: totals are joined, never collected, and keys are
compared null-safe. The written table keeps the ranges fixed for both passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factsheet.session import store

#: Rank tables are copied so often, and rows dealt over the copies, before they are joined:
#: one value that many rows hold then spreads over as many tasks.
#: Values with over one part in so many of all rows count as hot; there are fewer of them than this.
HOT_VALUES = 1000
RANGE = "__range"


def prefix_counts(freq: DataFrame, keys: list[str], value: str | list[str] = "v",
                  count: str | tuple[str, ...] = "n", carry: tuple[str, ...] = ()) -> DataFrame:
    """Add ``before`` (rows of the same key with a smaller value) and ``total``.

    ``freq`` must hold one row per distinct ``(keys, value)``; ties and nulls are
    ordered as Spark sorts them. With several ``count`` columns, each gives a pair
    ``{count}_before`` and ``{count}_total``.
    """
    values = [value] if isinstance(value, str) else list(value)
    counts = (count,) if isinstance(count, str) else tuple(count)
    order = [*keys, *values]
    ranged = store(freq.select(*dict.fromkeys([*order, *counts, *carry]))
                   .repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*keys, RANGE).agg(*(F.sum(c).alias(c) for c in counts))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(RANGE).alias("__at"),
        *(x for i, c in enumerate(counts) for x in (
            F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__b{i}"), F.sum(c).over(whole).alias(f"__t{i}"))))
    inside = Window.partitionBy(*keys, RANGE).orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__l{i}") for i, c in enumerate(counts)))
    same = reduce(lambda a, b: a & b, [F.col(RANGE) == F.col("__at"), *(
        F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))])
    names = [("before", "total")] if isinstance(count, str) else [(f"{c}_before", f"{c}_total") for c in counts]
    return local.join(offsets, same).select(
        *dict.fromkeys([*order, *counts, *carry]),
        *(x for i, (b, t) in enumerate(names) for x in (
            (F.col(f"__b{i}") + F.col(f"__l{i}")).cast("long").alias(b), F.col(f"__t{i}").cast("long").alias(t))))


def average_ranks(freq: DataFrame, keys: list[str], value: str = "v", count: str = "n") -> DataFrame:
    """``(keys, v, n, total, rank)`` with tied values sharing their mean rank."""
    ranked = prefix_counts(freq, keys, value, count)
    return ranked.select(*keys, value, count, "total",
                         (F.col("before") + (F.col(count) + 1) / 2.0).alias("rank"))


def exact_medians(freq: DataFrame, keys: list[str], value: str = "v", count: str = "n") -> DataFrame:
    """D5 median per key: exact, interpolated between the two middle values.

    Totals per key and range tell in which one or two ranges the middle lies; only the rows
    of those are ordered and summed up, the others are read for their totals alone.
    """
    ranged = store(freq.select(*keys, value, count).repartitionByRange(*keys, value).withColumn(RANGE, F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*keys, RANGE).agg(F.sum(count).alias("__n"))
    upto = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0)
    lo, hi = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    start = F.col("__upto") - F.col("__n")
    middle = totals.select("*", F.sum("__n").over(upto).alias("__upto"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__total")).where(
        (start <= hi) & (F.col("__upto") > lo)).select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(RANGE).alias("__at"), start.alias("__before"), lo.alias("__lo"), hi.alias("__hi"))
    same = reduce(lambda a, b: a & b, [F.col(RANGE) == F.col("__at"), *(F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))])
    inside = Window.partitionBy(*keys, RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = ranged.join(middle, same).withColumn("__end", F.col("__before") + F.sum(count).over(inside))
    covers = [(F.col("__end") > F.col(m)) & (F.col("__end") - F.col(count) <= F.col(m)) for m in ("__lo", "__hi")]
    return near.groupBy(*keys).agg(
        (sum(F.max(F.when(c, F.col(value))) for c in covers) / 2.0).alias("median"))


def centred_rank(count: str, before: str, total: str) -> Column:
    """Twice the average rank less its mean (``2 rank - N - 1``), a whole number, as a double."""
    return (F.col(before) * 2 + F.col(count) - F.col(total)).cast("double")


def attach_centred_ranks(df: DataFrame, freq: DataFrame, value: str, rows: str, ranked: dict[str, str]) -> DataFrame:
    """Add one centred rank of each row's ``value`` for every count column of ``freq``, named by ``ranked``.

    ``freq`` holds a row per value: its ``rows`` and the counts. Hot values are broadcast as in
    ``attach_average_rank``, the others joined by value, all ranks at once.
    """
    whole = freq.agg(F.sum(rows)).first()[0] or 0
    ranks = store(prefix_counts(freq, [], value, tuple(ranked), carry=(rows,)).select(
        F.col(value).alias("__v"), (F.col(rows) * HOT_VALUES > whole).alias("__heavy"),
        *(centred_rank(n, f"{n}_before", f"{n}_total").alias(r) for n, r in ranked.items())), "ranks")
    names = [*df.columns, *ranked.values()]
    near = df.join(F.broadcast(ranks.where("__heavy")), F.col(value) == F.col("__v"), "left")
    light = near.where(F.col("__heavy").isNull()).select(*df.columns).join(ranks.where("NOT __heavy"), F.col(value) == F.col("__v"))
    return near.where("__heavy").select(*names).unionByName(light.select(*names))


def attach_average_rank(df: DataFrame, keys: list[str], value: str, count: str, out: str) -> DataFrame:
    """Add ``out``: the average rank of each row's ``value`` among the rows of its key,
    every row weighing ``count`` (rows may repeat a value), plus ``{out}_total``.

    Ranks come from the value frequencies, counted map-side first. Values that over a thousandth of all
    rows hold, fewer than a thousand, are broadcast, so their rows stay where they are; the
    others are joined by key and value, each value a thousandth of the rows at most.
    """
    freq = df.groupBy(*keys, value).agg(F.sum(count).alias("__n"), F.count(F.lit(1)).alias("__rows"))
    freq = store(freq, "rank-values")
    rows = freq.agg(F.sum("__rows")).first()[0] or 0
    heavy = F.col("__rows") * HOT_VALUES > rows
    marked = prefix_counts(freq, keys, value, "__n", carry=("__rows",)).select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(value).alias("__v"), heavy.alias("__heavy"),
        (F.col("before") + (F.col("__n") + 1) / 2.0).alias(out), F.col("total").alias(f"{out}_total"))
    ranks = store(marked, "ranks")
    same = reduce(lambda a, b: a & b, [F.col(value).eqNullSafe(F.col("__v")), *(
        F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))])
    names = [*df.columns, out, f"{out}_total"]
    hot = F.broadcast(ranks.where("__heavy"))
    near = df.join(hot, same, "left")
    light = near.where(F.col("__heavy").isNull()).select(*df.columns).join(ranks.where("NOT __heavy"), same)
    return near.where("__heavy").select(*names).unionByName(light.select(*names))
