"""Sparse one-hot rows and the order of findings."""

from pyspark.sql import functions as F

from factsheet.operators import prep as P
from factsheet.operators import rules as R

SCHEMA = "k long, `a.b` string, n int"


def rows_of(df):
    return sorted((r[0], r["size"], list(r["indices"])) for r in df.collect())


def test_levels_keep_their_index_and_rare_ones_share_one(spark):
    train = spark.createDataFrame([(k, x, n) for k, (x, n) in enumerate(
        [("red", 1)] * 3 + [("blue", 2)] * 2 + [("teal", 1), ("pink", None), (None, 2)])], SCHEMA)
    rows = spark.createDataFrame([(1, "blue", 1), (2, "red", 9), (3, "teal", None), (4, "pink", 2), (5, "new", None),
                                  (6, None, 1), (6, None, 1)], SCHEMA)
    # a.b: blue 0, red 1, rare 2; n: 1 -> 3, 2 -> 4
    want = [(1, 5, [0, 3]), (2, 5, [1]), (3, 5, [2]), (4, 5, [2, 4]), (5, 5, []), (6, 5, [3]), (6, 5, [3])]
    for parts in (1, 7):
        got = P.sparse_vectors(rows, train.repartition(parts), ["k"], ["a.b", "n"], min_rows=2)
        assert rows_of(got) == want


def test_without_training_levels_and_without_rows(spark):
    some = spark.createDataFrame([(1, "x", 1)], SCHEMA)
    none = some.where(F.lit(False))
    assert rows_of(P.sparse_vectors(some, none, ["k"], ["a.b", "n"])) == [(1, 0, [])]
    assert rows_of(P.sparse_vectors(none, some, ["k"], ["a.b"])) == []


def test_a_hot_level_among_many_rare_ones(spark):
    rows = spark.range(30_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("v"), F.col("id") % 5_000)).alias("lvl"))
    got = P.sparse_vectors(rows, rows, ["k"], ["lvl"], min_rows=5).groupBy("size", "indices").count().collect()
    assert [(r["size"], list(r["indices"]), r["count"]) for r in sorted(got, key=lambda r: r["indices"])] == [
        (2, [0], 10_000), (2, [1], 20_000)]


def test_frequencies_count_missing_levels_in_the_whole(spark):
    rows = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, None, 1), (4, "y", 1)], SCHEMA)
    got = {r["k"]: r["a.b_freq"] for r in P.frequency_encode(rows, "a.b").collect()}
    assert got == {1: 0.5, 2: 0.5, 3: None, 4: 0.25}


def test_findings_by_severity_then_file_then_rule(spark):
    columns = spark.createDataFrame(
        [("late", 3, "eta", ["potential_leakage", "numeric_as_string"]), ("t", 0, "none", ["constant"]),
         ("first", 1, "none", ["id_like"]), ("gone", 2, "none", ["all_missing"]), ("same", 4, "purity", ["constant"]),
         ("clean", 5, "eta", [])], "name string, ordinal int, association_method string, flags array<string>")
    got = [tuple(r) for r in R.ordered_findings(columns, "t").select(
        "position", "column_name", "rule_no", "severity", "flag", "method_phrase").collect()]
    assert got == [
        (1, "gone", 2, "error", "all_missing", None),
        (2, "late", 1, "error", "potential_leakage", "eta association"),
        (3, "late", 4, "warning", "numeric_as_string", None),
        (4, "same", 3, "warning", "constant", None),
        (5, "first", 5, "info", "id_like", None)]
