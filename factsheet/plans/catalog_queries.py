"""Queries for the catalogue, retention, usage and selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from factsheet.operators import catalog as K
from factsheet.operators import selection as S
from factsheet.operators.snapshots import Catalogue
from factsheet.plans import inputs as I
from factsheet.plans.oracle import lit, profile_sql
from factsheet.plans.profile import profile_table
from factsheet.plans.queries import _load
from factsheet.session import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = "2024-01-30 00:00:00"

_ATTEMPTS_SQL = (
    "SELECT user_id AS dataset_id, event_id AS attempt_id, ts AS created_at, "
    "CAST(CASE WHEN event_type <> 'error' THEN floor(value) END AS BIGINT) AS input_tokens, "
    "CAST(CASE WHEN event_type = 'purchase' THEN floor(value / 2) END AS BIGINT) AS output_tokens, "
    "CAST(floor(value * 100) AS BIGINT) AS latency_ms FROM events")


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@q("usage_rollup")
def usage_rollup(spark, sf):
    """D17 attempts, token totals (null as 0) and total latency per dataset of the attempt log."""
    return K.usage_rollup(I.attempt_log(spark, sf))


ORACLE["usage_rollup"] = (
    f"SELECT dataset_id, COUNT(*) AS attempts, CAST(SUM(coalesce(input_tokens, 0)) AS BIGINT) AS total_input_tokens, "
    f"CAST(SUM(coalesce(output_tokens, 0)) AS BIGINT) AS total_output_tokens, "
    f"CAST(SUM(coalesce(latency_ms, 0)) AS BIGINT) AS total_latency_ms FROM ({_ATTEMPTS_SQL}) GROUP BY dataset_id")


@q("attempt_history")
def attempt_history(spark, sf):
    """E6 every attempt's position in its dataset's history by creation time."""
    return K.attempt_history(I.attempt_log(spark, sf))


ORACLE["attempt_history"] = (
    f"SELECT dataset_id, created_at, attempt_id, row_number() OVER (PARTITION BY dataset_id "
    f"ORDER BY created_at, attempt_id) AS seq FROM ({_ATTEMPTS_SQL})")


@q("expired_datasets")
def expired_datasets(spark, sf):
    """I1 attempts older than the 24 h TTL at a fixed as-of time, split into kept / expired counts."""
    kept, expired = K.expire(I.attempt_log(spark, sf), AS_OF)
    both = kept.select(F.lit("kept").alias("status")).unionByName(expired.select(F.lit("expired").alias("status")))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


ORACLE["expired_datasets"] = (
    f"SELECT CASE WHEN ts < TIMESTAMP {lit(AS_OF)} - INTERVAL 24 HOUR THEN 'expired' ELSE 'kept' END AS status, "
    f"COUNT(*) AS n FROM events GROUP BY 1")


@q("catalogue_lookup")
def catalogue_lookup(spark, sf):
    """A10 each dataset of the attempt log: found when it has an entry inside the TTL at the as-of time."""
    log = I.attempt_log(spark, sf)
    return K.lookup(log, log.select("dataset_id"), AS_OF)


ORACLE["catalogue_lookup"] = (
    f"SELECT dataset_id, bool_or(ts >= TIMESTAMP {lit(AS_OF)} - INTERVAL 24 HOUR) AS found "
    f"FROM (SELECT user_id AS dataset_id, ts FROM events) GROUP BY dataset_id")


@q("orphan_files")
def orphan_files(spark, sf):
    """C6 stored documents that no label row references."""
    docs = I.table(spark, sf, "documents").select("doc_id", "source")
    return K.orphan_files(docs, I.table(spark, sf, "labels"), "doc_id")


ORACLE["orphan_files"] = ("SELECT doc_id, source FROM documents d WHERE NOT EXISTS "
                          "(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")


@q("column_budget")
def column_budget(spark, sf):
    """E3 a five-column budget over the lineitem profile: target, flagged, then by association."""
    p = profile_table(_load(spark, sf, "lineitem_nulls"), "l_linestatus", duplicates=False)
    b = S.column_budget(p.columns, "l_linestatus", budget=5)
    return b.select(F.col("name").alias("column_name"), "kept", F.col("omitted").cast("bigint").alias("omitted"))


ORACLE["column_budget"] = profile_sql("lineitem_nulls", "l_linestatus") + (
    "SELECT column_name, rk <= 5 AS kept, CAST(SUM(CASE WHEN rk > 5 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS omitted "
    "FROM (SELECT column_name, row_number() OVER (ORDER BY tier, score DESC, ordinal) AS rk FROM "
    "(SELECT column_name, ordinal, CASE WHEN is_target THEN 0 WHEN flags <> '' THEN 1 ELSE 2 END AS tier, "
    "CASE WHEN NOT is_target AND flags = '' THEN coalesce(target_association, 0.0) ELSE 0.0 END AS score FROM prof))")

EXCLUDE = ["o_custkey", "o_no_such_column", "o_orderstatus", "o_totalprice"]


@q("column_exclusion")
def column_exclusion(spark, sf):
    """B4 requested exclusions checked against the orders profile (unknown, target, excluded)."""
    p = profile_table(_load(spark, sf, "orders"), "o_orderstatus", duplicates=False)
    req = spark.createDataFrame([(n,) for n in EXCLUDE], "requested string")
    return S.validate_exclusions(p.columns, req, "o_orderstatus")


ORACLE["column_exclusion"] = profile_sql("orders", "o_orderstatus") + (
    "SELECT r.requested, p.ordinal, CASE WHEN p.ordinal IS NULL THEN 'unknown' "
    "WHEN r.requested = 'o_orderstatus' THEN 'target' ELSE 'excluded' END AS status FROM (VALUES "
    + ", ".join(f"({lit(n)})" for n in EXCLUDE) + ") r(requested) LEFT JOIN prof p ON p.column_name = r.requested")


@q("column_search")
def column_search(spark, sf):
    """B7 column names containing ' PRICE ' (trimmed, case-folded) across three profiles."""
    frames = []
    for tname, target in [("lineitem", "l_linestatus"), ("orders", "o_orderstatus"), ("part", "p_size")]:
        p = profile_table(_load(spark, sf, tname), target, dataset_id=tname, duplicates=False)
        frames.append(S.search_columns(p.columns, " PRICE ").select(
            F.lit(tname).alias("table_name"), "ordinal", F.col("name").alias("column_name")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


ORACLE["column_search"] = " UNION ALL ".join(
    f"SELECT * FROM ({profile_sql(t, c)} SELECT {lit(t)} AS table_name, ordinal, column_name FROM prof "
    f"WHERE contains(lower(column_name), 'price'))"
    for t, c in [("lineitem", "l_linestatus"), ("orders", "o_orderstatus"), ("part", "p_size")])


@q("profile_roundtrip")
def profile_roundtrip(spark, sf):
    """A9/G7/G8 store the orders profile in the shared folder, read it back, and parse its JSON form."""
    p = profile_table(_load(spark, sf, "orders"), "o_orderstatus", dataset_id="orders")
    path = scratch_path(spark, "profiles")
    K.write_profile(p.dataset, p.columns, path)
    ds, cols = K.read_profile(spark, path, "orders")
    docs = S.profile_json(ds.drop("state"), cols)
    parsed = S.parse_profile_json(docs, "struct<n_rows:bigint,columns:array<struct<name:string,flags:array<string>>>>")
    return (parsed.select("dataset_id", F.col("profile.n_rows").alias("n_rows"), F.inline("profile.columns"))
            .select("dataset_id", "n_rows", F.col("name").alias("column_name"),
                    F.array_join("flags", ",").alias("flags")))


ORACLE["profile_roundtrip"] = profile_sql("orders", "o_orderstatus") + (
    "SELECT 'orders' AS dataset_id, n_rows, column_name, flags FROM prof")


SNAPSHOT_AS_OF = "2024-01-31 12:00:00"


@q("catalogue_snapshot")
def catalogue_snapshot(spark, sf):
    """A9/A10/I1 one dataset per user of the event log inserted, profiled once or twice, and expired: what the catalogue holds then."""
    events = I.table(spark, sf, "events").withColumn("dataset_id", F.col("user_id").cast("string"))
    catalogue = Catalogue(spark, scratch_path(spark, "catalogue"))
    catalogue.insert(events.groupBy("dataset_id").agg(
        F.lit("events.csv").alias("filename"), F.concat(F.lit("up/"), F.col("dataset_id")).alias("stored_path"), F.count(F.lit(1)).alias("n_rows"),
        F.lit(6).alias("n_columns"), F.lit("[]").alias("columns_json"), F.max("ts").alias("created_at")))
    of = lambda rows, word: rows.groupBy("dataset_id").agg(
        F.concat(F.lit(word), F.count(F.lit(1)).cast("string")).alias("profile_json"), F.lit(word == "b").alias("task_overridden"))
    catalogue.save_profiles(of(events.where("event_type = 'purchase'"), "a"))
    catalogue.save_profiles(of(events.where("event_type = 'purchase' AND value > 60"), "b").unionByName(of(events.limit(1).withColumn("dataset_id", F.lit("no such")), "b")))
    n, _ = catalogue.expire(SNAPSHOT_AS_OF)
    return catalogue.snapshot().select("dataset_id", "n_rows", "created_at", "profile_json", "task_overridden", "state", F.lit(n).cast("bigint").alias("n_expired"))


ORACLE["catalogue_snapshot"] = f"""
WITH d AS (SELECT user_id::VARCHAR AS dataset_id, count(*) AS n_rows, max(ts) AS created_at,
  count(*) FILTER (WHERE event_type = 'purchase') AS a, count(*) FILTER (WHERE event_type = 'purchase' AND value > 60) AS b FROM events GROUP BY 1),
s AS (SELECT *, created_at < TIMESTAMP {lit(SNAPSHOT_AS_OF)} - INTERVAL 24 HOUR AS old FROM d)
SELECT dataset_id, n_rows, created_at, CASE WHEN b > 0 THEN 'b' || b WHEN a > 0 THEN 'a' || a END AS profile_json,
  CASE WHEN b > 0 THEN true WHEN a > 0 THEN false END AS task_overridden, CASE WHEN a > 0 THEN 'complete' ELSE 'pending' END AS state,
  (SELECT count(*) FROM s WHERE old) AS n_expired FROM s WHERE NOT old"""


@q("orphan_uploads")
def orphan_uploads(spark, sf):
    """C6/I2 documents written as one file per source; files that the catalogue doesn't name and that are older than a day."""
    folder = scratch_path(spark, "uploads")
    docs = I.table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    docs.repartition("source").write.partitionBy("source").option("header", True).csv(folder)
    files = K.stored_files(spark, folder, "*.csv").withColumn("source", F.regexp_extract("stored_path", "source=([^/]*)/", 1))
    of = docs.groupBy("source").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # the listing has the time of writing; every third source is given a younger one
    seen = files.join(of, "source").withColumn("modified_at", F.when(
        F.col("least") % 3 == 0, F.to_timestamp(F.lit("2024-01-30 00:00:00"))).otherwise(F.to_timestamp(F.lit("2024-01-28 00:00:00"))))
    catalogue = seen.where("most % 2 = 0").select("stored_path")
    return K.orphan_files(seen, catalogue, "stored_path", "modified_at", "2024-01-30 12:00:00").select("source")


ORACLE["orphan_uploads"] = ("SELECT source FROM documents GROUP BY source HAVING max(doc_id) % 2 <> 0 AND min(doc_id) % 3 <> 0")

#: What a stored profile document must hold.
CHECKED = ST.StructType([
    ST.StructField("n_rows", ST.LongType(), False), ST.StructField("task", ST.StringType(), True),
    ST.StructField("columns", ST.ArrayType(ST.StructType([
        ST.StructField("name", ST.StringType(), False), ST.StructField("unique", ST.LongType(), True)]), False), False)])


@q("checked_json")
def checked_json(spark, sf):
    """G8 one document per event, some broken in seven ways: what is refused, and at which path."""
    doc = F.expr("""CASE event_id % 9
        WHEN 0 THEN '{"n_rows": ' || event_id
        WHEN 1 THEN '{"n_rows": "many", "columns": []}'
        WHEN 2 THEN '{"columns": []}'
        WHEN 3 THEN NULL
        WHEN 4 THEN '{"n_rows": ' || event_id || ', "columns": [{"name": "a", "unique": 1}, {"name": "b", "unique": "x"}]}'
        WHEN 5 THEN '{"n_rows": ' || event_id || ', "columns": [{"unique": 1}]}'
        WHEN 6 THEN '[1, 2]'
        ELSE '{"n_rows": ' || event_id || ', "task": null, "more": 1, "columns": [{"name": "' || event_type || '", "unique": 5}, {"name": "z"}]}' END""")
    docs = I.table(spark, sf, "events").select("event_id", doc.alias("profile_json"))
    return S.check_json(docs, CHECKED).select(
        "event_id", "status", "failed_path", F.col("profile.n_rows").alias("n_rows"),
        F.array_join(F.transform("profile.columns", lambda c: c["name"]), ",").alias("names"))


ORACLE["checked_json"] = """
SELECT event_id, CASE WHEN k = 0 THEN 'malformed' WHEN k = 3 THEN 'missing' WHEN k > 6 THEN 'valid' ELSE 'mismatch' END AS status,
  CASE k WHEN 1 THEN '$.n_rows' WHEN 2 THEN '$.n_rows' WHEN 4 THEN '$.columns[1].unique' WHEN 5 THEN '$.columns[0].name' WHEN 6 THEN '$' END AS failed_path,
  CASE WHEN k > 6 THEN event_id END AS n_rows, CASE WHEN k > 6 THEN event_type || ',z' END AS names
FROM (SELECT *, event_id % 9 AS k FROM events)"""


@q("prompt_json")
def prompt_json(spark, sf):
    """B4/E3/G7 the lineitem profile as one document: two columns excluded, two refused, six of the rest kept."""
    p = profile_table(_load(spark, sf, "lineitem_nulls"), "l_linestatus", dataset_id="lineitem", duplicates=False)
    asked = spark.createDataFrame([("lineitem", n, k) for k, n in enumerate(["l_suppkey", "l_no_such", "l_linestatus", "l_orderkey"])],
                                  "dataset_id string, requested string, place int")
    docs = S.prompt_json(p.dataset, p.columns, asked, budget=6)
    shape = ("struct<n_columns:bigint,columns:array<struct<name:string>>,columns_omitted_from_this_prompt:bigint,columns_excluded_by_user:array<string>>")
    return docs.withColumn("d", F.from_json("profile_json", shape)).select(
        "dataset_id", F.col("d.n_columns").alias("n_columns"), F.array_join(F.transform("d.columns", lambda c: c["name"]), ",").alias("columns"),
        F.col("d.columns_omitted_from_this_prompt").alias("omitted"), F.array_join("d.columns_excluded_by_user", ",").alias("excluded"),
        F.array_join("refused", ",").alias("refused"))


ORACLE["prompt_json"] = profile_sql("lineitem_nulls", "l_linestatus") + (
    "SELECT 'lineitem' AS dataset_id, 11 AS n_columns, string_agg(column_name, ',' ORDER BY ordinal) FILTER (WHERE rk <= 6) AS columns, "
    "count(*) FILTER (WHERE rk > 6) AS omitted, 'l_suppkey,l_orderkey' AS excluded, 'l_no_such,l_linestatus' AS refused FROM "
    "(SELECT column_name, ordinal, row_number() OVER (ORDER BY tier, score DESC, ordinal) AS rk FROM "
    "(SELECT column_name, ordinal, CASE WHEN is_target THEN 0 WHEN flags <> '' THEN 1 ELSE 2 END AS tier, "
    "CASE WHEN NOT is_target AND flags = '' THEN coalesce(target_association, 0.0) ELSE 0.0 END AS score FROM prof "
    "WHERE column_name NOT IN ('l_suppkey', 'l_orderkey')))")
