"""Named queries over the driver's tables, one per operator of the inventory.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names equal those of the matching SQL oracle. Doubles are rounded in both
(ratios to 6 places, large magnitudes to fewer) so float summation order does
not decide a comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsheet.errors import ProfileRefused
from factsheet.functions.scalar import parse_datetime
from factsheet.operators import rules as R
from factsheet.operators.columns import key_number, key_text
from factsheet.operators.ranking import average_ranks
from factsheet.plans import inputs as I
from factsheet.plans.profile import column_facts, profile_table, target_outcome

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r(x, d: int = 6):
    return F.round(x if not isinstance(x, str) else c(x), d)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- D1, D2, D3, D4, D5, D6: column statistics --------------------------------

@query("column_missing")
def column_missing(spark, sf):
    """D1 missing count and share per column of lineitem (l_tax partly missing)."""
    cf = column_facts(I.lineitem_nulls(spark, sf))
    return cf.stats.select(c("name").alias("column_name"), c("missing_count").cast("bigint").alias("missing_count"),
                           r("missing_pct").alias("missing_pct"))


@query("column_unique")
def column_unique(spark, sf):
    """D2 exact distinct count and share (of all rows) per column of lineitem."""
    cf = column_facts(I.lineitem_nulls(spark, sf))
    return cf.stats.select(c("name").alias("column_name"), c("unique_count").cast("bigint").alias("unique_count"),
                           r("unique_pct").alias("unique_pct"))


@query("value_counts")
def value_counts(spark, sf):
    """D3 value frequency table of the orders status, priority and customer columns."""
    df = I.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    cf = column_facts(df)
    names = {s.ordinal: s.name for s in cf.specs}
    name_map = F.create_map(*[x for o, n in names.items() for x in (F.lit(o), F.lit(n))])
    return cf.freq.select(F.element_at(name_map, c("ordinal")).alias("column_name"),
                          key_text().alias("value"), c("n").cast("bigint").alias("n"))


@query("top_value_share")
def top_value_share(spark, sf):
    """D4 share of the most frequent non-null value per column of lineitem."""
    cf = column_facts(I.lineitem_nulls(spark, sf))
    return cf.stats.select(c("name").alias("column_name"), r("top_value_pct").alias("top_value_pct"))


@query("numeric_summary")
def numeric_summary(spark, sf):
    """D5 min, max, mean, sample std, exact median of the numeric-typed lineitem columns."""
    p = profile_table(I.lineitem_nulls(spark, sf), "l_linestatus", duplicates=False)
    return (p.columns.where(c("inferred_type").isin("numeric_discrete", "numeric_continuous"))
            .select(c("name").alias("column_name"), r("min", 4).alias("min"), r("max", 4).alias("max"),
                    r("mean", 4).alias("mean"), r("std", 4).alias("std"), r("median", 4).alias("median")))


@query("duplicate_rows")
def duplicate_rows(spark, sf):
    """D6 rows minus distinct rows: whole line items, and the same without their numbers."""
    from factsheet.operators.stats import duplicate_row_count

    li = I.table(spark, sf, "lineitem")
    plain = li.select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return _union([duplicate_row_count(df).select(F.lit(name).alias("table_name"), "duplicate_row_count")
                   for name, df in (("lineitem", li.unionByName(li.where("l_linenumber = 1"))), ("plain", plain))])


# --- D7, H13-H15: target, task, metric ----------------------------------------

TARGETS = [
    ("orders", "o_orderstatus"), ("lineitem", "l_linestatus"), ("lineitem", "l_returnflag"),
    ("lineitem", "l_extendedprice"), ("lineitem", "l_linenumber"), ("documents_labelled", "quality"),
    ("documents_labelled", "toxic"), ("events_flagged", "big_error"), ("events_flagged", "event_type"),
    ("part", "p_size"), ("nation", "n_regionkey"), ("customer", "c_mktsegment"), ("embeddings", "label"),
]


def _load(spark, sf, name):
    derived = {"documents_labelled": I.documents_labelled, "events_flagged": I.events_flagged,
               "lineitem_nulls": I.lineitem_nulls, "orders_text": I.orders_text}
    if name in derived:
        return derived[name](spark, sf)
    return I.table(spark, sf, name)


def _target_rows(spark, sf, targets=TARGETS) -> DataFrame:
    """Dataset-level outcome (task, confidence, ratio, metrics) per (table, target).

    Only the target column is read (column pruning reaches the scan).
    """
    rows = []
    by_table: dict[str, list[str]] = {}
    for tname, target in targets:
        by_table.setdefault(tname, []).append(target)
    for tname, cols in by_table.items():
        # one pass over all targets of a table (only those columns are read)
        cf = column_facts(_load(spark, sf, tname).select(*cols))
        for target in cols:
            t = target_outcome(cf, target, None)
            rows.append((tname, target, cf.types[t["ordinal"]], t["task"], float(t["conf"]),
                         None if t["ratio"] is None else float(t["ratio"]), t["primary"],
                         list(t["secondary"]), bool(t["overridden"])))
    return spark.createDataFrame(rows, "table_name string, target_column string, inferred_type string, "
                                       "problem_type string, task_confidence double, class_balance_ratio double, "
                                       "primary_metric string, secondary_metrics array<string>, "
                                       "task_overridden boolean")


@query("class_balance")
def class_balance(spark, sf):
    """D7 most / least frequent class count per classification target."""
    rows = _target_rows(spark, sf)
    return rows.select("table_name", "target_column", r("class_balance_ratio").alias("class_balance_ratio"))


@query("task_inference")
def task_inference(spark, sf):
    """H13 task and confidence from each target's inferred type and distinct count."""
    rows = _target_rows(spark, sf)
    return rows.select("table_name", "target_column", "inferred_type", "problem_type",
                       r("task_confidence").alias("task_confidence"))


@query("metric_choice")
def metric_choice(spark, sf):
    """H15 primary and secondary metrics per target (binary bands on the class ratio)."""
    rows = _target_rows(spark, sf)
    return rows.select("table_name", "target_column", "problem_type", "primary_metric",
                       F.array_join("secondary_metrics", ",").alias("secondary_metrics"))


@query("ambiguous_tasks")
def ambiguous_tasks(spark, sf):
    """H17 targets whose task confidence is below 0.85 and not overridden."""
    rows = _target_rows(spark, sf)
    return rows.where(R.is_ambiguous(c("task_confidence"), c("task_overridden"))).select(
        "table_name", "target_column", r("task_confidence").alias("task_confidence"))


OVERRIDES = [
    ("lineitem", "l_linenumber", "regression"), ("lineitem", "l_linenumber", "binary_classification"),
    ("lineitem", "l_linenumber", "multiclass_classification"), ("lineitem", "l_extendedprice", "regression"),
    ("lineitem", "l_extendedprice", "binary_classification"), ("lineitem", "l_linestatus", "regression"),
    ("lineitem", "l_linestatus", "binary_classification"), ("orders", "o_orderstatus", "regression"),
]


@query("task_override")
def task_override(spark, sf):
    """H14 accepted or refused task overrides, with the resulting confidence."""
    frames = []
    for tname, target, req in OVERRIDES:
        cf = column_facts(_load(spark, sf, tname).select(target), target)
        task, conf, refusal = R.override_outcome(F.lit(req))
        frames.append(cf.stats.select(F.lit(tname).alias("table_name"), c("name").alias("target_column"),
                                      F.lit(req).alias("requested"), task.alias("problem_type"),
                                      r(conf).alias("task_confidence"), refusal.alias("refusal")))
    return _union(frames)


TARGET_CHECKS = [
    ("lineitem", "l_linestatus"), ("lineitem", "l_no_such_column"), ("customer", "c_name"),
    ("orders", "o_orderdate"), ("lineitem_nulls", "l_tax"), ("region", "r_name"),
]


@query("target_check")
def target_check(spark, sf):
    """B3 target admission in order: exists, any value, two values, modelable type."""
    rows = []
    for tname, target in TARGET_CHECKS:
        df = _load(spark, sf, tname)
        status = "ok"
        try:
            if target not in df.columns:
                raise ProfileRefused("TARGET_NOT_FOUND", target)
            cf = column_facts(df.select(target), target)
            target_outcome(cf, target, None)
        except ProfileRefused as e:
            status = e.code
        rows.append((tname, target, status))
    return spark.createDataFrame(rows, "table_name string, target_column string, status string")


# --- H1-H3, D8, D9, B2, G2-G4: typing -----------------------------------------

TYPED_TABLES = ["orders", "lineitem_nulls", "customer", "part", "events", "documents_labelled", "orders_text",
                "nation", "embeddings", "conversations"]


@query("column_types")
def column_types(spark, sf):
    """H1 the type ladder over every column of ten tables."""
    frames = []
    for tname in TYPED_TABLES:
        cf = column_facts(_load(spark, sf, tname))
        frames.append(cf.stats.select(F.lit(tname).alias("table_name"), c("name").alias("column_name"),
                                      "inferred_type"))
    return _union(frames)


@query("type_boolean")
def type_boolean(spark, sf):
    """H2 boolean rung on text (Yes/no), 0/1 numbers, and non-boolean columns."""
    cf = column_facts(I.orders_text(spark, sf))
    return cf.stats.select(c("name").alias("column_name"), R.boolean_match().alias("is_boolean"))


@query("parse_rate_datetime")
def parse_rate_datetime(spark, sf):
    """D8 share of non-null text values that parse as a datetime."""
    cf = column_facts(I.orders_text(spark, sf).select("date_mixed", "date_iso", "o_orderpriority", "price_text"))
    return cf.stats.select(c("name").alias("column_name"), c("dt_count").cast("bigint").alias("parsed"),
                           r(R.dt_rate()).alias("parse_rate"))


@query("parse_rate_timestamps")
def parse_rate_timestamps(spark, sf):
    """D8, G4 order dates written in the year-first forms, and outside the range: texts that parse."""
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    with_time = lambda tail: F.concat(d, F.lit(tail))
    forms = {"zulu": with_time("T03:04:05Z"), "shifted": with_time(" 03:04:05+02:00"), "millis": with_time("T03:04:05.123"),
             "nanos": with_time(" 03:04:05.123456789"), "minutes": with_time(" 03:04"),
             "short": F.date_format("o_orderdate", "yyyy-M-d"),
             "too_early": F.concat(F.lit("1"), F.substring(d, 2, 9)), "too_late": F.concat(F.lit("9"), F.substring(d, 2, 9)),
             "no_month": F.concat(F.substring(d, 1, 5), F.lit("13"), F.substring(d, 8, 3))}
    forms["too_early"] = F.regexp_replace(forms["too_early"], "^1[0-9]", "14")
    cf = column_facts(I.table(spark, sf, "orders").select(*[x.alias(k) for k, x in forms.items()]))
    return cf.stats.select(c("name").alias("column_name"), c("dt_count").cast("bigint").alias("parsed"))


#: Ways to write an order's date with a time of 03:04 where there is one: Spark's date pattern, and the seconds that it adds.
DATE_FORMS = {
    "d-MMM-yyyy": 0, "MMM d yyyy": 0, "MMMM d, yyyy": 0, "d MMMM yyyy": 0, "yyyy/M/d": 0, "M/d/yyyy": 0, "M-d-yyyy": 0, "M.d.yyyy": 0, "yyyyMMdd": 0,
    "d-MMM-yy": 0, "M/d/yy": 0, "yyyy MMM d": 0, "E, dd MMM yyyy '03:04:05' 'GMT'": 11045, "M/d/yyyy '3:04 pm'": 54240, "d MMM yyyy '03:04'": 11040,
    "MMM d yyyy '3pm'": 54000, "yyyy-MM-dd'T03:04:00+0200'": 3840, "MMM d yyyy '03:04 -01:00'": 14640}


@query("date_forms")
def date_forms(spark, sf):
    """G4 order dates written in eighteen ways and one that is none: how many parse, and the seconds they come to."""
    d = F.to_timestamp("o_orderdate")
    texts = [F.struct(F.lit(p).alias("form"), F.date_format(d, p).alias("v")) for p in DATE_FORMS]
    texts.append(F.struct(F.lit("none").alias("form"), F.concat(F.lit("order of "), F.date_format(d, "yyyy-MM-dd")).alias("v")))
    read = I.table(spark, sf, "orders").select(F.explode(F.array(*texts)).alias("x")).select("x.form", parse_datetime(c("x.v")).alias("t"))
    return read.groupBy("form").agg(F.count("t").alias("parsed"), F.coalesce(F.sum(F.unix_timestamp("t")), F.lit(0)).alias("seconds"))


@query("decimal_unique")
def decimal_unique(spark, sf):
    """D2 distinct values of line prices as wide decimals that doubles can't tell apart."""
    big = (F.col("l_orderkey").cast("decimal(38,0)") + F.lit("100000000000000000000").cast("decimal(38,0)")).alias("wide")
    cf = column_facts(I.table(spark, sf, "lineitem").select(big.cast("decimal(38,0)").alias("wide"), "l_quantity"))
    return cf.stats.select(c("name").alias("column_name"), c("unique_count").cast("bigint").alias("unique_count"))


@query("dataset_profile")
def dataset_profile(spark, sf):
    """H20 the dataset row of four profiles, repeated rows counted over whole rows."""
    out = []
    for t, target in DATASET_PROFILES:
        p = profile_table(_load(spark, sf, t), target, dataset_id=t)
        out.append(p.dataset.select(
            c("dataset_id").alias("table_name"), "target_column", "n_rows", "n_columns", "problem_type", "task_confidence",
            "primary_metric", F.array_join("secondary_metrics", ",").alias("secondary_metrics"),
            r("class_balance_ratio").alias("class_balance_ratio"), "duplicate_row_count"))
    return _union(out)


DATASET_PROFILES = [("orders", "o_orderstatus"), ("documents_labelled", "quality"), ("part", "p_retailprice"),
                    ("events_flagged", "big_error")]


@query("parse_rate_numeric")
def parse_rate_numeric(spark, sf):
    """D9 share of non-null text values that parse as a number after cleaning."""
    cf = column_facts(I.orders_text(spark, sf).select("price_text", "date_iso", "o_orderpriority", "status_yn"))
    return cf.stats.select(c("name").alias("column_name"), c("num_count").cast("bigint").alias("parsed"),
                           r(R.num_rate()).alias("parse_rate"))


@query("effective_values")
def effective_values(spark, sf):
    """B2 statistics of a text-coerced numeric column use the cleaned numbers."""
    p = profile_table(I.orders_text(spark, sf).select("price_text", "o_orderstatus"), "o_orderstatus",
                      duplicates=False)
    return p.columns.where(c("name") == "price_text").select(
        c("name").alias("column_name"), "inferred_type", c("unique_count").alias("unique_count"),
        r("min", 2).alias("min"), r("max", 2).alias("max"), r("mean", 4).alias("mean"),
        r("median", 4).alias("median"), r("parse_rate").alias("parse_rate"),
        F.array_join("flags", ",").alias("flags"))


# --- D10-D13, E1: association ----------------------------------------------------

def _assoc(spark, sf, tname, target, method=None):
    p = profile_table(_load(spark, sf, tname), target, duplicates=False)
    out = p.columns.where(c("name") != target)
    if method:
        out = out.where(c("association_method") == method)
    return out.select(c("name").alias("column_name"), r("target_association").alias("target_association"),
                      "association_method")


@query("assoc_eta")
def assoc_eta(spark, sf):
    """D10 correlation ratio of numeric lineitem columns with the line status."""
    return _assoc(spark, sf, "lineitem_nulls", "l_linestatus", "eta")


@query("assoc_purity")
def assoc_purity(spark, sf):
    """D11 purity of document language and source for the quality label."""
    return _assoc(spark, sf, "documents_labelled", "quality", "purity")


@query("assoc_spearman")
def assoc_spearman(spark, sf):
    """D12 Spearman of numeric lineitem columns with the extended price (pairs with l_tax null dropped)."""
    return _assoc(spark, sf, "lineitem_nulls", "l_extendedprice", "spearman")


@query("target_association")
def target_association(spark, sf):
    """D13 dispatch by feature type and task for every lineitem column against the price."""
    return _assoc(spark, sf, "lineitem_nulls", "l_extendedprice")


@query("average_rank")
def average_rank(spark, sf):
    """E1 average rank (ties share) of every value of l_quantity and l_tax."""
    cf = column_facts(I.lineitem_nulls(spark, sf).select("l_quantity", "l_tax"))
    f = cf.freq.select("ordinal", key_number().alias("v"), "n")
    ranks = average_ranks(f, ["ordinal"])
    return ranks.select(F.when(c("ordinal") == 0, "l_quantity").otherwise("l_tax").alias("column_name"),
                        c("v").alias("value"), r("rank", 2).alias("avg_rank"))


# --- H4-H12, E2, H16, D14-D16, H18: flags and findings --------------------------

FLAG_PROFILES = [("orders_text", "o_orderstatus"), ("lineitem_nulls", "l_linestatus"),
                 ("documents_labelled", "quality")]


def _profiles(spark, sf, dup=False):
    for tname, target in FLAG_PROFILES:
        yield tname, profile_table(_load(spark, sf, tname), target, dataset_id=tname, duplicates=dup)


@query("column_flags")
def column_flags(spark, sf):
    """H4-H12 flag lists per column, in the fixed flag order."""
    return _union([p.columns.select(F.lit(t).alias("table_name"), c("name").alias("column_name"),
                                    F.array_join("flags", ",").alias("flags")) for t, p in _profiles(spark, sf)])


@query("level_names")
def level_names(spark, sf):
    """E2 up to five level names of small categorical columns (ties by value)."""
    return _union([p.columns.where(c("sample_values").isNotNull()).select(
        F.lit(t).alias("table_name"), c("name").alias("column_name"),
        F.array_join("sample_values", "|").alias("sample_values")) for t, p in _profiles(spark, sf)])


@query("findings")
def findings(spark, sf):
    """H16, E4, G11 findings of every non-target column in display order, leakage with its method in words."""
    return _union([R.ordered_findings(p.columns, target).select(F.lit(t).alias("table_name"), "*")
                   for (t, target), (_, p) in zip(FLAG_PROFILES, _profiles(spark, sf))])


@query("flag_counts")
def flag_counts(spark, sf):
    """D14 columns per flag (zero counts omitted) plus duplicate rows when there are any."""
    frames = []
    for t, p in _profiles(spark, sf, dup=True):
        fc = (p.columns.select(F.explode("flags").alias("flag")).groupBy("flag")
              .agg(F.count(F.lit(1)).alias("n")))
        dup = p.dataset.where(c("duplicate_row_count") > 0).select(
            F.lit("duplicate_rows").alias("flag"), c("duplicate_row_count").alias("n"))
        frames.append(fc.unionByName(dup).select(F.lit(t).alias("table_name"), "flag", "n"))
    return _union(frames)


@query("quality_totals")
def quality_totals(spark, sf):
    """D15/H18 average missing share, duplicate share and their tones per table."""
    frames = []
    for t, p in _profiles(spark, sf, dup=True):
        per = p.columns.groupBy("dataset_id").agg(
            F.avg("missing_pct").alias("avg_missing"),
            F.max(F.array_contains("flags", "high_missing").cast("int")).alias("any_high"))
        frames.append(per.join(p.dataset, "dataset_id").select(
            F.lit(t).alias("table_name"), r("avg_missing").alias("avg_missing_pct"),
            r(F.when(c("n_rows") > 0, c("duplicate_row_count") / c("n_rows")).otherwise(0.0)).alias("duplicate_pct"),
            F.when(c("any_high") == 1, "error").when(c("avg_missing") > 0, "warning").otherwise("ok")
            .alias("missing_tone"),
            F.when(c("duplicate_row_count") > 0, "warning").otherwise("ok").alias("duplicate_tone")))
    return _union(frames)


@query("class_shares")
def class_shares(spark, sf):
    """D16 binary class shares r/(1+r) and 1/(1+r), labelled when two level names exist."""
    frames = []
    for tname, target in [("lineitem", "l_linestatus"), ("documents_labelled", "quality"),
                          ("events_flagged", "big_error")]:
        p = profile_table(_load(spark, sf, tname), target, duplicates=False)
        tcol = p.columns.select(c("name").alias("target_column"), "sample_values")
        ratio = c("class_balance_ratio")
        two = F.size(F.coalesce(c("sample_values"), F.array().cast("array<string>"))) == 2
        frames.append(p.dataset.where(c("problem_type") == "binary_classification").join(tcol, "target_column").select(
            F.lit(tname).alias("table_name"), "target_column",
            r(ratio / (1 + ratio)).alias("major_share"), r(1 / (1 + ratio)).alias("minor_share"),
            F.when(two, c("sample_values")[0]).alias("major_label"),
            F.when(two, c("sample_values")[1]).alias("minor_label")))
    return _union(frames)


QUERIES_DOC = {k: (v.__doc__ or "").strip() for k, v in QUERIES.items()}


# --- H20: the whole profile -----------------------------------------------------

def profile_rows(p) -> DataFrame:
    """The column profile with floats rounded and arrays as text (oracle-comparable)."""
    cols = p.columns
    return cols.select(
        c("name").alias("column_name"), "inferred_type", "missing_count", r("missing_pct").alias("missing_pct"),
        "unique_count", r("unique_pct").alias("unique_pct"), r("top_value_pct").alias("top_value_pct"),
        F.array_join("sample_values", "|").alias("sample_values"),
        r("min", 4).alias("min"), r("max", 4).alias("max"), r("mean", 4).alias("mean"),
        r("std", 4).alias("std"), r("median", 4).alias("median"), r("parse_rate").alias("parse_rate"),
        r("target_association").alias("target_association"), "association_method",
        F.array_join("flags", ",").alias("flags"))


PROFILES = {"profile_orders": ("orders", "o_orderstatus"),
            "profile_lineitem": ("lineitem_nulls", "l_linestatus"),
            "profile_documents": ("documents_labelled", "quality"),
            "profile_events": ("events_flagged", "big_error"),
            "profile_part": ("part", "p_retailprice")}


def _profile_query(tname: str, target: str):
    def run(spark, sf):
        return profile_rows(profile_table(_load(spark, sf, tname), target, dataset_id=tname, duplicates=False))
    run.__doc__ = f"H20 the whole column profile of {tname} for the target {target}."
    return run


for _k, (_t, _c) in PROFILES.items():
    QUERIES[_k] = _profile_query(_t, _c)


# --- G9, G10, G11: display text ---------------------------------------------------

@query("metric_rationale")
def metric_rationale(spark, sf):
    """G10/G11 metric and task labels and the rationale sentence for each target's primary metric."""
    from factsheet.functions.scalar import METRIC_LABELS, TASK_LABELS, map_lookup
    from factsheet.functions.scalar import metric_rationale as rationale

    rows = _target_rows(spark, sf)
    return rows.select("table_name", "target_column",
                       map_lookup(TASK_LABELS, c("problem_type")).alias("task_label"),
                       map_lookup(METRIC_LABELS, c("primary_metric")).alias("metric_label"),
                       rationale(c("problem_type"), c("primary_metric"), c("class_balance_ratio")).alias("rationale"))


@query("flag_labels")
def flag_labels(spark, sf):
    """G9/G11 every flag of every profiled column with its label and tone, and the missing share as text."""
    from factsheet.functions.scalar import FLAG_LABELS, FLAG_TONES, map_lookup, percent_text

    return _union([p.columns.select(F.lit(t).alias("table_name"), c("name").alias("column_name"),
                                    F.explode("flags").alias("flag"), "missing_pct")
                   .select("table_name", "column_name", "flag",
                           map_lookup(FLAG_LABELS, c("flag")).alias("label"),
                           map_lookup(FLAG_TONES, c("flag")).alias("tone"),
                           percent_text("missing_pct").alias("missing_text"))
                   for t, p in _profiles(spark, sf)])


# --- B5: association on a sample ------------------------------------------------------

@query("association_sample")
def association_sample(spark, sf):
    """B5 lineitem profiled with association on half of 100 md5 buckets of the row's key (the sampling operator)."""
    p = profile_table(_load(spark, sf, "lineitem"), "l_linestatus", duplicates=False, sample_percent=50,
                      sample_key=F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")))
    ds = p.dataset.select("dataset_id", "profiled_on_sample", "sample_percent", "n_rows")
    return p.columns.select("dataset_id", c("name").alias("column_name"), "association_method",
                            r("target_association").alias("target_association")).join(ds, "dataset_id")
