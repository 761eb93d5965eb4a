"""Profile rules (H1-H18) as column expressions over a per-column stats table.

The stats table has one row per input column (ordinal, name, storage, counts,
rates, summary numbers). Every rule is a ``when`` chain on that row, so the
same expressions serve the profile, the query keys and the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factsheet import thresholds as T
from factsheet.functions.scalar import METHOD_PHRASES, map_lookup
from factsheet.operators.columns import BINARY, COMPLEX, NUMERIC_STORAGE

c = F.col


def _ratio(num: str | Column, den: str | Column) -> Column:
    n = c(num) if isinstance(num, str) else num
    d = c(den) if isinstance(den, str) else den
    return F.when(d > 0, n.cast("double") / d)


def dt_rate() -> Column:
    return _ratio("dt_count", "non_null")


def num_rate() -> Column:
    return _ratio("num_count", "non_null")


def boolean_match() -> Column:
    """H2: bool storage; numbers all in {0,1}; text levels inside one vocabulary."""
    return (
        (c("storage") == "boolean")
        | (c("storage").isin(*NUMERIC_STORAGE) & F.coalesce(c("b01"), F.lit(False)))
        | ((c("storage") == "string") & (c("vmin") == c("vmax")) & (c("vmin") > 0))
    )


def ladder_stage(th: T.Thresholds = T.DEFAULTS) -> Column:
    """H1 up to the point distinct counts are needed.

    Values: unknown, boolean, numeric, datetime, coerced (text read as
    numbers), string (text or categorical, decided by distinct share).
    """
    return (
        F.when(c("non_null") == 0, "unknown")
        .when(boolean_match(), "boolean")
        .when(c("storage").isin(*NUMERIC_STORAGE), "numeric")
        .when(c("storage") == "datetime", "datetime")
        .when(c("storage").isin(COMPLEX, BINARY), "unknown")
        .when(dt_rate() >= th.parse_rate, "datetime")
        .when(num_rate() >= th.parse_rate, "coerced")
        .otherwise("string")
    )


def inferred_type(th: T.Thresholds = T.DEFAULTS) -> Column:
    """H1/H3 final type, given ``stage`` and ``unique_count``, ``n_rows``."""
    discrete = F.when(c("unique_count") <= th.discrete_max_unique, "numeric_discrete") \
        .otherwise("numeric_continuous")
    return (
        F.when(c("stage").isin("numeric", "coerced"), discrete)
        .when(c("stage") == "string",
              F.when(_ratio("unique_count", "n_rows") >= th.id_uniqueness, "text").otherwise("categorical"))
        .otherwise(c("stage"))
    )


def parse_rate() -> Column:
    return (
        F.when((c("stage") == "datetime") & (c("storage") == "string"), dt_rate())
        .when(c("stage") == "datetime", F.lit(1.0))
        .when(c("stage") == "coerced", num_rate())
    )


def flags(th: T.Thresholds = T.DEFAULTS) -> Column:
    """H4-H12 in the fixed order; all-missing columns carry that flag alone."""
    missing_pct = c("missing_pct")
    all_missing = c("non_null") == 0
    listed = F.array_compact(F.array(
        F.when(c("stage") == "coerced", F.lit("numeric_as_string")),
        F.when((missing_pct > th.high_missing_p) & ~all_missing, F.lit("high_missing")),
        F.when(c("unique_count") == 1, F.lit("constant"))
        .when(~c("is_target") & (c("top_value_pct") >= th.quasi_constant_p), F.lit("quasi_constant")),
        F.when(c("unique_pct") >= th.id_uniqueness, F.lit("id_like")),
        F.when((c("inferred_type") == "categorical")
               & ((c("unique_count") > th.high_card_abs) | (c("unique_pct") > th.high_card_rel)),
               F.lit("high_cardinality")),
        F.when(c("association") > th.leakage_r, F.lit("potential_leakage")),
    ))
    return F.when(all_missing, F.array(F.lit("all_missing"))).otherwise(listed)


def shows_levels(th: T.Thresholds = T.DEFAULTS) -> Column:
    """E2 predicate: categorical, few levels, neither id-like nor high-cardinality."""
    return ((c("inferred_type") == "categorical") & (c("unique_count") <= th.sample_values_max_unique)
            & ~F.array_contains(c("flags"), "id_like") & ~F.array_contains(c("flags"), "high_cardinality"))


# --- task, override, metric (H13-H15, D7) ------------------------------------

def inferred_task() -> Column:
    """H13 from the target's type and distinct count."""
    two = c("unique_count") == 2
    return (
        F.when(c("inferred_type") == "boolean", "binary_classification")
        .when(c("inferred_type").isin("categorical", "numeric_discrete"),
              F.when(two, "binary_classification").otherwise("multiclass_classification"))
        .when(c("inferred_type") == "numeric_continuous", "regression")
    )


def inferred_confidence() -> Column:
    return (F.when(c("inferred_type") == "numeric_discrete", F.lit(T.TASK_CONFIDENCE_DISCRETE_AMBIGUOUS))
            .when(inferred_task().isNotNull(), F.lit(T.TASK_CONFIDENCE_TYPE_MATCH)))


def override_outcome(requested: Column) -> tuple[Column, Column, Column]:
    """(task, confidence, refusal code) for a requested task (may be null)."""
    inferred = inferred_task()
    same = requested.isNull() | (requested == inferred)
    accepted_other = c("inferred_type") == "numeric_discrete"
    task = F.when(same, inferred).when(accepted_other, requested)
    conf = (F.when(requested.isNull(), inferred_confidence())
            .when(same, F.lit(T.TASK_CONFIDENCE_TYPE_MATCH))
            .when(accepted_other, F.lit(1.0)))
    refusal = F.when(~same & ~accepted_other, F.lit("TARGET_TYPE_UNSUPPORTED"))
    return task, conf, refusal


def class_balance(task: Column, class_max: Column, class_min: Column, classes: Column) -> Column:
    """Most / least frequent class count; null for regression or < 2 classes."""
    return F.when((task != "regression") & (classes >= 2), class_max.cast("double") / class_min)


def primary_metric(task: Column, ratio: Column) -> Column:
    return (
        F.when(task == "regression", "rmse")
        .when(task == "multiclass_classification", "f1_macro")
        .when(ratio.isNull(), F.lit(None).cast("string"))
        .when(ratio <= T.BALANCE_ACCURACY_MAX, "accuracy")
        .when(ratio <= T.BALANCE_F1_MAX, "f1")
        .otherwise("pr_auc")
    )


def secondary_metrics(task: Column, primary: Column) -> Column:
    bands = F.array(F.lit("accuracy"), F.lit("f1"), F.lit("pr_auc"))
    return (
        F.when(task == "regression", F.array(F.lit("mae"), F.lit("r2")))
        .when(task == "multiclass_classification", F.array(F.lit("accuracy")))
        .when(primary.isNull(), F.array().cast("array<string>"))
        .otherwise(F.concat(F.array_remove(bands, primary), F.array(F.lit("roc_auc"))))
    )


# --- findings (H16), ambiguity (H17), tone (H18) -------------------------------

SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}


def findings_array() -> Column:
    """Per non-target column, the findings in rule order as (rule_no, severity, flag)."""
    has = lambda f: F.array_contains(c("flags"), f)
    item = lambda no, sev, flag: F.struct(F.lit(no).alias("rule_no"), F.lit(sev).alias("severity"),
                                          F.lit(flag).alias("flag"))
    return F.array_compact(F.array(
        F.when(has("potential_leakage"), item(1, "error", "potential_leakage")),
        F.when(has("all_missing"), item(2, "error", "all_missing"))
        .when(has("high_missing"), item(2, "warning", "high_missing")),
        F.when(has("constant"), item(3, "warning", "constant"))
        .when(has("quasi_constant"), item(3, "warning", "quasi_constant")),
        F.when(has("numeric_as_string"), item(4, "warning", "numeric_as_string")),
        F.when(has("id_like"), item(5, "info", "id_like"))
        .when(has("high_cardinality"), item(5, "info", "high_cardinality")),
    ))


def ordered_findings(columns: DataFrame, target: str | Column) -> DataFrame:
    """The findings of all columns but the target, errors first, then in file order and rule order.

    ``position`` counts them from 1. The window sees at most five findings a column.
    """
    target = F.lit(target) if isinstance(target, str) else target
    found = columns.where(c("name") != target).select(
        c("name").alias("column_name"), "ordinal", "association_method", F.explode(findings_array()).alias("f")).select(
        "column_name", "ordinal", "association_method", "f.rule_no", "f.severity", "f.flag",
        severity_rank(c("f.severity")).alias("severity_rank"))
    order = ["severity_rank", "ordinal", "rule_no"]
    phrase = map_lookup(METHOD_PHRASES, F.coalesce("association_method", F.lit("none")))
    return found.select(
        F.row_number().over(Window.orderBy(*order)).alias("position"), "column_name", "ordinal", "rule_no", "severity",
        "flag", "severity_rank", F.when(c("flag") == "potential_leakage", phrase).alias("method_phrase")).orderBy("position")


def severity_rank(col: Column) -> Column:
    expr = F.lit(None).cast("int")
    for k, v in SEVERITY_RANK.items():
        expr = F.when(col == k, F.lit(v)).otherwise(expr)
    return expr


def is_ambiguous(confidence: Column, overridden: Column) -> Column:
    return (confidence < T.AMBIGUOUS_CONFIDENCE_BELOW) & ~overridden
