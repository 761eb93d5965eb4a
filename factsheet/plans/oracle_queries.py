"""SQL oracle text per registered query (DuckDB dialect, driver's tables as views)."""

from __future__ import annotations

from factsheet.plans import queries as Q
from factsheet.plans.oracle import SCHEMAS, lit, profile_sql, q, target_sql, view

ORACLE: dict[str, str] = {}


def _from_profile(table: str, select: str, target: str | None = None, columns=None, where: str = "TRUE") -> str:
    return profile_sql(table, target, columns) + f"SELECT {select} FROM prof WHERE {where}"


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


ORACLE["column_missing"] = _from_profile(
    "lineitem_nulls", "column_name, missing_count, round(missing_pct, 6) AS missing_pct")
ORACLE["column_unique"] = _from_profile(
    "lineitem_nulls", "column_name, CAST(unique_count AS BIGINT) AS unique_count, round(unique_pct, 6) AS unique_pct")
ORACLE["top_value_share"] = _from_profile(
    "lineitem_nulls", "column_name, round(top_value_pct, 6) AS top_value_pct")
ORACLE["value_counts"] = _union([
    f"SELECT {lit(c)} AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM orders "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")])
ORACLE["numeric_summary"] = _from_profile(
    "lineitem_nulls",
    "column_name, round(min_v, 4) AS min, round(max_v, 4) AS max, round(mean_v, 4) AS mean, "
    "round(std_v, 4) AS std, round(median_v, 4) AS median",
    where="inferred_type IN ('numeric_discrete', 'numeric_continuous')")
ORACLE["duplicate_rows"] = (
    "SELECT 'lineitem' AS table_name, CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) "
    "AS duplicate_row_count FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1) "
    "UNION ALL SELECT 'plain', CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate FROM lineitem)) AS BIGINT) FROM lineitem")
ORACLE["parse_rate_timestamps"] = " UNION ALL ".join(
    f"SELECT {lit(k)} AS column_name, CAST({v} AS BIGINT) AS parsed FROM orders" for k, v in {
        **dict.fromkeys(("zulu", "shifted", "millis", "nanos", "minutes", "short"), "COUNT(o_orderdate)"),
        **dict.fromkeys(("too_early", "too_late", "no_month"), "0 * COUNT(*)")}.items())
ORACLE["date_forms"] = " UNION ALL ".join(
    f"SELECT {lit(form)} AS form, COUNT(o_orderdate) AS parsed, "
    f"CAST(SUM(epoch(CAST(o_orderdate AS TIMESTAMP)) + {more}) AS BIGINT) AS seconds FROM orders" for form, more in Q.DATE_FORMS.items()
) + " UNION ALL SELECT 'none', 0, 0"
ORACLE["decimal_unique"] = (
    "SELECT 'wide' AS column_name, COUNT(DISTINCT l_orderkey) AS unique_count FROM lineitem "
    "UNION ALL SELECT 'l_quantity', COUNT(DISTINCT l_quantity) FROM lineitem")


def _targets(select: str, where: str = "TRUE") -> str:
    return _union([target_sql(t, c) + f"SELECT {select} FROM res WHERE {where}" for t, c in Q.TARGETS])


ORACLE["class_balance"] = _targets("table_name, target_column, round(class_balance_ratio, 6) AS class_balance_ratio")
ORACLE["task_inference"] = _targets(
    "table_name, target_column, inferred_type, problem_type, round(task_confidence, 6) AS task_confidence")
ORACLE["metric_choice"] = _targets("table_name, target_column, problem_type, primary_metric, secondary_metrics")
ORACLE["ambiguous_tasks"] = _targets(
    "table_name, target_column, round(task_confidence, 6) AS task_confidence", f"task_confidence < 0.85")


def _override(table: str, target: str, req: str) -> str:
    inferred = ("CASE WHEN inferred_type = 'boolean' THEN 'binary_classification' "
                "WHEN inferred_type IN ('categorical', 'numeric_discrete') THEN CASE WHEN unique_count = 2 "
                "THEN 'binary_classification' ELSE 'multiclass_classification' END "
                "WHEN inferred_type = 'numeric_continuous' THEN 'regression' END")
    same = f"({inferred}) = {lit(req)}"
    other = "inferred_type = 'numeric_discrete'"
    return profile_sql(table, None, [target]) + (
        f"SELECT {lit(table)} AS table_name, column_name AS target_column, {lit(req)} AS requested, "
        f"CASE WHEN {same} OR {other} THEN {lit(req)} END AS problem_type, "
        f"round(CASE WHEN {same} THEN 0.95 WHEN {other} THEN 1.0 END, 6) AS task_confidence, "
        f"CASE WHEN NOT ({same}) AND NOT ({other}) THEN 'TARGET_TYPE_UNSUPPORTED' END AS refusal FROM prof")


ORACLE["task_override"] = _union([_override(t, c, r) for t, c, r in Q.OVERRIDES])


def _check(table: str, target: str) -> str:

    if target not in [n for n, _ in SCHEMAS[table]]:
        return f"SELECT {lit(table)} AS table_name, {lit(target)} AS target_column, 'TARGET_NOT_FOUND' AS status"
    return profile_sql(table, None, [target]) + (
        f"SELECT {lit(table)} AS table_name, column_name AS target_column, "
        f"CASE WHEN non_null = 0 THEN 'TARGET_ALL_NULL' WHEN u_raw < 2 THEN 'TARGET_SINGLE_VALUE' "
        f"WHEN inferred_type NOT IN ('numeric_discrete', 'numeric_continuous', 'boolean', 'categorical') "
        f"THEN 'TARGET_TYPE_UNSUPPORTED' ELSE 'ok' END AS status FROM prof")


ORACLE["target_check"] = _union([_check(t, c) for t, c in Q.TARGET_CHECKS])
ORACLE["column_types"] = _union([
    profile_sql(t) + f"SELECT {lit(t)} AS table_name, column_name, inferred_type FROM prof" for t in Q.TYPED_TABLES])
ORACLE["type_boolean"] = _from_profile("orders_text", "column_name, is_boolean")
ORACLE["parse_rate_datetime"] = _from_profile(
    "orders_text", "column_name, CAST(dt_count AS BIGINT) AS parsed, round(dt_rate, 6) AS parse_rate",
    columns=["date_mixed", "date_iso", "o_orderpriority", "price_text"])
ORACLE["parse_rate_numeric"] = _from_profile(
    "orders_text", "column_name, CAST(num_count AS BIGINT) AS parsed, round(num_rate, 6) AS parse_rate",
    columns=["price_text", "date_iso", "o_orderpriority", "status_yn"])
ORACLE["effective_values"] = _from_profile(
    "orders_text",
    "column_name, inferred_type, unique_count, round(min_v, 2) AS min, round(max_v, 2) AS max, "
    "round(mean_v, 4) AS mean, round(median_v, 4) AS median, round(parse_rate, 6) AS parse_rate, flags",
    target="o_orderstatus", columns=["price_text", "o_orderstatus"], where="column_name = 'price_text'")


def _assoc(table: str, target: str, method: str | None = None) -> str:
    where = "NOT is_target" + (f" AND association_method = {lit(method)}" if method else "")
    return _from_profile(table, "column_name, round(target_association, 6) AS target_association, "
                                "association_method", target=target, where=where)


ORACLE["assoc_eta"] = _assoc("lineitem_nulls", "l_linestatus", "eta")
ORACLE["assoc_purity"] = _assoc("documents_labelled", "quality", "purity")
ORACLE["assoc_spearman"] = _assoc("lineitem_nulls", "l_extendedprice", "spearman")
ORACLE["target_association"] = _assoc("lineitem_nulls", "l_extendedprice")
ORACLE["average_rank"] = _union([
    f"WITH v AS ({view('lineitem_nulls')}) SELECT DISTINCT {lit(c)} AS column_name, {c} AS value, "
    f"round(rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0, 2) AS avg_rank "
    f"FROM v WHERE {c} IS NOT NULL" for c in ("l_quantity", "l_tax")])


def _profiles(select: str, where: str = "TRUE") -> str:
    return _union([profile_sql(t, c) + f"SELECT {lit(t)} AS table_name, {select} FROM prof WHERE {where}"
                   for t, c in Q.FLAG_PROFILES])


ORACLE["column_flags"] = _profiles("column_name, flags")
ORACLE["level_names"] = _profiles("column_name, sample_values", "sample_values IS NOT NULL")

_FINDING_RULES = [
    ("potential_leakage", "error", "list_contains(fl, 'potential_leakage')"),
    ("all_missing", "error", "list_contains(fl, 'all_missing')"),
    ("high_missing", "warning", "NOT list_contains(fl, 'all_missing') AND list_contains(fl, 'high_missing')"),
    ("constant", "warning", "list_contains(fl, 'constant')"),
    ("quasi_constant", "warning", "NOT list_contains(fl, 'constant') AND list_contains(fl, 'quasi_constant')"),
    ("numeric_as_string", "warning", "list_contains(fl, 'numeric_as_string')"),
    ("id_like", "info", "list_contains(fl, 'id_like')"),
    ("high_cardinality", "info", "NOT list_contains(fl, 'id_like') AND list_contains(fl, 'high_cardinality')"),
]
_SEV = {"error": 0, "warning": 1, "info": 2}
def _dup(t: str) -> str:
    return f"((SELECT COUNT(*) FROM v) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM v)))"


ORACLE["flag_counts"] = _union([
    profile_sql(t, c) + (
        f"SELECT {lit(t)} AS table_name, flag, COUNT(*) AS n FROM "
        f"(SELECT unnest(string_split(flags, ',')) AS flag FROM prof WHERE flags <> '') GROUP BY flag "
        f"UNION ALL SELECT {lit(t)} AS table_name, 'duplicate_rows' AS flag, {_dup(t)} AS n WHERE {_dup(t)} > 0")
    for t, c in Q.FLAG_PROFILES])
ORACLE["quality_totals"] = _union([
    profile_sql(t, c) + (
        f"SELECT {lit(t)} AS table_name, round(AVG(missing_pct), 6) AS avg_missing_pct, "
        f"round(CASE WHEN MAX(n_rows) > 0 THEN {_dup(t)} / MAX(n_rows) ELSE 0.0 END, 6) AS duplicate_pct, "
        f"CASE WHEN bool_or(list_contains(string_split(flags, ','), 'high_missing')) THEN 'error' "
        f"WHEN AVG(missing_pct) > 0 THEN 'warning' ELSE 'ok' END AS missing_tone, "
        f"CASE WHEN {_dup(t)} > 0 THEN 'warning' ELSE 'ok' END AS duplicate_tone FROM prof")
    for t, c in Q.FLAG_PROFILES])


def _shares(t: str, c: str) -> str:
    return target_sql(t, c) + (
        "SELECT table_name, target_column, round(class_balance_ratio / (1 + class_balance_ratio), 6) AS major_share, "
        "round(1 / (1 + class_balance_ratio), 6) AS minor_share, "
        "CASE WHEN len(string_split(sv, '|')) = 2 THEN split_part(sv, '|', 1) END AS major_label, "
        "CASE WHEN len(string_split(sv, '|')) = 2 THEN split_part(sv, '|', 2) END AS minor_label "
        "FROM (SELECT res.*, (SELECT sample_values FROM prof) AS sv FROM res) WHERE problem_type = 'binary_classification'")


ORACLE["class_shares"] = _union([_shares(t, c) for t, c in
                                 [("lineitem", "l_linestatus"), ("documents_labelled", "quality"),
                                  ("events_flagged", "big_error")]])

_PROFILE_SELECT = (
    "column_name, inferred_type, missing_count, round(missing_pct, 6) AS missing_pct, "
    "CAST(unique_count AS BIGINT) AS unique_count, round(unique_pct, 6) AS unique_pct, "
    "round(top_value_pct, 6) AS top_value_pct, sample_values, round(min_v, 4) AS min, round(max_v, 4) AS max, "
    "round(mean_v, 4) AS mean, round(std_v, 4) AS std, round(median_v, 4) AS median, "
    "round(parse_rate, 6) AS parse_rate, round(target_association, 6) AS target_association, "
    "association_method, flags")
for _k, (_t, _c) in Q.PROFILES.items():
    ORACLE[_k] = _from_profile(_t, _PROFILE_SELECT, target=_c)

from factsheet.functions import scalar as _S  # noqa: E402


def _case(mapping: dict, col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


_RULE_NO = {"potential_leakage": 1, "all_missing": 2, "high_missing": 2, "constant": 3, "quasi_constant": 3,
            "numeric_as_string": 4, "id_like": 5, "high_cardinality": 5}
_FILE_ORDER = {t: "CASE column_name " + " ".join(f"WHEN {lit(n)} THEN {i}" for i, (n, _) in enumerate(SCHEMAS[t])) + " END"
               for t, _ in Q.FLAG_PROFILES}
ORACLE["findings"] = _union([
    profile_sql(t, c) + f"SELECT {lit(t)} AS table_name, row_number() OVER (ORDER BY severity_rank, ordinal, rule_no) AS position, "
    "* FROM (" + " UNION ALL ".join(
        f"SELECT column_name, {_FILE_ORDER[t]} AS ordinal, {_RULE_NO[flag]} AS rule_no, {lit(sev)} AS severity, "
        f"{lit(flag)} AS flag, {_SEV[sev]} AS severity_rank, "
        + (_case(_S.METHOD_PHRASES, "association_method") if flag == "potential_leakage" else "CAST(NULL AS VARCHAR)")
        + f" AS method_phrase FROM (SELECT *, string_split(flags, ',') AS fl FROM prof) "
        f"WHERE NOT is_target AND {cond}" for flag, sev, cond in _FINDING_RULES) + ")"
    for t, c in Q.FLAG_PROFILES])


def _fill(template: str) -> str:
    head, tail = template.split("{ratio}")
    ratio = ("CASE WHEN class_balance_ratio IS NULL THEN 'an unknown ratio' ELSE "
             "'about ' || printf('%.2f', round(class_balance_ratio, 2)) || ':1' END")
    return f"{lit(head)} || {ratio} || {lit(tail)}"


ORACLE["metric_rationale"] = _targets(
    f"table_name, target_column, {_case(_S.TASK_LABELS, 'problem_type')} AS task_label, "
    f"{_case(_S.METRIC_LABELS, 'primary_metric')} AS metric_label, "
    f"CASE WHEN problem_type = 'regression' THEN {lit(_S.RATIONALE_REGRESSION)} "
    f"WHEN problem_type = 'multiclass_classification' THEN {lit(_S.RATIONALE_MULTICLASS)} "
    f"WHEN primary_metric = 'accuracy' THEN {_fill(_S.RATIONALE_ACCURACY)} "
    f"WHEN primary_metric = 'f1' THEN {_fill(_S.RATIONALE_F1)} ELSE {_fill(_S.RATIONALE_PR_AUC)} END AS rationale")
ORACLE["flag_labels"] = _profiles(
    f"column_name, flag, {_case(_S.FLAG_LABELS, 'flag')} AS label, {_case(_S.FLAG_TONES, 'flag')} AS tone, "
    f"printf('%.1f%%', round(missing_pct * 100, 1)) AS missing_text",
    "flags <> ''").replace("FROM prof WHERE flags <> ''",
                           "FROM (SELECT *, unnest(string_split(flags, ',')) AS flag FROM prof) WHERE flags <> ''")

# Association over half of the md5 buckets of the row's key, the row count over all
ORACLE["association_sample"] = profile_sql("lineitem_half", "l_linestatus") + (
    "SELECT 'dataset' AS dataset_id, column_name, association_method, "
    "round(target_association, 6) AS target_association, TRUE AS profiled_on_sample, "
    "50 AS sample_percent, (SELECT COUNT(*) FROM lineitem) AS n_rows FROM prof")


ORACLE["dataset_profile"] = _union([
    target_sql(t, c) + (
        f"SELECT table_name, target_column, (SELECT COUNT(*) FROM v) AS n_rows, "
        f"(SELECT COUNT(*) FROM (DESCRIBE v)) AS n_columns, problem_type, CAST(task_confidence AS DOUBLE) AS task_confidence, "
        f"primary_metric, secondary_metrics, round(class_balance_ratio, 6) AS class_balance_ratio, "
        f"(SELECT COUNT(*) FROM v) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM v)) AS duplicate_row_count FROM res")
    for t, c in Q.DATASET_PROFILES])
