"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark plans: plain SQL aggregates, window ranks
and scalar subqueries per column, over the same views the queries read.
The SQL for the per-column profile is generated from the view's column list
(one CTE per column, then a union), since SQL has no unpivot over mixed types.
Targets in these oracles are never text-coerced numbers.
"""

from __future__ import annotations

from factsheet import thresholds as T
from factsheet.functions.scalar import DATETIME_PATTERNS_STRFTIME, NUMBER_RE, _INF_RE

# --- views (the same derivations as factsheet.plans.inputs) ----------------------
VIEWS = {
    "lineitem_nulls": (
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
        "CASE WHEN l_linenumber > 4 THEN l_tax END AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem"),
    "documents_labelled": (
        "SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic "
        "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "orders_text": (
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, "
        "'$' || format('{:,.2f}', o_totalprice) AS price_text, "
        "CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') "
        "WHEN '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y') "
        "WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%B %-d, %Y') "
        "WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y%m%d') ELSE o_orderpriority END AS date_mixed, "
        "strftime(o_orderdate, '%Y-%m-%d') AS date_iso, "
        "CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END AS status_yn, "
        "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS status_01, "
        "CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey < 5 THEN 'F' ELSE o_orderstatus END AS leak "
        "FROM orders"),
    "lineitem_half": (
        "SELECT * FROM lineitem WHERE CAST(('0x' || substr(md5(l_orderkey || '-' || l_linenumber), 1, 8)) AS BIGINT)"
        " % 100 < 50"),
    "events_flagged": (
        "SELECT event_id, ts, user_id, event_type, value, props, "
        "CAST(event_type = 'error' AND value > 100 AS INTEGER) AS big_error FROM events"),
}

I, Fl, S, D, C = "integral", "floating", "string", "datetime", "complex"
SCHEMAS = {
    "orders": [("o_orderkey", I), ("o_custkey", I), ("o_orderstatus", S), ("o_totalprice", Fl),
               ("o_orderdate", D), ("o_orderpriority", S)],
    "lineitem": [("l_orderkey", I), ("l_partkey", I), ("l_suppkey", I), ("l_linenumber", I),
                 ("l_quantity", Fl), ("l_extendedprice", Fl), ("l_discount", Fl), ("l_tax", Fl),
                 ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", D)],
    "customer": [("c_custkey", I), ("c_name", S), ("c_nationkey", I), ("c_acctbal", Fl), ("c_mktsegment", S)],
    "part": [("p_partkey", I), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
             ("p_retailprice", Fl)],
    "events": [("event_id", I), ("ts", D), ("user_id", I), ("event_type", S), ("value", Fl), ("props", S)],
    "nation": [("n_nationkey", I), ("n_name", S), ("n_regionkey", I)],
    "region": [("r_regionkey", I), ("r_name", S)],
    "embeddings": [("vec_id", I), ("embedding", C), ("label", I)],
    "conversations": [("conv_id", I), ("turn", I), ("role", S), ("text", S)],
}
SCHEMAS["lineitem_nulls"] = SCHEMAS["lineitem_half"] = SCHEMAS["lineitem"]
SCHEMAS["documents_labelled"] = [("doc_id", I), ("lang", S), ("source", S), ("n_chars", I), ("text", S),
                                 ("quality", I), ("toxic", I)]
SCHEMAS["orders_text"] = [("o_orderkey", I), ("o_custkey", I), ("o_orderstatus", S), ("o_totalprice", Fl),
                          ("o_orderpriority", S), ("price_text", S), ("date_mixed", S), ("date_iso", S),
                          ("status_yn", S), ("status_01", I), ("leak", S)]
SCHEMAS["events_flagged"] = SCHEMAS["events"] + [("big_error", I)]


def view(name: str) -> str:
    return VIEWS.get(name, f"SELECT * FROM {name}")


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NUMERIC = (I, Fl, "decimal")


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def parsed_number(x: str) -> str:
    cleaned = f"regexp_replace({x}, '[,$£€¥%\\s]', '', 'g')"
    d = f"TRY_CAST({cleaned} AS DOUBLE)"
    return (f"(CASE WHEN regexp_matches({cleaned}, {lit(NUMBER_RE)}) AND (isfinite({d}) OR "
            f"regexp_matches({cleaned}, {lit(_INF_RE)})) THEN {d} END)")


def parsed_datetime(x: str) -> str:
    t = _trim(x)
    fmts = "[" + ", ".join(lit(f) for f in DATETIME_PATTERNS_STRFTIME) + "]"
    year = (f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}$') AND TRY_CAST({t} AS INTEGER) BETWEEN 1678 AND 2261 "
            f"THEN make_timestamp(TRY_CAST({t} AS BIGINT), 1, 1, 0, 0, 0) END")
    return (f"(CASE WHEN regexp_matches({t}, '[0-9]{{4}}') THEN "
            f"coalesce(try_strptime({t}, {fmts}), {year}) END)")


def bool_test(x: str, storage: str) -> str:
    if storage == "boolean":
        return "TRUE"
    if storage in NUMERIC:
        return f"(COUNT({x}) > 0 AND COUNT(*) FILTER (WHERE {x} IS NOT NULL AND {x} NOT IN (0, 1)) = 0)"
    if storage == S:
        norm = f"lower({_trim(x)})"
        tests = [f"COUNT(*) FILTER (WHERE {x} IS NOT NULL AND {norm} NOT IN ({lit(a)}, {lit(b)})) = 0"
                 for a, b in T.BOOLEAN_VOCABULARIES]
        return f"(COUNT({x}) > 0 AND ({' OR '.join(tests)}))"
    return "FALSE"


def num_expr(x: str, storage: str) -> str:
    if storage in NUMERIC:
        return f"CAST({x} AS DOUBLE)"
    if storage == S:
        return parsed_number(x)
    return "CAST(NULL AS DOUBLE)"


def raw_expr(x: str, storage: str) -> str:
    return f"CAST({x} AS VARCHAR)" if storage == C else x


def _eta(x: str, g: str) -> str:
    """Correlation ratio of x by group g over rows of v where both are present."""
    p = f"(SELECT {x} AS x, {g} AS g FROM v WHERE {x} IS NOT NULL AND {g} IS NOT NULL)"
    return (f"(SELECT CASE WHEN n >= 2 AND k >= 2 AND mn < mx AND tot > 0 "
            f"THEN sqrt(greatest(0.0, least(1.0, bss / tot))) END FROM ("
            f"SELECT COUNT(*) AS n, COUNT(DISTINCT g) AS k, MIN(x) AS mn, MAX(x) AS mx, "
            f"(SELECT SUM(cnt * (gm - (SELECT AVG(x) FROM {p})) ^ 2) FROM "
            f"(SELECT COUNT(*) AS cnt, AVG(x) AS gm FROM {p} GROUP BY g)) AS bss, "
            f"(SELECT SUM((x - (SELECT AVG(x) FROM {p})) ^ 2) FROM {p}) AS tot FROM {p}))")


def _purity(lv: str, cls: str) -> str:
    p = f"(SELECT {lv} AS lv, {cls} AS cls FROM v WHERE {lv} IS NOT NULL AND {cls} IS NOT NULL)"
    return (f"(SELECT CASE WHEN n >= 2 AND k >= 2 AND cmax < n THEN greatest(0.0, least(1.0, "
            f"(maj / n - cmax / n) / (1.0 - cmax / n))) END FROM ("
            f"SELECT (SELECT COUNT(*) FROM {p}) AS n, "
            f"(SELECT COUNT(DISTINCT cls) FROM {p}) AS k, "
            f"(SELECT MAX(c) FROM (SELECT COUNT(*) AS c FROM {p} GROUP BY cls)) AS cmax, "
            f"(SELECT SUM(m) FROM (SELECT MAX(c) AS m FROM (SELECT lv, COUNT(*) AS c FROM {p} GROUP BY lv, cls) "
            f"GROUP BY lv)) AS maj))")


def _spearman(x: str, y: str) -> str:
    p = f"(SELECT {x} AS x, {y} AS y FROM v WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return (f"(SELECT CASE WHEN COUNT(*) >= 2 AND COUNT(DISTINCT x) >= 2 AND COUNT(DISTINCT y) >= 2 "
            f"THEN abs(corr(rx, ry)) END FROM (SELECT x, y, "
            f"rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, "
            f"rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM {p}))")


def _column_cte(i: int, name: str, storage: str, target: tuple | None) -> str:
    x = q(name)
    raw = raw_expr(x, storage)
    num = num_expr(x, storage)
    dt = f"COUNT({parsed_datetime(x)})" if storage == S else "CAST(NULL AS BIGINT)"
    numcnt = f"COUNT({num})"
    top_raw = f"(SELECT MAX(k) FROM (SELECT COUNT(*) AS k FROM v WHERE {x} IS NOT NULL GROUP BY {raw}))"
    top_num = f"(SELECT MAX(k) FROM (SELECT COUNT(*) AS k FROM (SELECT {num} AS z FROM v) WHERE z IS NOT NULL GROUP BY z))"
    levels = (f"(SELECT string_agg(substr(lv, 1, {T.SAMPLE_VALUE_MAX_CHARS}), '|' ORDER BY k DESC, lv) FROM "
              f"(SELECT CAST({x} AS VARCHAR) AS lv, COUNT(*) AS k FROM v WHERE {x} IS NOT NULL GROUP BY 1 "
              f"ORDER BY k DESC, lv LIMIT {T.SAMPLE_VALUES_TOP}))")
    assoc = ("CAST(NULL AS DOUBLE) AS a_eta_num, CAST(NULL AS DOUBLE) AS a_purity, "
             "CAST(NULL AS DOUBLE) AS a_spearman, CAST(NULL AS DOUBLE) AS a_eta_cat")
    if target is not None and name != target[0] and storage in (*NUMERIC, S, "boolean"):
        tx = q(target[0])
        tnum = num_expr(tx, target[1]) if target[1] in NUMERIC else "CAST(NULL AS DOUBLE)"
        assoc = (f"{_eta(num, tx)} AS a_eta_num, {_purity(x, tx)} AS a_purity, "
                 f"{_spearman(num, tnum)} AS a_spearman, {_eta(tnum, x)} AS a_eta_cat")
    return (
        f"c{i} AS (SELECT {lit(name)} AS column_name, {i} AS ordinal, {lit(storage)} AS storage, "
        f"COUNT(*) AS n_rows, COUNT({x}) AS non_null, {bool_test(x, storage)} AS is_boolean, "
        f"{dt} AS dt_count, {numcnt} AS num_count, COUNT(DISTINCT {raw}) AS u_raw, COUNT(DISTINCT {num}) AS u_num, "
        f"{top_raw} AS top_raw, {top_num} AS top_num, "
        f"MIN({num}) AS nmin, MAX({num}) AS nmax, AVG({num}) AS nmean, "
        f"CASE WHEN COUNT({num}) = 1 THEN 0.0 ELSE stddev_samp({num}) END AS nstd, "
        f"median({num}) AS nmedian, {levels} AS levels, {assoc} FROM v)")


def profile_sql(table: str, target: str | None = None, columns: list[str] | None = None) -> str:
    """Per-column profile rows of a table (or view) as one SQL statement."""
    cols = [(n, s) for n, s in SCHEMAS[table] if columns is None or n in columns]
    tgt = next(((n, s) for n, s in cols if n == target), None) if target else None
    ctes = [_column_cte(i, n, s, tgt) for i, (n, s) in enumerate(cols)]
    union = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(cols)))
    pr = T.PARSE_RATE
    stage = (f"CASE WHEN non_null = 0 THEN 'unknown' WHEN is_boolean THEN 'boolean' "
             f"WHEN storage IN ('integral', 'floating', 'decimal') THEN 'numeric' "
             f"WHEN storage = 'datetime' THEN 'datetime' WHEN storage IN ('complex', 'binary') THEN 'unknown' "
             f"WHEN dt_count / non_null >= {pr} THEN 'datetime' WHEN num_count / non_null >= {pr} THEN 'coerced' "
             f"ELSE 'string' END")
    tname = lit(target) if target else "NULL"
    sql = f"""WITH v AS ({view(table)}), {', '.join(ctes)},
s0 AS ({union}),
s1 AS (SELECT *, {stage} AS stage FROM s0),
s2 AS (SELECT *,
  CASE WHEN stage = 'coerced' THEN u_num WHEN non_null = 0 THEN 0 ELSE u_raw END AS unique_count,
  CASE WHEN stage = 'coerced' THEN top_num ELSE top_raw END AS top_n,
  CASE WHEN stage = 'coerced' THEN num_count ELSE non_null END AS eff_non_null,
  column_name = {tname} AS is_target FROM s1),
s3 AS (SELECT *,
  CASE WHEN stage IN ('numeric', 'coerced') THEN
         CASE WHEN unique_count <= {T.NUMERIC_DISCRETE_MAX_UNIQUE} THEN 'numeric_discrete' ELSE 'numeric_continuous' END
       WHEN stage = 'string' THEN CASE WHEN unique_count / n_rows >= {T.ID_UNIQUENESS} THEN 'text' ELSE 'categorical' END
       ELSE stage END AS inferred_type,
  CAST(n_rows - non_null AS BIGINT) AS missing_count,
  CASE WHEN n_rows > 0 THEN (n_rows - non_null) / n_rows END AS missing_pct,
  CASE WHEN n_rows > 0 THEN unique_count / n_rows ELSE 0.0 END AS unique_pct,
  CASE WHEN eff_non_null > 0 THEN top_n / eff_non_null END AS top_value_pct,
  CASE WHEN stage = 'datetime' AND storage = 'string' THEN dt_count / non_null
       WHEN stage = 'datetime' THEN 1.0 WHEN stage = 'coerced' THEN num_count / non_null END AS parse_rate,
  dt_count / non_null AS dt_rate, num_count / non_null AS num_rate FROM s2),
tg AS (SELECT CASE WHEN inferred_type = 'boolean' THEN 'binary_classification'
    WHEN inferred_type IN ('categorical', 'numeric_discrete') THEN
      CASE WHEN unique_count = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END
    WHEN inferred_type = 'numeric_continuous' THEN 'regression' END AS task FROM s3 WHERE is_target),
s4 AS (SELECT s3.*, (SELECT task FROM tg) AS task FROM s3),
s5 AS (SELECT *,
  CASE WHEN is_target OR task IS NULL THEN NULL
       WHEN inferred_type IN ('numeric_discrete', 'numeric_continuous') AND task = 'regression' THEN a_spearman
       WHEN inferred_type IN ('numeric_discrete', 'numeric_continuous') THEN a_eta_num
       WHEN inferred_type IN ('boolean', 'categorical') AND task = 'regression' THEN a_eta_cat
       WHEN inferred_type IN ('boolean', 'categorical') THEN a_purity END AS target_association,
  CASE WHEN inferred_type IN ('numeric_discrete', 'numeric_continuous') AND task = 'regression' THEN 'spearman'
       WHEN inferred_type IN ('numeric_discrete', 'numeric_continuous') THEN 'eta'
       WHEN inferred_type IN ('boolean', 'categorical') AND task = 'regression' THEN 'eta'
       WHEN inferred_type IN ('boolean', 'categorical') THEN 'purity' END AS method0 FROM s4),
s6 AS (SELECT *,
  CASE WHEN target_association IS NULL THEN 'none' ELSE method0 END AS association_method,
  CASE WHEN non_null = 0 THEN 'all_missing' ELSE concat_ws(',',
    CASE WHEN stage = 'coerced' THEN 'numeric_as_string' END,
    CASE WHEN missing_pct > {T.HIGH_MISSING_P} THEN 'high_missing' END,
    CASE WHEN unique_count = 1 THEN 'constant'
         WHEN NOT is_target AND top_value_pct >= {T.QUASI_CONSTANT_P} THEN 'quasi_constant' END,
    CASE WHEN unique_pct >= {T.ID_UNIQUENESS} THEN 'id_like' END,
    CASE WHEN inferred_type = 'categorical' AND (unique_count > {T.HIGH_CARD_ABS} OR unique_pct > {T.HIGH_CARD_REL})
         THEN 'high_cardinality' END,
    CASE WHEN target_association > {T.LEAKAGE_R} THEN 'potential_leakage' END) END AS flags FROM s5),
prof AS (SELECT *,
  CASE WHEN inferred_type = 'categorical' AND unique_count <= {T.SAMPLE_VALUES_MAX_UNIQUE}
        AND NOT contains(flags, 'id_like') AND NOT contains(flags, 'high_cardinality') THEN levels END AS sample_values,
  CASE WHEN inferred_type IN ('numeric_discrete', 'numeric_continuous') THEN nmin END AS min_v,
  CASE WHEN inferred_type IN ('numeric_discrete', 'numeric_continuous') THEN nmax END AS max_v,
  CASE WHEN inferred_type IN ('numeric_discrete', 'numeric_continuous') THEN nmean END AS mean_v,
  CASE WHEN inferred_type IN ('numeric_discrete', 'numeric_continuous') THEN nstd END AS std_v,
  CASE WHEN inferred_type IN ('numeric_discrete', 'numeric_continuous') THEN nmedian END AS median_v
  FROM s6)
"""
    return sql


def target_sql(table: str, target: str) -> str:
    """Dataset-level outcome for one target: type, task, confidence, ratio, metrics."""
    base = profile_sql(table, None, [target])
    ratio = (f"(SELECT CASE WHEN COUNT(*) >= 2 THEN MAX(k) / MIN(k) END FROM "
             f"(SELECT COUNT(*) AS k FROM v WHERE {q(target)} IS NOT NULL GROUP BY {q(target)}))")
    return base + f""", t1 AS (SELECT inferred_type,
  CASE WHEN inferred_type = 'boolean' THEN 'binary_classification'
    WHEN inferred_type IN ('categorical', 'numeric_discrete') THEN
      CASE WHEN unique_count = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END
    WHEN inferred_type = 'numeric_continuous' THEN 'regression' END AS problem_type,
  CASE WHEN inferred_type = 'numeric_discrete' THEN {T.TASK_CONFIDENCE_DISCRETE_AMBIGUOUS}
       ELSE {T.TASK_CONFIDENCE_TYPE_MATCH} END AS task_confidence FROM prof),
t2 AS (SELECT *, CASE WHEN problem_type <> 'regression' THEN {ratio} END AS class_balance_ratio FROM t1),
t3 AS (SELECT *, CASE WHEN problem_type = 'regression' THEN 'rmse'
    WHEN problem_type = 'multiclass_classification' THEN 'f1_macro'
    WHEN class_balance_ratio <= {T.BALANCE_ACCURACY_MAX} THEN 'accuracy'
    WHEN class_balance_ratio <= {T.BALANCE_F1_MAX} THEN 'f1' ELSE 'pr_auc' END AS primary_metric FROM t2),
res AS (SELECT {lit(table)} AS table_name, {lit(target)} AS target_column, *,
  CASE WHEN problem_type = 'regression' THEN 'mae,r2'
       WHEN problem_type = 'multiclass_classification' THEN 'accuracy'
       ELSE concat_ws(',', CASE WHEN primary_metric <> 'accuracy' THEN 'accuracy' END,
                      CASE WHEN primary_metric <> 'f1' THEN 'f1' END,
                      CASE WHEN primary_metric <> 'pr_auc' THEN 'pr_auc' END, 'roc_auc') END AS secondary_metrics
  FROM t3)
"""


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)
