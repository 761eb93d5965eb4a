"""Every threshold and vocabulary the profiler reads.

FIXED VALUES: the numbers, word lists and patterns below must equal the
reference behaviour for results to agree. They are stated once, here, in
their natural order; no other module carries a magic number.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: thresholds ------------------------------------------------
HIGH_MISSING_P = 0.5                 # missing share strictly above -> high_missing
ID_UNIQUENESS = 0.99                 # distinct / rows at or above -> id_like (and text rung)
HIGH_CARD_ABS = 50                   # categorical distinct strictly above -> high_cardinality
HIGH_CARD_REL = 0.5                  # categorical distinct / rows strictly above -> high_cardinality
QUASI_CONSTANT_P = 0.99              # top-value share at or above -> quasi_constant
PARSE_RATE = 0.90                    # datetime / numeric parse share at or above -> coerce
NUMERIC_DISCRETE_MAX_UNIQUE = 20     # distinct at or below -> numeric_discrete
SAMPLE_VALUES_MAX_UNIQUE = 20        # categorical distinct at or below -> level names shown
SAMPLE_VALUES_TOP = 5                # at most this many level names
SAMPLE_VALUE_MAX_CHARS = 40          # each level name cut to this length
LEAKAGE_R = 0.98                     # association strictly above -> potential_leakage
MAX_COLS = 1000                      # the usual column limit (1000 passes, 1001 refused), where a caller asks for one
SIMILARITY_CUTOFF = 0.85             # near-miss column name ratio at or above
BALANCE_ACCURACY_MAX = 1.5           # binary ratio at or below -> accuracy
BALANCE_F1_MAX = 10.0                # binary ratio at or below -> f1, else pr_auc
TARGET_SKEW_THRESHOLD = 2.0          # |bias-corrected skew| strictly above -> advisory
PROMPT_MAX_COLUMNS = 200             # column budget
TASK_CONFIDENCE_TYPE_MATCH = 0.95
TASK_CONFIDENCE_DISCRETE_AMBIGUOUS = 0.65
AMBIGUOUS_CONFIDENCE_BELOW = 0.85    # confidence strictly below and not overridden -> ambiguous
DATASET_TTL_HOURS = 24
RARE_LEVEL_MIN_ROWS = 20             # one-hot: levels with fewer rows are grouped
TARGET_ENCODE_SMOOTHING = 20.0       # target encoding: weight of the prior mean

# --- fixed values: vocabularies ----------------------------------------------
# Boolean vocabularies: normalised levels must be a non-empty subset of one pair.
BOOLEAN_VOCABULARIES = (
    ("true", "false"),
    ("1", "0"),
    ("yes", "no"),
    ("y", "n"),
    ("t", "f"),
)

# Characters removed before a text value is tried as a number
# (comma, dollar, pound, euro, yen, percent, any Unicode whitespace).
NUMBER_CLEAN_CHARS = ",$£€¥%"

# Text read as missing by the CSV scan (the default CSV null tokens).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Logical types, tasks, metrics, flags, association methods, severities.
TYPES = ("boolean", "datetime", "numeric_discrete", "numeric_continuous",
         "categorical", "text", "unknown")
TASKS = ("binary_classification", "multiclass_classification", "regression")
METRICS = ("accuracy", "f1", "f1_macro", "pr_auc", "roc_auc", "rmse", "mae", "r2")
FLAGS = ("all_missing", "high_missing", "constant", "quasi_constant", "id_like",
         "high_cardinality", "numeric_as_string", "potential_leakage")
ASSOCIATION_METHODS = ("spearman", "eta", "purity", "none")
SEVERITIES = ("error", "warning", "info")


@dataclass(frozen=True)
class Thresholds:
    """The subset of thresholds a caller may tune per profile run."""

    high_missing_p: float = HIGH_MISSING_P
    id_uniqueness: float = ID_UNIQUENESS
    high_card_abs: int = HIGH_CARD_ABS
    high_card_rel: float = HIGH_CARD_REL
    quasi_constant_p: float = QUASI_CONSTANT_P
    parse_rate: float = PARSE_RATE
    discrete_max_unique: int = NUMERIC_DISCRETE_MAX_UNIQUE
    sample_values_max_unique: int = SAMPLE_VALUES_MAX_UNIQUE
    leakage_r: float = LEAKAGE_R


DEFAULTS = Thresholds()
