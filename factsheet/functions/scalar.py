"""Scalar column expressions (all JVM-side, inside whole-stage codegen).

G1 boolean-text normalisation, G2/G3 number cleaning and parsing, G4 datetime
parsing, G5 truncation, G9 percent text, G12 time cutoff.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsheet import thresholds as T

# Every character Python's str.isspace() accepts (what str.strip() removes):
# ASCII whitespace, the four information separators, NEL, NBSP and the
# Unicode space separators. Listed so plain Java regex classes and btrim can
# be used instead of the slower Unicode-aware regex mode.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
              "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WS_CLASS = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_TRIM_RE = f"^[{WS_CLASS}]+|[{WS_CLASS}]+$"
_CLEAN_RE = "[" + re.escape(T.NUMBER_CLEAN_CHARS).replace("\\%", "%") + WS_CLASS + "]"

# A decimal literal with optional sign and exponent, or an infinity word.
# Anything else (hex, '1d', '1f', '1_000', '(5)') is not a number.
NUMBER_RE = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
_INF_RE = r"^[+-]?(?i:inf|infinity)$"

# What every number begins with, up to its 64th character: any other text is none, told without cleaning it.
MAY_BE_NUMBER = "^[0-9.eE+\\-iInNfFtTyY" + re.escape(T.NUMBER_CLEAN_CHARS).replace("\\%", "%") + WS_CLASS + "]*$"

# Year-first dates with dashes: optional time (seconds, 1 to 9 fraction digits) and optional
# zone. Spark's own cast reads them; fractions beyond microseconds are cut.
ISO_SHAPE = (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?"
             r"( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?$")
# The instants that a 64-bit count of nanoseconds around 1970 can hold; others are not dates here.
EARLIEST, LATEST = "1677-09-21 00:12:44", "2262-04-11 23:47:16"
# A text with none of these is no date: four digits, a number after a slash or dash, a clock, a month.
DATE_HINT = r"(?i)^(?=.*[0-9])(?=.*([0-9]{4}|[0-9][/-][0-9]|[0-9] ?[ap]m\b|:|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))[0-9a-z:/.,+ -]{1,40}$"
# The time at a text's end: hour, minute, second, fraction, meridiem (with or without minutes), zone.
TIME_TAIL = (r"(?:^|(?<=[0-9])t|[ ,]+)([0-9]{1,2})(?::([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,9}))?)?(?: ?([ap])m)?| ?([ap])m)"
             r"(?: ?(z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}))?$")
# FIXED VALUES: month names and their short forms; weekday names, which say nothing here.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: The tokens before the time, by kind: Y four digits, N one or two, M a month's name, D eight digits. What the
#: slots year, month and day take: the place of a token, or -1.
SLOTS = {"YNN": (0, 1, 2), "NNY": (2, 0, 1), "NMY": (2, 1, 0), "MNY": (2, 0, 1), "YMN": (0, 1, 2), "YNM": (0, 2, 1),
         "MY": (1, 0, -1), "YM": (0, 1, -1), "Y": (0, -1, -1), "": (-1, -1, -1),
         "NMN": (2, 1, 0), "MNN": (2, 0, 1), "NNN": (2, 0, 1), "YN": (0, 1, -1), "NY": (1, 0, -1)}
#: These kinds are dates only when slashes or dashes stand between the numbers.
NUMBERS_ONLY = ("NNN", "NY")
#: The day that a clock time without a date is put on; a month or day that isn't told is the first.
NO_DATE = (1970, 1, 1)
# The same grammar in strftime notation, for SQL oracles.
DATETIME_PATTERNS_STRFTIME = (
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S.%f",
    "%Y/%m/%d",
    "%m/%d/%Y",
    "%d/%m/%Y",
    "%m-%d-%Y",
    "%m.%d.%Y",
    "%d %b %Y",
    "%d %B %Y",
    "%b %d, %Y",
    "%B %d, %Y",
    "%b %Y",
    "%B %Y",
    "%Y%m%d",
)
BARE_YEAR_MIN, BARE_YEAR_MAX = 1678, 2261


def col_(c: str | Column) -> Column:
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


#: Texts up to this length are keys as they are; longer ones are keyed by their SHA-256 digest.
TEXT_KEY_CHARS = 64


def is_long(c: Column) -> Column:
    return F.coalesce(F.length(c) > TEXT_KEY_CHARS, F.lit(False))


def text_key(c: Column) -> Column:
    """What stands for a text in shuffles and comparisons: never longer than a digest."""
    return F.when(is_long(c), F.sha2(c, 256)).otherwise(c)


def strip(c: str | Column) -> Column:
    """Remove leading and trailing whitespace (Python's definition of it)."""
    return F.btrim(col_(c).cast("string"), F.lit(WHITESPACE))


def strip_fold(c: str | Column) -> Column:
    """G1: Unicode strip then lower-case (casefold for the vocabularies used)."""
    return F.lower(strip(c))


def clean_number_text(c: str | Column) -> Column:
    """Drop , $ £ € ¥ % and every Unicode space; '%' is not rescaled."""
    return F.regexp_replace(col_(c).cast("string"), _CLEAN_RE, "")


def parse_number(c: str | Column) -> Column:
    """Text -> double, null when the cleaned text is not a plain number.

    Overflowing literals such as 1e400 are refused; written infinities pass.
    """
    text = col_(c).cast("string")
    s = clean_number_text(c)
    d = s.cast("double")
    finite = (F.abs(d) != F.lit(float("inf")))
    return F.when(F.substring(text, 1, 64).rlike(MAY_BE_NUMBER) & s.rlike(NUMBER_RE) & (finite | s.rlike(_INF_RE)), d)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _month(word: Column) -> Column:
    names = {n: k + 1 for k, n in enumerate(MONTHS)} | {n[:3]: k + 1 for k, n in enumerate(MONTHS)} | {"sept": 9}
    return F.element_at(F.expr(f"map({', '.join(f'{n!r}, {k}' for n, k in names.items())})"), word)


def _kind(token: Column) -> Column:
    return (F.when(token.rlike("^[0-9]{4}$"), "Y").when(token.rlike("^[0-9]{1,2}$"), "N").when(token.rlike("^[0-9]{8}$"), "D")
            .when(_month(token).isNotNull(), "M").otherwise("x"))


def _slots(date: Column) -> Column:
    """Year, month and day of the lower-cased text before the time; null where its tokens fit no slots."""
    plain = F.regexp_replace(date, "(?<=[0-9])(st|nd|rd|th)\\b", "")
    days = [w for n in WEEKDAYS for w in (n, n[:3])]
    words = F.filter(F.regexp_extract_all(plain, F.lit("([0-9]+|[a-z]+)"), F.lit(1)), lambda t: ~F.array_contains(F.lit(days), t))
    table = F.expr(f"map({', '.join(f'{k!r}, array{v}' for k, v in SLOTS.items())})")

    def filled(x: Column) -> Column:
        tokens, kinds = x["tokens"], x["kinds"]
        at = F.element_at(table, kinds)
        number = lambda slot: F.coalesce(_month(F.get(tokens, at[slot])), F.get(tokens, at[slot]).try_cast("int"))
        year = number(0)
        # two digits: 69 to 99 are of the last century
        year = F.when(F.length(F.get(tokens, at[0])) <= 2, year + F.when(year >= 69, 1900).otherwise(2000)).otherwise(year)
        month, day = number(1), number(2)
        swap = kinds.isin("NNY", "NNN") & (month > 12)  # month first, unless it can't be one
        whole = F.get(tokens, F.lit(0))
        parts = F.when(kinds == "D", F.array(*[F.substring(whole, p, n).cast("int") for p, n in ((1, 4), (5, 2), (7, 2))])).otherwise(
            F.array(F.when(at[0] >= 0, year).otherwise(NO_DATE[0]), F.when(at[1] < 0, NO_DATE[1]).when(swap, day).otherwise(month),
                    F.when(at[2] < 0, NO_DATE[2]).when(swap, month).otherwise(day)))
        fits = (F.when(kinds.isin(*NUMBERS_ONLY), date.rlike("^[0-9]+([/-][0-9]+)+$"))
                .when(kinds == "Y", year.between(BARE_YEAR_MIN, BARE_YEAR_MAX)).otherwise((kinds == "D") | at.isNotNull()))
        return F.when(fits & date.rlike("^[0-9a-z]*([-/., ]+[0-9a-z]+)*[., ]*$"), parts)

    return _let(words, lambda t: _let(F.struct(t.alias("tokens"), F.array_join(F.transform(t, _kind), "").alias("kinds")), filled))


def _free_datetime(text: Column) -> Column:
    """A lower-cased text as date tokens and a time, assigned to slots by ``SLOTS``."""
    def put(x: Column) -> Column:
        day, clock = x["day"], x["clock"]
        field = lambda k: F.nullif(F.get(clock, F.lit(k)), F.lit(""))
        half = F.coalesce(field(4), field(5))
        hour = F.coalesce(field(0).cast("int"), F.lit(0))
        hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        second = F.concat(F.coalesce(field(2), F.lit("0")), F.lit("."), F.substring(F.coalesce(field(3), F.lit("0")), 1, 6)).cast("decimal(8,6)")
        at = F.try_make_timestamp(day[0], day[1], day[2], hour, F.coalesce(field(1).cast("int"), F.lit(0)), second)
        zone = F.regexp_extract(F.coalesce(field(6), F.lit("")), "([+-][0-9]{2}):?([0-9]{2})", 0)
        sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
        shift = F.make_dt_interval(F.lit(0), sign * F.substring(zone, 2, 2).cast("int"), sign * F.substring(F.replace(zone, F.lit(":"), F.lit("")), 4, 2).cast("int"), F.lit(0))
        dated = x["date"] != ""
        return F.when(dated | field(1).isNotNull(), F.when(zone == "", at).otherwise(at - shift))

    def parts(date: Column) -> Column:
        tail = F.substr(text, F.length(date) + 1)
        clock = F.split(F.regexp_replace(tail, TIME_TAIL.replace("(?<=[0-9])t", "t"), "$1|$2|$3|$4|$5|$6|$7"), "\\|")
        has = F.length(tail) > 0
        day = F.when((date != "") | has, _slots(F.btrim(date, F.lit(", "))))
        return _let(F.struct(day.alias("day"), F.when(has, clock).alias("clock"), F.btrim(date, F.lit(", ")).alias("date")), put)

    return _let(F.regexp_replace(text, TIME_TAIL, ""), parts)


def parse_datetime(c: str | Column) -> Column:
    """Text -> timestamp, month first where a date can be read both ways, else null.

    Year-first dates are read by Spark's own cast. Others are cut into tokens (numbers, month
    names, time, meridiem, zone) whose kinds together say which slot each one fills (``SLOTS``),
    so separators, month names, clocks and zones combine freely. A clock time with minutes but no date is put
    on the day ``NO_DATE``; an hour alone, and a date without a year, are no instants. Weekday names are skipped.
    """
    s = strip(c)
    iso = F.when(s.rlike(ISO_SHAPE), F.try_to_timestamp(s))
    parsed = F.coalesce(iso, F.when(s.rlike(DATE_HINT), _free_datetime(F.lower(s))))
    return F.when(parsed.between(F.lit(EARLIEST).cast("timestamp"), F.lit(LATEST).cast("timestamp")), parsed)


def percent_text(x: str | Column) -> Column:
    """Share as percent text with one decimal (half up), e.g. 0.5734 -> '57.3%'."""
    return F.format_string("%.1f%%", F.round(col_(x) * 100.0, 1))


def md5_bucket(key: Column, buckets: int) -> Column:
    """A stable bucket in [0, buckets) from the md5 of the key's text (same in any engine)."""
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(buckets)).cast("int")


def cutoff(as_of: str | Column, hours: int = T.DATASET_TTL_HOURS) -> Column:
    """as_of minus the TTL, in UTC."""
    ts = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return ts - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0))


# --- display text (G9, G10, G11) ---------------------------------------------
# FIXED VALUES: display labels for metrics, tasks, flags and flag tones.
METRIC_LABELS = {
    "accuracy": "Accuracy",
    "f1": "F1 Score",
    "f1_macro": "F1 Macro",
    "pr_auc": "PR-AUC",
    "roc_auc": "ROC-AUC",
    "rmse": "RMSE",
    "mae": "MAE",
    "r2": "R²",
}
METHOD_PHRASES = {
    "spearman": "rank association",
    "eta": "eta association",
    "purity": "purity association",
    "none": "association",
}
TASK_LABELS = {
    "binary_classification": "Binary classification",
    "multiclass_classification": "Multiclass classification",
    "regression": "Regression",
}
FLAG_TONES = {
    "potential_leakage": "error",
    "all_missing": "error",
    "high_missing": "warning",
    "quasi_constant": "warning",
    "constant": "warning",
    "numeric_as_string": "warning",
    "id_like": "neutral",
    "high_cardinality": "neutral",
}
FLAG_LABELS = {
    "potential_leakage": "possible leakage",
    "all_missing": "all missing",
    "high_missing": "high missing",
    "quasi_constant": "quasi-constant",
    "constant": "constant",
    "numeric_as_string": "numeric as string",
    "id_like": "id-like",
    "high_cardinality": "high cardinality",
}
RATIONALE_REGRESSION = "A number is predicted, so the score is the typical size of the error, in the unit of the target."
RATIONALE_MULTICLASS = "There are three or more classes, so the score is the mean of one score per class, each weighing the same."
RATIONALE_ACCURACY = "Both classes are about equally common ({ratio}): always guessing one of them gains little, so accuracy is fair."
RATIONALE_F1 = "One class is rarer ({ratio}): F1 asks that its rows are found and that few others are taken for them."
RATIONALE_PR_AUC = "One class is very rare ({ratio}): PR-AUC judges how well its rows are ranked first, whatever the cut-off."


def map_lookup(mapping: dict[str, str], key: Column) -> Column:
    """A literal map lookup (a tiny dimension folded into the expression)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), key)


def metric_rationale(task: Column, metric: Column, ratio: Column) -> Column:
    """Why the primary metric was chosen, with the class ratio to two decimals."""
    ratio_text = F.when(ratio.isNull(), F.lit("an unknown ratio")).otherwise(
        F.concat(F.lit("about "), F.format_string("%.2f", F.round(ratio, 2)), F.lit(":1")))

    def fill(template: str) -> Column:
        head, tail = template.split("{ratio}")
        return F.concat(F.lit(head), ratio_text, F.lit(tail))

    return (F.when(task == "regression", F.lit(RATIONALE_REGRESSION))
            .when(task == "multiclass_classification", F.lit(RATIONALE_MULTICLASS))
            .when(metric == "accuracy", fill(RATIONALE_ACCURACY))
            .when(metric == "f1", fill(RATIONALE_F1))
            .otherwise(fill(RATIONALE_PR_AUC)))
