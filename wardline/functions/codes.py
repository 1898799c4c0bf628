"""Scalar string/code expressions.

Everything here is a built-in Spark expression so that it stays inside whole-stage
codegen; no Python runs per row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings the reference treats as missing after trimming.
BLANKS = ("", " ", "NA", "N/A", "None", "NONE", "NaN", "nan")
# Placeholder codes that become missing after the ICD-10 clean-up.
PLACEHOLDER_CODES = ("", "NAN", "NONE")

_WS = r"^\s+|\s+$"
# All that can end or begin a text which _WS changes: \s, and line ends, before which $ matches too.
_EDGE = " \t\n\x0b\f\r\u0085\u2028\u2029"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: trims any whitespace (Spark ``trim`` only trims spaces).

    The regular expression runs only on texts with something to trim."""
    c = _c(c)
    return F.when(F.trim(c, F.lit(_EDGE)) == c, c).otherwise(F.regexp_replace(c, _WS, ""))


def normalize_dx(c) -> Column:
    """Trim, upper-case, drop dots and whitespace; empty -> NULL."""
    s = F.translate(F.upper(_c(c)), ". \t\n\x0b\f\r", "")
    return F.when(s != "", s)


def clean_icd(c) -> Column:
    """Keep only A-Z and 0-9 of the upper-cased code; NULL -> ''."""
    return F.regexp_replace(F.upper(F.coalesce(_c(c).cast("string"), F.lit(""))), "[^A-Z0-9]", "")


def icd10_3char_strict(c) -> Column:
    """Letter + two digits at the start of the cleaned code, else NULL."""
    s = F.replace(F.upper(strip_ws(c)), F.lit("."), F.lit(""))
    return F.when(s.rlike(r"^[A-Z][0-9]{2}"), F.substring(s, 1, 3))


def icd10_3char_lenient(c) -> Column:
    """Strict rule, else the first three characters when there are at least three."""
    s = _c(c)
    return F.coalesce(
        F.when(s.rlike(r"^[A-Z][0-9]{2}"), F.substring(s, 1, 3)),
        F.when(F.length(s) >= 3, F.substring(s, 1, 3)),
    )


def infer_icd_version(dx_norm) -> Column:
    """10 when the normalised code starts with a letter, 9 with a digit, else NULL."""
    s = F.coalesce(_c(dx_norm), F.lit(""))
    return F.when(s.rlike("^[A-Z]"), F.lit(10)).when(s.rlike("^[0-9]"), F.lit(9))


def strip_quotes(c) -> Column:
    """``str.strip().strip("'")``."""
    return F.regexp_replace(strip_ws(c), r"^'+|'+$", "")


def placeholder_to_null(c) -> Column:
    """The placeholders '', 'NAN', 'NONE' -> NULL."""
    return F.when(~_c(c).isin(*PLACEHOLDER_CODES), _c(c))


def icd10_key(c) -> Column:
    """Join key of a full ICD-10 code: trimmed, dot-free, upper-case, placeholders NULL."""
    return placeholder_to_null(F.upper(F.replace(strip_ws(c), F.lit("."), F.lit(""))))


def not_blank(c) -> Column:
    """Value is neither NULL nor one of the blank strings '' and ' '."""
    return _c(c).isNotNull() & ~_c(c).isin("", " ")


def blank_to_null(c) -> Column:
    """Values whose trimmed text is in BLANKS -> NULL."""
    return F.when(~strip_ws(_c(c).cast("string")).isin(*BLANKS), _c(c))


def normalize_gender(c) -> Column:
    """Upper-case + strip, anything except M / F -> NULL."""
    g = strip_ws(F.upper(blank_to_null(c)))
    return F.when(g.isin("M", "F"), g)


def parse_list(c) -> Column:
    """List literal such as "['A', 'B']" or '["A"]' -> array<string>; bad -> []."""
    s = strip_ws(_c(c).cast("string"))
    parsed = F.from_json(s, "array<string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array().cast("array<string>"))


def list_length(c) -> Column:
    """Length of a list literal, 0 when it does not parse."""
    return F.coalesce(F.size(parse_list(c)), F.lit(0))


def or_default(c, default="NA") -> Column:
    """NULL -> default text."""
    return F.coalesce(_c(c).cast("string"), F.lit(default))


def safe_name(c) -> Column:
    """Lower-case, runs of characters outside [a-z0-9_-] -> '_', strip '_'."""
    s = F.regexp_replace(F.lower(strip_ws(_c(c).cast("string"))), r"[^a-z0-9\-_]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def fmt_ci(point, lo, hi, digits: int = 2) -> Column:
    """J20: 'p (lo, hi)' with fixed decimals."""
    f = f"%.{digits}f"
    return F.format_string(f"{f} ({f}, {f})", _c(point), _c(lo), _c(hi))


def pct(c) -> Column:
    """Percent scaling."""
    return _c(c) * F.lit(100.0)
