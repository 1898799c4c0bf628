"""Schema-level operators (A6, A7, B1-B8): decided on ``df.columns`` before planning."""
from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import to_number

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Raise ``ValueError`` listing the required columns that are absent."""
    absent = sorted(set(required).difference(df.columns))
    if absent:
        raise ValueError(f"table lacks {', '.join(absent)}; it has {', '.join(df.columns)}")
    return df


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop pandas index columns written into CSVs ('Unnamed: 0', '_c0', '')."""
    drop = [c for c in df.columns if c.startswith("Unnamed") or c in ("_c0", "")]
    return df.drop(*drop) if drop else df


def move_after(df: DataFrame, col: str, anchor: str) -> DataFrame:
    """B1: place ``col`` right after ``anchor``."""
    cols = [c for c in df.columns if c != col]
    if col not in df.columns or anchor not in cols:
        return df
    i = cols.index(anchor)
    cols.insert(i + 1, col)
    return df.select(*[F.col(f"`{c}`") for c in cols])


def clean_names(df: DataFrame) -> DataFrame:
    """B2: strip whitespace and surrounding apostrophes from column names."""
    return df.withColumnsRenamed({c: c.strip().strip("'") for c in df.columns})


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose whole name matches ``pattern``, in table order."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.fullmatch(c)]


def resolve_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Each canonical column that ``df`` lacks is taken from the earliest of its declared names that ``df`` has."""
    have = set(df.columns)
    return df.withColumnsRenamed({next(n for n in names if n in have): canonical for canonical, names in aliases.items()
                                  if canonical not in have and have.intersection(names)})


def with_default(df: DataFrame, col: str, default, dtype: str | None = None) -> DataFrame:
    """Add ``col`` as a constant when it is absent."""
    if col in df.columns:
        return df
    lit = F.lit(default)
    return df.withColumn(col, lit.cast(dtype) if dtype else lit)


def coerce_numeric(df: DataFrame, cols: Iterable[str], default: float | None = 0.0) -> DataFrame:
    """``to_numeric(errors='coerce').fillna(default)`` for each present column."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, to_number(F.col(c), default))
    return df


# Leakage set and allow list of the admission-level feature matrix.
LEAKAGE_COLUMNS = frozenset({
    "hospital_expire_flag", "los_days", "los_hours",
    "dischtime", "deathtime", "dischtime_dt", "deathtime_dt",
    "admittime", "admittime_dt",
    "hadm_id", "subject_id",
    "ccsr_list_sorted", "ccsr_union", "ccsr_description",
})
ENGINEERED_NUMERIC = ("age_at_admit", "adm_year", "adm_month", "adm_day", "adm_hour",
                      "adm_weekday", "adm_weekend", "n_ccsr_unique", "n_dx_rows")


def feature_columns(df: DataFrame, exclude=LEAKAGE_COLUMNS, allow=ENGINEERED_NUMERIC,
                    code_suffix: bool = True, keep_raw_code: bool = False) -> list[str]:
    """Numeric columns plus the allow list (and ``*_code``), minus the leakage set.

    ``keep_raw_code`` reproduces the quirk that lets the raw ``icd_code`` text in
    through the ``_code`` suffix test; by default it stays out.
    """
    numeric = {c for c, kind in df.dtypes if kind in NUMERIC_TYPES}
    listed = set(allow).intersection(df.columns)
    codes = {c for c in df.columns if c.endswith("_code")} if code_suffix else set()
    raw = set() if keep_raw_code else {"icd_code"} - numeric
    return sorted((numeric | listed | codes) - raw - set(exclude))
