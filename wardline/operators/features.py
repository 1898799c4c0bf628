"""Admission features: cleaning, code tables, time, LOS, age (C4-C8, J8, J14, J15,
K1-K7, B7) and the admission-level roll-up (E1, E2/H5, E5, E6, D7)."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import timecols as T
from ..plans.session import small_scans
from ..plans.sizing import checked_broadcast, materialise, release

CODED_COLUMNS = ("race", "admission_type", "gender")
BLANK_CHECKED = ("gender", "race", "admission_type", "hospital_expire_flag", "anchor_age", "anchor_year")


def clean_demographics(df: DataFrame, columns: Sequence[str] = BLANK_CHECKED) -> DataFrame:
    """C8 on the categorical inputs, then J8 on gender."""
    for c in columns:
        if c in df.columns and dict(df.dtypes)[c] == "string":
            df = df.withColumn(c, C.blank_to_null(F.col(c)))
    if "gender" in df.columns and "gender" in columns:
        df = df.withColumn("gender", C.normalize_gender(F.col("gender")))
    return df


def code_table(df: DataFrame, columns: Sequence[str] = CODED_COLUMNS) -> DataFrame:
    """J14 (+A4 payload): (feature, value, code) with codes 0.. in sorted value order.

    Values are the stripped, non-blank distinct values of each column, taken in one
    scan; the window runs over distinct values only (a categorical domain), not rows.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("none of the columns to encode is present")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), C.strip_ws(F.col(c).cast("string")).alias("value"))
                      for c in present])
    vals = df.select(F.inline(pairs)).filter(F.col("value").isNotNull() & ~F.col("value").isin(*C.BLANKS))
    vals = vals.distinct()
    w = Window.partitionBy("feature").orderBy("value")
    return vals.withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def apply_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str] = CODED_COLUMNS,
                missing: int = -1) -> DataFrame:
    """Add ``<col>_code`` by a size-checked broadcast lookup; missing -> -1."""
    codes = checked_broadcast(codes)
    for c in columns:
        if c not in df.columns:
            continue
        m = codes.filter(F.col("feature") == c).select(F.col("value").alias(f"_v_{c}"),
                                                      F.col("code").alias(f"{c}_code"))
        key = C.strip_ws(F.col(c).cast("string"))
        df = df.join(m, key == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
        df = df.withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(missing)).cast("int"))
    return df


def time_features(df: DataFrame) -> DataFrame:
    """Parsed times, LOS, calendar parts, age, target flag."""
    if "hospital_expire_flag" in df.columns:
        flag = T.to_number(F.col("hospital_expire_flag"), 0.0, dict(df.dtypes)["hospital_expire_flag"])
        df = df.withColumn("hospital_expire_flag", T.clip(flag, 0.0, 1.0).cast("int"))
    for t in ("admittime", "dischtime", "deathtime"):
        if t in df.columns:
            df = df.withColumn(f"{t}_dt", T.parse_ts(F.col(t)))
    if "admittime_dt" in df.columns and "dischtime_dt" in df.columns:
        death = F.col("deathtime_dt") if "deathtime_dt" in df.columns else None
        df = df.withColumn("los_hours", T.los_hours(F.col("admittime_dt"), F.col("dischtime_dt"), death))
        df = df.withColumn("los_days", F.col("los_hours") / F.lit(24.0))
    if "admittime_dt" in df.columns:
        a = F.col("admittime_dt")
        df = (df.withColumn("adm_year", F.year(a)).withColumn("adm_month", F.month(a))
              .withColumn("adm_day", F.dayofmonth(a)).withColumn("adm_hour", F.hour(a))
              .withColumn("adm_weekday", T.weekday(a)).withColumn("adm_weekend", T.weekend_flag(a)))
        if "anchor_age" in df.columns and "anchor_year" in df.columns:
            kinds = dict(df.dtypes)
            aa = T.to_number(F.col("anchor_age"), None, kinds["anchor_age"])
            ay = T.to_number(F.col("anchor_year"), None, kinds["anchor_year"])
            df = df.withColumn("age_at_admit", T.age_at_admit(aa, ay, F.col("adm_year")))
    return df


def count_categories(df: DataFrame) -> DataFrame:
    """``n_ccsr`` = number of categories of the row (0 when none)."""
    lst = F.col("ccsr_list_sorted")
    return df.withColumn("n_ccsr", F.coalesce(F.size(lst), F.lit(0)).cast("int"))


def coded_combinations(dx: DataFrame) -> DataFrame:
    """Distinct combinations of the columns to encode, as they stand in the rows."""
    return dx.select(*[c for c in CODED_COLUMNS if c in dx.columns]).distinct()


def engineer(dx: DataFrame, codes: DataFrame | None = None, combinations: DataFrame | None = None) -> DataFrame:
    """The whole per-row feature step; ``codes`` defaults to a table fitted on ``dx``.

    The columns to encode are cleaned and looked up once per combination of their values
    (``combinations``, those of ``dx`` by default); a size-checked join brings them to the rows."""
    seen = coded_combinations(dx) if combinations is None else combinations
    coded = seen.columns
    if codes is None:
        codes = code_table(clean_demographics(seen))
    table = seen.select(*coded, *[F.col(c).alias(f"_raw_{c}") for c in coded])
    table = checked_broadcast(apply_codes(clean_demographics(table), codes))
    order = [*dx.columns, *[f"{c}_code" for c in coded]]
    df = dx.withColumnsRenamed({c: f"_row_{c}" for c in coded})
    same = reduce(and_, [F.col(f"_row_{c}").eqNullSafe(F.col(f"_raw_{c}")) for c in coded])
    df = clean_demographics(df.join(table, same, "left").select(*order), [c for c in BLANK_CHECKED if c not in coded])
    df = time_features(df)
    return count_categories(df)


def minors(features: DataFrame, age_limit: float = 18) -> DataFrame:
    """C4: rows admitted below ``age_limit`` years."""
    return features.filter(F.col("age_at_admit") < F.lit(age_limit))


def first_non_null_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str],
                           columns: Sequence[str]) -> list:
    """Per column, the value of the first row (by ``order``) where it is not NULL."""
    aggs = []
    for c in columns:
        ordering = F.struct(*[F.col(o) for o in order])
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ordering)).alias(c))
    return aggs


MASK_BITS = 60


def _held(cols: Sequence[str]) -> Column:
    """A bit for each of the columns, set where it is not NULL."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(cols)])


def admission_rollup(features: DataFrame, key: Sequence[str] = ("hadm_id",),
                     order: Sequence[str] = ("seq_num",)) -> DataFrame:
    """E1 + E2/H5 + E5 + E6: one row per admission.

    Every scalar column takes its first non-NULL value in ``seq_num`` order; the
    category lists of all rows are unioned and sorted (``ccsr_union``), with their
    distinct count and the number of diagnosis rows.

    One aggregation keeps an admission's first row whole and marks the columns that hold a
    value in any row. Only columns that some admission finds in a later row alone are then
    looked for again, in those admissions. The table is written to the shared folder.
    """
    list_cols = {"ccsr_list_sorted", "ccsr_description"}
    scalar = [c for c in features.columns if c not in set(key) | list_cols]
    order_cols = list(order) + [c for c in ("icd_code",) if c in features.columns]
    first = F.min_by(F.struct(*scalar), F.struct(*order_cols))
    # which columns hold a value in a row: a bit each, in as many words as they need
    words = [scalar[i:i + MASK_BITS] for i in range(0, len(scalar), MASK_BITS)]
    # collect_set de-duplicates map-side, so the buffer per admission is bounded by
    # its distinct category lists, not by its row count
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_set(
        F.coalesce(F.col("ccsr_list_sorted"), F.array().cast("array<string>"))))))
    rows = features.groupBy(*key).agg(
        first.alias("_first"), *[F.bit_or(_held(w)).alias(f"_any{i}") for i, w in enumerate(words)],
        union.alias("ccsr_union"), F.count(F.lit(1)).alias("n_dx_rows"))
    with small_scans(features.sparkSession):
        rows = materialise(rows.select(*key, "_first.*", "ccsr_union", "n_dx_rows", *[f"_any{i}" for i in range(len(words))]))
    lacks = [F.col(f"_any{i}").bitwiseAND(F.bitwise_not(_held(w))) for i, w in enumerate(words)]
    missing = rows.agg(*[F.bit_or(x) for x in lacks]).first()
    late = [c for i, w in enumerate(words) for j, c in enumerate(w) if (missing[i] or 0) >> j & 1]
    out = rows
    if late:
        wanted = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
        short = rows.filter(reduce(or_, [x != 0 for x in lacks])).select(*wanted)
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
        found = (features.select(*dict.fromkeys([*key, *order_cols, *late])).join(short, same, "left_semi").groupBy(*wanted)
                 .agg(*[v.alias(f"_late_{c}") for c, v in zip(late, first_non_null_per_key(features, key, order_cols, late))]))
        out = materialise(rows.join(found, same, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_late_{c}")) for c in late}))
        release(rows)
    return out.select(*key, *scalar, "ccsr_union", "n_dx_rows").withColumn("n_ccsr_unique", F.size("ccsr_union").cast("int"))
