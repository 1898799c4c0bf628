"""Diagnosis-code harmonisation: joins, ICD-9 -> ICD-10, CCSR categories.

Covers D1-D7, D9, C1, C2, C9, C10, H1, H3, H4, E2-E4, E12, J1, J3, J6, J7, B10.

Plan shape: the two dimensions (crosswalk, categories) are reduced to one row per
code on their own small side, size-checked and broadcast, so the diagnosis fact is
never shuffled for a lookup. Only the duplicate-key check needs a shuffle, and it moves
just the three key columns with map-side partial counts; category lists are merged only
for the (usually absent) duplicated keys and joined back by broadcast.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..plans.sizing import checked_broadcast
from .schema import clean_names, columns_matching, move_after

DX_KEY = ["subject_id", "hadm_id", "seq_num"]


def merge_tables(patients: DataFrame, admissions: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """D1 + D2 + B1: patients ⋈ admissions on subject_id, ⋈ diagnoses on (subject_id, hadm_id).

    One row per diagnosis row; ``hadm_id`` sits right after ``subject_id``.
    """
    pa = patients.join(admissions, "subject_id", "inner")
    dx = pa.join(diagnoses, ["subject_id", "hadm_id"], "inner")
    return move_after(dx, "hadm_id", "subject_id")


def crosswalk_one_target(xwalk: DataFrame, src: str = "icd9", dst: str = "icd10",
                         priority: str | None = None) -> DataFrame:
    """One target per source code (lowest priority, then smallest target).

    Source codes are normalised like J1 so that they meet ``dx_norm``; invalid
    (blank) targets are never chosen.
    """
    x = xwalk.select(C.normalize_dx(F.col(src)).alias("src"),
                     C.strip_ws(F.col(dst)).alias("dst"),
                     (F.col(priority) if priority else F.lit(0)).alias("prio"))
    x = x.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("dst") != ""))
    best = F.min_by(F.col("dst"), F.struct(F.col("prio"), F.col("dst")))
    return x.groupBy("src").agg(best.alias("dst"))


def map_codes(dx: DataFrame, xwalk: DataFrame, code_col: str = "icd_code",
              version_col: str = "icd_version") -> DataFrame:
    """J1 + C1/B10 + D4 + J3: adds ``dx_norm``, ``icd10_full``, ``icd10_3char``.

    ICD-10 rows keep their normalised code; ICD-9 rows take the crosswalk target
    (NULL when unmapped). Without a version column the code shape decides.
    """
    dx = dx.withColumn("dx_norm", C.normalize_dx(F.col(code_col)))
    if version_col in dx.columns:
        v = F.col(version_col).cast("string")
        is9, is10 = v == "9", v == "10"
    else:
        ver = C.infer_icd_version(F.col("dx_norm"))
        is9, is10 = ver == 9, ver == 10
    xw = checked_broadcast(crosswalk_one_target(xwalk))
    joined = dx.join(xw, is9 & (F.col("dx_norm") == F.col("src")), "left")
    full = F.when(is10, F.col("dx_norm")).when(is9, F.col("dst"))
    out = joined.withColumn("icd10_full", full).drop("src", "dst")
    return out.withColumn("icd10_3char", C.icd10_3char_strict(F.col("icd10_full")))


def mapping_qa(mapped: DataFrame, version_col: str = "icd_version") -> DataFrame:
    """Row count, share of ICD-9 rows mapped, 3-char coverage, null counts."""
    is9 = F.col(version_col).cast("string") == "9"
    return mapped.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(is9).alias("icd9_rows"),
        F.avg(F.when(is9, F.col("icd10_full").isNotNull().cast("double"))).alias("icd9_mapped_share"),
        F.avg(F.col("icd10_3char").isNotNull().cast("double")).alias("char3_share"),
        F.count_if(F.col("icd10_full").isNull()).alias("icd10_full_nulls"),
        F.count_if(F.col("icd10_3char").isNull()).alias("icd10_3char_nulls"),
    )


def unmapped_codes(mapped: DataFrame, k: int = 20, version_col: str = "icd_version",
                   code_col: str = "icd_code") -> DataFrame:
    """C9 + E8 + G2: most frequent raw ICD-9 codes without a crosswalk target."""
    is9 = F.col(version_col).cast("string") == "9"
    return (mapped.filter(is9 & F.col("icd10_full").isNull())
            .groupBy(code_col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(code_col)).limit(k))


def drop_unmapped(mapped: DataFrame) -> DataFrame:
    """Drop rows without an ICD-10 code."""
    return mapped.na.drop(subset=["icd10_full"])


def ccsr_long(dim: DataFrame, code_header: str = "ICD-10-CM CODE",
              category_pattern: str = r"CCSR CATEGORY [1-6]") -> DataFrame:
    """B2 + B3 + J6 + H4 + C3 + H1: wide category file -> (icd10, category, description).

    Category and description columns are unpivoted *together* (never zipped by
    position), blank categories dropped, exact duplicates removed.
    """
    dim = clean_names(dim)
    cats = columns_matching(dim, category_pattern)
    pairs = F.array(*[
        F.struct(C.strip_quotes(F.col(f"`{c}`").cast("string")).alias("ccsr_category"),
                 C.strip_quotes(F.col(f"`{c} DESCRIPTION`").cast("string")).alias("ccsr_description"))
        for c in cats])
    icd10 = F.upper(F.regexp_replace(C.strip_quotes(F.col(f"`{code_header}`")), r"\.", ""))
    long = dim.select(icd10.alias("icd10"), F.inline(pairs))
    return long.filter(C.not_blank(F.col("ccsr_category"))).dropDuplicates(
        ["icd10", "ccsr_category", "ccsr_description"])


def ccsr_category_codes(dim: DataFrame, code_header: str = "ICD-10-CM CODE",
                        category_pattern: str = r"CCSR CATEGORY [1-6]") -> DataFrame:
    """H3: single-value unpivot of the category columns, blanks dropped, distinct."""
    dim = clean_names(dim)
    cats = columns_matching(dim, category_pattern)
    icd10 = F.upper(F.regexp_replace(C.strip_quotes(F.col(f"`{code_header}`")), r"\.", ""))
    wide = dim.select(icd10.alias("icd10"),
                      *[C.strip_quotes(F.col(f"`{c}`").cast("string")).alias(c) for c in cats])
    long = wide.unpivot(["icd10"], cats, "variable", "ccsr_category")
    return long.filter(C.not_blank(F.col("ccsr_category"))).drop("variable").distinct()


def ccsr_by_code(long: DataFrame) -> DataFrame:
    """E4 on the dimension side: per ICD-10 code, categories that have a non-blank
    description, sorted, with the aligned description (smallest one on conflicts)."""
    d = C.strip_ws(F.col("ccsr_description"))
    per_cat = (long.filter(F.col("ccsr_description").isNotNull() & (d != ""))
               .groupBy("icd10", "ccsr_category").agg(F.min(d).alias("desc")))
    pairs = F.array_sort(F.collect_list(F.struct("ccsr_category", "desc")))
    return per_cat.groupBy("icd10").agg(pairs.alias("pairs"))


def attach_ccsr(dx: DataFrame, long: DataFrame) -> DataFrame:
    """D6 + D7 + E4 + J7: per diagnosis row, ``ccsr_list_sorted`` (NULL when none) and
    the aligned ``ccsr_description`` ([] when none).

    Rows sharing a (subject_id, hadm_id, seq_num) key share the merged lists, as in a
    group-by on that key joined back. Duplicates are found from the key columns
    alone; lists are merged only for the duplicated keys.
    """
    by_code = checked_broadcast(ccsr_by_code(long))
    keyed = dx.withColumn("_icd10", C.icd10_key(F.col("icd10_full")))
    keyed = keyed.join(by_code, keyed["_icd10"] == by_code["icd10"], "left").drop("icd10", "_icd10")
    # duplicated keys: counted on the three key columns only (map-side partial counts)
    dup_keys = checked_broadcast(
        dx.groupBy(*DX_KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(*DX_KEY))
    if dup_keys.isEmpty():
        pairs = F.col("pairs")
    else:
        # merged lists only for rows of those keys (a broadcast semi join), joined back
        dups = (keyed.join(dup_keys, DX_KEY, "left_semi").groupBy(*DX_KEY)
                .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pairs")))).alias("_merged")))
        keyed = keyed.join(checked_broadcast(dups), DX_KEY, "left")
        pairs = F.coalesce(F.col("_merged"), F.col("pairs"))
    pairs = F.when(F.size(pairs) > 0, pairs)
    return (keyed.withColumn("ccsr_list_sorted", F.transform(pairs, lambda p: p["ccsr_category"]))
            .withColumn("ccsr_description",
                        F.coalesce(F.transform(pairs, lambda p: p["desc"]), F.array().cast("array<string>")))
            .drop("pairs", "_merged"))


def multi_category_rows(dx: DataFrame) -> DataFrame:
    """Rows with more than one category."""
    return dx.filter(F.coalesce(F.size("ccsr_list_sorted"), F.lit(0)) > 1)
