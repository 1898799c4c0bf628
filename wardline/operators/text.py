"""Admission-level records with generated text.

The first ``max_dx`` diagnosis rows of an admission are selected with
``row_number() <= max_dx``, which Spark turns into a map-side group limit, so a huge
admission never reaches one task whole; lines are assembled from at most
``max_dx`` ordered entries.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import timecols as T

MAX_DX = 60
KEY = ["subject_id", "hadm_id"]


def _na(c: str, df: DataFrame) -> Column:
    """The value as text, 'NA' when NULL or absent."""
    if c not in df.columns:
        return F.lit("NA")
    return C.or_default(F.col(c), "NA")


def _valid_dx(c: Column) -> Column:
    s = C.strip_ws(c.cast("string"))
    return F.when(s.isNotNull() & (s != "") & (F.lower(s) != "nan"), s)


def _first_ranked(features: DataFrame, max_dx: int) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("seq_num", "icd_code")
    return features.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= max_dx)


def _record(features: DataFrame, ranked: DataFrame, text: Column, edges=T.LOS_EDGES) -> DataFrame:
    first = F.min_by(F.struct(*[F.col(c) for c in ("hospital_expire_flag", "los_days", "race", "age_at_admit")]),
                     F.col("_i"))
    agg = ranked.groupBy(*KEY).agg(first.alias("_f"), text.alias("text"))
    n_dx = features.groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("n_dx"))
    out = agg.join(n_dx, KEY, "inner")
    y_los = F.col("_f.los_days").cast("double")
    return out.select(
        *KEY, "text",
        F.col("_f.hospital_expire_flag").cast("int").alias("y_mort"),
        y_los.alias("y_los"),
        T.los_class(y_los, edges).alias("y_los_cls"),
        F.coalesce(F.col("_f.race").cast("string"), F.lit("nan")).alias("race"),
        F.coalesce(F.col("_f.age_at_admit").cast("double"), F.lit(0.0)).alias("age"),
        "n_dx")


def prose_records(features: DataFrame, max_dx: int = MAX_DX) -> DataFrame:
    """J12 + E19: natural-language header and numbered diagnosis lines.

    Line i (position in seq order among the first ``max_dx`` rows) is
    ``"i. <dx>"`` plus ``" (CCSR: a, b)"`` with up to two non-blank categories; a row
    without a usable code is skipped (numbering keeps its gap); no line -> ``1. NA``.
    """
    r = _first_ranked(features, max_dx)
    dx = F.coalesce(F.when(_valid_dx(F.col("dx_norm")) != "NoDx", _valid_dx(F.col("dx_norm"))),
                    _valid_dx(F.col("icd10_full")))
    cats = F.filter(F.transform(F.coalesce("ccsr_list_sorted", F.array().cast("array<string>")),
                                lambda c: C.strip_ws(c)), lambda c: c != "")
    ccsr = F.when(F.size(cats) > 0, F.concat(F.lit(" (CCSR: "), F.array_join(F.slice(cats, 1, 2), ", "), F.lit(")"))
                  ).otherwise(F.lit(""))
    line = F.when(dx.isNotNull(), F.concat(F.col("_i").cast("string"), F.lit(". "), dx, ccsr))
    header = F.concat(
        F.lit("A "), _na("gender", r), F.lit(" patient, "), _na("age_at_admit", r), F.lit(" years old, "),
        F.lit("was admitted ("), _na("admission_type", r), F.lit(") via "), _na("admission_location", r),
        F.lit(". Insurance: "), _na("insurance", r), F.lit(". Race: "), _na("race", r),
        F.lit(". Diagnoses in order:"))
    r = r.withColumn("_line", line).withColumn("_hdr", header)
    lines = F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("_i", "_line"))))
    body = F.transform(lines, lambda p: p["_line"])
    hdr = F.min_by(F.col("_hdr"), F.col("_i"))
    text = F.concat(hdr, F.lit("\n"), F.when(F.size(body) > 0, F.array_join(body, "\n")).otherwise(F.lit("1. NA")))
    return _record(features, r, text)


def token_records(features: DataFrame, max_dx: int = MAX_DX) -> DataFrame:
    """J13 + E19: bracketed header, then ``DX_<code>`` and up to two ``CCSR_<cat>``
    tokens per row (dots -> '_'); ``ICD10_<code>`` tokens only when no token at all."""
    r = _first_ranked(features, max_dx)
    dx = F.when(_valid_dx(F.col("dx_norm")) != "NoDx", _valid_dx(F.col("dx_norm")))
    dx_tok = F.when(dx.isNotNull(), F.array(F.concat(F.lit("DX_"), F.regexp_replace(dx, r"\.", "_"))))
    first2 = F.slice(F.coalesce("ccsr_list_sorted", F.array().cast("array<string>")), 1, 2)
    cat_tok = F.transform(F.filter(F.transform(first2, lambda c: C.strip_ws(c)), lambda c: c != ""),
                          lambda c: F.concat(F.lit("CCSR_"), c))
    toks = F.concat(F.coalesce(dx_tok, F.array().cast("array<string>")), cat_tok)
    icd = _valid_dx(F.col("icd10_full"))
    fallback = F.when(icd.isNotNull(), F.concat(F.lit("ICD10_"), F.regexp_replace(icd, r"\.", "_")))
    header = F.concat(
        F.lit("[AGE] "), _na("age_at_admit", r), F.lit(" [SEX] "), _na("gender", r), F.lit(" [RACE] "), _na("race", r),
        F.lit(" [INS] "), _na("insurance", r), F.lit(" [ATYPE] "), _na("admission_type", r),
        F.lit(" [ALOC] "), _na("admission_location", r), F.lit(" "))
    r = r.withColumn("_toks", toks).withColumn("_fb", fallback).withColumn("_hdr", header)
    main = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_toks"))), lambda p: p["_toks"]))
    fb = F.transform(F.array_sort(F.collect_list(F.when(F.col("_fb").isNotNull(), F.struct("_i", "_fb")))),
                     lambda p: p["_fb"])
    body = F.when(F.size(main) > 0, main).otherwise(fb)
    hdr = F.min_by(F.col("_hdr"), F.col("_i"))
    text = F.concat(hdr, F.lit(" [DXSEQ] "), F.array_join(body, " "))
    return _record(features, r, text)
