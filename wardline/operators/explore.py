"""Exploration tables behind the reference's plots.

Global statistics (min, max, totals) are one-row aggregates attached to the data by
a broadcast equi-join on a constant key, so plans stay lazy and distributed; a one-row
side is bounded by construction.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a single-row aggregate to every row (broadcast hash join)."""
    k = "__one"
    return df.withColumn(k, F.lit(1)).join(F.broadcast(one_row.withColumn(k, F.lit(1))), k).drop(k)


def frequency(df: DataFrame, col: str, count_name: str = "count") -> DataFrame:
    """``value_counts`` (NULLs dropped)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(count_name))


def share_of_total(counts: DataFrame, count_col: str = "count", name: str = "percentage") -> DataFrame:
    """Count / total * 100 (total over the non-NULL rows that were counted)."""
    tot = counts.agg(F.sum(count_col).alias("__tot"))
    out = attach_scalars(counts, tot)
    return out.withColumn(name, F.col(count_col) * F.lit(100.0) / F.col("__tot")).drop("__tot")


def patient_mortality(features: DataFrame) -> DataFrame:
    """E7 + E8 + E9: patients by their max in-hospital death flag, labelled, with shares."""
    per_patient = features.groupBy("subject_id").agg(F.max("hospital_expire_flag").alias("flag"))
    counts = per_patient.groupBy("flag").agg(F.count(F.lit(1)).alias("count"))
    out = share_of_total(counts)
    label = F.when(F.col("flag") == 0, "Alive").when(F.col("flag") == 1, "Dead")
    return out.select(label.alias("hospital_expire_flag"), "count", "percentage")


def token_frequency(df: DataFrame, list_col: str, token_name: str = "token") -> DataFrame:
    """Counter over the elements of a list column (partial aggregation per task)."""
    toks = df.select(F.explode(F.col(list_col)).alias(token_name))
    return toks.groupBy(token_name).agg(F.count(F.lit(1)).alias("count"))


def text_token_frequency(df: DataFrame, text_col: str = "text",
                         prefixes=("DX_", "CCSR_")) -> DataFrame:
    """E11 on text: whitespace tokens starting with one of ``prefixes``."""
    words = df.select(F.explode(F.split(F.trim(F.col(text_col)), r"\s+")).alias("token"))
    cond = None
    for p in prefixes:
        c = F.col("token").startswith(p)
        cond = c if cond is None else (cond | c)
    return words.filter(cond).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def top_k(counts: DataFrame, k: int, count_col: str = "count", key_col: str | None = None) -> DataFrame:
    """The k largest counts, ties broken by key ascending (a top-k is the feature)."""
    order = [F.desc(count_col)] + ([F.asc(key_col)] if key_col else [])
    return counts.orderBy(*order).limit(k)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max]; the last edge is inclusive.

    Returns every bin (empty bins with count 0): bin, lo, hi, center, count.
    """
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    stats = x.agg(F.min("x").alias("lo_all"), F.max("x").alias("hi_all"))
    width = (F.col("hi_all") - F.col("lo_all")) / F.lit(bins)
    idx = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo_all")) / width), F.lit(bins - 1))
                 ).otherwise(F.lit(0)).cast("int")
    counted = (attach_scalars(x, stats).withColumn("bin", idx)
               .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = stats.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo_all", "hi_all")
    w = (F.col("hi_all") - F.col("lo_all")) / F.lit(bins)
    out = grid.join(counted, "bin", "left").select(
        "bin",
        (F.col("lo_all") + F.col("bin") * w).alias("lo"),
        (F.col("lo_all") + (F.col("bin") + 1) * w).alias("hi"),
        (F.col("lo_all") + (F.col("bin") + F.lit(0.5)) * w).alias("center"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))
    return out


def modal_bin(hist: DataFrame) -> DataFrame:
    """The tallest bar (lowest bin on ties) and its centre."""
    best = F.min_by(F.struct("bin", "center", "count"), F.struct(-F.col("count"), F.col("bin")))
    return hist.agg(best.alias("m")).select("m.bin", "m.center", "m.count")


# Terms of the expansion and width of its cells in bandwidths: a value lies within a quarter of
# a bandwidth of its centre, so term k is at most 1.09 * 0.25^k / sqrt(k!), and all terms
# left out are below 1e-16 of the kernel's peak.
KDE_TERMS = 16
KDE_CELL = 0.5


def kde_grid(df: DataFrame, col: str, grid_size: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid over [min, max], Scott bandwidth
    ``n^(-1/5) * stddev_samp``, by a fast Gauss transform.

    Rows are reduced, map-side, to the first ``KDE_TERMS`` moments of each half-bandwidth cell;
    only the cells meet the grid points, through Hermite polynomials. The error is below
    ``1e-16 / (bandwidth * sqrt(2 pi))``, before rounding. NULL density where the bandwidth is
    0 or undefined."""
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    stats = x.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                  F.stddev_samp("x").alias("sd"))
    stats = stats.withColumn("bw", F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("sd"))
    at = F.try_divide(F.col("x") - F.col("lo"), F.col("bw"))
    placed = attach_scalars(x, stats).select(at.alias("u")).withColumn("cell", F.floor(F.col("u") / KDE_CELL))
    delta = F.col("u") - (F.col("cell") + 0.5) * KDE_CELL
    moments = placed.withColumn("d", delta).groupBy("cell").agg(
        *[F.sum(F.pow("d", F.lit(float(k)))).alias(f"m{k}") for k in range(KDE_TERMS)])
    step = (F.col("hi") - F.col("lo")) / F.lit(grid_size - 1)
    point = F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("point")
    t = F.try_divide(F.col("point") * step, F.col("bw")) - (F.col("cell") + 0.5) * KDE_CELL
    met = attach_scalars(moments.select("*", point), stats).withColumn("t", t)
    # He(k + 1) = t He(k) - k He(k - 1); each term carries 1 / k!
    start = F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("now"), F.lit(1.0).alias("share"), F.lit(0.0).alias("sum"))
    terms = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"m{k}").alias("m")) for k in range(KDE_TERMS)])
    total = F.aggregate(terms, start, lambda a, m: F.struct(
        a["now"].alias("before"), (F.col("t") * a["now"] - m["k"] * a["before"]).alias("now"),
        (a["share"] / (m["k"] + 1.0)).alias("share"), (a["sum"] + m["m"] * a["share"] * a["now"]).alias("sum")))
    sums = met.withColumn("k", total["sum"] * F.exp(F.lit(-0.5) * F.col("t") * F.col("t"))).groupBy("point").agg(F.sum("k").alias("ksum"))
    norm = F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi))
    return attach_scalars(sums, stats).select(
        "point", (F.col("lo") + F.col("point") * step).alias("x"), F.try_divide("ksum", norm).alias("density"))


def class_balance(df: DataFrame, label: str = "y_true", by: list[str] | None = None) -> DataFrame:
    """E18 (+K16): counts, prevalence, imbalance ratio neg/max(1,pos) and class weights
    (balanced n/(2 n_c), inverse 1/n_c)."""
    g = df.groupBy(*by) if by else df.groupBy()
    y = F.col(label).cast("int")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("bigint").alias("pos"))
    out = out.withColumn("neg", F.col("n") - F.col("pos"))
    return out.select(
        *(by or []), "n", "pos", "neg",
        (F.col("pos") / F.col("n")).alias("prevalence"),
        (F.col("neg") / F.greatest(F.lit(1), F.col("pos"))).alias("imbalance_ratio"),
        F.try_divide(F.col("n"), F.lit(2) * F.col("pos")).alias("w_pos_balanced"),
        F.try_divide(F.col("n"), F.lit(2) * F.col("neg")).alias("w_neg_balanced"),
        F.try_divide(F.lit(1.0), F.col("pos")).alias("w_pos_inverse"),
        F.try_divide(F.lit(1.0), F.col("neg")).alias("w_neg_inverse"))


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """The first rows (deterministic when ``order`` is given)."""
    return (df.orderBy(*order) if order else df).limit(n)
