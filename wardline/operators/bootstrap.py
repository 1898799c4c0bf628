"""Bootstrap confidence intervals.

Resampling n rows with replacement is replaced by independent Poisson(1) weights per
(replicate, row), drawn from a hash of (seed, replicate, row key): deterministic,
reproducible in SQL, and needing no shuffle to draw. The hash ("mix") is integer
arithmetic in the style of SplitMix, which DuckDB evaluates bit for bit. Every metric is
computed for all replicates at once by ``replicates``; the CI is the exact
linear-interpolated percentile over replicates. ``replicate`` gives the rows x replicates
table itself, for a caller's own metric.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .poisson import FMIX_STAGES, MIX_MASK, MIX_STEP, POISSON1_CDF, fmix31
from .replicates import Weights, replicate_ranking, replicate_sums
from ..plans.sizing import materialise

def _fmix_stage(h: Column, op: str, v: int) -> Column:
    return h.bitwiseXOR(F.shiftright(h, v)) if op == "xor" else (h * F.lit(v)).bitwiseAND(F.lit(MIX_MASK))


def with_fmix(df: DataFrame, col: str) -> DataFrame:
    """Apply the finaliser to ``col`` as one projection per stage: each stage reads the
    previous one twice, so staging keeps every (row, replicate) at one evaluation
    (the optimizer does not merge projections that would duplicate such work)."""
    for op, v in FMIX_STAGES:
        df = df.withColumn(col, _fmix_stage(F.col(col), op, v))
    return df


def _fmix_col(h: Column) -> Column:
    for op, v in FMIX_STAGES:
        h = _fmix_stage(h, op, v)
    return h


def _key_words(key: Column) -> tuple[Column, Column]:
    k = key.cast("bigint")
    return k.bitwiseAND(F.lit(MIX_MASK)), F.shiftright(k, 31).bitwiseAND(F.lit(MIX_MASK))


def with_key_hash(df: DataFrame, seed: int, key: str, out: str = "_k1") -> DataFrame:
    """Per-row part of the "mix" hash: fmix(fmix(fmix(seed) ^ key_lo) ^ key_hi)."""
    lo, hi = _key_words(F.col(key))
    df = with_fmix(df.withColumn(out, F.lit(fmix31(seed & MIX_MASK)).cast("bigint").bitwiseXOR(lo)), out)
    return with_fmix(df.withColumn(out, F.col(out).bitwiseXOR(hi)), out)


def unit_from_hash(seed: int, replicate: Column, key: Column, method: str = "mix") -> Column:
    """Uniform [0, 1) from (seed, replicate, key): "mix" (integer, SQL-reproducible,
    the default), md5 (SQL-reproducible) or xxhash64. As one expression; the replicate
    plan stages "mix" with ``with_key_hash`` / ``with_fmix`` instead."""
    if method == "mix":
        lo, hi = _key_words(key)
        k1 = _fmix_col(_fmix_col(F.lit(fmix31(seed & MIX_MASK)).cast("bigint").bitwiseXOR(lo)).bitwiseXOR(hi))
        h = _fmix_col((k1 + replicate.cast("bigint") * F.lit(MIX_STEP)).bitwiseAND(F.lit(MIX_MASK)))
        return h.cast("double") / F.lit(float(1 << 31))
    if method == "md5":
        h = F.md5(F.concat(F.lit(f"{seed}:"), replicate.cast("string"), F.lit(":"), key.cast("string")))
        return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(float(2 ** 32))
    h = F.xxhash64(F.lit(seed), replicate, key)
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def poisson1(u: Column) -> Column:
    """Inverse CDF of Poisson(1) at ``u``."""
    k = F.lit(0)
    for c in POISSON1_CDF:
        k = k + F.when(u >= F.lit(c), 1).otherwise(0)
    return k


def replicate(df: DataFrame, key: str, n_boot: int, seed: int = 42, method: str = "mix",
              stratify: str | None = None, group: Sequence[str] = (), keep_zero: bool = False) -> DataFrame:
    """Rows x replicates with weight ``w`` > 0 (rows drawn 0 times are dropped;
    ``keep_zero`` keeps them with ``w`` = 0 for callers that only sum weights).

    With ``stratify`` (L6) the weights are rescaled inside each (group, replicate,
    class) so that every class keeps its original total, as a class-stratified
    resample does.
    """
    if method == "mix":
        # the key hash once per row, then one finaliser per (row, replicate)
        rep = with_key_hash(df, seed, key).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
        step = F.col("replicate").cast("bigint") * F.lit(MIX_STEP)
        rep = with_fmix(rep.withColumn("_h", (F.col("_k1") + step).bitwiseAND(F.lit(MIX_MASK))), "_h")
        rep = rep.withColumn("_u", F.col("_h").cast("double") / F.lit(float(1 << 31))).drop("_k1", "_h")
    else:
        rep = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
        rep = rep.withColumn("_u", unit_from_hash(seed, F.col("replicate"), F.col(key), method))
    if not keep_zero or stratify:
        # weight > 0  <=>  u >= P(K = 0); filtering on u keeps the hash out of the
        # Poisson expression when the optimizer pushes the filter down
        rep = rep.filter(F.col("_u") >= F.lit(POISSON1_CDF[0]))
    rep = rep.withColumn("w", poisson1(F.col("_u")).cast("double")).drop("_u")
    if stratify:
        g = list(group)
        orig = df.groupBy(*g, stratify).agg(F.count(F.lit(1)).alias("_n_c"))
        drawn = rep.groupBy(*g, "replicate", stratify).agg(F.sum("w").alias("_w_c"))
        rep = rep.join(drawn, [*g, "replicate", stratify]).join(orig, [*g, stratify])
        rep = rep.withColumn("w", F.col("w") * F.col("_n_c") / F.col("_w_c")).drop("_n_c", "_w_c")
    return rep


# ---- metric registry (O3): a family gives its metrics for rows, and for every replicate ----


def _confusion_replicates(df, by, key, n_boot, seed, stratify):
    cells = replicate_sums(df, [*by, "y_true", "y_pred"], key, n_boot, seed)
    return M.confusion(class_totals_kept(cells, df, by, stratify, "y_true", ("w",)), [*by, "replicate"], weight="w")


def _macro_f1_replicates(df, by, key, n_boot, seed, stratify):
    # a class that a replicate never drew is not among its classes
    cells = replicate_sums(df, [*by, "y_cls", "pred_cls"], key, n_boot, seed).where("w > 0")
    return _macro_f1(class_totals_kept(cells, df, by, stratify, "y_cls", ("w",)), [*by, "replicate"], "w")


def _regression_replicates(df, by, key, n_boot, seed, stratify):
    e = F.col("yhat").cast("double") - F.col("y").cast("double")
    cells = replicate_sums(df, [*by, *([stratify] if stratify else [])], key, n_boot, seed, {"sae": F.abs(e), "sse": e * e})
    cells = class_totals_kept(cells, df, by, stratify, stratify, ("sae", "sse", "w"))
    out = cells.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in ("w", "sae", "sse")])
    return out.select(*by, "replicate", F.try_divide("sae", "w").alias("mae"), F.sqrt(F.try_divide("sse", "w")).alias("rmse"))


def _ranking_replicates(df, by, key, n_boot, seed, stratify, metrics=("auroc", "ap")):
    if stratify not in (None, "y_true"):
        raise ValueError("ranking metrics keep the totals of their own classes: stratify by y_true")
    return replicate_ranking(df, by, "y_true", "y_prob", key, n_boot, seed, stratify is not None, "ap" in metrics)


def _ovr_replicates(df, by, key, n_boot, seed, stratify):
    if stratify:
        raise ValueError("one-vs-rest AUROC is not offered with class strata")
    per = replicate_ranking(M.one_vs_rest(df, by, key=key), [*by, "k"], "_t", "p", key, n_boot, seed, ap=False)
    return M.mean_of_classes(per, [*by, "replicate"], "los_auroc", len(M.CLASS_PROBS))


def _macro_f1(df, by, weight):
    rep = M.multiclass_report(df, by, "y_cls", "pred_cls", weight).filter(F.col("label") == "macro avg")
    return rep.select(*by, F.col("f1").alias("los_macro_f1"))


def class_totals_kept(cells: DataFrame, df: DataFrame, by: Sequence[str], stratify: str | None, has: str | None,
                      sums: Sequence[str]) -> DataFrame:
    """Cells of a replicate scaled so that every class keeps its number of rows, from the reduced cells alone."""
    if not stratify:
        return cells
    if stratify != has:
        raise ValueError(f"these metrics keep class totals of {has}, not of {stratify}")
    drawn = cells.groupBy(*by, "replicate", stratify).agg(F.sum("w").alias("_w_c"))
    rows = df.groupBy(*by, stratify).agg(F.count(F.lit(1)).alias("_n_c"))
    both = M.null_safe_join(M.null_safe_join(cells, drawn, [*by, "replicate", stratify]), rows, [*by, stratify])
    factor = F.try_divide(F.col("_n_c"), F.col("_w_c"))
    return both.select(*[F.coalesce(F.col(c) * factor, F.lit(0.0)).alias(c) if c in sums else F.col(c) for c in cells.columns])


# name: (metrics, of rows by group, of every replicate)
FAMILIES = {
    "ranking": (("auroc", "ap"), lambda d, g: M.auroc_ap(M.score_steps(d, g), g), _ranking_replicates),
    "confusion": (("f1", "precision", "recall", "tpr", "fpr"), M.confusion, _confusion_replicates),
    "los_macro_f1": (("los_macro_f1",), lambda d, g: _macro_f1(d, g, None), _macro_f1_replicates),
    "los_auroc": (("los_auroc",), lambda d, g: M.ovr_macro_auroc(d, g, "y_cls").withColumnRenamed("auroc_ovr_macro", "los_auroc"), _ovr_replicates),
    "regression": (("mae", "rmse"), M.regression_errors, _regression_replicates),
}


def _long(parts: list[DataFrame], by: Sequence[str], metrics: Sequence[str], value: str) -> DataFrame:
    out = None
    for part in parts:
        names = [m for m in metrics if m in part.columns]
        pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(value)) for m in names]))
        one = part.select(*by, pairs)
        out = one if out is None else out.unionByName(one)
    return out


def _wanted(metrics: Sequence[str]):
    known = {m for names, _, _ in FAMILIES.values() for m in names}
    if not set(metrics) <= known:
        raise ValueError(f"unknown metrics {sorted(set(metrics) - known)}")
    return [(name, fam) for name, fam in FAMILIES.items() if set(fam[0]) & set(metrics)]


def metric_points(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(group..., metric, point): every requested metric, each family computed once."""
    return _long([rows(df, list(group)) for _, (_, rows, _) in _wanted(metrics)], group, metrics, "point")


def replicate_metrics(df: DataFrame, group: Sequence[str], metrics: Sequence[str], key: str, n_boot: int, seed: int = 42,
                      stratify: str | None = None) -> DataFrame:
    """(group..., replicate, metric, value) of every replicate, written once.

    Count families send a few cells per group out of each task; ranking families shuffle
    the rows once. No table of rows x replicates exists anywhere."""
    parts = []
    for name, (_, _, reps) in _wanted(metrics):
        more = {"metrics": metrics} if name == "ranking" else {}
        parts.append(reps(df, list(group), key, n_boot, seed, stratify, **more))
    return materialise(_long(parts, [*group, "replicate"], metrics, "value"))


def percentile_ci(values: DataFrame, group: Sequence[str], alpha: float = 0.05,
                  min_valid: int = 1) -> DataFrame:
    """Exact percentile interval over the finite replicate values, NULL when fewer
    than ``min_valid`` replicates are valid."""
    v = F.col("value")
    fin = values.filter(v.isNotNull() & ~F.isnan(v))
    q = F.percentile(v, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = fin.groupBy(*group).agg(q.alias("_q"), F.count(F.lit(1)).alias("n_valid"))
    ok = F.col("n_valid") >= F.lit(min_valid)
    return out.select(*group, F.when(ok, F.col("_q")[0]).alias("lo"), F.when(ok, F.col("_q")[1]).alias("hi"),
                      "n_valid")


def bootstrap_ci(scored: DataFrame, metrics: Sequence[str], group: Sequence[str] = (), key: str = "hadm_id",
                 n_boot: int = 2000, alpha: float = 0.05, seed: int = 42, stratify: str | None = None,
                 min_valid: int = 1) -> DataFrame:
    """Point estimate and percentile CI of each metric, per group.

    Replicates where a metric is undefined (e.g. a one-class draw for AUROC) are
    skipped; CIs need ``min_valid`` valid replicates. One row per (group, metric); a NULL
    group is one like the others."""
    g = [*group, "metric"]
    points = metric_points(scored, group, metrics)
    ci = percentile_ci(replicate_metrics(scored, group, metrics, key, n_boot, seed, stratify), g, alpha, min_valid)
    both = points.unionByName(ci, allowMissingColumns=True)
    return both.groupBy(*g).agg(*[F.max(c).alias(c) for c in ("point", "lo", "hi", "n_valid")])


def eligible_groups(scored: DataFrame, group: str, min_n: int) -> DataFrame:
    """Rows of the groups with at least ``min_n`` rows (a partial count + semi join)."""
    scored = scored.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("Unknown")))
    sizes = scored.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return scored.join(sizes.filter(F.col("_n") >= min_n).select(group), group, "left_semi")


def gap_ci(scored: DataFrame, metrics: Sequence[str], group: str = "race", key: str = "hadm_id", n_boot: int = 2000,
           alpha: float = 0.05, seed: int = 42, min_n: int = 25) -> DataFrame:
    """Per metric the disparity gap, max - min over groups with at least ``min_n``
    rows and a defined metric (NULL with fewer than 2 such groups), with a within-group
    bootstrap CI. All metrics share the replicates."""
    eligible = eligible_groups(scored, group, min_n)

    def gap(vals: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
        agg = vals.groupBy(*by).agg(F.max(value).alias("_mx"), F.min(value).alias("_mn"), F.count(value).alias("_k"))
        return agg.select(*by, F.when(F.col("_k") >= 2, F.col("_mx") - F.col("_mn")).alias(value))

    points = gap(metric_points(eligible, [group], metrics), "point", ["metric"])
    reps = gap(replicate_metrics(eligible, [group], metrics, key, n_boot, seed), "value", ["metric", "replicate"])
    return points.join(percentile_ci(reps, ["metric"], alpha, 1), "metric", "left")


# A row's rate is dealt out in parts of at most this rate, each drawn from so many terms of its
# distribution: beyond them lies less than a 2^-53rd.
PART_RATE = 64.0
PART_TERMS = 192
MAX_CLASSES = 10_000


def poisson_bounds(rate: float) -> np.ndarray:
    """P(K <= k) for k = 0..PART_TERMS - 1 at ``rate`` (at most ``PART_RATE``)."""
    return np.cumsum(np.cumprod([math.exp(-rate), *(rate / k for k in range(1, PART_TERMS))]))


def balanced_resample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Class-balanced resampling with replacement. A draw of n rows with class-balanced
    weights takes each row of class c a Poisson number of times, with rate n / (K * n_c).

    The number is the inverse Poisson distribution at the row's hash, so the draw is
    reproducible. A rate above ``PART_RATE`` is the sum of equal parts, each drawn by a hash of
    its own; rows are expanded with ``explode`` (no cap on copies). Only the class sizes, at
    most ``MAX_CLASSES``, are seen by the driver. Adds ``copy``."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    total = sum(r["n"] for r in sizes)
    plan = []
    for i, r in enumerate(sizes):
        rate = total / (len(sizes) * r["n"])
        plan.append((r[label], i, math.ceil(rate / PART_RATE), rate / math.ceil(rate / PART_RATE)))
    if not plan:
        return df.withColumn("copy", F.lit(1))
    bounds = [poisson_bounds(p[3]) for p in plan]

    @F.pandas_udf("int")
    def drawn(keys: pd.Series, part: pd.Series, cls: pd.Series) -> pd.Series:
        u = Weights(seed, 1).unit(keys.to_numpy(np.int64), part.to_numpy())
        c, out = cls.to_numpy(), np.zeros(len(u), np.int32)
        for i in np.unique(c):
            out[c == i] = np.searchsorted(bounds[i], u[c == i], side="right")
        return pd.Series(out)

    kind = df.schema[label].dataType.simpleString()
    classes = df.sparkSession.createDataFrame([p[:3] for p in plan], f"_label {kind}, _cls int, _parts int")
    x = df.join(F.broadcast(classes), F.col(label).eqNullSafe(F.col("_label"))).withColumn("_part", F.explode(F.sequence(F.lit(1), "_parts")))
    x = x.withColumn("_copies", drawn(F.coalesce(F.col(key).cast("bigint"), F.lit(0)), "_part", "_cls"))
    # no filter on the draw: a filter would be pushed below and draw a second time
    copies = F.posexplode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_at", "_zero")
    return x.select(*df.columns, copies).select(*df.columns, (F.col("_at") + 1).alias("copy"))
