"""Evaluation operators over scored tables.

A scored table has group columns (model, subgroup, replicate, ...), a 0/1 label, a
score and optionally a hard prediction and a row weight. Every metric is computed
per group with one aggregation; metrics that are undefined come back NULL.

Cumulative counts by descending score (F9) are built from distinct scores only. To
keep one large group off a single task, distinct scores are ranged into cells of like
depth: the running sum restarts in each (group, cell) and a small table of cells
supplies the offset of everything above. Grid-based threshold searches
reduce the data to per-grid-cell counts first, so they cost one pass, not one pass
per threshold.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import checked_broadcast, materialise
from .ranges import running_sums

def _w(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def score_steps(scored: DataFrame, group: Sequence[str] = (), label: str = "y_true", score: str = "y_prob",
                weight: str | None = None, cells: int | None = None) -> DataFrame:
    """one row per (group, distinct score) with ``pos``/``neg`` at that score and the
    cumulative ``tp``/``fp`` over all scores >= it, plus group totals ``P``/``N``.

    Distinct scores are ranged by (group, score) into ``cells`` partitions of like depth, by
    default the session's shuffle partitions, so crowded scores are cut as finely as others.
    The sums run inside each range before it is written, so no row is shuffled again for them."""
    g = list(group)
    y = F.col(label).cast("double")
    per_score = scored.groupBy(*g, F.col(score).cast("double").alias("s")).agg(
        F.sum(_w(weight) * y).alias("pos"), F.sum(_w(weight) * (F.lit(1.0) - y)).alias("neg"))
    cells = cells or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: the cut points are sampled, so a second evaluation could cut elsewhere
    order = [*[F.asc(c) for c in g], F.desc("s")]
    ranged = per_score.repartitionByRange(cells, *order).withColumn("_b", F.spark_partition_id())
    per_score = materialise(running_sums(ranged.sortWithinPartitions(*order), g, ["pos", "neg"]))
    sums = per_score.groupBy(*g, "_b").agg(F.sum("pos").alias("_cp"), F.sum("neg").alias("_cn"))
    above = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    sums = sums.select(*g, "_b",
                       F.coalesce(F.sum("_cp").over(above), F.lit(0.0)).alias("_otp"),
                       F.coalesce(F.sum("_cn").over(above), F.lit(0.0)).alias("_ofp"),
                       F.sum("_cp").over(whole).alias("P"), F.sum("_cn").over(whole).alias("N"))
    steps = null_safe_join(per_score, checked_broadcast(sums), [*g, "_b"])
    return steps.select(*g, "s", "pos", "neg",
                        (F.col("_otp") + F.col("_run_pos")).alias("tp"),
                        (F.col("_ofp") + F.col("_run_neg")).alias("fp"), "P", "N")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL, so the rows of a NULL group stay."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def auroc_ap(steps: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """N1 + N2: tie-aware AUROC and step-wise average precision; NULL for one class."""
    auc = F.sum(F.col("pos") * (F.col("N") - F.col("fp") + F.lit(0.5) * F.col("neg")))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = steps.groupBy(*group).agg(auc.alias("_auc"), ap.alias("_ap"), F.max("P").alias("P"), F.max("N").alias("N"))
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    return out.select(*group, F.when(ok, F.col("_auc") / (F.col("P") * F.col("N"))).alias("auroc"),
                      F.when(ok, F.col("_ap") / F.col("P")).alias("ap"))


def roc_points(steps: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr, threshold) at every distinct score plus the (0, 0) start with an
    infinite threshold. NULL rates when a class is absent."""
    g = list(group)
    pts = steps.select(*g, F.col("s").alias("threshold"),
                       F.try_divide(F.col("fp"), F.col("N")).alias("fpr"),
                       F.try_divide(F.col("tp"), F.col("P")).alias("tpr"))
    start = steps.groupBy(*g).agg(F.lit(float("inf")).alias("threshold"),
                                  F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_points(steps: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(recall, precision, threshold) at every distinct score, the (0, 1) end point
    (NULL threshold) and the prevalence baseline. Recall is 1 when there is no
    positive."""
    g = list(group)
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0))
    prev = F.col("P") / (F.col("P") + F.col("N"))
    pts = steps.select(*g, F.col("s").alias("threshold"), rec.alias("recall"),
                       (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), prev.alias("baseline"))
    end = steps.groupBy(*g).agg(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"),
                                F.lit(1.0).alias("precision"), (F.max("P") / (F.max("P") + F.max("N"))).alias("baseline"))
    return pts.unionByName(end)


def f1_expr(tp, fp, fn) -> Column:
    d = F.lit(2.0) * tp + fp + fn
    return F.when(d > 0, F.lit(2.0) * tp / d).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, group: Sequence[str] = (), label: str = "y_true", pred: str = "y_pred",
              weight: str | None = None) -> DataFrame:
    """N4 (dense 2x2) + N3 + N5: counts, precision/recall/F1 (zero division -> 0),
    TPR/FPR (NULL on zero denominator), accuracy."""
    y, p, w = F.col(label).cast("int"), F.col(pred).cast("int"), _w(weight)
    out = scored.groupBy(*group).agg(
        F.sum(F.when((y == 0) & (p == 0), w).otherwise(0.0)).alias("tn"),
        F.sum(F.when((y == 0) & (p == 1), w).otherwise(0.0)).alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), w).otherwise(0.0)).alias("fn"),
        F.sum(F.when((y == 1) & (p == 1), w).otherwise(0.0)).alias("tp"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select(
        *group, "tn", "fp", "fn", "tp",
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"),
        f1_expr(tp, fp, fn).alias("f1"),
        F.when(tp + fn > 0, tp / (tp + fn)).alias("tpr"),
        F.when(fp + tn > 0, fp / (fp + tn)).alias("fpr"),
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def multiclass_report(scored: DataFrame, group: Sequence[str] = (), label: str = "y_true",
                      pred: str = "y_pred", weight: str | None = None) -> DataFrame:
    """Per-class precision, recall, F1 and support over the union of true and
    predicted classes, with 'macro avg' and 'weighted avg' rows (zero division -> 0)."""
    g, w = list(group), _w(weight)
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    pairs = scored.select(*g, y.alias("_y"), p.alias("_p"), w.alias("_w"))
    true_side = pairs.select(*g, F.col("_y").alias("cls"), F.col("_w").alias("support"),
                             F.when(F.col("_y") == F.col("_p"), F.col("_w")).otherwise(0.0).alias("tp"),
                             F.lit(0.0).alias("pred_n"))
    pred_side = pairs.select(*g, F.col("_p").alias("cls"), F.lit(0.0).alias("support"), F.lit(0.0).alias("tp"),
                             F.col("_w").alias("pred_n"))
    per = true_side.unionByName(pred_side).groupBy(*g, "cls").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("pred_n").alias("pred_n"))
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = f1_expr(F.col("tp"), F.col("pred_n") - F.col("tp"), F.col("support") - F.col("tp"))
    per = per.select(*g, F.col("cls").cast("string").alias("label"), prec.alias("precision"),
                     rec.alias("recall"), f1.alias("f1"), "support")
    tot = F.sum("support")
    macro = per.groupBy(*g).agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                                F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    wavg = per.groupBy(*g).agg(F.lit("weighted avg").alias("label"),
                               (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                               (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                               (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support"))
    return per.unionByName(macro).unionByName(wavg)


# Probability columns of the four length-of-stay classes.
CLASS_PROBS = ("p0", "p1", "p2", "p3")


def one_vs_rest(scored: DataFrame, group: Sequence[str] = (), label: str = "y_cls", probs: Sequence[str] = CLASS_PROBS,
                key: str | None = None, weight: str | None = None) -> DataFrame:
    """One row per row and class ``k``: its probability ``p`` and whether it is the true class, ``_t``."""
    arr = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("p")) for k, c in enumerate(probs)])
    more = [F.col(c) for c in (key,) if c] + ([F.col(weight).alias("_wt")] if weight else [])
    long = scored.select(*group, F.col(label).cast("int").alias("_y"), *more, F.inline(arr))
    return long.withColumn("_t", (F.col("_y") == F.col("k")).cast("int"))


def mean_of_classes(per: DataFrame, by: Sequence[str], name: str, classes: int) -> DataFrame:
    """Mean AUROC over the classes; NULL when any class lacks positives or negatives."""
    return per.groupBy(*by).agg(F.when(F.count("auroc") == classes, F.avg("auroc")).alias(name))


def ovr_macro_auroc(scored: DataFrame, group: Sequence[str] = (), label: str = "y_cls",
                    probs: Sequence[str] = CLASS_PROBS, weight: str | None = None) -> DataFrame:
    """Mean over classes of one-vs-rest AUROC; NULL when any class lacks positives
    or negatives."""
    long = one_vs_rest(scored, group, label, probs, weight=weight)
    per = auroc_ap(score_steps(long, [*group, "k"], "_t", "p", "_wt" if weight else None), [*group, "k"])
    return mean_of_classes(per, group, "auroc_ovr_macro", len(probs))


def regression_errors(scored: DataFrame, group: Sequence[str] = (), y: str = "y", yhat: str = "yhat",
                      weight: str | None = None) -> DataFrame:
    """MAE, RMSE and R^2 = 1 - SSE/SST (NULL when SST is 0)."""
    w = _w(weight)
    e = F.col(yhat).cast("double") - F.col(y).cast("double")
    yy = F.col(y).cast("double")
    out = scored.groupBy(*group).agg(F.sum(w).alias("n"), F.sum(w * F.abs(e)).alias("sae"),
                                     F.sum(w * e * e).alias("sse"), F.sum(w * yy).alias("sy"),
                                     F.sum(w * yy * yy).alias("syy"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return out.select(*group, (F.col("sae") / F.col("n")).alias("mae"),
                      F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
                      F.when(sst > 0, F.lit(1.0) - F.col("sse") / sst).alias("r2"))


def calibration_bin(p, n_bins: int = 10) -> Column:
    """N14 bin: number of interior edges i/n_bins (as NumPy's linspace builds them) <= p."""
    step = 1.0 / n_bins
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_bins - 1)), F.lit(0),
                       lambda acc, i: acc + F.when(p >= i * F.lit(step), 1).otherwise(0))


def reliability(scored: DataFrame, group: Sequence[str] = (), label: str = "y_true", score: str = "y_prob",
                n_bins: int = 10) -> DataFrame:
    """Dense bins 0..n_bins-1 with count, mean prediction and observed rate."""
    g = list(group)
    b = scored.select(*g, calibration_bin(F.col(score).cast("double"), n_bins).alias("bin"),
                      F.col(score).cast("double").alias("_p"), F.col(label).cast("double").alias("_y"))
    agg = b.groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"), F.avg("_p").alias("mean_pred"),
                                   F.avg("_y").alias("frac_pos"))
    grid = scored.select(*g).distinct().select(*g, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    out = null_safe_join(grid, agg, [*g, "bin"], "left")
    return out.select(*g, "bin", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "mean_pred", "frac_pos")


def ece(bins: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Sum over non-empty bins of |frac_pos - mean_pred| * count / N."""
    out = bins.groupBy(*group).agg(
        F.sum(F.when(F.col("count") > 0, F.abs(F.col("frac_pos") - F.col("mean_pred")) * F.col("count"))).alias("_s"),
        F.sum("count").alias("_n"))
    return out.select(*group, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("ece"))


def brier(scored: DataFrame, group: Sequence[str] = (), label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """N12."""
    d = F.col(score).cast("double") - F.col(label).cast("double")
    return scored.groupBy(*group).agg(F.avg(d * d).alias("brier"))


def multiclass_brier(scored: DataFrame, group: Sequence[str] = (), label: str = "y_cls",
                     probs: Sequence[str] = ("p0", "p1", "p2", "p3")) -> DataFrame:
    """Mean over rows of the squared distance to the one-hot label."""
    y = F.col(label).cast("int")
    s = None
    for k, c in enumerate(probs):
        t = F.col(c).cast("double") - F.when(y == k, 1.0).otherwise(0.0)
        s = t * t if s is None else s + t * t
    return scored.groupBy(*group).agg(F.avg(s).alias("brier_multiclass"))


def top_label(scored: DataFrame, label: str = "y_cls", probs: Sequence[str] = ("p0", "p1", "p2", "p3")) -> DataFrame:
    """N16 input + K9: confidence = max prob, predicted class = first argmax, correct flag."""
    arr = F.array(*[F.col(c).cast("double") for c in probs])
    return (scored.withColumn("conf", F.array_max(arr))
            .withColumn("pred_cls", (F.array_position(arr, F.array_max(arr)) - 1).cast("int"))
            .withColumn("correct", (F.col("pred_cls") == F.col(label).cast("int")).cast("int")))


# ---- thresholds ------------------------------------------------------------------
def grid_value(idx, start: float, stop: float, num: int) -> Column:
    """Value at ascending position ``idx`` of NumPy's ``linspace(start, stop, num)``
    (i*step + start, last point = stop exactly), for ascending or descending grids."""
    step = (stop - start) / (num - 1)
    m = idx if start < stop else F.lit(num - 1) - idx
    return F.when(m == num - 1, F.lit(stop)).otherwise(m.cast("double") * F.lit(step) + F.lit(start))


def grid_counts(scored: DataFrame, group: Sequence[str], start: float, stop: float, num: int,
                label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Counts at every threshold t_j of ``linspace(start, stop, num)`` (ascending j):
    tp/fp of the predictions p >= t_j, with class totals P/N.

    Each row is mapped to c = #{grid points <= p}: an arithmetic estimate corrected by
    comparing with the exact grid values next to it. Rows are reduced to sums per
    (group, c), and tp(t_j) is the suffix sum over c > j: at most num + 1 cells per
    group, one pass over the data for all thresholds.
    """
    g = list(group) or ["_all"]
    src = scored if group else scored.withColumn("_all", F.lit(0))
    lo, hi = min(start, stop), max(start, stop)
    step = (hi - lo) / (num - 1)
    base = src.select(*g, F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y"))
    e = F.least(F.greatest(F.floor((F.col("_s") - F.lit(lo)) / F.lit(step)), F.lit(-1)), F.lit(num - 1)).cast("int")
    base = base.withColumn("_e", e).withColumn("_lo", F.greatest(F.col("_e") - 1, F.lit(0)))
    cnt = F.col("_lo")
    for d in range(4):
        i = F.col("_lo") + F.lit(d)
        ok = (i <= F.least(F.col("_e") + 2, F.lit(num - 1))) & (grid_value(i, start, stop, num) <= F.col("_s"))
        cnt = cnt + F.when(ok, 1).otherwise(0)
    cells = base.withColumn("c", cnt).groupBy(*g, "c").agg(
        F.sum("_y").alias("cp"), F.sum(F.lit(1.0) - F.col("_y")).alias("cn"))
    dense = src.select(*g).distinct().select(*g, F.explode(F.sequence(F.lit(0), F.lit(num))).alias("c"))
    dense = null_safe_join(dense, cells, [*g, "c"], "left").fillna(0.0, ["cp", "cn"])
    suffix = Window.partitionBy(*g).orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*g)
    dense = dense.select(*g, "c", F.sum("cp").over(suffix).alias("tp"), F.sum("cn").over(suffix).alias("fp"),
                         F.sum("cp").over(whole).alias("P"), F.sum("cn").over(whole).alias("N"))
    out = dense.filter(F.col("c") >= 1).select(
        *g, (F.col("c") - 1).alias("j"), grid_value(F.col("c") - 1, start, stop, num).alias("t"),
        "tp", "fp", "P", "N")
    return out if group else out.drop("_all")


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, P = F.col("tp"), F.col("fp"), F.col("P")
    return df.select("*", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
                     F.when(P > 0, tp / P).otherwise(0.0).alias("recall"),
                     f1_expr(tp, fp, P - tp).alias("f1"))


def best_f1_threshold(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Grid threshold with the highest F1, lowest threshold on ties."""
    r = _rates(counts)
    best = F.min_by(F.struct("t", "f1", "precision", "recall"), F.struct(-F.col("f1"), F.col("t")))
    return r.groupBy(*group).agg(best.alias("b")).select(*group, F.col("b.t").alias("threshold"),
                                                         F.col("b.f1").alias("f1"), F.col("b.precision").alias("precision"),
                                                         F.col("b.recall").alias("recall"))


def recall_target_threshold(counts: DataFrame, group: Sequence[str] = (), target: float = 0.70) -> DataFrame:
    """Highest grid threshold whose recall reaches ``target`` (NULL when none)."""
    r = _rates(counts)
    pick = F.max_by(F.struct("t", "precision", "recall", "f1"),
                    F.when(F.col("recall") >= F.lit(target), F.col("t")))
    return r.groupBy(*group).agg(pick.alias("b")).select(
        *group, F.col("b.t").alias("threshold"), F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"), F.col("b.f1").alias("f1"))


def precision_target_threshold(counts: DataFrame, group: Sequence[str] = (), target: float = 0.50) -> DataFrame:
    """Lowest grid threshold whose precision reaches ``target`` (NULL when none)."""
    r = _rates(counts)
    pick = F.min_by(F.struct("t", "precision", "recall", "f1"),
                    F.when(F.col("precision") >= F.lit(target), F.col("t")))
    return r.groupBy(*group).agg(pick.alias("b")).select(
        *group, F.col("b.t").alias("threshold"), F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"), F.col("b.f1").alias("f1"))


# Threshold grids of the reference's tuning helpers.
F1_GRID = (0.001, 0.99, 1200)
RECALL_GRID = (0.999, 0.001, 2000)
PRECISION_GRID = (0.001, 0.999, 2000)


def threshold_policy(scored: DataFrame, group: Sequence[str] = (), mode: str = "f1", target_recall: float = 0.70,
                     target_precision: float = 0.50, label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Threshold by policy ('f1' | 'recall' | 'precision'), falling back to the
    best-F1 grid threshold when the target is never reached."""
    f1 = best_f1_threshold(grid_counts(scored, group, *F1_GRID, label=label, score=score), group)
    if mode == "f1":
        return f1.select(*group, "threshold", F.lit("f1").alias("source"))
    if mode == "recall":
        pol = recall_target_threshold(grid_counts(scored, group, *RECALL_GRID, label=label, score=score),
                                      group, target_recall)
    elif mode == "precision":
        pol = precision_target_threshold(grid_counts(scored, group, *PRECISION_GRID, label=label, score=score),
                                         group, target_precision)
    else:
        raise ValueError(f"unknown threshold policy {mode!r}: use f1, recall or precision")
    both = null_safe_join(f1.select(*group, F.col("threshold").alias("_f1t")), pol.select(*group, "threshold"), list(group), "left")
    return both.select(*group, F.coalesce("threshold", "_f1t").alias("threshold"),
                       F.when(F.col("threshold").isNotNull(), F.lit(mode)).otherwise(F.lit("f1")).alias("source"))


def fit_policy(scored: DataFrame, group: str, mode: str = "f1", target_recall: float = 0.70, target_precision: float = 0.50,
               min_n: int = 50, min_pos: int = 10, label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """N21 fit: (group, overall, threshold, source), one row for each group with at least ``min_n`` rows
    and ``min_pos`` positives, and one with ``overall`` true, for all other groups."""
    args = (mode, target_recall, target_precision, label, score)
    n = scored.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("int")).alias("_p"))
    enough = n.filter((F.col("_n") >= min_n) & (F.col("_p") >= min_pos)).select(group)
    own = null_safe_join(threshold_policy(scored, [group], *args), enough, [group])
    kind = dict(scored.dtypes)[group]
    every = threshold_policy(scored, [], *args).select(F.lit(None).cast(kind).alias(group), F.lit(True).alias("overall"), "threshold", "source")
    return materialise(own.select(group, F.lit(False).alias("overall"), "threshold", "source").unionByName(every))


def apply_policy(scored: DataFrame, policy: DataFrame, group: str, score: str = "y_prob", pred: str = "y_pred") -> DataFrame:
    """N21 applied to another split: every row by its group's threshold, or by the overall one where
    the group has none. Adds ``threshold``, ``source`` ('overall' where it is that one) and ``pred``."""
    own = policy.filter(~F.col("overall")).select(group, F.col("threshold").alias("_own"), F.col("source").alias("_src"))
    every = policy.filter("overall").agg(F.max("threshold").alias("_all")).withColumn("_one", F.lit(1))
    out = null_safe_join(scored, checked_broadcast(own), [group], "left")
    out = out.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").drop("_one")
    out = out.withColumn("threshold", F.coalesce("_own", "_all")).withColumn("source", F.coalesce("_src", F.lit("overall")))
    return out.withColumn(pred, (F.col(score) >= F.col("threshold")).cast("int")).drop("_own", "_src", "_all")


def best_f1_observed(steps: DataFrame, group: Sequence[str] = (), min_pos: int = 10) -> DataFrame:
    """Over the observed scores, the threshold with the best F1 among those that
    predict at least ``min_pos`` positives (lowest on ties); otherwise the best
    smoothed F1 over the PR points; 0.5 when there is no score."""
    tp, fp, P = F.col("tp"), F.col("fp"), F.col("P")
    f1 = f1_expr(tp, fp, P - tp)
    prec = tp / (tp + fp)
    rec = F.when(P > 0, tp / P).otherwise(F.lit(1.0))
    smooth = F.lit(2.0) * prec * rec / (prec + rec + F.lit(1e-12))
    r = steps.select(*group, "s", f1.alias("f1"), smooth.alias("sf1"), (tp + fp >= F.lit(min_pos)).alias("ok"))
    best = F.min_by(F.col("s"), F.when(F.col("ok"), F.struct(-F.col("f1"), F.col("s"))))
    fb = F.min_by(F.col("s"), F.struct(-F.col("sf1"), F.col("s")))
    out = r.groupBy(*group).agg(best.alias("_b"), fb.alias("_fb"))
    return out.select(*group, F.coalesce("_b", "_fb", F.lit(0.5)).alias("threshold"),
                      F.when(F.col("_b").isNotNull(), "min_pos").otherwise("fallback").alias("source"))


def losses(scored: DataFrame, group: Sequence[str] = (), label: str = "y_true", score: str | None = "y_prob",
           gamma: float = 2.0, alpha: float = 0.25, y_reg: str | None = None, yhat_reg: str | None = None,
           beta: float = 0.5) -> DataFrame:
    """Mean log-loss and focal loss of probabilities (clipped to [1e-7, 1-1e-7]),
    and smooth-L1 (Huber, ``beta``) of a regression pair when given."""
    aggs = []
    if score is not None:
        p = F.least(F.greatest(F.col(score).cast("double"), F.lit(1e-7)), F.lit(1 - 1e-7))
        y = F.col(label).cast("double")
        pt = y * p + (F.lit(1.0) - y) * (F.lit(1.0) - p)
        at = y * F.lit(alpha) + (F.lit(1.0) - y) * F.lit(1 - alpha)
        aggs += [F.avg(-F.log(pt)).alias("log_loss"),
                 F.avg(-at * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * F.log(pt)).alias("focal_loss")]
    if y_reg and yhat_reg:
        d = F.abs(F.col(yhat_reg).cast("double") - F.col(y_reg).cast("double"))
        aggs.append(F.avg(F.when(d < F.lit(beta), F.lit(0.5) * d * d / F.lit(beta))
                          .otherwise(d - F.lit(0.5 * beta))).alias("smooth_l1"))
    return scored.groupBy(*group).agg(*aggs)
