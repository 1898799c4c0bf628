"""Metrics against brute-force NumPy definitions on small inputs, plus edge rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import metrics as M


def _df(spark, y, p, group=None):
    rows = [(int(a), float(b), (group[i] if group else "g")) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "y_true int, y_prob double, race string")


def _auc_pairs(y, p):
    pos = p[y == 1]
    neg = p[y == 0]
    s = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _ap(y, p):
    order = np.argsort(-p, kind="mergesort")
    ys, ps = y[order], p[order]
    thr = np.unique(ps)[::-1]
    P = y.sum()
    ap, prev_r = 0.0, 0.0
    for t in thr:
        pred = p >= t
        tp = (pred & (y == 1)).sum()
        r = tp / P
        prec = tp / pred.sum()
        ap += (r - prev_r) * prec
        prev_r = r
    return ap


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_auroc_ap_bruteforce(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300), 2)  # ties on purpose
    out = M.auroc_ap(M.score_steps(_df(spark, y, p))).collect()[0]
    assert out.auroc == pytest.approx(_auc_pairs(y, p), abs=1e-12)
    assert out.ap == pytest.approx(_ap(y, p), abs=1e-12)


def test_one_class_group_is_null(spark):
    out = M.auroc_ap(M.score_steps(_df(spark, [0, 0, 0], [0.1, 0.5, 0.9]))).collect()[0]
    assert out.auroc is None and out.ap is None


def test_extreme_scores_and_many_buckets(spark):
    y = np.array([1, 0, 1, 0, 1, 0])
    p = np.array([0.0, 0.0, 1.0, 1.0, 50.0, -50.0])
    out = M.auroc_ap(M.score_steps(_df(spark, y, p), cells=4)).collect()[0]
    assert out.auroc == pytest.approx(_auc_pairs(y, p))


def test_reliability_bins_match_digitize(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([np.round(rng.random(500), 3), [0.0, 0.3, 0.6, 1.0, 0.1, 0.7]])
    y = rng.integers(0, 2, len(p))
    bins = M.reliability(_df(spark, y, p), []).orderBy("bin").collect()
    ref = np.digitize(p, np.linspace(0.0, 1.0, 11)[1:-1], right=False)
    assert [b["count"] for b in bins] == [int((ref == k).sum()) for k in range(10)]
    e = M.ece(M.reliability(_df(spark, y, p), []), []).collect()[0].ece
    assert 0.0 <= e <= 1.0


def test_grid_threshold_matches_loop(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400), 3)
    ts = np.linspace(0.001, 0.99, 1200)

    def f1(t):
        pred = p >= t
        tp = (pred & (y == 1)).sum()
        fp = (pred & (y == 0)).sum()
        fn = ((~pred) & (y == 1)).sum()
        return 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)
    f1s = [f1(t) for t in ts]
    best = M.best_f1_threshold(M.grid_counts(_df(spark, y, p), [], 0.001, 0.99, 1200)).collect()[0]
    assert best.threshold == ts[int(np.argmax(f1s))]
    assert best.f1 == pytest.approx(max(f1s))
    # highest threshold on the descending grid with recall >= 0.7
    td = np.linspace(0.999, 0.001, 2000)
    want = next(t for t in td if ((p >= t) & (y == 1)).sum() / y.sum() >= 0.7)
    got = M.recall_target_threshold(M.grid_counts(_df(spark, y, p), [], 0.999, 0.001, 2000)).collect()[0]
    assert got.threshold == want


def test_confusion_zero_division(spark):
    df = _df(spark, [0, 0], [0.1, 0.2]).withColumn("y_pred", F.lit(0))
    r = M.confusion(df).collect()[0]
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0 and r.tpr is None


def test_weighted_metrics_equal_replicated_rows(spark):
    """Integer weights must act exactly like repeating rows (the bootstrap relies on it)."""
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 200)
    p = np.round(rng.random(200), 2)
    w = rng.integers(0, 4, 200)
    rows = [(int(a), float(b), int(c), "g", float(c)) for a, b, c in zip(y, p, w)]
    df = spark.createDataFrame(rows, "y_true int, y_prob double, y_pred_src int, race string, w double")
    df = df.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))
    weighted = M.auroc_ap(M.score_steps(df, weight="w")).collect()[0]
    yr, pr = np.repeat(y, w), np.repeat(p, w)
    assert weighted.auroc == pytest.approx(_auc_pairs(yr, pr), abs=1e-12)
    assert weighted.ap == pytest.approx(_ap(yr, pr), abs=1e-12)
    conf = M.confusion(df, weight="w").collect()[0]
    tp = ((pr >= 0.5) & (yr == 1)).sum()
    fp = ((pr >= 0.5) & (yr == 0)).sum()
    fn = ((pr < 0.5) & (yr == 1)).sum()
    assert conf.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))


def test_stratified_replicates_keep_class_totals(spark):
    from wardline.operators import bootstrap as B
    rng = np.random.default_rng(11)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "hadm_id long, y_true int")
    rep = B.replicate(df, "hadm_id", 20, 3, "md5", stratify="y_true")
    tot = rep.groupBy("replicate", "y_true").agg(F.sum("w").alias("s")).collect()
    orig = {r.y_true: r.n for r in df.groupBy("y_true").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(tot) == 40
    for r in tot:
        assert r.s == pytest.approx(orig[r.y_true])


def test_score_cells_are_balanced(spark):
    """Rare-event scores: nearly all below a thousandth, which a fixed-width cut leaves in one cell."""
    rng = np.random.default_rng(4)
    p = np.append(rng.beta(0.4, 900, 8000), rng.random(80))
    y = (rng.random(len(p)) < p).astype(int)
    df = _df(spark, y.tolist(), p.tolist())
    plan = M.score_steps(df, cells=16)
    cells = plan.withColumn("cell", F.spark_partition_id())
    assert cells.count() == len(np.unique(p))
    cut = df.select(F.col("y_prob").alias("s")).distinct().repartitionByRange(16, F.desc("s")).groupBy(F.spark_partition_id()).count()
    depth = [r["count"] for r in cut.collect()]
    assert len(depth) == 16 and max(depth) < 3 * np.mean(depth)
    order = np.argsort(-p, kind="stable")
    tp = dict(zip(p[order], np.cumsum(y[order]), strict=True))
    got = {r.s: r.tp for r in plan.collect()}
    assert all(got[s] == tp[s] for s in got)
