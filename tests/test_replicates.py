"""Bootstrap replicates against a loop over the weights, row by row."""
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from wardline.operators import bootstrap as B
from wardline.operators import replicates as R

SCHEMA = "hadm_id long, race string, y_true int, y_prob double, y_pred int, y_cls int, pred_cls int, y double, yhat double"


def rows(n=400, seed=5):
    """A score that a third of all rows share, a NULL group, a group of one class and a repeated key."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        race = [None, "A", "A", "A", "one"][int(rng.integers(5))]
        s = 0.5 if rng.random() < 0.34 else round(float(rng.random()), 2)
        y = 0 if race == "one" else int(rng.random() < 0.2 + 0.4 * s)
        out.append((int(i if i % 9 else i * 10 ** 10), race, y, s, int(s > 0.6), int(rng.integers(3)), int(rng.integers(3)), float(rng.normal()), float(rng.normal())))
    return [*out, out[3], out[4]]


def brute(y, s, w, keep=False):
    y, s, w = np.array(y), np.array(s), np.array(w, float)
    p, n = w[y == 1].sum(), w[y == 0].sum()
    if not p or not n:
        return None, None
    if keep:
        w = np.where(y == 1, w * (y == 1).sum() / p, w * (y == 0).sum() / n)
        p, n = w[y == 1].sum(), w[y == 0].sum()
    right = sum(w[i] * (w[(y == 0) & (s < s[i])].sum() + 0.5 * w[(y == 0) & (s == s[i])].sum()) for i in np.flatnonzero(y == 1))
    ap = sum(w[i] * w[(y == 1) & (s >= s[i])].sum() / w[s >= s[i]].sum() for i in np.flatnonzero((y == 1) & (w > 0)))
    return right / (p * n), ap / p


@pytest.mark.parametrize("keep", [False, True])
def test_ranking_of_every_replicate(spark, keep):
    df = spark.createDataFrame(rows(), SCHEMA)
    drawn = defaultdict(list)
    for r in B.replicate(df, "hadm_id", 7, 42, keep_zero=True).collect():
        drawn[r.race, r.replicate].append((r.y_true, r.y_prob, r.w))
    got = {(r.race, r.replicate): (r.auroc, r.ap) for r in R.replicate_ranking(df, ["race"], "y_true", "y_prob", "hadm_id", 7, 42, keep).collect()}
    assert set(got) == set(drawn) and (None, 1) in got and got["one", 1] == (None, None)
    for at, of in drawn.items():
        assert got[at] == pytest.approx(brute(*zip(*of, strict=True), keep), abs=1e-9), at


def test_parts_are_put_together(spark):
    """One score over several parts, stretches that come in pieces, and no rows at all."""
    df = spark.createDataFrame(rows(600, 8), SCHEMA).withColumn("race", F.lit("x"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.replicate: (r.auroc, r.ap) for r in R.replicate_ranking(df, [], "y_true", "y_prob", "hadm_id", 3, 42).collect()}
        none = R.replicate_ranking(df.where("false"), ["race"], "y_true", "y_prob", "hadm_id", 3, 42).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    drawn = defaultdict(list)
    for r in B.replicate(df, "hadm_id", 3, 42, keep_zero=True).collect():
        drawn[r.replicate].append((r.y_true, r.y_prob, r.w))
    assert none == 0 and len(got) == 3
    for at, of in drawn.items():
        assert got[at] == pytest.approx(brute(*zip(*of, strict=True)), abs=1e-9)


def test_sums_of_every_replicate(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    e = F.col("yhat") - F.col("y")
    got = R.replicate_sums(df, ["race", "y_true"], "hadm_id", 5, 42, {"e": e, "a": F.abs(e)})
    got = {(r.race, r.y_true, r.replicate): (r.w, r.e, r.a) for r in got.where("w > 0").collect()}
    want = B.replicate(df, "hadm_id", 5, 42).withColumn("e", e).groupBy("race", "y_true", "replicate").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("e")).alias("we"), F.sum(F.col("w") * F.abs("e")).alias("wa"))
    want = {(r.race, r.y_true, r.replicate): (r.w, r.we, r.wa) for r in want.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_null_group_has_its_interval(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {(r.race, r.metric): r for r in B.bootstrap_ci(df, ["auroc", "f1", "mae"], ["race"], n_boot=50).collect()}
    assert len(got) == 9
    assert got[None, "auroc"].lo < got[None, "auroc"].point < got[None, "auroc"].hi
    assert got["one", "auroc"].point is None and got["one", "auroc"].n_valid is None and got["one", "mae"].n_valid == 50


def test_class_totals(spark):
    """With class totals kept, recall and F1 come from cells whose classes weigh what they did."""
    df = spark.createDataFrame(rows(), SCHEMA).where("race = 'A'")
    n = {r.y_true: r["count"] for r in df.groupBy("y_true").count().collect()}
    cells = R.replicate_sums(df, ["y_true", "y_pred"], "hadm_id", 20, 1)
    kept = B.class_totals_kept(cells, df, [], "y_true", "y_true", ("w",)).groupBy("replicate", "y_true").agg(F.sum("w").alias("w"))
    assert all(r.w == pytest.approx(n[r.y_true]) for r in kept.collect())
    with pytest.raises(ValueError):
        B.replicate_metrics(df, [], ["auroc"], "hadm_id", 5, stratify="race")


def test_balanced_draw_is_with_replacement(spark):
    """Every class has n / K rows in expectation; rare rows come many times, frequent ones also more than once."""
    df = spark.createDataFrame([(i, None if i % 500 == 0 else int(i % 3 == 0)) for i in range(6000)], "hadm_id long, y_true int")
    got = B.balanced_resample(df, "y_true", "hadm_id").groupBy("y_true", "hadm_id").count().collect()
    rows = {c: [r["count"] for r in got if r.y_true == c] for c in (None, 0, 1)}
    assert all(abs(sum(n) - 2000) < 5 * 2000 ** 0.5 for n in rows.values())
    assert len(rows[None]) == 12 and min(rows[None]) > 100 and max(rows[0]) > 1
    assert B.balanced_resample(df.where("false"), "y_true", "hadm_id").count() == 0
    p = B.poisson_bounds(64.0)
    assert abs(p[-1] - 1) < 1e-12 and abs((1 - p).sum() - 64) < 1e-9


def test_weights_are_the_draws_of_the_whole_distribution():
    """Weights taken block by block, the rare ones apart, are the number of bounds that each hash reaches."""
    w = R.Weights(42, 2000)
    keys = np.append(np.arange(3 * R.BLOCK + 5, dtype=np.int64) * 10 ** 12, 0)
    h = w._mixed((w.key_hash(keys)[:, None] + w.steps) & np.uint32(0x7FFFFFFF))
    got = w.of(keys)
    assert (got == sum((h >= b).astype(int) for b in w.bounds)).all() and got.max() > R.DENSE + 2
    assert (got[-1] == got[0]).all() and w.of(keys[:0]).shape == (0, 2000)


def test_labels_beyond_two_classes_weigh_as_before():
    runs, keys = R.Runs(R.Weights(42, 50)), np.arange(6, dtype=np.int64)
    w = R.Weights(42, 50).of(keys).astype(float)
    _, pos, neg = runs.of(np.array([3.0, 3, 2, 2, 1, 1]), np.array([1, 0, 2, 0, 0, 1]), keys)
    assert (pos == [w[0], 2 * w[2], w[5]]).all() and (neg == [w[1], w[3] - w[2], w[4]]).all()
