"""Boosted trees over binned columns: exact curve, patience, and the same trees in one task and over many."""
import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardline.operators import binned as B
from wardline.operators import metrics as M
from wardline.operators import models as MD
from wardline.plans import catalog


def _rows(spark, n=900):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[:, 3] = rng.integers(0, 2, n)
    x[:, 2] *= rng.random(n) < 0.3
    y = (x[:, 0] * x[:, 1] + x[:, 3] + 0.5 * rng.normal(size=n) > 0.5).astype(int)
    vec = lambda r: Vectors.dense(r) if rng.random() < 0.5 else Vectors.sparse(4, {j: float(v) for j, v in enumerate(r) if v})
    return spark.createDataFrame([(i, int(y[i]), float(1 + y[i]), vec(x[i].tolist()), ("train", "train", "val", "test")[i % 4]) for i in range(n)],
                                 ["hadm_id", "y", "weight", "features", "split"]).repartition(5, "hadm_id")


def _curve(model):
    return [(r.split, r.round, r.n, r.n_pos, r.auroc) for r in model.curve.orderBy("split", "round").collect()]


def test_one_task_and_many_grow_the_same(spark):
    df = _rows(spark).localCheckpoint()
    one, many = (B.BinnedGBT(12, 100, one_task=k).fit(df) for k in (1 << 22, 0))
    a, b = _curve(one), _curve(many)
    assert [r[:4] for r in a] == [r[:4] for r in b] and len(a) == 24
    assert all(abs(p[4] - q[4]) < 1e-3 for p, q in zip(a, b, strict=True)) and a[11][4] > 0.85
    for model in (one, many):
        val = M.auroc_ap(M.score_steps(model.transform(df.filter("split = 'val'")), [], "y", "y_prob")).first().auroc
        assert abs(val - {r[1]: r[4] for r in _curve(model) if r[0] == "val"}[model.best]) < 1e-9


def test_rounds_end_with_patience(spark):
    df = _rows(spark, 300).withColumn("y", (F.xxhash64("hadm_id") % 2 == 0).cast("int")).localCheckpoint()
    full, cut = B.BinnedGBT(60, 4, whole=True).fit(df), B.BinnedGBT(60, 4).fit(df)
    a, b = _curve(full), _curve(cut)
    assert len(a) == 120 and full.best == cut.best and len(b) == 2 * (cut.best + 4) < 120
    assert b == [r for r in a if r[1] <= cut.best + 4]


def test_registered_curve_has_the_reference_settings(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(catalog, "_prepared", lambda *_: None)
    monkeypatch.setattr(MD, "BinnedGBT", lambda rounds, patience, seed: seen.update(rounds=rounds, patience=patience) or 1 / 0)
    try:
        catalog.q_gbt_curve(spark, "")
    except ZeroDivisionError:
        pass
    assert seen == {"rounds": 2000, "patience": 100}
