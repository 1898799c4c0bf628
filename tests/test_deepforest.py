"""Deep forests grow whole: leaves are pure or cannot be split, and the registered models use the reference's settings."""
import numpy as np
from pyspark.ml.linalg import Vectors

from wardline.operators import deepforest as D
from wardline.operators import models as MD
from wardline.plans import catalog


def test_tree_grows_until_its_leaves_are_pure():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 32, (2000, 6)).astype(np.uint8)
    y, w = (rng.random(2000) < 0.3).astype(float), np.ones(2000)
    tree = D.grow(codes, y, w, 30, np.random.default_rng(1))
    drawn = np.random.default_rng(1).poisson(1.0, 2000) > 0
    assert np.allclose(D.leaf_values(codes, tree)[drawn], y[drawn], atol=1e-9) and (tree["feature"] < 0).sum() > 300
    shallow = D.grow(codes, y, w, 3, np.random.default_rng(1))
    assert len(shallow["value"]) <= 15 and abs(shallow["value"][0] - tree["value"][0]) < 1e-12


def test_forest_learns_and_hands_large_tables_on(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), 1.0, Vectors.dense(x[i].tolist())) for i in range(800)], ["hadm_id", "y", "weight", "features"])
    model = D.DeepForest(40, 30, 7, None).fit(df.filter("hadm_id % 4 > 0"))
    p = {r.hadm_id: r.y_prob for r in model.transform(df.filter("hadm_id % 4 = 0")).collect()}
    assert len(model.trees) == 40 and len(p) == 200 and sum((v > 0.5) == y[i] for i, v in p.items()) > 170

    class Large:
        def fit(self, rows):
            return rows.count()
    assert D.DeepForest(40, 30, 7, Large(), cells=10).fit(df) == 800


def test_mortality_models_have_the_reference_settings(spark, monkeypatch):
    fitted = []

    def fit(prepared, estimators):
        fitted.append(estimators)
        return spark.createDataFrame([(n, 1) for n in estimators], "model string, hadm_id long")
    monkeypatch.setattr(MD, "fit_and_score", fit)
    monkeypatch.setattr(catalog, "_prepared", lambda *_: None)
    folder = "settings-of-the-mortality-models"
    assert [r.model for r in catalog._mort_scores(spark, folder, "LogReg").collect()] == ["LogReg"]
    assert sorted(r.model for r in catalog._mort_scores(spark, folder).collect()) == sorted(MD.classifiers())
    assert list(fitted[0]) == ["LogReg"] and "LogReg" not in fitted[1]  # only what is read, and once
    forest, gbt = fitted[1]["RandomForest"], fitted[1]["GBT"]
    assert (forest.trees, forest.depth, gbt.rounds, gbt.patience) == (500, 30, 2000, 100)
    assert (forest.large.getNumTrees(), forest.large.getMaxDepth()) == (500, 30)
