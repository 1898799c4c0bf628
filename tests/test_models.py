"""MLlib layer: on a label that the features determine, every model ranks well above
chance (the fixture's own outcome labels are random by construction)."""
from pyspark.sql import functions as F

from conftest import SF_CHECK
from wardline.operators import metrics as M
from wardline.operators import models as MD
from wardline.operators import split as S
from wardline.plans.cohort import Cohort


def test_classifiers_learn_a_learnable_label(spark):
    adm = S.grouped_split(Cohort.of(spark, SF_CHECK).admissions, "subject_id", 0.2, 0.2)
    # label fully determined by a feature column: many diagnosis rows
    adm = adm.withColumn("learnable", (F.col("n_dx_rows") >= 5).cast("int"))
    prepared, cols = MD.prepare_admissions(adm, label="learnable")
    assert "n_dx_rows" in cols
    est = MD.classifiers(num_trees=10, gbt_iter=10, patience=5, forest_depth=8)
    scored = MD.fit_and_score(prepared, est)
    auc = {r.model: r.auroc for r in M.auroc_ap(M.score_steps(scored, ["model"]), ["model"]).collect()}
    assert set(auc) == set(est)
    assert all(v > 0.9 for v in auc.values()), auc


def test_text_classifier_learns_token_presence(spark):
    from wardline.operators import text as TX
    rec = TX.token_records(Cohort.of(spark, SF_CHECK).features)
    rec = rec.withColumn("learnable", F.col("text").contains("CCSR_BCAT").cast("int"))
    sp = S.stratified_group_split(rec, "subject_id", "race", 0.15, 0.15)
    pred = MD.text_classifier(sp, "learnable").withColumn("y_prob", F.col("probs")[1])
    r = M.auroc_ap(M.score_steps(pred)).collect()[0]
    assert r.auroc > 0.9


def test_trees_follow_mllib(spark):
    """Margins of the last round are the ensemble's own raw prediction; a cut ensemble is a shorter one."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from wardline.operators import boosting as BO
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), 1.0, Vectors.dense(x[i]), "train" if i % 3 else "val") for i in range(600)],
                               ["hadm_id", "y", "weight", "features", "split"])
    gbt = BO.StagedGBT(rounds=12, patience=3)
    fitted = gbt.estimator.fit(df.filter("split = 'train'"))
    trees = BO.trees_of(fitted, spark)
    got = {r.hadm_id: r.margins for r in BO.with_margins(df, trees, ["hadm_id"]).collect()}
    raw = {r.hadm_id: r.rawPrediction[1] for r in fitted.transform(df).collect()}
    assert all(abs(got[i][-1] - raw[i]) < 1e-9 and len(got[i]) == 12 for i in got)
    model = gbt.fit(df)
    p = {r.hadm_id: r.y_prob for r in model.transform(df).collect()}
    assert all(abs(p[i] - 1 / (1 + np.exp(-2 * got[i][model.best - 1]))) < 1e-9 for i in got)
    assert BO.best_round([0.5, 0.7, 0.6, 0.65, 0.9], 2) == 2 and BO.best_round([0.5, 0.7, 0.6, 0.65, 0.9], 3) == 5
    assert BO.best_round([None, None], 1) == 2 and BO.best_round([0.5, 0.5], 9) == 1
