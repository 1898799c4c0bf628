"""Model training and scoring with MLlib.

Design: features stay a sparse ``VectorUDT`` column (numeric block + multi-hot
categories); fitted one-row parameters (medians, class weights) are attached by
broadcast so that plans stay lazy; every model writes the same scored-table shape
(model, keys, group, y_true, y_prob, y_pred), which all evaluation operators consume.

Re-aims (see README): RBF SVC -> LinearSVC, kernel SVR -> Huber LinearRegression,
XGBoost/LightGBM/CatBoost -> staged GBT cut at its best validation AUROC, recurrent / attention
networks -> classifiers over per-patient trajectory aggregates, language-model
fine-tuning -> hashed TF-IDF + logistic regression.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, HashingTF, IDF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import finite, to_number
from ..plans.sizing import materialise
from . import metrics as M
from .binned import BinnedGBT
from .boosting import COLUMN_SHARE, DEPTH, PATIENCE, RATE, ROUNDS, ROW_SHARE, StagedGBT
from .deepforest import DeepForest
from .deeptree import DeepTree
from .explore import attach_scalars
from .quantiles import exact_quantiles
from .schema import feature_columns


# ---- feature preparation -----------------------------------------------------------
def numeric_block(adm: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """B8 + B7: the leakage-guarded numeric columns coerced to DOUBLE (NULL kept)."""
    cols = list(cols) if cols is not None else feature_columns(adm)
    kinds = dict(adm.dtypes)
    return adm.withColumns({c: to_number(F.col(c), None, kinds.get(c)) for c in cols}), cols


def fit_medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K14 fit: exact medians of all columns (linear interpolation, as NumPy) as one row; found
    by counting bit prefixes, so no column is sorted or gathered anywhere."""
    found = exact_quantiles(train, cols, [0.5])
    schema = ", ".join(f"`{c}__median` double" for c in cols)
    return train.sparkSession.createDataFrame([tuple(found[c][0] for c in cols)], schema)


def impute_medians(df: DataFrame, medians: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K14 transform: NULL -> fitted median (0 when the column was all NULL)."""
    out = attach_scalars(df, medians)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__median"), F.lit(0.0)) for c in cols})
    return out.drop(*[f"{c}__median" for c in cols])


def fit_scale(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K13 fit: population standard deviation per column (scale 1 when 0)."""
    return train.agg(*[F.stddev_pop(F.col(c)).alias(f"{c}__std") for c in cols])


def scale_without_centering(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K13 transform: x / std."""
    out = attach_scalars(df, params)
    for c in cols:
        s = F.col(f"{c}__std")
        out = out.withColumn(c, F.col(c) / F.when((s.isNull()) | (s == 0), F.lit(1.0)).otherwise(s))
    return out.drop(*[f"{c}__std" for c in cols])


def class_weights(train: DataFrame, label: str = "y") -> DataFrame:
    """Balanced weights n / (2 n_c) as a one-row table (w0, w1)."""
    y = F.col(label).cast("int")
    return train.agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_p")).select(
        (F.col("_n") / (F.lit(2.0) * F.greatest(F.col("_n") - F.col("_p"), F.lit(1)))).alias("w0"),
        (F.col("_n") / (F.lit(2.0) * F.greatest(F.col("_p"), F.lit(1)))).alias("w1"))


def with_weights(df: DataFrame, weights: DataFrame, label: str = "y") -> DataFrame:
    out = attach_scalars(df, weights)
    return out.withColumn("weight", F.when(F.col(label) == 1, F.col("w1")).otherwise(F.col("w0"))).drop("w0", "w1")


def multi_hot(list_col: str = "ccsr_union", out: str = "ccsr_vec") -> CountVectorizer:
    """H6: binary multi-hot encoding of a list column (vocabulary of categories, at most ``MAX_TERMS``)."""
    return CountVectorizer(inputCol=list_col, outputCol=out, binary=True, minDF=1.0, vocabSize=MAX_TERMS)


def assembler(num_cols: Sequence[str], extra: Sequence[str] = ("ccsr_vec",)) -> VectorAssembler:
    """H7: numeric block || multi-hot block as one sparse vector."""
    return VectorAssembler(inputCols=list(num_cols) + list(extra), outputCol="features", handleInvalid="keep")


# ---- estimators --------------------------------------------------------------------
# Tree counts and depth of the reference's forests; no depth limit becomes MLlib's largest.
FOREST_TREES, FULL_DEPTH = 500, 30


def classifiers(num_trees: int = FOREST_TREES, gbt_iter: int = ROUNDS, seed: int = 42, patience: int = PATIENCE,
                forest_depth: int = FULL_DEPTH) -> dict:
    """M1-M5 with the reference's settings (tree count, boosting rounds and patience are
    parameters; the booster is cut at its best validation AUROC)."""
    return {
        "LogReg": LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", maxIter=100),
        "LinearSVM": LinearSVC(featuresCol="scaled", labelCol="y", weightCol="weight", maxIter=100),
        "DecisionTree": DeepTree("y", "weight", FULL_DEPTH, 10, seed, out="y_prob"),
        "RandomForest": DeepForest(num_trees, forest_depth, seed, RandomForestClassifier(
            featuresCol="features", labelCol="y", weightCol="weight", numTrees=num_trees, maxDepth=forest_depth, seed=seed)),
        "GBT": BinnedGBT(gbt_iter, patience, seed),
    }


def regressors(num_trees: int = FOREST_TREES, gbt_iter: int = ROUNDS, seed: int = 42, forest_depth: int = FULL_DEPTH) -> dict:
    """M3-M6 regressors on the log1p target (M7)."""
    return {
        "HuberLinear": LinearRegression(featuresCol="scaled", labelCol="y_log", loss="huber", maxIter=100),
        "DecisionTree": DeepTree("y_log", None, FULL_DEPTH, 10, seed),
        "RandomForest": RandomForestRegressor(featuresCol="features", labelCol="y_log", numTrees=num_trees, maxDepth=forest_depth, seed=seed),
        "GBT": GBTRegressor(featuresCol="features", labelCol="y_log", maxIter=gbt_iter, stepSize=RATE, maxDepth=DEPTH,
                            subsamplingRate=ROW_SHARE, featureSubsetStrategy=str(COLUMN_SHARE),
                            validationIndicatorCol="is_val", validationTol=0.0, seed=seed),
    }


def prepare_admissions(adm: DataFrame, split_col: str = "split", label: str = "hospital_expire_flag",
                       cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Admission matrix for training: numeric block imputed with train medians,
    labels, validation flag, class weights, multi-hot + assembled + scaled vectors."""
    df, num = numeric_block(adm, cols)
    # the roll-up behind ``adm`` runs once; medians, weights and the vector stages
    # then read the written table
    df = materialise(df)
    dev = df.filter(F.col(split_col) == "train")
    df = impute_medians(df, fit_medians(dev, num), num)
    df = df.withColumn("y", F.col(label).cast("int")).withColumn("is_val", F.col(split_col) == "val")
    df = df.withColumn("y_reg", to_number(F.col("los_days"), None, dict(df.dtypes)["los_days"]))
    df = df.withColumn("y_log", F.log1p(F.greatest(F.col("y_reg"), F.lit(0.0))))
    df = with_weights(df, class_weights(df.filter(F.col(split_col) == "train")))
    pipe = Pipeline(stages=[multi_hot(), assembler(num),
                            StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True)])
    model = pipe.fit(df.filter(F.col(split_col) == "train"))
    return materialise(model.transform(df)), num


def positive_probability(pred: DataFrame, name: str) -> DataFrame:
    """Score for ranking: P(class 1) from ``probability``; LinearSVC has only a margin."""
    if "y_prob" in pred.columns:
        return pred
    if "probability" in pred.columns:
        return pred.withColumn("y_prob", vector_to_array("probability")[1])
    return pred.withColumn("y_prob", vector_to_array("rawPrediction")[1])


def _fit_all(estimators: dict, rows: DataFrame, parallelism: int, split_col: str = "split") -> dict:
    """Fit several estimators concurrently on the train rows; only an estimator with a
    validation column also sees the val rows, as that column marks them. Each fit submits
    its own Spark jobs from a driver thread, so short fits overlap with long ones."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        train = rows.filter(F.col(split_col) == "train")
        stops = {name: isinstance(est, StagedGBT) or not isinstance(est, (DeepTree, DeepForest)) and est.hasParam("validationIndicatorCol") and est.isSet("validationIndicatorCol")
                 for name, est in estimators.items()}
        futures = {name: pool.submit(est.fit, rows if stops[name] else train) for name, est in estimators.items()}
        return {name: f.result() for name, f in futures.items()}


def fit_and_score(prepared: DataFrame, estimators: dict, split_col: str = "split",
                  keys: Sequence[str] = ("hadm_id", "subject_id", "race"), parallelism: int = 4) -> DataFrame:
    """M9 + M10: fit each estimator on the train rows (boosters use the val rows only
    through their early-stopping column) and stack the test scores of all models
    into one scored table."""
    fit_rows = prepared.filter(F.col(split_col) != "test")
    test = prepared.filter(F.col(split_col) == "test")
    models = _fit_all(estimators, fit_rows, parallelism, split_col)
    out = None
    for name, est in estimators.items():
        pred = positive_probability(models[name].transform(test), name)
        thr = F.lit(0.0) if isinstance(est, LinearSVC) else F.lit(0.5)
        scored = pred.select(F.lit(name).alias("model"), *keys, F.col("y").alias("y_true"), "y_prob",
                             (F.col("y_prob") >= thr).cast("int").alias("y_pred"))
        out = scored if out is None else out.unionByName(scored)
    return out


def fit_and_predict_regression(prepared: DataFrame, estimators: dict, split_col: str = "split",
                               keys: Sequence[str] = ("hadm_id", "subject_id", "race"),
                               parallelism: int = 4) -> DataFrame:
    """M7: fit on log1p(LOS), predict, invert with expm1 and clip at 0; rows with a
    finite target only (C5)."""
    ok = prepared.filter(finite(F.col("y_reg")))
    fit_rows = ok.filter(F.col(split_col) != "test")
    test = ok.filter(F.col(split_col) == "test")
    models = _fit_all(estimators, fit_rows, parallelism, split_col)
    out = None
    for name, est in estimators.items():
        pred = models[name].transform(test)
        yhat = F.greatest(F.expm1(F.col("prediction")), F.lit(0.0))
        scored = pred.select(F.lit(name).alias("model"), *keys, F.col("y_reg").alias("y"), yhat.alias("yhat"))
        out = scored if out is None else out.unionByName(scored)
    return out


def grouped_cross_validation(prepared: DataFrame, reg_params: Sequence[float] = (0.0, 0.01, 0.1), k: int = 5,
                             split_col: str = "split", seed: int = 5, parallelism: int = 4) -> DataFrame:
    """L3 + M10: logistic regression tuned by grouped k-fold cross-validation (folds
    from the patient hash, so a patient never straddles folds); mean AUROC per
    setting. The fold hash uses its own seed: reusing the split's seed would leave the
    low folds empty, since those patients are in the test split."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    from .split import group_kfold
    lr = LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).build()
    rows = group_kfold(prepared.filter(F.col(split_col) != "test"), "subject_id", k, seed)
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, foldCol="fold", numFolds=k, parallelism=parallelism,
                        evaluator=BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderROC"))
    model = cv.fit(rows)
    spark = prepared.sparkSession
    data = [(float(p[lr.regParam]), float(m)) for p, m in zip(grid, model.avgMetrics)]
    return spark.createDataFrame(data, "reg_param double, mean_cv_auroc double")


def learning_curve(prepared: DataFrame, estimators: dict, fractions: Sequence[float], k: int = 5, split_col: str = "split",
                   seed: int = 5, size_seed: int = 11, parallelism: int = 4) -> DataFrame:
    """L4: (model, size, fraction, n_train, train_auroc, train_std, val_auroc, val_std, folds) by grouped k-fold
    cross-validation over the rows outside the test split.

    Every model is fitted on every (fold, size); the scores of all fits, on their training
    rows and on the fold, stand in one table, and one grouped metric gives all AUROCs."""
    from concurrent.futures import ThreadPoolExecutor

    from .split import fold_entry
    rows = materialise(fold_entry(prepared.filter(F.col(split_col) != "test"), fractions, "subject_id", k, seed, size_seed))

    def scored(name: str, f: int, j: int) -> DataFrame:
        train = rows.filter(F.col("entry")[f] <= j)
        model = estimators[name].fit(train)
        both = train.withColumn("part", F.lit("train")).unionByName(rows.filter(F.col("fold") == f).withColumn("part", F.lit("val")))
        out = positive_probability(model.transform(both), name)
        return materialise(out.select(F.lit(name).alias("model"), F.lit(f).alias("fold"), F.lit(j).alias("size"), "part", "y", "y_prob"))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fits = [pool.submit(scored, n, f, j) for n in estimators for f in range(k) for j in range(len(fractions))]
        frames = [x.result() for x in fits]
    table = frames[0]
    for x in frames[1:]:
        table = table.unionByName(x)
    by = ["model", "size", "fold", "part"]
    per = M.auroc_ap(M.score_steps(table, by, "y", "y_prob"), by)
    n = table.filter("part = 'train'").groupBy("model", "size").agg((F.count(F.lit(1)) / k).alias("n_train"))
    of = lambda part, how: how(F.when(F.col("part") == part, F.col("auroc")))
    curve = per.groupBy("model", "size").agg(
        of("train", F.avg).alias("train_auroc"), of("train", F.stddev_pop).alias("train_std"),
        of("val", F.avg).alias("val_auroc"), of("val", F.stddev_pop).alias("val_std"), of("val", F.count).alias("folds"))
    fr = F.element_at(F.array(*[F.lit(float(x)) for x in fractions]), F.col("size") + 1)
    return curve.join(n, ["model", "size"]).withColumn("fraction", fr)


def gbt_curve(prepared: DataFrame, max_iter: int = ROUNDS, patience: int = PATIENCE, seed: int = 42) -> DataFrame:
    """M8: train and validation AUROC after each boosting round until patience runs out, and whether the model is cut there."""
    model = BinnedGBT(max_iter, patience, seed).fit(prepared)
    wide = model.curve.groupBy("round").pivot("split", ["train", "val"]).agg(F.first("auroc"))
    return wide.select("round", F.col("train").alias("train_auroc"), F.col("val").alias("val_auroc"), (F.col("round") == model.best).alias("is_best"))


def gbt_facts(prepared: DataFrame, max_iter: int, patience: int, seed: int = 42) -> DataFrame:
    """What holds of any booster's curve: rounds, rows and positives of each split, that the cut
    is the best round of those before patience ran out, and that the cut model scores as that round."""
    model = BinnedGBT(max_iter, patience, seed, whole=True).fit(prepared)
    val = prepared.filter(F.col("split") == "val")
    cut = M.auroc_ap(M.score_steps(model.transform(val), [], "y", "y_prob")).select(F.col("auroc").alias("cut_auroc"))
    seen = model.curve.filter((F.col("split") == "val") & (F.col("round") <= model.best + patience)).agg(
        F.max("auroc").alias("top"), F.max(F.when(F.col("round") == model.best, F.col("auroc"))).alias("at_best"))
    per = model.curve.groupBy("split").agg(F.count(F.lit(1)).alias("rounds"), F.min("n").alias("n_min"), F.max("n").alias("n_rows"), F.max("n_pos").alias("n_pos"))
    both = attach_scalars(attach_scalars(per, cut), seen)
    return both.select("split", "rounds", "n_rows", "n_pos", (F.col("n_min") == F.col("n_rows")).alias("same_rows"),
                       (F.col("top") == F.col("at_best")).alias("best_is_top"), (F.abs(F.col("cut_auroc") - F.col("at_best")) < 1e-9).alias("cut_as_curve"))


def text_classifier(records: DataFrame, label: str = "y_mort", split_col: str = "split", num_features: int = 1 << 18,
                    family: str = "binomial") -> DataFrame:
    """Whitespace tokens -> hashed term frequencies -> IDF -> logistic regression,
    trained on the train split and scored on test (binary mortality or LOS classes)."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\s+", toLowercase=False),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="_y", family=family, maxIter=50, regParam=0.01),
    ])
    data = materialise(records.withColumn("_y", F.col(label).cast("double")))
    model = pipe.fit(data.filter(F.col(split_col) == "train"))
    pred = model.transform(data.filter(F.col(split_col) == "test"))
    probs = vector_to_array("probability")
    return pred.select("subject_id", "hadm_id", "race", F.col(label).alias("y_true"), probs.alias("probs"),
                       F.col("prediction").cast("int").alias("y_pred"))


# Bound of a fitted vocabulary: categories of a multi-hot block, (step, token) pairs of a trajectory.
MAX_TERMS = 1 << 20


def trajectory_table(seq: DataFrame, vocab: DataFrame) -> DataFrame:
    """M12 input: one row per patient with split, both targets, the scaled padded static block
    [20 x 15] as one vector and the (step, token) pairs of the last 20 admissions. The scaler
    is fitted on the training patients; lengths of stay are targets alone."""
    from . import trajectory as TR
    scaler = TR.fit_scaler(TR.last_n_admissions(seq.filter(F.col("split") == "train")))
    padded = TR.position_tokens(TR.padded_patients(TR.token_ids(seq, vocab), scaler=scaler))
    labels = TR.last_admission(seq).join(seq.select("subject_id", "split").distinct(), "subject_id")
    static = array_to_vector(F.flatten("adm_static"))
    return materialise(padded.select("subject_id", "step_tokens", static.alias("static")).join(labels, "subject_id"))


def trajectory_heads(table: DataFrame, max_iter: int = 50) -> DataFrame:
    """Mortality and length-of-stay heads over sparse (step x token) and static features, scored on
    the test patients: subject_id, race, y_true, y_prob, y (hours), yhat (hours)."""
    pipe = Pipeline(stages=[CountVectorizer(inputCol="step_tokens", outputCol="tokens", binary=True, vocabSize=MAX_TERMS),
                            VectorAssembler(inputCols=["static", "tokens"], outputCol="features")])
    data = table.select("subject_id", "split", "step_tokens", "static", F.col("race_last").alias("race"),
                        F.col("y_mort").cast("double").alias("y"), "y_los_log")
    data = materialise(pipe.fit(data.filter(F.col("split") == "train")).transform(data))
    train, test = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")
    train = with_weights(train, class_weights(train))
    mort = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=max_iter, regParam=0.01).fit(train)
    los = LinearRegression(featuresCol="features", labelCol="y_los_log", maxIter=max_iter, regParam=0.1, solver="l-bfgs").fit(train)
    scored = positive_probability(mort.transform(test), "mort").drop("prediction", "rawPrediction", "probability")
    yhat = F.greatest(F.expm1("prediction"), F.lit(0.0))
    return los.transform(scored).select("subject_id", "split", "race", F.col("y").cast("int").alias("y_true"), "y_prob",
                                        F.expm1("y_los_log").alias("y"), yhat.alias("yhat"))


def score_foreign(df: DataFrame, predict, input_cols: Sequence[str], out: str = "y_prob") -> DataFrame:
    """Score with a user-supplied Python model through Arrow batches
    (``predict(pandas.DataFrame) -> sequence of floats``), one batch per call."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out, DoubleType())])
    cols = list(input_cols)

    def run(batches):
        for pdf in batches:
            pdf[out] = list(predict(pdf[cols]))
            yield pdf

    return df.mapInPandas(run, schema)
