"""Registry of checked queries: name -> callable(spark, sf_dir) -> DataFrame."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import timecols as TC
from ..operators import bootstrap as BS
from ..operators import explore as X
from ..operators import fairness as FA
from ..operators import features as FE
from ..operators import harmonise as H
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import split as S
from ..operators import text as TX
from ..operators import trajectory as TR
from ..operators.schema import feature_columns, require_columns
from ..sources import io as IO
from .session import ensure_checkpoint_dir, small_scans
from .cohort import Cohort, category_outcomes
from .report import comparable
from .sizing import is_written, materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("category_outcomes")
def q_category_outcomes(spark, sf_dir):
    return comparable(category_outcomes(Cohort.of(spark, sf_dir).features))


# ---- harmonisation ------------------------------------------------------------

DX_COLS = ["subject_id", "hadm_id", "seq_num", "icd_version", "icd_code", "dx_norm", "icd10_full", "icd10_3char"]


@register("dx_harmonised")
def q_dx_harmonised(spark, sf_dir):
    return comparable(Cohort(spark, sf_dir, persist=False).mapped.select(*DX_COLS))


@register("mapping_qa")
def q_mapping_qa(spark, sf_dir):
    return comparable(H.mapping_qa(Cohort(spark, sf_dir, persist=False).mapped))


@register("unmapped_icd9_top20")
def q_unmapped(spark, sf_dir):
    return comparable(H.unmapped_codes(Cohort(spark, sf_dir, persist=False).mapped, 20))


@register("ccsr_long")
def q_ccsr_long(spark, sf_dir):
    return comparable(Cohort.of(spark, sf_dir).ccsr_long)


@register("ccsr_category_codes")
def q_ccsr_codes(spark, sf_dir):
    return comparable(H.ccsr_category_codes(Cohort.of(spark, sf_dir).inputs.ccsr_dimension()))


@register("dx_categories")
def q_dx_categories(spark, sf_dir):
    d = FE.count_categories(Cohort.of(spark, sf_dir).with_ccsr)
    return comparable(d.select("subject_id", "hadm_id", "seq_num", "icd10_full", "ccsr_list_sorted",
                               "ccsr_description", "n_ccsr"))


@register("multi_category_rows")
def q_multi(spark, sf_dir):
    d = H.multi_category_rows(Cohort.of(spark, sf_dir).with_ccsr)
    return comparable(d.select("subject_id", "hadm_id", "seq_num", "ccsr_list_sorted"))


# ---- features -----------------------------------------------------------------
FEATURE_COLS = ["subject_id", "hadm_id", "seq_num", "gender", "race", "admission_type", "insurance",
                "hospital_expire_flag", "race_code", "admission_type_code", "gender_code",
                "admittime_dt", "dischtime_dt", "deathtime_dt", "los_hours", "los_days",
                "adm_year", "adm_month", "adm_day", "adm_hour", "adm_weekday", "adm_weekend",
                "age_at_admit", "n_ccsr"]


@register("feature_table")
def q_feature_table(spark, sf_dir):
    return comparable(Cohort.of(spark, sf_dir).features.select(*FEATURE_COLS))


@register("label_codes")
def q_label_codes(spark, sf_dir):
    return comparable(Cohort.of(spark, sf_dir).code_table)


@register("minors")
def q_minors(spark, sf_dir):
    f = FE.minors(Cohort.of(spark, sf_dir).features)
    return comparable(f.select("subject_id", "hadm_id", "seq_num", "age_at_admit"))


@register("minors_reached")
def q_minors_reached(spark, sf_dir):
    """C4 on rows it keeps: every age taken 40 years lower."""
    f = Cohort.of(spark, sf_dir).features.withColumn("age_at_admit", F.col("age_at_admit") - 40)
    return comparable(FE.minors(f).select("subject_id", "hadm_id", "seq_num", "age_at_admit"))


@register("dx_categories_merged")
def q_dx_merged(spark, sf_dir):
    """Rows that share a key share the merged lists of them all."""
    c = Cohort.of(spark, sf_dir)
    paired = c.harmonised.withColumn("seq_num", F.ceil(F.col("seq_num") / 2).cast("int"))
    return comparable(H.attach_ccsr(paired, c.ccsr_long).select("subject_id", "hadm_id", "seq_num", "icd10_full", "ccsr_list_sorted"))


@register("patient_mortality")
def q_patient_mortality(spark, sf_dir):
    return comparable(X.patient_mortality(Cohort.of(spark, sf_dir).features))


@register("race_share")
def q_race_share(spark, sf_dir):
    return comparable(X.share_of_total(X.frequency(Cohort.of(spark, sf_dir).features, "race")))


@register("top_categories")
def q_top_categories(spark, sf_dir):
    counts = X.token_frequency(Cohort.of(spark, sf_dir).features, "ccsr_list_sorted", "ccsr_category")
    return comparable(X.top_k(counts, 10, "count", "ccsr_category"))


@register("age_histogram")
def q_age_hist(spark, sf_dir):
    return comparable(X.histogram(Cohort.of(spark, sf_dir).features, "age_at_admit", 20))


@register("los_histogram")
def q_los_hist(spark, sf_dir):
    return comparable(X.histogram(Cohort.of(spark, sf_dir).features, "los_days", 30))


@register("los_modal_bin")
def q_los_modal(spark, sf_dir):
    return comparable(X.modal_bin(X.histogram(Cohort.of(spark, sf_dir).features, "los_days", 30)))


@register("los_kde")
def q_los_kde(spark, sf_dir):
    return comparable(X.kde_grid(Cohort.of(spark, sf_dir).features, "los_days", 200))


ROLLUP_COLS = ["hadm_id", "subject_id", "gender", "race", "admission_type", "hospital_expire_flag",
               "los_days", "age_at_admit", "adm_year", "race_code", "seq_num", "icd_code", "n_ccsr",
               "ccsr_union", "n_ccsr_unique", "n_dx_rows"]


@register("admission_rollup")
def q_rollup(spark, sf_dir):
    return comparable(Cohort.of(spark, sf_dir).admissions.select(*ROLLUP_COLS))


@register("model_matrix")
def q_model_matrix(spark, sf_dir):
    adm = Cohort.of(spark, sf_dir).admissions
    cols = feature_columns(adm)
    from ..functions.timecols import finite, to_number
    kinds = dict(adm.dtypes)
    out = adm.select("hadm_id", "subject_id",
                     F.col("hospital_expire_flag").cast("int").alias("y_cls"),
                     to_number(F.col("los_days"), None, kinds["los_days"]).alias("y_reg"),
                     *[to_number(F.col(c), None, kinds[c]).alias(c) for c in cols])
    return comparable(out.withColumn("reg_ok", finite(F.col("y_reg"))))


# ---- trajectories -------------------------------------------------------------


def _seq(spark, sf_dir):
    return Cohort.of(spark, sf_dir).sequence


SEQ_COLS = ["subject_id", "hadm_id", "dx_tokens", "n_dx", "n_dx_unique", "delta_prev_adm_hours", "los_hours",
            "los_log", "mortality", "age_at_admit", "gender_code", "race_code", "admission_type_code",
            "insurance_code", "marital_code", "adm_year", "adm_month", "adm_day", "adm_hour", "adm_weekday",
            "adm_weekend"]


@register("seq_admissions")
def q_seq_admissions(spark, sf_dir):
    return comparable(_seq(spark, sf_dir).select(*SEQ_COLS))


@register("seq_patient_labels")
def q_seq_labels(spark, sf_dir):
    return comparable(TR.last_admission(_seq(spark, sf_dir)))


def _seq_split(spark, sf_dir):
    return S.grouped_split(_seq(spark, sf_dir), "subject_id", 0.2, 0.2, seed=42, val_seed=43)


@register("seq_split_labels")
def q_seq_split_labels(spark, sf_dir):
    seq = _seq_split(spark, sf_dir)
    labels = TR.last_admission(seq).join(seq.select("subject_id", "split").distinct(), "subject_id")
    return labels.groupBy("split", "y_mort").agg(F.count(F.lit(1)).alias("patients"))


def _seq_vocab(spark, sf_dir, seq):
    toks = Cohort.of(spark, sf_dir).dx_tokens
    return TR.vocabulary(TR.training_tokens(toks, seq.filter(F.col("split") == "train")))


@register("seq_vocab")
def q_seq_vocab(spark, sf_dir):
    return comparable(_seq_vocab(spark, sf_dir, _seq_split(spark, sf_dir)))


def _nested(c, inner=",", outer=";"):
    return F.array_join(F.transform(F.col(c), lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), inner)), outer)


@register("seq_padded")
def q_seq_padded(spark, sf_dir):
    seq = _seq_split(spark, sf_dir)
    pad = TR.padded_patients(TR.token_ids(seq, _seq_vocab(spark, sf_dir, seq)))
    return pad.select("subject_id", _nested("dx_ids").alias("dx_ids"), _nested("dx_mask").alias("dx_mask"),
                      F.array_join("adm_mask", ",").alias("adm_mask"),
                      F.size("adm_static").alias("n_steps"))


@register("seq_padded_static")
def q_seq_padded_static(spark, sf_dir):
    """H8 + K12: all values of all 20 steps of every patient, standardised by the training
    patients' parameters; padded steps are 0."""
    seq = _seq_split(spark, sf_dir)
    scaler = TR.fit_scaler(TR.last_n_admissions(seq.filter(F.col("split") == "train")))
    none = F.array().cast("array<int>")
    pad = TR.padded_patients(seq.withColumn("dx_ids", none), scaler=scaler)
    steps = pad.select("subject_id", "adm_mask", F.posexplode("adm_static").alias("t", "x"))
    return comparable(steps.select("subject_id", "t", F.col("adm_mask")[F.col("t")].alias("real"),
                                   *[F.col("x")[i].alias(c) for i, c in enumerate(TR.STATIC_COLS)]), digits=6)


@register("seq_scaler")
def q_seq_scaler(spark, sf_dir):
    seq = _seq_split(spark, sf_dir)
    rows = TR.last_n_admissions(seq.filter(F.col("split") == "train"))
    return comparable(TR.fit_scaler(rows), digits=6)


# ---- text records and splits ------------------------------------------------------
@register("admission_text_prose")
def q_prose(spark, sf_dir):
    return comparable(TX.prose_records(Cohort.of(spark, sf_dir).features))


@register("admission_text_tokens")
def q_tokens(spark, sf_dir):
    return comparable(TX.token_records(Cohort.of(spark, sf_dir).features))


def _text_records(spark, sf_dir, *columns):
    """Token records, written once: a split reads them twice. Where only ``columns`` are asked for and
    no query has written the texts yet, they are written without the texts."""
    held = Cohort.of(spark, sf_dir).__dict__.get("_scored_tables", {})
    name, columns = ("text_records", ["*"]) if not columns or "text_records" in held else ("text_record_columns", columns)
    with small_scans(spark):
        return _once(spark, sf_dir, name, lambda: TX.token_records(Cohort.of(spark, sf_dir).features).select(*columns))


@register("text_split_counts")
def q_text_split(spark, sf_dir):
    rec = _text_records(spark, sf_dir, *TX.KEY, "race")
    sp = S.stratified_group_split(rec, "subject_id", "race", 0.15, 0.15, seed=42)
    return sp.groupBy("race_subj", "split").agg(F.countDistinct("subject_id").alias("patients"),
                                                F.count(F.lit(1)).alias("admissions"))


@register("text_token_top")
def q_text_token_top(spark, sf_dir):
    sp = _text_split(spark, sf_dir)
    counts = X.text_token_frequency(sp.filter(F.col("split") == "train"), "text")
    return X.top_k(counts, 3000, "count", "token")


@register("grouped_split_counts")
def q_grouped_split(spark, sf_dir):
    adm = S.grouped_split(Cohort.of(spark, sf_dir).admissions, "subject_id", 0.2, 0.2, seed=42, val_seed=7)
    return adm.groupBy("split").agg(F.countDistinct("subject_id").alias("patients"),
                                    F.count(F.lit(1)).alias("admissions"),
                                    F.sum("hospital_expire_flag").cast("bigint").alias("deaths"))


@register("group_kfold_counts")
def q_kfold(spark, sf_dir):
    adm = S.group_kfold(Cohort.of(spark, sf_dir).admissions, "subject_id", 5, seed=42)
    return adm.groupBy("fold").agg(F.countDistinct("subject_id").alias("patients"),
                                   F.count(F.lit(1)).alias("admissions"))


@register("learning_curve_sizes")
def q_lc(spark, sf_dir):
    adm = S.grouped_split(Cohort.of(spark, sf_dir).admissions, "subject_id", 0.2, 0.2, seed=42, val_seed=7)
    sub = S.learning_curve_subsets(adm.filter(F.col("split") != "test"), "subject_id", 6, 0.1, 1.0, seed=11)
    return comparable(sub.groupBy("subset", "fraction").agg(F.count(F.lit(1)).alias("admissions")))


# ---- evaluation metrics -----------------------------------------------------------

PROBS = ("p0", "p1", "p2", "p3")


def _scores(spark, sf_dir):
    return Cohort.of(spark, sf_dir).inputs.ehr_scores


def _los_scores(spark, sf_dir):
    s = Cohort.of(spark, sf_dir).inputs.ehr_los_scores
    return M.top_label(s, "y_cls", PROBS)


@register("auroc_ap_overall")
def q_auc_overall(spark, sf_dir):
    return comparable(M.auroc_ap(M.score_steps(_scores(spark, sf_dir))))


@register("auroc_ap_by_race")
def q_auc_race(spark, sf_dir):
    return comparable(M.auroc_ap(M.score_steps(_scores(spark, sf_dir), ["race"]), ["race"]))


@register("roc_points_by_race")
def q_roc_points(spark, sf_dir):
    return comparable(M.roc_points(M.score_steps(_scores(spark, sf_dir), ["race"]), ["race"]))


@register("pr_points")
def q_pr_points(spark, sf_dir):
    return comparable(M.pr_points(M.score_steps(_scores(spark, sf_dir))))


@register("confusion_by_race")
def q_confusion(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("y_pred", TC.threshold(F.col("y_prob"), 0.5))
    return comparable(M.confusion(s, ["race"]))


@register("binary_class_report")
def q_binary_report(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("y_pred", TC.threshold(F.col("y_prob"), 0.5))
    return comparable(M.multiclass_report(s))


@register("los_class_report_by_race")
def q_los_report(spark, sf_dir):
    return comparable(M.multiclass_report(_los_scores(spark, sf_dir), ["race"], "y_cls", "pred_cls"))


@register("los_ovr_auroc_by_race")
def q_los_ovr(spark, sf_dir):
    return comparable(M.ovr_macro_auroc(_los_scores(spark, sf_dir), ["race"], "y_cls", PROBS))


def _expected_class(df):
    return df.withColumn("y", F.col("y_cls").cast("double")).withColumn(
        "yhat", sum(F.lit(float(k)) * F.col(c) for k, c in enumerate(PROBS)))


@register("regression_errors_by_race")
def q_regression(spark, sf_dir):
    return comparable(M.regression_errors(_expected_class(_los_scores(spark, sf_dir)), ["race"]))


@register("calibration_bins_by_race")
def q_calibration_bins(spark, sf_dir):
    return comparable(M.reliability(_scores(spark, sf_dir), ["race"]))


@register("calibration_summary_by_race")
def q_calibration_summary(spark, sf_dir):
    return comparable(FA.calibration_by_group(_scores(spark, sf_dir), "race"))


@register("multiclass_calibration_by_race")
def q_mc_calibration(spark, sf_dir):
    return comparable(FA.multiclass_calibration_by_group(Cohort.of(spark, sf_dir).inputs.ehr_los_scores, "race"))


@register("threshold_best_f1")
def q_thr_f1(spark, sf_dir):
    return comparable(M.best_f1_threshold(M.grid_counts(_scores(spark, sf_dir), [], *M.F1_GRID)))


@register("threshold_best_f1_by_race")
def q_thr_f1_race(spark, sf_dir):
    return comparable(M.best_f1_threshold(M.grid_counts(_scores(spark, sf_dir), ["race"], *M.F1_GRID), ["race"]))


@register("threshold_target_recall")
def q_thr_recall(spark, sf_dir):
    c = M.grid_counts(_scores(spark, sf_dir), ["race"], *M.RECALL_GRID)
    return comparable(M.recall_target_threshold(c, ["race"], 0.70))


@register("threshold_target_precision")
def q_thr_precision(spark, sf_dir):
    c = M.grid_counts(_scores(spark, sf_dir), ["race"], *M.PRECISION_GRID)
    return comparable(M.precision_target_threshold(c, ["race"], 0.50))


@register("threshold_policy_precision")
def q_thr_policy(spark, sf_dir):
    return comparable(M.threshold_policy(_scores(spark, sf_dir), ["race"], "precision", target_precision=0.50))


def _val_test(spark, sf_dir):
    s = S.grouped_split(_scores(spark, sf_dir), "subject_id", 0.3, 0.4, seed=42, val_seed=7)
    # every seventh group is a missing one
    s = s.withColumn("race", F.when(F.col("race").isin("NATION_7", "NATION_14", "NATION_21"), F.lit(None)).otherwise(F.col("race")))
    return s.filter(F.col("split") == "val"), s.filter(F.col("split") == "test")


@register("threshold_val_to_test")
def q_policy_carried(spark, sf_dir):
    """Thresholds for a target precision tuned per group on val, applied to test; groups
    with few rows or deaths take the overall threshold, missing groups are one of their own."""
    val, test = _val_test(spark, sf_dir)
    policy = M.fit_policy(val, "race", "precision", target_precision=0.50, min_n=40, min_pos=8)
    scored = M.apply_policy(test, policy, "race")
    used = scored.groupBy("race").agg(F.first("threshold").alias("threshold"), F.first("source").alias("source"))
    return comparable(M.null_safe_join(M.confusion(scored, ["race"]), used, ["race"]))


@register("threshold_observed_min_pos")
def q_thr_observed(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return comparable(M.best_f1_observed(M.score_steps(s, ["race"]), ["race"], 10))


@register("score_losses_by_race")
def q_losses(spark, sf_dir):
    return comparable(M.losses(_scores(spark, sf_dir), ["race"]))


@register("class_balance_by_race")
def q_class_balance(spark, sf_dir):
    return comparable(X.class_balance(_scores(spark, sf_dir), "y_true", ["race"]))


# ---- bootstrap and fairness ------------------------------------------------------


def _scored_pred(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("y_pred", TC.threshold(F.col("y_prob"), 0.5))


def _los_top(spark, sf_dir):
    return _los_scores(spark, sf_dir).select("hadm_id", "y_cls", "p0", "p1", "p2", "p3", "pred_cls")


def _both(spark, sf_dir):
    return _scored_pred(spark, sf_dir).join(_los_top(spark, sf_dir), "hadm_id")


@register("bootstrap_ci_overall")
def q_boot_overall(spark, sf_dir):
    return comparable(BS.bootstrap_ci(_scored_pred(spark, sf_dir), ["auroc", "ap", "f1"], [], "hadm_id", 2000, seed=42))


@register("bootstrap_ci_stratified")
def q_boot_strat(spark, sf_dir):
    return comparable(BS.bootstrap_ci(_scored_pred(spark, sf_dir), ["auroc", "f1"], [], "hadm_id", 2000, seed=42,
                                      stratify="y_true"))


@register("subgroup_report")
def q_subgroup_report(spark, sf_dir):
    s = FA.collapse_rare(_scored_pred(spark, sf_dir), "race", 50)
    return comparable(FA.subgroup_report(s, "race", 50, 10, n_boot=2000, seed=42, min_valid=50))


@register("subgroup_metrics_nomin")
def q_subgroup_nomin(spark, sf_dir):
    return comparable(FA.subgroup_metrics(_scored_pred(spark, sf_dir), "race"))


@register("subgroup_both_tasks")
def q_subgroup_both(spark, sf_dir):
    return comparable(FA.both_tasks_table(_scored_pred(spark, sf_dir), _los_top(spark, sf_dir), "race", n_boot=2000))


@register("subgroup_regression")
def q_subgroup_regression(spark, sf_dir):
    return comparable(FA.regression_report(_expected_class(_los_scores(spark, sf_dir)), "race", 50, n_boot=2000))


@register("disparity_gaps")
def q_gaps(spark, sf_dir):
    return comparable(FA.disparity_gaps(_both(spark, sf_dir), n_boot=2000))


@register("roc_by_race_supported")
def q_roc_supported(spark, sf_dir):
    return comparable(FA.roc_by_group(_scores(spark, sf_dir), "race", 50, 10))


def _two_models(spark, sf_dir):
    s = _scored_pred(spark, sf_dir)
    a = s.select(F.lit("score").alias("model"), "hadm_id", "y_true", "y_prob")
    b = s.select(F.lit("coarse").alias("model"), "hadm_id", "y_true",
                 (F.floor(F.col("y_prob") * 10) / 10).alias("y_prob"))
    return a.unionByName(b).withColumn("y_pred", TC.threshold(F.col("y_prob"), 0.5))


@register("model_compare_roc")
def q_model_roc(spark, sf_dir):
    return comparable(M.roc_points(M.score_steps(_two_models(spark, sf_dir), ["model"]), ["model"]))


@register("metric_ci_table")
def q_metric_ci(spark, sf_dir):
    ci = BS.bootstrap_ci(_scored_pred(spark, sf_dir), ["auroc", "ap", "f1"], [], "hadm_id", 2000, seed=42)
    return comparable(FA.metric_ci_table(ci))


@register("metric_bundle")
def q_metric_bundle(spark, sf_dir):
    los = _los_top(spark, sf_dir)
    los2 = los.withColumn("model", F.lit("score")).unionByName(los.withColumn("model", F.lit("coarse")))
    return comparable(FA.metric_bundle(_two_models(spark, sf_dir), los2))


@register("balanced_resample_counts")
def q_balanced(spark, sf_dir):
    r = BS.balanced_resample(_scores(spark, sf_dir), "y_true", "hadm_id", seed=42)
    return r.groupBy("y_true").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("hadm_id").alias("drawn"),
                                   F.max("copy").alias("most"), F.sum("hadm_id").alias("ids"))


# ---- models ------------------------------------------------------------------------


def _adm_split(spark, sf_dir):
    return S.grouped_split(Cohort.of(spark, sf_dir).admissions, "subject_id", 0.2, 0.2, seed=42, val_seed=7)


@register("median_impute_params")
def q_medians(spark, sf_dir):
    adm, cols = MD.numeric_block(_adm_split(spark, sf_dir))
    return comparable(MD.fit_medians(adm.filter(F.col("split") == "train"), cols))


@register("scale_params")
def q_scale(spark, sf_dir):
    adm, cols = MD.numeric_block(_adm_split(spark, sf_dir))
    dev = adm.filter(F.col("split") == "train")
    return comparable(MD.fit_scale(MD.impute_medians(dev, MD.fit_medians(dev, cols), cols), cols), digits=6)


@register("multi_hot_counts")
def q_multi_hot(spark, sf_dir):
    return X.token_frequency(Cohort.of(spark, sf_dir).admissions, "ccsr_union", "ccsr_category")


def _once(spark, sf_dir, name, make):
    """A scored table written once per session and folder, as the reference's reports re-read written predictions;
    what ``make`` wrote itself is not written again."""
    c = Cohort.of(spark, sf_dir)
    held = c.__dict__.setdefault("_scored_tables", {})
    if name not in held:
        made = make()
        held[name] = made if is_written(made) else materialise(made)
    return held[name]


def _prepared(spark, sf_dir):
    return _once(spark, sf_dir, "prepared", lambda: MD.prepare_admissions(_adm_split(spark, sf_dir))[0])


def _mort_scores(spark, sf_dir, only=None):
    """Test scores of all classifiers, at the reference's settings; with ``only`` of that model, which alone is fitted."""
    names = [only] if only else list(MD.classifiers())
    held = Cohort.of(spark, sf_dir).__dict__.setdefault("_scored_tables", {})
    missing = [n for n in names if f"mortality {n}" not in held]
    if missing:
        made = materialise(MD.fit_and_score(_prepared(spark, sf_dir), {n: m for n, m in MD.classifiers().items() if n in missing}))
        held.update({f"mortality {n}": made.filter(F.col("model") == n) for n in missing})
    out = held[f"mortality {names[0]}"]
    for n in names[1:]:
        out = out.unionByName(held[f"mortality {n}"])
    return out


def _los_pred(spark, sf_dir):
    return _once(spark, sf_dir, "los", lambda: MD.fit_and_predict_regression(
        _prepared(spark, sf_dir), MD.regressors(num_trees=50, gbt_iter=50, forest_depth=10)))


def _wide_ci(scored, metrics, n_boot=2000):
    ci = BS.bootstrap_ci(scored, metrics, ["model"], "hadm_id", n_boot)
    wide = ci.groupBy("model").pivot("metric", metrics).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return wide, ci


@register("mortality_leaderboard")
def q_mort_leaderboard(spark, sf_dir):
    """Ranking and thresholded metrics of every model with 2,000-replicate intervals of AUROC and F1."""
    scored = _mort_scores(spark, sf_dir)
    auc = M.auroc_ap(M.score_steps(scored, ["model"]), ["model"])
    conf = M.confusion(scored, ["model"]).select("model", "precision", "recall", "f1", "accuracy")
    wide, _ = _wide_ci(scored, ["auroc", "f1"])
    return auc.join(conf, "model").join(wide, "model").orderBy(F.desc_nulls_last("auroc"), "model")


@register("los_regression_leaderboard")
def q_los_leaderboard(spark, sf_dir):
    """M10 for lengths of stay, with intervals of MAE and RMSE."""
    pred = _los_pred(spark, sf_dir)
    wide, _ = _wide_ci(pred, ["mae", "rmse"])
    return M.regression_errors(pred, ["model"]).join(wide, "model").orderBy("mae")


def _in_ci(ci):
    ok = (F.col("lo") <= F.col("point")) & (F.col("point") <= F.col("hi"))
    return ci.groupBy("model").agg(F.every(F.coalesce(ok, F.lit(False))).alias("points_in_ci"))


@register("mortality_model_facts")
def q_mort_facts(spark, sf_dir):
    """Every model scores every test admission once, finitely, and its intervals hold its points."""
    scored = _mort_scores(spark, sf_dir)
    _, ci = _wide_ci(scored, ["auroc", "f1"])
    facts = scored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").cast("bigint").alias("deaths"), F.sum("hadm_id").alias("ids"),
                                        F.every(TC.finite(F.col("y_prob"))).alias("all_finite"))
    return facts.join(_in_ci(ci), "model")


@register("los_model_facts")
def q_los_facts(spark, sf_dir):
    """M6, M7 and the regression trees: every test admission with a finite target once, predictions not negative."""
    pred = _los_pred(spark, sf_dir)
    _, ci = _wide_ci(pred, ["mae", "rmse"])
    facts = pred.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("days"), F.sum("hadm_id").alias("ids"),
                                      F.every(TC.finite(F.col("yhat")) & (F.col("yhat") >= 0)).alias("all_valid"))
    return comparable(facts.join(_in_ci(ci), "model"), digits=6)


@register("model_reports")
def q_model_reports(spark, sf_dir):
    """Subgroup metrics, calibration and disparity gaps of every model's own test scores."""
    scored = FA.collapse_rare(_mort_scores(spark, sf_dir), "race", 50)
    cell = scored.withColumn("cell", F.concat_ws("|", "model", "race"))
    sub = FA.subgroup_report(cell, "cell", 50, 10).drop("n", "positives")
    cal = FA.calibration_by_group(cell.withColumn("y_prob", F.least(F.greatest("y_prob", F.lit(0.0)), F.lit(1.0))), "cell")
    both = cal.join(sub, "cell", "left").withColumn("model", F.substring_index("cell", "|", 1))
    per = M.auroc_ap(M.score_steps(scored, ["model", "race"]), ["model", "race"])
    gaps = per.groupBy("model").agg((F.max("auroc") - F.min("auroc")).alias("auroc_gap"), (F.max("ap") - F.min("ap")).alias("ap_gap"))
    return both.join(gaps, "model").withColumn("race", F.substring_index("cell", "|", -1)).drop("cell")


@register("model_subgroup_support")
def q_model_support(spark, sf_dir):
    """N22 on model scores: rows and deaths of every reported group, and that each has what its size allows."""
    scored = FA.collapse_rare(_mort_scores(spark, sf_dir, "LogReg"), "race", 50)
    rep = FA.subgroup_report(scored, "race", 50, 10, n_boot=200)
    return rep.select("race", "n", "positives", F.col("auroc").isNotNull().alias("has_auroc"),
                      (F.col("auroc_lo") <= F.col("auroc_hi")).alias("ordered"))


@register("model_vectors")
def q_model_vectors(spark, sf_dir):
    """H6 + H7: the assembled vector of every admission, by its sum, with label and class weight."""
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return comparable(_prepared(spark, sf_dir).select("hadm_id", "split", "y", "weight", total.alias("total")), digits=6)


@register("foreign_scores")
def q_foreign(spark, sf_dir):
    """O4 + A6: a caller's model over Arrow batches, behind the required-column guard."""
    adm = require_columns(Cohort.of(spark, sf_dir).admissions, ["hadm_id", "n_dx_rows", "age_at_admit"])
    rows = adm.select("hadm_id", F.col("n_dx_rows").cast("double"), F.coalesce(F.col("age_at_admit").cast("double"), F.lit(0.0)).alias("age_at_admit"))
    return comparable(MD.score_foreign(rows, lambda x: (x["n_dx_rows"] * 0.03125 + x["age_at_admit"] * 0.0078125).clip(0, 1), ["n_dx_rows", "age_at_admit"]))


@register("gbt_iteration_curve")
def q_gbt_curve(spark, sf_dir):
    """M8 at the reference's 2,000 rounds with a patience of 100."""
    prepared = _prepared(spark, sf_dir)
    return MD.gbt_curve(prepared)


@register("gbt_curve_facts")
def q_gbt_facts(spark, sf_dir):
    """M5 + M8: the booster's curve and cut, in the facts that hold whatever the draw."""
    prepared = _prepared(spark, sf_dir)
    return MD.gbt_facts(prepared, 20, 5)


def _text_split(spark, sf_dir):
    return S.stratified_group_split(_text_records(spark, sf_dir), "subject_id", "race", 0.15, 0.15, seed=42)


def _text_pred(spark, sf_dir):
    return _once(spark, sf_dir, "text", lambda: MD.text_classifier(_text_split(spark, sf_dir), "y_mort").withColumn("y_prob", F.col("probs")[1]))


@register("text_mortality_model")
def q_text_model(spark, sf_dir):
    pred = _text_pred(spark, sf_dir)
    return X.attach_scalars(M.auroc_ap(M.score_steps(pred)), M.confusion(pred).select("f1"))


@register("text_model_facts")
def q_text_facts(spark, sf_dir):
    """Every test record scored once with a probability."""
    return _text_pred(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_true").cast("bigint").alias("deaths"), F.sum("hadm_id").alias("ids"),
        F.every(F.col("y_prob").between(0, 1)).alias("all_probabilities"))


@register("text_los_model")
def q_text_los(spark, sf_dir):
    pred = MD.text_classifier(_text_split(spark, sf_dir), "y_los_cls", family="multinomial")
    pred = pred.select("race", F.col("y_true").alias("y_cls"), F.col("y_pred").alias("pred_cls"),
                       *[F.col("probs")[k].alias(f"p{k}") for k in range(4)])
    f1 = M.multiclass_report(pred, [], "y_cls", "pred_cls").filter(F.col("label") == "macro avg").select("f1")
    return X.attach_scalars(f1, M.ovr_macro_auroc(pred, [], "y_cls"))


def _trajectories(spark, sf_dir):
    seq = _seq_split(spark, sf_dir)
    return MD.trajectory_table(seq, _seq_vocab(spark, sf_dir, seq))


@register("trajectory_model")
def q_trajectory_model(spark, sf_dir):
    """Both heads on the test patients."""
    pred = MD.trajectory_heads(_trajectories(spark, sf_dir))
    los = M.regression_errors(pred, ["split"]).select("split", "mae", "rmse")
    return M.auroc_ap(M.score_steps(pred, ["split"]), ["split"]).join(los, "split")


@register("trajectory_model_inputs")
def q_trajectory_inputs(spark, sf_dir):
    """M12 input: patients, deaths, distinct (step, token) pairs and the scaled static block per split."""
    t = _trajectories(spark, sf_dir)
    static = F.aggregate(vector_to_array("static"), F.lit(0.0), lambda a, x: a + F.abs(x))
    return comparable(t.groupBy("split").agg(
        F.count(F.lit(1)).alias("patients"), F.sum("y_mort").cast("bigint").alias("deaths"), F.avg("y_los_log").alias("los_log"),
        F.sum(F.size("step_tokens")).cast("bigint").alias("pairs"), F.avg(static).alias("static_abs")), digits=6)


SIZES = [0.1 + 0.9 * j / 5 for j in range(6)]


def _curve_models():
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    return {"LogReg": LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", maxIter=30),
            "DecisionTree": DecisionTreeClassifier(featuresCol="features", labelCol="y", weightCol="weight", minInstancesPerNode=10, maxDepth=8)}


@register("learning_curve_auroc")
def q_learning_curve(spark, sf_dir):
    """L4: train and validation AUROC per size over grouped folds, for two models."""
    prepared = _prepared(spark, sf_dir)
    return MD.learning_curve(prepared, _curve_models(), SIZES)


@register("learning_curve_folds")
def q_curve_folds(spark, sf_dir):
    """L3 + L4: patients and admissions of every (fold, size) training part and of the fold."""
    rows = S.fold_entry(_adm_split(spark, sf_dir).filter(F.col("split") != "test"), SIZES, "subject_id", 5, 5, 11)
    part = F.inline(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda f: F.struct(f.alias("of_fold"), F.col("entry")[f].alias("entry"))))
    long = rows.select("subject_id", "hadm_id", part)
    count = [F.countDistinct("subject_id").alias("patients"), F.count(F.lit(1)).alias("admissions")]
    train = long.withColumn("size", F.explode(F.sequence(F.lit(0), F.lit(5)))).filter(F.col("entry") <= F.col("size"))
    val = long.filter(F.col("entry").isNull()).groupBy("of_fold").agg(*count).withColumn("size", F.lit(-1))
    return train.groupBy("of_fold", "size").agg(*count).unionByName(val)


# ---- sources and sinks -----------------------------------------------------------


def _scratch(spark, name):
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardline-io/{name}-{uuid.uuid4().hex}"


@register("csv_roundtrip_admissions")
def q_csv_admissions(spark, sf_dir):
    """A3 -> A1 + A7: admissions written as CSV with a pandas-style index column, read
    back with the declared schema; absent columns come back NULL."""
    adm = Cohort.of(spark, sf_dir).inputs.ehr_admissions
    path = _scratch(spark, "admissions")
    IO.write_table(adm.select(F.col("hadm_id").cast("string").alias("Unnamed: 0"), *adm.columns), path, "csv")
    back = IO.read_csv_typed(spark, path, IO.ADMISSIONS_SCHEMA)
    return back.select("subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "admission_type",
                       "insurance", "race", "hospital_expire_flag")


@register("csv_strings_patients")
def q_csv_patients(spark, sf_dir):
    """A3 -> A2 + C8: all-text read keeps blank and padded values; blanks -> NULL after."""
    pat = Cohort.of(spark, sf_dir).inputs.ehr_patients
    path = _scratch(spark, "patients")
    IO.write_table(pat, path, "csv")
    s = IO.read_csv_strings(spark, path)
    return s.select("subject_id", F.col("gender").alias("gender_raw"), C.blank_to_null(F.col("gender")).alias("gender"),
                    "anchor_age", "anchor_year")


@register("parquet_dx_lists_roundtrip")
def q_parquet_lists(spark, sf_dir):
    """A3 (Parquet keeps arrays) + A4 (code table as JSON) read back."""
    c = Cohort.of(spark, sf_dir)
    path, cpath = _scratch(spark, "dx"), _scratch(spark, "codes")
    IO.write_table(c.with_ccsr.select("subject_id", "hadm_id", "seq_num", "ccsr_list_sorted"), path)
    IO.write_code_table(c.code_table, cpath)
    back = spark.read.parquet(path)
    codes = spark.read.schema("feature string, value string, code int").json(cpath)
    n_codes = codes.agg(F.count(F.lit(1)).alias("n_codes"))
    return comparable(X.attach_scalars(back, n_codes))


# ---- remaining operators: sinks, inference, previews, text, streaming --------------
@register("trajectory_sink_roundtrip")
def q_traj_sink(spark, sf_dir):
    """A5: padded trajectories written partitioned by split and read back."""
    seq = _seq_split(spark, sf_dir)
    pad = TR.padded_patients(TR.token_ids(seq, _seq_vocab(spark, sf_dir, seq)))
    pad = pad.join(seq.select("subject_id", "split").distinct(), "subject_id")
    path = _scratch(spark, "trajectories")
    IO.write_trajectories(pad, path)
    back = spark.read.parquet(path)
    return back.select("subject_id", "split", _nested("dx_ids").alias("dx_ids"), _nested("dx_mask").alias("dx_mask"),
                       F.array_join("adm_mask", ",").alias("adm_mask"))


@register("dx_version_inferred")
def q_version_inferred(spark, sf_dir):
    """Mapping when the version column is absent (code shape decides)."""
    c = Cohort(spark, sf_dir, persist=False)
    m = H.map_codes(c.merged.drop("icd_version"), c.inputs.ehr_icd9_map, version_col="icd_version")
    return comparable(m.select("subject_id", "hadm_id", "seq_num", "dx_norm", "icd10_full", "icd10_3char"))


@register("calibration_top_groups")
def q_calibration_top(spark, sf_dir):
    """Calibration of the six largest groups."""
    s = _scores(spark, sf_dir)
    sizes = s.groupBy("race").agg(F.count(F.lit(1)).alias("n"))
    top = X.top_k(sizes, 6, "n", "race")
    data = s.join(top.select("race"), "race", "left_semi")
    e = M.ece(M.reliability(data, ["race"]), ["race"])
    return comparable(top.join(M.brier(data, ["race"]), "race").join(e, "race"))


@register("feature_preview")
def q_preview(spark, sf_dir):
    """First five feature rows in key order."""
    f = Cohort.of(spark, sf_dir).features.select("subject_id", "hadm_id", "seq_num", "icd10_full", "los_days")
    return comparable(X.preview(f, 5, ["subject_id", "hadm_id", "seq_num"]))


@register("csv_list_column_roundtrip")
def q_csv_lists(spark, sf_dir):
    """J9 + J10: category lists through CSV (as list literals) parsed back."""
    c = Cohort.of(spark, sf_dir)
    d = c.with_ccsr.select("subject_id", "hadm_id", "seq_num", "ccsr_list_sorted")
    path = _scratch(spark, "lists")
    IO.write_table(d, path, "csv")
    s = IO.read_csv_strings(spark, path)
    return comparable(s.select(F.col("subject_id").cast("bigint").alias("subject_id"),
                               F.col("hadm_id").cast("bigint").alias("hadm_id"),
                               F.col("seq_num").cast("int").alias("seq_num"),
                               C.parse_list(F.col("ccsr_list_sorted")).alias("ccsr_list_sorted"),
                               C.list_length(F.col("ccsr_list_sorted")).alias("n_ccsr")))


@register("ci_report_text")
def q_ci_text(spark, sf_dir):
    """J19 + J20: percent-scaled 'p (lo, hi)' text and file-safe metric names."""
    ci = BS.bootstrap_ci(_scored_pred(spark, sf_dir), ["auroc", "f1"], [], "hadm_id", 2000, seed=42)
    return ci.select(C.safe_name(F.concat(F.lit("Mortality "), F.col("metric"), F.lit(" (95% CI)"))).alias("name"),
                     C.fmt_ci(C.pct(F.col("point")), C.pct(F.col("lo")), C.pct(F.col("hi")), 2).alias("text"))


@register("los_softmax_argmax")
def q_softmax(spark, sf_dir):
    """K9: softmax of log-probabilities and its argmax."""
    s = Cohort.of(spark, sf_dir).inputs.ehr_los_scores
    logits = F.array(*[F.log(F.col(c)) for c in PROBS])
    out = s.select("hadm_id", TC.softmax(logits).alias("sm"), TC.argmax(logits).alias("pred_cls"),
                   TC.sigmoid(F.log(F.col("p0") / (F.lit(1.0) - F.col("p0")))).alias("p0_back"))
    return comparable(out.select("hadm_id", "pred_cls", F.array_max("sm").alias("p_max"), "p0_back"))


@register("streaming_dx_harmonised")
def q_stream(spark, sf_dir):
    """Structured Streaming: diagnosis files harmonised by stream-static joins."""
    from ..streaming.incremental import run_once
    c = Cohort.of(spark, sf_dir)
    src, sink, ck = _scratch(spark, "dx-src"), _scratch(spark, "dx-sink"), _scratch(spark, "dx-ckpt")
    dx = c.inputs.ehr_diagnoses
    dx.write.parquet(src)
    run_once(spark, src, dx.schema, c.inputs.ehr_icd9_map, sink, ck, c.ccsr_long)
    out = spark.read.parquet(sink)
    return comparable(out.select("subject_id", "hadm_id", "seq_num", "dx_norm", "icd10_full", "icd10_3char",
                                 "ccsr_list_sorted", "n_ccsr"))


@register("los_regression_losses")
def q_los_losses(spark, sf_dir):
    """K15 (smooth-L1, beta 0.5) and N11 on the expected LOS class."""
    e = _expected_class(_los_scores(spark, sf_dir))
    return comparable(M.losses(e, ["race"], score=None, y_reg="y", yhat_reg="yhat", beta=0.5))


@register("grouped_cv_logreg")
def q_grouped_cv(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    return MD.grouped_cross_validation(prepared)


@register("bootstrap_ci_b2000")
def q_boot_2000(spark, sf_dir):
    """L5/E16 at the reference's 2,000 replicates, per race, all metrics from one
    shared replicate table."""
    return comparable(BS.bootstrap_ci(_scored_pred(spark, sf_dir), ["auroc", "ap", "f1"], ["race"], "hadm_id", 2000,
                                      seed=42))


@register("seq_scaled_static")
def q_seq_scaled(spark, sf_dir):
    """K12 transform: the last-20 admissions of every patient standardised with the
    parameters fitted on training patients (train means come out 0, spreads 1)."""
    seq = _seq_split(spark, sf_dir)
    rows = TR.last_n_admissions(seq)
    params = TR.fit_scaler(rows.filter(F.col("split") == "train"))
    scaled = TR.apply_scaler(rows, params)
    cols = ["age_at_admit", "adm_year", "n_dx", "delta_prev_adm_hours", "race_code"]
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return comparable(scaled.groupBy("split").agg(*aggs), digits=6)
