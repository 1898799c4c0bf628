"""Rows without a group keep their place in every report."""
from wardline.operators import fairness as FR
from wardline.operators import metrics as M


def rows(spark):
    data = [(i, None if i % 3 == 0 else "AB"[i % 2], i % 2, (i * 37 % 100) / 100, (i // 2) % 2) for i in range(300)]
    return spark.createDataFrame(data, "hadm_id long, race string, y_true int, y_prob double, y_pred int")


def test_null_group_survives(spark):
    df = rows(spark)
    assert sum(r.pos + r.neg for r in M.score_steps(df, ["race"]).collect()) == 300
    assert sum(r["count"] for r in M.reliability(df, ["race"]).collect()) == 300
    assert {r.race: r.n for r in FR.subgroup_metrics(df).collect()}["Unknown"] == 100
    assert {r.P + r.N for r in M.grid_counts(df, ["race"], 0.0, 1.0, 11).collect()} == {100.0}
    assert "Unknown" in {r.race for r in FR.roc_by_group(df).select("race").distinct().collect()}


def test_policy_of_a_null_group(spark):
    df = rows(spark)
    for mode in ("f1", "recall", "precision"):
        got = M.threshold_policy(df, ["race"], mode, target_precision=0.99).collect()
        assert sorted(str(r.race) for r in got) == ["A", "B", "None"]
    policy = M.fit_policy(df, "race", "f1", min_n=50, min_pos=1)
    new = df.unionByName(df.limit(5).selectExpr("hadm_id + 1000 AS hadm_id", "'new' AS race", "y_true", "y_prob", "y_pred"))
    scored = M.apply_policy(new, policy, "race")
    assert scored.count() == 305
    used = {(r.race, r.source) for r in scored.select("race", "source").distinct().collect()}
    assert used == {("A", "overall"), ("B", "f1"), (None, "f1"), ("new", "overall")}  # A has no positive
    few = M.apply_policy(df, M.fit_policy(df, "race", "f1", min_n=500), "race")
    assert {r.source for r in few.select("source").distinct().collect()} == {"overall"} and few.count() == 300
