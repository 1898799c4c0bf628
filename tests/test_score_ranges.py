"""Cumulative counts by score: the sums run where the scores were ranged; what is written is written once."""
from itertools import groupby

from conftest import SF_SMALL
from wardline.operators import metrics as M
from wardline.operators import models as MD
from wardline.operators import ranges as R
from wardline.plans import catalog, sizing
from wardline.plans.cohort import Cohort

NAN = float("nan")


def rows():
    out = [("a", 1, (i * 37 % 50) / 50, i % 3 % 2, 1.0 + i % 4) for i in range(400)]
    out += [("a", None, 0.5, 1, 2.0)] * 300 + [(None, 2, (i % 9) / 9, int(i % 5 == 0), 0.1 * i) for i in range(200)]
    out += [("b", 2, 0.25, None, 1.0), ("b", 2, 0.75, 1, 1.0), ("b", 2, 0.9, None, 1.0), ("b", 2, None, 0, 1.0), ("b", 2, NAN, 1, 1.0)]
    return out


def descending(s):
    return (s is None, 0.0 if s is None or s != s else -s if s else 0.0) if s is None or s == s else (False, float("-inf"))


def expected(data):
    want = {}
    groups = {}
    for g, h, s, y, w in data:
        groups.setdefault((g, h), []).append((s, y, w))
    for key, of in groups.items():
        tp = fp = None
        of = sorted(of, key=lambda r: descending(r[0]))
        for s, ties in groupby(of, key=lambda r: repr(r[0])):
            known = [(y, w) for _, y, w in ties if y is not None]
            if known:
                tp = (tp or 0.0) + sum(w * y for y, w in known)
                fp = (fp or 0.0) + sum(w * (1 - y) for y, w in known)
            want[(*key, s)] = (tp, fp)
    return want


def test_running_counts_by_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, h int, p double, y int, w double").repartition(7)
    steps = M.score_steps(df, ["g", "h"], "y", "p", "w", cells=1)
    got = {(r.g, r.h, repr(r.s)): (r.tp, r.fp) for r in steps.collect()}
    want = expected(data)
    assert got.keys() == want.keys()
    for k, pair in want.items():
        for have, should in zip(got[k], pair):
            assert (have is None) == (should is None) and (should is None or abs(have - should) < 1e-9), (k, got[k], pair)
    # many ranges: the same totals, whichever rows share one
    again = {(r.g, r.h, repr(r.s)): (r.tp, r.fp) for r in M.score_steps(df, ["g", "h"], "y", "p", "w", cells=9).collect()}
    assert all(abs((again[k][0] or 0) - (want[k][0] or 0)) < 1e-9 for k in want if k[0] != "b")


def test_sums_go_on_over_batches(spark):
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([("a" if i < 8 else None, float(i)) for i in range(20)], "g string, x double").coalesce(1)
        got = [r._run_x for r in R.running_sums(df, ["g"], ["x"]).orderBy("x").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == [sum(range(i + 1)) for i in range(8)] + [sum(range(8, i + 1)) for i in range(8, 20)]


def test_ranged_scores_are_not_shuffled_again(spark):
    df = spark.createDataFrame([(i % 3, i / 500, i % 2) for i in range(500)], "g int, y_prob double, y_true int")
    plan = M.score_steps(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_prepared_table_is_written_once(spark, monkeypatch):
    made = []
    real = MD.materialise
    monkeypatch.setattr(MD, "materialise", lambda df: made.append(df.columns) or real(df))
    monkeypatch.setattr(catalog, "materialise", lambda df: made.append(df.columns) or real(df))
    monkeypatch.setattr(Cohort, "_shared", {})
    table = catalog._prepared(spark, SF_SMALL)
    assert sizing.is_written(table) and not sizing.is_written(table.filter("y = 1"))
    assert sum("scaled" in c for c in made) == 1


def test_lag_crosses_partitions_and_batches(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(held, ("3", "false")):
        spark.conf.set(k, v)
    data = [(None if i % 7 == 3 else 0 if i % 5 else i % 4, None if i % 11 == 0 else f"2020-01-{1 + i * 13 % 28:02d} 00:00:00", i // 2, f"x{i}") for i in range(120)]
    try:
        df = spark.createDataFrame(data, "g int, at string, id int, other string").selectExpr("g", "cast(at as timestamp) at", "id", "other")
        out = R.ranged_lag(df, "g", "at", "id", "prev")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((str(r.g), str(r["at"]), r.id, str(r.prev)) for r in out.collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert out.columns == ["g", "at", "id", "other", "prev"] and "hashpartitioning" not in plan
    want = []
    for g in {r[0] for r in data}:
        of = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        want += [(str(g), str(r[1]), r[2], str(before)) for r, before in zip(of, [None, *[r[1] for r in of]])]
    assert got == sorted(want)
