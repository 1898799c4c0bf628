"""Cohort steps that every report shares: same rows, without work that grows faster than needed."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from wardline.functions import codes as C
from wardline.functions import timecols as T
from wardline.operators import features as FE
from wardline.operators import models as MD
from wardline.plans.cohort import Cohort


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rollup_takes_each_columns_first_value(spark):
    rows = [(1, 10, 2, "B", "x", None, 5, ["k"]), (1, 10, 1, "C", None, None, 4, None), (1, 10, 1, "A", None, 0.5, 3, ["m", "k"]),
            (2, 20, 1, "A", None, None, None, None), (2, 20, 2, "A", None, None, None, ["z"]),
            (None, 30, 3, None, "q", 1.5, None, ["a"]), (None, 30, 4, "A", "r", 2.5, 7, None)]
    df = spark.createDataFrame(rows, "hadm_id long, subject_id long, seq_num int, icd_code string, late string, score double, n int, ccsr_list_sorted array<string>")
    out = FE.admission_rollup(df)
    assert "Aggregate" not in optimised(out)  # written once, however often it is read
    got = {r.hadm_id: r for r in out.collect()}

    def first(rows, i):
        return next((r[i] for r in sorted(rows, key=lambda r: (r[2], r[3] or "")) if r[i] is not None), None)

    for key in (1, 2, None):
        own = [r for r in rows if r[0] == key]
        assert [got[key][c] for c in ("subject_id", "seq_num", "icd_code", "late", "score", "n")] == [first(own, i) for i in range(1, 7)]
        lists = sorted({x for r in own for x in r[7] or []})
        assert (got[key].ccsr_union, got[key].n_ccsr_unique, got[key].n_dx_rows) == (lists, len(lists), len(own))


def test_rollup_marks_more_columns_than_a_word_has_bits(spark):
    wide = spark.createDataFrame([(1, 1), (1, 2)], "hadm_id long, seq_num int").withColumns(
        {f"c{i}": F.when(F.col("seq_num") == 1 + i % 2, F.lit(i)) for i in range(130)} | {"ccsr_list_sorted": F.array(F.lit("a"))})
    row = FE.admission_rollup(wide).first()
    assert [row[f"c{i}"] for i in range(130)] == list(range(130))


def test_numbers_stay_numbers(spark):
    df = spark.createDataFrame([(2**53 + 1, 0.1, -3), (-7, float("nan"), None), (0, float("inf"), 9), (5, -0.0, 1)], "a long, b double, c int")
    out, cols = MD.numeric_block(df, ["a", "b", "c"])
    assert "as string" not in optimised(out).lower()
    by_text = df.select(*[T.to_number(F.col(c), None).alias(c) for c in cols])
    assert out.collect() == by_text.collect()
    assert df.select(T.to_number(F.col("b").cast("float"), None, "float")).first()[0] == 0.1  # a float's own text


def test_codes_are_looked_up_once_a_row(spark):
    c = Cohort.of(spark, SF_SMALL)
    dx = c.with_ccsr.withColumn("gender", F.when(F.col("hadm_id") % 5 == 0, F.lit(None)).when(F.col("hadm_id") % 5 == 1, " f\t").otherwise(F.col("gender")))
    got = FE.engineer(dx)
    assert optimised(got).count("Join ") == optimised(dx).count("Join ") + 1
    plain = FE.clean_demographics(dx)
    want = FE.count_categories(FE.time_features(FE.apply_codes(plain, FE.code_table(plain))))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_trimming_as_the_expression_does(spark):
    texts = ["", " ", " a", "a ", "\ta b\n", "a  ", "  a", "a\n", "a \r\n", "\x0b a.1 \x0c", " a ", "a \u0085", "x y", None, ". .", "e11.9 ", "   "]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    old = F.regexp_replace("s", r"^\s+|\s+$", "")
    dx = F.nullif(F.regexp_replace(F.upper(old), r"[.\s]+", ""), F.lit(""))
    three = F.nullif(F.regexp_extract(F.regexp_replace(F.upper(old), r"\.", ""), r"^([A-Z][0-9]{2})", 1), F.lit(""))
    rows = df.select(C.strip_ws("s"), old, C.normalize_dx("s"), dx, C.icd10_3char_strict("s"), three).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in rows)
    assert "trim(" in optimised(df.select(C.strip_ws("s")))


def test_generated_methods_are_compiled(spark):
    Cohort(spark, SF_SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_rollup_tasks_read_bounded_pieces(spark, monkeypatch):
    """Wide rows are sorted by tasks of small scans, over row groups that allow them; the setting comes back afterwards."""
    import os

    import pyarrow.parquet as pq

    from wardline.operators import features as FE
    from wardline.plans import session, sizing
    given, seen = spark.conf.get(session.SCAN_LIMIT), []
    write = sizing.materialise
    monkeypatch.setattr(FE, "materialise", lambda df: seen.append(spark.conf.get(session.SCAN_LIMIT)) or write(df))
    rows = spark.createDataFrame([(1, 1, "A", ["x"]), (1, 2, "B", None)], "hadm_id long, seq_num int, race string, ccsr_list_sorted array<string>")
    assert [(r.race, r.n_dx_rows) for r in FE.admission_rollup(rows).collect()] == [("A", 2)]
    assert seen == [str(session.SCAN_BYTES)] and spark.conf.get(session.SCAN_LIMIT) == given
    monkeypatch.setattr(sizing, "ROW_GROUP", 1 << 16)
    at = sizing.materialise(spark.range(200_000).selectExpr("xxhash64(id) AS x").coalesce(1))._written_to.removeprefix("file:")
    files = [f for f in os.listdir(at) if f.endswith(".parquet")]
    assert sum(pq.ParquetFile(f"{at}/{f}").num_row_groups for f in files) > 4


def test_text_split_reads_written_records(spark):
    """A split reads its records twice: from a written table, not from the diagnosis rows; counts need no texts."""
    from conftest import SF_SMALL
    from wardline.plans import catalog as Q
    from wardline.plans.cohort import Cohort
    Cohort._shared.pop((spark.sparkContext.applicationId, spark.sparkContext.getCheckpointDir(), SF_SMALL), None)
    first = Q.QUERIES["text_split_counts"](spark, SF_SMALL)
    assert "seq_num" not in first._jdf.queryExecution().toString()
    assert "text" not in Q._text_records(spark, SF_SMALL, "race").columns
    whole = Q._text_split(spark, SF_SMALL)
    assert "text" in whole.columns and "seq_num" not in whole._jdf.queryExecution().toString()
    again = Q.QUERIES["text_split_counts"](spark, SF_SMALL)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
