"""Code rules: worked examples, and properties that hold of any string."""
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wardline.functions import codes as C

TEXT = st.text(alphabet="aAbBzZ019.. \t'_-/%()", max_size=10)

# Written by hand: code as recorded, without case, dots and blanks; letters and digits alone;
# strict category.
CODES = [
    ("i10", "I10", "I10", "I10"),
    (" e11.9 ", "E119", "E119", "E11"),
    ("V45 81", "V4581", "V4581", "V45"),
    ("250.00", "25000", "25000", None),
    ("a1", "A1", "A1", None),
    ("Z99-1", "Z99-1", "Z991", "Z99"),
    ("'F32'", "'F32'", "F32", None),
    ("", None, "", None),
    (" . ", None, "", None),
    (None, None, "", None),
]
# Cleaned code and its lenient category.
CATEGORIES = [("I10", "I10"), ("E119", "E11"), ("25000", "250"), ("A1", None), ("9", None), ("ABCD", "ABC"), (None, None)]
QUOTED = [("'I10'", "I10"), (" 'E11' ", "E11"), ("''", ""), ("a'b", "a'b"), ("", "")]
NAMES = [("Mortality AUROC (95% CI)", "mortality_auroc_95_ci"), ("  LOS--days ", "los--days"), ("__x__", "x"), ("%", ""), ("a/b c", "a_b_c")]


def test_worked_examples(spark):
    rows = spark.createDataFrame([r[:1] for r in CODES], "c string").select(C.normalize_dx("c"), C.clean_icd("c"), C.icd10_3char_strict("c"))
    assert [tuple(r) for r in rows.collect()] == [r[1:] for r in CODES]
    for table, rule in ((CATEGORIES, C.icd10_3char_lenient), (QUOTED, C.strip_quotes), (NAMES, C.safe_name)):
        got = spark.createDataFrame([r[:1] for r in table], "c string").select(rule(F.col("c")))
        assert [r[0] for r in got.collect()] == [r[1] for r in table]


@settings(max_examples=6, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=120))
def test_what_holds_of_any_code(spark, values):
    """Character by character: what a rule may keep, and that case and outer blanks change nothing."""
    df = spark.createDataFrame([(v, f" {v.lower()}\t") for v in values], "c string, d string")
    rules = {"n": C.normalize_dx, "k": C.clean_icd, "s": C.icd10_3char_strict}
    for v, r in zip(values, df.select(*[f(x).alias(name + x) for name, f in rules.items() for x in "cd"]).collect(), strict=True):
        kept = [ch.upper() for ch in v if ch.isalnum()]
        assert r.kc == "".join(kept) == r.kd
        assert (r.nc is None) == all(ch in ". \t" for ch in v) and r.nc == r.nd
        assert not set(r.nc or "") & set(". \tabz")
        assert r.sc == r.sd and (r.sc is None or (len(r.sc) == 3 and r.sc[0].isalpha() and r.sc[1:].isdigit() and (r.nc or "").startswith(r.sc)))


@settings(max_examples=4, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=120))
def test_what_holds_of_any_name(spark, values):
    out = spark.createDataFrame([(v,) for v in values], "c string").select(C.safe_name("c").alias("n"), C.safe_name(C.safe_name("c")).alias("again"))
    for v, r in zip(values, out.collect(), strict=True):
        assert r.n == r.again and set(r.n) <= set("abz019_-") and not r.n.startswith("_") and not r.n.endswith("_")
        assert [ch for ch in r.n if ch.isalnum()] == [ch.lower() for ch in v if ch.isalnum()]
