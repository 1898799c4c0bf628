"""The native operators against brute force, and on edge rows."""
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from wardline.llm import common, mixing, queries, rules, secrets, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, h string, rid int"
EDGE = [(1, None, None, None, None, 1, "a", 1), (2, "", "en", "s", 0, 1, "a", 1), (None, "a b c", "en", "s", 5, 1, "a", 1),
        (3, "x y " * 30_000, "en", "s", 1, 1, "a", 1), (4, "token=abcdefghijkl1 \n\n \t token=abcdefghijkl1", None, None, 1, 1, "a", 1),
        (4, "token=abcdefghijkl1 \n\n \t token=abcdefghijkl1", None, None, 1, 1, "a", 1)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_spans(text):
    found = []
    for m in re.finditer(secrets.ASSIGN, text, re.ASCII):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    return sorted(found)


def test_secret_spans_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    tricky = [(9001, "password=secret: abcdefghijklmnop token=\"é\" AKIAAKIA" + "B" * 20), (9002, "😀 ſecret=abcdefghijklmnop Api_Key : '0123456789abcdef0'")]
    docs = docs.unionByName(spark.createDataFrame(tricky, "doc_id long, text string"))
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for r in docs.collect():
        assert [tuple(s) for s in got[r.doc_id].spans if s.kind < 3] == brute_spans(r.text or "")


def test_secret_query_digest(spark):
    rows = queries.op3_secret_scan(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(texts[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert all(x in r.spans.split(",") for x in want.split(",") if x)


def test_markov_stretches_equal_brute_force(spark):
    """Random strings of 12 characters, glued to words before, behind and between."""
    rng = random.Random(6)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = lambda n: "".join(rng.choice(chars) for _ in range(n))
    names = ("configuration", "parameter_value", "authentication", "documentation", "config/local/data")
    samples = [(True, made(24)) for _ in range(3000)] + [(False, w) for w in names for _ in range(80)]
    ratios = secrets.markov_ratios(spark.createDataFrame(samples, "random boolean, token string"))
    runs = [made(n) for n in (12, 13, 14, 15) for _ in range(3)]
    runs += [f"authentication/configuration/documentation/{made(20)}" for _ in range(4)]
    runs += [f"{made(20)}/authentication/configuration/documentation/{made(20)}/parameter_value" for _ in range(4)]
    runs += ["authentication/configuration/documentation", "parameter_value", "documentation"]
    docs = spark.createDataFrame([(i, f"x {w} y") for i, w in enumerate(runs)], "doc_id long, text string")
    got = {r.doc_id: [(s.start - 2, s.end - 2) for s in r.spans if s.kind == 3] for r in secrets.secret_spans(docs, ratios).collect()}

    def best(w, least=12):
        r = [round(ratios[ord(a) * 128 + ord(b)], 4) for a, b in zip(w, w[1:], strict=False)]
        return max((round(sum(r[a:b - 1]), 6), -a, b) for a in range(len(w)) for b in range(a + least, len(w) + 1))
    for i, w in enumerate(runs):
        top, a, b = best(w)
        assert bool(got[i]) == (top >= secrets.MIN_RATIO)
        if len(got[i]) == 1:
            assert got[i] == [(-a, b)]
    # This small model has little to say on characters that its ordinary words lack.
    assert any(got[i] for i in range(12)) and any(got[i] for i in range(12, 16))
    assert not any(got[i] for i in range(20, 23)) and any(len(got[i]) == 2 for i in range(16, 20))


def test_markov_separates_random_from_words(spark):
    samples = [(True, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(300)]
    samples += [(False, w) for w in ("configuration", "parameter_value", "authentication", "documentation") for _ in range(50)]
    ratios = secrets.markov_ratios(spark.createDataFrame(samples, "random boolean, token string"))
    docs = spark.createDataFrame([(1, "x 9f8e7d6c5b4a39281706f5e4 y"), (2, "authentication_parameter_documentation")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.secret_spans(docs, ratios).collect()}
    assert (2, 3, 26) in got[1] and got[2] == []
    plain = sum(ratios[ord(a) * 128 + ord(b)] for a, b in zip("9f8e7d6c", "f8e7d6c", strict=False))
    row = spark.range(1).select(secrets.log_ratio(F.lit("9f8e7d6c"), ratios).alias("r")).first()
    assert abs(row.r - plain) < 1e-2


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(mixing.mix(docs.repartition(5)).collect())]
    src = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = src[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, full, goal = {}, set(), 1.5 * sum(size.values())
    while True:
        free = [s for s in names if s not in full]
        rest = goal - sum(2 * size[s] for s in full)
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    want = {s: 2.0 * size[s] if s in full else level * weight[s] for s in names}
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - want[s]) <= 0.05 * want[s]


def test_schedule_is_balanced_in_every_prefix(spark):
    sizes = spark.createDataFrame([("a", 60_000), ("b", 30_000), (None, 9_000)], "source string, source_size long")
    plan = mixing.block_plan(mixing.source_targets(sizes)).cache()
    slots = sorted(r.asDict().items() for r in mixing.schedule(plan).collect())
    slots = sorted((dict(s) for s in slots), key=lambda s: s["slot"])
    plans = {r.sid: r for r in plan.collect()}
    whole = Counter(s["sid"] for s in slots)
    assert all(whole[i] == p.k1 - p.k0 and whole[i] <= 2 * p.n_blocks for i, p in plans.items())
    seen = Counter()
    for n, s in enumerate(slots, 1):
        assert s["rank"] == seen[s["sid"]] and s["block_no"] == s["rank"] % plans[s["sid"]].n_blocks
        seen[s["sid"]] += 1
        assert all(abs(seen[i] - n * whole[i] / len(slots)) < 10 for i in whole)


def test_url_rules_and_bloom(spark):
    rows = [(1, "http://a.example.org/es/x?q#f"), (2, "HTTP://EXAMPLE.ORG/en/12"), (3, "x://b.com/fr/"), (4, None), (5, "no scheme"),
            (6, "http://www.q.net/p/1.html"), (7, "https://q.net/p/1/?utm=2"), (8, "http://notexample.org/es/"), (9, "http://org"), (9, "http://org")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.url_filter(pages, urls.repeated_urls(pages)).collect()}
    assert (got[1].rule, got[1].verdict, got[1].path) == ("example.org/es/", "block", "/es/x")
    assert (got[2].rule, got[2].host) == ("example.org/en/1", "example.org")
    assert got[3].verdict == "allow" and got[4].verdict == got[5].verdict == "allow" and got[5].host == got[4].path == ""
    assert got[6].listed and got[7].verdict == "block" and got[8].rule == "org/" and got[9].rule is None


def test_bloom_passes_every_listed_key_and_join_is_exact(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("u"))
    rows = spark.range(60_000).select("id", F.concat(F.lit("k"), "id").alias("u"))
    got = urls.listed_by_bloom(rows, listed, "u").agg(
        F.sum(F.col("listed").cast("int")).alias("l"), F.sum(F.col("bloom_hit").cast("int")).alias("h"),
        F.sum((F.col("listed") & (F.col("id") >= 20_000)).cast("int")).alias("wrong")).first()
    assert got.l == 20_000 and got.wrong == 0 and 20_000 <= got.h < 24_000


def test_repeat_words_brute_force(spark):
    texts = ["a b c d e " * 3, "a a a a a a a", "a b c d", "", "a b c d e f a b c d e", "p q r s t u v w x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.n for r in df.select("i", rules.repeat_words(common.words_of(F.col("text"))).alias("n")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        win = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
        c = Counter(win)
        assert got[i] == len({j + k for j, x in enumerate(win) if c[x] > 1 for k in range(5)})


def test_edges(spark, edge, empty):
    two = rules.line_rules(edge)
    rows = two.collect()
    assert len(rows) == len(EDGE) and sum(r.doc_id == 4 for r in rows) == 2
    assert all(r.base_failed and not r.kept for r in rows)
    assert next(r for r in rows if r.doc_id == 4).n_dup_lines == 0
    three = secrets.find_secrets(edge).collect()
    assert len(three) == len(EDGE) and [len([s for s in r.spans if s.kind < 3]) for r in three if r.doc_id == 4] == [2, 2]
    mixed = mixing.mix(edge).collect()
    assert len(mixed) == len(EDGE) and {r.taken for r in mixed if r["size"] == 0} == {0}
    for op in (rules.line_rules, secrets.find_secrets, mixing.mix):
        assert op(empty).collect() == []
    none = spark.createDataFrame([], "page_id long, url string, w0 long")
    assert urls.url_filter(none, urls.repeated_urls(none)).collect() == []


@pytest.mark.parametrize("name", ["op2_line_rules", "op5_url_filter"])
def test_oracle(spark, duck, name):
    from wardline.llm.oracle import ORACLE
    rel = duck.execute(ORACLE[name])
    cols = [c[0] for c in rel.description]
    want = Counter(rel.fetchall())
    assert Counter(tuple(r) for r in queries.QUERIES[name](spark, SF).select(*cols).collect()) == want
