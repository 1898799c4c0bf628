"""Operators with learned models, joins and files against brute force, held-out rows and round trips."""
import math
import zlib
from collections import Counter, defaultdict
from itertools import chain, combinations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from wardline.llm import brown, codec, common, decontaminate, langid, ngrams, quality, queries, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label double, rid int, n int"
EDGE = [(1, None, None, None, None, 1.0, 1, 1), (2, "", "en", "s", 0, 1.0, 1, 1), (None, "a b c", "en", "s", 5, 1.0, 1, 1),
        (3, "x y " * 30_000, "en", "s", 1, 1.0, 1, 1), (4, "one two\tthree four five", None, None, 1, 1.0, 1, 1),
        (4, "one two\tthree four five", None, None, 1, 1.0, 1, 1), (5, "ONE two three  four five", None, None, 1, 1.0, 1, 1)]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def held(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod == 2


def test_codec_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for ids in ([], [5], [0] * 5000, rng.integers(0, 50257, 9000), np.arange(50257), [1, 2, 3] * 4000):
        ids = np.array(ids, np.uint16)
        assert (codec.decode(codec.encode(ids)) == ids).all()
    whole = codec.encode(np.arange(3000, dtype=np.uint16) % 7)
    for at in [*range(100), *range(100, len(whole), 37), len(whole) - 3]:
        for bit in (1, 128):
            chunk = bytearray(whole)
            chunk[at] ^= bit
            with pytest.raises(ValueError):
                codec.decode(bytes(chunk))
    assert len(codec.encode(np.array([1, 2, 3] * 4000, np.uint16))) < 3000


def test_token_files(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a\t\n\nb  c \r\n d  ", "  x", "a\x1c!b <|endoftext|> z", " \n", "'s 't\n\n\n  a", "x\xa0 y", "  q"]
    e = tokens.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    for x, got in zip(odd, e.ids(odd), strict=True):
        assert list(got) == [*t.encode(x, add_special_tokens=False).ids, 0]
    rng = np.random.default_rng(8)
    signs = [*"ab Z9.!'\t\n\r", "  ", "\n\n", "\xa0", "\u3000", "é", "漢", "😀", "<|endoftext|>", "\x00", "\u200b", " \n", "the ", "\x1c"]
    mixed = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(3000)] + [None, "", "x" * 50000, " \n" * 900]
    for x, got in zip(mixed, chain.from_iterable(map(e.ids, tokens.portions(mixed))), strict=True):
        assert list(got) == [*(t.encode(x, add_special_tokens=False).ids if x else []), 0]
    got, pos = {r.doc_id: r for r in queries.op1_token_files(spark, SF).collect()}, 0
    assert len(got) == len(texts)
    for d in sorted(texts):
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[d])[:4] == (d, pos, len(ids), zlib.crc32(ids.tobytes()))
        pos += len(ids)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op4_neighbour_quality(spark, sf).collect() if r.held_out and r.doc_id in label]
    assert rows and all(0 <= r.score <= 1 and held(r.doc_id, 4) for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in rows]) >= 0.95


def test_quality_sees_words_behind_one_shape(spark):
    """Texts of one typographic shape, told apart by their words or by the order of the same words."""
    rng = np.random.default_rng(4)
    good, spam = ([f"{a}{b}{c}" for a in x for b in "aeiou" for c in x] for x in ("bdgklm", "nprstv"))

    def said(i):
        if i % 3 == 0:
            return " ".join(good[k] for j in rng.integers(0, 90, 60) for k in (2 * j, 2 * j + 1)) + "."
        return " ".join((spam if i % 3 == 1 else good)[k] for k in rng.integers(0, 180, 120)) + "."
    rows = [(i, said(i), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.score(docs, quality.fit(docs, labels), F.col("text")).alias("s")).collect()}
    out = [(got[i] >= 0.5) == q for i, _, q in rows if held(i, 4)]
    assert len(out) > 50 and np.mean(out) >= 0.9


def test_vote_is_exact():
    rng = np.random.default_rng(0)
    v, known = rng.random((20, 5)), rng.random((60, 5))
    y = rng.integers(0, 2, 60).astype(float)
    for a, got in zip(v, quality.vote(v, known, y), strict=True):
        s = sorted(zip(known @ a, y, strict=True), reverse=True)[:quality.NEIGHBOURS]
        w = [min(max(c, 0), 1) ** quality.SHARPNESS for c, _ in s]
        assert abs(got - sum(p * q for p, (_, q) in zip(w, s, strict=True)) / sum(w)) < 1e-9


def test_language_held_out_and_code_lengths(spark, texts):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in queries.op6_ppm_language(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) >= 0.9
    import pandas as pd
    g, n = np.unique(langid.grams("abracadabra"), return_counts=True)
    model = langid.build(pd.DataFrame({"lang": "x", "gram": g.astype(np.int64), "n": n}))
    hist = "\n\n\nabracadabra"
    count = defaultdict(Counter)
    for i in range(3, len(hist)):
        for k in range(4):
            count[hist[i - k:i]][hist[i]] += 1
    bits = 0.0
    for i, c in enumerate("abrxc", 3):
        ctx = ("\n\n\n" + "abrxc")[:i]
        for k in (3, 2, 1, 0):
            seen = count.get(ctx[len(ctx) - k:] if k else "")
            if seen:
                total = sum(seen.values()) + len(seen)
                if c in seen:
                    bits -= math.log2(seen[c] / total)
                    break
                bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    assert abs(langid.text_bits("abrxc", model)[0] - bits) < 1e-9


def test_decontamination_finds_planted_passages(spark, texts):
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    truth = {d: {i for i, x in items.items() if x in " ".join((t or "").lower().split())} for d, t in texts.items()}
    for r in queries.op7_latent_decontamination(spark, SF).collect():
        assert set(r.item_ids) == truth[r.doc_id] and r.contaminated == bool(truth[r.doc_id])


@pytest.mark.parametrize("size", ["10 thousand", "10 million"])
@pytest.mark.parametrize("kind", ["whole", "words changed", "half with answer"])
def test_latent_step_proposes_what_the_checks_accept(spark, texts, size, kind):
    """Passages among words outside the benchmark and among words of other items. With 10 million
    documents every word of the benchmark is as rare as the corpus allows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    if size == "10 million":
        docs = docs.where("false")
    block = next(iter(decontaminate.read_items(bench)))
    plain = [dict(x) for x in block]
    model = decontaminate.fit(docs, block)
    rng, found, planted, tried = np.random.default_rng(3), 0, 0, []
    vocabulary = sorted(model["vocab"])
    for j, x in enumerate(plain):
        ws = [w.decode() for w in x["words"]]
        if kind == "words changed":
            ws = [w if i % 5 else "zzchanged" for i, w in enumerate(ws)]
        elif kind == "half with answer":
            cut = len(ws) - len(x["answer"])
            ws = [w for i, w in enumerate(ws) if i >= cut or i % 2]
        around = [f"zzq{i}" if j % 2 else vocabulary[i % len(vocabulary)].decode() for i in rng.integers(0, 9999, 600)]
        tried.append(" ".join(around[:300] + ws + around[300:]))
        idx = [model["vocab"].get(w, -1) for w in decontaminate.words(tried[-1])]
        item = next(y for g in model["scales"].values() for y in g["items"] if y["id"] == x["id"])
        hop = decontaminate.scale_of(len(item["idx"])) // 2
        windows = [idx[at:at + 3 * hop] for at in range(0, len(idx), hop)]
        share = max(decontaminate.common_subsequence(item["idx"], w) / len(item["idx"]) for w in windows)
        if share >= decontaminate.MIN_COMMON or any(decontaminate.has_run(item["answer_idx"], w) and decontaminate.common_subsequence(
                item["idx"], w) >= decontaminate.PARAPHRASE * len(item["idx"]) for w in windows):
            planted += 1
            found += x["id"] in decontaminate.search(tried[-1], model)
    assert planted >= 0.9 * len(plain) and found >= 0.95 * planted, (found, planted, len(plain))
    # with the latent step switched off nothing is proposed, so nothing is found
    for g in model["scales"].values():
        g["vectors"] = g["vectors"] * 0
    assert not any(decontaminate.search(t, model) for t in tried[:20])


def test_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, 12).tolist(), rng.integers(0, 6, 20).tolist()
        assert decontaminate.common_subsequence(a, b) == plain(a, b)


def brute_components(texts, n, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_marks_never_tell_more_apart_than_there_is():
    rng = np.random.default_rng(5)
    for n in (2, 40, 255, 256, 257, 511, 512, 513, 5000):
        a = np.unique(rng.integers(0, 1 << 62, n))
        for drop in (0, n // 50, n // 6, n):
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, drop // 2 + 1)]))
            apart, told = len(np.setxor1d(a, b)), ngrams.differing(ngrams.marks(a), ngrams.marks(b))
            assert told <= apart
            assert drop < n or n < 40 or told > 0.16 * (len(a) + len(b))  # unrelated sets are told apart


@pytest.mark.parametrize("often", [4, 1])
def test_jaccard_join_brute_force(spark, texts, often, monkeypatch):
    """With ``often`` 1 every sampled token counts as frequent, so pairs of tokens carry the join."""
    monkeypatch.setattr(ngrams, "FREQUENT", often)
    monkeypatch.setattr(ngrams, "SAMPLE_EVERY", 1)
    base = " ".join(f"w{i}" for i in range(120))
    chain = {9000 + i: base.replace(f"w{7 * i} ", f"v{i} ").replace("w3 ", f"z{i} " if i % 2 else "w3 ") for i in range(1, 14)}
    every = texts | chain | {9100: "one", 9101: "One", 9102: "one two three four five six seven", 9103: "one two three four five six seven eight"}
    docs = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    want = brute_components(every, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.jaccard_components(docs, 4, 85).collect()}
    assert got == want


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_jaccard_large_buckets(spark, levels, monkeypatch):
    """One family of copies with 0 to 9 changed words, in subfamilies that share changes: buckets of 3 sets count as large."""
    monkeypatch.setattr(ngrams, "SMALL", 2)
    monkeypatch.setattr(ngrams, "LEVELS", levels)
    monkeypatch.setattr(ngrams, "FREQUENT", 2)
    monkeypatch.setattr(ngrams, "SAMPLE_EVERY", 1)
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(110)], {}
    for i in range(160):
        ws = list(base) if i % 8 else [f"u{j}" for j in range(40 + i)] + base[:20]
        if i % 8:
            for j in range(2 * (i % 4)):
                ws[9 + 11 * j] = f"family{i % 4}"
        for j in rng.choice(len(ws), int(rng.integers(0, 5)), replace=False):
            ws[j] = f"x{rng.integers(0, 3)}"
        texts[i] = " ".join(ws)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.jaccard_components(docs, 4, 85).collect()}
    assert got == brute_components(texts, 4, 85) and len({c for _, c in got.values()}) > 10


def test_frequent_tokens_are_counted_in_all_texts(spark, monkeypatch):
    """Bits equal a count over every text: a token common in a few of 3,000 texts is told, whichever texts they are."""
    texts = [f"a{i} b{i} c{i} d{i}" + (" north south east west" if i % 50 == 7 else "") for i in range(3000)] + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    for often, every in ((4, 16), (4, 15), (2, 1)):
        monkeypatch.setattr(ngrams, "FREQUENT", often)
        monkeypatch.setattr(ngrams, "SAMPLE_EVERY", every)
        cells = Counter(c for t in texts for c in ngrams.cells_of(ngrams.shingles(t, 4, {})).tolist())
        want = {c for c, k in cells.items() if k >= often * every}
        assert set(np.flatnonzero(np.unpackbits(ngrams.frequent_tokens(docs, 4))).tolist()) == want
    assert len(ngrams.frequent_tokens(docs.limit(0), 4)) == 0
    s = ngrams.shingles("north south east west", 4, {})
    assert ngrams.in_order(s, ngrams.frequent_tokens(docs, 4)).tolist() == [~int(s[0])]


def test_class_bigrams(spark, texts):
    rows = queries.op10_class_bigrams(spark, SF).collect()
    count = Counter(w for d, t in texts.items() if not held(d, 7) for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(count.values()), len(count)
    for r in rows:
        ws = [*(texts[r.doc_id] or "").encode().lower().split(), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_exchange_finds_alternating_classes(spark):
    pairs = [(i, j, 10) for i in range(4) for j in range(4, 8)] + [(j, i, 10) for i in range(4) for j in range(4, 8)]
    cls, table = brown.exchange(spark.createDataFrame(pairs, "i int, j int, n long"), 8, n_free=2, rounds=6)
    assert len(set(cls[:4])) == 1 and len(set(cls[4:8])) == 1 and cls[0] != cls[4]
    assert table.sum() == 320


def test_edges(spark):
    edge, none = spark.createDataFrame(EDGE, DOCS), spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([(2, 0, 0), (None, 1, 0), (3, 1, 0), (3, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five"), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    for docs, n in ((edge, len(EDGE)), (none, 0)):
        got = ngrams.jaccard_components(docs.select("doc_id", "text", "n", "label"), 4, 85).collect()
        assert len(got) == n
        if n:
            of = {r.doc_id: r for r in got}
            assert of[5].component_id == 4 and of[1].n_shingles == 0 and of[2].component_id == 2 and of[None].component_id is None
        s = docs.withColumn("score", quality.score(docs, quality.fit(docs, labels), F.col("text"))).collect()
        assert len(s) == n and all(r.score == 0 for r in s if not r.text)
        p = docs.select("doc_id", langid.predict(docs, langid.fit(docs), F.col("text")).alias("p")).collect()
        assert len(p) == n and all(r.p.lang_pred == "und" for r in p if r.doc_id in (1, 2))
        f = decontaminate.contaminated(docs, bench).collect()
        assert len(f) == n and {r.doc_id for r in f if r._found.item_ids} == ({4, 5} if n else set())
        b = brown.score(docs, brown.fit(docs)).collect()
        assert len(b) == n and {r.n_tokens for r in b if r.doc_id in (1, 2)} <= {1}
        t = queries.token_output(docs).collect()
        assert len(t) == n and sorted(r.n_tokens for r in t)[:2] == ([1, 1] if n else [])
    assert decontaminate.contaminated(edge, bench.limit(0)).count() == len(EDGE)


def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5
    near = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    want = {d for d, (_, c) in brute_components(texts, 5, 80).items() if d == c}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == want
    clean = corpus_pipeline.decontamination_stage(spark, docs, SF)
    found = {r.doc_id for r in queries.op7_latent_decontamination(spark, SF).collect() if r.contaminated}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(texts) - found
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF)
    copies = Counter(r.doc_id for r in mixed.collect())
    taken = {r.doc_id: r.taken / r["size"] for r in queries.op8_source_mix(spark, SF).collect() if r["size"]}
    assert mixed.columns == docs.columns and all(abs(copies[d] - taken[d]) <= 0.5 for d in taken)


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like the stages' own, repeated rows and ids, NULL and empty texts, and no rows."""
    names = ["_found", "_hit", "_id", "_copies", "_copy", "_keep", "_first", "_at"]
    docs = spark.createDataFrame(EDGE, DOCS).select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for stage in (corpus_pipeline.near_duplicate_stage, corpus_pipeline.decontamination_stage, corpus_pipeline.mixing_stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all([r[c] for c in names] == list(range(len(names))) for r in rows)
        assert stage(spark, docs.where("false"), SF).count() == 0
    kept = sorted((str(r.doc_id) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()))
    assert kept == ["1", "2", "3", "4", "None"]


def test_batches_of_long_texts_are_bounded(spark):
    """A batch holds about 4 MB whatever the rows are; a lower bound, or one given with a unit, stays."""
    import pandas as pd
    was = spark.conf.get(common.BATCH_LIMIT)
    try:
        spark.conf.unset(common.BATCH_LIMIT)
        common.bounded_batches(spark)
        texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("t"))
        most = texts.mapInPandas(lambda bs: (pd.DataFrame({"n": [len(b)]}) for b in bs), "n long").agg(F.max("n")).first()[0]
        assert most * 3000 <= 1.1 * common.BATCH_BYTES
        for given in ("1000", "64m"):
            spark.conf.set(common.BATCH_LIMIT, given)
            common.bounded_batches(spark)
            assert spark.conf.get(common.BATCH_LIMIT) == given
    finally:
        spark.conf.set(common.BATCH_LIMIT, was)


def test_encoder_keeps_the_most_used_pieces(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), tokens.Encoder(open(path).read())
    monkeypatch.setattr(tokens, "CACHED", 200)
    learn, met, most = e._learn, Counter(), 0
    monkeypatch.setattr(e, "_learn", lambda: (met.update(e.numbers.new), learn()))
    for r in range(30):
        rare = [f"the common word{r}x{i} again{r % 3}　and\x1cso {r * i}" for i in range(20)]
        part = [None, "", *rare, " ".join(f"w{r}y{i} often" for i in range(50))]
        for x, got in zip(part, e.ids(part), strict=True):
            assert list(got) == [*(t.encode(x, add_special_tokens=False).ids if x else []), 0]
        most = max(most, len(e.numbers))
    assert most <= 200 + 100 and met["often"] == 1  # dropped and encoded anew before
    monkeypatch.setattr(tokens, "BANK", 400)
    for r in range(5):
        part = ["x" * 3000 + f" often {r}", "often often"]
        for x, got in zip(part, e.ids(part), strict=True):
            assert list(got) == [*t.encode(x, add_special_tokens=False).ids, 0]


def test_worker_holds_the_state_of_one_operator():
    import public_tokenizers
    definition = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    e = tokens.encoder(definition)
    assert tokens.encoder(definition) is e
    words = common.held_by_worker("word hashes", dict)
    assert common.held_by_worker("word hashes", dict) is words
    assert list(common._HELD) == ["word hashes"] and tokens.encoder(definition) is not e  # stayed beside the join before
    assert len(common._HELD) == 1


def test_no_short_chunk_at_the_end_of_a_shard(spark, monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(tokens, "CHUNK", 1000)
    monkeypatch.setattr(tokens, "REST", 250)
    definition, parts = open(public_tokenizers.path("byte_bpe_50k.json")).read(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for sizes in ([99] * 23, [99] * 22, [99] * 11 + [5000, 5000, 20], [3000], [1], [999, 240], [999, 240, 9, 1], []):
            docs = spark.createDataFrame([(i, "a" + " a" * (n - 1)) for i, n in enumerate(sizes)], "doc_id long, text string")
            chunks = tokens.token_chunks(docs, definition).cache()
            n = [r.n_ids for r in chunks.orderBy("shard", "chunk").collect()]
            assert sum(n) == sum(x + 1 for x in sizes) and all(x < 1250 + 5001 for x in n)
            assert len(n) < 2 or max(sizes) > 1000 or min(n) >= 250
            got = {r.doc_id: (r.start, r.n_tokens) for r in tokens.read_documents(chunks).collect()}
            assert got == {i: (sum(sizes[:i]) + i, x + 1) for i, x in enumerate(sizes)}
            chunks.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
