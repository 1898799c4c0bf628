"""Spelling variants, Merkle manifest and vector links against brute force, and on edge rows."""
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from wardline.llm import merkle, spelling, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, tree string, idx int, n int"
TAIL = ("w", "t", 1, 1)
ROWS = "vec_id long, embedding array<double>, label int, node int, m int, cell int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *TAIL) for r in rows], DOCS)


# ---- spelling variants ----------------------------------------------------------------
def brute_words(rows):
    count = Counter()
    for doc_id, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % spelling.DROP_EVERY == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                if len(run) >= spelling.MIN_LENGTH:
                    count[run] += 1
                run = ""
    return {w: n for w, n in count.items() if n >= spelling.MIN_COUNT}


def edits(w):
    for i in range(len(w) + 1):
        for c in map(chr, spelling.CODES):
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1:]
        yield w[:i] + w[i + 1:]


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: {e for e in edits(w) if e in n and e != w} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= spelling.RATIO * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def variant_rows(seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdeé") + ["ÿ", "À"]
    base = ["".join(rng.choice(letters, rng.integers(6, 9))) for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = base[int(rng.integers(12) * rng.random())]
            for _ in range(int(rng.random() < 0.3) + int(rng.random() < 0.1)):
                k, c = int(rng.integers(len(w))), letters[int(rng.integers(len(letters)))]
                w = [w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:]][int(rng.integers(3))]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, "-".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 3)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, block):
    """With small blocks every cell is cut into several, each held in its turn."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = [*variant_rows(seed), (8, "kettenwort " * 6 + "kettenwart " * 40 + "kettenbart " * 300), (None, "wortlaut " * 9 + "wortlauf " * 900), (3, None), (5, ""), (6, "kurz " * 50), (7, "a" * 3000 + " "), (7, "a" * 3000)]
    got = spelling.spelling_variants(docs_of(spark, [(i, t, None, None, 1) for i, t in rows]))
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()), key=str)
    want = brute_variants(rows)
    assert got == want
    assert any(r[1] for r in want) and any(r[2] != (r[1] or r[0]) for r in want)


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(docs_of(spark, [])).count() == 0
    assert spelling.spelling_variants(docs_of(spark, [(1, None, None, None, None), (2, "", None, None, 0)])).count() == 0


def test_gram_finds_every_edit():
    words = sorted({e for w in ("abcabc", "banana", "éàéàéà") for e in edits(w) if len(e) == 6} | {"abcabc", "cbacba"})
    side = lambda ws: spelling.Words(pd.DataFrame({"word": ws, "n": 1}))
    longer = sorted({e for w in words[:40] for e in edits(w) if len(e) == 7})[::7]
    for others in (words, longer):
        i, j = spelling.near_pairs(side(words), side(others))
        want = {(a, b) for a in words for b in set(edits(a)) & set(others) if a != b}
        assert {(words[x], others[y]) for x, y in zip(i, j, strict=True)} == want


# ---- Merkle manifest --------------------------------------------------------------------
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def brute_tree(nodes):
    """Root and the proof of every node."""
    proofs, level, under = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        up, cover = [], []
        for s in range(0, len(level), 3):
            run = level[s:s + 3]
            for k, below in enumerate(under[s:s + 3]):
                for leaf in below:
                    proofs[leaf].append((k, run[:k] + run[k + 1:]))
            up.append(h(*run))
            cover.append(sum(under[s:s + 3], []))
        level, under = up, cover
    return level[0], proofs


def brute_manifest(rows, change):
    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append((r[0] is not None, r[0] or 0, brute_leaf(r, r[1]), brute_leaf(r, change(r[1]))))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in names:
        trees[s].sort()
        subs.append(brute_tree([x[2] for x in trees[s]]))
    root, above = brute_tree([s[0] for s in subs])
    out = []
    for s, (sub, proofs), top in zip(names, subs, above, strict=True):
        for (known, i, leaf, seen), proof in zip(trees[s], proofs, strict=True):
            cur = seen
            for k, side in proof + top:
                cur = h(*side[:k], cur, *side[k:])
            out.append((i if known else None, s, leaf, sub, root, "".join("".join(side) for _, side in proof + top), cur, cur == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "band"), [(1, 9), (2, 9), (40, 9), (40, 1), (100, 2), (244, 2)])
def test_manifest_equals_brute_force(spark, n, band):
    """With a band of one or two levels the sweeps pass messages between several blocks of a source."""
    rng = np.random.default_rng(n)
    rows = [(int(rng.integers(n)), ["a\nb", "", None, "line", "\n", "ü\n"][i % 6], None if i % 5 == 0 else "en",
             [None, "hot", "hot", "hot", "", "é", "z"][int(rng.integers(7))], None if i % 7 == 0 else i) for i in range(n)]
    rows += [(None, "x", "en", "hot", 1), rows[0], rows[0], (5, "y " * 40_000, "en", "hot", 3)]
    got = merkle.merkle_manifest(docs_of(spark, rows), F.replace("text", F.lit("\n"), F.lit("")), band)
    got = [(r.doc_id, r.source, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in got.collect()]
    want = brute_manifest(rows, lambda t: t and t.replace("\n", ""))
    assert sorted(got, key=str) == want
    assert any(r[-1] for r in want) and (n < 6 or any(not r[-1] for r in want))


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.merkle_manifest(docs_of(spark, [])).count() == 0
    one = merkle.merkle_manifest(docs_of(spark, [(1, "t", None, None, 1)])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof == "" and one.verified


def test_sweep_queue_stays_small(monkeypatch):
    most = 0
    push = merkle.heapq.heappush

    def seen(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))
    monkeypatch.setattr(merkle.heapq, "heappush", seen)
    s = merkle.Sweep(0, [b"%064d" % i for i in range(3 ** 7 - 5)], 3 ** 7 - 5)
    assert s.top == 7 and most <= 3 * 7
    assert sorted(i for i, _, _ in s.proofs(b"", b"")) == list(range(3 ** 7 - 5)) and most <= 3 * 7


# ---- vector links -----------------------------------------------------------------------
def brute_links(rows, cosine=vectors.COSINE):
    def usable(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, link = len(rows), defaultdict(set)
    for a in range(n):
        for b in range(a):
            (_, u, k), (_, v, m) = rows[a], rows[b]
            if k == m and usable(u, k) and usable(v, m) and len(u) == len(v):
                x, y = np.array(u, float) / np.abs(u).max(), np.array(v, float) / np.abs(v).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    link[a].add(b)
                    link[b].add(a)
    comp = {}
    for a in range(n):
        if a not in comp:
            todo, seen = [a], {a}
            while todo:
                for b in link[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            ids = [rows[x][0] for x in seen if rows[x][0] is not None]
            comp |= dict.fromkeys(seen, min(ids, default=None))
    return sorted(((r[0], len(link[a]), comp[a], None if comp[a] is None else r[0] == comp[a]) for a, r in enumerate(rows)), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], ROWS)
    got = vectors.near_duplicates(df)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=str)


def planted(rng, n, dim, labels, least=0.93):
    """Random vectors, and partners turned by angles around and beyond the least cosine."""
    rows = [rng.normal(size=dim) for _ in range(n)]
    for _ in range(n):
        v, t = rows[int(rng.integers(len(rows)))], rng.normal(size=dim)
        t -= t @ v / (v @ v) * v
        angle = np.arccos(rng.uniform(least - 0.02, 1))
        rows.append(np.cos(angle) * v + np.sin(angle) * np.linalg.norm(v) * t / np.linalg.norm(t))
    return [(i, [float(x) for x in v * 10.0 ** rng.integers(-3, 4)], int(rng.integers(labels))) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    """Up to nine dimensions the probes are sufficient without exception; so is one list at any dimension."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = planted(rng, 150, 8, 2)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(5)] * 2
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 8, 1), (2003, [1.0, None] * 4, 1), (2004, [float("nan")] * 8, 1),
             (2005, [float("inf")] * 8, 1), (2006, rows[0][1], None), (None, rows[0][1], rows[0][2]), (2007, [1.0, 2.0], 1), (2008, [1.0, 2.0], 1),
             (2009, [1e200] * 8, 0), (2010, [1e-200] * 8, 0), (None, [1.0, -2.0] * 4, 5), (None, [1.0, -2.1] * 4, 5)]
    assert found(spark, rows) == brute_links(rows)


def test_nothing_to_link(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1), (2, [0.0], None)]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert found(spark, [(1, [2.0], 1)]) == [(1, 0, 1, True)]


def test_recall_of_probes(spark):
    """64 dimensions and partners close to the least cosine: the worst case for the probes."""
    rng = np.random.default_rng(9)
    rows = [(i, v, 0) for i, v, _ in planted(rng, 1500, 64, 1)]
    x = vectors.unit(np.array([r[1] for r in rows]))
    got = {r[0]: r[1] for r in found(spark, rows)}
    want = ((x @ x.T) >= vectors.COSINE).sum(1) - 1
    assert want.sum() > 1500
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want))
    ix = vectors.Index(x, 10 ** 6)
    own, probes = ix.probes(x)
    assert len(ix.centres) == 256 and np.mean([len(p) for p in probes]) < 64
    a, b = np.nonzero(np.triu(x @ x.T >= vectors.COSINE, 1))
    met = [own[j] in probes[i] or own[i] in probes[j] for i, j in zip(a, b, strict=True)]
    assert np.mean(met) >= 0.99


def test_lookup_distance_is_bounded():
    """The looked-up distance differs from the true one by no more than the coding error."""
    rng = np.random.default_rng(2)
    x = vectors.unit(rng.normal(size=(400, 20)))
    ix = vectors.Index(x, 400)
    own, _ = ix.probes(x)
    codes, far = ix.coded(x, own)
    for cell in np.unique(own):
        at = own == cell
        true = np.linalg.norm(x[:, None] - x[at][None], axis=2)
        assert (np.abs(np.sqrt(np.maximum(ix.distances(x, cell, codes[at]), 0)) - true) <= far[at] + 1e-6).all()
