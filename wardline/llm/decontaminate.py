"""Benchmark decontamination: latent semantic retrieval, then common subsequences and answers."""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import materialise
from .common import free_name
from .lsa import ROWS, randomised_basis

ITEMS = 256        # benchmark items of one block: the bound of what a task holds
DIMENSIONS = 128   # of the latent space of a block
MIN_COSINE = 0.18  # of a window and an item in it
MIN_REACH = 0.25   # of the item's latent length that the window covers along it
FLOOR = 1e-4       # document share added to every word's, so weights do not grow with the corpus
MIN_COMMON = 0.75  # of an item's words in a common subsequence with the window
PARAPHRASE = 0.45  # enough when the item's answer stands in the window too
ANSWER = 4         # least words of an answer: the item's last sentence, or its last words
SEGMENT = 1 << 14  # words of a text embedded at once (items are shorter)
# Bytes of a word are letters, digits and non-ASCII; A-Z are lower-cased.
TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 or 48 <= x <= 57 else 32 for x in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def scale_of(n: int) -> int:
    """Power of two, 8 at least, that holds an item of n words."""
    return max(8, 1 << (n - 1).bit_length())


def read_items(benchmark: DataFrame) -> Iterator[list[dict]]:
    """The benchmark in blocks of ``ITEMS``, one at a time: id, words and answer of each item with a word."""
    rows = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    now = []
    for r in rows.toLocalIterator():
        w = words(r["text"])
        if w:
            last = [x for x in (words(s) for s in re.split(r"[.!?\n]", r["text"])) if x]
            answer = last[-1] if len(last[-1]) >= ANSWER else w[-ANSWER:]
            now.append({"id": r["item_id"], "words": w, "answer": answer})
        if len(now) == ITEMS:
            yield now
            now = []
    if now:
        yield now


def fit(docs: DataFrame, items: list[dict]) -> dict:
    """Vocabulary, idf over all documents, latent basis of the block's TF-IDF passages, and its vectors.

    The basis is fitted on the benchmark's passages: with documents among them, the few
    leading dimensions describe the documents, and items lose most of their length. Words
    outside the vocabulary weigh nothing and idf depends on document shares alone, so a
    window's cosine is the same in a corpus of any size."""
    vocab = {w: i for i, w in enumerate(sorted({w for x in items for w in x["words"]}))}
    n = len(vocab)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, df, rows = shared.value.get, np.zeros(n, np.int64), 0
        for b in batches:
            for t in b["text"]:
                rows += 1
                seen = {get(w, -1) for w in set(words(t))}
                seen.discard(-1)
                df[list(seen)] += 1
        idx = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(idx, -1), "n": np.append(df[idx], rows)})

    df, n_docs = np.zeros(n), 0
    for r in docs.select("text").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            n_docs = r["n"]
        else:
            df[r["term"]] = r["n"]
    idf = np.maximum(-np.log(np.minimum(df / max(n_docs, 1), 1) + FLOOR), 0.1)

    def tfidf(ws: list[bytes], get) -> tuple[list, list]:
        idx, tf = np.unique([i for i in map(get, ws) if i is not None] or np.zeros(0, int), return_counts=True)
        val = tf * idf[idx]
        return idx, val / (np.linalg.norm(val) or 1.0)

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for b in batches:
            yield pd.DataFrame([tfidf(words(t), get) for t in b["text"]], columns=["idx", "val"])

    mine = docs.sparkSession.createDataFrame(
        pd.DataFrame({"text": [b" ".join(x["words"]).decode("utf-8", "replace") for x in items]}), "text string")
    rows = materialise(mine.mapInPandas(passages, ROWS))
    basis = randomised_basis(rows, n, DIMENSIONS)
    embed = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    model = {"vocab": vocab, "embed": embed, "mass": np.append(idf ** 2, 0).astype(np.float32), "scales": {}}
    for x in items:
        idx = [vocab[w] for w in x["words"]]
        v = embed[idx].sum(0)
        x |= {"idx": idx, "vector": v / (np.linalg.norm(v) or 1.0), "length": np.linalg.norm(v), "answer_idx": [vocab[w] for w in x["answer"]]}
        model["scales"].setdefault(scale_of(len(idx)), {"items": []})["items"].append(x)
    for g in model["scales"].values():
        g["vectors"] = np.array([x["vector"] for x in g["items"]], np.float32).T.copy()
        g["reach"] = np.array([MIN_REACH * x["length"] for x in g["items"]], np.float32)
    return model


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def has_run(run: list[int], ws: list[int]) -> bool:
    return any(ws[i:i + len(run)] == run for i, x in enumerate(ws) if x == run[0])


def search(text: str | None, model: dict) -> dict[int, float]:
    """Items found in a whole text, with the largest common share of their words.

    Windows of 1.5 times an item's scale start every half scale, so each passage of an
    item's length lies whole in one. The latent space proposes (window, item) pairs; common
    subsequence and answer decide."""
    get, none = model["vocab"].get, len(model["vocab"])
    found: dict[int, float] = {}
    idx = np.array([get(w, none) for w in words(text)], np.int32)
    least, most = min(model["scales"], default=0) // 2, max(model["scales"], default=0) // 2
    for at in range(0, len(idx) if most else 0, SEGMENT):
        part = idx[at:at + SEGMENT + 2 * most]  # scales are powers of two below a segment, or one segment holds the text
        cuts = np.arange(0, len(part), least)
        sums = np.add.reduceat(model["embed"][part], cuts, axis=0), np.add.reduceat(model["mass"][part], cuts)
        hop = least
        while hop <= most:  # sums over half scales, each from the pairs of the one below
            if 2 * hop in model["scales"]:
                _look(*sums, part, hop, model["scales"][2 * hop], found)
            sums, hop = tuple(_paired(x) for x in sums), 2 * hop
    return found


def _paired(x: np.ndarray) -> np.ndarray:
    out = x[::2].copy()
    out[:len(x) // 2] += x[1::2]
    return out


def _look(v: np.ndarray, m: np.ndarray, part: np.ndarray, hop: int, items: dict, found: dict[int, float]) -> None:
    win, mass = v.copy(), m.copy()
    for s in (1, 2):  # three half scales make a window
        if len(v) > s:
            win[:-s] += v[s:]
            mass[:-s] += m[s:]
    along = win @ items["vectors"]
    for w, i in zip(*np.nonzero(along >= np.maximum(items["reach"], MIN_COSINE * np.sqrt(mass)[:, None])), strict=True):
        x = items["items"][i]
        if found.get(x["id"], 0) == 1.0:
            continue
        ws = part[w * hop:w * hop + 3 * hop].tolist()
        share = common_subsequence(x["idx"], ws) / len(x["idx"])
        if share >= MIN_COMMON or share >= PARAPHRASE and has_run(x["answer_idx"], ws):
            found[x["id"]] = max(found.get(x["id"], 0.0), share)


def contamination(docs: DataFrame, model: dict, text: Column) -> Column:
    """struct(item_ids sorted, common): items found in each row's whole text; none for NULL or empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("item_ids array<long>, common double")
    def searched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            hits = [search(t, shared.value) for t in s]
            yield pd.DataFrame({"item_ids": [sorted(h) for h in hits], "common": [max(h.values(), default=0.0) for h in hits]})

    return searched(text)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of ``docs`` with a last column struct(item_ids, common): the items found (none: clean) and the largest common share.

    The column is named ``_found``, with underscores behind it if ``docs`` has that name. Rows
    and their columns stay as they are, repeated rows too; an empty benchmark finds nothing. A
    benchmark beyond ``ITEMS`` items is read and searched in blocks."""
    name, hit = free_name(docs, "_found"), free_name(docs, "_hit")
    out = docs.withColumn(name, F.struct(F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("common")))
    for block in read_items(benchmark):
        out = out.withColumn(hit, contamination(docs, fit(docs.select("text"), block), F.col("text"))).withColumn(name, F.struct(
            F.array_sort(F.array_union(f"{name}.item_ids", f"{hit}.item_ids")).alias("item_ids"),
            F.greatest(f"{name}.common", f"{hit}.common").alias("common"))).drop(hit)
    return out
