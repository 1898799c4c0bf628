"""Quality classifier: nearest-neighbour voting over broadcast latent-semantic vectors."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import materialise
from .common import bounded_batches, id_crc
from .lsa import ROWS, randomised_basis

# Bound of the labelled sample: ids first by hash. 8,000 vectors of 64 floats are 2 MB.
LABELLED = 8_000
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 8      # a neighbour's weight is its cosine to this power
ACCEPT = 0.7
BLOCK = 512        # documents scored by one matrix product
GRAM = 4           # characters of a shape term; 8 classes make 4,096 terms
EXTRA = 3          # terms for words equal to the last one, repeated words, repeated lines
SHAPES = 8 ** GRAM + EXTRA
BUCKETS = 1 << 13  # hashed words and pairs of neighbouring words, after the shape terms
N_TERMS = SHAPES + BUCKETS


def _classes() -> bytes:
    """Class of each byte: letters by case, digits, space, line end, sentence marks, other marks, non-ASCII."""
    out = bytearray([6] * 128 + [0] * 128)
    for chars, c in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2),
                     (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:'\"()-", 5), (b"!?", 7)):
        for x in chars:
            out[x] = c
    return bytes(out)


CLASSES = _classes()


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts) of a whole text: four-grams of character classes, counts of repetition, words and word pairs."""
    raw = (text or "").encode()
    c = np.frombuffer(raw.translate(CLASSES), np.uint8).astype(np.int32)
    n = np.zeros(N_TERMS)
    if len(c) >= GRAM:
        code = c[:-3] * 512 + c[1:-2] * 64 + c[2:-1] * 8 + c[3:]
        n[:8 ** GRAM] = np.bincount(code, minlength=8 ** GRAM)
    elif len(c):
        n[int(c[0]) * 8 + int(c[-1])] = 1
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n[8 ** GRAM:SHAPES] = sum(map(eq, words, words[1:])), len(words) - len(set(words)), len(lines) - len(set(lines))
    low = raw.lower().split()
    found = Counter(low)
    found.update(map(b" ".join, zip(low, low[1:], strict=False)))
    if found:
        at = np.array([crc32(w) & BUCKETS - 1 for w in found])
        n[SHAPES:] = np.bincount(at, list(found.values()), minlength=BUCKETS)
    idx = np.flatnonzero(n)
    return idx, n[idx]


def weights(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF row of length 1 with logarithmic counts, shape and words of equal weight (empty text: no terms)."""
    idx, n = term_counts(text)
    val = np.log1p(n) * idf[idx]
    cut = np.searchsorted(idx, SHAPES)
    for part in (val[:cut], val[cut:]):
        part /= np.linalg.norm(part) or 1.0
    norm = np.linalg.norm(val)
    return (idx, val / norm) if norm else (idx[:0], val[:0])


def labelled_rows(docs: DataFrame, labels: DataFrame, n: int = LABELLED) -> DataFrame:
    """(text, label) of at most ``n`` labelled ids whose crc32 mod 4 is not 2, first by hash.

    Several labels of an id are averaged; NULL ids and labels are left out."""
    ids = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(id_crc(F.col("doc_id")) % 4 != 2)
           .groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").alias("label"))
           .join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
           .orderBy(F.xxhash64("_id"), "_id").limit(n))
    return (docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
            .select("text", "label"))


def fit(docs: DataFrame, labels: DataFrame, n: int = LABELLED) -> dict:
    """idf, latent basis, unit vectors and labels of the labelled sample (a bounded model)."""
    sample = materialise(labelled_rows(docs, labels, n))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(N_TERMS)
        for b in batches:
            for t in b["text"]:
                df[term_counts(t)[0]] += 1
        idx = np.flatnonzero(df)
        yield pd.DataFrame({"term": idx, "n": df[idx]})

    df = np.zeros(N_TERMS)
    for r in sample.mapInPandas(count, "term int, n double").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    n_rows = sample.count()
    idf = np.log((1 + n_rows) / (1 + df)) + 1

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([weights(t, idf) for t in b["text"]], columns=["idx", "val"])

    basis = randomised_basis(materialise(sample.mapInPandas(rows, ROWS)), N_TERMS, DIMENSIONS).astype(np.float32)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = embed(b["text"], idf, basis)
            yield pd.DataFrame({"label": b["label"].astype(float), "v": list(v.astype(float))})

    got = sample.mapInPandas(vectors, "label double, v array<double>").collect()
    got.sort(key=lambda r: (r["label"], tuple(r["v"])))
    return {"idf": idf, "basis": basis, "labels": np.array([r["label"] for r in got], np.float32),
            "vectors": np.array([r["v"] for r in got], np.float32).reshape(-1, basis.shape[1])}


def embed(texts, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors, one row per text (no terms: zeros)."""
    out = np.zeros((len(texts), basis.shape[1]), np.float32)
    for i, t in enumerate(texts):
        idx, val = weights(t, idf)
        out[i] = val.astype(np.float32) @ basis[idx]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def vote(v: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Similarity-weighted mean label of the exact nearest neighbours of every row of ``v`` (zero rows: 0)."""
    k = min(NEIGHBOURS, len(labels))
    if not k:
        return np.zeros(len(v))
    cos = v @ vectors.T
    top = np.argpartition(cos, len(labels) - k, axis=1)[:, -k:]
    w = np.clip(np.take_along_axis(cos, top, 1), 0, 1).astype(float) ** SHARPNESS
    total = w.sum(1)
    return np.where(total > 0, (w * labels[top]).sum(1) / np.where(total > 0, total, 1), 0.0)


def score(docs: DataFrame, model: dict, text: Column) -> Column:
    """Probability-like score of label 1 for every whole text; empty and NULL texts score 0.

    A column, so rows and their other columns stay as they are. Without labels all score 0."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in batches:
            out = [vote(embed(s.iloc[i:i + BLOCK], m["idf"], m["basis"]), m["vectors"], m["labels"])
                   for i in range(0, len(s), BLOCK)]
            yield pd.Series(np.clip(np.concatenate(out) if out else [], 0.0, 1.0))

    return scored(text)
