"""Language identification by prediction by partial matching over bytes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_crc

ORDER = 3          # longest context in bytes; a gram is a context and its next byte
PER_LANGUAGE = 400  # bound of the labelled sample: rows of each language, first by id hash
CHUNK = 1 << 22    # bytes of a text scored at once


def grams(text: str) -> np.ndarray:
    """Every byte of the lower-cased text behind its three predecessors, as one 32-bit number."""
    b = np.frombuffer(b"\n" * ORDER + text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def gram_counts(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, gram, n) over a bounded labelled sample of ``docs`` (crc32 of the id mod 4 is not 2)."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(id_crc(F.col("doc_id")) % 4 != 2)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.select(F.col("doc_id"), F.col("lang"), rank.alias("r")).where(F.col("r") <= per_language)
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    sample = known.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                g, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": g.astype(np.int64), "n": n})

    return (sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def build(counts: pd.DataFrame) -> dict:
    """Frozen model: per order the code length in bits of each known gram, and of an escape from each known context.

    Escapes by method C: with T symbols of D kinds seen behind a context, a symbol seen n
    times has probability n / (T + D) and the escape D / (T + D). A context that a language
    never saw costs nothing to leave; below order 0 every byte has probability 1/256."""
    langs = sorted(counts["lang"].unique())
    n_lang = max(len(langs), 1)
    col = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    gram, n = counts["gram"].to_numpy(np.uint32), counts["n"].to_numpy(float)
    below_keys, below = None, None
    orders = []
    for k in range(ORDER + 1):
        part = gram & np.uint32((1 << 8 * (k + 1)) - 1)
        keys, at = np.unique(part, return_inverse=True)
        c = np.zeros((len(keys), n_lang))
        np.add.at(c, (at, col), n)
        ctx, of = np.unique(keys >> np.uint32(8), return_inverse=True)
        total, kinds = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
        np.add.at(total, of, c)
        np.add.at(kinds, of, c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            esc = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
            seen = np.log2((total + kinds)[of]) - np.log2(c)
        if k:
            lower = below[np.searchsorted(below_keys, keys & np.uint32((1 << 8 * k) - 1))]
        else:
            lower = 8.0
        bits = np.where(c > 0, seen, esc[of] + lower)
        orders.append((keys, bits, ctx, esc))
        below_keys, below = keys, bits
    return {"langs": langs, "orders": orders}


def code_lengths(gram: np.ndarray, model: dict, k: int = ORDER) -> np.ndarray:
    """Bits of the last byte of each gram under every language, from the longest context down."""
    keys, bits, ctx, esc = model["orders"][k]
    g = gram & np.uint32((1 << 8 * (k + 1)) - 1)
    out = np.zeros((len(g), bits.shape[1]))
    at = np.searchsorted(keys, g)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == g[hit]
    out[hit] = bits[at[hit]]
    miss = ~hit
    if miss.any():
        c = g[miss] >> np.uint32(8)
        where = np.minimum(np.searchsorted(ctx, c), max(len(ctx) - 1, 0))
        known = ctx[where] == c if len(ctx) else np.zeros(len(c), bool)
        leave = np.where(known[:, None], esc[where] if len(ctx) else 0.0, 0.0)
        out[miss] = leave + (code_lengths(g[miss], model, k - 1) if k else 8.0)
    return out


def text_bits(text: str, model: dict) -> np.ndarray:
    """Exact code length in bits of the whole text under every language."""
    g = grams(text)
    out = np.zeros(len(model["langs"]))
    for i in range(0, len(g), CHUNK):
        kinds, n = np.unique(g[i:i + CHUNK], return_counts=True)
        out += n @ code_lengths(kinds, model)
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    return build(gram_counts(docs, per_language).toPandas())


def predict(docs: DataFrame, model: dict, text: Column) -> Column:
    """struct(lang_pred, score): shortest code, and its posterior under equal priors.

    NULL texts, texts without a letter and empty models give ``und`` with score 0; equal
    code lengths go to the first language in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            rows = []
            for t in s:
                if not m["langs"] or t is None or not any(map(str.isalpha, t)):
                    rows.append(("und", 0.0))
                    continue
                bits = text_bits(t, m)
                best = int(bits.argmin())
                rows.append((m["langs"][best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predicted(text)
