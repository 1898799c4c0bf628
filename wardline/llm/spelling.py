"""Spelling variants: words one edit apart, by blocked Gram matrices of their letter counts."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import checked_broadcast, materialise
from .blocks import meetings
from .common import ascii_lower

MIN_LENGTH = 6     # code points of a word
MIN_COUNT = 5      # occurrences of a word
RATIO = 5          # a form occurs at least this many times as often as its variant
DROP_EVERY = 199   # one in so many runs, by hash, loses a letter
BLOCK = 1024       # words of a held block
PASS = 2048        # words multiplied with it at once
LETTERS = 1 << 22  # most letters of a block of very long words
# The letters are A-Z, a-z and U+00C0 to U+00FF, one Latin-1 byte each.
CODES = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)])
COLUMN = np.zeros(256, np.int64)
COLUMN[CODES] = np.arange(len(CODES))
GROUPS = 6         # letters fall into groups by code; a cell holds the words of equal group counts


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts: letter runs, A-Z lower-cased, some with a letter deleted by hash of id and run."""
    runs = docs.where("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit(rf"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % DROP_EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))))
    return (runs.select(F.coalesce(word, "run").alias("word")).where(F.length("word") >= MIN_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT))


def group_counts(word: Column) -> list[Column]:
    """Letters of the word in each group: codes equal modulo ``GROUPS``."""
    return [F.regexp_count(word, F.lit("[" + "".join(chr(c) for c in CODES if c % GROUPS == g) + "]")) for g in range(GROUPS)]


def steps() -> list[tuple[int, list[int]]]:
    """(role, change of the group counts) from a word to the words near it, each unordered pair once.

    Role 1: a letter replaced within its group, the cell stays. Role 2: a letter inserted.
    Role 3: a letter replaced by one of a later group."""
    unit = np.eye(GROUPS, dtype=int)
    return ([(1, [0] * GROUPS)] + [(2, unit[g].tolist()) for g in range(GROUPS)] +
            [(3, (unit[g] - unit[k]).tolist()) for g in range(GROUPS) for k in range(g + 1, GROUPS)])


class Words:
    """Words of one length as letters, letter counts and squared sizes."""

    def __init__(self, rows: pd.DataFrame):
        self.text = rows["word"].to_numpy(object)
        self.n = rows["n"].to_numpy(np.int64)
        self.raw = np.frombuffer("".join(self.text).encode("latin-1"), np.uint8).reshape(len(rows), -1)
        at = np.arange(len(rows))[:, None] * len(CODES) + COLUMN[self.raw]
        self.counts = np.bincount(at.ravel(), minlength=len(rows) * len(CODES)).reshape(len(rows), -1).astype(float)
        self.square = (self.counts ** 2).sum(1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by exactly one replaced letter, or (b one longer) one inserted letter."""
    n = a.shape[1]
    if n == b.shape[1]:
        return (a != b).sum(1) == 1
    front = np.cumprod(a == b[:, :n], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    return front + back >= n


def near_pairs(held: Words, other: Words) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs one edit apart: squared count distance at most two by the Gram matrix, then the edit itself."""
    gap = held.square[:, None] + other.square[None, :] - 2 * (held.counts @ other.counts.T)
    i, j = np.nonzero(gap <= 2)
    part = max(1, LETTERS // max(1, other.raw.shape[1]))
    ok = [one_edit(held.raw[i[s:s + part]], other.raw[j[s:s + part]]) for s in range(0, len(i), part)]
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    return i[ok], j[ok]


def credit(to: Words, i: np.ndarray, by: Words, j: np.ndarray) -> pd.DataFrame:
    """(word, near, best_n, best): for each word of ``to`` in ``i`` its near words and the commonest of them."""
    order = np.lexsort((by.text[j].astype(str), -by.n[j], i))
    i, j = i[order], j[order]
    at, first, many = np.unique(i, return_index=True, return_counts=True)
    return pd.DataFrame({"word": to.text[at], "near": many, "best_n": by.n[j[first]], "best": by.text[j[first]]})


def near_counts(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a near word.

    A near word lies in the same cell of group counts or in one of a fixed number of cells
    beside it, of the same length or one letter more. Blocks of a cell are held in turn and
    multiplied with the words of these cells; a cell of many words has many blocks, each a
    task's unit of its own. Only sums and the best partner per word leave a task, no pairs."""
    counted = words.select("word", "n", F.array(*group_counts(F.col("word"))).alias("g"))
    name = lambda step: F.concat_ws(",", *[(F.col("g")[k] - step[k]).cast("string") for k in range(GROUPS)])
    counted = materialise(counted.withColumn("cell", name([0] * GROUPS)))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("word")) / LETTERS)).cast("int")
    large = checked_broadcast(counted.groupBy("cell").agg(blocks.alias("blocks")).where("blocks > 1"))
    held = (counted.join(large, "cell", "left").select(
        "cell", F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), F.lit(0).alias("role"), "word", "n"))
    to = F.explode(F.array(*[F.struct(name(change).alias("cell"), F.lit(role).alias("role")) for role, change in steps()]))
    passing = counted.select("word", "n", to.alias("to")).select("to.cell", "to.role", "word", "n").where(~F.col("cell").contains("-"))
    passing = passing.join(large, "cell", "left").select(
        "cell", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), "role", "word", "n")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, None
        for rows, role, piece in meetings(batches, ("cell", "block")):
            if rows is not last:
                last, mine = rows, Words(rows)
            part = max(1, min(PASS, LETTERS // max(1, mine.raw.shape[1])))
            for s in range(0, len(piece), part):
                other = Words(piece.iloc[s:s + part])
                i, j = near_pairs(mine, other)
                if len(i):
                    yield credit(mine, i, other, j)
                    if role > 1:  # within a cell each word is held once and passes once
                        yield credit(other, j, mine, i)

    met = (held.unionByName(passing).repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
           .mapInPandas(compare, "word string, near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))).alias("b")
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached by following ``form``, for words that have one.

    Counts rise at least ``RATIO`` times a step, so chains are short; each round doubles the
    reach and is written to the shared folder."""
    hop = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        far = hop.select(F.col("word").alias("_at"), F.col("root").alias("_far"))
        now = materialise(hop.join(far.hint("merge"), F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_far", "root").alias("root"), F.col("_at").isNotNull().alias("moved")))
        hop = now.select("word", "root")
        if now.where("moved").isEmpty():
            return hop


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text).

    Words are letter runs (A-Z, a-z, U+00C0 to U+00FF) of at least ``MIN_LENGTH`` code points
    and ``MIN_COUNT`` occurrences over all texts; a NULL text has none, a NULL id hashes as
    the empty text, repeated rows count again. ``form`` is the commonest near word (ties: the
    smaller in code-point order) if it occurs ``RATIO`` times as often, else NULL; ``root`` is
    the end of the chain of forms. An empty table gives no rows; other columns are ignored."""
    words = materialise(occurrences(docs.select("doc_id", "text")))
    near = near_counts(words).select(F.col("word").alias("_w"), "n_near", "best", "best_n")
    often = F.col("best_n") >= RATIO * F.col("n")
    forms = materialise(words.join(near.hint("merge"), F.col("word") == F.col("_w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best")).alias("form"),
        F.when(often, F.col("best_n")).alias("form_n")))
    end = roots(forms).withColumnRenamed("word", "_w")
    return forms.join(end.hint("merge"), F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
