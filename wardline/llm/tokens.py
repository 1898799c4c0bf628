"""Token-id output: texts to ids by a public tokenizer, coded chunks on shared storage, and back."""
from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import codec
from .common import bounded_batches, held_by_worker

END = 0            # id after every document
CHUNK = 1 << 22    # ids of a chunk: a chunk ends with the document that fills it
REST = CHUNK // 4  # fewer ids than these after it stand in the last chunk of a shard, for few blocks code slowly
CACHED = 300_000   # pieces whose ids a worker holds before it drops all but the most used
BANK = 1 << 23     # ids held before it does so
PIECES = 20_000    # new pieces encoded by one call
TEXTS = 500        # texts encoded together, and the characters after which no further one joins them
CHARS = 1 << 20
# White space of any kind but these four keeps a text from being cut into pieces.
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
PIECE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
BLANKS = (" ", "\t", "\r", "\n")
RUNS = ("\t", "\r", "  ", " \n", "\n ", "\n\n")


def keys(text: str) -> list[str]:
    """The pieces of a text without other white space: a run of blanks and what follows, up to the next run.

    The usual blank, one space, is left out of a key; a key that begins with a line break is the
    whole piece; a piece of any other form stands after a space (``piece`` takes keys back)."""
    if any(r in text for r in RUNS):
        return [" " + p for p in PIECE.findall(text)]
    found = text.replace("\n", " \n").split(" ")
    found[0] = " " + found[0]
    return found


def piece(key: str) -> str:
    return key[1:] if key[:1] == " " else key if key[:1] == "\n" else " " + key


class Numbers(dict):
    """Numbers of keys in order of first sight; keys not encoded yet are in ``new``, of these the whole texts at ``whole``."""

    def __init__(self, known: list[str] = ()):
        super().__init__(zip(known, range(1, len(known) + 1), strict=True))
        self.taken, self.new, self.whole = len(known) + 1, [], []  # number 0 is the end of a text

    def __missing__(self, key: str) -> int:
        number = self[key] = self.taken
        self.taken += 1
        self.new.append(key)
        return number

    def add(self, text: str) -> int:
        """The number of a whole text, which is not met again."""
        self.whole.append(len(self.new))
        self.new.append(" " + text)
        self.taken += 1
        return self.taken - 1


class Encoder:
    """Ids of whole texts by the tokenizers library, with the ids of repeated pieces held.

    The byte-level pre-tokenizer never joins a character and the white space after it, so a
    text can be cut before each run of blanks, and each distinct piece encoded once. New pieces
    are encoded as one text; the bytes that each id stands for tell whose it is."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task keeps to its own core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # a character of a byte-level token is a byte
        self._start()

    def _start(self) -> None:
        # ids of all pieces in one row; of the piece of each number, where they begin, how many they are, how often it was met
        self.numbers, self.bank, self.first, self.size = Numbers(), array("H", [END]), array("q", [0]), array("q", [1])
        self.uses = np.zeros(1, np.int64)

    def _thin(self) -> None:
        """Drop the pieces met once, and of more than half of ``CACHED`` the least met; all if the rest is long."""
        names, at = list(self.numbers), np.fromiter(self.numbers.values(), np.int64, len(self.numbers))
        uses, most = self.uses[at], CACHED // 2
        least = max(2, int(np.partition(uses, -most)[-most]) + 1) if len(uses) > most else 2
        stay = np.flatnonzero(uses >= least)
        at = np.concatenate([[0], at[stay]])
        first, size = np.frombuffer(self.first, np.int64)[at], np.frombuffer(self.size, np.int64)[at]
        if size.sum() > BANK // 2:
            self._start()
            return
        ends = np.cumsum(size)
        bank = np.frombuffer(self.bank, np.uint16)[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]
        self.numbers, self.uses = Numbers([names[i] for i in stay]), self.uses[at] // 2
        self.bank, self.first, self.size = array("H", bank.tobytes()), array("q", (ends - size).tobytes()), array("q", size.tobytes())

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in one row, and how many each has."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([*chain.from_iterable(coded)], np.uint16), np.array([*map(len, coded)], np.int64)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that each begin with a blank and end with none."""
        whole = "".join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.uint16)
        ends, reached = np.cumsum([*map(len, pieces if whole.isascii() else map(str.encode, pieces))]), np.cumsum(self.width[ids])
        cut = np.searchsorted(reached, ends)
        if cut[-1] != len(ids) - 1 or (reached[cut] != ends).any():
            return self._alone(pieces)  # an id that is not the bytes of its token
        return ids, np.diff(cut, prepend=-1)

    def _learn(self) -> None:
        new, whole = self.numbers.new, np.array(self.numbers.whole, int)
        self.numbers.new, self.numbers.whole = [], []
        for at in range(0, len(new), PIECES):
            part = [*map(piece, new[at:at + PIECES])]
            joins = np.array([p[:1] in BLANKS and p[-1:] not in BLANKS for p in part])
            joins[whole[(whole >= at) & (whole < at + PIECES)] - at] = False
            first, size = np.zeros((2, len(part)), np.int64)
            for some, how in ((joins, self._joined), (~joins, self._alone)):
                if some.any():
                    ids, size[some] = how([p for p, s in zip(part, some, strict=True) if s])
                    first[some] = len(self.bank) + np.cumsum(size[some]) - size[some]
                    self.bank.frombytes(ids.tobytes())
            self.first.frombytes(first.tobytes())
            self.size.frombytes(size.tobytes())

    def ids(self, texts) -> list[np.ndarray]:
        """uint16 ids of each text and the end id (NULL or empty: the end id alone)."""
        if len(self.numbers) > CACHED or len(self.bank) > BANK:
            self._thin()
        number, found, ends = self.numbers.__getitem__, [], []
        for t in texts:
            if t and OTHER_SPACE.search(t):
                found.append(self.numbers.add(t))
            elif t:
                found.extend(map(number, keys(t)))
            found.append(0)
            ends.append(len(found))
        self._learn()
        pieces = np.array(found, np.int64)
        uses = np.bincount(pieces, minlength=len(self.size))
        uses[:len(self.uses)] += self.uses
        self.uses = uses
        first, sizes = np.frombuffer(self.first, np.int64)[pieces], np.frombuffer(self.size, np.int64)[pieces]
        reached = np.cumsum(sizes)
        ids = np.frombuffer(self.bank, np.uint16).take(np.arange(reached[-1]) + np.repeat(first - (reached - sizes), sizes))
        return np.split(ids, reached[np.array(ends[:-1], int) - 1])


def portions(texts: list) -> Iterator[list]:
    """Texts in order, so many together that their ids fit well in memory; a very long text stands alone."""
    part, chars = [], 0
    for t in texts:
        if part and (len(part) == TEXTS or chars + len(t or "") > CHARS):
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t or "")
    if part:
        yield part


def encoder(definition: str) -> Encoder:
    """One encoder per worker process, so its held pieces serve all tasks of the worker, until another operator runs there."""
    return held_by_worker(f"encoder {zlib.crc32(definition.encode())}", lambda: Encoder(definition))


def token_chunks(docs: DataFrame, definition: str) -> DataFrame:
    """(shard, chunk, doc_ids, counts, n_ids, data): coded ids of all rows in ascending doc_id order.

    Rows are range-partitioned by id (NULL first; rows of one id by text hash) and sorted; a
    shard holds a range, its chunks whole documents in order. ``definition`` is the
    tokenizer's JSON, so executors need no file."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    kind = dict(docs.dtypes)["doc_id"]

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, number = encoder(shared.value).ids, 0
        ids: list[np.ndarray] = []
        names: list = []
        held = full = 0  # ids held, and the documents that fill a chunk

        def first(n: int) -> pd.DataFrame:
            counts = [len(x) for x in ids[:n]]
            return pd.DataFrame({"chunk": [number], "doc_ids": [names[:n]], "counts": [counts], "n_ids": [sum(counts)],
                                 "data": [codec.encode(np.concatenate(ids[:n]))]})

        for b in batches:
            coded = chain.from_iterable(map(encode, portions(b["text"].tolist())))
            for name, one in zip(b["doc_id"], coded, strict=True):
                ids.append(one)
                names.append(None if pd.isna(name) else int(name))
                held += len(ids[-1])
                if held >= CHUNK and not full:
                    full = len(ids)
                if held >= CHUNK + REST:
                    yield first(full)
                    ids, names, number = ids[full:], names[full:], number + 1
                    held = sum(map(len, ids))
                    full = len(ids) if held >= CHUNK else 0
        if ids:
            yield first(len(ids))

    h = F.xxhash64("text")
    ordered = (docs.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id"), h)
               .sortWithinPartitions(F.asc_nulls_first("doc_id"), h))
    return ordered.mapInPandas(
        chunks, f"chunk long, doc_ids array<{kind}>, counts array<long>, n_ids long, data binary").select(
        F.spark_partition_id().alias("shard"), "*")


def read_documents(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in stored chunks, from their decoded ids.

    ``start`` counts the ids of all documents before: sums over shards, over a shard's
    chunks, and inside a chunk. A damaged block raises."""
    kind = dict(chunks.dtypes)["doc_ids"][6:-1]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, chunk, names, counts, data in zip(b["shard"], b["chunk"], b["doc_ids"], b["counts"], b["data"], strict=True):
                ids = codec.decode(data).astype("<u4")
                ends = np.cumsum(counts)
                yield pd.DataFrame({
                    "shard": shard, "chunk": chunk, "doc_id": pd.array(list(names), "Int64"), "at": ends - counts, "n_tokens": counts,
                    "ids_crc32": [zlib.crc32(ids[lo:hi].tobytes()) for lo, hi in zip(ends - counts, ends, strict=True)]})

    read = chunks.select("shard", "chunk", "doc_ids", "counts", "data").mapInPandas(
        rows, f"shard int, chunk long, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    sizes = chunks.select("shard", "chunk", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = (sizes.withColumn("_in", inside).join(shards.select("shard", before.alias("_before")), "shard")
               .select("shard", "chunk", (F.col("_in") + F.col("_before")).alias("_off")))
    return read.join(offsets, ["shard", "chunk"]).select(
        "doc_id", (F.col("_off") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_tokens(docs: DataFrame, path: str, definition: str) -> None:
    """Write the chunks of ``docs`` under ``path`` through Spark's committer, so a lost task leaves nothing."""
    token_chunks(docs, definition).write.mode("errorifexists").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark.read.parquet(path))
