"""Language-model scores: Brown class bigrams with distributed exchange clustering."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import materialise
from .common import id_crc

CLUSTERED = 20_000  # words that the exchange moves: the broadcast bound of the model
CLASSES = 64
ROUNDS = 4
FORMS = 8          # classes of all other words, by length and final mark
SMOOTH = 0.1       # added to class transitions
MARKS = b".,;:!?"
FLUSH = 1 << 22    # bigrams counted together in a task


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased words of a whole text (white space is \\x20 and \\x09-\\x0D)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def form(word: bytes) -> int:
    """Class of a word outside the clustered ones: by bytes (to 5, 8, 12, more) and a final mark."""
    n = len(word)
    return (0 if n <= 5 else 1 if n <= 8 else 2 if n <= 12 else 3) + 4 * (word[-1] in MARKS)


def form_column():
    """``form`` of the column ``word``."""
    n = F.octet_length("word")
    mark = F.instr(F.lit(MARKS.decode()), F.substring("word", -1, 1)) > 0
    return (F.when(n <= 5, 0).when(n <= 8, 1).when(n <= 12, 2).otherwise(3) + F.when(mark, 4).otherwise(0)).cast("int")


def vocabulary(train: DataFrame) -> DataFrame:
    """(word, c) over all training texts; the end of a text is the empty word."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for t in b["text"]:
                c.update(tokens(t))
            c[b""] += len(b)
            yield pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in c], "c": list(c.values())})

    return (train.select("text").mapInPandas(count, "word string, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


def bigrams(train: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(i, j, n): neighbouring ids over all training texts, each between two ends."""
    shared = train.sparkSession.sparkContext.broadcast(ids)
    n_ids = len(ids) + FORMS + 1

    def merge(keys: list, counts: list) -> pd.DataFrame:
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts))
        return pd.DataFrame({"i": k // n_ids, "j": k % n_ids, "n": n.astype(np.int64)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, keys, counts, held = shared.value, [], [], 0
        for b in batches:
            seq: list[int] = []
            for t in b["text"]:
                seq.append(n_ids - 1)
                seq += numbered(tokens(t), known)
            s = np.array([*seq, n_ids - 1], np.int64)
            k, n = np.unique(s[:-1] * n_ids + s[1:], return_counts=True)
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > FLUSH:
                yield merge(keys, counts)
                keys, counts, held = [], [], 0
        if keys:
            yield merge(keys, counts)

    return (train.select("text").mapInPandas(count, "i int, j int, n long")
            .groupBy("i", "j").agg(F.sum("n").alias("n")))


def numbered(ws: list[bytes], ids: dict[bytes, int]) -> list[int]:
    """Ids of the clustered words; all others take the id of their form."""
    k, get = len(ids), ids.get
    return [i if i is not None else k + form(w) for w, i in zip(ws, map(get, ws), strict=True)]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(own: int, left: np.ndarray, right: np.ndarray, both: float, table: np.ndarray, n_free: int) -> int:
    """The class that a word joins for the largest likelihood, all other words staying.

    ``left`` and ``right`` count its neighbours by class and ``both`` its own pairs. The word
    is taken out of its class and tried in each; terms without its counts cancel."""
    t = table.copy()
    t[:, own] -= left
    t[own, :] -= right
    t[own, own] += both
    rows, outs = t.sum(1), t.sum(0)
    ci, cj = np.flatnonzero(left), np.flatnonzero(right)
    gain = (_xlogx(t[ci, :n_free] + left[ci, None]) - _xlogx(t[ci, :n_free])).sum(0)
    gain += (_xlogx(t[:n_free, cj] + right[cj]) - _xlogx(t[:n_free, cj])).sum(1)
    gain -= _xlogx(rows[:n_free] + right.sum()) - _xlogx(rows[:n_free])
    gain -= _xlogx(outs[:n_free] + left.sum()) - _xlogx(outs[:n_free])
    new = int(gain.argmax())
    return new if gain[new] > gain[own] + 1e-9 else own


def exchange(pairs: DataFrame, n_words: int, n_free: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every id: words by exchange from their frequency rank, forms and the end fixed.

    A round sums each word's neighbours by class over all bigrams, and half the words move
    at once, each by its own best gain, as tasks see them. Assignment and class table
    are bounded by ``CLUSTERED`` and ``CLASSES``."""
    spark = pairs.sparkSession
    n_all = n_free + FORMS + 1
    cls = np.concatenate([np.arange(n_words) % n_free, np.arange(n_free, n_all)]).astype(np.int64)
    for r in range(rounds + 1):
        m = F.broadcast(spark.createDataFrame(pd.DataFrame({"id": np.arange(len(cls)), "k": cls}), "id int, k int"))
        both = (pairs.join(m.select(F.col("id").alias("i"), F.col("k").alias("ki")), "i")
                .join(m.select(F.col("id").alias("j"), F.col("k").alias("kj")), "j"))
        table = np.zeros((n_all, n_all))
        for x in both.groupBy("ki", "kj").agg(F.sum("n").alias("n")).collect():
            table[x["ki"], x["kj"]] = x["n"]
        if r == rounds or not n_words:
            return cls, table
        moving = (F.xxhash64("id") % 2 == 0) if r % 2 else (F.xxhash64("id") % 2 != 0)
        sides = (both.select(F.col("j").alias("id"), F.lit(0).alias("side"), F.col("ki").alias("k"), "n")
                 .unionByName(both.select(F.col("i").alias("id"), F.lit(1).alias("side"), F.col("kj").alias("k"), "n"))
                 .unionByName(both.where("i = j").select(F.col("i").alias("id"), F.lit(2).alias("side"), F.lit(0).alias("k"), "n"))
                 .where(F.col("id") < n_words).where(moving).groupBy("id", "side", "k").agg(F.sum("n").alias("n"))
                 .groupBy("id").agg(F.collect_list(F.struct("side", "k", "n")).alias("around")))
        shared = spark.sparkContext.broadcast((cls, table))

        def move(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, t = shared.value
            for b in batches:
                out = []
                for i, around in zip(b["id"], b["around"], strict=True):
                    side = np.zeros((3, n_all))
                    for a in around:
                        side[a["side"], a["k"]] = a["n"]
                    out.append((i, best_class(int(own[i]), side[0], side[1], side[2, 0], t, n_free)))
                yield pd.DataFrame(out, columns=["id", "k"])

        for x in sides.mapInPandas(move, "id int, k int").collect():
            cls[x["id"]] = x["k"]
    return cls, table


def fit(docs: DataFrame, n_words: int = CLUSTERED, n_free: int = CLASSES, rounds: int = ROUNDS) -> dict:
    """Counts, classes and probabilities learned from the rows whose crc32 mod 7 is not 2.

    ``vocab`` (word, c) stays a table; what the tasks hold is bounded by ``n_words``."""
    train = docs.where(id_crc(F.col("doc_id")) % 7 != 2)
    vocab = materialise(vocabulary(train))
    totals = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = vocab.where("word <> ''").orderBy(F.desc("c"), "word").limit(n_words).collect()
    ends = vocab.where("word = ''").agg(F.sum("c")).first()[0] or 0
    ids = {r["word"].encode(): i for i, r in enumerate(top)}
    cls, table = exchange(materialise(bigrams(train, ids)), len(ids), n_free, rounds)
    rest = vocab.where("word <> ''")
    if top:
        last = top[-1]
        rest = rest.where((F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("word") > last["word"])))
    forms = np.zeros((FORMS, 2))
    for r in rest.groupBy(form_column().alias("f")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        forms[r["f"]] = r["n"], r["v"]
    counts = np.array([r["c"] for r in top], float)
    of_class = np.bincount(cls[:len(top)], counts, minlength=n_free) if top else np.zeros(n_free)
    trans = np.log10(table + SMOOTH) - np.log10(table.sum(1, keepdims=True) + SMOOTH * len(table))
    emit = np.concatenate([np.log10(counts / of_class[cls[:len(top)]]) if top else [], np.zeros(FORMS + 1)])
    return {"vocab": rest, "n": totals["n"], "v": totals["v"], "ids": ids, "cls": cls, "trans": trans, "emit": emit,
            "c1": np.concatenate([np.log10(counts + 1), np.zeros(FORMS), [np.log10(ends + 1)]]), "ends": ends,
            "forms": forms.sum(1) + 1}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row.

    Transitions, and emissions of clustered words, are summed in the tasks; every other
    word is joined by shuffle with its count, so no vocabulary but the bounded one is
    broadcast. NULL texts count as empty (one end); rows are kept apart, repeats too."""
    spark = docs.sparkSession
    light = {k: v for k, v in model.items() if k != "vocab"}
    shared = spark.sparkContext.broadcast(light)

    @F.pandas_udf("n_tokens long, n_known long, base double, score double, rest array<string>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k, end = len(m["ids"]), len(m["ids"]) + FORMS
        floor = np.log10(m["n"] + m["v"] + 1)
        for s in batches:
            out = []
            for t in s:
                ws = tokens(t)
                idx = np.array([end, *numbered(ws, m["ids"]), end])
                at, now = m["cls"][idx], idx[1:]
                known = now < k
                rest = [ws[i].decode("utf-8", "replace") for i in np.flatnonzero(~known[:-1])]
                out.append((len(now), int(known.sum()) + (m["ends"] > 0), m["c1"][now].sum() - floor * len(now),
                            m["trans"][at[:-1], at[1:]].sum() + m["emit"][now].sum(), rest))
            yield pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "score", "rest"])

    held = id_crc(F.col("doc_id")) % 7 == 2
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held.alias("held_out"),
                                   parts(F.col("text")).alias("p")).select("rid", "doc_id", "held_out", "p.*"))
    rare = rows.select("rid", F.explode("rest").alias("word"))
    vocab = model["vocab"].select(F.col("word").alias("_word"), "c")
    whole = F.element_at(F.array(*[F.lit(float(np.log10(x))) for x in model["forms"]]), form_column() + 1)
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(vocab.hint("merge"), F.col("word") == F.col("_word"), "left").select(
        "rid", (c > 0).cast("long").alias("n_known"), F.log10(c + 1).alias("base"), (F.log10(c + 1) - whole).alias("score"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("doc_id", dict(rows.dtypes)["doc_id"]), ("held_out", "boolean"), ("n_tokens", "long"))]
    both = rows.drop("rest").unionByName(rare.select("rid", *none, "n_known", "base", "score"))
    out = both.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model["n"])).cast("long").alias("train_tokens"),
                      "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
