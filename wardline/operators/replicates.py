"""Bootstrap replicates at the size of the rows (L5-L9): all replicates of a row at once.

A task turns a row's key into its weights in every replicate, an array that never leaves the
task. What leaves are sums: per (group, cell) for count metrics, and per stretch of sorted
scores for ranking metrics. Rows are shuffled once, ranged by (group, score); a stretch's
place among the others comes from a table of stretches x replicates, never rows x replicates.
Groups travel as one JSON text, so a NULL group is a group like any other.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import materialise
from .poisson import FMIX_STAGES, MIX_MASK, MIX_STEP, POISSON1_CDF, fmix31

CHUNK = 128        # rows whose weights are held at once
BLOCK = 32         # rows whose hashes are mixed, or whose runs are ranked, at once: their arrays stay in a core's cache
DENSE = 3          # draws looked for in every row; the few beyond are picked out
HELD = 1024        # (group, cell) sums that a task holds before it passes them on


class Weights:
    """Poisson(1) weights of rows in replicates 1..n_boot, as the SQL twins of the hash give them.

    The hash keeps 31 bits, so products may wrap at 32."""

    def __init__(self, seed: int, n_boot: int):
        self.start = np.uint32(fmix31(seed & MIX_MASK))
        self.steps = (np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(MIX_STEP) & np.uint64(MIX_MASK)).astype(np.uint32)
        self.bounds = [np.uint32(min(math.ceil(c * 2.0 ** 31), 2 ** 31)) for c in POISSON1_CDF]

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        shifted = np.empty_like(h)
        for op, v in FMIX_STAGES:
            if op == "xor":
                np.right_shift(h, np.uint32(v), out=shifted)
                h ^= shifted
            else:
                h *= np.uint32(v)
                h &= np.uint32(MIX_MASK)
        return h

    def key_hash(self, keys: np.ndarray) -> np.ndarray:
        low = (keys & MIX_MASK).astype(np.uint32)
        high = ((keys >> 31) & MIX_MASK).astype(np.uint32)
        return self._mixed(self._mixed(self.start ^ low) ^ high)

    def unit(self, keys: np.ndarray, replicate: np.ndarray) -> np.ndarray:
        """The hash in [0, 1) of each key in its own replicate."""
        step = (replicate.astype(np.uint64) * np.uint64(MIX_STEP) & np.uint64(MIX_MASK)).astype(np.uint32)
        return self._mixed((self.key_hash(keys) + step) & np.uint32(MIX_MASK)) / 2.0 ** 31

    def of(self, keys: np.ndarray) -> np.ndarray:
        hashes, out = self.key_hash(keys), np.empty((len(keys), len(self.steps)), np.uint8)
        rare = np.array(self.bounds[DENSE:])
        for s in range(0, len(keys), BLOCK):
            h, w = hashes[s:s + BLOCK, None] + self.steps, out[s:s + BLOCK]
            h &= np.uint32(MIX_MASK)
            self._mixed(h)
            w[:] = h >= self.bounds[0]
            for b in self.bounds[1:DENSE]:
                w += (h >= b).view(np.uint8)
            far = np.flatnonzero(h >= rare[0])
            w.reshape(-1)[far] += np.searchsorted(rare, h.reshape(-1)[far], side="right").astype(np.uint8)
        return out


def tasks(df: DataFrame) -> int:
    """Partitions of the replicate work, which is ``n_boot`` times what the bytes of the rows suggest:
    a number given outright is not merged into fewer by adaptive execution."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def group_key(by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("{}")


def with_groups(df: DataFrame, by: Sequence[str], like: DataFrame) -> DataFrame:
    """Group columns of ``like`` in place of the key ``_g``."""
    if not by:
        return df.drop("_g")
    schema = like.select(*by).schema
    return df.withColumn("_s", F.from_json("_g", schema)).select(*[F.col(f"_s.{c}").alias(c) for c in by], *[c for c in df.columns if c != "_g"])


def packed(*arrays: np.ndarray) -> bytes:
    return np.concatenate([np.asarray(a, float).ravel() for a in arrays]).tobytes()


def added(df: DataFrame) -> DataFrame:
    """(_g, data): rows of equal key added up, array by array, as they stream past."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for b in batches:
            for g, d in zip(b["_g"], b["data"], strict=True):
                x = np.frombuffer(d)
                if g != now:
                    if now is not None:
                        yield pd.DataFrame({"_g": [now], "data": [total.tobytes()]})
                    now, total = g, x.copy()
                else:
                    total += x
        if now is not None:
            yield pd.DataFrame({"_g": [now], "data": [total.tobytes()]})

    return df.repartition(tasks(df), "_g").sortWithinPartitions("_g").mapInPandas(add, "_g string, data binary")


def unpacked(df: DataFrame, n_boot: int, names: Sequence[str]) -> DataFrame:
    """One row per key and replicate with the named arrays of ``data`` as columns."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, d in zip(b["_g"], b["data"], strict=True):
                x = np.frombuffer(d).reshape(len(names), n_boot)
                yield pd.DataFrame({"_g": g, "replicate": np.arange(1, n_boot + 1, dtype=np.int32), **dict(zip(names, x, strict=True))})

    return df.mapInPandas(rows, "_g string, replicate int, " + ", ".join(f"{n} double" for n in names))


def replicate_sums(df: DataFrame, by: Sequence[str], key: str, n_boot: int, seed: int = 42,
                   values: dict[str, Column] | None = None) -> DataFrame:
    """(by..., replicate, w, values...): total weight, and weighted totals of ``values``, per cell and replicate.

    Rows are dealt out by key, since each stands for ``n_boot``; a task adds up its own and
    sends one array per cell. A row whose key is NULL takes key 0."""
    values = values or {}
    cols = [c.cast("double").alias(f"_v{i}") for i, c in enumerate(values.values())]
    rows = df.select(group_key(by).alias("_g"), F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("_key"), *cols)
    n_val = len(values)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, held = Weights(seed, n_boot), {}
        for b in batches:
            code, names = pd.factorize(b["_g"])
            order = np.argsort(code, kind="stable")
            keys, code = b["_key"].to_numpy(np.int64)[order], code[order]
            v = b[[f"_v{i}" for i in range(n_val)]].to_numpy(float)[order]
            for s in range(0, len(b), CHUNK):
                c = code[s:s + CHUNK]
                starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                w = weights.of(keys[s:s + CHUNK]).astype(float)
                sums = [np.add.reduceat(w, starts, axis=0)]
                sums += [np.add.reduceat(w * v[s:s + CHUNK, i:i + 1], starts, axis=0) for i in range(n_val)]
                for k, at in enumerate(starts):
                    total = held.setdefault(names[c[at]], np.zeros((1 + n_val, n_boot)))
                    for i, x in enumerate(sums):
                        total[i] += x[k]
            if len(held) > HELD:
                yield pd.DataFrame({"_g": list(held), "data": [x.tobytes() for x in held.values()]})
                held = {}
        if held:
            yield pd.DataFrame({"_g": list(held), "data": [x.tobytes() for x in held.values()]})

    sums = materialise(added(rows.repartition(tasks(df), "_key").mapInPandas(add, "_g string, data binary")))
    return with_groups(unpacked(sums, n_boot, ["w", *values]), by, df)


class Runs:
    """Weighted positives and negatives of each run of equal scores, from rows in descending order."""

    def __init__(self, weights: Weights):
        self.weights = weights

    def of(self, score: np.ndarray, label: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        all_, one = self.weights.of(keys), label == 1
        if (one | (label == 0)).all():  # each row stands on one side alone
            pos, neg = np.zeros((2, *all_.shape), np.float32)  # sums of a chunk stay exact
            pos[one], neg[~one] = all_[one], all_[~one]
        else:
            pos = all_ * label[:, None].astype(float)
            neg = all_ - pos
        if len(starts) < len(score):
            pos, neg = np.add.reduceat(pos, starts, axis=0), np.add.reduceat(neg, starts, axis=0)
        return score[starts], pos, neg


def segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, str], pd.DataFrame, bool]]:
    """((part, _g), rows, whether they begin it) in chunks of at most ``CHUNK`` rows of one part and group."""
    now = None
    for b in batches:
        part, g = b["part"].to_numpy(), b["_g"].to_numpy(object)
        new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (g[1:] != g[:-1]))) if len(b) else []
        for s, e in zip(new, [*new[1:], len(b)], strict=True):
            at = (int(part[s]), g[s])
            for c in range(s, e, CHUNK):
                yield at, b.iloc[c:min(c + CHUNK, e)], at != now
                now = at


def stretches(ranged: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(_g, part, s, role, data): every stretch of sorted rows as its first and last run (role 1) and all between (role 2).

    ``data``: weighted positives, negatives, and pairs ranked right within, of each replicate.
    Runs of the same score in neighbouring parts are put together later."""
    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs(Weights(seed, n_boot))
        at, first, middle, open_ = None, None, None, None

        def point(run) -> tuple:
            return (*at[::-1], run[0], 1, packed(run[1], run[2], 0.5 * run[1] * run[2]))

        def close() -> pd.DataFrame:
            out = [point(open_)] + ([point(first)] if first else [])
            if middle:
                out.append((*at[::-1], middle[0], 2, packed(*middle[1:])))
            return pd.DataFrame(out, columns=["_g", "part", "s", "role", "data"])

        def between(s: float, pos: np.ndarray, neg: np.ndarray) -> None:
            nonlocal middle
            if middle is None:
                middle = [s, *np.zeros((3, n_boot))]
            above, below = np.cumsum(pos, axis=0), neg.sum(0)
            total = above[-1].copy()
            above -= 0.5 * pos
            above *= neg
            middle[3] = middle[3] + middle[1] * below + above.sum(0)
            middle[1], middle[2] = middle[1] + total, middle[2] + below

        for key, rows, begins in segments(batches):
            if begins:
                if open_:
                    yield close()
                at, first, middle, open_ = key, None, None, None
            s, pos, neg = runs.of(rows["s"].to_numpy(float), rows["y"].to_numpy(np.int64), rows["_key"].to_numpy(np.int64))
            head = open_
            if open_ and open_[0] == s[0]:
                head = (s[0], open_[1] + pos[0], open_[2] + neg[0])
                s, pos, neg = s[1:], pos[1:], neg[1:]
            if not len(s):
                open_ = head
                continue
            open_ = (s[-1], pos[-1].astype(float), neg[-1].astype(float))
            s, pos, neg = s[:-1], pos[:-1], neg[:-1]
            if first is None and (head or len(s)):
                if head:
                    first, head = head, None
                else:
                    first = (s[0], pos[0].astype(float), neg[0].astype(float))
                    s, pos, neg = s[1:], pos[1:], neg[1:]
            if head:
                between(head[0], head[1][None], head[2][None])
            for c in range(0, len(s), BLOCK):
                between(s[c], pos[c:c + BLOCK], neg[c:c + BLOCK])
        if open_:
            yield close()

    return materialise(ranged.mapInPandas(cells, "_g string, part int, s double, role int, data binary"))


def ranked(cells: DataFrame, n_boot: int, classes: DataFrame | None) -> DataFrame:
    """The stretches of each group climbed from the highest score down.

    Rows (_g, part -1, data): AUROC, positives, and the average-precision sum over the first
    and last runs of the parts. Rows (_g, part, s, last, data): for the rows of a part between
    its first run at ``s`` and its last one, positives and negatives so far and the factors of
    the two classes, with which ``classes`` (_g, n_pos, n_neg) keeps class totals."""
    ends = cells.groupBy("_g", "part").agg(F.max("s").alias("s"), F.min(F.when(F.col("role") == 1, F.col("s"))).alias("last"))
    mark = F.lit(3).alias("role")
    marks = ends.select("_g", "part", "s", mark, "last").unionByName(
        ends.where("last < s").select("_g", F.lit(-1).alias("part"), F.col("last").alias("s"), mark, "last"))
    total = added(cells.select("_g", "data")).select("_g", F.lit(float("inf")).alias("s"), F.lit(0).alias("role"), "data")
    total = total.join(classes, "_g") if classes is not None else total.withColumns({"n_pos": F.lit(None).cast("double"), "n_neg": F.lit(None).cast("double")})
    rows = (cells.unionByName(total, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
            .repartition(tasks(cells), "_g").sortWithinPartitions("_g", F.desc("s"), "role")
            .select("_g", "part", "s", "role", "data", "last", "n_pos", "n_neg"))

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Climb | None = None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                name, part, s, role, data, last, n_pos, n_neg = r
                if role == 0:
                    if now:
                        out.append(now.result())
                    now = Climb(name, np.frombuffer(data).reshape(3, n_boot), n_pos, n_neg)
                elif role == 1:
                    now.point(s, *np.frombuffer(data).reshape(3, n_boot)[:2])
                elif role == 2:
                    now.between(*np.frombuffer(data).reshape(3, n_boot))
                else:
                    now.mark(s)
                    if part >= 0:
                        out.append((name, int(part), s, last, packed(now.factor[0] * now.pos, now.factor[1] * now.neg, *now.factor)))
            yield pd.DataFrame(out, columns=["_g", "part", "s", "last", "data"])
        if now:
            yield pd.DataFrame([now.result()], columns=["_g", "part", "s", "last", "data"])

    return materialise(rows.mapInPandas(climb, "_g string, part int, s double, last double, data binary"))


class Climb:
    """Positives and negatives above, and what they make of each run and stretch, for one group."""

    def __init__(self, name: str, total: np.ndarray, n_pos: float | None, n_neg: float | None):
        self.name, self.total = name, total[:2]
        ones = np.ones(total.shape[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.factor = (ones, ones) if n_pos is None or math.isnan(n_pos) else (n_pos / total[0], n_neg / total[1])
        self.pos, self.neg, self.right, self.ap = np.zeros((4, total.shape[1]))
        self.open = self.last = self.counted = None

    def point(self, s: float, pos: np.ndarray, neg: np.ndarray) -> None:
        if self.open and self.open[0] == s:
            self.open = (s, self.open[1] + pos, self.open[2] + neg)
        else:
            self.settle()
            self.open = (s, pos, neg)

    def settle(self) -> None:
        if self.open:
            s, pos, neg = self.last = self.open
            self.right = self.right + neg * (self.pos + 0.5 * pos)
            self.pos, self.neg, self.open = self.pos + pos, self.neg + neg, None

    def between(self, pos: np.ndarray, neg: np.ndarray, right: np.ndarray) -> None:
        self.settle()
        self.right = self.right + right + neg * self.pos
        self.pos, self.neg = self.pos + pos, self.neg + neg

    def mark(self, s: float) -> None:
        """The run at ``s`` ends or begins a part: its precision counts here, once."""
        self.settle()
        if self.counted != s:
            self.counted = s
            self.ap = self.ap + precision_sum(self.last[1][None] * self.factor[0], self.pos[None] * self.factor[0], self.neg[None] * self.factor[1])

    def result(self) -> tuple:
        self.settle()
        with np.errstate(divide="ignore", invalid="ignore"):
            auroc = self.right / (self.total[0] * self.total[1])
            return self.name, -1, None, None, packed(auroc, self.total[0] * self.factor[0], self.ap)


def precision_sum(pos: np.ndarray, tp: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Sum over runs of positives times the precision down to the run (nothing for runs without weight)."""
    some = pos.any(axis=1)  # most runs are of negatives alone
    pos, tp, fp = pos[some], tp[some], fp[some]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(pos > 0, pos * tp / (tp + fp), 0.0).sum(0)


def inner_precision(ranged: DataFrame, climbed: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(_g, data): the average-precision sum over the runs between the first and last of each part."""
    starts = climbed.where("part >= 0 AND last < s").withColumn("role", F.lit(0))
    rows = (ranged.withColumn("role", F.lit(1)).unionByName(starts, allowMissingColumns=True)
            .repartition(tasks(ranged), "part").sortWithinPartitions("part", "_g", "role", F.desc("s")).select("part", "_g", "role", "s", "y", "_key", "last", "data"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs(Weights(seed, n_boot))
        name, area, open_ = None, None, None

        def out() -> pd.DataFrame:
            total = area + precision_sum(open_[1][None], open_[1][None] + tp, open_[2][None] + fp) if open_ else area
            return pd.DataFrame({"_g": [name], "data": [packed(np.zeros((2, n_boot)), total)]})

        for (_, g), rows, begins in segments(batches):
            if begins:
                if area is not None:
                    yield out()
                name, area, open_ = g, None, None
                if rows["role"].iat[0] == 0:
                    area, first, last = np.zeros(n_boot), rows["s"].iat[0], rows["last"].iat[0]
                    tp, fp, a, c = np.frombuffer(rows["data"].iat[0]).reshape(4, n_boot)
                    rows = rows.iloc[1:]
            if area is None:
                continue
            rows = rows[(rows["s"] < first) & (rows["s"] > last)]
            if rows.empty:
                continue
            s, pos, neg = runs.of(rows["s"].to_numpy(float), rows["y"].to_numpy(np.int64), rows["_key"].to_numpy(np.int64))
            pos, neg = pos * a, neg * c
            if open_ and open_[0] == s[0]:
                pos[0] += open_[1]
                neg[0] += open_[2]
            elif open_:
                s, pos, neg = np.append(open_[0], s), np.vstack([open_[1], pos]), np.vstack([open_[2], neg])
            open_ = (s[-1], pos[-1], neg[-1])
            pos, neg = pos[:-1], neg[:-1]
            if len(pos):
                up, down = tp + np.cumsum(pos, axis=0), fp + np.cumsum(neg, axis=0)
                area = area + precision_sum(pos, up, down)
                tp, fp = up[-1], down[-1]
        if area is not None:
            yield out()

    return rows.mapInPandas(sweep, "_g string, data binary")


def replicate_ranking(df: DataFrame, by: Sequence[str], label: str, score: str, key: str, n_boot: int, seed: int = 42,
                      keep_classes: bool = False, ap: bool = True) -> DataFrame:
    """(by..., replicate, auroc, ap): tie-aware AUROC and step-wise AP of every replicate, NULL without both classes.

    Rows are ranged by (group, score, key), so neither a large group nor a score that many
    rows share is one task's. The first sweep leaves a few arrays for each part and group;
    those are climbed in order of score. Only AP needs a second sweep, which starts each part
    from what lies above it. ``keep_classes`` scales the weights so that each class keeps its
    total. Rows without label or score are left out."""
    s = F.col(score).cast("double")
    rows = df.select(group_key(by).alias("_g"), s.alias("s"), F.col(label).cast("int").alias("y"),
                     F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("_key")).where("s IS NOT NULL AND NOT isnan(s) AND y IS NOT NULL")
    order = (F.asc("_g"), F.desc("s"), F.asc("_key"))
    ranged = materialise(rows.repartitionByRange(tasks(df), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    classes = None
    if keep_classes:
        classes = ranged.groupBy("_g").agg(F.sum("y").cast("double").alias("n_pos"), F.sum(1 - F.col("y")).cast("double").alias("n_neg"))
    climbed = ranked(stretches(ranged, n_boot, seed), n_boot, classes)
    parts = climbed.where("part < 0").select("_g", "data")
    if ap:
        parts = added(parts.unionByName(inner_precision(ranged, climbed, n_boot, seed)))
    out = unpacked(materialise(parts), n_boot, ["auroc", "_pos", "_sum"])
    value = lambda x: F.when(~F.isnan(x) & ~F.isnan("auroc"), x)
    area = value(F.try_divide(F.col("_sum"), F.col("_pos"))) if ap else F.lit(None).cast("double")
    return with_groups(out.select("_g", "replicate", value(F.col("auroc")).alias("auroc"), area.alias("ap")), by, df)
