"""Near-duplicate vectors: inverted lists of product-quantised residuals, table-lookup distances, exact cosine."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import checked_broadcast, materialise
from .blocks import meetings
from .ngrams import components

COSINE = 0.93      # least cosine of a link
SAMPLE = 32_768    # vectors that the index is fitted on, about, chosen by hash; fewer of more than 128 dimensions
LISTS = 1024       # most coarse lists; there is one for about 4 * sqrt(n) vectors
PER_CODE = 8       # dimensions of a subspace
CODES = 256        # codewords of a subspace
ROUNDS = 8         # rounds of k-means
SIGMAS = 3.0       # how far a partner may lie across a list's border, in deviations of a random direction
BLOCK = 1024       # vectors of a held block of a list
PASS = 256         # vectors compared with it at once
PAIRS = 1 << 15    # pairs whose cosine is computed at once


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1 (by a power of two first, so that no square overflows)."""
    x = np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres, from evenly spaced rows of ``x``; a centre that loses all rows stays."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = np.concatenate([(p @ c.T - 0.5 * (c ** 2).sum(1)).argmax(1) for p in np.array_split(x, 1 + len(x) // 4096)])
        many = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, d, minlength=k) for d in x.T], axis=1)
        c[many > 0] = total[many > 0] / many[many > 0, None]
    return c


class Index:
    """Coarse centres and residual codewords, with the distance that a linked partner can have."""

    def __init__(self, x: np.ndarray, n: int, cosine: float = COSINE):
        self.dim, self.cosine = x.shape[1], cosine
        lists = min(LISTS, len(x), 1 << max(0, round(math.log2(math.sqrt(max(n, 1)) / 4))))
        self.centres = k_means(x, lists)
        apart = np.linalg.norm(self.centres[:, None] - self.centres[None], axis=2)
        self.apart = np.where(apart > 0, apart, np.inf)
        self.radius = math.sqrt(max(0.0, 2 - 2 * cosine))
        self.reach = self.radius * min(1.0, SIGMAS / math.sqrt(self.dim))
        self.spaces = np.array_split(np.arange(self.dim), max(1, self.dim // PER_CODE))
        rest = x - self.centres[self.score(x).argmax(1)]
        self.words = [k_means(rest[:, s], min(CODES, len(x))) for s in self.spaces]

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.centres.T - 0.5 * (self.centres ** 2).sum(1)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own list and all lists to search: those whose border is within ``reach``.

        The border between two centres is the plane half-way; a partner lies within ``radius``
        of a vector, and across a plane by more than ``SIGMAS`` deviations of a random
        direction only rarely (never, up to nine dimensions)."""
        s = self.score(x)
        own = s.argmax(1)
        past = (s[np.arange(len(x)), own][:, None] - s) / self.apart[own]
        past[np.arange(len(x)), own] = 0
        return own, [np.flatnonzero(p <= self.reach) for p in past]

    def coded(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes, and the distance of each vector from what its codes stand for."""
        rest = x - self.centres[own]
        codes = np.stack([(rest[:, s] @ w.T - 0.5 * (w ** 2).sum(1)).argmax(1) for s, w in zip(self.spaces, self.words, strict=True)], axis=1)
        left = sum(((rest[:, s] - w[c]) ** 2).sum(1) for s, w, c in zip(self.spaces, self.words, codes.T, strict=True))
        return codes.astype(np.uint8), np.sqrt(left)

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of vectors to coded vectors of a list: sums of table entries."""
        rest = x - self.centres[cell]
        out = np.zeros((len(x), len(codes)))
        for k, (s, w) in enumerate(zip(self.spaces, self.words, strict=True)):
            table = (rest[:, s] ** 2).sum(1)[:, None] + (w ** 2).sum(1) - 2 * (rest[:, s] @ w.T)
            out += np.take(table, codes[:, k], axis=1)
        return out


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, label, h1, h2) and classes (node, label, h1, h2, m, first_id, embedding) of equal usable vectors."""
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", e, F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", e)).alias("h1"),
                          F.xxhash64(F.lit(1), "label", e).alias("h2"))
    same = rows.where("h1 IS NOT NULL").groupBy("label", "h1", "h2").agg(
        F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("first_id"), F.first("embedding").alias("embedding"))
    return rows.drop("embedding"), materialise(same.withColumn("node", F.monotonically_increasing_id()))


def fit(classes: DataFrame, cosine: float = COSINE) -> Index | None:
    """Index fitted on about ``SAMPLE`` vectors, the lowest by hash; None without vectors.

    Shorter vectors are padded with zeros to the longest one's dimensions."""
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return None
    most = max(CODES, min(SAMPLE, (SAMPLE << 7) // dim))
    share = math.ceil(min(1.0, most / n) * (1 << 30))
    got = [r[0] for r in classes.where(F.pmod("h1", F.lit(1 << 30)) < share).orderBy("h1", "h2").select("embedding").collect()]
    if not got:
        got = [classes.orderBy("h1", "h2").first()["embedding"]]
    x = np.zeros((len(got), dim))
    for i, v in enumerate(got):
        x[i, :len(v)] = v
    return Index(unit(x), n, cosine)


def padded(vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in vectors])
    x = np.zeros((len(sizes), dim))
    x[np.arange(dim) < sizes[:, None]] = np.concatenate([np.asarray(v, float) for v in vectors])
    return x, sizes


def placed(classes: DataFrame, index) -> DataFrame:
    """(node, label, m, raw, size, cell, probes, code, far) of every class; ``index``: a broadcast ``Index``."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for b in batches:
            for s in range(0, len(b), 2048):
                p = b.iloc[s:s + 2048]
                x, sizes = padded(p["embedding"], ix.dim)
                own, probes = ix.probes(unit(x))
                codes, far = ix.coded(unit(x), own)
                yield pd.DataFrame({
                    "node": p["node"].array, "label": p["label"].array, "m": p["m"].array,
                    "raw": [np.asarray(v, float).tobytes() if wide else np.asarray(v, np.float32).tobytes() for v in p["embedding"]],
                    "size": sizes, "cell": own, "probes": probes, "code": [c.tobytes() for c in codes], "far": far})

    wide = dict(classes.dtypes)["embedding"] != "array<float>"
    kind = dict(classes.dtypes)["label"]
    return materialise(classes.select("node", "label", "m", "embedding").mapInPandas(
        place, f"node long, label {kind}, m long, raw binary, size int, cell int, probes array<int>, code binary, far double"))


class Block:
    """Vectors of one piece of rows, for exact cosines."""

    def __init__(self, rows: pd.DataFrame, ix: Index, wide: bool):
        raw = [np.frombuffer(r, np.float64 if wide else np.float32) for r in rows["raw"]]
        self.x, self.size = padded(raw, ix.dim)
        self.x = np.ldexp(self.x, -np.frexp(np.abs(self.x).max(1))[1][:, None])
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.unit = self.x / self.norm[:, None]
        self.node, self.m, self.own = (rows[c].to_numpy(np.int64) for c in ("node", "m", "own"))
        many = np.array([len(p) for p in rows["probes"]])
        self.probes = np.full((len(rows), max(many, default=0)), -1)
        self.probes[np.arange(self.probes.shape[1]) < many[:, None]] = np.concatenate(list(rows["probes"]))


def linked(ix: Index, held: Block, codes: np.ndarray, far: np.ndarray, cell: int, q: Block) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of ``q``, of ``held``) with the least cosine or more.

    The looked-up distance is off by no more than the held vector's own coding error, so every
    pair of the list that reaches the cosine is a candidate; the cosine itself decides."""
    i, j = np.nonzero(ix.distances(q.unit, cell, codes) <= ((ix.radius + far) ** 2 + 1e-9)[None, :])
    keep = (q.node[i] != held.node[j]) & (q.size[i] == held.size[j])
    i, j = i[keep], j[keep]
    ok = np.zeros(len(i), bool)
    for s in range(0, len(i), PAIRS):
        a, b = i[s:s + PAIRS], j[s:s + PAIRS]
        ok[s:s + PAIRS] = np.einsum("ij,ij->i", q.x[a], held.x[b]) / (q.norm[a] * held.norm[b]) >= ix.cosine
    return i[ok], j[ok]


def forest(held: Block, group: np.ndarray, q: Block, i: np.ndarray, j: np.ndarray, own: bool) -> list[tuple[int, int]]:
    """Edges that join the linked vectors; ``group`` names for each held one the held one it hangs on, and is kept up."""
    edges = []
    place = {n: k for k, n in enumerate(held.node)} if own else {}
    for x, start, many in zip(*np.unique(i, return_index=True, return_counts=True), strict=True):
        met = j[start:start + many]
        me = place.get(q.node[x])
        names = np.unique(group[met if me is None else np.append(met, me)])
        if me is None:
            edges.append((q.node[x], held.node[names[0]]))
        edges += [(held.node[names[0]], held.node[k]) for k in names[1:]]
        if len(names) > 1:
            group[np.isin(group, names)] = names[0]
    return edges


def link_rows(lists: DataFrame, index, wide: bool) -> DataFrame:
    """(node, links, other): links counted at a vector, and edges (node, other) that join all linked ones.

    A list is held in blocks of about ``BLOCK`` vectors, each a task's unit of its own; the
    vectors that probe the list pass every block. A link is counted for the vector that
    passes, and for the held one if that does not pass the other's list itself."""
    blocks = lists.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = checked_broadcast(blocks.select(F.col("label").alias("_label"), F.col("cell").alias("_cell"), "blocks"))
    own = lists.withColumn("own", F.col("cell"))
    at = (F.col("label") == F.col("_label")) & (F.col("cell") == F.col("_cell"))
    held = own.join(sizes, at).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("role", F.lit(0))
    visits = own.drop("code", "far", "cell").withColumn("cell", F.explode("probes"))
    visits = (visits.join(sizes, at).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("role", F.lit(1)).withColumn("code", F.lit(None).cast("binary")).withColumn("far", F.lit(None).cast("double")))
    columns = ["label", "cell", "block", "role", "node", "m", "own", "raw", "size", "probes", "code", "far"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, last = index.value, None
        for rows, _, piece in meetings(batches, ("label", "cell", "block")):
            if rows is not last:
                last, block, cell = rows, Block(rows, ix, wide), int(rows["cell"].iat[0])
                codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
                far, group = rows["far"].to_numpy(float), np.arange(len(rows))
            for s in range(0, len(piece), PASS):
                q = Block(piece.iloc[s:s + PASS], ix, wide)
                i, j = linked(ix, block, codes, far, cell, q)
                if not len(i):
                    continue
                mine = q.own == cell
                for part, inside in ((mine[i], True), (~mine[i], False)):
                    edges = forest(block, group, q, i[part], j[part], inside)
                    if edges:
                        yield pd.DataFrame(edges, columns=["node", "other"]).assign(links=0)
                passing = np.bincount(i, block.m[j], minlength=len(q.node)).astype(np.int64)
                back = ~mine[i] & ~(block.probes[j] == q.own[i][:, None]).any(1)
                staying = np.bincount(j[back], q.m[i[back]], minlength=len(block.node)).astype(np.int64)
                n = np.concatenate([q.node[passing > 0], block.node[staying > 0]])
                yield pd.DataFrame({"node": n, "other": pd.array([None] * len(n), "Int64"), "links": np.concatenate([passing[passing > 0], staying[staying > 0]])})

    met = held.select(*columns).unionByName(visits.select(*columns))
    return materialise(met.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "role")
                       .mapInPandas(compare, "node long, links long, other long"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label link when their cosine, in double precision, reaches ``cosine``.
    n_links counts the other rows linked directly, component_id is the smallest vec_id
    reachable, and kept marks the rows that have it. Equal vectors of a label are one class in
    all that follows, counted by its size, so copies are never paired. Vectors that are NULL,
    empty or zero, hold NULL or non-finite components, or have no label link with nothing;
    vectors of different lengths do not link with each other. Rows without an id count as
    links; where none of a component has an id, component_id and kept are NULL."""
    rows, classes = classes_of(vectors.select("vec_id", "embedding", "label"))
    index = fit(classes, cosine)
    none = F.lit(0).cast("long")
    if index is None:
        return rows.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    met = link_rows(placed(classes, shared), shared, dict(classes.dtypes)["embedding"] != "array<float>")
    links = met.where("other IS NULL").groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("links"))
    comp = components(met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("node", "label", "h1", "h2", "m", "first_id").join(links.hint("merge"), F.col("node") == F.col("_n"), "left").drop("_n")
    named = named.join(comp.select(F.col("node").alias("_n"), "component").hint("merge"), F.col("node") == F.col("_n"), "left").drop("_n")
    named = materialise(named.withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy(F.col("component").alias("_c")).agg(F.min("first_id").alias("component_id"))
    named = named.join(least.hint("merge"), F.col("component") == F.col("_c")).select(
        F.col("label").alias("_label"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"))
    out = rows.join(named.hint("merge"), (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    comp_id = F.when(F.col("_h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", none).cast("long").alias("n_links"), comp_id.alias("component_id"),
                      F.when(comp_id.isNotNull(), F.coalesce(F.col("vec_id") == comp_id, F.lit(False))).alias("kept"))
