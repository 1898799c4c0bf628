"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled in post-order, so a child's label is below its parent's. A sweep in label
order takes the digests that the children sent from a priority queue, and sends its own on;
a reversed sweep sends every node its proof suffix. Within a block of ``BAND`` levels the
queue is a heap of at most two messages a level; messages that leave a block go through
Spark's external sort, keyed by the block they are for, to the next sweep.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.sizing import checked_broadcast, materialise

FAN = 3            # children of a node
BAND = 7           # levels that a task sweeps at once: at most FAN ** BAND nodes of a tree are in a block
DIGEST = 64        # characters of a hexadecimal digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def height(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    h = 0
    while size > 1:
        size, h = -(-size // FAN), h + 1
    return h


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 over each field's byte count and value (integers decimal), ``-`` where NULL."""
    text = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
            for c in fields]
    return F.sha2(F.concat(*text).cast("binary"), 256)


class Sweep:
    """One block of a tree: consecutive nodes from index ``first`` of a level with ``size`` nodes."""

    def __init__(self, first: int, digests: list[bytes], size: int, band: int = BAND):
        self.first, self.size, self.top = first, size, min(band, height(size))
        self.done: list[tuple[int, int, list[tuple[int, bytes]]]] = []  # end, level, children (index, digest)
        self.root = (first, digests[0])
        queue: list[tuple[int, int, int, bytes]] = []
        for i, d in enumerate(digests, first):
            self._send(queue, i, 0, d)
            while queue and queue[0][0] <= i:
                end, level = queue[0][:2]
                children = []
                while queue and queue[0][:2] == (end, level):
                    children.append(heapq.heappop(queue)[2:])
                self.done.append((end, level, children))
                self._send(queue, children[0][0] // FAN, level, digest([c for _, c in children]))

    def _end(self, node: int, level: int) -> int:
        return min((node + 1) * FAN ** level, self.size) - 1

    def _send(self, queue: list, node: int, level: int, d: bytes) -> None:
        if level == self.top:
            self.root = (node, d)
        else:
            heapq.heappush(queue, (self._end(node // FAN, level + 1), level + 1, node, d))

    def proofs(self, turns: bytes, body: bytes) -> Iterator[tuple[int, bytes, bytes]]:
        """(index, turns, body) of every node of the block, last first, given those of the block's root.

        ``body``: digests of the siblings, level by level upwards; ``turns``: for each level
        the node's place among its run, times four, and the number of its siblings."""
        if self.top == 0:
            yield self.first, turns, body
            return
        queue = [(-self._end(self.root[0], self.top), -self.top, turns, body)]
        for end, level, children in reversed(self.done):
            got = heapq.heappop(queue)
            if got[:2] != (-end, -level):
                raise RuntimeError("a proof suffix reached the wrong node")
            for place, (node, _) in enumerate(children):
                t = bytes([4 * place + len(children) - 1]) + got[2]
                b = b"".join(d for k, (_, d) in enumerate(children) if k != place) + got[3]
                if level == 1:
                    yield node, t, b
                else:
                    heapq.heappush(queue, (-self._end(node, level - 1), 1 - level, t, b))


def fold(leaf: bytes, turns: bytes, body: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    at = 0
    for t in turns:
        place, many = t >> 2, t & 3
        run = body[at:at + DIGEST * many]
        leaf = digest([run[:DIGEST * place], leaf, run[DIGEST * place:]])
        at += DIGEST * many
    return leaf


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Add ``idx`` (from 0 within a tree, in ``order``) and ``size`` (rows of the tree).

    Rows are range-partitioned and written in order, then counted per tree and partition, so
    one large tree is spread over many tasks."""
    by = [F.asc_nulls_first(tree), *order]
    rows = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    cells = rows.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    tree_cells = W.partitionBy("_tree")
    before = tree_cells.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("_tree", "_p", F.sum("_n").over(tree_cells).alias("size"),
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_off"))
    return rows.join(checked_broadcast(cells), F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_p"))).withColumn(
        "idx", F.col("_at") + F.col("_off")).drop("_at", "_part", "_tree", "_p", "_off")


def swept(batches: Iterator[pd.DataFrame], band: int) -> Iterator[tuple[pd.DataFrame, dict | None, Sweep]]:
    """(rows, message, sweep) of each block from rows sorted by (tree, block, idx); the row with idx -1 is the message."""
    held: list[pd.DataFrame] = []
    now = None

    def close() -> tuple[pd.DataFrame, dict | None, Sweep]:
        rows = pd.concat(held, ignore_index=True)
        message = rows.iloc[0].to_dict() if rows["idx"].iat[0] < 0 else None
        rows = rows[rows["idx"] >= 0]
        return rows, message, Sweep(int(rows["idx"].iat[0]), [d.encode() for d in rows["digest"]], int(rows["size"].iat[0]), band)

    for b in batches:
        tree, block = b["tree"].to_numpy(object), b["block"].to_numpy()
        start = 0
        for i in range(len(b)):
            key = (tree[i], block[i])
            if key != now:
                if held or i > start:
                    if i > start:
                        held.append(b.iloc[start:i])
                    yield close()
                held, start, now = [], i, key
        if start < len(b):
            held.append(b.iloc[start:])
    if held:
        yield close()


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of a block in one partition, its message (idx -1) first, then its nodes in order."""
    return rows.repartition("tree", "block").sortWithinPartitions(F.asc_nulls_first("tree"), "block", "idx")


def block_of(band: int) -> Column:
    return F.expr(f"idx div {FAN ** band}").alias("block")


def lifted(nodes: DataFrame, band: int) -> DataFrame:
    """(tree, idx, size, digest) one band higher: every block becomes its root."""
    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for rows, _, s in swept(batches, band):
            out.append((rows["tree"].iat[0], rows["block"].iat[0], -(-s.size // FAN ** band), s.root[1].decode()))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["tree", "idx", "size", "digest"])
                out = []
        yield pd.DataFrame(out, columns=["tree", "idx", "size", "digest"])

    rows = nodes.select("tree", block_of(band), "idx", "size", "digest")
    return materialise(in_blocks(rows).mapInPandas(up, "tree string, idx long, size long, digest string"))


def bands(nodes: DataFrame, band: int) -> list[DataFrame]:
    """The nodes and all levels above them that sweeps end at; the last has one node a tree."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 1) > 1:
        out.append(lifted(out[-1], band))
    return out


def lowered(nodes: DataFrame, paths: DataFrame, band: int) -> DataFrame:
    """(tree, idx, turns, body) of the nodes of a band, from ``paths`` of the same columns one band higher."""
    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, m, s in swept(batches, band):
            got = list(s.proofs(m["turns"], m["body"]))
            yield pd.DataFrame({"tree": [rows["tree"].iat[0]] * len(got), "idx": [g[0] for g in got],
                                "turns": [g[1] for g in got], "body": [g[2] for g in got]})

    rows = nodes.select("tree", block_of(band), "idx", "size", "digest", F.lit(None).cast("binary").alias("turns"),
                        F.lit(None).cast("binary").alias("body"))
    return materialise(in_blocks(rows.unionByName(messages(paths), allowMissingColumns=True)).mapInPandas(
        down, "tree string, idx long, turns binary, body binary"))


def messages(paths: DataFrame) -> DataFrame:
    return paths.select("tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), *[c for c in paths.columns if c not in ("tree", "idx")])


def leaf_proofs(leaves: DataFrame, paths: DataFrame, band: int) -> DataFrame:
    """(leaf columns, subroot, proof, turns, folded_root) of every leaf; ``paths`` also carry the tree's subroot."""
    kind = dict(leaves.dtypes)["doc_id"]

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, m, s in swept(batches, band):
            got = sorted(s.proofs(m["turns"], m["body"]))
            seen = [x.encode() for x in rows["seen"]]
            yield pd.DataFrame({
                "id": rows["id"].array, "source": rows["tree"].array, "leaf": rows["digest"].array,
                "subroot": [m["subroot"]] * len(rows), "proof": [g[2].decode() for g in got], "turns": [g[1] for g in got],
                "folded_root": [fold(x, g[1], g[2]).decode() for x, g in zip(seen, got, strict=True)]})

    rows = leaves.select("tree", block_of(band), "idx", "size", "digest", F.col("doc_id").cast("string").alias("id"), "seen",
                         F.lit(None).cast("binary").alias("turns"), F.lit(None).cast("binary").alias("body"), F.lit(None).cast("string").alias("subroot"))
    return in_blocks(rows.unionByName(messages(paths), allowMissingColumns=True)).mapInPandas(
        down, "id string, source string, leaf string, subroot string, proof string, turns binary, folded_root string").withColumn(
        "doc_id", F.col("id").cast(kind))


def merkle_manifest(docs: DataFrame, seen_text: Column | None = None, band: int = BAND) -> DataFrame:
    """One row per row of ``docs`` (``FIELDS``): doc_id, source, leaf, subroot, root, proof, turns, folded_root, verified.

    Leaves of a source ascend by doc_id (NULL first, equal ids by leaf) and are hashed by runs
    of ``FAN`` up to the source's subroot; the subroots, ordered by source (NULL first), up to
    the root. ``proof`` holds the sibling digests, level by level to the root; ``folded_root``
    is what they give from the leaf of the row with ``seen_text`` in place of its text, and
    ``verified`` whether that is the root. Repeated rows are leaves of their own; NULL sources
    are a source; an empty table gives no rows. Other columns are ignored.
    ``band``: levels that a task sweeps at once."""
    fields = [F.col(c) for c in FIELDS]
    text = F.col("text") if seen_text is None else seen_text
    leaf = leaf_digest(fields)
    same = text.eqNullSafe(F.col("text"))
    seen = F.when(same, F.lit(None)).otherwise(leaf_digest([text if c == "text" else F.col(c) for c in FIELDS]))
    digests = materialise(docs.select("doc_id", F.col("source").cast("string").alias("tree"), leaf.alias("digest"), seen.alias("seen")))
    digests = digests.withColumn("seen", F.coalesce("seen", "digest"))
    leaves = materialise(numbered(digests, "tree", [F.asc_nulls_first("doc_id"), F.asc("digest")]))
    levels = bands(leaves.select("tree", "idx", "size", "digest"), band)
    subroots = levels[-1].select(F.col("tree").alias("source"), F.col("digest"), F.lit("").alias("tree"))
    tops = materialise(numbered(subroots, "tree", [F.asc_nulls_first("source")]))
    above = bands(tops.select("tree", "idx", "size", "digest"), band)
    top = above[-1].select("digest").first()
    root = F.lit(top[0] if top else None).cast("string")
    paths = above[-1].select("tree", "idx", F.lit(b"").alias("turns"), F.lit(b"").alias("body"))
    for level in reversed(above[:-1]):
        paths = lowered(level, paths, band)
    paths = (tops.select("source", F.col("idx").alias("_i"), F.col("digest").alias("subroot")).join(paths.drop("tree").hint("merge"), F.col("_i") == F.col("idx"))
             .select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("idx"), "turns", "body", "subroot"))
    start = paths = materialise(paths)
    for level in reversed(levels[1:-1]):
        paths = lowered(level, paths.drop("subroot"), band)
    if len(levels) > 1:
        named = start.select(F.col("tree").alias("_t"), F.col("subroot").alias("_s"))
        paths = paths.drop("subroot").join(named.hint("merge"), F.col("tree").eqNullSafe(F.col("_t"))).select(
            "tree", "idx", "turns", "body", F.col("_s").alias("subroot"))
    return leaf_proofs(leaves, paths, band).select(
        "doc_id", "source", "leaf", "subroot", root.alias("root"), "proof", "turns", "folded_root",
        (F.col("folded_root") == root).alias("verified"))
