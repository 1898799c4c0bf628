"""N-gram Jaccard join: extended prefixes, token combinations for frequent tokens, exact checks."""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.sizing import materialise, release
from .common import bounded_batches, held_by_worker

WORDS = 5          # words of a shingle, and the similarity in percent, unless a caller says otherwise
PERCENT = 80
# Frequent tokens come late in the order and are indexed by pairs; results do not depend on which
# they are. All texts are counted, in cells that tokens share by their first bits: the tokens of a
# cell are frequent from FREQUENT * SAMPLE_EVERY texts, or from LOADED times the mean of all cells.
FREQUENT = 4
SAMPLE_EVERY = 16
CELL_BITS = 22     # cells, 16 MB of counts in a task, half a MB of bits for all
LOADED = 4
SEGMENT = 1 << 16  # cells that are summed up as one row
PER_CLASS = 20     # set size that one more token class serves
CACHED = 1 << 17   # word hashes held by a worker
TEXT_BYTES = 1 << 22  # text of the rows whose sets are held at once
STARS = 2          # rounds in which a bucket is compared with one pivot, the same or another in each bucket
SMALL = 128        # sets of a bucket whose pairs are all checked at once; larger ones are dealt anew by what a hub lacks
MARKS = 256        # fewest bits of a set's marks
LEVELS = 2         # times that large buckets are dealt anew
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * B
    return h ^ (h >> np.uint64(32))


def word_hashes(ws: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    out = [cache.get(w) for w in ws]
    for i, x in enumerate(out):
        if x is None:
            if len(cache) >= CACHED:
                cache.clear()
            out[i] = cache[ws[i]] = int.from_bytes(blake2b(ws[i], digest_size=8).digest())
    return np.array(out, np.uint64)


def shingles(text: str | None, n: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the n-word shingles (fewer words: the whole sequence; none: empty)."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.int64)
    a = word_hashes(ws, cache)
    k = min(n, len(a))
    h = np.full(len(a) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * A + a[i:len(a) - k + 1 + i])
    return np.unique((h >> np.uint64(1)).view(np.int64))


def in_pieces(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch in pieces of about ``TEXT_BYTES`` of text, so what is made of them stays bounded."""
    size = b["text"].str.len().fillna(0).cumsum() // TEXT_BYTES
    for _, piece in b.groupby(size.to_numpy(), sort=False):
        yield piece


def classes_for(n: int) -> int:
    """Token classes for pairs whose larger set has n tokens: a power of two near n / PER_CLASS."""
    return 1 << max(0, (n // PER_CLASS).bit_length() - 1)


def prefix_length(n: int, percent: int) -> int:
    """Sets of n tokens that reach the similarity share c + 1 tokens within prefixes of this length.

    Two sets with an overlap of at least ceil(percent * n / 100) each share k tokens within
    prefixes of n - ceil(...) + k tokens, in any one global order; here k = c + 1."""
    return min(n, n - (percent * n + 99) // 100 + classes_for(100 * n // percent) + 1)


def cells_of(s: np.ndarray) -> np.ndarray:
    return s >> (63 - CELL_BITS)


def packed(counts: np.ndarray) -> bytes:
    """Counts byte plane by byte plane, so that the upper ones, nearly all 0, take no room."""
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(np.int64)


def cell_counts(docs: DataFrame, n: int) -> DataFrame:
    """(part, total, counts): in how many texts each cell's tokens stand, of all texts; ``SEGMENT`` cells a row, written once.

    A task counts equal texts once; copies in different tasks count again."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, seen, held = held_by_worker("word hashes", dict), set(), np.zeros(1 << CELL_BITS, np.uint32)
        for b in (p for whole in batches for p in in_pieces(whole)):
            fresh = []
            for t in b["text"]:
                if t and (h := hash(t)) not in seen:
                    seen.add(h)
                    fresh.append(cells_of(shingles(t, n, cache)))
            if fresh:
                cell, times = np.unique(np.concatenate(fresh), return_counts=True)
                held[cell] += times.astype(np.uint32)
        for part, c in enumerate(held.reshape(-1, min(SEGMENT, held.size))):
            if c.any():
                yield pd.DataFrame({"part": [part], "counts": [packed(c)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        row = lambda: pd.DataFrame({"part": [at], "total": [int(held.sum())], "counts": [packed(held)]})
        for b in batches:
            for part, c in zip(b["part"], b["counts"], strict=True):
                if at is not None and part != at:
                    yield row()
                at, held = part, unpacked(c) if part != at else held + unpacked(c)
        if at is not None:
            yield row()

    parts = docs.select("text").mapInPandas(count, "part int, counts binary").repartition("part").sortWithinPartitions("part")
    return materialise(parts.mapInPandas(add, "part int, total long, counts binary"))


def frequent_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """A bit for every cell, set where its tokens are frequent; empty where there are no tokens."""
    counted = cell_counts(docs, n)
    total = counted.agg(F.sum("total")).first()[0]
    least = max(FREQUENT * SAMPLE_EVERY, LOADED * (total or 0) / (1 << CELL_BITS))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"part": b["part"], "bits": [np.packbits(unpacked(c) >= least).tobytes() for c in b["counts"]]})

    out = np.zeros((1 << CELL_BITS) // 8 if total else 0, np.uint8)
    for r in counted.select("part", "counts").mapInPandas(bits, "part int, bits binary").collect():
        found = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] * len(found):(r["part"] + 1) * len(found)] = found
    release(counted)
    return out


def in_order(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: by hash, with frequent tokens, negative here, after all others."""
    c = cells_of(s)
    late = (often[c >> 3] >> (7 - (c & 7)) & 1).astype(bool) if len(often) else np.zeros(len(s), bool)
    return np.concatenate([s[~late], ~s[late]])


def doc_sets(docs: DataFrame, n: int, percent: int, shared) -> DataFrame:
    """(doc_id, n_shingles, key, prefix, marks): set size, 128-bit hash of the set, first tokens in the global order, ``marks``.

    ``shared``: broadcast ``frequent_tokens``."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = held_by_worker("word hashes", dict)
        often = shared.value
        for b in (p for whole in batches for p in in_pieces(whole)):
            out = []
            for t in b["text"]:
                s = shingles(t, n, cache)
                p = in_order(s, often)[:prefix_length(len(s), percent)] if len(s) > 1 else s[:0]
                out.append((len(s), blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, p, marks(s) if len(s) > 1 else None))
            yield pd.DataFrame(out, columns=["n_shingles", "key", "prefix", "marks"]).assign(doc_id=b["doc_id"].array)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(rows, f"n_shingles long, key binary, prefix array<long>, marks binary, doc_id {kind}")


def combinations(frequent: DataFrame, percent: int) -> DataFrame:
    """(sig, node, n): pairs of frequent tokens of one class, from (node, n, tokens).

    With c classes and c + 1 shared tokens, some class holds two of them. c follows from
    the larger set of a pair, so a set is indexed for its own size and for the largest partner's."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sigs, nodes, sizes = [], [], []
            for node, n, tokens in zip(b["node"], b["n"], b["tokens"], strict=True):
                t = np.sort(np.asarray(tokens, np.int64))
                for c in sorted({classes_for(n), classes_for(100 * n // percent)}):
                    of = t & (c - 1)
                    for k in np.unique(of):
                        x = t[of == k].view(np.uint64)
                        i, j = np.triu_indices(len(x), 1)
                        s = _mix(_mix(x[i] * A + np.uint64(c)) * A + x[j]).view(np.int64)
                        sigs.append(s)
                        nodes.append(np.full(len(s), node))
                        sizes.append(np.full(len(s), n))
            if sigs:
                yield pd.DataFrame({"sig": np.concatenate(sigs), "node": np.concatenate(nodes), "n": np.concatenate(sizes)})

    return frequent.mapInPandas(rows, "sig long, node long, n long")


def buckets(reps: DataFrame, percent: int) -> DataFrame:
    """(sig, node, n): every set under its rare prefix tokens and its combinations of frequent ones.

    Sets that reach the similarity meet in a bucket: either a shared prefix token is rare, or
    all c + 1 of them are frequent. Buckets of one set are left out."""
    tokens = reps.select("node", "n", F.explode("prefix").alias("sig"))
    often = tokens.where("sig < 0").groupBy("node", "n").agg(F.collect_list("sig").alias("tokens"))
    return shared_by_several(tokens.where("sig >= 0").select("sig", "node", "n").unionByName(combinations(often, percent)))


def shared_by_several(rows: DataFrame) -> DataFrame:
    return materialise(rows.withColumn("_many", F.count(F.lit(1)).over(W.partitionBy("sig"))).where("_many > 1").drop("_many"))


def close_sizes(percent: int):
    return ((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))


def marks(s: np.ndarray) -> bytes:
    """A bit for every remainder of the tokens by at least ``len(s)`` (a power of two): how often it comes, mod 2."""
    m = max(MARKS, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount(s & (m - 1), minlength=m) & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Tokens that two sets cannot share, at least, by their ``marks``; longer marks are folded to the length of the shorter.

    A token of both sets flips the same bit in both, so every bit that differs stands for another token of one set alone."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    m = min(len(p), len(q))
    return int(np.bitwise_count(np.bitwise_xor.reduce(p.reshape(-1, m), 0) ^ np.bitwise_xor.reduce(q.reshape(-1, m), 0)).sum())


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose marks still allow the similarity.

    With d tokens in one set only, na + nb tokens in all overlap in (na + nb - d) / 2 and unite to
    (na + nb + d) / 2. Marks hold a bit or two a token, so a pair costs a small part of its sets."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("marks").alias(f"m{x}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            apart = np.array([differing(p, q) for p, q in zip(x["ma"], x["mb"], strict=True)], np.int64)
            yield x.loc[(x["na"] + x["nb"]) * (100 - percent) >= apart * (100 + percent), ["a", "b"]]

    return both.mapInPandas(rows, "a long, b long")


def full_sets(nodes: DataFrame, docs: DataFrame, n: int, shared=None) -> DataFrame:
    """(node, tokens): whole sets of the nodes ``_n``, made again from the texts; with ``shared`` in the global order."""
    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = held_by_worker("word hashes", dict)
        order = (lambda s: in_order(s, shared.value)) if shared else (lambda s: s)
        for x in (p for whole in batches for p in in_pieces(whole)):
            yield pd.DataFrame({"node": x["doc_id"], "tokens": [order(shingles(t, n, cache)) for t in x["text"]]})

    return materialise(docs.select("doc_id", "text").join(nodes.distinct(), F.col("doc_id") == F.col("_n"), "left_semi")
                       .mapInPandas(full, "node long, tokens array<long>"))


def ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``_n``: every node that stands in one of the columns, once."""
    return pairs.select(F.col(a).alias("_n")).distinct().unionByName(pairs.select(F.col(b).alias("_n")).distinct()).distinct()


def linked_pairs(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: exact overlap of the two sets, made again from the texts. Written once."""
    sets = full_sets(ends(pairs, "a", "b"), docs, n)
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b"))
    same = F.size(F.array_intersect("ta", "tb"))
    out = materialise(both.where(same * 100 >= (F.size("ta") + F.size("tb") - same) * percent).select("a", "b").distinct())
    release(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over links (a, b), for nodes with a link.

    Rounds of minimum over neighbours followed by one jump, each written to the shared
    folder, until nothing changes."""
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    table = label = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = (edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        now = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        jump = now.select(F.col("node").alias("via"), F.col("via").alias("far"))
        now = materialise(now.join(jump, "via", "left").select("node", "was", F.least("via", F.coalesce("far", "via")).alias("component")))
        release(table)
        table, label = now, now.select("node", "component")
        if now.where("component <> was").isEmpty():
            release(edges)
            return label


def with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return (rows.join(comp.select(F.col("node").alias("_n"), "component"), F.col("node") == F.col("_n"), "left").drop("_n")
            .withColumn("component", F.coalesce("component", "node")))


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (node, component) after further links (a, b): components of its components, then one lookup.

    A component is named by its smallest node, so names of merged ones are again the smallest."""
    one = with_component(links.select(F.col("a").alias("node"), "b"), comp).select(F.col("b").alias("node"), F.col("component").alias("a"))
    both = with_component(one, comp).select("a", F.col("component").alias("b")).where("a <> b")
    over = components(both)
    fresh = over.join(comp.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    to = over.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return materialise(comp.unionByName(fresh).join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component")))


def dealt_anew(rows: DataFrame, links: DataFrame, comp: DataFrame, docs: DataFrame, n: int, percent: int, shared, inside: bool):
    """(near, cover) in place of the large buckets ``rows`` (sig, node, n, component).

    A bucket takes as its hub the set with most links of its commonest component, or with
    ``inside`` of that component's sets in the bucket, so that its own token goes. Let x and y share w(x) and w(y) tokens with the hub. A pair that needs an overlap of more than the
    smaller of the two also shares a token that the hub lacks: ``cover`` (sig, node, n) holds
    the sets under such tokens, by a prefix of them that is never longer than the usual one.
    ``near`` (sig, node, n, component, reach) keeps a set in its bucket only while some set
    there is small enough (n <= reach) for the other kind of pair. Every pair of a bucket
    that can link is thus in one of them."""
    degree = with_component(links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d")), comp)
    hubs = degree.groupBy(F.col("component").alias("_c")).agg(F.max_by("node", F.struct("d", -F.col("node"))).alias("hub"))
    d = F.coalesce("d", F.lit(0))
    common = (rows.join(degree.select(F.col("node").alias("_n"), "d"), F.col("node") == F.col("_n"), "left")
              .groupBy(F.col("sig").alias("_s"), "component")
              .agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("low"), F.max_by("node", F.struct(d, -F.col("node"))).alias("own"))
              .groupBy("_s").agg(F.max_by(F.struct("component", "own"), F.struct("m", -F.col("component"))).alias("c"), F.min("low").alias("low")))
    common = (common.select("_s", "low", F.col("c.own").alias("hub")) if inside else
              common.join(hubs, F.col("c.component") == F.col("_c"), "left").select("_s", "low", F.coalesce("hub", "c.own").alias("hub")))
    at = materialise(rows.join(common.hint("merge"), F.col("sig") == F.col("_s")).drop("_s"))
    sets = full_sets(ends(at, "node", "hub"), docs, n, shared)
    beside = (at.select("node", "n", "hub").distinct().join(sets.hint("merge"), "node")
              .join(sets.select(F.col("node").alias("hub"), F.col("tokens").alias("th")).hint("merge"), "hub")
              .withColumn("w", F.size(F.array_intersect("tokens", "th"))))
    least = F.expr(f"(n * {percent} + 99) div 100")  # overlap with the smallest partner
    length = (F.col("n") - F.col("w") - F.greatest(least - F.col("w"), F.lit(1)) + 1).cast("int")
    beside = materialise(beside.select("hub", "node", "n", "w", F.slice(F.array_except("tokens", "th"), F.lit(1), F.greatest(length, F.lit(0))).alias("rest")))
    cover = beside.select("hub", "node", "n", F.explode("rest").alias("token")).select(F.xxhash64("hub", "token").alias("sig"), "node", "n")
    reach = F.expr(f"w * {100 + percent} div {percent}") - F.col("n")
    near = (at.join(beside.select("hub", "node", reach.alias("reach")), ["hub", "node"])
            .where(F.col("reach") >= F.greatest("low", least)).select("sig", "node", "n", "component", "reach"))
    near, cover = materialise(near), shared_by_several(cover)
    release(at, sets, beside)
    return near, cover


def all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a bucket in different components, of sizes that can link, within each other's reach."""
    side = lambda x: rows.select("sig", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), F.col("reach").alias(f"r{x}"))
    return (side("a").join(side("b").hint("merge"), "sig").where("a < b AND ca <> cb AND na <= rb AND nb <= ra").where(close_sizes(percent))
            .select("a", "b").distinct())


def open_buckets(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with their number ``m``."""
    some = rows.groupBy(F.col("sig").alias("_s")).agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("_s", "m")
    return rows.join(some.hint("merge"), F.col("sig") == F.col("_s")).drop("_s")


def link_components(reps: DataFrame, docs: DataFrame, n: int, percent: int, shared) -> DataFrame:
    """(node, component) of the representatives (node, n, prefix, marks) that link with another.

    A bucket is first compared with single pivots, and the sets that link fall into one
    component. Where sets of several components are left, the pairs of small buckets are
    checked, and large ones are dealt anew by the tokens that their hub lacks; what is still
    open after ``LEVELS`` of these is checked pair by pair. So no link that joins components
    is lost, and a group of similar sets costs a few comparisons for each set."""
    none = docs.sparkSession.range(0)
    links = done = none.select(F.col("id").alias("a"), F.col("id").alias("b"))
    comp = none.select(F.col("id").alias("node"), F.col("id").alias("component"))

    def check(pairs: DataFrame) -> None:
        nonlocal comp, links, done
        pairs = materialise(pairs.join(done, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return
        open_ = materialise(possible(pairs, reps, percent))
        got = linked_pairs(open_, docs, n, percent)
        release(open_)
        done, links = done.unionByName(pairs), links.unionByName(got)
        if not got.isEmpty():
            old, comp = comp, merged(comp, got)
            release(old)

    b, free = buckets(reps, percent), F.lit(1 << 62).alias("reach")
    for level in range(LEVELS + 1):
        for r in range(STARS):
            first = level == 0 and r == 0
            rows = b.withColumn("component", F.col("node")) if first else materialise(open_buckets(with_component(b, comp)))
            if rows.isEmpty():
                return comp
            pivot = rows.groupBy(F.col("sig").alias("_s")).agg(F.min_by(
                F.struct("node", "n", "component"), F.struct(F.xxhash64("node", "sig") if r else F.col("node"), "node")).alias("p"))
            pairs = rows.join(pivot.hint("merge"), F.col("sig") == F.col("_s")).where("component <> p.component").select(
                F.col("node").alias("x"), F.col("n").alias("na"), F.col("p.node").alias("y"), F.col("p.n").alias("nb")).where(close_sizes(percent))
            check(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
            release(rows)
        rows = materialise(open_buckets(with_component(b, comp)))
        large = rows.where((F.col("m") > SMALL) & F.lit(level < LEVELS))
        check(all_pairs(rows.where((F.col("m") <= SMALL) | F.lit(level == LEVELS)).select("*", free), percent))
        if large.isEmpty():
            return comp
        old = b
        near, b = dealt_anew(large.drop("m"), links, comp, docs, n, percent, shared, level > 0)
        release(rows, old)
        check(all_pairs(open_buckets(near), percent))
        release(near)
    return comp


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text).

    Texts link when the Jaccard similarity of their sets of distinct n-word shingles
    reaches ``percent``; component_id is the smallest id reachable, the own one included.
    Texts without words have no shingles and link with nothing. Equal sets are joined by
    hash first and stand as one row in all that follows, so copies are never paired. A
    repeated row joins its like; an id that comes with several texts stands for all of
    them; rows whose like all have NULL ids keep NULL."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, n))
    sets = materialise(doc_sets(docs, n, percent, shared))
    kind = dict(docs.dtypes)["doc_id"]
    classes = materialise(sets.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("key").alias("_key"))
                          .agg(F.min("doc_id").cast("long").alias("node")))
    reps = materialise(sets.join(classes, (F.col("key") == F.col("_key")) & (F.col("doc_id") == F.col("node")), "inner")
                       .where("n_shingles > 1").select("node", F.col("n_shingles").alias("n"), "prefix", "marks"))
    comp = link_components(reps, docs, n, percent, shared)
    classes = with_component(classes, comp).select("_key", "component")
    return sets.select("doc_id", "n_shingles", "key").join(classes.hint("merge"), F.col("key") == F.col("_key"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").cast(kind).alias("component_id"))
