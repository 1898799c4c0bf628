"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.sizing import checked_broadcast, materialise
from .common import n_words, running_offset

WEIGHTS = (5, 2, 1)    # by source in code point order, repeating
SHARE = 1.5            # words taken in all, as a share of all words
MOST = 2               # times a document may be taken
BLOCK = 512            # words of a block; small sources are cut into at least MIN_BLOCKS
MIN_BLOCKS = 64
CHUNK = 4096           # schedule points generated by one row
CELL = 1024            # schedule points, or about as many documents, ranked in one window
SEED = 20


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with sid, weight and target, one row per source, NULL source last.

    Targets share ``share`` times all words by weight, none above ``most`` times its source,
    the excess shared again by weight: target = min(most * size, level * weight). The level
    is the largest quotient of what is left for the sources by what they weigh when the
    first sources in order of size / weight are full."""
    ranked = sizes.withColumn("sid", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    w = F.lit(float(weights[-1]))
    for i, x in enumerate(weights[:-1]):
        w = F.when(F.col("sid") % len(weights) == i, float(x)).otherwise(w)
    s = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    by_room = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(
        F.sum("cap").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weigh = F.sum("weight").over(by_room.rowsBetween(W.currentRow, W.unboundedFollowing))
    s = s.withColumn("level", left / weigh)
    return s.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight"))).drop("cap", "level")


def bit_reversed(k: Column, bits: int) -> Column:
    """The van der Corput permutation: the low ``bits`` bits of k in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("long")


def block_plan(targets: DataFrame) -> DataFrame:
    """Add block (words), n_blocks, k0, k1: the source's points are k0 .. k1 - 1 of the schedule.

    Cumulative targets in blocks are rounded, so a source has the points that fall into its
    interval of the cumulative weights, within one of its target. A block is taken ``MOST``
    times at the most."""
    p = targets.withColumn("block", F.greatest(F.lit(1), F.least(
        F.lit(BLOCK), F.expr(f"source_size div {MIN_BLOCKS}"))).cast("long"))
    p = p.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    upto = F.sum(F.col("target") / F.col("block")).over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    p = p.withColumn("_upto", F.floor(upto + 0.5).cast("long"))
    p = p.withColumn("k0", F.coalesce(F.lag("_upto").over(W.orderBy("sid")), F.lit(0)).cast("long"))
    return p.withColumn("k1", F.least(F.col("_upto"), F.col("k0") + MOST * F.col("n_blocks"))).drop("_upto")


def schedule(plan: DataFrame) -> DataFrame:
    """(sid, slot, rank, block_no, epoch): every point of every source, at its van der Corput slot.

    The slots of a source are ranked in slot order: windows hold the points of ``CELL`` slots,
    and a table of cell counts gives what came before. Rank r takes block r mod n_blocks."""
    top = plan.agg(F.max("k1")).first()[0] or 0
    bits = max(1, int(top - 1).bit_length()) if top else 1
    chunks = plan.where("k1 > k0").select("sid", "n_blocks", "k0", "k1", F.explode(
        F.sequence(F.expr(f"k0 div {CHUNK}"), F.expr(f"(k1 - 1) div {CHUNK}"))).alias("chunk")).repartition("sid", "chunk")
    points = chunks.select("sid", "n_blocks", F.explode(F.sequence(
        F.greatest("k0", F.col("chunk") * CHUNK), F.least(F.col("k1") - 1, F.col("chunk") * CHUNK + CHUNK - 1))).alias("k"))
    points = points.select("sid", "n_blocks", bit_reversed(F.col("k"), bits).alias("slot")).withColumn(
        "cell", F.expr(f"slot div {CELL}"))
    cells = running_offset(points.groupBy("sid", "cell").agg(F.count(F.lit(1)).alias("n")), "sid", "cell", "n", "off")
    inside = F.row_number().over(W.partitionBy("sid", "cell").orderBy("slot")) - 1
    ranked = (points.withColumn("_in", inside)
              .join(cells.select("sid", "cell", "off").hint("merge"), ["sid", "cell"])
              .withColumn("rank", F.col("off") + F.col("_in")))
    return ranked.select("sid", "slot", "rank", F.expr("rank % n_blocks").alias("block_no"),
                         F.expr("rank div n_blocks").alias("epoch"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h), written once: words per row, and the hash that shuffles a source's rows."""
    return materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                                   F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs`` (doc_id, text, source).

    The rows of a source, shuffled by hash, form one run of words that is cut into blocks of
    equal length (the last may be shorter); a row is taken as often as the schedule takes the
    blocks that cover it. NULL text has size 0 and is not taken; NULL source is one more
    source, the last; repeated rows count each. Sizes, and so memory, do not depend on
    how many rows one source holds."""
    d = sized_documents(docs)
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialise(block_plan(source_targets(sizes, weights, share)))
    small = checked_broadcast(plan.select(F.col("source").alias("_source"), "sid", "source_size", "target", "block"))
    taken_blocks = (schedule(plan).groupBy("sid", "block_no").agg(F.count(F.lit(1)).alias("times")))

    bits = max(0, (d.count() // CELL).bit_length())
    cell = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = (d.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
            .withColumn("cell", cell))
    cells = running_offset(rows.groupBy("sid", "cell").agg(F.sum("size").alias("n")), "sid", "cell", "n", "off")
    before = F.coalesce(F.sum("size").over(W.partitionBy("sid", "cell").orderBy("h", "doc_id", "size")
                                           .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = (rows.withColumn("_in", before).join(cells.select("sid", "cell", "off").hint("merge"), ["sid", "cell"])
              .withColumn("lo", F.col("off") + F.col("_in")).withColumn("hi", F.col("lo") + F.col("size")))
    numbers = F.when(F.col("size") > 0, F.sequence(F.expr("lo div block"), F.expr("(hi - 1) div block")))
    pieces = placed.withColumn("rid", F.monotonically_increasing_id()).select(
        "rid", "doc_id", "size", "source_size", "target", "sid", "lo", "hi", "block", F.explode_outer(numbers).alias("block_no"))
    words = (F.least("hi", (F.col("block_no") + 1) * F.col("block")) - F.greatest("lo", F.col("block_no") * F.col("block")))
    got = pieces.withColumn("words", words).join(taken_blocks.hint("merge"), ["sid", "block_no"], "left")
    return got.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken")).drop("rid")
