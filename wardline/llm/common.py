"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The word pattern of the contracts, in Java and Python regex syntax.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# What the operator that ran last in this worker process holds for its next task.
_HELD: dict[str, object] = {}

BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 22


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or with underscores behind it, so that no column of ``df`` has the name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def words_of(text: Column) -> Column:
    """The words of a text, in order (NULL text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of a text (NULL text: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once: a lambda variable over a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text (NULL id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def running_offset(cells: DataFrame, key: str, order: str, value: str, out: str, fan: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the cells of the same ``key`` before this one in ``order``.

    ``cells`` has one row per (key, order) and ``order`` is a non-negative integer. The
    sum is taken in two levels, so one window holds at most ``fan`` cells, or one row per
    ``fan`` cells of a key."""
    c = cells.withColumn("_super", F.expr(f"`{order}` div {fan}"))
    tops = c.groupBy(key, "_super").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(key).orderBy("_super").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(F.col(key).alias("_k"), F.col("_super").alias("_s"),
                       F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inner = W.partitionBy(key, "_super").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return (c.join(tops.hint("merge"), c[key].eqNullSafe(F.col("_k")) & (F.col("_super") == F.col("_s")))
            .withColumn(out, F.col("_off") + F.col("_in")).drop("_super", "_in", "_k", "_s", "_off"))


def held_by_worker(key: str, make: Callable[[], object]):
    """``make()``, held by the worker process for later tasks that ask for the same ``key``.

    A worker holds one such thing: what another operator held before goes first, so that an
    operator's memory does not stay while later ones run."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def bounded_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches that this session's Python tasks get to ``BATCH_BYTES``; a lower bound, or one given with a unit, stays.

    By the usual bounds thousands of long texts make one batch, held several times over on both sides."""
    now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(BATCH_LIMIT))
    if now and not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
