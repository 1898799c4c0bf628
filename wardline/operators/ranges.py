"""Steps over rows that stand in order within ranged partitions: sums and the row before, without another shuffle.

Arrow batches pass one at a time; what is carried from one to the next is a row."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..plans.sizing import materialise

FIRST, LAST = 1, 2     # edges of a partition


def _starts(batch: pa.RecordBatch, group: Sequence[str], last: dict | None) -> np.ndarray:
    """Where a row's group differs from the row's before (NULL and NaN equal themselves); ``last`` is the row before the batch."""
    new = np.zeros(batch.num_rows, bool)
    for c in group:
        before = batch.column(c)[:1] if last is None else last[c]
        keys = pa.concat_arrays([before, batch.column(c)]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= keys[1:] != keys[:-1]
    return new


def running_sums(ordered: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds ``_run_<value>``: the sum of a DOUBLE column from the first row of the partition's stretch of
    ``group`` to this one, as SQL sums (NULL is left out, and stays until a value is seen).

    Rows must stand in order within partitions, each group in one stretch; a batch is held at a time."""
    g, vals = list(group), list(values)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, {v: (0.0, False) for v in vals}
        for b in batches:
            if not b.num_rows:
                continue
            cuts = [0, *np.flatnonzero(_starts(b, g, last)), b.num_rows]
            out = []
            for v in vals:
                known = b.column(v).is_valid().to_numpy(zero_copy_only=False)
                x = np.where(known, b.column(v).fill_null(0.0).to_numpy(), 0.0)
                total, seen = carried[v]
                sums, some = np.empty(b.num_rows), np.empty(b.num_rows, bool)
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    if i:
                        total, seen = 0.0, False
                    if hi > lo:
                        sums[lo:hi] = np.cumsum(np.concatenate([[total], x[lo:hi]]))[1:]
                        some[lo:hi] = np.logical_or.accumulate(known[lo:hi]) | seen
                        total, seen = sums[hi - 1], bool(some[hi - 1])
                carried[v] = (total, seen)
                out.append(pa.array(sums, mask=~some))
            last = {c: b.column(c)[-1:] for c in g}
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, *[f"_run_{v}" for v in vals]])

    sums = [StructField(f"_run_{v}", DoubleType()) for v in vals]
    return ordered.mapInArrow(follow, StructType([*ordered.schema.fields, *sums]))


def ranged_lag(df: DataFrame, group: str, ts: str, tie: str, out: str) -> DataFrame:
    """``df`` with ``out``, the ``ts`` of the row before in its group by (``ts``, NULL first, then ``tie``); written once.

    Rows are ranged by (group, time), so neither a long history nor an id that many rows share is one
    task's. Only the first row of a partition asks the partition before, through a table of edges."""
    order = (F.asc_nulls_first(group), F.asc_nulls_first(ts), F.asc_nulls_first(tie))
    ranged = df.repartitionByRange(*order).withColumn("_cell", F.spark_partition_id()).sortWithinPartitions(*order)

    def finish(b: pa.RecordBatch, last: dict | None, final: bool) -> pa.RecordBatch:
        t = b.column(ts)
        before = pa.nulls(1, t.type) if last is None else last[ts]
        prev = pa.concat_arrays([before, t[:-1]])
        prev = pc.if_else(pa.array(_starts(b, [group], last)), pa.scalar(None, t.type), prev)
        edge = np.zeros(b.num_rows, np.int32)
        edge[0] += FIRST if last is None else 0
        edge[-1] += LAST if final else 0
        return pa.RecordBatch.from_arrays([*b.columns, prev, pa.array(edge)], names=[*b.schema.names, out, "_edge"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield finish(held, last, False)
                last = {c: held.column(c)[-1:] for c in (group, ts)}
            held = b
        if held is not None:
            yield finish(held, last, True)

    fields = [*ranged.schema.fields, StructField(out, ranged.schema[ts].dataType), StructField("_edge", IntegerType(), False)]
    rows = materialise(ranged.mapInArrow(follow, StructType(fields)))
    # one row a partition: the group and time it ends with, looked up from the partition after it
    ends = rows.filter(F.col("_edge").bitwiseAND(LAST) > 0).select("_cell", F.col(group).alias("_g"), F.col(ts).alias("_t"))
    w = Window.orderBy("_cell")
    ends = ends.select(F.col("_cell").alias("_at"), F.lag("_g").over(w).alias("_g"), F.lag("_t").over(w).alias("_t"), (F.row_number().over(w) > 1).alias("_any"))
    joined = rows.join(F.broadcast(ends), (F.col("_edge").bitwiseAND(FIRST) > 0) & (F.col("_cell") == F.col("_at")), "left")
    from_before = F.col("_any") & F.col(group).eqNullSafe(F.col("_g"))
    return joined.withColumn(out, F.when(from_before, F.col("_t")).otherwise(F.col(out))).drop("_cell", "_edge", "_at", "_g", "_t", "_any")
