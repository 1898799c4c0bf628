"""Incremental harmonisation of arriving diagnosis files (stream-static joins)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import codes as C
from ..operators import harmonise as H
from ..plans.sizing import checked_broadcast


def harmonise_stream(stream: DataFrame, xwalk: DataFrame, ccsr_long: DataFrame | None = None) -> DataFrame:
    """Row-level harmonisation of a streaming diagnosis DataFrame. The static sides
    are size-checked and broadcast; no state is kept. Category lists are per row
    (duplicate-key merging needs the whole key group and stays a batch step)."""
    out = H.map_codes(stream, xwalk)
    if ccsr_long is not None:
        by_code = checked_broadcast(H.ccsr_by_code(ccsr_long))
        keyed = out.withColumn("_icd10", C.icd10_key(F.col("icd10_full")))
        out = keyed.join(by_code, keyed["_icd10"] == by_code["icd10"], "left").drop("icd10", "_icd10")
        pairs = F.when(F.size("pairs") > 0, F.col("pairs"))
        out = (out.withColumn("ccsr_list_sorted", F.transform(pairs, lambda p: p["ccsr_category"]))
               .withColumn("n_ccsr", F.coalesce(F.size(F.transform(pairs, lambda p: p["ccsr_category"])), F.lit(0)))
               .drop("pairs"))
    return out


def run_once(spark: SparkSession, source_dir: str, schema, xwalk: DataFrame, sink_dir: str, checkpoint_dir: str,
             ccsr_long: DataFrame | None = None) -> StreamingQuery:
    """Process every file present in ``source_dir`` (``availableNow`` trigger) into a
    Parquet sink with exactly-once file-sink semantics, then stop."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    q = (harmonise_stream(stream, xwalk, ccsr_long).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint_dir).option("path", sink_dir)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
