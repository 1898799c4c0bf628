"""Build-side sizing: broadcast only what is proven small.

A dimension (crosswalk, category table, code map, vocabulary, fitted parameters) is
materialised once into the shared checkpoint folder, which cuts its lineage so that
a lost executor re-reads it instead of recomputing the scan behind it. Its row count
is then checked against an explicit bound: within the bound it is broadcast, above
it the join is left to a shuffle (sort-merge) join, so nothing unbounded is ever
shipped to every executor.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ensure_checkpoint_dir

# Largest dimension we are willing to broadcast, in rows. ICD-10-CM has ~75k codes,
# the category file ~75k rows per category slot; a few hundred thousand narrow rows
# are a few tens of MB.
DEFAULT_MAX_ROWS = 500_000

# Bytes of a row group, the least that one task can read of a written table.
ROW_GROUP = 1 << 23


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared ``spark.checkpoint.dir``
    and read it back: lineage is cut (a lost executor re-reads files instead of
    recomputing the plan), the plan runs exactly once (an eager ``checkpoint()``
    runs it twice unless cached), and later scans prune columns and push filters."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/wardline-tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.parquet(path)
    out._written_to = path
    return out


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` is a table as ``materialise`` wrote it, nothing added."""
    return getattr(df, "_written_to", None) is not None


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote, once what was made of them is written itself.

    Only for tables that no plan reads any more; frames of another kind are left alone."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path:
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared one."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Materialise ``df`` and broadcast-hint it only if it has at most ``max_rows`` rows."""
    small = materialise(df)
    n = small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small
