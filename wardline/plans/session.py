"""Spark session construction and checkpoint-directory handling."""
from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every wardline plan relies on. Timestamps are compared as UTC wall clock.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# HotSpot does not compile methods above 8,000 bytes, and whole-stage code of wide projections
# is larger; within this limit Spark takes such stages operator by operator, in small methods.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
METHOD_BYTES = 8000


def compiled_methods(spark: SparkSession) -> None:
    """Hold whole-stage methods to what HotSpot compiles; a lower limit stays."""
    if int(spark.conf.get(METHOD_LIMIT, "65535")) > METHOD_BYTES:
        spark.conf.set(METHOD_LIMIT, str(METHOD_BYTES))


# Bytes of a written table that one task sorts whole: wide rows take some fifteen times their written size.
SCAN_LIMIT = "spark.sql.files.maxPartitionBytes"
SCAN_BYTES = 1 << 24


@contextmanager
def small_scans(spark: SparkSession) -> Iterator[None]:
    """Tasks of the tables written inside read at most ``SCAN_BYTES``, so that they sort wide rows without spilling; a lower bound stays."""
    given = spark.conf.get(SCAN_LIMIT)
    now = re.fullmatch(r"(\d+)b?", given)
    if now and int(now[1]) > SCAN_BYTES:
        spark.conf.set(SCAN_LIMIT, str(SCAN_BYTES))
    try:
        yield
    finally:
        spark.conf.set(SCAN_LIMIT, given)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "wardline", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the base settings; used by tests and bench."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this is configured and only read here. A fresh local folder is
    created only when nothing is configured (tests, local runs).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="wardline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
