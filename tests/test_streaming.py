"""Incremental harmonisation: re-running on the same checkpoint adds nothing; a new
file is processed exactly once (file sink + checkpoint, availableNow trigger)."""
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from wardline.plans.cohort import Cohort
from wardline.streaming.incremental import run_once


def test_restart_is_idempotent_and_new_files_are_picked_up(spark):
    c = Cohort(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="wardline-stream-")
    src, sink, ck = f"{root}/src", f"{root}/sink", f"{root}/ckpt"
    dx = c.inputs.ehr_diagnoses
    first = dx.filter(F.col("hadm_id") % 2 == 0)
    second = dx.filter(F.col("hadm_id") % 2 == 1)
    first.write.parquet(f"{src}/part=1")
    run_once(spark, src, first.schema, c.inputs.ehr_icd9_map, sink, ck, c.ccsr_long)
    n1 = spark.read.parquet(sink).count()
    assert n1 == first.count()
    run_once(spark, src, first.schema, c.inputs.ehr_icd9_map, sink, ck, c.ccsr_long)
    assert spark.read.parquet(sink).count() == n1
    second.write.parquet(f"{src}/part=2")
    run_once(spark, src, first.schema, c.inputs.ehr_icd9_map, sink, ck, c.ccsr_long)
    out = spark.read.parquet(sink)
    assert out.count() == dx.count()
    assert out.select("subject_id", "hadm_id", "seq_num").distinct().count() == dx.count()
