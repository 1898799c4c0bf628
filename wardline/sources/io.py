"""CSV / JSON / Parquet scans and sinks of the cohort tables.

The reference passes CSV files between steps; here Parquet is the default hand-off
(typed, columnar, array columns kept native) and CSV is supported at the edges with
declared schemas (no inference: ``icd_code`` must stay text to keep leading zeros).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.schema import drop_unnamed

# Declared input schemas (data model of the three EHR tables).
PATIENTS_SCHEMA = T.StructType([
    T.StructField("subject_id", T.LongType()), T.StructField("gender", T.StringType()),
    T.StructField("anchor_age", T.IntegerType()), T.StructField("anchor_year", T.IntegerType()),
    T.StructField("dod", T.StringType())])
ADMISSIONS_SCHEMA = T.StructType([
    T.StructField("subject_id", T.LongType()), T.StructField("hadm_id", T.LongType()),
    T.StructField("admittime", T.StringType()), T.StructField("dischtime", T.StringType()),
    T.StructField("deathtime", T.StringType()), T.StructField("admission_type", T.StringType()),
    T.StructField("admission_location", T.StringType()), T.StructField("insurance", T.StringType()),
    T.StructField("marital_status", T.StringType()), T.StructField("race", T.StringType()),
    T.StructField("hospital_expire_flag", T.IntegerType())])
DIAGNOSES_SCHEMA = T.StructType([
    T.StructField("subject_id", T.LongType()), T.StructField("hadm_id", T.LongType()),
    T.StructField("seq_num", T.IntegerType()), T.StructField("icd_code", T.StringType()),
    T.StructField("icd_version", T.IntegerType())])


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1 (+A7, B5): header CSV read by column name, each declared field coerced with
    ``try_cast`` (bad values -> NULL, never an error under ANSI); declared fields that
    the file lacks come back as typed NULL columns, pandas index columns are dropped,
    undeclared extra columns are kept as text."""
    raw = drop_unnamed(spark.read.option("header", True).option("inferSchema", False).csv(path))
    declared = []
    for f in schema.fields:
        if f.name in raw.columns:
            declared.append(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name))
        else:
            declared.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [F.col(f"`{c}`") for c in raw.columns if c not in set(schema.fieldNames())]
    return raw.select(*declared, *extra)


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A2: every column as text with blanks kept as '' (never turned into NULL)."""
    return drop_unnamed(spark.read.option("header", True).option("inferSchema", False)
                        .option("nullValue", "\u0000").option("emptyValue", "").csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """A3: Parquet (arrays native) or CSV (arrays as JSON text)."""
    if fmt == "csv":
        cols = [F.to_json(F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
        w = (df.select(*cols).write.mode("overwrite").option("header", True)
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
        (w.partitionBy(*partition_by) if partition_by else w).csv(path)
        return
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(path)


def write_code_table(codes: DataFrame, path: str) -> None:
    """A4: the (feature, value, code) encoder table as JSON lines."""
    codes.write.mode("overwrite").json(path)


def write_trajectories(padded: DataFrame, path: str) -> None:
    """A5: padded trajectory arrays as Parquet, partitioned by split."""
    padded.write.mode("overwrite").partitionBy("split").parquet(path)
