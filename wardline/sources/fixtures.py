"""EHR stand-in views over the driver tables.

The reference reads three EHR CSVs, an ICD-9 -> ICD-10 crosswalk and a CCSR category
file, none of which ship with it. These views derive tables of the same shape from
the TPC-H-like driver tables so that their size grows with the scale factor.

The SQL text is fixed (it defines the test inputs) and is shared by the Spark side and
the DuckDB oracle; ``{STR}`` is the engine's string type name.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import compiled_methods
from .tables import table

# The stand-in view definitions (inputs, identical in both engines).
PATIENTS_SQL = """
SELECT c_custkey AS subject_id,
 CASE WHEN c_custkey % 17 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'F ' END AS gender,
 CAST(18 + c_custkey % 75 AS INT) AS anchor_age, CAST(1994 + c_custkey % 5 AS INT) AS anchor_year FROM customer
"""

ADMISSIONS_SQL = """
SELECT hadm_id, subject_id, CAST(admit_ts AS {STR}) AS admittime,
 CASE WHEN hadm_id % 53 = 0 THEN NULL ELSE CAST(admit_ts + (hadm_id * 37 % 500 - 5) * INTERVAL '1' HOUR AS {STR}) END AS dischtime,
 CASE WHEN expire = 1 THEN CAST(admit_ts + (hadm_id * 37 % 500) * INTERVAL '1' HOUR AS {STR}) END AS deathtime,
 admission_type, insurance, race, expire AS hospital_expire_flag
FROM (SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS admit_ts,
  o_orderpriority AS admission_type, c_mktsegment AS insurance, n_name AS race,
  CAST(CASE WHEN o_orderkey * 7919 % 1009 < 40 THEN 1 ELSE 0 END AS INT) AS expire
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) t
"""

DIAGNOSES_SQL = """
SELECT o_custkey AS subject_id, l_orderkey AS hadm_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS seq_num,
 CAST(CASE WHEN l_partkey % 3 = 0 THEN 9 ELSE 10 END AS INT) AS icd_version,
 CASE WHEN l_partkey % 3 = 0 THEN concat(lpad(CAST(l_partkey % 1000 AS {STR}), 3, '0'), '.', CAST(l_partkey % 7 AS {STR}))
      ELSE concat(' ', chr(CAST(97 + l_partkey % 26 AS INT)), lpad(CAST(l_partkey % 100 AS {STR}), 2, '0'), '.', CAST(l_partkey % 5 AS {STR})) END AS icd_code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

SCORES_SQL = """
SELECT hadm_id, subject_id, race, hospital_expire_flag AS y_true,
 CAST((hadm_id * 104729 % 7919) % 701 + 299 * hospital_expire_flag AS DOUBLE) / 1000 AS y_prob FROM ehr_admissions
"""

ICD9_MAP_SQL = """
SELECT DISTINCT concat(lpad(CAST(p_partkey % 1000 AS {STR}), 3, '0'), CAST(p_partkey % 7 AS {STR})) AS icd9,
 concat(chr(CAST(65 + p_partkey % 26 AS INT)), lpad(CAST(p_partkey % 90 AS {STR}), 2, '0'), CAST(p_partkey % 4 AS {STR})) AS icd10
FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 11 <> 0
"""

CCSR_SQL = """
SELECT concat(chr(39), icd10, chr(39)) AS icd10_code,
 concat(chr(39), chr(CAST(65 + h % 5 AS INT)), 'CAT00', CAST(h % 9 AS {STR}), chr(39)) AS cat1,
 concat(chr(39), 'Group ', CAST(h % 9 AS {STR}), ' ', chr(CAST(65 + h % 5 AS INT)), chr(39)) AS desc1,
 CASE WHEN h % 3 = 0 THEN concat(chr(39), chr(CAST(70 + h % 4 AS INT)), 'CAT01', CAST(h % 7 AS {STR}), chr(39)) ELSE concat(chr(39), ' ', chr(39)) END AS cat2,
 CASE WHEN h % 3 = 0 THEN concat(chr(39), 'Alt ', CAST(h % 7 AS {STR}), ' ', chr(CAST(70 + h % 4 AS INT)), chr(39)) ELSE concat(chr(39), ' ', chr(39)) END AS desc2
FROM (SELECT icd10, ascii(substr(icd10,1,1)) * 100 + CAST(substr(icd10,2,2) AS INT) AS h FROM (
  SELECT icd10 FROM ehr_icd9_map UNION
  SELECT concat(chr(CAST(65 + (p_partkey + 6) % 26 AS INT)), lpad(CAST(p_partkey % 100 AS {STR}), 2, '0'), CAST(p_partkey % 5 AS {STR})) AS icd10 FROM part WHERE p_partkey % 3 <> 0) u) t
WHERE h % 13 <> 0
"""

LOS_SCORES_SQL = """
SELECT hadm_id, race, y_cls, w0 / (w0 + w1 + w2 + w3) AS p0, w1 / (w0 + w1 + w2 + w3) AS p1,
 w2 / (w0 + w1 + w2 + w3) AS p2, w3 / (w0 + w1 + w2 + w3) AS p3
FROM (SELECT hadm_id, race, y_cls,
  CAST(1 + hadm_id * 7 % 97 + CASE WHEN y_cls = 0 THEN 60 ELSE 0 END AS DOUBLE) AS w0,
  CAST(1 + hadm_id * 38 % 97 + CASE WHEN y_cls = 1 THEN 60 ELSE 0 END AS DOUBLE) AS w1,
  CAST(1 + hadm_id * 69 % 97 + CASE WHEN y_cls = 2 THEN 60 ELSE 0 END AS DOUBLE) AS w2,
  CAST(1 + hadm_id * 11 % 97 + CASE WHEN y_cls = 3 THEN 60 ELSE 0 END AS DOUBLE) AS w3
 FROM (SELECT hadm_id, race, CAST(CASE WHEN h < 72 THEN 0 WHEN h < 168 THEN 1 WHEN h < 336 THEN 2 ELSE 3 END AS INT) AS y_cls
  FROM (SELECT hadm_id, race, hadm_id * 37 % 500 AS h FROM ehr_admissions) a) b) c
"""

# name -> (sql, upstream views it reads)
VIEWS = {
    "ehr_patients": (PATIENTS_SQL, ("customer",)),
    "ehr_admissions": (ADMISSIONS_SQL, ("orders", "customer", "nation")),
    "ehr_diagnoses": (DIAGNOSES_SQL, ("lineitem", "orders")),
    "ehr_scores": (SCORES_SQL, ("ehr_admissions",)),
    "ehr_icd9_map": (ICD9_MAP_SQL, ("part",)),
    "ehr_ccsr": (CCSR_SQL, ("ehr_icd9_map", "part")),
    "ehr_los_scores": (LOS_SCORES_SQL, ("ehr_admissions",)),
}


def view_sql(name: str, string_type: str) -> str:
    return VIEWS[name][0].replace("{STR}", string_type).strip()


def duckdb_ctes(*names: str) -> str:
    """``WITH`` prefix defining the requested views (and their dependencies) for DuckDB."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in VIEWS or n in order:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{view_sql(n, 'VARCHAR')}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n"


class EhrInputs:
    """Lazily built stand-in tables for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # the views (and the reference's naive timestamps) are UTC wall-clock times;
        # pinning the zone keeps hour/weekday/LOS free of daylight-saving shifts
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        compiled_methods(spark)
        self.spark = spark
        self.sf_dir = sf_dir

    def _view(self, name: str) -> DataFrame:
        sql, deps = VIEWS[name]
        frames = {d: self._source(d) for d in deps}
        # {name} placeholders are bound to DataFrames by spark.sql
        text = view_sql(name, "STRING")
        for d in deps:
            text = _bind(text, d)
        return self.spark.sql(text, **frames)

    def _source(self, name: str) -> DataFrame:
        return getattr(self, name) if name in VIEWS else table(self.spark, self.sf_dir, name)

    @cached_property
    def ehr_patients(self) -> DataFrame:
        return self._view("ehr_patients")

    @cached_property
    def ehr_admissions(self) -> DataFrame:
        return self._view("ehr_admissions")

    @cached_property
    def ehr_diagnoses(self) -> DataFrame:
        return self._view("ehr_diagnoses")

    @cached_property
    def ehr_scores(self) -> DataFrame:
        return self._view("ehr_scores")

    @cached_property
    def ehr_icd9_map(self) -> DataFrame:
        return self._view("ehr_icd9_map")

    @cached_property
    def ehr_ccsr(self) -> DataFrame:
        return self._view("ehr_ccsr")

    @cached_property
    def ehr_los_scores(self) -> DataFrame:
        return self._view("ehr_los_scores")

    def ccsr_dimension(self) -> DataFrame:
        """The category file in its published wide layout (quoted header names)."""
        c = self.ehr_ccsr
        return c.select(
            c.icd10_code.alias("'ICD-10-CM CODE'"),
            c.cat1.alias("'CCSR CATEGORY 1'"), c.desc1.alias("'CCSR CATEGORY 1 DESCRIPTION'"),
            c.cat2.alias("'CCSR CATEGORY 2'"), c.desc2.alias("'CCSR CATEGORY 2 DESCRIPTION'"),
        )


def _bind(sql: str, name: str) -> str:
    """Turn bare table references ``FROM name`` / ``JOIN name`` into ``{name}`` bindings."""
    import re
    return re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", sql)
