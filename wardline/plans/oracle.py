"""Independent DuckDB SQL twins of the registered queries (the correctness oracle).

Written directly in SQL, not generated from the Spark plans. Each statement inlines
the stand-in views it needs as CTEs, followed by the cohort CTE chain below.
"""
from __future__ import annotations

from ..sources.fixtures import duckdb_ctes


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def unquote(x: str) -> str:
    return rf"regexp_replace({strip(x)}, '^''+|''+$', '', 'g')"


def norm_dx(x: str) -> str:
    return rf"nullif(regexp_replace(upper({strip(x)}), '[.\s]+', '', 'g'), '')"


BLANKS_SQL = "('', ' ', 'NA', 'N/A', 'None', 'NONE', 'NaN', 'nan')"


def blank_null(x: str) -> str:
    return f"CASE WHEN {strip(x)} NOT IN {BLANKS_SQL} THEN {x} END"


# merged rows -> code mapping -> harmonised rows (ICD-10 present)
HARMONISED = rf"""
merged AS (
 SELECT p.subject_id, a.hadm_id, p.gender, p.anchor_age, p.anchor_year, a.admittime, a.dischtime,
  a.deathtime, a.admission_type, a.insurance, a.race, a.hospital_expire_flag, d.seq_num,
  d.icd_version, d.icd_code
 FROM ehr_patients p JOIN ehr_admissions a ON a.subject_id = p.subject_id
 JOIN ehr_diagnoses d ON d.subject_id = a.subject_id AND d.hadm_id = a.hadm_id),
xw AS (
 SELECT src, min(dst) AS dst FROM (
  SELECT {norm_dx('icd9')} AS src, {strip('icd10')} AS dst FROM ehr_icd9_map) x
 WHERE src IS NOT NULL AND dst IS NOT NULL AND dst <> '' GROUP BY src),
normed AS (SELECT *, {norm_dx('icd_code')} AS dx_norm FROM merged),
mapped AS (
 SELECT n.*, CASE WHEN CAST(n.icd_version AS VARCHAR) = '10' THEN n.dx_norm
                  WHEN CAST(n.icd_version AS VARCHAR) = '9' THEN xw.dst END AS icd10_full
 FROM normed n LEFT JOIN xw ON CAST(n.icd_version AS VARCHAR) = '9' AND n.dx_norm = xw.src),
mapped3 AS (
 SELECT *, nullif(regexp_extract(upper(replace({strip('icd10_full')}, '.', '')), '^([A-Z][0-9]{{2}})', 1), '') AS icd10_3char
 FROM mapped),
harm AS (SELECT * FROM mapped3 WHERE icd10_full IS NOT NULL)"""

# category file -> long (icd10, category, description) -> per-row category sets
CATEGORIES = rf"""
cc AS (
 SELECT upper(replace({unquote('icd10_code')}, '.', '')) AS icd10,
  {unquote('cat1')} AS cat1, {unquote('desc1')} AS desc1, {unquote('cat2')} AS cat2, {unquote('desc2')} AS desc2
 FROM ehr_ccsr),
ccsr_long AS (
 SELECT DISTINCT icd10, cat AS ccsr_category, dsc AS ccsr_description FROM (
  SELECT icd10, cat1 AS cat, desc1 AS dsc FROM cc UNION ALL SELECT icd10, cat2, desc2 FROM cc) u
 WHERE cat IS NOT NULL AND cat NOT IN ('', ' ')),
cat_desc AS (
 SELECT icd10, ccsr_category, min({strip('ccsr_description')}) AS ccsr_desc FROM ccsr_long
 WHERE ccsr_description IS NOT NULL AND {strip('ccsr_description')} <> '' GROUP BY 1, 2),
harm_key AS (
 SELECT *, CASE WHEN k IN ('', 'NAN', 'NONE') THEN NULL ELSE k END AS icd10_key FROM (
  SELECT *, upper(replace({strip('icd10_full')}, '.', '')) AS k FROM harm) t),
row_cats AS (
 SELECT DISTINCT h.subject_id, h.hadm_id, h.seq_num, c.ccsr_category, c.ccsr_desc
 FROM harm_key h JOIN cat_desc c ON c.icd10 = h.icd10_key),
row_lists AS (
 SELECT subject_id, hadm_id, seq_num,
  string_agg(ccsr_category, '|' ORDER BY ccsr_category) AS ccsr_list_sorted,
  string_agg(ccsr_desc, '|' ORDER BY ccsr_category) AS ccsr_description,
  CAST(count(*) AS INTEGER) AS n_ccsr
 FROM row_cats GROUP BY 1, 2, 3)"""

# per-row features (gender, codes, time, LOS, age, category counts)
FEATURES = rf"""
clean AS (
 SELECT h.* EXCLUDE (gender, race, admission_type),
  CASE WHEN upper({strip(blank_null('h.gender'))}) IN ('M', 'F') THEN upper({strip(blank_null('h.gender'))}) END AS gender,
  {blank_null('h.race')} AS race, {blank_null('h.admission_type')} AS admission_type
 FROM harm h),
codes AS (
 SELECT col, v, CAST(row_number() OVER (PARTITION BY col ORDER BY v) - 1 AS INTEGER) AS code FROM (
  SELECT DISTINCT 'race' AS col, {strip('race')} AS v FROM clean WHERE race IS NOT NULL UNION
  SELECT DISTINCT 'admission_type', {strip('admission_type')} FROM clean WHERE admission_type IS NOT NULL UNION
  SELECT DISTINCT 'gender', {strip('gender')} FROM clean WHERE gender IS NOT NULL) d
 WHERE v NOT IN {BLANKS_SQL}),
timed AS (
 SELECT c.*, try_cast(c.admittime AS TIMESTAMP) AS admittime_dt, try_cast(c.dischtime AS TIMESTAMP) AS dischtime_dt,
  try_cast(c.deathtime AS TIMESTAMP) AS deathtime_dt,
  coalesce(rc.code, -1) AS race_code, coalesce(ac.code, -1) AS admission_type_code, coalesce(gc.code, -1) AS gender_code
 FROM clean c
 LEFT JOIN codes rc ON rc.col = 'race' AND rc.v = {strip('c.race')}
 LEFT JOIN codes ac ON ac.col = 'admission_type' AND ac.v = {strip('c.admission_type')}
 LEFT JOIN codes gc ON gc.col = 'gender' AND gc.v = {strip('c.gender')}),
feat AS (
 SELECT t.*, los_hours, los_hours / 24.0 AS los_days,
  CAST(year(admittime_dt) AS INTEGER) AS adm_year, CAST(month(admittime_dt) AS INTEGER) AS adm_month,
  CAST(day(admittime_dt) AS INTEGER) AS adm_day, CAST(hour(admittime_dt) AS INTEGER) AS adm_hour,
  CAST(isodow(admittime_dt) - 1 AS INTEGER) AS adm_weekday,
  CAST(coalesce(isodow(admittime_dt) - 1 >= 5, false) AS INTEGER) AS adm_weekend,
  CASE WHEN age BETWEEN 0 AND 120 THEN age END AS age_at_admit,
  rl.ccsr_list_sorted, rl.ccsr_description, coalesce(rl.n_ccsr, 0) AS n_ccsr
 FROM (SELECT *,
   CASE WHEN x IS NOT NULL THEN greatest(x, 0.0) END AS los_hours,
   CAST(anchor_age AS DOUBLE) + CAST(year(admittime_dt) - anchor_year AS DOUBLE) AS age
  FROM (SELECT *, (epoch_us(coalesce(dischtime_dt, deathtime_dt)) - epoch_us(admittime_dt)) / 3.6e9 AS x FROM timed) t0) t
 LEFT JOIN row_lists rl USING (subject_id, hadm_id, seq_num))"""

BASE_VIEWS = ("ehr_patients", "ehr_admissions", "ehr_diagnoses", "ehr_icd9_map", "ehr_ccsr")


def with_cohort(body: str, *chain: str, views=BASE_VIEWS) -> str:
    """Prefix ``body`` with the stand-in views and the chosen CTE fragments."""
    ctes = duckdb_ctes(*views).rstrip()
    extra = ",".join(chain)
    return f"{ctes},{extra}\n{body}" if chain else f"{ctes}\n{body}"


def ctes(*parts: str) -> str:
    return ",".join(parts)


ORACLE: dict[str, str] = {}

ORACLE["category_outcomes"] = with_cohort(r"""
, per_adm AS (
 SELECT rc.ccsr_category, f.hadm_id, count(*) AS n_rows, max(f.hospital_expire_flag) AS died, max(f.los_days) AS los
 FROM feat f JOIN row_cats rc USING (subject_id, hadm_id, seq_num) GROUP BY 1, 2)
SELECT ccsr_category, CAST(sum(n_rows) AS BIGINT) AS n_dx_rows, count(*) AS n_admissions,
 CAST(sum(died) AS BIGINT) AS n_deaths, round(avg(died), 9) AS mortality_rate, round(avg(los), 9) AS mean_los_days
FROM per_adm GROUP BY 1""", HARMONISED, CATEGORIES, FEATURES)

HC = (HARMONISED, CATEGORIES)
HCF = (HARMONISED, CATEGORIES, FEATURES)

ORACLE["dx_harmonised"] = with_cohort(
    "SELECT subject_id, hadm_id, seq_num, icd_version, icd_code, dx_norm, icd10_full, icd10_3char FROM mapped3",
    HARMONISED)

ORACLE["mapping_qa"] = with_cohort(r"""
SELECT count(*) AS total_rows, CAST(count_if(CAST(icd_version AS VARCHAR) = '9') AS BIGINT) AS icd9_rows,
 round(avg(CASE WHEN CAST(icd_version AS VARCHAR) = '9' THEN CAST(icd10_full IS NOT NULL AS DOUBLE) END), 9) AS icd9_mapped_share,
 round(avg(CAST(icd10_3char IS NOT NULL AS DOUBLE)), 9) AS char3_share,
 CAST(count_if(icd10_full IS NULL) AS BIGINT) AS icd10_full_nulls, CAST(count_if(icd10_3char IS NULL) AS BIGINT) AS icd10_3char_nulls
FROM mapped3""", HARMONISED)

ORACLE["unmapped_icd9_top20"] = with_cohort(r"""
SELECT icd_code, count(*) AS n FROM mapped3
WHERE CAST(icd_version AS VARCHAR) = '9' AND icd10_full IS NULL
GROUP BY icd_code ORDER BY n DESC, icd_code LIMIT 20""", HARMONISED)

ORACLE["ccsr_long"] = with_cohort("SELECT icd10, ccsr_category, ccsr_description FROM ccsr_long", *HC)

ORACLE["ccsr_category_codes"] = with_cohort(r"""
SELECT DISTINCT icd10, cat AS ccsr_category FROM (
 SELECT icd10, cat1 AS cat FROM cc UNION ALL SELECT icd10, cat2 FROM cc) u
WHERE cat IS NOT NULL AND cat NOT IN ('', ' ')""", *HC)

ORACLE["dx_categories"] = with_cohort(r"""
SELECT h.subject_id, h.hadm_id, h.seq_num, h.icd10_full, rl.ccsr_list_sorted,
 coalesce(rl.ccsr_description, '') AS ccsr_description, coalesce(rl.n_ccsr, 0) AS n_ccsr
FROM harm h LEFT JOIN row_lists rl USING (subject_id, hadm_id, seq_num)""", *HC)

ORACLE["multi_category_rows"] = with_cohort(r"""
SELECT subject_id, hadm_id, seq_num, ccsr_list_sorted FROM harm JOIN row_lists USING (subject_id, hadm_id, seq_num)
WHERE n_ccsr > 1""", *HC)

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"

ORACLE["feature_table"] = with_cohort(f"""
SELECT subject_id, hadm_id, seq_num, gender, race, admission_type, insurance, hospital_expire_flag,
 race_code, admission_type_code, gender_code, {TS.format('admittime_dt')}, {TS.format('dischtime_dt')},
 {TS.format('deathtime_dt')}, round(los_hours, 9) AS los_hours, round(los_days, 9) AS los_days,
 adm_year, adm_month, adm_day, adm_hour, adm_weekday, adm_weekend, round(age_at_admit, 9) AS age_at_admit, n_ccsr
FROM feat""", *HCF)

ORACLE["label_codes"] = with_cohort("SELECT col AS feature, v AS value, code FROM codes", *HCF)

ORACLE["minors"] = with_cohort(
    "SELECT subject_id, hadm_id, seq_num, round(age_at_admit, 9) AS age_at_admit FROM feat WHERE age_at_admit < 18",
    *HCF)

ORACLE["minors_reached"] = with_cohort(
    "SELECT subject_id, hadm_id, seq_num, round(age_at_admit - 40, 9) AS age_at_admit FROM feat WHERE age_at_admit - 40 < 18", *HCF)

ORACLE["dx_categories_merged"] = with_cohort(r"""
, paired AS (SELECT * REPLACE (CAST(ceil(seq_num / 2) AS INTEGER) AS seq_num) FROM harm_key),
cats AS (SELECT DISTINCT p.subject_id, p.hadm_id, p.seq_num, c.ccsr_category, c.ccsr_desc FROM paired p JOIN cat_desc c ON c.icd10 = p.icd10_key),
lists AS (SELECT subject_id, hadm_id, seq_num, string_agg(ccsr_category, '|' ORDER BY ccsr_category) AS ccsr_list_sorted FROM cats GROUP BY 1, 2, 3)
SELECT subject_id, hadm_id, seq_num, icd10_full, ccsr_list_sorted FROM paired LEFT JOIN lists USING (subject_id, hadm_id, seq_num)""", *HC)

ORACLE["patient_mortality"] = with_cohort(r"""
, pm AS (SELECT subject_id, max(hospital_expire_flag) AS flag FROM feat GROUP BY 1),
cnt AS (SELECT flag, count(*) AS count FROM pm GROUP BY 1)
SELECT CASE WHEN flag = 0 THEN 'Alive' WHEN flag = 1 THEN 'Dead' END AS hospital_expire_flag, count,
 round(count * 100.0 / (SELECT sum(count) FROM cnt), 9) AS percentage FROM cnt""", *HCF)

ORACLE["race_share"] = with_cohort(r"""
, cnt AS (SELECT race, count(*) AS count FROM feat WHERE race IS NOT NULL GROUP BY 1)
SELECT race, count, round(count * 100.0 / (SELECT sum(count) FROM cnt), 9) AS percentage FROM cnt""", *HCF)

ORACLE["top_categories"] = with_cohort(r"""
SELECT rc.ccsr_category, count(*) AS count FROM feat f JOIN row_cats rc USING (subject_id, hadm_id, seq_num)
GROUP BY 1 ORDER BY count DESC, ccsr_category LIMIT 10""", *HCF)


def _hist_sql(col: str, bins: int) -> str:
    return rf"""
, x AS (SELECT CAST({col} AS DOUBLE) AS x FROM feat WHERE {col} IS NOT NULL AND NOT isnan({col})),
st AS (SELECT min(x) AS lo_all, max(x) AS hi_all FROM x),
cnt AS (
 SELECT CAST(CASE WHEN (hi_all - lo_all) / {bins} > 0
   THEN least(floor((x - lo_all) / ((hi_all - lo_all) / {bins})), {bins - 1}) ELSE 0 END AS INTEGER) AS bin,
  count(*) AS c FROM x, st GROUP BY 1),
hist AS (
 SELECT CAST(g.range AS INTEGER) AS bin, lo_all + g.range * ((hi_all - lo_all) / {bins}) AS lo,
  lo_all + (g.range + 1) * ((hi_all - lo_all) / {bins}) AS hi,
  lo_all + (g.range + 0.5) * ((hi_all - lo_all) / {bins}) AS center, CAST(coalesce(cnt.c, 0) AS BIGINT) AS count
 FROM range(0, {bins}) g CROSS JOIN st LEFT JOIN cnt ON cnt.bin = g.range)"""


ORACLE["age_histogram"] = with_cohort(
    _hist_sql("age_at_admit", 20) + "\nSELECT bin, round(lo, 9) AS lo, round(hi, 9) AS hi, round(center, 9) AS center, count FROM hist",
    *HCF)
ORACLE["los_histogram"] = with_cohort(
    _hist_sql("los_days", 30) + "\nSELECT bin, round(lo, 9) AS lo, round(hi, 9) AS hi, round(center, 9) AS center, count FROM hist",
    *HCF)
ORACLE["los_modal_bin"] = with_cohort(
    _hist_sql("los_days", 30) + "\nSELECT bin, round(center, 9) AS center, count FROM hist ORDER BY count DESC, bin LIMIT 1",
    *HCF)

ORACLE["los_kde"] = with_cohort(r"""
, x AS (SELECT CAST(los_days AS DOUBLE) AS x FROM feat WHERE los_days IS NOT NULL AND NOT isnan(los_days)),
st AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd,
        pow(CAST(count(*) AS DOUBLE), -0.2) * stddev_samp(x) AS bw FROM x),
d AS (SELECT x, count(*) AS m FROM x GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS point FROM range(0, 200))
SELECT g.point, round(lo + g.point * ((hi - lo) / 199), 9) AS x,
 round(sum(m * exp(-0.5 * pow((lo + g.point * ((hi - lo) / 199) - d.x) / bw, 2))) / (n * bw * sqrt(2 * pi())), 9) AS density
FROM g CROSS JOIN d CROSS JOIN st GROUP BY g.point, lo, hi, n, bw""", *HCF)

ORACLE["admission_rollup"] = with_cohort(r"""
, adm AS (
 SELECT hadm_id,
  arg_min(subject_id, seq_num) FILTER (WHERE subject_id IS NOT NULL) AS subject_id,
  arg_min(gender, seq_num) FILTER (WHERE gender IS NOT NULL) AS gender,
  arg_min(race, seq_num) FILTER (WHERE race IS NOT NULL) AS race,
  arg_min(admission_type, seq_num) FILTER (WHERE admission_type IS NOT NULL) AS admission_type,
  arg_min(hospital_expire_flag, seq_num) FILTER (WHERE hospital_expire_flag IS NOT NULL) AS hospital_expire_flag,
  arg_min(los_days, seq_num) FILTER (WHERE los_days IS NOT NULL) AS los_days,
  arg_min(age_at_admit, seq_num) FILTER (WHERE age_at_admit IS NOT NULL) AS age_at_admit,
  arg_min(adm_year, seq_num) FILTER (WHERE adm_year IS NOT NULL) AS adm_year,
  arg_min(race_code, seq_num) FILTER (WHERE race_code IS NOT NULL) AS race_code,
  min(seq_num) AS seq_num,
  arg_min(icd_code, seq_num) FILTER (WHERE icd_code IS NOT NULL) AS icd_code,
  arg_min(n_ccsr, seq_num) FILTER (WHERE n_ccsr IS NOT NULL) AS n_ccsr,
  count(*) AS n_dx_rows
 FROM feat GROUP BY hadm_id),
un AS (SELECT hadm_id, string_agg(DISTINCT ccsr_category, '|' ORDER BY ccsr_category) AS u,
        CAST(count(DISTINCT ccsr_category) AS INTEGER) AS k FROM row_cats GROUP BY 1)
SELECT adm.hadm_id, subject_id, gender, race, admission_type, hospital_expire_flag, round(los_days, 9) AS los_days,
 round(age_at_admit, 9) AS age_at_admit, adm_year, race_code, seq_num, icd_code, n_ccsr,
 coalesce(un.u, '') AS ccsr_union, coalesce(un.k, 0) AS n_ccsr_unique, n_dx_rows
FROM adm LEFT JOIN un USING (hadm_id)""", *HCF)

# ---- sequence (trajectory) chain --------------------------------------------------
def lenient3(x: str) -> str:
    return (f"coalesce(nullif(regexp_extract({x}, '^([A-Z][0-9]{{2}})', 1), ''), "
            f"CASE WHEN length({x}) >= 3 THEN substr({x}, 1, 3) END)")


def clean_icd(x: str) -> str:
    return f"regexp_replace(upper(coalesce(CAST({x} AS VARCHAR), '')), '[^A-Z0-9]', '', 'g')"


def md5_unit(seed, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0)"


SEQ = rf"""
sadm AS (
 SELECT a.subject_id, a.hadm_id, a.race, a.admission_type, a.insurance,
  try_cast(a.admittime AS TIMESTAMP) AS admittime_dt, try_cast(a.dischtime AS TIMESTAMP) AS dischtime_dt,
  CAST(coalesce(try_cast(CAST(a.hospital_expire_flag AS VARCHAR) AS DOUBLE), 0) AS INTEGER) AS mortality,
  p.gender, p.anchor_age
 FROM ehr_admissions a LEFT JOIN ehr_patients p ON p.subject_id = a.subject_id),
sadm2 AS (
 SELECT *, coalesce(CASE WHEN h IS NOT NULL THEN greatest(h, 0.0) END, 0.0) AS los_hours FROM (
  SELECT *, (epoch_us(dischtime_dt) - epoch_us(admittime_dt)) / 3.6e9 AS h FROM sadm) t),
xw3 AS (
 SELECT src, arg_min(tok, tgt) AS mapped3 FROM (
  SELECT src, tgt, {lenient3('tgt')} AS tok FROM (
   SELECT {clean_icd('icd9')} AS src, nullif({clean_icd('icd10')}, '') AS tgt FROM ehr_icd9_map) x) y
 WHERE src <> '' AND tok IS NOT NULL GROUP BY src),
dxt AS (
 SELECT d.subject_id, d.hadm_id, CAST(coalesce(try_cast(CAST(d.seq_num AS VARCHAR) AS DOUBLE), 0) AS INTEGER) AS seq_num,
  d.icd_norm,
  CASE WHEN d.icd_norm = '' THEN NULL
       WHEN CAST(d.icd_version AS VARCHAR) = '10' OR regexp_matches(d.icd_norm, '^[A-Z][0-9]')
         THEN coalesce({lenient3('d.icd_norm')}, 'UNK_DX')
       ELSE coalesce(xw3.mapped3, 'UNK_DX') END AS dx_token
 FROM (SELECT *, {clean_icd('icd_code')} AS icd_norm FROM ehr_diagnoses) d LEFT JOIN xw3 ON d.icd_norm = xw3.src),
dxr AS (
 SELECT *, row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY seq_num, icd_norm) AS rn
 FROM dxt WHERE dx_token IS NOT NULL),
tok AS (
 SELECT subject_id, hadm_id, string_agg(CASE WHEN rn <= 40 THEN dx_token END, '|' ORDER BY rn) AS dx_tokens,
  count(*) AS n_dx, count(DISTINCT dx_token) AS n_dx_unique FROM dxr GROUP BY 1, 2),
seq0 AS (
 SELECT s.*, coalesce(t.dx_tokens, '') AS dx_tokens, coalesce(t.n_dx, 0) AS n_dx, coalesce(t.n_dx_unique, 0) AS n_dx_unique,
  lag(s.admittime_dt) OVER (PARTITION BY s.subject_id ORDER BY s.admittime_dt NULLS FIRST, s.hadm_id) AS prev_dt
 FROM sadm2 s LEFT JOIN tok t ON t.subject_id = s.subject_id AND t.hadm_id = s.hadm_id),
fcodes AS (
 SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS code FROM (
  SELECT DISTINCT 'gender' AS f, coalesce(CAST(gender AS VARCHAR), 'UNKNOWN') AS v FROM seq0 UNION
  SELECT DISTINCT 'race', coalesce(race, 'UNKNOWN') FROM seq0 UNION
  SELECT DISTINCT 'admission_type', coalesce(admission_type, 'UNKNOWN') FROM seq0 UNION
  SELECT DISTINCT 'insurance', coalesce(insurance, 'UNKNOWN') FROM seq0 UNION
  SELECT 'marital_status', 'UNKNOWN') u),
seq AS (
 SELECT s.subject_id, s.hadm_id, s.admittime_dt, s.race, s.dx_tokens, CAST(s.n_dx AS DOUBLE) AS n_dx,
  CAST(s.n_dx_unique AS DOUBLE) AS n_dx_unique,
  coalesce(CASE WHEN s.prev_dt IS NOT NULL AND s.admittime_dt IS NOT NULL
   THEN greatest((epoch_us(s.admittime_dt) - epoch_us(s.prev_dt)) / 3.6e9, 0.0) END, 0.0) AS delta_prev_adm_hours,
  s.los_hours, ln(1 + s.los_hours) AS los_log, s.mortality,
  coalesce(try_cast(CAST(s.anchor_age AS VARCHAR) AS DOUBLE), 0.0) AS age_at_admit,
  CAST(g.code AS DOUBLE) AS gender_code, CAST(r.code AS DOUBLE) AS race_code, CAST(t.code AS DOUBLE) AS admission_type_code,
  CAST(i.code AS DOUBLE) AS insurance_code, CAST(m.code AS DOUBLE) AS marital_code,
  CAST(coalesce(year(s.admittime_dt), 0) AS DOUBLE) AS adm_year, CAST(coalesce(month(s.admittime_dt), 0) AS DOUBLE) AS adm_month,
  CAST(coalesce(day(s.admittime_dt), 0) AS DOUBLE) AS adm_day, CAST(coalesce(hour(s.admittime_dt), 0) AS DOUBLE) AS adm_hour,
  CAST(coalesce(isodow(s.admittime_dt) - 1, 0) AS DOUBLE) AS adm_weekday,
  CAST(CAST(coalesce(isodow(s.admittime_dt) - 1, 0) >= 5 AS INTEGER) AS DOUBLE) AS adm_weekend
 FROM seq0 s
 LEFT JOIN fcodes g ON g.f = 'gender' AND g.v = coalesce(CAST(s.gender AS VARCHAR), 'UNKNOWN')
 LEFT JOIN fcodes r ON r.f = 'race' AND r.v = coalesce(s.race, 'UNKNOWN')
 LEFT JOIN fcodes t ON t.f = 'admission_type' AND t.v = coalesce(s.admission_type, 'UNKNOWN')
 LEFT JOIN fcodes i ON i.f = 'insurance' AND i.v = coalesce(s.insurance, 'UNKNOWN')
 LEFT JOIN fcodes m ON m.f = 'marital_status' AND m.v = 'UNKNOWN'),
seq_split AS (
 SELECT *, CASE WHEN {md5_unit(42, 'subject_id')} < 0.2 THEN 'test'
                WHEN {md5_unit(43, 'subject_id')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM seq),
labels AS (
 SELECT subject_id, hadm_id AS last_hadm_id, mortality AS y_mort, los_log AS y_los_log,
  coalesce(race, 'nan') AS race_last, split FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime_dt DESC NULLS LAST, hadm_id DESC) AS rd
  FROM seq_split) x WHERE rd = 1),
vocab AS (
 SELECT '<PAD>' AS token, CAST(0 AS BIGINT) AS count, 0 AS id UNION ALL
 SELECT '<UNK>', CAST(0 AS BIGINT), 1 UNION ALL
 SELECT token, count, CAST(row_number() OVER (ORDER BY count DESC, token) + 1 AS INTEGER) FROM (
  SELECT dx_token AS token, count(*) AS count FROM dxr
  WHERE (subject_id, hadm_id) IN (SELECT (subject_id, hadm_id) FROM seq_split WHERE split = 'train')
  GROUP BY 1 HAVING count(*) >= 5) f)"""

SEQ_VIEWS = ("ehr_patients", "ehr_admissions", "ehr_diagnoses", "ehr_icd9_map")
SEQ_STATIC = ("age_at_admit", "gender_code", "race_code", "admission_type_code", "insurance_code",
              "marital_code", "adm_year", "adm_month", "adm_day", "adm_hour", "adm_weekday",
              "adm_weekend", "n_dx", "n_dx_unique", "delta_prev_adm_hours")


def with_seq(body: str) -> str:
    return with_cohort(body, SEQ, views=SEQ_VIEWS)


ORACLE["seq_admissions"] = with_seq(
    "SELECT subject_id, hadm_id, dx_tokens, n_dx, n_dx_unique, round(delta_prev_adm_hours, 9) AS delta_prev_adm_hours, "
    "round(los_hours, 9) AS los_hours, round(los_log, 9) AS los_log, mortality, " +
    ", ".join(f"round({c}, 9) AS {c}" for c in SEQ_STATIC if c not in ("n_dx", "n_dx_unique", "delta_prev_adm_hours"))
    + " FROM seq")

ORACLE["seq_patient_labels"] = with_seq(
    "SELECT subject_id, last_hadm_id, y_mort, round(y_los_log, 9) AS y_los_log, race_last FROM labels")

ORACLE["seq_split_labels"] = with_seq(
    "SELECT split, y_mort, count(*) AS patients FROM labels GROUP BY 1, 2")

ORACLE["seq_vocab"] = with_seq("SELECT token, count, id FROM vocab")

ZERO40 = ",".join(["0"] * 40)
SEQ_PADDED = rf"""
, kept AS (
 SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime_dt DESC NULLS LAST, hadm_id DESC) AS rd,
  count(*) OVER (PARTITION BY subject_id) AS n_all FROM seq_split),
last20 AS (SELECT *, least(n_all, 20) - rd AS t FROM kept WHERE rd <= 20),
ids AS (
 SELECT d.subject_id, d.hadm_id, list(coalesce(v.id, 1) ORDER BY d.rn) AS ids
 FROM dxr d LEFT JOIN vocab v ON v.token = d.dx_token AND v.id >= 2 WHERE d.rn <= 40 GROUP BY 1, 2),
steps AS (
 SELECT l.subject_id, l.t, coalesce(i.ids, []::INTEGER[]) AS ids FROM last20 l
 LEFT JOIN ids i ON i.subject_id = l.subject_id AND i.hadm_id = l.hadm_id),
per AS (
 SELECT subject_id, count(*) AS n,
  string_agg(array_to_string(list_resize(ids, 40, 0), ','), ';' ORDER BY t) AS dx_ids,
  string_agg(array_to_string(list_resize(list_transform(ids, lambda x: 1), 40, 0), ','), ';' ORDER BY t) AS dx_mask
 FROM steps GROUP BY 1)"""
_PADDED_COLS = rf"""dx_ids || repeat(';{ZERO40}', CAST(20 - n AS INTEGER)) AS dx_ids,
 dx_mask || repeat(';{ZERO40}', CAST(20 - n AS INTEGER)) AS dx_mask,
 rtrim(repeat('1,', CAST(n AS INTEGER)) || repeat('0,', CAST(20 - n AS INTEGER)), ',') AS adm_mask"""
ORACLE["seq_padded"] = with_seq(SEQ_PADDED + f"\nSELECT subject_id, {_PADDED_COLS}, 20 AS n_steps FROM per")

# last 20 admissions standardised by the training patients' parameters, one row per real step
SCALED_STEPS = (
    SEQ_PADDED + ",\npar AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in SEQ_STATIC)
    + " FROM last20 WHERE split = 'train'),\nz AS (SELECT subject_id, split, t, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in SEQ_STATIC) + " FROM last20 CROSS JOIN par)")
ORACLE["seq_padded_static"] = with_seq(
    SCALED_STEPS + "\nSELECT p.subject_id, CAST(g.range AS INTEGER) AS t, CASE WHEN z.t IS NULL THEN 0 ELSE 1 END AS real, "
    + ", ".join(f"round(coalesce(z.{c}, 0.0), 6) + 0.0 AS {c}" for c in SEQ_STATIC)
    + " FROM per p CROSS JOIN range(0, 20) g LEFT JOIN z ON z.subject_id = p.subject_id AND z.t = g.range")
ORACLE["trajectory_model_inputs"] = with_seq(
    SCALED_STEPS + ", ab AS (SELECT subject_id, sum(" + " + ".join(f"abs({c})" for c in SEQ_STATIC) + ") AS a FROM z GROUP BY 1),\n"
    "pr AS (SELECT subject_id, sum(len(list_distinct(ids))) AS k FROM steps GROUP BY 1)\n"
    "SELECT l.split, count(*) AS patients, CAST(sum(y_mort) AS BIGINT) AS deaths, round(avg(y_los_log), 6) AS los_log, "
    "CAST(sum(k) AS BIGINT) AS pairs, round(avg(a), 6) AS static_abs FROM labels l JOIN ab USING (subject_id) JOIN pr USING (subject_id) GROUP BY 1")

ORACLE["seq_scaler"] = with_seq(
    ", kept AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime_dt DESC NULLS LAST, hadm_id DESC) AS rd "
    "FROM seq_split WHERE split = 'train')\nSELECT " +
    ", ".join(f"round(avg({c}), 6) AS {c}__mean, round(stddev_pop({c}), 6) AS {c}__std" for c in SEQ_STATIC)
    + " FROM kept WHERE rd <= 20")


# ---- text records -------------------------------------------------------------------
def valid_text(x: str) -> str:
    s = strip(f"CAST({x} AS VARCHAR)")
    return f"CASE WHEN {s} IS NOT NULL AND {s} <> '' AND lower({s}) <> 'nan' THEN {s} END"


TEXT_ROWS = rf"""
tr AS (
 SELECT *, CASE WHEN vdx0 <> 'NoDx' THEN vdx0 END AS vdx,
  list_filter(list_transform(coalesce(string_split(ccsr_list_sorted, '|'), []::VARCHAR[]), lambda c: {strip('c')}), lambda c: c <> '') AS cats,
  list_transform(coalesce(string_split(ccsr_list_sorted, '|'), []::VARCHAR[]), lambda c: {strip('c')}) AS cats_all
 FROM (SELECT f.*, row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY seq_num, icd_code) AS i,
        count(*) OVER (PARTITION BY subject_id, hadm_id) AS n_all,
        {valid_text('dx_norm')} AS vdx0, {valid_text('icd10_full')} AS vicd FROM feat f) a
 WHERE i <= 60),
rec_base AS (
 SELECT subject_id, hadm_id, CAST(max(n_all) AS INTEGER) AS n_dx,
  arg_min(hospital_expire_flag, i) AS y_mort, arg_min(los_days, i) AS y_los,
  coalesce(arg_min(race, i), 'nan') AS race, coalesce(arg_min(age_at_admit, i), 0.0) AS age
 FROM tr GROUP BY 1, 2)"""

LOS_CLS = ("CAST(CASE WHEN y_los >= 0 AND y_los < 3 THEN 0 WHEN y_los >= 3 AND y_los < 7 THEN 1 "
           "WHEN y_los >= 7 AND y_los < 14 THEN 2 ELSE 3 END AS INTEGER)")
REC_SELECT = (f"SELECT b.subject_id, b.hadm_id, t.text, CAST(y_mort AS INTEGER) AS y_mort, round(y_los, 9) AS y_los, "
              f"{LOS_CLS} AS y_los_cls, race, round(age, 9) AS age, n_dx FROM rec_base b JOIN txt t USING (subject_id, hadm_id)")

PROSE = r"""
, lines AS (
 SELECT *, CASE WHEN coalesce(vdx, vicd) IS NOT NULL THEN CAST(i AS VARCHAR) || '. ' || coalesce(vdx, vicd) ||
   CASE WHEN len(cats) > 0 THEN ' (CCSR: ' || array_to_string(list_slice(cats, 1, 2), ', ') || ')' ELSE '' END END AS line,
  'A ' || coalesce(gender, 'NA') || ' patient, ' || coalesce(CAST(age_at_admit AS VARCHAR), 'NA') || ' years old, ' ||
  'was admitted (' || coalesce(admission_type, 'NA') || ') via NA. Insurance: ' || coalesce(insurance, 'NA') ||
  '. Race: ' || coalesce(race, 'NA') || '. Diagnoses in order:' AS hdr
 FROM tr),
txt AS (
 SELECT subject_id, hadm_id, arg_min(hdr, i) || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY i), '1. NA') AS text
 FROM lines GROUP BY 1, 2)
"""

TOKENS = r"""
, toks AS (
 SELECT *, list_concat(CASE WHEN vdx IS NOT NULL THEN ['DX_' || replace(vdx, '.', '_')] ELSE []::VARCHAR[] END,
   list_transform(list_filter(list_slice(cats_all, 1, 2), lambda c: c <> ''), lambda c: 'CCSR_' || c)) AS tk,
  CASE WHEN vicd IS NOT NULL THEN 'ICD10_' || replace(vicd, '.', '_') END AS fb,
  '[AGE] ' || coalesce(CAST(age_at_admit AS VARCHAR), 'NA') || ' [SEX] ' || coalesce(gender, 'NA') || ' [RACE] ' ||
  coalesce(race, 'NA') || ' [INS] ' || coalesce(insurance, 'NA') || ' [ATYPE] ' || coalesce(admission_type, 'NA') ||
  ' [ALOC] NA ' AS hdr
 FROM tr),
txt AS (
 SELECT subject_id, hadm_id, arg_min(hdr, i) || ' [DXSEQ] ' ||
  array_to_string(CASE WHEN len(flatten(list(tk ORDER BY i))) > 0 THEN flatten(list(tk ORDER BY i))
   ELSE coalesce(list(fb ORDER BY i) FILTER (WHERE fb IS NOT NULL), []::VARCHAR[]) END, ' ') AS text
 FROM toks GROUP BY 1, 2)
"""

ORACLE["admission_text_prose"] = with_cohort(PROSE + REC_SELECT, *HCF, TEXT_ROWS)
ORACLE["admission_text_tokens"] = with_cohort(TOKENS + REC_SELECT, *HCF, TEXT_ROWS)

TEXT_SPLIT = rf"""
, recs AS ({REC_SELECT}),
rc AS (SELECT subject_id, race, count(*) AS c FROM recs GROUP BY 1, 2),
modal AS (SELECT subject_id, coalesce(arg_min(race, (-c, race)), 'UNKNOWN') AS race_subj FROM rc GROUP BY 1),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY race_subj ORDER BY u, subject_id) AS rk,
  count(*) OVER (PARTITION BY race_subj) AS n FROM (SELECT *, {md5_unit(42, 'subject_id')} AS u FROM modal) m),
assign AS (
 SELECT subject_id, race_subj, CASE WHEN n < 2 THEN 'train'
   WHEN rk <= floor(n * CAST(0.15 AS DOUBLE)) THEN 'test'
   WHEN rk <= floor(n * CAST(0.15 AS DOUBLE)) + floor((n - floor(n * CAST(0.15 AS DOUBLE))) * CAST({0.15 / 0.85!r} AS DOUBLE)) THEN 'val'
   ELSE 'train' END AS split FROM ranked),
sp AS (SELECT r.*, a.race_subj, a.split FROM recs r LEFT JOIN assign a USING (subject_id))
"""

ORACLE["text_split_counts"] = with_cohort(
    TOKENS + TEXT_SPLIT + "SELECT race_subj, split, count(DISTINCT subject_id) AS patients, count(*) AS admissions "
    "FROM sp GROUP BY 1, 2", *HCF, TEXT_ROWS)

ORACLE["text_token_top"] = with_cohort(
    TOKENS + TEXT_SPLIT + r"""
SELECT token, count(*) AS count FROM (
 SELECT unnest(string_split_regex(trim(text), '\s+')) AS token FROM sp WHERE split = 'train') w
WHERE starts_with(token, 'DX_') OR starts_with(token, 'CCSR_')
GROUP BY 1 ORDER BY count DESC, token LIMIT 3000""", *HCF, TEXT_ROWS)

ADM_SPLIT = rf"""
, adm AS (
 SELECT hadm_id, arg_min(subject_id, seq_num) AS subject_id, arg_min(hospital_expire_flag, seq_num) AS flag FROM feat GROUP BY 1),
asp AS (SELECT *, CASE WHEN {md5_unit(42, 'subject_id')} < 0.2 THEN 'test'
                       WHEN {md5_unit(7, 'subject_id')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM adm)
"""

ORACLE["grouped_split_counts"] = with_cohort(
    ADM_SPLIT + "SELECT split, count(DISTINCT subject_id) AS patients, count(*) AS admissions, "
    "CAST(sum(flag) AS BIGINT) AS deaths FROM asp GROUP BY 1", *HCF)

ORACLE["group_kfold_counts"] = with_cohort(
    ADM_SPLIT + f"SELECT CAST(floor({md5_unit(42, 'subject_id')} * 5) AS INTEGER) AS fold, "
    "count(DISTINCT subject_id) AS patients, count(*) AS admissions FROM asp GROUP BY 1", *HCF)

_FR = [0.1 + (1.0 - 0.1) * j / 5 for j in range(6)]
ORACLE["learning_curve_sizes"] = with_cohort(
    ADM_SPLIT + ", fr AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, CAST({f!r} AS DOUBLE))" for j, f in enumerate(_FR))
    + ") v(subset, fraction))\n"
    f"SELECT CAST(subset AS INTEGER) AS subset, round(fraction, 9) AS fraction, count(*) AS admissions "
    f"FROM asp JOIN fr ON {md5_unit(11, 'asp.subject_id')} < fr.fraction OR fr.fraction >= 1.0 "
    "WHERE split <> 'test' GROUP BY 1, 2", *HCF)

ORACLE["learning_curve_folds"] = with_cohort(
    ADM_SPLIT + ", fr AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, CAST({f!r} AS DOUBLE))" for j, f in enumerate(_FR)) + rf""") v(size, fraction)),
dev AS (SELECT subject_id, hadm_id FROM asp WHERE split <> 'test'),
who AS (SELECT subject_id, CAST(floor({md5_unit(5, 'subject_id')} * 5) AS INTEGER) AS fold FROM (SELECT DISTINCT subject_id FROM dev) d),
placed AS (SELECT subject_id, f.of_fold, row_number() OVER (PARTITION BY f.of_fold ORDER BY {md5_unit(11, 'subject_id')}, subject_id) AS r,
 count(*) OVER (PARTITION BY f.of_fold) AS n FROM who JOIN (SELECT CAST(range AS INTEGER) AS of_fold FROM range(0, 5)) f ON f.of_fold <> who.fold)
SELECT of_fold, CAST(size AS INTEGER) AS size, count(DISTINCT subject_id) AS patients, count(*) AS admissions
 FROM placed JOIN fr ON r <= ceil(fraction * n) JOIN dev USING (subject_id) GROUP BY 1, 2
UNION ALL SELECT fold, -1, count(DISTINCT subject_id), count(*) FROM who JOIN dev USING (subject_id) GROUP BY 1""", *HCF)

# ---- evaluation metrics ---------------------------------------------------------------
SCORE_VIEWS = ("ehr_admissions", "ehr_scores", "ehr_los_scores")


def with_scores(body: str, *chain: str) -> str:
    return with_cohort(body, *chain, views=SCORE_VIEWS)


def r9(x: str, name: str) -> str:
    return f"round({x}, 9) AS {name}"


# AUROC from average ranks (Mann-Whitney), AP from the step-wise sum
AUC_RANK = r"""
ranked AS (
 SELECT {g}y_true, y_prob, rank() OVER (PARTITION BY {gp} ORDER BY y_prob) + (count(*) OVER (PARTITION BY {gp}, y_prob) - 1) / 2.0 AS rk
 FROM ehr_scores),
auc AS (
 SELECT {g}sum(y_true) AS P, count(*) - sum(y_true) AS N, sum(CASE WHEN y_true = 1 THEN rk ELSE 0 END) AS rs FROM ranked GROUP BY {gb}),
st AS (
 SELECT {g}y_prob AS s, sum(y_true) AS pos, count(*) - sum(y_true) AS neg FROM ehr_scores GROUP BY {gb}y_prob),
cum AS (
 SELECT *, sum(pos) OVER (PARTITION BY {gp} ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY {gp} ORDER BY s DESC) AS fp FROM st),
ap AS (SELECT {g}sum(pos * tp / (tp + fp)) AS aps FROM cum GROUP BY {gb})
"""


def _auc_sql(by_race: bool) -> str:
    g = "race, " if by_race else ""
    gp = "race" if by_race else "1"
    gb = "race" if by_race else "ALL"
    gb2 = "race, " if by_race else ""
    body = AUC_RANK.format(g=g, gp=gp, gb=gb if by_race else "()", ).replace("GROUP BY ()y_prob", "GROUP BY y_prob")
    body = body.replace("GROUP BY racey_prob", "GROUP BY race, y_prob")
    join = "JOIN ap USING (race)" if by_race else "CROSS JOIN ap"
    return with_scores(
        "," + body + f"SELECT {g}CASE WHEN P > 0 AND N > 0 THEN round((rs - P * (P + 1) / 2.0) / (P * N), 9) END AS auroc, "
        f"CASE WHEN P > 0 AND N > 0 THEN round(aps / P, 9) END AS ap FROM auc {join}")


ORACLE["auroc_ap_overall"] = _auc_sql(False)
ORACLE["auroc_ap_by_race"] = _auc_sql(True)

ORACLE["roc_points_by_race"] = with_scores(r"""
, st AS (SELECT race, y_prob AS s, sum(y_true) AS pos, count(*) - sum(y_true) AS neg FROM ehr_scores GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY race ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY race ORDER BY s DESC) AS fp,
        sum(pos) OVER (PARTITION BY race) AS P, sum(neg) OVER (PARTITION BY race) AS N FROM st)
SELECT race, s AS threshold, round(CASE WHEN N > 0 THEN fp / N END, 9) AS fpr, round(CASE WHEN P > 0 THEN tp / P END, 9) AS tpr FROM cum
UNION ALL SELECT DISTINCT race, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM ehr_scores""")

ORACLE["pr_points"] = with_scores(r"""
, st AS (SELECT y_prob AS s, sum(y_true) AS pos, count(*) - sum(y_true) AS neg FROM ehr_scores GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
        sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM st)
SELECT s AS threshold, round(CASE WHEN P > 0 THEN tp / P ELSE 1.0 END, 9) AS recall, round(tp / (tp + fp), 9) AS precision,
 round(P / (P + N), 9) AS baseline FROM cum
UNION ALL SELECT NULL, 0.0, 1.0, round(sum(y_true) / count(*), 9) FROM ehr_scores""")

CONF = r"""
, c AS (
 SELECT {g}CAST(sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
  CAST(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
  CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp
 FROM (SELECT *, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM ehr_scores) s {gb})
"""
ORACLE["confusion_by_race"] = with_scores(CONF.format(g="race, ", gb="GROUP BY race") + r"""
SELECT race, tn, fp, fn, tp, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS tpr, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 9) AS fpr,
 round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy FROM c""")


def _report_sql(src: str, g: str, y: str, p: str) -> str:
    gsel = f"{g}, " if g else ""
    gby = f"GROUP BY {g}" if g else ""
    return rf"""
, src AS ({src}),
per AS (
 SELECT {gsel}cls, sum(support) AS support, sum(tp) AS tp, sum(pred_n) AS pred_n FROM (
  SELECT {gsel}{y} AS cls, CAST(1 AS DOUBLE) AS support, CAST(CASE WHEN {y} = {p} THEN 1 ELSE 0 END AS DOUBLE) AS tp, CAST(0 AS DOUBLE) AS pred_n FROM src
  UNION ALL SELECT {gsel}{p}, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM src) u GROUP BY {gsel}cls),
m AS (
 SELECT {gsel}CAST(cls AS VARCHAR) AS label, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN 2 * tp + (pred_n - tp) + (support - tp) > 0 THEN 2 * tp / (2 * tp + (pred_n - tp) + (support - tp)) ELSE 0 END AS f1,
  support FROM per)
SELECT {gsel}label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM m
UNION ALL SELECT {gsel}'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support) FROM m {gby}
UNION ALL SELECT {gsel}'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
 round(sum(f1 * support) / sum(support), 9), sum(support) FROM m {gby}"""


ORACLE["binary_class_report"] = with_scores(_report_sql(
    "SELECT y_true, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM ehr_scores", "", "y_true", "y_pred"))

LOS_TOP = ("SELECT *, greatest(p0, p1, p2, p3) AS conf, CAST(CASE WHEN p0 = greatest(p0, p1, p2, p3) THEN 0 "
           "WHEN p1 = greatest(p0, p1, p2, p3) THEN 1 WHEN p2 = greatest(p0, p1, p2, p3) THEN 2 ELSE 3 END AS INTEGER) AS pred_cls "
           "FROM ehr_los_scores")
ORACLE["los_class_report_by_race"] = with_scores(_report_sql(LOS_TOP, "race", "y_cls", "pred_cls"))

ORACLE["los_ovr_auroc_by_race"] = with_scores(r"""
, long AS (
 SELECT race, k, CASE WHEN y_cls = k THEN 1 ELSE 0 END AS t, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS p
 FROM ehr_los_scores CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(0, 4)) ks),
rk AS (SELECT *, rank() OVER (PARTITION BY race, k ORDER BY p) + (count(*) OVER (PARTITION BY race, k, p) - 1) / 2.0 AS r FROM long),
per AS (
 SELECT race, k, sum(t) AS P, count(*) - sum(t) AS N, sum(CASE WHEN t = 1 THEN r ELSE 0 END) AS rs FROM rk GROUP BY 1, 2),
auc AS (SELECT race, k, CASE WHEN P > 0 AND N > 0 THEN (rs - P * (P + 1) / 2.0) / (P * N) END AS a FROM per)
SELECT race, round(CASE WHEN count(a) = 4 THEN avg(a) END, 9) AS auroc_ovr_macro FROM auc GROUP BY race""")

ORACLE["regression_errors_by_race"] = with_scores(r"""
, src AS (SELECT race, CAST(y_cls AS DOUBLE) AS y, 0.0 * p0 + 1.0 * p1 + 2.0 * p2 + 3.0 * p3 AS yhat FROM ehr_los_scores),
mu AS (SELECT race, avg(y) AS ybar FROM src GROUP BY 1),
e AS (SELECT s.race, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, sum((yhat - y) * (yhat - y)) AS sse,
        sum((y - ybar) * (y - ybar)) AS sst FROM src s JOIN mu USING (race) GROUP BY 1)
SELECT race, round(mae, 9) AS mae, round(rmse, 9) AS rmse, round(CASE WHEN sst > 0 THEN 1 - sse / sst END, 9) AS r2 FROM e""")


def _bin(p: str, n: int = 10) -> str:
    step = 1.0 / n
    return "(" + " + ".join(f"CASE WHEN {p} >= {i} * CAST({step!r} AS DOUBLE) THEN 1 ELSE 0 END" for i in range(1, n)) + ")"


RELIABILITY = rf"""
, b AS (SELECT race, {_bin('y_prob')} AS bin, y_prob, y_true FROM ehr_scores),
agg AS (SELECT race, bin, count(*) AS count, avg(y_prob) AS mean_pred, avg(y_true) AS frac_pos FROM b GROUP BY 1, 2),
grid AS (SELECT DISTINCT race, CAST(g.range AS INTEGER) AS bin FROM ehr_scores CROSS JOIN range(0, 10) g),
rel AS (SELECT grid.race, grid.bin, coalesce(agg.count, 0) AS count, agg.mean_pred, agg.frac_pos FROM grid LEFT JOIN agg USING (race, bin))
"""
ORACLE["calibration_bins_by_race"] = with_scores(
    RELIABILITY + "SELECT race, bin, count, round(mean_pred, 9) AS mean_pred, round(frac_pos, 9) AS frac_pos FROM rel")
ORACLE["calibration_summary_by_race"] = with_scores(RELIABILITY + r"""
, e AS (SELECT race, sum(CASE WHEN count > 0 THEN abs(frac_pos - mean_pred) * count END) / sum(count) AS ece FROM rel GROUP BY 1),
br AS (SELECT race, count(*) AS n, avg((y_prob - y_true) * (y_prob - y_true)) AS brier FROM ehr_scores GROUP BY 1)
SELECT race, n, round(brier, 9) AS brier, round(ece, 9) AS ece FROM br JOIN e USING (race)""")

ORACLE["multiclass_calibration_by_race"] = with_scores(rf"""
, t AS (SELECT *, CAST(pred_cls = y_cls AS INTEGER) AS correct FROM ({LOS_TOP}) x),
b AS (SELECT race, {_bin('conf')} AS bin, conf, correct FROM t),
agg AS (SELECT race, bin, count(*) AS count, avg(conf) AS mp, avg(correct) AS fp FROM b GROUP BY 1, 2),
e AS (SELECT race, sum(abs(fp - mp) * count) / sum(count) AS ece_toplabel FROM agg GROUP BY 1),
br AS (SELECT race, count(*) AS n, avg(pow(p0 - CASE WHEN y_cls = 0 THEN 1 ELSE 0 END, 2) + pow(p1 - CASE WHEN y_cls = 1 THEN 1 ELSE 0 END, 2)
   + pow(p2 - CASE WHEN y_cls = 2 THEN 1 ELSE 0 END, 2) + pow(p3 - CASE WHEN y_cls = 3 THEN 1 ELSE 0 END, 2)) AS brier_mc
  FROM ehr_los_scores GROUP BY 1)
SELECT race, n, round(brier_mc, 9) AS brier_mc, round(ece_toplabel, 9) AS ece_toplabel FROM br JOIN e USING (race)""")


def _grid_sql(start: float, stop: float, num: int) -> str:
    step = (stop - start) / (num - 1)
    return (f"SELECT CASE WHEN range = {num - 1} THEN CAST({stop!r} AS DOUBLE) "
            f"ELSE CAST(range AS DOUBLE) * CAST({step!r} AS DOUBLE) + CAST({start!r} AS DOUBLE) END AS t FROM range(0, {num})")


def _grid_rates(start: float, stop: float, num: int, by_race: bool, pre: str = "") -> str:
    gsel = "race, " if by_race else ""
    rsel = f"{pre}gr.race, " if by_race else ""
    src = "(SELECT DISTINCT race FROM ehr_scores) r CROSS JOIN " if by_race else ""
    on = f"s.race = {pre}gr.race AND " if by_race else ""
    return rf"""
, {pre}grid AS ({_grid_sql(start, stop, num)}),
{pre}gr AS (SELECT {'r.race, ' if by_race else ''}{pre}grid.t FROM {src}{pre}grid),
{pre}cnt AS (
 SELECT {rsel}{pre}gr.t, CAST(count(s.y_true) FILTER (WHERE s.y_true = 1) AS DOUBLE) AS tp,
  CAST(count(s.y_true) FILTER (WHERE s.y_true = 0) AS DOUBLE) AS fp
 FROM {pre}gr LEFT JOIN ehr_scores s ON {on}s.y_prob >= {pre}gr.t GROUP BY {rsel}{pre}gr.t),
{pre}tot AS (SELECT {gsel}CAST(sum(y_true) AS DOUBLE) AS P FROM ehr_scores {'GROUP BY race' if by_race else ''}),
{pre}rates AS (
 SELECT {gsel}t, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN P > 0 THEN tp / P ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + (P - tp) > 0 THEN 2 * tp / (2 * tp + fp + (P - tp)) ELSE 0 END AS f1
 FROM {pre}cnt {f'JOIN {pre}tot USING (race)' if by_race else f'CROSS JOIN {pre}tot'})
"""


def _best_f1_sql(by_race: bool) -> str:
    g = "race, " if by_race else ""
    body = _grid_rates(0.001, 0.99, 1200, by_race) + (
        f"SELECT {g}round(arg_max(t, (f1, -t)), 9) AS threshold, round(max(f1), 9) AS f1, "
        f"round(arg_max(precision, (f1, -t)), 9) AS precision, round(arg_max(recall, (f1, -t)), 9) AS recall "
        f"FROM rates {'GROUP BY race' if by_race else ''}")
    return with_scores(body)


ORACLE["threshold_best_f1"] = _best_f1_sql(False)
ORACLE["threshold_best_f1_by_race"] = _best_f1_sql(True)
ORACLE["threshold_target_recall"] = with_scores(_grid_rates(0.999, 0.001, 2000, True) + r"""
, ok AS (SELECT race, max(t) FILTER (WHERE recall >= 0.7) AS tt FROM rates GROUP BY 1)
SELECT ok.race, round(ok.tt, 9) AS threshold, round(r.precision, 9) AS precision, round(r.recall, 9) AS recall, round(r.f1, 9) AS f1
FROM ok LEFT JOIN rates r ON r.race = ok.race AND r.t = ok.tt""")
ORACLE["threshold_target_precision"] = with_scores(_grid_rates(0.001, 0.999, 2000, True) + r"""
, ok AS (SELECT race, min(t) FILTER (WHERE precision >= 0.5) AS tt FROM rates GROUP BY 1)
SELECT ok.race, round(ok.tt, 9) AS threshold, round(r.precision, 9) AS precision, round(r.recall, 9) AS recall, round(r.f1, 9) AS f1
FROM ok LEFT JOIN rates r ON r.race = ok.race AND r.t = ok.tt""")

ORACLE["threshold_policy_precision"] = with_scores(
    _grid_rates(0.001, 0.99, 1200, True) + _grid_rates(0.001, 0.999, 2000, True, "p") + r"""
, f1b AS (SELECT race, arg_max(t, (f1, -t)) AS ft FROM rates GROUP BY 1),
pb AS (SELECT race, min(t) FILTER (WHERE precision >= 0.5) AS pt FROM prates GROUP BY 1)
SELECT f1b.race, round(coalesce(pt, ft), 9) AS threshold, CASE WHEN pt IS NOT NULL THEN 'precision' ELSE 'f1' END AS source
FROM f1b LEFT JOIN pb USING (race)""")

def _policy_rates(name: str, start: float, stop: float, num: int) -> str:
    """Rates of the tuned rows ``tuned`` (g, y_true, y_prob) at every threshold of a grid."""
    return rf"""
{name} AS (SELECT g, t, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN 2 * tp + fp + (P - tp) > 0 THEN 2 * tp / (2 * tp + fp + (P - tp)) ELSE 0 END AS f1
 FROM (SELECT gr.g, gr.t, CAST(count(*) FILTER (WHERE s.y_true = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE s.y_true = 0) AS DOUBLE) AS fp
  FROM (SELECT g, t FROM (SELECT DISTINCT g FROM tuned) x CROSS JOIN ({_grid_sql(start, stop, num)}) y) gr
  LEFT JOIN tuned s ON s.g = gr.g AND s.y_prob >= gr.t GROUP BY 1, 2) c
 JOIN (SELECT g, CAST(sum(y_true) AS DOUBLE) AS P FROM tuned GROUP BY 1) tot USING (g))"""


ORACLE["threshold_val_to_test"] = with_scores(rf"""
, sp AS (SELECT *, CASE WHEN race IN ('NATION_7', 'NATION_14', 'NATION_21') THEN '?' ELSE race END AS g,
 CASE WHEN {md5_unit(42, 'subject_id')} < 0.3 THEN 'test' WHEN {md5_unit(7, 'subject_id')} < 0.4 THEN 'val' ELSE 'train' END AS split FROM ehr_scores),
tuned AS (SELECT g, y_true, y_prob FROM sp WHERE split = 'val' UNION ALL SELECT '*', y_true, y_prob FROM sp WHERE split = 'val'),
{_policy_rates('fr', 0.001, 0.99, 1200)},
{_policy_rates('pr', 0.001, 0.999, 2000)},
thr AS (SELECT g, coalesce(pt, ft) AS threshold, CASE WHEN pt IS NOT NULL THEN 'precision' ELSE 'f1' END AS source
 FROM (SELECT g, arg_max(t, (f1, -t)) AS ft FROM fr GROUP BY 1) a JOIN (SELECT g, min(t) FILTER (WHERE precision >= 0.5) AS pt FROM pr GROUP BY 1) b USING (g)),
own AS (SELECT * FROM thr WHERE g IN (SELECT g FROM tuned GROUP BY g HAVING count(*) >= 40 AND sum(y_true) >= 8) AND g <> '*'),
used AS (SELECT s.g, s.y_true, coalesce(o.threshold, a.threshold) AS threshold, coalesce(o.source, 'overall') AS source,
 s.y_prob >= coalesce(o.threshold, a.threshold) AS hit FROM sp s LEFT JOIN own o USING (g) CROSS JOIN (SELECT threshold FROM thr WHERE g = '*') a WHERE split = 'test'),
c AS (SELECT g, any_value(threshold) AS threshold, any_value(source) AS source, CAST(count(*) FILTER (WHERE y_true = 0 AND NOT hit) AS DOUBLE) AS tn,
 CAST(count(*) FILTER (WHERE y_true = 0 AND hit) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE y_true = 1 AND NOT hit) AS DOUBLE) AS fn,
 CAST(count(*) FILTER (WHERE y_true = 1 AND hit) AS DOUBLE) AS tp FROM used GROUP BY 1)
SELECT nullif(g, '?') AS race, round(threshold, 9) AS threshold, source, tn, fp, fn, tp,
 round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS tpr, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 9) AS fpr,
 round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy FROM c""")

ORACLE["threshold_observed_min_pos"] = with_scores(r"""
, st AS (SELECT race, y_prob AS s, sum(y_true) AS pos, count(*) - sum(y_true) AS neg FROM ehr_scores GROUP BY 1, 2),
cum AS (SELECT *, CAST(sum(pos) OVER (PARTITION BY race ORDER BY s DESC) AS DOUBLE) AS tp,
        CAST(sum(neg) OVER (PARTITION BY race ORDER BY s DESC) AS DOUBLE) AS fp,
        CAST(sum(pos) OVER (PARTITION BY race) AS DOUBLE) AS P FROM st),
m AS (SELECT race, s, tp + fp >= 10 AS ok,
  CASE WHEN 2 * tp + fp + (P - tp) > 0 THEN 2 * tp / (2 * tp + fp + (P - tp)) ELSE 0 END AS f1,
  2 * (tp / (tp + fp)) * (CASE WHEN P > 0 THEN tp / P ELSE 1.0 END) / ((tp / (tp + fp)) + (CASE WHEN P > 0 THEN tp / P ELSE 1.0 END) + 1e-12) AS sf1
 FROM cum),
b AS (SELECT race, arg_max(s, (f1, -s)) FILTER (WHERE ok) AS bt, arg_max(s, (sf1, -s)) AS ft FROM m GROUP BY 1)
SELECT race, round(coalesce(bt, ft, 0.5), 9) AS threshold, CASE WHEN bt IS NOT NULL THEN 'min_pos' ELSE 'fallback' END AS source FROM b""")

ORACLE["score_losses_by_race"] = with_scores(r"""
, c AS (SELECT race, y_true, least(greatest(y_prob, 1e-7), 1 - 1e-7) AS p FROM ehr_scores),
t AS (SELECT race, CASE WHEN y_true = 1 THEN p ELSE 1 - p END AS pt, CASE WHEN y_true = 1 THEN 0.25 ELSE 0.75 END AS a_t FROM c)
SELECT race, round(avg(-ln(pt)), 9) AS log_loss, round(avg(-a_t * pow(1 - pt, 2.0) * ln(pt)), 9) AS focal_loss FROM t GROUP BY 1""")

ORACLE["class_balance_by_race"] = with_scores(r"""
, c AS (SELECT race, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS pos FROM ehr_scores GROUP BY 1)
SELECT race, n, pos, n - pos AS neg, round(pos / n, 9) AS prevalence, round((n - pos) / greatest(1, pos), 9) AS imbalance_ratio,
 round(CASE WHEN pos > 0 THEN n / (2.0 * pos) END, 9) AS w_pos_balanced, round(CASE WHEN n - pos > 0 THEN n / (2.0 * (n - pos)) END, 9) AS w_neg_balanced,
 round(CASE WHEN pos > 0 THEN 1.0 / pos END, 9) AS w_pos_inverse, round(CASE WHEN n - pos > 0 THEN 1.0 / (n - pos) END, 9) AS w_neg_inverse
FROM c""")

# ---- weighted metric SQL builders (bootstrap / fairness oracles) ----------------------
from ..operators.bootstrap import FMIX_STAGES, MIX_MASK, MIX_STEP, POISSON1_CDF, fmix31  # noqa: E402


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= {c!r} THEN 1 ELSE 0 END" for c in POISSON1_CDF) + ")"


def rep_unit(seed: int, b: str, key: str) -> str:
    return (f"(CAST('0x' || substr(md5('{seed}:' || CAST({b} AS VARCHAR) || ':' || CAST({key} AS VARCHAR)), 1, 8) "
            f"AS BIGINT) / 4294967296.0)")


def fmix_sql(src: str, col: str) -> str:
    """The 31-bit finaliser on ``col`` of ``src``, one subquery per stage."""
    for op, v in FMIX_STAGES:
        e = f"xor({col}, {col} >> {v})" if op == "xor" else f"(({col} * {v}) & {MIX_MASK})"
        src = f"SELECT * REPLACE ({e} AS {col}) FROM ({src}) f"
    return src


def reps_sql(src: str, n_boot: int, seed: int = 42, key: str = "hadm_id") -> str:
    """Rows x replicates with Poisson(1) weight > 0 (the "mix" hash)."""
    k = (f"SELECT *, xor(CAST({fmix31(seed & MIX_MASK)} AS BIGINT), CAST({key} AS BIGINT) & {MIX_MASK}) AS _k1 "
         f"FROM ({src}) s")
    k = fmix_sql(k, "_k1")
    k = f"SELECT * REPLACE (xor(_k1, (CAST({key} AS BIGINT) >> 31) & {MIX_MASK}) AS _k1) FROM ({k}) s"
    k = fmix_sql(k, "_k1")
    h = (f"SELECT s.*, CAST(b.range AS INTEGER) AS replicate, (s._k1 + b.range * {MIX_STEP}) & {MIX_MASK} AS _h "
         f"FROM ({k}) s CROSS JOIN range(1, {n_boot + 1}) b")
    h = fmix_sql(h, "_h")
    return (f"SELECT * EXCLUDE (_k1, _h) FROM (SELECT *, CAST({poisson_sql('(_h / 2147483648.0)')} AS DOUBLE) AS w "
            f"FROM ({h}) x) y WHERE w > 0")


def reps_hash_sql(src: str, n: int = 64, seed: int = 42, key: str = "hadm_id") -> str:
    """Rows x (1..n) with the "mix" hash as ``_u`` in [0, 1)."""
    rows = reps_sql(src, n, seed, key)
    inner = rows[rows.index("FROM (SELECT *, CAST(") + 6:rows.rindex(") y WHERE")]
    return f"SELECT * EXCLUDE (_k1, _h, w), _h / 2147483648.0 AS _u FROM ({inner}) y"


def gl(g) -> tuple[str, str, str]:
    """(select prefix, partition list, group-by list) for group columns ``g``."""
    if not g:
        return "", "1", "ALL"
    return ", ".join(g) + ", ", ", ".join(g), ", ".join(g)


def auc_sql(src: str, g, w: str = "w") -> str:
    """(g..., auroc, ap) from src(g..., y_true, y_prob, w)."""
    sel, part, gb = gl(g)
    return f"""SELECT {sel}CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - fp + 0.5 * neg)) / (max(P) * max(N)) END AS auroc,
 CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * tp / (tp + fp)) / max(P) END AS ap FROM (
 SELECT *, sum(pos) OVER (PARTITION BY {part} ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY {part} ORDER BY s DESC) AS fp,
  sum(pos) OVER (PARTITION BY {part}) AS P, sum(neg) OVER (PARTITION BY {part}) AS N FROM (
  SELECT {sel}y_prob AS s, sum({w} * y_true) AS pos, sum({w} * (1 - y_true)) AS neg FROM ({src}) q GROUP BY {sel}y_prob) a) c
 GROUP BY {gb}"""


def conf_sql(src: str, g, w: str = "w") -> str:
    """(g..., precision, recall, f1, tpr, fpr) of y_pred."""
    sel, _, gb = gl(g)
    return f"""SELECT {sel}CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS tpr, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr FROM (
 SELECT {sel}sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN {w} ELSE 0 END) AS tp, sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN {w} ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN {w} ELSE 0 END) AS fn, sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN {w} ELSE 0 END) AS tn
 FROM ({src}) q GROUP BY {gb}) c"""


def macro_f1_sql(src: str, g, w: str = "w") -> str:
    """(g..., los_macro_f1) over the union of true and predicted classes."""
    sel, _, gb = gl(g)
    return f"""SELECT {sel}avg(CASE WHEN 2 * tp + (pn - tp) + (sp - tp) > 0 THEN 2 * tp / (2 * tp + (pn - tp) + (sp - tp)) ELSE 0 END) AS los_macro_f1
 FROM (SELECT {sel}cls, sum(sp) AS sp, sum(tp) AS tp, sum(pn) AS pn FROM (
  SELECT {sel}y_cls AS cls, {w} AS sp, CASE WHEN y_cls = pred_cls THEN {w} ELSE 0 END AS tp, 0 AS pn FROM ({src}) q
  UNION ALL SELECT {sel}pred_cls, 0, 0, {w} FROM ({src}) q2) u GROUP BY {sel}cls) c GROUP BY {gb}"""


def ovr_sql(src: str, g, w: str = "w") -> str:
    """(g..., los_auroc) = mean one-vs-rest AUROC, NULL when a class is degenerate."""
    sel, _, gb = gl(g)
    long = (f"SELECT {sel}k, CASE WHEN y_cls = k THEN 1 ELSE 0 END AS y_true, "
            f"CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS y_prob, {w} AS w "
            f"FROM ({src}) q CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(0, 4)) ks")
    per = auc_sql(long, list(g) + ["k"])
    return f"SELECT {sel}CASE WHEN count(auroc) = 4 THEN avg(auroc) END AS los_auroc FROM ({per}) a GROUP BY {gb}"


def ci_sql(vals: str, g, col: str, min_valid: int = 1) -> str:
    """(g..., lo, hi, n_valid) percentile interval of ``col`` over replicates."""
    sel, _, gb = gl(g)
    return (f"SELECT {sel}CASE WHEN count(*) >= {min_valid} THEN quantile_cont({col}, 0.025) END AS lo, "
            f"CASE WHEN count(*) >= {min_valid} THEN quantile_cont({col}, 0.975) END AS hi, count(*) AS n_valid "
            f"FROM ({vals}) v WHERE {col} IS NOT NULL AND NOT isnan({col}) GROUP BY {gb}")


SCORED_PRED = "SELECT *, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM ehr_scores"
LOS_TOP_SQL = ("SELECT hadm_id, y_cls, p0, p1, p2, p3, greatest(p0, p1, p2, p3) AS conf, "
               "CAST(CASE WHEN p0 = greatest(p0, p1, p2, p3) THEN 0 WHEN p1 = greatest(p0, p1, p2, p3) THEN 1 "
               "WHEN p2 = greatest(p0, p1, p2, p3) THEN 2 ELSE 3 END AS INTEGER) AS pred_cls FROM ehr_los_scores")
BOTH_SQL = f"SELECT m.*, l.y_cls, l.p0, l.p1, l.p2, l.p3, l.pred_cls FROM ({SCORED_PRED}) m JOIN ({LOS_TOP_SQL}) l USING (hadm_id)"

ONE = "CAST(1 AS DOUBLE) AS w"


def _boot_overall(metrics, stratified: bool = False) -> str:
    w = "w2" if stratified else "w"
    pre = rf"""
, src AS ({SCORED_PRED}),
reps AS ({reps_sql('SELECT * FROM src', 2000)}),
"""
    if stratified:
        pre += r"""rw AS (
 SELECT r.*, r.w * o.n_c / d.w_c AS w2 FROM reps r
 JOIN (SELECT replicate, y_true, sum(w) AS w_c FROM reps GROUP BY 1, 2) d USING (replicate, y_true)
 JOIN (SELECT y_true, count(*) AS n_c FROM src GROUP BY 1) o USING (y_true)),
"""
    rsrc = "SELECT * FROM rw" if stratified else "SELECT * FROM reps"
    pre += rf"""pa AS ({auc_sql(f'SELECT *, {ONE} FROM src', [])}),
pc AS ({conf_sql(f'SELECT *, {ONE} FROM src', [])}),
ra AS ({auc_sql(rsrc, ['replicate'], w)}),
rc AS ({conf_sql(rsrc, ['replicate'], w)})
"""
    parts = []
    for m in metrics:
        pt, rv = ("pa", "ra") if m in ("auroc", "ap") else ("pc", "rc")
        parts.append(f"SELECT '{m}' AS metric, round(p.{m}, 9) AS point, round(c.lo, 9) AS lo, round(c.hi, 9) AS hi, "
                     f"c.n_valid FROM {pt} p CROSS JOIN ({ci_sql(f'SELECT * FROM {rv}', [], m)}) c")
    return pre, "\nUNION ALL ".join(parts)


_p, _b = _boot_overall(["auroc", "ap", "f1"])
ORACLE["bootstrap_ci_overall"] = with_scores(_p + _b)
ORACLE["metric_ci_table"] = with_scores(
    _p + ", ci AS (" + _b + ")\nSELECT metric, point, lo, hi, round(point - lo, 9) AS err_low, round(hi - point, 9) AS err_high FROM ci")
_p, _b = _boot_overall(["auroc", "f1"], stratified=True)
ORACLE["bootstrap_ci_stratified"] = with_scores(_p + _b)


def _boot_grouped(metrics, g: str, n_boot: int) -> str:
    """Per-group points and percentile CIs from one replicate table (left join: a
    group without a valid replicate keeps its point with NULL bounds)."""
    pre = rf"""
, src AS ({SCORED_PRED}),
reps AS ({reps_sql('SELECT * FROM src', n_boot)}),
pa AS ({auc_sql(f'SELECT *, {ONE} FROM src', [g])}),
pc AS ({conf_sql(f'SELECT *, {ONE} FROM src', [g])}),
ra AS ({auc_sql('SELECT * FROM reps', [g, 'replicate'])}),
rc AS ({conf_sql('SELECT * FROM reps', [g, 'replicate'])})
"""
    parts = []
    for m in metrics:
        pt, rv = ("pa", "ra") if m in ("auroc", "ap") else ("pc", "rc")
        parts.append(f"SELECT p.{g}, '{m}' AS metric, round(p.{m}, 9) AS point, round(c.lo, 9) AS lo, "
                     f"round(c.hi, 9) AS hi, c.n_valid FROM {pt} p LEFT JOIN "
                     f"({ci_sql(f'SELECT * FROM {rv}', [g], m)}) c ON p.{g} = c.{g}")
    return pre + "\nUNION ALL ".join(parts)


ORACLE["bootstrap_ci_b2000"] = with_scores(_boot_grouped(["auroc", "ap", "f1"], "race", 2000))

ORACLE["subgroup_report"] = with_scores(rf"""
, b0 AS (SELECT *, coalesce(CASE WHEN CAST(race AS VARCHAR) <> '' THEN CAST(race AS VARCHAR) END, 'Unknown') AS cat FROM ({SCORED_PRED}) s),
base AS (SELECT b0.* EXCLUDE (race, cat), CASE WHEN c.cnt < 50 THEN 'Other' ELSE b0.cat END AS race
 FROM b0 JOIN (SELECT cat, count(*) AS cnt FROM b0 GROUP BY 1) c USING (cat)),
sizes AS (SELECT race, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS positives FROM base GROUP BY 1),
data AS (SELECT * FROM base WHERE race IN (SELECT race FROM sizes WHERE n >= 50)),
pa AS ({auc_sql(f'SELECT *, {ONE} FROM data', ['race'])}),
pc AS ({conf_sql(f'SELECT *, {ONE} FROM data', ['race'])}),
reps AS ({reps_sql('SELECT * FROM data', 2000)}),
ra AS ({auc_sql('SELECT * FROM reps', ['race', 'replicate'])}),
rc AS ({conf_sql('SELECT * FROM reps', ['race', 'replicate'])}),
bo AS (SELECT ra.race, ra.replicate, ra.auroc, rc.f1 FROM ra JOIN rc USING (race, replicate) WHERE ra.auroc IS NOT NULL),
ca AS ({ci_sql('SELECT * FROM bo', ['race'], 'auroc', 50)}),
cf AS ({ci_sql('SELECT * FROM bo', ['race'], 'f1', 50)})
SELECT s.race, s.n, s.positives, round(s.positives / s.n, 9) AS prevalence,
 round(CASE WHEN s.positives >= 10 AND s.n - s.positives >= 1 THEN pa.auroc END, 9) AS auroc,
 round(CASE WHEN s.positives >= 10 AND s.n - s.positives >= 1 THEN pa.ap END, 9) AS auprc,
 round(pc.precision, 9) AS precision, round(pc.recall, 9) AS recall, round(pc.f1, 9) AS f1,
 round(CASE WHEN s.positives >= 10 AND s.n - s.positives >= 1 THEN ca.lo END, 9) AS auroc_lo,
 round(CASE WHEN s.positives >= 10 AND s.n - s.positives >= 1 THEN ca.hi END, 9) AS auroc_hi,
 round(CASE WHEN s.positives >= 10 AND s.n - s.positives >= 1 THEN cf.lo END, 9) AS f1_lo,
 round(CASE WHEN s.positives >= 10 AND s.n - s.positives >= 1 THEN cf.hi END, 9) AS f1_hi
FROM sizes s JOIN pa USING (race) JOIN pc USING (race) LEFT JOIN ca USING (race) LEFT JOIN cf USING (race) WHERE s.n >= 50""")

ORACLE["subgroup_metrics_nomin"] = with_scores(rf"""
, src AS (SELECT *, {ONE} FROM ({SCORED_PRED}) s),
pa AS ({auc_sql('SELECT * FROM src', ['race'])}),
pc AS ({conf_sql('SELECT * FROM src', ['race'])})
SELECT race, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS pos, round(any_value(pa.auroc), 9) AS auroc,
 round(any_value(pa.ap), 9) AS auprc, round(any_value(pc.precision), 9) AS precision, round(any_value(pc.recall), 9) AS recall,
 round(any_value(pc.f1), 9) AS f1
FROM src JOIN pa USING (race) JOIN pc USING (race) GROUP BY race""")

_BT = ["auroc", "ap", "f1", "los_macro_f1", "los_auroc"]
_BT_NAMES = {"auroc": "mort_auc", "ap": "mort_ap", "f1": "mort_f1", "los_macro_f1": "los_f1", "los_auroc": "los_auc"}


def _rep_metric(src: str, g, m: str, w: str = "w") -> str:
    if m in ("auroc", "ap"):
        return f"SELECT {', '.join(g)}, {m} AS value FROM ({auc_sql(src, g, w)}) a"
    if m in ("f1", "precision", "recall", "tpr", "fpr"):
        return f"SELECT {', '.join(g)}, {m} AS value FROM ({conf_sql(src, g, w)}) a"
    if m == "los_macro_f1":
        return f"SELECT {', '.join(g)}, los_macro_f1 AS value FROM ({macro_f1_sql(src, g, w)}) a"
    return f"SELECT {', '.join(g)}, los_auroc AS value FROM ({ovr_sql(src, g, w)}) a"


def _both_tasks_sql() -> str:
    ctes = [f"src AS ({BOTH_SQL})", f"reps AS ({reps_sql('SELECT * FROM src', 2000)})",
            f"pa AS ({auc_sql(f'SELECT *, {ONE} FROM src', ['race'])})",
            f"pc AS ({conf_sql(f'SELECT *, {ONE} FROM src', ['race'])})",
            f"pf AS ({macro_f1_sql(f'SELECT *, {ONE} FROM src', ['race'])})",
            f"po AS ({ovr_sql(f'SELECT *, {ONE} FROM src', ['race'])})",
            "sz AS (SELECT race, count(*) AS n, avg(CAST(y_true AS DOUBLE)) AS mort_rate FROM src GROUP BY 1)"]
    sel = []
    for m in _BT:
        ctes.append(f"ci_{m} AS ({ci_sql(_rep_metric('SELECT * FROM reps', ['race', 'replicate'], m), ['race'], 'value')})")
        nm = _BT_NAMES[m]
        sel += [f"round(CASE WHEN n >= 50 THEN ci_{m}.lo END, 9) AS {nm}_lo", f"round(CASE WHEN n >= 50 THEN ci_{m}.hi END, 9) AS {nm}_hi"]
    joins = " ".join(f"LEFT JOIN ci_{m} USING (race)" for m in _BT)
    return (", " + ",\n".join(ctes) + "\nSELECT race, n, round(mort_rate, 9) AS mort_rate, round(pa.auroc, 9) AS mort_auc, "
            "round(pa.ap, 9) AS mort_ap, round(pc.f1, 9) AS mort_f1, round(pc.precision, 9) AS mort_precision, "
            "round(pc.recall, 9) AS mort_recall, round(pc.tpr, 9) AS mort_tpr, round(pc.fpr, 9) AS mort_fpr, "
            "round(pf.los_macro_f1, 9) AS los_macro_f1, round(po.los_auroc, 9) AS los_auc, " + ", ".join(sel) +
            " FROM sz JOIN pa USING (race) JOIN pc USING (race) JOIN pf USING (race) JOIN po USING (race) " + joins)


ORACLE["subgroup_both_tasks"] = with_scores(_both_tasks_sql())

REG_SRC = ("SELECT hadm_id, race, CAST(y_cls AS DOUBLE) AS y, 0.0 * p0 + 1.0 * p1 + 2.0 * p2 + 3.0 * p3 AS yhat "
           "FROM ehr_los_scores")


def _reg_sql(src: str, g, w: str = "w") -> str:
    sel, _, gb = gl(g)
    return (f"SELECT {sel}sum({w} * abs(yhat - y)) / sum({w}) AS mae, sqrt(sum({w} * (yhat - y) * (yhat - y)) / sum({w})) AS rmse "
            f"FROM ({src}) q GROUP BY {gb}")


ORACLE["subgroup_regression"] = with_scores(rf"""
, base AS ({REG_SRC}),
sz AS (SELECT race, count(*) AS n FROM base GROUP BY 1),
data AS (SELECT * FROM base WHERE race IN (SELECT race FROM sz WHERE n >= 50)),
mu AS (SELECT race, avg(y) AS ybar FROM data GROUP BY 1),
pe AS (SELECT d.race, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, sum((yhat - y) * (yhat - y)) AS sse,
       sum((y - ybar) * (y - ybar)) AS sst FROM data d JOIN mu USING (race) GROUP BY 1),
reps AS ({reps_sql('SELECT * FROM data', 2000)}),
rr AS ({_reg_sql('SELECT * FROM reps', ['race', 'replicate'])}),
cm AS ({ci_sql('SELECT * FROM rr', ['race'], 'mae')}),
cr AS ({ci_sql('SELECT * FROM rr', ['race'], 'rmse')})
SELECT race, n, round(pe.mae, 9) AS mae, round(pe.rmse, 9) AS rmse, round(CASE WHEN sst > 0 THEN 1 - sse / sst END, 9) AS r2,
 round(cm.lo, 9) AS mae_lo, round(cm.hi, 9) AS mae_hi, round(cr.lo, 9) AS rmse_lo, round(cr.hi, 9) AS rmse_hi
FROM sz JOIN pe USING (race) LEFT JOIN cm USING (race) LEFT JOIN cr USING (race) WHERE n >= 50""")


def _gaps_sql(metrics) -> str:
    ctes = [f"src AS ({BOTH_SQL})",
            "el AS (SELECT * FROM src WHERE race IN (SELECT race FROM src GROUP BY race HAVING count(*) >= 25))",
            f"reps AS ({reps_sql('SELECT * FROM el', 2000)})"]
    outs = []
    for m in metrics:
        pv = _rep_metric(f"SELECT *, {ONE} FROM el", ["race"], m)
        rv = _rep_metric("SELECT * FROM reps", ["race", "replicate"], m)
        ctes.append(f"pg_{m} AS (SELECT CASE WHEN count(value) FILTER (WHERE NOT isnan(value)) >= 2 THEN max(value) - min(value) END AS point "
                    f"FROM ({pv}) p WHERE value IS NOT NULL AND NOT isnan(value))")
        ctes.append(f"rg_{m} AS (SELECT replicate, CASE WHEN count(value) >= 2 THEN max(value) - min(value) END AS value "
                    f"FROM ({rv}) r WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY replicate)")
        ctes.append(f"cg_{m} AS ({ci_sql(f'SELECT * FROM rg_{m}', [], 'value')})")
        outs.append(f"SELECT '{m}' AS metric, round(pg_{m}.point, 9) AS point, round(cg_{m}.lo, 9) AS lo, "
                    f"round(cg_{m}.hi, 9) AS hi, cg_{m}.n_valid FROM pg_{m} LEFT JOIN cg_{m} ON TRUE")
    return ", " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(outs)


ORACLE["disparity_gaps"] = with_scores(_gaps_sql(["auroc", "ap", "f1", "los_macro_f1", "los_auroc", "tpr", "fpr"]))

ORACLE["roc_by_race_supported"] = with_scores(r"""
, ok AS (SELECT race FROM ehr_scores GROUP BY race HAVING count(*) >= 50 AND sum(y_true) >= 10 AND count(*) - sum(y_true) >= 1),
d AS (SELECT * FROM ehr_scores WHERE race IN (SELECT race FROM ok)),
st AS (SELECT race, y_prob AS s, sum(y_true) AS pos, count(*) - sum(y_true) AS neg FROM d GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY race ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY race ORDER BY s DESC) AS fp,
        sum(pos) OVER (PARTITION BY race) AS P, sum(neg) OVER (PARTITION BY race) AS N FROM st)
SELECT race, s AS threshold, round(CASE WHEN N > 0 THEN fp / N END, 9) AS fpr, round(CASE WHEN P > 0 THEN tp / P END, 9) AS tpr FROM cum
UNION ALL SELECT DISTINCT race, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM d""")

TWO_MODELS = (f"SELECT *, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM (SELECT 'score' AS model, hadm_id, y_true, y_prob FROM ehr_scores "
              f"UNION ALL SELECT 'coarse', hadm_id, y_true, floor(y_prob * 10) / 10 FROM ehr_scores) u")

ORACLE["model_compare_roc"] = with_scores(rf"""
, d AS ({TWO_MODELS}),
st AS (SELECT model, y_prob AS s, sum(y_true) AS pos, count(*) - sum(y_true) AS neg FROM d GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY model ORDER BY s DESC) AS fp,
        sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM st)
SELECT model, round(s, 9) AS threshold, round(CASE WHEN N > 0 THEN fp / N END, 9) AS fpr, round(CASE WHEN P > 0 THEN tp / P END, 9) AS tpr FROM cum
UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM d""")

ORACLE["metric_bundle"] = with_scores(rf"""
, d AS (SELECT m.*, l.y_cls, l.p0, l.p1, l.p2, l.p3, l.pred_cls, {ONE} FROM ({TWO_MODELS}) m JOIN ({LOS_TOP_SQL}) l USING (hadm_id)),
pa AS ({auc_sql('SELECT * FROM d', ['model'])}),
pc AS ({conf_sql('SELECT * FROM d', ['model'])}),
pf AS ({macro_f1_sql('SELECT * FROM d', ['model'])}),
po AS ({ovr_sql('SELECT * FROM d', ['model'])}),
ex AS (SELECT model, avg(pow(p0 - CASE WHEN y_cls = 0 THEN 1 ELSE 0 END, 2) + pow(p1 - CASE WHEN y_cls = 1 THEN 1 ELSE 0 END, 2)
   + pow(p2 - CASE WHEN y_cls = 2 THEN 1 ELSE 0 END, 2) + pow(p3 - CASE WHEN y_cls = 3 THEN 1 ELSE 0 END, 2)) AS brier_multiclass,
  avg(abs(p1 + 2.0 * p2 + 3.0 * p3 - y_cls)) AS mae, sqrt(avg(pow(p1 + 2.0 * p2 + 3.0 * p3 - y_cls, 2))) AS rmse,
  (sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END)) / count(*) AS accuracy FROM d GROUP BY 1)
SELECT model, round(pa.auroc, 9) AS auroc, round(pa.ap, 9) AS ap, round(pc.precision, 9) AS precision, round(pc.recall, 9) AS recall,
 round(pc.f1, 9) AS f1, round(ex.accuracy, 9) AS accuracy, round(pf.los_macro_f1, 9) AS los_macro_f1, round(po.los_auroc, 9) AS los_auc,
 round(ex.brier_multiclass, 9) AS brier_multiclass, round(ex.mae, 9) AS mae, round(ex.rmse, 9) AS rmse
FROM pa JOIN pc USING (model) JOIN pf USING (model) JOIN po USING (model) JOIN ex USING (model)""")

ORACLE["balanced_resample_counts"] = with_scores(rf"""
, c AS (SELECT y_true, count(*) AS n_c FROM ehr_scores GROUP BY 1),
r AS (SELECT c.y_true, k.n / (k.k * c.n_c) AS rate FROM c CROSS JOIN (SELECT count(*) AS k, sum(n_c) AS n FROM c) k),
p AS (SELECT y_true, CAST(ceil(rate / 64.0) AS INTEGER) AS parts, rate / ceil(rate / 64.0) AS rate FROM r),
b AS (SELECT y_true, parts, list(upto ORDER BY k) AS bounds FROM (
 SELECT y_true, parts, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY y_true ORDER BY k) AS upto FROM p CROSS JOIN (SELECT range AS k FROM range(0, 192)) t) x
 GROUP BY 1, 2),
u AS ({reps_hash_sql('SELECT hadm_id, y_true FROM ehr_scores')}),
d AS (SELECT u.y_true, u.hadm_id, len(list_filter(b.bounds, lambda c: u._u >= c)) AS copies FROM u JOIN b ON b.y_true = u.y_true AND u.replicate <= b.parts)
SELECT y_true, CAST(sum(copies) AS BIGINT) AS rows, count(DISTINCT hadm_id) FILTER (WHERE copies > 0) AS drawn, CAST(max(copies) AS INTEGER) AS most,
 CAST(sum(hadm_id * copies) AS BIGINT) AS ids FROM d GROUP BY 1""")

# ---- model inputs -----------------------------------------------------------------
MATRIX_COLS = ("adm_day", "adm_hour", "adm_month", "adm_weekday", "adm_weekend", "adm_year", "admission_type_code",
               "age_at_admit", "anchor_age", "anchor_year", "gender_code", "icd_version", "n_ccsr", "n_ccsr_unique",
               "n_dx_rows", "race_code", "seq_num")
_FIRST = [c for c in MATRIX_COLS if c not in ("n_ccsr_unique", "n_dx_rows", "seq_num")]
# one row per admission: numeric columns, both targets and the split
ALL_MATRIX = (", mat AS (SELECT hadm_id, arg_min(subject_id, seq_num) AS subject_id, "
              "CAST(arg_min(hospital_expire_flag, seq_num) FILTER (WHERE hospital_expire_flag IS NOT NULL) AS INTEGER) AS y_cls, "
              "arg_min(los_days, seq_num) FILTER (WHERE los_days IS NOT NULL) AS y_reg, " +
              ", ".join(f"CAST(arg_min({c}, seq_num) FILTER (WHERE {c} IS NOT NULL) AS DOUBLE) AS {c}" for c in _FIRST) +
              ", CAST(min(seq_num) AS DOUBLE) AS seq_num, CAST(count(*) AS DOUBLE) AS n_dx_rows FROM feat GROUP BY hadm_id),\n"
              "un AS (SELECT hadm_id, CAST(count(DISTINCT ccsr_category) AS DOUBLE) AS k FROM row_cats GROUP BY 1),\n"
              "matrix AS (SELECT m.*, coalesce(un.k, 0) AS n_ccsr_unique, "
              f"CASE WHEN {md5_unit(42, 'm.subject_id')} < 0.2 THEN 'test' WHEN {md5_unit(7, 'm.subject_id')} < 0.2 THEN 'val' "
              "ELSE 'train' END AS split FROM mat m LEFT JOIN un USING (hadm_id))\n")
DEV_MATRIX = ALL_MATRIX + ", dev AS (SELECT * FROM matrix WHERE split = 'train')\n"
ORACLE["median_impute_params"] = with_cohort(
    DEV_MATRIX + "SELECT " + ", ".join(f"round(quantile_cont({c}, 0.5), 9) AS {c}__median" for c in MATRIX_COLS) + " FROM dev",
    *HCF)
ORACLE["scale_params"] = with_cohort(
    DEV_MATRIX + ", med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in MATRIX_COLS) + " FROM dev)\n"
    "SELECT " + ", ".join(f"round(stddev_pop(coalesce({c}, m_{c}, 0.0)), 6) AS {c}__std" for c in MATRIX_COLS) +
    " FROM dev CROSS JOIN med", *HCF)
ORACLE["multi_hot_counts"] = with_cohort(
    ", un AS (SELECT DISTINCT hadm_id, ccsr_category FROM row_cats)\n"
    "SELECT ccsr_category, count(*) AS count FROM un GROUP BY 1", *HCF)

# ---- sources and sinks -------------------------------------------------------------
ORACLE["csv_roundtrip_admissions"] = with_cohort(
    "SELECT subject_id, hadm_id, admittime, dischtime, deathtime, admission_type, insurance, race, hospital_expire_flag "
    "FROM ehr_admissions", views=("ehr_admissions",))
ORACLE["csv_strings_patients"] = with_cohort(
    f"SELECT CAST(subject_id AS VARCHAR) AS subject_id, gender AS gender_raw, {blank_null('gender')} AS gender, "
    "CAST(anchor_age AS VARCHAR) AS anchor_age, CAST(anchor_year AS VARCHAR) AS anchor_year FROM ehr_patients",
    views=("ehr_patients",))
ORACLE["parquet_dx_lists_roundtrip"] = with_cohort(
    ", nc AS (SELECT count(*) AS n_codes FROM codes)\n"
    "SELECT h.subject_id, h.hadm_id, h.seq_num, rl.ccsr_list_sorted, nc.n_codes FROM harm h "
    "LEFT JOIN row_lists rl USING (subject_id, hadm_id, seq_num) CROSS JOIN nc", *HCF)

ORACLE["trajectory_sink_roundtrip"] = with_seq(
    SEQ_PADDED + f"\nSELECT subject_id, split, {_PADDED_COLS} FROM per JOIN (SELECT DISTINCT subject_id, split FROM seq_split) s USING (subject_id)")

ORACLE["dx_version_inferred"] = with_cohort(rf"""
, v AS (SELECT *, CASE WHEN regexp_matches(coalesce(dx_norm, ''), '^[A-Z]') THEN 10
                       WHEN regexp_matches(coalesce(dx_norm, ''), '^[0-9]') THEN 9 END AS ver FROM normed),
m AS (SELECT v.*, CASE WHEN ver = 10 THEN dx_norm WHEN ver = 9 THEN xw.dst END AS icd10_full
      FROM v LEFT JOIN xw ON v.ver = 9 AND v.dx_norm = xw.src)
SELECT subject_id, hadm_id, seq_num, dx_norm, icd10_full,
 nullif(regexp_extract(upper(replace({strip('icd10_full')}, '.', '')), '^([A-Z][0-9]{{2}})', 1), '') AS icd10_3char FROM m""",
    HARMONISED)

ORACLE["calibration_top_groups"] = with_scores(RELIABILITY + r"""
, sz AS (SELECT race, count(*) AS n FROM ehr_scores GROUP BY 1 ORDER BY n DESC, race LIMIT 6),
e AS (SELECT race, sum(CASE WHEN count > 0 THEN abs(frac_pos - mean_pred) * count END) / sum(count) AS ece FROM rel GROUP BY 1),
br AS (SELECT race, avg((y_prob - y_true) * (y_prob - y_true)) AS brier FROM ehr_scores GROUP BY 1)
SELECT race, n, round(brier, 9) AS brier, round(ece, 9) AS ece FROM sz JOIN br USING (race) JOIN e USING (race)""")

ORACLE["feature_preview"] = with_cohort(
    "SELECT subject_id, hadm_id, seq_num, icd10_full, round(los_days, 9) AS los_days FROM feat "
    "ORDER BY subject_id, hadm_id, seq_num LIMIT 5", *HCF)

ORACLE["csv_list_column_roundtrip"] = with_cohort(
    "SELECT h.subject_id, h.hadm_id, h.seq_num, coalesce(rl.ccsr_list_sorted, '') AS ccsr_list_sorted, "
    "coalesce(rl.n_ccsr, 0) AS n_ccsr FROM harm h LEFT JOIN row_lists rl USING (subject_id, hadm_id, seq_num)", *HC)

ORACLE["los_softmax_argmax"] = with_scores(
    "SELECT hadm_id, CAST(CASE WHEN p0 = greatest(p0, p1, p2, p3) THEN 0 WHEN p1 = greatest(p0, p1, p2, p3) THEN 1 "
    "WHEN p2 = greatest(p0, p1, p2, p3) THEN 2 ELSE 3 END AS INTEGER) AS pred_cls, "
    "round(greatest(p0, p1, p2, p3), 9) AS p_max, round(p0, 9) AS p0_back FROM ehr_los_scores")

ORACLE["streaming_dx_harmonised"] = with_cohort(
    ", d AS (SELECT subject_id, hadm_id, seq_num, dx_norm, icd10_full, icd10_3char FROM mapped3)\n"
    "SELECT d.*, rl.ccsr_list_sorted, coalesce(rl.n_ccsr, 0) AS n_ccsr FROM d "
    "LEFT JOIN row_lists rl USING (subject_id, hadm_id, seq_num)", *HC)

ORACLE["model_matrix"] = with_cohort(
    ALL_MATRIX + "SELECT hadm_id, subject_id, y_cls, round(y_reg, 9) AS y_reg, "
    + ", ".join(f"round({c}, 9) AS {c}" for c in MATRIX_COLS)
    + ", coalesce(y_reg IS NOT NULL AND NOT isnan(y_reg) AND abs(y_reg) < CAST('inf' AS DOUBLE), false) AS reg_ok FROM matrix",
    *HCF)

def _names(*names: str) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS models(model)"


ORACLE["mortality_model_facts"] = with_cohort(
    ALL_MATRIX + "SELECT model, count(*) AS n, CAST(sum(y_cls) AS BIGINT) AS deaths, CAST(sum(hadm_id) AS BIGINT) AS ids, true AS all_finite, "
    f"true AS points_in_ci FROM matrix CROSS JOIN {_names('LogReg', 'LinearSVM', 'DecisionTree', 'RandomForest', 'GBT')} "
    "WHERE split = 'test' GROUP BY model", *HCF)
ORACLE["los_model_facts"] = with_cohort(
    ALL_MATRIX + "SELECT model, count(*) AS n, round(sum(y_reg), 6) AS days, CAST(sum(hadm_id) AS BIGINT) AS ids, true AS all_valid, "
    f"true AS points_in_ci FROM matrix CROSS JOIN {_names('HuberLinear', 'DecisionTree', 'RandomForest', 'GBT')} "
    "WHERE split = 'test' AND y_reg IS NOT NULL AND NOT isnan(y_reg) AND NOT isinf(y_reg) GROUP BY model", *HCF)
ORACLE["model_subgroup_support"] = with_cohort(ALL_MATRIX + r"""
, ra AS (SELECT hadm_id, arg_min(race, seq_num) FILTER (WHERE race IS NOT NULL) AS race FROM feat GROUP BY 1),
t AS (SELECT m.y_cls, coalesce(nullif(race, ''), 'Unknown') AS race FROM matrix m JOIN ra USING (hadm_id) WHERE split = 'test'),
c AS (SELECT race, count(*) AS k FROM t GROUP BY 1),
g AS (SELECT CASE WHEN k < 50 THEN 'Other' ELSE race END AS race, count(*) AS n, CAST(sum(y_cls) AS BIGINT) AS positives FROM t JOIN c USING (race) GROUP BY 1)
SELECT race, n, positives, positives >= 10 AND n > positives AS has_auroc, CASE WHEN positives >= 10 AND n > positives THEN true END AS ordered FROM g WHERE n >= 50""", *HCF)
ORACLE["model_vectors"] = with_cohort(
    DEV_MATRIX + ", med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in MATRIX_COLS) + " FROM dev),\n"
    "w AS (SELECT count(*) / (2.0 * greatest(count(*) - sum(y_cls), 1)) AS w0, count(*) / (2.0 * greatest(sum(y_cls), 1)) AS w1 FROM dev),\n"
    "seen AS (SELECT DISTINCT ccsr_category FROM row_cats JOIN dev USING (hadm_id)),\n"
    "hot AS (SELECT hadm_id, count(DISTINCT ccsr_category) AS k FROM row_cats WHERE ccsr_category IN (SELECT ccsr_category FROM seen) GROUP BY 1)\n"
    "SELECT m.hadm_id, split, y_cls AS y, round(CASE WHEN y_cls = 1 THEN w1 ELSE w0 END, 6) AS weight, round("
    + " + ".join(f"coalesce({c}, m_{c}, 0.0)" for c in MATRIX_COLS)
    + " + coalesce(hot.k, 0), 6) AS total FROM matrix m CROSS JOIN med CROSS JOIN w LEFT JOIN hot USING (hadm_id)", *HCF)
ORACLE["foreign_scores"] = with_cohort(
    ALL_MATRIX + "SELECT hadm_id, n_dx_rows, round(coalesce(age_at_admit, 0.0), 9) AS age_at_admit, "
    "round(least(greatest(n_dx_rows * 0.03125 + coalesce(age_at_admit, 0.0) * 0.0078125, 0.0), 1.0), 9) AS y_prob FROM matrix", *HCF)
ORACLE["text_model_facts"] = with_cohort(
    TOKENS + TEXT_SPLIT + "SELECT count(*) AS n, CAST(sum(y_mort) AS BIGINT) AS deaths, CAST(sum(hadm_id) AS BIGINT) AS ids, true AS all_probabilities "
    "FROM sp WHERE split = 'test'", *HCF, TEXT_ROWS)

ORACLE["gbt_curve_facts"] = with_cohort(
    ALL_MATRIX + "SELECT split, CAST(20 AS BIGINT) AS rounds, count(*) AS n_rows, CAST(sum(y_cls) AS BIGINT) AS n_pos, true AS same_rows, "
    "true AS best_is_top, true AS cut_as_curve FROM matrix WHERE split <> 'test' GROUP BY split", *HCF)

ORACLE["los_regression_losses"] = with_scores(
    f", e AS ({REG_SRC})\nSELECT race, round(avg(CASE WHEN abs(yhat - y) < 0.5 THEN 0.5 * (yhat - y) * (yhat - y) / 0.5 "
    "ELSE abs(yhat - y) - 0.25 END), 9) AS smooth_l1 FROM e GROUP BY 1")

ORACLE["ci_report_text"] = with_scores(rf"""
, src AS ({SCORED_PRED}),
reps AS ({reps_sql('SELECT * FROM src', 2000)}),
pa AS ({auc_sql(f'SELECT *, {ONE} FROM src', [])}),
pc AS ({conf_sql(f'SELECT *, {ONE} FROM src', [])}),
ra AS ({auc_sql('SELECT * FROM reps', ['replicate'])}),
rc AS ({conf_sql('SELECT * FROM reps', ['replicate'])}),
ci AS (
 SELECT 'auroc' AS metric, p.auroc AS point, c.lo, c.hi FROM pa p CROSS JOIN ({ci_sql('SELECT * FROM ra', [], 'auroc')}) c
 UNION ALL SELECT 'f1', p.f1, c.lo, c.hi FROM pc p CROSS JOIN ({ci_sql('SELECT * FROM rc', [], 'f1')}) c)
SELECT trim(regexp_replace(lower('Mortality ' || metric || ' (95% CI)'), '[^a-z0-9_-]+', '_', 'g'), '_') AS name,
 printf('%.2f (%.2f, %.2f)', point * 100.0, lo * 100.0, hi * 100.0) AS text FROM ci""")

_SC = ("age_at_admit", "adm_year", "n_dx", "delta_prev_adm_hours", "race_code")
ORACLE["seq_scaled_static"] = with_seq(
    ", kept AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime_dt DESC NULLS LAST, hadm_id DESC) AS rd "
    "FROM seq_split), last20 AS (SELECT * FROM kept WHERE rd <= 20),\n"
    "par AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
                                  for c in _SC) + " FROM last20 WHERE split = 'train'),\n"
    "z AS (SELECT split, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in _SC) + " FROM last20 CROSS JOIN par)\n"
    # "+ 0.0" turns a rounded -0.0 into 0.0, as Spark's decimal rounding does
    "SELECT split, " + ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}__mean, round(stddev_pop({c}), 6) AS {c}__std"
                                 for c in _SC) + " FROM z GROUP BY split")
