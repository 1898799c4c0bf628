"""Every registered query with an oracle agrees with DuckDB on the smallest fixture
(row count, column names and order-insensitive values)."""
import math

import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

SLOW = {"mortality_leaderboard", "los_regression_leaderboard", "gbt_iteration_curve", "learning_curve_auroc",
        "text_los_model", "text_mortality_model", "trajectory_model", "grouped_cv_logreg", "model_reports"}


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL).toPandas()
    ddf = duck.sql(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    assert len(sdf) == len(ddf)
    assert _rows(sdf) == _rows(ddf)


def test_every_query_has_oracle_or_is_model():
    from wardline.plans.catalog import QUERIES
    assert set(QUERIES) - set(E.oracle_sql()) <= SLOW


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"ccsr_category", "n_dx_rows", "mortality_rate", "mean_los_days"}
    assert df.count() > 0
