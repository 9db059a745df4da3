"""Every registered query against its SQL twin on the smallest data folder."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# Fitted models are covered by test_models.py; here they would only repeat long fits.
MODELS = {"freq_sev_fit", "gbt_freq_sev", "dependent_severity", "woe_fit", "tweedie_fit", "oof_predictions",
          "calibration_report", "benchmark_table", "ablation", "parameter_sweep", "final_refit_price", "score_batch", "fit_equations"}
CORE = {name for module in entry.MODULES for name in module.QUERIES}
NAMES = sorted(CORE & set(entry.oracle_sql()))


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}"
    return str(value)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def test_every_query_without_sql_is_a_fitted_model():
    assert CORE - set(entry.oracle_sql()) == MODELS


def test_entry_returns_one_kpi_row(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["violations"] == 0


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    mine = sorted(tuple(canonical(v) for v in r) for r in df.select(*columns).collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(canonical(r[i]) for i in order) for r in result.fetchall())
    assert mine == theirs
