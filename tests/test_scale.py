"""What large tables need: rows that move once, tables that go when nothing reads them, fits that keep no copy of their rows."""

import time
from pathlib import Path
from unittest import mock

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from tariffspark.models import boosting as G
from tariffspark.models import freqsev as M
from tariffspark.models import newton as N
from tariffspark.models.matrix import align, fit_matrix, infer_schema
from tariffspark.plans import eda
from tariffspark.session import for_now, materialize, tune
from tariffspark.sources import portfolio as S


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = [(f"c{i}", int(rng.random() < 0.3), float(rng.uniform(10, 90)), float(rng.uniform(100, 900)), None if i % 9 == 0 else float(rng.normal()), 4.0,
             [None, "x", "y", "z"][i % 4], "ab"[i % 2]) for i in range(400)]
    return materialize(spark.createDataFrame([(k, c, c * a, *r) for k, c, a, *r in rows], "contract_number string, is_claim int, claim_amount double, "
                                             "premium double, power double, same double, region string, kind string"), "scale")


def test_driver_rows_that_lie_by_order_become_policies_where_they_are(spark, data):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = S.policies(spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning(l_") == 2 and "hashpartitioning(contract_number" not in plan, plan


def test_the_board_joins_the_driver_rows_once(spark, data):
    with mock.patch.object(eda.S, "driver_rows", side_effect=S.driver_rows) as rows:
        assert eda.QUERIES["feature_action_board"](spark, data).count() == 24
    assert rows.call_count == 1


def test_shuffle_files_go_with_their_job(spark):
    disk = tune(spark).sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    before = {f.getName() for f in _files(disk)}
    materialize(spark.range(100_000).groupBy((F.col("id") % 5000).alias("k")).count(), "counted")
    for _ in range(40):
        left = [f.getName() for f in _files(disk) if f.getName() not in before and f.getName().startswith("shuffle_")]
        if not left:
            break
        time.sleep(0.25)
    assert not left


def _files(disk):
    found = disk.getAllFiles()
    return [found.apply(i) for i in range(found.size())]


def test_a_table_for_now_is_deleted(spark):
    with for_now(spark.range(10).toDF("a"), "short") as rows:
        place = Path(rows.inputFiles()[0].removeprefix("file:")).parent
        assert rows.count() == 10
    assert spark.read.parquet(str(place)).columns == ["nothing"]


@pytest.mark.parametrize("kind", ["baseline_freq_sev", "woe_freq_sev"])
def test_linear_fits_keep_no_copy_of_their_rows(table, kind):
    with mock.patch.object(type(table), "persist", side_effect=AssertionError("a copy of the rows")):
        model = M.build_candidate(kind).fit(table)
        with mock.patch.object(M, "materialize", side_effect=AssertionError("a copy of the rows")):
            found = {part: (n, worst) for part, n, worst in model.equations(table)}
    assert found["frequency"][0] == 400 and found["frequency"][1] <= N.TOLERANCE and found["severity"][1] < 1e-9


def test_tweedie_rows_never_go_to_disk(table):
    levels, plain = [], type(table).persist
    with mock.patch.object(type(table), "persist", lambda df, level: levels.append(level) or plain(df, level)):
        M.build_candidate("tweedie_aggregate").fit(table)
    assert levels and not any(level.useDisk for level in levels)


@pytest.mark.parametrize("loss,penalty", [("logistic", 1.0), ("squared", 5.0)])
def test_rows_as_columns_and_as_vectors_have_the_same_fit(table, loss, penalty):
    schema = infer_schema(table)
    rows = align(table, schema)
    matrix = fit_matrix(rows, schema)
    vectors = matrix.transform(rows)
    x = np.array([r[0].toArray() for r in vectors.select("features").collect()])
    y = np.array([float(r[0]) for r in vectors.select("is_claim").collect()])
    found = [N.newton(r, loss, penalty) for r in (N.rows_of(rows, matrix, F.col("is_claim")), N.rows_of_vectors(vectors, F.col("is_claim"), x.shape[1]))]
    assert found[0][0] == pytest.approx(found[1][0], abs=1e-6) and found[0][1] == pytest.approx(found[1][1], abs=1e-6)
    beta, intercept = found[0]
    eta = x @ beta + intercept
    residual = (1 / (1 + np.exp(-eta)) if loss == "logistic" else eta) - y
    assert np.abs(x.T @ residual + penalty * beta).max() / len(y) < 1e-7 and abs(residual.sum()) / len(y) < 1e-7


def test_a_vector_with_hashed_places_has_no_columns(table):
    schema = infer_schema(table)
    rows = align(table, schema)
    assert N.rows_of(rows, fit_matrix(rows, schema, hashed=["region"]), F.col("is_claim")) is None


def test_long_growth_writes_its_margins_and_evaluates_no_tree_again(table):
    binning = G.fit_binning(table, ["premium", "power"], ["region"], F.col("is_claim"), 16)
    blocks = G.pack_blocks(table, binning, {"claim": F.col("is_claim"), "log": F.log1p("claim_amount")}, F.col("is_claim"), F.col("contract_number"))
    assert blocks.rdd.getStorageLevel() == StorageLevel.NONE
    make = lambda: [G.Task(G.BoostParams("logistic", trees=7, depth=2), "claim"), G.Task(G.BoostParams("squared", trees=5, depth=2), "log", claims_only=True)]
    plain, short = make(), make()
    G.grow(blocks, plain)
    with mock.patch.object(G, "REFRESH", 2), mock.patch.object(G, "_kept_state", side_effect=G._kept_state) as kept:
        G.grow(blocks, short)
    assert kept.call_count == 3 and [t.trees for t in plain] == [t.trees for t in short]
