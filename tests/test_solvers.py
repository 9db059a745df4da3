"""Work and results of the fits: passes over the rows must not grow with the conditioning or the number of trees."""

import math
import types
from unittest import mock

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from tariffspark.models import boosting as G
from tariffspark.models import freqsev as M
from tariffspark.operators import quantiles as Q


def vectors(spark, y="CAST(id % 11 < 3 OR id % 35 = 4 AS INT)"):
    """Columns that nearly repeat each other, one constant."""
    df = spark.sql(f"SELECT {y} AS y, CAST(id % 7 AS DOUBLE) AS a, id % 7 + 0.001D * (id % 5) AS b, CAST(id % 35 AS DOUBLE) AS c, 3.0D AS d, "
                   "CAST(id % 4 AS DOUBLE) AS amount FROM range(3000)")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).select("y", "amount", "features").cache()


def test_logistic_reaches_the_optimum_without_gradient_steps(spark):
    rows = vectors(spark)
    with mock.patch.object(LogisticRegression, "fit", side_effect=AssertionError("gradient steps")):
        model = M.fit_balanced_logistic(rows)
    (part, n, largest), = M.linear_equations(rows, dict([M.logistic_stage(model)]), rows, None, 1.0)
    assert (part, n) == ("frequency", 3000) and largest <= M.NEWTON_ACCEPTED
    p = [r["_p"] for r in M.with_probability(rows, {"newton": model}).collect()]
    plain = LogisticRegression(labelCol="y", weightCol="w", maxIter=5000, tol=1e-14, regParam=1 / 3000, standardization=False)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    other = plain.fit(rows.withColumn("w", F.when(F.col("y") == 1, 1500.0 / counts[1]).otherwise(1500.0 / counts[0])))
    q = [r["probability"][1] for r in other.transform(rows).collect()]
    assert p == pytest.approx(q, abs=1e-4)


def test_logistic_of_one_class_stays_with_the_gradient_method(spark):
    model = M.fit_balanced_logistic(vectors(spark, "0"))
    assert isinstance(model, LogisticRegressionModel) and M.logistic_stage(model)[0] == "logistic"


def test_tweedie_steps_read_kept_rows(spark, policies):
    levels, plain = [], GeneralizedLinearRegression.fit

    def fit(self, df, *args):
        levels.append(df.storageLevel)
        return plain(self, df, *args)

    with mock.patch.object(GeneralizedLinearRegression, "fit", fit):
        M.build_candidate("tweedie_aggregate").fit(policies.select("contract_number", "is_claim", "claim_amount", "premium", "driver_count"))
    assert levels and all(level != StorageLevel.NONE for level in levels)


def test_level_of_a_tree_does_not_evaluate_finished_trees():
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 9, (500, 4)).astype("u1"), rng.integers(0, 2, 500).astype(float)
    margins = rng.normal(size=500)
    part = ((bins, {"y": y}, y.astype("i4"), np.full(500, -1, "i4"), np.arange(500)), [margins])
    task = G.Task(G.BoostParams("logistic", trees=30, depth=2, subsample=1.0), "y", trees=[G.Tree([-1], [0], [False], [0.0], [0])] * 25)
    tree = G.Tree([1, -1, -1, -1, -1, -1, -1], [4] * 7, [True] * 7, [0.0] * 7, [500] * 7).arrays()
    state = types.SimpleNamespace()
    state.mapPartitions = lambda f: types.SimpleNamespace(treeReduce=lambda merge, depth: f([part])[0])
    blocks = types.SimpleNamespace(binning=types.SimpleNamespace(widths=[9] * 4), partitions=1)
    with mock.patch.object(G, "_margin", side_effect=AssertionError("finished trees again")):
        found = G._histograms(blocks, state, [(0, task, 25, tree, {2: 0})])[0]
    right = bins[:, 1] > 4
    g, h = G._gradients(task.params, margins, y)
    for column in range(4):
        for b in range(9):
            at = right & (bins[:, column] == b)
            assert found[0, column * 9 + b].tolist() == [g[at].sum(), h[at].sum(), at.sum()]


def test_quantiles_of_chunks_are_exact(spark):
    df = spark.sql("SELECT CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 7.0D ELSE CAST(id * 7919 % 30011 AS DOUBLE) END AS a, "
                   "CAST(id % 13 AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS c, CASE WHEN id % 1000 = 1 THEN double('NaN') ELSE CAST(id AS DOUBLE) END AS d FROM range(30000)")
    grid = [i / 64 for i in range(65)]
    found = Q.exact_quantiles(df, {c: grid for c in df.columns}, candidate_values=500)
    for c in ("a", "b", "d"):
        expected = df.select(F.percentile(c, F.lit(grid).cast("array<double>"))).first()[0]
        assert all(x == pytest.approx(e, rel=1e-12) or math.isnan(x) and math.isnan(e) for x, e in zip(found[c], expected))
    assert found["c"] == [None] * 65


def test_brackets_are_counted_in_one_place_per_quantile(spark):
    wide = spark.sql("SELECT CAST(id AS DOUBLE) AS a FROM range(1000)").repartition(3)
    targets = {("a", i): Q._Target("a", 999 * q, 0.0, 999.0, 0, 1000) for i, q in enumerate((0.1, 0.5))}
    out = Q._recount(wide, targets, {("a", 0): (90.0, 110.0), ("a", 1): (490.0, 510.0)})
    assert [(t.low, t.high, t.below, t.inside) for t in out.values()] == [(90.0, 110.0, 90, 21), (490.0, 510.0, 490, 21)]
    rows = Q._inside(wide, out).groupBy("slot").agg(F.min("x"), F.max("x"), F.count("*")).orderBy("slot").collect()
    assert [tuple(r) for r in rows] == [(0, 90.0, 110.0, 21), (1, 490.0, 510.0, 21)]


def test_cleaning_computes_each_number_once(spark):
    from tariffspark.operators import encode as E

    df = spark.createDataFrame([(" 7 ", "1 98"), ("M", "2 00"), ("1e2", "bad"), ("3.50", "2 01"), (None, "1999"), ("5\n", "")], "bonus_malus string, car_year string")
    out = E.clean_numeric_columns(df)
    assert [tuple(r) for r in out.collect()] == [("7", "1998"), (None, "2000"), ("100", None), ("3.5", "2001"), (None, "1999"), ("5", None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") + plan.count("regexp_replace(trim") <= 2, plan


def test_retained_sums_of_both_slopes_and_free_policies(spark):
    from tariffspark.operators import price_search as Z
    from tariffspark.operators.pricing import Retention

    rng = np.random.default_rng(5)
    rows = [(float(p), float(p) * 0.9, float(a), float(x)) for p, a, x in zip(rng.choice([0.0, 50.0, 80.0], 300), rng.choice([0.0, 90.0], 300), rng.exponential(60.0, 300))]
    df = spark.createDataFrame(rows, "premium double, premium_wo_term double, claim_amount double, expected_loss double")
    retention, (p, net, paid, loss) = Retention(enabled=True), np.array(rows).T
    for r in Z.grid_candidates(df, [-0.6, 0.0, 1.4], [0.8, 1.2], retention=retention).collect():
        factor = np.clip(r["beta"] * (1 + r["alpha"] * (loss / loss.mean() - 1)), 0.0, 3.0)
        logit = np.log(0.9 / 0.1) - 4.0 * np.where(p > 0, factor - 1.0, 0.0)
        w = np.clip(1 / (1 + np.exp(-logit)), 0.05, 0.995)
        keep = (factor <= 1 + 1e-12) | (p <= 0)
        income = np.where(p > 0, net, 0.0) * factor * w
        assert r["lr_total"] == pytest.approx((paid * w).sum() / income.sum(), rel=1e-9)
        assert r["share_group1"] == pytest.approx(w[keep].sum() / w.sum(), rel=1e-9)
        for name, part in (("lr_group1", keep), ("lr_group2", ~keep)):
            assert r[name] == pytest.approx((paid * w)[part].sum() / income[part].sum() if income[part].sum() > 0 else 0.0, rel=1e-9)
