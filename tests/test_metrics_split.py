"""Metrics and splits against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffspark.operators import metrics as M
from tariffspark.operators import split as O


def _auc(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = y == 1, y != 1
    less = (p[pos][:, None] > p[neg][None, :]) + 0.5 * (p[pos][:, None] == p[neg][None, :])
    weight = w[pos][:, None] * w[neg][None, :]
    return float((less * weight).sum() / weight.sum())


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    n = 300
    # A third of all scores are equal.
    p = np.where(np.arange(n) % 3 == 0, 0.3, rng.integers(0, 40, n) / 40.0)
    y = (rng.random(n) < 0.2 + 0.4 * p).astype(int)
    claims, prem = y * rng.uniform(10, 90, n), rng.uniform(20, 50, n)
    rows = [(f"k{i}", float(p[i]), int(y[i]), float(claims[i]), float(prem[i]), float(prem[i] * 1.1)) for i in range(n)]
    return (y, p, claims, prem), spark.createDataFrame(rows, "k string, p_claim double, is_claim int, claim_amount double, premium double, new_premium double").repartition(6)


def test_auc_equals_the_pairwise_definition(scored):
    (y, p, _, _), df = scored
    for n in (1, 7):
        row = M.classification_metrics(df.repartition(n)).first()
        assert row["auc"] == pytest.approx(_auc(y, p), abs=1e-12) and row["gini"] == pytest.approx(2 * _auc(y, p) - 1, abs=1e-12)
    assert row["brier"] == pytest.approx(float(np.mean((y - p) ** 2)))


def test_one_class_has_no_auc(scored):
    _, df = scored
    assert M.auc_exact(df.where("is_claim = 0")).first()["auc"] is None


def test_bootstrap_replicates_equal_a_weighted_sum(scored):
    import hashlib

    (y, p, claims, prem), df = scored
    cuts = np.array(M.POISSON_ONE) * 2.0**32
    for partitions in (1, 5):
        rows = {r["replicate"]: r for r in M.bootstrap_replicates(df.repartition(partitions), "k", 6).collect()}
        for b in range(6):
            draws = [int(hashlib.md5(f"42:{b // 4}:k{i}".encode()).hexdigest()[8 * (b % 4):8 * (b % 4) + 8], 16) for i in range(len(y))]
            w = np.array([(cuts <= u).sum() for u in draws], float)
            assert rows[b]["auc"] == pytest.approx(_auc(y, p, w), abs=1e-12)
            assert rows[b]["brier"] == pytest.approx((w * (y - p) ** 2).sum() / w.sum())
            assert rows[b]["lr_original"] == pytest.approx((w * claims).sum() / (w * prem).sum())
            assert rows[b]["lr_new_premium"] == pytest.approx((w * claims).sum() / (w * prem * 1.1).sum())


def test_bootstrap_interval_holds_the_point(scored):
    (y, p, _, _), df = scored
    ci = {r["metric"]: r for r in M.bootstrap_ci(df, "k", 40).collect()}
    assert set(ci) == set(M.BOOTSTRAP_METRICS)
    assert ci["auc"]["ci_lower"] < _auc(y, p) < ci["auc"]["ci_upper"]


def test_severity_metrics_need_claims(scored):
    _, df = scored
    none = M.severity_metrics(df.where("is_claim = 0").withColumn("expected_severity", F.lit(1.0))).first()
    assert none["rmse"] is None and none["r2"] is None and none["n"] == 0
    exact = M.severity_metrics(df.withColumn("expected_severity", F.col("claim_amount"))).first()
    assert exact["rmse"] == pytest.approx(0.0) and exact["r2"] == pytest.approx(1.0)


@pytest.fixture(scope="module")
def dated(spark):
    rows = [(f"c{i}", dt.datetime(2024, 1, 1) + dt.timedelta(days=15 * i), i % 4 == 0) for i in range(20)] + [("late", None, False)]
    return spark.createDataFrame(rows, "contract_number string, operation_date timestamp_ntz, claim boolean").withColumn("is_claim", F.col("claim").cast("int"))


def test_time_split_respects_the_cutoff(dated):
    out, scheme = O.split_group_time(dated, holdout_start="2024-05-01")
    assert scheme == "group_time"
    assert all((r["operation_date"] is not None and r["operation_date"] >= dt.datetime(2024, 5, 1)) == (r["split"] == "valid") for r in out.collect())


def test_derived_cutoff_and_fallbacks(dated):
    out, scheme = O.split_group_time(dated, test_size=0.2)
    assert scheme == "group_time" and out.where("split = 'valid'").count() == 4
    assert O.split_group_time(dated, holdout_start="2030-01-01")[1] == "group"
    assert O.split_group_time(dated.drop("operation_date"), test_size=0.4)[1] == "group"
    with pytest.raises(ValueError):
        O.split_group(dated.withColumn("one", F.lit(1)), 0.5, "one")
    with pytest.raises(ValueError):
        O.split_group(dated, 0.5, "absent")


def test_groups_never_share_a_side(spark):
    df = spark.createDataFrame([(i, f"g{i % 9}") for i in range(90)], "id int, g string")
    for out in (O.split_group(df, 0.5, "g").withColumn("fold", F.col("split")), O.group_folds(df, 4, "g")):
        assert out.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert O.group_folds(df.where("g < 'g3'"), 10, "g").agg(F.max("fold")).first()[0] <= 2


def test_overlapping_groups_leave_valid(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "valid"), ("b", "valid"), (None, "train"), (None, "valid")], "g string, split string")
    assert sorted((r["g"] or "-", r["split"]) for r in O.remove_overlap(df, "g").collect()) == [("-", "train"), ("a", "train"), ("b", "valid")]


def test_random_split_is_exact_per_stratum(dated):
    out = O.split_random(dated, 0.4)
    got = {(r["is_claim"], r["split"]): r["count"] for r in out.groupBy("is_claim", "split").count().collect()}
    assert got[(1, "valid")] == 2 and got[(0, "valid")] == 6


def test_bootstrap_query_runs_all_replicates(spark, data, monkeypatch):
    import inspect

    from tariffspark.plans import metric

    seen, draw = [], M.bootstrap_replicates
    monkeypatch.setattr(M, "bootstrap_replicates", lambda df, key, replicates, *a, **kw: seen.append(replicates) or draw(df, key, replicates, *a, **kw))
    metric.QUERIES["bootstrap_ci"](spark, data)
    assert seen == [metric.REPLICATES] == [inspect.signature(M.bootstrap_ci).parameters["replicates"].default]
