"""Preparation: cleanup, encodings, interactions, pruning, fit and transform."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffspark.operators import drift as D
from tariffspark.operators import encode as E
from tariffspark.operators import features as X
from tariffspark.operators import preprocess as Z
from tariffspark.operators import prune as P
from tariffspark.operators import woe as W


def test_numeric_like_cleanup(spark):
    df = spark.createDataFrame([("5", "2 00"), ("M", "1 98"), (" 7 ", "2020"), (None, "bad"), ("3.5", None)], "bonus_malus string, car_year string")
    got = [tuple(r) for r in E.clean_numeric_columns(df).collect()]
    assert got == [("5", "2000"), (None, "1998"), ("7", "2020"), (None, None), ("3.5", None)]
    stats = {r["feature"]: r.asDict() for r in E.numeric_like_stats(df).collect()}
    assert stats["car_year"] == {"feature": "car_year", "non_null": 4, "non_numeric_before": 3, "rescued": 2, "coerced_to_missing": 1}


def test_fill_values(spark):
    df = spark.createDataFrame([(None, 1.0, None), (2.0, None, None), (4.0, 9.0, None)], "premium double, a double, empty double")
    assert E.fit_fill_values(df, ["premium", "a", "empty"]) == {"premium": 0.0, "a": 5.0, "empty": 0.0}
    assert E.fit_fill_values(df, ["a"], "zero") == {"a": 0.0}


def test_rare_values_fold_and_unseen_values_fall_back(spark):
    rows = [("big", 1)] * 30 + [("mid", 0)] * 10 + [("tiny", 1)] * 1 + [(None, 0)] * 9
    df = spark.createDataFrame(rows, "model string, is_claim int")
    state = E.fit_categories(df, ["model"], share=0.1, least=1000)
    table = {r["category"]: r for r in state.lookup.collect()}
    assert set(table) == {"big", "mid", "missing", "other"} and table["other"]["n"] == 1
    mean = 31 / 50
    assert table["big"]["te"] == pytest.approx((30 * 1.0 + mean * 40) / 70) and table["big"]["freq"] == 0.6
    new = spark.createDataFrame([("big",), ("never",), (None,)], "model string")
    out = [tuple(r) for r in E.fold_and_encode(new, state, ["model"], ["model"], ["model"]).select("model", "model_te", "model_freq").collect()]
    assert [o[0] for o in out] == ["big", "other", "missing"] and out[1][2] == 0.02
    without = E.fit_categories(df.where("model <> 'tiny'"), ["model"], share=0.1, least=1000)
    unseen = E.fold_and_encode(new, without, ["model"], ["model"], ["model"]).where("model = 'other'").first()
    assert unseen["model_te"] == pytest.approx(0.75) and unseen["model_freq"] == 0.0


def test_column_without_common_values_keeps_its_largest(spark):
    rows = [(f"v{i:04d}", 0) for i in range(1000)] + [("v0001", 1)] * 2
    state = E.fit_categories(spark.createDataFrame(rows, "model string, is_claim int"), ["model"], share=0.1, least=200)
    kept = {r["category"] for r in state.lookup.collect()}
    assert len(kept) == 21 and {"other", "v0000", "v0001"} <= kept


def test_out_of_fold_encoding_equals_a_loop_over_folds(spark):
    rng = random.Random(5)
    rows = [(f"c{i // 2}", rng.choice("xyz"), rng.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(rows, "contract_number string, mark string, is_claim int").withColumn("id", F.monotonically_increasing_id())
    out = E.out_of_fold_encoding(df, ["mark"], 4, "contract_number", smoothing=3.0, min_leaf=30)
    folded = out.withColumn("fold", E.fold_of(F.col("contract_number"), 4)).collect()
    for r in folded:
        outside = [o for o in folded if o["fold"] != r["fold"]]
        mean = sum(o["is_claim"] for o in outside) / len(outside)
        same = [o["is_claim"] for o in outside if o["mark"] == r["mark"]]
        pull = 6.0 if len(same) < 30 else 3.0
        assert r["mark_te"] == pytest.approx((sum(same) + mean * pull) / (len(same) + pull))
    assert out.groupBy("contract_number").agg(F.countDistinct(E.fold_of(F.col("contract_number"), 4)).alias("n")).where("n > 1").count() == 0


def test_score_statistics_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (None, 4.0, 2.0), (None, None, None)], "SCORE_1 double, SCORE_2 double, SCORE_3 double")
    got = [tuple(round(v, 9) for v in r) for r in df.select(*[c.alias(n) for n, c in X.score_statistics(["SCORE_1", "SCORE_2", "SCORE_3"]).items()]).collect()]
    assert got == [(3.0, round(float(np.std([1, 2, 6])), 9), 2.0), (3.0, 1.0, 3.0), (0.0, 0.0, 0.0)]


def test_interactions_and_their_eligibility(spark):
    df = spark.createDataFrame([(100.0, 0, 50.0, "5", None, "car")],
                               "premium double, driver_count int, engine_power_mean double, bonus_malus string, region_name string, vehicle_type_name string")
    row = X.with_interactions(df, list(X.BASE_INTERACTIONS)).first()
    assert row["premium_per_driver"] == 100.0 and row["premium_per_power"] == 2.0 and row["region_x_vehicle_type"] == "missing__car"
    assert "car_age_x_bonus_malus" not in row.asDict()
    plan = X.plan_interactions(["premium_x_power", "premium_per_driver", "nonsense", "score_x_car_age"], ["premium", "engine_power"], [*X.EXTENDED_INTERACTIONS, "nonsense"])
    assert plan["accepted"] == ["premium_x_power"] and plan["dropped_by_whitelist"] == ["premium_per_driver"]
    assert {d["feature"] for d in plan["dropped_missing_sources"]} == {"nonsense", "score_x_car_age"}


def test_missing_aggregate_names():
    plan = X.missing_aggregate_plan(["SCORE_4_1", "SCORE_11_2", "car_age"])
    assert set(plan) == {"score_missing_cnt_total", "score_missing_share", "score_4_missing_cnt", "score_11_missing_cnt"}


def _psi_reference(ref, cur, bins=10):
    ref, cur = np.asarray(ref, float), np.asarray(cur, float)
    r, c = ref[~np.isnan(ref)], cur[~np.isnan(cur)]
    edges = np.unique(np.quantile(r, np.linspace(0, 1, bins + 1)))
    edges = np.array([-np.inf, np.median(r), np.inf]) if len(edges) < 2 else np.concatenate([[-np.inf], edges[1:-1], [np.inf]])
    shares = [np.append(np.histogram(v, edges)[0] / len(v), np.isnan(w).mean()) for v, w in ((r, ref), (c, cur))]
    a, b = (np.clip(s, 1e-6, None) for s in shares)
    return float(np.sum((b - a) * np.log(b / a)))


def test_psi_equals_numpy(spark):
    rng = np.random.default_rng(1)
    cols = {"same": rng.normal(size=600), "shifted": np.concatenate([rng.normal(size=300), rng.normal(3, 1, 300)]), "constant": np.full(600, 4.0),
            "few": rng.integers(0, 3, 600).astype(float)}
    cols["holes"] = np.where(np.arange(600) % 4 == 0, np.nan, cols["same"])
    rows = [("reference" if i < 300 else "current", *[None if np.isnan(v[i]) else float(v[i]) for v in cols.values()]) for i in range(600)]
    df = spark.createDataFrame(rows, "window string, " + ", ".join(f"{c} double" for c in cols))
    got = {r["feature"]: r["psi"] for r in D.psi(df, list(cols)).collect()}
    for c, v in cols.items():
        assert got[c] == pytest.approx(_psi_reference(v[:300], v[300:]), abs=1e-9)
    closed = {r["feature"]: r["psi"] for r in D.psi(df, list(cols), mode="closed").collect()}
    assert closed["constant"] is None and closed["shifted"] > 0.2


def _daily(spark, n, drift_after):
    rng = random.Random(9)
    rows = [(f"c{i:04d}", dt.datetime(2022, 1, 1) + dt.timedelta(days=i), int(rng.random() < 0.2), rng.gauss(0, 1), rng.gauss(0 if i < drift_after else 5, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "contract_number string, operation_date timestamp_ntz, is_claim int, stable double, drifting double")


def test_drift_pruning_drops_the_moving_feature_and_respects_exclusions(spark):
    df = _daily(spark, 180, 120)
    options = {"share": 0.66, "threshold": 0.25, "min_rows": 30}
    kept = P.prune_features(df, ["stable", "drifting"], drift=options, date="operation_date").kept
    assert "drifting" not in kept
    assert P.prune_features(df, ["stable", "drifting"], drift={**options, "exclude_patterns": ["drift*"], "exclude": ["stable"]}, date="operation_date").kept == ["stable", "drifting"]


def test_correlation_pruning_keeps_the_later_column(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3)) for i in range(50)], "a double, b double, c double")
    assert [(d["feature"], d["kept"]) for d in P.correlated_columns(df, ["c", "b", "a"], 0.99)] == [("a", "b")]
    assert [d["feature"] for d in P.correlated_columns(df, ["a", "b", "c"], 0.99, ["a"])] == []


def test_duplicates_with_equal_nulls(spark):
    df = spark.createDataFrame([(f"k{i}", None if i % 2 else 1.0 * i, None if i % 2 else 1.0 * i, 1.0 * i) for i in range(10)], "k string, x double, y double, z double")
    assert P.duplicate_columns(df, ["z", "y", "x"], "k") == [{"feature": "y", "kept": "x", "reason": "exact_duplicate"}]


def test_woe_bins_by_hand(spark):
    rows = [(float(i), int(i >= 150)) for i in range(200)] + [(None, 1)] * 5
    bins = W.woe_bins(spark.createDataFrame(rows, "x double, is_claim int"), ["x"], n_bins=4, min_bin_size=50).orderBy("bin").collect()
    assert [(b["count"], b["event_count"]) for b in bins] == [(50, 0), (50, 0), (50, 0), (50, 50)]
    assert bins[3]["woe"] == pytest.approx(np.log((0.5 / 151) / (50.5 / 51)))
    out = W.woe_transform(spark.createDataFrame([(0.0,), (199.0,), (None,), (1e9,)], "x double"), W.woe_bins(
        spark.createDataFrame(rows, "x double, is_claim int"), ["x"], 4), ["x"]).collect()
    assert out[0]["x_woe"] == 0.0 and out[1]["x_woe"] < 0 and out[2]["x_woe"] == 0.0 and out[3]["x_woe"] == 0.0


def test_fit_on_train_applies_to_a_poorer_split_and_survives_saving(spark, policies, tmp_path):
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    train, valid = policies.where(F.col("operation_date") < cut), policies.where(F.col("operation_date") >= cut)
    train, valid = train.drop("p_claim", "expected_severity", "expected_loss"), valid.drop("p_claim", "expected_severity", "expected_loss")
    cfg = Z.PreprocessConfig(missing_flag_threshold=0.001, extended_interactions=["premium_x_power", "score_x_car_age"], prune={}, drift={"threshold": 5.0})
    state = Z.fit_preprocessor(train, cfg)
    assert "score_missing_share" not in state.features and {"premium", "premium_wo_term"} <= set(state.features)
    full = Z.transform(valid, state)
    assert full.columns[:4] == ["contract_number", "is_claim", "claim_amount", "claim_cnt"]
    assert full.count() == valid.count()
    assert all(full.where(F.col(c).isNull()).count() == 0 for c in state.features)
    poor = Z.transform(valid.drop("mark", "SCORE_1_1", "operation_date"), state)
    assert poor.columns == full.columns
    state.save(spark, str(tmp_path / "state"))
    again = Z.Preprocessor.load(spark, str(tmp_path / "state"))
    first, second = (sorted(map(str, Z.transform(valid, s).collect())) for s in (state, again))
    assert first == second
    assert {d["reason"] for d in state.pruning} & {"interaction_retained", "interaction_corr", "interaction_rank", "interaction_psi"}


def test_lists_steer_the_columns(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0, 3.0, 4.0, "r")], "contract_number string, premium double, premium_wo_term double, a double, b double, region_name string")
    numeric, text, _ = Z.assign_roles(df, Z.PreprocessConfig(whitelist=["a"], droplist=[]))
    assert numeric == ["premium", "premium_wo_term", "a"] and text == ["region_name"]
    numeric, _, _ = Z.assign_roles(df, Z.PreprocessConfig(droplist=["a"], force_drop=["b", "premium"]))
    assert numeric == ["premium", "premium_wo_term"]


def test_interactions_without_psi_say_why(spark):
    df = spark.sql("SELECT id AS contract_number, timestamp_ntz'2022-01-01' + make_dt_interval(CAST(id AS INT)) AS operation_date, CAST(id % 7 AS DOUBLE) AS a, "
                   "CAST(id * id % 11 AS DOUBLE) AS ab, CAST(id % 2 AS INT) AS is_claim, CAST(id AS DOUBLE) AS claim_amount FROM range(100)")
    rows = P.prune_features(df, ["a", "ab"], ["ab"], date="operation_date").decisions
    assert [d["note"] for d in rows if d["feature"] == "ab"] == ["too few rows for PSI: 100, minimum 1000"]


def test_equal_fingerprints_of_different_columns_drop_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (2, None, None, None), (3, 5.0, 5.0, 5.0)], "k int, a double, b double, c double")
    same = spark.createDataFrame([(c, 1) for c in "abc"], "feature string, fingerprint int")
    monkeypatch.setattr(P, "column_fingerprints", lambda *_: same)
    assert [(d["feature"], d["kept"]) for d in P.duplicate_columns(df, ["a", "b", "c"], "k")] == [("b", "a")]
