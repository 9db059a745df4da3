"""Fitted models, the benchmark, a whole run, scoring and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffspark.models import bench as B
from tariffspark.models import calibrate as C
from tariffspark.models import experiment as X
from tariffspark.models import freqsev as M
from tariffspark.models.isotonic import IsotonicCurve
from tariffspark.models.oof import out_of_fold
from tariffspark.models.matrix import FeatureSchema, align, fit_matrix, infer_schema, matrix_entries, matrix_slots
from tariffspark.operators import metrics
from tariffspark.operators import score as K
from tariffspark.operators.pricing import PricingPolicy
from tariffspark.sources import portfolio as S
from tariffspark.sources.tables import read_leaderboard
from tariffspark.streaming import reprice as T

TREES = {"iterations": 4, "depth": 3}
PREDICTION = ["p_claim", "expected_severity", "expected_loss"]


@pytest.fixture(scope="module")
def planted(spark):
    """Claims that depend on power and premium, with a category the second half has never seen."""
    rng = np.random.default_rng(23)
    rows = []
    for i in range(600):
        power, premium = rng.uniform(50, 200), rng.uniform(100, 1000)
        claim = int(rng.random() < 1 / (1 + np.exp(-(power - 140) / 15)))
        rows.append((f"c{i}", claim, float(claim * premium * rng.uniform(2, 3)), float(claim), float(premium), float(premium * 0.9),
                     None if i % 50 == 0 else float(power), "new" if i > 500 else ["east", "west"][i % 2]))
    return spark.createDataFrame(rows, "contract_number string, is_claim int, claim_amount double, claim_cnt double, premium double, premium_wo_term double, "
                                       "engine_power_mean double, region_name string")


@pytest.fixture(scope="module")
def halves(planted):
    early = F.substring("contract_number", 2, 4).cast("int") <= 450
    return planted.where(early), planted.where(~early)


@pytest.mark.parametrize("kind,params", [("baseline_freq_sev", {}), ("gbt_freq_sev", TREES), ("gbt_dep_freq_sev", {**TREES, "oof_folds": 2}),
                                         ("gbt_freq_sev", {"n_estimators": 6, "max_depth": 3, "reg_lambda": 2.0, "colsample_bytree": 0.8, "severity_loss_function": "TWEEDIE"}),
                                         ("woe_freq_sev", {}), ("tweedie_aggregate", {})])
def test_models_find_the_signal_and_survive_saving(spark, halves, tmp_path, kind, params):
    train, valid = halves
    model = M.build_candidate(kind, params).fit(train)
    out = model.predict(valid)
    assert out.columns == [*valid.columns, *PREDICTION] and out.count() == valid.count()
    assert out.where("engine_power_mean is null").count() == valid.where("engine_power_mean is null").count()
    bad = out.where("p_claim < 0 or p_claim > 1 or expected_loss < 0 or expected_loss is null").count()
    assert bad == 0
    assert metrics.auc_exact(out).first()["auc"] > 0.7
    model.save(spark, str(tmp_path / "m"))
    again = C.load_model(spark, str(tmp_path / "m")).predict(valid)
    first, second = ({r["contract_number"]: r["expected_loss"] for r in o.collect()} for o in (out, again))
    assert first == pytest.approx(second)


@pytest.mark.parametrize("kind", ["baseline_freq_sev", "woe_freq_sev"])
def test_linear_fits_solve_their_score_equations(halves, kind):
    train, _ = halves
    model = M.build_candidate(kind, {"ridge_alpha": 7.0}).fit(train)
    found = {part: (n, worst) for part, n, worst in model.equations(train)}
    assert found["frequency"][0] == train.count() and found["frequency"][1] < 1e-4
    assert found["severity"][0] == train.where("is_claim > 0").count() and found["severity"][1] < 1e-9
    model.params["ridge_alpha"] = 70.0
    assert dict((part, worst) for part, _, worst in model.equations(train))["severity"] > 1e-6


def test_too_few_claims_use_their_mean(halves):
    train, valid = halves
    few = train.where("is_claim = 0").unionByName(train.where("is_claim = 1").limit(5))
    mean = few.where("is_claim = 1").agg(F.avg("claim_amount")).first()[0]
    out = M.build_candidate("baseline_freq_sev").fit(few).predict(valid).first()
    assert out["expected_severity"] == pytest.approx(mean)


def test_wide_categories_are_hashed(planted):
    schema = infer_schema(planted)
    assert schema.numeric[0] == "premium" and schema.categorical == ["region_name"]
    assert any("Hasher" in type(s).__name__ for s in fit_matrix(align(planted, schema), schema, hashed=["region_name"]).stages)


def test_matrix_has_exact_medians_and_no_place_for_unknown_categories(spark):
    schema = FeatureSchema(["a", "gone", "same"], ["c"])
    train = align(spark.createDataFrame([(i, None if i == 3 else float(i * i), None, 5.0, "xy"[i % 2] if i else None) for i in range(9)],
                                        "k int, a double, gone double, same double, c string"), schema)
    fitted = fit_matrix(train, schema)
    assert matrix_slots(fitted)[:2] == ["a", "same"] and set(matrix_slots(fitted)[2:]) == {"c=x", "c=y", "c=missing"}
    a = [float(i * i) if i != 3 else float(np.median([0, 1, 4, 16, 25, 36, 49, 64])) for i in range(9)]
    got = {(r["k"], r["slot"]): r["value"] for r in matrix_entries(train, fitted, "k").collect()}
    want = {(i, "a"): v / np.std(a) for i, v in enumerate(a) if v} | {(i, "c=" + ("xy"[i % 2] if i else "missing")): 1.0 for i in range(9)}
    assert got == pytest.approx(want)
    unseen = align(spark.createDataFrame([(1, 4.0, "new")], "k int, a double, c string"), schema)
    assert [r["slot"] for r in matrix_entries(unseen, fitted, "k").collect()] == ["a"]


def test_out_of_fold_rows_are_complete_and_resume(halves, tmp_path):
    train, _ = halves
    path = str(tmp_path / "folds")
    fits = []
    fit = lambda settings, df=train: out_of_fold(df, lambda part: fits.append(1) or (lambda rows: rows.select("contract_number", "is_claim")), 3,
                                                 resume_path=path, settings=settings)
    assert sorted(r[0] for r in fit({"a": 1}).select("contract_number").collect()) == sorted(r[0] for r in train.select("contract_number").collect())
    assert len(fits) == 3
    fit({"a": 1})
    assert len(fits) == 3  # the same input, rule and settings: nothing is fitted again
    (tmp_path / "folds" / "fold=1" / "manifest" / "_SUCCESS").unlink()
    for part in (tmp_path / "folds" / "fold=1" / "manifest").glob("part-*"):
        part.unlink()
    fit({"a": 1})
    assert len(fits) == 4  # one fold was cut off
    fit({"a": 2})
    assert len(fits) == 7
    fit({"a": 2}, train.limit(100))
    assert len(fits) == 10
    whole = C.oof_predictions(train, "baseline_freq_sev", {"max_iter": 20}, 3)
    assert whole.count() == train.count() and whole.where("p_claim is null").count() == 0


def test_folds_go_by_row_without_a_group(halves):
    train, _ = halves
    alone = train.drop("contract_number")
    assert C.oof_predictions(alone, "baseline_freq_sev", {"max_iter": 20}, 3).count() == train.count()
    assert C.oof_predictions(train.withColumn("contract_number", F.lit("one")), "baseline_freq_sev", {"max_iter": 20}, 3).count() == train.count()


def test_calibration_lowers_brier_and_guards(spark, halves):
    train, _ = halves
    for method in ("platt", "isotonic"):
        calibrator, report = C.fit_calibrator(train, "baseline_freq_sev", C.CalibrationConfig(True, method, 3, min_samples=50))
        assert report.status == "applied" and calibrator is not None
        assert report.brier_calibrated <= report.brier_raw + 0.02
    config = C.CalibrationConfig(True, "sigmoid", min_samples=50)
    assert config.method == "platt"
    assert C.fit_calibrator(train, "x", C.CalibrationConfig())[1].reason == "disabled_in_config"
    assert C.fit_calibrator(train.limit(10), "x", config)[1].reason == "not_enough_samples"
    assert C.fit_calibrator(train.where("is_claim = 0"), "x", config)[1].reason == "single_class_target"
    assert C.fit_calibrator(train, "oof_blend_freq_sev", config)[1].reason == "blend_candidate_not_supported"


def test_isotonic_curve_is_the_max_min_formula(spark, tmp_path):
    rng = np.random.default_rng(4)
    scores = np.round(rng.random(400), 2)
    events = (rng.random(400) < scores ** 2).astype(int)
    rows = [(float(p), int(y)) for p, y in zip(scores, events)] + [(None, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    levels = np.unique(scores)
    w, s = (np.array([f(scores == v) for v in levels]) for f in (np.sum, lambda m: events[m].sum()))
    mean = lambda a, b: s[a:b + 1].sum() / w[a:b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, len(levels))) for a in range(i + 1)) for i in range(len(levels))]
    try:
        for parts in ("1", "4", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            curve = IsotonicCurve.fit(df, F.col("p"), F.col("y"))
            assert np.interp(levels, curve.scores, curve.values) == pytest.approx(want, abs=1e-12)
            assert curve.scores == sorted(set(curve.scores)) and curve.values == sorted(curve.values)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    curve.save(spark, str(tmp_path / "curve"))
    again = IsotonicCurve.load(spark, str(tmp_path / "curve"))
    got = df.select("p", again.at(F.col("p")).alias("v")).collect()
    assert again == curve and all((r["v"] is None) == (r["p"] is None) for r in got)
    with pytest.raises(ValueError):
        IsotonicCurve.fit(df.limit(0), F.col("p"), F.col("y"))


PRICE = B.PriceConfig(alphas=[0.0, 0.3, 0.6], betas=[0.5, 1.0, 1.5, 2.0])


def test_benchmark_isolates_failures_and_blends(spark, halves, tmp_path):
    train, valid = halves
    config = B.BenchmarkConfig(["baseline_freq_sev", "broken", "oof_blend_freq_sev"], {"gbt_freq_sev": TREES, "oof_blend_freq_sev": {
        "base_candidates": ["baseline_freq_sev", "tweedie_aggregate"], "oof_folds": 2, "weight_grid_step": 0.5}}, must_pass=False)
    result = B.run_benchmark(train, valid, config, PRICE)
    status = {r["candidate"]: (r["status"], r["error"]) for r in result.table.collect()}
    assert status["baseline_freq_sev"][0] == "ok" and status["broken"][0] == "failed" and "broken" in status["broken"][1]
    assert status["oof_blend_freq_sev"][0] == "ok", status
    blend = result.candidates[2]
    assert sum(blend.metadata["weights"].values()) == pytest.approx(1.0)
    blend.model.save(spark, str(tmp_path / "b"))
    assert C.load_model(spark, str(tmp_path / "b")).predict(valid).count() == valid.count()
    assert result.winner.status == "ok" and result.reason.startswith("best_")


CONFIG = {
    "split": {"test_size": 0.2, "random_state": 42},
    "validation": {"scheme": "group_time", "time_holdout_start": "2000-03-01 00:00:00", "group_kfold_n_splits": 3},
    "model": {"max_iter": 30, "ridge_alpha": 1.0},
    "preprocessing": {"categorical": {"rare_threshold": 0.05, "rare_min_count": 400}, "target_encoding": {"columns": ["mark"]}, "freq_encoding": {"enabled": False},
                      "feature_pruning": {"enabled": True}, "date_features": {"features": ["month"]}},
    "benchmark": {"enabled": True, "candidates": ["baseline_freq_sev"], "must_pass_constraints": False},
    "pricing": {"target_lr": 0.7, "alpha_grid": {"start": 0.0, "stop": 0.4, "num": 3}, "beta_grid": {"start": 0.8, "stop": 1.1, "num": 7},
                "target_band": {"min": 0.69, "max": 0.71}, "optimization": {"method": "grid"}},
    "ablation": {"enabled": False},
}


def test_whole_run_scores_and_reprices(spark, data, tmp_path):
    rows = S.driver_rows(spark, data)
    test = rows.where(F.col("contract_number") % 5 == 0).drop("is_claim", "claim_amount", "claim_cnt")
    out = str(tmp_path / "artifacts")
    cfg = X.read_config(CONFIG)
    record = X.run_experiment(spark, rows, cfg, out, test, "r1")
    run = K.latest_path(spark, out)
    assert run == record["path"] and read_leaderboard(spark, f"{out}/leaderboard").count() == 1
    answer = spark.read.option("header", True).csv(f"{run}/submission")
    assert answer.count() == test.count() and answer.where("new_premium is null").count() == 0
    for table in ("benchmark", "double_lift", "ae_by_risk", "ae_by_segment", "iv_summary", "bootstrap_ci", "quality_report", "valid_predictions", "test_predictions"):
        assert spark.read.parquet(f"{run}/{table}").count() > 0
    records = S.policies(spark, data).orderBy("contract_number").limit(50)
    priced = K.reprice_batch(spark, run, records)
    manual = K.reprice_batch(spark, run, records, alpha=0.0, beta=1.1)
    assert priced.count() == 50
    assert all(r["new_premium"] == pytest.approx(1.1 * r["premium"]) for r in manual.collect())


def test_boosted_winner_is_explained(spark, data, tmp_path):
    bench = {**CONFIG["benchmark"], "candidates": ["gbt_freq_sev"], "candidate_params": {"gbt_freq_sev": TREES}}
    out = str(tmp_path / "artifacts")
    record = X.run_experiment(spark, S.driver_rows(spark, data), X.read_config({**CONFIG, "benchmark": bench}), out, None, "r2")
    ranked = spark.read.parquet(f"{record['path']}/contributions").collect()
    assert record["winner"] == "gbt_freq_sev" and len(ranked) > 5 and max(r["mean_abs_contribution"] for r in ranked) > 0


def test_stream_gives_the_batch_prices(spark, policies, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    slim = policies.select("contract_number", "premium", "expected_loss").repartition(3)
    slim.write.parquet(source)
    policy = PricingPolicy("scalar", "grid", 0.3, 0.95, 100000.0)
    stream = T.reprice_stream(T.read_records(spark, source, slim.schema, 1), policy)
    T.write_prices(stream, sink, str(tmp_path / "check")).awaitTermination(120)
    got = {r["contract_number"]: r["new_premium"] for r in spark.read.parquet(sink).collect()}
    want = {r["contract_number"]: r["new_premium"] for r in K.reprice(slim, policy).collect()}
    assert got == pytest.approx(want) and len(got) == slim.count()
    with pytest.raises(ValueError):
        T.reprice_stream(slim, PricingPolicy("scalar", "grid", 0.3, 0.95))


def test_eda_writes_its_tables(spark, data, tmp_path):
    tables = X.run_eda(S.driver_rows(spark, data), str(tmp_path / "eda"))
    assert spark.read.parquet(str(tmp_path / "eda/tables/feature_action_board")).count() == tables["feature_action_board"].count() > 0
    assert spark.read.option("header", True).csv(str(tmp_path / "eda/feature_selection/feature_whitelist")).count() > 0


def test_model_queries_run_the_defaults():
    from unittest import mock

    from tariffspark.plans import model as P

    state = mock.Mock()
    state.families.return_value = {f"family_{i}": [] for i in range(5)}
    with mock.patch.object(P, "_splits", return_value=(None, state, "train", "valid")), mock.patch.object(P.M, "build_candidate") as build, \
            mock.patch.object(P.C, "oof_predictions") as oof, mock.patch.object(P.B, "ablation") as ablation:
        for name in ("gbt_freq_sev", "dependent_severity", "oof_predictions", "ablation"):
            P.QUERIES[name](None, None)
    assert all(not any(c.args[1:]) and not c.kwargs for c in build.call_args_list) and build.call_count == 2
    assert not oof.call_args.args[2:] and not oof.call_args.kwargs
    assert ablation.call_args.args[2] == state.families()
    assert not P.BENCH.params and len(P.PRICE.alphas) * len(P.PRICE.betas) == 6400 and min(t["iterations"] for t in P.TRIALS) >= 180


def test_halving_finds_the_trial_of_the_full_grid(halves):
    train, valid = halves
    trials = [{"iterations": n, "depth": k, "learning_rate": r} for n, k, r in ((8, 2, 0.3), (12, 3, 0.2), (4, 1, 0.02), (4, 2, 0.9))]
    config = B.BenchmarkConfig(must_pass=False)
    cut, reference = B.sweep(train, valid, "xgboost_freq_sev", trials, config, PRICE)
    whole, _ = B.sweep(train, valid, "gbt_freq_sev", trials, config, PRICE, rungs=(1.0,))
    cut, whole = ({r["trial"]: r for r in t.collect()} for t in (cut, whole))
    assert {r["status"] for r in whole.values()} == {"ok"} and reference is not None
    assert sorted(r["status"] for r in cut.values()) == ["ok", "stopped", "stopped", "stopped"]
    best = lambda t: max(t.values(), key=lambda r: (r["objective"], -r["trial"]))
    left = next(r for r in cut.values() if r["status"] == "ok")
    assert (left["objective"], left["gini"], left["lr_total"]) == (whole[left["trial"]]["objective"], whole[left["trial"]]["gini"], whole[left["trial"]]["lr_total"])
    assert left["objective"] >= sorted(r["objective"] for r in whole.values())[-2] and best(whole)["objective"] >= left["objective"]
