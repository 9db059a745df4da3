"""Whole runs: experiment, exploratory analysis, stability over time splits."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.models.bench import (
    Benchmark, BenchmarkConfig, PriceConfig, ablation, run_benchmark, run_candidate,
)
from tariffspark.models.calibrate import CalibratedModel, CalibrationConfig
from tariffspark.models.matrix import align
from tariffspark.operators import diagnostics as D
from tariffspark.operators import leakage as L
from tariffspark.operators import metrics as M
from tariffspark.operators import price_search as Z
from tariffspark.operators import pricing as R
from tariffspark.operators import profile as P
from tariffspark.operators import quality as Q
from tariffspark.operators import selection as C
from tariffspark.operators import split as O
from tariffspark.operators import woe as W
from tariffspark.operators import drift as X
from tariffspark.operators.encode import clean_numeric_columns
from tariffspark.operators.features import EXTENDED_INTERACTIONS
from tariffspark.operators.policy import aggregate_to_policy, check_submission, submission
from tariffspark.operators.preprocess import PreprocessConfig, fit_preprocessor, require_columns, train_matrix, transform
from tariffspark.roles import AMOUNT, CLAIM, CONTRACT, OPERATION_DATE, ROW_KEY, TARGETS, UNIQUE_ID
from tariffspark.session import materialize, scratch
from tariffspark.sources.runs import Attempt
from tariffspark.sources.tables import read_feature_list, write_table


@dataclass
class RunConfig:
    preprocess: PreprocessConfig = field(default_factory=PreprocessConfig)
    benchmark: BenchmarkConfig = field(default_factory=BenchmarkConfig)
    price: PriceConfig = field(default_factory=PriceConfig)
    scheme: str = "random"
    test_size: float = 0.2
    seed: int = 42
    group: str = CONTRACT
    date: str = OPERATION_DATE
    holdout_start: str | None = None
    folds: int = 5
    deciles: int = 10
    diagnostics: bool = True
    ablation: bool = False
    order_key: str = ROW_KEY
    train_path: str | None = None
    test_path: str | None = None
    artifacts: str | None = None


def _given(cls, raw: dict[str, Any]) -> dict[str, Any]:
    names = {f.name for f in fields(cls)}
    return {k: v for k, v in raw.items() if k in names}


def _feature_list(spark: SparkSession | None, path: str | None) -> list[str]:
    return sorted(read_feature_list(spark, path)) if spark is not None and path else []


def read_config(raw: dict[str, Any], spark: SparkSession | None = None) -> RunConfig:
    """Configuration from nested JSON (paths, split, validation, model, preprocessing, benchmark, pricing)."""
    prep, bench, pricing = raw.get("preprocessing") or {}, raw.get("benchmark") or {}, raw.get("pricing") or {}
    part = lambda name, source=prep: source.get(name) or {}
    default = PreprocessConfig()
    on = lambda section: section.get("enabled", True)
    target, freq, inter = part("target_encoding"), part("freq_encoding"), part("interaction_features")
    extended, pruning, drift = part("interaction_features_mvp"), part("feature_pruning"), part("drift_pruning")
    winsor = part("winsorize", part("outliers"))
    preprocess = PreprocessConfig(
        grain=prep.get("grain", default.grain), targets=prep.get("target_columns", default.targets),
        drop_columns=[*prep.get("drop_columns", default.drop_columns), ROW_KEY], forbidden=prep.get("forbidden_feature_columns", default.forbidden),
        whitelist=_feature_list(spark, prep.get("feature_whitelist_path")), droplist=_feature_list(spark, prep.get("feature_droplist_path")),
        force_keep=part("selection_rules").get("force_keep", default.force_keep), force_drop=part("selection_rules").get("force_drop", []),
        numeric_default=part("missing").get("numeric_default", "median"), financial_fill=part("missing").get("financial_fill", 0.0),
        missing_flag_threshold=part("missing").get("missing_flag_threshold", 0.05) if part("missing").get("add_missing_flags", True) else 2.0,
        missing_prefixes=part("missing").get("missing_aggregate_prefixes", default.missing_prefixes),
        winsor_low=winsor.get("low", 0.01), winsor_high=winsor.get("high", 0.99),
        rare_share=part("categorical").get("rare_threshold", 0.005), rare_count=part("categorical").get("rare_min_count", 200),
        date_columns=part("date_features").get("columns", default.date_columns), date_parts=part("date_features").get("features", default.date_parts),
        target_encoded=target.get("columns", default.target_encoded) if on(target) else [],
        frequency_encoded=freq.get("columns", default.frequency_encoded) if on(freq) else [],
        smoothing=target.get("smoothing", 20.0), min_leaf=target.get("min_samples_leaf", 100),
        log1p=part("transforms").get("log1p_columns", default.log1p),
        interactions=inter.get("definitions", default.interactions) if on(inter) else [],
        extended_interactions=extended.get("definitions", list(EXTENDED_INTERACTIONS)) if extended.get("enabled") else [],
        interaction_limits={"max_features": extended.get("max_features", 12), "corr": extended.get("corr_filter_threshold", 0.995),
                            "psi": extended.get("psi_filter_threshold", 0.6)},
        prune={k: pruning[k] for k in ("drop_exact_duplicates", "drop_missing_share", "corr_threshold") if k in pruning} if pruning.get("enabled") else None,
        drift={"share": drift.get("reference_share", 0.7), "threshold": drift.get("psi_threshold", 0.25), "bins": drift.get("bins", 10),
               "min_rows": drift.get("min_rows", 500), "exclude": drift.get("exclude_columns", []),
               "exclude_patterns": drift.get("exclude_patterns", [])} if drift.get("enabled") else None,
    )
    limits = bench.get("constraints") or {}
    model = raw.get("model") or {}
    params = {k: dict(v or {}) for k, v in (bench.get("candidate_params") or {}).items()}
    for name in ("baseline_freq_sev", "woe_freq_sev"):
        params.setdefault(name, {k: model[k] for k in ("max_iter", "ridge_alpha") if k in model})
    benchmark = BenchmarkConfig(
        candidates=bench.get("candidates") or ["baseline_freq_sev"], params=params, metric=bench.get("selection_metric", "policy_score"),
        stability_penalty=bench.get("stability_penalty", 0.0), must_pass=bench.get("must_pass_constraints", True), limits=limits,
        fallback=bench.get("fallback_strategy", "best_metric"), fallback_candidate=bench.get("fallback_candidate", "baseline_freq_sev"),
        calibration=CalibrationConfig(**_given(CalibrationConfig, bench.get("calibration") or {})))
    if bench and not bench.get("enabled", True):
        benchmark.candidates = ["baseline_freq_sev"]
        benchmark.must_pass = False
    grid = lambda g: [float(v) for v in np.linspace(g["start"], g["stop"], max(1, int(g["num"])))]
    band, optimisation = pricing.get("target_band") or {}, pricing.get("optimization") or {}
    method = str(optimisation.get("method", pricing.get("optimization_method", "grid"))).strip().lower()
    between = lambda d, lo, hi: (float(d[lo]), float(d[hi])) if lo in d and hi in d else None
    price = PriceConfig(
        target_lr=float(pricing.get("target_lr", 0.7)),
        alphas=grid(pricing["alpha_grid"]) if "alpha_grid" in pricing else [0.0],
        betas=grid(pricing["beta_grid"]) if pricing.get("beta_grid") else [1.0],
        band=between(band, "min", "max") or between(limits, "lr_total_min", "lr_total_max"),
        # A derivative-based optimiser is replaced by ever finer grids around the optimum.
        method="refine" if method == "slsqp" else method,
        retention=R.Retention(**_given(R.Retention, pricing.get("retention") or {})),
        stratified=Z.StratifiedSearch(**_given(Z.StratifiedSearch, pricing.get("stratified") or {})))
    validation, split, paths = raw.get("validation") or {}, raw.get("split") or {}, raw.get("paths") or {}
    report = raw.get("diagnostics") or raw.get("reports") or {}
    return RunConfig(
        preprocess, benchmark, price, str(validation.get("scheme", "random")).strip().lower(), float(split.get("test_size", 0.2)), int(split.get("random_state", 42)),
        validation.get("group_column", CONTRACT), validation.get("time_column", OPERATION_DATE), validation.get("time_holdout_start"),
        int(validation.get("group_kfold_n_splits", 5)), int(report.get("deciles", 10)), bool(report.get("enabled", True)),
        bool((raw.get("ablation") or {}).get("enabled", True)),
        train_path=paths.get("train_csv"), test_path=paths.get("test_csv"), artifacts=paths.get("artifacts_dir"))


def split_policies(policy: DataFrame, cfg: RunConfig) -> tuple[DataFrame, DataFrame, str]:
    """Train and valid policies by the configured scheme, and the scheme that was really used."""
    if cfg.scheme == "group_time":
        labelled, used = O.split_group_time(policy, cfg.test_size, cfg.holdout_start, cfg.date, cfg.group, cfg.seed)
    elif cfg.scheme == "group":
        labelled, used = O.split_group(policy, cfg.test_size, cfg.group, cfg.seed), "group"
    else:
        labelled, used = O.split_random(policy, cfg.test_size, cfg.preprocess.grain, CLAIM, cfg.seed), "random"
    labelled = materialize(labelled, "split")
    return tuple(labelled.where(F.col("split") == side).drop("split") for side in ("train", "valid")) + (used,)


def with_row_key(df: DataFrame, key: str = ROW_KEY) -> DataFrame:
    """Order-dependent steps need a key that decides ties; without one the row's full content serves."""
    if key in df.columns:
        return df
    return df.withColumn(key, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))


def run_experiment(spark: SparkSession, rows: DataFrame, cfg: RunConfig, out: str, test_rows: DataFrame | None = None,
                   run_id: str | None = None) -> dict[str, Any]:
    """Validate, aggregate, split, prepare, benchmark, diagnose, price the test rows; everything is written under ``out``.

    The run is visible once all of it is written; its intermediate tables are deleted at the end.
    """
    attempt = Attempt(spark, out, run_id or datetime.now(UTC).strftime("%Y%m%d_%H%M%S"))
    with scratch(spark, "experiment"):
        return attempt.publish(_experiment(spark, rows, cfg, attempt, test_rows))


def _experiment(spark: SparkSession, rows: DataFrame, cfg: RunConfig, attempt: Attempt, test_rows: DataFrame | None) -> dict[str, Any]:
    """The leaderboard row of a run whose tables were written to ``attempt``."""
    run = attempt.path
    rows = with_row_key(rows, cfg.order_key)
    Q.require_valid(rows)
    policy = materialize(aggregate_to_policy(rows, cfg.preprocess.grain, cfg.order_key), "policy")
    train, valid, scheme = split_policies(policy, cfg)
    state = fit_preprocessor(train, cfg.preprocess)
    group = cfg.group if "group" in scheme else None
    train_x = materialize(train_matrix(train, state, cfg.folds, group), "train-x")
    valid_x = materialize(transform(valid, state), "valid-x")
    require_columns(train_x, [CLAIM, AMOUNT])
    full_x = transform(policy, state)
    for name, table in (("full", full_x), ("train", train_x), ("valid", valid_x)):
        attempt.table(table, f"preprocessed/{name}")
    state.save(spark, f"{run}/preprocessor")
    attempt.table(Q.quality_report({"raw": rows, "policy": policy, "processed": full_x}), "quality_report")
    attempt.state({"scheme": scheme, "features": state.features, "pruning": state.pruning}, "split")

    result: Benchmark = run_benchmark(train_x, valid_x, cfg.benchmark, cfg.price)
    winner = result.winner
    attempt.table(result.table, "benchmark")
    winner.model.save(spark, f"{run}/model")
    attempt.state(json.loads(winner.policy.to_json()), "pricing_policy")
    grain = cfg.preprocess.grain
    losses = winner.predictions.select(F.col(grain).alias("_grain"), "p_claim", "expected_severity", "expected_loss")
    predicted = valid.join(losses, F.col(grain).eqNullSafe(F.col("_grain"))).drop("_grain")
    priced = materialize(R.price_delta(R.apply_policy(predicted, winner.policy)), "priced")
    attempt.table(priced, "valid_predictions")

    if cfg.diagnostics:
        attempt.table(D.double_lift(priced, cfg.deciles, cfg.preprocess.grain), "double_lift")
        risk = materialize(D.ae_by_risk(priced, cfg.deciles, cfg.preprocess.grain), "ae")
        attempt.table(risk, "ae_by_risk")
        attempt.table(D.worst_ae(risk), "ae_summary")
        attempt.table(D.ae_by_segment(priced), "ae_by_segment")
        bins = materialize(W.woe_bins(train_x), "woe")
        attempt.table(W.iv_report(bins), "woe_report")
        attempt.table(W.iv_summary(bins), "iv_summary")
        attempt.table(M.bootstrap_ci(priced, cfg.preprocess.grain), "bootstrap_ci")
        base = winner.model.base if isinstance(winner.model, CalibratedModel) else winner.model
        frequency = base.fitted.stages.get("gbt_class") if base.fitted is not None else None
        if frequency is not None and frequency.binning.columns:
            attempt.table(D.tree_contribution_rank(align(valid_x, base.fitted.schema), frequency), "contributions")
    if cfg.ablation:
        attempt.table(ablation(train_x, valid_x, state.families(), cfg.benchmark, cfg.price), "ablation")
    if test_rows is not None:
        tested = with_row_key(test_rows, cfg.order_key)
        test_policy = aggregate_to_policy(tested, cfg.preprocess.grain, cfg.order_key)
        test_priced = R.apply_policy(winner.model.predict(transform(test_policy, state)), winner.policy)
        answer = materialize(submission(tested, test_priced, UNIQUE_ID, cfg.preprocess.grain), "submission")
        check_submission(tested, answer)
        attempt.table(test_priced, "test_predictions")
        attempt.table(answer, "submission", "csv")
    metrics = {**{k: winner.ml.get(k) for k in ("auc", "gini", "brier")},
               **{k: winner.pricing.get(k) for k in ("policy_score", "lr_total", "lr_group1", "lr_group2", "share_group1", "in_target")}}
    return {"winner": winner.name, "selection_reason": result.reason, "scheme": scheme, "feature_count": len(state.features),
            **{k: float(v) if v is not None else float("nan") for k, v in metrics.items()}}


def run_eda(rows: DataFrame, out: str, test_rows: DataFrame | None = None, order_key: str = ROW_KEY) -> dict[str, DataFrame]:
    """All exploratory tables, written under ``out`` and read from there."""
    with scratch(rows.sparkSession, "eda"):
        names = _eda(rows, out, test_rows, order_key)
    return {name: rows.sparkSession.read.parquet(f"{out}/tables/{name}") for name in names}


def _eda(rows: DataFrame, out: str, test_rows: DataFrame | None, order_key: str) -> list[str]:
    """Names of the tables written."""
    rows = materialize(with_row_key(rows, order_key), "rows")
    policy = materialize(aggregate_to_policy(rows, order_key=order_key), "policy")
    test = test_rows if test_rows is not None else rows.drop(*TARGETS)
    train_only, test_only = P.schema_difference(rows, test)
    features = [c for c in P.numeric_columns(rows, [*TARGETS, *L.FORBIDDEN])]
    text = [c for c in P.string_columns(rows) if c != order_key]
    windows = materialize(X.time_windows(rows, OPERATION_DATE, order_key), "windows")
    psi = materialize(X.psi(windows, features, mode="closed").where("psi is not null"), "psi")
    leakage = materialize(L.leakage_risk(rows.drop(order_key), train_only), "leakage")
    missing = P.missing_rates(rows.drop(order_key)).withColumnRenamed("null_rate", "missing_rate")
    names = [(c, "train_only") for c in train_only if c != order_key] + [(c, "test_only") for c in test_only]
    tables = {
        "layer_sizes": P.layer_sizes({"train": rows, "test": test, "policy": policy}),
        "schema_diff": rows.sparkSession.createDataFrame(names, "feature string, side string"),
        "rows_per_contract": P.rows_per_contract(rows), "policy_vs_driver": P.policy_vs_driver(rows), "missing_rates": missing,
        "numeric_summary": P.numeric_summary(rows, features), "categorical_cardinality": P.categorical_cardinality(rows, text),
        "leakage_watchlist": L.leakage_watchlist(rows), "leakage_blacklist": L.identifier_blacklist(rows),
        "target_distribution": P.target_distribution(rows), "claim_amount_hist": P.claim_amount_histogram(rows),
        "contract_size_hist": P.contract_size_histogram(rows), "target_by_month": P.target_by_month(rows),
        "leakage_risk_rank": leakage, "drift_psi": psi, "categorical_shift": X.categorical_shift(windows, text),
        "segment_kpis": P.segment_kpis(clean_numeric_columns(rows)), "feature_action_board": L.feature_action_board(missing, leakage, psi),
        "feature_selection": L.feature_selection(policy), "eda_profile": P.eda_profile(rows),
    }
    for name, table in tables.items():
        write_table(table, f"{out}/tables/{name}")
    selection = tables["feature_selection"]
    for decision, name in (("keep", "feature_whitelist"), ("drop", "feature_droplist"), ("review", "feature_review")):
        write_table(selection.where(F.col("decision") == decision).select("feature", "reason"), f"{out}/feature_selection/{name}", "csv")
    return list(tables)


def run_stability(rows: DataFrame, cfg: RunConfig, cutoffs: Sequence[str], candidate: str, penalty: float = 1.0,
                  out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit and price a candidate once per cut-off; the results per split and their summary."""
    with scratch(rows.sparkSession, "stability"):
        return _stability(rows, cfg, cutoffs, candidate, penalty, out)


def _stability(rows: DataFrame, cfg: RunConfig, cutoffs: Sequence[str], candidate: str, penalty: float, out: str | None) -> tuple[DataFrame, DataFrame]:
    rows = with_row_key(rows, cfg.order_key)
    policy = materialize(aggregate_to_policy(rows, cfg.preprocess.grain, cfg.order_key), "policy")
    records = []
    for cutoff in cutoffs:
        here = RunConfig(**{**cfg.__dict__, "scheme": "group_time", "holdout_start": cutoff})
        train, valid, scheme = split_policies(policy, here)
        state = fit_preprocessor(train, cfg.preprocess)
        train_x = materialize(train_matrix(train, state, cfg.folds, cfg.group if "group" in scheme else None), "train-x")
        found = run_candidate(candidate, train_x, transform(valid, state), cfg.benchmark, cfg.price)
        records.append((cutoff, found.status, found.error, int(found.passes), found.pricing.get("in_target"), found.pricing.get("violations"),
                        *[found.pricing.get(k) for k in ("policy_score", "lr_total", "lr_group1", "lr_group2", "share_group1", "distance_to_target")],
                        found.ml.get("auc"), found.ml.get("gini")))
    results = rows.sparkSession.createDataFrame(
        records, "split_value string, status string, error string, passes_constraints int, in_target int, violations long, policy_score double, "
        "lr_total double, lr_group1 double, lr_group2 double, share_group1 double, distance_to_target double, auc double, gini double")
    summary = C.stability_summary(results, penalty)
    if out:
        write_table(results, f"{out}/results")
        write_table(summary, f"{out}/summary")
    return results, summary
