"""Benchmark of candidate models: fit, calibrate, price, check, choose."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.models import boosting as G
from tariffspark.models.calibrate import BlendModel, CalibratedModel, CalibrationConfig, fit_calibrator, oof_predictions
from tariffspark.models.freqsev import MIN_CLAIMS, BoostedFrequencySeverity, RiskModel, boost_blocks, build_candidate, severity_constant
from tariffspark.models.matrix import infer_schema
from tariffspark.operators import metrics as M
from tariffspark.operators import price_search as Z
from tariffspark.operators import pricing as R
from tariffspark.operators import selection as C
from tariffspark.roles import AMOUNT, CLAIM, CONTRACT, PREDICTION, PREMIUM, PREMIUM_NET
from tariffspark.session import materialize

# Candidate names that older configurations use for boosted trees.
ALIASES = {"xgboost_freq_sev": "gbt_freq_sev", "lightgbm_freq_sev": "gbt_freq_sev", "catboost_freq_sev": "gbt_freq_sev",
           "catboost_dep_freq_sev": "gbt_dep_freq_sev"}


@dataclass
class PriceConfig:
    target_lr: float = 0.7
    alphas: Sequence[float] = (0.0,)
    betas: Sequence[float] = (1.0,)
    band: tuple[float, float] | None = None
    method: str = "grid"
    retention: R.Retention | None = None
    stratified: Z.StratifiedSearch | None = None


@dataclass
class BenchmarkConfig:
    candidates: Sequence[str] = ("baseline_freq_sev",)
    params: Mapping[str, dict[str, Any]] = field(default_factory=dict)
    metric: str = "policy_score"
    stability_penalty: float = 0.0
    must_pass: bool = True
    limits: Mapping[str, float] = field(default_factory=dict)
    fallback: str = "best_metric"
    fallback_candidate: str = "baseline_freq_sev"
    calibration: CalibrationConfig = field(default_factory=CalibrationConfig)


@dataclass
class Candidate:
    name: str
    status: str = "ok"
    error: str | None = None
    seconds: float = 0.0
    model: RiskModel | None = None
    policy: R.PricingPolicy | None = None
    ml: dict[str, Any] = field(default_factory=dict)
    severity: dict[str, Any] = field(default_factory=dict)
    pricing: dict[str, Any] = field(default_factory=dict)
    passes: bool = False
    reasons: str = ""
    metadata: dict[str, Any] = field(default_factory=dict)
    predictions: DataFrame | None = None

    def record(self, ordinal: int) -> dict[str, Any]:
        number = lambda v: None if v is None else float(v)
        keep = ("lr_total", "lr_group1", "lr_group2", "share_group1", "policy_score", "distance_to_target")
        return {
            "ordinal": ordinal, "candidate": self.name, "status": self.status, "error": self.error,
            "passes_constraints": int(self.passes), "reasons": self.reasons,
            "alpha": number(self.policy.alpha) if self.policy else None, "beta": number(self.policy.beta) if self.policy else None,
            "pricing_policy_kind": self.policy.kind if self.policy else None,
            **{k: number(self.ml.get(k)) for k in ("auc", "gini", "brier")},
            **{f"severity_{k}": number(self.severity.get(k)) for k in ("rmse", "mae", "r2")},
            **{k: number(self.pricing.get(k)) for k in keep},
            "in_target": self.pricing.get("in_target"), "violations": number(self.pricing.get("violations")),
            "calibration_status": getattr(self.metadata.get("calibration"), "status", None), "seconds": float(self.seconds),
        }


RECORD_SCHEMA = ("ordinal int, candidate string, status string, error string, passes_constraints int, reasons string, alpha double, beta double, "
                 "pricing_policy_kind string, auc double, gini double, brier double, severity_rmse double, severity_mae double, severity_r2 double, "
                 "lr_total double, lr_group1 double, lr_group2 double, share_group1 double, policy_score double, distance_to_target double, "
                 "in_target int, violations double, calibration_status string, seconds double")


def evaluate_predictions(predicted: DataFrame, price: PriceConfig, limits: Mapping[str, float]) -> dict[str, Any]:
    """Model metrics, the best tariff and its KPIs for predictions on a validation split."""
    wanted = [c for c in (CONTRACT, CLAIM, AMOUNT, PREMIUM, PREMIUM_NET, *PREDICTION) if c in predicted.columns]
    kept = materialize(predicted.select(*wanted), "valid")
    policy, kpis = Z.select_pricing(kept, price.alphas, price.betas, price.target_lr, price.band, price.method, price.retention, price.stratified)
    row = C.check_constraints(kpis, limits).first().asDict()
    return {
        "ml": M.classification_metrics(kept).first().asDict(), "severity": M.severity_metrics(kept).first().asDict(),
        "policy": policy, "pricing": row, "passes": bool(row["passes_constraints"]), "reasons": row["reasons"], "predictions": kept,
    }


def run_candidate(name: str, train: DataFrame, valid: DataFrame, config: BenchmarkConfig, price: PriceConfig,
                  factory: Callable[[str, dict | None], RiskModel] = build_candidate) -> Candidate:
    """Fit and evaluate one candidate; an error becomes a failed row instead of ending the run."""
    start, out = time.monotonic(), Candidate(name)
    kind = ALIASES.get(name, name)
    params = dict(config.params.get(name) or {})
    try:
        if kind == BlendModel.kind:
            out.model, out.metadata = fit_blend(train, config, price, params)
        else:
            out.model = factory(kind, params).fit(train)
        if config.calibration.enabled and kind != BlendModel.kind:
            calibrator, report = fit_calibrator(train, kind, config.calibration, params)
            out.metadata["calibration"] = report
            if calibrator is not None:
                out.model = CalibratedModel(out.model, calibrator)
        found = evaluate_predictions(out.model.predict(valid), price, config.limits)
        out.policy, out.ml, out.severity, out.pricing = found["policy"], found["ml"], found["severity"], found["pricing"]
        out.passes, out.reasons, out.predictions = found["passes"], found["reasons"], found["predictions"]
    except Exception as exc:  # noqa: BLE001 - one candidate must not stop the others
        out.status, out.error = "failed", f"{type(exc).__name__}: {exc}"[:500]
    out.seconds = time.monotonic() - start
    return out


def fit_blend(train: DataFrame, config: BenchmarkConfig, price: PriceConfig, params: dict[str, Any]) -> tuple[BlendModel, dict[str, Any]]:
    """Choose blend weights on out-of-fold rows, then refit the bases on all of them."""
    bases = list(params.get("base_candidates") or ["baseline_freq_sev", "gbt_freq_sev"])
    kinds = {b: ALIASES.get(b, b) for b in bases}
    if len(set(kinds.values())) < len(bases):
        bases = list({kinds[b]: b for b in reversed(bases)}.values())[::-1]
    folds, group = int(params.get("oof_folds", 5)), str(params.get("oof_group_column", CONTRACT))
    joined = train.select(CONTRACT, PREMIUM, PREMIUM_NET, AMOUNT, CLAIM)
    for b in bases:
        resume = f"{params['checkpoint_dir']}/{b}" if params.get("checkpoint_dir") else None
        oof = oof_predictions(train, kinds[b], config.params.get(b), folds, group, resume)
        loss = oof.select(F.col(CONTRACT).alias("_contract"), F.col("expected_loss").alias(f"{b}_loss"))
        joined = joined.join(loss, F.col(CONTRACT).eqNullSafe(F.col("_contract"))).drop("_contract")
    table = Z.blend_weight_search(materialize(joined, "oof"), [f"{b}_loss" for b in bases], price.alphas, price.betas,
                                  float(params.get("weight_grid_step", 0.1)), price.target_lr, price.band, dict(config.limits), config.metric,
                                  price.method, price.retention, price.stratified)
    chosen = table.where("chosen = 1").first()
    weights = {b: float(chosen[f"w_{b}_loss"]) for b in bases}
    models = {b: build_candidate(kinds[b], config.params.get(b)).fit(train) for b in bases if weights[b] > 0}
    return BlendModel(models, weights), {"base_candidates": bases, "weights": weights, "oof_policy_score": chosen["policy_score"],
                                         "oof_constraints_pass": bool(chosen["passes"]), "oof_alpha": chosen["alpha"], "oof_beta": chosen["beta"]}


@dataclass
class Benchmark:
    candidates: list[Candidate]
    winner: Candidate
    reason: str
    table: DataFrame


def run_benchmark(train: DataFrame, valid: DataFrame, config: BenchmarkConfig, price: PriceConfig,
                  factory: Callable[[str, dict | None], RiskModel] = build_candidate) -> Benchmark:
    """Run all candidates one after the other; each fit uses the whole cluster."""
    train, valid = materialize(train, "train"), materialize(valid, "valid")
    found = [run_candidate(n, train, valid, config, price, factory) for n in config.candidates]
    table = benchmark_table(train, found)
    choice = C.select_winner(table, config.metric, config.stability_penalty, config.must_pass, config.fallback, config.fallback_candidate).first()
    winner = next(c for c in found if c.name == choice["candidate"])
    return Benchmark(found, winner, choice["reason"], table)


def benchmark_table(df: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    order = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    rows = [tuple(c.record(i)[k] for k in order) for i, c in enumerate(candidates)]
    return df.sparkSession.createDataFrame(rows, RECORD_SCHEMA)


def ablation(train: DataFrame, valid: DataFrame, families: Mapping[str, Sequence[str]], config: BenchmarkConfig, price: PriceConfig,
             candidate: str = "baseline_freq_sev") -> DataFrame:
    """Score without each feature family, and its difference to the full model."""
    train, valid = materialize(train, "train"), materialize(valid, "valid")
    protected = {CONTRACT, CLAIM, AMOUNT, "claim_cnt"}
    rows, full = [], None
    for name, family in {"full_model": [], **families}.items():
        gone = [c for c in family if c in train.columns and c not in protected]
        if not set(train.columns) - set(gone) - protected:
            rows.append((name, "failed", "no_features_left_after_ablation", ";".join(gone), len(gone), None, None, None, None, None))
            continue
        # Pricing needs the premiums even where a model may not see them.
        out = run_candidate(candidate, train.drop(*gone), valid.drop(*[c for c in gone if c not in (PREMIUM, PREMIUM_NET)]), config, price)
        score = out.pricing.get("policy_score")
        full = score if name == "full_model" else full
        rows.append((name, out.status, out.error, ";".join(gone), len(gone), score, out.pricing.get("lr_total"), out.ml.get("auc"), out.ml.get("gini"),
                     score - full if score is not None and full is not None else None))
    return train.sparkSession.createDataFrame(rows, "ablation_name string, status string, error string, dropped_columns string, dropped_count int, "
                                              "policy_score double, lr_total double, auc double, gini double, delta_vs_full_policy_score double")


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], Any]], at_once: int = 4) -> list[Any]:
    """Results of ``jobs``, some of them at a time, each in a scheduler pool of its own: with the fair scheduler they share the cluster evenly."""
    def pooled(place: int, job: Callable[[], Any]):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{place}")
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(jobs)))) as pool:
        # Every thread takes the caller's scratch folder along.
        return [f.result() for f in [pool.submit(copy_context().run, pooled, place, job) for place, job in enumerate(jobs)]]


def sweep(train: DataFrame, valid: DataFrame, candidate: str, trials: Sequence[dict[str, Any]], config: BenchmarkConfig, price: PriceConfig,
          baseline: str = "baseline_freq_sev", rungs: Sequence[float] = (0.25, 0.5, 1.0)) -> tuple[DataFrame, float | None]:
    """All parameter sets of a candidate as rows (trial, params, KPIs), and the baseline's score. The splits are written once.

    Boosted trees run by successive halving: all trials grow together on one binned matrix, and after each share of their
    trees in ``rungs`` the better half by objective goes on (the earlier trial on ties). Stopped trials keep the KPIs of
    their last rung and the status ``stopped``; ``rungs=(1.0,)`` runs all of them in full.
    """
    spark = train.sparkSession
    train, valid = materialize(train, "train"), materialize(valid, "valid")
    reference = run_candidate(baseline, train, valid, config, price).pricing.get("policy_score")
    merged = [{**(config.params.get(candidate) or {}), **t} for t in trials]
    if ALIASES.get(candidate, candidate) == BoostedFrequencySeverity.kind:
        done = halving(train, valid, merged, config, price, rungs)
    else:
        settings = [BenchmarkConfig(**{**config.__dict__, "params": {**config.params, candidate: p}}) for p in merged]
        done = side_by_side(spark, [lambda use=use: run_candidate(candidate, train, valid, use, price) for use in settings])
    texts = spark.createDataFrame([(i, json.dumps(p, sort_keys=True)) for i, p in enumerate(trials)], "ordinal int, params string")
    table = benchmark_table(train, done).join(texts, "ordinal").withColumnRenamed("ordinal", "trial")
    return C.single_objective(table), reference


def halving(train: DataFrame, valid: DataFrame, trials: Sequence[dict[str, Any]], config: BenchmarkConfig, price: PriceConfig,
            rungs: Sequence[float]) -> list[Candidate]:
    """Every trial's candidate: trained in full if it survived, else as far as it came."""
    start, spark = time.monotonic(), train.sparkSession
    models = [BoostedFrequencySeverity(**t) for t in trials]
    out = [Candidate(BoostedFrequencySeverity.kind, metadata={"params": t}) for t in trials]
    schema, constant = infer_schema(train), severity_constant(train).first()
    matrices, tasks = {}, []
    for m in models:
        bins = int(m.params["bins"])
        if bins not in matrices:
            binning = m.binning(train, schema, bins)
            matrices[bins] = (binning, boost_blocks(train, schema, binning, constant["severity_constant"]))
        tasks.append((G.Task(m.settings(), "claim"), m.severity_task(constant) if constant["claims"] >= MIN_CLAIMS else None))

    def evaluated(i: int) -> None:
        frequency, severity = tasks[i]
        model = models[i].take(schema, matrices[int(models[i].params["bins"])][0], frequency, severity, constant["severity_constant"])
        one = out[i]
        try:
            found = evaluate_predictions(model.predict(valid), price, config.limits)
            one.model, one.policy, one.ml, one.severity, one.pricing = model, found["policy"], found["ml"], found["severity"], found["pricing"]
            one.passes, one.reasons, one.predictions = found["passes"], found["reasons"], found["predictions"]
        except Exception as exc:  # noqa: BLE001 - one trial must not stop the others
            one.status, one.error = "failed", f"{type(exc).__name__}: {exc}"[:500]
        one.seconds = time.monotonic() - start

    alive = list(range(len(trials)))
    try:
        for rung in rungs:
            for bins, (_, blocks) in matrices.items():
                mine = [t for i in alive if int(models[i].params["bins"]) == bins for t in tasks[i] if t is not None]
                if mine:
                    G.grow(blocks, mine, [math.ceil(t.params.trees * rung) for t in mine])
            side_by_side(spark, [lambda i=i: evaluated(i) for i in alive])
            if rung != rungs[-1]:
                order = C.single_objective(benchmark_table(train, out)).orderBy(F.desc_nulls_last("objective"), "ordinal").select("ordinal", "status").collect()
                ranked = [r["ordinal"] for r in order if r["ordinal"] in alive and r["status"] == "ok"]
                stay = ranked[:math.ceil(len(ranked) / 2)]
                for i in alive:
                    if i not in stay and out[i].status == "ok":
                        out[i].status = "stopped"
                alive = stay
    finally:
        for _, blocks in matrices.values():
            blocks.unpersist()
    return out


def refit_and_price(full: DataFrame, test: DataFrame, candidate: str, params: dict[str, Any] | None, policy: R.PricingPolicy) -> DataFrame:
    """Fit on all policies, then price the test policies with the tariff found on the holdout."""
    model = build_candidate(ALIASES.get(candidate, candidate), params).fit(full)
    return R.apply_policy(model.predict(test), policy)
