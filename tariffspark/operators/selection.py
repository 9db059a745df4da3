"""Choosing among candidates: constraints, winner, objectives, stability, top trials."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMITS = {"max_violations": 0, "lr_total_min": 0.69, "lr_total_max": 0.71, "share_group1_min": 0.0, "share_group1_max": 1.0}


def constraint_columns(limits: Mapping[str, float] | None = None) -> dict[str, Column]:
    """``passes`` and the list of broken limits (``reasons``) as expressions over KPI columns."""
    use = {**DEFAULT_LIMITS, **(limits or {})}
    rules = [(f"violations>{use['max_violations']}", F.coalesce(F.col("violations"), F.lit(0)) > use["max_violations"])]
    for column in ("lr_total", "share_group1"):
        low, high = use[f"{column}_min"], use[f"{column}_max"]
        rules.append((f"{column}<{low}", F.col(column) < low))
        rules.append((f"{column}>{high}", F.col(column) > high))
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(label)) for label, cond in rules]))
    return {"passes": F.size(reasons) == 0, "reasons": reasons}


def check_constraints(kpis: DataFrame, limits: Mapping[str, float] | None = None) -> DataFrame:
    found = constraint_columns(limits)
    return kpis.withColumn("reasons", F.array_join(found["reasons"], "|")).withColumn("passes_constraints", found["passes"].cast("int"))


def select_winner(results: DataFrame, metric: str = "policy_score", stability_penalty: float = 0.0, must_pass: bool = False,
                  fallback: str = "best_available", fallback_candidate: str | None = None) -> DataFrame:
    """(candidate, reason): the best compliant candidate, else the configured or the best one.

    Candidates rank by metric minus ``stability_penalty`` times its deviation,
    then by gini; of equals the first by ``ordinal`` wins.
    """
    usable = results.where(F.col("status") == "ok")
    deviation = F.coalesce(F.col(f"{metric}_std"), F.lit(0.0)) if f"{metric}_std" in results.columns else F.lit(0.0)
    lowest = F.lit(float("-inf"))
    order = F.struct(
        F.coalesce(F.col(metric), lowest) - F.lit(max(stability_penalty, 0.0)) * deviation,
        F.coalesce(F.col("gini"), lowest), -F.col("ordinal"))
    passing = F.col("passes_constraints") == 1
    best = usable.agg(
        F.count("*").alias("n"),
        F.max_by(F.when(passing, F.col("candidate")), F.when(passing, order)).alias("compliant"),
        F.max_by("candidate", order).alias("any"),
        F.max(F.when(F.col("candidate") == fallback_candidate, F.col("candidate"))).alias("configured") if fallback_candidate
        else F.lit(None).cast("string").alias("configured"),
    )
    stop = F.raise_error(F.lit("no compliant candidate")).cast("string") if must_pass else F.lit(None).cast("string")
    use_configured = F.col("configured").isNotNull() & F.lit(fallback == "configured_candidate")
    return best.select(
        F.when(F.col("n") == 0, F.raise_error(F.lit("no usable candidate")).cast("string"))
        .when(F.col("compliant").isNotNull(), F.col("compliant"))
        .when(F.lit(must_pass), stop)
        .when(use_configured, F.col("configured")).otherwise(F.col("any")).alias("candidate"),
        F.when(F.col("compliant").isNotNull(), "best_compliant_candidate")
        .when(use_configured, "fallback_no_compliant_candidates").otherwise("best_available_no_compliant_candidates").alias("reason"),
    )


def single_objective(trials: DataFrame) -> DataFrame:
    """The policy score of a trial that passes and lies in the band, else a large penalty."""
    good = (F.col("status") == "ok") & (F.col("passes_constraints") == 1) & (F.col("in_target") == 1)
    penalty = F.lit(-1_000_000.0) - F.col("distance_to_target") - F.lit(100.0) * F.greatest(F.col("violations"), F.lit(0))
    return trials.withColumn("objective", F.when(good, F.col("policy_score")).otherwise(penalty))


def stability_objective(results: DataFrame, by: Sequence[str] = ("trial",), penalty: float = 1.0, min_pass_rate: float = 1.0,
                        min_band_rate: float = 1.0) -> DataFrame:
    """Per trial over its splits: mean minus ``penalty`` deviations of the compliant scores, behind two gates."""
    ok = F.col("status") == "ok"
    passes, inside = ok & (F.col("passes_constraints") == 1), ok & (F.col("in_target") == 1)
    scored = F.when(passes & inside, F.col("policy_score"))
    per_trial = results.groupBy(*by).agg(
        F.count("*").alias("split_count"),
        (F.count_if(passes) / F.count("*")).alias("constraints_pass_rate"),
        (F.count_if(inside) / F.count("*")).alias("in_target_rate"),
        F.avg(scored).alias("policy_score_mean"), F.stddev_pop(scored).alias("policy_score_std"), F.count(scored).alias("policy_score_count"),
        F.avg(F.when(ok, F.col("lr_total"))).alias("lr_total_mean"),
        F.avg("distance_to_target").alias("distance_mean"), F.max("violations").alias("max_violations"),
    )
    gates = ((F.col("constraints_pass_rate") >= min_pass_rate) & (F.col("in_target_rate") >= min_band_rate) & F.col("policy_score_mean").isNotNull())
    short = lambda need, rate: F.greatest(F.lit(0.0), F.lit(float(need)) - F.col(rate))
    failed = (F.lit(-1_000_000.0) - F.lit(10_000.0) * short(min_pass_rate, "constraints_pass_rate")
              - F.lit(10_000.0) * short(min_band_rate, "in_target_rate") - F.col("distance_mean") - F.lit(100.0) * F.col("max_violations"))
    passed = F.col("policy_score_mean") - F.lit(max(penalty, 0.0)) * F.col("policy_score_std")
    return per_trial.withColumn("objective", F.when(gates, passed).otherwise(failed)).withColumn(
        "status", F.when(gates, "ok").otherwise("gates_failed"))


def stability_summary(results: DataFrame, penalty: float = 1.0) -> DataFrame:
    """One row over the splits of a candidate: mean, deviation, pass rates, objective."""
    return results.agg(
        F.count("*").alias("n_splits"), F.avg(F.coalesce("in_target", F.lit(0))).alias("in_target_rate"),
        F.avg(F.coalesce("passes_constraints", F.lit(0))).alias("constraints_pass_rate"), F.max("violations").alias("max_violations"),
        F.avg("policy_score").alias("mean_policy_score"), F.stddev_pop("policy_score").alias("std_policy_score"),
        F.avg("lr_group1").alias("mean_lr_group1"), F.avg("lr_group2").alias("mean_lr_group2"), F.avg("share_group1").alias("mean_share_group1"),
    ).withColumn("objective", F.col("mean_policy_score") - F.lit(max(penalty, 0.0)) * F.col("std_policy_score"))


def top_trials(trials: DataFrame, n: int = 5, by: str = "objective", baseline: float | None = None) -> DataFrame:
    """Best trials by objective then trial number, or by (passes, score, gini); a distributed top-k."""
    order = ([F.desc_nulls_last("objective"), F.asc("trial")] if by == "objective"
             else [F.desc("passes_constraints"), F.desc_nulls_last("policy_score"), F.desc_nulls_last("gini"), F.asc("trial")])
    top = trials.orderBy(*order).limit(n)
    return top.withColumn("delta_policy_score", F.col("policy_score") - F.lit(float(baseline))) if baseline is not None else top


def rank_models(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("gini"), F.desc_nulls_last("auc"), "candidate")


def blend_predictions(df: DataFrame, predictions: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Linear blend of ``<name>_p_claim`` / ``_expected_severity`` / ``_expected_loss``; zero weights are left out."""
    used = [(n, float(weights.get(n, 0.0))) for n in predictions if float(weights.get(n, 0.0)) > 0]
    if not used:
        raise ValueError("blend weights leave no prediction")
    out = {}
    for column in ("p_claim", "expected_severity", "expected_loss"):
        total = None
        for name, w in used:
            term = F.col(f"{name}_{column}") * F.lit(w)
            total = term if total is None else total + term
        out[column] = total
    return df.withColumns(out)
