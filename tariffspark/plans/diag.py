"""Registered queries: portfolio diagnostics and choices among candidates."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffspark.functions.columns import nonneg
from tariffspark.operators import diagnostics as D
from tariffspark.operators import metrics as M
from tariffspark.operators import price_search as Z
from tariffspark.operators import pricing as R
from tariffspark.operators import selection as C
from tariffspark.operators.split import stability_splits
from tariffspark.plans.common import fx, kpi_select_sql, oracle, rounded, scalar_price_sql, sfx
from tariffspark.plans.metric import auc_sql
from tariffspark.plans.price import KPIS, grid_ctes
from tariffspark.plans.split import CUTOFFS
from tariffspark.session import materialize
from tariffspark.sources import portfolio as S

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def decile_sql(value, name, source, q=10):
    return f"(SELECT *, greatest(1, ((row_number() OVER (ORDER BY {value}, contract_number) - 1) * {q} + count(*) OVER () - 2) // (count(*) OVER () - 1))::INTEGER AS {name} FROM {source})"


_AE = """count(*) AS policies, sum(new_premium) AS premium_sum, sum(expected_loss) AS expected_loss_sum, sum(claim_amount) AS claim_amount_sum"""
_LR = f"""{sfx('claim_amount_sum / premium_sum', 8)} AS actual_lr, {sfx('expected_loss_sum / premium_sum', 8)} AS expected_lr, {sfx('claim_amount_sum / expected_loss_sum', 8)} AS ae_ratio"""
_SUM = ", ".join(f"{sfx(c, 2)} AS {c}" for c in ("premium_sum", "expected_loss_sum", "claim_amount_sum"))
_ROUND = dict(premium_sum=2, expected_loss_sum=2, claim_amount_sum=2)

register("deciles", lambda s, d: D.with_deciles(materialize(S.scored_policies(s, d).select("contract_number", "expected_loss"), "scored"), "expected_loss", "risk_decile").select(
    "contract_number", "risk_decile"), oracle("scored", f"SELECT contract_number, risk_decile FROM {decile_sql('expected_loss', 'risk_decile', 'scored')}"))
# Price changes repeat where prices hit a limit, so the change is rounded before it is ranked.
PRICED_ROUNDED = f"pr AS (SELECT * REPLACE ({sfx('price_delta_pct', 9)} AS price_delta_pct) FROM priced)"


def _priced(s, d):
    return S.priced_policies(s, d).withColumn("price_delta_pct", fx(F.col("price_delta_pct"), 9))


register("double_lift", lambda s, d: rounded(D.double_lift(_priced(s, d)), 8, "avg_price_delta", "actual_lr", "expected_lr", "ae_ratio", avg_expected_loss=4, **_ROUND),
         oracle("priced", f"""SELECT risk_decile, delta_decile, policies, {_SUM}, {sfx('apd', 8)} AS avg_price_delta, {sfx('ael', 4)} AS avg_expected_loss, {_LR} FROM (
SELECT risk_decile, delta_decile, {_AE}, avg(price_delta_pct) AS apd, avg(expected_loss) AS ael
FROM {decile_sql('price_delta_pct', 'delta_decile', decile_sql('expected_loss', 'risk_decile', 'pr'))} GROUP BY 1, 2)""", PRICED_ROUNDED))
register("ae_by_risk", lambda s, d: rounded(D.ae_by_risk(S.priced_policies(s, d)), 8, "actual_lr", "expected_lr", "ae_ratio", **_ROUND),
         oracle("priced", f"SELECT risk_decile, policies, {_SUM}, {_LR} FROM (SELECT risk_decile, {_AE} FROM {decile_sql('expected_loss', 'risk_decile', 'priced')} GROUP BY 1)"))
_segments = " UNION ALL ".join(f"SELECT '{c}' AS segment_column, coalesce({c}, 'missing') AS segment_value, new_premium, expected_loss, claim_amount FROM priced" for c in D.SEGMENTS)
register("ae_by_segment", lambda s, d: rounded(D.ae_by_segment(S.priced_policies(s, d), top=20), 8, "actual_lr", "expected_lr", "ae_ratio", **_ROUND),
         oracle("priced", f"""SELECT segment_column, segment_value, policies, {_SUM}, {_LR} FROM (
SELECT *, row_number() OVER (PARTITION BY segment_column ORDER BY policies DESC, segment_value) AS place FROM (
SELECT segment_column, segment_value, {_AE} FROM ({_segments}) GROUP BY 1, 2)) WHERE place <= 20"""))

WEIGHTS = {"premium": 2e-6, "engine_power_mean": 0.004, "car_age_mean": 0.01, "SCORE_1_1": 0.02, "SCORE_4_1": -0.03, "SCORE_11_1": 0.05, "driver_count": 0.1}
_contrib = " UNION ALL ".join(f"""SELECT '{c}' AS feature, avg(abs({w!r}::DOUBLE * (x - m))) AS k FROM (
SELECT coalesce({c}, 0)::DOUBLE AS x, (SELECT avg(coalesce({c}, 0)::DOUBLE) FROM policy) AS m FROM policy)""" for c, w in WEIGHTS.items())
register("contribution_rank", lambda s, d: rounded(D.contribution_rank(S.policies(s, d), WEIGHTS, 20), 8, "mean_abs_contribution", "cumulative_share"),
         oracle("policy", f"""SELECT feature, {sfx('k', 8)} AS mean_abs_contribution, (row_number() OVER (ORDER BY k DESC, feature))::INTEGER AS rank,
  {sfx('sum(k) OVER (ORDER BY k DESC, feature ROWS UNBOUNDED PRECEDING) / sum(k) OVER ()', 8)} AS cumulative_share FROM ({_contrib})"""))

# -- candidates: three scores of different quality, priced with one tariff -----------------------
TARIFF = (0.3, 0.92)
SCORES = {"full_score": "p_claim", "first_score": "score_1", "flat_score": "flat"}


def _candidates(s, d) -> DataFrame:
    policy = S.scored_policies(s, d)
    rounded_ = lambda c: fx(c, 6)
    policy = materialize(policy.select(
        "contract_number", "premium", "premium_wo_term", "is_claim", "claim_amount", rounded_(F.col("p_claim")).alias("p_claim"),
        rounded_(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(2.5) - F.lit(0.02) * F.col("SCORE_1_1")))).alias("score_1"), F.lit(0.125).alias("flat")), "candidates")
    parts = []
    for ordinal, (name, column) in enumerate(SCORES.items()):
        priced = R.price_scalar(policy.withColumn("expected_loss", F.col(column) * F.lit(5.4) * F.col("premium")), *TARIFF)
        auc = M.auc_exact(policy, column)
        kpis = C.check_constraints(R.portfolio_kpis(priced), {"share_group1_max": 0.9})
        parts.append(kpis.select(F.lit(name).alias("candidate"), F.lit(ordinal).alias("ordinal"), F.lit("ok").alias("status"),
                                 auc.select("auc").scalar().alias("auc"), auc.select("gini").scalar().alias("gini"), *KPIS, "in_target", "violations",
                                 "passes_constraints", "reasons"))
    return reduce(DataFrame.unionByName, parts)


def constraint_sql(low=0.69, high=0.71, share_low=0.0, share_high=1.0):
    rules = [("violations > 0", "violations>0"), (f"lr_total < {low}", f"lr_total<{low}"), (f"lr_total > {high}", f"lr_total>{high}"),
             (f"share_group1 < {share_low}", f"share_group1<{share_low}"), (f"share_group1 > {share_high}", f"share_group1>{share_high}")]
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in rules) + "], lambda t: t IS NOT NULL), '|')"


def _candidate_ctes():
    p1 = sfx("1.0::DOUBLE / (1.0::DOUBLE + exp(2.5::DOUBLE - 0.02::DOUBLE * SCORE_1_1))", 6)
    out = [f"cand AS (SELECT contract_number, premium, premium_wo_term, is_claim, claim_amount, {sfx('p_claim', 6)} AS p_claim, {p1} AS score_1, 0.125::DOUBLE AS flat FROM scored)"]
    parts = []
    for i, (name, col) in enumerate(SCORES.items()):
        loss = f"({col} * 5.4::DOUBLE * premium)"
        out.append(f"cand{i} AS (SELECT *, {scalar_price_sql(loss, f'(SELECT avg({loss}) FROM cand)', *map(repr, TARIFF))} AS new_premium FROM cand)")
        parts.append(f"SELECT '{name}' AS candidate, {i} AS ordinal, 'ok' AS status, auc, 2.0::DOUBLE * auc - 1.0::DOUBLE AS gini, k.* FROM ({kpi_select_sql(f'cand{i}')}) k, ({auc_sql('cand', col)})")
    out.append(f"results AS (SELECT *, (reasons = '')::INTEGER AS passes_constraints FROM (SELECT *, {constraint_sql(share_high=0.9)} AS reasons FROM ({' UNION ALL '.join(parts)})))")
    return out


register("model_rank", lambda s, d: rounded(C.rank_models(_candidates(s, d)).select("candidate", "auc", "gini", "policy_score", "passes_constraints", "reasons"),
                                            8, "auc", "gini", "policy_score"),
         oracle("scored", f"SELECT candidate, {sfx('auc', 8)} AS auc, {sfx('gini', 8)} AS gini, {sfx('policy_score', 8)} AS policy_score, passes_constraints, reasons FROM results",
                *_candidate_ctes()))
register("winner_selection", lambda s, d: C.select_winner(_candidates(s, d)), oracle("scored", """
SELECT coalesce(arg_max(candidate, (policy_score, gini, -ordinal)) FILTER (WHERE passes_constraints = 1), arg_max(candidate, (policy_score, gini, -ordinal))) AS candidate,
  CASE WHEN max(passes_constraints) = 1 THEN 'best_compliant_candidate' ELSE 'best_available_no_compliant_candidates' END AS reason FROM results""", *_candidate_ctes()))

# -- trials: grid points of the tariff, evaluated on the time splits --------------------------------
T_ALPHA, T_BETA = [0.0, 0.15, 0.3, 0.45], [0.86, 0.9, 0.94, 0.98, 1.0, 1.02]
TRIAL_LIMITS = {"share_group1_max": 0.95}


def _constraint_check(s, d):
    grid = Z.grid_candidates(S.scored_policies(s, d), T_ALPHA, T_BETA)
    return rounded(C.check_constraints(grid, TRIAL_LIMITS).select("ordinal", "alpha", "beta", "lr_total", "share_group1", "violations", "passes_constraints", "reasons"),
                   8, "lr_total", "share_group1", violations=0)


_trials = [*grid_ctes(T_ALPHA, T_BETA), f"checked AS (SELECT *, (reasons = '')::INTEGER AS passes_constraints FROM (SELECT *, {constraint_sql(share_high=0.95)} AS reasons FROM gridkpi))"]
register("constraint_check", _constraint_check, oracle("scored", f"""
SELECT ordinal, alpha, beta, {sfx('lr_total', 8)} AS lr_total, {sfx('share_group1', 8)} AS share_group1, violations::DOUBLE AS violations, passes_constraints, reasons FROM checked""", *_trials))


def _single_trials(s, d):
    grid = C.check_constraints(Z.grid_candidates(S.scored_policies(s, d), T_ALPHA, T_BETA), TRIAL_LIMITS)
    return C.single_objective(grid.withColumn("status", F.lit("ok")).withColumnRenamed("ordinal", "trial"))


_single = "CASE WHEN passes_constraints = 1 AND in_target = 1 THEN policy_score ELSE -1000000.0::DOUBLE - distance_to_target - 100.0::DOUBLE * violations END"
register("objective_single", lambda s, d: rounded(_single_trials(s, d).select("trial", "alpha", "beta", "objective"), 7, "objective"),
         oracle("scored", f"SELECT ordinal AS trial, alpha, beta, {sfx(_single, 7)} AS objective FROM checked", *_trials))


def _top(s, d):
    trials = materialize(_single_trials(s, d), "trials")
    baseline = trials.where("trial = 0").first()["policy_score"]
    return rounded(C.top_trials(trials, 5, baseline=baseline).select("trial", "alpha", "beta", "objective", "policy_score", "delta_policy_score"),
                   7, "objective", "policy_score", "delta_policy_score")


register("trial_topk", _top, oracle("scored", f"""
SELECT trial, alpha, beta, {sfx('objective', 7)} AS objective, {sfx('policy_score', 7)} AS policy_score, {sfx('policy_score - base', 7)} AS delta_policy_score FROM (
SELECT ordinal AS trial, alpha, beta, {_single} AS objective, policy_score, (SELECT policy_score FROM checked WHERE ordinal = 0) AS base FROM checked
ORDER BY objective DESC, trial LIMIT 5)""", *_trials))


def _split_trials(s, d):
    """KPIs of every trial on the valid side of every split, from one pass (a split is a bucket)."""
    policy = materialize(S.scored_policies(s, d).select("contract_number", "operation_date", "premium", "premium_wo_term", "claim_amount", "expected_loss"), "trials")
    family = Z.relative_risk_family(T_ALPHA, T_BETA)
    loss = nonneg(F.col("expected_loss"))
    weights = Z._index_weights(np.ones((1, 1)), Z._means(policy, [loss]))
    valid = stability_splits(policy, CUTOFFS).where("split = 'valid'")
    place = F.array_position(F.array(*[F.lit(c) for c in CUTOFFS]), F.col("split_value")) - 1
    sums = Z.grid_sums(Z.bin_sums(valid, family, [loss], weights, place, len(CUTOFFS)), family)
    kpis = R.kpis_from_sums(sums.drop("multiplier", "variant").withColumnRenamed("bucket", "split"), 0.7, R.target_band(0.7, (0.66, 0.74)))
    return C.check_constraints(kpis, {"lr_total_min": 0.66, "lr_total_max": 0.74}).withColumn("status", F.lit("ok")).withColumnRenamed("ordinal", "trial")


OBJECTIVE_COLUMNS = ["constraints_pass_rate", "in_target_rate", "policy_score_mean", "policy_score_std", "lr_total_mean", "objective"]


def _stability_objective(s, d):
    out = C.stability_objective(_split_trials(s, d), ["trial", "alpha", "beta"], penalty=1.0, min_pass_rate=0.6, min_band_rate=0.6)
    return rounded(out.select("trial", "alpha", "beta", "split_count", "policy_score_count", "status", *OBJECTIVE_COLUMNS), 6, *OBJECTIVE_COLUMNS)


_split_source = f"""(SELECT s.*, g.*, c, {scalar_price_sql('expected_loss', '(SELECT avg(expected_loss) FROM scored)', 'alpha', 'beta')} AS new_premium
FROM scored s, grid g, (SELECT unnest([{', '.join(f"'{c}'" for c in CUTOFFS)}]) AS c) WHERE operation_date >= c::TIMESTAMP)"""
_split_ctes = [grid_ctes(T_ALPHA, T_BETA)[0], f"""split_kpi AS (SELECT * FROM ({kpi_select_sql(_split_source, by='c, ordinal, alpha, beta', low=0.66, high=0.74)}))"""]
register("objective_stability", _stability_objective, oracle("scored", f"""
SELECT trial, alpha, beta, split_count, policy_score_count, CASE WHEN gate THEN 'ok' ELSE 'gates_failed' END AS status, {sfx('pr', 6)} AS constraints_pass_rate,
  {sfx('br', 6)} AS in_target_rate, {sfx('m', 6)} AS policy_score_mean, {sfx('sd', 6)} AS policy_score_std, {sfx('lr', 6)} AS lr_total_mean,
  {sfx('CASE WHEN gate THEN m - sd ELSE -1000000.0::DOUBLE - 10000.0::DOUBLE * greatest(0, 0.6::DOUBLE - pr) - 10000.0::DOUBLE * greatest(0, 0.6::DOUBLE - br) - dist - 100.0::DOUBLE * viol END', 6)} AS objective
FROM (SELECT *, pr >= 0.6 AND br >= 0.6 AND m IS NOT NULL AS gate FROM (
SELECT ordinal AS trial, alpha, beta, count(*) AS split_count, count(*) FILTER (WHERE in_target = 1) AS policy_score_count, avg(in_target) AS pr, avg(in_target) AS br,
  avg(policy_score) FILTER (WHERE in_target = 1) AS m, stddev_pop(policy_score) FILTER (WHERE in_target = 1) AS sd, avg(lr_total) AS lr,
  avg(distance_to_target) AS dist, max(violations) AS viol FROM split_kpi GROUP BY ordinal, alpha, beta))""", *_split_ctes))

SUMMARY = ["in_target_rate", "constraints_pass_rate", "mean_policy_score", "std_policy_score", "mean_lr_group1", "mean_lr_group2", "mean_share_group1", "objective"]


def _stability(s, d):
    priced = R.price_scalar(S.scored_policies(s, d), *TARIFF)
    by_split = R.portfolio_kpis(stability_splits(priced, CUTOFFS).where("split = 'valid'"), 0.7, (0.66, 0.74), by=["split_value"])
    checked = C.check_constraints(by_split, {"lr_total_min": 0.66, "lr_total_max": 0.74})
    return rounded(C.stability_summary(checked), 8, *SUMMARY)


_one = f"""(SELECT *, {scalar_price_sql('expected_loss', '(SELECT avg(expected_loss) FROM scored)', *map(repr, TARIFF))} AS new_premium
FROM scored, (SELECT unnest([{', '.join(f"'{c}'" for c in CUTOFFS)}]) AS c) WHERE operation_date >= c::TIMESTAMP)"""
register("stability_summary", _stability, oracle("scored", f"""
SELECT count(*) AS n_splits, {sfx('avg(in_target)', 8)} AS in_target_rate, {sfx('avg((lr_total BETWEEN 0.66 AND 0.74)::INTEGER)', 8)} AS constraints_pass_rate,
  max(violations)::BIGINT AS max_violations, {sfx('avg(policy_score)', 8)} AS mean_policy_score, {sfx('stddev_pop(policy_score)', 8)} AS std_policy_score,
  {sfx('avg(lr_group1)', 8)} AS mean_lr_group1, {sfx('avg(lr_group2)', 8)} AS mean_lr_group2, {sfx('avg(share_group1)', 8)} AS mean_share_group1,
  {sfx('avg(policy_score) - stddev_pop(policy_score)', 8)} AS objective FROM ({kpi_select_sql(_one, by='c', low=0.66, high=0.74)})"""))
