"""Registered queries: model metrics, weight of evidence, model-free parts of the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tariffspark.operators import metrics as M
from tariffspark.operators import woe as W
from tariffspark.plans.common import fx, oracle, rounded, sfx
from tariffspark.sources import portfolio as S

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# Scores are compared for equality, so both engines first round away the last bits of exp().
TIED = f"tied AS (SELECT * REPLACE ({sfx('p_claim', 6)} AS p_claim) FROM scored)"


def tied_scores(s, d):
    return S.scored_policies(s, d).withColumn("p_claim", fx(F.col("p_claim"), 6))


def auc_sql(source, score="p_claim", label="is_claim"):
    return f"""SELECT sum(pos * (below - neg + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE AS auc, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives
FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY score) AS below FROM (
  SELECT {score} AS score, count(*) FILTER (WHERE {label} = 1) AS pos, count(*) FILTER (WHERE {label} <> 1) AS neg FROM {source} GROUP BY 1))"""


register("auc_exact", lambda s, d: rounded(M.auc_exact(tied_scores(s, d)), 9, "auc", "gini"), oracle(
    "scored", f"SELECT {sfx('auc')} AS auc, {sfx('2.0::DOUBLE * auc - 1.0::DOUBLE')} AS gini, positives, negatives FROM ({auc_sql('tied')})", TIED))
register("brier", lambda s, d: rounded(M.brier(S.scored_policies(s, d)), 9, "brier"),
         oracle("scored", f"SELECT {sfx('avg((is_claim - p_claim) * (is_claim - p_claim))')} AS brier FROM scored"))
register("severity_metrics", lambda s, d: rounded(M.severity_metrics(S.scored_policies(s, d)), 9, "rmse", "mae", "r2"), oracle("scored", f"""
SELECT {sfx('sqrt(avg((y - p) * (y - p)))')} AS rmse, {sfx('avg(abs(y - p))')} AS mae, {sfx('1.0::DOUBLE - avg((y - p) * (y - p)) / var_pop(y)')} AS r2, count(*) AS n
FROM (SELECT ln(1 + claim_amount) AS y, ln(1 + expected_severity) AS p FROM scored WHERE is_claim > 0)"""))

# The default of the operator, written out for the SQL.
REPLICATES = 500


def _bootstrap(s, d):
    priced = S.priced_policies(s, d).withColumn("p_claim", fx(F.col("p_claim"), 6))
    return rounded(M.bootstrap_ci(priced, "contract_number"), 8, "point_estimate", "ci_lower", "ci_upper", "std")


_weight = " + ".join(f"(u >= {p!r}::DOUBLE * 4294967296.0::DOUBLE)::INTEGER" for p in M.POISSON_ONE)
DRAWS = [
    f"tiedp AS (SELECT * REPLACE ({sfx('p_claim', 6)} AS p_claim) FROM priced)",
    f"""draws AS (SELECT *, ({_weight})::DOUBLE AS w FROM (SELECT t.*, r, ('0x' || substr(md5('42:' || (r // 4)::VARCHAR || ':' || contract_number::VARCHAR), 1 + 8 * (r % 4), 8))::BIGINT AS u
FROM tiedp t, range({REPLICATES}) v(r)))""",
    """aucs AS (SELECT r, sum(pos * (below - neg + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc FROM (
SELECT r, pos, neg, sum(neg) OVER (PARTITION BY r ORDER BY p_claim) AS below FROM (
SELECT r, p_claim, sum(w * is_claim) AS pos, sum(w * (1 - is_claim)) AS neg FROM draws GROUP BY r, p_claim)) GROUP BY r)""",
    """reps AS (SELECT r, auc, 2.0::DOUBLE * auc - 1.0::DOUBLE AS gini, brier, lr_original, lr_new_premium FROM aucs JOIN (
SELECT r, sum(w * (is_claim - p_claim) * (is_claim - p_claim)) / sum(w) AS brier, sum(w * claim_amount) / sum(w * premium) AS lr_original,
  sum(w * claim_amount) / sum(w * new_premium) AS lr_new_premium FROM draws GROUP BY r) USING (r))""",
]
register("bootstrap_ci", _bootstrap, oracle("priced", " UNION ALL ".join(f"""SELECT '{m}' AS metric, {sfx(f'avg({m})', 8)} AS point_estimate,
  {sfx(f'quantile_cont({m}, {(1 - 0.95) / 2!r}::DOUBLE)', 8)} AS ci_lower, {sfx(f'quantile_cont({m}, {1 - (1 - 0.95) / 2!r}::DOUBLE)', 8)} AS ci_upper,
  {sfx(f'stddev_pop({m})', 8)} AS std FROM reps""" for m in M.BOOTSTRAP_METRICS), *DRAWS))

# -- weight of evidence -------------------------------------------------------------------
FEATURES = ["driver_count", "premium", "premium_wo_term", "engine_power_mean", "car_age_mean", "SCORE_1_1", "SCORE_4_1", "SCORE_11_1"]
_grid = ", ".join(f"{i / 10!r}::DOUBLE" for i in range(11))


def woe_ctes(source="policy"):
    union = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, is_claim AS y FROM {source} WHERE {c} IS NOT NULL" for c in FEATURES)
    return [
        f"woe_long AS ({union})",
        f"woe_edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [{_grid}]))) AS e, count(*) AS n, sum(y)::BIGINT AS ev FROM woe_long GROUP BY feature)",
        """woe_cells AS (SELECT feature, bin, any_value(e[bin + 1]) AS bin_lower, any_value(e[bin + 2]) AS bin_upper, count(*) AS count, sum(y)::BIGINT AS event_count,
  any_value(n) AS n, any_value(ev) AS ev FROM (SELECT feature, x, y, e, n, ev, len(list_filter(e[2:len(e)-1], lambda t: t < x))::INTEGER AS bin
  FROM woe_long JOIN woe_edges USING (feature) WHERE n >= 100 AND len(e) >= 2 AND ev > 0 AND ev < n) GROUP BY feature, bin)""",
        """woe AS (SELECT feature, bin, bin_lower, bin_upper, count, event_count, count - event_count AS non_event_count, ln(dn / de) AS woe, (dn - de) * ln(dn / de) AS iv_contribution
FROM (SELECT *, (event_count + 0.5::DOUBLE) / (ev + 1.0::DOUBLE) AS de, (count - event_count + 0.5::DOUBLE) / (n - ev + 1.0::DOUBLE) AS dn FROM woe_cells))""",
    ]


register("woe_bins", lambda s, d: rounded(W.woe_bins(S.policies(s, d), FEATURES), 8, "bin_lower", "bin_upper", "woe", "iv_contribution", bin_lower=4, bin_upper=4),
         oracle("policy", f"""SELECT feature, bin, {sfx('bin_lower', 4)} AS bin_lower, {sfx('bin_upper', 4)} AS bin_upper, count, event_count, non_event_count,
  {sfx('woe', 8)} AS woe, {sfx('iv_contribution', 8)} AS iv_contribution FROM woe""", *woe_ctes()))
register("iv_summary", lambda s, d: rounded(W.iv_summary(W.woe_bins(S.policies(s, d), FEATURES), FEATURES), 8, "iv"), oracle("policy", f"""
SELECT feature, {sfx('iv', 8)} AS iv, n_bins, (iv >= 0.02)::INTEGER AS above_002, (iv >= 0.1)::INTEGER AS above_010
FROM (SELECT feature, sum(iv_contribution) AS iv, count(*) AS n_bins FROM woe GROUP BY feature)""", *woe_ctes()))


def _woe_transform(s, d):
    policy = S.policies(s, d)
    out = W.woe_transform(policy, W.woe_bins(policy, FEATURES), FEATURES)
    return rounded(out.select("contract_number", *[f"{c}_woe" for c in FEATURES]), 8, *[f"{c}_woe" for c in FEATURES])


register("woe_transform", _woe_transform, oracle("policy", "SELECT contract_number, " + ", ".join(
    f"{sfx(f'coalesce(w_{c}.woe, 0)', 8)} AS {c}_woe" for c in FEATURES) + " FROM policy p " + " ".join(
    f"LEFT JOIN woe w_{c} ON w_{c}.feature = '{c}' AND p.{c} > w_{c}.bin_lower AND p.{c} <= w_{c}.bin_upper" for c in FEATURES), *woe_ctes()))


def _woe_selection(s, d):
    bins = W.woe_bins(S.policies(s, d), FEATURES)
    chosen = W.select_features(bins)
    return rounded(W.iv_summary(bins).select("feature", "iv", F.col("feature").isin(chosen).cast("int").alias("selected")), 8, "iv")


register("woe_selection", _woe_selection, oracle("policy", f"""
SELECT feature, {sfx('iv', 8)} AS iv, (CASE WHEN any_above THEN iv >= 0.02 ELSE place <= 10 END)::INTEGER AS selected FROM (
SELECT feature, iv, bool_or(iv >= 0.02) OVER () AS any_above, row_number() OVER (ORDER BY iv DESC, feature) AS place
FROM (SELECT feature, sum(iv_contribution) AS iv FROM woe GROUP BY feature))""", *woe_ctes()))
