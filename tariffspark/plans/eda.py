"""Registered queries: profiling, leakage, drift, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tariffspark.operators import drift as D
from tariffspark.operators import leakage as L
from tariffspark.operators import profile as P
from tariffspark.plans.common import oracle, rounded, sfx
from tariffspark.plans.data import POLICY_COLUMNS, ROW_COLUMNS, null_rate_sql
from tariffspark.roles import FORBIDDEN, TARGETS
from tariffspark.session import materialize
from tariffspark.sources import portfolio as S

QUERIES, ORACLES = {}, {}

ROW_NUMERIC = ["unique_id", "contract_number", "premium", "premium_wo_term", "engine_power", "car_age", "SCORE_1_1", "SCORE_4_1",
               "SCORE_11_1", "driver_iin", "insurer_iin", "car_number"]
ROW_FEATURES = [c for c in ROW_NUMERIC if c not in FORBIDDEN]
ROW_TEXT = ["region_name", "ownerkato", "vehicle_type_name", "mark", "model", "bonus_malus", "car_year"]


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def layers(s, d):
    rows = S.driver_rows(s, d)
    return {"train": rows, "test": rows.drop(*TARGETS), "policy": S.policies(s, d)}


register("layer_sizes", lambda s, d: P.layer_sizes(layers(s, d)), oracle("policy", f"""
SELECT 'train' AS layer, count(*) AS n_rows, {len(ROW_COLUMNS)}::BIGINT AS n_columns FROM driver_rows
UNION ALL SELECT 'test', count(*), {len(ROW_COLUMNS) - 3} FROM driver_rows
UNION ALL SELECT 'policy', count(*), {len(POLICY_COLUMNS)} FROM policy"""))

register("rows_per_contract", lambda s, d: rounded(P.rows_per_contract(S.driver_rows(s, d)), 9, "rows_per_contract"),
         oracle("driver_rows", "SELECT 'mean' AS statistic, " + sfx("avg(n)") + " AS rows_per_contract FROM sizes " + " ".join(
             f"UNION ALL SELECT 'q{q}', {sfx(f'quantile_cont(n, {q}::DOUBLE)')} FROM sizes" for q in (0.5, 0.75, 0.9, 0.95, 0.99)),
             "sizes AS (SELECT count(*)::DOUBLE AS n FROM driver_rows WHERE contract_number IS NOT NULL GROUP BY contract_number)"))

register("policy_vs_driver", lambda s, d: rounded(P.policy_vs_driver(S.driver_rows(s, d)), 1, "value"), oracle("policy", f"""
SELECT metric, {sfx('value', 1)} AS value FROM (SELECT 'driver_level_rows' AS metric, count(*)::DOUBLE AS value FROM driver_rows
UNION ALL SELECT 'policy_level_rows', count(*) FROM policy UNION ALL SELECT 'driver_level_premium_sum', sum(premium) FROM driver_rows
UNION ALL SELECT 'policy_level_premium_sum', sum(premium) FROM policy
UNION ALL SELECT 'premium_duplication_factor', (SELECT sum(premium) FROM driver_rows) / (SELECT sum(premium) FROM policy))"""))

register("missing_rates", lambda s, d: rounded(P.missing_rates(S.driver_rows(s, d)), 9, "null_rate"), oracle("driver_rows", f"""
SELECT feature, {sfx('null_rate')} AS null_rate, (row_number() OVER (ORDER BY null_rate DESC, feature))::INTEGER AS rank
FROM ({null_rate_sql('driver_rows', ROW_COLUMNS)})"""))

STATS = ["mean", "std", "min", "q25", "q50", "q75", "max"]
SUMMARY = ["premium", "premium_wo_term", "claim_amount", "engine_power", "car_age", "SCORE_1_1", "SCORE_4_1", "SCORE_11_1"]
register("numeric_summary", lambda s, d: rounded(P.numeric_summary(S.driver_rows(s, d), SUMMARY), 4, *STATS), oracle("driver_rows",
         " UNION ALL ".join(f"""SELECT '{c}' AS feature, count({c}) AS count, {sfx(f'avg({c}::DOUBLE)', 4)} AS mean,
  {sfx(f'stddev_samp({c}::DOUBLE)', 4)} AS std, {sfx(f'min({c})', 4)} AS min, {sfx(f'quantile_cont({c}::DOUBLE, 0.25::DOUBLE)', 4)} AS q25,
  {sfx(f'quantile_cont({c}::DOUBLE, 0.5::DOUBLE)', 4)} AS q50, {sfx(f'quantile_cont({c}::DOUBLE, 0.75::DOUBLE)', 4)} AS q75,
  {sfx(f'max({c})', 4)} AS max FROM driver_rows""" for c in SUMMARY)))

register("categorical_cardinality", lambda s, d: rounded(P.categorical_cardinality(S.driver_rows(s, d), ROW_TEXT), 9, "missing_rate"),
         oracle("driver_rows", " UNION ALL ".join(
             f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS nunique, {sfx(f'avg(({c} IS NULL)::INTEGER)')} AS missing_rate FROM driver_rows"
             for c in ROW_TEXT)))

register("leakage_watchlist", lambda s, d: rounded(L.leakage_watchlist(S.driver_rows(s, d)), 9, "abs_corr_with_is_claim", "corr_with_is_claim"),
         oracle("driver_rows", f"SELECT feature, {sfx('abs(c)')} AS abs_corr_with_is_claim, {sfx('c')} AS corr_with_is_claim FROM (" + " UNION ALL ".join(
             f"SELECT '{c}' AS feature, corr({c}::DOUBLE, is_claim::DOUBLE) AS c, count({c}) AS n FROM driver_rows" for c in ROW_NUMERIC)
             + ") WHERE n >= 30"))

register("target_distribution", lambda s, d: P.target_distribution(S.driver_rows(s, d)),
         oracle("driver_rows", "SELECT coalesce(is_claim, 0) AS is_claim, count(*) AS n FROM driver_rows GROUP BY 1"))


def _histograms(s, d):
    rows = S.driver_rows(s, d)
    amounts = P.claim_amount_histogram(rows).select(F.lit("log1p_claim_amount").alias("chart"), "*")
    sizes = P.contract_size_histogram(rows).select(F.lit("rows_per_contract").alias("chart"), "*")
    return rounded(amounts.unionByName(sizes), 9, "lower", "upper")


register("claim_amount_hist", _histograms, oracle("driver_rows", f"""
SELECT 'log1p_claim_amount' AS chart, bin, {sfx('lo + (hi - lo) / 40.0::DOUBLE * bin')} AS lower, {sfx('lo + (hi - lo) / 40.0::DOUBLE * (bin + 1)')} AS upper, n
FROM (SELECT lo, hi, least(floor((x - lo) / (hi - lo) * 40.0::DOUBLE), 39)::INTEGER AS bin, count(*) AS n
  FROM (SELECT x, min(x) OVER () AS lo, max(x) OVER () AS hi FROM (SELECT ln(1 + claim_amount) AS x FROM driver_rows WHERE claim_amount > 0)) GROUP BY ALL)
UNION ALL SELECT 'rows_per_contract', least(size, 23)::INTEGER AS bin, least(size, 23)::DOUBLE, least(size, 23)::DOUBLE + 1, count(*)
FROM (SELECT count(*) AS size FROM driver_rows GROUP BY contract_number) WHERE size <= 24 GROUP BY least(size, 23)"""))

register("target_by_month", lambda s, d: rounded(P.target_by_month(S.driver_rows(s, d)), 9, "claim_rate", mean_claim_amount=4),
         oracle("driver_rows", f"""SELECT strftime(operation_date, '%Y-%m') AS year_month, {sfx('avg(is_claim::DOUBLE)')} AS claim_rate,
  {sfx('avg(coalesce(claim_amount, 0))', 4)} AS mean_claim_amount, count(*) AS rows FROM driver_rows WHERE operation_date IS NOT NULL GROUP BY 1"""))

# -- leakage score, action board, selection ---------------------------------------

_in = lambda names: ", ".join(f"'{n}'" for n in names)
_corr = " UNION ALL ".join(f"""SELECT '{c}' AS feature, CASE WHEN count({c}) >= 21 THEN abs(corr({c}::DOUBLE, is_claim::DOUBLE)) END AS c1,
  CASE WHEN count({c}) >= 21 THEN abs(corr({c}::DOUBLE, coalesce(claim_amount, 0)::DOUBLE)) END AS c2 FROM driver_rows""" for c in ROW_FEATURES)
_rules = [
    (f"feature IN ({_in(TARGETS)})", 100, "exact_target_column"),
    (f"feature IN ({_in(FORBIDDEN)})", 30, "forbidden_identifier_column"),
    *[(f"regexp_matches(feature, '{p}')", int(w), r) for r, p, w in L.NAME_RULES],
    ("c1 >= 0.35", 25, "high_abs_corr_is_claim>=0.35"), ("c1 >= 0.2 AND c1 < 0.35", 10, "mid_abs_corr_is_claim>=0.20"),
    ("c2 >= 0.35", 25, "high_abs_corr_claim_amount>=0.35"), ("c2 >= 0.2 AND c2 < 0.35", 10, "mid_abs_corr_claim_amount>=0.20"),
    (f"feature IN ({_in(TARGETS)})", 15, "train_only_column"), ("missing_rate > 0.95", 0, "extremely_sparse"),
]
_risk = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in _rules)
_reasons = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, _, r in _rules) + "], lambda t: t IS NOT NULL)), ';')"
LEAKAGE = [
    f"rates AS (SELECT feature, null_rate AS missing_rate FROM ({null_rate_sql('driver_rows', ROW_COLUMNS)}))",
    f"cors AS ({_corr})",
    f"""leak AS (SELECT *, CASE WHEN risk_score >= 90 THEN 'drop' WHEN risk_score >= 45 THEN 'review' ELSE 'keep' END AS action_recommendation FROM (
SELECT feature, ({_risk})::DOUBLE AS risk_score, c1 AS abs_corr_is_claim, c2 AS abs_corr_claim_amount, missing_rate,
  (feature IN ({_in(TARGETS)}))::INTEGER AS train_only, {_reasons} AS reasons FROM rates LEFT JOIN cors USING (feature)))""",
]
register("leakage_risk_rank", lambda s, d: rounded(L.leakage_risk(S.driver_rows(s, d)), 9, "abs_corr_is_claim", "abs_corr_claim_amount", "missing_rate"),
         oracle("driver_rows", f"""SELECT feature, risk_score, {sfx('abs_corr_is_claim')} AS abs_corr_is_claim,
  {sfx('abs_corr_claim_amount')} AS abs_corr_claim_amount, {sfx('missing_rate')} AS missing_rate, train_only, reasons, action_recommendation FROM leak""", *LEAKAGE))


def psi_sql(features, source="windowed", bins=10, mode="open", prefix=""):
    """CTEs ending in ``{prefix}psi`` (feature, psi) for a source with column ``win`` in reference/current."""
    grid = ", ".join(f"{i / bins!r}::DOUBLE" for i in range(bins + 1))
    casts = ", ".join(f"{f}::DOUBLE AS {f}" for f in features)
    least = 2 if mode == "open" else 50
    long = f"""{prefix}lng AS (SELECT win, feature, x FROM (SELECT win, {casts} FROM {source} WHERE win IS NOT NULL)
  UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(features)})))"""
    edges = f"""{prefix}edg AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [{grid}]) FILTER (WHERE win = 'reference'))) AS e,
  count(x) FILTER (WHERE win = 'reference') AS nr, count(x) FILTER (WHERE win = 'current') AS nc FROM {prefix}lng GROUP BY feature)"""
    if mode == "open":
        code = "CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(CASE WHEN len(e) >= 2 THEN e[2:len(e)-1] ELSE e END, lambda t: t <= x)) END"
        usable = f"nr >= {least} AND nc >= {least}"
    else:
        code = "CASE WHEN x >= e[1] AND x <= e[len(e)] THEN len(list_filter(e[2:len(e)-1], lambda t: t <= x)) END"
        usable = f"nr >= {least} AND nc >= {least} AND len(e) >= 3"
    cnt = f"""{prefix}cnt AS (SELECT feature, b, count(*) FILTER (WHERE win = 'reference') AS r, count(*) FILTER (WHERE win = 'current') AS c
  FROM (SELECT feature, win, {code} AS b FROM {prefix}lng JOIN {prefix}edg USING (feature) WHERE {usable}) WHERE b IS NOT NULL GROUP BY feature, b)"""
    share = lambda n: (f"greatest(CASE WHEN b >= 0 THEN {n} / greatest(sum({n}) FILTER (WHERE b >= 0) OVER (PARTITION BY feature), 1)"  # noqa: E731
                       f" ELSE {n} / sum({n}) OVER (PARTITION BY feature) END, 1e-6::DOUBLE)")
    out = f"""{prefix}psi AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM (SELECT feature, {share('r')} AS r, {share('c')} AS c FROM {prefix}cnt) GROUP BY feature)"""
    return [long, edges, cnt, out]


EARLY_LATE = """windowed AS (SELECT *, CASE WHEN rk <= floor(n * 0.3::DOUBLE) THEN 'reference' WHEN rk > floor(n * 0.7::DOUBLE) THEN 'current' END AS win
FROM (SELECT *, row_number() OVER (ORDER BY operation_date, row_key) AS rk, count(*) OVER () AS n FROM driver_rows WHERE operation_date IS NOT NULL))"""


def _early_late(s, d, columns):
    rows = materialize(S.driver_rows(s, d).select("row_key", "operation_date", *columns), "rows")
    return D.time_windows(rows, "operation_date", "row_key")


def _closed_psi(windows):
    return D.psi(windows, ROW_FEATURES, mode="closed").where("psi is not null")


register("drift_psi_early_late", lambda s, d: rounded(_closed_psi(_early_late(s, d, ROW_FEATURES)), 8, "psi"), oracle(
    "driver_rows", f"SELECT feature, {sfx('psi', 8)} AS psi FROM psi", EARLY_LATE, *psi_sql(ROW_FEATURES, mode="closed")))

_missing = lambda c: f"coalesce({c}, '__MISSING__') AS {c}"
register("categorical_shift", lambda s, d: rounded(D.categorical_shift(_early_late(s, d, ROW_TEXT), ROW_TEXT), 9,
                                                   "total_variation_distance", "late_unseen_rate_vs_early"),
         oracle("driver_rows", f"""SELECT feature, {sfx('sum(abs(r / nr - c / nc)) / 2')} AS total_variation_distance,
  {sfx('sum(CASE WHEN r = 0 THEN c ELSE 0 END) / any_value(nc)')} AS late_unseen_rate_vs_early,
  count(*) FILTER (WHERE r > 0) AS early_unique, count(*) FILTER (WHERE c > 0) AS late_unique FROM (
  SELECT feature, v, count(*) FILTER (WHERE win = 'reference') AS r, count(*) FILTER (WHERE win = 'current') AS c,
    (SELECT count(*) FROM windowed WHERE win = 'reference')::DOUBLE AS nr, (SELECT count(*) FROM windowed WHERE win = 'current')::DOUBLE AS nc
  FROM (SELECT win, {', '.join(map(_missing, ROW_TEXT))} FROM windowed WHERE win IS NOT NULL) UNPIVOT (v FOR feature IN ({', '.join(ROW_TEXT)}))
  GROUP BY feature, v) GROUP BY feature""", EARLY_LATE))

_num = lambda c: f"CASE WHEN regexp_matches(trim({c}), '^[0-9]+$') THEN trim({c})::DOUBLE END"
BINNED = f"""binned AS (SELECT *, CASE WHEN b IS NULL THEN 'unknown' WHEN b <= 5 THEN '<=5' WHEN b <= 8 THEN '6-8' WHEN b <= 11 THEN '9-11' ELSE '12+' END AS bonus_malus_bin,
  CASE WHEN y IS NULL THEN 'unknown' WHEN y <= 2005 THEN '<=2005' WHEN y <= 2010 THEN '2006-2010' WHEN y <= 2015 THEN '2011-2015' WHEN y <= 2020 THEN '2016-2020' ELSE '2021+' END AS car_year_bin
FROM (SELECT *, {_num('bonus_malus')} AS b, {_num('car_year')} AS y FROM driver_rows))"""
register("fixed_bins", lambda s, d: P.with_segment_bins(S.driver_rows(s, d)).groupBy("bonus_malus_bin", "car_year_bin").agg(F.count("*").alias("n")),
         oracle("driver_rows", "SELECT bonus_malus_bin, car_year_bin, count(*) AS n FROM binned GROUP BY 1, 2", BINNED))
register("segment_kpis", lambda s, d: rounded(P.segment_kpis(S.driver_rows(s, d)), 6, "avg_claim_amount", "premium_mean", "total_claim_amount",
                                              total_premium=5, claim_rate=9, lr_proxy=9),
         oracle("driver_rows", f"""SELECT region_name, model, bonus_malus_bin, car_year_bin, count_policies, {sfx('claim_rate')} AS claim_rate,
  {sfx('a', 6)} AS avg_claim_amount, {sfx('p', 6)} AS premium_mean, {sfx('ta', 6)} AS total_claim_amount, {sfx('tp', 5)} AS total_premium,
  {sfx('CASE WHEN tp <> 0 THEN ta / tp ELSE 0 END')} AS lr_proxy FROM (SELECT region_name, model, bonus_malus_bin, car_year_bin, count(*) AS count_policies,
    avg(is_claim::DOUBLE) AS claim_rate, avg(coalesce(claim_amount, 0)) AS a, avg(premium_wo_term) AS p, sum(coalesce(claim_amount, 0)) AS ta,
    sum(premium_wo_term) AS tp FROM binned GROUP BY ALL)""", BINNED))
_bins = ["<=5", "6-8", "9-11", "12+", "unknown"]
register("segment_pivot", lambda s, d: rounded(P.segment_pivot(S.driver_rows(s, d), "ownerkato"), 9, *_bins), oracle(
    "driver_rows", "SELECT ownerkato, " + ", ".join(f"""{sfx(f"avg(is_claim::DOUBLE) FILTER (WHERE bonus_malus_bin = '{b}')")} AS "{b}" """ for b in _bins)
    + """FROM binned WHERE ownerkato IN (SELECT ownerkato FROM driver_rows GROUP BY 1 ORDER BY count(*) DESC, ownerkato LIMIT 20) GROUP BY ownerkato""", BINNED))


def _board(s, d):
    # All three parts read the driver rows, whose joins run once.
    rows = materialize(S.driver_rows(s, d), "rows")
    missing = P.missing_rates(rows).withColumnRenamed("null_rate", "missing_rate")
    return L.feature_action_board(missing, L.leakage_risk(rows), _closed_psi(D.time_windows(rows, "operation_date", "row_key")))


BOARD = [*LEAKAGE, EARLY_LATE, *psi_sql(ROW_FEATURES, mode="closed"), f"""board AS (SELECT *, CASE WHEN feature IN ({_in([*TARGETS, *FORBIDDEN])}) THEN 'drop'
  WHEN risk_score >= 90 THEN 'drop' WHEN missing_rate > 0.95 AND risk_score >= 40 THEN 'drop'
  WHEN risk_score >= 45 OR psi >= 0.25 OR missing_rate > 0.90 THEN 'review' ELSE 'keep' END AS final_action, risk_score + 100.0::DOUBLE * psi + 10.0::DOUBLE * missing_rate AS priority_score
FROM (SELECT feature, leak.missing_rate, risk_score, action_recommendation, reasons, coalesce(psi, 0.0::DOUBLE) AS psi FROM leak LEFT JOIN psi USING (feature)))"""]
register("feature_action_board", lambda s, d: rounded(_board(s, d), 8, "missing_rate", "psi", priority_score=6),
         oracle("driver_rows", f"""SELECT feature, {sfx('missing_rate', 8)} AS missing_rate, risk_score, action_recommendation, reasons, {sfx('psi', 8)} AS psi,
  final_action, {sfx('priority_score', 6)} AS priority_score FROM board""", *BOARD))

# The lists a previous run left behind.
_DROPLIST, _WHITELIST = ["driver_iin", "insurer_iin", "car_number", "unique_id"], ["premium", "premium_wo_term", "claim_amount"]


def _board_diff(s, d):
    listed = lambda names: s.createDataFrame([(n,) for n in names], "feature string")
    return L.feature_board_diff(_board(s, d), listed(_DROPLIST), listed(_WHITELIST))


register("feature_board_diff", _board_diff, oracle("driver_rows", f"""
SELECT 'new_drop_candidate' AS list, feature FROM board WHERE final_action = 'drop' AND feature NOT IN ({_in(_DROPLIST)})
UNION ALL SELECT 'review_not_in_whitelist', feature FROM board WHERE final_action = 'review' AND feature NOT IN ({_in(_WHITELIST)})""", *BOARD))

_FORCED = list(dict.fromkeys([*FORBIDDEN, *TARGETS]))
_CANDIDATES = [c for c in POLICY_COLUMNS if c not in _FORCED]
_POLICY_NUMERIC = ["driver_count", "premium", "premium_wo_term", "engine_power_mean", "car_age_mean", "SCORE_1_1", "SCORE_4_1", "SCORE_11_1"]
SELECTION = [
    f"prates AS (SELECT feature, null_rate AS missing_rate FROM ({null_rate_sql('policy', _CANDIDATES)}))",
    "pcors AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN count({c}) >= 50 THEN abs(corr({c}::DOUBLE, is_claim::DOUBLE)) END AS k FROM policy" for c in _POLICY_NUMERIC) + ")",
    f"""selection AS (SELECT feature, CASE WHEN feature IN ('premium', 'premium_wo_term') THEN 'keep' WHEN missing_rate > 0.9 THEN 'drop'
    WHEN missing_rate > 0.6 OR abs_corr >= 0.08 THEN 'review' ELSE 'keep' END AS decision,
  CASE WHEN feature IN ('premium', 'premium_wo_term') THEN 'force_keep' WHEN missing_rate > 0.9 THEN 'missing_rate>0.90'
    WHEN missing_rate > 0.6 OR abs_corr >= 0.08 THEN concat_ws('|', CASE WHEN missing_rate > 0.6 THEN 'missing_rate>0.60' END,
      CASE WHEN abs_corr >= 0.08 THEN 'abs_corr>=0.08' END) ELSE 'pass_rules' END AS reason, missing_rate, abs_corr
  FROM (SELECT feature, missing_rate, coalesce(k, 0.0) AS abs_corr FROM prates LEFT JOIN pcors USING (feature))
  UNION ALL SELECT f, 'drop', 'force_drop', NULL, NULL FROM (SELECT unnest([{_in([c for c in _FORCED if c in POLICY_COLUMNS])}]) AS f))""",
]
register("feature_selection", lambda s, d: rounded(L.feature_selection(S.policies(s, d)), 9, "missing_rate", "abs_corr"), oracle(
    "policy", f"SELECT feature, decision, reason, {sfx('missing_rate')} AS missing_rate, {sfx('abs_corr')} AS abs_corr FROM selection", *SELECTION))


def _profile(s, d):
    policy = S.policies(s, d)
    counts = L.selection_summary(L.feature_selection(policy), policy)
    profile = rounded(P.eda_profile(S.driver_rows(s, d)), 9, "claim_rate", "rows_per_contract_mean", "premium_duplication_factor",
                      driver_level_premium_sum=1, policy_level_premium_sum=1)
    return profile.select("*", *[counts.select(c).scalar().alias(c) for c in ("whitelist_count", "droplist_count", "review_count")])


register("eda_profile", _profile, oracle("policy", f"""
SELECT (SELECT count(*) FROM driver_rows) AS train_rows, {len(ROW_COLUMNS)}::BIGINT AS train_columns,
  {sfx('(SELECT avg(is_claim::DOUBLE) FROM driver_rows)')} AS claim_rate, count(*) AS contract_nunique,
  {sfx('avg(driver_count)')} AS rows_per_contract_mean, {sfx('(SELECT sum(premium) FROM driver_rows)', 1)} AS driver_level_premium_sum,
  {sfx('sum(premium)', 1)} AS policy_level_premium_sum, {sfx('(SELECT sum(premium) FROM driver_rows) / sum(premium)')} AS premium_duplication_factor,
  (SELECT count(*) FROM selection WHERE decision = 'keep') AS whitelist_count, (SELECT count(*) FROM selection WHERE decision = 'drop') AS droplist_count,
  (SELECT count(*) FROM selection WHERE decision = 'review') AS review_count FROM policy""", *SELECTION))
