"""Registered queries: feature preparation, pruning, the fitted preprocessor."""

from __future__ import annotations

from pyspark.sql import functions as F

from tariffspark.functions.columns import NUMBER_PATTERN
from tariffspark.operators import drift as D
from tariffspark.operators import encode as E
from tariffspark.operators import features as X
from tariffspark.operators import preprocess as Z
from tariffspark.operators import prune as P
from tariffspark.plans.common import oracle, rounded, sfx
from tariffspark.plans.eda import psi_sql
from tariffspark.session import materialize
from tariffspark.sources import portfolio as S

QUERIES, ORACLES = {}, {}
CUTOFF = "2000-06-01"
NUMERIC = ["driver_count", "premium", "premium_wo_term", "engine_power_mean", "car_age_mean", "SCORE_1_1", "SCORE_4_1", "SCORE_11_1"]
ORDINARY = [c for c in NUMERIC if c not in ("premium", "premium_wo_term")]
TEXT = ["region_name", "ownerkato", "vehicle_type_name", "mark", "model", "bonus_malus", "car_year"]


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _policy(s, d, *extra):
    return materialize(S.policies(s, d).select("contract_number", *extra), "policy")


# -- numeric-like text ---------------------------------------------------------------

def number_sql(expr):
    return f"(CASE WHEN regexp_matches(trim({expr}), '{NUMBER_PATTERN}') THEN trim({expr})::DOUBLE END)"


def clean_sql(c, year):
    compact = f"trim(replace(replace({c}, chr(160), ''), ' ', ''))"
    if year:
        grown = f"substr({compact}, 1, 1) || CASE WHEN {compact}[1] = '1' THEN '9' ELSE '0' END || substr({compact}, 2, 2)"
        compact = f"(CASE WHEN (contains({c}, ' ') OR contains({c}, chr(160))) AND regexp_matches({compact}, '^[12][0-9]{{2}}$') THEN {grown} ELSE {compact} END)"
    return number_sql(compact)


BONUS, YEAR = clean_sql("bonus_malus", False), clean_sql("car_year", True)
as_text = lambda n: f"cast({n}::BIGINT AS varchar)"

register("clean_numeric_like", lambda s, d: E.clean_numeric_columns(S.driver_rows(s, d)).select("row_key", "bonus_malus", "car_year"),
         oracle("driver_rows", f"SELECT row_key, {as_text(BONUS)} AS bonus_malus, {as_text(YEAR)} AS car_year FROM driver_rows"))
register("clean_numeric_stats", lambda s, d: E.numeric_like_stats(S.driver_rows(s, d)), oracle("driver_rows", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS non_null, count(*) FILTER (WHERE {c} IS NOT NULL AND {number_sql(c)} IS NULL) AS non_numeric_before,
  count(*) FILTER (WHERE {c} IS NOT NULL AND {number_sql(c)} IS NULL AND {k} IS NOT NULL) AS rescued,
  count(*) FILTER (WHERE {c} IS NOT NULL AND {k} IS NULL) AS coerced_to_missing FROM driver_rows""" for c, k in (("bonus_malus", BONUS), ("car_year", YEAR)))))

# -- numbers ---------------------------------------------------------------------------


def _imputed(s, d):
    policy = _policy(s, d, *NUMERIC)
    return E.impute(policy, E.fit_fill_values(policy, NUMERIC))


def fill_sql(c, source="policy"):
    return f"coalesce({c}::DOUBLE, 0.0::DOUBLE)" if c in ("premium", "premium_wo_term") else \
        f"coalesce({c}::DOUBLE, (SELECT coalesce(quantile_cont({c}::DOUBLE, 0.5::DOUBLE), 0) FROM {source}))"


FILLED = "filled AS (SELECT contract_number, " + ", ".join(f"{fill_sql(c)} AS {c}" for c in NUMERIC) + " FROM policy)"
register("impute_median", _imputed, oracle("policy", "SELECT * FROM filled", FILLED))


def _flags(s, d):
    policy = _policy(s, d, *NUMERIC)
    flagged = E.fit_missing_flags(policy, NUMERIC, 0.005)
    return E.missing_flags(policy, flagged).select("contract_number", *[f"{c}_is_missing" for c in flagged])


FLAGGED = ["SCORE_11_1", "SCORE_4_1", "car_age_mean"]
register("missing_flags", _flags, oracle(
    "policy", "SELECT contract_number, " + ", ".join(f"({c} IS NULL)::INTEGER AS {c}_is_missing" for c in FLAGGED) + " FROM policy"))


def _winsorized(s, d):
    filled = materialize(_imputed(s, d), "filled")
    return E.winsorize(filled, E.fit_winsor_bounds(filled, ORDINARY))


def clip_sql(c, source="filled", low=0.01, high=0.99):
    return (f"least(greatest({c}, (SELECT quantile_cont({c}, {low}::DOUBLE) FROM {source})), (SELECT quantile_cont({c}, {high}::DOUBLE) FROM {source}))")


register("winsorize", lambda s, d: rounded(_winsorized(s, d), 9, *ORDINARY), oracle("policy", "SELECT contract_number, premium, premium_wo_term, "
         + ", ".join(f"{sfx(clip_sql(c))} AS {c}" for c in ORDINARY) + " FROM filled", FILLED))
register("log1p_features", lambda s, d: rounded(E.log1p_columns(S.policies(s, d)).select("contract_number", "premium_log1p", "premium_wo_term_log1p"), 9,
                                               "premium_log1p", "premium_wo_term_log1p"),
         oracle("policy", f"""SELECT contract_number, {sfx('ln(1 + greatest(premium, 0))')} AS premium_log1p,
  {sfx('ln(1 + greatest(premium_wo_term, 0))')} AS premium_wo_term_log1p FROM policy"""))

PARTS = [f"operation_date_{p}" for p in E.DATE_PARTS]


def date_sql(c="operation_date", digits=9):
    month = f"coalesce(month({c}), 0)::DOUBLE"
    angle = f"2.0::DOUBLE * 3.141592653589793::DOUBLE * {month} / 12.0::DOUBLE"
    return [f"{month} AS {c}_month", f"coalesce(quarter({c}), 0)::DOUBLE AS {c}_quarter", f"coalesce(isodow({c}) - 1, 0)::DOUBLE AS {c}_dayofweek",
            f"coalesce((last_day({c}) = {c}::DATE)::INTEGER, 0) AS {c}_is_month_end", f"{sfx(f'sin({angle})', digits)} AS {c}_sin_month",
            f"{sfx(f'cos({angle})', digits)} AS {c}_cos_month"]


register("date_features", lambda s, d: rounded(E.date_features(S.policies(s, d), "operation_date").select("contract_number", *PARTS), 9,
                                              "operation_date_sin_month", "operation_date_cos_month"),
         oracle("policy", f"SELECT contract_number, {', '.join(date_sql())} FROM policy"))

# -- categories ----------------------------------------------------------------------------
# Rare here: below 4% of the policies and below 700 policies.
RARE = {"share": 0.04, "least": 700}
CATS = ["ownerkato", "mark", "model", "region_name", "car_year"]


def lookup_ctes(columns, source, share, least, smoothing=20.0, leaf=100, prefix=""):
    """CTE ``{prefix}lookup`` (feature, category, n, s, te, freq) of folded categories."""
    union = " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce({c}, 'missing') AS category, is_claim FROM {source}" for c in columns)
    total = f"(SELECT count(*) FROM {source})"
    mean = f"(SELECT avg(is_claim::DOUBLE) FROM {source})"
    pull = f"CASE WHEN n < {leaf} THEN {smoothing * 2}::DOUBLE ELSE {smoothing}::DOUBLE END"
    return [
        f"{prefix}cats AS (SELECT feature, category, count(*) AS n, sum(is_claim)::DOUBLE AS s FROM ({union}) GROUP BY 1, 2)",
        f"{prefix}keep AS (SELECT feature, category FROM {prefix}cats WHERE n / {total}::DOUBLE >= {share}::DOUBLE OR n >= {least})",
        f"""{prefix}lookup AS (SELECT *, (s / n * n + {mean} * ({pull})) / (n + {pull}) AS te, n / {total}::DOUBLE AS freq FROM (
SELECT c.feature, CASE WHEN k.category IS NULL THEN 'other' ELSE c.category END AS category, sum(n)::BIGINT AS n, sum(s) AS s
FROM {prefix}cats c LEFT JOIN {prefix}keep k ON c.feature = k.feature AND c.category = k.category GROUP BY 1, 2))""",
    ]


def _categories(s, d, **kw):
    policy = _policy(s, d, "is_claim", *CATS)
    return policy, E.fit_categories(policy, CATS, **{**RARE, **kw})


LOOKUP = lookup_ctes(CATS, "policy", RARE["share"], RARE["least"])
register("rare_categories", lambda s, d: _categories(s, d)[1].lookup.select("feature", "category", "n"),
         oracle("policy", "SELECT feature, category, n FROM lookup", *LOOKUP))
register("target_encoding_map", lambda s, d: rounded(_categories(s, d)[1].lookup.select("feature", "category", "te"), 9, "te"),
         oracle("policy", f"SELECT feature, category, {sfx('te')} AS te FROM lookup", *LOOKUP))


def _encoded(s, d, target=(), frequency=()):
    policy, state = _categories(s, d)
    return E.fold_and_encode(policy, state, CATS, target, frequency)


def folded_sql(c, source, te=False, freq=False, prefix="", digits=9):
    """Select items and join that fold one category of ``source`` p and add its encodings."""
    on = f"LEFT JOIN {prefix}lookup l_{c} ON l_{c}.feature = '{c}' AND l_{c}.category = coalesce(p.{c}, 'missing')"
    other = lambda v: f"(SELECT {v} FROM {prefix}lookup WHERE feature = '{c}' AND category = 'other')"
    items = [f"CASE WHEN l_{c}.category IS NULL THEN 'other' ELSE l_{c}.category END AS {c}"]
    if te:
        items.append(f"""{sfx(f"coalesce(l_{c}.te, {other('te')}, (SELECT avg(is_claim::DOUBLE) FROM {source}))", digits)} AS {c}_te""")
    if freq:
        items.append(f"""{sfx(f"coalesce(l_{c}.freq, {other('freq')}, 0)", digits)} AS {c}_freq""")
    return items, on


def _encode_oracle(te, freq):
    parts = [folded_sql(c, "policy", te, freq) for c in CATS]
    return oracle("policy", "SELECT contract_number, " + ", ".join(i for items, _ in parts for i in items) + " FROM policy p " + " ".join(j for _, j in parts), *LOOKUP)


register("target_encoding_apply", lambda s, d: rounded(_encoded(s, d, target=CATS).drop("is_claim"), 9, *[f"{c}_te" for c in CATS]), _encode_oracle(True, False))
register("frequency_encoding", lambda s, d: rounded(_encoded(s, d, frequency=CATS).drop("is_claim"), 9, *[f"{c}_freq" for c in CATS]), _encode_oracle(False, True))

FOLDS = 5
HASH = lambda k: f"('0x' || substr(md5(cast({k} AS varchar)), 1, 8))::BIGINT"


def _oof(s, d):
    policy = _policy(s, d, "is_claim", "mark", "model")
    out = E.out_of_fold_encoding(policy, ["mark", "model"], FOLDS, "contract_number")
    return rounded(out.select("contract_number", "mark_te", "model_te"), 9, "mark_te", "model_te")


def oof_sql(c):
    """Each fold is encoded in its own pass over the other folds."""
    return f"""{c}_enc AS (SELECT f.fold, t.category, (t.m * t.n + f.mu * t.w) / (t.n + t.w) AS te FROM
  (SELECT v.fold, avg(p.is_claim::DOUBLE) AS mu FROM range({FOLDS}) v(fold) JOIN folded p ON p.fold <> v.fold GROUP BY v.fold) f
  JOIN (SELECT v.fold, p.{c} AS category, avg(p.is_claim::DOUBLE) AS m, count(*) AS n, CASE WHEN count(*) < 100 THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS w
    FROM range({FOLDS}) v(fold) JOIN folded p ON p.fold <> v.fold GROUP BY v.fold, p.{c}) t ON t.fold = f.fold)"""


register("target_encoding_oof", _oof, oracle("policy", f"""SELECT p.contract_number, {sfx('a.te')} AS mark_te, {sfx('b.te')} AS model_te FROM folded p
LEFT JOIN mark_enc a ON a.fold = p.fold AND a.category = p.mark LEFT JOIN model_enc b ON b.fold = p.fold AND b.category = p.model""",
    f"folded AS (SELECT *, {HASH('contract_number')} % {FOLDS} AS fold FROM policy)", oof_sql("mark"), oof_sql("model")))

# -- derived columns ------------------------------------------------------------------------


def _aggregates(s, d):
    policy = S.policies(s, d)
    flagged = ["SCORE_4_1", "SCORE_11_1", "car_age_mean"]
    plan = X.missing_aggregate_plan(flagged)
    return X.missing_aggregates(E.missing_flags(policy, flagged), plan).select("contract_number", *plan)


_miss4, _miss11 = "(SCORE_4_1 IS NULL)::INTEGER", "(SCORE_11_1 IS NULL)::INTEGER"
register("missing_aggregates", _aggregates, oracle("policy", f"""SELECT contract_number, ({_miss4} + {_miss11})::DOUBLE AS score_missing_cnt_total,
  ({_miss4} + {_miss11}) / 2.0::DOUBLE AS score_missing_share, {_miss4}::DOUBLE AS score_4_missing_cnt, {_miss11}::DOUBLE AS score_11_missing_cnt FROM policy"""))

_SCORES = ["SCORE_1_1", "SCORE_4_1", "SCORE_11_1"]
STATS = """stats AS (SELECT *, coalesce(list_aggregate(v, 'avg'), 0) AS score_mean, coalesce(list_aggregate(v, 'stddev_pop'), 0) AS score_std,
  coalesce(list_aggregate(v, 'median'), 0) AS score_median FROM (SELECT *, list_filter([SCORE_1_1, SCORE_4_1, SCORE_11_1], lambda t: t IS NOT NULL) AS v FROM policy))"""
register("score_row_stats", lambda s, d: rounded(X.with_score_statistics(S.policies(s, d), _SCORES).select(
    "contract_number", "score_mean", "score_std", "score_median"), 8, "score_mean", "score_std", "score_median"),
    oracle("policy", f"SELECT contract_number, {sfx('score_mean', 8)} AS score_mean, {sfx('score_std', 8)} AS score_std, {sfx('score_median', 8)} AS score_median FROM stats", STATS))

BASE_NUMERIC = [n for n in X.BASE_INTERACTIONS if n != "region_x_vehicle_type"]
register("interactions_base", lambda s, d: rounded(X.with_interactions(S.policies(s, d), list(X.BASE_INTERACTIONS)).select(
    "contract_number", *X.BASE_INTERACTIONS), 6, *BASE_NUMERIC), oracle("policy", f"""SELECT contract_number,
  {sfx('premium / driver_count', 6)} AS premium_per_driver, {sfx('premium_wo_term / driver_count', 6)} AS premium_wo_term_per_driver,
  {sfx('premium / CASE WHEN abs(coalesce(engine_power_mean, 0)) <= 1e-9 THEN 1 ELSE engine_power_mean END', 6)} AS premium_per_power,
  {sfx('premium_wo_term / CASE WHEN abs(coalesce(engine_power_mean, 0)) <= 1e-9 THEN 1 ELSE engine_power_mean END', 6)} AS premium_wo_term_per_power,
  {sfx(f"coalesce(car_age_mean, 0) * coalesce({number_sql('bonus_malus')}, 0)", 6)} AS car_age_x_bonus_malus,
  coalesce(region_name, 'missing') || '__' || coalesce(vehicle_type_name, 'missing') AS region_x_vehicle_type FROM policy"""))


def _extended(s, d):
    """Policies with region frequency, missing counts and the ten extended interactions."""
    policy = _policy(s, d, "operation_date", "is_claim", "region_name", "bonus_malus", *NUMERIC)
    state = E.fit_categories(policy, ["region_name"])
    coded = E.fold_and_encode(policy, state, ["region_name"], frequency_columns=["region_name"])
    flagged = E.missing_flags(coded, ["SCORE_4_1", "SCORE_11_1"])
    counted = X.missing_aggregates(flagged, X.missing_aggregate_plan(["SCORE_4_1", "SCORE_11_1"]))
    return X.with_interactions(counted, list(X.EXTENDED_INTERACTIONS))


EXTENDED = f"""extended AS (SELECT *, score_mean / CASE WHEN abs(coalesce(premium, 0)) <= 1e-9 THEN 1 ELSE premium END AS score_x_premium_ratio,
  score_mean * bm AS score_x_bonus_malus, score_mean * coalesce(car_age_mean, 0) AS score_x_car_age, score_mean - score_median AS score_group_mean_diff,
  premium * engine_power_mean AS premium_x_power, premium_wo_term * engine_power_mean AS premium_wo_term_x_power,
  coalesce(car_age_mean, 0) * region_freq AS car_age_x_region_risk, bm * region_freq AS bm_x_region_risk,
  ({_miss4} + {_miss11}) * score_mean AS score_missing_cnt_x_score_mean, score_std * premium AS score_dispersion_x_premium
FROM (SELECT *, coalesce({number_sql('bonus_malus')}, 0.0::DOUBLE) AS bm,
  (count(*) OVER (PARTITION BY coalesce(region_name, 'missing')))::DOUBLE / count(*) OVER () AS region_freq FROM stats))"""
EXT = list(X.EXTENDED_INTERACTIONS)
_wide = {"premium_x_power": 3, "premium_wo_term_x_power": 3, "score_dispersion_x_premium": 2}
register("interactions_ext", lambda s, d: rounded(_extended(s, d).select("contract_number", *EXT), 7, *[c for c in EXT if c not in _wide], **_wide),
         oracle("policy", "SELECT contract_number, " + ", ".join(f"{sfx(c, _wide.get(c, 7))} AS {c}" for c in EXT) + " FROM extended", STATS, EXTENDED))

# -- pruning -----------------------------------------------------------------------------------
LIMITS = {"max_features": 4, "corr": 0.97, "psi": 0.6}
FILTER_BASE = ["premium", "premium_wo_term", "engine_power_mean", "car_age_mean", "SCORE_1_1"]
SPLIT = """split AS (SELECT *, CASE WHEN rk <= cut THEN 'reference' ELSE 'current' END AS win FROM (
SELECT *, least(greatest(round_even(n * 0.7::DOUBLE, 0), 500), greatest(n - 500, 1)) AS cut FROM (
SELECT *, row_number() OVER (ORDER BY operation_date, contract_number) AS rk, count(*) OVER () AS n FROM {source} WHERE operation_date IS NOT NULL)))"""


def _interaction_filter(s, d):
    table = materialize(_extended(s, d), "extended")
    split = D.time_split(table, "operation_date", "contract_number")
    decisions = P.filter_interactions(table, EXT, FILTER_BASE, LIMITS["max_features"], LIMITS["corr"], LIMITS["psi"], split)
    rows = [(x["feature"], x["reason"], x.get("value")) for x in decisions]
    return rounded(s.createDataFrame(rows, "feature string, reason string, value double"), 6, "value")


_pairs = " UNION ALL ".join(f"SELECT '{i}' AS feature, abs(corr({i}, coalesce({b}, 0))) AS r FROM extended" for i in EXT for b in FILTER_BASE)
_targets = " UNION ALL ".join(f"SELECT '{i}' AS feature, abs(corr({i}, is_claim::DOUBLE)) AS t FROM extended" for i in EXT)
register("interaction_filter", _interaction_filter, oracle("policy", f"""
SELECT feature, reason, {sfx('value', 6)} AS value FROM (
SELECT feature, CASE WHEN mx >= {LIMITS['corr']} THEN 'interaction_corr' WHEN psi > {LIMITS['psi']} THEN 'interaction_psi'
  WHEN row_number() OVER (PARTITION BY mx >= {LIMITS['corr']} OR psi > {LIMITS['psi']} ORDER BY psi, -t, feature) <= {LIMITS['max_features']} THEN 'interaction_retained'
  ELSE 'interaction_rank' END AS reason, CASE WHEN mx >= {LIMITS['corr']} THEN mx ELSE psi END AS value
FROM (SELECT feature, max(r) AS mx FROM ({_pairs}) GROUP BY 1) JOIN ({_targets}) USING (feature) JOIN psi USING (feature))""",
    STATS, EXTENDED, SPLIT.format(source="extended"), *psi_sql(EXT, "split")))

PLANTED_FEATURES = ["SCORE_1_1", "day_index", "engine_power_mean", "power_twice", "premium", "premium_copy", "score_missing_share"]


def _planted(s, d):
    """Policies with a copied column, a linear twin, a drifting column and a missing share."""
    p = S.policies(s, d)
    return materialize(p.select(
        "contract_number", "operation_date", "is_claim", "premium", F.col("premium").alias("premium_copy"), "engine_power_mean",
        (F.col("engine_power_mean") * 2 + 1).alias("power_twice"), F.col("SCORE_11_1").isNull().cast("double").alias("score_missing_share"),
        F.datediff(F.to_date("operation_date"), F.lit("1995-01-01").cast("date")).cast("double").alias("day_index"), "SCORE_1_1"), "planted")


PLANTED = """planted AS (SELECT contract_number, operation_date, is_claim, premium, premium AS premium_copy, engine_power_mean,
  engine_power_mean * 2 + 1 AS power_twice, (SCORE_11_1 IS NULL)::DOUBLE AS score_missing_share,
  (operation_date::DATE - DATE '1995-01-01')::DOUBLE AS day_index, SCORE_1_1 FROM policy)"""


def _duplicates(s, d):
    found = P.duplicate_columns(_planted(s, d), PLANTED_FEATURES, "contract_number", ["premium"])
    return s.createDataFrame([(x["feature"], x["kept"], x["reason"]) for x in found], "feature string, kept string, reason string")


_order = lambda cols: sorted(cols, key=lambda c: (c != "premium", c))
_equal = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{b}' AS feature, '{a}' AS kept, count(*) FILTER (WHERE {a} IS DISTINCT FROM {b}) AS differ FROM planted"
    for i, a in enumerate(_order(PLANTED_FEATURES)) for j, b in enumerate(_order(PLANTED_FEATURES)) if i < j)
DUPES = f"dupes AS (SELECT feature, arg_min(kept, i) AS kept FROM ({_equal}) WHERE differ = 0 AND feature <> 'premium' GROUP BY feature)"
register("prune_duplicates", _duplicates, oracle("policy", "SELECT feature, kept, 'exact_duplicate' AS reason FROM dupes", PLANTED, DUPES))


def _correlated(s, d):
    found = P.correlated_columns(_planted(s, d), PLANTED_FEATURES, 0.9, ["premium"])
    return rounded(s.createDataFrame([(x["feature"], x["kept"], x["value"]) for x in found], "feature string, kept string, value double"), 7, "value")


def corr_sql(columns, threshold):
    cols = _order(columns)
    pairs = " UNION ALL ".join(f"SELECT {j} AS j, '{a}' AS feature, '{b}' AS kept, abs(corr(coalesce({a}, 0), coalesce({b}, 0))) AS value FROM planted"
                               for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j)
    return f"SELECT feature, arg_min(kept, j) AS kept, arg_min(value, j) AS value FROM ({pairs}) WHERE value > {threshold} AND feature <> 'premium' GROUP BY feature"


register("prune_correlated", _correlated, oracle("policy", f"SELECT feature, kept, {sfx('value', 7)} AS value FROM ({corr_sql(PLANTED_FEATURES, 0.9)})", PLANTED))

PSI_FEATURES = ["premium", "premium_wo_term", "engine_power_mean", "car_age_mean", "SCORE_1_1", "SCORE_4_1", "SCORE_11_1", "driver_count"]


def _windowed(s, d):
    window = F.when(F.col("operation_date") < F.lit(CUTOFF).cast("timestamp_ntz"), "reference").otherwise("current")
    return S.policies(s, d).withColumn("window", window)


register("psi", lambda s, d: rounded(D.psi(_windowed(s, d), PSI_FEATURES), 8, "psi"), oracle(
    "policy", f"SELECT feature, {sfx('psi', 8)} AS psi FROM psi",
    f"windowed AS (SELECT *, CASE WHEN operation_date < TIMESTAMP '{CUTOFF}' THEN 'reference' ELSE 'current' END AS win FROM policy)", *psi_sql(PSI_FEATURES)))


def _prune_drift(s, d):
    split = D.time_split(_planted(s, d), "operation_date", "contract_number")
    return rounded(D.drift_report(split, PLANTED_FEATURES, protected=["premium"], exclude_patterns=["*_copy"]), 8, "psi")


register("prune_drift", _prune_drift, oracle("policy", f"""SELECT feature, {sfx('psi', 8)} AS psi, CASE WHEN feature = 'premium' THEN 'protected'
  WHEN feature LIKE '%\\_copy' ESCAPE '\\' THEN 'excluded' WHEN psi > 0.25 THEN 'drop' ELSE 'keep' END AS decision FROM psi""",
    PLANTED, SPLIT.format(source="planted"), *psi_sql(PLANTED_FEATURES, "split")))


def _pruning_report(s, d):
    table = _planted(s, d)
    pruned = P.prune_features(table, PLANTED_FEATURES, statistics={"corr_threshold": 0.995}, drift={}, force_keep=["premium"], date="operation_date")
    return rounded(P.decisions_frame(table, len(PLANTED_FEATURES), pruned), 6, "value")


_after = [c for c in PLANTED_FEATURES if c not in ("premium_copy", "score_missing_share")]
register("pruning_report", _pruning_report, oracle("policy", f"""
SELECT feature, reason, kept_instead, {sfx('value', 6)} AS value FROM (SELECT * FROM gone
UNION ALL SELECT '*', 'before_count', NULL, 7 UNION ALL SELECT '*', 'after_count', NULL, 7 - (SELECT count(*) FROM gone)
UNION ALL SELECT '*', 'dropped_total', NULL, (SELECT count(*) FROM gone))""", PLANTED, DUPES, SPLIT.format(source="planted"), *psi_sql(PLANTED_FEATURES, "split"),
    f"""gone AS (SELECT feature, 'exact_duplicate' AS reason, kept AS kept_instead, NULL::DOUBLE AS value FROM dupes
UNION ALL SELECT 'score_missing_share', 'manual', NULL, NULL
UNION ALL SELECT feature, 'corr>0.995', kept, value FROM ({corr_sql(_after, 0.995)})
UNION ALL SELECT feature, 'drift_psi', NULL, psi FROM psi WHERE psi > 0.25 AND feature IN ('SCORE_1_1', 'day_index', 'power_twice'))"""))

# -- the fitted preprocessor -----------------------------------------------------------------------
CONFIG = dict(missing_flag_threshold=0.005, rare_share=0.04, rare_count=700)
FLAGS = ["car_age_mean", "SCORE_4_1", "SCORE_11_1"]


def _splits(s, d):
    rows = materialize(S.policies(s, d), "policy")
    cutoff = F.lit(CUTOFF).cast("timestamp_ntz")
    return rows.where(F.col("operation_date") < cutoff), rows.where(F.col("operation_date") >= cutoff)


def _fit_transform(s, d):
    train, valid = _splits(s, d)
    state = Z.fit_preprocessor(train, Z.PreprocessConfig(**CONFIG))
    return _rounded_matrix(Z.transform(valid, state))


ENC = Z.ENCODED
_six = [*[f"{c}_te" for c in ENC], *[f"{c}_freq" for c in ENC], "operation_date_sin_month", "operation_date_cos_month",
        "premium_log1p", "premium_wo_term_log1p", *ORDINARY]
_six += ["premium_per_driver", "premium_wo_term_per_driver", "premium_per_power", "premium_wo_term_per_power", "car_age_x_bonus_malus"]


def _rounded_matrix(df):
    return rounded(df, 6, *[c for c in _six if c in df.columns])


CLEANED = f"cleaned AS (SELECT * REPLACE ({as_text(BONUS)} AS bonus_malus, {as_text(YEAR)} AS car_year) FROM policy)"
TRAIN = f"train AS (SELECT * FROM cleaned WHERE operation_date < TIMESTAMP '{CUTOFF}')"
TFILLED = "tfilled AS (SELECT " + ", ".join(f"{fill_sql(c, 'train')} AS {c}" for c in NUMERIC) + " FROM train)"


def matrix_sql(source, absent=()):
    """Select over ``source`` that applies everything fitted on ``train``."""
    number = {c: ("NULL" if c in absent else f"p.{c}") for c in NUMERIC}
    filled = {c: (f"coalesce({number[c]}::DOUBLE, 0.0::DOUBLE)" if c in ("premium", "premium_wo_term") else
                  f"coalesce({number[c]}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5::DOUBLE) FROM train))") for c in NUMERIC}
    value = {c: filled[c] if c in ("premium", "premium_wo_term") else
             f"least(greatest({filled[c]}, (SELECT quantile_cont({c}, 0.01::DOUBLE) FROM tfilled)), (SELECT quantile_cont({c}, 0.99::DOUBLE) FROM tfilled))" for c in NUMERIC}
    inner = [f"{value[c]} AS {c}" for c in NUMERIC] + [f"({number[c]} IS NULL)::INTEGER AS {c}_is_missing" for c in FLAGS]
    joins = []
    for c in TEXT:
        items, on = folded_sql(c, "train", c in ENC, c in ENC, digits=6)
        if c in absent:
            items, on = [i.replace(f"p.{c}", "NULL") for i in items], on.replace(f"p.{c}", "NULL")
        inner += items
        joins.append(on)
    dates = date_sql(digits=6)
    return f"""SELECT contract_number, is_claim, claim_amount, claim_cnt, premium, premium_wo_term, {', '.join(f"{sfx(c, 6)} AS {c}" for c in ORDINARY)},
  {', '.join(f'{c}_is_missing' for c in FLAGS)}, {', '.join(TEXT)}, {', '.join(f'{c}_te, {c}_freq' for c in ENC)},
  {sfx('ln(1 + greatest(premium, 0))', 6)} AS premium_log1p, {sfx('ln(1 + greatest(premium_wo_term, 0))', 6)} AS premium_wo_term_log1p, {', '.join(dates)},
  (SCORE_4_1_is_missing + SCORE_11_1_is_missing)::DOUBLE AS score_missing_cnt_total, (SCORE_4_1_is_missing + SCORE_11_1_is_missing) / 2.0::DOUBLE AS score_missing_share,
  SCORE_4_1_is_missing::DOUBLE AS score_4_missing_cnt, SCORE_11_1_is_missing::DOUBLE AS score_11_missing_cnt,
  {sfx('premium / driver_count', 6)} AS premium_per_driver, {sfx('premium_wo_term / driver_count', 6)} AS premium_wo_term_per_driver,
  {sfx('premium / engine_power_mean', 6)} AS premium_per_power, {sfx('premium_wo_term / engine_power_mean', 6)} AS premium_wo_term_per_power,
  {sfx("car_age_mean * coalesce(TRY_CAST(bonus_malus AS DOUBLE), 0)", 6)} AS car_age_x_bonus_malus, region_name || '__' || vehicle_type_name AS region_x_vehicle_type
FROM (SELECT p.contract_number, p.is_claim, p.claim_amount, p.claim_cnt, p.operation_date, {', '.join(inner)} FROM {source} p {' '.join(joins)})"""


FITTED = [CLEANED, TRAIN, TFILLED, *lookup_ctes(TEXT, "train", 0.04, 700)]
VALID = f"valid AS (SELECT * FROM cleaned WHERE operation_date >= TIMESTAMP '{CUTOFF}')"
register("preprocess_fit_transform", _fit_transform, oracle("policy", matrix_sql("valid"), *FITTED, VALID))


def _feature_matrix(s, d):
    """Applied to a split that lacks a score and a category column."""
    train, valid = _splits(s, d)
    state = Z.fit_preprocessor(train, Z.PreprocessConfig(**CONFIG))
    return _rounded_matrix(Z.transform(valid.drop("SCORE_4_1", "mark"), state))


register("feature_matrix", _feature_matrix, oracle("policy", matrix_sql("valid", ("SCORE_4_1", "mark")), *FITTED, VALID))
