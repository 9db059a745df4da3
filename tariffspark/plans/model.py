"""Registered queries: models, their deterministic parts, and scoring jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tariffspark.models import bench as B
from tariffspark.models import calibrate as C
from tariffspark.models import freqsev as M
from tariffspark.models import matrix as X
from tariffspark.operators import price_search as Z
from tariffspark.operators import pricing as R
from tariffspark.operators import score as K
from tariffspark.operators.preprocess import PreprocessConfig, fit_preprocessor, train_matrix, transform
from tariffspark.operators.selection import blend_predictions
from tariffspark.plans.common import oracle, rounded, scalar_price_sql, sfx
from tariffspark.plans.price import DEFAULT_ALPHA, DEFAULT_BETA
from tariffspark.plans.split import CUTOFF
from tariffspark.roles import PREDICTION
from tariffspark.session import materialize, shared_folder
from tariffspark.sources import portfolio as S
from tariffspark.streaming import reprice as T

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# -- parts that SQL can check ---------------------------------------------------------------

register("freq_balanced_weights", lambda s, d: rounded(M.class_weights(S.policies(s, d)), 9, "weight"), oracle("policy", f"""
SELECT is_claim, count(*) AS n, {sfx('(SELECT count(*) FROM policy) / (2.0::DOUBLE * count(*))')} AS weight FROM policy GROUP BY is_claim"""))
register("severity_constant", lambda s, d: rounded(M.severity_constant(S.policies(s, d)), 4, "severity_constant"), oracle("policy", f"""
SELECT {sfx('avg(claim_amount)', 4)} AS severity_constant, count(*) AS claims FROM policy WHERE is_claim > 0"""))


def _expected(s, d):
    policy = S.scored_policies(s, d)
    log_severity = F.log1p(F.col("premium")) + F.lit(0.1) * (F.col("SCORE_1_1") - F.lit(25.0))
    out = M.expected_loss(policy.drop("expected_severity", "expected_loss"), F.col("p_claim"), log_severity)
    return rounded(out.select("contract_number", *PREDICTION), 8, "p_claim", expected_severity=2, expected_loss=2)


register("expected_loss", _expected, oracle("scored", f"""
SELECT contract_number, {sfx('p_claim', 8)} AS p_claim, {sfx('sev', 2)} AS expected_severity, {sfx('p_claim * sev', 2)} AS expected_loss
FROM (SELECT contract_number, p_claim, exp(least(greatest(ln(1 + premium) + 0.1::DOUBLE * (SCORE_1_1 - 25.0::DOUBLE), 0), 20)) - 1 AS sev FROM scored)"""))


def _tweedie(s, d):
    policy = S.scored_policies(s, d)
    means = policy.agg(F.avg("claim_amount").alias("l"), F.avg(F.col("is_claim").cast("double")).alias("p"))
    loss = F.col("expected_loss") * F.lit(2.0) - F.lit(20000.0)
    out = M.tweedie_parts(policy, loss, means.select("l").scalar(), means.select("p").scalar())
    return rounded(out.select("contract_number", *PREDICTION), 8, "p_claim", expected_severity=2, expected_loss=2)


register("tweedie_decompose", _tweedie, oracle("scored", f"""
SELECT contract_number, {sfx('p', 8)} AS p_claim, {sfx('CASE WHEN p > 1e-9 THEN el / least(greatest(p, 1e-9::DOUBLE), 1.0::DOUBLE) ELSE ms END', 2)} AS expected_severity, {sfx('el', 2)} AS expected_loss
FROM (SELECT *, least(greatest(el / ms, 0), 1) AS p FROM (SELECT contract_number, greatest(expected_loss * 2.0::DOUBLE - 20000.0::DOUBLE, 0) AS el,
  (SELECT avg(claim_amount) / avg(is_claim::DOUBLE) FROM scored) AS ms FROM scored))"""))

SLOPE, INTERCEPT = 6.5, -2.9
register("calibration_apply", lambda s, d: rounded(
    C.apply_probability(S.scored_policies(s, d), C.platt(F.col("p_claim"), SLOPE, INTERCEPT)).select("contract_number", *PREDICTION), 8, "p_claim",
    expected_loss=2), oracle("scored", f"""
SELECT contract_number, {sfx('p', 8)} AS p_claim, expected_severity, {sfx('expected_severity * p', 2)} AS expected_loss FROM (
SELECT *, least(greatest(1.0::DOUBLE / (1.0::DOUBLE + exp(-({SLOPE}::DOUBLE * least(greatest(p_claim, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) + {INTERCEPT}::DOUBLE))), 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) AS p FROM scored)"""))

BLEND = {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}


def _blend(s, d):
    policy = S.scored_policies(s, d)
    p, sev = F.col("p_claim"), F.col("expected_severity")
    parts = {"a": (p, sev), "b": (p * 0.5 + 0.05, sev * 1.2), "c": (p * p, F.col("premium") * 4.0), "d": (p, sev)}
    cols = {}
    for n, (q, v) in parts.items():
        cols |= {f"{n}_p_claim": q, f"{n}_expected_severity": v, f"{n}_expected_loss": q * v}
    out = blend_predictions(policy.withColumns(cols), list(parts), BLEND)
    return rounded(out.select("contract_number", *PREDICTION), 8, "p_claim", expected_severity=3, expected_loss=2)


register("blend_predictions", _blend, oracle("scored", f"""
SELECT contract_number, {sfx('0.5::DOUBLE * p + 0.3::DOUBLE * pb + 0.2::DOUBLE * p * p', 8)} AS p_claim,
  {sfx('0.5::DOUBLE * v + 0.3::DOUBLE * v * 1.2::DOUBLE + 0.2::DOUBLE * premium * 4.0::DOUBLE', 3)} AS expected_severity,
  {sfx('0.5::DOUBLE * p * v + 0.3::DOUBLE * pb * v * 1.2::DOUBLE + 0.2::DOUBLE * p * p * premium * 4.0::DOUBLE', 2)} AS expected_loss
FROM (SELECT contract_number, premium, p_claim AS p, p_claim * 0.5::DOUBLE + 0.05::DOUBLE AS pb, expected_severity AS v FROM scored)"""))

# Entries of the model matrix, other than zero.
_NUMBERS = ["premium", "driver_count", "engine_power_mean", "car_age_mean", "SCORE_1_1", "SCORE_4_1", "SCORE_11_1"]
_CATEGORIES = ["region_name", "vehicle_type_name"]


def _matrix(s, d):
    schema = X.FeatureSchema(_NUMBERS, _CATEGORIES)
    aligned = materialize(X.align(S.policies(s, d), schema), "aligned")
    return rounded(X.matrix_entries(aligned, X.fit_matrix(aligned, schema), "contract_number"), 7, "value").where("value <> 0")


register("model_matrix", _matrix, oracle("policy", "SELECT * FROM (" + "\nUNION ALL ".join(
    [f"SELECT contract_number, '{c}' AS slot, {sfx('v / stddev_pop(v) OVER ()', 7)} AS value FROM (SELECT contract_number, "
     f"coalesce({c}, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM policy))::DOUBLE AS v FROM policy)" for c in _NUMBERS]
    + [f"SELECT contract_number, '{c}=' || coalesce({c}, 'missing') AS slot, 1.0::DOUBLE AS value FROM policy" for c in _CATEGORIES]) + ") WHERE value <> 0"))

# -- fitted models -------------------------------------------------------------------------------


def _splits(s, d):
    """Feature matrices of the policies before and from the cut-off."""
    policy = materialize(S.policies(s, d), "policy")
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    train, valid = policy.where(F.col("operation_date") < cut), policy.where(F.col("operation_date") >= cut)
    state = fit_preprocessor(train, PreprocessConfig())
    return policy, state, materialize(train_matrix(train, state), "train"), materialize(transform(valid, state), "valid")


def _predictions(candidate, params=None):
    def query(s, d):
        _, _, train, valid = _splits(s, d)
        return M.build_candidate(candidate, params).fit(train).predict(valid).select("contract_number", "is_claim", *PREDICTION)
    return query


register("freq_sev_fit", _predictions("baseline_freq_sev"))
register("gbt_freq_sev", _predictions("gbt_freq_sev"))
register("dependent_severity", _predictions("gbt_dep_freq_sev"))
register("woe_fit", _predictions("woe_freq_sev"))
register("tweedie_fit", _predictions("tweedie_aggregate"))


def _equations(s, d):
    """The largest score equation of the linear fits, penalty included, at the fitted coefficients: zero at the optimum and nowhere else.

    Solvers stop at a tolerance, so the values are small and not zero.
    """
    train = _splits(s, d)[2]
    rows = [(kind, *found) for kind in ("baseline_freq_sev", "woe_freq_sev") for found in M.build_candidate(kind).fit(train).equations(train)]
    return s.createDataFrame(rows, "model string, part string, policies long, largest_equation double")


register("fit_equations", _equations)


def _score_saved(s, d):
    """Predictions of the saved run beside those of the model that is still in memory; both are the same numbers."""
    policy, state, train, valid = _splits(s, d)
    run = f"{shared_folder(s)}/run-{uuid.uuid4().hex}"
    state.save(s, f"{run}/preprocessor")
    model = M.build_candidate("baseline_freq_sev").fit(train)
    model.save(s, f"{run}/model")
    records = policy.where(F.col("operation_date") >= F.lit(CUTOFF).cast("timestamp_ntz"))
    saved = K.score_batch(s, run, records).select("contract_number", *PREDICTION)
    other = model.predict(valid).select("contract_number", *[F.col(c).alias(f"_{c}") for c in PREDICTION])
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) / F.greatest(F.abs(F.col(c)), F.lit(1.0)) for c in PREDICTION])
    product = F.abs(F.col("expected_loss") - F.col("p_claim") * F.col("expected_severity"))
    return saved.join(other, "contract_number").select("contract_number", F.round(gap, 9).alias("gap"), F.round(product, 6).alias("product_gap"))


register("score_saved_equals_fitted", _score_saved, oracle("policy", f"""
SELECT contract_number, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS product_gap FROM policy WHERE operation_date >= TIMESTAMP '{CUTOFF}'"""))


def _oof(s, d):
    return C.oof_predictions(_splits(s, d)[2], "baseline_freq_sev")


register("oof_predictions", _oof)


def _scored(s, d):
    """Predictions with rounded probabilities: both engines then see the same ties."""
    return materialize(rounded(S.scored_policies(s, d).select("contract_number", "is_claim", *PREDICTION), 6, "p_claim"), "scored")


def _calibrate_isotonic(s, d):
    table = _scored(s, d)
    out = C.Calibrator.fit(table, "isotonic").transform(table)
    return rounded(out.select("contract_number", "is_claim", *PREDICTION), 9, "p_claim", expected_severity=2, expected_loss=2)


# A score ends a block where every slope from the left is smaller than every slope to the right.
_CURVE = [f"pts AS (SELECT contract_number, is_claim, expected_severity, least(greatest({sfx('p_claim', 6)}, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) AS p FROM scored)",
          """steps AS (SELECT 0::BIGINT AS i, -1.0::DOUBLE AS p, 0::BIGINT AS cw, 0::BIGINT AS cs UNION ALL
SELECT row_number() OVER (ORDER BY p), p, sum(w) OVER (ORDER BY p)::BIGINT, sum(e) OVER (ORDER BY p)::BIGINT FROM (SELECT p, count(*) AS w, sum(is_claim) AS e FROM pts GROUP BY p))""",
          "lft AS (SELECT b.i, max((b.cs - a.cs)::DOUBLE / (b.cw - a.cw)) AS m FROM steps b JOIN steps a ON a.i < b.i GROUP BY b.i)",
          "rgt AS (SELECT a.i, min((b.cs - a.cs)::DOUBLE / (b.cw - a.cw)) AS m FROM steps a JOIN steps b ON a.i < b.i GROUP BY a.i)",
          """corners AS (SELECT p, (cs - lag(cs) OVER (ORDER BY i))::DOUBLE / (cw - lag(cw) OVER (ORDER BY i)) AS v FROM (
SELECT i, p, cw, cs FROM steps LEFT JOIN lft USING (i) LEFT JOIN rgt USING (i) WHERE lft.m IS NULL OR rgt.m IS NULL OR lft.m < rgt.m))""",
          "fitted AS (SELECT pts.*, least(greatest(v, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) AS c FROM pts ASOF JOIN corners ON pts.p <= corners.p)"]
register("calibrate_isotonic", _calibrate_isotonic, oracle("scored", f"""
SELECT contract_number, is_claim, {sfx('c', 9)} AS p_claim, {sfx('expected_severity', 2)} AS expected_severity, {sfx('expected_severity * c', 2)} AS expected_loss FROM fitted""", *_CURVE))


def _calibrate_platt(s, d):
    """The score equations at the fitted slope and intercept, penalty included: both are zero at the optimum and nowhere else."""
    table = _scored(s, d)
    fitted = C.Calibrator.fit(table, "platt")
    out = table.select(F.col("is_claim").cast("double").alias("y"), F.col("p_claim").alias("x"), C.platt(F.col("p_claim"), fitted.slope, fitted.intercept).alias("c"))
    error = F.col("c") - F.col("y")
    row = out.agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("intercept"),
                  (F.avg(error * F.col("x")) + F.lit(fitted.slope) / F.count(F.lit(1))).alias("slope"))
    return row.select("n", *[F.round(F.abs(c), 5).alias(f"{c}_equation") for c in ("intercept", "slope")])


register("calibrate_platt", _calibrate_platt, oracle("scored", "SELECT count(*) AS n, 0.0::DOUBLE AS intercept_equation, 0.0::DOUBLE AS slope_equation FROM scored"))


def _calibration_report(s, d):
    scored = _scored(s, d)
    rows = []
    for method in ("none", "platt", "isotonic"):
        report = C.fit_calibrator(scored, "baseline_freq_sev", C.CalibrationConfig(enabled=True, method=method), oof=scored)[1]
        rows.append((method, report.status, report.reason, report.brier_raw, report.brier_calibrated, report.auc_raw, report.auc_calibrated))
    return s.createDataFrame(rows, "method string, status string, reason string, brier_raw double, brier_calibrated double, auc_raw double, auc_calibrated double")


register("calibration_report", _calibration_report)

PRICE = B.PriceConfig(alphas=DEFAULT_ALPHA, betas=DEFAULT_BETA)
BENCH = B.BenchmarkConfig(["baseline_freq_sev", "gbt_freq_sev", "woe_freq_sev", "tweedie_aggregate", "no_such_model"], must_pass=False)


def _benchmark(s, d):
    _, _, train, valid = _splits(s, d)
    return B.run_benchmark(train, valid, BENCH, PRICE).table.drop("seconds")


register("benchmark_table", _benchmark)


def _ablation(s, d):
    _, state, train, valid = _splits(s, d)
    return B.ablation(train, valid, state.families(), BENCH, PRICE)


register("ablation", _ablation)


# The built-in grid of the boosted-tree tuning.
TRIALS = [{"iterations": n, "depth": k, "learning_rate": rate, "subsample": share}
          for n, k, rate, share in ((220, 6, 0.05, 0.8), (300, 7, 0.04, 0.85), (360, 6, 0.03, 0.9), (180, 5, 0.07, 0.8))]


def _sweep(s, d):
    _, _, train, valid = _splits(s, d)
    table, baseline = B.sweep(train, valid, "gbt_freq_sev", TRIALS, BENCH, PRICE)
    return table.select("trial", "params", "status", "passes_constraints", "policy_score", "gini", "objective").withColumn("baseline_policy_score", F.lit(baseline))


register("parameter_sweep", _sweep)


def _refit(s, d):
    policy, state, train, valid = _splits(s, d)
    model = M.build_candidate("baseline_freq_sev").fit(train)
    tariff, _ = Z.select_pricing(model.predict(valid), PRICE.alphas, PRICE.betas)
    full = materialize(transform(policy, state), "full")
    return B.refit_and_price(full, valid, "baseline_freq_sev", None, tariff).select("contract_number", *PREDICTION, "new_premium")


register("final_refit_price", _refit)


def _score(s, d):
    """Saved and loaded again before it scores."""
    policy, state, train, valid = _splits(s, d)
    run = f"{shared_folder(s)}/run-{s.sparkContext.applicationId}-{valid.count()}"
    state.save(s, f"{run}/preprocessor")
    M.build_candidate("baseline_freq_sev").fit(train).save(s, f"{run}/model")
    records = policy.where(F.col("operation_date") >= F.lit(CUTOFF).cast("timestamp_ntz"))
    return K.score_batch(s, run, records).select("contract_number", *PREDICTION)


register("score_batch", _score)

# A saved tariff with the mean loss of its fit.
TARIFF = R.PricingPolicy("scalar", "grid", 0.25, 0.95, 110000.0)
BUCKETED = R.PricingPolicy("stratified", "stratified_grid", 0.25, 0.95, 110000.0, [80000.0, 160000.0], [
    {"bucket_id": 0, "alpha": 0.1, "beta": 0.9, "mean_expected_loss": 110000.0}, {"bucket_id": 2, "alpha": 0.3, "beta": 1.05, "mean_expected_loss": 110000.0}],
    0.25, 0.95)


def _reprice(s, d):
    scored = S.scored_policies(s, d)
    saved = R.PricingPolicy.from_json(BUCKETED.to_json())
    out = K.reprice(scored, TARIFF).withColumnRenamed("new_premium", "scalar_price")
    out = K.reprice(out, TARIFF, alpha=0.5).withColumnRenamed("new_premium", "manual_price")
    out = K.reprice(out, saved).withColumnRenamed("new_premium", "bucket_price")
    prices = ["scalar_price", "manual_price", "bucket_price"]
    return rounded(out.select("contract_number", *prices), 3, *prices)


_own = "(SELECT avg(expected_loss) FROM scored WHERE expected_loss >= 80000 AND expected_loss < 160000)"
_bucket = lambda values: f"(CASE WHEN expected_loss >= 160000 THEN {values[2]} WHEN expected_loss >= 80000 THEN {values[1]} ELSE {values[0]} END)"
register("reprice_batch", _reprice, oracle("scored", f"""
SELECT contract_number, {sfx(scalar_price_sql('expected_loss', '110000.0::DOUBLE', '0.25', '0.95'), 3)} AS scalar_price,
  {sfx(scalar_price_sql('expected_loss', '110000.0::DOUBLE', '0.5', '0.95'), 3)} AS manual_price,
  {sfx(scalar_price_sql('expected_loss', _bucket(['110000.0::DOUBLE', _own, '110000.0::DOUBLE']), _bucket(['0.1', '0.25', '0.3']), _bucket(['0.9', '0.95', '1.05'])), 3)} AS bucket_price
FROM scored"""))


def _stream(s, d):
    """Half of the records is priced and the stream ends; the rest arrives, and a new stream resumes from the checkpoint."""
    place = f"{shared_folder(s)}/reprice-{uuid.uuid4().hex}"
    records = materialize(S.scored_policies(s, d).select("contract_number", "premium", "expected_loss"), "records")
    late = F.pmod(F.xxhash64("contract_number"), F.lit(2)) == 1
    for part in (records.where(~late), records.where(late)):
        part.write.mode("append").parquet(f"{place}/in")
        priced = T.reprice_stream(T.read_records(s, f"{place}/in", records.schema, 16), TARIFF)
        T.write_prices(priced, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return rounded(s.read.parquet(f"{place}/out").select("contract_number", "new_premium"), 3, "new_premium")


register("stream_reprice", _stream, oracle("scored", f"""
SELECT contract_number, {sfx(scalar_price_sql('expected_loss', '110000.0::DOUBLE', '0.25', '0.95'), 3)} AS new_premium FROM scored"""))
