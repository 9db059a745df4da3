"""Registered queries: applying tariffs and searching them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tariffspark.operators import price_search as Z
from tariffspark.operators import pricing as R
from tariffspark.plans.common import kpi_select_sql, oracle, rounded, scalar_price_sql, sfx
from tariffspark.session import materialize
from tariffspark.sources import portfolio as S

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


KPIS = ["lr_total", "lr_group1", "lr_group2", "share_group1", "distance_to_target", "policy_score"]
KPI_COLUMNS = ", ".join([f"{sfx(c)} AS {c}" for c in KPIS] + ["in_target", "violations"])
PRICING_COLUMNS = ["contract_number", "premium", "premium_wo_term", "is_claim", "claim_amount", "expected_loss"]

# -- applying a tariff --------------------------------------------------------------------

register("price_scalar", lambda s, d: rounded(S.priced_policies(s, d).select("contract_number", "new_premium", "price_delta_pct"), 3,
                                              "new_premium", price_delta_pct=7),
         oracle("priced", f"SELECT contract_number, {sfx('new_premium', 3)} AS new_premium, {sfx('price_delta_pct', 7)} AS price_delta_pct FROM priced"))
register("pricing_kpis", lambda s, d: rounded(R.portfolio_kpis(S.priced_policies(s, d)), 9, *KPIS),
         oracle("priced", f"SELECT {KPI_COLUMNS} FROM ({kpi_select_sql('priced')})"))

RETENTION = R.Retention(enabled=True)


def retention_sql(new="new_premium", base="premium"):
    logit = f"least(greatest(ln(0.9::DOUBLE / 0.1::DOUBLE) - 4.0::DOUBLE * (CASE WHEN {base} > 0 THEN {new} / {base} - 1.0::DOUBLE ELSE 0 END), -35), 35)"
    return f"least(greatest(1.0::DOUBLE / (1.0::DOUBLE + exp(-({logit}))), 0.05::DOUBLE), 0.995::DOUBLE)"


def _retained(s, d):
    p = R.retention_probability(F.col("premium"), F.col("new_premium"), RETENTION)
    return rounded(S.priced_policies(s, d).select("contract_number", p.alias("retention")), 8, "retention")


register("retention_prob", _retained, oracle("priced", f"SELECT contract_number, {sfx(retention_sql(), 8)} AS retention FROM priced"))
register("pricing_kpis_retention", lambda s, d: rounded(R.portfolio_kpis(S.priced_policies(s, d), retention=RETENTION), 8, *KPIS, "retention_rate"),
         oracle("priced", "SELECT " + ", ".join(f"{sfx(c, 8)} AS {c}" for c in [*KPIS, "retention_rate"]) + ", in_target, violations FROM ("
                + kpi_select_sql("priced", weight=retention_sql(), retention=True) + ")"))

EDGES_5 = [60000.0, 110000.0, 160000.0, 220000.0]
register("price_buckets", lambda s, d: S.scored_policies(s, d).select("contract_number", R.risk_bucket(EDGES_5).alias("bucket")), oracle(
    "scored", "SELECT contract_number, (" + " + ".join(f"(expected_loss >= {e!r}::DOUBLE)::INTEGER" for e in EDGES_5) + ") AS bucket FROM scored"))

BUCKETS = 3
_q = [float(q) for q in np.linspace(0, 1, BUCKETS + 1)[1:-1]]
EDGES = f"edg AS (SELECT list_sort(list_distinct(quantile_cont(expected_loss, [{', '.join(f'{q!r}::DOUBLE' for q in _q)}]))) AS e FROM scored)"
BUCKETED = "bucketed AS (SELECT *, len(list_filter((SELECT e FROM edg), lambda t: t <= expected_loss))::INTEGER AS risk_bucket FROM scored)"
ALPHA = {0: 0.10, 1: 0.15, 2: 0.2}
BETA = {0: 0.92, 1: 0.94, 2: 0.96}


def _stratified(s, d):
    scored = materialize(S.scored_policies(s, d).select(*PRICING_COLUMNS), "scored")
    return scored, Z.stratified_policy(scored, Z.stratified_edges(scored, BUCKETS, 50), ALPHA, BETA, (0.3, 1.0))


def _edges(s, d):
    scored = S.scored_policies(s, d).select("expected_loss")
    found = Z.stratified_edges(materialize(scored, "edges"), BUCKETS, 50)
    return rounded(s.createDataFrame([(i, e) for i, e in enumerate(found)], "edge int, value double"), 4, "value")


register("stratified_edges", _edges, oracle("scored", f"""
SELECT (i - 1)::INTEGER AS edge, {sfx('e[i]', 4)} AS value FROM edg, (SELECT unnest(range(1, len(e) + 1)) AS i FROM edg)""", EDGES))


def _policy_table(s, d):
    policy = _stratified(s, d)[1]
    return rounded(s.createDataFrame(policy.bucket_params, "bucket_id int, alpha double, beta double, mean_expected_loss double, "
                                     "bucket_expected_loss_mean double, count bigint"), 4, "mean_expected_loss", "bucket_expected_loss_mean")


_case = lambda values: "CASE risk_bucket " + " ".join(f"WHEN {b} THEN {v!r}::DOUBLE" for b, v in values.items()) + " END"
register("stratified_policy", _policy_table, oracle("scored", f"""
SELECT risk_bucket AS bucket_id, {_case(ALPHA)} AS alpha, {_case(BETA)} AS beta, {sfx('(SELECT avg(expected_loss) FROM scored)', 4)} AS mean_expected_loss,
  {sfx('avg(expected_loss)', 4)} AS bucket_expected_loss_mean, count(*) AS count FROM bucketed GROUP BY risk_bucket""", EDGES, BUCKETED))
STRAT = f"strat AS (SELECT *, {scalar_price_sql('expected_loss', '(SELECT avg(expected_loss) FROM scored)', f'({_case(ALPHA)})', f'({_case(BETA)})')} AS new_premium FROM bucketed)"


def _price_stratified(s, d):
    scored, policy = _stratified(s, d)
    return rounded(R.price_stratified(scored, policy).select("contract_number", "risk_bucket", "new_premium"), 3, "new_premium")


register("price_stratified", _price_stratified, oracle("scored", f"SELECT contract_number, risk_bucket, {sfx('new_premium', 3)} AS new_premium FROM strat", EDGES, BUCKETED, STRAT))
register("stratified_monotone", lambda s, d: rounded(Z.bucket_multipliers(*_stratified(s, d)), 8, "mean_multiplier"), oracle("scored", f"""
SELECT risk_bucket, n, {sfx('m', 8)} AS mean_multiplier, coalesce((m - lag(m) OVER (ORDER BY risk_bucket) >= -1e-9)::INTEGER, 1) AS increasing
FROM (SELECT risk_bucket, count(*) AS n, avg(CASE WHEN premium > 0 THEN new_premium / premium ELSE 0 END) AS m FROM strat GROUP BY risk_bucket)""", EDGES, BUCKETED, STRAT))

# -- searching a tariff ------------------------------------------------------------------------
# The default search grid, 80 x 80 points.
DEFAULT_ALPHA = [float(a) for a in np.linspace(-0.6, 2.0, 80)]
DEFAULT_BETA = [float(b) for b in np.linspace(0.8, 1.8, 80)]
MEAN = "(SELECT avg(expected_loss) FROM scored)"


def doubles(values):
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def grid_cte(alphas, betas, name="grid"):
    return f"""{name} AS (SELECT (bi * {len(alphas)} + ai)::BIGINT AS ordinal, ({doubles(alphas)})[ai + 1] AS alpha, ({doubles(betas)})[bi + 1] AS beta
FROM range({len(betas)}) tb(bi), range({len(alphas)}) ta(ai))"""


def grid_ctes(alphas, betas, grid="grid", out="gridkpi", price=None):
    """The grid, and the KPIs of every point by pricing every policy with it."""
    new = price or scalar_price_sql("expected_loss", MEAN, "alpha", "beta")
    source = f"(SELECT premium, premium_wo_term, claim_amount, ordinal, alpha, beta, {new} AS new_premium FROM scored, {grid})"
    first = [grid_cte(alphas, betas, grid)] if alphas is not None else []
    return [*first, f"{out} AS MATERIALIZED (SELECT * FROM ({kpi_select_sql(source, by='ordinal, alpha, beta')}))"]


def best_sql(source="gridkpi", order="in_target DESC, policy_score DESC, share_group1 DESC, ordinal"):
    return f"SELECT ordinal, alpha, beta, {KPI_COLUMNS.replace('violations', 'violations::DOUBLE AS violations')} FROM {source} ORDER BY {order} LIMIT 1"


def _search(s, d, alphas, betas, **kw):
    scored = materialize(S.scored_policies(s, d).select(*PRICING_COLUMNS), "scored")
    return rounded(Z.search_price(scored, alphas, betas, **kw), 9, *KPIS)


register("price_grid_search", lambda s, d: _search(s, d, DEFAULT_ALPHA, DEFAULT_BETA),
         oracle("scored", best_sql(), *grid_ctes(DEFAULT_ALPHA, DEFAULT_BETA)))
V_ALPHA, V_BETA = [float(a) for a in np.linspace(-0.5, 1.5, 21)], [float(b) for b in np.linspace(0.75, 1.25, 26)]
register("price_grid_violation_first", lambda s, d: _search(s, d, V_ALPHA, V_BETA, key="violation_first"), oracle(
    "scored", best_sql(order="(violations = 0) DESC, in_target DESC, policy_score DESC, share_group1 DESC, ordinal"), *grid_ctes(V_ALPHA, V_BETA)))
# The grid of the relative-loss tariff, 81 x 61 points.
L_ALPHA, L_BETA = [float(a) for a in np.linspace(-0.25, 0.25, 81)], [float(b) for b in np.linspace(0.0, 1.2, 61)]
_relative = "greatest(premium, 0) * least(greatest(1.0::DOUBLE + alpha + beta * expected_loss / greatest(premium, 1), 0.4::DOUBLE), 3.0::DOUBLE)"
register("price_relative_loss", lambda s, d: _search(s, d, L_ALPHA, L_BETA, kind="relative_loss", key="distance_first"), oracle(
    "scored", best_sql(order="(violations = 0) DESC, in_target DESC, distance_to_target, policy_score DESC, ordinal"), *grid_ctes(L_ALPHA, L_BETA, price=_relative)))
R_ALPHA, R_BETA = DEFAULT_ALPHA, DEFAULT_BETA


def _retention_search(s, d):
    scored = materialize(S.scored_policies(s, d).select(*PRICING_COLUMNS), "scored")
    grid = Z.grid_candidates(scored, R_ALPHA, R_BETA, retention=RETENTION)
    return rounded(grid, 8, *KPIS, "retention_rate")


register("price_grid_retention", _retention_search, oracle("scored", "SELECT ordinal, alpha, beta, " + ", ".join(
    f"{sfx(c, 8)} AS {c}" for c in [*KPIS, "retention_rate"]) + ", in_target, violations::DOUBLE AS violations FROM (" + kpi_select_sql(
    f"(SELECT premium, premium_wo_term, claim_amount, ordinal, alpha, beta, {scalar_price_sql('expected_loss', MEAN, 'alpha', 'beta')} AS new_premium FROM scored, grid)",
    by="ordinal, alpha, beta", weight=retention_sql(), retention=True) + ")", grid_cte(R_ALPHA, R_BETA)))

RETAINED = f"""gridkpi AS MATERIALIZED (SELECT * FROM ({kpi_select_sql(
    f"(SELECT premium, premium_wo_term, claim_amount, ordinal, alpha, beta, {scalar_price_sql('expected_loss', MEAN, 'alpha', 'beta')} AS new_premium FROM scored, grid)",
    by="ordinal, alpha, beta", weight=retention_sql(), retention=True)}))"""


def _retention_best(s, d):
    scored = materialize(S.scored_policies(s, d).select(*PRICING_COLUMNS), "scored")
    return rounded(Z.search_price(scored, R_ALPHA, R_BETA, retention=RETENTION), 8, *KPIS, "retention_rate")


register("price_retention_search", _retention_best, oracle("scored", "SELECT ordinal, alpha, beta, " + ", ".join(
    f"{sfx(c, 8)} AS {c}" for c in [*KPIS, "retention_rate"]) + ", in_target, violations::DOUBLE AS violations FROM gridkpi "
    "ORDER BY in_target DESC, policy_score DESC, share_group1 DESC, ordinal LIMIT 1", grid_cte(R_ALPHA, R_BETA), RETAINED))

# Local refinement: two rounds of five points per axis around the grid optimum.
F_ALPHA, F_BETA = [float(a) for a in np.linspace(-0.4, 1.2, 9)], [float(b) for b in np.linspace(0.8, 1.2, 9)]


def _refine(s, d):
    scored = materialize(S.scored_policies(s, d).select(*PRICING_COLUMNS), "scored")
    return rounded(Z.refine_price(scored, F_ALPHA, F_BETA, rounds=2, points=5).drop("violations"), 7, "alpha", "beta", *KPIS)


def _refine_ctes():
    order = "in_target DESC, policy_score DESC, share_group1 DESC, ordinal"
    ctes = [*grid_ctes(F_ALPHA, F_BETA, "grid0", "kpi0"), f"best0 AS (SELECT *, 0 AS step FROM kpi0 ORDER BY {order} LIMIT 1)"]
    reach = [(max(g) - min(g)) / (len(g) - 1) for g in (F_ALPHA, F_BETA)]
    for i in (1, 2):
        axis = lambda name, r, g: (f"least(greatest({name} - {r!r}::DOUBLE + 2.0::DOUBLE * {r!r}::DOUBLE * {name[0]}i / 4.0::DOUBLE, "  # noqa: E731
                                   f"{min(g)!r}::DOUBLE), {max(g)!r}::DOUBLE)")
        ctes.append(f"""grid{i} AS (SELECT (bi * 5 + ai)::BIGINT AS ordinal, {axis('alpha', reach[0], F_ALPHA)} AS alpha, {axis('beta', reach[1], F_BETA)} AS beta
FROM best{i - 1}, range(5) tb(bi), range(5) ta(ai))""")
        ctes += grid_ctes(None, None, f"grid{i}", f"kpi{i}")
        ctes.append(f"""best{i} AS (SELECT * FROM (SELECT * FROM best{i - 1} UNION ALL (SELECT *, {i} AS step FROM kpi{i} ORDER BY {order} LIMIT 1))
ORDER BY in_target DESC, policy_score DESC, share_group1 DESC, step LIMIT 1)""")
        reach = [r * 2.0 / 4.0 for r in reach]
    return ctes


register("price_refine", _refine, oracle("scored", f"""
SELECT {sfx('alpha', 7)} AS alpha, {sfx('beta', 7)} AS beta, {', '.join(f'{sfx(c, 7)} AS {c}' for c in KPIS)}, in_target FROM best2""", *_refine_ctes()))

# -- one tariff per bucket -------------------------------------------------------------------------
B_ALPHA, B_BETA, PASSES = [0.0, 0.1, 0.2, 0.3, 0.4], [0.88, 0.92, 0.96, 1.0, 1.04], 2


def _stratified_search(s, d, retention=None):
    scored = materialize(S.scored_policies(s, d).select(*PRICING_COLUMNS), "scored")
    policy = Z.search_stratified(scored, B_ALPHA, B_BETA, config=Z.StratifiedSearch(BUCKETS, 50, PASSES, True), retention=retention)
    params = policy.bucket_params or [{"bucket_id": -1, "alpha": policy.alpha, "beta": policy.beta}]
    rows = [(policy.kind, p["bucket_id"], p["alpha"], p["beta"]) for p in params]
    return s.createDataFrame(rows, "kind string, bucket_id int, alpha double, beta double")


def _search_ctes(weight="1.0::DOUBLE", reward=""):
    """Coordinate search written out: one step per bucket over the sums of (bucket, grid point), policies weighted by ``weight``."""
    new = scalar_price_sql("expected_loss", MEAN, "alpha", "beta")
    share = "(CASE WHEN premium > 0 THEN least(greatest(premium_wo_term / premium, 0.0::DOUBLE), 1.0::DOUBLE) ELSE 1.0::DOUBLE END)"
    sums = ["po", "ne", "po1", "ne1", "po2", "ne2", "n", "n1", "cnt"]
    ctes = [EDGES, BUCKETED, grid_cte(B_ALPHA, B_BETA), f"""st AS MATERIALIZED (SELECT risk_bucket AS b, ordinal AS g, sum(pay) AS po, sum(net) AS ne,
  coalesce(sum(pay) FILTER (WHERE k), 0) AS po1, coalesce(sum(net) FILTER (WHERE k), 0) AS ne1, coalesce(sum(pay) FILTER (WHERE NOT k), 0) AS po2,
  coalesce(sum(net) FILTER (WHERE NOT k), 0) AS ne2, sum(w) AS n, coalesce(sum(w) FILTER (WHERE k), 0) AS n1, count(*)::DOUBLE AS cnt, avg(np / premium) AS mm
FROM (SELECT *, np * {share} * w AS net, claim_amount * w AS pay, np <= premium AS k FROM (SELECT *, {weight} AS w FROM (SELECT *, {new} AS np FROM bucketed, grid))) GROUP BY 1, 2)"""]

    def keyed(source, head):
        r = lambda a, c: f"(CASE WHEN {c} > 0 THEN {a} / {c} ELSE 0 END)"
        t, one, two, sh = r("po", "ne"), r("po1", "ne1"), r("po2", "ne2"), r("n1", "n")
        band = f"({t} BETWEEN 0.69::DOUBLE AND 0.71::DOUBLE)::INTEGER"
        return (f"SELECT {head}, {band} AS k1, -abs({t} - 0.7::DOUBLE) - 0.7::DOUBLE * abs({one} - 0.7::DOUBLE) - 0.7::DOUBLE * abs({two} - 0.7::DOUBLE) "
                f"+ 0.15::DOUBLE * {sh} + 0.5::DOUBLE * {band}{reward} AS k2, {sh} AS k3 FROM {source}")

    total = ", ".join(f"sum({c}) AS {c}" for c in sums)
    ctes.append(f"start AS (SELECT g AS g0, g AS g1, g AS g2, k1, k2, k3 FROM ({keyed(f'(SELECT g, {total} FROM st GROUP BY g)', 'g')}) ORDER BY k1 DESC, k2 DESC, k3 DESC, g LIMIT 1)")
    last = "start"
    for step in range(PASSES * BUCKETS):
        b = step % BUCKETS
        picks = ", ".join((f"x.g AS g{o}" if o == b else f"c.g{o}") for o in range(BUCKETS))
        add = ", ".join(f"x.{c} + " + " + ".join(f"s{o}.{c}" for o in range(BUCKETS) if o != b) + f" AS {c}" for c in sums)
        mean = {o: "x.mm" if o == b else f"s{o}.mm" for o in range(BUCKETS)}
        joins = " ".join(f"JOIN st s{o} ON s{o}.b = {o} AND s{o}.g = c.g{o}" for o in range(BUCKETS) if o != b)
        mono = " AND ".join(f"{mean[o + 1]} - {mean[o]} >= -1e-9" for o in range(BUCKETS - 1))
        rows = f"(SELECT {picks}, x.g AS pick, {add} FROM {last} c JOIN st x ON x.b = {b} {joins} WHERE {mono})"
        ctes.append(f"""step{step} AS MATERIALIZED (SELECT g0, g1, g2, k1, k2, k3 FROM (SELECT *, -1 AS pick FROM {last} UNION ALL BY NAME SELECT * FROM ({keyed(rows, 'g0, g1, g2, pick')}))
ORDER BY k1 DESC, k2 DESC, k3 DESC, pick LIMIT 1)""")
        last = f"step{step}"
    means = [f"(SELECT mm FROM st WHERE b = {o} AND g = (SELECT g0 FROM start))" for o in range(BUCKETS)]
    ctes.append(f"usable AS (SELECT {' AND '.join(f'{means[o + 1]} - {means[o]} >= -1e-9' for o in range(BUCKETS - 1))} AS ok)")
    return ctes


_FOUND = "\nUNION ALL ".join(
    f"SELECT 'stratified' AS kind, {b}::INTEGER AS bucket_id, alpha, beta FROM step{PASSES * BUCKETS - 1} JOIN grid ON ordinal = g{b} WHERE (SELECT ok FROM usable)"
    for b in range(BUCKETS)) + "\nUNION ALL SELECT 'scalar', -1, alpha, beta FROM start JOIN grid ON ordinal = g0 WHERE NOT (SELECT ok FROM usable)"
register("price_stratified_search", _stratified_search, oracle("scored", _FOUND, *_search_ctes()))
register("price_stratified_retention", lambda s, d: _stratified_search(s, d, RETENTION),
         oracle("scored", _FOUND, *_search_ctes(retention_sql("np"), " + 0.1::DOUBLE * n / cnt")))

# -- blends --------------------------------------------------------------------------------------------
W_ALPHA, W_BETA, STEP = [0.0, 0.2, 0.4, 0.6, 0.8], [0.86, 0.9, 0.94, 0.98, 1.02], 0.25
LOSSES = ["loss_a", "loss_b", "loss_c"]


def _with_losses(df):
    """Three different expected losses per policy, standing for three fitted models."""
    return df.withColumns({
        "loss_a": F.col("expected_loss"),
        "loss_b": F.lit(0.1) * F.col("expected_severity") + F.lit(0.25) * F.col("expected_loss"),
        "loss_c": F.lit(1500.0) * F.col("SCORE_1_1") + F.lit(0.3) * F.col("premium"),
    })


def _blend(s, d, retention=None):
    scored = _with_losses(S.scored_policies(s, d)).select("contract_number", "premium", "premium_wo_term", "claim_amount", *LOSSES)
    out = Z.blend_weight_search(materialize(scored, "losses"), LOSSES, W_ALPHA, W_BETA, STEP, limits={"share_group1_max": 0.9}, retention=retention)
    return rounded(out.drop("ordinal", "violations", "clean"), 8, *KPIS, *(["retention_rate"] if retention else []))


_mixes = Z.simplex_weights(3, STEP)


def _blend_ctes(weight="1.0::DOUBLE", retention=False):
    return [
        """losses AS (SELECT *, expected_loss AS loss_a, 0.1::DOUBLE * expected_severity + 0.25::DOUBLE * expected_loss AS loss_b,
  1500.0::DOUBLE * SCORE_1_1 + 0.3::DOUBLE * premium AS loss_c FROM scored)""",
        "mixes AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(f'{float(w)!r}::DOUBLE' for w in m)})" for i, m in enumerate(_mixes)) + ") t(variant, wa, wb, wc))",
        "mixed AS (SELECT premium, premium_wo_term, claim_amount, variant, wa * loss_a + wb * loss_b + wc * loss_c AS el FROM losses, mixes)",
        "mixmean AS (SELECT variant, avg(el) AS m FROM mixed GROUP BY variant)",
        grid_cte(W_ALPHA, W_BETA),
        "mixkpi AS MATERIALIZED (SELECT * FROM (" + kpi_select_sql(
            f"(SELECT premium, premium_wo_term, claim_amount, variant, ordinal, alpha, beta, {scalar_price_sql('el', 'm', 'alpha', 'beta')} AS new_premium FROM mixed JOIN mixmean USING (variant), grid)",
            by="variant, ordinal, alpha, beta", weight=weight, retention=retention) + "))",
        """mixbest AS (SELECT *, (violations = 0 AND lr_total >= 0.69 AND lr_total <= 0.71 AND share_group1 >= 0 AND share_group1 <= 0.9)::INTEGER AS passes FROM mixkpi
QUALIFY row_number() OVER (PARTITION BY variant ORDER BY in_target DESC, policy_score DESC, share_group1 DESC, ordinal) = 1)""",
    ]


def _blend_sql(kpis, **kw):
    return oracle("scored", f"""
SELECT variant::INTEGER AS variant, wa AS w_loss_a, wb AS w_loss_b, wc AS w_loss_c, alpha, beta, {', '.join(f'{sfx(c, 8)} AS {c}' for c in kpis)}, in_target, passes,
  (row_number() OVER (ORDER BY passes DESC, policy_score DESC, variant) = 1)::INTEGER AS chosen FROM mixbest JOIN mixes USING (variant)""", *_blend_ctes(**kw))


register("blend_weight_search", _blend, _blend_sql(KPIS))
register("blend_weight_retention", lambda s, d: _blend(s, d, RETENTION), _blend_sql([*KPIS, "retention_rate"], weight=retention_sql(), retention=True))
