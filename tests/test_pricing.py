"""Tariffs, their search and the portfolio diagnostics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffspark.operators import diagnostics as G
from tariffspark.operators import price_search as Z
from tariffspark.operators import pricing as R
from tariffspark.operators import retention_bounds as B
from tariffspark.operators import selection as C

SCHEMA = "contract_number long, premium double, premium_wo_term double, is_claim int, claim_amount double, expected_loss double"


def _brute(p, net, pay, el, alpha, beta, target=0.7, band=(0.69, 0.71), retention=None, lines=None):
    x = el / el.mean() if el.mean() > 0 else np.ones(len(el))
    new = np.clip(p * beta * (1 + alpha * (x - 1)), 0, 3 * p) if lines is None else lines(alpha, beta)
    share = np.where(p > 0, np.clip(net / np.where(p > 0, p, 1), 0, 1), 1.0)
    w = np.ones(len(p))
    if retention:
        change = np.where(p > 0, new / np.where(p > 0, p, 1) - 1, 0)
        w = np.clip(1 / (1 + np.exp(-(np.log(9) - retention.elasticity * change))), retention.floor, retention.cap)
    kept = new <= p
    ratio = lambda a, b: a / b if b > 0 else 0.0
    lr = ratio((pay * w).sum(), (new * share * w).sum())
    l1, l2 = (ratio((pay * w)[m].sum(), (new * share * w)[m].sum()) for m in (kept, ~kept))
    s1 = w[kept].sum() / w.sum()
    score = -abs(lr - target) - 0.7 * abs(l1 - target) - 0.7 * abs(l2 - target) + 0.15 * s1 + (0.5 if band[0] <= lr <= band[1] else 0)
    return lr, l1, l2, s1, score + (0.1 * w.mean() if retention else 0)


@pytest.fixture(scope="module")
def portfolio(spark):
    rng = np.random.default_rng(4)
    n = 400
    p = rng.uniform(50, 500, n)
    p[:6] = 0.0
    el = rng.gamma(1.0, 150.0, n)
    el[10:40] = 0.0
    net = p * rng.uniform(0.8, 1.1, n)
    pay = np.where(rng.random(n) < 0.2, rng.gamma(2.0, 500.0, n), 0.0)
    rows = [(i, float(p[i]), float(net[i]), int(pay[i] > 0), float(pay[i]), float(el[i])) for i in range(n)]
    return (p, net, pay, el), spark.createDataFrame(rows, SCHEMA).repartition(5)


ALPHAS, BETAS = [-0.6, -0.2, 0.0, 0.4, 1.0, 2.0], [0.0, 0.7, 1.0, 1.4, 3.5]


def test_grid_equals_brute_force(portfolio):
    arrays, df = portfolio
    for r in Z.grid_candidates(df, ALPHAS, BETAS).collect():
        expected = _brute(*arrays, r["alpha"], r["beta"])
        got = [r[c] for c in ("lr_total", "lr_group1", "lr_group2", "share_group1", "policy_score")]
        assert np.allclose(got, expected, rtol=0, atol=1e-9), (r["alpha"], r["beta"])


def test_retention_grid_equals_brute_force(portfolio):
    arrays, df = portfolio
    keep = R.Retention(enabled=True)
    for r in Z.grid_candidates(df, ALPHAS, [0.7, 1.0, 1.4], retention=keep).collect():
        expected = _brute(*arrays, r["alpha"], r["beta"], retention=keep)
        assert np.allclose([r[c] for c in ("lr_total", "lr_group1", "lr_group2", "share_group1", "policy_score")], expected, rtol=0, atol=1e-9)


def test_relative_loss_grid_equals_brute_force(portfolio):
    (p, net, pay, el), df = portfolio
    price = lambda a, b: p * np.clip(1 + a + b * el / np.clip(p, 1, None), 0.4, 3.0)
    for r in Z.grid_candidates(df, [-0.25, 0.0, 0.25], [0.0, 0.3, 1.2], kind="relative_loss").collect():
        expected = _brute(p, net, pay, el, r["alpha"], r["beta"], lines=price)
        assert np.allclose([r[c] for c in ("lr_total", "lr_group1", "lr_group2", "share_group1", "policy_score")], expected, rtol=0, atol=1e-9)


def test_grid_does_not_depend_on_the_partitioning(portfolio):
    _, df = portfolio
    one, seven = ({r["ordinal"]: r["policy_score"] for r in Z.grid_candidates(df.repartition(n), ALPHAS, BETAS).collect()} for n in (1, 7))
    assert all(one[k] == pytest.approx(seven[k], abs=1e-12) for k in one)


def test_price_stays_within_its_bounds(spark):
    df = spark.createDataFrame([(1, 100.0, 100.0, 0, 0.0, 10.0), (2, 200.0, 200.0, 0, 0.0, 300.0), (3, 300.0, 300.0, 0, 0.0, 20.0)], SCHEMA)
    assert all(0 <= r["new_premium"] <= 3 * r["premium"] for r in R.price_scalar(df, 2.0).collect())
    assert R.portfolio_kpis(R.price_scalar(df, 2.0)).first()["violations"] == 0
    bad = df.withColumn("new_premium", F.col("premium") * F.when(F.col("contract_number") == 1, -1).otherwise(4))
    assert R.portfolio_kpis(bad).first()["violations"] == 3


def test_zero_mean_loss_leaves_the_base_price(spark):
    df = spark.createDataFrame([(1, 100.0, 90.0, 0, 0.0, 0.0), (2, 50.0, 40.0, 0, 0.0, None)], SCHEMA)
    assert [r["new_premium"] for r in R.price_scalar(df, 1.5, 1.1).orderBy("contract_number").collect()] == pytest.approx([110.0, 55.0])


def test_first_best_point_prefers_the_band(spark):
    df = spark.createDataFrame([(i, 100.0, 100.0, 1, 70.0, 10.0) for i in range(4)], SCHEMA)
    best = Z.search_price(df, [0.0, 0.5], [0.8, 1.0, 1.2]).first()
    assert (best["alpha"], best["beta"], best["in_target"], best["share_group1"]) == (0.0, 1.0, 1, 1.0)


def test_empty_grids_are_refused(spark):
    df = spark.createDataFrame([(1, 100.0, 100.0, 0, 0.0, 1.0)], SCHEMA)
    with pytest.raises(ValueError):
        Z.search_price(df, [], [1.0])
    with pytest.raises(ValueError):
        Z.select_pricing(df, [0.0], method="magic")


def test_refinement_is_never_worse(portfolio):
    _, df = portfolio
    alphas, betas = [-0.5, 0.0, 0.5, 1.0], [0.6, 0.9, 1.2]
    grid = Z.search_price(df, alphas, betas).first()
    fine = Z.refine_price(df, alphas, betas, rounds=2, points=5).first()
    key = lambda r: (r["in_target"], r["policy_score"], r["share_group1"])
    assert key(fine) >= key(grid)
    assert -0.5 <= fine["alpha"] <= 1.0 and 0.6 <= fine["beta"] <= 1.2


@pytest.mark.parametrize("keep", [R.Retention(enabled=True), R.Retention(True, 0.8, -3.0, 0.1)])
def test_bounds_never_lose_the_best_point(portfolio, keep):
    _, df = portfolio
    alphas, betas = list(np.linspace(-0.6, 2.0, 14)), list(np.linspace(0.5, 1.8, 27))
    family, mean = Z.relative_risk_family(alphas, betas), float(Z._means(df, [F.col("expected_loss")])[0])
    every = {r["ordinal"]: r for r in Z.grid_candidates(df, alphas, betas, retention=keep).collect()}
    best = max(every.values(), key=lambda r: (r["in_target"], r["policy_score"], r["share_group1"], -r["ordinal"]))
    for cells in (3, 512):
        found = B.score_bounds(B.cell_table(df, F.col("expected_loss"), mean, cells), family, keep, 0.7, (0.69, 0.71))
        for g, r in every.items():
            assert found["least"][g] - 1e-9 <= r["policy_score"] <= found["most"][g] + 1e-9
            assert found["sure"][g] <= r["in_target"] <= found["possible"][g]
        left = B.contenders(df, family, F.col("expected_loss"), mean, keep, 0.7, (0.69, 0.71), cells)
        assert best["ordinal"] in left and (cells == 3 or len(left) < len(every) / 4)
    chosen = Z.search_price(df, alphas, betas, retention=keep).first()
    assert all(chosen[c] == pytest.approx(best[c], abs=1e-9) for c in best.asDict())


@pytest.mark.parametrize("name,columns", [("empty", {}), ("no premium", {"premium": "0.0D"}), ("no losses", {"expected_loss": "0.0D"}),
                                          ("nulls", {"expected_loss": "cast(null as double)", "claim_amount": "cast(null as double)"})])
def test_bounded_search_without_premiums_losses_or_rows(portfolio, name, columns):
    df = portfolio[1].withColumns({c: F.expr(e) for c, e in columns.items()}) if columns else portfolio[1].limit(0)
    keep = R.Retention(enabled=True)
    every = Z.grid_candidates(df, [0.0, 0.5], [0.8, 1.0], retention=keep)
    want, got = Z.best_candidate(every).first(), Z.search_price(df, [0.0, 0.5], [0.8, 1.0], retention=keep).first()
    assert got["ordinal"] == want["ordinal"] and got["policy_score"] == pytest.approx(want["policy_score"])


def test_retention_falls_with_the_price(spark):
    df = spark.createDataFrame([(100.0, v) for v in (80.0, 100.0, 120.0, 160.0)], "b double, n double")
    got = [r[0] for r in df.select(R.retention_probability(F.col("b"), F.col("n"), R.Retention(enabled=True))).collect()]
    assert got == sorted(got, reverse=True) and len(set(got)) == 4
    assert R.Retention(floor=0.9, cap=0.2).floor == 0.2


def test_stratified_search_is_monotone_serialises_and_reprices_equal(portfolio):
    _, df = portfolio
    policy = Z.search_stratified(df, [-0.2, 0.0, 0.3, 0.6], [0.7, 0.9, 1.1], config=Z.StratifiedSearch(3, 20, 2, True))
    assert Z.is_monotone(df, policy)
    again = R.PricingPolicy.from_json(policy.to_json())
    assert again == policy and again.summary()["bucket_count"] == len(policy.bucket_params)
    first, second = (sorted(r["new_premium"] for r in R.apply_policy(df, p).collect()) for p in (policy, again))
    assert first == second
    single = Z.search_price(df, [-0.2, 0.0, 0.3, 0.6], [0.7, 0.9, 1.1]).first()
    kpis = R.portfolio_kpis(R.apply_policy(df, policy)).first()
    assert (kpis["in_target"], kpis["policy_score"]) >= (single["in_target"], single["policy_score"] - 1e-9)


def test_too_few_rows_fall_back_to_one_tariff(spark):
    df = spark.createDataFrame([(i, 100.0 + i, 90.0, 0, 60.0, 10.0 * i) for i in range(5)], SCHEMA)
    policy = Z.search_stratified(df, [0.0, 0.2], [0.9, 1.0], config=Z.StratifiedSearch(3, 50))
    assert (policy.kind, policy.method) == ("scalar", "stratified_grid_fallback")


def test_methods_report_kpis(portfolio):
    _, df = portfolio
    for method in ("grid", "refine", "stratified_grid"):
        policy, kpis = Z.select_pricing(df, [0.0, 0.4], [0.8, 1.0], method=method, stratified=Z.StratifiedSearch(3, 20))
        assert kpis.count() == 1 and policy.kind in ("scalar", "stratified")


def test_stratified_search_and_blends_use_the_retention(portfolio):
    _, df = portfolio
    alphas, betas, keep, cfg = [-0.2, 0.0, 0.3, 0.6], [0.7, 0.9, 1.1], R.Retention(enabled=True, elasticity=8.0), Z.StratifiedSearch(3, 20, 2, False)
    score = lambda policy: R.portfolio_kpis(R.apply_policy(df, policy), retention=keep).first()
    key = lambda r: (r["in_target"], r["policy_score"])
    found = score(Z.select_pricing(df, alphas, betas, method="stratified_grid", retention=keep, stratified=cfg)[0])
    assert key(found) >= key(Z.search_price(df, alphas, betas, retention=keep).first())
    assert key(found) > key(score(Z.search_stratified(df, alphas, betas, config=cfg)))
    two = df.withColumns({"a": F.col("expected_loss"), "b": F.col("premium") * 0.5})
    for method in ("grid", "refine", "stratified_grid"):
        rows = Z.blend_weight_search(two, ["a", "b"], alphas, betas, 0.5, method=method, retention=keep, stratified=cfg).orderBy("variant").collect()
        for r in rows:
            mixed = two.withColumn("mix", F.col("a") * r["w_a"] + F.col("b") * r["w_b"])
            own = Z.select_pricing(mixed, alphas, betas, method=method, retention=keep, stratified=cfg, loss="mix")
            assert (r["alpha"], r["beta"]) == pytest.approx((own[0].alpha, own[0].beta)) and r["policy_score"] == pytest.approx(own[1].first()["policy_score"])
        assert len(rows) == 3 and sum(r["chosen"] for r in rows) == 1


def test_simplex_weights():
    assert Z.simplex_weights(3, 0.1).shape == (66, 3)
    assert np.allclose(Z.simplex_weights(3, 0.1).sum(axis=1), 1.0)
    assert Z.simplex_weights(1, 0.1).tolist() == [[1.0]]


def test_target_band():
    assert R.target_band(0.7) == pytest.approx((0.69, 0.71))
    assert R.target_band(0.7, (0.8, 0.6)) == (0.6, 0.8)


def test_deciles_equal_the_rank_rule(portfolio):
    (_, _, _, el), df = portfolio
    n = len(el)
    place = {int(i): r for r, i in enumerate(sorted(range(n), key=lambda i: (el[i], i)))}
    for q in (3, 10):
        for r in G.with_deciles(df, "expected_loss", "d", q).collect():
            assert r["d"] == max(1, -(-place[r["contract_number"]] * q // (n - 1)))


def test_deciles_of_constant_and_missing_values(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, None), (3, 5.0, None)], "contract_number long, same double, none double")
    assert {r["d"] for r in G.with_deciles(df, "same", "d").collect()} == {1}
    assert {r["d"] for r in G.with_deciles(df, "none", "d").collect()} == {1}


RESULTS = "ordinal int, candidate string, status string, passes_constraints int, policy_score double, gini double"


def test_winner_rules(spark):
    def winner(rows, **kw):
        return tuple(C.select_winner(spark.createDataFrame(rows, RESULTS), **kw).first())

    rows = [(0, "a", "ok", 1, 0.5, 0.2), (1, "b", "ok", 1, 0.5, 0.3), (2, "c", "ok", 0, 0.9, 0.9), (3, "d", "failed", 1, 2.0, 0.9)]
    assert winner(rows) == ("b", "best_compliant_candidate")
    none = [(0, "a", "ok", 0, 0.5, 0.2), (1, "b", "ok", 0, 0.7, 0.1)]
    assert winner(none) == ("b", "best_available_no_compliant_candidates")
    assert winner(none, fallback="configured_candidate", fallback_candidate="a") == ("a", "fallback_no_compliant_candidates")
    with pytest.raises(Exception, match="no compliant candidate"):
        winner(none, must_pass=True)
    with pytest.raises(Exception, match="no usable candidate"):
        winner([(0, "a", "failed", 0, None, None)])


def test_constraints_name_what_is_broken(spark):
    df = spark.createDataFrame([(1, 0.5, 0.4), (0, 0.7, 0.5)], "violations int, lr_total double, share_group1 double")
    assert [r["reasons"] for r in C.check_constraints(df).collect()] == ["violations>0|lr_total<0.69", ""]
