"""Histogram boosting against a plain tree over rows, its invariances and contributions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffspark.models import boosting as G
from tariffspark.operators.diagnostics import tree_contribution_rank


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(200):
        a, b, c = rng.normal(), float(rng.integers(0, 6)), ["x", "y", "z", None][i % 4]
        p = 1 / (1 + math.exp(-(1.5 * a - 0.5 * b + (c == "x"))))
        claim = int(rng.random() < p)
        rows.append((f"k{i}", None if i % 17 == 0 else float(a), b, c, claim, float(claim * math.exp(1 + a)), i % 3))
    return spark.createDataFrame(rows, "key string, a double, b double, c string, claim int, amount double, fold int")


def blocks_of(df, bins=16):
    binning = G.fit_binning(df, ["a", "b"], ["c"], F.col("claim"), bins)
    return G.pack_blocks(df, binning, {"y": F.col("claim"), "amount": F.col("amount"), "log": F.log1p("amount")}, F.col("claim"), F.col("key"), F.col("fold"))


def plain_boost(bins, y, p, trees):
    """Boosting by the textbook: every split of every node tried on the rows themselves."""
    mean = y.mean()
    start = math.log(mean / (1 - mean)) if p.loss == "logistic" else math.log(mean) if p.loss == "tweedie" else mean
    margin = np.full(len(y), start)
    for _ in range(trees):
        if p.loss == "logistic":
            q = 1 / (1 + np.exp(-margin))
            g, h = q - y, q * (1 - q)
        elif p.loss == "tweedie":
            g = np.exp((2 - p.power) * margin) - y * np.exp((1 - p.power) * margin)
            h = (2 - p.power) * np.exp((2 - p.power) * margin) - (1 - p.power) * y * np.exp((1 - p.power) * margin)
        else:
            g, h = margin - y, np.ones(len(y))
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + p.leaf_penalty)

        def build(rows, depth):
            best = None
            if depth < p.depth:
                for missing_left in (True, False):
                    for c in range(bins.shape[1]):
                        for cut in range(0 if missing_left else 1, bins.max() + 1):
                            b = bins[rows, c]
                            left = np.where(b == 0, missing_left, b <= cut)
                            lo, hi = rows[left], rows[~left]
                            if len(lo) and len(hi) and min(h[lo].sum(), h[hi].sum()) >= p.least_child_weight:
                                gain = 0.5 * (score(lo) + score(hi) - score(rows)) - p.split_penalty
                                if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                                    best = (gain, lo, hi)
            if best is None:
                margin[rows] += -p.learning_rate * g[rows].sum() / (h[rows].sum() + p.leaf_penalty)
            else:
                build(best[1], depth + 1)
                build(best[2], depth + 1)

        build(np.arange(len(y)), 0)
    return margin


@pytest.mark.parametrize("loss,target", [("logistic", "y"), ("squared", "log"), ("tweedie", "amount")])
def test_equals_a_plain_tree_on_the_rows(table, loss, target):
    blocks = blocks_of(table)
    params = G.BoostParams(loss, trees=3, depth=3, learning_rate=0.3, subsample=1.0, leaf_penalty=0.7, split_penalty=0.05, least_child_weight=2.0)
    task = G.Task(params, target)
    G.grow(blocks, [task])
    parts = blocks.rdd.collect()
    bins, y = np.concatenate([p[0] for p in parts]).astype(int), np.concatenate([p[1][target] for p in parts])
    assert task.margins(bins) == pytest.approx(plain_boost(bins, y, params, 3), abs=1e-5)


def test_models_grown_together_are_those_grown_alone_whatever_the_cut(table):
    params = G.BoostParams("logistic", trees=25, depth=3, subsample=0.7, column_share=0.7, seed=5)
    make = lambda: [G.Task(params, "y"), G.Task(params, "y", hold_out=1), G.Task(G.BoostParams("squared", trees=8, depth=4), "log", claims_only=True)]
    together, alone = make(), make()
    G.grow(blocks_of(table.repartition(1)), together)
    other = blocks_of(table.repartition(7))
    for t in alone:
        G.grow(other, [t])
    assert [t.trees for t in together] == [t.trees for t in alone] and [len(t.trees) for t in together] == [25, 25, 8]
    step = make()
    G.grow(other, step, [10, 3, 0])
    G.grow(other, step)
    assert [t.trees for t in step] == [t.trees for t in together]
    used = {c for t in together[0].trees for c in t.column if c >= 0}
    assert used == {0, 1, 2} and any(len({c for c in t.column if c >= 0}) < 3 for t in together[0].trees)
    assert together[1].rows == sum(i % 3 != 1 for i in range(200))


def test_model_predicts_saves_and_explains(spark, table, tmp_path):
    blocks = blocks_of(table)
    task = G.Task(G.BoostParams("logistic", trees=12, depth=4, subsample=0.8), "y")
    G.grow(blocks, [task])
    model = G.BoostedModel.of(task, blocks.binning)
    model.save(spark, str(tmp_path / "m"))
    again = G.BoostedModel.load(spark, str(tmp_path / "m"))
    assert again.binning == model.binning and again.start == model.start
    odd = table.unionByName(spark.createDataFrame([("new", None, None, "never seen", 0, 0.0, 0)], table.schema))
    rows = again.contributions(odd.withColumn("m", model.margin()).withColumn("again", again.margin())).collect()
    for r in rows:
        assert r["m"] == r["again"] and r["base"] + sum(r["contribution"]) == pytest.approx(r["m"], abs=1e-9)
    ranked = tree_contribution_rank(odd, again).collect()
    want = dict(zip(again.binning.columns, np.abs([r["contribution"] for r in rows]).mean(axis=0)))
    assert {r["feature"]: r["mean_abs_contribution"] for r in ranked} == pytest.approx(want) and [r["rank"] for r in ranked] == [1, 2, 3]
    assert ranked[-1]["cumulative_share"] == pytest.approx(1.0)
    loss = lambda margins: sum(math.log1p(math.exp(-m if r["claim"] else m)) for m, r in zip(margins, rows))
    assert loss([r["m"] for r in rows]) < 0.8 * loss([model.start] * len(rows))


def test_nothing_to_learn_from(spark, table):
    blocks = blocks_of(table.limit(0))
    task = G.Task(G.BoostParams(trees=2), "y")
    G.grow(blocks, [task])
    assert task.trees == [] and task.rows == 0
    flat = blocks_of(table.withColumn("claim", F.lit(0)))
    G.grow(flat, [task := G.Task(G.BoostParams(trees=2, subsample=1.0), "y")])
    assert all(c == -1 for t in task.trees for c in t.column)
