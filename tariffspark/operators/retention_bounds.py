"""Which points of a tariff grid can still be the best when policies are weighted by their retention.

A price factor is a straight line in the relative risk x, clipped, and the
retention falls with the factor; so between the smallest and the largest x of a
cell both are bounded by their values at the two ends.  A table of sums per cell
of x then bounds every KPI of every grid point without looking at a policy
again, and only points whose bounds reach the best one need the exact pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffspark.functions.columns import nonneg
from tariffspark.operators.pricing import Retention, net_share
from tariffspark.roles import AMOUNT, PREMIUM

CELLS = 512
POINTS_AT_ONCE = 128
# Prices within 1e-12 of the old one count as kept; sums of doubles may differ by far less than this share.
KEPT, SLACK = 1.0 + 1e-12, 1e-9
_SUMS = ["n", "payout", "net"]


def retained(factor: np.ndarray, retention: Retention) -> np.ndarray:
    """Share of customers that stay when their price is multiplied by ``factor``."""
    share = min(max(retention.base_retention, 1e-6), 1.0 - 1e-6)
    logit = np.clip(np.log(share / (1.0 - share)) - retention.elasticity * (factor - 1.0 - retention.center), -35.0, 35.0)
    return np.clip(1.0 / (1.0 + np.exp(-logit)), retention.floor, retention.cap)


def cell_table(df: DataFrame, loss: Column, mean: float, cells: int = CELLS) -> pd.DataFrame:
    """(cell, n, payout, net, low, high): sums and the range of x; cell 0 holds policies without a premium.

    The edges come from a sketch and need not be exact, as every cell reports its
    own range.  A task returns at most one row per cell.
    """
    base = nonneg(F.col(PREMIUM))
    wanted = [i / cells for i in range(1, cells)]
    found = df.select(F.percentile_approx(loss, wanted, 10 * cells).alias("q")).first()["q"] or []
    scale = mean if mean > 0 else 1.0
    edges = np.unique(np.asarray(found, float)) / scale
    slim = df.select(base.alias("base"), (base * net_share(base)).alias("net"), nonneg(F.col(AMOUNT)).alias("payout"),
                     (loss / F.lit(scale) if mean > 0 else F.lit(1.0)).alias("x"))
    size = len(edges) + 2

    def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, low, high = np.zeros((len(_SUMS), size)), np.full(size, np.inf), np.full(size, -np.inf)
        for batch in batches:
            base_, net, payout, x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            place = np.where(base_ > 0, np.searchsorted(edges, x, side="right") + 1, 0)
            for k, value in enumerate((None, payout, net)):
                totals[k] += np.bincount(place, weights=value, minlength=size)
            np.minimum.at(low, place, x)
            np.maximum.at(high, place, x)
        used = np.nonzero(totals[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(t[used]) for t in totals], pa.array(low[used]), pa.array(high[used])],
                                         names=["cell", *_SUMS, "low", "high"])

    parts = slim.mapInArrow(sum_batches, "cell long, n double, payout double, net double, low double, high double")
    return parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in _SUMS], F.min("low").alias("low"), F.max("high").alias("high")).toPandas()


def _ratio(top: tuple[np.ndarray, np.ndarray], bottom: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a quotient that is zero where its denominator is."""
    with np.errstate(divide="ignore", invalid="ignore"):
        low = np.where(bottom[0] > 0, top[0] / bottom[1], 0.0)
        high = np.where(bottom[0] > 0, top[1] / bottom[0], np.where(bottom[1] > 0, np.inf, 0.0))
    return low * (1.0 - SLACK), high * (1.0 + SLACK)


def _distance(value: tuple[np.ndarray, np.ndarray], target: float) -> tuple[np.ndarray, np.ndarray]:
    low, high = value
    return np.maximum(np.maximum(low - target, target - high), 0.0), np.maximum(np.abs(low - target), np.abs(high - target))


def score_bounds(table: pd.DataFrame, family, retention: Retention, target: float, limits: tuple[float, float]) -> dict[str, np.ndarray]:
    """Per grid point: is the target band possible, is it sure, and the range of the policy score."""
    paying, without = table[table["cell"] > 0], table[table["cell"] == 0]
    n, payout, net, low, high = (paying[c].to_numpy(float) for c in (*_SUMS, "low", "high"))
    stay = float(retained(np.ones(1), retention)[0])
    alone, alone_paid = without["n"].sum() * stay, without["payout"].sum() * stay
    count = n.sum() + without["n"].sum()
    out = {name: [] for name in ("possible", "sure", "most", "least")}
    for start in range(0, family.size, POINTS_AT_ONCE):
        a, b = (v[start:start + POINTS_AT_ONCE, None] for v in (family.a, family.b))
        ends = [np.clip(a + b * x, family.low, family.high) for x in (low, high)]
        small, large = np.minimum(*ends), np.maximum(*ends)
        weights = [retained(f, retention) for f in (small, large)]
        w = np.minimum(*weights), np.maximum(*weights)
        kept, maybe = large <= KEPT, small <= KEPT
        groups = {"all": (1.0, 1.0), "first": (kept, maybe), "second": (~maybe, ~kept)}
        bounds = {}
        for group, inside in groups.items():
            extra = (0.0, 0.0) if group == "second" else (alone, alone_paid)
            bounds[group] = {"weight": tuple((i * w_ * n).sum(axis=1) + extra[0] for i, w_ in zip(inside, w)),
                             "payout": tuple((i * w_ * payout).sum(axis=1) + extra[1] for i, w_ in zip(inside, w)),
                             "net": tuple((i * w_ * f * net).sum(axis=1) for i, w_, f in zip(inside, w, (small, large)))}
        total = _ratio(bounds["all"]["payout"], bounds["all"]["net"])
        near = [_distance(v, target) for v in (total, *[_ratio(bounds[g]["payout"], bounds[g]["net"]) for g in ("first", "second")])]
        one, two = bounds["first"]["weight"], bounds["second"]["weight"]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = [np.nan_to_num(x / (x + y)) for x, y in ((one[0], two[1]), (one[1], two[0]))]
        rate = [v / max(count, 1.0) for v in bounds["all"]["weight"]]
        possible, sure = (total[1] >= limits[0]) & (total[0] <= limits[1]), (total[0] >= limits[0]) & (total[1] <= limits[1])
        penalty = [near[0][k] + 0.7 * near[1][k] + 0.7 * near[2][k] for k in (0, 1)]
        out["possible"].append(possible)
        out["sure"].append(sure)
        out["most"].append(0.15 * share[1] + 0.1 * rate[1] + 0.5 * possible - penalty[0])
        out["least"].append(0.15 * share[0] + 0.1 * rate[0] + 0.5 * sure - penalty[1])
    return {name: np.concatenate(parts) for name, parts in out.items()}


def contenders(df: DataFrame, family, loss: Column, mean: float, retention: Retention, target: float, limits: tuple[float, float],
               cells: int = CELLS) -> np.ndarray:
    """Places of the grid points that may have the largest (in_target, policy_score); never without the best one."""
    found = score_bounds(cell_table(df, loss, mean, cells), family, retention, target, limits)
    floor = found["sure"].any()
    best = found["least"][found["sure"]].max() if floor else found["least"].max()
    reach = found["most"] >= best - SLACK
    return np.nonzero(found["possible"] & reach if floor else found["possible"] | reach)[0]
