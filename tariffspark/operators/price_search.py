"""Searching a tariff over a grid of (alpha, beta).

Every tariff here multiplies the base premium by ``clip(a + b * x, low, high)``
with ``x`` the relative risk of a policy.  Where the clip starts, and where the
price stops being a reduction, are thresholds on ``x``; so one pass that sums
premium, premium times x, claims and counts between consecutive thresholds of
the *whole* grid gives every grid point by prefix sums.  The cost is one binary
search per policy, whatever the number of grid points, and only bin sums leave
the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.functions.columns import half_open_bin, nonneg
from tariffspark.operators.pricing import (
    PRICE_CAP, PricingPolicy, Retention, kpis_from_sums, net_share, portfolio_kpis, price_scalar, price_stratified, target_band,
)
from tariffspark.operators.quantiles import even_grid, exact_quantiles
from tariffspark.operators.retention_bounds import contenders
from tariffspark.roles import AMOUNT, PREMIUM
from tariffspark.session import materialize

KPI_SUMS = ["n", "payout", "net", "payout_1", "net_1", "payout_2", "net_2", "weight", "weight_1", "violations"]
_BIN_SUMS = ["n", "n_paying", "payout", "net", "net_x", "x_paying"]


@dataclass(frozen=True)
class Family:
    """The grid as straight lines: point g multiplies by clip(a[g] + b[g] * x, low, high)."""

    alpha: np.ndarray
    beta: np.ndarray
    a: np.ndarray
    b: np.ndarray
    low: float
    high: float

    @property
    def size(self) -> int:
        return len(self.a)

    def crossings(self) -> dict[str, np.ndarray]:
        """x where the line meets the lower limit, 1 and the upper limit; prices within 1e-12 of the old one count as kept."""
        sloped = self.b != 0
        slope = np.where(sloped, self.b, 1.0)
        cross = {n: np.where(sloped, (level - self.a) / slope, np.inf) for n, level in (("low", self.low), ("one", 1.0), ("high", self.high))}
        slack = 1e-12 * np.maximum(1.0, np.abs(cross["one"]))
        with np.errstate(invalid="ignore"):
            cross["one"] = np.where(sloped, cross["one"] + np.sign(self.b) * slack, np.inf)
        return cross

    def thresholds(self) -> np.ndarray:
        every = np.concatenate(list(self.crossings().values()))
        return np.unique(every[np.isfinite(every)])


def _points(alphas: Sequence[float], betas: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs, beta outside and alpha inside: the order that decides ties."""
    if len(alphas) == 0 or len(betas) == 0:
        raise ValueError("alpha and beta grids must not be empty")
    beta, alpha = np.meshgrid(np.asarray(betas, float), np.asarray(alphas, float), indexing="ij")
    return alpha.ravel(), beta.ravel()


def relative_risk_family(alphas: Sequence[float], betas: Sequence[float]) -> Family:
    """beta x (1 + alpha x (x - 1)) within 0..3, with x = expected loss over its mean."""
    alpha, beta = _points(alphas, betas)
    return Family(alpha, beta, beta * (1.0 - alpha), alpha * beta, 0.0, PRICE_CAP)


def relative_loss_family(alphas: Sequence[float], betas: Sequence[float]) -> Family:
    """1 + alpha + beta x within 0.4..3, with x = expected loss over the policy's own premium."""
    alpha, beta = _points(alphas, betas)
    return Family(alpha, beta, 1.0 + alpha, beta.copy(), 0.4, PRICE_CAP)


# -- one pass over the policies --------------------------------------------------------

def bin_sums(df: DataFrame, family: Family, losses: Sequence[Column], weights: np.ndarray, bucket: Column | None = None,
             buckets: int = 1) -> DataFrame:
    """Sums per (variant, bucket, bin) with x = losses @ weights[variant].

    Bin -1 holds policies without a premium.  A task returns at most one row per
    non-empty bin, so the shuffle depends on the grid and not on the data.
    """
    edges, weights = family.thresholds(), np.atleast_2d(np.asarray(weights, float))
    variants, bins = weights.shape[0], len(edges) + 2
    base = nonneg(F.col(PREMIUM))
    slim = df.select(
        base.alias("base"), (base * net_share(base)).alias("net"), nonneg(F.col(AMOUNT)).alias("payout"),
        (bucket if bucket is not None else F.lit(0)).cast("int").alias("bucket"),
        *[loss.cast("double").alias(f"loss{i}") for i, loss in enumerate(losses)],
    )

    def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(_BIN_SUMS), variants, buckets * bins))
        for batch in batches:
            base_, net, payout, bucket_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            z = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4, batch.num_columns)])
            paying = base_ > 0
            for v in range(variants):
                x = z @ weights[v] if weights[v].any() else np.ones(len(z))
                place = np.where(paying, np.searchsorted(edges, x, side="right") + 1, 0)
                slot = bucket_ * bins + place
                for k, value in enumerate((None, paying, payout, net, net * x, x * paying)):
                    totals[k, v] += np.bincount(slot, weights=value, minlength=buckets * bins)
        totals = totals.reshape(len(_BIN_SUMS), variants * buckets * bins)
        used = np.nonzero(totals[0])[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array((used // (buckets * bins)).astype("int32")), pa.array((used // bins % buckets).astype("int32")),
             pa.array((used % bins - 1).astype("int32")), *[pa.array(totals[k][used]) for k in range(len(_BIN_SUMS))]],
            names=["variant", "bucket", "bin", *_BIN_SUMS])

    schema = "variant int, bucket int, bin int, " + ", ".join(f"{c} double" for c in _BIN_SUMS)
    return slim.mapInArrow(sum_batches, schema).groupBy("variant", "bucket", "bin").agg(*[F.sum(c).alias(c) for c in _BIN_SUMS])


def _grid_sums(pdf: pd.DataFrame, family: Family) -> pd.DataFrame:
    """KPI sums of every grid point from the bin sums of one (variant, bucket)."""
    edges, cross = family.thresholds(), family.crossings()
    table = np.zeros((len(_BIN_SUMS), len(edges) + 2))
    for k, c in enumerate(_BIN_SUMS):
        np.add.at(table[k], pdf["bin"].to_numpy() + 1, pdf[c].to_numpy())
    without = dict(zip(_BIN_SUMS, table[:, 0]))
    running = np.concatenate([np.zeros((len(_BIN_SUMS), 1)), np.cumsum(table[:, 1:], axis=1)], axis=1)
    whole = running[:, -1:]

    def below(name: str) -> np.ndarray:
        """Sums over policies with x under the crossing, per grid point."""
        at = np.searchsorted(edges, cross[name])
        return running[:, np.minimum(at + 1, running.shape[1] - 1)]

    low, one, high = below("low"), below("one"), below("high")
    up, down = family.b > 0, family.b < 0
    flat = ~up & ~down
    constant = np.clip(family.a, family.low, family.high)

    def price(part_low, part_mid, part_high, column, column_x):
        """Premium-like total when the three parts are priced at the limits and on the line."""
        k, kx = _BIN_SUMS.index(column), _BIN_SUMS.index(column_x)
        return family.low * part_low[k] + family.a * part_mid[k] + family.b * part_mid[kx] + family.high * part_high[k]

    zero = np.zeros_like(low)
    at_low = np.where(up, low, np.where(down, whole - low, zero))
    at_high = np.where(up, whole - high, np.where(down, high, zero))
    on_line = whole - at_low - at_high
    kept = np.where(up, one, np.where(down, whole - one, np.where(constant <= 1.0, whole, zero)))
    kept_line = kept - np.where(flat, zero, at_low)

    def total(column, column_x):
        return np.where(flat, constant * whole[_BIN_SUMS.index(column)], price(at_low, on_line, at_high, column, column_x))

    i = {c: k for k, c in enumerate(_BIN_SUMS)}
    net = total("net", "net_x")
    net_1 = np.where(flat, constant * kept[i["net"]], price(at_low, kept_line, zero, "net", "net_x"))
    payout = whole[i["payout"]] + without["payout"]
    payout_1 = kept[i["payout"]] + without["payout"]
    n = whole[i["n"]] + without["n"]
    n_1 = kept[i["n"]] + without["n"]
    out = pd.DataFrame({
        "ordinal": np.arange(family.size, dtype="int64"), "alpha": family.alpha, "beta": family.beta,
        "n": n.repeat(family.size), "payout": payout.repeat(family.size), "net": net, "payout_1": payout_1, "net_1": net_1,
        "payout_2": payout - payout_1, "net_2": net - net_1, "weight": n.repeat(family.size), "weight_1": n_1,
        "violations": np.zeros(family.size), "multiplier": total("n_paying", "x_paying"),
    })
    # Differences of equal sums leave rounding noise; an empty group is exactly empty.
    empty = out["weight_1"] == out["weight"]
    out.loc[empty, ["payout_2", "net_2"]] = 0.0
    none = out["weight_1"] == 0
    out.loc[none, ["payout_1", "net_1"]] = 0.0
    return out


def grid_sums(sums: DataFrame, family: Family) -> DataFrame:
    """KPI sums per (variant, bucket, grid point); a group holds at most one row per threshold."""
    def per_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _grid_sums(pdf, family).assign(variant=np.int32(key[0]), bucket=np.int32(key[1]))

    schema = "ordinal long, alpha double, beta double, " + ", ".join(f"{c} double" for c in KPI_SUMS) + ", multiplier double, variant int, bucket int"
    return sums.groupBy("variant", "bucket").applyInPandas(per_group, schema)


def _means(df: DataFrame, losses: Sequence[Column]) -> np.ndarray:
    row = df.agg(*[F.coalesce(F.avg(loss), F.lit(0.0)) for loss in losses]).first()
    return np.asarray(list(row), float)


def _index_weights(mixes: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Rows of mixing weights over loss columns, scaled so that x is the loss over its mean (0 rows: x = 1)."""
    mixed = mixes @ means
    return np.where(mixed[:, None] > 0, mixes / np.where(mixed > 0, mixed, 1.0)[:, None], 0.0)


def _retained_sums(df: DataFrame, family: Family, losses: Sequence[Column], mixes: np.ndarray, means: np.ndarray, retention: Retention,
                   bucket: Column | None = None, buckets: int = 1, only: np.ndarray | None = None) -> DataFrame:
    """KPI sums when policies are weighted by their retention, which is not a straight line in x.

    Each task evaluates the grid point by point (or the places in ``only``) on its
    Arrow batches and returns one row per point, weight vector (row of ``mixes``) and bucket.
    """
    ordinals = np.arange(family.size) if only is None else only
    family = replace(family, **{name: getattr(family, name)[ordinals] for name in ("alpha", "beta", "a", "b")})
    base = nonneg(F.col(PREMIUM))
    slim = df.select(base.alias("base"), net_share(base).alias("share"), nonneg(F.col(AMOUNT)).alias("payout"),
                     (bucket if bucket is not None else F.lit(0)).cast("int").alias("bucket"), *[loss.alias(f"loss{i}") for i, loss in enumerate(losses)])
    kept_share = min(max(retention.base_retention, 1e-6), 1.0 - 1e-6)
    offset = float(np.log(kept_share / (1.0 - kept_share)))
    mixed = mixes @ means
    names = [*KPI_SUMS, "multiplier"]

    def add_points(out: np.ndarray, x: np.ndarray, base: np.ndarray, share: np.ndarray, payout: np.ndarray) -> None:
        """Add every point's sums. In order of x the factor only rises or only falls, so the policies that pay no more are one end of it."""
        free = ~(base > 0)
        free_paid, free_net, n_free = payout[free].sum(), (base[free] * share[free]).sum(), int(free.sum())
        free_weight = np.clip(1.0 / (1.0 + np.exp(-np.clip(offset + retention.elasticity * retention.center, -35.0, 35.0))), retention.floor, retention.cap)
        order = np.argsort(x[~free], kind="stable")
        x, income, payout = x[~free][order], (base * share)[~free][order], payout[~free][order]
        n = len(x)
        factor, w, earned = np.empty(n), np.empty(n), np.empty(n)
        for g in range(family.size):
            np.multiply(x, family.b[g], out=factor)
            factor += family.a[g]
            np.clip(factor, family.low, family.high, out=factor)
            np.subtract(factor, 1.0, out=w)
            w -= retention.center
            w *= retention.elasticity
            w -= offset
            np.clip(w, -35.0, 35.0, out=w)
            np.exp(w, out=w)
            w += 1.0
            np.divide(1.0, w, out=w)
            np.clip(w, retention.floor, retention.cap, out=w)
            np.multiply(factor, w, out=earned)
            cut = int(np.count_nonzero(factor <= 1.0 + 1e-12))
            kept, gone = (slice(0, cut), slice(cut, n)) if family.b[g] >= 0 else (slice(n - cut, n), slice(0, n - cut))
            paid, net, weight = payout[kept] @ w[kept] + free_paid * free_weight, income[kept] @ earned[kept] + free_net, w[kept].sum() + n_free * free_weight
            other_paid, other_net = payout[gone] @ w[gone], income[gone] @ earned[gone]
            out[g] += (n + n_free, paid + other_paid, net + other_net, paid, net, other_paid, other_net, weight + w[gone].sum(), weight, 0.0, factor.sum())

    def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(mixes), buckets, family.size, len(names)))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for k in range(buckets):
                mine = columns[3] == k
                base_, share, payout, _, *z = columns if mine.all() else [c[mine] for c in columns]
                if not len(base_):
                    continue
                for v, mix in enumerate(mixes):
                    x = sum(w * c for w, c in zip(mix, z)) / mixed[v] if mixed[v] > 0 else np.ones(len(base_))
                    add_points(totals[v, k], x, base_, share, payout)
        for v in range(len(mixes)):
            for k in range(buckets):
                if buckets == 1 or totals[v, k, 0, 0] > 0:
                    rows = family.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows, v, "int32")), pa.array(np.full(rows, k, "int32")), pa.array(ordinals.astype("int64")),
                         *[pa.array(totals[v, k, :, i].copy()) for i in range(len(names))]], names=["variant", "bucket", "ordinal", *names])

    schema = "variant int, bucket int, ordinal long, " + ", ".join(f"{c} double" for c in names)
    summed = slim.mapInArrow(sum_batches, schema).groupBy("variant", "bucket", "ordinal").agg(*[F.sum(c).alias(c) for c in names])
    points = [(int(i), float(a), float(b)) for i, a, b in zip(ordinals, family.alpha, family.beta)]
    grid = df.sparkSession.createDataFrame(points, "ordinal long, alpha double, beta double")
    return grid.join(summed, "ordinal")


# -- candidates and the choice among them ---------------------------------------------------

RANK_KEYS: dict[str, list[str]] = {
    "band_first": ["in_target", "policy_score", "share_group1"],
    "violation_first": ["clean", "in_target", "policy_score", "share_group1"],
    "distance_first": ["clean", "in_target", "closeness", "policy_score"],
}


def grid_candidates(df: DataFrame, alphas: Sequence[float], betas: Sequence[float], target: float = 0.7,
                    band: tuple[float, float] | None = None, loss: str = "expected_loss", kind: str = "relative_risk",
                    retention: Retention | None = None, may_win: bool = False) -> DataFrame:
    """KPIs of every grid point as rows (ordinal, alpha, beta, lr_total, ...).

    With ``may_win`` and a retention, points that provably are not the best in the band by score are left out.
    """
    limits = target_band(target, band)
    if kind == "relative_loss":
        family = relative_loss_family(alphas, betas)
        x = F.coalesce(F.col(loss).cast("double"), F.lit(0.0)) / F.greatest(nonneg(F.col(PREMIUM)), F.lit(1.0))
        sums = grid_sums(bin_sums(df, family, [x], np.ones((1, 1))), family)
        return kpis_from_sums(sums.drop("multiplier", "variant", "bucket"), target, limits)
    family = relative_risk_family(alphas, betas)
    column = nonneg(F.col(loss))
    mean = _means(df, [column])
    if retention is not None and retention.enabled:
        only = contenders(df, family, column, float(mean[0]), retention, target, limits) if may_win else None
        sums = _retained_sums(df, family, [column], np.ones((1, 1)), mean, retention, only=only)
        return kpis_from_sums(sums.drop("multiplier", "variant", "bucket"), target, limits, True)
    sums = grid_sums(bin_sums(df, family, [column], _index_weights(np.ones((1, 1)), mean)), family)
    return kpis_from_sums(sums.drop("multiplier", "variant", "bucket"), target, limits)


def best_candidate(candidates: DataFrame, key: str = "band_first", by: Sequence[str] = ()) -> DataFrame:
    """The row with the largest key; the first of equals in grid order."""
    ranked = candidates.withColumn("clean", (F.col("violations") == 0).cast("int")).withColumn("closeness", -F.col("distance_to_target"))
    order = F.struct(*[F.col(c) for c in RANK_KEYS[key]], (-F.col("ordinal")).alias("earliest"))
    row = F.struct(*[F.col(c) for c in candidates.columns if c not in by])
    return ranked.groupBy(*by).agg(F.max_by(row, order).alias("best")).select(*by, "best.*")


def search_price(df: DataFrame, alphas: Sequence[float], betas: Sequence[float], target: float = 0.7,
                 band: tuple[float, float] | None = None, loss: str = "expected_loss", kind: str = "relative_risk",
                 key: str = "band_first", retention: Retention | None = None) -> DataFrame:
    # Prices never leave 0..3 times the premium here, so no point has violations and the first two keys agree.
    return best_candidate(grid_candidates(df, alphas, betas, target, band, loss, kind, retention, key != "distance_first"), key)


def refine_price(df: DataFrame, alphas: Sequence[float], betas: Sequence[float], target: float = 0.7,
                 band: tuple[float, float] | None = None, rounds: int = 4, points: int = 9, loss: str = "expected_loss",
                 retention: Retention | None = None) -> DataFrame:
    """Grid optimum, then ever finer grids around it inside the original limits; never worse than the grid."""
    best = search_price(df, alphas, betas, target, band, loss, retention=retention).first().asDict()
    limits = [(min(g), max(g)) for g in (alphas, betas)]
    reach = [(high - low) / max(len(g) - 1, 1) for (low, high), g in zip(limits, (alphas, betas))]
    order = RANK_KEYS["band_first"]
    for _ in range(rounds):
        grids = []
        for (low, high), centre, step in zip(limits, (best["alpha"], best["beta"]), reach):
            grids.append([min(max(centre - step + 2.0 * step * i / (points - 1), low), high) for i in range(points)])
        found = search_price(df, grids[0], grids[1], target, band, loss, retention=retention).first().asDict()
        if tuple(found[c] for c in order) > tuple(best[c] for c in order):
            best = found
        reach = [2.0 * step / (points - 1) for step in reach]
    frame = df.sparkSession.createDataFrame([best])
    return frame.drop("ordinal")


# -- one tariff per risk bucket ----------------------------------------------------------------

def stratified_edges(df: DataFrame, n_buckets: int, min_bucket_size: int, loss: str = "expected_loss") -> list[float]:
    """Inner quantile edges with the most buckets (at most ``n_buckets``) that all reach the minimum size."""
    values = df.select(nonneg(F.col(loss)).alias("v"))
    n = values.count()
    if n < max(2, 2 * min_bucket_size):
        return []
    counts = range(max(1, n_buckets), 0, -1)
    wanted = {k: even_grid(k)[1:-1] for k in counts}
    flat = [q for k in counts for q in wanted[k]]
    found = exact_quantiles(values, {"v": flat})["v"] if flat else []
    edges, start = {}, 0
    for k in counts:
        edges[k] = sorted(set(found[start:start + len(wanted[k])]))
        start += len(wanted[k])
    sized = values.select(*[half_open_bin(F.col("v"), edges[k]).alias(f"b{k}") for k in counts]).agg(
        *[F.count_if(F.col(f"b{k}") == b).alias(f"b{k}_{b}") for k in counts for b in range(len(edges[k]) + 1)]).first()
    for k in counts:
        present = [sized[f"b{k}_{b}"] for b in range(len(edges[k]) + 1) if sized[f"b{k}_{b}"] > 0]
        if min(present) >= min_bucket_size:
            return edges[k]
    return []


def stratified_policy(df: DataFrame, edges: Sequence[float], alpha: dict[int, float], beta: dict[int, float], init: tuple[float, float],
                      method: str = "stratified_grid", loss: str = "expected_loss") -> PricingPolicy:
    """Per bucket: its parameters, size and mean loss; the risk index always uses the portfolio mean."""
    v = nonneg(F.col(loss))
    rows = df.groupBy(half_open_bin(v, edges).alias("b")).agg(F.count("*").alias("n"), F.sum(v).alias("s")).orderBy("b").collect()
    n = sum(r["n"] for r in rows)
    mean = sum(r["s"] for r in rows) / n if n else 0.0
    params = [{"bucket_id": r["b"], "alpha": float(alpha.get(r["b"], init[0])), "beta": float(beta.get(r["b"], init[1])),
               "mean_expected_loss": float(mean), "bucket_expected_loss_mean": r["s"] / r["n"], "count": r["n"]} for r in rows]
    return PricingPolicy("stratified", method, init[0], init[1], float(mean), [float(e) for e in edges], params, init[0], init[1])


def bucket_multipliers(df: DataFrame, policy: PricingPolicy, loss: str = "expected_loss") -> DataFrame:
    """(risk_bucket, n, mean_multiplier, increasing): increasing is 0 where a bucket's mean price factor falls."""
    priced = price_stratified(df, policy, loss)
    base = nonneg(F.col(PREMIUM))
    factor = F.when(base > 0, F.col("new_premium") / base).otherwise(F.lit(0.0))
    means = priced.groupBy("risk_bucket").agg(F.count("*").alias("n"), F.avg(factor).alias("mean_multiplier"))
    # At most one row per bucket.
    before = F.lag("mean_multiplier").over(Window.orderBy("risk_bucket"))
    return means.withColumn("increasing", F.coalesce((F.col("mean_multiplier") - before >= -1e-9).cast("int"), F.lit(1)))


def is_monotone(df: DataFrame, policy: PricingPolicy, loss: str = "expected_loss") -> bool:
    if policy.kind != "stratified" or len(policy.bucket_params) <= 1:
        return True
    return bucket_multipliers(df, policy, loss).agg(F.min("increasing")).first()[0] == 1


@dataclass
class StratifiedSearch:
    n_buckets: int = 5
    min_bucket_size: int = 50
    coordinate_passes: int = 2
    enforce_monotonic: bool = True


def _kpi_arrays(sums: dict[str, np.ndarray], target: float, limits: tuple[float, float], with_retention: bool = False) -> dict[str, np.ndarray]:
    def share(a, b):
        return np.where(b > 0, a / np.where(b > 0, b, 1.0), 0.0)

    total, first, second = share(sums["payout"], sums["net"]), share(sums["payout_1"], sums["net_1"]), share(sums["payout_2"], sums["net_2"])
    group1 = share(sums["weight_1"], sums["weight"])
    inside = (total >= limits[0]) & (total <= limits[1])
    score = (-np.abs(total - target) - 0.7 * np.abs(first - target) - 0.7 * np.abs(second - target) + 0.15 * group1 + 0.5 * inside)
    if with_retention:
        score = score + 0.10 * share(sums["weight"], sums["n"])
    return {"in_target": inside.astype(int), "policy_score": score, "share_group1": group1}


def search_stratified(df: DataFrame, alphas: Sequence[float], betas: Sequence[float], target: float = 0.7,
                      band: tuple[float, float] | None = None, config: StratifiedSearch | None = None,
                      loss: str = "expected_loss", retention: Retention | None = None) -> PricingPolicy:
    """Coordinate search over buckets, starting from the best single tariff.

    The KPIs are sums over buckets, so one job gives the sums of every (bucket,
    grid point) and the search itself is arithmetic on that small table.  Falls
    back to the single tariff when buckets do not help or would not be monotone.
    """
    cfg = config or StratifiedSearch()
    limits = target_band(target, band)
    family = relative_risk_family(alphas, betas)
    column = nonneg(F.col(loss))
    mean = _means(df, [column])
    edges = stratified_edges(df, cfg.n_buckets, cfg.min_bucket_size, loss)
    buckets = len(edges) + 1
    retained = retention is not None and retention.enabled
    if retained:
        sums = _retained_sums(df, family, [column], np.ones((1, 1)), mean, retention, half_open_bin(column, edges), buckets)
    else:
        sums = grid_sums(bin_sums(df, family, [column], _index_weights(np.ones((1, 1)), mean), half_open_bin(column, edges), buckets), family)
    # buckets x grid points rows: the size of the search, not of the data.
    table = sums.toPandas()
    names = [*KPI_SUMS, "multiplier"]
    present = sorted(table["bucket"].unique())
    part = {b: {c: table.loc[table["bucket"] == b].sort_values("ordinal")[c].to_numpy() for c in names} for b in present}
    overall = {c: sum(part[b][c] for b in present) for c in names}

    def key_at(kpi, g):
        return kpi["in_target"][g], kpi["policy_score"][g], kpi["share_group1"][g]

    def first_best(kpi, allowed):
        found = None
        for g in np.nonzero(allowed)[0]:
            if found is None or key_at(kpi, g) > key_at(kpi, found):
                found = int(g)
        return found

    kpi = _kpi_arrays(overall, target, limits, retained)
    start = first_best(kpi, np.ones(family.size, bool))
    init = (float(family.alpha[start]), float(family.beta[start]))
    single = PricingPolicy("scalar", "grid", init[0], init[1], float(mean[0]))
    if not edges:
        return replace(single, method="stratified_grid_fallback")

    chosen = {b: start for b in present}

    def means_of(choice):
        return np.array([part[b]["multiplier"][choice[b]] / part[b]["n"][choice[b]] for b in present])

    def monotone(values) -> bool:
        return bool(np.all(np.diff(values) >= -1e-9))

    if cfg.enforce_monotonic and not monotone(means_of(chosen)):
        return single
    best = key_at(kpi, start)
    for _ in range(cfg.coordinate_passes):
        for place, b in enumerate(present):
            rest = {c: sum(part[o][c][chosen[o]] for o in present if o != b) for c in names}
            kpi = _kpi_arrays({c: rest[c] + part[b][c] for c in names}, target, limits, retained)
            allowed = np.ones(family.size, bool)
            if cfg.enforce_monotonic:
                others, own = means_of(chosen), part[b]["multiplier"] / part[b]["n"]
                if place > 0:
                    allowed &= own - others[place - 1] >= -1e-9
                if place + 1 < len(present):
                    allowed &= others[place + 1] - own >= -1e-9
                left, right = others[:place], others[place + 1:]
                allowed &= monotone(left) and monotone(right)
            g = first_best(kpi, allowed)
            if g is not None and key_at(kpi, g) > best:
                best, chosen = key_at(kpi, g), {**chosen, b: g}
    kpi = _kpi_arrays(overall, target, limits, retained)
    if (cfg.enforce_monotonic and not monotone(means_of(chosen))) or best < key_at(kpi, start):
        return single
    alpha = {int(b): float(family.alpha[g]) for b, g in chosen.items()}
    beta = {int(b): float(family.beta[g]) for b, g in chosen.items()}
    return stratified_policy(df, edges, alpha, beta, init, loss=loss)


def select_pricing(df: DataFrame, alphas: Sequence[float], betas: Sequence[float] | None = None, target: float = 0.7,
                   band: tuple[float, float] | None = None, method: str = "grid", retention: Retention | None = None,
                   stratified: StratifiedSearch | None = None, loss: str = "expected_loss") -> tuple[PricingPolicy, DataFrame]:
    """Find a tariff with the named method and return it with its KPIs on ``df``."""
    betas = [1.0] if betas is None else betas
    kept = materialize(df, "pricing")
    name = (method or "grid").strip().lower()
    if name in ("grid", "refine"):
        search = search_price if name == "grid" else refine_price
        best = search(kept, alphas, betas, target, band, loss=loss, retention=retention).first()
        mean = float(_means(kept, [nonneg(F.col(loss))])[0])
        policy = PricingPolicy("scalar", name, best["alpha"], best["beta"], mean)
    elif name == "stratified_grid":
        policy = search_stratified(kept, alphas, betas, target, band, stratified, loss, retention)
    else:
        raise ValueError(f"unknown pricing method: {method}")
    priced = (price_scalar(kept, policy.alpha, policy.beta, loss=loss) if policy.kind == "scalar" else price_stratified(kept, policy, loss))
    return policy, portfolio_kpis(priced, target, band, retention)


# -- blends ----------------------------------------------------------------------------------------

def simplex_weights(n: int, step: float) -> np.ndarray:
    """All non-negative weight vectors of length ``n`` on the step grid that sum to one."""
    if n <= 0:
        return np.zeros((0, 0))
    if n == 1:
        return np.ones((1, 1))
    step = step if 0 < step <= 1 else 0.05
    units = max(1, round(1.0 / step))

    def vectors(left: int, places: int) -> Iterator[list[int]]:
        if places == 1:
            yield [left]
            return
        for value in range(left + 1):
            for rest in vectors(left - value, places - 1):
                yield [value, *rest]

    return np.array(list(vectors(units, n)), float) / units


def blend_weight_search(df: DataFrame, losses: Sequence[str], alphas: Sequence[float], betas: Sequence[float], step: float = 0.1,
                        target: float = 0.7, band: tuple[float, float] | None = None, limits: dict | None = None,
                        metric: str = "policy_score", method: str = "grid", retention: Retention | None = None,
                        stratified: StratifiedSearch | None = None) -> DataFrame:
    """Best tariff of every weight vector, with ``passes`` and ``chosen``.

    The thresholds depend on the grid alone, so on the plain grid all weight
    vectors share one pass; other methods search once per weight vector, and
    ``alpha`` and ``beta`` are then those of the whole tariff. The chosen row is
    the best that passes, else the best of all.
    """
    from tariffspark.operators.selection import constraint_columns

    columns = [nonneg(F.col(c)) for c in losses]
    mixes = simplex_weights(len(losses), step)
    if (method or "grid").strip().lower() == "grid":
        family, means, retained = relative_risk_family(alphas, betas), _means(df, columns), retention is not None and retention.enabled
        sums = (_retained_sums(df, family, columns, mixes, means, retention) if retained
                else grid_sums(bin_sums(df, family, columns, _index_weights(mixes, means)), family))
        best = best_candidate(kpis_from_sums(sums.drop("multiplier", "bucket"), target, target_band(target, band), retained), by=["variant"])
    else:
        found = []
        for v, mix in enumerate(mixes):
            mixed = df.withColumn("__mixed", reduce(add, [F.lit(float(w)) * c for w, c in zip(mix, columns)]))
            policy, kpis = select_pricing(mixed, alphas, betas, target, band, method, retention, stratified, "__mixed")
            found.append(kpis.select(F.lit(v).alias("variant"), F.lit(policy.alpha).alias("alpha"), F.lit(policy.beta).alias("beta"), "*").first())
        # One row per weight vector.
        best = df.sparkSession.createDataFrame(found, kpis.select(F.lit(0).alias("variant"), F.lit(0.0).alias("alpha"), F.lit(0.0).alias("beta"), "*").schema)
    passes = constraint_columns(limits or {})
    rows = [(int(v), *map(float, mixes[v])) for v in range(len(mixes))]
    named = df.sparkSession.createDataFrame(rows, "variant int, " + ", ".join(f"w_{c} double" for c in losses))
    table = materialize(named.join(F.broadcast(best.withColumn("passes", passes["passes"].cast("int"))), "variant"), "blend")
    winner = table.agg(F.max_by("variant", F.struct("passes", metric, -F.col("variant")))).scalar()
    return table.withColumn("chosen", (F.col("variant") == winner).cast("int"))
