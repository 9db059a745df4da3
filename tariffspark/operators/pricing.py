"""Applying a tariff and measuring it on a portfolio."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffspark.functions.columns import clip, half_open_bin, nonneg, ratio
from tariffspark.roles import AMOUNT, PREMIUM, PREMIUM_NET

PRICE_CAP = 3.0


@dataclass
class Retention:
    """Share of customers that stay, as a logistic function of the price change."""

    enabled: bool = False
    base_retention: float = 0.90
    elasticity: float = 4.0
    center: float = 0.0
    floor: float = 0.05
    cap: float = 0.995

    def __post_init__(self) -> None:
        low, high = sorted((self.floor, self.cap))
        self.floor, self.cap = min(max(low, 0.0), 1.0), min(max(high, 0.0), 1.0)


@dataclass
class PricingPolicy:
    """A fitted tariff: one (alpha, beta), or one per expected-loss bucket."""

    kind: str = "scalar"
    method: str = "grid"
    alpha: float | None = None
    beta: float | None = None
    mean_loss: float | None = None
    bucket_edges: list[float] = field(default_factory=list)
    bucket_params: list[dict] = field(default_factory=list)
    global_init_alpha: float | None = None
    global_init_beta: float | None = None
    bucket_feature: str = "expected_loss"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "PricingPolicy":
        return PricingPolicy(**json.loads(text))

    def summary(self) -> dict:
        return {"kind": self.kind, "method": self.method, "alpha": self.alpha, "beta": self.beta,
                "bucket_count": len(self.bucket_params), "bucket_edges": list(self.bucket_edges)}


def target_band(target: float, band: tuple[float, float] | None = None,
                constraints: tuple[float, float] | None = None) -> tuple[float, float]:
    """Explicit band, else the constraint limits, else target plus or minus one point."""
    chosen = band or constraints or (target - 0.01, target + 0.01)
    return min(chosen), max(chosen)


def mean_expected_loss(df: DataFrame, loss: str = "expected_loss") -> Column:
    """Portfolio mean as a scalar subquery: no join, and Spark runs it once."""
    return df.agg(F.coalesce(F.avg(nonneg(F.col(loss))), F.lit(0.0))).scalar()


def risk_multiplier(loss: Column, mean: Column, alpha: Column, beta: Column) -> Column:
    index = F.when(mean > 0, loss / mean).otherwise(F.lit(1.0))
    return F.lit(1.0) * beta * (F.lit(1.0) + alpha * (index - F.lit(1.0)))


def scalar_price(base: Column, loss: Column, mean: Column, alpha: Column, beta: Column) -> Column:
    index = F.when(mean > 0, loss / mean).otherwise(F.lit(1.0))
    raw = base * beta * (F.lit(1.0) + alpha * (index - F.lit(1.0)))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(PRICE_CAP) * base)


def price_scalar(df: DataFrame, alpha: float, beta: float = 1.0, mean_loss: float | None = None,
                 loss: str = "expected_loss") -> DataFrame:
    """``new_premium`` = base premium x beta x (1 + alpha x (relative risk - 1)), within 0..3 x base."""
    mean = F.lit(float(mean_loss)) if mean_loss is not None else mean_expected_loss(df, loss)
    price = scalar_price(nonneg(F.col(PREMIUM)), nonneg(F.col(loss)), mean, F.lit(float(alpha)), F.lit(float(beta)))
    return df.withColumn("new_premium", price)


def risk_bucket(edges: list[float], loss: str = "expected_loss") -> Column:
    return half_open_bin(nonneg(F.col(loss)), edges)


def price_stratified(df: DataFrame, policy: PricingPolicy, loss: str = "expected_loss") -> DataFrame:
    """Price by bucket; a bucket without parameters uses the global ones and its own mean loss."""
    known = {int(p.get("bucket_id", i)): p for i, p in enumerate(policy.bucket_params)}
    buckets = range(len(policy.bucket_edges) + 1)
    lacking = [b for b in buckets if known.get(b, {}).get("mean_expected_loss") is None]
    means: dict[int, float] = {}
    if lacking:
        rows = df.groupBy(risk_bucket(policy.bucket_edges, loss).alias("b")).agg(F.avg(nonneg(F.col(loss))).alias("m")).collect()
        means = {r["b"]: r["m"] for r in rows}
    default_alpha = policy.global_init_alpha if policy.global_init_alpha is not None else 0.0
    default_beta = policy.global_init_beta if policy.global_init_beta is not None else 1.0

    def per_bucket(value) -> Column:
        out = None
        for b in buckets:
            cond = F.col("risk_bucket") == b
            out = F.when(cond, F.lit(value(b))) if out is None else out.when(cond, F.lit(value(b)))
        return out

    def mean_of(b: int) -> float:
        own = known.get(b, {}).get("mean_expected_loss")
        return float(own if own is not None else means.get(b, 0.0))

    price = scalar_price(
        nonneg(F.col(PREMIUM)), nonneg(F.col(loss)), per_bucket(mean_of),
        per_bucket(lambda b: float(known.get(b, {}).get("alpha", default_alpha))),
        per_bucket(lambda b: float(known.get(b, {}).get("beta", default_beta))),
    )
    return df.withColumn("risk_bucket", risk_bucket(policy.bucket_edges, loss)).withColumn("new_premium", price)


def apply_policy(df: DataFrame, policy: PricingPolicy, loss: str = "expected_loss") -> DataFrame:
    if policy.kind == "scalar":
        return price_scalar(df, policy.alpha or 0.0, 1.0 if policy.beta is None else policy.beta, policy.mean_loss, loss)
    if policy.kind != "stratified":
        raise ValueError(f"unsupported pricing policy kind: {policy.kind}")
    return price_stratified(df, policy, loss).drop("risk_bucket")


def price_relative_loss(df: DataFrame, alpha: float, beta: float, loss: str = "expected_loss") -> DataFrame:
    """Tariff relative to the policy's own premium: 1 + alpha + beta x loss/premium, within 0.4..3."""
    base = nonneg(F.col(PREMIUM))
    relative = F.col(loss) / F.greatest(base, F.lit(1.0))
    return df.withColumn("new_premium", base * clip(F.lit(1.0 + alpha) + F.lit(float(beta)) * relative, 0.4, PRICE_CAP))


def price_delta(df: DataFrame) -> DataFrame:
    """Relative price change; a policy without a premium counts as unchanged."""
    return df.withColumn("price_delta_pct",
                         F.when(F.col(PREMIUM) > 0, F.col("new_premium") / F.col(PREMIUM) - F.lit(1.0)).otherwise(F.lit(0.0)))


def retention_probability(base: Column, new: Column, r: Retention) -> Column:
    if not r.enabled:
        return F.lit(1.0)
    share = min(max(r.base_retention, 1e-6), 1.0 - 1e-6)
    change = F.when(base > 0, new / base - F.lit(1.0)).otherwise(F.lit(0.0))
    logit = clip(F.lit(math.log(share / (1.0 - share))) - F.lit(r.elasticity) * (change - F.lit(r.center)), -35.0, 35.0)
    return clip(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), r.floor, r.cap)


def net_share(base: Column) -> Column:
    """Net-to-gross premium ratio within 0..1; 1 where there is no gross premium."""
    net = F.coalesce(F.col(PREMIUM_NET).cast("double"), base)
    return F.when(base > 0, clip(net / base, 0.0, 1.0)).otherwise(F.lit(1.0))


def kpi_sums(base: Column, new: Column, payout: Column, weight: Column, net: Column) -> list[Column]:
    """The additive quantities behind every portfolio KPI (group 1: price not raised)."""
    kept = new <= base
    zero = F.lit(0.0)
    return [
        F.count("*").alias("n"),
        F.coalesce(F.sum(payout * weight), zero).alias("payout"),
        F.coalesce(F.sum(net * weight), zero).alias("net"),
        F.coalesce(F.sum(F.when(kept, payout * weight)), zero).alias("payout_1"),
        F.coalesce(F.sum(F.when(kept, net * weight)), zero).alias("net_1"),
        F.coalesce(F.sum(F.when(~kept, payout * weight)), zero).alias("payout_2"),
        F.coalesce(F.sum(F.when(~kept, net * weight)), zero).alias("net_2"),
        F.coalesce(F.sum(weight), zero).alias("weight"),
        F.coalesce(F.sum(F.when(kept, weight)), zero).alias("weight_1"),
        (F.count_if(new < 0) + F.count_if(new > F.lit(PRICE_CAP) * base)).alias("violations"),
    ]


def kpis_from_sums(sums: DataFrame, target: float, band: tuple[float, float], with_retention: bool = False) -> DataFrame:
    """Loss ratios, shares and the policy score from the additive quantities; other columns pass through."""
    low, high = band
    total, first, second = (ratio(F.col(p), F.col(n)) for p, n in (("payout", "net"), ("payout_1", "net_1"), ("payout_2", "net_2")))
    score = (
        -F.col("distance_to_target")
        - F.lit(0.7) * F.abs(F.col("lr_group1") - F.lit(target))
        - F.lit(0.7) * F.abs(F.col("lr_group2") - F.lit(target))
        + F.lit(0.15) * F.col("share_group1")
        - F.lit(2.0) * F.col("violations")
        + F.when(F.col("in_target") == 1, F.lit(0.5)).otherwise(F.lit(0.0))
    )
    if with_retention:
        score = score + F.lit(0.10) * F.col("retention_rate")
    out = (
        sums.withColumn("lr_total", total)
        .withColumn("lr_group1", first)
        .withColumn("lr_group2", second)
        .withColumn("share_group1", ratio(F.col("weight_1"), F.col("weight")))
        .withColumn("retention_rate", ratio(F.col("weight"), F.col("n")))
        .withColumn("distance_to_target", F.abs(F.col("lr_total") - F.lit(target)))
        .withColumn("in_target", F.col("lr_total").between(low, high).cast("int"))
        .withColumn("policy_score", score)
        .drop("n", "payout", "net", "payout_1", "net_1", "payout_2", "net_2", "weight", "weight_1")
    )
    return out if with_retention else out.drop("retention_rate")


def portfolio_kpis(priced: DataFrame, target: float = 0.7, band: tuple[float, float] | None = None,
                   retention: Retention | None = None, by: list[str] | None = None) -> DataFrame:
    """KPIs of a priced portfolio in one aggregation (one row, or one per ``by`` group)."""
    base = nonneg(F.col(PREMIUM))
    new = F.col("new_premium")
    keep = retention is not None and retention.enabled
    weight = retention_probability(base, nonneg(new), retention) if keep else F.lit(1.0)
    sums = priced.groupBy(*(by or [])).agg(*kpi_sums(base, new, nonneg(F.col(AMOUNT)), weight, new * net_share(base)))
    return kpis_from_sums(sums, target, target_band(target, band), keep)
