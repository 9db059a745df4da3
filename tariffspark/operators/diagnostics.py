"""Portfolio diagnostics: deciles, double lift, actual-to-expected, contributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.functions.columns import finite, nonneg, ratio
from tariffspark.operators.order import with_part
from tariffspark.operators.profile import wide_to_long
from tariffspark.operators.quantiles import exact_quantiles
from tariffspark.roles import AMOUNT, CONTRACT
from tariffspark.session import materialize

SEGMENTS = ["region_name", "vehicle_type_name", "mark", "model", "bonus_malus"]


def with_deciles(df: DataFrame, value: str, name: str, deciles: int = 10, key: str = CONTRACT) -> DataFrame:
    """Equal-width buckets 1..q over the global rank of ``value`` (nulls rank as the median, ties by key).

    q is at most the number of rows and of distinct values; a constant column is all 1.
    """
    number = finite(F.col(value))
    counts = df.agg(F.count("*").alias("n"), F.count(number).alias("known")).first()
    n = counts["n"]
    if n == 0 or counts["known"] == 0:
        return df.withColumn(name, F.lit(1))
    filled = df.withColumn("_v", number)
    if counts["known"] < n:
        median = exact_quantiles(filled, {"_v": [0.5]})["_v"][0]
        filled = filled.withColumn("_v", F.coalesce("_v", F.lit(median)))
    distinct = filled.select("_v").distinct().limit(max(2, deciles)).count()
    if distinct <= 1:
        return filled.withColumn(name, F.lit(1)).drop("_v")
    q = max(2, min(deciles, n, distinct))
    # Bucket b ends at rank floor(b (n - 1) / q) + 1.
    placed = with_part(filled, F.col("_v"), key, [b * (n - 1) // q + 1 for b in range(1, q)], name)
    return placed.withColumn(name, F.col(name) + 1).drop("_v")


def _report_columns(df: DataFrame) -> DataFrame:
    amount = nonneg(F.col(AMOUNT)) if AMOUNT in df.columns else F.lit(0.0)
    return (df.withColumn(AMOUNT, amount).withColumn("expected_loss", nonneg(F.col("expected_loss")))
            .withColumn("new_premium", nonneg(F.col("new_premium")))
            .withColumn("price_delta_pct", F.coalesce(F.col("price_delta_pct").cast("double"), F.lit(0.0))))



def _ae_sums() -> list[Column]:
    return [F.count("*").alias("policies"), F.sum("new_premium").alias("premium_sum"), F.sum("expected_loss").alias("expected_loss_sum"),
            F.sum(AMOUNT).alias("claim_amount_sum")]


def _ae_ratios(df: DataFrame) -> DataFrame:
    return (df.withColumn("actual_lr", ratio(F.col("claim_amount_sum"), F.col("premium_sum")))
            .withColumn("expected_lr", ratio(F.col("expected_loss_sum"), F.col("premium_sum")))
            .withColumn("ae_ratio", ratio(F.col("claim_amount_sum"), F.col("expected_loss_sum"))))


def double_lift(df: DataFrame, deciles: int = 10, key: str = CONTRACT) -> DataFrame:
    """Cells of risk decile x price-change decile with actual and expected loss ratios."""
    slim = _report_columns(df).select(key, AMOUNT, "expected_loss", "new_premium", "price_delta_pct")
    both = with_deciles(with_deciles(materialize(slim, "lift"), "expected_loss", "risk_decile", deciles, key), "price_delta_pct", "delta_decile", deciles, key)
    cells = both.groupBy("risk_decile", "delta_decile").agg(
        *_ae_sums(), F.avg("price_delta_pct").alias("avg_price_delta"), F.avg("expected_loss").alias("avg_expected_loss"))
    return _ae_ratios(cells)


def ae_by_risk(df: DataFrame, deciles: int = 10, key: str = CONTRACT) -> DataFrame:
    slim = materialize(_report_columns(df).select(key, AMOUNT, "expected_loss", "new_premium"), "ae")
    return _ae_ratios(with_deciles(slim, "expected_loss", "risk_decile", deciles, key).groupBy("risk_decile").agg(*_ae_sums()))


def worst_ae(table: DataFrame) -> DataFrame:
    return table.agg(F.max(F.abs(F.col("ae_ratio") - F.lit(1.0))).alias("max_abs_ae_risk_decile"))


def ae_by_segment(df: DataFrame, segments: Sequence[str] = tuple(SEGMENTS), top: int | None = None) -> DataFrame:
    """Actual-to-expected of every value of each segment column, or of the ``top`` largest; all columns in one aggregation."""
    present = [c for c in segments if c in df.columns]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in present]
    long = _report_columns(df).select(AMOUNT, "expected_loss", "new_premium", *texts).unpivot(
        [AMOUNT, "expected_loss", "new_premium"], present, "segment_column", "segment_value")
    summed = long.groupBy("segment_column", "segment_value").agg(*_ae_sums())
    if top is None:
        return _ae_ratios(summed)
    # Spark keeps only the best ``top`` per column in every task before this window sorts them.
    place = F.row_number().over(Window.partitionBy("segment_column").orderBy(F.desc("policies"), "segment_value"))
    return _ae_ratios(summed.withColumn("_place", place).where(F.col("_place") <= top).drop("_place"))


def contribution_rank(df: DataFrame, weights: Mapping[str, float], top: int | None = None) -> DataFrame:
    """Features by mean absolute linear contribution weight x (value - mean), with rank and cumulative share.

    For a linear model these are the exact additive contributions, and all rows count.
    """
    features = list(weights)
    filled = df.select(*[F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in features])
    mean = filled.agg(*[F.avg(c).alias(c) for c in features]).first()
    row = filled.agg(*[F.avg(F.abs(F.lit(float(weights[c])) * (F.col(c) - F.lit(mean[c])))).alias(f"mean_abs_contribution__{c}") for c in features])
    long = wide_to_long(row, features, ["mean_abs_contribution"])
    # One row per feature.
    order = Window.orderBy(F.desc("mean_abs_contribution"), "feature")
    running = F.sum("mean_abs_contribution").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.greatest(F.sum("mean_abs_contribution").over(Window.partitionBy()), F.lit(1e-9))
    ranked = long.withColumn("rank", F.row_number().over(order)).withColumn("cumulative_share", running / whole)
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def tree_contribution_rank(df: DataFrame, model, top: int | None = None) -> DataFrame:
    """Columns of a fitted boosted model by mean absolute contribution over all rows, with rank and cumulative share.

    A row's contributions and the base add up to its margin; one row per column comes out of one aggregation.
    """
    names = list(model.binning.columns)
    rows = model.contributions(df).select("contribution")
    summed = rows.select(F.posexplode("contribution").alias("place", "x")).groupBy("place").agg(F.avg(F.abs("x")).alias("mean_abs_contribution"))
    long = summed.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("place") + 1).alias("feature"), "mean_abs_contribution")
    # One row per column of the model.
    order = Window.orderBy(F.desc("mean_abs_contribution"), "feature")
    running = F.sum("mean_abs_contribution").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.greatest(F.sum("mean_abs_contribution").over(Window.partitionBy()), F.lit(1e-9))
    ranked = long.withColumn("rank", F.row_number().over(order)).withColumn("cumulative_share", running / whole)
    return ranked if top is None else ranked.where(F.col("rank") <= top)
