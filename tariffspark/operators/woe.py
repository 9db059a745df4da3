"""Weight of evidence and information value of numeric features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffspark.functions.columns import finite, right_closed_bin
from tariffspark.operators.quantiles import even_grid, exact_quantiles
from tariffspark.roles import CLAIM, FORBIDDEN, TARGETS, numeric_columns
from tariffspark.session import materialize


def woe_bins(df: DataFrame, features: Sequence[str] | None = None, n_bins: int = 10, min_bin_size: int = 50, target: str = CLAIM,
             prepared: bool = False) -> DataFrame:
    """(feature, bin, bin_lower, bin_upper, count, event_count, non_event_count, woe, iv_contribution).

    Quantile bins are right-closed with repeated edges merged; a feature needs
    two bins' worth of values and both classes.  Counts get half an observation
    each so that empty classes have a finite weight. A ``prepared`` table is
    written already and holds finite numbers or nulls: it is read as it is.
    """
    features = list(features or numeric_columns(df, [*TARGETS, *FORBIDDEN]))
    y = F.coalesce(F.col(target), F.lit(0)).cast("int")
    table = df.select(y.alias("_y"), *features) if prepared else materialize(df.select(y.alias("_y"), *[finite(F.col(c)).alias(c) for c in features]), "woe")
    seen = table.agg(*[F.count(c).alias(f"n__{c}") for c in features], *[F.sum(F.when(F.col(c).isNotNull(), F.col("_y"))).alias(f"e__{c}") for c in features]).first()
    usable = [c for c in features if seen[f"n__{c}"] >= 2 * min_bin_size and 0 < (seen[f"e__{c}"] or 0) < seen[f"n__{c}"]]
    grid = even_grid(n_bins)
    edges = {c: sorted(set(v)) for c, v in exact_quantiles(table, {c: grid for c in usable}).items()}
    edges = {c: e for c, e in edges.items() if len(e) >= 2}
    if not edges:
        return df.sparkSession.createDataFrame([], "feature string, bin int, bin_lower double, bin_upper double, count bigint, "
                                               "event_count bigint, non_event_count bigint, woe double, iv_contribution double")
    binned = table.select("_y", *[F.when(F.col(c).isNotNull(), right_closed_bin(F.col(c), e[1:-1])).alias(c) for c, e in edges.items()])
    counts = (
        binned.unpivot(["_y"], list(edges), "feature", "bin").where("bin is not null")
        .groupBy("feature", "bin").agg(F.count("*").alias("count"), F.sum("_y").cast("bigint").alias("event_count"))
    )
    # One row per feature and bin from here on: bounds and totals are known on the driver.
    bounds = [(c, i, float(e[i]), float(e[i + 1]), int(seen[f"n__{c}"]), int(seen[f"e__{c}"])) for c, e in edges.items() for i in range(len(e) - 1)]
    frame = df.sparkSession.createDataFrame(bounds, "feature string, bin int, bin_lower double, bin_upper double, _n bigint, _e bigint")
    event = (F.col("event_count") + 0.5) / (F.col("_e") + 1.0)
    other = (F.col("count") - F.col("event_count") + 0.5) / (F.col("_n") - F.col("_e") + 1.0)
    return (
        counts.join(F.broadcast(frame), ["feature", "bin"])
        .withColumn("non_event_count", F.col("count") - F.col("event_count"))
        .withColumn("woe", F.log(other / event)).withColumn("iv_contribution", (other - event) * F.col("woe"))
        .select("feature", "bin", "bin_lower", "bin_upper", "count", "event_count", "non_event_count", "woe", "iv_contribution")
    )


def iv_summary(bins: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, iv, n_bins, above_002, above_010); features without bins have an IV of 0."""
    found = bins.groupBy("feature").agg(F.sum("iv_contribution").alias("iv"), F.count("*").alias("n_bins"))
    if features is not None:
        listed = bins.sparkSession.createDataFrame([(f,) for f in features], "feature string")
        found = listed.join(F.broadcast(found), "feature", "left").fillna({"iv": 0.0, "n_bins": 0})
    return (found.withColumn("above_002", (F.col("iv") >= 0.02).cast("int")).withColumn("above_010", (F.col("iv") >= 0.10).cast("int"))
            .orderBy(F.desc("iv"), "feature"))


def iv_report(bins: DataFrame) -> DataFrame:
    """Bin rows with the total IV of their feature."""
    return bins.join(F.broadcast(bins.groupBy("feature").agg(F.sum("iv_contribution").alias("iv_total"))), "feature")


def select_features(bins: DataFrame, threshold: float = 0.02, fallback: int = 10) -> list[str]:
    """Features with enough information value, else the best ones; one row per feature is read."""
    ranked = [(r["feature"], r["iv"]) for r in iv_summary(bins).collect()]
    chosen = [f for f, iv in ranked if iv >= threshold]
    return chosen or [f for f, _ in ranked[:fallback]]


def woe_transform(df: DataFrame, bins: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``<feature>_woe``; values outside the fitted bins (the lowest edge included) and nulls give 0."""
    table: dict[str, list] = {}
    for r in bins.where(F.col("feature").isin(list(features))).collect():
        table.setdefault(r["feature"], []).append((r["bin_lower"], r["bin_upper"], r["woe"]))
    out = {}
    for f in features:
        value, x = F.lit(0.0), F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")
        for low, high, woe in sorted(table.get(f, []), reverse=True):
            value = F.when((x > F.lit(low)) & (x <= F.lit(high)), F.lit(woe)).otherwise(value)
        out[f"{f}_woe"] = value
    return df.withColumns(out)
