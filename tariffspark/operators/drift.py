"""Population stability and categorical shift between two windows of a table."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.functions.columns import finite, half_open_bin, micros
from tariffspark.operators.order import with_part
from tariffspark.operators.quantiles import even_grid, exact_quantiles
from tariffspark.session import materialize

EPS = 1e-6


def time_windows(df: DataFrame, date: str, key: str, early: float = 0.3, late: float = 0.7) -> DataFrame:
    """``window`` = reference for the first ``early`` share of the rows by time, current from ``late`` on."""
    dated = df.where(F.col(date).isNotNull())
    n = dated.count()
    placed = with_part(dated, micros(F.col(date)), key, [int(n * early), int(n * late)], "window")
    return placed.withColumn("window", F.when(F.col("window") == 0, "reference").when(F.col("window") == 2, "current")).where("window is not null")


def time_split(df: DataFrame, date: str, key: str, share: float = 0.7, min_rows: int = 500) -> DataFrame | None:
    """Reference / current split at ``share`` of the dated rows; None when the table is too short for it."""
    dated = df.where(F.col(date).isNotNull())
    n, least = dated.count(), max(int(min_rows), 20)
    cut = min(max(round(n * min(max(share, 0.5), 0.95)), least), max(n - least, 1))
    if n < 2 or cut <= 0 or cut >= n:
        return None
    placed = with_part(dated, micros(F.col(date)), key, [cut], "window")
    return placed.withColumn("window", F.when(F.col("window") == 0, "reference").otherwise("current"))


def _bins_of(x: Column, edges: list[float], mode: str) -> Column:
    if mode == "open":
        return F.when(x.isNull(), F.lit(-1)).otherwise(half_open_bin(x, edges))
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    return F.when(inside, half_open_bin(x, edges[1:-1]))


def psi(df: DataFrame, features: Sequence[str], bins: int = 10, mode: str = "open", prepared: bool = False) -> DataFrame:
    """(feature, psi) between the reference and the current window.

    ``open``: outer bins reach to infinity, nulls are a bin of their own, a
    constant reference is split at its value, two values suffice.
    ``closed``: values outside the reference range and nulls are left out, both
    windows need 50 values and three distinct edges.
    All features share one quantile step and one counting job.
    """
    features = list(features)
    table = df if prepared else materialize(df.select("window", *[finite(F.col(c)).alias(c) for c in features]), "psi")
    least = 2 if mode == "open" else 50
    bins = max(int(bins), 3) if mode == "open" else int(bins)
    observed = table.groupBy("window").agg(*[F.count(c).alias(c) for c in features]).collect()
    seen = {r["window"]: r for r in observed}
    usable = [c for c in features if len(seen) == 2 and min(seen["reference"][c], seen["current"][c]) >= least]
    grid = even_grid(bins)
    raw = exact_quantiles(table.where("window = 'reference'"), {c: grid for c in usable})
    edges: dict[str, list[float]] = {}
    for c in usable:
        unique = sorted(set(raw[c]))
        if mode == "open":
            edges[c] = unique[1:-1] if len(unique) >= 2 else unique
        elif len(unique) >= 3:
            edges[c] = unique
    if not edges:
        return df.sparkSession.createDataFrame([(c, None) for c in features], "feature string, psi double")

    binned = table.select("window", *[_bins_of(F.col(c), e, mode).alias(c) for c, e in edges.items()])
    counts = (
        binned.unpivot(["window"], list(edges), "feature", "bin").where("bin is not null")
        .groupBy("feature", "bin").agg(F.count_if(F.col("window") == "reference").alias("r"),
                                       F.count_if(F.col("window") == "current").alias("c"))
    )
    # One row per (feature, bin) from here on.
    whole = Window.partitionBy("feature")
    valid = F.col("bin") >= 0

    def share(name: str) -> Column:
        among_valid = F.greatest(F.sum(F.when(valid, F.col(name))).over(whole), F.lit(1))
        part = F.when(valid, F.col(name) / among_valid).otherwise(F.col(name) / F.sum(name).over(whole))
        return F.greatest(part, F.lit(EPS))

    term = counts.select("feature", share("r").alias("r"), share("c").alias("c"))
    scored = term.groupBy("feature").agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))
    listed = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    return listed.join(F.broadcast(scored), "feature", "left")


def categorical_shift(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Total-variation distance, unseen share and distinct values per text column between the windows."""
    columns = list(columns)
    counted = (
        df.select("window", *[F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias(c) for c in columns])
        .unpivot(["window"], columns, "feature", "value").groupBy("feature", "value")
        .agg(F.count_if(F.col("window") == "reference").alias("r"), F.count_if(F.col("window") == "current").alias("c"))
    )
    totals = df.groupBy().agg(F.count_if(F.col("window") == "reference").alias("r"), F.count_if(F.col("window") == "current").alias("c")).first()
    early, late = F.lit(float(max(totals["r"], 1))), F.lit(float(max(totals["c"], 1)))
    return counted.groupBy("feature").agg(
        (F.sum(F.abs(F.col("r") / early - F.col("c") / late)) / 2).alias("total_variation_distance"),
        (F.sum(F.when(F.col("r") == 0, F.col("c")).otherwise(0)) / late).alias("late_unseen_rate_vs_early"),
        F.count_if(F.col("r") > 0).alias("early_unique"),
        F.count_if(F.col("c") > 0).alias("late_unique"),
    )


def excluded_by_pattern(columns: Sequence[str], names: Sequence[str] = (), patterns: Sequence[str] = ()) -> set[str]:
    return {c for c in columns if c in set(names) or any(fnmatch.fnmatch(c, p) for p in patterns if p.strip())}


def drift_report(split: DataFrame, features: Sequence[str], threshold: float = 0.25, bins: int = 10,
                 protected: Sequence[str] = (), exclude: Sequence[str] = (), exclude_patterns: Sequence[str] = ()) -> DataFrame:
    """(feature, psi, decision) with decision drop, keep, excluded or protected."""
    skipped = excluded_by_pattern([c for c in features if c not in set(protected)], exclude, exclude_patterns)
    measured = psi(split, features, bins)
    decision = (
        F.when(F.col("feature").isin(list(protected)), "protected")
        .when(F.col("feature").isin(sorted(skipped)), "excluded")
        .when(F.col("psi") > F.lit(max(float(threshold), 0.0)), "drop").otherwise("keep")
    )
    return measured.withColumn("decision", decision)
