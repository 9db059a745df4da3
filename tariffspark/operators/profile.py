"""Exploratory tables: sizes, missingness, distributions, segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.functions.columns import fixed_label, nonneg, ratio, to_number
from tariffspark.operators.quality import null_rates
from tariffspark.operators.quantiles import exact_quantiles
from tariffspark.roles import AMOUNT, CLAIM, CONTRACT, OPERATION_DATE, PREMIUM, PREMIUM_NET, numeric_columns, string_columns
from tariffspark.session import materialize

# Segment bins (right edges) and their labels.
BONUS_EDGES, BONUS_LABELS = [5, 8, 11], ["<=5", "6-8", "9-11", "12+"]
CAR_YEAR_EDGES = [2005, 2010, 2015, 2020]
CAR_YEAR_LABELS = ["<=2005", "2006-2010", "2011-2015", "2016-2020", "2021+"]


def wide_to_long(row: DataFrame, features: Sequence[str], statistics: Sequence[str], name: str = "feature") -> DataFrame:
    """One-row aggregate with columns ``<statistic>__<feature>`` as one row per feature."""
    structs = [F.struct(F.lit(f).alias(name), *[F.col(f"`{s}__{f}`").alias(s) for s in statistics]) for f in features]
    return row.select(F.inline(F.array(*structs)))


def schema_difference(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str]]:
    """Columns only on the left, columns only on the right."""
    return sorted(set(left.columns) - set(right.columns)), sorted(set(right.columns) - set(left.columns))


def layer_sizes(layers: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("layer"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns")) for name, df in layers.items()]
    return reduce(DataFrame.unionByName, parts)


def rows_per_contract(df: DataFrame, quantiles: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99), contract: str = CONTRACT) -> DataFrame:
    """Mean and quantiles of the rows per contract.

    Contracts are counted per size first, so the quantile step sees only the
    distinct sizes.
    """
    sizes = df.where(F.col(contract).isNotNull()).groupBy(contract).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    row = sizes.agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("size", F.array(*[F.lit(float(q)) for q in quantiles]), F.col("n")).alias("q"),
    )
    stats = [F.struct(F.lit("mean").alias("statistic"), F.col("mean").cast("double").alias("rows_per_contract"))]
    stats += [F.struct(F.lit(f"q{q:g}").alias("statistic"), F.col("q")[i].alias("rows_per_contract")) for i, q in enumerate(quantiles)]
    return row.select(F.inline(F.array(*stats)))


def policy_vs_driver(df: DataFrame, contract: str = CONTRACT) -> DataFrame:
    """Row counts and premium sums on both grains, and the duplication factor, from one shuffle."""
    premium = F.coalesce(F.col(PREMIUM).cast("double"), F.lit(0.0))
    both = df.groupBy(contract).agg(F.count("*").alias("n"), F.sum(premium).alias("s"), F.coalesce(F.max(PREMIUM), F.lit(0.0)).alias("m"))
    row = both.agg(F.sum("n").alias("n"), F.count("*").alias("p"), F.sum("s").alias("s"), F.sum("m").alias("m"))
    metrics = {
        "driver_level_rows": F.col("n").cast("double"),
        "policy_level_rows": F.col("p").cast("double"),
        "driver_level_premium_sum": F.col("s"),
        "policy_level_premium_sum": F.col("m"),
        "premium_duplication_factor": F.when(F.col("m") > 0, F.col("s") / F.col("m")),
    }
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()])))


def missing_rates(df: DataFrame, top: int | None = None) -> DataFrame:
    """Null rate of every column, ranked; one row per column, so the rank window is metadata-sized."""
    ranked = null_rates(df).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("null_rate"), "feature")))
    return ranked.where(F.col("rank") <= top) if top else ranked


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max of each numeric column."""
    features = list(columns or numeric_columns(df))
    table = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in features]), "numeric")
    quartiles = exact_quantiles(table, {c: [0.25, 0.5, 0.75] for c in features})
    long = table.unpivot([], features, "feature", "x")
    basic = long.groupBy("feature").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
                                        F.min("x").alias("min"), F.max("x").alias("max"))
    # One row per column.
    known = df.sparkSession.createDataFrame([(c, *quartiles[c]) for c in features], "feature string, q25 double, q50 double, q75 double")
    return known.join(F.broadcast(basic), "feature").select("feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def categorical_cardinality(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values and null rate per text column; values are counted before they are shuffled."""
    features = list(columns or string_columns(df))
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"nunique__{c}") for c in features],
                     *[F.avg(F.col(c).isNull().cast("int")).alias(f"missing_rate__{c}") for c in features])
        return wide_to_long(row, features, ["nunique", "missing_rate"])
    counted = df.unpivot([], features, "feature", "value").groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counted.groupBy("feature").agg(
        F.count("value").alias("nunique"),
        (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("missing_rate"),
    )


def target_distribution(df: DataFrame, target: str = CLAIM) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(target), F.lit(0)).cast("int").alias(target)).agg(F.count("*").alias("n"))


def equal_width_histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, lower, upper, n) with the maximum in the last bin; the range is a scalar subquery."""
    x = df.select(value.alias("x")).where("x is not null")
    low = x.agg(F.min("x")).scalar()
    high = x.agg(F.max("x")).scalar()
    counted = (
        x.select("x", low.alias("lo"), high.alias("hi"))
        .select("lo", "hi", F.when(F.col("hi") > F.col("lo"), F.least(
            F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins))), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int").alias("bin"))
        .groupBy("bin", "lo", "hi").agg(F.count("*").alias("n"))
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return counted.select("bin", (F.col("lo") + step * F.col("bin")).alias("lower"),
                          (F.col("lo") + step * (F.col("bin") + 1)).alias("upper"), "n")


def claim_amount_histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    return equal_width_histogram(df, F.when(F.col(AMOUNT) > 0, F.log1p(F.col(AMOUNT).cast("double"))), bins)


def contract_size_histogram(df: DataFrame, widest: int = 23, contract: str = CONTRACT) -> DataFrame:
    """Contracts by number of rows in unit bins; the last bin holds ``widest`` rows and more."""
    sizes = df.where(F.col(contract).isNotNull()).groupBy(contract).agg(F.count("*").alias("size"))
    return (
        sizes.groupBy(F.least(F.col("size"), F.lit(widest)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
        .select("bin", F.col("bin").cast("double").alias("lower"), (F.col("bin") + 1).cast("double").alias("upper"), "n")
    )


def target_by_month(df: DataFrame, date: str = OPERATION_DATE) -> DataFrame:
    return (
        df.where(F.col(date).isNotNull()).groupBy(F.date_format(date, "yyyy-MM").alias("year_month"))
        .agg(F.avg(F.coalesce(F.col(CLAIM), F.lit(0)).cast("double")).alias("claim_rate"),
             F.avg(nonneg(F.col(AMOUNT))).alias("mean_claim_amount"), F.count("*").alias("rows"))
    )


def with_segment_bins(df: DataFrame) -> DataFrame:
    """Labelled bonus class and car-year bins; text that is no number falls into ``unknown``."""
    bonus = to_number(F.col("bonus_malus")) if "bonus_malus" in df.columns else F.lit(None).cast("double")
    year = to_number(F.col("car_year")) if "car_year" in df.columns else F.lit(None).cast("double")
    return (df.withColumn("bonus_malus_bin", fixed_label(bonus, BONUS_EDGES, BONUS_LABELS))
            .withColumn("car_year_bin", fixed_label(year, CAR_YEAR_EDGES, CAR_YEAR_LABELS)))


def first_existing(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def segment_kpis(df: DataFrame) -> DataFrame:
    """Claim rate, amounts and loss-ratio proxy by region, vehicle, bonus bin and car-year bin."""
    premium = first_existing(df, [PREMIUM_NET, PREMIUM])
    keys = [k for k in (first_existing(df, ["region_name", "ownerkato"]),
                        first_existing(df, ["vehicle_type", "car_type", "model"])) if k]
    amount, paid = nonneg(F.col(AMOUNT)), F.coalesce(F.col(premium).cast("double"), F.lit(0.0))
    out = with_segment_bins(df).groupBy(*keys, "bonus_malus_bin", "car_year_bin").agg(
        F.count("*").alias("count_policies"),
        F.avg(F.coalesce(F.col(CLAIM), F.lit(0)).cast("double")).alias("claim_rate"),
        F.avg(amount).alias("avg_claim_amount"),
        F.avg(paid).alias("premium_mean"),
        F.sum(amount).alias("total_claim_amount"),
        F.sum(paid).alias("total_premium"),
    )
    total = F.col("total_premium")
    proxy = F.when(total != 0, F.col("total_claim_amount") / total).otherwise(F.lit(0.0))
    return out.withColumn("lr_proxy", proxy).orderBy(F.desc("lr_proxy"), F.desc("claim_rate"), F.desc("count_policies"))


def segment_pivot(df: DataFrame, region: str = "region_name", top: int = 20) -> DataFrame:
    """Claim rate of the ``top`` largest regions by bonus bin (one column per bin)."""
    largest = (df.where(F.col(region).isNotNull()).groupBy(region).agg(F.count("*").alias("n"))
               .orderBy(F.desc("n"), region).limit(top).select(region))
    # ``largest`` holds at most ``top`` rows.
    kept = with_segment_bins(df).join(F.broadcast(largest), region, "left_semi")
    return kept.groupBy(region).pivot("bonus_malus_bin", [*BONUS_LABELS, "unknown"]).agg(
        F.avg(F.coalesce(F.col(CLAIM), F.lit(0)).cast("double")))


def eda_profile(df: DataFrame, contract: str = CONTRACT) -> DataFrame:
    """Headline metrics of the portfolio as one row, from one shuffle on the contract."""
    premium = F.coalesce(F.col(PREMIUM).cast("double"), F.lit(0.0))
    by_contract = df.groupBy(contract).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.col(CLAIM), F.lit(0)).cast("double")).alias("c"),
        F.sum(premium).alias("s"), F.coalesce(F.max(PREMIUM), F.lit(0.0)).alias("m"))
    known = F.col(contract).isNotNull()
    return by_contract.agg(
        F.sum("n").alias("train_rows"), F.lit(len(df.columns)).cast("bigint").alias("train_columns"),
        (F.sum("c") / F.sum("n")).alias("claim_rate"),
        F.count_if(known).alias("contract_nunique"),
        ratio(F.sum(F.when(known, F.col("n"))).cast("double"), F.count_if(known)).alias("rows_per_contract_mean"),
        F.sum("s").alias("driver_level_premium_sum"),
        F.sum("m").alias("policy_level_premium_sum"),
        F.when(F.sum("m") > 0, F.sum("s") / F.sum("m")).alias("premium_duplication_factor"),
    )
