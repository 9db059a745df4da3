"""Column-level preparation: imputation, winsorising, categories and their encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffspark.functions.columns import clean_numeric_like, clip, date_part, key_hash, key_text, number_as_text, to_number
from tariffspark.operators.profile import wide_to_long
from tariffspark.operators.quantiles import exact_quantiles
from tariffspark.roles import AMOUNT, CLAIM, COUNT, PREMIUM, PREMIUM_NET, is_numeric
from tariffspark.session import materialize

FINANCIAL = (PREMIUM, PREMIUM_NET, AMOUNT, COUNT)
NUMERIC_LIKE = ("bonus_malus", "car_year")
DATE_PARTS = ("month", "quarter", "dayofweek", "is_month_end", "sin_month", "cos_month")
BROADCAST_ROWS = 200_000
MISSING, OTHER = "missing", "other"


# -- numeric-like text ------------------------------------------------------------

def clean_numeric_columns(df: DataFrame, columns: Sequence[str] = NUMERIC_LIKE) -> DataFrame:
    """Clean the numeric-like columns: numeric ones become double, text ones canonical number text."""
    for field in df.schema.fields:
        if field.name in columns:
            numeric = is_numeric(field.dataType)
            # The number first, as a column of its own: its text refers to it several times.
            df = df.withColumn(field.name, F.col(field.name).cast("double") if numeric else clean_numeric_like(F.col(field.name), field.name))
            if not numeric:
                df = df.withColumn(field.name, number_as_text(F.col(field.name)))
    return df


def numeric_like_stats(df: DataFrame, columns: Sequence[str] = NUMERIC_LIKE) -> DataFrame:
    """Per column: non-null, unreadable before cleaning, rescued by it, lost to missing."""
    present = [c for c in columns if c in df.columns]
    aggregates = []
    for c in present:
        raw, clean, given = to_number(F.col(c)), clean_numeric_like(F.col(c), c), F.col(c).isNotNull()
        aggregates += [
            F.count(c).alias(f"non_null__{c}"),
            F.count_if(given & raw.isNull()).alias(f"non_numeric_before__{c}"),
            F.count_if(given & raw.isNull() & clean.isNotNull()).alias(f"rescued__{c}"),
            F.count_if(given & clean.isNull()).alias(f"coerced_to_missing__{c}"),
        ]
    return wide_to_long(df.agg(*aggregates), present, ["non_null", "non_numeric_before", "rescued", "coerced_to_missing"])


# -- numbers ----------------------------------------------------------------------

def fit_fill_values(df: DataFrame, columns: Sequence[str], strategy: str = "median", financial: float = 0.0) -> dict[str, float]:
    """Fill value per column: a constant for money, else the median (0 for an empty column)."""
    ordinary = [c for c in columns if c not in FINANCIAL]
    medians = exact_quantiles(df, {c: [0.5] for c in ordinary}) if strategy == "median" and ordinary else {}
    return {c: float(financial) if c in FINANCIAL else float((medians.get(c) or [0.0])[0] or 0.0) for c in columns}


def impute(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()})


def fit_missing_flags(df: DataFrame, columns: Sequence[str], threshold: float = 0.05) -> list[str]:
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row["_n"] and (row["_n"] - row[c]) / row["_n"] > threshold]


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in columns})


def fit_winsor_bounds(filled: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> dict[str, tuple[float, float]]:
    """Quantile bounds of already filled columns."""
    found = exact_quantiles(filled, {c: sorted((low, high)) for c in columns})
    return {c: (v[0], v[1]) if v[0] is not None else (0.0, 0.0) for c, v in found.items()}


def winsorize(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clip to the fitted bounds; premiums are left as they are."""
    return df.withColumns({c: clip(F.col(c), *b) for c, b in bounds.items() if c not in (PREMIUM, PREMIUM_NET)})


def log1p_columns(df: DataFrame, columns: Sequence[str] = (PREMIUM, PREMIUM_NET)) -> DataFrame:
    return df.withColumns({f"{c}_log1p": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in columns})


def date_features(df: DataFrame, column: str, parts: Sequence[str] = DATE_PARTS) -> DataFrame:
    ts = F.col(column).try_cast("timestamp_ntz")
    return df.withColumns({f"{column}_{p}": date_part(ts, p) for p in parts})


# -- categories -------------------------------------------------------------------

def category_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, category, n) of all text columns from one shuffle of the distinct values."""
    return (
        df.select(*[category_text(F.col(c)).alias(c) for c in columns])
        .unpivot([], list(columns), "feature", "category")
        .groupBy("feature", "category").agg(F.count("*").alias("n"))
    )


@dataclass
class CategoryTotals:
    """What one small aggregation over the counted values tells: rows, and the columns without a common value."""

    rows: int
    lacking: list[str]


def category_totals(counts: DataFrame, share: float, least: int) -> CategoryTotals:
    per = counts.groupBy("feature").agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).collect()
    rows = max((int(r["rows"]) for r in per), default=0)
    return CategoryTotals(rows, [r["feature"] for r in per if r["largest"] / rows < share and r["largest"] < least])


def is_kept(counts: DataFrame, totals: CategoryTotals, share: float = 0.005, least: int = 200, fallback: int = 20) -> Column:
    """Common by share or by count; a column without any common value keeps its ``fallback`` largest."""
    common = (F.col("n") / F.lit(float(max(totals.rows, 1))) >= share) | (F.col("n") >= least)
    if not totals.lacking:
        return common
    # A distributed top-k per column; at most ``fallback`` values of each come back.
    for feature in totals.lacking:
        top = counts.where(F.col("feature") == feature).orderBy(F.desc("n"), "category").limit(fallback).collect()
        common = common | ((F.col("feature") == feature) & F.col("category").isin([r["category"] for r in top]))
    return common


def target_encoding(sums: DataFrame, mean: Column, smoothing: float = 20.0, min_leaf: int = 100) -> DataFrame:
    """Add ``te`` to rows with ``n`` and ``s`` (target sum): the category mean pulled towards ``mean``.

    The pull doubles for categories with fewer than ``min_leaf`` rows.
    """
    pull = F.lit(max(float(smoothing), 0.0))
    if min_leaf > 0:
        pull = F.when(F.col("n") < min_leaf, pull * F.lit(2.0)).otherwise(pull)
    weight = F.col("n") + pull
    value = (F.col("s") / F.col("n") * F.col("n") + mean * pull) / F.when(weight == 0, F.lit(1.0)).otherwise(weight)
    return sums.withColumn("te", value)


@dataclass
class CategoryState:
    """Lookup of one fit: per (feature, category) the frequency and the target encoding."""

    lookup: DataFrame
    target_mean: float
    rows: int
    lookup_rows: int
    features: list[str]


def fit_categories(df: DataFrame, columns: Sequence[str], target: str = CLAIM, share: float = 0.005, least: int = 200,
                   smoothing: float = 20.0, min_leaf: int = 100) -> CategoryState:
    """Kept values, frequencies and target encodings of all text columns in one shuffle.

    Values that are not kept fold into ``other`` before the encodings are fitted.
    """
    columns = list(columns)
    y = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    long = (
        df.select(y.alias("_y"), *[category_text(F.col(c)).alias(c) for c in columns])
        .unpivot(["_y"], columns, "feature", "category")
        .groupBy("feature", "category").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))
    )
    counts = materialize(long, "categories")
    totals = category_totals(counts, share, least)
    own = counts.where(F.col("feature") == columns[0]) if columns else counts
    mean = float(own.agg(F.sum("s")).first()[0] or 0.0) / max(totals.rows, 1)
    name = F.when(is_kept(counts, totals, share, least), F.col("category")).otherwise(F.lit(OTHER))
    folded = counts.groupBy("feature", name.alias("category")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    encoded = target_encoding(folded, F.lit(mean), smoothing, min_leaf).withColumn("freq", F.col("n") / F.lit(float(max(totals.rows, 1))))
    lookup = materialize(encoded.select("feature", "category", "n", "s", "te", "freq"), "lookup")
    return CategoryState(lookup, mean, totals.rows, lookup.count(), columns)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a lookup only when its counted size allows; otherwise Spark shuffles (and splits skewed keys)."""
    return F.broadcast(df) if rows <= limit else df


def fold_and_encode(df: DataFrame, state: CategoryState, columns: Sequence[str], target_columns: Sequence[str] = (),
                    frequency_columns: Sequence[str] = ()) -> DataFrame:
    """Fold rare values into ``other`` and add ``<c>_te`` / ``<c>_freq``; one lookup join per column.

    A value never seen in the fit is ``other``; if the fit had no ``other`` it
    gets the global mean and frequency 0.
    """
    known = set(state.features)
    others = {r["feature"]: r for r in state.lookup.where(F.col("category") == OTHER).collect()}
    for c in columns:
        if c not in known:
            continue
        own = state.lookup.where(F.col("feature") == c)
        slim = own.select(F.col("category").alias("_k"), F.col("te").alias("_te"), F.col("freq").alias("_freq"))
        text = category_text(F.col(c))
        df = df.withColumn(c, text).join(maybe_broadcast(slim, state.lookup_rows), F.col(c) == F.col("_k"), "left")
        unseen = F.col("_k").isNull()
        te_other, freq_other = (others[c]["te"], others[c]["freq"]) if c in others else (state.target_mean, 0.0)
        df = df.withColumn(c, F.when(unseen, F.lit(OTHER)).otherwise(F.col(c)))
        if c in target_columns:
            df = df.withColumn(f"{c}_te", F.coalesce("_te", F.lit(float(te_other))))
        if c in frequency_columns:
            df = df.withColumn(f"{c}_freq", F.coalesce("_freq", F.lit(float(freq_other))))
        df = df.drop("_k", "_te", "_freq")
    return df


def fold_of(group: Column, folds: int) -> Column:
    """Fold of a group key: every row of a group lands in the same fold."""
    return F.pmod(key_hash(group), F.lit(int(folds))).cast("int")


def out_of_fold_encoding(df: DataFrame, columns: Sequence[str], folds: int = 5, group: str | None = None, target: str = CLAIM,
                         smoothing: float = 20.0, min_leaf: int = 100, noise_std: float = 0.0, seed: int = 42,
                         row_key: str | None = None) -> DataFrame:
    """``<c>_te`` for each row from the other folds only.

    Sums per (category, fold) are taken once; what lies outside a fold is the
    total minus the fold's own part, so no pass per fold is needed.  Categories
    of ``columns`` must already be folded text.
    """
    columns = list(columns)
    key = key_text(F.col(group)) if group else key_text(F.col(row_key))
    y = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    work = df.withColumn("_fold", fold_of(key, folds)).withColumns({c: category_text(F.col(c)) for c in columns})
    sums = (
        work.select("_fold", y.alias("_y"), *columns).unpivot(["_fold", "_y"], columns, "feature", "category")
        .groupBy("feature", "category", "_fold").agg(F.count("*").alias("n_f"), F.sum("_y").alias("s_f"))
    )
    # ``folds`` rows: what each fold leaves behind.
    per_fold = {r["_fold"]: (r["n"], r["s"]) for r in work.groupBy("_fold").agg(F.count("*").alias("n"), F.sum(y).alias("s")).collect()}
    n_all, s_all = sum(v[0] for v in per_fold.values()), sum(v[1] for v in per_fold.values())
    if n_all < 2 or len(per_fold) < 2:
        mean = s_all / n_all if n_all else 0.0
        return df.withColumns({f"{c}_te": F.lit(float(mean)) for c in columns})
    outside = {f: (s_all - s) / (n_all - n) if n_all > n else s_all / n_all for f, (n, s) in per_fold.items()}
    fold_mean = reduce(lambda acc, f: acc.when(F.col("_fold") == f, F.lit(float(outside[f]))), sorted(outside), F.when(F.lit(False), F.lit(0.0)))
    totals = sums.groupBy("feature", "category").agg(F.sum("n_f").alias("n_t"), F.sum("s_f").alias("s_t"))
    rest = (
        sums.join(totals, ["feature", "category"])
        .select("feature", "category", "_fold", (F.col("n_t") - F.col("n_f")).alias("n"), (F.col("s_t") - F.col("s_f")).alias("s"))
    )
    encoded = target_encoding(rest.where("n > 0"), fold_mean, smoothing, min_leaf)
    lookup = materialize(encoded.select("feature", "category", "_fold", "te"), "oof")
    size = lookup.count()
    for c in columns:
        slim = lookup.where(F.col("feature") == c).select(F.col("category").alias("_k"), F.col("_fold").alias("_kf"), F.col("te").alias("_te"))
        work = (
            work.join(maybe_broadcast(slim, size), (F.col(c) == F.col("_k")) & (F.col("_fold") == F.col("_kf")), "left")
            .withColumn(f"{c}_te", F.coalesce("_te", fold_mean)).drop("_k", "_kf", "_te")
        )
        if noise_std > 0:
            work = work.withColumn(f"{c}_te", F.col(f"{c}_te") + F.randn(seed) * F.lit(float(noise_std)))
    return work.drop("_fold")
