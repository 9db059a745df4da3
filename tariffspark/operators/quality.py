"""Validation rules and data-quality tables.

Every check returns rows of (rule, feature, severity, measure); severity is
``ok``, ``warning`` or ``error``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.roles import AMOUNT, CLAIM, CONTRACT, COUNT, PREMIUM, PREMIUM_NET, REQUIRED, UNIQUE_ID

STRICT_COLUMNS = (PREMIUM, PREMIUM_NET, CLAIM)
CLAIM_COLUMNS = (AMOUNT, COUNT)
NON_NEGATIVE = (PREMIUM, PREMIUM_NET, COUNT, AMOUNT)


def missing_columns(df: DataFrame, required: list[str] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def one_row_to_long(row: DataFrame, name: str, value: str) -> DataFrame:
    """A one-row wide aggregate as (name, value) rows."""
    return row.unpivot([], row.columns, name, value)


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, null_rate) for all columns from one aggregation of plain counts."""
    wanted = list(columns or df.columns)
    counted = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in wanted]).unpivot(["_n"], wanted, "feature", "known")
    return counted.select("feature", null_share())


def null_share() -> Column:
    return F.when(F.col("_n") > 0, (F.col("_n") - F.col("known")) / F.col("_n")).alias("null_rate")


def _rows(rule: str, long: DataFrame, severity: Column, measure: str) -> DataFrame:
    return long.select(F.lit(rule).alias("rule"), "feature", severity.alias("severity"), F.col(measure).cast("double").alias("measure"))


def _count_rules(df: DataFrame, required: list[str] = REQUIRED) -> dict[str, list[tuple[str, Column, Column]]]:
    """Rules that are counts over the rows: rule -> (feature, measure, severity) over one aggregated row.

    The aggregates they need are named ``known__c``, ``negative__c`` and ``bad__c``.
    """
    n = F.col("n").cast("double")
    rules: dict[str, list[tuple[str, Column, Column]]] = {"required_column": [], "null_rate": [], "binary_domain": [], "negative_values": []}
    for c in required:
        present = c in df.columns
        rules["required_column"].append((c, n if present else F.lit(0.0), F.lit("ok" if present else "error")))
    if missing_columns(df, required):
        return rules
    for c in STRICT_COLUMNS + CLAIM_COLUMNS:
        rate = F.when(n > 0, (F.col("n") - F.col(f"known__{c}")) / F.col("n"))
        strict = F.when(rate > 0.4, "error").when(rate > 0.1, "warning").otherwise("ok")
        rules["null_rate"].append((c, rate, strict if c in STRICT_COLUMNS else F.when(rate > 0.99, "warning").otherwise("ok")))
    found = lambda name: F.when(F.col(name) > 0, "error").otherwise("ok")
    rules["binary_domain"].append((CLAIM, F.col(f"bad__{CLAIM}").cast("double"), found(f"bad__{CLAIM}")))
    for c in NON_NEGATIVE:
        rules["negative_values"].append((c, F.col(f"negative__{c}").cast("double"), found(f"negative__{c}")))
    return rules


def _counted(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Everything the count rules need, from one pass over the rows."""
    if missing_columns(df, required):
        return df.agg(F.count("*").alias("n"))
    flag = F.col(CLAIM)
    return df.agg(
        F.count("*").alias("n"), *[F.count(c).alias(f"known__{c}") for c in STRICT_COLUMNS + CLAIM_COLUMNS],
        F.count_if(flag.isNotNull() & ~flag.isin(0, 1)).alias(f"bad__{CLAIM}"),
        *[F.count_if(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) < 0).alias(f"negative__{c}") for c in NON_NEGATIVE])


def _checks(df: DataFrame, wanted: tuple[str, ...] | None = None, required: list[str] = REQUIRED) -> DataFrame:
    rows = [F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("feature"), severity.alias("severity"), measure.alias("measure"))
            for rule, items in _count_rules(df, required).items() if wanted is None or rule in wanted for c, measure, severity in items]
    return _counted(df, required).select(F.inline(F.array(*rows)))


def check_required(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """One row per required column; the measure counts the rows that carry it."""
    return _checks(df, ("required_column",), required)


def check_null_rates(df: DataFrame) -> DataFrame:
    """Strict columns: error above 0.4, warning above 0.1.  Claim columns: warning above 0.99."""
    return _checks(df, ("null_rate",))


def bad_binary_values(df: DataFrame, column: str = CLAIM) -> DataFrame:
    """(value, n) for values other than 0 and 1; a table, since there may be many."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(0, 1))
        .groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    )


def check_binary(df: DataFrame) -> DataFrame:
    """Rows whose claim flag is neither 0, 1 nor null; ``bad_binary_values`` lists the values."""
    return _checks(df, ("binary_domain",))


def check_negative(df: DataFrame) -> DataFrame:
    return _checks(df, ("negative_values",))


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of each key (a null key is one more key), as one row ``duplicates``.

    Counting per key combines map-side, so a heavily repeated key is cheap.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def check_duplicates(df: DataFrame, key: str = UNIQUE_ID) -> DataFrame:
    long = duplicate_count(df, key).select(F.lit(key).alias("feature"), "duplicates")
    return _rows("duplicate_id", long, F.when(F.col("duplicates") > 0, "warning").otherwise("ok"), "duplicates")


def validate(df: DataFrame) -> DataFrame:
    """All rules: one pass for the counts, one aggregation for the ids; without the required columns only their rule runs."""
    counted = _checks(df)
    if missing_columns(df) or UNIQUE_ID not in df.columns:
        return counted
    return counted.unionByName(check_duplicates(df))


def verdict(report: DataFrame) -> DataFrame:
    """``ok`` is 1 when no rule ended in an error."""
    return report.agg(
        F.when(F.count_if(F.col("severity") == "error") == 0, 1).otherwise(0).alias("ok"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def require_valid(df: DataFrame) -> None:
    """Raise when the table breaks an error-level rule."""
    errors = [f"{r['rule']}:{r['feature']}" for r in validate(df).where("severity = 'error'").collect()]
    if errors:
        raise ValueError(f"validation failed: {errors}")


def quality_report(layers: Mapping[str, DataFrame], top: int | None = None) -> DataFrame:
    """Shape and the null rates of each layer, highest first, or the ``top`` highest."""
    parts = []
    for name, df in layers.items():
        wide = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in df.columns])
        parts.append(wide.unpivot(["_n"], df.columns, "feature", "known").select(
            F.lit(name).alias("layer"), F.col("_n").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            "feature", null_share()))
    # One row per column of each layer: a window over metadata, not over data.
    ranked = reduce(DataFrame.unionByName, parts).withColumn(
        "rank", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("null_rate"), "feature")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def duplicate_contracts(df: DataFrame, contract: str = CONTRACT) -> DataFrame:
    return duplicate_count(df, contract)
