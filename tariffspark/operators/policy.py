"""Grain change: driver rows to one row per policy and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffspark.functions.columns import to_number
from tariffspark.roles import (
    AMOUNT, CLAIM, CONTRACT, COUNT, DRIVER_COUNT, IDENTIFIERS, OPERATION_DATE, PREMIUM, PREMIUM_NET, ROW_KEY,
    SCORE_PREFIX, TARGETS, UNIQUE_ID, is_numeric,
)


def _first_present(column: str, order_key: str) -> Column:
    """First non-null value in key order; every column picks its own row."""
    return F.expr(f"min_by(`{column}`, `{order_key}`) FILTER (WHERE `{column}` IS NOT NULL)").alias(column)


def aggregate_to_policy(
    df: DataFrame,
    contract: str = CONTRACT,
    order_key: str = ROW_KEY,
    targets: str = "max",
) -> DataFrame:
    """One row per contract in a single aggregation (null contracts form one group).

    Premiums take the maximum, targets the maximum (or with ``targets="sum"``
    the sum of amounts and counts, and the latest date), scores keep their name,
    other numbers become ``<name>_mean`` and the rest take the first non-null
    value.  Every function combines map-side, so a contract that holds a large
    share of the rows costs one partial row per task.
    """
    if contract not in df.columns:
        return df
    summed = targets == "sum"
    aggregates: list[Column] = [F.count("*").alias(DRIVER_COUNT)]
    for field in df.schema.fields:
        name = field.name
        if name in (contract, order_key) or name in IDENTIFIERS:
            continue
        if name in (AMOUNT, COUNT) and summed:
            aggregates.append(F.sum(name).alias(name))
        elif name in (PREMIUM, PREMIUM_NET, *TARGETS) or (summed and name == OPERATION_DATE):
            aggregates.append(F.max(name).alias(name))
        elif is_numeric(field.dataType):
            alias = name if name.startswith(SCORE_PREFIX) else f"{name}_mean"
            aggregates.append(F.avg(F.col(name).cast("double")).alias(alias))
        else:
            aggregates.append(_first_present(name, order_key))
    return coerce_targets(df.groupBy(contract).agg(*aggregates))


def coerce_targets(df: DataFrame) -> DataFrame:
    """Claim flag to int, amount and count to double; null or unreadable means 0."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name, target in ((CLAIM, "int"), (COUNT, "double"), (AMOUNT, "double")):
        if name in kinds:
            number = F.col(name).cast("double") if is_numeric(kinds[name]) else to_number(F.col(name))
            df = df.withColumn(name, F.coalesce(number, F.lit(0.0)).cast(target))
    return df


def policy_to_rows(rows: DataFrame, policy: DataFrame, columns: list[str], contract: str = CONTRACT) -> DataFrame:
    """Left join policy results back to driver rows; null contracts match each other.

    The policy side has one row per contract.  A contract with very many rows
    is split by adaptive skew-join handling, which may divide the left side.
    """
    right = policy.select(F.col(contract).alias("_contract"), *columns)
    return rows.join(right, rows[contract].eqNullSafe(F.col("_contract")), "left").drop("_contract")


def submission(rows: DataFrame, priced: DataFrame, row_id: str = UNIQUE_ID, contract: str = CONTRACT) -> DataFrame:
    """Row-level prices; every input row must come out once and with a price."""
    return policy_to_rows(rows.select(row_id, contract), priced, ["new_premium"], contract).select(
        row_id, contract,
        F.coalesce("new_premium", F.raise_error(F.lit("row without a price")).cast("double")).alias("new_premium"),
    )


def check_submission(rows: DataFrame, out: DataFrame) -> None:
    """Raise unless ``out`` has exactly one priced row for every input row."""
    expected, got = rows.count(), out.agg(F.count("*"), F.count("new_premium")).first()
    if (expected, expected) != tuple(got):
        raise ValueError(f"submission holds {got[0]} rows, {got[1]} priced; expected {expected}")
