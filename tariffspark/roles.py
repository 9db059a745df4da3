"""Column roles of the driver-grain and policy-grain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of the insurance data contract.
CONTRACT = "contract_number"
UNIQUE_ID = "unique_id"
PREMIUM = "premium"
PREMIUM_NET = "premium_wo_term"
CLAIM = "is_claim"
AMOUNT = "claim_amount"
COUNT = "claim_cnt"
OPERATION_DATE = "operation_date"
DRIVER_COUNT = "driver_count"
ROW_KEY = "row_key"

IDENTIFIERS = ["unique_id", "driver_iin", "insurer_iin", "car_number"]
TARGETS = [CLAIM, AMOUNT, COUNT]
FORBIDDEN = [UNIQUE_ID, CONTRACT, "driver_iin", "insurer_iin", "car_number"]
REQUIRED = [PREMIUM, PREMIUM_NET, CLAIM, AMOUNT, COUNT]
SCORE_PREFIX = "SCORE_"
PREDICTION = ["p_claim", "expected_severity", "expected_loss"]


def is_numeric(data_type: T.DataType) -> bool:
    """Booleans count as numeric, both when aggregating and when modelling."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in set(exclude)]


def string_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in set(exclude)]


def date_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in set(exclude)]
