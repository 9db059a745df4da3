"""Repricing of a record stream with a fixed model and a fixed tariff.

Every step is stateless per record (the tariff carries the fitted mean loss), so
the stream needs no watermark and gives the prices of the batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tariffspark.operators.pricing import PricingPolicy
from tariffspark.operators.score import reprice


def read_records(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def reprice_stream(records: DataFrame, policy: PricingPolicy, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Priced stream; ``score`` adds the expected loss where the records do not carry it."""
    if policy.kind == "scalar" and policy.mean_loss is None:
        raise ValueError("a streamed tariff needs the fitted mean loss")
    if policy.kind == "stratified" and any(p.get("mean_expected_loss") is None for p in policy.bucket_params):
        raise ValueError("a streamed tariff needs the fitted mean loss of every bucket")
    return reprice(score(records) if score else records, policy)


def write_prices(priced: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once per record, until the records at hand are used up."""
    return (priced.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
