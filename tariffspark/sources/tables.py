"""Reading and writing tables: CSV with a header, Parquet, append-only logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffspark.functions.columns import key_hash, key_text


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV.  Give a schema for large files: inference costs a second pass."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows of an explicit order (a table has no file order); a distributed top-k."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows, the same ones on every run: the smallest seeded hashes of the key."""
    return (
        df.withColumn("_h", key_hash(key_text(F.col(key)), f"{seed}:"))
        .orderBy("_h", key)
        .limit(n)
        .drop("_h")
    )


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """Map-side sample by the same hash; no sort, for when the exact size does not matter."""
    return df.where(key_hash(key_text(F.col(key)), f"{seed}:") < F.lit(int(fraction * 4294967296)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def append_leaderboard(spark: SparkSession, path: str, row: Mapping[str, Any]) -> None:
    """Append one run; a new metric becomes a new column (older runs read it as null).

    Every row has a folder of its own: two jobs that append to one folder would
    delete each other's temporary files.
    """
    stamped = {"finished_at": datetime.now(UTC).replace(tzinfo=None), **row}
    spark.createDataFrame([stamped]).coalesce(1).write.mode("error").parquet(f"{path}/entry=e-{uuid.uuid4().hex}")


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """All finished runs, one row each."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("entry")


def latest_run(spark: SparkSession, path: str) -> str:
    """Run id of the newest leaderboard row."""
    return read_leaderboard(spark, path).agg(F.max_by("run_id", F.struct("finished_at", "run_id"))).first()[0]


def run_metrics(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return read_leaderboard(spark, path).where(F.col("run_id") == run_id)


def read_feature_list(spark: SparkSession, path: str | None) -> set[str]:
    """Names in the ``feature`` column of a CSV; a missing file or column is an empty list."""
    if not path:
        return set()
    try:
        listed = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    if "feature" not in listed.columns:
        return set()
    return {r[0] for r in listed.select("feature").dropna().distinct().collect()}


def write_json(spark: SparkSession, path: str, payload: Mapping[str, Any]) -> None:
    """Small fitted state as one JSON line in a folder (works on any Hadoop file system)."""
    text = json.dumps(payload, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()[0])
