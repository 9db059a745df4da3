"""Folders of runs: everything is written under an attempt, and a run exists once its manifest does."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.sources.tables import append_leaderboard, read_json, read_leaderboard, write_json, write_table

MANIFEST = "manifest"


class Attempt:
    """One try at a run.  Two tries of the same run never write to the same folder, and readers see neither before it is published."""

    def __init__(self, spark: SparkSession, root: str, run_id: str) -> None:
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id
        self.path = f"{self.root}/runs/{run_id}/attempt-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def table(self, df: DataFrame, name: str, fmt: str = "parquet") -> None:
        write_table(df, f"{self.path}/{name}", fmt)
        self.tables[name] = fmt

    def state(self, payload: Mapping[str, Any], name: str) -> None:
        """Small fitted state as JSON."""
        write_json(self.spark, f"{self.path}/{name}", payload)

    def publish(self, record: Mapping[str, Any]) -> dict[str, Any]:
        """The manifest names the tables; the leaderboard row, written last, is what makes the run visible."""
        record = {"run_id": self.run_id, "path": self.path, **record}
        self.state({"run_id": self.run_id, "tables": self.tables}, MANIFEST)
        append_leaderboard(self.spark, f"{self.root}/leaderboard", record)
        return record


def published(spark: SparkSession, root: str) -> DataFrame:
    """The newest published attempt of every run; no row where nothing was published."""
    try:
        board = read_leaderboard(spark, f"{root.rstrip('/')}/leaderboard")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "run_id string, path string, finished_at timestamp")
    newest = F.max_by(F.struct(*[c for c in board.columns if c != "run_id"]), F.struct("finished_at", "path"))
    return board.groupBy("run_id").agg(newest.alias("_newest")).select("run_id", "_newest.*")


def run_path(spark: SparkSession, root: str, run_id: str) -> str:
    """Folder of a published run."""
    row = published(spark, root).where(F.col("run_id") == run_id).select("path").first()
    if row is None:
        raise LookupError(f"no published run {run_id} under {root}")
    return row[0]


def run_tables(spark: SparkSession, root: str, run_id: str) -> dict[str, str]:
    """Names of a published run's tables with their formats."""
    return read_json(spark, f"{run_path(spark, root, run_id)}/{MANIFEST}")["tables"]


def read_run_table(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame:
    """A table of a published run, as Parquet or as CSV with a header."""
    path = run_path(spark, root, run_id)
    tables = read_json(spark, f"{path}/{MANIFEST}")["tables"]
    if name not in tables:
        raise LookupError(f"run {run_id} has no table {name}")
    reader = spark.read.option("header", True) if tables[name] == "csv" else spark.read
    return reader.format(tables[name]).load(f"{path}/{name}")
