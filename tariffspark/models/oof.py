"""Out-of-fold predictions: every row is scored by a model that never saw its group."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.operators.split import group_folds
from tariffspark.session import materialize
from tariffspark.sources.tables import read_json, write_json

FOLD_KEY = "_fold_key"


def with_fold_key(df: DataFrame) -> DataFrame:
    """``df`` with a key made of the whole row: what folds are dealt by where no group column serves. Equal rows share a fold."""
    return df.withColumn(FOLD_KEY, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256))


def fingerprint(df: DataFrame) -> str:
    """Rows and an order-free sum of their hashes: another table gives another text."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))).first()
    return f"{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in sorted(df.schema.fields, key=lambda f: f.name))}|{row[0]}|{row[1]}"


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], folds: int = 5, group: str | None = "contract_number",
                resume_path: str | None = None, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """``fit(train)`` returns a scoring function; its output on the held-out folds is put together.

    Without the group column, or with one group only, folds are dealt by row. Each fold's predictions are
    written as soon as they exist. With a ``resume_path`` a fold is read instead of fitted if its manifest
    names the same input, the same rule of folds and the same ``settings``; the manifest is written last,
    so a fold that was cut off counts as absent.
    """
    spark = df.sparkSession
    labelled = materialize(group_folds(with_fold_key(df), folds, group, FOLD_KEY).drop(FOLD_KEY), "folds")
    numbers = sorted(r[0] for r in labelled.select("fold").distinct().collect())
    rule = {"folds": folds, "group": group, "settings": json.dumps(settings, sort_keys=True, default=str)}
    if resume_path:
        rule["input"] = fingerprint(df)
    parts = []
    for i in numbers:
        path = f"{resume_path}/fold={i}" if resume_path else None
        if path and manifest_of(spark, f"{path}/manifest") == rule:
            parts.append(spark.read.parquet(f"{path}/rows"))
            continue
        score = fit(labelled.where(F.col("fold") != i).drop("fold"))
        out = score(labelled.where(F.col("fold") == i).drop("fold"))
        if path:
            # First the old manifest goes, so that no crash leaves new rows under it.
            write_json(spark, f"{path}/manifest", {"writing": True})
            out.write.mode("overwrite").parquet(f"{path}/rows")
            write_json(spark, f"{path}/manifest", rule)
            parts.append(spark.read.parquet(f"{path}/rows"))
        else:
            parts.append(materialize(out, f"fold{i}"))
    return reduce(DataFrame.unionByName, parts)


def manifest_of(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """What a finished fold was made from; None where nothing, or nothing whole, is at ``path``."""
    try:
        return read_json(spark, path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    except TypeError:  # an empty folder: the write was cut off
        return None
