"""Penalised linear fits by Newton steps over the rows as they lie.

A step is one pass: the task makes the vectors from the columns, chunk by chunk, and returns sums whose size is
places x places, whatever the rows. Nothing is kept between the passes, neither in memory nor on disk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoderModel, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOLERANCE = 1e-8    # of the largest score equation, at which the steps end
ACCEPTED = 1e-6     # and that after the last step
STEPS = 25
CHUNK_ROWS = 4096
MERGED = 8          # tasks that add up the sums of all others before they reach the driver


@dataclass
class Rows:
    """Rows (y, weight, numbers, categories) and how a task makes their vectors: scaled numbers, then a place per label, in order."""

    df: DataFrame
    numeric: list[str]
    scale: list[float]
    categorical: list[str] = field(default_factory=list)
    labels: list[list[str]] = field(default_factory=list)
    vector: str | None = None

    @property
    def width(self) -> int:
        return len(self.scale) + sum(map(len, self.labels))


def rows_of(df: DataFrame, matrix: PipelineModel, y: Column, weight: Column | None = None) -> Rows | None:
    """What ``matrix`` makes of ``df``, as columns; None where it holds a stage that has no place per label."""
    numeric, scale, categorical, labels = [], [], [], []
    for stage in matrix.stages:
        if isinstance(stage, SQLTransformer):
            df = stage.transform(df)
        elif isinstance(stage, ElementwiseProduct):
            scale = [float(x) for x in stage.getScalingVec()]
        elif isinstance(stage, VectorAssembler):
            numeric = numeric or [c for c in stage.getInputCols() if c != "_scaled" and not c.endswith("__hot")]
        elif isinstance(stage, StringIndexerModel):
            categorical, labels = list(stage.getInputCols()), [list(x) for x in stage.labelsArray]
        elif not isinstance(stage, OneHotEncoderModel):
            return None
    return _rows(df, y, weight, numeric, scale or [1.0] * len(numeric), categorical, labels)


def rows_of_vectors(vectors: DataFrame, y: Column, width: int, weight: Column | None = None) -> Rows:
    """The same for rows that hold finished ``features``."""
    df = vectors.select(y.cast("double").alias("y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w"), vector_to_array("features").alias("x"))
    return Rows(df, [], [1.0] * width, vector="x")


def _rows(df, y, weight, numeric: Sequence[str], scale, categorical: Sequence[str], labels) -> Rows:
    columns = [F.col(f"`{c}`").cast("double").alias(f"n{i}") for i, c in enumerate(numeric)] + [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(categorical)]
    df = df.select(y.cast("double").alias("y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w"), *columns)
    return Rows(df, list(numeric), list(scale), list(categorical), labels)


def _maker(rows: Rows):
    """(batch) -> (numbers and a one, code per category column); for use inside tasks."""
    scale, sets, width, vector = np.asarray(rows.scale), rows.labels, len(rows.scale), rows.vector

    def made(batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        n = batch.num_rows
        out = np.ones((n, width + 1))
        if vector is not None:
            out[:, :width] = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
        else:
            for i in range(width):
                out[:, i] = batch.column(2 + i).to_numpy(zero_copy_only=False)
            out[:, :width] *= scale
        codes = [pc.fill_null(pc.index_in(batch.column(2 + width + i), value_set=pa.array(s, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                 for i, s in enumerate(sets)]
        return out, codes

    return made


def _curvature(numbers, codes, sizes, starts, h):
    """Sum of h x x' over the rows, the places of numbers and the one first; pairs of categories are counted, not multiplied."""
    width = numbers.shape[1]
    total = width + sum(sizes)
    out, weighted = np.zeros((total, total)), numbers * h[:, None]
    out[:width, :width] = numbers.T @ weighted
    if codes:
        hot = np.zeros((len(h), total - width))
        for code, start in zip(codes, starts):
            known = np.flatnonzero(code >= 0)
            hot[known, start + code[known]] = 1.0
        out[width:, :width] = hot.T @ weighted
        out[:width, width:] = out[width:, :width].T
        for i, (a, at, size) in enumerate(zip(codes, starts, sizes)):
            for b, bt, other in zip(codes[i:], starts[i:], sizes[i:]):
                known = (a >= 0) & (b >= 0)
                both = np.bincount(a[known] * other + b[known], weights=h[known], minlength=size * other).reshape(size, other)
                out[width + at:width + at + size, width + bt:width + bt + other] = both
                out[width + bt:width + bt + other, width + at:width + at + size] = both.T
    return out


def _sums(rows: Rows, beta: np.ndarray, loss: str) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(rows, loss, gradient, curvature) at ``beta``, whose places are numbers, the one, categories."""
    made, sizes = _maker(rows), [len(s) for s in rows.labels]
    starts, width = np.cumsum([0, *sizes[:-1]]).tolist() if sizes else [], len(rows.scale) + 1
    total = width + sum(sizes)

    def sums(batches):
        import pyarrow as pa

        count, value, gradient, curvature = 0, 0.0, np.zeros(total), np.zeros((total, total))
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(at, CHUNK_ROWS)
                y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                numbers, codes = made(batch)
                eta = numbers @ beta[:width]
                for code, start, size in zip(codes, starts, sizes):
                    eta += np.append(beta[width + start:width + start + size], 0.0)[code]
                if loss == "logistic":
                    p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700.0, 700.0)))
                    r, h = w * (p - y), w * p * (1.0 - p)
                    value += float((w * (np.logaddexp(0.0, eta) - y * eta)).sum())
                else:
                    r, h = w * (eta - y), w
                    value += float((r * (eta - y)).sum() / 2.0)
                count += len(y)
                gradient[:width] += numbers.T @ r
                for code, start, size in zip(codes, starts, sizes):
                    gradient[width + start:width + start + size] += np.bincount(code + 1, weights=r, minlength=size + 1)[1:]
                curvature += _curvature(numbers, codes, sizes, starts, h)
        if count:
            yield pa.record_batch([pa.array([np.concatenate([[count, value], gradient, curvature.ravel()]).tobytes()], pa.binary())], names=["sums"])

    def added(batches):
        import pyarrow as pa

        out = None
        for batch in batches:
            for one in batch.column(0).to_pylist():
                out = np.frombuffer(one) if out is None else out + np.frombuffer(one)
        if out is not None:
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    found = rows.df.mapInArrow(sums, "sums binary").repartition(MERGED).mapInArrow(added, "sums binary").collect()
    whole = sum((np.frombuffer(r[0]) for r in found), np.zeros(2 + total + total * total))
    return int(whole[0]), float(whole[1]), whole[2:2 + total], whole[2 + total:].reshape(total, total)


def newton(rows: Rows, loss: str, penalty: float, steps: int = STEPS, tolerance: float = TOLERANCE, accepted: float = ACCEPTED) -> tuple[np.ndarray, float] | None:
    """(coefficients, intercept) that minimise the loss plus half the penalty times the sum of squares, proved by the score equations.

    The intercept has no penalty. A step that does not lower the loss is halved. None where the steps do not get there.
    """
    width, total = len(rows.scale), rows.width + 1
    ridge = np.full(total, penalty)
    ridge[width] = 0.0
    beta, step, best = np.zeros(total), None, None
    for _ in range(steps + 1):
        n, value, gradient, curvature = _sums(rows, beta, loss)
        if not n:
            return None
        value += float((ridge * beta * beta).sum() / 2.0)
        gradient = gradient + ridge * beta
        worst = float(np.abs(gradient).max() / n)
        if best is not None and (not np.isfinite(value) or value > best[1] + 1e-9 * abs(best[1])):
            step = step / 2.0
            beta = best[2] + step
            continue
        if not np.isfinite(gradient).all() or not np.isfinite(curvature).all():
            return None
        # At the end of the digits the loss says no more; the best place seen is the one with the smallest equations.
        if best is not None and best[0] <= accepted and worst >= best[0]:
            break
        best = (worst, value, beta)
        if worst <= tolerance:
            break
        try:
            step = -np.linalg.solve(curvature + np.diag(ridge), gradient)
        except np.linalg.LinAlgError:
            return None
        beta = beta + step
    worst, _, beta = best
    if worst > accepted:
        return None
    return np.delete(beta, width), float(beta[width])


def logistic_model(spark: SparkSession, coefficients: np.ndarray, intercept: float) -> LogisticRegressionModel:
    """Spark's model of given coefficients."""
    return LogisticRegressionModel(_java(spark, "classification.LogisticRegressionModel", "logreg", coefficients, intercept))


def linear_model(spark: SparkSession, coefficients: np.ndarray, intercept: float) -> LinearRegressionModel:
    return LinearRegressionModel(_java(spark, "regression.LinearRegressionModel", "linReg", coefficients, intercept))


def _java(spark: SparkSession, name: str, prefix: str, coefficients: np.ndarray, intercept: float):
    sc = spark.sparkContext
    made = sc._jvm
    for part in ("org", "apache", "spark", "ml", *name.split(".")):
        made = getattr(made, part)
    return made(f"{prefix}_{uuid4().hex[:12]}", _py2java(sc, Vectors.dense(coefficients)), float(intercept))
