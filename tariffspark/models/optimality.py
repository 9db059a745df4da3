"""Proof that a penalised fit is the optimum: its score equations, which are zero there and nowhere else."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_equations(vectors: DataFrame, residual: Column, coefficients: Sequence[float], penalty: float) -> tuple[int, np.ndarray]:
    """(rows, equations): per feature mean of residual x feature plus penalty x coefficient; last the intercept's, which has no penalty.

    One aggregation returns two rows, as sums over positive and negative residuals are taken apart.
    """
    signed = vectors.select("features", residual.alias("r"))
    total = Summarizer.metrics("sum").summary(F.col("features"), F.abs(F.col("r"))).alias("s")
    parts = signed.groupBy((F.col("r") > 0).alias("above")).agg(total, F.sum("r").alias("r"), F.count("*").alias("n")).collect()
    n = sum(p["n"] for p in parts)
    slopes = sum((1.0 if p["above"] else -1.0) * p["s"]["sum"].toArray() for p in parts) / n + penalty * np.asarray(coefficients, float)
    return n, np.append(slopes, sum(p["r"] for p in parts) / n)
