"""Model quality: exact AUC, Brier, severity errors, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.functions.columns import key_text, ratio
from tariffspark.operators.order import offsets, ranged
from tariffspark.roles import AMOUNT, CLAIM


def auc_exact(df: DataFrame, score: str = "p_claim", label: str = CLAIM) -> DataFrame:
    """One row (auc, gini, positives, negatives); tied scores count half, a single class gives null.

    Scores are counted first, so ties never meet in one task; the running count
    of negatives goes range by range.
    """
    y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    counted = df.groupBy(F.col(score).alias("score")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    ordered = ranged(counted, "score", label="auc")
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.col("_before_neg") + F.sum("neg").over(inside) - F.col("neg")
    pairs = (
        ordered.join(F.broadcast(offsets(ordered, "neg")), "_pid")
        .select("pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("u"))
        .agg(F.sum("u").alias("u"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    )
    auc = F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
                 F.col("u") / (F.col("positives").cast("double") * F.col("negatives").cast("double")))
    return pairs.select(auc.alias("auc"), (F.lit(2.0) * auc - F.lit(1.0)).alias("gini"), "positives", "negatives")


def brier(df: DataFrame, score: str = "p_claim", label: str = CLAIM) -> DataFrame:
    error = F.coalesce(F.col(label).cast("double"), F.lit(0.0)) - F.col(score)
    return df.agg(F.avg(error * error).alias("brier"))


def classification_metrics(df: DataFrame, score: str = "p_claim", label: str = CLAIM) -> DataFrame:
    """auc, gini and brier in one row."""
    return auc_exact(df, score, label).select("auc", "gini", brier(df, score, label).scalar().alias("brier"))


def severity_metrics(df: DataFrame, predicted: str = "expected_severity", amount: str = AMOUNT, label: str = CLAIM, log: bool = True) -> DataFrame:
    """rmse, mae and r2 on the claims (of log1p values by default); r2 needs two claims."""
    actual = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    guess = F.greatest(F.col(predicted).cast("double"), F.lit(0.0))
    y, p = (F.log1p(actual), F.log1p(guess)) if log else (actual, guess)
    error = F.col("y") - F.col("p")
    return (
        df.where(F.coalesce(F.col(label), F.lit(0)) > 0).select(y.alias("y"), p.alias("p"))
        .agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
             F.when((F.count("*") >= 2) & (F.var_pop("y") > 0), F.lit(1.0) - F.avg(error * error) / F.var_pop("y")).alias("r2"),
             F.count("*").alias("n"))
    )


def loss_ratio(claims: Column, premium: Column) -> Column:
    """Claims over premium; infinite without premium."""
    return F.when(premium > 0, claims / premium).otherwise(F.lit(float("inf")))


# -- bootstrap -------------------------------------------------------------------------------

# Cumulative Poisson(1) probabilities; a weight is the number of them at or below a uniform number.
POISSON_ONE = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
               0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974021]
_PER_DIGEST = 4


def _digests(key: Column, replicates: int, seed: int) -> Column:
    """Bytes that hold one 32-bit number per replicate, four of them from each md5 of the key."""
    count = -(-replicates // _PER_DIGEST)
    return F.concat(*[F.unhex(F.md5(F.concat(F.lit(f"{seed}:{j}:"), key))) for j in range(count)])


def bootstrap_replicates(df: DataFrame, key: str, replicates: int = 200, seed: int = 42, score: str = "p_claim", label: str = CLAIM,
                         claims: str = AMOUNT, premium: str = "premium", new_premium: str = "new_premium") -> DataFrame:
    """Metrics of each replicate: (replicate, auc, gini, brier, lr_original, lr_new_premium).

    Every row draws a Poisson(1) weight per replicate from its key, which is the
    multinomial bootstrap in a form that needs no resampled copies.  The rows are
    range-partitioned by score; a task keeps only one vector per replicate and
    returns its first and last run of tied scores and one block for what lies
    between, from which the AUC follows exactly.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    slim = df.select(
        F.col(score).cast("double").alias("p"), number(label).alias("y"), number(claims).alias("claims"),
        number(premium).alias("premium"), number(new_premium).alias("new_premium"), key_text(F.col(key)).alias("k"))
    drawn = slim.repartitionByRange("p", "k").sortWithinPartitions("p", "k").withColumn("draws", _digests(F.col("k"), replicates, seed)).drop("k")
    limits = np.array([p * 2.0**32 for p in POISSON_ONE])
    names = ["kind", "replicate", "score", "pos", "neg", "u", "w", "se", "claims", "premium", "new_premium"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = lambda: np.zeros(replicates)
        sums = np.zeros((5, replicates))
        runs: list[tuple[str, float, np.ndarray, np.ndarray, np.ndarray]] = []
        current: tuple[float, np.ndarray, np.ndarray] | None = None
        inner_start, pos_in, neg_in, u_in = None, zero(), zero(), zero()
        for batch in batches:
            p, y, claims_, premium_, new_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if len(p) == 0:
                continue
            bits = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=">u4").reshape(len(p), -1)[:, :replicates]
            weight = np.searchsorted(limits, bits.astype(float), side="right").astype(float)
            for i, value in enumerate((np.ones(len(p)), (y - p) ** 2, claims_, premium_, new_)):
                sums[i] += value @ weight
            starts = np.concatenate([[0], np.nonzero(np.diff(p))[0] + 1])
            pos = np.add.reduceat(weight * y[:, None], starts, axis=0)
            neg = np.add.reduceat(weight * (1.0 - y)[:, None], starts, axis=0)
            scores = p[starts]
            if current is not None and current[0] == scores[0]:
                pos[0] += current[1]
                neg[0] += current[2]
            elif current is not None:
                scores = np.concatenate([[current[0]], scores])
                pos, neg = np.vstack([current[1], pos]), np.vstack([current[2], neg])
            current = (scores[-1], pos[-1], neg[-1])
            scores, pos, neg = scores[:-1], pos[:-1], neg[:-1]
            if len(scores) and not runs:
                runs.append(("run", scores[0], pos[0], neg[0], pos[0] * neg[0] / 2))
                scores, pos, neg = scores[1:], pos[1:], neg[1:]
            if len(scores):
                inner_start = scores[0] if inner_start is None else inner_start
                before = neg_in + np.cumsum(neg, axis=0) - neg
                u_in += (pos * (before + neg / 2)).sum(axis=0)
                pos_in += pos.sum(axis=0)
                neg_in += neg.sum(axis=0)
        if inner_start is not None:
            runs.append(("inner", inner_start, pos_in, neg_in, u_in))
        if current is not None:
            runs.append(("run", current[0], current[1], current[2], zero()))
        index = np.arange(replicates, dtype="int32")
        for kind, at, pos_, neg_, u_ in runs:
            blank = zero()
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * replicates), pa.array(index), pa.array(np.full(replicates, at)), pa.array(pos_), pa.array(neg_),
                 pa.array(u_ if kind == "inner" else blank), *[pa.array(blank)] * 5], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["sums"] * replicates), pa.array(index), pa.array(np.zeros(replicates)), *[pa.array(zero())] * 3,
             *[pa.array(s) for s in sums]], names=names)

    schema = "kind string, replicate int, " + ", ".join(f"{n} double" for n in names[2:])
    parts = drawn.mapInArrow(segments, schema).groupBy("replicate", "kind", "score").agg(*[F.sum(n).alias(n) for n in names[3:]])
    # From here a replicate has at most three rows per range of scores.
    earlier = Window.partitionBy("replicate").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    # Rows of sums have no positives and negatives, the others no sums, so one pass serves both.
    totals = (
        parts.withColumn("below", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
        .withColumn("u", F.col("pos") * F.col("below") + F.when(F.col("kind") == "inner", F.col("u")).otherwise(F.col("pos") * F.col("neg") / 2))
        .groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("u", "pos", "neg", "w", "se", "claims", "premium", "new_premium")])
    )
    auc = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("u") / (F.col("pos") * F.col("neg")))
    return totals.select(
        "replicate", auc.alias("auc"), (F.lit(2.0) * auc - F.lit(1.0)).alias("gini"), ratio(F.col("se"), F.col("w")).alias("brier"),
        loss_ratio(F.col("claims"), F.col("premium")).alias("lr_original"),
        loss_ratio(F.col("claims"), F.col("new_premium")).alias("lr_new_premium"))


BOOTSTRAP_METRICS = ["auc", "gini", "brier", "lr_original", "lr_new_premium"]


def bootstrap_ci(df: DataFrame, key: str, replicates: int = 500, confidence: float = 0.95, seed: int = 42, **columns: str) -> DataFrame:
    """(metric, point_estimate, ci_lower, ci_upper, std) over the replicates."""
    tail = (1.0 - confidence) / 2.0
    long = bootstrap_replicates(df, key, replicates, seed, **columns).unpivot(["replicate"], BOOTSTRAP_METRICS, "metric", "value").where("value is not null")
    return long.groupBy("metric").agg(
        F.avg("value").alias("point_estimate"), F.percentile("value", F.lit(tail)).alias("ci_lower"),
        F.percentile("value", F.lit(1.0 - tail)).alias("ci_upper"), F.stddev_pop("value").alias("std"))

