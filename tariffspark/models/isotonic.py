"""Isotonic regression of events on a score, by mergeable lower hulls.

Order the scores and plot running events over running rows: the isotonic fit is
the slope of the greatest convex minorant of these points. A minorant of a
range is a short list of blocks (rows and events between two of its vertices),
and the minorant of two neighbouring ranges comes from their blocks alone. So
every range of scores returns the blocks of its own hull, hulls of ``FAN_IN``
neighbours are merged, and so on up a tree. A point that is no vertex of its
range can be none of the whole and never leaves its task.

Counts are whole numbers and slopes are compared by cross products, so the
blocks do not depend on how the rows were cut. The corners of a convex chain
between whole coordinates over n rows are O(n^(2/3)): that bounds the last
merge and the fitted model, about a million blocks for a billion rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.session import materialize

FAN_IN = 16
BLOCKS = "part int, low double, high double, rows long, events long"


def _minorant(batches):
    """Rows (part, low, high, rows, events) in order of (part, low) -> the blocks of every part's lower hull."""
    import pyarrow as pa

    names = ["part", "low", "high", "rows", "events"]
    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    stack, now = [], None

    def out():
        return pa.record_batch([pa.array([b[i] for b in stack], kinds[i]) for i in range(5)], names=names)

    for batch in batches:
        for part, low, high, rows, events in zip(*[c.to_pylist() for c in batch.columns]):
            if part != now:
                if stack:
                    yield out()
                stack, now = [], part
            while stack and stack[-1][4] * rows >= events * stack[-1][3]:
                _, low, _, before, more = stack.pop()
                rows, events = rows + before, events + more
            stack.append((part, low, high, rows, events))
    if stack:
        yield out()


def isotonic_blocks(df: DataFrame, score: Column, event: Column) -> DataFrame:
    """(low, high, rows, events) of the blocks of equal fitted value, in order of their scores; null scores take no part."""
    points = df.select(score.cast("double").alias("low"), event.cast("long").alias("e")).where("low is not null")
    counted = points.groupBy("low").agg(F.count(F.lit(1)).alias("rows"), F.sum("e").alias("events"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = counted.repartitionByRange(parts, "low").sortWithinPartitions("low")
    hulls = ranges.select(F.spark_partition_id().alias("part"), "low", F.col("low").alias("high"), "rows", "events").mapInArrow(_minorant, BLOCKS)
    while True:
        hulls = materialize(hulls, "hulls")
        if parts <= 1:
            return hulls.drop("part")
        parts = -(-parts // FAN_IN)
        merged = hulls.withColumn("part", F.expr(f"cast(part div {FAN_IN} as int)")).repartition(parts, "part").sortWithinPartitions("part", "low")
        hulls = merged.mapInArrow(_minorant, BLOCKS)


@dataclass
class IsotonicCurve:
    """Fitted value by score: constant on blocks, straight between them, flat outside."""

    scores: list[float] = field(default_factory=list)
    values: list[float] = field(default_factory=list)

    @staticmethod
    def fit(df: DataFrame, score: Column, event: Column) -> "IsotonicCurve":
        curve = IsotonicCurve()
        for b in isotonic_blocks(df, score, event).orderBy("low").collect():  # O(n^(2/3)) blocks, see above
            ends = [b["low"]] if b["low"] == b["high"] else [b["low"], b["high"]]
            curve.scores += ends
            curve.values += [b["events"] / b["rows"]] * len(ends)
        if not curve.scores:
            raise ValueError("no scores to calibrate on")
        return curve

    def at(self, score: Column) -> Column:
        scores, values = self.scores, self.values

        @F.pandas_udf("double")
        def value(x):
            import numpy as np
            import pandas as pd

            return pd.Series(np.where(x.isna(), np.nan, np.interp(x.to_numpy(dtype=float), scores, values)))

        found = value(score.cast("double"))
        return F.when(score.isNull() | F.isnan(found), F.lit(None).cast("double")).otherwise(found)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(zip(range(len(self.scores)), self.scores, self.values))
        spark.createDataFrame(rows, "place int, score double, value double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsotonicCurve":
        rows = spark.read.parquet(path).orderBy("place").collect()
        return IsotonicCurve([r["score"] for r in rows], [r["value"] for r in rows])
