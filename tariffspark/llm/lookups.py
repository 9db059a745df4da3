"""Joins against tables that are usually small, and places in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.llm.text import free_names
from tariffspark.session import materialize

BROADCAST_ROWS = 200_000


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table whose counted rows stay under ``rows``; beyond, Spark plans a shuffle join."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def chunks(table: DataFrame, key: Column, rows: int = BROADCAST_ROWS) -> list[DataFrame]:
    """Parts of a written table by the hash of ``key``, each broadcast; one scan of the other side per part."""
    parts = -(-table.count() // rows)
    if parts <= 1:
        return [F.broadcast(table)]
    # Twice the parts leave room for uneven hashes; a part that is still too large is planned as a shuffle join.
    parts *= 2
    return [bounded(table.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i), 2 * rows) for i in range(parts)]


def ranked(df: DataFrame, order: list[Column], place: str = "place", label: str = "ranked") -> tuple[DataFrame, int]:
    """Rows with their 0-based place in the order of ``order``, and how many there are.

    Rows are range-partitioned, numbered inside each partition and written; one
    count per partition gives the offsets. Ties beyond ``order`` are broken by
    row number, so that no run of equal rows has to fit one task.
    """
    part, at, tie, start = free_names(df.columns, "__part", "__at", "__tie", "__before")
    spread = df.withColumn(tie, F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = materialize(
        spread.repartitionByRange(parts, *order, F.col(tie)).sortWithinPartitions(*order, F.col(tie)).drop(tie)
        .withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), label)
    counts = written.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.withColumn(start, F.coalesce(F.sum("__n").over(before), F.lit(0))), f"{label}-offsets")
    total = offsets.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    # One row per shuffle partition: a bound that the settings give.
    out = written.join(F.broadcast(offsets.drop("__n")), part).withColumn(place, F.col(start) + F.col(at))
    return out.drop(part, at, start), int(total)
