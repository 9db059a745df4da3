"""Global order without a one-task window.

Questions about a few places of the order (the first k rows, deciles) need no
sort at all: ``with_part`` finds the value at each place exactly and settles
ties by key among the tied rows alone.  Where every row needs its place, rows are range-partitioned on the full order key (value plus tie-break key, so
a value shared by a third of all rows still spreads over many partitions),
sorted inside each partition and numbered by position.  Only one row count per
partition travels to build the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.operators.quantiles import exact_quantiles
from tariffspark.session import materialize

_POSITION_BITS = 33


def ranged(df: DataFrame, *order: Column | str, label: str = "ranged") -> DataFrame:
    """``df`` written in global order with ``_pid`` (range) and ``_pos`` (0-based place in it).

    The table is written once because range boundaries come from a sample and
    two runs of the same plan may draw different ones.
    """
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_gid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_gid", _POSITION_BITS))
        .withColumn("_pos", F.col("_gid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_gid")
    )
    return materialize(numbered, label)


def offsets(ordered: DataFrame, *sums: str) -> DataFrame:
    """Per range: number of rows (and totals of ``sums``) before it; one row per partition."""
    spark = ordered.sparkSession
    per_range = (
        ordered.groupBy("_pid").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).orderBy("_pid").collect()
    )
    columns = ["n", *sums]
    running = {c: [0, *accumulate(row[c] for row in per_range)] for c in columns}
    rows = [tuple([row["_pid"], *[running[c][i] for c in columns]]) for i, row in enumerate(per_range)]
    kinds = dict(ordered.dtypes)
    fields = ", ".join(f"_before_{c} {'bigint' if c == 'n' or kinds[c] in ('int', 'bigint') else 'double'}" for c in columns)
    return spark.createDataFrame(rows, f"_pid bigint, {fields}")


def with_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """1-based global row number; ``order`` must end in a unique key."""
    ordered = ranged(df, *order)
    return (
        ordered.join(F.broadcast(offsets(ordered)), "_pid")
        .withColumn(name, F.col("_before_n") + F.col("_pos") + F.lit(1))
        .drop("_pid", "_pos", "_before_n")
    )


def number_copies(df: DataFrame, by: Sequence[str], name: str = "copy") -> DataFrame:
    """0-based number of each row among the rows that agree in ``by`` (never null), for rows that are interchangeable otherwise.

    Rows are numbered inside the task that wrote them and shifted by the counts
    of the tasks before, so a value shared by a third of all rows never meets in one task.
    """
    written = materialize(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_row", _POSITION_BITS)), "copies")
    per_task = written.groupBy("_pid", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.select("_pid", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_pid", *by).orderBy("_row")) - 1
    return written.withColumn(name, local).join(shifts, ["_pid", *by]).withColumn(name, F.col(name) + F.col("_before")).drop("_pid", "_row", "_before")


def before_key(a: Column, b: Column) -> Column:
    """``a`` sorts before ``b``; nulls come first."""
    return b.isNotNull() & (a.isNull() | F.coalesce(a < b, F.lit(False)))


def with_part(df: DataFrame, value: Column, key: str, places: Sequence[int], name: str) -> DataFrame:
    """``name`` = how many of the ``places`` k are at or before the row's place in the order of (value, key).

    Exactly k rows lie before place k, also where rows repeat both value and key:
    which of the repeats then come first is left open.  ``value`` is numeric and
    never null, a null key sorts first.  Needs a few scans of the two columns and
    no shuffle of the rows; only rows that tie with the value at place k are ordered by key.
    """
    x, own = value.cast("double"), F.col(key)
    table = df.select(x.alias("x"), own.alias("k"))
    n = table.count()
    inner = sorted({k for k in places if 0 < k < n})
    found = exact_quantiles(table, {"x": [(k - 0.5) / (n - 1) for k in inner]})["x"] if inner else []
    # Between two different neighbours lies their midpoint, so the value at place k is the largest one up to it.
    tops = table.agg(*[F.max(F.when(F.col("x") <= v, F.col("x"))).alias(f"t{i}") for i, v in enumerate(found)]).first() if inner else []
    sizes = table.agg(*[F.count_if(F.col("x") < t).alias(f"b{i}") for i, t in enumerate(tops)],
                      *[F.count_if(F.col("x") == t).alias(f"a{i}") for i, t in enumerate(tops)]).first() if inner else []
    copy = "_copy"
    while copy in df.columns:
        copy = "_" + copy
    upto, ranks, repeats = {}, {}, []
    for i, k in enumerate(inner):
        top, among, equal = tops[i], k - sizes[f"b{i}"], sizes[f"a{i}"]
        if among >= equal:
            upto[k] = x <= F.lit(top)
            continue
        if top not in ranks:
            ranks[top] = materialize(with_rank(table.where(F.col("x") == top).select("k"), "k"), "tied")
        # A local table keeps the type of the key, which a literal of Python might not.
        last = ranks[top].where(F.col("rank") == among).first()["k"]
        mark = F.lit(last).cast(df.schema[key].dataType)
        same = ranks[top].where(F.col("k").eqNullSafe(mark)).agg(F.min("rank").alias("first"), F.count("*").alias("n")).first()
        need, tied = among - same["first"] + 1, (x == F.lit(top)) & own.eqNullSafe(mark)
        earlier = (x < F.lit(top)) | ((x == F.lit(top)) & before_key(own, mark))
        if need == same["n"]:
            upto[k] = earlier | tied
        else:
            if (top, last) not in [r[0] for r in repeats]:
                repeats.append(((top, last), tied))
            upto[k] = earlier | (tied & (F.col(copy) < F.lit(need)))
    if repeats:
        group = reduce(lambda rest, r: F.when(r[1][1], F.lit(r[0])).otherwise(rest), enumerate(repeats), F.lit(-1))
        marked = df.withColumn("_cut", group)
        others = marked.where("_cut < 0").drop("_cut").withColumn(copy, F.lit(0).cast("bigint"))
        df = others.unionByName(number_copies(marked.where("_cut >= 0"), ["_cut"], copy).drop("_cut"))
    conditions = [upto[k] if k in upto else F.lit(k >= n) for k in places]
    return df.withColumn(name, reduce(add, [(~c).cast("int") for c in conditions], F.lit(0))).drop(copy)
