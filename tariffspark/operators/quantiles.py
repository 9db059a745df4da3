"""Exact linear-interpolation quantiles of many columns.

``percentile`` keeps every distinct value of a column in one buffer.  Here
columns are narrowed with mergeable sketches: each pass keeps, per quantile,
only the rows between two data values that provably enclose the wanted rank,
until the rows or distinct values left fit a checked limit and are ranked
inside Spark.  Small tables take the same path with no pass.

A pass reads the columns side by side and sorts them chunk by chunk inside the
task: every count and every row between two bounds is then a slice, so that its
cost does not grow with the number of quantiles, and only what is asked for
leaves the task as (column, value) rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_VALUES = 10_000
CHUNK_ROWS = 1 << 16
STRIDE = 64  # the first sketch is made of every 64th value of a sorted chunk; exact counts prove its brackets
_GRID = [i / 64 for i in range(65)]
_FIRST_GRID = [i / 1024 for i in range(1025)]


def even_grid(parts: int) -> list[float]:
    """0, 1/parts, ..., 1 as the nearest doubles, so that a whole rank stays whole."""
    return [i / parts for i in range(parts + 1)]


@dataclass
class _Target:
    feature: str
    rank: float
    low: float
    high: float
    below: int
    inside: int


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], candidate_values: int = CANDIDATE_VALUES) -> dict[str, list[float | None]]:
    """{column: quantiles}; nulls are skipped, an all-null column gives None."""
    if not wanted:
        return {}
    columns = list(wanted)
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    # The first sketch is shared by all quantiles of a column.
    start = {r["feature"]: r for r in _points(wide).groupBy("feature").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.percentile_approx("x", _FIRST_GRID, 10_000).alias("grid")).collect()}
    open_targets: dict[tuple[str, int], _Target] = {}
    for c in columns:
        if c in start:
            n, lo, hi = start[c]["n"], start[c]["lo"], start[c]["hi"]
            for i, q in enumerate(wanted[c]):
                open_targets[(c, i)] = _Target(c, (n - 1) * float(q), lo, hi, 0, n)
    answers: dict[tuple[str, int], float] = {}
    if any(t.inside > candidate_values for t in open_targets.values()):
        open_targets = _recount(wide, open_targets, {k: _shrink(t, list(start[k[0]]["grid"])) for k, t in open_targets.items()}, halve=False)
    while open_targets:
        answers.update({k: t.low for k, t in open_targets.items() if t.low == t.high})
        open_targets = {k: t for k, t in open_targets.items() if t.low != t.high}
        if not open_targets:
            break
        small = {k: t for k, t in open_targets.items() if t.inside <= candidate_values}
        if small:
            answers.update(_finish(_inside(wide, small), small))
            open_targets = {k: t for k, t in open_targets.items() if k not in small}
            continue
        sketch = {
            (r["feature"], r["slot"]): r
            for r in _inside(wide, open_targets).groupBy("feature", "slot").agg(
                F.approx_count_distinct("x").alias("values"), F.percentile_approx("x", _GRID, 4096).alias("grid")).collect()
        }
        # A rank between two values keeps both, so a handful must always count as few.
        small = {k: t for k, t in open_targets.items() if sketch[k]["values"] <= max(candidate_values, 16)}
        if small:
            answers.update(_finish(_inside(wide, small), small))
        rest = {k: t for k, t in open_targets.items() if k not in small}
        open_targets = _recount(wide, rest, {k: _shrink(t, list(sketch[k]["grid"])) for k, t in rest.items()}) if rest else {}
    return {c: [answers.get((c, i)) for i in range(len(wanted[c]))] for c in columns}


def _sorted_chunks(batches):
    """(place of the column, its values without nulls in order) for every chunk of rows; for use inside tasks.  NaN is the largest value."""
    import numpy as np
    import pyarrow as pa

    def chunk(held):
        for i, column in enumerate(pa.Table.from_batches(held).columns):
            values = np.sort(column.drop_null().to_numpy())
            if len(values):
                yield i, values

    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= CHUNK_ROWS:
            yield from chunk(held)
            held, rows = [], 0
    if rows:
        yield from chunk(held)


def _points(wide: DataFrame) -> DataFrame:
    """(feature, x, n, lo, hi): per chunk and column the count and the ends, and every ``STRIDE``-th value."""
    names = wide.columns

    def points(batches):
        import pyarrow as pa

        for i, v in _sorted_chunks(batches):
            few = v[min(STRIDE // 2, len(v) // 2)::STRIDE]
            rest = [None] * (len(few) - 1)
            yield pa.record_batch([pa.array([names[i]] * len(few)), pa.array(few), pa.array([len(v), *rest], pa.int64()),
                                   pa.array([v[0], *rest], pa.float64()), pa.array([v[-1], *rest], pa.float64())], names=["feature", "x", "n", "lo", "hi"])

    return wide.mapInArrow(points, "feature string, x double, n long, lo double, hi double")


def _by_place(wide: DataFrame, targets: Mapping[tuple[str, int], tuple[float, float]]):
    """{place of a column: (slots, low bounds, high bounds)}."""
    out = {}
    for i, c in enumerate(wide.columns):
        own = [(k[1], *b) for k, b in targets.items() if k[0] == c]
        if own:
            out[i] = tuple(zip(*own))
    return out


def _inside(wide: DataFrame, targets: Mapping[tuple[str, int], _Target]) -> DataFrame:
    """(feature, slot, x): values between the bounds of each open quantile."""
    names, bounds = wide.columns, _by_place(wide, {k: (t.low, t.high) for k, t in targets.items()})

    def inside(batches):
        import numpy as np
        import pyarrow as pa

        for i, v in _sorted_chunks(batches):
            if i in bounds:
                slots, low, high = bounds[i]
                for slot, a, b in zip(slots, np.searchsorted(v, low, "left"), np.searchsorted(v, high, "right")):
                    if b > a:
                        yield pa.record_batch([pa.array([names[i]] * (b - a)), pa.array(np.full(b - a, slot, dtype=np.int32)), pa.array(v[a:b])],
                                              names=["feature", "slot", "x"])

    return wide.mapInArrow(inside, "feature string, slot int, x double")


def _shrink(t: _Target, grid: list[float]) -> tuple[float, float]:
    place = (t.rank - t.below) / max(t.inside - 1, 1) * (len(grid) - 1)
    return grid[max(math.floor(place) - 1, 0)], grid[min(math.ceil(place) + 1, len(grid) - 1)]


def _recount(wide: DataFrame, targets: Mapping[tuple[str, int], _Target], proposals: Mapping[tuple[str, int], tuple[float, float]],
             halve: bool = True) -> dict[tuple[str, int], _Target]:
    """Adopt a narrower bracket only where exact counts prove it holds both neighbours of the rank."""
    names, bounds = wide.columns, _by_place(wide, {k: proposals[k] for k in targets})

    def counts(batches):
        import numpy as np
        import pyarrow as pa

        sums = {i: np.zeros((2, len(slots)), dtype=np.int64) for i, (slots, _, _) in bounds.items()}
        for i, v in _sorted_chunks(batches):
            if i in bounds:
                below = np.searchsorted(v, bounds[i][1], "left")
                sums[i] += [below, np.searchsorted(v, bounds[i][2], "right") - below]
        for i, (below, inside) in sums.items():
            yield pa.record_batch([pa.array([names[i]] * len(below)), pa.array(np.asarray(bounds[i][0], dtype=np.int32)), pa.array(below), pa.array(inside)],
                                  names=["feature", "slot", "below", "inside"])

    counted = wide.mapInArrow(counts, "feature string, slot int, below long, inside long").groupBy("feature", "slot").agg(
        F.sum("below").alias("below"), F.sum("inside").alias("inside")).collect()
    found = {(r["feature"], r["slot"]): r for r in counted}
    out = {}
    for key, t in targets.items():
        (lo, hi), below, inside = proposals[key], found[key]["below"], found[key]["inside"]
        holds = below <= math.floor(t.rank) and below + inside > math.ceil(t.rank)
        if holds and inside < t.inside:
            out[key] = _Target(t.feature, t.rank, lo, hi, below, inside)
        else:
            # The sketch could not narrow this one; cut the value range in half instead.
            out[key] = _halve(wide, t, (t.low + t.high) / 2) if halve else t
    return out


def _halve(wide: DataFrame, t: _Target, middle: float) -> _Target:
    own = wide.select(F.col(t.feature).alias("x")).where(F.col("x").between(t.low, t.high))
    row = own.agg(
        F.count_if(F.col("x") <= middle).alias("left"),
        F.max(F.when(F.col("x") <= middle, F.col("x"))).alias("left_max"),
        F.min(F.when(F.col("x") > middle, F.col("x"))).alias("right_min"),
    ).first()
    if t.below + row["left"] > math.ceil(t.rank):
        return _Target(t.feature, t.rank, t.low, row["left_max"], t.below, row["left"])
    if t.below + row["left"] <= math.floor(t.rank):
        return _Target(t.feature, t.rank, row["right_min"], t.high, t.below + row["left"], t.inside - row["left"])
    ties = own.where(F.col("x").isin(row["left_max"], row["right_min"])).groupBy("x").count().collect()
    at = {r["x"]: r["count"] for r in ties}
    return _Target(t.feature, t.rank, row["left_max"], row["right_min"],
                   t.below + row["left"] - at[row["left_max"]], sum(at.values()))


def _finish(inside: DataFrame, targets: Mapping[tuple[str, int], _Target]) -> dict[tuple[str, int], float]:
    """The two values next to each rank, ranked in Spark; two rows per quantile come back."""
    spark = inside.sparkSession
    ranks = spark.createDataFrame([(*k, math.floor(t.rank) - t.below, math.ceil(t.rank) - t.below) for k, t in targets.items()],
                                  "_f string, _s int, lower bigint, upper bigint")
    upto = Window.partitionBy("feature", "slot").orderBy("x")
    placed = inside.groupBy("feature", "slot", "x").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
    at = placed.join(F.broadcast(ranks), (F.col("feature") == F.col("_f")) & (F.col("slot") == F.col("_s")))
    holds = lambda r: (F.col("upto") - F.col("n") <= F.col(r)) & (F.col(r) < F.col("upto"))
    found = at.groupBy("feature", "slot").agg(F.max(F.when(holds("lower"), F.col("x"))).alias("a"), F.max(F.when(holds("upper"), F.col("x"))).alias("b"))
    out = {}
    for r in found.collect():
        t = targets[(r["feature"], r["slot"])]
        lower, upper = math.floor(t.rank), math.ceil(t.rank)
        out[(r["feature"], r["slot"])] = r["a"] if r["a"] == r["b"] else (upper - t.rank) * r["a"] + (t.rank - lower) * r["b"]
    return out
