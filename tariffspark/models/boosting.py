"""Histogram boosting: trees on binned columns from gradients and second derivatives.

Columns become small whole numbers once (``fit_binning``), packed into blocks
that stay with the executors. A level of a tree costs one job: every task adds
up gradients per (node, column, bin) over its blocks, sums are combined up a
tree of tasks, and the driver picks the splits from a table whose size is
nodes x columns x bins, whatever the rows. Of two siblings only the smaller is
summed, the other is its parent minus it.

Any number of models (trials, folds, frequency and severity) grow in step over
the same blocks, so a level of all of them is one job too. Gradients are
rounded to multiples of 2^-24 and added as whole numbers: sums, splits and
predictions do not depend on how the rows were cut, nor on the order of adding.

A block keeps the margins of all finished trees: the jobs of a tree find them
ready, and only the newest tree is added before the next one starts. After
``REFRESH`` trees blocks and margins are written and read again, so the lineage
never gets longer than that and no finished tree is evaluated twice. Blocks of
numpy arrays that several hundred jobs read are kept as an RDD: the same level
over a cached DataFrame took 0.22 s of overhead here, this one 0.09 s.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from contextlib import ExitStack
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.operators.quantiles import even_grid, exact_quantiles
from tariffspark.session import for_now, materialize
from tariffspark.sources.tables import read_json, write_json

UNIT = float(1 << 24)   # gradients are whole multiples of 1 / UNIT
BLOCK_ROWS = 2048       # a block's sums stay whole numbers below 2^53
COUNTED = 4096          # more than a block's rows
REFRESH = 20
REDUCE_WIDTH = 64
STEEPEST = 1 << 14      # larger gradients are cut to this (a severity of that many units of the mean)


@dataclass(frozen=True)
class BoostParams:
    loss: str = "logistic"          # logistic, squared or tweedie (log link)
    trees: int = 40
    depth: int = 4
    learning_rate: float = 0.1
    subsample: float = 0.8          # rows of a tree, by a hash of the row
    column_share: float = 1.0       # columns of a tree, by a hash of the column
    leaf_penalty: float = 1.0
    split_penalty: float = 0.0
    least_child_weight: float = 1.0
    power: float = 1.5
    seed: int = 42


@dataclass
class Binning:
    """Bin 0 is a missing value; numbers fall between edges, categories have their own place."""

    numeric: dict[str, list[float]] = field(default_factory=dict)
    categorical: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def widths(self) -> list[int]:
        """Bins of every column."""
        return [len(e) + 2 for e in self.numeric.values()] + [max(m.values(), default=0) + 2 for m in self.categorical.values()]


def fit_binning(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: Column, bins: int = 64) -> Binning:
    """Edges at exact quantiles; the ``bins - 2`` most frequent categories in order of their mean target, all others share the last bin."""
    grid = even_grid(bins)[1:-1]
    quantiles = exact_quantiles(df, {c: grid for c in numeric}) if numeric else {}
    edges = {c: sorted({q for q in quantiles[c] if q is not None}) for c in numeric}
    places: dict[str, dict[str, int]] = {c: {} for c in categorical}
    if categorical:
        from pyspark.sql import Window

        long = df.select(target.cast("double").alias("_y"), *categorical).unpivot(["_y"], list(categorical), "column", "value").where("value is not null")
        counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"))
        best = Window.partitionBy("column").orderBy(F.desc("n"), "value")  # top rows per column, cut in every task first
        kept = counted.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max(bins - 2, 1)).collect()
        for c in categorical:
            own = sorted((r for r in kept if r["column"] == c), key=lambda r: (round(r["y"] / r["n"], 9), r["value"]))
            places[c] = {r["value"]: i + 1 for i, r in enumerate(own)}
    return Binning(edges, places)


def _binner(binning: Binning):
    """(columns as numpy arrays or lists) -> matrix of bins; for use inside tasks."""

    def binned(columns):
        import numpy as np
        import pandas as pd

        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), dtype=np.int32)
        for i, edges in enumerate(binning.numeric.values()):
            x = np.asarray(columns[i], dtype=float)
            out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.asarray(edges), x, side="left"))
        for i, places in enumerate(binning.categorical.values(), len(binning.numeric)):
            value = pd.Series(columns[i], dtype=object)
            rest = max(places.values(), default=0) + 1
            out[:, i] = np.where(value.isna(), 0, value.map(places).fillna(rest)).astype(np.int32)
        return out

    return binned


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2i + 1 and 2i + 2; ``column`` -1 marks a leaf."""

    column: list[int]
    cut: list[int]             # bins up to this one go left
    missing_left: list[bool]
    value: list[float]         # what the row's path is worth if it ended here
    rows: list[int]

    def arrays(self):
        import numpy as np

        return (np.asarray(self.column, dtype=np.int64), np.asarray(self.cut, dtype=np.int64), np.asarray(self.missing_left, dtype=bool),
                np.asarray(self.value, dtype=float))


def _leaf_of(tree, bins, steps: int):
    """Node every row stands in after ``steps`` levels."""
    import numpy as np

    column, cut, missing_left, _ = tree
    rows, width = bins.shape
    node, flat, first = np.zeros(rows, dtype=np.int64), bins.ravel(), np.arange(rows) * width
    inner, used = column >= 0, np.maximum(column, 0)
    if not width:
        return node
    for _ in range(steps):
        if not inner.take(node).any():
            break
        b = flat.take(first + used.take(node))
        right = np.where(b == 0, ~missing_left.take(node), b > cut.take(node))
        node = np.where(inner.take(node), 2 * node + 1 + right, node)
    return node


def _of_task(trees, bins, depth: int, claim, claims_only: bool, start):
    """``_margin`` of the rows that a model sees; the others keep ``start``."""
    import numpy as np

    at = np.flatnonzero(claim > 0) if claims_only else None
    if at is None or len(at) == len(bins):
        return _margin(trees, bins, depth, start)
    out = start.copy()
    out[at] = _margin(trees, bins[at], depth, start[at])
    return out


def _margin(trees, bins, depth: int, start):
    """``start`` plus the values of ``trees`` (arrays) for every row."""
    out = start.copy()
    for tree in trees:
        out += tree[3][_leaf_of(tree, bins, depth)]
    return out


@dataclass
class Task:
    """One model among those that grow together: its settings, its target and its rows."""

    params: BoostParams
    target: str                     # name of a target of the blocks
    claims_only: bool = False
    hold_out: int | None = None     # fold that the model must not see
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    rows: int = 0

    def margins(self, bins, trees: int | None = None):
        import numpy as np

        return _margin([t.arrays() for t in self.trees[:trees]], bins, self.params.depth, np.full(len(bins), self.start))


def _gradients(params: BoostParams, margin, y):
    import numpy as np

    if params.loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1.0 - p)
    elif params.loss == "tweedie":
        a, b = np.exp((1.0 - params.power) * margin), np.exp((2.0 - params.power) * margin)
        g, h = b - y * a, (2.0 - params.power) * b - (1.0 - params.power) * y * a
    else:
        g, h = margin - y, np.ones_like(margin)
    whole = lambda x: np.rint(np.clip(x, -STEEPEST, STEEPEST) * UNIT)
    return whole(g), whole(np.maximum(h, 1e-6))


def _draw(keys, seed: int, salt: int):
    """A number in [0, 1) per key, the same on every run."""
    import numpy as np

    x = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + salt * 0xD1B54A32D192ED03) % (1 << 64))
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(m)
    return (x ^ (x >> np.uint64(32))) / float(1 << 64)


@dataclass
class Blocks:
    """The binned rows of a split: an RDD of (bins, {target: values}, claim, fold, key) per block."""

    rdd: Any
    binning: Binning
    partitions: int
    rows: int
    labels: Sequence[str]
    kind: str
    spark: SparkSession

    def unpersist(self) -> None:
        self.rdd.unpersist()


def _kept_state(state, labels: Sequence[str], kind: str, spark: SparkSession, places: ExitStack):
    """Blocks and margins, written and read again; ``places`` deletes the table."""

    def packed(part):
        (bins, y, claim, fold, key), margins = part
        return (len(bins), bins.shape[1], bytearray(bins.tobytes()), *[bytearray(x.tobytes()) for x in (claim, fold, key)],
                [bytearray(y[t].tobytes()) for t in labels], [None if m is None else bytearray(m.tobytes()) for m in margins])

    def unpacked(row):
        import numpy as np

        block = (np.frombuffer(row["bins"], kind).reshape(row["n"], row["width"]), {t: np.frombuffer(b, "<f8") for t, b in zip(labels, row["y"])},
                 *[np.frombuffer(row[c], k) for c, k in (("claim", "<i4"), ("fold", "<i4"), ("key", "<i8"))])
        return block, [None if m is None else np.frombuffer(m, "<f8") for m in row["margins"]]

    table = spark.createDataFrame(state.map(packed), "n int, width int, bins binary, claim binary, fold binary, key binary, y array<binary>, margins array<binary>",
                                  verifySchema=False)
    return places.enter_context(for_now(table, "boost-state")).rdd.map(unpacked)


def pack_blocks(df: DataFrame, binning: Binning, targets: Mapping[str, Column], claim: Column, key: Column, fold: Column | None = None) -> Blocks:
    """Bin ``df`` and keep it in blocks; the packed table is written first, so a lost block is read again."""
    names, labels = binning.columns, list(targets)
    binned = _binner(binning)
    kind = "u1" if max(binning.widths, default=0) <= 256 else "<u2"
    wanted = [*[F.col(c).cast("double") if c in binning.numeric else F.col(c).cast("string") for c in names], *[targets[t].cast("double") for t in labels],
              claim.cast("int"), (F.lit(-1) if fold is None else fold).cast("int"), F.xxhash64(key)]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(wanted)])
    width = len(names)

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(part.num_columns)]
                bins = binned(columns[:width]).astype(kind) if width else np.zeros((part.num_rows, 0), dtype=kind)
                y = np.stack([np.asarray(c, dtype="<f8") for c in columns[width:-3]]) if labels else np.empty((0, part.num_rows))
                blobs = [bins.tobytes(), y.tobytes(), columns[-3].astype("<i4").tobytes(), columns[-2].astype("<i4").tobytes(), columns[-1].astype("<i8").tobytes()]
                yield pa.record_batch([pa.array([part.num_rows], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]],
                                      names=["n", "bins", "y", "claim", "fold", "key"])

    table = materialize(rows.mapInArrow(pack, "n int, bins binary, y binary, claim binary, fold binary, key binary"), "boost-blocks")

    def unpacked(row):
        import numpy as np

        y = np.frombuffer(row["y"], "<f8").reshape(len(labels), row["n"])
        return (np.frombuffer(row["bins"], kind).reshape(row["n"], width), dict(zip(labels, y)), np.frombuffer(row["claim"], "<i4"),
                np.frombuffer(row["fold"], "<i4"), np.frombuffer(row["key"], "<i8"))

    # Hundreds of passes follow: a table of fewer parts than cores is spread once.
    rows_of, cores = table.rdd, df.sparkSession.sparkContext.defaultParallelism
    if rows_of.getNumPartitions() < cores:
        rows_of = rows_of.repartition(cores)
    # The table is on disk already: what memory does not hold is read from it again. A state of ``grow`` holds its blocks itself.
    rdd = rows_of.map(unpacked)
    rows_in = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Blocks(rdd, binning, rdd.getNumPartitions(), int(rows_in), labels, kind, df.sparkSession)


def _combined(rdd, partitions: int, function, merge):
    """``function`` over every partition's blocks, combined in a tree of width ``REDUCE_WIDTH``."""
    depth = max(1, math.ceil(math.log(max(partitions, 2), REDUCE_WIDTH)))
    return rdd.mapPartitions(function).treeReduce(merge, depth)


def _mine(task: Task, y, claim, fold):
    import numpy as np

    mask = ~np.isnan(y[task.target])
    if task.claims_only:
        mask &= claim > 0
    return mask & (fold != task.hold_out) if task.hold_out is not None else mask


def _starts(blocks: Blocks, tasks: Sequence[Task]) -> None:
    """Constant every model starts from: the best one without any split."""
    given = [replace_trees(t) for t in tasks]

    def sums(parts):
        import numpy as np

        out = np.zeros((len(given), 2), dtype=object)
        for _, y, claim, fold, _ in parts:
            for i, t in enumerate(given):
                mask = _mine(t, y, claim, fold)
                out[i] += [int(mask.sum()), int(np.rint(y[t.target][mask] * UNIT).astype(object).sum() if mask.any() else 0)]
        return [out]

    total = _combined(blocks.rdd, blocks.partitions, sums, lambda a, b: a + b)
    for task, (n, s) in zip(tasks, total.tolist()):
        mean = s / UNIT / n if n else 0.0
        if task.params.loss == "logistic":
            inside = min(max(mean, 1e-6), 1 - 1e-6)
            task.start = math.log(inside / (1 - inside))
        else:
            task.start = math.log(max(mean, 1e-6)) if task.params.loss == "tweedie" else mean
        task.rows = int(n)


def replace_trees(task: Task) -> Task:
    """``task`` without its trees, to travel with a job."""
    return replace(task, trees=[])


def _histograms(blocks: Blocks, state, work: list[tuple[int, Task, int, Any, dict[int, int]]]):
    """Sums (gradient, second derivative, rows) per node and bin of every model at work, the bins of all columns one after the other.

    ``work``: (place of the model, the model, number of the tree, tree being grown, {node: slot}).
    """
    depth_of = {i: max((n + 1).bit_length() - 1 for n in slots) for i, _, _, _, slots in work}
    widths = blocks.binning.widths
    width, total = len(widths), sum(widths)

    def sums(parts):
        import numpy as np

        out = {i: np.zeros((3, len(slots) * total), dtype=np.int64) for i, _, _, _, slots in work}
        offset = np.cumsum([0, *widths[:-1]])
        for (bins, y, claim, fold, key), margins in parts:
            for i, task, number, tree, slots in work:
                mask = _mine(task, y, claim, fold)
                if task.params.subsample < 1.0:
                    mask &= _draw(key, task.params.seed, number) < task.params.subsample
                rows = np.flatnonzero(mask)
                if not len(rows):
                    continue
                slot = np.full(2 << task.params.depth, -1, dtype=np.int64)
                slot[list(slots)] = list(slots.values())
                b = bins.take(rows, axis=0)
                slot = slot[_leaf_of(tree, b, depth_of[i])]
                # Only the rows of the nodes asked for go on.
                at = np.flatnonzero(slot >= 0)
                if not len(at):
                    continue
                if len(at) < len(rows):
                    rows, slot, b = rows.take(at), slot.take(at), b.take(at, axis=0)
                g, h = _gradients(task.params, margins[i].take(rows), y[task.target].take(rows))
                place = (b + (slot * total)[:, None] + offset).ravel()
                size = len(slots) * total
                out[i][0] += np.bincount(place, weights=np.repeat(g, width), minlength=size).astype(np.int64)
                if task.params.loss == "tweedie":
                    out[i][1] += np.bincount(place, weights=np.repeat(h, width), minlength=size).astype(np.int64)
                    out[i][2] += np.bincount(place, minlength=size)
                else:
                    # Second derivatives of at most 1 and the rows share one exact sum: below 2^36 for the one, 2^12 for the other.
                    both = np.bincount(place, weights=np.repeat(h * COUNTED + 1.0, width), minlength=size).astype(np.int64)
                    out[i][1] += both // COUNTED
                    out[i][2] += both % COUNTED
        out = {i: np.moveaxis(out[i].reshape(3, len(slots), total), 0, -1) for i, _, _, _, slots in work}
        return [out]

    merge = lambda a, b: {i: a[i] + b[i] for i in a}
    return _combined(state, blocks.partitions, sums, merge)


def best_split(sums, params: BoostParams, columns):
    """(gain, column, cut, missing_left) of the best split of a node's sums, or None; ties go to the first column and lowest cut.

    ``sums``: column x bin x (gradient, second derivative, rows), whole numbers.
    """
    import numpy as np

    s = sums.astype(float)
    g, h, n = s[..., 0] / UNIT, s[..., 1] / UNIT, s[..., 2]
    total_g, total_h, total_n = g[0].sum(), h[0].sum(), n[0].sum()
    score = lambda a, b: a * a / (b + params.leaf_penalty)
    best = None
    for missing_left in (True, False):
        first = 0 if missing_left else 1
        left_g, left_h, left_n = (np.cumsum(x[:, first:], axis=1) for x in (g, h, n))
        right_g, right_h, right_n = total_g - left_g, total_h - left_h, total_n - left_n
        fits = (left_n > 0) & (right_n > 0) & (left_h >= params.least_child_weight) & (right_h >= params.least_child_weight)
        gain = np.where(fits, 0.5 * (score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)) - params.split_penalty, -np.inf)
        gain = np.where(columns[:, None], gain, -np.inf)
        # Sums of whole numbers are exact, their quotients are not: equal gains must tie on every machine.
        gain = np.round(gain, 9)
        at = int(gain.argmax())
        column, cut = divmod(at, gain.shape[1])
        if gain[column, cut] > 0 and (best is None or gain[column, cut] > best[0]):
            best = (float(gain[column, cut]), column, cut + first, missing_left)
    return best


def grow(blocks: Blocks, tasks: Sequence[Task], upto: Sequence[int] | None = None) -> None:
    """Grow every task's trees, all tasks level by level together, to ``upto`` trees each (default: as many as its settings say)."""
    import numpy as np

    goal = [t.params.trees for t in tasks] if upto is None else list(upto)
    if not any(t.trees for t in tasks):
        _starts(blocks, tasks)
    names, width = blocks.binning.columns, len(blocks.binning.columns)
    if not width:
        return
    settled, state, before, links = None, None, None, 0
    places, older = ExitStack(), ExitStack()
    try:
        while any(len(t.trees) < g and t.rows for t, g in zip(tasks, goal)):
            active = [i for i, t in enumerate(tasks) if len(t.trees) < goal[i] and t.rows]
            anew = settled is None
            # Trees that the margins of the state lack; finished models need none.
            lacking = [t.trees[0 if anew else settled[i]:] if i in active else [] for i, t in enumerate(tasks)]
            held = [(t.start, [x.arrays() for x in trees], t.params.depth, t.claims_only, i in active) for i, (t, trees) in enumerate(zip(tasks, lacking))]

            def with_margins(part, held=held, anew=anew):
                import numpy as np

                block, old = (part, None) if anew else part
                bins, rows, claim = block[0], len(block[0]), block[2]
                return block, [_of_task(trees, bins, depth, claim, claims_only, np.full(rows, start) if anew else old[i]) if used else None
                               for i, (start, trees, depth, claims_only, used) in enumerate(held)]

            source = blocks.rdd if anew else state
            if links >= REFRESH:
                fresh = ExitStack()
                source, links = _kept_state(state, blocks.labels, blocks.kind, blocks.spark, fresh), 0
                older, places = places, fresh
            before, state = state, source.map(with_margins).persist(StorageLevel.MEMORY_AND_DISK)
            settled, links = [len(t.trees) for t in tasks], links + 1
            _grow_one(blocks, state, tasks, active, names)
            # The first job of the tree has computed the new state from the old one.
            if before is not None:
                before.unpersist()
            older.close()
    finally:
        for one in (state, before):
            if one is not None:
                one.unpersist()
        older.close()
        places.close()


def _grow_one(blocks: Blocks, state, tasks, active, names) -> None:
    """One more tree for every active task."""
    import zlib

    import numpy as np

    width = len(names)
    given = {i: replace_trees(tasks[i]) for i in active}
    trees, sums, chosen = {}, {}, {}
    for i in active:
        p = tasks[i].params
        size = (2 << p.depth) - 1
        trees[i] = Tree([-1] * size, [0] * size, [False] * size, [0.0] * size, [0] * size)
        keys = np.array([zlib.crc32(c.encode()) for c in names], dtype=np.int64)
        drawn = _draw(keys, p.seed, (1 << 20) + len(tasks[i].trees))
        chosen[i] = drawn <= max(p.column_share, drawn.min()) if p.column_share < 1 else np.ones(width, dtype=bool)
    open_nodes = {i: [0] for i in active}
    shape = np.arange(max(blocks.binning.widths)) < np.array(blocks.binning.widths)[:, None]
    for level in range(max(tasks[i].params.depth for i in active) + 1):
        work, derived = [], {}
        for i in active:
            p, nodes = tasks[i].params, open_nodes[i]
            if not nodes or level >= p.depth:
                continue
            if level == 0:
                wanted = [0]
            else:
                wanted, derived[i] = [], []
                for left in range(nodes[0], nodes[-1] + 1, 2):
                    if left in nodes:
                        small = left if trees[i].rows[left] <= trees[i].rows[left + 1] else left + 1
                        wanted.append(small)
                        derived[i].append((2 * left + 1 - small, small, (left - 1) // 2))
            work.append((i, given[i], len(tasks[i].trees), trees[i].arrays(), {n: k for k, n in enumerate(wanted)}))
        if not work:
            break
        found = _histograms(blocks, state, work)
        for i, _, _, _, slots in work:
            here = {n: found[i][k] for n, k in slots.items()}
            for other, small, parent in derived.get(i, []):
                here[other] = sums[i][parent] - here[small]
            sums[i] = here
            # On the driver columns lie side by side, as wide as the widest.
            padded = {n: _padded(x, shape) for n, x in here.items()}
            open_nodes[i] = _split_nodes(trees[i], padded, tasks[i].params, chosen[i], level)
    for i in active:
        tree, p = trees[i], tasks[i].params
        tree.value = [v * p.learning_rate for v in tree.value]
        tasks[i].trees.append(tree)


def _padded(sums, shape):
    import numpy as np

    out = np.zeros((*shape.shape, 3), dtype=np.int64)
    out[shape] = sums
    return out


def _split_nodes(tree: Tree, sums, params: BoostParams, columns, level: int) -> list[int]:
    """Split the nodes of a level where that gains; their children, in order."""
    out = []
    for node in sorted(sums):
        s = sums[node]
        if level == 0:
            g, h, n = (int(x) for x in s[0].sum(axis=0))
            tree.value[0], tree.rows[0] = -(g / UNIT) / (h / UNIT + params.leaf_penalty), n
        best = best_split(s, params, columns)
        if best is None:
            continue
        _, column, cut, missing_left = best
        tree.column[node], tree.cut[node], tree.missing_left[node] = column, cut, missing_left
        own = s[column]
        left = own[:cut + 1].sum(axis=0) if missing_left else own[1:cut + 1].sum(axis=0)
        for child, part in ((2 * node + 1, left), (2 * node + 2, own.sum(axis=0) - left)):
            g, h, n = (int(x) for x in part)
            tree.value[child], tree.rows[child] = -(g / UNIT) / (h / UNIT + params.leaf_penalty), n
        out += [2 * node + 1, 2 * node + 2]
    return sorted(out)


NODES = "tree int, node int, column string, cut int, missing_left boolean, value double, rows long"


@dataclass
class BoostedModel:
    """A fitted model: binning, constant and trees. The last link (probability, exp) is up to the caller."""

    binning: Binning
    params: BoostParams
    start: float
    trees: list[Tree]

    @staticmethod
    def of(task: Task, binning: Binning, trees: int | None = None) -> "BoostedModel":
        return BoostedModel(binning, task.params, task.start, task.trees[:trees])

    def _inputs(self) -> list[Column]:
        b = self.binning
        return [F.col(c).cast("double") for c in b.numeric] + [F.col(c).cast("string") for c in b.categorical]

    def margin(self) -> Column:
        """Margin of a row, from columns of the binning's names."""
        binned, start, depth = _binner(self.binning), self.start, self.params.depth
        trees = [t.arrays() for t in self.trees]
        if not self.binning.columns:
            return F.lit(float(start))

        @F.pandas_udf("double")
        def value(*columns):
            import numpy as np
            import pandas as pd

            bins = binned([c.to_numpy() for c in columns]).astype(np.int64)
            return pd.Series(_margin(trees, bins, depth, np.full(len(bins), start)))

        return value(*self._inputs())

    def contributions(self, df: DataFrame) -> DataFrame:
        """``df`` with ``base`` and an array ``contribution`` in the order of the binning's columns.

        A split's contribution is the value of the child taken minus the node's own, both as the mean of the leaves below,
        weighted by rows of the fit. Over a path and over all trees these and the base add up to the margin.
        """
        binned, width, depth = _binner(self.binning), len(self.binning.columns), self.params.depth
        expected = [_expected(t) for t in self.trees]
        trees, base = [t.arrays() for t in self.trees], self.start + sum(e[0] for e in expected)

        @F.pandas_udf("array<double>")
        def parts(*columns):
            import numpy as np
            import pandas as pd

            bins = binned([c.to_numpy() for c in columns]).astype(np.int64)
            out, at = np.zeros((len(bins), width)), np.arange(len(bins))
            for (column, cut, missing_left, _), value in zip(trees, expected):
                node = np.zeros(len(bins), dtype=np.int64)
                for _ in range(depth):
                    inner = column[node] >= 0
                    if not inner.any():
                        break
                    used = np.maximum(column[node], 0)
                    b = bins[at, used]
                    child = np.where(inner, 2 * node + 1 + np.where(b == 0, ~missing_left[node], b > cut[node]), node)
                    np.add.at(out, (at, used), np.where(inner, value[child] - value[node], 0.0))
                    node = child
            return pd.Series(list(out))

        found = parts(*self._inputs()) if width else F.array().cast("array<double>")
        return df.withColumn("base", F.lit(float(base))).withColumn("contribution", found)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as a table, a row per node."""
        names = self.binning.columns
        rows = [(k, i, names[t.column[i]] if t.column[i] >= 0 else None, int(t.cut[i]), bool(t.missing_left[i]), float(t.value[i]), int(t.rows[i]))
                for k, t in enumerate(self.trees) for i in range(len(t.column)) if i == 0 or t.column[(i - 1) // 2] >= 0]
        return spark.createDataFrame(rows, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        write_json(spark, f"{path}/settings", {"binning": json.dumps(asdict(self.binning)), "params": asdict(self.params), "start": self.start, "trees": len(self.trees)})

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedModel":
        meta = read_json(spark, f"{path}/settings")
        binning, params = Binning(**json.loads(meta["binning"])), BoostParams(**meta["params"])
        size, place = (2 << params.depth) - 1, {c: i for i, c in enumerate(binning.columns)}
        trees = [Tree([-1] * size, [0] * size, [False] * size, [0.0] * size, [0] * size) for _ in range(meta["trees"])]
        for r in spark.read.parquet(f"{path}/nodes").collect():
            t, i = trees[r["tree"]], r["node"]
            t.column[i], t.cut[i], t.missing_left[i] = place.get(r["column"], -1), r["cut"], r["missing_left"]
            t.value[i], t.rows[i] = r["value"], r["rows"]
        return BoostedModel(binning, params, meta["start"], trees)


def _expected(tree: Tree):
    """Mean value of the leaves below every node, weighted by rows."""
    import numpy as np

    value = np.asarray(tree.value, dtype=float)
    for i in range(len(value) - 1, -1, -1):
        if tree.column[i] >= 0:
            left, right = tree.rows[2 * i + 1], tree.rows[2 * i + 2]
            value[i] = (value[2 * i + 1] * left + value[2 * i + 2] * right) / (left + right)
    return value
