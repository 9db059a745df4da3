"""Approximate nearest neighbours by inner product: stable projections, kd-trees and a chi-square stop.

1. The largest inner product becomes the least distance: a vector x gets one
   more component ``sqrt(M^2 - |x|^2)`` (M the largest norm), a query a 0, and
   then ``|q - x|^2 = |q|^2 + M^2 - 2 q.x``.
2. ``dims`` Gaussian (2-stable) projections: the projected squared distance of
   a pair is its squared distance times a chi-square variable of ``dims``
   degrees of freedom.
3. The first splits of a kd-tree over the projections are fitted on a bounded
   sample; every row goes to its cell, and cells are range-partitioned with a
   hash behind the cell, so that a cell with a third of all rows is cut. Each
   task builds the rest of the tree over the rows it reads, all of them.
4. A query meets the leaves by projected distance and verifies their rows on
   the original vectors. It stops when the next leaf is so far that
   ``chi2(dims) <= (projected distance)^2 / (distance of the k-th found)^2``
   holds with probability ``certainty``: a nearer row would have been met.
   The distance of the k-th is first bounded in the query's own cell, then all
   cells are searched under that bound.

Queries are handed to the tasks in blocks of about ``block_rows``; that bounds
what one job ships, the index itself never moves to meet them. Every task
returns at most its ``k`` best for a query, and ties.

Defined results: vectors that are null, zero, hold null or non-finite
components or have another length than most (ties: the shorter) take no part,
nor do rows without an id. Copies of a vector count each with its id; a
repeated row counts once; vectors that share an id stand for it together. Ties go to the smaller id. A query with fewer than
``k`` candidates gets all of them. Empty tables give no rows; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffspark.session import materialize

SCHEMA = "query_id long, vec_id long, score double"
CLOSE = 1e-9  # scores of one matrix product may differ in their last bits; nearer than this both are ranked exactly


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom."""
    import math

    def beyond(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(dims // 2):
            total += term
            term *= (x / 2) / (i + 1)
        return math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while beyond(high) > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > 1 - p else (low, middle)
    return high


def projector(width: int, dims: int, seed: int, norm2: float):
    """(vectors, whether they are queries) -> projections; for use inside tasks and on the driver."""

    def project(x, query: bool):
        import numpy as np

        g = np.random.default_rng(seed).standard_normal((width + 1, dims))
        y = x @ g[:width]
        return y if query else y + np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", x, x), 0.0))[:, None] * g[width]

    return project


def kd_split(y, leaf_rows: int, most_leaves: int = 1 << 40):
    """Median splits along the widest side -> (splits, leaves): splits as (axis, value, left, right) with leaves as ~number, leaves as row arrays."""
    import numpy as np

    splits, leaves = [], []

    def grow(rows, leaves_left):
        part = y[rows]
        spread = part.max(0) - part.min(0) if len(rows) else np.zeros(y.shape[1])
        axis = int(spread.argmax())
        if len(rows) <= leaf_rows or leaves_left < 2 or spread[axis] <= 0:
            leaves.append(rows)
            return ~(len(leaves) - 1)
        values = part[:, axis]
        cut = float(np.partition(values, len(values) // 2)[len(values) // 2])
        low = values < cut
        if not low.any():  # the median is the least value: its copies go left
            cut = float(values[values > cut].min())
            low = values < cut
        at = len(splits)
        splits.append(None)
        left = grow(rows[low], leaves_left // 2)
        splits[at] = (axis, cut, left, grow(rows[~low], leaves_left - leaves_left // 2))
        return at

    grow(np.arange(len(y)), most_leaves)
    return splits, leaves


def cells_of(y, splits):
    """Leaf number of every projected row under ``splits``."""
    import numpy as np

    out = np.zeros(len(y), dtype=np.int64)
    if splits:
        stack = [(0, np.arange(len(y)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = ~node
                continue
            axis, cut, left, right = splits[node]
            low = y[rows, axis] < cut
            stack += [(left, rows[low]), (right, rows[~low])]
    return out


def _vectors(batch, column: int, kind: str, width: int):
    import numpy as np

    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype=kind).reshape(batch.num_rows, width).astype(np.float64)


def _placed(project, splits, kind: str, width: int):
    """(id, vector as bytes) -> (cell, id, vector)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                cell = cells_of(project(_vectors(batch, 1, kind, width), False), splits)
                yield pa.record_batch([pa.array(cell.astype("int32")), batch.column(0), batch.column(1)], names=["cell", "vec_id", "vector"])

    return run


def _packed(kind: str):
    """(id, array) -> (id, vector as bytes)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            blobs = [np.asarray(v, dtype=kind).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(blobs, pa.binary())], names=["vec_id", "vector"])

    return run


def _found(project, kind: str, width: int, norm2: float, radius2: float, k: int, leaf_rows: int, tree_rows: int, block, home: bool):
    """Index rows (cell, id, vector) -> (query_id, vec_id, score) of the best of every tree for every query of ``block``.

    ``block``: query ids, vectors, cells and, unless ``home``, for each the least score that still matters.
    """
    query_ids, query_vectors, query_cells, least = block

    def search(ids, cells, x):
        import numpy as np

        wanted = np.flatnonzero(np.isin(query_cells, cells)) if home else np.arange(len(query_ids))
        if not len(wanted):
            return None
        # Copies of a vector are one point; of its ids only the k + 1 least can be answers.
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        fresh = np.append(True, (x[1:] != x[:-1]).any(1))
        point = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        point_at, x = first, x[fresh]
        count = np.minimum(np.diff(np.append(first, len(ids))), 2 * k + 2)
        y = project(x, False)
        _, leaves = kd_split(y, leaf_rows)
        q, floor = query_vectors[wanted], least[wanted]
        qy, q2 = project(q, True), np.einsum("ij,ij->i", q, q)
        near = np.zeros((len(q), len(leaves)))
        for j, rows in enumerate(leaves):
            gap = np.maximum(np.maximum(y[rows].min(0) - qy, qy - y[rows].max(0)), 0.0)
            near[:, j] = np.einsum("ij,ij->i", gap, gap)
        turn = np.argsort(near, axis=1, kind="stable")
        near = np.take_along_axis(near, turn, axis=1)
        best = np.full((len(q), k + 1), -np.inf)
        active, met = np.arange(len(q)), []
        for step in range(len(leaves)):
            kth = np.maximum(best[active, 0], floor[active])
            reach = np.maximum(q2[active] + norm2 - 2 * kth, 0.0) * radius2
            active = active[near[active, step] <= reach + CLOSE * norm2]
            if not len(active):
                break
            to = turn[active, step]
            by_leaf = np.argsort(to, kind="stable")
            for group in np.split(active[by_leaf], np.flatnonzero(np.diff(to[by_leaf])) + 1):
                rows = leaves[turn[group[0], step]]
                scores = q[group] @ x[rows].T
                both = np.concatenate([best[group], scores], axis=1)
                best[group] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -k - 1:]
                keep = scores >= (np.maximum(best[group, 0], floor[group]) - CLOSE * norm2)[:, None]
                a, b = np.nonzero(keep)
                met.append((group[a], rows[b], scores[a, b]))
        if not met:
            return None
        a, b, s = (np.concatenate(c) for c in zip(*met))
        late = s >= np.maximum(best[a, 0], floor[a]) - CLOSE * norm2
        a, b = a[late], b[late]
        # Exactly the inner product, added in order of the components, whatever block a pair was met in.
        score = np.concatenate([np.cumsum(q[a[i:i + 65536]] * x[b[i:i + 65536]], axis=1)[:, -1] for i in range(0, len(a), 65536)])
        times = count[b]
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        a, score, own = np.repeat(a, times), np.repeat(score, times), ids[np.repeat(point_at[b], times) + offset]
        own_query = query_ids[wanted][a]
        other = own != own_query
        a, score, own, own_query = a[other], score[other], own[other], own_query[other]
        if not len(a):
            return None
        order = np.lexsort((own, -score, a))
        a, score, own, own_query = a[order], score[order], own[order], own_query[order]
        again = np.append(False, (a[1:] == a[:-1]) & (own[1:] == own[:-1]) & (score[1:] == score[:-1]))
        a, score, own, own_query = a[~again], score[~again], own[~again], own_query[~again]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        top = rank < k
        return own_query[top], own[top], score[top]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, rows = [], 0

        def out():
            cells, ids, x = (np.concatenate([h[i] for h in held]) for i in range(3))
            found = search(ids, cells, x)
            if found is not None:
                yield pa.record_batch([pa.array(found[0]), pa.array(found[1]), pa.array(found[2])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _vectors(batch, 2, kind, width)))
                rows += batch.num_rows
            if rows >= tree_rows:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, dims: int = 8, certainty: float = 0.95, cell_rows: int = 4096, leaf_rows: int = 256,
            tree_rows: int = 65536, block_rows: int = 4096, fit_rows: int = 8192, seed: int = 12, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (a condition on ``vec_id``) its ``k`` nearest found among all others.

    About ``fit_rows`` rows, by a hash of the id, fit the first splits; their number follows the rows, one cell
    for ``cell_rows``, at most half the fitted rows.
    """
    import numpy as np

    if dims % 2:
        raise ValueError("dims must be even")
    spark = vectors.sparkSession
    element = vectors.schema[vector_column].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    v, x = F.col("v"), F.col("v").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = (vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(x, lambda c: c != 0)))
    norm2 = F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c)
    lengths = rows.groupBy(F.size(v).alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("norm2"), F.count(F.when(is_query, 1)).alias("queries"))
    most = lengths.orderBy(F.desc("n"), "width").first()
    out = "query_id long, rank int, vec_id long, score double"
    if most is None or not most["queries"]:
        return spark.createDataFrame([], out)
    width, n, top2 = int(most["width"]), int(most["n"]), float(most["norm2"])
    project = projector(width, dims, seed, top2)
    packed = rows.where(F.size(v) == width).mapInArrow(_packed(kind), "vec_id long, vector binary")

    # A share of the rows by hash; the limit only guards against a hash that is far from even.
    share = packed.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, fit_rows / n) * (1 << 30))).limit(2 * fit_rows)
    sample = np.frombuffer(b"".join(r["vector"] for r in share.select("vector").collect()), dtype=kind).reshape(-1, width).astype(np.float64)
    cells = max(1, min(-(-n // cell_rows), len(sample) // 2))
    splits, _ = kd_split(project(sample, False), 1, cells) if len(sample) else ([], [])
    index = packed.mapInArrow(_placed(project, splits, kind, width), "cell int, vec_id long, vector binary")
    index = materialize(index.repartitionByRange("cell", F.xxhash64("vec_id")), "neighbours-index")

    radius2 = chi_square_quantile(certainty, dims)
    blocks = -(-int(most["queries"]) // block_rows)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = None
    for i in range(blocks):
        mine = index.where(is_query & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)).select("vec_id", "vector").dropDuplicates().collect()
        if not mine:
            continue
        ids = np.array([r["vec_id"] for r in mine], dtype=np.int64)
        q = np.frombuffer(b"".join(r["vector"] for r in mine), dtype=kind).reshape(-1, width).astype(np.float64)
        settings = (project, kind, width, top2, radius2, k, leaf_rows, tree_rows)
        no_floor = np.full(len(ids), -np.inf)
        own_cells = cells_of(project(q, False), splits)
        near = index.mapInArrow(_found(*settings, (ids, q, own_cells, no_floor), True), SCHEMA)
        near = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", "score")
        kth = {r["query_id"]: r["score"] for r in near.collect()}
        floor = np.array([kth.get(i, -np.inf) for i in ids.tolist()])
        found = materialize(index.mapInArrow(_found(*settings, (ids, q, own_cells, floor), False), SCHEMA), "neighbours-found")
        parts = found if parts is None else parts.unionByName(found)
    return (parts.dropDuplicates().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
