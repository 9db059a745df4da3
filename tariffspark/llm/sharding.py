"""Hilbert-curve ordering of documents and shards cut from the order.

Each metadata dimension is quantised to ``bits`` bits: numbers by equal-depth
cells from a mergeable sketch over all rows, text by hash, as only equal values
matter for pruning there. Rows are sorted by the curve index and
cut into runs, so that a file holds a narrow box of every dimension.

Defined results: nulls fall into cell 0, null texts have no bytes, ties are
broken by id and text, equal rows are interchangeable, an empty table gives no
rows, other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, NumericType

from tariffspark.llm.lookups import ranked
from tariffspark.llm.sketch import cell
from tariffspark.llm.text import free_names, text_key, whole
from tariffspark.session import materialize


def cells(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """One expression per dimension with values 0 to 2**bits - 1."""
    n = 1 << bits
    out = []
    for d in dims:
        c = F.col(f"`{d}`")
        if not isinstance(df.schema[d].dataType, NumericType):
            out.append(F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c.cast("string")), F.lit(n))).cast("long"))
            continue
        whole_number = F.floor(c.cast("double")).cast("long") if isinstance(df.schema[d].dataType, FractionalType) else c.cast("long")
        least = df.agg(F.min(whole_number)).first()[0] or 0
        value = whole_number - F.lit(least)
        counts = df.where(c.isNotNull()).groupBy(cell(value).alias("low")).agg(F.count(F.lit(1)).alias("n"))
        # A sketch has a bounded number of cells, so one task may order them and their edges fit a literal.
        before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
        every = Window.partitionBy()
        place = counts.withColumn("at", F.floor(
            F.coalesce(F.sum("n").over(before), F.lit(0)).cast("decimal(38,0)") * n / F.sum("n").over(every)).cast("long"))
        cuts = sorted(r["low"] for r in place.where("at > 0").groupBy("at").agg(F.min("low").alias("low")).collect())
        steps = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
        out.append(F.when(c.isNull(), 0).otherwise(F.size(F.filter(steps, lambda e: e <= value))).cast("long"))  # noqa: B023
    return out


def hilbert_index(x: Column, bits: int, dims: int) -> Column:
    """Place on the curve of a point given as an array of ``dims`` cells.

    The cells are turned into the transposed form (undo the excess rotations
    bit by bit, then Gray-encode) and their bits are interleaved. Folds keep
    the expression small whatever the number of bits.
    """
    def at(a: Column, i: Column) -> Column:
        return F.element_at(a, (i + 1).cast("int"))

    def put(a: Column, i: Column, v: Column) -> Column:
        return F.transform(a, lambda e, j: F.when(j == i, v).otherwise(e))

    def rotate(a: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        p = q - 1
        flip = at(a, i).bitwiseAND(q) != 0
        swap = at(a, F.lit(0)).bitwiseXOR(at(a, i)).bitwiseAND(p)
        swapped = put(a, F.lit(0), at(a, F.lit(0)).bitwiseXOR(swap))
        return F.when(flip, put(a, F.lit(0), at(a, F.lit(0)).bitwiseXOR(p))).otherwise(
            F.when(i == 0, a).otherwise(put(swapped, i, at(a, i).bitwiseXOR(swap))))

    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dims)])
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def given(value: Column, use) -> Column:
        """``use(value)`` with the value computed once, however often it is named."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def interleaved(point: Column) -> Column:
        order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])
        return F.aggregate(order, zero, lambda h, s: h * 2 + F.call_function("shiftright", at(point, s["i"]), s["b"]).bitwiseAND(one))

    def untwisted(gray: Column) -> Column:
        if bits == 1:
            return interleaved(gray)
        tail = given(F.element_at(gray, -1), lambda last: F.aggregate(
            F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]), zero,
            lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)))
        return given(tail, lambda t: given(F.transform(gray, lambda e: e.bitwiseXOR(t)), interleaved))

    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dims)])
    turned = F.aggregate(steps, x.cast("array<long>"), rotate) if bits > 1 else x.cast("array<long>")
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(dims - 1)), turned, lambda a, i: put(a, i, at(a, i).bitwiseXOR(at(a, i - 1)))) if dims > 1 else turned
    return given(gray, untwisted)


def hilbert_shards(docs: DataFrame, dims: list[str], shards: int = 16, law: str = "rows", bits: int = 6, id_column: str = "doc_id",
                   text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default all) with struct ``placed`` (size, hilbert, shard, slot); slots count from 0 in every shard.

    ``law='rows'``: counts of shards are at most one apart. ``law='bytes'``:
    every shard ends at its part of all bytes, so sizes differ by one document.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    out, size, index, key, place, number, slot, spot = free_names(
        docs.columns, "placed", "__size", "__hilbert", "__text", "__place", "__shard", "__slot", "__point")
    sized = docs.withColumn(size, F.octet_length(whole(F.col(text_column))).cast("long") + 1)
    point = F.array(*cells(docs, dims, bits))
    rows = sized.withColumn(spot, point).withColumn(index, hilbert_index(F.col(spot), bits, len(dims))).drop(spot)
    keep = docs.columns if keep is None else keep
    carried = [F.col(f"`{c}`") for c in dict.fromkeys([*keep, id_column])]
    rows = rows.select(*carried, size, index, text_key(F.col(text_column)).alias(key))
    order = [F.col(index), F.col(f"`{id_column}`"), F.col(key)]
    placed, n = ranked(rows, order, place, "hilbert")
    if law == "rows":
        shard = F.expr(f"`{place}` * {shards} div {max(n, 1)}").cast("int")
        first = F.expr(f"({max(n, 1)} * `{number}` + {shards - 1}) div {shards}")
        done = placed.withColumn(number, shard).withColumn(slot, F.col(place) - first)
    else:
        done = _by_bytes(placed, size, place, number, slot, shards, max(n, 1))
    struct = F.struct(F.col(size).alias("size"), F.col(index).alias("hilbert"), F.col(number).alias("shard"), F.col(slot).cast("long").alias("slot"))
    return done.select(*[F.col(f"`{c}`") for c in keep], struct.alias(out))


def _by_bytes(placed: DataFrame, size: str, place: str, number: str, slot: str, shards: int, n: int) -> DataFrame:
    """Cumulative bytes from blocks of places: sums per block give offsets, a window finishes inside each block."""
    block = max(1, min(100_000, int(n ** 0.5) + 1))
    group, total_of, start, cum, first = free_names(placed.columns, "__block", "__sum", "__from", "__cum", "__first")
    rows = materialize(placed.withColumn(group, F.expr(f"`{place}` div {block}")), "hilbert-bytes")
    sums = rows.groupBy(group).agg(F.sum(size).alias(total_of))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn(start, F.coalesce(F.sum(total_of).over(before), F.lit(0))).drop(total_of)
    total = max(1, rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    inside = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.join(offsets, group).withColumn(cum, F.col(start) + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    shard = F.expr(f"cast(`{cum}` as decimal(38,0)) * {shards} div {total}").cast("int")
    done = materialize(summed.withColumn(number, shard).drop(group, cum, start), "hilbert-bytes")
    firsts = done.groupBy(number).agg(F.min(place).alias(first))
    return done.join(F.broadcast(firsts), number).withColumn(slot, F.col(place) - F.col(first)).drop(first)


def write_shards(placed: DataFrame, path: str, struct: str = "placed") -> None:
    """One folder per shard, rows in the order of their slots; readers prune shards by the statistics of the files."""
    shard, slot = F.col(f"{struct}.shard"), F.col(f"{struct}.slot")
    (placed.withColumn("shard", shard).withColumn("slot", slot).repartitionByRange(shard, slot).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
