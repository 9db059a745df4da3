"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over the training run, given as knots
(time 0 to 1, weight) with straight lines between them. Its integral is the
source's share of the token budget; where a share asks for more than
``most_repeats`` passes over the source, the excess goes to the other sources
by weight. Documents of a source stand in the order of a keyed hash; their
cumulative tokens are the source's supply, and the inverse of the cumulative
demand gives each copy its training position. Rows are range-sorted by it.

Positions are worked out on narrow rows (source, order, size). Texts move once:
the run is cut into ``slices`` of equal length, and because the copies of one
pass over a source stand in the order of their hashes, a short table says from
which hash on a slice begins. A row finds its slices by its own hash, goes
there, and gets its exact position from the running sum inside the slice.

A copy is taken if its middle token lies inside the target, so taken words
differ from the target by half a document at most.

Defined results: null texts and texts without words have size 0; null sources
are one source, last in order; equal rows take neighbouring places; a source
missing from the schedules has weight 0 and is not taken; an empty table gives
no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.llm.lookups import bounded
from tariffspark.llm.text import free_names, whole, words
from tariffspark.session import materialize

BINS = 4096  # parts of a source's hash order; a third of all rows in one source still makes BINS groups


def source_key(c: Column) -> Column:
    """Sorts by code point, null last."""
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))


def order_key(id_column: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(id_column.cast("string"), F.lit("")), F.lit("|"), F.md5(whole(text))))


def filled_targets(sources: DataFrame, budget: float, most_repeats: float) -> DataFrame:
    """``sources(key, source_size, weight)`` with ``target``: the budget by weight, never above ``most_repeats`` times the size.

    Each round is one aggregation over the sources; the set of full sources
    only grows, so the rounds end.
    """
    cap = F.col("source_size") * F.lit(float(most_repeats))
    level, full = None, -1
    while True:
        is_full = F.lit(False) if level is None else cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(is_full, cap)).alias("c"), F.sum(F.when(~is_full, F.col("weight"))).alias("w"),
                          F.count(F.when(is_full, 1)).alias("n")).first()
        if row["n"] == full or not row["w"]:
            break
        full, level = row["n"], (float(budget) - (row["c"] or 0.0)) / row["w"]
    target = F.lit(0.0) if level is None else F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def schedule_area(knots: Column) -> Column:
    """Integral of the polygon through ``knots`` (array of t, w, in order of t)."""
    pairs = F.arrays_zip(F.slice(knots, 1, F.size(knots) - 1).alias("a"), F.slice(knots, 2, F.size(knots) - 1).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["b"]["t"] - p["a"]["t"]) * (p["a"]["w"] + p["b"]["w"]) / 2)


def inverse_area(knots: Column, share: Column) -> Column:
    """Time at which ``share`` (0 to 1) of the integral is reached."""
    pairs = F.arrays_zip(F.slice(knots, 1, F.size(knots) - 1).alias("a"), F.slice(knots, 2, F.size(knots) - 1).alias("b"))
    start = F.struct((share * schedule_area(knots)).alias("left"), F.lit(None).cast("double").alias("t"))

    def step(s: Column, p: Column) -> Column:
        width, w0, w1 = p["b"]["t"] - p["a"]["t"], p["a"]["w"], p["b"]["w"]
        area = width * (w0 + w1) / 2
        slope = (w1 - w0) / width
        root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * s["left"], F.lit(0.0)))
        inside = p["a"]["t"] + F.when(w0 + root > 0, 2 * s["left"] / (w0 + root)).otherwise(0.0)
        here = s["t"].isNull() & (s["left"] <= area) & (width > 0)
        return F.struct((s["left"] - area).alias("left"), F.when(here, F.least(inside, p["b"]["t"])).otherwise(s["t"]).alias("t"))

    return F.aggregate(pairs, start, step, lambda s: F.coalesce(s["t"], F.lit(1.0)))


def _supply(docs: DataFrame, schedules: DataFrame, budget_share: float, most_repeats: float, seed: str, id_column: str, text_column: str, source_column: str):
    """``docs`` with source key, order, bin and size, and per (source, bin) what stands before it, with the source's size, target and knots."""
    names = free_names(docs.columns, "__key", "__order", "__bin", "__size", "__supply")
    key, order, at, size, info = names
    text = F.col(text_column)
    rows = (docs.withColumn(key, source_key(F.col(source_column))).withColumn(order, order_key(F.col(id_column), text, seed))
            .withColumn(at, F.expr(f"cast(conv(substring(`{order}`, 1, 4), 16, 10) as int) div {65536 // BINS}").cast("int"))
            .withColumn(size, F.size(words(whole(text))).cast("long")))
    bins = materialize(rows.groupBy(F.col(key).alias("key"), F.col(at).alias("bin")).agg(F.sum(size).alias("words")), "mix-bins")
    sizes = bins.groupBy("key").agg(F.sum("words").alias("source_size"))
    sources = materialize(sizes.join(bounded(schedules), "key", "left").withColumn("weight", F.coalesce(schedule_area(F.col("knots")), F.lit(0.0))), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = filled_targets(sources, budget_share * total, most_repeats)
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    supply = materialize(bins.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
                         .join(targets, "key").select(F.col("key").alias(key), F.col("bin").alias(at), F.struct("before", "source_size", "target", "knots").alias(info)), "mix-supply")
    return rows, supply, names, int(total)


def _passes(most_repeats: float) -> int:
    return int(-(-most_repeats // 1))


def _placed(rows: DataFrame, supply: DataFrame, names: list[str], inner: str) -> DataFrame:
    """``rows`` with their supply and the words before them in their bin."""
    key, order, at, size, _ = names
    inside = Window.partitionBy(key, at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(inner, F.coalesce(F.sum(size).over(inside), F.lit(0))).join(bounded(supply), [key, at])


def mix_counts(docs: DataFrame, schedules: DataFrame, budget_share: float = 1.5, most_repeats: float = 2.0, seed: str = "mix",
               id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``docs`` with struct ``mix``: size, source_size, target, copies, taken, positions (one per copy).

    ``schedules(key, knots)`` holds ``source_key`` and an array of (t, w);
    the budget is ``budget_share`` times all words. All columns of ``docs`` are shuffled: give those that are needed.
    """
    out, inner = free_names(docs.columns, "mix", "__in")
    rows, supply, names, _ = _supply(docs, schedules, budget_share, most_repeats, seed, id_column, text_column, source_column)
    held = [f"`{c}`" for c in docs.columns]
    s, i = F.col(names[3]), F.col(names[4])
    first = i["before"] + F.col(inner)
    # Pass p over the source begins at p times its size.
    middles = F.array(*[(first + p * i["source_size"] + s / 2.0) for p in range(_passes(most_repeats))])
    taken = F.filter(middles, lambda m: m < i["target"])
    copies = F.size(taken).cast("long")
    positions = F.transform(taken, lambda m: inverse_area(i["knots"], m / i["target"]))
    struct = F.struct(s.alias("size"), i["source_size"].cast("long").alias("source_size"), i["target"].cast("double").alias("target"), copies.alias("copies"),
                      (copies * s).alias("taken"), positions.alias("positions"))
    return _placed(rows, supply, names, inner).select(*held, struct.alias(out))


def in_training_order(counted: DataFrame, mix: str = "mix") -> DataFrame:
    """Rows of ``mix_counts`` range-sorted by the position of their first copy; those not taken stand last."""
    first = F.coalesce(F.get(F.col(f"{mix}.positions"), F.lit(0)), F.lit(2.0))
    return counted.repartitionByRange(first).sortWithinPartitions(first)


def mixed(docs: DataFrame, schedules: DataFrame, budget_share: float = 1.5, most_repeats: float = 2.0, seed: str = "mix", id_column: str = "doc_id",
          text_column: str = "text", source_column: str = "source", slice_words: int = 1 << 22, least_slices: int = 4096) -> DataFrame:
    """The mix itself: one row per taken copy with the columns of ``docs``, in the order of training positions.

    A slice of the run holds about ``slice_words`` words, and there are ``least_slices`` at least: it is what one task sorts.
    """
    rows, supply, names, total = _supply(docs, schedules, budget_share, most_repeats, seed, id_column, text_column, source_column)
    key, order, at, size, info = names
    slices = max(least_slices, int(total * budget_share) // slice_words)
    taken = free_names([*docs.columns, *names], "__in", "__stretches", "__stretch", "__first", "__middle", "__position")
    inner, stretches, stretch, first, middle, position = taken
    i = F.col(info)

    # Where every slice begins in each pass over a source, on narrow rows. Equal rows begin together.
    run = Window.partitionBy(key, at).orderBy(order)
    narrow = _placed(rows.select(key, order, at, size), supply, names, inner)
    narrow = narrow.withColumn(middle, F.when(F.coalesce(F.lag(order).over(run) != F.col(order), F.lit(True)), F.col(inner)))
    start = i["before"] + F.max(middle).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    narrow = narrow.withColumn(first, start).drop(middle)
    start = F.col(first)
    passes = F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), (start + p * i["source_size"]).cast("long").alias("first")) for p in range(_passes(most_repeats))]))
    copies = narrow.select(key, at, order, F.col(size).alias("size"), info, passes.alias("copy")).select(
        key, at, order, "copy.*", (F.col("copy.first") + F.col("size") / 2.0).alias("middle"), info).where(F.col("middle") < i["target"])
    share = inverse_area(i["knots"], F.col("middle") / i["target"])
    sliced = copies.select(key, at, order, "pass", "first", F.least(F.floor(share * slices), F.lit(slices - 1)).cast("int").alias("slice"))
    begins = sliced.groupBy(key, at, "pass", "slice").agg(F.min(F.struct(order, "first")).alias("b"))
    begins = begins.groupBy(key, at).agg(F.collect_list(F.struct("pass", F.col(f"b.{order}").alias("from"), "slice", F.col("b.first").alias("first"))).alias(stretches))
    begins = materialize(begins.join(supply, [key, at]), "mix-slices")

    met = rows.join(bounded(begins), [key, at])
    latest = lambda p: F.array_max(F.filter(F.col(stretches), lambda b: (b["pass"] == p) & (b["from"] <= F.col(order))))
    mine = F.array(*[latest(p) for p in range(_passes(most_repeats))])
    met = met.withColumn(stretch, F.explode(F.array_compact(mine)))
    b = F.col(stretch)
    here = Window.partitionBy(f"{stretch}.slice", key, f"{stretch}.pass", at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = met.repartitionByRange(F.col(f"{stretch}.slice")).withColumn(first, b["first"] + F.coalesce(F.sum(size).over(here), F.lit(0)))
    met = met.withColumn(middle, F.col(first) + F.col(size) / 2.0).where(F.col(middle) < i["target"])
    met = met.withColumn(position, inverse_area(i["knots"], F.col(middle) / i["target"]))
    return met.sortWithinPartitions(f"{stretch}.slice", position).select(*[f"`{c}`" for c in docs.columns])
