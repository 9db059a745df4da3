"""Benchmark decontamination as a prefix-filtered containment join.

An item becomes windows of ``window`` consecutive words; a shorter item is one
window. The words of a window are ordered by their rarity in the corpus, and
only the necessary prefix of that order is joined: a window of which a share
``containment`` must be found shares one of its ``k - ceil(containment * k) + 1``
rarest words, aligned, with every place where it occurs. The offset of the
prefix word gives the place, bounds on position and length drop places that
stick out, and the words of the place are compared with the window.

Defined results: null and empty texts have no words and no hits; items without
words have no window; a null item_id is the empty string; equal windows of
several items hit for all of them, repeated items count once; rows with equal
texts get equal results; empty tables give no hits; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.llm.lookups import bounded, chunks
from tariffspark.llm.text import NOT_ALNUM, ascii_lower, free_names, text_key, whole, words
from tariffspark.session import materialize


def tokens(column: str):
    return words(ascii_lower(whole(F.col(column))), NOT_ALNUM)


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, words): every window of every item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), tokens("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, F.least(F.size("w"), F.lit(window))).alias("words")).distinct()


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 10, containment: float = 1.0, text_column: str = "text") -> DataFrame:
    """(text, start, k, item_id): places of distinct texts, by ``text_key``, where a window of an item occurs."""
    members = materialize(item_windows(benchmark, window).withColumn("window", F.array_join("words", " ")), "bench-windows")
    distinct = members.select("window", "words").distinct()
    placed = distinct.select("window", F.size("words").alias("k"), F.posexplode("words").alias("offset", "word"))
    vocabulary = materialize(placed.select("word").distinct(), "bench-words")
    corpus = docs.select(tokens(text_column).alias("w"))
    counts = None
    for part in chunks(vocabulary, F.col("word")):
        found = corpus.select(F.explode("w").alias("word")).join(part, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        counts = found if counts is None else counts.unionByName(found)
    counts = materialize(counts, "bench-rarity")
    rarity = Window.partitionBy("window").orderBy("n", "word", "offset")
    need = F.ceil(F.col("k") * F.lit(containment) - F.lit(1e-9)).cast("int")
    prefix = (placed.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(rarity))
              .where(F.col("rank") <= F.col("k") - need + 1).where("n > 0").select("word", "offset", "k", "window"))
    probes = materialize(prefix, "bench-prefix")
    texts = docs.select(text_key(F.col(text_column)).alias("text"), tokens(text_column).alias("w"))
    hits = None
    for part in chunks(probes, F.col("word")):
        start = F.col("pos") - F.col("offset")
        tried = (texts.select("text", "w", F.posexplode("w").alias("pos", "word")).join(part, "word")
                 .where((start >= 0) & (start + F.col("k") <= F.size("w"))))
        place = F.slice("w", start + 1, F.col("k"))
        if containment >= 1.0:
            same = F.array_join(place, " ") == F.col("window")
        else:
            met = F.size(F.filter(F.zip_with(place, F.split("window", " "), lambda a, b: a == b), lambda e: e))
            same = met >= F.ceil(F.col("k") * F.lit(containment) - F.lit(1e-9))
        found = tried.where(same).select("text", start.alias("start"), "k", "window")
        hits = found if hits is None else hits.unionByName(found)
    hits = materialize(hits.distinct(), "bench-hits")
    return hits.join(bounded(members.select("item_id", "window")), "window").drop("window")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, containment: float = 1.0, text_column: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default all) with struct ``found``: n_words, n_hit (words inside any place), items (sorted ids)."""
    keep = docs.columns if keep is None else keep
    out, key, n, info = free_names(docs.columns, "found", "__text", "__n", "__found")
    hits = materialize(find_windows(docs, benchmark, window, containment, text_column), "bench-places")
    cover = (hits.select("text", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("k") - 1)).alias("pos")).distinct()
             .groupBy("text").agg(F.count(F.lit(1)).alias("n_hit")))
    items = hits.select("text", "item_id").distinct().groupBy("text").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = materialize(cover.join(items, "text").select(F.col("text").alias(key), F.struct("n_hit", "items").alias(info)), "bench-found")
    rows = docs.select(*[f"`{c}`" for c in keep], text_key(F.col(text_column)).alias(key), F.size(tokens(text_column)).cast("long").alias(n))
    met = rows.join(bounded(found), key, "left")
    struct = F.struct(F.col(n).alias("n_words"), F.coalesce(F.col(info)["n_hit"], F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce(F.col(info)["items"], F.array().cast("array<string>")).alias("items"))
    return met.select(*[f"`{c}`" for c in keep], struct.alias(out))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, containment: float = 1.0, text_column: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    texts = materialize(find_windows(docs, benchmark, window, containment, text_column).select("text").distinct(), "bench-dropped")
    key = free_names(docs.columns, "__text")[0]
    gone = bounded(texts.withColumnRenamed("text", key))
    return docs.withColumn(key, text_key(F.col(text_column))).join(gone, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
