"""Quality rules whose thresholds come from the data.

One pass over the texts counts words, symbols, repeated lines and repeated
word windows. The counts give ratios, the ratios go into mergeable quantile
sketches (``sketch.py``) per language and source, and a document is dropped
where a ratio lies outside the fence of its group: quartiles plus ``reach``
times the quartile distance, which is never taken below ``floor``. A group
borrows ``POINTS * prior`` documents that stand at evenly spaced ranks of its
language, so that thresholds of small groups move smoothly to those of their
language. A
few base rules need no threshold of the corpus.

Defined results: null and empty texts have no words and fail the base rule;
null languages and sources are groups of their own; ties lie inside the fence;
equal rows get equal verdicts; an empty table gives no rows; other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.llm.lookups import bounded
from tariffspark.llm.sketch import cell, cell_top
from tariffspark.llm.text import free_names
from tariffspark.session import materialize

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
# ratio -> (numerator, denominator, checked below, checked above, least quartile distance), in millionths
RATIOS = {
    "word_length": ("word_chars", "n_words", True, True, 500_000),
    "symbols": ("n_symbols", "n_words", False, True, 20_000),
    "dup_lines": ("n_dup_lines", "n_lines", False, True, 200_000),
    "repeats": ("n_repeat_words", "n_words", False, True, 120_000),
}
MILLION = 1_000_000
POINTS = 32


def counter():
    """Pandas function from texts to ``COUNTS``; it imports what it needs, so that executors need no more than pandas."""

    @F.pandas_udf(COUNTS)
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import re
        from collections import Counter

        symbols_of = re.compile(r"[#*$%&|<>]").findall
        has_word = re.compile(r"[^\x20\x09-\x0D]").search

        def one(text):
            if not text:
                return 0, 0, 0, 0, 0, 0
            words = text.encode().split()  # bytes are split at ASCII white space alone
            n = len(words)
            lines = [x for x in text.split("\n") if has_word(x)]
            seen = Counter(zip(words, words[1:], words[2:]))
            repeated = 0
            if len(seen) < n - 2:
                end = 0
                for i in range(n - 2):
                    if seen[words[i], words[i + 1], words[i + 2]] > 1:
                        repeated += i + 3 - max(i, end)
                        end = i + 3
            return n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), len(symbols_of(text)), len(lines), len(lines) - len(set(lines)), repeated

        names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=names, dtype="int64")

    return count


def _ratio(counts: Column, name: str) -> Column:
    top, under = RATIOS[name][:2]
    return F.when(counts[under] > 0, F.call_function("floor", counts[top] * F.lit(MILLION) / counts[under])).otherwise(0).cast("long")


def base_failed(counts: Column, least_words: int = 50, most_repeat_percent: int = 50) -> Column:
    return (counts["n_words"] < least_words) | (counts["n_repeat_words"] * 100 > counts["n_words"] * most_repeat_percent)


def fences(measured: DataFrame, group: list[str], counts: str, prior: int = 3, reach: int = 3) -> DataFrame:
    """(lang, source, low and high per ratio) from sketches of the documents that pass the base rules.

    ``group`` names the columns of language and source. All ranks are whole
    numbers, so that the fences repeat exactly.
    """
    lang, source = group
    c = F.col(counts)
    ratios = F.array(*[F.struct(F.lit(name).alias("ratio"), cell(_ratio(c, name)).alias("low")) for name in RATIOS])
    sketch = materialize(measured.where(~base_failed(c)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(ratios).alias("r"))
                         .groupBy("lang", "source", "r.ratio", "r.low").agg(F.count(F.lit(1)).alias("n")), "quality-sketch")
    of_lang = sketch.groupBy("lang", "ratio", "low").agg(F.sum("n").alias("n_lang"))
    in_order = Window.partitionBy("lang", "ratio").orderBy("low")
    placed = of_lang.select("lang", "ratio", "low", "n_lang", F.sum("n_lang").over(in_order).alias("upto"),
                            F.sum("n_lang").over(Window.partitionBy("lang", "ratio")).alias("t"))
    # How many of the POINTS middles (2 i + 1) / (2 POINTS) of the language's order fall into the cell.
    upper, lower = f"({2 * POINTS} * upto + t) div (2 * t)", f"({2 * POINTS} * (upto - n_lang) + t) div (2 * t)"
    borrowed = placed.select("lang", "ratio", "low", (F.expr(f"{upper} - {lower}") * prior).alias("n")).where("n > 0")
    groups = sketch.select("lang", "source").distinct()
    lent = (groups.alias("g").join(borrowed.alias("b"), F.col("g.lang").eqNullSafe(F.col("b.lang")))
            .select("g.lang", "g.source", "ratio", "low", "n"))
    cells = sketch.unionByName(lent).groupBy("lang", "source", "ratio", "low").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("lang", "source", "ratio").orderBy("low")
    whole = Window.partitionBy("lang", "source", "ratio")
    at = cells.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"))
    quartile = (at.groupBy("lang", "source", "ratio")
                .agg(F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("low"))).alias("q1"),
                     F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("low"))).alias("q3"))
                .withColumn("q3", cell_top(F.col("q3"))))
    floor = F.create_map(*[x for name, r in RATIOS.items() for x in (F.lit(name), F.lit(r[4]))])[F.col("ratio")]
    span = F.greatest(F.col("q3") - F.col("q1"), floor) * reach
    bounds = quartile.select("lang", "source", "ratio", (F.col("q1") - span).alias("low"), (F.col("q3") + span).alias("high"))
    return bounds.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("ratio") == name, F.struct("low", "high"))).alias(name) for name in RATIOS])


def judge(docs: DataFrame, prior: int = 3, reach: int = 3, text_column: str = "text", lang_column: str = "lang",
          source_column: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default all) with struct ``quality``: the counts, base_failed, kept, and the ratios that failed."""
    keep = docs.columns if keep is None else keep
    out, counts, lang, source, fence, its, from_ = free_names(docs.columns, "quality", "__counts", "__lang", "__source", "__fence", "__of", "__from")
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(lang_column).cast("string").alias(lang), F.col(source_column).cast("string").alias(source),
                       counter()(F.col(text_column).cast("string")).alias(counts))
    measured = materialize(rows, "quality-counts")
    table = materialize(fences(measured, [lang, source], counts, prior, reach), "quality-fences")
    limits = bounded(table.select(F.col("lang").alias(its), F.col("source").alias(from_), F.struct(*RATIOS).alias(fence)))
    met = measured.join(limits, F.col(lang).eqNullSafe(F.col(its)) & F.col(source).eqNullSafe(F.col(from_)), "left")
    c = F.col(counts)
    failed = []
    for name, (_, _, below, above, _) in RATIOS.items():
        ratio, limit = cell(_ratio(c, name)), F.col(fence)[name]
        outside = [ratio < limit["low"]] * below + [ratio > limit["high"]] * above
        failed.append(F.when(outside[0] if len(outside) == 1 else outside[0] | outside[1], F.lit(name)))
    base = base_failed(c)
    reasons = F.array_compact(F.array(*failed))
    struct = F.struct(*[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")],
                      base.alias("base_failed"), (~base & (F.size(reasons) == 0)).alias("kept"), reasons.alias("failed"))
    return met.select(*[f"`{x}`" for x in keep], struct.alias(out))


def passing(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    out = free_names(docs.columns, "quality")[0]
    return judge(docs, **settings).where(F.col(f"{out}.kept")).drop(out)
