"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding lower-cases, maps lookalike letters and digit or sign substitutes to
one plain letter (1, l, i, | and ! are one letter), and cuts words; the lexicon
is learned on folded words, so both sides meet. Entries are whole words and
beginnings of words whose document odds differ between toxic and clean labelled
texts; exception phrases, two words that mostly stand in clean texts, take back
the entries inside them. The score of a text is a logistic function of the
summed weights and of the same per length.

Learning uses at most ``fit_rows`` labelled documents of either class, those of
least key hash; scoring covers every text.

Defined results: null and empty texts match nothing and get the score of that;
documents without an id are never learned from; a document that is labelled
both ways counts both ways; without labels of both classes every score is 0;
equal texts get equal scores; an empty table gives no rows; other columns pass
through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffspark.llm.text import free_names
from tariffspark.session import materialize

# Signs that stand for a Latin letter, in folded form (l and i are one letter).
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
SHORTEST, LONGEST = 4, 7  # letters of beginnings of words


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: list[str] = field(default_factory=list)      # " word word "


def folder():
    """text -> folded words between single spaces; for use inside tasks."""
    table = str.maketrans(LOOKALIKES)

    def fold(text):
        import re
        import unicodedata

        if not text:
            return " "
        folded = text if text.isascii() else unicodedata.normalize("NFKC", text)
        words = re.findall(r"[^\W_]+", folded.lower().translate(table))
        return " " + " ".join(words) + " "

    return fold


def is_held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int, id_column: str, text_column: str) -> DataFrame:
    """(text, toxic) of the documents to learn from, equal texts once."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(fit_rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(fit_rows))
    # Twice fit_rows ids: a proven bound.
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("__id"), "toxic"))
    return docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("text")).join(chosen, "__id").select("text", "toxic").distinct()


def _terms():
    fold, short, long = folder(), SHORTEST, LONGEST

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            counts = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(fold(text).split())
                terms = {f" {w} " for w in words}
                terms.update(f" {w[:k]}" for w in words for k in range(short, min(long, len(w)) + 1))
                counts.update((t, toxic) for t in terms)
            yield pa.record_batch([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()),
                                   pa.array(list(counts.values()), pa.int64())], names=["term", "toxic", "n"])

    return run


def matcher(lexicon: Lexicon):
    """Folded text -> (start, end, weight) of the entries outside exceptions; for use inside tasks."""
    weights, exceptions = dict(lexicon.weights), list(lexicon.exceptions)

    def build():
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in {*weights, *exceptions}:
            machine.add_word(term, (len(term), weights.get(term), term in exceptions))
        if len(machine):
            machine.make_automaton()

        def hits(folded):
            if not len(machine):
                return []
            found, spared = [], []
            for end, (size, weight, exception) in machine.iter(folded):
                if exception:
                    spared.append((end - size + 1, end))
                elif weight is not None:
                    found.append((end - size + 1, end, weight))
            if spared:
                found = [h for h in found if not any(a <= h[0] and h[1] <= b for a, b in spared)]
            return found

        return hits

    return build


def _phrases(lexicon: Lexicon):
    fold, build = folder(), matcher(lexicon)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        hits = build()
        for batch in batches:
            counts = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, found = fold(text), set()
                for start, _, _ in hits(folded):
                    end = folded.index(" ", start + 1)
                    before, after = folded.rfind(" ", 0, max(start, 0)), folded.find(" ", end + 1)
                    if before >= 0:
                        found.add(folded[before:end + 1])
                    if after >= 0:
                        found.add(folded[start:after + 1])
                counts.update((p, toxic) for p in found)
            yield pa.record_batch([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()),
                                   pa.array(list(counts.values()), pa.int64())], names=["term", "toxic", "n"])

    return run


def learn_lexicon(texts: DataFrame, least_documents: int = 3, least_weight: float = 2.0, least_z: float = 3.0) -> Lexicon:
    """Lexicon of every term of ``texts(text, toxic)`` that passes the bounds; the labelled sample limits its size."""
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Lexicon()

    def counted(run):
        rows = texts.mapInArrow(run, "term string, toxic int, n long")
        return rows.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))

    weight = F.log((F.col("t") + 0.5) / (bad - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (good - F.col("c") + 0.5))
    z = F.col("weight") / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = (counted(_terms()).where(F.col("t") >= least_documents).withColumn("weight", weight).where((F.col("weight") >= least_weight) & (z >= least_z))
            .collect())
    weights: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (len(r["term"].rstrip()), r["term"])):
        # A beginning that says nearly as much covers its words.
        covers = [weights[k] for i in range(SHORTEST + 1, len(r["term"])) if (k := r["term"][:i]) in weights]
        if not covers or max(covers) < r["weight"] - 1.0:
            weights[r["term"]] = r["weight"]
    lexicon = Lexicon(weights)
    spared = counted(_phrases(lexicon)).where((F.col("c") >= least_documents) & (F.col("c") * bad > 10 * F.col("t") * good))
    lexicon.exceptions = [r["term"] for r in spared.orderBy(F.desc("c"), "term").collect()]
    return lexicon


def _features(lexicon: Lexicon):
    fold, build = folder(), matcher(lexicon)

    @F.pandas_udf("weight double, n_words long, n_hits long")
    def features(texts):
        import pandas as pd

        hits = build()
        rows = []
        for text in texts:
            folded = fold(text)
            # Of entries that begin at one word the heaviest counts.
            at = {}
            for start, _, weight in hits(folded):
                at[start] = max(weight, at.get(start, 0.0))
            rows.append((float(sum(at.values())), folded.count(" ") - 1, len(at)))
        return pd.DataFrame(rows, columns=["weight", "n_words", "n_hits"])

    return features


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_column: str = "doc_id", text_column: str = "text",
          keep: list[str] | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """Columns ``keep`` (default all) with struct ``toxicity``: score, weight, n_hits, n_words."""
    keep = docs.columns if keep is None else keep
    out, found = free_names(docs.columns, "toxicity", "__found")
    texts = materialize(labelled(docs, labels, fit_rows, id_column, text_column), "toxic-labelled")
    lexicon = learn_lexicon(texts) if lexicon is None else lexicon
    features = _features(lexicon)

    def scaled(row: Column) -> list[Column]:
        # The total, and the total per hundred words with half a hundred added, so that one hit in a short text is no certainty.
        return [F.log1p(row["weight"]), F.log1p(100 * row["weight"] / (row["n_words"] + 50))]

    sample = materialize(texts.select(features(F.col("text")).alias("f"), F.col("toxic").cast("double").alias("label")), "toxic-features")
    both = sample.agg(F.count_distinct("label")).first()[0] > 1
    a = b = 0.0
    c = None
    if both:
        x = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(sample.select(*[v.alias(n) for v, n in zip(scaled(F.col("f")), "ab")], "label"))
        # Either class weighs alike, so that the score does not hang on how many clean documents happen to be labelled.
        share = x.agg(F.avg("label")).first()[0]
        x = x.withColumn("w", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
        model = LogisticRegression(regParam=1e-3, standardization=False, weightCol="w").fit(x)
        a, b, c = *map(float, model.coefficients), float(model.intercept)
    rows = docs.select(*[f"`{k}`" for k in keep], features(F.col(text_column).cast("string")).alias(found))
    total, dense = scaled(F.col(found))
    probability = F.lit(0.0) if c is None else 1 / (1 + F.exp(-(total * a + dense * b + c)))
    return rows.select(*[f"`{k}`" for k in keep], F.struct(probability.alias("score"), *[F.col(found)[n].alias(n) for n in ("weight", "n_hits", "n_words")]).alias(out))
