"""Secret scan: candidates by rule, false positives removed by a random forest.

A word gives any number of candidates, at any place in it: the value behind a
name that contains a credential word (up to a quote or the end of the word), the
password of a URL, keys with a vendor's prefix, and long runs of token characters
with a digit. A word behind a credential name is a value as a whole. Each
candidate is described by its length and kind of characters, by transitions
between kinds, by how far words of the corpus cover its letters, by the path
(source) and by the words beside it. The forest is trained on labelled findings:
``labelled`` if given, else weak labels (a credential name beside the value or a
vendor's prefix is a finding, the rest is not), at most ``fit_rows`` of either class.

Defined results: null and empty texts have no candidates; equal candidates of
one document are separate rows with their place and their part of the word;
without labels of both classes the probability is the weak label; an empty table
gives no rows. Values leave only as SHA-256 with their first two characters.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffspark.llm.lookups import bounded
from tariffspark.llm.text import SPACE, ascii_lower, whole
from tariffspark.session import materialize

# Names of credentials, prefixes that vendors give their keys.
NAMES = r"password|passwd|pwd|secret(?!ar)|token(?!i[sz])|api[_.\-]?key|access[_.\-]?key|auth(?!or(?!i[sz]))|bearer|credential|private[_.\-]?key"
PREFIX = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|eyJ|ya29"
BODY = r"[A-Za-z0-9+/_.\-]"
_NAME, _SEPARATOR, _QUOTE = r"[A-Za-z0-9_.\-]", r"(?:=>|:=|==?|:|>)", "[\"'`]"
_END = rf"[.,;:)\]}}>]+(?:{_QUOTE}|\z)"
# Credential names up to the value; the first group is the credential word. Every loop is possessive or starts only where a name starts.
_HEAD = rf"(?:(?={_NAME}*?({NAMES})){_NAME}++[\"'`\])]*+{_SEPARATOR}[\"'`(\[{{]*+)+"
USER = rf"://([^/?#:@\"'`]*):([^/?#\"'`]{{8,}})@"
PARAMETER = rf"(?i)(?<=[?&]){_HEAD}([^&#\"'`]{{8,}}+)"
# Unquoted values stop before a further pair, a closing tag and closing punctuation.
NAMED = rf"(?i)(?<!{_NAME}){_HEAD}((?<={_QUOTE})[^\"'`]{{8,}}+|(?:(?!{_END}|</|[,;&|]{_QUOTE}?{_NAME}++{_QUOTE}?(?:=>|[=:]))[^\"'`]){{8,}}+)"
KEY = rf"(?<![A-Za-z0-9])(?:{PREFIX})[A-Za-z0-9+_.\-]{{12,}}"
RUN = rf"((?:{KEY}|(?:(?!{KEY}){BODY}){{8,}}+)(?:={{1,2}}(?![A-Za-z0-9=\"']))?)"
WHOLE = rf"^[\"'`(\[{{<]*+((?:(?!{_END})[^\"'`]){{8,}}+)"
SHAPES = ["length", "digits", "uppers", "signs", "letter_digit", "digit_letter", "lower_upper", "upper_lower", "digit_digit", "letter_letter", "distinct", "hexadecimal", "covered"]
WORDS = ["before", "before_2", "name", "after", "path"]


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """(doc_id, place, part, value, name, told, before, before_2, after, path): place is the number of the word, part that of the value in it."""
    # Splitting at single runs keeps places stable; words shorter than any candidate go before the regular expressions run.
    split = docs.select(F.col(id_column).alias("doc_id"), F.col(path_column).cast("string").alias("path"), F.split(whole(F.col(text_column)), SPACE).alias("w"))
    rows = split.select("doc_id", "path", "w", F.posexplode("w").alias("place", "word")).where(F.length("word") >= 8)
    near = [F.coalesce(F.get("w", F.col("place") + d), F.lit("")) for d in (-1, -2, 1)]
    beside = [F.regexp_replace(ascii_lower(c), r"[^a-z0-9_=]", "") for c in near]
    alone = near[0].rlike(rf"^{_SEPARATOR}$")
    before = F.when(alone, beside[1]).otherwise(beside[0])
    # In prose a word counts only if it is a credential word; with a separator the name may contain one.
    paired = (alone | near[0].rlike(r"(?:[=:]|=>)[\"'`(\[{]*$")) & F.when(alone, near[1]).otherwise(near[0]).rlike(rf"(?i)(?:{NAMES}){_NAME}*[\"'`\])]*{_SEPARATOR}?[\"'`(\[{{]*$")
    told = paired | before.rlike(f"^({NAMES})=?$")
    word = F.col("word")
    # Letters alone are no candidate unless a credential name, a prefix or a URL's password is there.
    some = F.col("told") | word.rlike("[0-9]") | word.rlike(f"(?i){NAMES}") | word.rlike(PREFIX) | word.rlike("://[^/]*@")
    kept = rows.select("doc_id", "path", "place", "word", told.alias("told"), before.alias("before"), beside[1].alias("before_2"), beside[2].alias("after")).where(some)

    def found(text, pattern: str, name, value: int):
        names = name if isinstance(name, int) else None
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
        named = F.regexp_extract_all(text, F.lit(pattern), F.lit(names)) if names else F.transform(values, lambda _: F.lit(name))
        return F.arrays_zip(named.alias("name"), values.alias("value"))

    steps = kept.withColumn("users", found(word, USER, "user", 2)).withColumn("rest", F.regexp_replace("word", USER, "://"))
    steps = steps.withColumn("parameters", found(F.col("rest"), PARAMETER, 1, 2)).withColumn("rest", F.regexp_replace("rest", PARAMETER, " "))
    steps = steps.withColumn("pairs", found(F.col("rest"), NAMED, 1, 2)).withColumn("rest", F.regexp_replace("rest", NAMED, " "))
    named = F.concat("users", "parameters", "pairs")
    whole_word = found(word, WHOLE, "", 1)
    hits = F.when(F.col("told") & (F.size(named) == 0), whole_word).otherwise(F.concat(named, found(F.col("rest"), RUN, "", 1)))
    each = steps.select("*", F.posexplode(hits).alias("part", "hit")).select("*", F.col("hit.value").alias("value"), ascii_lower(F.col("hit.name")).alias("name"))
    value = F.col("value")
    fits = (F.length(value) >= 16) & value.rlike("[0-9]") | value.rlike(f"^({PREFIX})") | F.col("told") | (F.col("name") != "")
    return each.where(fits).select("doc_id", "place", "part", "value", "name", (F.col("told") | (F.col("name") != "")).alias("told"), "before", "before_2", "after",
                                   F.coalesce("path", F.lit("")).alias("path"))


def dictionary(docs: DataFrame, found: DataFrame, text_column: str = "text", least_documents: int = 5) -> DataFrame:
    """Pieces of the candidates' values that are words of four letters or more of at least ``least_documents`` texts."""
    words = docs.select(F.explode(F.array_distinct(F.split(ascii_lower(whole(F.col(text_column))), r"[^a-z]+"))).alias("piece")).where(F.length("piece") >= 4)
    common = words.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents)
    return common.join(pieces(found).select("piece").distinct(), "piece", "left_semi").select("piece")


def pieces(found: DataFrame) -> DataFrame:
    """(value, piece): the letter runs of the values, once each."""
    return found.select("value", F.explode(F.split(ascii_lower(F.col("value")), "[^a-z]+")).alias("piece")).where(F.length("piece") >= 4).distinct()


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with the numeric features; ``known`` is a written dictionary, broadcast while its counted rows are few."""
    v = F.col("value")

    def share(pattern: str):
        return F.regexp_count(v, F.lit(pattern)) / F.length(v)

    shaped = found.select("*", F.length(v).cast("double").alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"), share("[^A-Za-z0-9]").alias("signs"),
                          share("[A-Za-z](?=[0-9])").alias("letter_digit"), share("[0-9](?=[A-Za-z])").alias("digit_letter"), share("[a-z](?=[A-Z])").alias("lower_upper"),
                          share("[A-Z](?=[a-z])").alias("upper_lower"), share("[0-9](?=[0-9])").alias("digit_digit"), share("[A-Za-z](?=[A-Za-z])").alias("letter_letter"),
                          (F.size(F.array_distinct(F.split(v, ""))) / F.length(v)).alias("distinct"), v.rlike("^[0-9a-fA-F]+$").cast("double").alias("hexadecimal"))
    covered = pieces(found).join(bounded(known), "piece").groupBy("value").agg(F.sum(F.length("piece")).alias("letters"))
    met = shaped.join(covered, "value", "left")
    return met.withColumn("covered", F.least(F.coalesce(F.col("letters"), F.lit(0)) / F.col("length"), F.lit(1.0))).drop("letters")


def weak_label(found: DataFrame) -> DataFrame:
    return found.withColumn("label", (F.col("told") | F.col("value").rlike(f"^({PREFIX})")).cast("double"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, fit_rows: int = 20_000, trees: int = 30, depth: int = 8, id_column: str = "doc_id",
         text_column: str = "text", path_column: str = "source") -> DataFrame:
    """One row per candidate: doc_id, place, part, length, shown, value_sha256, probability, is_secret.

    ``labelled(doc_id, place, label)`` marks known findings; its rows train the forest.
    With a column ``part`` it marks single values of a word, else all of them.
    """
    found = materialize(candidates(docs, id_column, text_column, path_column), "secret-candidates")
    known = materialize(dictionary(docs, found, text_column), "secret-words")
    rows = weak_label(described(found, known))
    if labelled is not None:
        part = F.col("part") if "part" in labelled.columns else F.lit(None).cast("int")
        marks = labelled.select(F.col("doc_id").alias("__id"), F.col("place").alias("__place"), part.alias("__part"), F.col("label").cast("double").alias("label"))
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("place") == F.col("__place")) & (F.coalesce("__part", "part") == F.col("part"))
        rows = rows.withColumnRenamed("label", "weak").join(marks, same, "left").drop("__id", "__place", "__part")
    else:
        rows = rows.withColumn("weak", F.col("label"))
    rows = materialize(rows, "secret-features")
    order = [F.xxhash64("value", "doc_id", "place", "part"), F.col("value"), F.col("doc_id"), F.col("place"), F.col("part")]
    train = materialize(rows.where("label = 1").orderBy(*order).limit(fit_rows).unionByName(rows.where("label = 0").orderBy(*order).limit(fit_rows)), "secret-train")
    shown = F.rpad(F.substring("value", 1, 2), 5, "*")
    out = ["doc_id", "place", "part", F.length("value").alias("length"), shown.alias("shown"), F.sha2("value", 256).alias("value_sha256")]
    if train.agg(F.count_distinct("label")).first()[0] < 2:
        return rows.select(*out, F.coalesce("label", "weak").alias("probability"), (F.coalesce("label", "weak") >= 0.5).alias("is_secret"))
    steps = [FeatureHasher(inputCols=WORDS, outputCol="beside", numFeatures=256), VectorAssembler(inputCols=[*SHAPES, "beside"], outputCol="features"),
             RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird")]
    model = Pipeline(stages=steps).fit(train)
    scored = model.transform(rows).withColumn("p", F.round(F.element_at(vector_to_array("probability"), 2), 6))
    return scored.select(*out, F.col("p").alias("probability"), (F.col("p") >= 0.5).alias("is_secret"))
