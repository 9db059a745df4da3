"""One query per operator, as its contract fixes columns and settings, with the SQL that checks it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.llm import curriculum, decontam, divergence, fim, jaccard, lines, neighbours, quality, secret_scan, sharding, toxicity, training_order, urls
from tariffspark.llm.oracles import ORACLES  # noqa: F401
from tariffspark.llm.text import read, small_batches, whole

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
TOKENIZER = os.environ.get("LLM_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
SHARD_DIMS = ["source", "lang", "n_chars", "doc_id"]


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    q = quality.judge(read(spark, folder, "documents"), keep=["doc_id"])
    return q.select("doc_id", *[F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(read(spark, folder, "pages"), RULES, keep=["page_id"]).select("page_id", "judged.*")


def op3_training_order(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return training_order.ordered(read(spark, folder, "documents"), TOKENIZER)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"), keep=["doc_id"])
    ids = F.sha2(F.array_join("found.items", ","), 256)
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), ids.alias("items_sha256"),
                        (F.col("found.n_hit") > 0).alias("contaminated"))


def contract_schedules(docs: DataFrame) -> DataFrame:
    """Sources in code-point order weigh 3, 1, 2 and so on; odd places fall over the run, even ones rise, about that weight."""
    from pyspark.sql import Window

    # One row per source of the mix, as a configuration file would list them.
    names = docs.select(curriculum.source_key(F.col("source")).alias("key")).distinct()
    n = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), (n % 3 + 1).cast("int"))
    tilt = F.when(n % 2 == 0, F.lit(0.5)).otherwise(F.lit(-0.5))
    knots = F.array(*[F.struct(F.lit(t).alias("t"), (weight * (1 + tilt * side)).alias("w")) for t, side in ((0.0, 1), (1.0, -1))])
    return names.select("key", knots.alias("knots"))


def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    narrow = docs.select("doc_id", "text", "source")
    counted = curriculum.in_training_order(curriculum.mix_counts(narrow, contract_schedules(docs)).select("doc_id", "mix"))
    place = lambda i: F.round(F.get(F.col("mix.positions"), F.lit(i)), 9).alias(("first_position", "second_position")[i])
    return counted.select("doc_id", *[F.col(f"mix.{c}") for c in ("size", "source_size", "target", "taken")], place(0), place(1))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    scored = toxicity.score(read(spark, folder, "documents"), read(spark, folder, "labels"), keep=["doc_id"])
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return jaccard.jaccard_components(read(spark, folder, "documents"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(read(spark, folder, "documents"))


def place_documents(docs: DataFrame) -> DataFrame:
    """The rows of op9 for ``docs`` with the columns of documents."""
    crc = F.crc32(whole(F.col("text")).cast("binary"))
    dims = [d for d in SHARD_DIMS if d in docs.columns]
    placed = sharding.hilbert_shards(docs.select("doc_id", "text", *[d for d in dims if d != "doc_id"], crc.alias("text_crc32")), dims,
                                     keep=["doc_id", "text_crc32"])
    return placed.select("doc_id", "placed.size", "text_crc32", F.lit("rows").alias("law"), "placed.shard", "placed.slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return place_documents(read(spark, folder, "documents"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = lines.dedup_lines(read(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(whole(F.col("text")), 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    moved = fim.fill_in_middle(read(spark, folder, "documents"), keep=["doc_id"], with_output=False)
    return moved.select("doc_id", "fim.*")


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return divergence.audit(read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_training_order, op4_decontamination, op5_mix_sources, op6_toxicity, op7_jaccard_join, op8_secret_scan,
                                    op9_hilbert_shards, op10_line_dedup, op11_fill_in_middle,
                                    op12_nearest_neighbours, op13_divergence_audit)}
