"""Line dedup: lines that many documents share survive in one document only.

Lines are exploded with their position, normalised and hashed; distinct
documents are counted per hash; positions of lines over the threshold are
gathered per document, and the text is put together from the positions left.

Defined results: a null text is one empty line and stays null; rows that share
a doc_id are one document (null ids together are one, and never the keeper
unless all are null); repeated lines inside a document count once, and go or
stay together; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffspark.llm.text import SPACE_CHARS, ascii_lower, free_names, text_key, whole
from tariffspark.session import materialize


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = 20,
                least_documents: int = 3) -> DataFrame:
    """``docs`` with its text cut, and struct ``line_dedup`` (n_lines, n_dropped).

    Keys of ``least_chars`` code points or more that are found in
    ``least_documents`` documents or more keep their lines only in the largest
    id that holds them.
    """
    lines = (docs.select(F.col(id_column).alias("id"), text_key(F.col(text_column)).alias("row"),
                         F.posexplode(F.split(whole(F.col(text_column)), "\n")).alias("at", "line"))
             .withColumn("line", line_key(F.col("line"))).where(F.length("line") >= least_chars)
             .select("id", "row", "at", F.unhex(F.md5("line")).alias("key")))
    spread = (lines.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max(F.col("id").isNull().cast("int")).alias("nulls"),
                                       F.max("id").alias("keeper"))
              .where(F.col("n") + F.col("nulls") >= least_documents).select("key", "keeper"))
    shared = materialize(spread, "line-keys")
    gone = (lines.join(shared, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy("id", "row").agg(F.collect_set("at").alias("gone")))
    out, row, dropped, parts, own, key = free_names(docs.columns, "line_dedup", "__row", "__gone", "__lines", "__id", "__key")
    wide = docs.withColumn(row, text_key(F.col(text_column)))
    met = wide.join(gone.select(F.col("id").alias(own), F.col("row").alias(key), F.col("gone").alias(dropped)),
                    F.col(row).eqNullSafe(F.col(key)) & F.col(id_column).eqNullSafe(F.col(own)), "left")
    cut = met.withColumn(parts, F.split(whole(F.col(text_column)), "\n"))
    kept = F.expr(f"transform(array_except(sequence(0, size(`{parts}`) - 1), `{dropped}`), i -> `{parts}`[i])")
    text = F.when(F.col(dropped).isNull(), F.col(text_column)).otherwise(F.array_join(kept, "\n"))
    counts = F.struct(F.size(parts).cast("long").alias("n_lines"), F.when(F.col(dropped).isNull(), 0).otherwise(F.size(dropped)).cast("long").alias("n_dropped"))
    return cut.withColumn(out, counts).select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns], F.col(out))
