"""Column helpers for words, lines and row keys of a text column.

Null texts have no words. ``WORD`` splits at ASCII white space only, so that
every engine with code-point regular expressions cuts the same words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
# Everything that is neither an ASCII letter or digit nor beyond ASCII, after lower-casing.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(c: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else untouched; the fast path serves pure ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def words(c: Column, separator: str = SPACE) -> Column:
    return F.array_remove(F.split(c, separator), "")


def text_key(c: Column) -> Column:
    """16 bytes that stand for a whole text in narrow shuffles."""
    return F.unhex(F.md5(whole(c)))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted`` with as many leading underscores as it takes to clash with no column, whatever the case."""
    lower, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in lower:
            name = "_" + name
        lower.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> SparkSession:
    """Rows handed to Python at a time: whole texts are long, and workers must stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark
