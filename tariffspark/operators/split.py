"""Train / validation splits and folds, all of them functions of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tariffspark.functions.columns import key_hash, key_text, key_uniform, micros
from tariffspark.operators.order import before_key, number_copies
from tariffspark.operators.quantiles import exact_quantiles
from tariffspark.roles import CLAIM, CONTRACT, OPERATION_DATE
from tariffspark.session import materialize


def split_random(df: DataFrame, share: float, key: str = CONTRACT, stratum: str | None = CLAIM, seed: int = 42) -> DataFrame:
    """``split`` column with an exact ``share`` of each stratum in valid: the first rows by (seeded hash of the key, key).

    Counts per 16 leading bits of the hash find the cell of the cut, counts per
    hash inside it the cut, counts per key the tie there, so no row is sorted.
    Of rows that repeat the key at the cut just as many are taken as are missing.
    A missing number counts as stratum 0, a missing text as a stratum of its own.
    """
    kind = df.schema[stratum].dataType if stratum else None
    if stratum is None:
        label = F.lit("")
    elif isinstance(kind, (NumericType, BooleanType)):
        label = F.coalesce(F.col(stratum).cast("int"), F.lit(0)).cast("string")
    else:
        label = key_text(F.col(stratum))
    hashed = key_hash(key_text(F.col(key)), f"{seed}:")
    narrow = materialize(df.select(label.alias("_s"), hashed.alias("_h"), F.col(key).alias("_k")), "split-keys")

    def cut(counts: DataFrame, by: str, target: Column) -> DataFrame:
        """The value of ``by`` that the target falls on, how many rows are still wanted there, and how many there are."""
        upto = F.sum("_n").over(Window.partitionBy("_s").orderBy(F.col(by).asc_nulls_first()))
        placed = counts.withColumn("_wanted", target).withColumn("_upto", upto)
        before = F.col("_upto") - F.col("_n")
        return placed.where((before < F.col("_wanted")) & (F.col("_wanted") <= F.col("_upto"))).withColumn("_wanted", F.col("_wanted") - before)

    size = F.sum("_n").over(Window.partitionBy("_s"))
    cells = narrow.groupBy("_s", F.shiftright("_h", 16).alias("_hi")).agg(F.count("*").alias("_n"))
    cell = cut(cells, "_hi", F.floor(size * F.lit(float(share)) + 0.5)).select("_s", "_hi", "_wanted")
    inside = narrow.withColumn("_hi", F.shiftright("_h", 16)).join(cell, ["_s", "_hi"])
    keys = materialize(inside.groupBy("_s", "_h", "_k").agg(F.count("*").alias("_n"), F.first("_wanted").alias("_cell")), "split-cell")
    at = cut(keys.groupBy("_s", "_h").agg(F.sum("_n").alias("_n"), F.first("_cell").alias("_cell")), "_h", F.col("_cell"))
    tied = keys.join(at.select("_s", "_h", F.col("_wanted").alias("_tied")), ["_s", "_h"]).select("_s", "_h", "_k", "_n", "_tied")
    last = cut(tied, "_k", F.col("_tied"))
    cuts = materialize(last.select(F.col("_s").alias("_cs"), F.col("_h").alias("_ch"), F.col("_k").alias("_ck"),
                                   F.when(F.col("_wanted") < F.col("_n"), F.col("_wanted")).alias("_part")), "split-cuts")
    met = df.withColumn("_s", label).withColumn("_h", hashed).join(cuts, F.col("_s") == F.col("_cs"), "left")
    same = (F.col("_h") == F.col("_ch")) & F.col(key).eqNullSafe(F.col("_ck"))
    earlier = (F.col("_h") < F.col("_ch")) | ((F.col("_h") == F.col("_ch")) & before_key(F.col(key), F.col("_ck")))
    valid = earlier | (same & F.col("_part").isNull())
    if cuts.where("_part is not null").limit(1).count():
        divided = F.coalesce(same & F.col("_part").isNotNull(), F.lit(False))
        copies = number_copies(met.where(divided), ["_s"], "_copy")
        met = met.where(~divided).withColumn("_copy", F.lit(None).cast("bigint")).unionByName(copies)
        valid = valid | F.coalesce(F.col("_copy") < F.col("_part"), F.lit(False))
    return met.withColumn("split", F.when(valid, "valid").otherwise("train")).select(*[F.col(f"`{c}`") for c in df.columns if c != "split"], "split")


def _checked(df: DataFrame) -> DataFrame:
    row = df.agg(F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "valid")).first()
    if 0 in tuple(row):
        raise ValueError("the split left train or valid empty")
    return df


def split_group(df: DataFrame, share: float, group: str, seed: int = 42, check: bool = True) -> DataFrame:
    """Whole groups go to valid when their hash falls below ``share``."""
    if group not in df.columns:
        raise ValueError(f"group split needs column {group!r}")
    if check and df.select(group).distinct().limit(2).count() < 2:
        raise ValueError("group split needs at least two groups")
    u = key_uniform(key_text(F.col(group)), f"{seed}:")
    out = df.withColumn("split", F.when(u < F.lit(float(share)), "valid").otherwise("train"))
    return _checked(out) if check else out


def time_cutoff(df: DataFrame, test_size: float, date: str = OPERATION_DATE) -> int | None:
    """Cut-off (microseconds) at the time quantile 1 - test_size, kept within 0.5..0.95."""
    q = max(0.5, min(0.95, 1.0 - test_size))
    found = exact_quantiles(df.select(micros(F.col(date)).alias("t")), {"t": [q]})["t"][0]
    return None if found is None else int(found)


def cutoff_micros(text: str) -> int:
    """Microseconds of an ISO date or date-time."""
    from datetime import datetime

    moment = datetime.fromisoformat(text)
    return round((moment - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def split_time(df: DataFrame, cutoff: int, date: str = OPERATION_DATE) -> DataFrame:
    """Valid from the cut-off on; rows without a date are train."""
    valid = F.coalesce(micros(F.col(date)) >= F.lit(int(cutoff)), F.lit(False))
    return df.withColumn("split", F.when(valid, "valid").otherwise("train"))


def remove_overlap(df: DataFrame, group: str) -> DataFrame:
    """Drop valid rows whose group also occurs in train (null groups match each other)."""
    seen = df.where("split = 'train'").select(F.col(group).alias("_seen")).distinct()
    train, valid = df.where("split = 'train'"), df.where("split = 'valid'")
    return train.unionByName(valid.join(seen, valid[group].eqNullSafe(F.col("_seen")), "left_anti"))


def split_group_time(df: DataFrame, test_size: float = 0.2, holdout_start: str | None = None, date: str = OPERATION_DATE,
                     group: str = CONTRACT, seed: int = 42) -> tuple[DataFrame, str]:
    """Time split without shared groups; falls back to a group split when time is missing or a side is empty.

    Returns the labelled table and the scheme that was used.
    """
    if date in df.columns:
        cutoff = cutoff_micros(holdout_start) if holdout_start else time_cutoff(df, test_size, date)
        if cutoff is not None:
            labelled = split_time(df, cutoff, date)
            if group in df.columns:
                labelled = remove_overlap(labelled, group)
            sizes = labelled.agg(F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "valid")).first()
            if 0 not in tuple(sizes):
                return labelled, "group_time"
    return split_group(df, test_size, group, seed), "group"


def group_folds(df: DataFrame, k: int, group: str | None = CONTRACT, row_key: str | None = None, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 from the hash of the group (or of the row key); k is at least 2 and at most the number of groups."""
    use = group if group and group in df.columns and df.select(group).distinct().limit(2).count() == 2 else row_key
    if use is None:
        raise ValueError("folds need a group column with two groups, or a row key")
    k = min(max(2, int(k)), df.select(use).distinct().limit(int(k)).count())
    return df.withColumn(name, F.pmod(key_hash(key_text(F.col(use))), F.lit(k)).cast("int"))


def split_three_way(df: DataFrame, valid: float = 0.2, test: float = 0.15, key: str = CONTRACT, seed: int = 42) -> DataFrame:
    """train / valid / test, with ``test`` taken from what valid leaves."""
    u = key_uniform(key_text(F.col(key)), f"{seed}:v:")
    w = key_uniform(key_text(F.col(key)), f"{seed}:t:")
    return df.withColumn("split", F.when(u < valid, "valid").when(w < test, "test").otherwise("train"))


def stability_splits(df: DataFrame, cutoffs: Sequence[str], date: str = OPERATION_DATE) -> DataFrame:
    """Each row once per cut-off with ``split_value`` and its ``split`` there."""
    marks = F.array(*[F.struct(F.lit(c).alias("split_value"), F.lit(cutoff_micros(c)).alias("cut")) for c in cutoffs])
    out = df.withColumn("_t", micros(F.col(date))).withColumn("_m", F.explode(marks))
    valid = F.coalesce(F.col("_t") >= F.col("_m.cut"), F.lit(False))
    return out.withColumn("split_value", F.col("_m.split_value")).withColumn("split", F.when(valid, "valid").otherwise("train")).drop("_t", "_m")
