"""Global order, exact quantiles and order boundaries, with ties and hot values."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffspark.operators import order as O
from tariffspark.operators.quantiles import exact_quantiles
from tariffspark.operators.split import split_random


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    # A third of all rows share one value.
    rows = [(f"k{i:05d}", 7.0 if i % 3 == 0 else float(rng.randrange(500)), rng.gauss(0, 1)) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "key string, hot double, x double").repartition(7)


def test_rank_is_the_sorted_position(values):
    rows, df = values
    got = {r["key"]: r["rank"] for r in O.with_rank(df, "hot", "key").collect()}
    expected = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == expected


def test_rank_does_not_depend_on_the_partitioning(values):
    _, df = values
    one, seven = (sorted(tuple(r) for r in O.with_rank(df.repartition(n), "hot", "key").collect()) for n in (1, 7))
    assert one == seven


def test_parts_hold_exactly_k_rows(values):
    rows, df = values
    places = [0, 1, 17, 1200, 1500, 3999, 4000]
    ordered = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    got = {r["key"]: r["part"] for r in O.with_part(df, F.col("hot"), "key", places, "part").collect()}
    assert got == {key: sum(k <= i for k in places) for i, key in enumerate(ordered)}


def test_parts_are_exact_where_value_and_key_repeat(spark):
    # Two thirds of the rows are one repeated row; others repeat a key, or have none.
    rows = [(1.0, "a")] * 20 + [(1.0, None)] * 7 + [(2.0, "same")] * 130 + [(2.0, "zzz")] * 3 + [(3.0, None)] * 40
    df = spark.createDataFrame(rows, "x double, key string").withColumn("_copy", F.lit("kept")).repartition(6)
    ordered = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    places = [3, 10, 27, 30, 50, 100, 157, 158, 180]
    expected = Counter((*row, sum(k <= i for k in places)) for i, row in enumerate(ordered))
    out = O.with_part(df, F.col("x"), "key", places, "part")
    assert out.columns == ["x", "key", "_copy", "part"]
    assert Counter((r["x"], r["key"], r["part"]) for r in out.collect()) == expected
    assert out.where("_copy = 'kept'").count() == len(rows)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_random_split_is_exact_with_repeats_text_strata_and_nulls(spark, share):
    rows = [("hot", "s")] * 150 + [("hot", None)] * 31 + [(f"k{i}", "s" if i % 2 else None) for i in range(40)] + [(None, "s")] * 9 + [("one", "t")]
    out = split_random(spark.createDataFrame(rows, "key string, stratum string").repartition(5), share, "key", "stratum")
    want = {s: int(n * share + 0.5) for s, n in Counter(r[1] for r in rows).items()}
    got = out.collect()
    assert Counter((r["key"], r["stratum"]) for r in got) == Counter(rows)
    assert {s: sum(r["split"] == "valid" for r in got if r["stratum"] == s) for s in want} == want


def test_random_split_of_an_empty_table(spark):
    assert split_random(spark.createDataFrame([], "key string, stratum string"), 0.3, "key", "stratum").collect() == []


QS = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("candidate_values", [10_000, 20])
def test_quantiles_equal_numpy(values, candidate_values):
    rows, df = values
    got = exact_quantiles(df, {"hot": QS, "x": QS}, candidate_values)
    for i, name in ((1, "hot"), (2, "x")):
        assert np.allclose(got[name], np.quantile([r[i] for r in rows], QS), rtol=0, atol=1e-12)


def test_quantiles_of_an_empty_column_are_none(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, {"x": [0.5]}) == {"x": [None]}
    assert exact_quantiles(df, {"x": [0.5]}, candidate_values=1) == {"x": [None]}


def test_narrowing_handles_two_values_and_one_value(spark):
    df = spark.createDataFrame([(1.0, 5.0)] * 60 + [(2.0, 5.0)] * 40, "two double, one double")
    got = exact_quantiles(df, {"two": [0.1, 0.6, 0.9], "one": [0.5]}, candidate_values=1)
    assert np.allclose(got["two"], np.quantile([1.0] * 60 + [2.0] * 40, [0.1, 0.6, 0.9]))
    assert got["one"] == [5.0]
