"""Validation, grain change, sources."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tariffspark.models.bench import side_by_side
from tariffspark.operators import policy as P
from tariffspark.operators import quality as Q
from tariffspark.session import materialize, scratch
from tariffspark.sources import runs as A
from tariffspark.sources import tables as T

ROWS = "row_key string, unique_id long, contract_number string, premium double, premium_wo_term double, is_claim int, claim_amount double, claim_cnt double, " \
       "engine_power double, region_name string, driver_iin string, SCORE_1_1 double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        ("a", 1, "c1", 100.0, 90.0, 0, None, None, 80.0, None, "d1", 1.0),
        ("b", 2, "c1", 120.0, 95.0, 1, 500.0, 1.0, 100.0, "east", "d2", 3.0),
        ("c", 3, "c2", 200.0, 180.0, 0, None, None, None, "west", "d3", None),
        ("d", 4, None, 50.0, 40.0, 0, None, None, 60.0, "north", "d4", 2.0),
        ("e", 4, None, 60.0, 45.0, 0, None, None, 70.0, "south", "d5", 4.0)], ROWS)


def test_policy_grain(rows):
    out = {r["contract_number"]: r for r in P.aggregate_to_policy(rows).collect()}
    assert len(out) == 3 and "driver_iin" not in out["c1"].asDict()
    one = out["c1"]
    assert (one["premium"], one["premium_wo_term"], one["is_claim"], one["claim_amount"], one["driver_count"]) == (120.0, 95.0, 1, 500.0, 2)
    assert one["engine_power_mean"] == 90.0 and one["SCORE_1_1"] == 2.0 and one["region_name"] == "east"
    assert out["c2"]["claim_amount"] == 0.0 and out["c2"]["claim_cnt"] == 0.0
    assert out[None]["driver_count"] == 2 and out[None]["region_name"] == "north"


def test_policy_grain_with_sums_and_without_contract(rows):
    out = {r["contract_number"]: r for r in P.aggregate_to_policy(rows.withColumn("claim_amount", F.lit(10.0)), targets="sum").collect()}
    assert out["c1"]["claim_amount"] == 20.0
    assert P.aggregate_to_policy(rows.drop("contract_number")).count() == 5


def test_policy_grain_does_not_depend_on_the_partitioning(rows):
    one, seven = (sorted(map(str, P.aggregate_to_policy(rows.repartition(n)).collect())) for n in (1, 7))
    assert one == seven


def test_null_contracts_find_their_policy(rows):
    priced = P.aggregate_to_policy(rows).withColumn("new_premium", F.col("premium") * 2)
    out = P.submission(rows, priced)
    assert sorted(r["new_premium"] for r in out.collect()) == [120.0, 120.0, 240.0, 240.0, 400.0]
    P.check_submission(rows, out)
    with pytest.raises(ValueError):
        P.check_submission(rows, out.limit(3))


def test_submission_rejects_unpriced_rows(rows):
    priced = P.aggregate_to_policy(rows).where("contract_number = 'c1'").withColumn("new_premium", F.lit(1.0))
    with pytest.raises(Exception, match="row without a price"):
        P.submission(rows, priced).collect()


def test_valid_rows_pass(rows):
    verdict = Q.verdict(Q.validate(rows)).first()
    assert verdict["ok"] == 1 and verdict["warnings"] == 1  # one repeated unique_id
    Q.require_valid(rows)


def test_faults_are_found(rows):
    bad = rows.withColumn("is_claim", F.when(F.col("row_key") == "a", 3).otherwise(F.col("is_claim"))).withColumn("premium", F.col("premium") - 55)
    found = {(r["rule"], r["feature"]): (r["severity"], r["measure"]) for r in Q.validate(bad).collect()}
    assert found[("binary_domain", "is_claim")] == ("error", 1.0)
    assert found[("negative_values", "premium")] == ("error", 1.0)
    assert [r["value"] for r in Q.bad_binary_values(bad).collect()] == [3.0]
    with pytest.raises(ValueError):
        Q.require_valid(bad)


def test_missing_column_stops_the_other_rules(rows):
    report = Q.validate(rows.drop("claim_cnt")).collect()
    assert {r["rule"] for r in report} == {"required_column"}
    assert {r["feature"]: r["severity"] for r in report}["claim_cnt"] == "error"


def test_null_rate_gates(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0, None, None)] * 5 + [(None, 1.0, 0, None, None)] * 4 + [(None, None, 1, None, None)],
                               "premium double, premium_wo_term double, is_claim int, claim_amount double, claim_cnt double")
    got = {r["feature"]: r["severity"] for r in Q.check_null_rates(df).collect()}
    assert got == {"premium": "error", "premium_wo_term": "ok", "is_claim": "ok", "claim_amount": "warning", "claim_cnt": "warning"}


def test_null_ids_are_one_more_key(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "id int")
    assert Q.duplicate_count(df, "id").first()["duplicates"] == 2


def test_csv_leaderboard_and_lists(spark, rows, tmp_path):
    path = str(tmp_path / "rows")
    T.write_table(rows, path, "csv")
    assert T.read_csv(spark, path, rows.schema).count() == 5
    board = str(tmp_path / "board")
    T.append_leaderboard(spark, board, {"run_id": "r1", "auc": 0.5})
    T.append_leaderboard(spark, board, {"run_id": "r2", "auc": 0.6, "brier": 0.1})
    assert T.latest_run(spark, board) == "r2"
    assert T.run_metrics(spark, board, "r1").first()["brier"] is None
    names = str(tmp_path / "list")
    T.write_table(spark.createDataFrame([("x",), ("y",)], "feature string"), names, "csv")
    assert T.read_feature_list(spark, names) == {"x", "y"}
    assert T.read_feature_list(spark, str(tmp_path / "absent")) == set() and T.read_feature_list(spark, None) == set()


def test_a_run_exists_once_it_is_published(spark, rows, tmp_path):
    root = str(tmp_path / "artifacts")
    assert A.published(spark, root).count() == 0
    lost = A.Attempt(spark, root, "r1")
    lost.table(rows, "train")
    assert A.published(spark, root).count() == 0
    with pytest.raises(LookupError):
        A.read_run_table(spark, root, "r1", "train")
    done = A.Attempt(spark, root, "r1")
    done.table(rows.limit(2), "train")
    done.table(rows.limit(3), "answer", "csv")
    side_by_side(spark, [lambda: done.publish({"auc": 0.5}), lambda: A.Attempt(spark, root, "r2").publish({"auc": 0.7, "brier": 0.1})])
    board = {r["run_id"]: r for r in A.published(spark, root).collect()}
    assert set(board) == {"r1", "r2"} and board["r1"]["path"] == done.path and board["r1"]["brier"] is None
    assert A.run_tables(spark, root, "r1") == {"train": "parquet", "answer": "csv"}
    assert [A.read_run_table(spark, root, "r1", name).count() for name in ("train", "answer")] == [2, 3]
    with pytest.raises(LookupError):
        A.read_run_table(spark, root, "r1", "other")
    again = A.Attempt(spark, root, "r1")
    again.publish({"auc": 0.9})
    assert A.run_path(spark, root, "r1") == again.path and A.published(spark, root).count() == 2


def test_scratch_tables_go_with_their_block(spark, rows):
    def files(folder):
        return sorted(p for p in Path(folder.removeprefix("file:")).rglob("part-*.parquet"))

    with scratch(spark) as folder:
        kept = materialize(rows, "a")
        parts = side_by_side(spark, [lambda: materialize(rows, "b"), lambda: materialize(rows, "c")])
        assert kept.count() == 5 and [p.count() for p in parts] == [5, 5]
        assert {p.parent.name[0] for p in files(folder)} == {"a", "b", "c"}
    assert all(p.parent.name == Path(folder).name for p in files(folder))
    with pytest.raises(ZeroDivisionError), scratch(spark) as folder:
        materialize(rows, "d")
        1 / 0
    assert all(p.parent.name == Path(folder).name for p in files(folder))
    assert materialize(rows, "e").count() == 5


def test_partitioned_write_and_samples(spark, rows, tmp_path):
    path = str(tmp_path / "by")
    T.write_table(rows, path, partition_by=["is_claim"])
    assert spark.read.parquet(path).count() == 5
    assert T.sample_rows(rows, 3, "row_key").count() == 3
    a, b = (sorted(r["row_key"] for r in T.sample_rows(rows.repartition(n), 3, "row_key").collect()) for n in (1, 4))
    assert a == b
    assert T.sample_fraction(rows, 1.0, "row_key").count() == 5
