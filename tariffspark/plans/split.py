"""Registered queries: splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tariffspark.operators import split as O
from tariffspark.operators.order import with_part
from tariffspark.plans.common import oracle
from tariffspark.sources import portfolio as S

QUERIES, ORACLES = {}, {}
CUTOFF = "2000-06-01"
CUTOFFS = ["2000-01-01", "2000-04-01", "2000-06-01", "2000-08-01", "2000-10-01"]


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def hash_sql(key, salt=""):
    text = f"cast({key} AS varchar)"
    return f"('0x' || substr(md5({f''''{salt}' || ''' if salt else ''}{text}), 1, 8))::BIGINT"


def uniform_sql(key, salt=""):
    return f"{hash_sql(key, salt)} / 4294967296.0::DOUBLE"


def _labels(df):
    return df.select("contract_number", "split")


register("split_random", lambda s, d: _labels(O.split_random(S.policies(s, d), 0.2)), oracle("policy", f"""
SELECT contract_number, CASE WHEN row_number() OVER (PARTITION BY is_claim ORDER BY {hash_sql('contract_number', '42:')}, contract_number)
  <= floor(count(*) OVER (PARTITION BY is_claim) * 0.2::DOUBLE + 0.5) THEN 'valid' ELSE 'train' END AS split FROM policy"""))


def _repeats(s, d):
    """Keys that thousands of rows share: which of equal rows lies before the cut is open, their number is not."""
    rows = O.split_random(S.driver_rows(s, d).select("mark", "region_name"), 0.2, "mark", "region_name")
    return rows.groupBy("mark", "region_name", "split").agg(F.count("*").alias("n"))


register("split_random_repeats", _repeats, oracle("driver_rows", f"""
SELECT mark, region_name, split, count(*) AS n FROM (SELECT mark, region_name, CASE WHEN row_number() OVER (PARTITION BY region_name
  ORDER BY {hash_sql('mark', '42:')}, mark) <= floor(count(*) OVER (PARTITION BY region_name) * 0.2::DOUBLE + 0.5) THEN 'valid' ELSE 'train' END AS split
FROM driver_rows) GROUP BY ALL"""))


def _places(s, d):
    rows = S.driver_rows(s, d).select(F.coalesce("car_age", F.lit(0)).alias("car_age"), "mark")
    n = rows.count()
    return with_part(rows, F.col("car_age"), "mark", [n // 7, n // 2, 9 * n // 10], "part").groupBy("car_age", "mark", "part").agg(F.count("*").alias("n"))


register("order_places_repeats", _places, oracle("driver_rows", """
SELECT car_age, mark, (i > n // 7)::INTEGER + (i > n // 2)::INTEGER + (i > 9 * n // 10)::INTEGER AS part, count(*) AS n
FROM (SELECT car_age, mark, row_number() OVER (ORDER BY car_age, mark) AS i, count(*) OVER () AS n
      FROM (SELECT coalesce(car_age, 0) AS car_age, mark FROM driver_rows)) GROUP BY ALL"""))
register("split_group", lambda s, d: O.split_group(S.policies(s, d), 0.3, "ownerkato").select("contract_number", "ownerkato", "split"), oracle("policy", f"""
SELECT contract_number, ownerkato, CASE WHEN {uniform_sql('ownerkato', '42:')} < 0.3 THEN 'valid' ELSE 'train' END AS split FROM policy"""))
register("split_group_time", lambda s, d: _labels(O.split_group_time(S.policies(s, d), 0.2, CUTOFF)[0]), oracle("policy", f"""
SELECT contract_number, CASE WHEN operation_date >= TIMESTAMP '{CUTOFF}' THEN 'valid' ELSE 'train' END AS split FROM policy"""))


def _quantile(s, d):
    policy = S.policies(s, d)
    cut = O.time_cutoff(policy, 0.2)
    return O.split_time(policy, cut).groupBy("split").agg(F.count("*").alias("policies"), F.lit(cut).cast("bigint").alias("cutoff_micros"))


register("split_time_quantile", _quantile, oracle("policy", """
SELECT split, count(*) AS policies, any_value(cut) AS cutoff_micros FROM (
SELECT cut, CASE WHEN t >= cut THEN 'valid' ELSE 'train' END AS split FROM (
SELECT epoch_us(operation_date) AS t, (SELECT floor(quantile_cont(epoch_us(operation_date)::DOUBLE, 0.8::DOUBLE))::BIGINT FROM policy) AS cut FROM policy)) GROUP BY split"""))


def _overlap(s, d):
    rows = S.driver_rows(s, d).withColumn("grp", F.concat_ws("|", F.col("driver_iin").cast("string"), "mark"))
    return O.remove_overlap(O.split_time(rows, O.cutoff_micros(CUTOFF)), "grp").select("row_key", "grp", "split")


register("split_overlap_removed", _overlap, oracle("driver_rows", """
SELECT row_key, grp, split FROM g WHERE split = 'train' OR grp NOT IN (SELECT grp FROM g WHERE split = 'train')""",
    f"""g AS (SELECT row_key, driver_iin || '|' || mark AS grp, CASE WHEN operation_date >= TIMESTAMP '{CUTOFF}' THEN 'valid' ELSE 'train' END AS split FROM driver_rows)"""))
register("group_kfold", lambda s, d: O.group_folds(S.policies(s, d), 5).select("contract_number", "fold"),
         oracle("policy", f"SELECT contract_number, ({hash_sql('contract_number')} % 5)::INTEGER AS fold FROM policy"))
register("split_three_way", lambda s, d: _labels(O.split_three_way(S.policies(s, d))), oracle("policy", f"""
SELECT contract_number, CASE WHEN {uniform_sql('contract_number', '42:v:')} < 0.2 THEN 'valid' WHEN {uniform_sql('contract_number', '42:t:')} < 0.15 THEN 'test'
  ELSE 'train' END AS split FROM policy"""))
register("stability_splits", lambda s, d: O.stability_splits(S.policies(s, d), CUTOFFS).groupBy("split_value", "split").agg(
    F.count("*").alias("policies"), F.sum("is_claim").alias("claims")), oracle("policy", """
SELECT c AS split_value, CASE WHEN operation_date >= c::TIMESTAMP THEN 'valid' ELSE 'train' END AS split, count(*) AS policies, sum(is_claim)::BIGINT AS claims
FROM policy, (SELECT unnest([""" + ", ".join(f"'{c}'" for c in CUTOFFS) + """]) AS c) GROUP BY 1, 2"""))
