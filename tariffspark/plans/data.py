"""Registered queries: sources, validation, grain change."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffspark.models.bench import side_by_side
from tariffspark.operators import policy as P
from tariffspark.operators import quality as Q
from tariffspark.plans.common import oracle, rounded, sfx
from tariffspark.session import materialize, shared_folder
from tariffspark.sources import portfolio as S
from tariffspark.sources import runs as A
from tariffspark.sources import tables as T

QUERIES, ORACLES = {}, {}

ROW_COLUMNS = ["row_key", "unique_id", "contract_number", "operation_date", "premium", "premium_wo_term", "is_claim",
               "claim_amount", "claim_cnt", "region_name", "ownerkato", "vehicle_type_name", "mark", "model", "engine_power",
               "car_age", "bonus_malus", "car_year", "SCORE_1_1", "SCORE_4_1", "SCORE_11_1", "driver_iin", "insurer_iin", "car_number"]
POLICY_COLUMNS = ["contract_number", "driver_count", "operation_date", "premium", "premium_wo_term", "is_claim", "claim_amount",
                  "claim_cnt", "region_name", "ownerkato", "vehicle_type_name", "mark", "model", "engine_power_mean",
                  "car_age_mean", "bonus_malus", "car_year", "SCORE_1_1", "SCORE_4_1", "SCORE_11_1"]


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def null_rate_sql(source: str, columns: list[str], key: str = "feature", value: str = "null_rate") -> str:
    wide = ", ".join(f"avg(({c} IS NULL)::INTEGER) AS {c}" for c in columns)
    return f"SELECT {key}, {value} FROM (SELECT {wide} FROM {source}) UNPIVOT INCLUDE NULLS ({value} FOR {key} IN ({', '.join(columns)}))"


register("scan_driver_rows", lambda s, d: S.driver_rows(s, d), oracle("driver_rows", "SELECT * FROM driver_rows"))
register("scan_first_n", lambda s, d: T.first_rows(S.driver_rows(s, d), 500, "row_key"),
         oracle("driver_rows", "SELECT * FROM driver_rows ORDER BY row_key LIMIT 500"))
register("sample_hash_n", lambda s, d: T.sample_rows(S.driver_rows(s, d), 1000, "row_key"), oracle(
    "driver_rows", "SELECT * FROM driver_rows ORDER BY ('0x' || substr(md5('42:' || row_key), 1, 8))::BIGINT, row_key LIMIT 1000"))

# -- validation ---------------------------------------------------------------

_MISSING = "claim_cnt"


def _dirty(s, d):
    """Driver rows with planted faults: claim flag 2, negative net premiums."""
    return (S.driver_rows(s, d)
            .withColumn("is_claim", F.when(F.col("SCORE_1_1") >= 49, 2).otherwise(F.col("is_claim")))
            .withColumn("premium_wo_term", F.col("premium_wo_term") - 20000))


DIRTY = """dirty AS (SELECT * REPLACE (CASE WHEN SCORE_1_1 >= 49 THEN 2 ELSE is_claim END AS is_claim,
  premium_wo_term - 20000 AS premium_wo_term) FROM driver_rows)"""

_required = ["premium", "premium_wo_term", "is_claim", "claim_amount", "claim_cnt"]


def required_sql(source, lacking=()):
    return " UNION ALL ".join(
        f"SELECT 'required_column' AS rule, '{c}' AS feature, '{'error' if c in lacking else 'ok'}' AS severity, "
        f"{'sum(0)' if c in lacking else 'count(*)'}::DOUBLE AS measure FROM {source}" for c in _required)


def null_gate_sql(source):
    return f"""SELECT 'null_rate' AS rule, feature, CASE WHEN feature IN ('premium', 'premium_wo_term', 'is_claim') THEN
  CASE WHEN null_rate > 0.4 THEN 'error' WHEN null_rate > 0.1 THEN 'warning' ELSE 'ok' END
  WHEN null_rate > 0.99 THEN 'warning' ELSE 'ok' END AS severity, null_rate::DOUBLE AS measure FROM ({null_rate_sql(source, _required)})"""


def binary_sql(source):
    return f"""SELECT 'binary_domain' AS rule, 'is_claim' AS feature, CASE WHEN n > 0 THEN 'error' ELSE 'ok' END AS severity,
  n::DOUBLE AS measure FROM (SELECT count(*) AS n FROM {source} WHERE is_claim NOT IN (0, 1))"""


def negative_sql(source):
    return " UNION ALL ".join(
        f"SELECT 'negative_values' AS rule, '{c}' AS feature, CASE WHEN n > 0 THEN 'error' ELSE 'ok' END AS severity, n::DOUBLE AS measure "
        f"FROM (SELECT count(*) AS n FROM {source} WHERE coalesce({c}, 0) < 0)" for c in ("premium", "premium_wo_term", "claim_cnt", "claim_amount"))


def duplicate_sql(source):
    return f"""SELECT 'duplicate_id' AS rule, 'unique_id' AS feature, CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END AS severity,
  n::DOUBLE AS measure FROM (SELECT count(*) - count(DISTINCT unique_id) AS n FROM {source})"""


register("validate_required", lambda s, d: Q.check_required(S.driver_rows(s, d).drop(_MISSING)),
         oracle("driver_rows", required_sql("driver_rows", [_MISSING])))
register("validate_null_rates", lambda s, d: rounded(Q.check_null_rates(S.driver_rows(s, d)), 9, "measure"),
         oracle("driver_rows", f"SELECT rule, feature, severity, {sfx('measure')} AS measure FROM ({null_gate_sql('driver_rows')})"))
register("validate_binary", lambda s, d: Q.bad_binary_values(_dirty(s, d)), oracle(
    "driver_rows", "SELECT is_claim::DOUBLE AS value, count(*) AS n FROM dirty WHERE is_claim NOT IN (0, 1) GROUP BY 1", DIRTY))
register("validate_negative", lambda s, d: Q.check_negative(_dirty(s, d)), oracle("driver_rows", negative_sql("dirty"), DIRTY))
register("validate_duplicates", lambda s, d: Q.check_duplicates(S.driver_rows(s, d)),
         oracle("driver_rows", duplicate_sql("driver_rows")))

_all_rules = " UNION ALL ".join(f"({f('dirty')})" for f in (required_sql, null_gate_sql, binary_sql, negative_sql, duplicate_sql))


def _report(s, d):
    report = rounded(Q.validate(_dirty(s, d)), 9, "measure")
    return report.unionByName(Q.verdict(report).select(
        F.lit("verdict").alias("rule"), F.lit("*").alias("feature"),
        F.when(F.col("ok") == 1, "ok").otherwise("error").alias("severity"), F.col("errors").cast("double").alias("measure")))


register("validation_report", _report, oracle("driver_rows", f"""SELECT rule, feature, severity, {sfx('measure')} AS measure FROM rules
UNION ALL SELECT 'verdict', '*', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'error' END, count(*)::DOUBLE FROM rules WHERE severity = 'error'""",
                                              DIRTY, f"rules AS ({_all_rules})"))


def _filled(policy):
    """Processed layer of the report: numbers and categories without nulls."""
    return policy.select(*[F.coalesce(F.col(c), F.lit("missing") if t == "string" else F.lit(0).cast(t)).alias(c)
                           if t in ("string", "double") else F.col(c) for c, t in policy.dtypes])


def _quality(s, d):
    policy = materialize(S.policies(s, d), "policy")
    return rounded(Q.quality_report({"raw": S.driver_rows(s, d), "policy": policy, "processed": _filled(policy)}, 20), 9, "null_rate")


def _layer_sql(layer, source, columns):
    return f"""SELECT '{layer}' AS layer, (SELECT count(*) FROM {source}) AS n_rows, {len(columns)}::BIGINT AS n_columns, feature,
  {'0.0::DOUBLE' if layer == 'processed' else 'null_rate'} AS null_rate FROM ({null_rate_sql(source, columns)})"""


register("quality_report", _quality, oracle("policy", f"""SELECT layer, n_rows, n_columns, feature, {sfx('null_rate')} AS null_rate, rank FROM (
SELECT *, row_number() OVER (PARTITION BY layer ORDER BY null_rate DESC, feature COLLATE "binary") AS rank FROM (
{_layer_sql('raw', 'driver_rows', ROW_COLUMNS)} UNION ALL {_layer_sql('policy', 'policy', POLICY_COLUMNS)}
UNION ALL {_layer_sql('processed', 'policy', POLICY_COLUMNS)})) WHERE rank <= 20""".replace(' COLLATE "binary"', "")))
register("dup_contracts", lambda s, d: Q.duplicate_contracts(S.driver_rows(s, d)),
         oracle("driver_rows", "SELECT count(*) - count(DISTINCT contract_number) AS duplicates FROM driver_rows"))
register("dup_key_pair", lambda s, d: Q.duplicate_count(S.driver_rows(s, d), "contract_number", "operation_date"), oracle(
    "driver_rows", "SELECT sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM driver_rows GROUP BY contract_number, operation_date)"))

# -- grain change ---------------------------------------------------------------

register("policy_aggregate", lambda s, d: S.policies(s, d), oracle("policy", "SELECT * FROM policy"))
register("policy_driver_count", lambda s, d: S.policies(s, d).select("contract_number", "driver_count"),
         oracle("driver_rows", "SELECT contract_number, count(*) AS driver_count FROM driver_rows GROUP BY 1"))


def _sum_grain(s, d):
    out = P.aggregate_to_policy(S.driver_rows(s, d), targets="sum")
    return rounded(out.select("contract_number", "driver_count", "operation_date", "premium", "is_claim", "claim_amount", "claim_cnt"),
                   3, "claim_amount")


register("policy_aggregate_sum", _sum_grain, oracle("driver_rows", f"""SELECT contract_number, count(*) AS driver_count,
  max(operation_date) AS operation_date, max(premium) AS premium, coalesce(max(is_claim), 0)::INTEGER AS is_claim,
  {sfx('coalesce(sum(claim_amount), 0)', 3)} AS claim_amount, coalesce(sum(claim_cnt), 0)::DOUBLE AS claim_cnt FROM driver_rows GROUP BY 1"""))
register("policy_to_rows_join", lambda s, d: P.policy_to_rows(
    S.driver_rows(s, d).select("row_key", "contract_number", "premium"), S.policies(s, d), ["driver_count", "car_age_mean"]),
    oracle("policy", """SELECT r.row_key, r.contract_number, r.premium, p.driver_count, p.car_age_mean
FROM driver_rows r LEFT JOIN policy p ON r.contract_number IS NOT DISTINCT FROM p.contract_number"""))
register("submission", lambda s, d: rounded(P.submission(S.driver_rows(s, d), S.priced_policies(s, d)), 3, "new_premium"),
         oracle("priced", f"""SELECT r.unique_id, r.contract_number, {sfx('p.new_premium', 3)} AS new_premium
FROM driver_rows r LEFT JOIN priced p ON r.contract_number IS NOT DISTINCT FROM p.contract_number"""))

# -- runs ---------------------------------------------------------------

RUN_CUT = "2000-06-01"


def _run_tables(s, d):
    """The tables of a run whose first attempt ended before its manifest; readers see the second only."""
    root = f"{shared_folder(s)}/run-tables-{uuid.uuid4().hex}"
    policy = materialize(S.policies(s, d).select("contract_number", "operation_date", "premium", "is_claim"), "policy")
    early = F.col("operation_date") < F.lit(RUN_CUT).cast("timestamp_ntz")
    tables = {"full": policy, "train": policy.where(early), "valid": policy.where(~early)}
    A.Attempt(s, root, "r1").table(policy.withColumn("premium", F.lit(-1.0)), "full")
    done = A.Attempt(s, root, "r1")
    for name, table in tables.items():
        done.table(table, name)
    done.publish({"policies": policy.count()})
    read = [A.read_run_table(s, root, "r1", name).withColumn("table_name", F.lit(name)) for name in A.run_tables(s, root, "r1")]
    return reduce(DataFrame.unionByName, read)


_tables = {"full": "true", "train": f"operation_date < TIMESTAMP '{RUN_CUT}'", "valid": f"operation_date >= TIMESTAMP '{RUN_CUT}'"}
register("run_tables", _run_tables, oracle("policy", "\nUNION ALL ".join(
    f"SELECT contract_number, operation_date, premium, is_claim, '{name}' AS table_name FROM policy WHERE {where}" for name, where in _tables.items())))


def _leaderboard(s, d):
    """One run per region, appended side by side; each was tried before, and one metric is unknown to runs without a region."""
    root = f"{shared_folder(s)}/leaderboard-{uuid.uuid4().hex}"
    found = S.policies(s, d).groupBy(F.coalesce("region_name", F.lit("none")).alias("run_id")).agg(
        F.count("*").alias("policies"), F.max("premium").alias("largest_premium"), F.sum("is_claim").alias("claims")).collect()
    records = [{k: v for k, v in row.asDict().items() if k != "claims" or row["run_id"] != "none"} for row in found]
    for tries in ([{**r, "policies": -1} for r in records], records):
        side_by_side(s, [lambda r=r: A.Attempt(s, root, r["run_id"]).publish(r) for r in tries])
    return A.published(s, root).select("run_id", "policies", "largest_premium", "claims")


register("leaderboard_runs", _leaderboard, oracle("policy", """SELECT coalesce(region_name, 'none') AS run_id, count(*) AS policies, max(premium) AS largest_premium,
  CASE WHEN coalesce(region_name, 'none') <> 'none' THEN sum(is_claim)::BIGINT END AS claims FROM policy GROUP BY 1"""))
