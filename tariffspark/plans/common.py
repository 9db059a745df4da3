"""Pieces shared by the registered queries and by their DuckDB twins.

Doubles that come from sums or logarithms differ in their last bits between
engines, so a registered query rounds them; the operators themselves never do.
``floor(x * 10^d + 0.5003) / 10^d`` is the same arithmetic in both engines, and
the small excess over one half keeps sums of short decimals, which often end
exactly on a half, away from the rounding boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fx(c: Column, digits: int = 9) -> Column:
    scale = F.lit(float(10 ** digits))
    return F.floor(c.cast("double") * scale + F.lit(0.5003)).cast("double") / scale


def rounded(df: DataFrame, digits: int = 9, *columns: str, **other: int) -> DataFrame:
    """Round ``columns`` to ``digits`` and each keyword column to its own number of digits."""
    plan = {**{c: digits for c in columns}, **other}
    return df.select(*[fx(F.col(c), plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns])


def sfx(expression: str, digits: int = 9) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({expression})::DOUBLE * {scale} + 0.5003::DOUBLE) / {scale})"


DRIVER_ROWS = """driver_rows AS (
SELECT concat_ws('|', cast(l.l_orderkey as varchar), cast(l.l_linenumber as varchar), cast(l.l_partkey as varchar),
         cast(l.l_suppkey as varchar), cast(cast(l.l_quantity as int) as varchar), cast(cast(l.l_shipdate as date) as varchar)) AS row_key,
       l.l_orderkey * 10 + l.l_linenumber AS unique_id,
       l.l_orderkey AS contract_number,
       o.o_orderdate AS operation_date,
       o.o_totalprice AS premium,
       o.o_totalprice * (1 - l.l_discount) AS premium_wo_term,
       CASE WHEN l.l_returnflag = 'R' AND l.l_quantity >= 46 THEN 1 ELSE 0 END AS is_claim,
       CASE WHEN l.l_returnflag = 'R' AND l.l_quantity >= 46 THEN o.o_totalprice * (l.l_tax + 0.5::DOUBLE) * 9.8::DOUBLE END AS claim_amount,
       CASE WHEN l.l_returnflag = 'R' AND l.l_quantity >= 46 THEN 1 END AS claim_cnt,
       CASE WHEN c.c_custkey % 20 = 0 THEN NULL ELSE r.r_name END AS region_name,
       n.n_name AS ownerkato, o.o_orderpriority AS vehicle_type_name, p.p_brand AS mark, p.p_type AS model,
       floor(p.p_retailprice / 10)::DOUBLE AS engine_power,
       CASE WHEN l.l_partkey % 9 = 0 THEN NULL ELSE p.p_size END AS car_age,
       CASE l.l_partkey % 11 WHEN 0 THEN 'M' WHEN 1 THEN ' 7 ' ELSE cast(p.p_size % 14 as varchar) END AS bonus_malus,
       CASE l.l_partkey % 13 WHEN 0 THEN '2 00' WHEN 1 THEN '1 98' WHEN 2 THEN 'bad' ELSE cast(1995 + p.p_size % 26 as varchar) END AS car_year,
       l.l_quantity AS SCORE_1_1,
       CASE WHEN l.l_partkey % 7 = 0 THEN NULL ELSE floor(l.l_discount * 100 + 0.5::DOUBLE)::DOUBLE END AS SCORE_4_1,
       CASE WHEN l.l_suppkey % 3 = 0 THEN NULL ELSE floor(l.l_tax * 100 + 0.5::DOUBLE)::DOUBLE END AS SCORE_11_1,
       o.o_custkey AS driver_iin, l.l_suppkey AS insurer_iin, l.l_partkey AS car_number
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey)"""

_FIRST = ", ".join(f"arg_min({c}, row_key) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in
                   ("operation_date", "region_name", "ownerkato", "vehicle_type_name", "mark", "model", "bonus_malus", "car_year"))

POLICY = f"""policy AS (
SELECT contract_number, count(*)::BIGINT AS driver_count, max(premium) AS premium, max(premium_wo_term) AS premium_wo_term,
       coalesce(max(is_claim), 0)::INTEGER AS is_claim, coalesce(max(claim_amount), 0)::DOUBLE AS claim_amount,
       coalesce(max(claim_cnt), 0)::DOUBLE AS claim_cnt,
       avg(engine_power) AS engine_power_mean, avg(car_age::DOUBLE) AS car_age_mean,
       avg(SCORE_1_1) AS SCORE_1_1, avg(SCORE_4_1) AS SCORE_4_1, avg(SCORE_11_1) AS SCORE_11_1, {_FIRST}
FROM driver_rows GROUP BY contract_number)"""

SCORED = """scored AS (
SELECT *, p_claim * expected_severity AS expected_loss FROM (
  SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(-2.72::DOUBLE + 0.02::DOUBLE * SCORE_1_1 + 0.01::DOUBLE * coalesce(car_age_mean, 25.0::DOUBLE)))) AS p_claim,
         5.4::DOUBLE * premium AS expected_severity FROM policy))"""


def scalar_price_sql(loss: str, mean: str, alpha: str, beta: str, base: str = "greatest(premium, 0)") -> str:
    index = f"(CASE WHEN {mean} > 0 THEN {loss} / {mean} ELSE 1.0::DOUBLE END)"
    raw = f"{base} * {beta}::DOUBLE * (1.0::DOUBLE + {alpha}::DOUBLE * ({index} - 1.0::DOUBLE))"
    return f"least(greatest({raw}, 0.0::DOUBLE), 3.0::DOUBLE * {base})"


PRICED = f"""priced AS (
SELECT *, CASE WHEN premium > 0 THEN new_premium / premium - 1.0::DOUBLE ELSE 0.0::DOUBLE END AS price_delta_pct FROM (
  SELECT *, {scalar_price_sql('expected_loss', '(SELECT avg(expected_loss) FROM scored)', '0.3', '1.0')} AS new_premium FROM scored))"""

_LAYERS = {"driver_rows": [DRIVER_ROWS], "policy": [DRIVER_ROWS, POLICY], "scored": [DRIVER_ROWS, POLICY, SCORED],
           "priced": [DRIVER_ROWS, POLICY, SCORED, PRICED]}


def oracle(layer: str, select: str, *ctes: str) -> str:
    """SQL text: the layers up to ``layer``, extra CTEs, then the final select."""
    return "WITH " + ",\n".join([*(c.replace(" AS (", " AS MATERIALIZED (", 1) for c in _LAYERS[layer]), *ctes]) + "\n" + select


def net_share_sql(net: str = "premium_wo_term", base: str = "premium") -> str:
    return f"(CASE WHEN {base} > 0 THEN least(greatest({net} / {base}, 0.0::DOUBLE), 1.0::DOUBLE) ELSE 1.0::DOUBLE END)"


def kpi_select_sql(source: str, new: str = "new_premium", by: str = "", weight: str = "1.0::DOUBLE", target: float = 0.7,
                   low: float = 0.69, high: float = 0.71, retention: bool = False) -> str:
    """KPI row(s) of a priced source, written as one nested SELECT."""
    head, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    r = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0::DOUBLE END"
    extra = " + 0.1::DOUBLE * retention_rate" if retention else ""
    keep = "retention_rate, " if retention else ""
    return f"""
SELECT {head}violations, lr_total, lr_group1, lr_group2, share_group1, {keep}abs(lr_total - {target}::DOUBLE) AS distance_to_target,
  (lr_total BETWEEN {low}::DOUBLE AND {high}::DOUBLE)::INTEGER AS in_target,
  -abs(lr_total - {target}::DOUBLE) - 0.7::DOUBLE * abs(lr_group1 - {target}::DOUBLE) - 0.7::DOUBLE * abs(lr_group2 - {target}::DOUBLE)
  + 0.15::DOUBLE * share_group1 - 2.0::DOUBLE * violations + CASE WHEN lr_total BETWEEN {low}::DOUBLE AND {high}::DOUBLE THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END{extra} AS policy_score
FROM (SELECT {head}violations, {r('po', 'ne')} AS lr_total, {r('po1', 'ne1')} AS lr_group1, {r('po2', 'ne2')} AS lr_group2,
        {r('w1', 'w')} AS share_group1, w / n AS retention_rate
  FROM (SELECT {head}count(*) AS n, sum(pay * w) AS po, sum(net * w) AS ne, coalesce(sum(pay * w) FILTER (WHERE keep), 0) AS po1,
          coalesce(sum(net * w) FILTER (WHERE keep), 0) AS ne1, coalesce(sum(pay * w) FILTER (WHERE NOT keep), 0) AS po2,
          coalesce(sum(net * w) FILTER (WHERE NOT keep), 0) AS ne2, sum(w) AS w, coalesce(sum(w) FILTER (WHERE keep), 0) AS w1, sum(bad)::BIGINT AS violations
    FROM (SELECT *, {weight} AS w, claim_amount AS pay, {new} * {net_share_sql()} AS net, {new} <= premium AS keep,
            ({new} < 0)::INTEGER + ({new} > 3.0::DOUBLE * premium)::INTEGER AS bad FROM {source}){group}))"""
