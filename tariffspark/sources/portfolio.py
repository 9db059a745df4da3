"""The driver-grain portfolio view over the given star-schema tables.

``row_key`` identifies a row and is the tie-break of every order-dependent
operator; ``unique_id`` repeats on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.operators.policy import aggregate_to_policy
from tariffspark.operators.pricing import price_delta, price_scalar
from tariffspark.session import materialize
from tariffspark.sources.tables import read_table


def driver_rows(spark: SparkSession, folder: str) -> DataFrame:
    # What moves with every driver row is made narrow before it moves: a flag and a day instead of a text and a time.
    lineitem = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", F.to_date("l_shipdate").alias("l_shipdate"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 46)).alias("claimed"))
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    part = read_table(spark, folder, "part").select(
        "p_partkey", "p_brand", "p_type", "p_size", F.floor(F.col("p_retailprice") / 10).cast("double").alias("power"))
    # nation and region are fixed lists of 25 and 5 rows.
    place = customer.join(F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))),
                          F.col("c_nationkey") == F.col("n_nationkey"))
    # The customer joins the orders first and the order comes last: its columns never move with the driver rows, and rows that
    # lie by order need not move again to become policies.
    placed = orders.join(place, F.col("o_custkey") == F.col("c_custkey"))
    joined = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    claimed = F.col("claimed")
    part_mod = {m: F.col("l_partkey") % m for m in (7, 9, 11, 13)}
    return joined.select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                    F.col("l_quantity").cast("int").cast("string"), F.col("l_shipdate").cast("string")).alias("row_key"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unique_id"),
        F.col("l_orderkey").alias("contract_number"),
        F.col("o_orderdate").alias("operation_date"),
        F.col("o_totalprice").alias("premium"),
        (F.col("o_totalprice") * (1 - F.col("l_discount"))).alias("premium_wo_term"),
        F.when(claimed, 1).otherwise(0).alias("is_claim"),
        F.when(claimed, F.col("o_totalprice") * (F.col("l_tax") + F.lit(0.5)) * F.lit(9.8)).alias("claim_amount"),
        F.when(claimed, 1).alias("claim_cnt"),
        F.when(F.col("c_custkey") % 20 != 0, F.col("r_name")).alias("region_name"),
        F.col("n_name").alias("ownerkato"),
        F.col("o_orderpriority").alias("vehicle_type_name"),
        F.col("p_brand").alias("mark"),
        F.col("p_type").alias("model"),
        F.col("power").alias("engine_power"),
        F.when(part_mod[9] != 0, F.col("p_size")).alias("car_age"),
        F.when(part_mod[11] == 0, "M").when(part_mod[11] == 1, " 7 ")
         .otherwise((F.col("p_size") % 14).cast("string")).alias("bonus_malus"),
        F.when(part_mod[13] == 0, "2 00").when(part_mod[13] == 1, "1 98").when(part_mod[13] == 2, "bad")
         .otherwise((F.lit(1995) + F.col("p_size") % 26).cast("string")).alias("car_year"),
        F.col("l_quantity").alias("SCORE_1_1"),
        F.when(part_mod[7] != 0, F.floor(F.col("l_discount") * 100 + F.lit(0.5)).cast("double")).alias("SCORE_4_1"),
        F.when(F.col("l_suppkey") % 3 != 0, F.floor(F.col("l_tax") * 100 + F.lit(0.5)).cast("double")).alias("SCORE_11_1"),
        F.col("o_custkey").alias("driver_iin"),
        F.col("l_suppkey").alias("insurer_iin"),
        F.col("l_partkey").alias("car_number"),
    )


def policies(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate_to_policy(driver_rows(spark, folder), order_key="row_key")


def demo_score(policy: DataFrame) -> DataFrame:
    """A fixed stand-in for a fitted model, so that pricing has a known expected loss."""
    logit = (F.lit(-2.72) + F.lit(0.02) * F.col("SCORE_1_1")
             + F.lit(0.01) * F.coalesce(F.col("car_age_mean"), F.lit(25.0)))
    return (
        policy.withColumn("p_claim", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
        .withColumn("expected_severity", F.lit(5.4) * F.col("premium"))
        .withColumn("expected_loss", F.col("p_claim") * F.col("expected_severity"))
    )


def scored_policies(spark: SparkSession, folder: str) -> DataFrame:
    return demo_score(policies(spark, folder))


def priced_policies(spark: SparkSession, folder: str, alpha: float = 0.3, beta: float = 1.0) -> DataFrame:
    # Pricing reads the policies twice (mean loss, then prices); the driver rows should be read once.
    return price_delta(price_scalar(materialize(scored_policies(spark, folder), "scored"), alpha, beta))
