"""Leakage screening and the keep / review / drop decisions built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffspark.functions.columns import nonneg
from tariffspark.operators.quality import null_rates
from tariffspark.roles import AMOUNT, CLAIM, CONTRACT, FORBIDDEN, PREMIUM, PREMIUM_NET, TARGETS, numeric_columns

# Name patterns that raise the leakage risk of a column, with their points.
NAME_RULES = [
    ("target_name_pattern", r"(?i)(is_claim|claim_amount|claim_cnt|target|label)", 35.0),
    ("claim_semantic_pattern", r"(?i)(claim|loss|payout|paid|reserve|damage)", 20.0),
    ("id_semantic_pattern", r"(?i)(iin|id$|_id$|number$)", 10.0),
]


def target_correlations(df: DataFrame, features: Sequence[str], targets: dict[str, Column], least: int) -> DataFrame:
    """(feature, n, <target>...): correlations over the non-null values, of which ``least`` are needed.

    The columns are stacked, so the plan stays small for any number of them and
    a task returns one partial row per column.
    """
    names = list(targets)
    long = df.select(*[y.alias(f"_{t}") for t, y in targets.items()], *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        [f"_{t}" for t in names], list(features), "feature", "x")
    found = long.where("x is not null").groupBy("feature").agg(F.count("*").alias("n"), *[F.corr("x", f"_{t}").alias(t) for t in names])
    known = [F.when((F.col("n") >= least) & ~F.isnan(t), F.col(t)).alias(t) for t in names]
    return found.select("feature", "n", *known)


def leakage_watchlist(df: DataFrame, target: str = CLAIM) -> DataFrame:
    """Numeric columns by absolute correlation with the claim flag (at least 30 values)."""
    features = numeric_columns(df, TARGETS)
    y = F.coalesce(F.col(target), F.lit(0)).cast("double")
    found = target_correlations(df, features, {"corr_with_is_claim": y}, 30)
    return (
        found.where("corr_with_is_claim is not null")
        .select("feature", F.abs("corr_with_is_claim").alias("abs_corr_with_is_claim"), "corr_with_is_claim")
        .orderBy(F.desc("abs_corr_with_is_claim"), "feature")
    )


def identifier_blacklist(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, "forbidden_identifier_or_linkage") for c in FORBIDDEN], "feature string, rule string")


def leakage_risk(df: DataFrame, train_only: Sequence[str] = tuple(TARGETS)) -> DataFrame:
    """Risk score per column from its role, its name and its correlation with the targets.

    From 90 points the recommendation is drop, from 45 review, else keep.
    """
    features = numeric_columns(df, [*TARGETS, *FORBIDDEN])
    correlation = target_correlations(df, features, {
        "c1": F.coalesce(F.col(CLAIM), F.lit(0)).cast("double"), "c2": nonneg(F.col(AMOUNT))}, 21)
    # One row per column of the table from here on.
    table = null_rates(df).withColumnRenamed("null_rate", "missing_rate").join(F.broadcast(correlation), "feature", "left")
    name = F.col("feature")
    c1, c2 = F.abs("c1"), F.abs("c2")
    rules: list[tuple[Column, float, str]] = [
        (name.isin(*TARGETS), 100.0, "exact_target_column"),
        (name.isin(*FORBIDDEN), 30.0, "forbidden_identifier_column"),
        *[(name.rlike(pattern), points, rule) for rule, pattern, points in NAME_RULES],
    ]
    for value, label in ((c1, "is_claim"), (c2, "claim_amount")):
        rules.append((value >= 0.35, 25.0, f"high_abs_corr_{label}>=0.35"))
        rules.append(((value >= 0.20) & (value < 0.35), 10.0, f"mid_abs_corr_{label}>=0.20"))
    only = name.isin(list(train_only)) if train_only else F.lit(False)
    rules.append((only, 15.0, "train_only_column"))
    rules.append((F.col("missing_rate") > 0.95, 0.0, "extremely_sparse"))
    risk = sum((F.when(cond, F.lit(points)).otherwise(F.lit(0.0)) for cond, points, _ in rules), F.lit(0.0))
    reasons = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, _, label in rules]))), ";")
    return (
        table.select(
            "feature", risk.alias("risk_score"), c1.alias("abs_corr_is_claim"), c2.alias("abs_corr_claim_amount"), "missing_rate",
            only.cast("int").alias("train_only"), reasons.alias("reasons"))
        .withColumn("action_recommendation",
                    F.when(F.col("risk_score") >= 90, "drop").when(F.col("risk_score") >= 45, "review").otherwise("keep"))
        .orderBy(F.desc("risk_score"), "feature")
    )


def feature_action_board(missing: DataFrame, leakage: DataFrame, psi: DataFrame) -> DataFrame:
    """Missingness, leakage and drift of every feature, joined into one final action with a priority."""
    joined = (
        missing.select("feature", "missing_rate")
        .join(leakage.select("feature", "risk_score", "action_recommendation", "reasons"), "feature", "full")
        .join(psi.where("psi is not null").select("feature", "psi"), "feature", "full")
        .fillna({"missing_rate": 0.0, "risk_score": 0.0, "psi": 0.0, "action_recommendation": "keep", "reasons": ""})
    )
    risk, rate = F.col("risk_score"), F.col("missing_rate")
    action = (
        F.when(F.col("feature").isin(*TARGETS, *FORBIDDEN), "drop")
        .when(risk >= 90, "drop")
        .when((rate > 0.95) & (risk >= 40), "drop")
        .when((risk >= 45) | (F.col("psi") >= 0.25) | (rate > 0.90), "review")
        .otherwise("keep")
    )
    return joined.withColumn("final_action", action).withColumn(
        "priority_score", risk + F.lit(100.0) * F.col("psi") + F.lit(10.0) * rate)


def feature_board_diff(board: DataFrame, droplist: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Proposed drops not yet on the drop list, and reviews that the white list does not hold."""
    new_drop = board.where("final_action = 'drop'").join(droplist.select("feature"), "feature", "left_anti")
    review = board.where("final_action = 'review'").join(whitelist.select("feature"), "feature", "left_anti")
    return new_drop.select(F.lit("new_drop_candidate").alias("list"), "feature").unionByName(
        review.select(F.lit("review_not_in_whitelist").alias("list"), "feature"))


def feature_selection(
    policy: DataFrame,
    target: str = CLAIM,
    grain: str = CONTRACT,
    drop_above: float = 0.90,
    review_above: float = 0.60,
    corr_review: float = 0.08,
    force_keep: Sequence[str] = (PREMIUM, PREMIUM_NET),
    force_drop: Sequence[str] = tuple(dict.fromkeys([*FORBIDDEN, *TARGETS])),
) -> DataFrame:
    """(feature, decision, reason, missing_rate, abs_corr): keep, drop or review for each policy column."""
    candidates = [c for c in policy.columns if c not in {grain, target, *force_drop}]
    numeric = [c for c in numeric_columns(policy) if c in candidates]
    y = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    correlated = target_correlations(policy, numeric, {"corr": y}, 50).select("feature", F.abs("corr").alias("abs_corr"))
    table = (null_rates(policy, candidates).withColumnRenamed("null_rate", "missing_rate")
             .join(F.broadcast(correlated), "feature", "left")
             .withColumn("abs_corr", F.coalesce("abs_corr", F.lit(0.0))))
    sparse, strong = F.col("missing_rate") > review_above, F.col("abs_corr") >= corr_review
    reasons = F.concat_ws("|", F.when(sparse, f"missing_rate>{review_above:.2f}"), F.when(strong, f"abs_corr>={corr_review:.2f}"))
    kept, dropped = F.col("feature").isin(*force_keep), F.col("missing_rate") > drop_above
    decided = table.select(
        "feature",
        F.when(kept, "keep").when(dropped, "drop").when(sparse | strong, "review").otherwise("keep").alias("decision"),
        F.when(kept, "force_keep").when(dropped, f"missing_rate>{drop_above:.2f}")
        .when(sparse | strong, reasons).otherwise("pass_rules").alias("reason"),
        "missing_rate", "abs_corr",
    )
    forced = [(c, "drop", "force_drop", None, None) for c in force_drop if c in policy.columns]
    if not forced:
        return decided
    return decided.unionByName(policy.sparkSession.createDataFrame(
        forced, "feature string, decision string, reason string, missing_rate double, abs_corr double"))


def selection_summary(selection: DataFrame, policy: DataFrame) -> DataFrame:
    return selection.agg(
        F.lit(len(policy.columns)).cast("bigint").alias("total_policy_columns"),
        F.count_if(F.col("reason") != "force_drop").alias("candidate_features"),
        F.count_if(F.col("decision") == "keep").alias("whitelist_count"),
        F.count_if(F.col("decision") == "drop").alias("droplist_count"),
        F.count_if(F.col("decision") == "review").alias("review_count"),
    )
