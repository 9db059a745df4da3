"""Scoring and repricing with what a run has saved, as table jobs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.models.calibrate import load_model
from tariffspark.operators.preprocess import Preprocessor, transform
from tariffspark.operators.pricing import PricingPolicy, apply_policy
from tariffspark.roles import PREDICTION
from tariffspark.sources.runs import published
from tariffspark.sources.tables import read_json


def latest_path(spark: SparkSession, artifacts: str) -> str:
    """Folder of the newest run on the leaderboard."""
    return published(spark, artifacts).agg(F.max_by("path", F.struct("finished_at", "path"))).first()[0]


def load_policy(spark: SparkSession, run: str) -> PricingPolicy:
    return PricingPolicy.from_json(json.dumps(read_json(spark, f"{run}/pricing_policy")))


def score_batch(spark: SparkSession, run: str, records: DataFrame) -> DataFrame:
    """Records as given with predictions: the run's preparation, then its model, without a second look at the records."""
    state = Preprocessor.load(spark, f"{run}/preprocessor")
    packed = records.withColumn("_record", F.struct(*[c for c in records.columns if c not in PREDICTION]))
    predicted = load_model(spark, f"{run}/model").predict(transform(packed, state, carry=["_record"]))
    return predicted.select("_record.*", *PREDICTION)


def chosen_policy(policy: PricingPolicy, alpha: float | None = None, beta: float | None = None) -> PricingPolicy:
    """The saved tariff, or a manual scalar one as soon as alpha or beta is given.

    Both keep the mean loss of the fit, so that a price does not depend on the
    batch it is computed in.
    """
    if alpha is None and beta is None:
        return policy
    mean = policy.mean_loss
    if mean is None and policy.bucket_params:
        mean = policy.bucket_params[0].get("mean_expected_loss")
    use_alpha = alpha if alpha is not None else policy.alpha
    use_beta = beta if beta is not None else policy.beta
    return PricingPolicy("scalar", "manual_override", 0.0 if use_alpha is None else use_alpha, 1.0 if use_beta is None else use_beta, mean)


def reprice(scored: DataFrame, policy: PricingPolicy, alpha: float | None = None, beta: float | None = None, mean_loss: str = "fitted") -> DataFrame:
    """``new_premium`` for records with an expected loss; ``mean_loss='batch'`` takes the batch's own mean instead."""
    use = chosen_policy(policy, alpha, beta)
    if mean_loss == "batch" and use.kind == "scalar":
        use = PricingPolicy(**{**use.__dict__, "mean_loss": None})
    return apply_policy(scored, use)


def reprice_batch(spark: SparkSession, run: str, records: DataFrame, alpha: float | None = None, beta: float | None = None) -> DataFrame:
    return reprice(score_batch(spark, run, records), load_policy(spark, run), alpha, beta)
