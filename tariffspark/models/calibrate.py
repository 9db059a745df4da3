"""Probability calibration, and blends of fitted models."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.functions.columns import clip
from tariffspark.models.freqsev import RiskModel, build_candidate, label, load_risk_model
from tariffspark.models.isotonic import IsotonicCurve
from tariffspark.models.oof import out_of_fold
from tariffspark.operators import metrics as M
from tariffspark.operators.selection import blend_predictions
from tariffspark.roles import CLAIM, CONTRACT, PREDICTION
from tariffspark.session import materialize
from tariffspark.sources.tables import read_json, write_json


@dataclass
class CalibrationConfig:
    enabled: bool = False
    method: str = "none"
    oof_folds: int = 5
    group_column: str = CONTRACT
    min_samples: int = 500
    clip_eps: float = 1e-6

    def __post_init__(self) -> None:
        self.method = {"sigmoid": "platt"}.get(self.method.strip().lower(), self.method.strip().lower())
        if self.method not in ("none", "platt", "isotonic"):
            self.method = "none"
        self.clip_eps = min(max(float(self.clip_eps), 1e-9), 0.1)


def platt(p: Column, slope: float, intercept: float, eps: float = 1e-6) -> Column:
    """Calibrated probability: a logistic function of the clipped one."""
    inside = clip(p, eps, 1.0 - eps)
    return clip(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(slope)) * inside + F.lit(float(intercept))))), eps, 1.0 - eps)


def apply_probability(df: DataFrame, probability: Column) -> DataFrame:
    """Replace the claim probability and follow with the expected loss."""
    return df.withColumn("p_claim", probability).withColumn("expected_loss", F.col("expected_severity") * F.col("p_claim"))


class Calibrator:
    """none, platt (logistic in the probability) or isotonic (``model`` holds the curve)."""

    def __init__(self, method: str = "none", eps: float = 1e-6, slope: float = 0.0, intercept: float = 0.0,
                 model: IsotonicCurve | None = None) -> None:
        self.method, self.eps, self.slope, self.intercept, self.model = method, eps, slope, intercept, model

    @staticmethod
    def fit(df: DataFrame, method: str, eps: float = 1e-6) -> "Calibrator":
        """``df`` holds p_claim and is_claim."""
        points = df.select(clip(F.col("p_claim"), eps, 1.0 - eps).alias("p"), label().cast("double").alias("y"))
        if method == "platt":
            data = VectorAssembler(inputCols=["p"], outputCol="features").transform(points)
            fitted = LogisticRegression(labelCol="y", featuresCol="features", maxIter=2000, tol=1e-10, regParam=1.0 / max(points.count(), 1),
                                        standardization=False).fit(data)
            return Calibrator("platt", eps, float(fitted.coefficients[0]), float(fitted.intercept))
        if method == "isotonic":
            return Calibrator("isotonic", eps, model=IsotonicCurve.fit(points, F.col("p"), F.col("y")))
        if method == "none":
            return Calibrator("none", eps)
        raise ValueError(f"unsupported calibration method: {method}")

    def transform(self, df: DataFrame) -> DataFrame:
        inside = clip(F.col("p_claim"), self.eps, 1.0 - self.eps)
        if self.method == "platt":
            return apply_probability(df, platt(F.col("p_claim"), self.slope, self.intercept, self.eps))
        if self.method == "isotonic":
            return apply_probability(df, clip(self.model.at(inside), self.eps, 1.0 - self.eps))
        return apply_probability(df, inside)


class CalibratedModel(RiskModel):
    kind = "calibrated"

    def __init__(self, base: RiskModel, calibrator: Calibrator) -> None:
        super().__init__()
        self.base, self.calibrator = base, calibrator

    def fit(self, df):
        self.base.fit(df)
        return self

    def predict(self, df):
        return self.calibrator.transform(self.base.predict(df))

    def save(self, spark: SparkSession, path: str) -> None:
        self.base.save(spark, f"{path}/base")
        c = self.calibrator
        write_json(spark, f"{path}/meta", {"kind": self.kind, "method": c.method, "eps": c.eps, "slope": c.slope, "intercept": c.intercept})
        if c.model is not None:
            c.model.save(spark, f"{path}/isotonic")


class BlendModel(RiskModel):
    """Weighted sum of the predictions of fitted models."""

    kind = "oof_blend_freq_sev"

    def __init__(self, models: dict[str, RiskModel], weights: dict[str, float]) -> None:
        super().__init__()
        self.models, self.weights = models, weights

    def fit(self, df):
        return self

    def predict(self, df):
        used = [n for n in self.models if self.weights.get(n, 0.0) > 0]
        out = df.drop(*[c for c in PREDICTION if c in df.columns])
        for name in used:
            out = self.models[name].predict(out).withColumnsRenamed({c: f"{name}_{c}" for c in PREDICTION})
        blended = blend_predictions(out, used, self.weights)
        return blended.drop(*[f"{n}_{c}" for n in used for c in PREDICTION])

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark, f"{path}/meta", {"kind": self.kind, "weights": self.weights, "models": sorted(self.models)})
        for name, model in self.models.items():
            model.save(spark, f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> RiskModel:
    """Any saved model: a plain candidate, a calibrated one or a blend."""
    meta = read_json(spark, f"{path}/meta")
    if meta["kind"] == CalibratedModel.kind:
        isotonic = IsotonicCurve.load(spark, f"{path}/isotonic") if meta["method"] == "isotonic" else None
        return CalibratedModel(load_model(spark, f"{path}/base"), Calibrator(meta["method"], meta["eps"], meta["slope"], meta["intercept"], isotonic))
    if meta["kind"] == BlendModel.kind:
        return BlendModel({n: load_model(spark, f"{path}/{n}") for n in meta["models"]}, meta["weights"])
    return load_risk_model(spark, path)


def oof_predictions(df: DataFrame, candidate: str, params: dict[str, Any] | None = None, folds: int = 5, group: str = CONTRACT,
                    resume_path: str | None = None) -> DataFrame:
    """Rows of ``df`` (key, target) with the out-of-fold predictions of a candidate."""
    def fit(train: DataFrame):
        model = build_candidate(candidate, params).fit(train)
        key = [group] if group in df.columns else []
        return lambda rows: model.predict(rows).select(*key, CLAIM, *PREDICTION)

    return out_of_fold(df, fit, folds, group, resume_path, {"candidate": candidate, "params": params or {}})


@dataclass
class CalibrationReport:
    """What happened to a candidate's calibration, and its quality out of fold before and after."""

    status: str
    reason: str
    brier_raw: float | None = None
    brier_calibrated: float | None = None
    auc_raw: float | None = None
    auc_calibrated: float | None = None


def obstacle(train: DataFrame, candidate: str, config: CalibrationConfig) -> str | None:
    """Why this split allows no calibration: the first condition that holds, all evaluated in one aggregation."""
    # Names of the reasons.
    conditions = {
        "not_enough_samples": F.count(F.lit(1)) < config.min_samples,
        "blend_candidate_not_supported": F.lit(candidate == BlendModel.kind),
        "single_class_target": F.count_distinct(label()) < 2,
    }
    return train.agg(F.coalesce(*[F.when(c, F.lit(name)) for name, c in conditions.items()])).first()[0]


def fit_calibrator(train: DataFrame, candidate: str, config: CalibrationConfig, params: dict[str, Any] | None = None,
                   oof: DataFrame | None = None) -> tuple[Calibrator | None, CalibrationReport]:
    """Calibrator on out-of-fold probabilities with its report; None where a guard or a fit that the folds do not allow stops it."""
    if not config.enabled or config.method == "none":
        return None, CalibrationReport("disabled", "disabled_in_config")
    reason = obstacle(train, candidate, config)
    if reason is not None:
        return None, CalibrationReport("skipped", reason)
    try:
        if oof is None:
            oof = oof_predictions(train, candidate, params, config.oof_folds, config.group_column)
        scored = materialize(oof.select(CLAIM, *PREDICTION), "calibration")
        calibrator = Calibrator.fit(scored, config.method, config.clip_eps)
    except (ValueError, IllegalArgumentException) as exc:  # lost jobs and missing columns still raise
        return None, CalibrationReport("failed", f"oof_error:{exc}"[:500])
    quality = {}
    for name, table in (("raw", scored), ("calibrated", calibrator.transform(scored))):
        row = M.classification_metrics(table).first()
        quality |= {f"brier_{name}": row["brier"], f"auc_{name}": row["auc"]}
    return calibrator, CalibrationReport("applied", "ok", **quality)
