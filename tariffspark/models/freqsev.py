"""Frequency x severity models: claim probability times expected claim amount."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffspark.functions.columns import clip, nonneg
from tariffspark.models import boosting as G
from tariffspark.models import newton as N
from tariffspark.models.matrix import FeatureSchema, align, fit_matrix, infer_schema
from tariffspark.models.oof import FOLD_KEY, with_fold_key
from tariffspark.models.optimality import score_equations
from tariffspark.operators import woe as W
from tariffspark.operators.split import group_folds
from tariffspark.roles import AMOUNT, CLAIM, CONTRACT, PREDICTION
from tariffspark.session import divided_code, for_now, materialize
from tariffspark.sources.tables import read_json, write_json

MIN_CLAIMS = 20
NEWTON_WIDTH = 4096       # the widest vector whose normal equations Spark solves
NEWTON_ACCEPTED = N.ACCEPTED
SIGNAL = "freq_risk_signal"


def label() -> Column:
    return F.coalesce(F.col(CLAIM), F.lit(0)).cast("int")


def class_weights(df: DataFrame) -> DataFrame:
    """(is_claim, n, weight): weights that give both classes the same total."""
    counts = df.groupBy(label().alias(CLAIM)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count("*")).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")))


def severity_constant(df: DataFrame) -> DataFrame:
    """Mean amount of the claims: the severity when there are too few claims to fit one."""
    return df.where(label() > 0).agg(F.coalesce(F.avg(nonneg(F.col(AMOUNT))), F.lit(0.0)).alias("severity_constant"), F.count("*").alias("claims"))


def expected_loss(df: DataFrame, probability: Column, log_severity: Column) -> DataFrame:
    """The three prediction columns from a probability and a log1p severity."""
    return (df.withColumn("p_claim", probability).withColumn("expected_severity", F.expm1(clip(log_severity, 0.0, 20.0)))
            .withColumn("expected_loss", F.col("p_claim") * F.col("expected_severity")))


def fit_balanced_logistic(vectors: DataFrame, max_iter: int = 300, balanced: bool = True, penalty: float = 1.0, rows: N.Rows | None = None) -> LogisticRegressionModel:
    """L2 logistic regression; the penalty is per data set, so it shrinks with the total weight.

    Newton steps reach the optimum in a handful of passes, where a gradient method may need hundreds. Vectors too
    wide for the normal equations, a single class and fits that Newton steps do not settle go to the gradient method.
    ``rows`` are the same vectors as columns (y and w are set here).
    """
    counts = {r["y"]: r["n"] for r in vectors.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    if balanced and len(counts) == 2:
        weight = F.when(F.col("y") == 1, F.lit(total / (2.0 * counts[1]))).otherwise(F.lit(total / (2.0 * counts[0])))
    if len(counts) == 2:
        if rows is None:
            width = len(vectors.select("features").first()[0])
            rows = N.rows_of_vectors(vectors, F.col("y"), width)
        if rows.width <= NEWTON_WIDTH:
            found = N.newton(replace(rows, df=rows.df.withColumn("w", weight)), "logistic", penalty, min(N.STEPS, max_iter))
            if found is not None:
                return N.logistic_model(vectors.sparkSession, *found)
    kept = vectors.withColumn("w", weight).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return LogisticRegression(labelCol="y", featuresCol="features", weightCol="w", maxIter=max_iter, regParam=penalty / max(total, 1),
                                  elasticNetParam=0.0, standardization=False).fit(kept)
    finally:
        kept.unpersist()


def logistic_coefficients(model: LogisticRegressionModel | PipelineModel, width: int) -> np.ndarray:
    """Coefficients over all places of the vector, whichever way the model was fitted."""
    if isinstance(model, LogisticRegressionModel):
        return model.coefficients.toArray()
    out, (*slicing, glm) = np.zeros(width), model.stages
    out[slicing[0].getIndices() if slicing else slice(None)] = glm.coefficients.toArray()
    return out


def with_probability(df: DataFrame, stages: dict[str, Any]) -> DataFrame:
    """``df`` with ``_p`` from its features, whichever way the model was fitted."""
    model = stages.get("newton") or stages["logistic"]
    if isinstance(model, PipelineModel):
        return model.transform(df).drop("_varying")
    scored = model.transform(df).withColumn("_p", vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def logistic_stage(model: LogisticRegressionModel | PipelineModel) -> tuple[str, Any]:
    """Runs saved in earlier rounds hold a pipeline named ``newton``."""
    return ("logistic" if isinstance(model, LogisticRegressionModel) else "newton"), model


def fit_ridge(claims: DataFrame, n: int, alpha: float, rows: N.Rows | None = None) -> LinearRegressionModel:
    """Ridge regression whose penalty is alpha on the sum of squares; ``rows`` are the same vectors and targets as columns.

    One step solves it, a second one takes back the rounding of the first. Vectors too wide for that go to Spark's
    solver, which divides the penalty it is given by the target's deviation.
    """
    if rows is not None and rows.width <= NEWTON_WIDTH:
        found = N.newton(rows, "squared", alpha, 3, 1e-13, 1e-9)
        if found is not None:
            return N.linear_model(claims.sparkSession, *found)
    spread = claims.agg(F.stddev_pop("target")).first()[0] or 1.0
    return LinearRegression(labelCol="target", featuresCol="features", elasticNetParam=0.0, standardization=False, regParam=alpha / max(n, 1) * spread).fit(claims)


def linear_equations(vectors: DataFrame, stages: dict[str, Any], claims: DataFrame, ridge: LinearRegressionModel | None,
                     alpha: float) -> list[tuple[str, int, float]]:
    """(part, rows, largest equation) of a balanced logistic and a ridge fit: zero where the fit is the optimum."""
    classes = class_weights(vectors.withColumnRenamed("y", CLAIM)).collect()
    weight = F.coalesce(*[F.when(F.col("y") == r[CLAIM], F.lit(r["weight"])) for r in classes])
    scored = with_probability(vectors, stages)
    logistic = stages.get("newton") or stages["logistic"]
    width = logistic.numFeatures if isinstance(logistic, LogisticRegressionModel) else vectors.select(F.max(F.size(vector_to_array("features")))).first()[0]
    n, found = score_equations(scored, weight * (F.col("_p") - F.col("y")), logistic_coefficients(logistic, width), 1.0 / sum(r["n"] for r in classes))
    out = [("frequency", n, float(abs(found).max()))]
    if ridge is not None:
        n = claims.count()
        n, found = score_equations(ridge.transform(claims), F.col("prediction") - F.log1p("amount"), ridge.coefficients.toArray(), alpha / n)
        out.append(("severity", n, float(abs(found).max())))
    return out


@dataclass
class Fitted:
    """Common parts of a fitted model: where its columns come from and how severity is predicted."""

    params: dict[str, Any]
    schema: FeatureSchema
    constant: float = 0.0
    stages: dict[str, Any] = field(default_factory=dict)


_LOADERS = {
    "matrix": PipelineModel, "severity_matrix": PipelineModel, "newton": PipelineModel, "logistic": LogisticRegressionModel, "ridge": LinearRegressionModel,
    "tweedie": GeneralizedLinearRegressionModel,
}


class RiskModel:
    """fit(df) and predict(df); predict adds p_claim, expected_severity and expected_loss."""

    kind = ""

    def __init__(self, **params: Any) -> None:
        self.params = {**self.defaults(), **params}
        self.fitted: Fitted | None = None
        self.bins: DataFrame | None = None

    @classmethod
    def defaults(cls) -> dict[str, Any]:
        return {}

    def fit(self, df: DataFrame) -> "RiskModel":
        with divided_code(df.sparkSession):
            return self._fit(df)

    def _fit(self, df: DataFrame) -> "RiskModel":
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` as given, with the prediction columns added."""
        kept = [c for c in df.columns if c not in PREDICTION]
        return self._score(df.withColumn("_row", F.struct(*kept)), self._ready()).select("_row.*", *PREDICTION)

    def _score(self, df: DataFrame, f: Fitted) -> DataFrame:
        raise NotImplementedError

    def _ready(self) -> Fitted:
        if self.fitted is None:
            raise RuntimeError("the model must be fitted before it predicts")
        return self.fitted

    def save(self, spark: SparkSession, path: str) -> None:
        f = self._ready()
        write_json(spark, f"{path}/meta", {"kind": self.kind, "params": self.params, "schema": asdict(f.schema), "constant": f.constant,
                                           "stages": sorted(f.stages), "extra": self._extra()})
        for name, stage in f.stages.items():
            if isinstance(stage, G.BoostedModel):
                stage.save(spark, f"{path}/{name}")
            else:
                stage.write().overwrite().save(f"{path}/{name}")
        if self.bins is not None:
            self.bins.write.mode("overwrite").parquet(f"{path}/bins")

    def _extra(self) -> dict[str, Any]:
        return {}

    def _restore(self, extra: dict[str, Any]) -> None:
        pass

    # -- shared fitting steps

    def _vectors(self, df: DataFrame, matrix: PipelineModel) -> DataFrame:
        return matrix.transform(df).select(label().alias("y"), nonneg(F.col(AMOUNT)).alias("amount"), "features")


class FrequencySeverity(RiskModel):
    """Class-balanced logistic regression times ridge regression on log amounts."""

    kind = "baseline_freq_sev"

    @classmethod
    def defaults(cls):
        return {"max_iter": 300, "ridge_alpha": 1.0}

    def _fit_frequency(self, vectors: DataFrame, rows: N.Rows | None):
        return logistic_stage(fit_balanced_logistic(vectors, int(self.params["max_iter"]), rows=rows))

    def _fit_severity(self, claims: DataFrame, n: int, rows: N.Rows | None):
        return "ridge", fit_ridge(claims, n, float(self.params["ridge_alpha"]), rows)

    def equations(self, df: DataFrame) -> list[tuple[str, int, float]]:
        """Score equations of the fit on the table it was fitted on."""
        f = self._ready()
        vectors = self._vectors(align(df, f.schema), f.stages["matrix"])
        return linear_equations(vectors, f.stages, vectors.where("y > 0"), f.stages.get("ridge"), float(self.params["ridge_alpha"]))

    def _probability(self, df: DataFrame, f: Fitted) -> DataFrame:
        """``df`` with features and p (a model over the aligned columns)."""
        return with_probability(f.stages["matrix"].transform(df), f.stages)

    def _log_severity(self, scored: DataFrame, f: Fitted) -> DataFrame:
        if "ridge" not in f.stages:
            return scored.withColumn("_s", F.log1p(F.lit(float(f.constant))))
        return f.stages["ridge"].transform(scored).withColumnRenamed("prediction", "_s")

    def _fit(self, df: DataFrame) -> "FrequencySeverity":
        schema = infer_schema(df)
        aligned = align(df, schema)
        matrix = fit_matrix(aligned, schema)
        vectors = self._vectors(aligned, matrix)
        name, frequency = self._fit_frequency(vectors, N.rows_of(aligned, matrix, label()))
        self.fitted = Fitted(self.params, schema, stages={"matrix": matrix, name: frequency})
        constant = severity_constant(df).first()
        self.fitted.constant = constant["severity_constant"]
        if constant["claims"] >= MIN_CLAIMS:
            claims = vectors.where("y > 0").withColumn("target", F.log1p("amount"))
            rows = N.rows_of(aligned.where(label() > 0), matrix, F.log1p(nonneg(F.col(AMOUNT))))
            sname, severity = self._fit_severity(claims, constant["claims"], rows)
            self.fitted.stages[sname] = severity
        return self

    def _score(self, df: DataFrame, f: Fitted) -> DataFrame:
        scored = self._log_severity(self._probability(align(df, f.schema), f), f)
        return expected_loss(scored, F.col("_p"), F.col("_s"))


# Names that configurations of boosted-tree libraries use for the same settings.
SETTING_NAMES = {"n_estimators": "iterations", "max_depth": "depth", "l2_leaf_reg": "leaf_penalty", "reg_lambda": "leaf_penalty", "colsample_bytree": "column_share",
                 "rsm": "column_share", "min_child_weight": "least_child_weight", "gamma": "split_penalty", "border_count": "bins", "max_bin": "bins",
                 "severity_loss_function": "severity_loss", "tweedie_variance_power": "power", "random_state": "seed"}
LOSS_NAMES = {"rmse": "squared", "squared": "squared", "tweedie": "tweedie"}


def boost_settings(given: dict[str, Any]) -> dict[str, Any]:
    """Settings under this library's names; ``reg_`` in front names the same setting of the severity part."""
    out = {}
    for name, value in given.items():
        if name in SETTING_NAMES:
            out[SETTING_NAMES[name]] = value
        elif name.startswith("reg_") and name[4:] in SETTING_NAMES:
            out[f"reg_{SETTING_NAMES[name[4:]]}"] = value
        else:
            out[name] = value
    return out


class BoostedFrequencySeverity(RiskModel):
    """Histogram-boosted trees for both parts: probability of a claim, and log amount (or, with the Tweedie loss, the amount) of claims."""

    kind = "gbt_freq_sev"

    def __init__(self, **params: Any) -> None:
        super().__init__(**boost_settings(params))

    @classmethod
    def defaults(cls):
        return {"iterations": 40, "depth": 4, "learning_rate": 0.1, "subsample": 0.8, "column_share": 1.0, "leaf_penalty": 1.0, "split_penalty": 0.0,
                "least_child_weight": 1.0, "bins": 64, "severity_loss": "squared", "power": 1.5, "reg_iterations": None, "seed": 42}

    def settings(self, severity: bool = False) -> G.BoostParams:
        def p(name):
            own = self.params.get(f"reg_{name}") if severity else None
            return self.params[name] if own is None else own

        loss = LOSS_NAMES.get(str(self.params["severity_loss"]).strip().lower(), "squared") if severity else "logistic"
        # The depth of a tree of unlimited depth is bounded by its heap.
        depth = int(p("depth")) if int(p("depth")) > 0 else 10
        return G.BoostParams(loss, int(p("iterations")), min(depth, 12), float(p("learning_rate")), float(p("subsample")), float(p("column_share")), float(p("leaf_penalty")),
                             float(p("split_penalty")), float(p("least_child_weight")), min(max(float(p("power")), 1.01), 1.99), int(p("seed")))

    def binning(self, df: DataFrame, schema: FeatureSchema, bins: int | None = None) -> G.Binning:
        return G.fit_binning(align(df, schema), schema.numeric, schema.categorical, label(), int(bins or self.params["bins"]))

    def severity_task(self, constant) -> G.Task:
        params = self.settings(True)
        return G.Task(params, "unit" if params.loss == "tweedie" else "log", claims_only=True)

    def take(self, schema: FeatureSchema, binning: G.Binning, frequency: G.Task, severity: G.Task | None, constant: float, trees: tuple[int | None, int | None] = (None, None)):
        """Become the model of two grown tasks, or of their first ``trees``."""
        stages = {"gbt_class": G.BoostedModel.of(frequency, binning, trees[0])}
        if severity is not None:
            stages["gbt_value"] = G.BoostedModel.of(severity, binning, trees[1])
        self.fitted = Fitted(self.params, schema, constant, stages)
        return self

    def _fit(self, df: DataFrame) -> "BoostedFrequencySeverity":
        schema = infer_schema(df)
        constant = severity_constant(df).first()
        binning = self.binning(df, schema)
        blocks = boost_blocks(df, schema, binning, constant["severity_constant"])
        try:
            frequency = G.Task(self.settings(), "claim")
            severity = self.severity_task(constant) if constant["claims"] >= MIN_CLAIMS else None
            G.grow(blocks, [t for t in (frequency, severity) if t is not None])
        finally:
            blocks.unpersist()
        return self.take(schema, binning, frequency, severity, constant["severity_constant"])

    def _severity(self, model: G.BoostedModel, unit: float) -> Column:
        if model.params.loss != "tweedie":
            return model.margin()
        return F.log1p(F.exp(clip(model.margin(), -20.0, 20.0)) * F.lit(unit if unit > 0 else 1.0))

    def _score(self, df: DataFrame, f: Fitted) -> DataFrame:
        scored = align(df, f.schema).withColumn("_p", logistic(f.stages["gbt_class"].margin()))
        value = f.stages.get("gbt_value")
        return expected_loss(scored, F.col("_p"), F.log1p(F.lit(float(f.constant))) if value is None else self._severity(value, f.constant))


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def boost_blocks(df: DataFrame, schema: FeatureSchema, binning: G.Binning, unit: float, fold: Column | None = None) -> G.Blocks:
    """Targets of both parts over the binned rows; amounts in units of their mean keep a log link near zero."""
    amount = nonneg(F.col(AMOUNT))
    key = CONTRACT if CONTRACT in df.columns else binning.columns[0]
    targets = {"claim": label(), "log": F.log1p(amount), "unit": amount / F.lit(unit if unit > 0 else 1.0)}
    return G.pack_blocks(align(df, schema), binning, targets, label(), F.col(key), fold)


class DependentFrequencySeverity(BoostedFrequencySeverity):
    """Boosted trees whose severity also sees the claim probability, out of fold while fitting."""

    kind = "gbt_dep_freq_sev"

    @classmethod
    def defaults(cls):
        return {**super().defaults(), "oof_folds": 5, "group": CONTRACT}

    def _fit(self, df: DataFrame) -> "DependentFrequencySeverity":
        p, schema = self.params, infer_schema(df)
        constant = severity_constant(df).first()
        binning = self.binning(df, schema)
        folded = materialize(group_folds(with_fold_key(df), int(p["oof_folds"]), p["group"], FOLD_KEY, "_fold").drop(FOLD_KEY), "dep")
        blocks = boost_blocks(folded, schema, binning, constant["severity_constant"], F.col("_fold"))
        try:
            # The model of all rows and those that leave a fold out grow together.
            frequency = G.Task(self.settings(), "claim")
            held_out = [G.Task(self.settings(), "claim", hold_out=i) for i in range(int(p["oof_folds"]))]
            G.grow(blocks, [frequency, *held_out])
        finally:
            blocks.unpersist()
        self.take(schema, binning, frequency, None, constant["severity_constant"])
        if constant["claims"] >= MIN_CLAIMS:
            signal = F.coalesce(*[F.when(F.col("_fold") == i, logistic(G.BoostedModel.of(t, binning).margin())) for i, t in enumerate(held_out)])
            claims = materialize(align(folded.where(label() > 0), schema).withColumn(SIGNAL, signal).drop("_fold"), "claims")
            wide = FeatureSchema([*schema.numeric, SIGNAL], schema.categorical)
            second = self.binning(claims, wide)
            blocks = boost_blocks(claims, wide, second, constant["severity_constant"])
            try:
                severity = self.severity_task(constant)
                G.grow(blocks, [severity])
            finally:
                blocks.unpersist()
            self.fitted.stages["gbt_value"] = G.BoostedModel.of(severity, second)
        return self

    def _score(self, df: DataFrame, f: Fitted) -> DataFrame:
        scored = align(df, f.schema).withColumn("_p", logistic(f.stages["gbt_class"].margin())).withColumn(SIGNAL, F.col("_p"))
        value = f.stages.get("gbt_value")
        return expected_loss(scored, F.col("_p"), F.log1p(F.lit(float(f.constant))) if value is None else self._severity(value, f.constant))


class WoeFrequencySeverity(RiskModel):
    """Logistic regression on weight-of-evidence values; ridge on the raw numbers."""

    kind = "woe_freq_sev"

    @classmethod
    def defaults(cls):
        return {"n_bins": 10, "min_bin_size": 50, "max_iter": 1000, "ridge_alpha": 1.0, "iv_threshold": 0.02}

    def _extra(self):
        return {"selected": self.selected}

    def _restore(self, extra):
        self.selected = list(extra["selected"])

    def _numbers(self, df: DataFrame, schema: FeatureSchema) -> DataFrame:
        return align(df, schema).fillna(0.0, subset=schema.numeric)

    def _fit(self, df: DataFrame) -> "WoeFrequencySeverity":
        p = self.params
        schema = FeatureSchema(infer_schema(df).numeric, [])
        with for_now(align(df, schema), "woe-fit") as table:
            self.bins = materialize(W.woe_bins(table, schema.numeric, int(p["n_bins"]), int(p["min_bin_size"]), prepared=True), "bins")
            self.selected = W.select_features(self.bins, float(p["iv_threshold"]))
            inputs = [f"{c}_woe" for c in self.selected]
            encoded = W.woe_transform(table, self.bins, self.selected)
            if not inputs:
                inputs, encoded = ["_none"], encoded.withColumn("_none", F.lit(0.0))
            assemble = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features")]).fit(encoded)
            rows = N.rows_of(encoded, assemble, label())
            name, logistic = logistic_stage(fit_balanced_logistic(self._vectors(encoded, assemble), int(p["max_iter"]), rows=rows))
            constant = severity_constant(table).first()
            stages = {"matrix": assemble, name: logistic}
            if constant["claims"] >= MIN_CLAIMS:
                claims = table.fillna(0.0, subset=schema.numeric).where(label() > 0)
                numbers = Pipeline(stages=[VectorAssembler(inputCols=schema.numeric, outputCol="features")]).fit(claims)
                vectors = self._vectors(claims, numbers).withColumn("target", F.log1p("amount"))
                rows = N.rows_of(claims, numbers, F.log1p(nonneg(F.col(AMOUNT))))
                stages |= {"severity_matrix": numbers, "ridge": fit_ridge(vectors, constant["claims"], float(p["ridge_alpha"]), rows)}
        self.fitted = Fitted(p, schema, constant["severity_constant"], stages)
        return self

    def equations(self, df: DataFrame) -> list[tuple[str, int, float]]:
        """Score equations of the fit on the table it was fitted on."""
        f = self._ready()
        encoded = W.woe_transform(align(df, f.schema), self.bins, self.selected)
        encoded = encoded if self.selected else encoded.withColumn("_none", F.lit(0.0))
        vectors = self._vectors(encoded, f.stages["matrix"])
        claims = self._vectors(self._numbers(df, f.schema).where(label() > 0), f.stages["severity_matrix"]) if "ridge" in f.stages else vectors
        return linear_equations(vectors, f.stages, claims, f.stages.get("ridge"), float(self.params["ridge_alpha"]))

    def _score(self, df: DataFrame, f: Fitted) -> DataFrame:
        encoded = W.woe_transform(align(df, f.schema), self.bins, self.selected)
        if not self.selected:
            encoded = encoded.withColumn("_none", F.lit(0.0))
        scored = with_probability(f.stages["matrix"].transform(encoded), f.stages).drop("features")
        if "ridge" not in f.stages:
            return expected_loss(scored, F.col("_p"), F.log1p(F.lit(float(f.constant))))
        scored = f.stages["ridge"].transform(f.stages["severity_matrix"].transform(scored.fillna(0.0, subset=f.schema.numeric)))
        return expected_loss(scored, F.col("_p"), F.col("prediction"))


def tweedie_parts(df: DataFrame, loss: Column, mean_loss: Column, mean_p: Column) -> DataFrame:
    """Split an aggregate loss into probability and severity with the portfolio's mean severity."""
    df = df.withColumn("_l", F.greatest(loss, F.lit(0.0))).withColumn("_m", mean_loss / F.greatest(mean_p, F.lit(1e-9)))
    p = clip(F.col("_l") / F.greatest(F.col("_m"), F.lit(1e-9)), 0.0, 1.0)
    out = df.withColumn("p_claim", p)
    severity = F.when(F.col("p_claim") > 1e-9, F.col("_l") / clip(F.col("p_claim"), 1e-9, 1.0)).otherwise(F.col("_m"))
    return out.withColumn("expected_severity", severity).withColumn("expected_loss", F.col("_l")).drop("_l", "_m")


class TweedieLoss(RiskModel):
    """One Tweedie regression for the total loss, split into parts for reporting."""

    kind = "tweedie_aggregate"

    @classmethod
    def defaults(cls):
        return {"variance_power": 1.5, "max_iter": 50, "penalty": 0.01}

    def _extra(self):
        return {"mean_loss": self.mean_loss, "mean_p": self.mean_p}

    def _restore(self, extra):
        self.mean_loss, self.mean_p = extra["mean_loss"], extra["mean_p"]

    def _fit(self, df: DataFrame) -> "TweedieLoss":
        p = self.params
        schema = FeatureSchema(infer_schema(df).numeric, [])
        row = df.agg(F.avg(nonneg(F.col(AMOUNT))).alias("loss"), F.avg(label().cast("double")).alias("p")).first()
        self.mean_loss, self.mean_p = float(row["loss"] or 0.0), float(row["p"] or 0.05)
        aligned = align(df, schema).fillna(0.0, subset=schema.numeric)
        matrix = fit_matrix(aligned, schema)
        # Losses in units of their mean keep the log link near zero.
        unit = self.mean_loss if self.mean_loss > 0 else 1.0
        vectors = self._vectors(aligned, matrix).select((F.col("amount") / F.lit(unit)).alias("target"), "features")
        # Every step is a pass over these rows; those that memory does not hold are made again from the table, not written a second time.
        vectors = vectors.persist(StorageLevel.MEMORY_ONLY)
        try:
            model = GeneralizedLinearRegression(family="tweedie", variancePower=min(max(float(p["variance_power"]), 1.01), 1.99), linkPower=0.0,
                                                labelCol="target", featuresCol="features", maxIter=int(p["max_iter"]), regParam=float(p["penalty"])).fit(vectors)
        finally:
            vectors.unpersist()
        self.fitted = Fitted(p, schema, unit, {"matrix": matrix, "tweedie": model})
        return self

    def _score(self, df: DataFrame, f: Fitted) -> DataFrame:
        aligned = align(df, f.schema).fillna(0.0, subset=f.schema.numeric)
        scored = f.stages["tweedie"].transform(f.stages["matrix"].transform(aligned))
        return tweedie_parts(scored, F.col("prediction") * F.lit(f.constant), F.lit(self.mean_loss), F.lit(self.mean_p))


CANDIDATES: dict[str, type[RiskModel]] = {
    m.kind: m for m in (FrequencySeverity, BoostedFrequencySeverity, DependentFrequencySeverity, WoeFrequencySeverity, TweedieLoss)
}


def build_candidate(name: str, params: dict[str, Any] | None = None) -> RiskModel:
    if name not in CANDIDATES:
        raise ValueError(f"unknown candidate: {name}")
    return CANDIDATES[name](**(params or {}))


def load_stages(spark: SparkSession, path: str, names: list[str]) -> dict[str, Any]:
    return {n: _LOADERS[n].load(f"{path}/{n}") if n in _LOADERS else G.BoostedModel.load(spark, f"{path}/{n}") for n in names}


def load_risk_model(spark: SparkSession, path: str) -> RiskModel:
    meta = read_json(spark, f"{path}/meta")
    model = build_candidate(meta["kind"], meta["params"])
    model.fitted = Fitted(meta["params"], FeatureSchema(**meta["schema"]), meta["constant"], load_stages(spark, path, meta["stages"]))
    model._restore(meta["extra"])
    if meta["kind"] == WoeFrequencySeverity.kind:
        model.bins = spark.read.parquet(f"{path}/bins")
    return model
