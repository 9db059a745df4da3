"""Model matrix: which columns enter a model and how they become one vector."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffspark.functions.columns import finite
from tariffspark.operators.quantiles import exact_quantiles
from tariffspark.roles import DRIVER_COUNT, FORBIDDEN, PREMIUM, TARGETS, numeric_columns

HASH_BUCKETS = 1 << 14


@dataclass
class FeatureSchema:
    numeric: list[str]
    categorical: list[str]

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.categorical


def infer_schema(df: DataFrame, exclude: Sequence[str] = ()) -> FeatureSchema:
    """Everything but identifiers and targets; premium and driver count lead."""
    out = {*FORBIDDEN, *TARGETS, *exclude}
    numeric = numeric_columns(df, list(out))
    lead = [c for c in (PREMIUM, DRIVER_COUNT) if c in numeric]
    categorical = [c for c in df.columns if c not in out and c not in numeric]
    return FeatureSchema(lead + [c for c in numeric if c not in lead], categorical)


def align(df: DataFrame, schema: FeatureSchema) -> DataFrame:
    """Give ``df`` every schema column in the type the model expects; absent ones are null or ``missing``."""
    columns = {}
    for c in schema.numeric:
        columns[c] = finite(F.col(c)) if c in df.columns else F.lit(None).cast("double")
    for c in schema.categorical:
        columns[c] = F.coalesce(F.col(c).cast("string"), F.lit("missing")) if c in df.columns else F.lit("missing")
    return df.withColumns(columns)


def fit_matrix(df: DataFrame, schema: FeatureSchema, hashed: Sequence[str] = ()) -> PipelineModel:
    """Exact median imputation, scaling by the population deviation without centring, one-hot categories (unknown ones are all zero).

    A column without a value is left out; a constant one, which says no more than
    the intercept, is scaled to zero. One-hot labels live on the driver; name
    columns without a bound on their categories in ``hashed``, which encodes them alike at every size of the data.
    """
    if not schema.columns:
        raise ValueError("at least one feature is needed")
    stages, parts = [], []
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"k_{c}") for c in schema.numeric]).first()
    known = [c for c in schema.numeric if row[f"k_{c}"] > 0]
    if known:
        # Columns complete here may have gaps where the matrix is applied, so each gets its median.
        medians = {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in known}).items()}
        spread = df.agg(*[F.stddev_pop(F.coalesce(F.col(c), F.lit(medians[c]))).alias(c) for c in known]).first()
        fills = ", ".join(f"coalesce(`{c}`, {v!r}D) AS `{c}__filled`" for c, v in medians.items())
        stages.append(SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"))
        names = [f"{c}__filled" for c in known]
        stages += [VectorAssembler(inputCols=names, outputCol="_numeric", handleInvalid="keep"),
                   ElementwiseProduct(scalingVec=Vectors.dense([1.0 / spread[c] if spread[c] else 0.0 for c in known]), inputCol="_numeric", outputCol="_scaled")]
        parts.append("_scaled")
    small = [c for c in schema.categorical if c not in hashed]
    large = [c for c in schema.categorical if c in hashed]
    if small:
        # The indexer's place for unknown categories is the last one, which the encoder drops.
        stages += [StringIndexer(inputCols=small, outputCols=[f"{c}__index" for c in small], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}__index" for c in small], outputCols=[f"{c}__hot" for c in small], dropLast=True, handleInvalid="error")]
        parts += [f"{c}__hot" for c in small]
    if large:
        stages.append(FeatureHasher(inputCols=large, outputCol="_hashed", numFeatures=HASH_BUCKETS))
        parts.append("_hashed")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df)


def matrix_slots(matrix: PipelineModel) -> list[str]:
    """Name of every place of the vector: the column, or ``column=category``; hashed columns have no names."""
    names = []
    for stage in matrix.stages:
        if isinstance(stage, VectorAssembler) and stage.getOutputCol() == "_numeric":
            names += [c.removesuffix("__filled") for c in stage.getInputCols()]
        if isinstance(stage, StringIndexerModel):
            names += [f"{c}={label}" for c, labels in zip(stage.getInputCols(), stage.labelsArray) for label in labels]
    return names


def matrix_entries(df: DataFrame, matrix: PipelineModel, key: str) -> DataFrame:
    """The matrix as a table (key, slot, value) of its entries other than zero."""
    names = F.array(*[F.lit(n) for n in matrix_slots(matrix)])
    cells = matrix.transform(df).select(key, F.posexplode(vector_to_array("features")).alias("_place", "value")).where("value <> 0")
    return cells.select(key, F.get(names, F.col("_place")).alias("slot"), "value")
