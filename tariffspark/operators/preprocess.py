"""Fit the feature preparation on one split, apply it to any other."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffspark.functions.columns import clip, date_part, finite
from tariffspark.operators import encode as E
from tariffspark.operators import features as X
from tariffspark.operators import prune as P
from tariffspark.roles import CLAIM, CONTRACT, FORBIDDEN, IDENTIFIERS, OPERATION_DATE, PREMIUM, PREMIUM_NET, ROW_KEY, TARGETS, is_numeric
from tariffspark.session import for_now, materialize
from tariffspark.sources.tables import read_json, write_json

ENCODED = ["model", "mark", "ownerkato", "region_name", "car_year", "bonus_malus"]


@dataclass
class PreprocessConfig:
    grain: str = CONTRACT
    targets: list[str] = field(default_factory=lambda: list(TARGETS))
    drop_columns: list[str] = field(default_factory=lambda: [*IDENTIFIERS, ROW_KEY])
    forbidden: list[str] = field(default_factory=lambda: list(FORBIDDEN))
    whitelist: list[str] = field(default_factory=list)
    droplist: list[str] = field(default_factory=list)
    force_keep: list[str] = field(default_factory=lambda: [PREMIUM, PREMIUM_NET])
    force_drop: list[str] = field(default_factory=list)
    numeric_default: str = "median"
    financial_fill: float = 0.0
    missing_flag_threshold: float = 0.05
    missing_prefixes: list[str] = field(default_factory=lambda: ["SCORE_4_", "SCORE_11_", "SCORE_"])
    winsor_low: float = 0.01
    winsor_high: float = 0.99
    rare_share: float = 0.005
    rare_count: int = 200
    date_columns: list[str] = field(default_factory=lambda: [OPERATION_DATE])
    date_parts: list[str] = field(default_factory=lambda: list(E.DATE_PARTS))
    target_encoded: list[str] = field(default_factory=lambda: list(ENCODED))
    frequency_encoded: list[str] = field(default_factory=lambda: list(ENCODED))
    smoothing: float = 20.0
    min_leaf: int = 100
    log1p: list[str] = field(default_factory=lambda: [PREMIUM, PREMIUM_NET])
    interactions: list[str] = field(default_factory=lambda: list(X.BASE_INTERACTIONS))
    extended_interactions: list[str] = field(default_factory=list)
    interaction_limits: dict = field(default_factory=lambda: {"max_features": 12, "corr": 0.995, "psi": 0.6})
    prune: dict | None = None
    drift: dict | None = None


@dataclass
class Preprocessor:
    config: PreprocessConfig
    numeric: list[str]
    categorical: list[str]
    dates: list[str]
    fills: dict[str, float]
    bounds: dict[str, tuple[float, float]]
    flagged: list[str]
    missing_plan: dict[str, list[str]]
    interactions: list[str]
    interaction_report: dict
    target_mean: float
    rows: int
    lookup_rows: int
    features: list[str]
    pruning: list[dict] = field(default_factory=list)
    lookup: DataFrame | None = None

    @property
    def target_encoded(self) -> list[str]:
        return [c for c in self.config.target_encoded if c in self.categorical]

    @property
    def frequency_encoded(self) -> list[str]:
        return [c for c in self.config.frequency_encoded if c in self.categorical]

    def families(self) -> dict[str, list[str]]:
        """Feature families for ablation."""
        return {
            "drop_date_features": [f"{c}_{p}" for c in self.dates for p in self.config.date_parts],
            "drop_target_encoding": [f"{c}_te" for c in self.target_encoded],
            "drop_frequency_encoding": [f"{c}_freq" for c in self.frequency_encoded],
            "drop_interactions": list(self.interactions),
            "drop_missing_aggregates": list(self.missing_plan),
        }

    def save(self, spark: SparkSession, path: str) -> None:
        """Scalars and lists as JSON, the category lookup as Parquet."""
        plain = {k: (asdict(v) if k == "config" else v) for k, v in self.__dict__.items() if k != "lookup"}
        write_json(spark, f"{path}/state", json.loads(json.dumps(plain)))
        if self.lookup is not None:
            self.lookup.write.mode("overwrite").parquet(f"{path}/lookup")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Preprocessor":
        plain = read_json(spark, f"{path}/state")
        plain["config"] = PreprocessConfig(**plain["config"])
        plain["bounds"] = {k: tuple(v) for k, v in plain["bounds"].items()}
        out = Preprocessor(**plain)
        out.lookup = spark.read.parquet(f"{path}/lookup") if out.categorical else None
        return out


def assign_roles(df: DataFrame, cfg: PreprocessConfig) -> tuple[list[str], list[str], list[str]]:
    """Numeric, categorical and date inputs after identifiers, lists and forced columns."""
    protected = {cfg.grain, *cfg.targets}
    ignored = (set(cfg.drop_columns) | set(cfg.forbidden)) - protected
    fields = [f for f in df.schema.fields if f.name not in protected and f.name not in ignored]
    dates = [f.name for f in fields if f.name in cfg.date_columns]
    numeric = [f.name for f in fields if f.name not in dates and is_numeric(f.dataType)]
    categorical = [f.name for f in fields if f.name not in dates and f.name not in numeric]
    available = {*numeric, *categorical, *dates}
    forced = ({*cfg.force_keep, *dates, *cfg.target_encoded, *cfg.frequency_encoded}) & available
    chosen = (available & set(cfg.whitelist)) | forced if cfg.whitelist else set(available)
    chosen = (chosen - set(cfg.droplist) - set(cfg.force_drop)) | forced
    numeric, categorical, dates = ([c for c in part if c in chosen] for part in (numeric, categorical, dates))
    if not numeric and not categorical and PREMIUM in available:
        numeric = [PREMIUM]
    return numeric, categorical, dates


def fit_preprocessor(df: DataFrame, config: PreprocessConfig | None = None, order_key: str | None = None) -> Preprocessor:
    """Fit on ``df`` (train rows only).  The input is written once; each statistic then reads its own columns."""
    cfg = config or PreprocessConfig()
    with for_now(E.clean_numeric_columns(df), "fit") as cleaned:
        return _fitted(cleaned, cfg, order_key)


def _fitted(cleaned: DataFrame, cfg: PreprocessConfig, order_key: str | None) -> Preprocessor:
    numeric, categorical, dates = assign_roles(cleaned, cfg)
    flagged = E.fit_missing_flags(cleaned, numeric, cfg.missing_flag_threshold) if numeric else []
    fills = E.fit_fill_values(cleaned, numeric, cfg.numeric_default, cfg.financial_fill)
    bounded = [c for c in numeric if c not in (PREMIUM, PREMIUM_NET)]
    bounds = E.fit_winsor_bounds(E.impute(cleaned, fills), bounded, cfg.winsor_low, cfg.winsor_high) if bounded else {}
    state = (E.fit_categories(cleaned, categorical, CLAIM, cfg.rare_share, cfg.rare_count, cfg.smoothing, cfg.min_leaf)
             if categorical else None)
    plan = X.missing_aggregate_plan(flagged, cfg.missing_prefixes)

    fitted = Preprocessor(cfg, numeric, categorical, dates, fills, bounds, flagged, plan, [], {},
                          state.target_mean if state else 0.0, state.rows if state else 0, state.lookup_rows if state else 0, [],
                          lookup=state.lookup if state else None)
    sources = list(X.interaction_sources(_prepared(cleaned.limit(0), fitted)))
    base = X.plan_interactions(cfg.interactions, sources)
    extended = X.plan_interactions(cfg.extended_interactions, sources, list(X.EXTENDED_INTERACTIONS))
    extra = [n for n in extended["accepted"] if n not in base["accepted"]]
    fitted.interactions = [*base["accepted"], *extra]
    fitted.interaction_report = extended
    fitted.features = sorted({
        *numeric, *categorical, *[f"{c}_{p}" for c in dates for p in cfg.date_parts],
        *[f"{c}_log1p" for c in cfg.log1p if c in numeric], *[f"{c}_is_missing" for c in flagged],
        *[f"{c}_te" for c in fitted.target_encoded], *[f"{c}_freq" for c in fitted.frequency_encoded],
        *plan, *fitted.interactions,
    })
    if extra or cfg.prune or cfg.drift:
        _prune(cleaned, fitted, extra, order_key or cfg.grain)
    return fitted


def _prune(cleaned: DataFrame, fitted: Preprocessor, extra: Sequence[str], order_key: str) -> None:
    cfg = fitted.config
    matrix = transform(cleaned, fitted, carry=[c for c in (*fitted.dates, order_key) if c not in (cfg.grain, *cfg.targets)])
    table = materialize(matrix, "matrix")
    result = P.prune_features(
        table, fitted.features, interactions=extra, limits=cfg.interaction_limits, statistics=cfg.prune, drift=cfg.drift,
        force_keep=cfg.force_keep, date=fitted.dates[0] if fitted.dates else None, key=order_key)
    fitted.pruning = result.decisions
    fitted.features = [c for c in fitted.features if c in set(result.kept)]
    fitted.interactions = [c for c in fitted.interactions if c in set(result.kept) or c not in set(extra)]


def _prepared(df: DataFrame, state: Preprocessor) -> DataFrame:
    """All feature groups except the interactions."""
    cfg = state.config
    absent = {c: F.lit(None).cast("double") for c in state.numeric if c not in df.columns}
    absent |= {c: F.lit(None).cast("string") for c in state.categorical if c not in df.columns}
    absent |= {c: F.lit(None).cast("timestamp_ntz") for c in state.dates if c not in df.columns}
    if absent:
        df = df.withColumns(absent)
    df = E.missing_flags(df, state.flagged)
    df = E.impute(df, state.fills)
    df = df.withColumns({c: clip(F.col(c), *b) for c, b in state.bounds.items()})
    df = E.log1p_columns(df, [c for c in cfg.log1p if c in state.numeric])
    if state.categorical:
        lookup = E.CategoryState(state.lookup, state.target_mean, state.rows, state.lookup_rows, state.categorical)
        df = E.fold_and_encode(df, lookup, state.categorical, state.target_encoded, state.frequency_encoded)
    for c in state.dates:
        ts = F.col(c) if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(c).try_cast("timestamp_ntz")
        df = df.withColumns({f"{c}_{p}": date_part(ts, p) for p in cfg.date_parts})
    return X.missing_aggregates(df, state.missing_plan) if state.missing_plan else df


def project(df: DataFrame, state: Preprocessor, carry: Sequence[str] = ()) -> DataFrame:
    """Grain, targets and features in a fixed order; absent features get neutral values, infinities null."""
    cfg = state.config
    text = {*state.categorical, "region_x_vehicle_type"}

    def value(c: str):
        if c not in df.columns:
            return (F.lit("missing") if c in text else F.lit(0) if c.endswith("_is_missing") else F.lit(0.0)).alias(c)
        kind = df.schema[c].dataType
        return (finite(F.col(c)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c)).alias(c)

    kept = [c for c in (cfg.grain, *cfg.targets, *carry) if c in df.columns]
    return df.select(*kept, *[value(c) for c in state.features if c not in kept])


def transform(df: DataFrame, state: Preprocessor, carry: Sequence[str] = ()) -> DataFrame:
    """Feature matrix of any split with the fitted state; ``carry`` keeps extra input columns."""
    prepared = _prepared(E.clean_numeric_columns(df), state)
    return project(X.with_interactions(prepared, state.interactions), state, carry)


def train_matrix(df: DataFrame, state: Preprocessor, folds: int = 5, group: str | None = CONTRACT, noise_std: float = 0.0) -> DataFrame:
    """Matrix of the fit split itself, with out-of-fold target encodings in place of the fitted ones.

    Nothing is written but the encodings; ``df`` is read once for them and once for the matrix.
    """
    matrix = transform(df, state)
    if not state.target_encoded:
        return matrix
    cfg = state.config
    plain = matrix.drop(*[f"{c}_te" for c in state.target_encoded])
    encoded = E.out_of_fold_encoding(plain, state.target_encoded, folds, group, CLAIM, cfg.smoothing, cfg.min_leaf, noise_std,
                                     row_key=cfg.grain)
    return encoded.select(*matrix.columns)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing after preprocessing: {lacking}")
