"""Row-wise derived features: score statistics, missing counts, interactions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffspark.functions.columns import safe_divide, to_number
from tariffspark.roles import CLAIM, DRIVER_COUNT, PREMIUM, PREMIUM_NET, SCORE_PREFIX, is_numeric


def score_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.name.startswith(SCORE_PREFIX) and is_numeric(f.dataType) and not f.name.endswith("_is_missing")]


def score_statistics(columns: Sequence[str]) -> dict[str, Column]:
    """Row mean, population deviation and median over the given columns; nulls skipped, none left gives 0."""
    values = [F.col(c).cast("double") for c in columns]
    n = reduce(add, [v.isNotNull().cast("int") for v in values])
    mean = reduce(add, [F.coalesce(v, F.lit(0.0)) for v in values]) / n
    square = reduce(add, [F.coalesce((v - mean) * (v - mean), F.lit(0.0)) for v in values])
    # Ascending order puts nulls first, so the values start after len - n places.
    ordered, skip = F.sort_array(F.array(*values)), F.lit(len(values)) - n
    low = F.try_element_at(ordered, (skip + F.floor((n + 1) / 2)).cast("int"))
    high = F.try_element_at(ordered, (skip + F.floor((n + 2) / 2)).cast("int"))
    some = n > 0
    return {
        "score_mean": F.when(some, mean).otherwise(F.lit(0.0)),
        "score_std": F.when(some, F.sqrt(square / n)).otherwise(F.lit(0.0)),
        "score_median": F.when(some, (low + high) / 2).otherwise(F.lit(0.0)),
    }


def with_score_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns(score_statistics(list(columns or score_columns(df))))


def prefix_token(prefix: str) -> str:
    """Lower-case name part of a column prefix."""
    kept = "".join(ch if ch.isalnum() else "_" for ch in prefix.lower())
    return "_".join(p for p in kept.split("_") if p) or "missing"


def missing_aggregate_plan(flagged: Sequence[str], prefixes: Sequence[str] = ("SCORE_4_", "SCORE_11_", "SCORE_")) -> dict[str, list[str]]:
    """Output column -> flag columns it sums (``*_share`` divides by their number)."""
    plan: dict[str, list[str]] = {}
    scores = [f"{c}_is_missing" for c in flagged if c.startswith(SCORE_PREFIX)]
    if scores:
        plan["score_missing_cnt_total"] = scores
        plan["score_missing_share"] = scores
    for prefix in prefixes:
        own = [f"{c}_is_missing" for c in flagged if c.startswith(prefix)]
        if own and prefix != SCORE_PREFIX:
            plan[f"{prefix_token(prefix)}_missing_cnt"] = own
    return plan


def missing_aggregates(df: DataFrame, plan: Mapping[str, Sequence[str]]) -> DataFrame:
    out = {}
    for name, flags in plan.items():
        total = reduce(add, [F.col(f) if f in df.columns else F.lit(0) for f in flags]).cast("double")
        out[name] = total / F.lit(float(len(flags))) if name.endswith("_share") else total
    return df.withColumns(out)


@dataclass(frozen=True)
class Interaction:
    sources: tuple[str, ...]
    build: Callable[[Mapping[str, Column]], Column]


def _product(a: str, b: str) -> Interaction:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return Interaction((a, b), lambda s: zero(s[a]) * zero(s[b]))


def _quotient(a: str, b: str) -> Interaction:
    return Interaction((a, b), lambda s: safe_divide(s[a], s[b]))


BASE_INTERACTIONS: dict[str, Interaction] = {
    "premium_per_driver": _quotient("premium", "driver_count"),
    "premium_wo_term_per_driver": _quotient("premium_wo_term", "driver_count"),
    "premium_per_power": _quotient("premium", "engine_power"),
    "premium_wo_term_per_power": _quotient("premium_wo_term", "engine_power"),
    "car_age_x_bonus_malus": _product("car_age", "bonus_malus"),
    "region_x_vehicle_type": Interaction(
        ("region_name", "vehicle_type_name"), lambda s: F.concat(s["region_name"], F.lit("__"), s["vehicle_type_name"])),
}
EXTENDED_INTERACTIONS: dict[str, Interaction] = {
    "score_x_premium_ratio": _quotient("score_mean", "premium"),
    "score_x_bonus_malus": _product("score_mean", "bonus_malus"),
    "score_x_car_age": _product("score_mean", "car_age"),
    "score_group_mean_diff": Interaction(("score_mean", "score_median"), lambda s: s["score_mean"] - s["score_median"]),
    "premium_x_power": _product("premium", "engine_power"),
    "premium_wo_term_x_power": _product("premium_wo_term", "engine_power"),
    "car_age_x_region_risk": _product("car_age", "region_risk"),
    "bm_x_region_risk": _product("bonus_malus", "region_risk"),
    "score_missing_cnt_x_score_mean": _product("score_missing_cnt_total", "score_mean"),
    "score_dispersion_x_premium": _product("score_std", "premium"),
}
INTERACTIONS = {**BASE_INTERACTIONS, **EXTENDED_INTERACTIONS}

# Each source name with the columns that may provide it, best first.
_SOURCE_COLUMNS: dict[str, tuple[str, ...]] = {
    "premium": (PREMIUM,),
    "premium_wo_term": (PREMIUM_NET,),
    "driver_count": (DRIVER_COUNT,),
    "engine_power": ("engine_power_mean", "engine_power"),
    "car_age": ("car_age_mean", "car_age"),
    "bonus_malus": ("bonus_malus_mean", "bonus_malus"),
    "region_risk": ("region_name_te", "region_name_freq"),
    "score_missing_cnt_total": ("score_missing_cnt_total",),
}


def interaction_sources(df: DataFrame) -> dict[str, Column]:
    """The sources this table can provide, as numbers (or text for the two category sources)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found: dict[str, Column] = {}
    for source, columns in _SOURCE_COLUMNS.items():
        name = next((c for c in columns if c in kinds), None)
        if name:
            found[source] = F.col(name).cast("double") if is_numeric(kinds[name]) else to_number(F.col(name))
    for name in ("region_name", "vehicle_type_name"):
        if name in kinds:
            found[name] = F.coalesce(F.col(name).cast("string"), F.lit("missing"))
    scores = score_columns(df)
    if scores:
        found.update(score_statistics(scores))
    return found


def plan_interactions(names: Sequence[str], available: Sequence[str], whitelist: Sequence[str] | None = None) -> dict[str, list]:
    """Which of the requested interactions can be built, and why the others cannot."""
    report: dict[str, list] = {"accepted": [], "dropped_by_whitelist": [], "dropped_missing_sources": []}
    for name in dict.fromkeys(n.strip() for n in names if n.strip()):
        if whitelist is not None and name not in whitelist:
            report["dropped_by_whitelist"].append(name)
        elif name not in INTERACTIONS:
            report["dropped_missing_sources"].append({"feature": name, "missing_sources": ["unsupported_definition"]})
        else:
            lacking = sorted(set(INTERACTIONS[name].sources) - set(available))
            if lacking:
                report["dropped_missing_sources"].append({"feature": name, "missing_sources": lacking})
            else:
                report["accepted"].append(name)
    return report


def with_interactions(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the named interactions whose sources exist."""
    sources = interaction_sources(df)
    built = {n: INTERACTIONS[n].build(sources) for n in plan_interactions(names, list(sources))["accepted"]}
    return df.withColumns(built) if built else df


def claim_label(target: str = CLAIM) -> Column:
    return F.coalesce(F.col(target).cast("double"), F.lit(0.0))
