"""Dropping features that repeat others, or drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffspark.functions.columns import finite
from tariffspark.operators import drift as D
from tariffspark.operators.features import claim_label
from tariffspark.operators.profile import wide_to_long
from tariffspark.roles import CLAIM, numeric_columns


@dataclass
class Pruned:
    kept: list[str]
    decisions: list[dict] = field(default_factory=list)


def decisions_frame(df: DataFrame, before: int, pruned: Pruned) -> DataFrame:
    """The decisions as rows (feature, reason, kept_instead, value) plus one ``summary`` row per count."""
    rows = [(d["feature"], d["reason"], d.get("kept"), d.get("value")) for d in pruned.decisions]
    rows += [("*", "before_count", None, float(before)), ("*", "after_count", None, float(len(pruned.kept))),
             ("*", "dropped_total", None, float(before - len(pruned.kept)))]
    return df.sparkSession.createDataFrame(rows, "feature string, reason string, kept_instead string, value double")


def protected_columns(columns: Sequence[str], force_keep: Sequence[str]) -> set[str]:
    return {c for c in columns if c in set(force_keep) or c.endswith(("_missing_cnt", "_missing_cnt_total"))}


def column_fingerprints(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(feature, fingerprint): an order-free sum of row hashes of (key, value); equal columns agree."""
    aggregates = []
    for c in columns:
        value = F.col(c).cast("double") + F.lit(0.0)
        aggregates.append(F.sum(F.xxhash64(F.col(key), value.isNull(), F.coalesce(value, F.lit(0.0))).cast("decimal(38,0)")).alias(f"fingerprint__{c}"))
    return wide_to_long(df.agg(*aggregates), columns, ["fingerprint"])


def duplicate_columns(df: DataFrame, columns: Sequence[str], key: str, protected: Sequence[str] = ()) -> list[dict]:
    """Columns equal to another one; the protected or alphabetically first of a group stays.

    Fingerprints only propose: a column goes if no row differs from the one that stays.
    """
    groups: dict[object, list[str]] = {}
    for r in column_fingerprints(df, columns, key).collect():
        groups.setdefault(r["fingerprint"], []).append(r["feature"])
    out = []
    for group in groups.values():
        keeper, *rest = sorted(group, key=lambda c: (c not in protected, c))
        out += [{"feature": c, "kept": keeper, "reason": "exact_duplicate"} for c in rest if c not in protected]
    if not out:
        return []
    number = lambda c: F.col(c).cast("double") + F.lit(0.0)
    differ = df.agg(*[F.count_if(~number(d["feature"]).eqNullSafe(number(d["kept"]))) for d in out]).first()
    return sorted((d for d, n in zip(out, differ) if n == 0), key=lambda d: d["feature"])


def correlation_matrix(df: DataFrame, columns: Sequence[str]):
    """Pearson matrix (nulls as 0) from one pass that sums the outer products per partition."""
    filled = df.select(*[F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(filled).select("v")
    return Correlation.corr(vectors, "v").first()[0].toArray()


def correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.995, protected: Sequence[str] = ()) -> list[dict]:
    """Columns that some later column repeats, in the order protected first, then by name.

    The later column of a pair stays, unless the earlier one is protected.
    """
    ordered = sorted(columns, key=lambda c: (c not in protected, c))
    if len(ordered) < 2 or not 0.0 < threshold < 1.0:
        return []
    matrix = abs(correlation_matrix(df, ordered))
    out = []
    for i, column in enumerate(ordered):
        later = [j for j in range(i + 1, len(ordered)) if matrix[i, j] > threshold]
        if later and column not in protected:
            out.append({"feature": column, "kept": ordered[later[0]], "reason": f"corr>{threshold}", "value": float(matrix[i, later[0]])})
    return out


def filter_interactions(df: DataFrame, interactions: Sequence[str], base: Sequence[str], max_features: int = 12,
                        corr: float = 0.995, psi: float = 0.6, split: DataFrame | None = None, bins: int = 10) -> list[dict]:
    """Decision per interaction: too close to a base feature, drifting, beyond the best ``max_features``, or retained.

    One correlation matrix and one PSI run serve all of them.
    """
    interactions = [c for c in interactions if c in df.columns]
    if not interactions:
        return []
    clean = lambda c: F.coalesce(finite(F.col(c)), F.lit(0.0))
    columns, own = [*interactions, *base], df.withColumn("_target", claim_label() if CLAIM in df.columns else F.lit(0.0))
    matrix = np.nan_to_num(abs(correlation_matrix(own, [*columns, "_target"])))
    closest: dict[str, tuple[float, str | None]] = {}
    for i, name in enumerate(interactions):
        value, other = max(((matrix[i, len(interactions) + j], b) for j, b in enumerate(base)), default=(0.0, None), key=lambda x: x[0])
        closest[name] = (float(value), other)
    target = {name: float(matrix[i, -1]) for i, name in enumerate(interactions)}
    drift: dict[str, float | None] = {}
    if split is not None:
        filled = split.select("window", *[clean(i).alias(i) for i in interactions])
        drift = {r["feature"]: r["psi"] for r in D.psi(filled, interactions, bins).collect()}
    out, ranked = [], []
    for i in interactions:
        if closest[i][0] >= corr:
            out.append({"feature": i, "kept": closest[i][1], "reason": "interaction_corr", "value": closest[i][0]})
        elif drift.get(i) is not None and drift[i] > psi:
            out.append({"feature": i, "reason": "interaction_psi", "value": drift[i]})
        else:
            ranked.append((drift[i] if drift.get(i) is not None else float("inf"), -target[i], i))
    for place, (value_, _, i) in enumerate(sorted(ranked)):
        reason = "interaction_retained" if place < max_features else "interaction_rank"
        out.append({"feature": i, "reason": reason, "value": value_ if value_ != float("inf") else None})
    return out


def prune_features(df: DataFrame, features: Sequence[str], interactions: Sequence[str] = (), limits: Mapping | None = None,
                   statistics: Mapping | None = None, drift: Mapping | None = None, force_keep: Sequence[str] = (),
                   date: str | None = None, key: str = "contract_number") -> Pruned:
    """Interaction filter, duplicates, manual drop, correlation and drift, in that order.

    ``statistics``: drop_exact_duplicates, drop_missing_share, corr_threshold;
    ``drift``: share, threshold, bins, min_rows, exclude, exclude_patterns.
    """
    kept, decisions = [c for c in features if c in df.columns], []
    numeric = set(numeric_columns(df))
    protected = protected_columns(kept, force_keep)
    limits, options = dict(limits or {}), dict(drift or {})
    split = None
    if date and (interactions or drift is not None):
        split = D.time_split(df, date, key, options.get("share", 0.7), options.get("min_rows", 500))

    if interactions:
        base = [c for c in kept if c in numeric and c not in set(interactions)]
        n, least = split.count() if split is not None else 0, 2 * max(options.get("min_rows", 500), 20)
        enough = split is not None and n >= least
        own = filter_interactions(df, interactions, base, limits.get("max_features", 12), limits.get("corr", 0.995),
                                  limits.get("psi", 0.6), split if enough else None)
        if split is not None and not enough:
            own = [{**d, "note": f"too few rows for PSI: {n}, minimum {least}"} for d in own]
        decisions += own
        gone = {d["feature"] for d in own if d["reason"] != "interaction_retained"}
        kept = [c for c in kept if c not in gone]
    if statistics is not None:
        if statistics.get("drop_exact_duplicates", True):
            found = duplicate_columns(df, [c for c in kept if c in numeric], key, protected)
            decisions += found
            kept = [c for c in kept if c not in {d["feature"] for d in found}]
        if statistics.get("drop_missing_share", True) and "score_missing_share" in kept:
            decisions.append({"feature": "score_missing_share", "reason": "manual"})
            kept.remove("score_missing_share")
        found = correlated_columns(df, [c for c in kept if c in numeric], statistics.get("corr_threshold", 0.995), protected)
        decisions += found
        kept = [c for c in kept if c not in {d["feature"] for d in found}]
    if drift is not None and split is not None:
        candidates = [c for c in kept if c in numeric and c not in protected]
        report = D.drift_report(split, candidates, options.get("threshold", 0.25), options.get("bins", 10), (),
                                options.get("exclude", ()), options.get("exclude_patterns", ()))
        dropped = [{"feature": r["feature"], "reason": "drift_psi", "value": r["psi"]}
                   for r in report.where("decision = 'drop'").orderBy("feature").collect()]
        decisions += dropped
        kept = [c for c in kept if c not in {d["feature"] for d in dropped}]
    return Pruned(kept, decisions)
