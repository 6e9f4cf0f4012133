"""Window scores: rules, model documents, blends, fusion, contributions, quality, severity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import constants as K
from netloom.functions.scalars import C, clip, clip01, col, flag, sigmoid
from netloom.operators.flows import app_family
from netloom.plans.ordered import with_group

# Rule score weights.
RULE_WEIGHTS = {"novelty": 0.32, "burst": 0.22, "exfil": 0.20, "outbound": 0.14, "frequency": 0.12}


#: Window column behind each part of the rule score.
RULE_FEATURES = {"novelty": "novelty_score", "burst": "burstiness", "exfil": "total_bytes_out", "outbound": "outbound_ratio",
                 "frequency": "connection_frequency_delta"}


def _rule_parts() -> dict[str, Column]:
    exfil = (F.col("total_bytes_out") / (F.col("total_bytes_in") + 1.0) - 2.0) / 6.0
    return {
        "novelty": clip01("novelty_score"),
        "burst": clip01(F.col("burstiness") / 500.0),
        "exfil": clip01(exfil),
        "outbound": clip01((F.col("outbound_ratio") - 0.7) / 0.3),
        "frequency": clip01(F.col("connection_frequency_delta") / 20.0),
    }


def rule_score_column() -> Column:
    total = F.lit(0.0)
    for name, part in _rule_parts().items():
        total = total + part * RULE_WEIGHTS[name]
    return clip01(total)


def rule_contributions() -> Column:
    """Feature and share of each part of the rule score."""
    return F.array(*[F.struct(F.lit(RULE_FEATURES[n]).alias("feature"), (p * RULE_WEIGHTS[n]).alias("value"))
                     for n, p in _rule_parts().items()])


def rule_score(windows: DataFrame, name: str = "score") -> DataFrame:
    return windows.withColumn(name, rule_score_column())


def minmax(df: DataFrame, column: str, name: str = "normalized") -> DataFrame:
    """Scale to [0, 1] over the table; a constant column becomes 0."""
    out = with_group(df, [], _lo=F.min(column), _hi=F.max(column))
    width = F.col("_hi") - F.col("_lo")
    return out.withColumn(name, F.when(width > 0, (F.col(column) - F.col("_lo")) / width).otherwise(0.0)).drop(
        "_lo", "_hi")


def value_of(df: DataFrame, feature: str) -> Column:
    return F.coalesce(F.col(feature).cast("double"), F.lit(0.0)) if feature in df.columns else F.lit(0.0)


def _linear_terms(df: DataFrame, model: dict) -> dict[str, Column]:
    terms = {}
    for i, f in enumerate(model["feature_order"]):
        scale = float(model["scales"][i]) or 1.0
        terms[f] = (value_of(df, f) - float(model["means"][i])) / scale * float(model["weights"][i])
    return terms


def distance_confidence(score: C, threshold: float) -> Column:
    """Confidence grows with the distance to the threshold, within [0.35, 0.98]."""
    return clip(0.45 + F.least(F.lit(1.0), F.abs(col(score) - threshold)) * 0.55, 0.35, 0.98)


def top_features(contributions: Column, n: int) -> Column:
    """Names of the n largest positive contributions of array<struct<feature, value>>."""
    positive = F.filter(contributions, lambda x: x["value"] > 0)
    ordered = F.array_sort(F.transform(positive, lambda x: F.struct((-x["value"]).alias("k"), x["feature"].alias("f"))))
    return F.transform(F.slice(ordered, 1, n), lambda x: x["f"])


def score_linear(df: DataFrame, model: dict, name: str = "score", detail: bool = True) -> DataFrame:
    """Standardize, weigh, add, squash: one Column expression, no Python in the executors."""
    terms = _linear_terms(df, model)
    total = F.lit(float(model.get("bias", 0.0)))
    for t in terms.values():
        total = total + t
    out = df.withColumn(name, sigmoid(total))
    if detail:
        cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(t).alias("value")) for f, t in terms.items()])
        out = out.withColumns({
            "contributions": cells,
            "top_features": top_features(cells, 4),
            "confidence": distance_confidence(name, float(model.get("recommended_threshold", 0.5))),
        })
    return out


def _matrix_udf(fn, returns: str):
    """Vectorized function over a dense feature matrix (one Arrow batch at a time)."""
    @F.pandas_udf(returns)
    def run(features: pd.Series) -> pd.Series:
        return fn(np.vstack(features.to_numpy())) if len(features) else pd.Series([], dtype="float64")

    return run


def _features(df: DataFrame, order: list[str]) -> Column:
    return F.array(*[value_of(df, f) for f in order])


def walk_trees(values, trees: list[dict]):
    """Leaf value of every row in every tree: rows advance one level per step, all at once."""
    out = np.zeros((len(trees), values.shape[0]))
    rows = np.arange(values.shape[0])
    for i, t in enumerate(trees):
        feature = np.asarray(t["feature"], dtype=int)
        cut, leaf = np.asarray(t["threshold"], dtype=float), np.asarray(t["value"], dtype=float)
        left, right = np.asarray(t["left"], dtype=int), np.asarray(t["right"], dtype=int)
        inner = (feature >= 0) & (left >= 0) & (right >= 0)
        at = np.zeros(values.shape[0], dtype=int)
        for _ in range(len(feature)):  # a path without a cycle is no longer
            open_ = inner[at]
            if not open_.any():
                break
            r, n = rows[open_], at[open_]
            at[open_] = np.where(values[r, feature[n]] <= cut[n], left[n], right[n])
        if inner[at].any():
            raise ValueError(f"tree {i} has a cycle")
        out[i] = leaf[at]
    return out


def score_trees(df: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """Forest (mean of leaves) or boosted trees (calibrated logit of the weighted sum)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(values):
        m = shared.value
        leaves = walk_trees(values, m["trees"])
        if m["model_type"] == "random_forest_classifier":
            return pd.Series(leaves.sum(axis=0) / max(1, len(m["trees"])))
        raw = float(m.get("initial_score", 0.0)) + float(m.get("learning_rate", 1.0)) * leaves.sum(axis=0)
        logit = float(m.get("calibration_slope", 1.0)) * raw + float(m.get("calibration_bias", 0.0))
        return pd.Series(1.0 / (1.0 + np.exp(-logit)))

    out = df.withColumn(name, _matrix_udf(score, "double")(_features(df, model["feature_order"])))
    scale = float(model.get("score_scale", 1.0))
    return out if scale == 1.0 else out.withColumn(name, clip01(F.col(name) * scale))


def score_mahalanobis(df: DataFrame, model: dict, name: str = "score", detail: bool = True) -> DataFrame:
    """1 - exp(-distance / scale) against the benign mean and inverse covariance."""
    order = list(model["feature_order"])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def distance(values):
        m = shared.value
        centred = values - np.asarray(m["mean"])
        return pd.Series(np.einsum("ij,jk,ik->i", centred, np.asarray(m["precision_matrix"]), centred))

    scale = max(float(model["threshold_distance"]), float(len(order)), 1.0)
    out = df.withColumn("distance", _matrix_udf(distance, "double")(_features(df, order)))
    out = out.withColumn(name, clip01(1.0 - F.exp(-F.col("distance") / scale)))
    if detail:
        root = [max(float(model["precision_matrix"][i][i]), 1e-9) ** 0.5 for i in range(len(order))]
        cells = F.array(*[F.struct(
            F.lit(f).alias("feature"),
            (F.abs(value_of(df, f) - float(model["mean"][i])) * root[i]).alias("value"))
            for i, f in enumerate(order)])
        out = out.withColumns({
            "contributions": cells, "top_features": top_features(cells, 4),
            "confidence": distance_confidence(name, float(model.get("recommended_threshold", 0.62)))})
    return out


def stack_scores(df: DataFrame, model: dict, anomaly: str = "anomaly_score", context: str = "context_score",
                 tree: str = "tree_score", risk: str = "risk_flag_sum", name: str = "score") -> DataFrame:
    """Meta score over three channels, their spread and the risk flags."""
    three = [F.col(anomaly), F.col(context), F.col(tree)]
    meta = {
        "anomaly_score": three[0], "context_score": three[1], "tree_score": three[2],
        "score_gap": F.greatest(*three) - F.least(*three),
        "risk_flag_sum": F.col(risk) if risk in df.columns else F.lit(0.0),
    }
    total = F.lit(float(model.get("meta_bias", -1.0)))
    for f, w in zip(model["meta_feature_order"], model["meta_weights"]):
        total = total + meta[f] * float(w)
    return df.withColumn(name, sigmoid(total))


# Channel weights when contributions and confidences of a stack are merged.
STACK_WEIGHTS = [0.34, 0.33, 0.33]


def score_stacked(df: DataFrame, model: dict, name: str = "score") -> DataFrame:
    out = score_mahalanobis(df, model["anomaly_model"], "anomaly_score", detail=False)
    out = score_linear(out, model["context_model"], "context_score", detail=False)
    out = score_trees(out, model["tree_model"], "tree_score")
    return stack_scores(out, model, name=name)


def score_document(df: DataFrame, doc: dict, name: str) -> DataFrame:
    from netloom.operators.privacy import reduce_features

    view = {"medium_reduced": "medium", "medium_plus_reduced": "medium_plus"}.get(doc.get("input_transform", ""))
    features = reduce_features(df, view) if view else df
    kind = doc["model_type"]
    if kind == "logistic_regression":
        out = score_linear(features, doc, name, detail=False)
    elif kind in ("random_forest_classifier", "boosted_tree_classifier"):
        out = score_trees(features, doc, name)
    elif "mahalanobis" in kind:
        out = score_mahalanobis(features, doc, name, detail=False).drop("distance")
    elif "hybrid_dual_channel" in kind:
        out = score_stacked(features, doc, name)
    else:
        raise ValueError(f"unsupported model_type: {kind}")
    return out


def calibrate_scores(df: DataFrame, default: float, families: dict[str, float] | None = None,
                     apps: dict[str, float] | None = None, name: str = "score") -> DataFrame:
    """Rescale by default / effective threshold; an app threshold beats a family threshold."""
    effective = F.lit(float(default))
    for keys, key in ((families, app_family("app_id")), (apps, F.col("app_id"))):
        if keys:
            table = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.lit(max(0.05, float(v))))])
            effective = F.coalesce(F.try_element_at(table, key), effective)
    return df.withColumn(name, clip01(F.col(name) * (F.lit(float(default)) / clip(effective, 0.05, 1.0))))


def score_model(df: DataFrame, doc: dict, name: str = "score") -> DataFrame:
    """A model document with family specialists and threshold calibration."""
    out = score_document(df, doc, name)
    for family, specialist in (doc.get("specialists", {}).get("app_family") or {}).items():
        out = score_document(out, specialist, "_special")
        out = out.withColumn(name, F.when(app_family("app_id") == family, F.col("_special")).otherwise(
            F.col(name))).drop("_special")
    overrides = doc.get("threshold_overrides") or {}
    if overrides:
        out = calibrate_scores(out, float(doc.get("recommended_threshold", 0.5)),
                               overrides.get("app_family"), overrides.get("app_id"), name)
    return out


# Families that take the maximum, and families capped near the quiet model.
MAX_FAMILIES = ["malware", "remote_access"]
CAPPED_FAMILIES = ["service", "system", "other_app"]


def blend_scores(df: DataFrame, a: str, b: str, name: str = "score", service_weight: C | float = 0.25,
                 service_cap: C | float = 0.12, other_weight: C | float = 0.45, malware_mode: C = "max") -> DataFrame:
    """Blend by family. The parameters may be columns, so a grid can be scored in one pass."""
    def as_col(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    x, y = F.col(a), F.col(b)
    sw, cap, ow, mode = (as_col(v) for v in (service_weight, service_cap, other_weight, malware_mode))
    family = F.col("app_family") if "app_family" in df.columns else app_family("app_id")
    capped = F.least(sw * x + (1.0 - sw) * y, y + cap)
    strong = F.when(mode == "max", F.greatest(x, y)).when(mode == "quiet", y).otherwise(0.35 * x + 0.65 * y)
    blended = F.when(family.isin(MAX_FAMILIES), strong).when(family.isin(CAPPED_FAMILIES), capped).otherwise(
        ow * x + (1.0 - ow) * y)
    return df.withColumn(name, clip01(blended))


# Default fusion weights.
FUSION_WEIGHTS = {"statistical": 0.28, "multivariate": 0.20, "sequence": 0.12, "local": 0.16,
                  "tflite": 0.12, "remote": 0.12}
RESPONSE_WEIGHTS = {"beacon": 0.15, "drift": 0.10, "reputation": 0.18, "data_quality_penalty": 0.10,
                    "anomaly_blend": 0.82, "context_blend": 0.18}


def fuse_scores(df: DataFrame, weights: dict[str, float], confidences: dict[str, str] | None = None,
                name: str = "score") -> DataFrame:
    """Weighted mean, median and spread of detector scores (columns named by the weights' keys)."""
    names = list(weights)
    total = max(sum(weights.values()), 1e-9)
    mean = sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0)) / total
    ordered = F.array_sort(F.array(*[F.col(n) for n in names]))
    half = len(names) // 2
    median = ordered[half] if len(names) % 2 else (ordered[half - 1] + ordered[half]) / 2.0
    spread = ordered[len(names) - 1] - ordered[0]
    out = df.withColumns({
        name: clip01(0.70 * mean + 0.30 * median - 0.20 * clip01(spread)), "score_spread": spread})
    if confidences:
        sure = sum((F.col(c) * weights[n] for n, c in confidences.items()), F.lit(0.0)) / total
        out = out.withColumn("uncertainty", clip01((1.0 - sure) * 0.7 + spread * 0.3))
        out = out.withColumn("confidence", clip01(1.0 - F.col("uncertainty")))
    return out


def merge_contributions(df: DataFrame, sources: dict[str, float], name: str = "merged", n: int = 3) -> DataFrame:
    """Weighted sum of array<struct<feature, value>> columns by feature, largest first."""
    total = max(sum(sources.values()), 1e-9)

    def scaled(c: str, share: float) -> Column:
        return F.transform(F.col(c), lambda x: F.struct(
            x["feature"].alias("feature"), (F.abs(x["value"]) * share).alias("value")))

    weighted = F.concat(*[scaled(c, w / total) for c, w in sources.items()])
    names = F.array_distinct(F.transform(weighted, lambda x: x["feature"]))
    merged = F.transform(names, lambda f: F.struct(
        f.alias("feature"),
        F.aggregate(F.filter(weighted, lambda x: x["feature"] == f), F.lit(0.0),
                    lambda acc, x: acc + x["value"]).alias("value")))
    out = df.withColumn(name, merged)
    return out.withColumn("top_features", top_features(F.col(name), n))


def explain(windows: DataFrame, columns: list[str] | None = None, n: int = 3) -> DataFrame:
    """The n features furthest from the table mean in sample deviations."""
    columns = columns or [c for c in K.FEATURES if c in windows.columns]
    aggs = {}
    for c in columns:
        aggs[f"_m_{c}"] = F.avg(F.col(c).cast("double"))
        aggs[f"_d_{c}"] = F.stddev_samp(F.col(c).cast("double"))
    out = with_group(windows, [], **aggs)
    cells = F.array(*[F.struct(
        (-F.abs((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") > 0, F.col(f"_d_{c}")).otherwise(1.0))).alias("z"),
        F.lit(i).alias("i"), F.lit(c).alias("feature")) for i, c in enumerate(columns)])
    names = F.transform(F.slice(F.array_sort(cells), 1, n), lambda x: x["feature"])
    out = out.withColumn("top_features", names).drop(*aggs)
    return out.withColumn("explanation", F.concat(F.lit("Top contributors: "), F.concat_ws(", ", "top_features")))


def when_list(tests: list[tuple[Column, str | Column]]) -> Column:
    """Names whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(t, n if isinstance(n, Column) else F.lit(n)) for t, n in tests]))


def quality_columns(df: DataFrame) -> dict[str, Column]:
    def get(name: str, default) -> Column:
        return F.col(name) if name in df.columns else F.lit(default)

    def bad_port(c: Column) -> Column:
        return ~c.between(0, 65535)

    warnings = when_list([
        (F.col("duration_ms") <= 0, "duration_non_positive"),
        ((F.col("bytes_out") == 0) & (F.col("bytes_in") == 0), "zero_bytes_flow"),
        (bad_port(get("src_port", 0)) | bad_port(F.col("dst_port")), "invalid_port"),
        (F.col("timestamp_end") < get("timestamp_start", 0), "inverted_timestamps"),
        (F.length(F.trim(F.coalesce(get("destination_hash", "x"), F.lit("")))) == 0, "missing_destination_hash"),
        (~F.col("dst_novelty").between(0.0, 1.0), "novelty_out_of_range"),
    ])
    return {"warnings": warnings, "quality_score": clip01(1.0 - F.size(warnings) * 0.15)}


def quality(flows: DataFrame) -> DataFrame:
    return flows.withColumns(quality_columns(flows))


def warning_counts(flows: DataFrame) -> DataFrame:
    """Occurrences of each warning; works on a stream in update mode as well."""
    return quality(flows).select(F.explode("warnings").alias("warning")).groupBy("warning").count()


def response_score(df: DataFrame, weights: dict[str, float] | None = None, drift_high: float = 0.65) -> DataFrame:
    """Anomaly channel (with beacon, drift and quality) blended with the reputation channel."""
    w = {**RESPONSE_WEIGHTS, **(weights or {})}
    drift = F.when(F.col("drift_score") >= drift_high, F.col("drift_score")).otherwise(
        clip01(F.col("drift_score") * 0.35))
    anomaly = clip01(F.col("anomaly_score") + w["beacon"] * F.col("beacon_score") + w["drift"] * drift
                     - w["data_quality_penalty"] * (1.0 - F.col("quality_score")))
    context = clip01(w["reputation"] * F.col("reputation_score"))
    return df.withColumns({
        "drift_post_score": drift, "anomaly_channel": anomaly, "context_channel": context,
        "response_score": clip01(w["anomaly_blend"] * anomaly + w["context_blend"] * context)})


# Threshold offsets (low, medium, high) of each app profile.
PROFILE_OFFSETS = {
    "TRUSTED": (0.08, 0.10, 0.12), "HIGH_CHURN": (0.05, 0.07, 0.08),
    "BROWSER": (0.05, 0.06, 0.08), "SYSTEM": (0.10, 0.12, 0.15),
}
DEFAULT_THRESHOLDS = {"low": 0.35, "medium": 0.6, "high": 0.85}
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


def normalize_thresholds(low: Column, medium: Column, high: Column) -> tuple[Column, Column, Column]:
    lo = clip01(low)
    mid = F.least(F.lit(1.0), F.greatest(medium, lo))
    return lo, mid, F.least(F.lit(1.0), F.greatest(high, mid))


def with_thresholds(df: DataFrame, overrides: DataFrame | None = None, defaults: dict | None = None,
                    profile: str | None = None) -> DataFrame:
    """Attach low / medium / high: app override or default, moved by the app profile."""
    d = {**DEFAULT_THRESHOLDS, **(defaults or {})}
    out = df
    names = ["low", "medium", "high"]
    if overrides is not None:
        small = overrides.select(F.col("app_id").alias("_app"), *[F.col(n).alias(f"_o_{n}") for n in names])
        out = out.join(small, F.col("app_id") == F.col("_app"), "left").drop("_app")
        base = [F.coalesce(F.col(f"_o_{n}"), F.lit(float(d[n]))) for n in names]
    else:
        base = [F.lit(float(d[n])) for n in names]
    base = list(normalize_thresholds(*base))
    if profile:
        moved = []
        for i, b in enumerate(base):
            shift = F.when(F.lit(False), 0.0)
            for p, offsets in PROFILE_OFFSETS.items():
                shift = shift.when(F.col(profile) == p, offsets[i])
            moved.append(b + shift.otherwise(0.0))
        base = list(normalize_thresholds(*moved))
    out = out.withColumns({f"{n}_threshold": b for n, b in zip(names, base)})
    return out.drop(*[f"_o_{n}" for n in names])


def severity_of(score: C, medium: C = "medium_threshold", high: C = "high_threshold") -> Column:
    s = col(score)
    return F.when(s >= col(high), "HIGH").when(s >= col(medium), "MEDIUM").otherwise("LOW")


def severity(df: DataFrame, overrides: DataFrame | None = None, defaults: dict | None = None,
             score: str = "score", profile: str | None = None) -> DataFrame:
    return with_thresholds(df, overrides, defaults, profile).withColumn("severity", severity_of(score))


def severity_rank(c: C = "severity") -> Column:
    return F.when(col(c) == "HIGH", 3).when(col(c) == "MEDIUM", 2).otherwise(1)


def severity_name(rank: Column) -> Column:
    return F.when(rank >= 3, "HIGH").when(rank == 2, "MEDIUM").otherwise("LOW")


def lower_severity(c: C) -> Column:
    return F.when(col(c) == "HIGH", "MEDIUM").otherwise("LOW")
