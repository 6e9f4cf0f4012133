"""End-to-end plans composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import scoring as sc

# Scorer names and the older names they replace.
SCORER_ALIASES = {"linear_local": "local", "tree_local": "local", "statistics": "statistical",
                  "covariance": "multivariate", "markov": "sequence", "ensemble": "ensemble_fusion"}


def score(windows: DataFrame, mode: str | dict, name: str = "score", **models: dict) -> DataFrame:
    """One interface over every scorer: a mode name or a model document."""
    if isinstance(mode, dict):
        return sc.score_model(windows, mode, name)
    mode = SCORER_ALIASES.get(mode, mode)
    if mode == "rule":
        return sc.rule_score(windows, name)
    if mode in ("local", "remote", "quiet", "sensitive", "privacy"):
        return sc.score_model(windows, models[mode], name)
    if mode == "balanced":
        both = score(score(windows, "sensitive", "_a", **models), "quiet", "_b", **models)
        return sc.blend_scores(both, "_a", "_b", name).drop("_a", "_b")
    if mode in ("statistical", "multivariate", "sequence"):
        from netloom.operators import stateful

        detector = {"statistical": stateful.statistical_score, "multivariate": stateful.multivariate_score,
                    "sequence": stateful.sequence_score}[mode]
        return detector(windows).withColumnRenamed(f"{mode}_score", name)
    if mode == "ensemble_fusion":
        out, weights = windows, {}
        for part in ("statistical", "multivariate", "sequence"):
            out = score(out, part, part)
            weights[part] = sc.FUSION_WEIGHTS[part]
        for part in ("local", "remote"):
            if part in models:
                out = score(out, part, part, **models)
                weights[part] = sc.FUSION_WEIGHTS[part]
        return sc.fuse_scores(out, weights, name=name)
    raise ValueError(f"unknown scoring mode {mode!r}")


def shadow_score(windows: DataFrame, active: str | dict, shadow: str | dict, **models: dict) -> DataFrame:
    """Two scores side by side from one scan."""
    return score(score(windows, active, "active", **models), shadow, "shadow", **models)
