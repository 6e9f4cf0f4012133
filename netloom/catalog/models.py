"""Trained models and leakage attacks. Results depend on optimizers, so rows and invariants are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.base import query, stage
from netloom.catalog.evaluate import scored, show
from netloom.catalog.sql import with_
from netloom.functions.scalars import r6
from netloom.operators import models as mo
from netloom.operators import scoring as sc
from netloom.operators.privacy import REPRESENTATIONS, VIEW_COLUMNS, privacy_views
from netloom.operators.sequences import class_holdout
from netloom.operators.windows import BACKEND_FEATURES, backend_features

FEATURES = ["flow_count", "byte_rate", "novelty_score", "burstiness", "outbound_ratio", "destination_diversity", "ack_rate_total", "payload_mean"]
SMALL_TREES = {"rounds": 5, "depth": 3}


def halves(spark, sf):
    s = scored(spark, sf).drop("score")
    return s.filter("window_bucket % 4 <> 0"), s.filter("window_bucket % 4 = 0")


def quality(test, doc, name):
    return show(mo.evaluate_document(test, doc), ["tp", "fp", "fn", "tn"], ["f1", "roc_auc", "pr_auc"]).withColumn("model", F.lit(name))


@query("k01_linear")
def k01(spark, sf):
    train, test = halves(spark, sf)
    return quality(test, mo.train_linear(train, FEATURES), "linear")


@query("k02_forest")
def k02(spark, sf):
    train, test = halves(spark, sf)
    return quality(test, mo.train_forest(train, FEATURES, trees=10, depth=5), "forest")


@query("k03_boosted")
def k03(spark, sf):
    train, test = halves(spark, sf)
    return quality(test, mo.train_boosted(train, FEATURES, **SMALL_TREES), "boosted")


@query("k04_mahalanobis")
def k04(spark, sf):
    train, test = halves(spark, sf)
    b_train, b_test = backend_features(train), backend_features(test)
    return quality(b_test, mo.train_mahalanobis(b_train, BACKEND_FEATURES), "mahalanobis")


@query("k05_stacked")
def k05(spark, sf):
    train, test = halves(spark, sf)
    return quality(test, mo.train_stacked(train, FEATURES, 2, SMALL_TREES), "stacked")


@query("k06_fusion")
def k06(spark, sf):
    s = scored(spark, sf)
    doc, ranked = mo.train_fusion(s.withColumnRenamed("score", "score_a"), ["score_a", "score_b", "rule"])
    out = sc.score_linear(ranked, doc, "fused", detail=False)
    return out.agg(F.count("fused").alias("rows"), r6(F.avg("rank_mean")).alias("rank_mean"), r6(F.avg("fused")).alias("fused"))


@query("k07_specialists")
def k07(spark, sf):
    train, test = halves(spark, sf)
    docs = mo.train_specialists(train, FEATURES, ["service", "system", "malware"], 50, trees=5, depth=4)
    base = {**mo.train_linear(train, FEATURES), "specialists": {"app_family": docs}}
    out = sc.score_model(test, base, "score")
    return out.groupBy("app_family").agg(F.count("score").alias("rows"), r6(F.avg("score")).alias("mean_score"))


@query("k07_profile_thresholds", with_("fsweep", select="SELECT count(DISTINCT app_family) AS families, (SELECT count(*) FROM (SELECT app_id FROM scored GROUP BY 1 HAVING count(*) >= 50)) AS apps FROM fsweep"))
def k07_profiles(spark, sf):
    out = mo.profile_thresholds(scored(spark, sf))
    return out.agg(F.count_if(F.col("dimension") == "app_family").alias("families"), F.count_if(F.col("dimension") == "app_id").alias("apps"))


@query("k08_families")
def k08(spark, sf):
    train, test = halves(spark, sf)
    out = mo.compare_families(train, test, FEATURES, {"forest": {"trees": 5, "depth": 4}, "boosted": SMALL_TREES})
    return show(out, ["family", "tp", "fp", "fn", "tn"], ["f1", "roc_auc"])


@query("k08_protocol")
def k08_protocol(spark, sf):
    out = mo.protocol_report(scored(spark, sf).drop("score"), FEATURES, ["source_env_session", "family_time"], [42])
    return show(out, ["strategy", "runs"], ["f1", "f1_std", "roc_auc"])


@query("k09_cluster_thresholds")
def k09(spark, sf):
    return show(mo.cluster_thresholds(scored(spark, sf), FEATURES, 3), ["cluster", "rows"], ["p99", "p999"])


@query("k10_privacy_ablation")
def k10(spark, sf):
    mean, drops = mo.privacy_ablation(scored(spark, sf).drop("score"), [42], max_iter=10)
    return show(drops, ["view", "runs"], ["f1", "f1_delta", "pr_auc_relative_drop"])


@query("f36_utility_under_views")
def f36(spark, sf):
    from netloom.catalog.scoring import BOOSTED, LINEAR

    out = mo.utility_under_views(scored(spark, sf).drop("score"), {"linear": LINEAR, "boosted": BOOSTED})
    return show(out, ["view", "model", "features", "present", "tp", "fp"], ["f1"])


def attack_rows(spark, sf, view="medium"):
    frame = privacy_views(scored(spark, sf))[view].withColumn("id", F.concat_ws(":", "app_id", "window_bucket"))
    split = stage(spark, f"attack-{view}", sf, lambda: class_holdout(frame, "app_family", ["session_id"]))
    return split.filter("split = 'train'"), split.filter("split = 'test'"), VIEW_COLUMNS[view]


@query("i08_leakage_attack")
def i08(spark, sf):
    train, test, features = attack_rows(spark, sf)
    out = mo.leakage_attack(train, test, features, "app_family")
    return show(out, ["model", "rows", "strongest"], ["accuracy", "macro_f1", "top_5_accuracy", "normalized_leakage"])


@query("i09_leakage_by_group")
def i09(spark, sf):
    train, test, _ = attack_rows(spark, sf)
    out = mo.leakage_by_group(train, test, "app_family")
    return show(out, ["feature_group", "model", "rows"], ["accuracy", "normalized_leakage"])


@query("i10_open_world")
def i10(spark, sf):
    s = scored(spark, sf)
    out = mo.open_world(s, FEATURES, "app_id", ["session_id"])
    return show(out, [], ["unknown_precision", "unknown_recall", "unknown_f1", "known_accuracy", "unknown_auroc", "cut"])


@query("i11_leakage_suite")
def i11(spark, sf):
    out = mo.leakage_suite(scored(spark, sf), ["medium"], ["app_family", "dataset_source"])
    return show(out, ["view", "task", "model", "rows"], ["accuracy", "normalized_leakage"])


@query("i12_representation_leakage")
def i12(spark, sf):
    train, test = halves(spark, sf)
    out = None
    for name in REPRESENTATIONS:
        line = mo.representation_leakage(train, test, "app_family", name, FEATURES, 10)
        line = show(line, ["representation", "rows"], ["accuracy", "macro_f1"])
        out = line if out is None else out.unionByName(line)
    return out
