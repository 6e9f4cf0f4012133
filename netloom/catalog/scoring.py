"""Window scores, model documents, blends and severity."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.base import query
from netloom.catalog.evaluate import scored, show
from netloom.catalog.sql import WINDOW_MS, cte, rounded, with_
from netloom.functions.scalars import r6
from netloom.operators import scoring as sc
from netloom.operators import windows as win
from netloom.sources.tables import flow_view

KEYS = ["app_id", "window_bucket"]


def overrides(spark, sf):
    """Threshold overrides of the apps that have more confirmed windows than one in ten."""
    s = scored(spark, sf).groupBy("app_id").agg(
        F.lit(0.3).alias("low"), r6(F.avg("score")).alias("medium"), r6(F.avg("score") + 0.2).alias("high"),
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("confirmed"))
    return s.filter("confirmed * 10 > n").drop("n", "confirmed")


cte("overrides", ["scored"], """
SELECT app_id, 0.3 AS low, round(avg(score), 6) AS medium, round(avg(score) + 0.2, 6) AS high
FROM scored GROUP BY app_id HAVING sum(label) * 10 > count(*)
""")

SEVERITY = """CASE WHEN {s} >= {h} THEN 'HIGH' WHEN {s} >= {m} THEN 'MEDIUM' ELSE 'LOW' END"""


@query("flagship_scored_windows", with_("overrides", select=f"""
SELECT app_id, window_bucket, flow_count, round(total_bytes_out, 6) AS total_bytes_out, round(burstiness, 6) AS burstiness, rule,
  {SEVERITY.format(s='rule', m='coalesce(o.medium, 0.6)', h='coalesce(o.high, 0.85)')} AS severity
FROM scored LEFT JOIN overrides o USING (app_id)"""))
def flagship(spark, sf):
    out = sc.severity(scored(spark, sf), overrides(spark, sf), {"low": 0.35}, "rule")
    return out.select(*KEYS, "flow_count", r6("total_bytes_out").alias("total_bytes_out"),
                      r6("burstiness").alias("burstiness"), "rule", "severity")


@query("e01_rule_score", with_("scored", select="SELECT app_id, window_bucket, rule FROM scored"))
def e01(spark, sf):
    return scored(spark, sf).select(*KEYS, "rule")


@query("e02_minmax", with_("scored", select="""
SELECT app_id, window_bucket, round((byte_rate - lo) / (hi - lo), 6) AS normalized, 0.0 AS constant
FROM (SELECT *, min(byte_rate) OVER () AS lo, max(byte_rate) OVER () AS hi FROM scored)"""))
def e02(spark, sf):
    out = sc.minmax(scored(spark, sf), "byte_rate")
    out = sc.minmax(out, "data_quality_score", "constant")
    return show(out, KEYS, ["normalized", "constant"])


LINEAR = {
    "model_type": "logistic_regression", "feature_order": ["novelty_score", "burstiness", "byte_rate", "outbound_ratio"],
    "means": [0.25, 0.3, 1.0, 0.5], "scales": [0.2, 0.25, 0.0, 0.5], "weights": [1.2, -0.7, 0.3, 0.9], "bias": -0.4,
    "recommended_threshold": 0.55,
}
LINEAR_Z = "-0.4 + (novelty_score - 0.25) / 0.2 * 1.2 + (burstiness - 0.3) / 0.25 * -0.7 + (byte_rate - 1.0) * 0.3 + (outbound_ratio - 0.5) / 0.5 * 0.9"
cte("linear", ["scored"], f"""
SELECT *, 1.0 / (1.0 + exp(-({LINEAR_Z}))) AS linear_score,
  [('novelty_score', abs((novelty_score - 0.25) / 0.2 * 1.2)), ('burstiness', abs((burstiness - 0.3) / 0.25 * 0.7)),
   ('byte_rate', abs((byte_rate - 1.0) * 0.3)), ('outbound_ratio', abs((outbound_ratio - 0.5) / 0.5 * 0.9))] AS parts FROM scored
""")


@query("e03_linear_model", with_("linear", select="""
SELECT app_id, window_bucket, round(linear_score, 6) AS linear_score,
  round(greatest(0.35, least(0.98, 0.45 + least(1.0, abs(linear_score - 0.55)) * 0.55)), 6) AS confidence,
  (SELECT string_agg(f, ',' ORDER BY v DESC, f) FROM (SELECT unnest(parts)[1] AS f, unnest(parts)[2] AS v) WHERE v > 0) AS top_features FROM linear"""
                                  .replace("unnest(parts)[1]", "struct_extract(unnest(parts), 1)").replace("unnest(parts)[2]", "struct_extract(unnest(parts), 2)")))
def e03(spark, sf):
    out = sc.score_linear(scored(spark, sf), LINEAR, "linear_score")
    return out.select(*KEYS, r6("linear_score").alias("linear_score"), r6("confidence").alias("confidence"),
                      F.concat_ws(",", "top_features").alias("top_features"))


TREE_A = {"feature": [0, 1, -1, -1, -1], "threshold": [0.25, 1.0, 0, 0, 0], "left": [1, 2, -1, -1, -1],
          "right": [4, 3, -1, -1, -1], "value": [0, 0, 0.1, 0.4, 0.9]}
TREE_B = {"feature": [2, -1, -1], "threshold": [0.5, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1],
          "value": [0, 0.3, 0.7]}
FOREST = {"model_type": "random_forest_classifier", "feature_order": ["novelty_score", "byte_rate", "outbound_ratio"],
          "trees": [TREE_A, TREE_B], "score_scale": 1.1}
BOOSTED = {**FOREST, "model_type": "boosted_tree_classifier", "initial_score": -0.5, "learning_rate": 0.8,
           "calibration_slope": 1.5, "calibration_bias": 0.1, "score_scale": 1.0}
LEAF_A = "(CASE WHEN novelty_score <= 0.25 THEN CASE WHEN byte_rate <= 1.0 THEN 0.1 ELSE 0.4 END ELSE 0.9 END)"
LEAF_B = "(CASE WHEN outbound_ratio <= 0.5 THEN 0.3 ELSE 0.7 END)"


@query("e04_tree_models", with_("scored", select=f"""
SELECT app_id, window_bucket, round(least(1.0, ({LEAF_A} + {LEAF_B}) / 2 * 1.1), 6) AS forest,
  round(1.0 / (1.0 + exp(-(1.5 * (-0.5 + 0.8 * ({LEAF_A} + {LEAF_B})) + 0.1))), 6) AS boosted FROM scored"""))
def e04(spark, sf):
    out = sc.score_trees(sc.score_trees(scored(spark, sf), FOREST, "forest"), BOOSTED, "boosted")
    return show(out, KEYS, ["forest", "boosted"])


MAHALANOBIS = {"model_type": "mahalanobis_covariance", "feature_order": ["novelty_score", "outbound_ratio"],
               "mean": [0.25, 0.5], "precision_matrix": [[4.0, 1.0], [1.0, 2.0]], "threshold_distance": 3.0}
DIST = "(4.0 * (novelty_score - 0.25) * (novelty_score - 0.25) + 2.0 * (novelty_score - 0.25) * (outbound_ratio - 0.5) + 2.0 * (outbound_ratio - 0.5) * (outbound_ratio - 0.5))"


@query("e05_mahalanobis", with_("scored", select=f"""
SELECT app_id, window_bucket, round({DIST}, 6) AS distance, round(1.0 - exp(-{DIST} / 3.0), 6) AS m_score FROM scored"""))
def e05(spark, sf):
    return show(sc.score_mahalanobis(scored(spark, sf), MAHALANOBIS, "m_score"), KEYS, ["distance", "m_score"])


STACK = {"model_type": "hybrid_dual_channel", "anomaly_model": MAHALANOBIS, "context_model": LINEAR, "tree_model": BOOSTED,
         "meta_bias": -1.0, "meta_feature_order": ["anomaly_score", "context_score", "tree_score", "score_gap"],
         "meta_weights": [0.9, 1.1, 0.7, -0.3]}


@query("e06_stacked", with_("linear", select=f"""
SELECT app_id, window_bucket, round(1.0 / (1.0 + exp(-(-1.0 + 0.9 * a + 1.1 * c + 0.7 * t - 0.3 * (greatest(a, c, t) - least(a, c, t))))), 6) AS stacked
FROM (SELECT app_id, window_bucket, 1.0 - exp(-{DIST} / 3.0) AS a, linear_score AS c,
  1.0 / (1.0 + exp(-(1.5 * (-0.5 + 0.8 * ({LEAF_A} + {LEAF_B})) + 0.1))) AS t FROM linear)"""))
def e06(spark, sf):
    return show(sc.score_stacked(scored(spark, sf), STACK, "stacked"), KEYS, ["stacked"])


DOC = {**LINEAR, "specialists": {"app_family": {"service": {**LINEAR, "bias": 0.6}}},
       "threshold_overrides": {"app_family": {"system": 0.7, "browser": 0.3}, "app_id": {"com.whatsapp": 0.8}}}


@query("e07_model_document", with_("linear", select=f"""
SELECT app_id, window_bucket, round(least(1.0, s * (0.55 / CASE WHEN app_id = 'com.whatsapp' THEN 0.8 WHEN app_family = 'system' THEN 0.7
  WHEN app_family = 'browser' THEN 0.3 ELSE 0.55 END)), 6) AS doc_score
FROM (SELECT *, CASE WHEN app_family = 'service' THEN 1.0 / (1.0 + exp(-({LINEAR_Z} + 1.0))) ELSE linear_score END AS s FROM linear)"""))
def e07(spark, sf):
    return show(sc.score_model(scored(spark, sf), DOC, "doc_score"), KEYS, ["doc_score"])


BLEND = """CASE WHEN app_family IN ('malware', 'remote_access') THEN greatest(score, score_b)
  WHEN app_family IN ('service', 'system', 'other_app') THEN least(0.25 * score + 0.75 * score_b, score_b + 0.12)
  ELSE 0.45 * score + 0.55 * score_b END"""


@query("e08_blend", with_("scored", select=f"SELECT app_id, window_bucket, round({BLEND}, 6) AS blended FROM scored"))
def e08(spark, sf):
    return show(sc.blend_scores(scored(spark, sf), "score", "score_b", "blended"), KEYS, ["blended"])


@query("e09_fusion", with_("scored", select="""
SELECT app_id, window_bucket, round(greatest(0, least(1, 0.7 * (0.28 * score + 0.2 * score_b + 0.12 * rule) / 0.6
    + 0.3 * list_sort([score, score_b, rule])[2] - 0.2 * (greatest(score, score_b, rule) - least(score, score_b, rule)))), 6) AS fused,
  round(greatest(score, score_b, rule) - least(score, score_b, rule), 6) AS score_spread,
  round(1 - (1 - 0.5) * 0.7 - (greatest(score, score_b, rule) - least(score, score_b, rule)) * 0.3, 6) AS confidence FROM scored"""))
def e09(spark, sf):
    s = scored(spark, sf).withColumn("half", F.lit(0.5))
    out = sc.fuse_scores(s, {"score": 0.28, "score_b": 0.2, "rule": 0.12},
                         {"score": "half", "score_b": "half", "rule": "half"}, "fused")
    return show(out, KEYS, ["fused", "score_spread", "confidence"])


@query("e10_merge_contributions", with_("scored", select="""
, parts AS (SELECT app_id, window_bucket, 'n' AS f, 0.75 * novelty_score AS v FROM scored
  UNION ALL SELECT app_id, window_bucket, 'o', 0.75 * outbound_ratio + 0.25 * outbound_ratio * outbound_ratio FROM scored
  UNION ALL SELECT app_id, window_bucket, 'd', 0.25 * destination_diversity FROM scored)
SELECT app_id, window_bucket, round(sum(v), 6) AS total, string_agg(f, ',' ORDER BY v DESC, f) FILTER (v > 0 AND rn <= 2) AS top_features
FROM (SELECT *, row_number() OVER (PARTITION BY app_id, window_bucket ORDER BY v DESC, f) AS rn FROM parts) GROUP BY app_id, window_bucket"""))
def e10(spark, sf):
    def cell(name, value):
        return F.struct(F.lit(name).alias("feature"), value.alias("value"))

    s = scored(spark, sf).withColumns({
        "c1": F.array(cell("n", F.col("novelty_score")), cell("o", F.col("outbound_ratio"))),
        "c2": F.array(cell("o", F.col("outbound_ratio") * F.col("outbound_ratio")), cell("d", -F.col("destination_diversity")))})
    out = sc.merge_contributions(s, {"c1": 3.0, "c2": 1.0}, n=2)
    total = F.aggregate("merged", F.lit(0.0), lambda acc, x: acc + x["value"])
    return out.select(*KEYS, r6(total).alias("total"), F.concat_ws(",", "top_features").alias("top_features"))


EXPLAINED = ["flow_count", "novelty_score", "burstiness", "outbound_ratio", "ttl_gap"]


@query("e11_explain", with_("scored", select=", z AS (" + " UNION ALL ".join(
    f"SELECT app_id, window_bucket, {i} AS i, '{c}' AS f, abs(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()) AS z FROM scored"
    for i, c in enumerate(EXPLAINED)) + """)
SELECT app_id, window_bucket, 'Top contributors: ' || string_agg(f, ', ' ORDER BY z DESC, i) FILTER (rn <= 3) AS explanation
FROM (SELECT *, row_number() OVER (PARTITION BY app_id, window_bucket ORDER BY z DESC, i) AS rn FROM z) GROUP BY app_id, window_bucket"""))
def e11(spark, sf):
    return sc.explain(scored(spark, sf), EXPLAINED).select(*KEYS, "explanation")


cte("quality", ["flows"], """
SELECT *, list_filter([CASE WHEN duration_ms <= 0 THEN 'duration_non_positive' END,
  CASE WHEN bytes_out = 0 AND bytes_in = 0 THEN 'zero_bytes_flow' END,
  CASE WHEN dst_port - 40000 > 65535 OR dst_port - 200 < 0 THEN 'invalid_port' END,
  CASE WHEN duration_ms > 4900 THEN 'inverted_timestamps' END,
  CASE WHEN k % 9 = 0 THEN 'missing_destination_hash' END,
  CASE WHEN dst_novelty + k / 100.0 > 1.5 THEN 'novelty_out_of_range' END], lambda x: x IS NOT NULL) AS warnings FROM flows
""")


def quality_flows(spark, sf):
    f = flow_view(spark, sf)
    return sc.quality(f.withColumns({
        "dst_port": F.col("dst_port") - 200, "src_port": F.lit(443),
        "timestamp_start": F.when(F.col("duration_ms") > 4900, F.col("timestamp_end") + 1).otherwise(F.col("timestamp_end")),
        "destination_hash": F.when(F.col("k") % 9 == 0, "").otherwise("h"),
        "dst_novelty": F.when(F.col("dst_novelty") + F.col("k") / 100.0 > 1.5, 1.5).otherwise(0.5)}))


@query("e12_quality", with_("quality", select="""
SELECT flow_id, array_to_string(warnings, ',') AS warnings, round(greatest(0, 1 - 0.15 * len(warnings)), 6) AS quality_score FROM quality"""))
def e12(spark, sf):
    return quality_flows(spark, sf).select("flow_id", F.concat_ws(",", "warnings").alias("warnings"),
                                           r6("quality_score").alias("quality_score"))


@query("g09_warning_counts", with_("quality", select="""
SELECT warning, count(*) AS count FROM (SELECT unnest(warnings) AS warning FROM quality) GROUP BY warning"""))
def g09(spark, sf):
    q = quality_flows(spark, sf)
    return q.select(F.explode("warnings").alias("warning")).groupBy("warning").count()


@query("e19_response_score", with_("scored", select="""
SELECT app_id, window_bucket, round(a, 6) AS anomaly_channel, round(c, 6) AS context_channel, round(0.82 * a + 0.18 * c, 6) AS response_score
FROM (SELECT app_id, window_bucket, greatest(0, least(1, score + 0.15 * periodic_beacon_score
    + 0.10 * CASE WHEN score_b >= 0.65 THEN score_b ELSE 0.35 * score_b END - 0.10 * (1 - 0.85))) AS a,
  0.18 * rule AS c FROM scored)"""))
def e19(spark, sf):
    s = scored(spark, sf).withColumns({
        "anomaly_score": F.col("score"), "beacon_score": F.col("periodic_beacon_score"), "drift_score": F.col("score_b"),
        "quality_score": F.lit(0.85), "reputation_score": F.col("rule")})
    return show(sc.response_score(s), KEYS, ["anomaly_channel", "context_channel", "response_score"])


@query("e20_severity", with_("overrides", select=f"""
SELECT app_id, window_bucket, round(m, 6) AS medium_threshold, round(h, 6) AS high_threshold, {SEVERITY.format(s='score', m='m', h='h')} AS severity
FROM (SELECT *, least(1, coalesce(o.medium, 0.6) + CASE app_family WHEN 'browser' THEN 0.06 WHEN 'system' THEN 0.12 ELSE 0 END) AS m,
  least(1, coalesce(o.high, 0.85) + CASE app_family WHEN 'browser' THEN 0.08 WHEN 'system' THEN 0.15 ELSE 0 END) AS h
  FROM scored LEFT JOIN overrides o USING (app_id))"""))
def e20(spark, sf):
    s = scored(spark, sf).withColumn("profile", F.upper("app_family"))
    out = sc.severity(s, overrides(spark, sf), {"low": 0.35}, profile="profile")
    return show(out, KEYS + ["severity"], ["medium_threshold", "high_threshold"])


@query("l12_shadow_score", with_("linear", select="SELECT app_id, window_bucket, rule AS active, round(linear_score, 6) AS shadow FROM linear"))
def l12(spark, sf):
    from netloom.plans.pipeline import shadow_score

    return show(shadow_score(scored(spark, sf), "rule", LINEAR), KEYS, ["active", "shadow"])
