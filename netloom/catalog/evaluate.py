"""Metrics, thresholds, reports and audits over scored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.catalog.base import query, stage
from netloom.catalog.sql import WINDOW_MS, cte, rounded, with_
from netloom.functions import constants as K
from netloom.functions.scalars import r6
from netloom.operators import evaluate as ev
from netloom.operators import scoring as sc
from netloom.operators import windows as win
from netloom.sources.tables import flow_view

RULE = """greatest(0.0, least(1.0, 0.32 * greatest(0.0, least(1.0, novelty_score)) + 0.22 * greatest(0.0, least(1.0, burstiness / 500.0))
  + 0.20 * greatest(0.0, least(1.0, (total_bytes_out / (total_bytes_in + 1.0) - 2.0) / 6.0))
  + 0.14 * greatest(0.0, least(1.0, (outbound_ratio - 0.7) / 0.3))
  + 0.12 * greatest(0.0, least(1.0, connection_frequency_delta / 20.0))))"""

cte("scored", ["windows"], f"""
SELECT *, app_id || ':' || window_bucket AS id, round({RULE}, 6) AS rule,
  round(0.6 * novelty_score + 0.4 * outbound_ratio, 6) AS score,
  round(0.5 * periodic_beacon_score + 0.5 * destination_transition_rate, 6) AS score_b FROM windows
""")


def scored(spark, sf) -> DataFrame:
    """Feature windows with three scores."""
    return stage(spark, "scored", sf, lambda: _scored(spark, sf))


def _scored(spark, sf) -> DataFrame:
    w = sc.rule_score(win.feature_windows(flow_view(spark, sf, dealt=True), WINDOW_MS), "rule")
    return w.withColumns({
        "id": F.concat_ws(":", "app_id", "window_bucket"), "rule": r6("rule"),
        "score": r6(0.6 * F.col("novelty_score") + 0.4 * F.col("outbound_ratio")),
        "score_b": r6(0.5 * F.col("periodic_beacon_score") + 0.5 * F.col("destination_transition_rate"))})


def show(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(v).alias(v) for v in values])


CONF = """count(*) FILTER (score >= {t} AND label = 1) AS tp, count(*) FILTER (score >= {t} AND label = 0) AS fp,
  count(*) FILTER (score < {t} AND label = 1) AS fn, count(*) FILTER (score < {t} AND label = 0) AS tn"""
RATES = """coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
  coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, fp / greatest(1, fp + tn)::DOUBLE AS false_positive_rate"""


@query("f01_binary_metrics", with_("scored", select=f"""
SELECT app_family, tp, fp, fn, tn, {rounded(['precision', 'recall', 'f1', 'false_positive_rate'])}
FROM (SELECT *, {RATES} FROM (SELECT app_family, {CONF.format(t=0.5)} FROM scored GROUP BY app_family))"""))
def f01(spark, sf):
    return show(ev.binary_metrics(scored(spark, sf), 0.5, ["app_family"]), ["app_family"],
                ["tp", "fp", "fn", "tn", *ev.PR])


AUC = """SELECT {by} round((sum(CASE WHEN label = 1 THEN ar END) - p * (p + 1) / 2.0) / (p * (n - p))::DOUBLE, 6) AS roc_auc
FROM (SELECT *, rank() OVER (PARTITION BY {grp} ORDER BY score) + (count(*) OVER (PARTITION BY {grp}, score) - 1) / 2.0::DOUBLE AS ar,
  count(*) OVER (PARTITION BY {grp}) AS n, count(*) FILTER (label = 1) OVER (PARTITION BY {grp}) AS p FROM scored)
GROUP BY {by} n, p"""


@query("f02_roc_auc", with_("scored", select=AUC.format(by="app_id,", grp="app_id")))
def f02(spark, sf):
    return show(ev.roc_auc(scored(spark, sf), ["app_id"]), ["app_id"], ["roc_auc"])


@query("f02_roc_auc_all", with_("scored", select=AUC.format(by="", grp="1")))
def f02_all(spark, sf):
    return show(ev.roc_auc(scored(spark, sf)), [], ["roc_auc"])


AP = """SELECT app_id, round(sum((tp_s / p::DOUBLE) * (ctp / cn::DOUBLE)), 6) AS average_precision FROM (
  SELECT app_id, s, tp_s, sum(tp_s) OVER w AS ctp, sum(n_s) OVER w AS cn, sum(tp_s) OVER (PARTITION BY app_id) AS p
  FROM (SELECT app_id, score AS s, count(*) AS n_s, count(*) FILTER (label = 1) AS tp_s FROM scored GROUP BY ALL)
  WINDOW w AS (PARTITION BY app_id ORDER BY s DESC)) GROUP BY app_id"""


@query("f03_average_precision", with_("scored", select=AP))
def f03(spark, sf):
    return show(ev.average_precision(scored(spark, sf), ["app_id"]), ["app_id"], ["average_precision"])


@query("f04_brier", with_("scored", select="""
SELECT app_id, round(avg((score - label) * (score - label)), 6) AS brier_score FROM scored GROUP BY app_id"""))
def f04(spark, sf):
    return show(ev.brier(scored(spark, sf), ["app_id"]), ["app_id"], ["brier_score"])


@query("f05_ece", with_("scored", select="""
SELECT app_id, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM (
  SELECT app_id, least(9, floor(score * 10)) AS b, count(*) AS n, avg(label) AS acc, avg(score) AS conf
  FROM scored GROUP BY ALL) GROUP BY app_id"""))
def f05(spark, sf):
    return show(ev.ece(scored(spark, sf), 10, ["app_id"]), ["app_id"], ["ece"])


@query("f06_calibration_bins", with_("scored", select="""
SELECT b AS bin, coalesce(n, 0) AS rows, round(coalesce(conf, 0), 6) AS mean_score, round(coalesce(acc, 0), 6) AS positive_rate
FROM range(10) r(b) LEFT JOIN (
  SELECT CAST(least(9, floor(score * 10)) AS BIGINT) AS bb, count(*) AS n, avg(label) AS acc, avg(score) AS conf
  FROM scored GROUP BY ALL) ON b = bb"""))
def f06(spark, sf):
    return show(ev.calibration_bins(scored(spark, sf)), ["bin", "rows"], ["mean_score", "positive_rate"])


cte("sweep", ["scored"], f"""
SELECT *, {RATES} FROM (SELECT step, CASE WHEN step = 200 THEN 1.0::DOUBLE ELSE step * (1.0::DOUBLE / 200) END AS threshold, {CONF.format(t='threshold')}
  FROM range(201) r(step) CROSS JOIN scored GROUP BY step)
""")
cte("fsweep", ["scored"], f"""
SELECT *, {RATES} FROM (SELECT app_family, step, CASE WHEN step = 200 THEN 1.0::DOUBLE ELSE step * (1.0::DOUBLE / 200) END AS threshold, {CONF.format(t='threshold')}
  FROM range(201) r(step) CROSS JOIN scored GROUP BY app_family, step)
""")


@query("f07_threshold_sweep", with_("sweep", select=f"""
SELECT step, tp, fp, fn, tn, {rounded(['threshold', 'precision', 'recall', 'f1', 'false_positive_rate'])} FROM sweep"""))
def f07(spark, sf):
    return show(ev.threshold_sweep(scored(spark, sf)), ["step", "tp", "fp", "fn", "tn"], ["threshold", *ev.PR])


@query("f07_threshold_sweep_by_family", with_("fsweep", select=f"""
SELECT app_family, step, tp, fp, {rounded(['precision', 'recall'])} FROM fsweep"""))
def f07_by(spark, sf):
    return show(ev.threshold_sweep(scored(spark, sf), by=["app_family"]), ["app_family", "step", "tp", "fp"],
                ["precision", "recall"])


def tier_sql(p, r, f, first_two: str) -> str:
    second = {"pf": f"precision >= {p} AND false_positive_rate <= {f}", "rf": f"recall >= {r} AND false_positive_rate <= {f}"}[first_two]
    return f"""CASE WHEN precision >= {p} AND recall >= {r} AND false_positive_rate <= {f} THEN 0
      WHEN {second} THEN 1 WHEN false_positive_rate <= {f} THEN 2 ELSE 3 END"""


PICKS = {
    "max_f1": ("0", "f1 DESC, precision DESC, recall DESC"),
    "policy": (tier_sql(0.55, 0.50, 0.10, "pf"), "recall DESC, f1 DESC, precision DESC"),
    "hard_mining": (tier_sql(0.55, 0.40, 0.035, "pf"), "f1 DESC, recall DESC, precision DESC"),
    "calibration": (tier_sql(0.85, 0.90, 0.18, "rf"), "f1 DESC, recall DESC, precision DESC"),
    "service": (tier_sql(0.85, 0.90, 0.18, "rf"), "f1 DESC, recall DESC, precision DESC, false_positive_rate"),
}


@query("f08_select_threshold", with_("sweep", select=" UNION ALL ".join(
    f"""(SELECT '{n}' AS policy, step, {t} AS tier, round(f1, 6) AS f1 FROM sweep
    ORDER BY tier, {o}, threshold LIMIT 1)""" for n, (t, o) in PICKS.items()) + """
UNION ALL (SELECT 'precision_at_recall' AS policy, step, 0 AS tier, round(f1, 6) AS f1 FROM sweep WHERE recall >= 0.9
    ORDER BY precision DESC, sweep.f1 DESC, threshold LIMIT 1)
UNION ALL (SELECT 'target' AS policy, step, 0 AS tier, round(f1, 6) AS f1 FROM sweep
    ORDER BY CASE WHEN precision >= 0.9 AND recall >= 0.9 AND false_positive_rate <= 0.1 THEN 0 ELSE 1 END,
      greatest(0, 0.9 - precision) + greatest(0, 0.9 - recall) + 0.25 * greatest(0, false_positive_rate - 0.1),
      sweep.f1 DESC, recall DESC, precision DESC, threshold LIMIT 1)"""))
def f08(spark, sf):
    sweep = ev.threshold_sweep(scored(spark, sf))
    out = None
    for name in (*PICKS, "precision_at_recall"):
        piece = ev.select_threshold(sweep, name).select(F.lit(name).alias("policy"), "step", "tier", r6("f1").alias("f1"))
        out = piece if out is None else out.unionByName(piece)
    target = ev.select_target_threshold(sweep, 0.9, 0.9, 0.1)
    return out.unionByName(target.select(F.lit("target").alias("policy"), "step", F.lit(0).alias("tier"), r6("f1").alias("f1")))


@query("f08_family_thresholds", with_("fsweep", select=f"""
SELECT app_family, step, tier FROM (SELECT *, row_number() OVER (PARTITION BY app_family ORDER BY tier, f1 DESC, recall DESC, precision DESC, threshold) AS rn
FROM (SELECT *, CASE app_family WHEN 'service' THEN {tier_sql(0.80, 0.45, 0.08, 'pf')}
  WHEN 'malware' THEN {tier_sql(0.60, 0.55, 0.15, 'pf')} ELSE {tier_sql(0.35, 0.25, 0.02, 'pf')} END AS tier FROM fsweep)) WHERE rn = 1"""))
def f08_family(spark, sf):
    return ev.select_family_threshold(ev.threshold_sweep(scored(spark, sf), by=["app_family"])).select(
        "app_family", "step", "tier")


@query("f09_frontier", with_("sweep", select="""
SELECT max(CASE WHEN precision >= 0.7 AND recall >= 0.7 THEN 1 ELSE 0 END) AS achieves_both,
  (SELECT round(threshold, 6) FROM sweep WHERE precision >= 0.7 AND recall >= 0.7 ORDER BY f1 DESC, threshold LIMIT 1) AS both_threshold,
  (SELECT round(threshold, 6) FROM sweep ORDER BY f1 DESC, threshold LIMIT 1) AS max_f1_threshold,
  (SELECT round(recall, 6) FROM sweep WHERE precision >= 0.7 ORDER BY recall DESC, f1 DESC, threshold LIMIT 1) AS recall_at_precision_recall,
  (SELECT round(precision, 6) FROM sweep WHERE recall >= 0.7 ORDER BY precision DESC, f1 DESC, threshold LIMIT 1) AS precision_at_recall_precision
FROM sweep"""))
def f09(spark, sf):
    return show(ev.frontier(ev.threshold_sweep(scored(spark, sf))), ["achieves_both"], [
        "both_threshold", "max_f1_threshold", "recall_at_precision_recall", "precision_at_recall_precision"])


@query("f10_precision_at_k", with_("scored", select="SELECT " + ", ".join(
    f"""CAST(sum(label) FILTER (rn <= {k}) AS BIGINT) AS true_positives_at_{k}, round(avg(label) FILTER (rn <= {k}), 6) AS precision_at_{k}"""
    for k in (1, 3, 5, 10)) + " FROM (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rn FROM scored)"))
def f10(spark, sf):
    out = ev.precision_at_k(scored(spark, sf))
    return show(out, [f"true_positives_at_{k}" for k in (1, 3, 5, 10)], [f"precision_at_{k}" for k in (1, 3, 5, 10)])


@query("f11_recall_at_fpr", with_("scored", select="SELECT " + ", ".join(
    f"round(coalesce(max(tp / p::DOUBLE) FILTER (fp / n::DOUBLE <= {t}), 0), 6) AS recall_at_fpr_{str(t).replace('.', '_')}"
    for t in (0.01, 0.05, 0.1)) + """ FROM (
  SELECT count(*) FILTER (label = 1) OVER w AS tp, count(*) FILTER (label = 0) OVER w AS fp,
    count(*) FILTER (label = 1) OVER () AS p, count(*) FILTER (label = 0) OVER () AS n
  FROM scored WINDOW w AS (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""))
def f11(spark, sf):
    return show(ev.recall_at_fpr(scored(spark, sf)), [], ["recall_at_fpr_0_01", "recall_at_fpr_0_05", "recall_at_fpr_0_1"])


GROUPS = f"""SELECT {{g}} AS "group", tp + fp + fn + tn AS rows, tp + fn AS positives,
  {rounded(['precision', 'recall', 'f1', 'false_positive_rate'])}
FROM (SELECT *, {RATES} FROM (SELECT {{g}}, {CONF.format(t=0.5)} FROM scored GROUP BY {{g}}))
WHERE tp + fp + fn + tn >= 24 AND tp + fn > 0 AND fp + tn > 0"""


@query("f12_group_metrics", with_("scored", select=GROUPS.format(g="session_id")))
def f12(spark, sf):
    return show(ev.group_metrics(scored(spark, sf), "session_id", 0.5), ["group", "rows", "positives"], ev.PR)


CURVE = """(SELECT s, sum(tp_s) OVER w AS ctp, sum(n_s) OVER w AS cn, sum(tp_s) OVER () AS p, sum(n_s) OVER () AS n
  FROM (SELECT score AS s, count(*) AS n_s, count(*) FILTER (label = 1) AS tp_s FROM scored GROUP BY ALL)
  WINDOW w AS (ORDER BY s DESC))"""


@query("f13_roc_curve", with_("scored", select=f"""
SELECT s AS threshold, round((cn - ctp) / (n - p)::DOUBLE, 6) AS fpr, round(ctp / p::DOUBLE, 6) AS tpr FROM {CURVE}"""))
def f13(spark, sf):
    return show(ev.roc_curve(scored(spark, sf)), ["threshold"], ["fpr", "tpr"])


@query("f13_pr_curve", with_("scored", select=f"""
SELECT s AS threshold, round(ctp / cn::DOUBLE, 6) AS precision, round(ctp / p::DOUBLE, 6) AS recall FROM {CURVE}"""))
def f13_pr(spark, sf):
    return show(ev.pr_curve(scored(spark, sf)), ["threshold"], ["precision", "recall"])


@query("f14_confusion_matrix", with_("scored", select="""
SELECT label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction, count(*) AS rows FROM scored GROUP BY ALL"""))
def f14(spark, sf):
    return ev.confusion(scored(spark, sf), 0.5)


CALIBRATED = """SELECT NULL AS app_id, round(quantile_cont(score, 0.9), 6) AS medium, round(quantile_cont(score, 0.98), 6) AS high FROM scored
UNION ALL SELECT app_id, round(quantile_cont(score, 0.9), 6), round(quantile_cont(score, 0.98), 6) FROM scored GROUP BY app_id HAVING count(*) >= 10"""


@query("f15_calibrate_thresholds", with_("scored", select=CALIBRATED))
def f15(spark, sf):
    return show(ev.calibrate_thresholds(scored(spark, sf)), ["app_id"], ["medium", "high"])


@query("f16_policy_document", with_("scored", select=f"""
, c AS ({CALIBRATED})
SELECT 7 AS policy_version, 30 AS retention_days, (SELECT count(*) FROM c WHERE app_id IS NOT NULL) AS overrides,
  (SELECT round(medium, 6) FROM c WHERE app_id IS NULL) AS medium,
  (SELECT round(high, 6) FROM c WHERE app_id = 'com.whatsapp') AS whatsapp_high"""))
def f16(spark, sf):
    doc = ev.policy_document(ev.calibrate_thresholds(scored(spark, sf)), 7, True, 30)
    pair = "struct<medium:double,high:double>"
    parsed = doc.select(F.from_json("document", f"policy_version int, default_thresholds {pair}, "
                                    f"app_threshold_overrides map<string,{pair}>, retention_days int").alias("d"))
    return parsed.select("d.policy_version", "d.retention_days", F.size("d.app_threshold_overrides").alias("overrides"),
                         r6("d.default_thresholds.medium").alias("medium"),
                         r6(F.col("d.app_threshold_overrides")["com.whatsapp"]["high"]).alias("whatsapp_high"))


@query("f17_error_groups", with_("scored", select="""
SELECT "group", errors, rows, round(errors / rows::DOUBLE, 6) AS error_rate, round(errors / total::DOUBLE, 6) AS share_of_error_type
FROM (SELECT app_id AS "group", count(*) FILTER (score >= 0.5 AND label = 0) AS errors, count(*) AS rows,
    sum(count(*) FILTER (score >= 0.5 AND label = 0)) OVER () AS total FROM scored GROUP BY app_id)
WHERE errors > 0 ORDER BY errors DESC, "group" LIMIT 5"""))
def f17(spark, sf):
    s = scored(spark, sf)
    return show(ev.error_groups(s, (F.col("score") >= 0.5) & (F.col("label") == 0), "app_id", 5),
                ["group", "errors", "rows"], ["error_rate", "share_of_error_type"])


SHIFT_COLUMNS = ["flow_count", "byte_rate", "novelty_score", "burstiness", "outbound_ratio", "ttl_gap",
                 "destination_diversity", "mean_duration_ms"]


def shift_sql(columns: list[str], wrong: str = "score >= 0.5 AND label = 0", right: str = "score < 0.5 AND label = 0") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, avg({c}) FILTER ({wrong}) AS e, avg({c}) FILTER ({right}) AS r,
    stddev_pop({c}) FILTER ({right}) AS d FROM scored""" for c in columns)


def _shift_rows(section: str, wrong: str, right: str) -> str:
    """The ten features that differ most, of all features of a window."""
    return f"""SELECT * FROM (SELECT '{section}' AS section, feature AS key, 'standardized_delta' AS metric,
  round((e - r) / (d + 1e-9), 6) AS value FROM ({shift_sql(K.FEATURES, wrong, right)}) ORDER BY abs((e - r) / (d + 1e-9)) DESC, feature LIMIT 10)"""


@query("f18_feature_shifts", with_("scored", select=f"""
SELECT feature, round(e, 6) AS error_mean, round(r, 6) AS reference_mean, round((e - r) / (d + 1e-9), 6) AS standardized_delta
FROM ({shift_sql(SHIFT_COLUMNS)}) ORDER BY abs((e - r) / (d + 1e-9)) DESC, feature LIMIT 5"""))
def f18(spark, sf):
    s = scored(spark, sf)
    pred = F.col("score") >= 0.5
    out = ev.feature_shifts(s, pred & (F.col("label") == 0), ~pred & (F.col("label") == 0), 5, SHIFT_COLUMNS)
    return show(out, ["feature"], ["error_mean", "reference_mean", "standardized_delta"])


cte("episodes", ["scored"], """
SELECT app_id, session_id, episode, arg_min(app_family, (window_end_ms, window_bucket)) AS app_family,
  arg_min(dataset_source, (window_end_ms, window_bucket)) AS dataset_source,
  min(window_end_ms) AS start_ms, max(window_end_ms) AS end_ms, count(*) AS windows, max(label) AS label,
  max(score) AS score, max(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS prediction
FROM (SELECT *, sum(is_new) OVER (PARTITION BY app_id, session_id ORDER BY window_end_ms) AS episode FROM (
  SELECT *, CASE WHEN window_end_ms - lag(window_end_ms) OVER (PARTITION BY app_id, session_id ORDER BY window_end_ms) <= 43200000 THEN 0 ELSE 1 END AS is_new
  FROM scored)) GROUP BY app_id, session_id, episode
""")


def episodes(spark, sf):
    return ev.episodes(scored(spark, sf), 43_200_000)


@query("f19_episodes", with_("episodes", select="""
SELECT app_id, session_id, app_family, dataset_source, start_ms, end_ms, windows, label, round(score, 6) AS score, prediction FROM episodes"""))
def f19(spark, sf):
    return episodes(spark, sf).select("app_id", "session_id", "app_family", "dataset_source", "start_ms", "end_ms",
                                      "windows", "label", r6("score").alias("score"), "prediction")


@query("f20_episode_report", with_("episodes", select=f"""
SELECT dimension, value, tp + fp + fn + tn AS episodes, {rounded(['precision', 'recall', 'f1'])} FROM (
  SELECT *, {RATES} FROM (SELECT dimension, value, {CONF.format(t=0.5)} FROM (
    SELECT 'all' AS dimension, 'all' AS value, label, score FROM episodes UNION ALL
    SELECT 'app_family', app_family, label, score FROM episodes UNION ALL
    SELECT 'dataset_source', dataset_source, label, score FROM episodes) GROUP BY dimension, value))"""))
def f20(spark, sf):
    return show(ev.episode_report(scored(spark, sf), 43_200_000), ["dimension", "value", "episodes"],
                ["precision", "recall", "f1"])


DRIFT = ["score", "novelty_score", "burstiness"]


def _z(c: str) -> str:
    return f"""least(10.0, coalesce(CASE WHEN count({c}) OVER d >= 12 THEN
      abs(({c} - avg({c}) OVER d) / nullif(stddev_samp({c}) OVER d, 0)) END, 0.0))"""


cte("drift", ["scored"], f"""
SELECT app_id, window_bucket, greatest(0, least(1, ({' + '.join(_z(c) for c in DRIFT)}) / 3 / 5)) AS drift_score FROM scored
WINDOW d AS (PARTITION BY app_id ORDER BY window_end_ms ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)
""")


@query("f21_drift_series", with_("drift", select="""
SELECT app_id, window_bucket, round(drift_score, 6) AS drift_score, CASE WHEN drift_score >= 0.3 THEN 1 ELSE 0 END AS high_drift FROM drift"""))
def f21(spark, sf):
    out = ev.drift_series(scored(spark, sf), features=DRIFT, high=0.3)
    return show(out, ["app_id", "window_bucket", "high_drift"], ["drift_score"])


@query("f22_drift_report", with_("drift", select="""
SELECT app_id, count(*) AS rows, round(max(drift_score), 6) AS max_drift, round(avg(drift_score), 6) AS mean_drift,
  CAST(sum(CASE WHEN drift_score >= 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS high_drift_rows
FROM drift GROUP BY GROUPING SETS ((app_id), ())"""))
def f22(spark, sf):
    out = ev.drift_report(ev.drift_series(scored(spark, sf), features=DRIFT, high=0.3))
    return show(out, ["app_id", "rows", "high_drift_rows"], ["max_drift", "mean_drift"])


FP_FEATURES = ["flow_count", "novelty_score"]
FP_SQL = "dataset_source || '|' || app_family || '|' || flow_count || '|' || round_even(novelty_score, 1)"

cte("conflicts", ["scored"], f"""
SELECT fp, count(*) AS rows, sum(label) AS positives, list_sort(list_distinct(list(app_id)))[1:8] AS apps,
  list_sort(list_distinct(list(app_family)))[1:5] AS families
FROM (SELECT *, {FP_SQL} AS fp FROM scored) GROUP BY fp HAVING sum(label) > 0 AND sum(label) < count(*)
""")


@query("f23_label_audit", with_("conflicts", select="""
SELECT rows, CAST(positives AS BIGINT) AS positives, round(positives / rows::DOUBLE, 6) AS positive_rate, array_to_string(apps, ',') AS apps,
  array_to_string(families, ',') AS families FROM conflicts"""))
def f23(spark, sf):
    out = ev.label_audit(scored(spark, sf), 1, FP_FEATURES)
    return out.select("rows", "positives", r6("positive_rate").alias("positive_rate"),
                      F.concat_ws(",", "apps").alias("apps"), F.concat_ws(",", "families").alias("families"))


@query("f23_label_audit_by_family", with_("conflicts", select="""
SELECT app_family, count(*) AS conflict_groups, CAST(sum(rows) AS BIGINT) AS conflict_rows
FROM (SELECT unnest(families) AS app_family, rows FROM conflicts) GROUP BY app_family"""))
def f23_family(spark, sf):
    return ev.label_audit_by_family(ev.label_audit(scored(spark, sf), 1, FP_FEATURES))


AUDIT_SQL = "dataset_source || '|' || app_family || '|' || " + " || '|' || ".join(
    f"round_even({c}, 0)" for c in ev.AUDIT_FEATURES)


@query("f24_label_conflicts", with_("scored", select=f"""
SELECT app_id, window_bucket, CASE WHEN lo = 0 AND hi = 1 THEN 1 ELSE 0 END AS label_conflict,
  CASE WHEN lo = 0 AND hi = 1 THEN 0.35 ELSE 1.0 END AS conflict_weight
FROM (SELECT app_id, window_bucket, min(label) OVER (PARTITION BY {AUDIT_SQL}) AS lo, max(label) OVER (PARTITION BY {AUDIT_SQL}) AS hi FROM scored)"""))
def f24(spark, sf):
    return ev.label_conflicts(scored(spark, sf), 0).select("app_id", "window_bucket", "label_conflict", "conflict_weight")


@query("f25_balance_counts", with_("scored", select=" UNION ALL ".join(f"""
SELECT split, '{c}' AS dimension, {c} AS "group", count(*) AS rows, count(*) FILTER (label = 1) AS positives,
  count(*) FILTER (label = 0) AS negatives, round(avg(label), 6) AS positive_rate
FROM (SELECT *, CASE WHEN window_bucket % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM scored) GROUP BY split, {c}"""
    for c in ("dataset_source", "app_family"))))
def f25(spark, sf):
    s = scored(spark, sf).withColumn("split", F.when(F.col("window_bucket") % 10 < 7, "train").otherwise("test"))
    return show(ev.balance_counts(s, ["dataset_source", "app_family"], "split"),
                ["split", "dimension", "group", "rows", "positives", "negatives"], ["positive_rate"])


MELTED = """, long AS (SELECT 'model' AS model, score, 0.5 AS t, label FROM scored UNION ALL SELECT 'rule', rule, 0.2, label FROM scored)"""


@query("f26_compare_scores", with_("scored", select=MELTED + f"""
, m AS (SELECT *, {RATES} FROM (SELECT model, {CONF.format(t='t')} FROM long GROUP BY model)),
auc AS (SELECT model, (sum(CASE WHEN label = 1 THEN ar END) - p * (p + 1) / 2.0) / (p * (n - p))::DOUBLE AS roc_auc
  FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS ar,
    count(*) OVER (PARTITION BY model) AS n, count(*) FILTER (label = 1) OVER (PARTITION BY model) AS p FROM long) GROUP BY model, n, p)
SELECT model, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc,
  round(f1 - (SELECT f1 FROM m WHERE model = 'model'), 6) AS f1_delta FROM m JOIN auc USING (model)"""))
def f26(spark, sf):
    out = ev.compare_scores(scored(spark, sf), {"model": "score", "rule": "rule"}, {"model": 0.5, "rule": 0.2})
    return show(out, ["model"], ["f1", "roc_auc", "f1_delta"])


# Per (app, fold) metrics stand for repeated runs; a view is the app's family.
cte("runs", ["scored"], f"""
SELECT view, fold, f1, precision AS pr_auc, recall AS roc_auc FROM (SELECT *, {RATES} FROM (
  SELECT app_family AS view, window_bucket % 5 AS fold, {CONF.format(t=0.5)} FROM scored GROUP BY ALL))
""")


def runs(spark, sf):
    s = scored(spark, sf).withColumns({"view": F.col("app_family"), "fold": F.col("window_bucket") % 5})
    return ev.binary_metrics(s, 0.5, ["view", "fold"]).select(
        "view", "fold", "f1", F.col("precision").alias("pr_auc"), F.col("recall").alias("roc_auc"))


RUN_SQL = """SELECT view, count(*) AS runs, avg(f1) AS f1, stddev_pop(f1) AS f1_std, avg(pr_auc) AS pr_auc, avg(roc_auc) AS roc_auc FROM runs GROUP BY view"""


@query("f27_aggregate_runs", with_("runs", select=f"SELECT view, runs, {rounded(['f1', 'f1_std', 'pr_auc'])} FROM ({RUN_SQL})"))
def f27(spark, sf):
    return show(ev.aggregate_runs(runs(spark, sf), ["view"], ["f1", "pr_auc", "roc_auc"]), ["view", "runs"],
                ["f1", "f1_std", "pr_auc"])


@query("f28_relative_drop", with_("runs", select=f"""
, a AS ({RUN_SQL})
SELECT a.view, round(greatest(0, 1 - a.pr_auc / greatest(1e-9, b.pr_auc)), 6) AS pr_auc_relative_drop,
  round(greatest(0, 1 - a.roc_auc / greatest(1e-9, b.roc_auc)), 6) AS roc_auc_relative_drop, round(a.f1 - b.f1, 6) AS f1_delta
FROM a CROSS JOIN (SELECT * FROM a WHERE view = 'browser') b"""))
def f28(spark, sf):
    agg = ev.aggregate_runs(runs(spark, sf), ["view"], ["f1", "pr_auc", "roc_auc"])
    return show(ev.relative_drop(agg, "browser"), ["view"], ["pr_auc_relative_drop", "roc_auc_relative_drop", "f1_delta"])


LIMITS = {"service": {"f1": 0.5, "pr_auc": 0.4}, "system": {"f1": 0.6, "pr_auc": 0.9}, "browser": {"f1": 0.4}}


def verdicts(spark, sf):
    agg = ev.aggregate_runs(runs(spark, sf), ["view"], ["f1", "pr_auc"]).withColumn("category", F.col("view"))
    return agg, ev.gates(agg, ev.limits_table(spark, LIMITS), ["view"])


cte("verdicts", ["runs"], f"""
SELECT view, CASE view WHEN 'service' THEN 2 WHEN 'system' THEN 2 WHEN 'browser' THEN 1 ELSE 0 END AS checks,
  CASE view WHEN 'service' THEN CASE WHEN f1 >= 0.5 AND pr_auc >= 0.4 THEN 1 ELSE 0 END
    WHEN 'system' THEN CASE WHEN f1 >= 0.6 AND pr_auc >= 0.9 THEN 1 ELSE 0 END
    WHEN 'browser' THEN CASE WHEN f1 >= 0.4 THEN 1 ELSE 0 END END AS passed, f1, pr_auc FROM ({RUN_SQL})
""")


@query("f29_gates", with_("verdicts", select="SELECT view, checks, passed FROM verdicts"))
def f29(spark, sf):
    return verdicts(spark, sf)[1].select("view", "checks", "passed")


@query("f29_risk_levels", with_("runs", select=f"""
SELECT view, CASE WHEN f1 >= 0.75 THEN 'severe' WHEN f1 >= 0.45 THEN 'elevated' WHEN f1 >= 0.2 THEN 'reduced' ELSE 'low' END AS risk FROM ({RUN_SQL})"""))
def f29_risk(spark, sf):
    return ev.aggregate_runs(runs(spark, sf), ["view"], ["f1"]).select("view", ev.risk_level("f1").alias("risk"))


@query("f30_rank_models", with_("verdicts", select="""
SELECT (SELECT view FROM verdicts ORDER BY f1 DESC, view LIMIT 1) AS best_f1_model,
  (SELECT view FROM verdicts ORDER BY pr_auc DESC, view LIMIT 1) AS best_pr_auc_model,
  (SELECT min(view) FROM verdicts WHERE passed = 1) AS first_passing_model"""))
def f30(spark, sf):
    agg, v = verdicts(spark, sf)
    return ev.rank_models(agg.withColumnRenamed("view", "model"), v.withColumnRenamed("view", "model"))


@query("f31_pareto", with_("runs", select=f"""
SELECT a.view, round(a.f1, 6) AS f1, l.leak FROM ({RUN_SQL}) a LEFT JOIN (
  SELECT app_family AS view, count(*) AS leak FROM scored WHERE label = 1 GROUP BY ALL) l ON a.view = l.view"""))
def f31(spark, sf):
    found = scored(spark, sf).filter("label = 1")
    leak = found.groupBy(F.col("app_family").alias("view")).agg(F.count(F.lit(1)).alias("leak"))
    return ev.pareto(ev.aggregate_runs(runs(spark, sf), ["view"], ["f1"]).select("view", r6("f1").alias("f1")), leak)


@query("f32_run_diff", with_("runs", select="""
SELECT a.view AS model, round(a.f1 - b.f1, 6) AS f1_delta, round(a.pr_auc - b.pr_auc, 6) AS pr_auc_delta, round(a.roc_auc - b.roc_auc, 6) AS roc_auc_delta
FROM runs a JOIN runs b ON a.view = b.view AND a.fold = 1 AND b.fold = 0"""))
def f32(spark, sf):
    r = runs(spark, sf).withColumnRenamed("view", "model")
    return show(ev.run_diff(r.filter("fold = 1"), r.filter("fold = 0")), ["model"], ["f1_delta", "pr_auc_delta", "roc_auc_delta"])


@query("f33_client_counts", with_("scored", select="""
SELECT session_id AS client, count(*) AS rows, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1,
  round(avg(label), 6) AS positive_rate FROM scored GROUP BY session_id"""))
def f33(spark, sf):
    return show(ev.client_counts(scored(spark, sf), "session_id"), ["client", "rows", "label_0", "label_1"], ["positive_rate"])


@query("f34_error_report", with_("scored", select=f"""
, m AS (SELECT *, {RATES} FROM (SELECT {CONF.format(t=0.5)} FROM scored)),
g AS ({GROUPS.format(g='app_family')}),
e AS (SELECT app_family, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) AS n FROM scored GROUP BY app_family)
SELECT 'totals' AS section, 'all' AS key, metric, round(v, 6) AS value FROM (SELECT unnest(['tp','fp','fn','tn','precision','recall','f1','false_positive_rate']) AS metric,
  unnest([tp::DOUBLE, fp, fn, tn, precision, recall, f1, false_positive_rate]) AS v FROM m)
UNION ALL SELECT 'groups', "group", metric, round(v, 6) FROM (SELECT "group", unnest(['rows','precision','recall','f1','false_positive_rate']) AS metric,
  unnest([rows::DOUBLE, precision, recall, f1, false_positive_rate]) AS v FROM g)
UNION ALL SELECT 'false_positives', app_family, 'errors', fp::DOUBLE FROM e WHERE fp > 0
UNION ALL SELECT 'false_positives', app_family, 'error_rate', round(fp / n::DOUBLE, 6) FROM e WHERE fp > 0
UNION ALL SELECT 'false_negatives', app_family, 'errors', fn::DOUBLE FROM e WHERE fn > 0
UNION ALL SELECT 'false_negatives', app_family, 'error_rate', round(fn / n::DOUBLE, 6) FROM e WHERE fn > 0
UNION ALL {_shift_rows("false_positives_shift", "score >= 0.5 AND label = 0", "score < 0.5 AND label = 0")}
UNION ALL {_shift_rows("false_negatives_shift", "score < 0.5 AND label = 1", "score >= 0.5 AND label = 1")}"""))
def f34(spark, sf):
    return show(ev.error_report(scored(spark, sf), 0.5), ["section", "key", "metric"], ["value"])


def model_view_rows(spark, sf):
    long = ev.melt_scores(scored(spark, sf), {"a": "score", "b": "score_b"}, ["label", "dataset_source"])
    return long.withColumns({"view": F.col("dataset_source"), "threshold": F.lit(0.4)})


@query("f35_model_view_table", with_("scored", select=f"""
, long AS (SELECT 'a' AS model, dataset_source AS view, label, score FROM scored UNION ALL SELECT 'b', dataset_source, label, score_b FROM scored),
m AS (SELECT *, {RATES} FROM (SELECT model, view, {CONF.format(t=0.4)} FROM long GROUP BY ALL)),
s AS (SELECT *, {RATES} FROM (SELECT model, view, step, CASE WHEN step = 200 THEN 1.0::DOUBLE ELSE step * (1.0::DOUBLE / 200) END AS threshold, {CONF.format(t='threshold')}
  FROM range(201) r(step) CROSS JOIN long GROUP BY ALL)),
b AS (SELECT model, view, threshold AS bt, f1 AS bf FROM (SELECT *, row_number() OVER (PARTITION BY model, view ORDER BY f1 DESC, precision DESC, recall DESC, threshold) AS rn FROM s) WHERE rn = 1)
SELECT model, view, round(m.f1, 6) AS f1, round(m.precision, 6) AS precision, round(bt, 6) AS best_threshold, round(bf, 6) AS best_f1,
  (SELECT max(CASE WHEN s.precision >= 0.7 AND s.recall >= 0.7 THEN 1 ELSE 0 END) FROM s WHERE s.model = m.model AND s.view = m.view) AS achieves_70_70
FROM m JOIN b USING (model, view)"""))
def f35(spark, sf):
    return show(ev.model_view_table(model_view_rows(spark, sf)), ["model", "view", "achieves_70_70"],
                ["f1", "precision", "best_threshold", "best_f1"])
