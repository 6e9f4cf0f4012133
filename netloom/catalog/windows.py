"""Per-flow features and feature windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.catalog.base import query
from netloom.catalog.sql import WINDOW_MS, cte, family, rounded, with_
from netloom.functions import constants as K
from netloom.functions.scalars import r6
from netloom.operators import flows as fl
from netloom.operators import sliding as sl
from netloom.operators import windows as win
from netloom.sources.tables import flow_view

KEYS = ["app_id", "window_bucket"]
HOUR = 3_600_000
HORIZONS = [HOUR, 6 * HOUR, 24 * HOUR]


def show(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) for c in values])


def prepared(spark, sf):
    return fl.prepare_flows(flow_view(spark, sf))


def windows(spark, sf):
    return win.feature_windows(flow_view(spark, sf, dealt=True), WINDOW_MS)


def register_flow_columns(name: str, columns: list[str], source: str) -> None:
    sql = with_(source, select=f"SELECT flow_id, {rounded(columns)} FROM {source}")
    query(name, sql)(lambda spark, sf: show(prepared(spark, sf), ["flow_id"], columns))


register_flow_columns("b1_prepare_flows", ["bytes_out", "bytes_in", "packets_out", "packets_in",
                                           "dst_novelty", "duration_ms", "dst_port", "total_bytes"], "prep")
register_flow_columns("b2_calendar_parts", ["hour_of_day", "day_of_week", "is_weekend"], "prep")
register_flow_columns("b3_transport_derivations", [
    "ttl_gap", "ttl_metrics_present", "syn_rate_total", "rst_rate_total", "ack_rate_total", "fin_rate_total",
    "psh_rate_total", "fragment_rate_total", "tcp_window_mean", "ack_delay_mean", "inter_packet_gap_mean",
    "payload_mean", "load_mean", "transport_metrics_present"], "prep")
register_flow_columns("b4_port_roles", ["dns_flow", "web_flow", "high_port", "small_flow"], "prep")
register_flow_columns("b5_private_multicast", ["private_destination", "multicast_destination"], "prep")
register_flow_columns("b6_host_risk", ["destination_risk", "lookalike_score_flow", "suspicious_destination",
                                       "known_identity", "mitre_technique_flow", "threat_tag_flow"], "hosted")


def register_window_columns(name: str, columns: list[str], source: str = "win", keys: list[str] | None = None) -> None:
    keys = keys or KEYS
    sql = with_(source, select=f"SELECT {', '.join(keys)}, {rounded(columns)} FROM {source}")
    query(name, sql)(lambda spark, sf: show(
        windows(spark, sf) if source == "windows" else win.raw_windows(flow_view(spark, sf, dealt=True), WINDOW_MS), keys, columns))


register_window_columns("b7_tumbling_windows", [
    "window_start_ms", "window_end_ms", "flow_count", "total_bytes_out", "total_bytes_in", "mean_packet_size",
    "outbound_ratio", "novelty_score", "bytes_per_flow", "destination_diversity", "mean_duration_ms",
    "port_diversity", "protocol_diversity", "packet_imbalance"], "base")
register_window_columns("b8_burstiness", ["burstiness"], "base")
register_window_columns("b9_duration_jitter", ["duration_jitter"], "base")
register_window_columns("b10_rates", ["connection_frequency_delta", "activity_ratio", "byte_rate", "packet_rate"], "base")
register_window_columns("b11_mean_columns", [*K.FLAG_MEANS.values(), *K.TRANSPORT_MEANS,
                                             "small_flow_ratio", "high_port_ratio"], "base")
register_window_columns("b12_destination_concentration", ["destination_concentration"])
register_window_columns("b13_destination_switch_rate", ["destination_transition_rate"], "base")
register_window_columns("b14_transition_entropy", ["destination_transition_entropy"])
register_window_columns("b15_beacon_regularity", ["periodic_beacon_score"], "base")
register_window_columns("b16_profile_diversity", ["protocol_port_profile_diversity"], "base")
register_window_columns("b17_flow_size_iqr", ["flow_size_iqr"], "base")
register_window_columns("b19_window_label", ["label"], "base")
register_window_columns("b20_rolling_baseline", [
    "flow_count_deviation", "byte_rate_deviation", "destination_diversity_shift", "novelty_shift",
    "recent_flow_count_mean", "recent_byte_rate_mean", "recent_novelty_mean", "flow_count_trend",
    "byte_rate_trend", "novelty_trend", "destination_diversity_trend", "consecutive_burst_windows",
    "low_volume_periodic_score"], "windows")


@query("b18_dominant_text", with_("win", select=f"SELECT app_id, window_bucket, {', '.join(K.PROVENANCE)} FROM win"))
def b18(spark, sf):
    rows = win.bucketed(flow_view(spark, sf), WINDOW_MS)
    out = None
    for c in K.PROVENANCE:
        piece = win.dominant(rows, KEYS, c, K.PROVENANCE[c])
        out = piece if out is None else out.join(piece, KEYS)
    return out


@query("b21_runtime_baseline", with_("win", select="""
, d AS (SELECT *, least(10.0, coalesce(abs(flow_count - m_fc) / (abs(m_fc) + 1.0), 0.0)) AS flow_count_deviation,
    least(10.0, coalesce(abs(byte_rate - m_br) / (abs(m_br) + 1.0), 0.0)) AS byte_rate_deviation,
    coalesce(m_fc, 0.0) AS recent_flow_count_mean,
    greatest(-10.0, least(10.0, coalesce((flow_count - o_fc) / (abs(o_fc) + 1.0::DOUBLE), 0.0))) AS flow_count_trend,
    greatest(-1.0, least(1.0, coalesce(novelty_score - o_nv, 0.0))) AS novelty_trend
  FROM (SELECT *, avg(flow_count) OVER p AS m_fc, avg(byte_rate) OVER p AS m_br,
    first_value(flow_count) OVER p AS o_fc, first_value(novelty_score) OVER p AS o_nv
    FROM win WINDOW p AS (PARTITION BY app_id ORDER BY window_end_ms ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))),
r AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY window_end_ms) AS rn,
    (flow_count_deviation >= 0.4 OR byte_rate_deviation >= 0.4) AS burst FROM d)
SELECT a.app_id, a.window_bucket, round(a.flow_count_deviation, 6) AS flow_count_deviation,
  round(a.byte_rate_deviation, 6) AS byte_rate_deviation, round(a.recent_flow_count_mean, 6) AS recent_flow_count_mean,
  round(a.flow_count_trend, 6) AS flow_count_trend, round(a.novelty_trend, 6) AS novelty_trend,
  CAST(coalesce((SELECT min(a.rn - b.rn) - 1 FROM r b WHERE b.app_id = a.app_id AND b.rn < a.rn
    AND b.rn >= a.rn - 5 AND NOT b.burst), least(5, a.rn - 1)) AS DOUBLE) AS consecutive_burst_windows
FROM r a"""))
def b21(spark, sf):
    raw = win.raw_windows(flow_view(spark, sf, dealt=True), WINDOW_MS)
    return show(win.rolling_baseline_runtime(raw), KEYS, [
        "flow_count_deviation", "byte_rate_deviation", "recent_flow_count_mean", "flow_count_trend",
        "novelty_trend", "consecutive_burst_windows"])


# Trailing rows by position, then by age: exact under equal timestamps.
def trail(name: str, extra: str) -> None:
    cte(name, ["hosted"], f"""
SELECT a.flow_id, a.app_id, a.timestamp_end AS now_ms, a.rn, a.label AS focal, a.dataset_source AS now_source,
  b.* EXCLUDE (flow_id, app_id, rn, dataset_source), b.rn AS brn
FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY timestamp_end, flow_id) AS rn FROM hosted) a
JOIN (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY timestamp_end, flow_id) AS rn FROM hosted) b
  ON a.app_id = b.app_id AND b.rn <= a.rn AND {extra}
""")


trail("trail", f"b.timestamp_end >= a.timestamp_end - {24 * HOUR}")
trail("limited", "b.rn > a.rn - 240")

SLIDING = ["flow_count", "total_bytes_out", "total_bytes_in", "mean_packet_size", "outbound_ratio", "burstiness",
           "novelty_score", "connection_frequency_delta", "destination_diversity", "activity_ratio",
           "periodic_beacon_score", "mean_duration_ms", "duration_jitter", "port_diversity", "protocol_diversity",
           "packet_imbalance", "small_flow_ratio", "destination_concentration", "destination_transition_rate",
           "ack_rate_total", "tcp_window_mean", "destination_risk_score", "hour_of_day", "label",
           "window_contains_positive"]


def sliding_sql(rows: str, horizon: str, key: str = "flow_id") -> str:
    """Aggregates of the trailing rows in ``rows`` grouped by flow and horizon."""
    return f"""
, t AS ({rows}),
s AS (SELECT *, lag(destination_key) OVER w AS pd, (timestamp_end - lag(timestamp_end) OVER w) / 1000.0::DOUBLE AS gap,
    avg(total_bytes) OVER (PARTITION BY flow_id, h) AS mb,
    count(*) OVER (PARTITION BY flow_id, h, destination_key) AS nd
  FROM t WINDOW w AS (PARTITION BY flow_id, h ORDER BY brn)),
g AS (SELECT flow_id, any_value(app_id) AS app_id, h, any_value(now_ms) AS window_end_ms,
  count(*) AS flow_count, sum(bytes_out)::DOUBLE AS total_bytes_out, sum(bytes_in)::DOUBLE AS total_bytes_in,
  sum(total_bytes) / greatest(1, sum(packets_out + packets_in))::DOUBLE AS mean_packet_size,
  sum(bytes_out) / (sum(total_bytes) + 1.0::DOUBLE) AS outbound_ratio,
  CASE WHEN sum(total_bytes) > 0 THEN least(4.0, avg(abs(total_bytes - mb)) / avg(total_bytes)) ELSE 0.0::DOUBLE END AS burstiness,
  avg(dst_novelty) AS novelty_score, ln(1.0 + count(*) / greatest(1.0, h / 1000.0::DOUBLE)) AS connection_frequency_delta,
  sum(total_bytes) / greatest(1.0, h / 1000.0::DOUBLE) AS byte_rate,
  count(DISTINCT destination_key) / count(*)::DOUBLE AS destination_diversity,
  least(1.0, sum(duration_ms) / h::DOUBLE) AS activity_ratio,
  CASE WHEN count(*) >= 4 AND avg(gap) > 0 THEN greatest(0.0, least(1.0, 1.0 - stddev_pop(gap) / avg(gap))) ELSE 0.0::DOUBLE END AS periodic_beacon_score,
  avg(duration_ms) AS mean_duration_ms, CASE WHEN count(*) > 1 THEN stddev_pop(duration_ms) ELSE 0.0::DOUBLE END AS duration_jitter,
  count(DISTINCT dst_port) / count(*)::DOUBLE AS port_diversity, count(DISTINCT protocol) / count(*)::DOUBLE AS protocol_diversity,
  abs(sum(packets_out) - sum(packets_in)) / (greatest(1, sum(packets_out + packets_in)) + 1.0::DOUBLE) AS packet_imbalance,
  avg(small_flow) AS small_flow_ratio, max(nd) / count(*)::DOUBLE AS destination_concentration,
  sum(CASE WHEN pd <> destination_key THEN 1 ELSE 0 END) / greatest(1, count(*) - 1)::DOUBLE AS destination_transition_rate,
  avg(ack_rate_total) AS ack_rate_total, avg(tcp_window_mean) AS tcp_window_mean,
  avg(destination_risk) AS destination_risk_score, avg(hour_of_day) AS hour_of_day,
  any_value(focal) AS label, max(label) AS window_contains_positive
FROM s GROUP BY flow_id, h)
"""


def horizon_rows(h: int, rows: str = "trail") -> str:
    return f"SELECT *, {h}::BIGINT AS h FROM {rows} WHERE timestamp_end >= now_ms - {h}"


@query("b22_sliding_windows", with_("trail", select=sliding_sql(horizon_rows(6 * HOUR), "h")
                                    + f"SELECT flow_id, {rounded(SLIDING)} FROM g"))
def b22(spark, sf):
    out = sl.sliding_windows(flow_view(spark, sf), 6 * HOUR, baseline=False)
    return show(out, ["flow_id"], SLIDING)


cte("chosen", ["trail"], """
SELECT flow_id, CASE WHEN """ + family("any_value(app_id)") + f""" IN ('service', 'system', 'background') THEN {24 * HOUR}
    WHEN count(*) FILTER (timestamp_end >= now_ms - {6 * HOUR}) < 10 THEN {24 * HOUR}
    WHEN count(*) FILTER (timestamp_end >= now_ms - {6 * HOUR}) > 100 THEN {HOUR} ELSE {6 * HOUR} END AS h
FROM trail GROUP BY flow_id
""")

ADAPTIVE = "SELECT t.*, c.h FROM trail t JOIN chosen c USING (flow_id) WHERE timestamp_end >= now_ms - c.h"


@query("b23_adaptive_windows", with_("chosen", select=sliding_sql(ADAPTIVE, "h")
                                     + f"SELECT flow_id, h // 1000 AS adaptive_window_seconds, {rounded(SLIDING)} FROM g"))
def b23(spark, sf):
    out = sl.adaptive_windows(flow_view(spark, sf), horizons_ms=HORIZONS, baseline=False)
    return show(out, ["flow_id", "adaptive_window_seconds"], SLIDING)


@query("b24_all_horizons", with_("trail", select=sliding_sql(
    " UNION ALL ".join(horizon_rows(h) for h in HORIZONS), "h")
    + "SELECT flow_id, h // 1000 AS adaptive_window_seconds, "
    + rounded(["flow_count", "burstiness", "byte_rate", "activity_ratio", "destination_diversity"]) + " FROM g"))
def b24(spark, sf):
    out = sl.adaptive_windows(flow_view(spark, sf), horizons_ms=HORIZONS, emit_all_horizons=True, baseline=False)
    return show(out, ["flow_id", "adaptive_window_seconds"],
                ["flow_count", "burstiness", "byte_rate", "activity_ratio", "destination_diversity"])


@query("b25_emission_thinning", with_("hosted", select="""
SELECT flow_id, app_id, label FROM (
  SELECT flow_id, app_id, label, row_number() OVER (ORDER BY app_id, timestamp_end, flow_id) AS rn,
    greatest(1, CAST(ceil(count(*) OVER () / 700.0) AS BIGINT)) AS stride FROM hosted)
WHERE rn % stride = 0 OR label > 0"""))
def b25(spark, sf):
    out = sl.sliding_windows(flow_view(spark, sf), 6 * HOUR, max_windows=700, baseline=False)
    return out.select("flow_id", "app_id", "label")


@query("b26_label_any", with_("trail", select=f"""
SELECT flow_id, max(CASE WHEN timestamp_end >= now_ms - {6 * HOUR} THEN label ELSE 0 END) AS label
FROM trail GROUP BY flow_id"""))
def b26(spark, sf):
    out = sl.sliding_windows(flow_view(spark, sf), 6 * HOUR, label_strategy="any", baseline=False)
    return out.select("flow_id", "label")


@query("b22_sliding_row_limit", with_("limited", select=sliding_sql(horizon_rows(24 * HOUR, "limited"), "h")
                                      + f"SELECT flow_id, {rounded(SLIDING)} FROM g"))
def b22_row_limit(spark, sf):
    out = sl.sliding_windows(flow_view(spark, sf), 24 * HOUR, baseline=False, row_limit=240)
    return show(out, ["flow_id"], SLIDING)


BUSY = [c for c in SLIDING if c != "hour_of_day"]
#: One application has few panes, so each gets much of what a task makes.
FLOWS_OF_A_TASK = 131_072


@query("b22_busy_horizon", with_("trail", select=sliding_sql(horizon_rows(HOUR, "busy"), "h").replace(", t AS", f""", dense AS (
SELECT * EXCLUDE (app_id, timestamp_end), 'one' AS app_id, timestamp_end // 64 AS timestamp_end FROM hosted),
busy AS (SELECT a.flow_id, a.app_id, a.timestamp_end AS now_ms, a.rn, a.label AS focal, a.dataset_source AS now_source,
  b.* EXCLUDE (flow_id, app_id, rn, dataset_source), b.rn AS brn
FROM (SELECT *, row_number() OVER (ORDER BY timestamp_end, flow_id) AS rn FROM dense) a
JOIN (SELECT *, row_number() OVER (ORDER BY timestamp_end, flow_id) AS rn FROM dense) b
  ON b.rn <= a.rn AND b.timestamp_end >= a.timestamp_end - {HOUR}), t AS""", 1)
    + f"SELECT flow_id, {rounded(BUSY)} FROM g"))
def b22_busy(spark, sf):
    """All flows as one application, 64 times as dense: hundreds of flows in each horizon."""
    dense = flow_view(spark, sf, dealt=True, rows=FLOWS_OF_A_TASK).withColumns({
        "app_id": F.lit("one"), "timestamp_end": F.expr("timestamp_end div 64")})
    return show(sl.sliding_windows(dense, HOUR, baseline=False), ["flow_id"], BUSY)


@query("b22_sliding_with_baseline", with_("trail", select=sliding_sql(horizon_rows(6 * HOUR), "h") + """
, p AS (SELECT *, avg(flow_count) OVER q AS m FROM g
  WINDOW q AS (PARTITION BY app_id ORDER BY window_end_ms, flow_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT flow_id, round(coalesce(abs(flow_count - m) / (abs(m) + 1.0), 0.0), 6) AS flow_count_deviation FROM p"""))
def b22_baseline(spark, sf):
    return show(sl.sliding_windows(flow_view(spark, sf), 6 * HOUR), ["flow_id"], ["flow_count_deviation"])


@query("b27_feature_matrix", with_("windows", select=f"SELECT app_id, window_bucket, {rounded(K.FEATURES)} FROM windows"))
def b27(spark, sf):
    """The values of the vector, each under the name of its place."""
    from pyspark.ml.functions import vector_to_array

    m = win.feature_matrix(windows(spark, sf)).select(*KEYS, vector_to_array("features").alias("v"))
    return m.select(*KEYS, *[r6(F.col("v")[i]).alias(c) for i, c in enumerate(K.FEATURES)])


@query("b28_contract_check", with_("base", select="SELECT count(*) AS n_windows FROM base"))
def b28(spark, sf):
    out = windows(spark, sf)
    kept = [c for c in K.FEATURES if c in out.columns]
    win.check_contract(kept)
    return out.select(*kept).agg(F.count(F.lit(1)).alias("n_windows"))


BACKEND = list(win.GATED_MEANS) + ["ttl_metrics_present", "transport_metrics_present", "hour_of_day",
                                   "day_of_week", "is_weekend", "flow_count", "burstiness"]


@query("b29_backend_windows", with_("prep", "base", select="""
, f AS (SELECT app_id, window_bucket, avg(has_ttl_metrics) AS p_ttl, avg(has_tcp_flag_metrics) AS p_flag,
    avg(has_payload_metrics) AS p_pay, avg(abs(sttl - rttl)) / 255.0 AS g, avg(s_syn_rate + r_syn_rate) AS syn,
    avg(s_ack_rate + r_ack_rate) AS ack, avg(s_psh_rate) AS psh, avg((s_win_tcp + r_win_tcp) * 0.5) AS wn,
    avg((s_payload_avg + r_payload_avg) * 0.5) AS pay, max(timestamp_end) AS tmax
  FROM prep GROUP BY app_id, window_bucket)
SELECT app_id, window_bucket,
  round(CASE WHEN p_ttl > 0 THEN g ELSE 0 END, 6) AS ttl_gap, round(CASE WHEN p_flag > 0 THEN syn ELSE 0 END, 6) AS syn_rate_total,
  0.0 AS rst_rate_total, round(CASE WHEN p_flag > 0 THEN ack ELSE 0 END, 6) AS ack_rate_total, 0.0 AS fin_rate_total,
  round(CASE WHEN p_flag > 0 THEN psh ELSE 0 END, 6) AS psh_rate_total, 0.0 AS fragment_rate_total,
  round(wn, 6) AS tcp_window_mean, 0.0 AS ack_delay_mean, 0.0 AS inter_packet_gap_mean,
  round(CASE WHEN p_pay > 0 THEN pay ELSE 0 END, 6) AS payload_mean, 0.0 AS load_mean,
  round(p_ttl, 6) AS ttl_metrics_present, 1.0 AS transport_metrics_present,
  CAST(hour(make_timestamp(tmax * 1000)) AS DOUBLE) AS hour_of_day, CAST(isodow(make_timestamp(tmax * 1000)) AS DOUBLE) AS day_of_week,
  CASE WHEN isodow(make_timestamp(tmax * 1000)) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend,
  flow_count::DOUBLE AS flow_count, round(burstiness, 6) AS burstiness
FROM f JOIN base USING (app_id, window_bucket)"""))
def b29(spark, sf):
    return show(win.backend_windows(flow_view(spark, sf, dealt=True), WINDOW_MS), KEYS, BACKEND)


@query("b30_ablation", with_("windows", select="""
SELECT app_id, window_bucket, 0.0 AS flow_count, 0.0 AS byte_rate, 0.0 AS burstiness, 0.0 AS periodic_beacon_score,
  round(novelty_score, 6) AS novelty_score, round(port_diversity, 6) AS port_diversity FROM windows"""))
def b30(spark, sf):
    out = win.ablate(windows(spark, sf), ["volume", "timing"])
    return show(out, KEYS, ["flow_count", "byte_rate", "burstiness", "periodic_beacon_score",
                            "novelty_score", "port_diversity"])


def _log(c: str, source: str) -> str:
    return f"round(ln(1.0 + greatest(0.0, {source})), 6) AS {c}"


@query("b31_backend_features", with_("windows", "prep", select="""
SELECT app_id, window_bucket, """ + ", ".join(
    _log(c, {"bytes_out": "total_bytes_out", "bytes_in": "total_bytes_in"}.get(s, s))
    for c, s in win.LOG_FEATURES.items()) + ", " + rounded(win.PLAIN_FEATURES) + """,
  round(sin(2 * pi() * (CAST(floor(hour_of_day) AS INT) % 24) / 24), 6) AS hour_of_day_sin,
  round(cos(2 * pi() * (CAST(floor(hour_of_day) AS INT) % 24) / 24), 6) AS hour_of_day_cos,
  round(sin(2 * pi() * (CAST(floor(day_of_week) AS INT) % 7) / 7), 6) AS day_of_week_sin,
  round(cos(2 * pi() * (CAST(floor(day_of_week) AS INT) % 7) / 7), 6) AS day_of_week_cos,
  CASE WHEN is_weekend <> 0 THEN 1.0 ELSE 0.0 END AS is_weekend, round(1.0 - data_quality_score, 6) AS data_quality_penalty,
  round(ttl_gap, 6) AS ttl_gap_norm,
  CASE WHEN regexp_matches(site_hint, '[.](zip|mov|top|xyz|click)$') OR contains(site_hint, 'xn--') THEN 1.0 ELSE 0.0 END AS phishing_domain_pattern,
  CASE WHEN regexp_matches(site_hint, 'login-|verify-|secure-|update-|account-|auth-') THEN 1.0 ELSE 0.0 END AS credential_lure_pattern,
  CASE WHEN regexp_matches(site_hint, 'doubleclick|googlesyndication|googleadservices|tracking|telemetry|analytics') THEN 1.0 ELSE 0.0 END AS tracking_destination
FROM windows JOIN (SELECT app_id, window_bucket, min(dst_host) AS site_hint FROM prep GROUP BY ALL) USING (app_id, window_bucket)"""))
def b31(spark, sf):
    hint = win.bucketed(flow_view(spark, sf), WINDOW_MS).groupBy(*KEYS).agg(F.min("dst_host").alias("site_hint"))
    out = win.backend_features(windows(spark, sf).join(hint, KEYS))
    return show(out, KEYS, win.BACKEND_FEATURES)


@query("b32_insight_windows", with_("hosted", select="""
SELECT app_id, window_bucket, round(avg(greatest(look, CASE WHEN tag THEN 0.85 ELSE 0 END, CASE WHEN b_tld THEN 0.65 ELSE 0 END,
    CASE WHEN b_puny OR b_digit THEN 0.55 ELSE 0 END, 0.35 * conf)), 6) AS destination_risk_score,
  round(avg(look), 6) AS lookalike_score,
  round(avg(CASE WHEN look >= 0.55 OR b_puny OR b_digit OR b_tld OR tag THEN 1.0 ELSE 0.0 END), 6) AS suspicious_destination_ratio,
  1.0 AS known_identity_ratio, round(avg(CASE WHEN k % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) AS mitre_technique_ratio,
  round(avg(CASE WHEN tag THEN 1.0 ELSE 0.0 END), 6) AS threat_tag_ratio
FROM (SELECT *, (k % 4) / 4.0 AS look, k % 5 = 0 AS tag, (k % 3) / 2.0 AS conf FROM hosted) GROUP BY app_id, window_bucket"""))
def b32(spark, sf):
    rows = flow_view(spark, sf)
    tests = fl.host_tests("dst_host")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "lookalike_score": (F.col("k") % 4) / 4.0,
        "threat_tags": F.when(F.col("k") % 5 == 0, F.array(F.lit("tag"))).otherwise(none),
        "mitre_techniques": F.when(F.col("k") % 7 == 0, F.array(F.lit("T1566"))).otherwise(none),
        "confidence": (F.col("k") % 3) / 2.0,
        "punycode_present": tests["punycode"], "digit_substitution_present": tests["digit_substitution"],
        "suspicious_tld": tests["suspicious_tld"], "normalized_host": F.col("dst_host"),
        "registrable_domain": F.col("dst_host"),
    })
    return show(win.insight_window(rows, WINDOW_MS), KEYS, list(win.INSIGHT_MEANS.values()))
