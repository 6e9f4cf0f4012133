"""Common table expressions in DuckDB SQL, written apart from the Spark operators."""

from __future__ import annotations

WINDOW_MS = 21_600_000  # six hours: the test events are sparse

CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (body, needs)


def with_(*names: str, select: str, recursive: bool = False) -> str:
    """WITH clause holding the named tables and what they need, then the query."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for need in CTES[n][1]:
            visit(need)
        order.append(n)

    for n in names:
        visit(n)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + select


cte("flows", [], """
SELECT event_id AS flow_id, epoch_us(ts) // 1000 AS timestamp_end, k,
  ['com.android.chrome','service:tcp:10.0.0.1:443','uid:1000','com.analytics.sdk',
   'org.openvpn.client','com.whatsapp','com.sensor.daemon','com.spyware.rat',
   'com.example.shop','com.example.bank'][u % 10 + 1] AS app_id,
  CAST(floor(value * 100) AS BIGINT) AS bytes_out, k * 37 AS bytes_in,
  event_id % 5 + 1 AS packets_out, event_id % 7 AS packets_in, (event_id * 13) % 5000 AS duration_ms,
  CAST([53,80,443,8443,8080,51820][k % 6 + 1] AS BIGINT) AS dst_port,
  CASE WHEN event_id % 3 <> 0 THEN 'TCP' ELSE 'UDP' END AS protocol,
  ['10.0.0.5','g00gle.xyz','xn--pple-43d.com','224.0.0.251','cdn.example.com',
   'a.b.c.d.example.net','paypa1.com','93.184.216.34'][k % 8 + 1] AS dst_host,
  dst_host || ':' || dst_port AS destination_key,
  CASE WHEN (event_id * 7) % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dst_novelty,
  CASE WHEN event_type = 'error' AND value > 40 THEN 1 ELSE 0 END AS label,
  'src_' || u % 3 AS dataset_source, 'prof_' || u % 2 AS dataset_profile,
  'var_' || k % 4 AS dataset_variant, 'env_' || event_id % 3 AS environment_id,
  's_' || u % 7 AS session_id, 'dev_' || u % 20 AS device_id,
  64.0::DOUBLE AS sttl, 32.0::DOUBLE + (k % 5) * 16 AS rttl,
  CAST(event_id % 2 AS DOUBLE) AS has_ttl_metrics,
  CASE WHEN event_id % 4 <> 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_tcp_flag_metrics,
  0.0::DOUBLE AS has_fragment_metrics, 1.0::DOUBLE AS has_window_metrics,
  CASE WHEN event_id % 8 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_payload_metrics,
  (event_id % 4) / 4.0::DOUBLE AS s_syn_rate, (k % 2) / 2.0::DOUBLE AS r_syn_rate,
  (event_id % 8) / 8.0::DOUBLE AS s_ack_rate, (k % 4) / 4.0::DOUBLE AS r_ack_rate,
  (event_id % 2) / 2.0::DOUBLE AS s_psh_rate,
  (event_id % 16) * 1024.0::DOUBLE AS s_win_tcp, (k % 8) * 512.0::DOUBLE AS r_win_tcp,
  k * 2.0::DOUBLE AS s_payload_avg, CAST(event_id % 32 AS DOUBLE) AS r_payload_avg,
  k / 4.0::DOUBLE AS s_inter_packet_avg, CAST(event_id % 64 AS DOUBLE) AS s_load
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id AS u FROM events)
""")

cte("prep", ["flows"], """
SELECT *,
  bytes_out + bytes_in AS total_bytes,
  CAST(hour(make_timestamp(timestamp_end * 1000)) AS DOUBLE) AS hour_of_day,
  CAST(isodow(make_timestamp(timestamp_end * 1000)) AS DOUBLE) AS day_of_week,
  CASE WHEN isodow(make_timestamp(timestamp_end * 1000)) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend,
  1.0::DOUBLE AS data_quality_score,
  CASE WHEN has_ttl_metrics > 0 THEN least(1.0, abs(sttl - rttl) / 255.0) ELSE 0.0::DOUBLE END AS ttl_gap,
  has_ttl_metrics AS ttl_metrics_present,
  s_syn_rate + r_syn_rate AS syn_rate_total, 0.0::DOUBLE AS rst_rate_total,
  s_ack_rate + r_ack_rate AS ack_rate_total, 0.0::DOUBLE AS fin_rate_total,
  s_psh_rate AS psh_rate_total, 0.0::DOUBLE AS fragment_rate_total,
  (s_win_tcp + r_win_tcp) * 0.5 AS tcp_window_mean, 0.0::DOUBLE AS ack_delay_mean,
  s_inter_packet_avg * 0.5 AS inter_packet_gap_mean, (s_payload_avg + r_payload_avg) * 0.5 AS payload_mean,
  s_load * 0.5 AS load_mean, 1.0::DOUBLE AS transport_metrics_present,
  CASE WHEN dst_port IN (53, 853) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dns_flow,
  CASE WHEN dst_port IN (80, 443, 8000, 8080, 8443) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS web_flow,
  CASE WHEN dst_port >= 1024 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS high_port,
  CASE WHEN bytes_out + bytes_in <= 256 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS small_flow,
  CASE WHEN starts_with(dst_host, '10.') OR starts_with(dst_host, '192.168.')
         OR regexp_matches(dst_host, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') OR dst_host IN ('127.0.0.1', '::1')
         OR starts_with(dst_host, 'fc') OR starts_with(dst_host, 'fd') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS private_destination,
  CASE WHEN coalesce(TRY_CAST(split_part(dst_host, '.', 1) AS INTEGER) BETWEEN 224 AND 239, FALSE)
         OR starts_with(dst_host, 'ff') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS multicast_destination,
  timestamp_end // 21600000 AS window_bucket
FROM flows
""")

cte("hosted", ["prep"], """
SELECT *,
  CASE WHEN b_tld OR b_puny OR b_digit OR b_long OR b_labels THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS suspicious_destination,
  least(1.0, (CASE WHEN b_digit THEN 0.45 ELSE 0 END) + (CASE WHEN b_puny THEN 0.35 ELSE 0 END))::DOUBLE AS lookalike_score_flow,
  greatest(least(1.0, (CASE WHEN b_digit THEN 0.45 ELSE 0 END) + (CASE WHEN b_puny THEN 0.35 ELSE 0 END)),
    CASE WHEN b_tld THEN 0.65 ELSE 0 END, CASE WHEN b_puny THEN 0.55 ELSE 0 END,
    CASE WHEN b_digit THEN 0.45 ELSE 0 END, CASE WHEN b_long THEN 0.30 ELSE 0 END,
    CASE WHEN b_labels THEN 0.25 ELSE 0 END)::DOUBLE AS destination_risk,
  CASE WHEN regexp_matches(dst_host, '[a-z]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS known_identity,
  0.0::DOUBLE AS mitre_technique_flow, 0.0::DOUBLE AS threat_tag_flow
FROM (SELECT *,
  regexp_matches(dst_host, '\\.(xyz|top|club|click|work|icu|tk|gq|ml|cf)$') AS b_tld,
  contains(dst_host, 'xn--') AS b_puny,
  regexp_matches(dst_host, '[a-z][0-9][a-z]|[0-9][a-z][0-9]') AS b_digit,
  length(dst_host) >= 32 AS b_long,
  length(dst_host) - length(replace(dst_host, '.', '')) >= 4 AS b_labels
  FROM prep)
""")

cte("stepped", ["hosted"], """
SELECT *,
  lag(destination_key) OVER w AS prev_dest,
  (timestamp_end - lag(timestamp_end) OVER w) / 1000.0::DOUBLE AS delta,
  avg(total_bytes) OVER (PARTITION BY app_id, window_bucket) AS mean_bytes
FROM hosted
WINDOW w AS (PARTITION BY app_id, window_bucket ORDER BY timestamp_end, flow_id)
""")

FAMILY = """CASE
  WHEN {n} LIKE 'service\\_%' ESCAPE '\\' THEN 'service'
  WHEN {n} LIKE 'uid\\_%' ESCAPE '\\' THEN 'system'
  WHEN regexp_matches({n}, 'chrome|firefox|browser|opera|edge|safari|duckduckgo|brave') THEN 'browser'
  WHEN regexp_matches({n}, 'analytics|telemetry|doubleclick|googleads|scorecardresearch|tracking') THEN 'telemetry'
  WHEN regexp_matches({n}, 'vpn|ssh|rdp|teamviewer|anydesk|openvpn|ipsec|l2tp') THEN 'remote_access'
  WHEN regexp_matches({n}, 'gmail|outlook|telegram|whatsapp|fbmessenger|facebook|instagram|snapchat|twitter|tiktok|spotify|netflix|youtube') THEN 'consumer_app'
  WHEN regexp_matches({n}, 'android|systemui|gms|play_services|packageinstaller') THEN 'system'
  WHEN regexp_matches({n}, 'background|daemon|worker|sensor|watersensor|temp_humidity') THEN 'background'
  WHEN regexp_matches({n}, 'spy|rat|mal|phish|attack|anomaly|bot') THEN 'malware'
  ELSE 'other_app' END"""


def family(app: str) -> str:
    n = f"trim(regexp_replace(lower(trim({app})), '[^a-z0-9]+', '_', 'g'), '_')"
    return FAMILY.format(n=n)


cte("base", ["stepped"], """
SELECT app_id, window_bucket, window_bucket * 21600000 AS window_start_ms,
  (window_bucket + 1) * 21600000 AS window_end_ms,
  """ + family("app_id") + """ AS app_family,
  count(*) AS flow_count, CAST(sum(bytes_out) AS DOUBLE) AS total_bytes_out,
  CAST(sum(bytes_in) AS DOUBLE) AS total_bytes_in,
  CAST(sum(total_bytes) AS DOUBLE) / greatest(1, sum(packets_out + packets_in)) AS mean_packet_size,
  sum(bytes_out) / (sum(total_bytes) + 1.0::DOUBLE) AS outbound_ratio,
  least(4.0, coalesce((sum(abs(total_bytes - mean_bytes)) / count(*)) / nullif(sum(total_bytes) / count(*)::DOUBLE, 0), 0)) AS burstiness,
  avg(dst_novelty) AS novelty_score,
  ln(1.0 + count(*) / 21600.0::DOUBLE) AS connection_frequency_delta,
  sum(total_bytes) / count(*)::DOUBLE AS bytes_per_flow,
  count(DISTINCT destination_key) / count(*)::DOUBLE AS destination_diversity,
  least(1.0, sum(duration_ms) / 21600000.0::DOUBLE) AS activity_ratio,
  CASE WHEN count(delta) >= 3 THEN coalesce(greatest(0.0, least(1.0, 1.0 - stddev_pop(delta) / nullif(avg(delta), 0))), 0.0) ELSE 0.0::DOUBLE END AS periodic_beacon_score,
  sum(total_bytes) / 21600.0::DOUBLE AS byte_rate,
  sum(packets_out + packets_in) / 21600.0::DOUBLE AS packet_rate,
  avg(duration_ms) AS mean_duration_ms,
  stddev_pop(duration_ms) AS duration_jitter,
  count(DISTINCT dst_port) / count(*)::DOUBLE AS port_diversity,
  count(DISTINCT protocol) / count(*)::DOUBLE AS protocol_diversity,
  abs(sum(packets_out) - sum(packets_in)) / (sum(packets_out + packets_in) + 1.0::DOUBLE) AS packet_imbalance,
  avg(small_flow) AS small_flow_ratio, avg(high_port) AS high_port_ratio,
  avg(hour_of_day) AS hour_of_day, avg(day_of_week) AS day_of_week, avg(is_weekend) AS is_weekend,
  avg(data_quality_score) AS data_quality_score, avg(ttl_gap) AS ttl_gap,
  avg(ttl_metrics_present) AS ttl_metrics_present, avg(syn_rate_total) AS syn_rate_total,
  avg(rst_rate_total) AS rst_rate_total, avg(ack_rate_total) AS ack_rate_total,
  avg(fin_rate_total) AS fin_rate_total, avg(psh_rate_total) AS psh_rate_total,
  avg(fragment_rate_total) AS fragment_rate_total, avg(tcp_window_mean) AS tcp_window_mean,
  avg(ack_delay_mean) AS ack_delay_mean, avg(inter_packet_gap_mean) AS inter_packet_gap_mean,
  avg(payload_mean) AS payload_mean, avg(load_mean) AS load_mean,
  avg(transport_metrics_present) AS transport_metrics_present,
  coalesce(sum(CASE WHEN prev_dest <> destination_key THEN 1 ELSE 0 END), 0) / greatest(1, count(*) - 1)::DOUBLE AS destination_transition_rate,
  avg(dns_flow) AS dns_flow_ratio, avg(web_flow) AS web_flow_ratio,
  avg(private_destination) AS private_destination_ratio, avg(multicast_destination) AS multicast_destination_ratio,
  avg(destination_risk) AS destination_risk_score, avg(lookalike_score_flow) AS lookalike_score,
  avg(suspicious_destination) AS suspicious_destination_ratio, avg(known_identity) AS known_identity_ratio,
  avg(mitre_technique_flow) AS mitre_technique_ratio, avg(threat_tag_flow) AS threat_tag_ratio,
  count(DISTINCT protocol || ':' || dst_port) / count(*)::DOUBLE AS protocol_port_profile_diversity,
  quantile_cont(total_bytes, 0.75) - quantile_cont(total_bytes, 0.25) AS flow_size_iqr,
  max(label) AS label
FROM stepped GROUP BY app_id, window_bucket
""")

cte("top_dest", ["prep"], """
SELECT app_id, window_bucket, max(n) AS top_n, sum(n) AS all_n FROM (
  SELECT app_id, window_bucket, destination_key, count(*) AS n FROM prep GROUP BY ALL) GROUP BY app_id, window_bucket
""")

cte("entropy", ["stepped"], """
SELECT app_id, window_bucket,
  CASE WHEN count(*) > 1 THEN -sum((n / total) * ln(n / total)) / ln(count(*)) ELSE 0.0::DOUBLE END AS transition_entropy
FROM (SELECT app_id, window_bucket, n::DOUBLE AS n, sum(n) OVER (PARTITION BY app_id, window_bucket)::DOUBLE AS total
  FROM (SELECT app_id, window_bucket, prev_dest || '->' || destination_key AS step, count(*) AS n
        FROM stepped WHERE prev_dest IS NOT NULL GROUP BY ALL))
GROUP BY app_id, window_bucket
""")


def dominant(column: str) -> str:
    return f"""(SELECT app_id, window_bucket, {column} FROM (
      SELECT *, row_number() OVER (PARTITION BY app_id, window_bucket ORDER BY n DESC, {column}) AS rn
      FROM (SELECT app_id, window_bucket, {column}, count(*) AS n FROM prep GROUP BY ALL)) WHERE rn = 1)"""


cte("win", ["base", "top_dest", "entropy", "prep"], f"""
SELECT b.*, t.top_n / b.flow_count::DOUBLE AS destination_concentration,
  coalesce(e.transition_entropy, 0.0) AS destination_transition_entropy,
  d1.dataset_source, d2.dataset_profile, d3.dataset_variant, d4.environment_id, d5.session_id
FROM base b JOIN top_dest t USING (app_id, window_bucket)
LEFT JOIN entropy e USING (app_id, window_bucket)
JOIN {dominant('dataset_source')} d1 USING (app_id, window_bucket)
JOIN {dominant('dataset_profile')} d2 USING (app_id, window_bucket)
JOIN {dominant('dataset_variant')} d3 USING (app_id, window_bucket)
JOIN {dominant('environment_id')} d4 USING (app_id, window_bucket)
JOIN {dominant('session_id')} d5 USING (app_id, window_bucket)
""")

cte("rolled0", ["win"], """
SELECT *,
  coalesce(abs(flow_count - m_fc) / (abs(m_fc) + 1.0), 0.0) AS flow_count_deviation,
  coalesce(abs(byte_rate - m_br) / (abs(m_br) + 1.0), 0.0) AS byte_rate_deviation,
  coalesce(abs(destination_diversity - m_dd), 0.0) AS destination_diversity_shift,
  coalesce(abs(novelty_score - m_nv), 0.0) AS novelty_shift,
  coalesce(m_fc, 0.0) AS recent_flow_count_mean, coalesce(m_br, 0.0) AS recent_byte_rate_mean,
  coalesce(m_nv, 0.0) AS recent_novelty_mean,
  greatest(-10.0, least(10.0, coalesce((flow_count - l_fc) / (abs(l_fc) + 1.0::DOUBLE), 0.0))) AS flow_count_trend,
  greatest(-10.0, least(10.0, coalesce((byte_rate - l_br) / (abs(l_br) + 1.0), 0.0))) AS byte_rate_trend,
  greatest(-1.0, least(1.0, coalesce(novelty_score - l_nv, 0.0))) AS novelty_trend,
  greatest(-1.0, least(1.0, coalesce(destination_diversity - l_dd, 0.0))) AS destination_diversity_trend,
  CASE WHEN byte_rate <= 128 THEN periodic_beacon_score ELSE 0.0::DOUBLE END AS low_volume_periodic_score
FROM (SELECT *, avg(flow_count) OVER p AS m_fc, avg(byte_rate) OVER p AS m_br,
    avg(destination_diversity) OVER p AS m_dd, avg(novelty_score) OVER p AS m_nv,
    lag(flow_count, 3) OVER w AS l_fc, lag(byte_rate, 3) OVER w AS l_br,
    lag(novelty_score, 3) OVER w AS l_nv, lag(destination_diversity, 3) OVER w AS l_dd
  FROM win WINDOW w AS (PARTITION BY app_id ORDER BY window_end_ms),
    p AS (PARTITION BY app_id ORDER BY window_end_ms ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
""")

cte("windows", ["rolled0"], """
SELECT * EXCLUDE (m_fc, m_br, m_dd, m_nv, l_fc, l_br, l_nv, l_dd),
  CAST(sum(CASE WHEN flow_count_deviation >= 0.4 OR byte_rate_deviation >= 0.4 THEN 1 ELSE 0 END)
    OVER (PARTITION BY app_id ORDER BY window_end_ms ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS consecutive_burst_windows
FROM rolled0
""")


def rounded(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)
