"""Packets to flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.base import query
from netloom.catalog.sql import cte, with_
from netloom.functions.scalars import r6
from netloom.operators import assemble as asm
from netloom.sources.tables import flow_view, packet_view

HOUR = 3_600_000
IDLE, LIFE = 36 * HOUR, 24 * HOUR

cte("packets", ["flows"], """
SELECT flow_id AS packet_id, timestamp_end AS ts_ms, app_id, 'cap_' || u % 3 AS capture,
  CASE WHEN u % 3 <> 0 THEN 'TCP' ELSE 'UDP' END AS protocol, flow_id % 2 = 0 AS outbound,
  CASE WHEN flow_id % 2 = 0 THEN '10.0.0.' || u % 4 ELSE '93.184.216.' || k % 3 END AS src_ip,
  CASE WHEN flow_id % 2 = 0 THEN 40000 + u % 5 ELSE 443 END AS src_port,
  CASE WHEN flow_id % 2 = 1 THEN '10.0.0.' || u % 4 ELSE '93.184.216.' || k % 3 END AS dst_ip,
  CASE WHEN flow_id % 2 = 1 THEN 40000 + u % 5 ELSE 443 END AS dst_port,
  '10.0.0.' || u % 4 AS local_ip, 40000 + u % 5 AS local_port, '93.184.216.' || k % 3 AS remote_ip, 443 AS remote_port,
  bytes_out AS bytes, CASE WHEN flow_id % 4 <> 0 THEN k ELSE 0 END AS payload_bytes,
  CASE WHEN flow_id % 5 <> 0 THEN CASE WHEN flow_id % 2 = 0 THEN 64 ELSE k % 4 + 48 END END AS hop_limit,
  flow_id % 11 = 0 AS fragmented, flow_id % 6 = 0 AS syn, flow_id % 13 = 0 AS rst, flow_id % 2 = 1 AS ack,
  flow_id % 17 = 0 AS fin, flow_id % 3 = 0 AS psh, (flow_id % 16) * 1024 AS tcp_window,
  CASE WHEN k % 7 = 0 THEN 'h' || k % 5 || '.example.com' END AS host_hint,
  CASE WHEN k % 4 = 0 THEN 'www.Q' || k % 6 || '.example.net' END AS dns_query_name,
  CASE WHEN flow_id % 9 = 0 THEN '93.184.216.' || k % 3 WHEN flow_id % 10 = 0 THEN 'not-an-address' END AS dns_answer_value,
  CASE WHEN k % 5 = 0 THEN 'sni' || k % 3 || '.example.org' END AS tls_sni,
  CASE WHEN k % 6 = 0 THEN '' WHEN k % 8 = 0 THEN 'Web.Example.com' END AS http_host, k % 10 = 0 AS quic_detected
FROM flows JOIN (SELECT event_id, user_id AS u FROM events) ON event_id = flow_id
""")

FLOW_KEY = "least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '|' || greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port)"


@query("c01_canonical_key", with_("packets", select=f"SELECT packet_id, {FLOW_KEY} AS flow_key FROM packets"))
def c01(spark, sf):
    return asm.canonical_flow_key(packet_view(spark, sf)).select("packet_id", "flow_key")


LOCALS = """, ends AS (SELECT capture AS cap, ip, count(*) AS n FROM (SELECT capture, src_ip AS ip FROM packets UNION ALL SELECT capture, dst_ip FROM packets)
  WHERE starts_with(ip, '10.') GROUP BY ALL),
locals AS (SELECT cap, ip AS cap_ip FROM (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY n DESC, ip) AS rn FROM ends) WHERE rn = 1)"""


@query("c02_direction", with_("packets", select=LOCALS + """
SELECT packet_id, CASE WHEN src_ip = cap_ip THEN 1 WHEN dst_ip = cap_ip THEN 0 WHEN starts_with(src_ip, '10.') AND NOT starts_with(dst_ip, '10.') THEN 1
  WHEN starts_with(dst_ip, '10.') AND NOT starts_with(src_ip, '10.') THEN 0 ELSE 1 END AS outbound FROM packets JOIN locals ON capture = cap"""))
def c02(spark, sf):
    out = asm.infer_direction(packet_view(spark, sf).drop("outbound"))
    return out.select("packet_id", F.col("outbound").cast("int").alias("outbound"))


HOST = """regexp_replace(coalesce(nullif(lower(trim(tls_sni)), ''), nullif(lower(trim(http_host)), ''), nullif(lower(trim(dns_query_name)), '')), '^www\\.', '')"""


@query("c03_capture_flows", with_("packets", select=f"""
SELECT capture, app_id, local_ip, local_port, remote_ip, remote_port, protocol, min(ts_ms) AS start_ms, max(ts_ms) AS timestamp_end,
  CAST(sum(CASE WHEN outbound THEN bytes ELSE 0 END) AS BIGINT) AS bytes_out, CAST(sum(CASE WHEN outbound THEN 0 ELSE bytes END) AS BIGINT) AS bytes_in,
  count(*) FILTER (outbound) AS packets_out, count(*) FILTER (NOT outbound) AS packets_in,
  first(host ORDER BY ts_ms, packet_id) FILTER (host IS NOT NULL) AS site_hint
FROM (SELECT *, {HOST} AS host FROM packets) GROUP BY ALL"""))
def c03(spark, sf):
    p = packet_view(spark, sf).withColumn("host", asm.preferred_host("tls_sni", "http_host", "dns_query_name"))
    return asm.assemble_capture(p).drop("duration_ms", "dst_port", "destination_key")


@query("c04_preferred_host", with_("packets", select=f"SELECT packet_id, {HOST} AS host FROM packets"))
def c04(spark, sf):
    return packet_view(spark, sf).select("packet_id", asm.preferred_host("tls_sni", "http_host", "dns_query_name").alias("host"))


# The reference cut, packet by packet.
cte("keyed", ["packets"], f"""
SELECT *, row_number() OVER (PARTITION BY app_id, protocol, flow_key ORDER BY ts_ms, packet_id) AS rn FROM (SELECT *, {FLOW_KEY} AS flow_key FROM packets)
""")
cte("walk", ["keyed"], f"""
SELECT app_id, protocol, flow_key, rn, packet_id, ts_ms AS last, ts_ms AS start, 1 AS n FROM keyed WHERE rn = 1
UNION ALL
SELECT k.app_id, k.protocol, k.flow_key, k.rn, k.packet_id, k.ts_ms,
  CASE WHEN k.ts_ms >= w.start + {LIFE} OR k.ts_ms >= w.last + {IDLE} THEN k.ts_ms ELSE w.start END,
  CASE WHEN k.ts_ms >= w.start + {LIFE} OR k.ts_ms >= w.last + {IDLE} THEN w.n + 1 ELSE w.n END
FROM walk w JOIN keyed k ON k.app_id = w.app_id AND k.protocol = w.protocol AND k.flow_key = w.flow_key AND k.rn = w.rn + 1
""")


def cut(spark, sf):
    return asm.cut_flows(asm.canonical_flow_key(packet_view(spark, sf)), IDLE, LIFE)


@query("c05_timed_flows", with_("walk", recursive=True, select="""
SELECT app_id, protocol, flow_key, min(packet_id) AS first_packet, count(*) AS packets, max(last) - min(start) AS duration FROM walk GROUP BY app_id, protocol, flow_key, n"""))
def c05(spark, sf):
    return cut(spark, sf).groupBy(*asm.KEY, "flow_no").agg(
        F.min("packet_id").alias("first_packet"), F.count(F.lit(1)).alias("packets"),
        (F.max("ts_ms") - F.min("ts_ms")).alias("duration")).drop("flow_no")


STEPPED = """, j AS (SELECT k.*, w.n FROM keyed k JOIN walk w USING (app_id, protocol, flow_key, rn)),
s AS (SELECT *, CASE WHEN ts_ms > lag(ts_ms) OVER o THEN ts_ms - lag(ts_ms) OVER o END AS gap_ms,
    CASE WHEN protocol = 'TCP' AND ack THEN ts_ms - max(CASE WHEN payload_bytes > 0 THEN ts_ms END) OVER p END AS ack_delay_ms
  FROM j WINDOW o AS (PARTITION BY app_id, protocol, flow_key, n ORDER BY ts_ms, packet_id),
    p AS (PARTITION BY app_id, protocol, flow_key, n ORDER BY ts_ms, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT app_id, protocol, flow_key, n, min(packet_id) AS first_packet, min(ts_ms) AS timestamp_start, max(ts_ms) AS timestamp_end,
    sum(bytes) AS total, count(*) FILTER (outbound) AS packets_out, first(host_hint ORDER BY ts_ms, packet_id) FILTER (host_hint IS NOT NULL) AS site_hint,
    first(remote_ip ORDER BY ts_ms, packet_id) AS remote_ip,
    coalesce(abs(avg(hop_limit) FILTER (outbound) - avg(hop_limit) FILTER (NOT outbound)) / 255.0, 0) AS ttl_gap,
    count(*) FILTER (protocol = 'TCP' AND syn) / greatest(1, count(*) FILTER (protocol = 'TCP'))::DOUBLE AS syn_rate_total,
    count(*) FILTER (protocol = 'TCP' AND ack) / greatest(1, count(*) FILTER (protocol = 'TCP'))::DOUBLE AS ack_rate_total,
    avg(CASE WHEN fragmented THEN 1 ELSE 0 END) AS fragment_rate_total,
    coalesce(avg(tcp_window) FILTER (protocol = 'TCP'), 0) AS tcp_window_mean, coalesce(avg(ack_delay_ms), 0) AS ack_delay_mean,
    coalesce(avg(gap_ms), 0) AS inter_packet_gap_mean, coalesce(avg(payload_bytes) FILTER (payload_bytes > 0), 0) AS payload_mean,
    first(tls_sni ORDER BY ts_ms, packet_id) FILTER (tls_sni IS NOT NULL) AS tls_sni,
    first(nullif(http_host, '') ORDER BY ts_ms, packet_id) FILTER (nullif(http_host, '') IS NOT NULL) AS http_host,
    max(CASE WHEN quic_detected THEN 1 ELSE 0 END) AS quic
  FROM s GROUP BY app_id, protocol, flow_key, n)"""


def finished(spark, sf):
    return asm.finalize_flows(cut(spark, sf))


@query("c06_flow_metrics", with_("walk", recursive=True, select=STEPPED + """
SELECT app_id, protocol, flow_key, timestamp_start, timestamp_end, packets_out, site_hint, round(ttl_gap, 6) AS ttl_gap,
  round(syn_rate_total, 6) AS syn_rate_total, round(ack_rate_total, 6) AS ack_rate_total, round(fragment_rate_total, 6) AS fragment_rate_total,
  round(tcp_window_mean, 6) AS tcp_window_mean, round(payload_mean, 6) AS payload_mean,
  round(total / (greatest(1, timestamp_end - timestamp_start) / 1000.0::DOUBLE), 6) AS load_mean FROM g"""))
def c06(spark, sf):
    return finished(spark, sf).select(*asm.KEY, "timestamp_start", "timestamp_end", "packets_out", "site_hint", *[
        r6(c).alias(c) for c in ("ttl_gap", "syn_rate_total", "ack_rate_total", "fragment_rate_total",
                                 "tcp_window_mean", "payload_mean", "load_mean")])


@query("c07_packet_gaps", with_("walk", recursive=True, select=STEPPED + """
SELECT app_id, protocol, flow_key, timestamp_start, round(inter_packet_gap_mean, 6) AS inter_packet_gap_mean FROM g"""))
def c07(spark, sf):
    return finished(spark, sf).select(*asm.KEY, "timestamp_start", r6("inter_packet_gap_mean").alias("inter_packet_gap_mean"))


@query("c08_ack_delay", with_("walk", recursive=True, select=STEPPED + """
SELECT app_id, protocol, flow_key, timestamp_start, round(ack_delay_mean, 6) AS ack_delay_mean FROM g"""))
def c08(spark, sf):
    return finished(spark, sf).select(*asm.KEY, "timestamp_start", r6("ack_delay_mean").alias("ack_delay_mean"))


@query("c09_evidence_merge", with_("walk", recursive=True, select=STEPPED + """
SELECT app_id, protocol, flow_key, timestamp_start, tls_sni, http_host, quic FROM g"""))
def c09(spark, sf):
    return finished(spark, sf).select(*asm.KEY, "timestamp_start", "tls_sni", "http_host",
                                      F.col("quic_detected").cast("int").alias("quic"))


@query("c10_flow_novelty", with_("walk", recursive=True, select=STEPPED + """
SELECT app_id, destination, count(*) AS flows, CAST(sum(nov) AS DOUBLE) AS novel, min(timestamp_end) FILTER (nov = 1) AS first_end FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY app_id, destination ORDER BY timestamp_end, timestamp_start, flow_key) = 1 THEN 1 ELSE 0 END AS nov
  FROM (SELECT *, coalesce(site_hint, remote_ip) || ':443' AS destination FROM g)) GROUP BY app_id, destination"""))
def c10(spark, sf):
    out = asm.flow_novelty(finished(spark, sf))
    return out.groupBy("app_id", "destination").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("dst_novelty").alias("novel"),
        F.min(F.when(F.col("dst_novelty") == 1, F.col("timestamp_end"))).alias("first_end"))


@query("c11_force_flush", with_("packets", select="""
SELECT count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM packets"""))
def c11(spark, sf):
    out = asm.assemble_flows(packet_view(spark, sf), IDLE, LIFE)
    return out.agg(F.sum(F.col("packets_out") + F.col("packets_in")).alias("packets"),
                   F.sum(F.col("bytes_out") + F.col("bytes_in")).alias("bytes"))


@query("c12_dns_enrich", with_("packets", select="""
, ans AS (SELECT dns_answer_value AS ip, ts_ms, packet_id, dns_query_name AS name FROM packets
  WHERE dns_query_name IS NOT NULL AND regexp_matches(dns_answer_value, '^[0-9]{1,3}([.][0-9]{1,3}){3}$'))
SELECT packet_id, dns_host, coalesce(host_hint, nullif(http_host, ''), tls_sni, dns_query_name, dns_host) AS resolved_host FROM (
  SELECT p.*, (SELECT name FROM ans a WHERE a.ip = p.dst_ip AND (a.ts_ms < p.ts_ms OR (a.ts_ms = p.ts_ms AND a.packet_id < p.packet_id))
    ORDER BY a.ts_ms DESC, a.packet_id DESC LIMIT 1) AS dns_host FROM packets p)"""))
def c12(spark, sf):
    p = packet_view(spark, sf).withColumn("site_hint", F.col("host_hint"))
    return asm.dns_enrich(p, "ts_ms", "packet_id").select("packet_id", "dns_host", "resolved_host")


@query("c13_key_totals", with_("packets", select=f"""
SELECT {FLOW_KEY} AS flow_key, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT app_id) AS apps,
  min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM packets GROUP BY 1"""))
def c13(spark, sf):
    """Both directions of a conversation add up under one canonical key."""
    p = asm.canonical_flow_key(packet_view(spark, sf))
    return p.groupBy("flow_key").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"), F.countDistinct("app_id").alias("apps"),
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
