"""Scans, normalization, metadata and sinks."""

from __future__ import annotations


from pyspark.sql import functions as F

from netloom.catalog.base import query
from netloom.catalog.sql import cte, family, with_
from netloom.functions.scalars import r6
from netloom.operators import metadata as md
from netloom.operators import normalize as nm
from netloom.session import shared_dir
from netloom.sources import readers, writers
from netloom.sources.tables import flow_view, table


def stored(df, fmt: str, **options) -> str:
    """Write a table in some format to the shared folder, for the scan under test to read."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/netloom-{fmt}-{uuid.uuid4().hex}"
    writer = df.write
    for k, v in options.items():
        writer = writer.option(k, v)
    getattr(writer, "csv" if fmt in ("csv", "tsv") else fmt)(path)
    return path


SMALL = ["flow_id", "app_id", "timestamp_end", "bytes_out", "bytes_in", "protocol"]
SMALL_SQL = with_("flows", select="SELECT flow_id, app_id, timestamp_end, bytes_out, bytes_in, protocol FROM flows")


@query("a01_read_csv", SMALL_SQL)
def a01(spark, sf):
    path = stored(flow_view(spark, sf).select(*SMALL), "csv", header="true")
    raw = readers.read_flows(spark, path, "csv")
    return raw.select(*[F.col(c).try_cast("long").alias(c) if c not in ("app_id", "protocol") else F.col(c) for c in SMALL])


@query("a01_read_tsv", SMALL_SQL)
def a01_tsv(spark, sf):
    path = stored(flow_view(spark, sf).select(*SMALL), "tsv", header="true", sep="\t")
    raw = readers.read_flows(spark, path, "tsv")
    return raw.select(*[F.col(c).try_cast("long").alias(c) if c not in ("app_id", "protocol") else F.col(c) for c in SMALL])


@query("a02_read_parquet", "SELECT event_id, user_id, event_type FROM events")
def a02(spark, sf):
    return readers.read_flows(spark, f"{sf}/events.parquet", "parquet").select("event_id", "user_id", "event_type")


@query("a03_read_records", with_("flows", select="SELECT flow_id, app_id FROM flows"))
def a03(spark, sf):
    # One document per file with the rows under "alerts".
    docs = flow_view(spark, sf).groupBy((F.col("flow_id") % 16).alias("part")).agg(
        F.collect_list(F.struct("flow_id", "app_id")).alias("alerts")).drop("part")
    return readers.read_records(spark, stored(docs, "json"), multi_line=False).select("flow_id", "app_id")


@query("a04_recursive_scan", with_("flows", select="SELECT dataset_source AS folder, count(*) AS rows FROM flows GROUP BY 1"))
def a04(spark, sf):
    import uuid

    path = f"{shared_dir(spark)}/netloom-tree-{uuid.uuid4().hex}"
    flow_view(spark, sf).select(*SMALL, "dataset_source").write.partitionBy("dataset_source").option("header", "true").csv(path)
    got = readers.read_flows(spark, path, "csv", recursive=True, pattern="*.csv")
    return got.groupBy(F.regexp_extract("source_path", "dataset_source=([^/]+)/", 1).alias("folder")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("a05_canonical_columns", with_("flows", select="SELECT flow_id, bytes_out AS total_fwd_bytes, dst_port AS dst_port FROM flows"))
def a05(spark, sf):
    f = flow_view(spark, sf).select(F.col("flow_id").alias(" Flow ID "), F.col("bytes_out").alias("Total Fwd--Bytes"),
                                    F.col("dst_port").alias("DST.Port#"))
    return nm.canonicalize_columns(f)


def raw_table(spark, sf):
    """A raw table with foreign names, text times, text labels and a total instead of directions."""
    f = flow_view(spark, sf)
    k = F.col("k")
    return f.select(
        F.col("flow_id"), F.date_format(F.timestamp_millis("timestamp_end"), "yyyy-MM-dd HH:mm:ss.SSS").alias("Time"),
        F.when(k % 9 == 0, F.lit(" ")).otherwise(F.col("app_id")).alias("Application Name"),
        (F.col("bytes_out") + F.col("bytes_in")).cast("string").alias("Tot Bytes"),
        F.col("packets_out").alias("Tot Fwd Pkts"), F.col("packets_in").alias("Tot Bwd Pkts"),
        F.when(k % 4 == 0, "6").when(k % 4 == 1, "17").when(k % 4 == 2, " http/2 ").otherwise("").alias("Proto"),
        F.when(k % 8 == 0, F.lit("")).otherwise(F.col("dst_host")).alias("Server Name"),
        F.concat(F.lit("10.1.0."), (k % 7).cast("string")).alias("dst_ip"), F.col("dst_port").cast("string").alias("DstPort"),
        F.when(F.col("label") == 1, "Malware attack").when(k % 2 == 0, "Benign scan").otherwise("other").alias("Class"),
        (F.col("duration_ms") / 100.0).alias("Duration"), (k * 2.5).cast("string").alias("src_load"), F.lit("x").alias("sttl"))


cte("raw", ["flows"], """
SELECT *, CASE WHEN k % 9 = 0 THEN 'unknown_app' ELSE app_id END AS r_app,
  CASE k % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'HTTP_2' ELSE 'UNKNOWN' END AS r_proto,
  CASE WHEN k % 8 = 0 THEN '10.1.0.' || k % 7 ELSE dst_host END || ':' || dst_port AS r_dest,
  CASE WHEN label = 1 THEN 1 ELSE 0 END AS r_label, (bytes_out + bytes_in) * 0.5::DOUBLE AS half FROM flows
""")


@query("a06_resolve_aliases", with_("raw", select="""
SELECT flow_id, r_app AS app_id, bytes_out + bytes_in AS bytes_total, packets_out, dst_port FROM raw"""))
def a06(spark, sf):
    out, mapping = nm.resolve_aliases(nm.canonicalize_columns(raw_table(spark, sf)), "generic_flow")
    assert mapping["app_id"] == "application_name" and mapping["bytes_out"] is None
    return out.select("flow_id", F.coalesce(F.nullif(F.trim("app_id"), F.lit("")), F.lit("unknown_app")).alias("app_id"),
                      F.col("bytes_total").cast("long").alias("bytes_total"), "packets_out", F.col("dst_port").cast("long").alias("dst_port"))


@query("a07_time_coercion", with_("flows", select="""
SELECT flow_id, timestamp_end AS from_text, CAST(round_even(timestamp_end / 1000.0::DOUBLE * 1000, 0) AS BIGINT) AS from_seconds, timestamp_end AS from_millis FROM flows"""))
def a07(spark, sf):
    f = flow_view(spark, sf).withColumns({
        "a": F.date_format(F.timestamp_millis("timestamp_end"), "yyyy-MM-dd HH:mm:ss.SSS"),
        "b": (F.col("timestamp_end") / 1000.0).cast("string"), "c": F.col("timestamp_end").cast("string")})
    for source, name in (("a", "from_text"), ("b", "from_seconds"), ("c", "from_millis")):
        f = nm.to_epoch_ms(f, source, name)
    return f.select("flow_id", "from_text", "from_seconds", "from_millis")


@query("a08_duration_unit", with_("flows", select="""
SELECT flow_id, round(duration_ms / 100.0::DOUBLE * 1000, 6) AS seconds, round(duration_ms::DOUBLE, 6) AS millis FROM flows"""))
def a08(spark, sf):
    f = flow_view(spark, sf).withColumns({"a": F.col("duration_ms") / 100.0, "b": F.col("duration_ms").cast("double")})
    f = nm.fix_duration(nm.fix_duration(f, "duration", "a"), "duration_ms", "b")
    return f.select("flow_id", r6("a").alias("seconds"), r6("b").alias("millis"))


@query("a09_protocol", with_("raw", select="SELECT flow_id, r_proto AS protocol, CASE k % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN CASE WHEN k % 3 = 0 THEN 'TCP' ELSE 'HTTP-2' END ELSE CASE WHEN k % 3 = 0 THEN 'TCP' ELSE 'UNKNOWN' END END AS capture FROM raw"))
def a09(spark, sf):
    r = raw_table(spark, sf).join(flow_view(spark, sf).select("flow_id", "k"), "flow_id")
    number = F.when(F.col("k") % 4 == 0, "6").when(F.col("k") % 4 == 1, "17").when(F.col("k") % 3 == 0, "6").otherwise("")
    shown = F.when(F.col("k") % 4 == 2, F.lit("http/2")).otherwise("")
    return r.select("flow_id", nm.normalize_protocol("Proto").alias("protocol"),
                    nm.capture_protocol(shown, number).alias("capture"))


@query("a10_dst_novelty", with_("flows", select="""
SELECT flow_id, CASE WHEN row_number() OVER (PARTITION BY app_id, destination_key ORDER BY timestamp_end, flow_id) = 1 THEN 1.0 ELSE 0.0 END AS dst_novelty FROM flows"""))
def a10(spark, sf):
    return nm.dst_novelty(flow_view(spark, sf).drop("dst_novelty")).select("flow_id", "dst_novelty")


@query("a11_label", with_("raw", select="SELECT flow_id, r_label AS worded, CASE WHEN k % 10 = 0 THEN 0 ELSE least(1, k % 3) END AS numeric FROM raw"))
def a11(spark, sf):
    r = raw_table(spark, sf).join(flow_view(spark, sf).select("flow_id", "k"), "flow_id")
    r = r.withColumn("n", F.when(F.col("k") % 10 == 0, "?").otherwise((F.col("k") % 3).cast("string")))
    return nm.normalize_label(nm.normalize_label(r, "Class", "worded"), "n", "numeric").select("flow_id", "worded", "numeric")


PATHS = ["/data/Benign/run_1.csv", "/x/real/Adware-Set/CICAndMal2017 a.csv", "/corp/westermo/Site B.csv", "/p/parrot/app one_2025-01-02-0304_5.csv",
         "/q/data/Ransomware.csv", "/itc-net-blend/WhatsAppB12_final.csv"]


def pathed(spark, sf):
    f = flow_view(spark, sf)
    return f.withColumn("source_path", F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.col("k") % len(PATHS) + 1).cast("int")))


cte("pathed", ["flows"], f"SELECT *, {PATHS}[k % {len(PATHS)} + 1] AS source_path, k % {len(PATHS)} AS pi FROM flows".replace("[k", "[CAST(k").replace("+ 1]", "+ 1 AS INT)]"))


@query("a12_label_from_path", with_("pathed", select="""
SELECT flow_id, CASE WHEN pi = 0 THEN 0 ELSE 1 END AS label, ['benign', 'adware', 'unknown_profile', 'unknown_profile', 'ransomware', 'unknown_profile'][CAST(pi + 1 AS INT)] AS collection FROM pathed"""))
def a12(spark, sf):
    return pathed(spark, sf).select("flow_id", md.label_from_path("source_path").alias("label"),
                                    md.collection_from_path("source_path").alias("collection"))


@query("a13_destination_key", with_("raw", select="SELECT flow_id, r_dest AS destination_key FROM raw"))
def a13(spark, sf):
    r = raw_table(spark, sf)
    return r.select("flow_id", nm.destination_key("Server Name", "dst_ip", "DstPort").alias("destination_key"))


@query("a14_app_id", with_("raw", select="SELECT flow_id, r_app AS given, 'service:' || lower(r_proto) || ':10.1.0.' || k % 7 || ':' || dst_port AS derived FROM raw"))
def a14(spark, sf):
    r = raw_table(spark, sf).withColumn("proto_n", nm.normalize_protocol("Proto"))
    return r.select("flow_id", nm.derive_app_id("Application Name", None, None, None).alias("given"),
                    nm.derive_app_id(None, "proto_n", "dst_ip", "DstPort").alias("derived"))


@query("a15_app_from_path", with_("pathed", select="""
SELECT flow_id, ['run_1', 'CICAndMal2017 a', 'Site B', 'app one', 'Ransomware', 'WhatsAppB12_final'][CAST(pi + 1 AS INT)] AS parrot,
  ['run_1', 'cicandmal2017_a', 'site_b', 'app_one_2025_01_02_0304_5', 'ransomware', 'whatsapp'][CAST(pi + 1 AS INT)] AS blend,
  ['run_1', 'cicandmal2017_a', 'site_b', 'app_one_2025_01_02_0304_5', 'ransomware', 'whatsappb12_final'][CAST(pi + 1 AS INT)] AS other FROM pathed"""))
def a15(spark, sf):
    return pathed(spark, sf).select("flow_id", *[md.app_id_from_path("source_path", p).alias(n) for p, n in (
        ("parrot", "parrot"), ("itc_net_blend", "blend"), ("android_spyware", "other"))])


def normalized(spark, sf):
    return nm.normalize_flows(raw_table(spark, sf), "generic_flow", "flow_id")[0]


@query("a16_availability", with_("flows", select="SELECT 1 AS has_duration_ms, 1 AS has_load_metrics, 1 AS has_ttl_metrics, 0 AS has_tcp_flag_metrics, count(*) AS rows FROM flows"))
def a16(spark, sf):
    return normalized(spark, sf).groupBy("has_duration_ms", "has_load_metrics", "has_ttl_metrics", "has_tcp_flag_metrics").agg(
        F.count(F.lit(1)).alias("rows"))


@query("a17_split_totals", with_("raw", select="SELECT flow_id, CAST(round_even(half, 0) AS BIGINT) AS bytes_out, CAST(round_even(half, 0) AS BIGINT) AS bytes_in, ceil((packets_out + packets_in) * 0.5)::BIGINT AS p_out, floor((packets_out + packets_in) * 0.5)::BIGINT AS p_in FROM raw"))
def a17(spark, sf):
    r = raw_table(spark, sf).withColumns({"packets": F.col("Tot Fwd Pkts") + F.col("Tot Bwd Pkts")}).drop("Tot Fwd Pkts", "Tot Bwd Pkts")
    out = nm.normalize_flows(r, "generic_flow", "flow_id")[0]
    return out.select("flow_id", "bytes_out", "bytes_in", F.col("packets_out").alias("p_out"), F.col("packets_in").alias("p_in"))


@query("a18_normalize_flows", with_("raw", select="""
SELECT flow_id, r_app AS app_id, timestamp_end, CAST(round_even(half, 0) AS BIGINT) AS bytes_out, packets_out, packets_in, r_label AS label, r_dest AS destination_key,
  r_proto AS protocol, dst_port, CAST(round_even(duration_ms / 100.0::DOUBLE * 1000, 0) AS BIGINT) AS duration_ms, round(k * 2.5, 6) AS s_load, 0.0 AS sttl,
  CASE WHEN row_number() OVER (PARTITION BY r_app, r_dest ORDER BY timestamp_end, flow_id) = 1 THEN 1.0 ELSE 0.0 END AS dst_novelty, """ + family("r_app") + " AS app_family FROM raw"))
def a18(spark, sf):
    return normalized(spark, sf).select(
        "flow_id", "app_id", "timestamp_end", "bytes_out", "packets_out", "packets_in", "label", "destination_key", "protocol",
        "dst_port", "duration_ms", r6("s_load").alias("s_load"), "sttl", "dst_novelty", "app_family")


@query("a19_row_index_time", with_("flows", select="SELECT flow_id, row_number() OVER (ORDER BY flow_id) * 1000 AS timestamp_end, 0 AS label FROM flows"))
def a19(spark, sf):
    f = flow_view(spark, sf).select("flow_id", F.col("bytes_out").alias("Total Length of Fwd Packet"), F.lit("web").alias("Label"))
    return nm.normalize_flows(f, "sdncampus", "flow_id")[0].select("flow_id", "timestamp_end", "label")


@query("a20_public_adapter", with_("pathed", select="""
SELECT flow_id, app_id, (timestamp_end // 1000 % 1000000 + 1700000000) * 1000 AS timestamp_end, bytes_out::DOUBLE AS bytes_out, bytes_in::DOUBLE AS bytes_in, packets_out,
  dst_host || ':' || dst_port AS destination_key, label, 'pub' AS dataset_source,
  CASE WHEN row_number() OVER (PARTITION BY app_id, dst_host || ':' || dst_port ORDER BY timestamp_end // 1000 % 1000000, flow_id) = 1 THEN 1.0 ELSE 0.0 END AS dst_novelty FROM pathed"""))
def a20(spark, sf):
    p = pathed(spark, sf)
    f = p.select("flow_id", "source_path", F.col("app_id").alias("Package"), F.expr("timestamp_end div 1000 % 1000000").alias("Flow End Time"),
                 F.col("bytes_out").alias("Total Length of Fwd Packets"), F.col("bytes_in").alias("Total Length of Bwd Packets"),
                 F.col("packets_out").alias("Total Fwd Packets"), F.col("packets_in").alias("Total Backward Packets"),
                 F.col("dst_port").alias("Destination Port"), F.col("dst_host").alias("Destination IP"),
                 F.when(F.col("label") == 1, "Trojan").otherwise("Benign").alias("Label"))
    out = nm.adapt_public(f, "pub")
    return out.select("flow_id", "app_id", "timestamp_end", "bytes_out", "bytes_in", "packets_out", "destination_key", "label",
                      "dataset_source", "dst_novelty")


PROVENANCE_SQL = """SELECT flow_id, ['generic_flow','cicandmal2017_android','westermo','parrot2025_mitmproxy','generic_flow','itc_net_blend60_scenario_e'][CAST(pi + 1 AS INT)] AS dataset_source,
  ['generic_flow','cicflowmeter','westermo','parrot','generic_flow','itc_net_blend'][CAST(pi + 1 AS INT)] AS dataset_profile,
  ['run_1','cicandmal2017_a','site_b','app_one_2025_01_02_0304_5','ransomware','whatsappb12_final'][CAST(pi + 1 AS INT)] AS dataset_variant,
  ['benign','adware_set','site_b','parrot2025_mitmproxy','ransomware','itc_net_blend60_scenario_e'][CAST(pi + 1 AS INT)] AS environment_id FROM pathed"""


@query("a21_provenance", with_("pathed", select=PROVENANCE_SQL))
def a21(spark, sf):
    return md.add_provenance(pathed(spark, sf)).select("flow_id", "dataset_source", "dataset_profile", "dataset_variant", "environment_id")


@query("a22_recover_provenance", with_("pathed", select=f"""
, r AS ({PROVENANCE_SQL}) SELECT flow_id, CASE k % 4 WHEN 0 THEN r.dataset_source WHEN 1 THEN r.dataset_source WHEN 2 THEN r.dataset_source ELSE pathed.dataset_source END AS dataset_source
FROM pathed JOIN r USING (flow_id)"""))
def a22(spark, sf):
    k = F.col("k")
    p = pathed(spark, sf).withColumn("dataset_source", F.when(k % 4 == 0, " NaN ").when(k % 4 == 1, F.lit(None)).when(
        k % 4 == 2, "unknown_source").otherwise(F.col("dataset_source")))
    return md.recover_provenance(p, "source_path").select("flow_id", "dataset_source")


@query("a23_app_family", with_("flows", select=f"SELECT flow_id, {family('app_id')} AS app_family FROM flows"))
def a23(spark, sf):
    from netloom.operators.flows import app_family

    return flow_view(spark, sf).select("flow_id", app_family("app_id").alias("app_family"))


@query("a24_merge_flows", with_("flows", select=f"""
SELECT flow_id, dataset_source, session_id, {family('app_id')} AS app_family FROM flows WHERE k % 2 = 0 UNION ALL
SELECT flow_id, 'unknown_source', session_id, {family('app_id')} FROM flows WHERE k % 2 = 1"""))
def a24(spark, sf):
    f = flow_view(spark, sf)
    out = md.merge_flows(f.filter("k % 2 = 0"), f.filter("k % 2 = 1").drop("dataset_source"))
    return out.select("flow_id", "dataset_source", "session_id", "app_family")


def with_family(spark, sf):
    from netloom.operators.flows import app_family

    return flow_view(spark, sf).withColumn("app_family", app_family("app_id"))


@query("a25_manifest", with_("flows", select=f"""
SELECT dataset_source, count(*) AS rows, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1,
  count(DISTINCT {family('app_id')}) AS app_family_count, count(DISTINCT session_id) AS session_count, count(DISTINCT environment_id) AS environment_count FROM flows GROUP BY 1"""))
def a25(spark, sf):
    return md.manifest(with_family(spark, sf))["sources"]


@query("a25_completeness", with_("flows", select="SELECT count(*) AS rows, 1.0 AS session_id, 1 AS ready FROM flows"))
def a25_complete(spark, sf):
    return md.manifest(with_family(spark, sf))["completeness"].select("rows", "session_id", "ready")


@query("a26_source_weights", with_("flows", select="""
SELECT dataset_source, rows, round(least(3.0, greatest(0.65, sqrt((SELECT quantile_cont(n, 0.5) FROM (SELECT count(*) AS n FROM flows GROUP BY dataset_source)) / rows))), 6) AS weight
FROM (SELECT dataset_source, count(*) AS rows FROM flows GROUP BY 1)"""))
def a26(spark, sf):
    return md.source_weights(flow_view(spark, sf)).select("dataset_source", "rows", r6("weight").alias("weight"))


def triaged(spark, sf):
    o = table(spark, sf, "orders")
    i = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("alert-"), (i % 9000).cast("string")).alias("alert_id"), F.concat(F.lit("app."), (F.col("o_custkey") % 12).cast("string")).alias("appId"),
        F.when(F.col("o_orderstatus") == "F", " false_positive").when(F.col("o_orderstatus") == "O", "RESOLVED").otherwise("OPEN").alias("triage_status"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 20000 + i).alias("timestamp"),
        F.when(i % 7 == 0, F.lit("bad")).otherwise((F.col("o_totalprice") / 1e6).cast("string")).alias("anomaly_score"),
        F.struct((i % 100).alias("flow_count"), (i % 10 / 10.0).alias("novelty_score")).alias("features"))


cte("triaged", [], """
SELECT 'alert-' || o_orderkey % 9000 AS alert_id, 'app.' || o_custkey % 12 AS app, o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 'FALSE_POSITIVE' WHEN 'O' THEN 'RESOLVED' ELSE 'OPEN' END AS st, epoch(o_orderdate)::BIGINT * 20000 + o_orderkey AS ts,
  CASE WHEN o_orderkey % 7 = 0 THEN 0.0::DOUBLE ELSE o_totalprice / 1e6 END AS anomaly_score FROM orders
""")


@query("a27_feedback_rows", with_("triaged", select="""
SELECT app AS app_id, ts AS timestamp_end, CASE WHEN st = 'RESOLVED' THEN 1 ELSE 0 END AS label, alert_id AS session_id, o_orderkey % 100 AS flow_count FROM triaged WHERE st <> 'OPEN'"""))
def a27(spark, sf):
    t = triaged(spark, sf).withColumn("triage_status", F.trim("triage_status"))
    return md.feedback_to_rows(t).select("app_id", "timestamp_end", "label", "session_id", "flow_count")


RETRAIN = """SELECT alert_id, ts AS timestamp, CASE WHEN st = 'RESOLVED' THEN 1 ELSE 0 END AS label, anomaly_score FROM (
  SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC) AS rn FROM triaged WHERE st <> 'OPEN') WHERE rn = 1 ORDER BY ts DESC, alert_id DESC LIMIT 3000"""


@query("a28_retraining_set", with_("triaged", select=f"SELECT alert_id, timestamp, label, round(anomaly_score, 6) AS anomaly_score, 0.5 AS confidence FROM ({RETRAIN})"))
def a28(spark, sf):
    return md.retraining_set(triaged(spark, sf), 3000).select("alert_id", "timestamp", "label", r6("anomaly_score").alias("anomaly_score"), "confidence")


@query("a29_retraining_report", with_("triaged", select=f"""
SELECT count(*) AS rows_exported, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1, round(avg(label), 6) AS positive_ratio, 1 AS sufficient_per_class FROM ({RETRAIN})"""))
def a29(spark, sf):
    out = md.retraining_report(md.retraining_set(triaged(spark, sf), 3000))
    return out.select("rows_exported", "label_0", "label_1", r6("positive_ratio").alias("positive_ratio"), "sufficient_per_class")


@query("a30_sinks", with_("flows", select="SELECT dataset_source, count(*) AS rows FROM flows GROUP BY 1"))
def a30(spark, sf):
    import uuid

    path = f"{shared_dir(spark)}/netloom-sink-{uuid.uuid4().hex}"
    writers.write_table(flow_view(spark, sf).select(*SMALL, "dataset_source"), f"{path}/t", partition_by=["dataset_source"])
    report = spark.read.parquet(f"{path}/t").groupBy("dataset_source").agg(F.count(F.lit(1)).alias("rows"))
    writers.write_report(report, f"{path}/r")
    return spark.read.json(f"{path}/r").select("dataset_source", "rows")


def export_rows(spark, sf):
    f = flow_view(spark, sf)
    return f.withColumns({
        "src_ip": F.concat(F.lit("10.0.0."), (F.col("k") % 5).cast("string")), "src_port": F.lit(40000), "dst_ip": F.lit("93.184.216.34"),
        "timestamp_start": F.col("timestamp_end") - F.col("duration_ms"), "destination_hash": F.sha2("destination_key", 256),
        "site_hint": F.when(F.col("k") % 3 == 0, F.col("dst_host")), "protocol_code": F.when(F.col("protocol") == "TCP", 6).otherwise(17)})


@query("a31_flow_export", with_("flows", select="""
SELECT flow_id, sha256('salt:' || app_id) AS app_id, sha256(destination_key) AS destination_key, 9 AS elements, sha256('salt:10.0.0.' || k % 5) AS first_value, '1.1' AS event_version FROM flows"""))
def a31(spark, sf):
    out = writers.export_flow_events(export_rows(spark, sf), "MEDIUM", salt="salt")
    doc = F.from_json("payload", "app_id string, destination_key string, event_version string, ipfix_elements array<struct<id:int,name:string,value:string>>")
    out = out.withColumn("d", doc)
    return out.select("flow_id", "d.app_id", "d.destination_key", F.size("d.ipfix_elements").alias("elements"),
                      F.col("d.ipfix_elements")[0]["value"].alias("first_value"), "d.event_version")


@query("a32_export_latest", with_("flows", select="SELECT flow_id, timestamp_end FROM flows ORDER BY timestamp_end DESC, flow_id DESC LIMIT 250"))
def a32(spark, sf):
    return writers.export_latest(flow_view(spark, sf), 250).select("flow_id", "timestamp_end")


@query("a33_export_backfill", with_("flows", select="""
SELECT flow_id, 'flow' AS kind FROM (SELECT * FROM flows ORDER BY timestamp_end DESC, flow_id DESC LIMIT 400) WHERE timestamp_end > 1706000000000
UNION ALL SELECT flow_id, 'alert' FROM (SELECT * FROM flows WHERE label = 1 ORDER BY timestamp_end DESC, flow_id DESC LIMIT 400) WHERE timestamp_end > 1706000000000"""))
def a33(spark, sf):
    f = flow_view(spark, sf)
    alerts = f.filter("label = 1").select(F.col("flow_id").alias("alert_id"), F.col("flow_id").alias("feature_window_id"),
                                          F.col("timestamp_end").alias("timestamp"), "app_id")
    windows = f.select(F.col("flow_id").alias("feature_window_id"), "app_id", "bytes_out")
    a, b = writers.export_backfill(f, alerts, windows, 1706000000000, 400)
    return a.select("flow_id", F.lit("flow").alias("kind")).unionByName(b.select(F.col("alert_id").alias("flow_id"), F.lit("alert").alias("kind")))
