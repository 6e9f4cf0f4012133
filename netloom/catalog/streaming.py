"""Streaming queries: each runs over the events table as a stream and returns the stored result."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.base import query
from netloom.catalog.evaluate import show
from netloom.catalog.sql import family, rounded, with_
from netloom.functions.scalars import r6
from netloom.operators.sliding import window_builder
from netloom.sources.tables import flow_arrivals, flow_stream, flow_view, table
from netloom.streaming import flows as sf_

HOUR = 3_600_000


@query("l01_ingest", with_("flows", select="""
SELECT 'good' AS side, count(*) FILTER (k % 7 <> 0) AS rows FROM flows UNION ALL SELECT 'rejected', count(*) FILTER (k % 7 = 0) FROM flows"""))
def l01(spark, sf):
    s = flow_stream(spark, sf).select(
        F.lit("mobile_flow").alias("event_type"), F.lit("1.1").alias("event_version"), F.lit("device-0001").alias("device_id_pseudo"), "app_id",
        "protocol", F.lit(40000).alias("src_port"), "dst_port", F.sha2("destination_key", 256).alias("dst_host_hash"), "bytes_out", "bytes_in",
        "duration_ms", F.col("timestamp_end").alias("timestamp_start"), "timestamp_end", F.when(F.col("k") % 7 == 0, 1.5).otherwise(0.5).alias("anomaly_score"))
    good, bad = sf_.new_path(spark, "good"), sf_.new_path(spark, "bad")
    sf_.ingest_stream(s, good, bad)

    def count(path, side):
        return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(side).alias("side"), "rows")

    return count(good, "good").unionByName(count(bad, "rejected"))


@query("l02_dedup", with_("flows", select="SELECT flow_id FROM flows"))
def l02(spark, sf):
    s = flow_stream(spark, sf).select("flow_id", "timestamp_end", F.explode(F.sequence(F.lit(1), (F.col("k") % 3 + 1).cast("int"))).alias("copy"))
    return sf_.run_to_table(sf_.dedup_stream(s, "flow_id").select("flow_id"))


CLOSED = "(SELECT max(timestamp_end) FROM flows)"


@query("l03_tumbling", with_("base", "flows", select=f"""
SELECT app_id, window_end_ms, flow_count, CAST(total_bytes_out AS BIGINT) AS total_bytes_out, round(novelty_score, 6) AS novelty_score, round(duration_jitter, 6) AS duration_jitter, label
FROM base WHERE window_end_ms <= {CLOSED}"""))
def l03(spark, sf):
    out = sf_.run_to_table(sf_.feature_windows_stream(flow_stream(spark, sf), "6 hours"))
    return show(out, ["app_id", "window_end_ms", "flow_count", "total_bytes_out", "label"], ["novelty_score", "duration_jitter"])


@query("l04_hopping", with_("flows", select=f"""
SELECT app_id, h.e AS window_end_ms, count(*) AS flow_count, CAST(sum(bytes_out) AS BIGINT) AS total_bytes_out FROM (
  SELECT *, unnest([(timestamp_end // {6 * HOUR} + 1) * {6 * HOUR}, (timestamp_end // {6 * HOUR} + 2) * {6 * HOUR}]) AS e FROM flows) h
WHERE h.e <= {CLOSED} GROUP BY ALL"""))
def l04(spark, sf):
    out = sf_.run_to_table(sf_.hopping_windows_stream(flow_stream(spark, sf), "12 hours", "6 hours"))
    return out.select("app_id", "window_end_ms", "flow_count", "total_bytes_out")


@query("l05_sessions", with_("flows", select=f"""
SELECT app_id, session_id, min(timestamp_end) AS start_ms, max(timestamp_end) AS end_ms, count(*) AS windows, max(label) AS label FROM (
  SELECT *, sum(n) OVER (PARTITION BY app_id, session_id ORDER BY timestamp_end, flow_id) AS e FROM (
    SELECT *, CASE WHEN timestamp_end - lag(timestamp_end) OVER (PARTITION BY app_id, session_id ORDER BY timestamp_end, flow_id) <= {2 * HOUR} THEN 0 ELSE 1 END AS n FROM flows))
GROUP BY app_id, session_id, e HAVING max(timestamp_end) + {2 * HOUR} + 1 <= {CLOSED}"""))
def l05(spark, sf):
    return sf_.run_to_table(sf_.episodes_stream(flow_stream(spark, sf), 2 * HOUR)).select(
        "app_id", "session_id", "start_ms", "end_ms", "windows", "label")


# Files by time, some flows one or two files late; a flow is late behind the newest of the files before.
ARRIVED = """
, e AS (SELECT min(timestamp_end) AS lo, max(timestamp_end) AS hi FROM flows),
arrived AS (SELECT f.*, least(7, CAST(floor((timestamp_end - lo) * 8 / (hi - lo + 1)) AS BIGINT)
    + CASE WHEN flow_id % 41 = 0 THEN 2 WHEN flow_id % 13 = 1 THEN 1 ELSE 0 END) AS arrival FROM flows f, e),
tops AS (SELECT a.arrival, (SELECT max(timestamp_end) FROM arrived b WHERE b.arrival < a.arrival) AS one_before,
    (SELECT max(timestamp_end) FROM arrived b WHERE b.arrival < a.arrival - 1) AS two_before FROM (SELECT DISTINCT arrival FROM arrived) a)"""


def _sliding_sql():
    """Windows over the flows that were on time, for panes that the last watermark has passed."""
    from netloom.catalog.windows import SLIDING, sliding_sql

    pane = 6 * HOUR // 4
    body = sliding_sql(f"SELECT *, {6 * HOUR}::BIGINT AS h FROM kept_trail WHERE timestamp_end >= now_ms - {6 * HOUR}", "h")
    return with_("hosted", "flows", select=ARRIVED + f""",
kept AS (SELECT hosted.*, row_number() OVER (PARTITION BY app_id ORDER BY timestamp_end, flow_id) AS rn FROM hosted
  WHERE flow_id IN (SELECT flow_id FROM arrived JOIN tops USING (arrival) WHERE timestamp_end > coalesce(two_before, 0) - {HOUR})),
kept_trail AS (SELECT a.flow_id, a.app_id, a.timestamp_end AS now_ms, a.rn, a.label AS focal, a.dataset_source AS now_source,
    b.* EXCLUDE (flow_id, app_id, rn, dataset_source), b.rn AS brn
  FROM kept a JOIN kept b ON a.app_id = b.app_id AND b.rn <= a.rn AND b.timestamp_end >= a.timestamp_end - {6 * HOUR}
  WHERE (a.timestamp_end // {pane} + 1) * {pane} <= (SELECT hi FROM e) - {HOUR})""" + body + f"SELECT flow_id, {rounded(SLIDING)} FROM g")


@query("l06_sliding", _sliding_sql())
def l06(spark, sf):
    from netloom.catalog.windows import SLIDING

    sf_.with_rocksdb(spark)
    arrivals = flow_arrivals(spark, sf, sf_.new_path(spark, "arrivals"))
    return show(sf_.run_to_table(sf_.sliding_windows_stream(arrivals, 6 * HOUR, lateness="1 hour")), ["flow_id"], SLIDING)


@query("l07_late_rows", with_("flows", select=ARRIVED + f"""
SELECT count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late, min(flow_id) FILTER (late) AS first_late, max(flow_id) FILTER (late) AS last_late
FROM (SELECT flow_id, timestamp_end < coalesce(one_before, 0) - {HOUR} AS late FROM arrived JOIN tops USING (arrival))"""))
def l07(spark, sf):
    good, late = sf_.new_path(spark, "ontime"), sf_.new_path(spark, "late")
    arrivals = flow_arrivals(spark, sf, sf_.new_path(spark, "arrivals"), ["flow_id", "timestamp_end"])
    sf_.split_late(arrivals, good, late, HOUR)
    a = spark.read.parquet(good).agg(F.count(F.lit(1)).alias("on_time"))
    b = spark.read.parquet(late).agg(F.count(F.lit(1)).alias("late"), F.min("flow_id").alias("first_late"), F.max("flow_id").alias("last_late"))
    return a.crossJoin(b)


POLICY = {"threshold": 0.3, "window_ms": 6 * HOUR, "merge_ms": 12 * HOUR}

_PARTS = """[{'f': 'novelty_score', 'v': least(1, greatest(0, novelty_score)) * 0.32},
    {'f': 'burstiness', 'v': least(1, greatest(0, burstiness / 500)) * 0.22},
    {'f': 'total_bytes_out', 'v': least(1, greatest(0, (total_bytes_out / (total_bytes_in + 1) - 2) / 6)) * 0.20},
    {'f': 'outbound_ratio', 'v': least(1, greatest(0, (outbound_ratio - 0.7) / 0.3)) * 0.14},
    {'f': 'connection_frequency_delta', 'v': least(1, greatest(0, connection_frequency_delta / 20)) * 0.12}]"""


def _alerts_sql():
    """Rule score, evidence, persistence per session and merging per correlation key over all sliding windows."""
    from netloom.catalog.alerts import EVIDENCE
    from netloom.catalog.windows import horizon_rows, sliding_sql

    body = sliding_sql(horizon_rows(6 * HOUR), "h").replace("avg(ack_rate_total) AS ack_rate_total,", """avg(ack_rate_total) AS ack_rate_total,
  avg(transport_metrics_present) AS transport_metrics_present, avg(syn_rate_total) AS syn_rate_total, avg(rst_rate_total) AS rst_rate_total,
  avg(fragment_rate_total) AS fragment_rate_total, avg(suspicious_destination) AS suspicious_destination_ratio, 0 AS novelty_shift,
  0 AS byte_rate_deviation, 0 AS flow_count_deviation, 0 AS low_volume_periodic_score,""")
    return with_("trail", "flows", select=body + f""",
sc AS (SELECT g.*, f.session_id, {_PARTS} AS parts, {EVIDENCE} AS ev FROM g JOIN flows f USING (flow_id)),
sd AS (SELECT *, least(1, greatest(0, list_sum([x.v FOR x IN parts]))) AS score,
    [x.f FOR x IN list_sort([{{'k': -x.v, 'i': list_position([y.f FOR y IN parts], x.f), 'f': x.f}} FOR x IN parts IF x.v > 0])][1:3] AS top FROM sc),
k AS (SELECT *, {family("app_id")} AS fam, sha256(app_id || '|rule|' || array_to_string(list_sort(top)[1:3], '|')) AS correlation_key FROM sd WHERE score >= 0.3),
w AS (SELECT *, count(*) OVER o AS n, first_value(score) OVER o AS fs, max(ev) OVER o AS me FROM k
  WINDOW o AS (PARTITION BY app_id, session_id ORDER BY window_end_ms RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)),
em AS (SELECT *, CASE WHEN window_end_ms - lag(window_end_ms) OVER c <= {12 * HOUR} THEN 0 ELSE 1 END AS nw FROM w
  WHERE (n >= CASE WHEN fam IN ('service', 'system', 'other_app') THEN 2 ELSE 2 END AND score >= fs - 0.08 AND me >= 1) OR (score >= 0.94 AND ev >= 1)
  WINDOW c AS (PARTITION BY app_id, correlation_key ORDER BY window_end_ms, flow_id)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY app_id, correlation_key ORDER BY window_end_ms, flow_id) AS alert_no FROM em)
SELECT app_id, correlation_key, CAST(alert_no AS BIGINT) AS alert_no, count(*) AS occurrence_count, min(window_end_ms) AS first_seen,
  max(window_end_ms) AS last_seen, round(max(score), 6) AS score FROM r GROUP BY ALL""")


def padded(spark, sf):
    """All flows, and one made of the last, a year later, that lets the watermark pass them all."""
    path = sf_.new_path(spark, "arrivals")
    arrivals = flow_arrivals(spark, sf, path)
    f = spark.read.schema(arrivals.schema).parquet(path)
    last = f.orderBy(F.desc("timestamp_end"), F.desc("flow_id")).limit(1)
    last.withColumns({"timestamp_end": F.col("timestamp_end") + 365 * 24 * HOUR, "flow_id": F.lit(-1).cast("bigint")}).coalesce(1).write.mode(
        "append").parquet(path)
    return arrivals


@query("l08_alert_pipeline", _alerts_sql())
def l08(spark, sf):
    """Late flows wait for no one here: the lateness covers all delays, so every flow counts."""
    sf_.with_rocksdb(spark)
    out = sf_.alert_stream(padded(spark, sf), sf_.new_path(spark, "alerts"), 6 * HOUR, POLICY, lateness="30 days")
    return show(out, ["app_id", "correlation_key", "alert_no", "occurrence_count", "first_seen", "last_seen"], ["score"])


@query("l09_guard_sample", with_("flows", select="SELECT flow_id FROM (SELECT flow_id, row_number() OVER (ORDER BY timestamp_end, flow_id) AS rn FROM flows) WHERE rn % 7 = 0"))
def l09(spark, sf):
    return sf_.guard_sample(flow_view(spark, sf), 7).select("flow_id")


@query("l10_window_builder")
def l10(spark, sf):
    f, out = flow_view(spark, sf), None
    for mode, options in (("bucket", {"window_ms": 6 * HOUR}), ("sliding", {"horizon_ms": 6 * HOUR}),
                          ("adaptive", {"horizons_ms": [HOUR, 6 * HOUR, 24 * HOUR]})):
        line = f.transform(window_builder(mode, **options)).agg(
            F.count(F.lit(1)).alias("windows"), F.sum("label").alias("positives")).withColumn("mode", F.lit(mode))
        out = line if out is None else out.unionByName(line)
    return out


@query("l11_scorers")
def l11(spark, sf):
    from netloom.catalog.evaluate import scored
    from netloom.catalog.scoring import BOOSTED, LINEAR
    from netloom.plans.pipeline import score

    models = {"local": LINEAR, "remote": BOOSTED, "sensitive": LINEAR, "quiet": BOOSTED}
    s, out = scored(spark, sf).drop("score"), None
    for mode in ("rule", "local", "remote", "balanced", "statistical", "multivariate", "sequence", "ensemble_fusion"):
        line = score(s, mode, "score", **models).agg(
            F.count("score").alias("rows"), r6(F.min("score")).alias("lowest"), r6(F.max("score")).alias("highest")).withColumn("mode", F.lit(mode))
        out = line if out is None else out.unionByName(line)
    return out


@query("d18_device_activity", """
SELECT 'dev_' || user_id % 20 AS device_id, max(epoch_us(ts) // 1000000) AS last_seen_epoch, max(CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000000 ELSE 0 END) AS last_flow_epoch, count(*) AS total_events FROM events GROUP BY 1""")
def d18(spark, sf):
    e = table(spark, sf, "events")
    s = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    s = s.select(F.concat(F.lit("dev_"), (F.col("user_id") % 20).cast("string")).alias("device_id"),
                 F.when(F.col("event_type") == "error", "mobile_alert").otherwise("mobile_flow").alias("event_type"),
                 F.unix_seconds(F.col("ts").cast("timestamp")).alias("updated_epoch"))
    path = sf_.new_path(spark, "devices")

    def handle(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    sf_.run_batches(sf_.device_activity_stream(s), handle, "update")
    # Update mode repeats a device whenever it changes; all values only grow.
    rows = spark.read.parquet(path)
    return rows.groupBy("device_id").agg(*[F.max(c).alias(c) for c in ("last_seen_epoch", "last_flow_epoch", "total_events")])
