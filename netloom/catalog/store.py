"""Event, alert, policy, device and model tables, made of orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.base import query
from netloom.catalog.sql import cte, with_
from netloom.functions.scalars import r6
from netloom.operators import store as so
from netloom.sources.tables import flow_view, table

NOW = 1_000_000_000


def alerts(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    i = F.col("o_orderkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.concat(F.lit("alert-"), i.cast("string")).alias("alert_id"),
        F.concat(F.lit("device-"), (F.col("o_custkey") % 40).cast("string")).alias("device_id"),
        F.concat(F.lit("app."), F.lower("c_mktsegment")).alias("app_id"),
        F.floor(F.col("o_totalprice")).cast("long").alias("cents"), (F.floor(F.col("o_totalprice")) / 600000.0).alias("score"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH").when(
            F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "FALSE_POSITIVE").when(F.col("o_orderstatus") == "O", "RESOLVED").otherwise("OPEN").alias("triage_status"),
        F.lit("").alias("triage_note"), (i % 3 + 1).alias("occurrence_count"),
        F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("corr-"), (i % 300).cast("string"))).alias("correlation_key"),
        F.concat(F.lit("Seen by "), F.col("c_name")).alias("explanation"), F.lit("rule").alias("source_model"),
        F.array(F.col("c_mktsegment"), F.col("o_orderpriority")).alias("top_features"),
        F.when(i % 4 == 0, F.lit('["zero_bytes_flow","invalid_port"]')).when(i % 4 == 1, '["zero_bytes_flow"]').otherwise("[]").alias("warnings"),
        F.to_json(F.struct((i % 50).cast("double").alias("flow_count"))).alias("feature_window"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + i % 86400).alias("updated_epoch"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - 100).alias("created_epoch"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + i % 1000).alias("last_seen_epoch"))


cte("al", [], """
SELECT 'alert-' || o_orderkey AS alert_id, 'device-' || o_custkey % 40 AS device_id, 'app.' || lower(c_mktsegment) AS app_id, o_orderkey AS i,
  floor(o_totalprice)::BIGINT AS cents, floor(o_totalprice) / 600000.0::DOUBLE AS score,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE o_orderstatus WHEN 'F' THEN 'FALSE_POSITIVE' WHEN 'O' THEN 'RESOLVED' ELSE 'OPEN' END AS triage_status, o_orderkey % 3 + 1 AS occurrence_count,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'corr-' || o_orderkey % 300 END AS correlation_key, 'Seen by ' || c_name AS explanation, c_mktsegment, o_orderpriority,
  epoch(o_orderdate)::BIGINT + o_orderkey % 86400 AS updated_epoch, epoch(o_orderdate)::BIGINT - 100 AS created_epoch, epoch(o_orderdate)::BIGINT + o_orderkey % 1000 AS last_seen_epoch
FROM orders JOIN customer ON o_custkey = c_custkey
""")


def events(spark, sf):
    a = alerts(spark, sf)
    i = F.substring("alert_id", 7, 20).cast("long")
    return a.select(
        F.concat(F.lit("ev-"), i.cast("string")).alias("event_id"),
        F.when(i % 3 == 0, "mobile_alert").when(i % 3 == 1, "mobile_flow").otherwise("heartbeat").alias("event_type"), "device_id",
        F.to_json(F.struct(F.col("device_id").alias("device_id_pseudo"), "app_id")).alias("payload"),
        F.when(i % 2 == 0, "pending").otherwise("sent").alias("status"), (i % 6).alias("attempts"),
        F.col("updated_epoch").alias("next_attempt_epoch"), F.lit(None).cast("string").alias("last_error"), "created_epoch", "updated_epoch")


cte("ev", ["al"], """
SELECT 'ev-' || i AS event_id, i, CASE i % 3 WHEN 0 THEN 'mobile_alert' WHEN 1 THEN 'mobile_flow' ELSE 'heartbeat' END AS event_type, device_id,
  CASE WHEN i % 2 = 0 THEN 'pending' ELSE 'sent' END AS status, i % 6 AS attempts, updated_epoch AS next_attempt_epoch, created_epoch, updated_epoch FROM al
""")


@query("d01_upsert", with_("al", select="""
SELECT alert_id, severity, max(updated_epoch) AS updated_epoch, min(created_epoch) AS created_epoch FROM (
  SELECT 'alert-' || i % 5000 AS alert_id, first_value(severity) OVER (PARTITION BY i % 5000 ORDER BY updated_epoch DESC, i DESC) AS severity, updated_epoch, created_epoch FROM al) GROUP BY ALL"""))
def d01(spark, sf):
    a = alerts(spark, sf).withColumn("i", F.substring("alert_id", 7, 20).cast("long"))
    a = a.withColumns({"alert_id": F.concat(F.lit("alert-"), (F.col("i") % 5000).cast("string")),
                       # the larger row id is the later of two equal times
                       "updated_epoch": F.struct("updated_epoch", "i")})
    a = a.select("alert_id", "severity", "updated_epoch", "created_epoch", "i")
    out = so.upsert(a.filter("i % 2 = 0").drop("i"), a.filter("i % 2 = 1").drop("i"), "alert_id")
    return out.withColumn("updated_epoch", F.col("updated_epoch.updated_epoch"))


@query("d02_list_events", with_("ev", select="""
SELECT event_id, updated_epoch FROM ev WHERE status = 'pending' AND event_type = 'mobile_flow' AND device_id IN ('device-1', 'device-2') ORDER BY updated_epoch DESC, event_id DESC LIMIT 30"""))
def d02(spark, sf):
    e = events(spark, sf).drop("device_id")
    return so.list_events(e, "pending", "mobile_flow", ["device-1", "device-2"], 30).select("event_id", "updated_epoch")


@query("d03_list_alerts", with_("al", select="""
SELECT alert_id, severity, updated_epoch FROM al WHERE triage_status = 'OPEN' AND severity IN ('HIGH', 'MEDIUM') AND device_id IN ('device-1', 'device-3', 'device-5')
  AND (contains(lower(app_id), 'mach') OR contains(lower(explanation), 'mach') OR contains(lower(c_mktsegment || ',' || o_orderpriority), 'mach')) ORDER BY updated_epoch DESC, alert_id DESC LIMIT 40"""))
def d03(spark, sf):
    return so.list_alerts(alerts(spark, sf), "OPEN", ["device-1", "device-3", "device-5"], ["HIGH", "MEDIUM"], "rule", "MACH", 40).select(
        "alert_id", "severity", "updated_epoch")


@query("d04_get_alert", with_("al", select="SELECT alert_id, cents FROM al WHERE alert_id = 'alert-77'"))
def d04(spark, sf):
    return so.get_alert(alerts(spark, sf), "alert-77").select("alert_id", "cents")


def heartbeats(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.concat(F.lit("device-"), F.col("c_custkey").cast("string")).alias("device_id"),
                                             (F.lit(985_000_000) + F.col("c_custkey") % 60 * 200_000).alias("last_heartbeat_epoch"))


def policies(spark, sf):
    c = table(spark, sf, "customer")  # every fourth device has a policy of its own
    own = c.select(F.concat(F.lit("device-"), (F.col("c_custkey") * 4).cast("string")).alias("device_id"), F.col("c_name").alias("policy"),
                   (F.col("c_custkey") * 3 % 100).alias("retention_days"), (F.lit(900_000_000) + F.col("c_custkey")).alias("updated_epoch"))
    one = table(spark, sf, "region").limit(1).select(F.lit(so.GLOBAL).alias("device_id"), F.lit("shared").alias("policy"),
                                                     F.lit(60).cast("long").alias("retention_days"), F.lit(1).cast("long").alias("updated_epoch"))
    return own.unionByName(one)


cte("hb", [], "SELECT 'device-' || c_custkey AS device_id, 985000000 + c_custkey % 60 * 200000 AS last_heartbeat_epoch FROM customer")
cte("pol", [], """SELECT 'device-' || c_custkey * 4 AS device_id, c_name AS policy, c_custkey * 3 % 100 AS retention_days, 900000000 + c_custkey AS updated_epoch
FROM customer UNION ALL SELECT '__global__', 'shared', 60, 1""")
cte("devs", ["hb", "ev", "al", "pol"], """
SELECT device_id, max(seen) AS last_seen_epoch, max(fl) AS last_flow_epoch, max(alr) AS last_alert_epoch, max(hb) AS last_heartbeat_epoch, max(pol) AS last_policy_epoch, CAST(sum(n) AS BIGINT) AS total_events FROM (
  SELECT device_id, last_heartbeat_epoch AS seen, 0 AS fl, 0 AS alr, last_heartbeat_epoch AS hb, 0 AS pol, 0 AS n FROM hb
  UNION ALL SELECT device_id, updated_epoch, CASE WHEN event_type = 'mobile_flow' THEN updated_epoch ELSE 0 END, CASE WHEN event_type = 'mobile_alert' THEN updated_epoch ELSE 0 END, 0, 0, 1 FROM ev WHERE event_type <> 'heartbeat'
  UNION ALL SELECT device_id, updated_epoch, 0, updated_epoch, 0, 0, 0 FROM al
  UNION ALL SELECT device_id, 0, 0, 0, 0, updated_epoch, 0 FROM pol WHERE device_id <> '__global__') GROUP BY device_id
""")


def index(spark, sf):
    return so.device_index(heartbeats(spark, sf), events(spark, sf), alerts(spark, sf), policies(spark, sf))


@query("d17_device_index", with_("devs", select="SELECT * FROM devs"))
def d17(spark, sf):
    return index(spark, sf)


def metadata(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.concat(F.lit("device-"), F.col("c_custkey").cast("string")).alias("device_id"),
                    F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("observed_name"),
                    F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("My "), F.col("c_name"))).alias("display_name"),
                    F.col("c_custkey").alias("updated_epoch"))


cte("meta", [], """SELECT 'device-' || c_custkey AS device_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS observed_name,
  CASE WHEN c_custkey % 3 = 0 THEN 'My ' || c_name END AS display_name, c_custkey AS updated_epoch FROM customer""")
NOW_D = 996_400_900


@query("d05_list_devices", with_("devs", "meta", select="""
SELECT row_number() OVER (ORDER BY act DESC, last_policy_epoch DESC, last_seen_epoch DESC, device_id) AS device_rank, device_id, coalesce(m.updated_epoch, 0) AS metadata_updated_epoch, act AS last_activity_epoch, total_events
FROM (SELECT *, greatest(last_flow_epoch, last_alert_epoch, last_heartbeat_epoch) AS act FROM devs) LEFT JOIN meta m USING (device_id) ORDER BY 1 LIMIT 45"""))
def d05(spark, sf):
    return so.list_devices(index(spark, sf), metadata(spark, sf), NOW_D, 45).select(
        "device_rank", "device_id", "metadata_updated_epoch", "last_activity_epoch", "total_events")


@query("d06_device_status", with_("devs", select=f"""
, a AS (SELECT *, greatest(last_flow_epoch, last_alert_epoch, last_heartbeat_epoch) AS act FROM devs),
b AS (SELECT *, act > 0 AND {NOW_D} - act <= CASE WHEN last_heartbeat_epoch > 0 AND last_heartbeat_epoch >= act THEN 1200 ELSE 600 END AS up FROM a)
SELECT device_id, CASE WHEN up THEN 1 ELSE 0 END AS online, CASE WHEN up THEN 'online' WHEN act > 0 AND {NOW_D} - act <= 3600 THEN 'recent' ELSE 'stale' END AS status_label,
  CASE greatest(act, last_policy_epoch) WHEN last_flow_epoch THEN 'flow' WHEN last_alert_epoch THEN 'alert' WHEN last_heartbeat_epoch THEN 'heartbeat' ELSE 'policy' END AS activity_source FROM b"""))
def d06(spark, sf):
    return so.list_devices(index(spark, sf), metadata(spark, sf), NOW_D).select("device_id", "online", "status_label", "activity_source")


@query("d07_incidents", with_("al", select="""
SELECT correlation_key, min(device_id) AS device_id, min(app_id) AS app_id, count(*) AS alert_count, max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS max_severity_rank,
  max(last_seen_epoch) AS latest_seen_epoch, CASE max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS max_severity
FROM al WHERE correlation_key <> '' GROUP BY 1 ORDER BY latest_seen_epoch DESC, correlation_key LIMIT 60"""))
def d07(spark, sf):
    return so.incidents(alerts(spark, sf), 60)


@query("d08_quality_summary", with_("al", select="""
SELECT warning, count(*) AS count FROM (SELECT unnest(CASE i % 4 WHEN 0 THEN ['zero_bytes_flow', 'invalid_port'] WHEN 1 THEN ['zero_bytes_flow'] ELSE [] END) AS warning
  FROM al) GROUP BY 1"""))
def d08(spark, sf):
    return so.quality_summary(alerts(spark, sf))


def dead_letters(spark, sf):
    e = events(spark, sf)
    return e.filter("attempts = 5").select("event_id", "event_type", "payload", F.lit("down").alias("reason"), "created_epoch")


@query("d09_store_stats", with_("ev", "pol", select="""
SELECT 'pending' AS counter, count(*) FILTER (status = 'pending') AS value FROM ev UNION ALL SELECT 'sent', count(*) FILTER (status = 'sent') FROM ev
UNION ALL SELECT 'dead_letter', count(*) FROM ev WHERE attempts = 5 UNION ALL SELECT 'alerts', count(*) FROM al UNION ALL SELECT 'policies', count(*) FROM pol"""))
def d09(spark, sf):
    return so.store_stats(events(spark, sf), dead_letters(spark, sf), alerts(spark, sf), policies(spark, sf))


BASE = {"low": 0.3, "medium": 0.6, "high": 0.85}
TUNE = """, t AS (SELECT device_id, app_id, sum(CASE WHEN triage_status = 'FALSE_POSITIVE' THEN occurrence_count ELSE 0 END) AS fp, sum(CASE WHEN triage_status = 'RESOLVED' THEN occurrence_count ELSE 0 END) AS tp FROM al GROUP BY ALL),
d AS (SELECT *, greatest(-0.25, least(0.25, fp * 0.02 - tp * 0.01)) AS dl FROM t),
l AS (SELECT *, greatest(0.0, least(0.9, 0.3 + dl)) AS lo FROM d), m AS (SELECT *, greatest(lo, greatest(0.05, least(0.95, 0.6 + dl))) AS md FROM l),
h AS (SELECT *, greatest(md, least(0.99, 0.85 + dl)) AS hi FROM m)"""


@query("d10_tune_thresholds", with_("al", select=TUNE + """
SELECT device_id, app_id, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp, round(lo, 6) AS low, round(md, 6) AS medium, round(hi, 6) AS high FROM h"""))
def d10(spark, sf):
    t = so.tune_thresholds(alerts(spark, sf), BASE, ["device_id", "app_id"])
    return t.select("device_id", "app_id", "fp", "tp", *[r6(c).alias(c) for c in BASE])


def overrides(spark, sf):
    """Over all devices, the apps whose alerts were confirmed at least as often as rejected."""
    return so.tune_thresholds(alerts(spark, sf), BASE).filter("tp >= fp")


ALL_TUNE = TUNE.replace("SELECT device_id, app_id, sum", "SELECT app_id, sum")


@query("d10_merge_overrides", with_("al", select=ALL_TUNE + """
SELECT coalesce(a.app_id, b.app_id) AS app_id, round(coalesce(b.lo, a.lo), 6) AS low FROM (SELECT * FROM h WHERE tp >= fp) a
FULL JOIN (SELECT * FROM h WHERE fp * 2 > tp) b ON a.app_id = b.app_id"""))
def d10_merge(spark, sf):
    noisy = so.tune_thresholds(alerts(spark, sf), BASE).filter("fp * 2 > tp")
    return so.merge_overrides(overrides(spark, sf).select("app_id", "low", "medium", "high"), noisy).select("app_id", r6("low").alias("low"))


SIM = ALL_TUNE + """, o AS (SELECT * FROM h WHERE tp >= fp),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY updated_epoch DESC, alert_id DESC) AS rn FROM al) WHERE rn <= 120),
s AS (SELECT n.app_id, CASE WHEN score >= coalesce(hi, 0.85) THEN 'HIGH' WHEN score >= coalesce(md, 0.6) THEN 'MEDIUM' WHEN score >= coalesce(lo, 0.3) THEN 'LOW' ELSE 'SUPPRESSED' END AS sev
  FROM n LEFT JOIN o ON n.app_id = o.app_id)"""


@query("d11_policy_what_if", with_("al", select=SIM + """
SELECT app_id, count(*) FILTER (sev = 'SUPPRESSED') AS SUPPRESSED, count(*) FILTER (sev = 'LOW') AS LOW, count(*) FILTER (sev = 'MEDIUM') AS MEDIUM, count(*) FILTER (sev = 'HIGH') AS HIGH FROM s GROUP BY 1"""))
def d11(spark, sf):
    return so.policy_what_if(alerts(spark, sf), overrides(spark, sf), BASE, 120)[1]


@query("d11_policy_what_if_totals", with_("al", select=SIM + """
SELECT count(*) AS rows_evaluated, count(*) FILTER (sev = 'SUPPRESSED') AS SUPPRESSED, count(*) FILTER (sev = 'LOW') AS LOW, count(*) FILTER (sev = 'MEDIUM') AS MEDIUM, count(*) FILTER (sev = 'HIGH') AS HIGH FROM s"""))
def d11_totals(spark, sf):
    return so.policy_what_if(alerts(spark, sf), overrides(spark, sf), BASE, 120)[0]


@query("d12_what_if_windows", with_("al", select=ALL_TUNE + """, o AS (SELECT * FROM h WHERE tp >= fp),
s AS (SELECT al.app_id, severity, CASE WHEN score >= coalesce(hi, 0.85) THEN 'HIGH' WHEN score >= coalesce(md, 0.6) THEN 'MEDIUM' ELSE 'LOW' END AS sev FROM al LEFT JOIN o ON al.app_id = o.app_id)
SELECT count(*) AS rows_evaluated, count(*) FILTER (sev = 'LOW') AS LOW, count(*) FILTER (sev = 'MEDIUM') AS MEDIUM, count(*) FILTER (sev = 'HIGH') AS HIGH, count(*) FILTER (sev <> severity) AS rows_changed FROM s"""))
def d12(spark, sf):
    return so.policy_what_if_windows(alerts(spark, sf), overrides(spark, sf), BASE, existing="severity")[0]


@query("d12_what_if_apps", with_("al", select=ALL_TUNE + """, o AS (SELECT * FROM h WHERE tp >= fp),
s AS (SELECT al.app_id, CASE WHEN score >= coalesce(hi, 0.85) THEN 'HIGH' WHEN score >= coalesce(md, 0.6) THEN 'MEDIUM' ELSE 'LOW' END AS sev FROM al LEFT JOIN o ON al.app_id = o.app_id)
SELECT app_id, count(*) FILTER (sev = 'LOW') AS LOW, count(*) FILTER (sev = 'MEDIUM') AS MEDIUM, count(*) FILTER (sev = 'HIGH') AS HIGH, count(*) AS total FROM s GROUP BY 1 ORDER BY total DESC, app_id LIMIT 3"""))
def d12_apps(spark, sf):
    return so.policy_what_if_windows(alerts(spark, sf), overrides(spark, sf), BASE, 3)[1]


@query("d13_retraining_samples", with_("al", select="""
SELECT alert_id, CASE WHEN triage_status = 'RESOLVED' THEN 1 ELSE 0 END AS label, (i % 50)::DOUBLE AS flow_count, updated_epoch AS timestamp FROM al WHERE triage_status <> 'OPEN' ORDER BY updated_epoch DESC, alert_id DESC LIMIT 500"""))
def d13(spark, sf):
    out = so.retraining_samples(alerts(spark, sf), 500)
    return out.select("alert_id", "label", F.col("window_features")["flow_count"].alias("flow_count"), "timestamp")


@query("d14_feedback_bias", with_("al", select="""
SELECT app_id, round((tp - fp) / greatest(1, fp + tp)::DOUBLE * 0.18, 6) AS score_bias, round(tp / greatest(1, fp + tp)::DOUBLE * 0.12, 6) AS confidence_boost FROM (
  SELECT app_id, sum(CASE WHEN triage_status = 'FALSE_POSITIVE' THEN occurrence_count ELSE 0 END) AS fp, sum(CASE WHEN triage_status = 'RESOLVED' THEN occurrence_count ELSE 0 END) AS tp FROM al GROUP BY 1)"""))
def d14(spark, sf):
    return so.feedback_bias(alerts(spark, sf)).select("app_id", r6("score_bias").alias("score_bias"), r6("confidence_boost").alias("confidence_boost"))


KEEP = f"updated_epoch >= {NOW} - greatest(1, least(90, coalesce(p.retention_days, 60))) * 86400"


@query("d16_retention", with_("al", "pol", select=f"SELECT alert_id FROM al LEFT JOIN pol p USING (device_id) WHERE {KEEP.replace('updated_epoch', 'al.updated_epoch')}"))
def d16(spark, sf):
    return so.apply_retention(alerts(spark, sf), policies(spark, sf), NOW)[0].select("alert_id")


@query("d16_retention_removed", with_("al", "pol", select=f"SELECT device_id, count(*) AS removed FROM al LEFT JOIN pol p USING (device_id) WHERE NOT ({KEEP.replace('updated_epoch', 'al.updated_epoch')}) GROUP BY 1"))
def d16_removed(spark, sf):
    return so.apply_retention(alerts(spark, sf), policies(spark, sf), NOW)[1]


@query("d19_purge", with_("al", "ev", select="""
SELECT 'alerts' AS "table", count(*) FILTER (device_id IN ('device-2', 'device-8') OR regexp_matches(app_id, 'machinery')) AS removed FROM al
UNION ALL SELECT 'events', count(*) FILTER (device_id IN ('device-2', 'device-8')) FROM ev"""))
def d19(spark, sf):
    gone = heartbeats(spark, sf).filter("device_id in ('device-2', 'device-8')")
    a = alerts(spark, sf).withColumn("app_id", F.regexp_replace("app_id", "machinery", "com.test"))
    e = events(spark, sf).withColumn("app_id", F.lit("x"))
    return so.purge({"alerts": a, "events": e}, gone, test_data=True, test_column="app_id")[1]


@query("d20_due_deliveries", with_("ev", select="SELECT event_id, created_epoch FROM ev WHERE status = 'pending' AND next_attempt_epoch <= 900000000 ORDER BY created_epoch, event_id LIMIT 80"))
def d20(spark, sf):
    return so.due_deliveries(events(spark, sf), 900_000_000, 80).select("event_id", "created_epoch")


@query("d20_backlog", with_("ev", select="""
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'pending' AND next_attempt_epoch <= 900000000) AS due, min(created_epoch) FILTER (status = 'pending') AS oldest_epoch FROM ev"""))
def d20_backlog(spark, sf):
    return so.backlog(events(spark, sf), 900_000_000)


def outcomes(spark, sf):
    e = events(spark, sf)
    i = F.substring("event_id", 4, 20).cast("long")
    return e.filter(i % 5 < 3).select("event_id", (i % 5 == 0).alias("ok"), F.lit("timeout").alias("reason"))


@query("d21_delivery_outcomes", with_("ev", select=f"""
SELECT event_id, CASE WHEN i % 5 = 0 THEN 'sent' ELSE status END AS status, CASE WHEN i % 5 IN (1, 2) THEN attempts + 1 ELSE attempts END AS attempts,
  CASE WHEN i % 5 IN (1, 2) THEN {NOW} + least(300, 5 * CAST(pow(2, attempts) AS BIGINT)) ELSE next_attempt_epoch END AS next_attempt_epoch FROM ev WHERE NOT (i % 5 IN (1, 2) AND attempts + 1 >= 5)"""))
def d21(spark, sf):
    return so.apply_outcomes(events(spark, sf), outcomes(spark, sf), NOW)[0].select("event_id", "status", "attempts", "next_attempt_epoch")


@query("d21_dead_letters", with_("ev", select=f"SELECT event_id, event_type, 'timeout' AS reason, {NOW} AS created_epoch FROM ev WHERE i % 5 IN (1, 2) AND attempts + 1 >= 5"))
def d21_dead(spark, sf):
    return so.apply_outcomes(events(spark, sf), outcomes(spark, sf), NOW)[1].drop("payload")


@query("d22_replay", with_("ev", select="""
, d AS (SELECT event_id, created_epoch, row_number() OVER (ORDER BY created_epoch, event_id) AS rn FROM ev WHERE attempts = 5)
SELECT event_id, CASE WHEN rn <= 300 THEN 'pending' ELSE 'dead' END AS state FROM d"""))
def d22(spark, sf):
    back, rest = so.replay(dead_letters(spark, sf), NOW, 300)
    return back.select("event_id", F.col("status").alias("state")).unionByName(rest.select("event_id", F.lit("dead").alias("state")))


def flow_events(spark, sf):
    f = flow_view(spark, sf)
    k = F.col("k")
    return f.select(
        "flow_id", F.when(k % 31 == 0, "other").otherwise("mobile_flow").alias("event_type"), F.when(k % 29 == 0, "2.0").otherwise("1.1").alias("event_version"),
        F.when(k % 23 == 0, "short").otherwise(F.lit("device-0001")).alias("device_id_pseudo"), "app_id",
        F.when(k % 19 == 0, "sctp").otherwise(F.concat(F.lit(" "), F.lower("protocol"))).alias("protocol"), F.lit(40000).alias("src_port"),
        F.when(k % 17 == 0, F.lit(70000).cast("long")).otherwise(F.col("dst_port")).alias("dst_port"), F.sha2("destination_key", 256).alias("dst_host_hash"),
        F.when(k % 13 == 0, F.lit(-1).cast("long")).otherwise(F.col("bytes_out")).alias("bytes_out"), "bytes_in", "duration_ms",
        F.when(k % 11 == 0, F.col("timestamp_end") + 5).otherwise(F.col("timestamp_end")).alias("timestamp_start"), "timestamp_end",
        F.when(k % 7 == 0, 1.5).otherwise(0.5).alias("anomaly_score"), F.array_repeat(F.lit("f"), F.when(k % 37 == 0, 17).otherwise(3)).alias("explain_top_features"))


@query("d23_validate_events", with_("flows", select="""
SELECT flow_id, array_to_string(list_filter([CASE WHEN k % 31 = 0 THEN 'event_type' END, CASE WHEN k % 29 = 0 THEN 'event_version' END, CASE WHEN k % 23 = 0 THEN 'device_id_pseudo:length' END,
  CASE WHEN k % 7 = 0 THEN 'anomaly_score:range' END, CASE WHEN k % 13 = 0 THEN 'bytes_out:negative' END, CASE WHEN k % 17 = 0 THEN 'dst_port:range' END,
  CASE WHEN k % 37 = 0 THEN 'explain_top_features:size' END, CASE WHEN k % 19 = 0 THEN 'protocol' END, CASE WHEN k % 11 = 0 THEN 'timestamp_order' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CASE WHEN k % 31 = 0 OR k % 29 = 0 OR k % 23 = 0 OR k % 7 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 37 = 0 OR k % 19 = 0 OR k % 11 = 0 THEN NULL ELSE protocol END AS protocol FROM flows"""))
def d23(spark, sf):
    good, bad = so.validate_events(flow_events(spark, sf))
    return good.select("flow_id", F.lit("").alias("reasons"), "protocol").unionByName(
        bad.select("flow_id", F.concat_ws(",", "reasons").alias("reasons"), F.lit(None).cast("string").alias("protocol")))


@query("d24_validate_policies", """
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'medium<low' END, CASE WHEN c_custkey % 5 = 0 THEN 'high<medium' END, CASE WHEN c_custkey % 11 = 0 THEN 'retention_days:range' END,
  CASE WHEN c_custkey % 13 = 0 THEN 'detection_model' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CASE WHEN c_custkey % 13 = 0 THEN 'mystery' WHEN c_custkey % 3 = 0 THEN 'local' ELSE 'sequence' END AS detection_model FROM customer""")
def d24(spark, sf):
    c = table(spark, sf, "customer")
    i = F.col("c_custkey")
    p = c.select("c_custkey", F.when(i % 7 == 0, 0.65).otherwise(0.3).alias("low"), F.lit(0.6).alias("medium"), F.when(i % 5 == 0, 0.5).otherwise(0.9).alias("high"),
                 F.when(i % 11 == 0, 91).otherwise(30).alias("retention_days"), F.lit(1).alias("policy_version"),
                 F.when(i % 13 == 0, "mystery").when(i % 3 == 0, "linear").otherwise("sequence").alias("detection_model"))
    good, bad = so.validate_policies(p)
    return good.select("c_custkey", F.lit("").alias("reasons"), "detection_model").unionByName(
        bad.select("c_custkey", F.concat_ws(",", "reasons").alias("reasons"), "detection_model"))


@query("d25_effective_policy", with_("devs", "pol", select="""
SELECT device_id, coalesce(p.policy, 'shared') AS policy, CASE WHEN p.policy IS NOT NULL THEN 'device' ELSE 'global' END AS policy_source FROM devs LEFT JOIN pol p USING (device_id)"""))
def d25(spark, sf):
    return so.effective_policy(index(spark, sf).select("device_id"), policies(spark, sf), "{}")


@query("d26_apply_policy", with_("devs", "pol", select=f"""
SELECT device_id, 'new' AS policy, {NOW} AS updated_epoch FROM devs UNION ALL SELECT device_id, policy, updated_epoch FROM pol WHERE device_id NOT IN (SELECT device_id FROM devs)"""))
def d26(spark, sf):
    p = policies(spark, sf).select("device_id", "policy", "updated_epoch")
    return so.apply_policy(p, "new", "all_devices", NOW, devices=index(spark, sf))


@query("d27_triage_update", with_("al", select=f"""
SELECT alert_id, CASE WHEN i % 6 = 0 THEN 'INVESTIGATING' ELSE triage_status END AS triage_status, CASE WHEN i % 6 = 0 THEN 1024 ELSE 0 END AS note_length, CASE WHEN i % 6 = 0 THEN {NOW} ELSE updated_epoch END AS updated_epoch FROM al"""))
def d27(spark, sf):
    a = alerts(spark, sf)
    u = a.filter(F.substring("alert_id", 7, 20).cast("long") % 6 == 0).select(
        "alert_id", F.lit("INVESTIGATING").alias("triage_status"), F.repeat(F.lit("n"), F.lit(2000)).alias("triage_note"))
    return so.apply_triage(a, u, NOW).select("alert_id", "triage_status", F.length("triage_note").alias("note_length"), "updated_epoch")


def registry(spark, sf):
    c = table(spark, sf, "customer")
    i = F.col("c_custkey")
    return c.select(F.concat(F.lit("device-"), (i % 50).cast("string")).alias("device_id"), F.expr("c_custkey div 50 + 1").alias("version"),
                    F.col("c_name").alias("model"), i.alias("created_epoch"), F.when(i >= 150, i).alias("activated_epoch"), (i >= 150).cast("int").alias("is_active"))


@query("d28_registry", with_("hb", select=f"""
, r AS (SELECT 'device-' || c_custkey % 50 AS device_id, c_custkey // 50 + 1 AS version, CASE WHEN c_custkey >= 150 THEN 1 ELSE 0 END AS act FROM customer)
SELECT device_id, version, CASE WHEN device_id = 'device-3' THEN CASE WHEN version = 2 THEN 1 ELSE 0 END WHEN device_id IN (SELECT device_id FROM hb) THEN 0 ELSE act END AS is_active FROM r
UNION ALL SELECT device_id, coalesce((SELECT max(version) FROM r WHERE r.device_id = hb.device_id), 0) + 1, CASE WHEN device_id = 'device-3' THEN 0 ELSE 1 END FROM hb"""))
def d28(spark, sf):
    new = heartbeats(spark, sf).select("device_id", F.lit("m").alias("model"))
    out = so.registry_add(registry(spark, sf), new, NOW)
    return so.registry_activate(out, "device-3", 2, NOW).select("device_id", "version", "is_active")


@query("d28_active_models", """
SELECT device_id, version, model FROM (SELECT 'device-' || c_custkey % 50 AS device_id, c_custkey // 50 + 1 AS version, c_name AS model,
  row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey DESC) AS rn FROM customer WHERE c_custkey >= 150) WHERE rn = 1""")
def d28_active(spark, sf):
    return so.active_models(registry(spark, sf))


@query("d29_forensic_bundle", with_("al", select="""
SELECT device_id, count(*) AS alerts, count(*) FILTER (severity = 'HIGH') AS high_alerts, least(20, count(*)) AS recent, least(20, count(DISTINCT CASE WHEN correlation_key <> '' THEN correlation_key END)) AS incidents,
  (SELECT alert_id FROM al b WHERE b.device_id = a.device_id ORDER BY updated_epoch DESC, alert_id DESC LIMIT 1) AS newest FROM al a GROUP BY device_id"""))
def d29(spark, sf):
    a = alerts(spark, sf)
    out = so.forensic_bundle(a.select("device_id"), a, policies(spark, sf), 20)
    return out.select("device_id", "alerts", "high_alerts", F.size("recent_alerts").alias("recent"), F.size("incidents").alias("incidents"),
                      F.col("recent_alerts")[0]["alert_id"].alias("newest"))


@query("d30_display_names", with_("meta", "hb", select=f"""
SELECT coalesce(m.device_id, h.device_id) AS device_id, coalesce(CASE WHEN h.device_id IS NOT NULL THEN 'Named' END, m.display_name, m.observed_name, m.device_id) AS device_name
FROM meta m FULL JOIN (SELECT * FROM hb WHERE last_heartbeat_epoch % 400000 = 0) h ON m.device_id = h.device_id"""))
def d30(spark, sf):
    names = heartbeats(spark, sf).filter("last_heartbeat_epoch % 400000 = 0").select("device_id", F.lit("Named").alias("display_name"))
    out = so.set_display_names(metadata(spark, sf), names, NOW)
    return out.select("device_id", so.device_name(out).alias("device_name"))


@query("d31_recent_flows", with_("flows", select="""
SELECT flow_id FROM flows WHERE app_id = 'com.whatsapp' AND timestamp_end BETWEEN 1705000000000 AND 1705500000000 ORDER BY timestamp_end DESC, flow_id DESC LIMIT 240"""))
def d31(spark, sf):
    from netloom.operators.sliding import recent_flows

    return recent_flows(flow_view(spark, sf), "com.whatsapp", 1705000000000, 1705500000000, n=240).select("flow_id")


@query("d32_job_status", with_("al", select="""
SELECT 'job-' || i % 4000 AS job_id, CASE max(i // 4000) WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, min(i) FILTER (i // 4000 = 0) AS created_epoch,
  min(i) FILTER (i // 4000 = 1) AS started_epoch, max(i) FILTER (i // 4000 >= 2) AS completed_epoch FROM al GROUP BY 1 ORDER BY created_epoch DESC, job_id DESC LIMIT 1000"""))
def d32(spark, sf):
    a = alerts(spark, sf)
    i = F.substring("alert_id", 7, 20).cast("long")
    step = F.expr("cast(substring(alert_id, 7, 20) as bigint) div 4000")
    t = a.select(F.concat(F.lit("job-"), (i % 4000).cast("string")).alias("job_id"), "device_id",
                 F.when(step == 0, "queued").when(step == 1, "running").when(step == 2, "completed").otherwise("failed").alias("status"),
                 i.alias("epoch"), step.alias("seq"), F.lit("boom").alias("error"), F.lit(2).alias("output_version"))
    return so.job_status(t, 1000).select("job_id", "status", "created_epoch", "started_epoch", "completed_epoch")
