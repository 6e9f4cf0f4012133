"""The event, alert, policy, device and model tables: every change returns a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.scalars import clip
from netloom.operators.scoring import severity_name, severity_rank, when_list
from netloom.plans.ordered import positions

GLOBAL = "__global__"
DAY = 86_400


def upsert(current: DataFrame, updates: DataFrame, key: str, updated: str = "updated_epoch",
           created: str = "created_epoch") -> DataFrame:
    """Newest payload per key (an update beats the stored row on equal times), first creation time.

    One partial aggregate over both inputs: no key's versions are gathered.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    body = F.struct(*[c for c in current.columns if c not in (key, created)])
    out = both.groupBy(key).agg(
        F.max_by(body, F.struct(updated, "_new", F.xxhash64(body))).alias("_b"), F.min(created).alias(created))
    return out.select(key, "_b.*", created).select(*current.columns)


def first_n(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows if the caller asks for a limit, else all."""
    return df if n is None else df.limit(n)


def newest(df: DataFrame, n: int | None, ts: str = "updated_epoch", id_col: str = "alert_id") -> DataFrame:
    return first_n(df.orderBy(F.desc(ts), F.desc(id_col)), n)


def list_events(df: DataFrame, status: str | None = None, event_type: str | None = None,
                devices: list[str] | None = None, n: int | None = None) -> DataFrame:
    if status:
        df = df.filter(F.col("status") == status)
    if event_type:
        df = df.filter(F.col("event_type") == event_type)
    if devices:
        device = F.col("device_id") if "device_id" in df.columns else F.get_json_object("payload", "$.device_id_pseudo")
        df = df.filter(device.isin(devices))
    return newest(df, n, "updated_epoch", "event_id")


SEARCHED = ["app_id", "explanation", "top_features", "site_hint", "device_id", "destination_identity",
            "mitre_techniques", "threat_tags"]


def search(df: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive substring over the text and list columns; no wildcards."""
    hit = F.lit(False)
    for c in SEARCHED:
        if c in df.columns:
            text = F.concat_ws(",", c) if df.schema[c].dataType.typeName() == "array" else F.col(c)
            hit = hit | F.coalesce(F.lower(text).contains(needle.lower()), F.lit(False))
    return df.filter(hit)


def list_alerts(df: DataFrame, status: str | None = None, devices: list[str] | None = None,
                severities: list[str] | None = None, model: str | None = None, needle: str | None = None,
                n: int | None = None) -> DataFrame:
    if status:
        df = df.filter(F.col("triage_status") == status)
    if devices:
        df = df.filter(F.col("device_id").isin(devices))
    if severities:
        df = df.filter(F.col("severity").isin(severities))
    if model:
        df = df.filter(F.col("source_model") == model)
    if needle:
        df = search(df, needle)
    return newest(df, n)


def get_alert(df: DataFrame, alert_id: str) -> DataFrame:
    return df.filter(F.col("alert_id") == alert_id)


def device_name(devices: DataFrame) -> Column:
    return F.coalesce("display_name", "observed_name", "device_id")


def list_devices(devices: DataFrame, meta: DataFrame, now: int, n: int | None = None) -> DataFrame:
    """Devices with names, activity, online state and rank; most recently active first."""
    c = F.col
    out = devices.join(meta.select("device_id", "observed_name", "display_name", c("updated_epoch").alias(
        "metadata_updated_epoch")), "device_id", "left").fillna(0, ["metadata_updated_epoch"])
    points = ["last_flow_epoch", "last_alert_epoch", "last_heartbeat_epoch"]
    active = F.greatest(*points)
    out = out.withColumn("last_activity_epoch", active)
    out = out.orderBy(F.desc("last_activity_epoch"), F.desc("last_policy_epoch"), F.desc("last_seen_epoch"),
                      F.asc("device_id"))
    out = first_n(out, n)
    age = F.lit(now) - c("last_activity_epoch")
    beat = (c("last_heartbeat_epoch") > 0) & (c("last_heartbeat_epoch") >= c("last_activity_epoch"))
    online = (c("last_activity_epoch") > 0) & (age <= F.when(beat, 1200).otherwise(600))
    best = F.greatest(*points, "last_policy_epoch")
    source = F.when(best <= 0, "unknown")
    for name in ("flow", "alert", "heartbeat", "policy"):
        source = source.when(c(f"last_{name}_epoch") == best, name)
    out = out.withColumns({
        "device_name": device_name(out), "online": online.cast("int"),
        "status_label": F.when(online, "online").when((c("last_activity_epoch") > 0) & (age <= 3600), "recent").otherwise("stale"),
        "activity_source": source,
        "minutes_since_seen": F.when(c("last_activity_epoch") > 0, F.expr(f"({now} - last_activity_epoch) div 60"))})
    order = [F.desc("last_activity_epoch"), F.desc("last_policy_epoch"), F.desc("last_seen_epoch"), F.asc("device_id")]
    return positions(out, [], order, "device_rank")


def incidents(alerts: DataFrame, n: int | None = None, devices: list[str] | None = None) -> DataFrame:
    rows = alerts.filter(F.col("correlation_key") != "")
    if devices:
        rows = rows.filter(F.col("device_id").isin(devices))
    rank = F.max(severity_rank("severity"))
    g = rows.groupBy("correlation_key").agg(
        F.min("device_id").alias("device_id"), F.min("app_id").alias("app_id"), F.count(F.lit(1)).alias("alert_count"),
        rank.alias("max_severity_rank"), F.max("last_seen_epoch").alias("latest_seen_epoch"))
    g = g.withColumn("max_severity", severity_name(F.col("max_severity_rank")))
    return first_n(g.orderBy(F.desc("latest_seen_epoch"), F.asc("correlation_key")), n)


def quality_summary(alerts: DataFrame, newest_n: int | None = None) -> DataFrame:
    """Counts of each warning in all alerts, or the newest n (warnings stored as JSON text or as a list)."""
    rows = alerts if newest_n is None else newest(alerts.select("alert_id", "updated_epoch", "warnings"), newest_n)
    listed = F.col("warnings") if alerts.schema["warnings"].dataType.typeName() == "array" else F.from_json(
        "warnings", "array<string>")
    return rows.select(F.explode(listed).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("count"))


def store_stats(events: DataFrame, dead: DataFrame, alerts: DataFrame, policies: DataFrame) -> DataFrame:
    parts = [events.agg(F.count_if(F.col("status") == "pending").alias("pending"),
                        F.count_if(F.col("status") == "sent").alias("sent")).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in ("pending", "sent")])))]
    for name, df in (("dead_letter", dead), ("alerts", alerts), ("policies", policies)):
        parts.append(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("counter"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _triage_counts(alerts: DataFrame, by: list[str]) -> DataFrame:
    def total(status: str) -> Column:
        return F.sum(F.when(F.col("triage_status") == status, F.col("occurrence_count")).otherwise(0))

    return alerts.groupBy(*by).agg(total("FALSE_POSITIVE").alias("fp"), total("RESOLVED").alias("tp"))


def tune_thresholds(alerts: DataFrame, base: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Thresholds per app moved by its triage history."""
    t = _triage_counts(alerts, by or ["app_id"])
    t = t.withColumn("_d", clip(F.col("fp") * 0.02 - F.col("tp") * 0.01, -0.25, 0.25))
    t = t.withColumn("low", clip(base["low"] + F.col("_d"), 0.0, 0.90))
    t = t.withColumn("medium", F.greatest("low", clip(base["medium"] + F.col("_d"), 0.05, 0.95)))
    return t.withColumn("high", F.greatest("medium", F.least(F.lit(0.99), base["high"] + F.col("_d")))).drop("_d")


def merge_overrides(current: DataFrame, tuned: DataFrame) -> DataFrame:
    """Override table after tuning: tuned values win, untouched apps stay."""
    new = tuned.select("app_id", *[F.col(c).alias(f"_n_{c}") for c in ("low", "medium", "high")])
    out = current.join(new, "app_id", "full")
    return out.select("app_id", *[F.coalesce(f"_n_{c}", c).alias(c) for c in ("low", "medium", "high")])


def with_policy(df: DataFrame, overrides: DataFrame, defaults: dict[str, float], levels: list[str]) -> DataFrame:
    """Thresholds of each row's app, in ascending order."""
    o = overrides.select(F.col("app_id").alias("_a"), *[F.col(c).alias(f"_o_{c}") for c in levels])
    out = df.join(o, F.col("app_id") == F.col("_a"), "left").drop("_a")
    previous = None
    for c in levels:
        t = F.coalesce(F.col(f"_o_{c}"), F.lit(float(defaults[c])))
        out = out.withColumn(f"_t_{c}", t if previous is None else F.greatest(t, F.col(previous)))
        previous = f"_t_{c}"
    return out.drop(*[f"_o_{c}" for c in levels])


def policy_what_if(alerts: DataFrame, overrides: DataFrame, defaults: dict[str, float], n: int,
                   device: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(totals, per-app pivot) of four levels for the newest alerts of a device (or of each device)."""
    if device is not None:
        rows = newest(alerts.filter(F.col("device_id") == device), n)
    else:
        rows = positions(alerts, ["device_id"], [F.desc("updated_epoch"), F.desc("alert_id")], "_rn").filter(
            F.col("_rn") <= n).drop("_rn")
    out = with_policy(rows.select("app_id", "score"), overrides, defaults, ["low", "medium", "high"])
    s = F.col("score")
    level = F.when(s >= F.col("_t_high"), "HIGH").when(s >= F.col("_t_medium"), "MEDIUM").when(
        s >= F.col("_t_low"), "LOW").otherwise("SUPPRESSED")
    out = out.select("app_id", level.alias("severity"))
    names = ["SUPPRESSED", "LOW", "MEDIUM", "HIGH"]
    totals = out.agg(F.count(F.lit(1)).alias("rows_evaluated"), *[F.count_if(F.col("severity") == x).alias(x) for x in names])
    return totals, out.groupBy("app_id").pivot("severity", names).count().fillna(0)


def policy_what_if_windows(df: DataFrame, overrides: DataFrame, defaults: dict[str, float], top: int = 10,
                           score: str = "score", existing: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(distribution and change counts, top apps by rows) of three levels on scored windows."""
    out = with_policy(df, overrides, defaults, ["medium", "high"])
    s = F.col(score)
    level = F.when(s >= F.col("_t_high"), "HIGH").when(s >= F.col("_t_medium"), "MEDIUM").otherwise("LOW")
    out = out.withColumn("simulated_severity", level)
    names = ["LOW", "MEDIUM", "HIGH"]
    aggs = [F.count_if(F.col("simulated_severity") == x).alias(x) for x in names]
    changed = [F.count_if(F.upper(existing) != F.col("simulated_severity")).alias("rows_changed")] if existing else []
    totals = out.agg(F.count(F.lit(1)).alias("rows_evaluated"), *aggs, *changed)
    apps = out.groupBy("app_id").pivot("simulated_severity", names).count().fillna(0)
    apps = apps.withColumn("total", F.col("LOW") + F.col("MEDIUM") + F.col("HIGH"))
    return totals, apps.orderBy(F.desc("total"), F.asc("app_id")).limit(top)


def retraining_samples(alerts: DataFrame, n: int, features: str = "map<string,double>") -> DataFrame:
    rows = alerts.filter(F.col("triage_status").isin("FALSE_POSITIVE", "RESOLVED"))
    out = newest(rows, n).withColumns({
        "label": F.when(F.col("triage_status") == "FALSE_POSITIVE", 0).otherwise(1), "timestamp": F.col("updated_epoch")})
    return out.withColumn("window_features", F.from_json("feature_window", features)) if "feature_window" in out.columns else out


def feedback_bias(alerts: DataFrame) -> DataFrame:
    """Score bias within 0.18 and confidence boost up to 0.12 per app."""
    t = _triage_counts(alerts, ["app_id"])
    total = F.greatest(F.lit(1.0), (F.col("fp") + F.col("tp")).cast("double"))
    return t.withColumns({
        "score_bias": clip((F.col("tp") - F.col("fp")) / total * 0.18, -0.18, 0.18),
        "confidence_boost": clip(F.col("tp") / total * 0.12, 0.0, 0.12)})


def apply_bias(scores: DataFrame, bias: DataFrame, score: str = "score", confidence: str = "confidence") -> DataFrame:
    out = scores.join(bias.select("app_id", "score_bias", "confidence_boost"), "app_id", "left")
    return out.withColumns({
        score: clip(F.col(score) + F.coalesce("score_bias", F.lit(0.0)), 0, 1),
        confidence: clip(F.col(confidence) + F.coalesce("confidence_boost", F.lit(0.0)), 0, 1)}).drop(
        "score_bias", "confidence_boost")


def apply_retention(df: DataFrame, policies: DataFrame, now: int, ts: str = "updated_epoch") -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed counts per device): device days, else global days, else 90; within 1..90."""
    days = policies.select(F.col("device_id").alias("_d"), F.col("retention_days").alias("_own"))
    fallback = policies.agg(F.max(F.when(F.col("device_id") == GLOBAL, F.col("retention_days"))).alias("_all"))
    out = df.join(days, F.col("device_id") == F.col("_d"), "left").crossJoin(F.broadcast(fallback))
    keep_days = clip(F.coalesce("_own", "_all", F.lit(90)), 1, 90)
    fresh = F.col(ts) >= F.lit(now) - (keep_days * DAY).cast("long")
    marked = out.withColumn("_keep", fresh)
    kept = marked.filter("_keep").select(*df.columns)
    removed = marked.filter("not _keep").groupBy("device_id").agg(F.count(F.lit(1)).alias("removed"))
    return kept, removed


ACTIVITY = ["last_seen_epoch", "last_flow_epoch", "last_alert_epoch", "last_heartbeat_epoch", "last_policy_epoch"]


def _touch(df: DataFrame, **values: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.select("device_id", *[values.get(c.removeprefix("last_").removesuffix("_epoch"), zero).cast("long").alias(c)
                                    for c in ACTIVITY], values.get("total", zero).cast("long").alias("total_events"))


def event_activity(events: DataFrame) -> DataFrame:
    t = F.col("updated_epoch")
    zero = F.lit(0)
    known = events.filter(F.col("event_type").isin("mobile_flow", "mobile_alert"))
    return _touch(known, seen=t, flow=F.when(F.col("event_type") == "mobile_flow", t).otherwise(zero),
                  alert=F.when(F.col("event_type") == "mobile_alert", t).otherwise(zero), total=F.lit(1))


def max_activity(touches: DataFrame) -> DataFrame:
    """Max of each time, sum of events. Also the streaming form: groupBy + max in update mode."""
    return touches.groupBy("device_id").agg(*[F.max(c).alias(c) for c in ACTIVITY], F.sum("total_events").alias("total_events"))


def device_index(heartbeats: DataFrame, events: DataFrame, alerts: DataFrame, policies: DataFrame) -> DataFrame:
    beat = F.col("last_heartbeat_epoch")
    parts = [
        _touch(heartbeats, seen=beat, heartbeat=beat), event_activity(events),
        _touch(alerts, seen=F.col("updated_epoch"), alert=F.col("updated_epoch")),
        _touch(policies.filter(F.col("device_id") != GLOBAL), policy=F.col("updated_epoch"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return max_activity(out.filter(F.col("device_id").isNotNull() & (F.col("device_id") != "")))


# What marks test data.
TEST_PATTERN = r"^(abcd1234$|device-test-)|com\.test|manual|test"


def purge(tables: dict[str, DataFrame], devices: DataFrame | None = None, everything: bool = False,
          test_data: bool = False, test_column: str = "device_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(remaining tables, removed counter per table)."""
    left, counts = {}, None
    for name, df in tables.items():
        kept = df
        if everything:
            kept = kept.filter(F.lit(False))
        if devices is not None:
            targets = devices.filter(F.col("device_id") != GLOBAL).select("device_id").distinct()
            kept = kept.join(targets, "device_id", "left_anti")
        if test_data:
            kept = kept.filter(~F.coalesce(F.col(test_column).rlike(TEST_PATTERN), F.lit(False)))
        left[name] = kept
        before, after = (d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((df, "_b"), (kept, "_a")))
        line = before.crossJoin(after).select(F.lit(name).alias("table"), (F.col("_b") - F.col("_a")).alias("removed"))
        counts = line if counts is None else counts.unionByName(line)
    return left, counts


def due_deliveries(queue: DataFrame, now: int, n: int) -> DataFrame:
    due = queue.filter((F.col("status") == "pending") & (F.col("next_attempt_epoch") <= now))
    return due.orderBy("created_epoch", "event_id").limit(n)


def backlog(queue: DataFrame, now: int) -> DataFrame:
    waiting = F.col("status") == "pending"
    return queue.agg(F.count_if(waiting).alias("pending"),
                     F.count_if(waiting & (F.col("next_attempt_epoch") <= now)).alias("due"),
                     F.min(F.when(waiting, F.col("created_epoch"))).alias("oldest_epoch"))


def apply_outcomes(queue: DataFrame, outcomes: DataFrame, now: int, base: int = 5, max_retries: int = 5,
                   cap: int = 300) -> tuple[DataFrame, DataFrame]:
    """(queue, dead letters) after delivery attempts: sent, retried with backoff, or given up."""
    o = outcomes.select(F.col("event_id").alias("_e"), F.col("ok").alias("_ok"), F.substring("reason", 1, 1024).alias("_why"))
    j = queue.join(o, F.col("event_id") == F.col("_e"), "left")
    tries = F.col("attempts") + 1
    failed = F.col("_ok") == F.lit(False)
    dead = failed & (tries >= max_retries)
    delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2), tries - 1)).cast("long")
    hit = F.col("_ok").isNotNull()
    alive = j.filter(~F.coalesce(dead, F.lit(False))).withColumns({
        "status": F.when(F.col("_ok"), "sent").otherwise(F.col("status")),
        "next_attempt_epoch": F.when(failed, F.lit(now) + delay).otherwise(F.col("next_attempt_epoch")),
        "attempts": F.when(failed, tries).otherwise(F.col("attempts")),
        "last_error": F.when(failed, F.col("_why")).otherwise(F.col("last_error")),
        "updated_epoch": F.when(hit, F.lit(now)).otherwise(F.col("updated_epoch"))}).select(*queue.columns)
    letters = j.filter(dead).select("event_id", "event_type", "payload", F.col("_why").alias("reason"),
                                    F.lit(now).cast("long").alias("created_epoch"))
    return alive, letters


def replay(dead: DataFrame, now: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(events put back to pending, letters that remain): oldest n first."""
    oldest = dead.orderBy("created_epoch", "event_id").limit(n)
    stamp = F.lit(now).cast("long")
    back = oldest.select("event_id", "event_type", "payload", F.lit("pending").alias("status"),
                         F.lit(0).cast("long").alias("attempts"), stamp.alias("next_attempt_epoch"),
                         F.lit(None).cast("string").alias("last_error"), stamp.alias("created_epoch"),
                         stamp.alias("updated_epoch"))
    return back, dead.join(oldest.select("event_id"), "event_id", "left_anti")


# Limits of the event documents.
EVENT_VERSIONS = {"mobile_flow": ["1.0", "1.1"], "mobile_alert": ["1.0"]}
FLOW_PROTOCOLS = ["TCP", "UDP", "ICMP", "UNKNOWN"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH"]
TRIAGE = ["OPEN", "INVESTIGATING", "RESOLVED", "FALSE_POSITIVE"]
LENGTHS = {  # column: (least, most)
    "device_id_pseudo": (8, 128), "app_id": (1, 256), "dst_host_hash": (8, 256), "alert_id": (8, 128),
    "explanation": (0, 2048), "site_hint": (0, 512), "device_label": (0, 256), "destination_key": (0, 512),
    "dns_query_name": (0, 512), "tls_sni": (0, 512), "http_host": (0, 512), "http_path": (0, 2048),
    "source_model": (0, 128), "triage_note": (0, 1024), "correlation_key": (0, 256), "suppression_reason": (0, 512),
}
REQUIRED = {"mobile_flow": ["device_id_pseudo", "app_id", "protocol", "src_port", "dst_port", "dst_host_hash", "bytes_out",
                            "bytes_in", "duration_ms", "timestamp_start", "timestamp_end"],
            "mobile_alert": ["device_id_pseudo", "alert_id", "app_id", "anomaly_score", "severity", "timestamp"]}
UNIT_RANGE = ["anomaly_score", "base_anomaly_score", "context_score", "response_score", "confidence", "uncertainty",
              "drift_score", "beacon_score", "lookalike_score", "shadow_score", "dst_novelty", "is_new_destination_for_app"]
NON_NEGATIVE = ["bytes_out", "bytes_in", "packets_out", "packets_in", "duration_ms"]
LIST_LIMITS = {"explain_top_features": 16, "ipfix_elements": 512, "top_features": 16, "data_quality_warnings": 64}


def event_problems(df: DataFrame, kind: str) -> Column:
    """Names of the rules an event document breaks."""
    c, tests = F.col, []

    def have(*names: str) -> list[str]:
        return [n for n in names if n in df.columns]

    tests.append((c("event_type") != kind, "event_type"))
    tests.append((~c("event_version").isin(EVENT_VERSIONS[kind]), "event_version"))
    tests += [(c(n).isNull(), f"{n}:missing") for n in have(*REQUIRED[kind])]
    tests += [((F.length(n) < lo) | (F.length(n) > hi), f"{n}:length") for n, (lo, hi) in LENGTHS.items() if n in df.columns]
    tests += [(~c(n).between(0.0, 1.0), f"{n}:range") for n in have(*UNIT_RANGE)]
    tests += [(c(n) < 0, f"{n}:negative") for n in have(*NON_NEGATIVE)]
    tests += [(~c(n).between(0, 65535), f"{n}:range") for n in have("src_port", "dst_port")]
    tests += [(F.size(n) > most, f"{n}:size") for n, most in LIST_LIMITS.items() if n in df.columns]
    if kind == "mobile_flow":
        tests.append((~F.upper(F.trim("protocol")).isin(FLOW_PROTOCOLS), "protocol"))
        tests.append((c("timestamp_end") < c("timestamp_start"), "timestamp_order"))
    else:
        tests.append((~c("severity").isin(SEVERITIES), "severity"))
        tests += [(~c(n).isin(TRIAGE), n) for n in have("triage_status")]
        tests += [(~c(n).between(1, 100_000), f"{n}:range") for n in have("occurrence_count")]
    return when_list(tests)


def validate_events(df: DataFrame, kind: str = "mobile_flow") -> tuple[DataFrame, DataFrame]:
    """(good events, rejected events with their reasons)."""
    checked = df.withColumn("reasons", event_problems(df, kind))
    good = checked.filter(F.size("reasons") == 0).drop("reasons")
    if kind == "mobile_flow":
        good = good.withColumn("protocol", F.upper(F.trim("protocol")))
    return good, checked.filter(F.size("reasons") > 0)


# Detection models and the older names they go by.
MODELS = ["ensemble_fusion", "statistical", "multivariate", "sequence", "local", "local_sensitive", "local_quiet",
          "local_balanced", "local_privacy", "tflite", "remote_assisted"]
MODEL_ALIASES = {"linear": "local", "linear_v13_recall": "local_sensitive", "linear_v14_quiet": "local_quiet",
                 "hybrid_v15": "local_balanced"}
THEMES = ["SYSTEM", "LIGHT", "DARK"]


def model_name(c: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MODEL_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(c)), F.col(c))


def validate_policies(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good policies with current model names, rejected ones with reasons)."""
    c = F.col
    named = df.withColumns({m: model_name(m) for m in ("detection_model", "shadow_model") if m in df.columns})

    def bad_range(n: str, lo: float, hi: float) -> tuple:
        return (~c(n).between(lo, hi), f"{n}:range")

    tests = [bad_range(n, 0.0, 1.0) for n in ("low", "medium", "high")]
    tests += [(c("medium") < c("low"), "medium<low"), (c("high") < c("medium"), "high<medium")]
    for n, lo, hi in (("policy_version", 1, 2 ** 31), ("retention_days", 1, 90),
                      ("false_positive_budget_per_app_day", 1, 250), ("drift_high_threshold", 0.1, 1.0)):
        if n in df.columns:
            tests.append(bad_range(n, lo, hi))
    if "app_threshold_overrides" in df.columns:
        tests.append((F.size("app_threshold_overrides") > 1000, "too_many_overrides"))
        tests.append((F.exists(F.map_values("app_threshold_overrides"),
                               lambda t: (t["low"] > t["medium"]) | (t["medium"] > t["high"])), "override_order"))
    tests += [(~c(m).isin(MODELS), m) for m in ("detection_model", "shadow_model") if m in df.columns]
    if "theme_mode" in df.columns:
        tests.append((~c("theme_mode").isin(THEMES), "theme_mode"))
    checked = named.withColumn("reasons", when_list(tests))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def effective_policy(devices: DataFrame, policies: DataFrame, default: str, value: str = "policy") -> DataFrame:
    """Own policy, else the global one, else the default."""
    own = policies.select(F.col("device_id").alias("_d"), F.col(value).alias("_own"))
    shared = policies.agg(F.max(F.when(F.col("device_id") == GLOBAL, F.col(value))).alias("_all"))
    out = devices.join(own, F.col("device_id") == F.col("_d"), "left").crossJoin(F.broadcast(shared))
    source = F.when(F.col("_own").isNotNull(), "device").when(F.col("_all").isNotNull(), "global").otherwise("default")
    return out.withColumns({value: F.coalesce("_own", "_all", F.lit(default)), "policy_source": source}).drop("_d", "_own", "_all")


def apply_policy(policies: DataFrame, policy: str, scope: str, now: int, ids: list[str] | None = None,
                 devices: DataFrame | None = None) -> DataFrame:
    """Policy table after setting one policy for a device, the default, chosen devices or all."""
    spark = policies.sparkSession
    if scope == "global_default":
        targets = spark.createDataFrame([(GLOBAL,)], "device_id string")
    elif scope in ("device", "selected_devices"):
        if not ids:
            raise ValueError(f"device ids required for scope {scope}")
        targets = spark.createDataFrame([(i,) for i in (ids[:1] if scope == "device" else ids)], "device_id string")
    elif scope == "all_devices":
        targets = devices.select("device_id").filter(F.col("device_id") != GLOBAL).distinct()
    else:
        raise ValueError(f"unknown scope {scope!r}")
    stamp = F.lit(now).cast("long")
    new = targets.select("device_id", F.lit(policy).alias("policy"), stamp.alias("updated_epoch"))
    return upsert(policies.withColumn("_c", F.col("updated_epoch")), new.withColumn("_c", stamp), "device_id",
                  created="_c").drop("_c")


def apply_triage(alerts: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    u = updates.select(F.col("alert_id").alias("_a"), F.col("triage_status").alias("_s"),
                       F.substring("triage_note", 1, 1024).alias("_n"))
    out = alerts.join(u, F.col("alert_id") == F.col("_a"), "left")
    return out.withColumns({
        "triage_status": F.coalesce("_s", "triage_status"), "triage_note": F.coalesce("_n", "triage_note"),
        "updated_epoch": F.when(F.col("_a").isNotNull(), F.lit(now)).otherwise(F.col("updated_epoch"))}).select(*alerts.columns)


def registry_add(registry: DataFrame, models: DataFrame, now: int, activate: bool = True) -> DataFrame:
    """Append models with the next version of their device; an activated one is the only active."""
    latest = registry.groupBy("device_id").agg(F.max("version").alias("_v"))
    stamp = F.lit(now).cast("long")
    new = models.join(latest, "device_id", "left").select(
        "device_id", (F.coalesce("_v", F.lit(0)) + 1).cast("long").alias("version"), "model", stamp.alias("created_epoch"),
        (stamp if activate else F.lit(None).cast("long")).alias("activated_epoch"), F.lit(int(activate)).alias("is_active"))
    old = registry
    if activate:
        hit = models.select("device_id").distinct().withColumn("_hit", F.lit(True))
        old = registry.join(hit, "device_id", "left").withColumn(
            "is_active", F.when(F.col("_hit"), 0).otherwise(F.col("is_active"))).drop("_hit")
    return old.select(*new.columns).unionByName(new)


def registry_activate(registry: DataFrame, device: str, version: int, now: int) -> DataFrame:
    mine, chosen = F.col("device_id") == device, F.col("version") == version
    exists = registry.agg(F.max((mine & chosen).cast("int")).alias("_ok"))
    out = registry.crossJoin(F.broadcast(exists))
    on = mine & (F.col("_ok") == 1)
    return out.withColumns({
        "is_active": F.when(on, chosen.cast("int")).otherwise(F.col("is_active")),
        "activated_epoch": F.when(on & chosen, F.lit(now)).otherwise(F.col("activated_epoch"))}).drop("_ok")


def active_models(registry: DataFrame) -> DataFrame:
    rows = registry.filter("is_active = 1")
    return rows.groupBy("device_id").agg(F.max("version").alias("version"), F.max_by("model", "version").alias("model"))


def list_versions(registry: DataFrame, device: str, n: int) -> DataFrame:
    return registry.filter(F.col("device_id") == device).orderBy(F.desc("version")).limit(n)


def forensic_bundle(devices: DataFrame, alerts: DataFrame, policies: DataFrame, n: int = 50,
                    default: str = "{}") -> DataFrame:
    """Per device: policy, counters, its newest alerts and its incidents, nested (bounded lists)."""
    base = effective_policy(devices.select("device_id").distinct(), policies, default)
    counters = alerts.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "HIGH").alias("high_alerts"))
    top = positions(alerts, ["device_id"], [F.desc("updated_epoch"), F.desc("alert_id")], "_rn").filter(F.col("_rn") <= n)
    recent = top.groupBy("device_id").agg(F.array_sort(F.collect_list(
        F.struct("_rn", "alert_id", "app_id", "severity", "score"))).alias("recent_alerts"))
    groups = alerts.filter(F.col("correlation_key") != "").groupBy("device_id", "correlation_key").agg(
        F.count(F.lit(1)).alias("alert_count"), F.max("last_seen_epoch").alias("latest"))
    placed = positions(groups, ["device_id"], [F.desc("latest"), F.asc("correlation_key")], "_rn").filter(F.col("_rn") <= n)
    cases = placed.groupBy("device_id").agg(F.array_sort(F.collect_list(
        F.struct("_rn", "correlation_key", "alert_count", "latest"))).alias("incidents"))
    return base.join(counters, "device_id", "left").join(recent, "device_id", "left").join(cases, "device_id", "left")


def set_display_names(meta: DataFrame, names: DataFrame, now: int) -> DataFrame:
    stamp = F.lit(now).cast("long")
    u = names.select(F.col("device_id").alias("_d"), F.col("display_name").alias("_n"))
    known = meta.join(u, F.col("device_id") == F.col("_d"), "full")
    return known.select(
        F.coalesce("device_id", "_d").alias("device_id"), "observed_name", F.coalesce("_n", "display_name").alias("display_name"),
        F.when(F.col("_d").isNotNull(), stamp).otherwise(F.col("updated_epoch")).alias("updated_epoch"))


def job_status(transitions: DataFrame, n: int | None = None) -> DataFrame:
    """Job table from its transition events (queued, running, completed / failed), newest first."""
    place = F.struct("epoch", "seq")

    def at(state: list[str], value: str) -> Column:
        return F.max(F.when(F.col("status").isin(state), F.col(value)))

    out = transitions.groupBy("job_id").agg(
        F.max_by("device_id", place).alias("device_id"), F.max_by("status", place).alias("status"),
        at(["queued"], "epoch").alias("created_epoch"), at(["running"], "epoch").alias("started_epoch"),
        at(["completed", "failed"], "epoch").alias("completed_epoch"),
        F.substring(F.max_by(F.when(F.col("status") == "failed", F.col("error")), place), 1, 1024).alias("error"),
        at(["completed"], "output_version").alias("output_version"))
    return first_n(out.orderBy(F.desc("created_epoch"), F.desc("job_id")), n)
