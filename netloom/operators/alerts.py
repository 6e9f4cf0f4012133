"""From scored windows to alerts: budgets, suppression, evidence, persistence, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.scalars import clip01, flag
from netloom.operators import evaluate as ev
from netloom.operators.intel import BROWSER_PORTS, first_text
from netloom.operators.scoring import MAX_FAMILIES, lower_severity, severity_name, severity_rank, when_list
from netloom.plans.ordered import first_rows, running, trailing, with_group

DAY_MS = 86_400_000


def fp_budget(df: DataFrame, budget: int = 12, ts: str = "timestamp", id_col: str = "alert_id",
              severity: str = "severity") -> DataFrame:
    """One severity level down once the app's false positives of the last day reach the budget."""
    fp = F.when(F.col("triage_status") == "FALSE_POSITIVE", 1).otherwise(0)
    out = trailing(df, ["app_id"], ts, id_col, DAY_MS, sums={"fp_count": fp})
    hit = (F.col(severity) != "LOW") & (F.col("fp_count") >= budget)
    return out.withColumns({
        "budgeted_severity": F.when(hit, lower_severity(severity)).otherwise(F.col(severity)),
        "budget_reason": F.when(hit, F.format_string("false_positive_budget_exceeded:%d/%d", F.col("fp_count"),
                                                     F.lit(budget)))})


# Features that alone mean a burst, ports a browser may burst on.
BURST_FEATURES = ["burstiness", "conn_freq_delta", "flow_count", "activity_ratio"]
QUIET_PORTS = [80, 443, 853]
MIN_CONFIDENCE = 0.48


def suppress(df: DataFrame, severity: str = "severity", profile: str = "app_profile") -> DataFrame:
    """Lower severity at low confidence; drop to LOW where the profile explains a pure burst."""
    burst = F.forall("top_features", lambda f: f.isin(BURST_FEATURES))
    calm = first_text("danger_summary").isNull()
    p = F.col(profile)
    explained = F.when(p == "BROWSER", burst & calm & first_text("site_hint").isNull()
                       & F.col("dst_port").isin(QUIET_PORTS)).when(
        p.isin("TRUSTED", "HIGH_CHURN", "SYSTEM"), burst & calm).otherwise(False)
    unsure = (F.col("confidence") < MIN_CONFIDENCE) & (F.col(severity) != "LOW")
    step = F.when(unsure, lower_severity(severity)).otherwise(F.col(severity))
    reasons = [first_text("suppression_reason")] if "suppression_reason" in df.columns else []
    reasons += [F.when(unsure, F.format_string("low_confidence:%.2f", "confidence")),
                F.when(explained, F.concat(F.lit("profile_suppression:"), F.lower(p)))]
    return df.withColumns({
        "final_severity": F.when(explained, "LOW").otherwise(step),
        "suppression_reason": F.nullif(F.concat_ws(",", *reasons), F.lit(""))})


def evidence_strength(df: DataFrame, endpoint: bool = False) -> DataFrame:
    """How many independent kinds of evidence a window shows."""
    def v(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    def named(*parts: str) -> Column:
        if not endpoint:
            return F.lit(False)
        return F.exists("top_features", lambda f: f.rlike("|".join(parts)))

    tests = [
        (v("novelty_score") >= 0.35) | (v("novelty_shift") >= 0.18) | named("novelty"),
        (v("destination_diversity") >= 0.35) | (v("destination_transition_rate") >= 0.25) | named("destination"),
        (v("port_diversity") >= 0.20) | (v("protocol_diversity") >= 0.20) | named("port", "protocol"),
        (v("byte_rate_deviation") >= 0.40) | (v("flow_count_deviation") >= 0.40) | named("byte_rate", "flow_count"),
        (v("periodic_beacon_score") >= 0.55) | named("beacon"),
        (v("transport_metrics_present") >= 0.5) & ((v("syn_rate_total") >= 0.15) | (v("rst_rate_total") >= 0.15)
                                                   | (v("fragment_rate_total") >= 0.05)),
    ]
    if endpoint:
        c = F.col
        tests.append((v("lookalike_score") >= 0.55) | (F.size("threat_tags") > 0) | c("suspicious_tld")
                     | c("punycode_present") | c("digit_substitution_present"))
    else:
        tests += [v("low_volume_periodic_score") >= 0.35,
                  (v("destination_risk_score") >= 0.35) | (v("suspicious_destination_ratio") >= 0.20)]
    total = F.lit(0)
    for t in tests:
        total = total + t.cast("int")
    return df.withColumn("evidence_strength", total)


# Default persistence policy.
POLICY = {"threshold": 0.5, "high_bypass": 0.94, "service_count": 2, "default_count": 2, "min_evidence": 1,
          "window_ms": 300_000, "trend_slack": 0.08}
CAREFUL_FAMILIES = ["service", "system", "other_app"]


def policy_frame(df: DataFrame, threshold: float, window_ms: int, ts: str = "window_end_ms",
                 id_col: str = "window_bucket", score: str = "score") -> DataFrame:
    """Candidates with count, first score and greatest evidence of the trailing window.

    These do not depend on the other policy parameters, so a grid reuses one frame.
    """
    candidates = df.filter(F.col(score) >= threshold)
    return trailing(candidates, ["app_id", "session_id"], ts, id_col, window_ms,
                    sums={"candidate_count": F.lit(1)}, firsts={"first_score": F.col(score)},
                    maxes={"max_evidence": F.col("evidence_strength")})


def policy_emits(score: str, service_count, default_count, min_evidence, high_bypass, trend_slack) -> Column:
    """Does the policy emit this candidate? Parameters may be numbers or columns."""
    def c(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    required = F.when(F.col("app_family").isin(CAREFUL_FAMILIES), c(service_count)).otherwise(c(default_count))
    persistent = (F.col("candidate_count") >= required) & (F.col(score) >= F.col("first_score") - c(trend_slack))
    strong = (F.col(score) >= c(high_bypass)) & (F.col("evidence_strength") >= c(min_evidence))
    return (persistent & (F.col("max_evidence") >= c(min_evidence))) | strong


def alert_policy(df: DataFrame, params: dict | None = None, ts: str = "window_end_ms",
                 id_col: str = "window_bucket", score: str = "score") -> DataFrame:
    """Candidates with their verdict and, if not emitted, what is pending."""
    p = {**POLICY, **(params or {})}
    frame = policy_frame(df, p["threshold"], p["window_ms"], ts, id_col, score)
    emit = policy_emits(score, p["service_count"], p["default_count"], p["min_evidence"], p["high_bypass"],
                        p["trend_slack"])
    required = F.when(F.col("app_family").isin(CAREFUL_FAMILIES), p["service_count"]).otherwise(p["default_count"])
    return frame.withColumns({
        "emitted": emit.cast("int"),
        "pending_reason": F.when(~emit, F.format_string(
            "alert_policy_pending:persistence=%d/%d,evidence=%d/%d", F.col("candidate_count").cast("int"), required,
            F.col("max_evidence").cast("int"), F.lit(p["min_evidence"])))})


# Policy grids.
GLOBAL_GRID = {"service_count": [2, 3, 4], "default_count": [1, 2], "min_evidence": [1, 2, 3],
               "high_bypass": [0.94, 0.97, 0.99]}
FAMILY_GRID = {"service_count": [1, 2, 3, 4], "default_count": [1, 2, 3], "min_evidence": [1, 2, 3],
               "high_bypass": [0.90, 0.94, 0.97, 0.99]}


def grid_rows(grid: dict[str, list]) -> Column:
    """The combinations of a fixed parameter grid as one literal array of structs."""
    import itertools

    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(grid, values)])
                     for values in itertools.product(*grid.values())])


def policy_search(df: DataFrame, grid: dict | None = None, threshold: float = 0.5, gap_ms: int = 300_000,
                  by_family: bool = False, min_rows: int = 100, id_col: str = "window_bucket",
                  ts: str = "window_end_ms", score: str = "score", trend_slack: float = 0.08) -> DataFrame:
    """Episode metrics of every policy in the grid, best first by (F1, precision, recall).

    The trailing frame and the episodes are computed once; a row then carries one bit per
    policy, episodes keep the maximum of each bit, and only per-episode bits meet the grid.
    """
    grid = grid or (FAMILY_GRID if by_family else GLOBAL_GRID)
    combos = grid_rows(grid)
    frame = policy_frame(df, threshold, gap_ms, ts, id_col, score)
    bits = F.transform(combos, lambda g: policy_emits(
        score, g["service_count"], g["default_count"], g["min_evidence"], g["high_bypass"], trend_slack).cast("int"))
    keys = ["app_id", "session_id", ts, id_col]
    hits = frame.select(*keys, bits.alias("_bits"))
    size = 1
    for values in grid.values():
        size *= len(values)
    numbered = ev.gap_groups(df, ["app_id", "session_id"], ts, id_col, gap_ms, "_episode")
    joined = numbered.select(*keys, "_episode", "app_family", "label").join(hits, keys, "left")
    by = ["app_family"] if by_family else []
    per_episode = joined.groupBy("app_id", "session_id", "_episode").agg(
        F.min_by("app_family", F.struct(ts, id_col)).alias("app_family"), F.max("label").alias("label"),
        *[F.max(F.coalesce(F.col("_bits")[i], F.lit(0))).alias(f"_b{i}") for i in range(size)])
    votes = per_episode.select("app_family", "label", F.posexplode(
        F.array(*[F.col(f"_b{i}") for i in range(size)])).alias("policy", "score"))
    metrics = ev.binary_metrics(votes, 0.5, [*by, "policy"])
    metrics = metrics.withColumn("_g", F.element_at(combos, F.col("policy") + 1))
    out = metrics.select(*by, "policy", "_g.*", "tp", "fp", "fn", "tn", *ev.PR)
    if by_family:
        size_ok = df.groupBy("app_family").agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_p")).filter(
            (F.col("_n") >= min_rows) & (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))).select("app_family")
        out = out.join(size_ok, "app_family", "left_semi")
    return out


def best_policy(search: DataFrame, by_family: bool = False) -> DataFrame:
    """First policy by the metric order of the family (or the general order)."""
    if not by_family:
        return first_rows(search, [], [F.desc("f1"), F.desc("precision"), F.desc("recall"), F.asc("policy")])
    family = F.col("app_family")

    def order(service: Column, malware: Column, other: Column) -> Column:
        return F.when(family == "service", service).when(family == "malware", malware).otherwise(other).desc()

    p, r, f, fpr = (F.col(c) for c in ev.PR)
    return first_rows(search, ["app_family"], [order(p, r, f), order(-fpr, p, p), order(r, f, r), F.asc("policy")])


def correlation_key(app: str = "app_id", model: str = "source_model", features: str = "top_features") -> Column:
    names = F.slice(F.array_sort(F.transform(features, lambda x: F.lower(F.trim(x)))), 1, 3)
    return F.sha2(F.concat_ws("|", app, model, F.concat_ws("|", names)), 256)


def correlate_alerts(df: DataFrame, gap_ms: int = 600_000, ts: str = "timestamp", id_col: str = "alert_id") -> DataFrame:
    """Merge alerts of one key while the gap is at most ten minutes."""
    keyed = df.withColumn("correlation_key", correlation_key())
    numbered = ev.gap_groups(keyed, ["app_id", "correlation_key"], ts, id_col, gap_ms, "_run")
    place = F.struct(ts, id_col)
    last = [c for c in ("triage_status", "destination", "explanation") if c in df.columns]
    return numbered.groupBy("app_id", "correlation_key", "_run").agg(
        F.min_by(id_col, place).alias("alert_id"), F.count(F.lit(1)).alias("occurrence_count"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.max("score").alias("score"),
        severity_name(F.max(severity_rank("severity"))).alias("severity"),
        *[F.max_by(c, place).alias(c) for c in last]).drop("_run")


def pending_alerts(df: DataFrame, ts: str = "timestamp", id_col: str = "alert_id") -> DataFrame:
    """Candidates that wait: merged per key between emits; an emit clears what waits."""
    keys = ["app_id", "correlation_key"]
    out = running(df, keys, [ts, id_col], {"_emits": F.col("emitted")})
    out = with_group(out, keys, _last=F.sum("emitted"))
    waiting = out.filter((F.col("emitted") == 0) & (F.col("_emits") == F.col("_last")))
    place = F.struct(ts, id_col)
    return waiting.groupBy(*keys).agg(
        F.max("score").alias("score"), severity_name(F.max(severity_rank("severity"))).alias("severity"),
        F.count(F.lit(1)).alias("occurrence_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.max("evidence_strength").alias("max_evidence_strength"),
        F.max_by("evidence_strength", place).alias("evidence_strength"))


def explanation_text(features: str = "top_features", contributions: str = "contributions") -> Column:
    """Sentence ranking the named features by their share of the largest contribution."""
    def value(f: Column) -> Column:
        hit = F.filter(contributions, lambda x: x["feature"] == f)
        return F.try_element_at(hit, F.lit(1))["value"]

    ranked = F.filter(F.transform(features, lambda f: F.struct(f.alias("f"), F.abs(value(f)).alias("v"))),
                      lambda x: x["v"].isNotNull())
    top = F.greatest(F.array_max(F.transform(ranked, lambda x: x["v"])), F.lit(1e-9))
    parts = F.transform(ranked, lambda x: F.concat(x["f"], F.when(x["v"] / top >= 0.66, " (high impact)").when(
        x["v"] / top >= 0.33, " (moderate impact)").otherwise(" (low impact)")))
    return F.when(F.size(features) == 0, "No dominant contributing features were detected.").when(
        F.size(ranked) == 0, "Anomaly detected but detailed contributions are unavailable.").otherwise(
        F.concat(F.lit("Top contributors: "), F.array_join(parts, ", "), F.lit(".")))


# Blend grid.
BLEND_GRID = {"service_weight": [0.0, 0.15, 0.25, 0.40, 0.55], "service_cap": [0.06, 0.12, 0.18, 0.30],
              "malware_mode": ["max", "blend", "quiet"], "other_weight": [0.25, 0.45, 0.65]}


def blend_search(df: DataFrame, a: str, b: str, max_fpr: float = 0.10, grid: dict | None = None) -> DataFrame:
    """Best constrained-recall and best-F1 threshold of every blend.

    Each row meets the fixed grid, but only (policy, threshold step) counts are shuffled.
    """
    from netloom.operators.scoring import blend_scores

    combos = grid_rows(grid or BLEND_GRID)
    rows = df.select("label", "app_family", a, b, F.posexplode(combos).alias("policy", "_g"))
    scored = blend_scores(rows, a, b, "score", F.col("_g.service_weight"), F.col("_g.service_cap"),
                          F.col("_g.other_weight"), F.col("_g.malware_mode"))
    sweep = ev.threshold_sweep(scored, by=["policy"])
    limited = ev.Policy(((None, None, max_fpr), (None, None, None)), ("-recall", "-f1", "-precision"))
    one = ev.select_threshold(sweep, limited, ["policy"]).select(
        "policy", *[F.col(c).alias(f"constrained_{c}") for c in ("threshold", "precision", "recall", "f1")])
    two = ev.select_threshold(sweep, "max_f1", ["policy"]).select(
        "policy", *[F.col(c).alias(f"best_{c}") for c in ("threshold", "precision", "recall", "f1")])
    out = one.join(two, "policy").withColumn("_g", F.element_at(combos, F.col("policy") + 1))
    return out.select("policy", "_g.*", *[c for c in out.columns if c not in ("policy", "_g")])


# Confidence of a technique match by its evidence.
CACHE_KEY = ["destination_identity", "site_hint", "dns_query_name", "tls_sni", "http_host", "dst_ip"]


def cache_key(df: DataFrame) -> Column:
    parts = [F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) if c in df.columns else F.lit("") for c in CACHE_KEY]
    port = F.coalesce(F.col("dst_port").cast("string"), F.lit("443"))
    return F.array_join(F.array(*parts, port), "|")


def cached_enrichment(df: DataFrame, cache: DataFrame, now: int, max_age: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """(rows with their fresh cache entry, rows that have none)."""
    fresh = cache.filter(F.col("updated_epoch") >= now - max(1, max_age))
    keyed = df.withColumn("cache_key", cache_key(df))
    return keyed.join(fresh, "cache_key", "inner"), keyed.join(fresh, "cache_key", "left_anti")


def enrich_alerts(alerts: DataFrame, cache: DataFrame, now: int, max_age: int = 86_400) -> DataFrame:
    """Alerts with tags, techniques, similarity and severity raised by the cached destination facts.

    Alerts the gate leaves out, and those without a cache entry, keep their own values.
    ``cert_names`` (lower-case certificate names) is optional in the cache.
    """
    c = F.col
    fresh = cache.filter(c("updated_epoch") >= now - max(1, max_age))
    fresh = fresh.select("cache_key", *[c(n).alias(f"_e_{n}") for n in cache.columns if n not in ("cache_key", "updated_epoch")])
    hosts = [n for n in ("site_hint", "tls_sni", "http_host", "dns_query_name") if n in alerts.columns]
    gate = c("severity").isin("MEDIUM", "HIGH") | (F.coalesce(c("lookalike_score"), F.lit(0.0)) >= 0.45)
    for h in hosts:
        gate = gate | first_text(h).isNotNull()
    out = alerts.withColumn("cache_key", cache_key(alerts)).join(fresh, "cache_key", "left")
    none = F.array().cast("array<string>")

    def arr(name: str) -> Column:
        return F.coalesce(c(name), none)

    own, theirs = F.coalesce(c("lookalike_score"), F.lit(0.0)), F.coalesce(c("_e_lookalike_score"), F.lit(0.0))
    alike = F.when(gate, F.greatest(own, theirs)).otherwise(own)
    identity = F.coalesce(first_text("destination_identity"), F.when(gate, first_text("_e_registrable_domain")),
                          F.when(gate, first_text("_e_normalized_host")))
    out = out.withColumns({"_gate": gate, "_alike": alike, "_identity": identity})
    names = c("_e_cert_names") if "cert_names" in cache.columns else F.lit(None).cast("array<string>")
    mismatch = F.coalesce(c("_gate") & (F.size(names) > 0) & c("_identity").isNotNull() & ~F.exists(
        names, lambda n: F.lower(c("_identity")).endswith(F.regexp_replace(n, r"^\*\.", ""))), F.lit(False))
    dns = first_text("dns_query_name").isNotNull() if "dns_query_name" in alerts.columns else F.lit(False)
    repeated = c("_gate") & dns & (F.coalesce(c("periodic_beacon_score"), F.lit(0.0)) >= 0.72)
    out = out.withColumns({"_mismatch": mismatch, "_repeated": repeated})
    tags = F.array_distinct(F.concat(arr("threat_tags"), F.when(c("_gate"), arr("_e_threat_tags")).otherwise(none),
                                     when_list([(c("_mismatch"), "suspicious_cert_mismatch"),
                                                (c("_repeated"), "repeated_dns_beaconing")])))
    techniques = F.array_distinct(F.concat(arr("mitre_techniques"),
                                           F.when(c("_gate"), arr("_e_mitre_techniques")).otherwise(none)))
    out = out.withColumns({"threat_tags": tags, "mitre_techniques": techniques})

    def match(t: Column) -> Column:
        sure = F.when((t == "T1566") & (c("_alike") >= 0.55), F.when(c("_alike") >= 0.80, 0.86).otherwise(0.72)).when(
            (t == "T1071.004") & c("_repeated"), 0.74).when((t == "T1573") & c("_mismatch"), 0.70).otherwise(0.40)
        return F.struct(t.alias("technique"), sure.alias("confidence"), when_list([
            (c("_alike") >= 0.55, "lookalike_domain"), (c("_mismatch"), "certificate_name_mismatch"),
            (c("_repeated"), "periodic_dns_pattern"), (t == "T1071.001", "encrypted_web_protocol"),
            (t == "T1071.004", "dns_protocol")]).alias("evidence"))

    raised = F.when(c("_gate") & ((c("_alike") >= 0.80) | c("_mismatch")), "HIGH").when(
        c("_repeated") & (c("severity") == "LOW"), "MEDIUM").otherwise(c("severity"))
    out = out.withColumns({
        "mitre_matches": F.when(c("_gate"), F.transform("mitre_techniques", match)),
        "severity": raised, "lookalike_score": c("_alike"), "destination_identity": c("_identity")})
    return out.drop(*[n for n in out.columns if n.startswith("_")])
