"""Destination intelligence, alert decisions and the detectors that remember."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.base import query
from netloom.catalog.evaluate import CONF, RATES, scored, show
from netloom.catalog.sql import cte, rounded, with_
from netloom.functions.scalars import r6
from netloom.operators import alerts as al
from netloom.operators import intel
from netloom.operators import scoring as sc
from netloom.operators import stateful as st
from netloom.sources.tables import flow_view, table

KEYS = ["app_id", "window_bucket"]


def joined(c: str):
    return F.concat_ws(",", c).alias(c)


# ---- hosts: page hosts, and look-alikes made from document languages and part numbers
def hosts(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    return intel_hosts(p)


ODD = ["WWW.G00gle.com.", "paypa1-login.co.uk", "rnicrosoft.net", "xn--pple-43d.com", "netfl1x.top", "a.b.amaz0n.xyz", "10.0.0.9", "gm4il.zip"]


def intel_hosts(p):
    arr = F.array(*[F.lit(h) for h in ODD])
    odd = F.element_at(arr, (F.col("page_id") % len(ODD) + 1).cast("int"))
    return p.withColumns({
        "site_hint": F.when(F.col("page_id") % 3 == 0, odd).otherwise(F.col("host")),
        "tls_sni": F.when(F.col("page_id") % 5 == 0, "sni.example.org"),
        "dns_query_name": F.when(F.col("page_id") % 4 == 0, F.col("host")),
        "dst_port": F.when(F.col("page_id") % 7 == 0, 80).when(F.col("page_id") % 7 == 1, 8081).otherwise(443)})


ODD_SQL = "[" + ", ".join(f"'{h}'" for h in ODD) + "]"
cte("hosts", [], f"""
SELECT page_id, host, CASE WHEN page_id % 3 = 0 THEN {ODD_SQL}[CAST(page_id % {len(ODD)} + 1 AS INT)] ELSE host END AS site_hint,
  CASE WHEN page_id % 5 = 0 THEN 'sni.example.org' END AS tls_sni, CASE WHEN page_id % 4 = 0 THEN host END AS dns_query_name,
  CASE page_id % 7 WHEN 0 THEN 80 WHEN 1 THEN 8081 ELSE 443 END AS dst_port
FROM (SELECT page_id, split_part(url, '/', 3) AS host FROM pages)
""")
NORM = "regexp_replace(lower(trim(trim({h}, '.'))), '^www\\.', '')"
cte("named", ["hosts"], f"""
SELECT *, CASE WHEN len(l) <= 2 THEN norm WHEN length(l[-1]) = 2 AND l[-2] IN ('co','com','org','net','gov','ac') THEN l[-3] || '.' || l[-2] || '.' || l[-1]
  ELSE l[-2] || '.' || l[-1] END AS domain
FROM (SELECT *, list_filter(string_split(norm, '.'), lambda x: x <> '') AS l FROM (
  SELECT *, {NORM.format(h="coalesce(nullif(trim(tls_sni), ''), nullif(trim(site_hint), ''), nullif(trim(dns_query_name), ''))")} AS norm FROM hosts))
""")
BRANDS_SQL = "[" + ", ".join(f"'{b}'" for b in intel.BRANDS) + "]"
cte("brands", [], f"SELECT unnest({BRANDS_SQL}) AS brand, unnest(range({len(intel.BRANDS)})) AS bi")
cte("alike", ["named", "brands"], """
SELECT * EXCLUDE (rn, bi, d, sim, brand), CASE WHEN sim >= 0.45 THEN brand END AS brand_match, CASE WHEN sim >= 0.45 THEN sim ELSE 0.0::DOUBLE END AS lookalike_score
FROM (SELECT *, CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE greatest(0.0, 1.0 - d / greatest(length(bare), length(brand), 1)::DOUBLE) END AS sim,
    row_number() OVER (PARTITION BY page_id ORDER BY d, bi) AS rn
  FROM (SELECT n.*, b.*, levenshtein(bare, brand) AS d FROM (
    SELECT *, replace(translate(lower(split_part(domain, '.', 1)), '013457', 'oleast'), 'rn', 'm') AS bare FROM named) n CROSS JOIN brands b))
WHERE rn = 1
""")


@query("e13_hosts", with_("named", select="SELECT page_id, norm AS normalized_host, domain AS registrable_domain FROM named"))
def e13(spark, sf):
    h = hosts(spark, sf)
    out = h.withColumn("normalized_host", intel.normalize_host(intel.first_text("tls_sni", "site_hint", "dns_query_name")))
    return out.select("page_id", "normalized_host", intel.registrable_domain("normalized_host").alias("registrable_domain"))


@query("e14_lookalike", with_("alike", select="SELECT page_id, brand_match, round(lookalike_score, 6) AS lookalike_score FROM alike"))
def e14(spark, sf):
    out = intel.analyze_destinations(hosts(spark, sf))
    return out.select("page_id", "brand_match", r6("lookalike_score").alias("lookalike_score"))


cte("insight", ["alike"], """
SELECT *, contains(norm, 'xn--') AS puny, regexp_matches(norm, '[0-9]') AS digit, regexp_matches(norm, '\\.(zip|mov|top|xyz|click|gq|work)$') AS tld,
  dst_port NOT IN (53, 80, 123, 443, 853) AS odd_port FROM alike
""")
cte("tagged", ["insight"], """
SELECT *, list_filter([CASE WHEN puny THEN 'punycode_domain' END, CASE WHEN tld THEN 'suspicious_tld' END,
  CASE WHEN lookalike_score >= 0.55 THEN 'phishing_lookalike' END, CASE WHEN digit AND lookalike_score >= 0.45 THEN 'digit_substitution_lookalike' END,
  CASE WHEN dst_port = 80 THEN 'plaintext_web' END, CASE WHEN odd_port THEN 'unusual_destination_port' END], lambda x: x IS NOT NULL) AS tags,
  list_filter([CASE WHEN tls_sni IS NOT NULL OR site_hint IS NOT NULL THEN 'T1071.001' END, CASE WHEN dns_query_name IS NOT NULL THEN 'T1071.004' END,
  CASE WHEN lookalike_score >= 0.55 OR (digit AND lookalike_score >= 0.45) THEN 'T1566' END, CASE WHEN odd_port THEN 'T1571' END,
  CASE WHEN tls_sni IS NOT NULL OR site_hint IS NOT NULL THEN 'T1573' END], lambda x: x IS NOT NULL) AS techniques FROM insight
""")


@query("e15_threat_tags", with_("tagged", select="""
SELECT page_id, array_to_string(tags, ',') AS threat_tags, array_to_string(techniques, ',') AS mitre_techniques FROM tagged"""))
def e15(spark, sf):
    return intel.analyze_destinations(hosts(spark, sf)).select("page_id", joined("threat_tags"), joined("mitre_techniques"))


def host_alerts(spark, sf):
    h = hosts(spark, sf)
    none = F.array().cast("array<string>")
    return h.withColumns({
        "severity": F.when(F.col("page_id") % 6 == 0, "HIGH").when(F.col("page_id") % 6 == 1, "MEDIUM").otherwise("LOW"),
        "lookalike_score": (F.col("page_id") % 5) / 10.0, "destination_identity": F.when(F.col("page_id") % 8 == 0, "id.example.com"),
        "threat_tags": F.when(F.col("page_id") % 9 == 0, F.array(F.lit("own_tag"))).otherwise(none), "mitre_techniques": none,
        "periodic_beacon_score": (F.col("page_id") % 10) / 10.0, "http_host": F.lit(None).cast("string"),
        "dst_ip": F.lit(None).cast("string")})


@query("e16_enrich_alerts", with_("tagged", select="""
, a AS (SELECT *, CASE page_id % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS sev, (page_id % 5) / 10.0 AS own,
    page_id % 2 = 0 AS fresh, dns_query_name IS NOT NULL AND page_id % 10 >= 8 AS rep FROM tagged),
b AS (SELECT *, greatest(own, CASE WHEN fresh THEN lookalike_score ELSE 0 END) AS alike FROM a)
SELECT page_id, CASE WHEN alike >= 0.8 THEN 'HIGH' WHEN rep AND sev = 'LOW' THEN 'MEDIUM' ELSE sev END AS severity,
  round(alike, 6) AS lookalike_score, CASE WHEN page_id % 8 = 0 THEN 'id.example.com' WHEN fresh THEN domain END AS destination_identity,
  array_to_string(list_filter([CASE WHEN page_id % 9 = 0 THEN 'own_tag' END] || CASE WHEN fresh THEN tags ELSE [] END || [CASE WHEN rep THEN 'repeated_dns_beaconing' END], lambda x: x IS NOT NULL), ',') AS threat_tags,
  CASE WHEN fresh THEN array_to_string(techniques, ',') ELSE '' END AS mitre_techniques FROM b"""))
def e16(spark, sf):
    a = host_alerts(spark, sf)
    known = intel.analyze_destinations(hosts(spark, sf)).withColumn(
        "updated_epoch", F.when(F.col("page_id") % 2 == 0, 1000).otherwise(10).cast("long"))
    # The page id joins the address part of the key, so that every alert has its own entry.
    keyed = a.withColumn("dst_ip", F.col("page_id").cast("string"))
    cache = known.join(keyed.select("page_id", al.cache_key(keyed).alias("cache_key")), "page_id").select(
        "cache_key", "updated_epoch", "normalized_host", "registrable_domain", "lookalike_score", "threat_tags", "mitre_techniques")
    out = al.enrich_alerts(keyed, cache, 1000, 100)
    return out.select("page_id", "severity", r6("lookalike_score").alias("lookalike_score"), "destination_identity",
                      joined("threat_tags"), joined("mitre_techniques"))


@query("d15_enrichment_cache", with_("hosts", select="""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'hit' ELSE 'miss' END AS found FROM hosts"""))
def d15(spark, sf):
    a = host_alerts(spark, sf).withColumn("dst_ip", F.col("page_id").cast("string"))
    cache = a.select(al.cache_key(a).alias("cache_key"),
                     F.when(F.col("page_id") % 2 == 0, 1000).otherwise(10).cast("long").alias("updated_epoch"),
                     F.lit("x").alias("enrichment"))
    hit, miss = al.cached_enrichment(a, cache, 1000, 100)
    return hit.select("page_id", F.lit("hit").alias("found")).unionByName(miss.select("page_id", F.lit("miss").alias("found")))


def danger_flows(spark, sf):
    f = flow_view(spark, sf)
    k = F.col("k")
    hint = F.when(k % 11 == 0, "expired.badssl.com").when(k % 11 == 1, "http.badssl.com").when(
        k % 11 == 2, "login-bank.example.com").when(k % 11 == 3, "telemetry.example.net").when(
        k % 11 == 4, "93.184.216.34").when(k % 11 == 5, "evil-phish.zip").when(k % 11 == 6, F.lit(None)).otherwise(F.col("dst_host"))
    none = F.array().cast("array<string>")
    return f.withColumns({
        "site_hint": hint, "lookalike_score": (k % 10) / 10.0, "brand_match": F.when(k % 10 >= 5, "google"),
        "punycode_present": F.col("dst_host").contains("xn--"), "suspicious_tld": F.col("dst_host").endswith(".xyz"),
        "digit_substitution_present": F.lit(False), "http3_detected": k % 13 == 0,
        "tls_leaf_subject": F.when(k % 17 == 0, "CN=x"),
        "threat_tags": F.when(k % 5 == 0, F.array(F.lit("plaintext_web"), F.lit("punycode_domain"))).otherwise(none)})


cte("danger", ["flows"], """
SELECT *, lower(coalesce(site_hint, '')) AS h,
  app_id IN ('com.android.chrome') OR (starts_with(app_id, 'uid:') AND dst_port IN (80, 443, 8080, 8443, 853))
    OR (coalesce(trim(site_hint), '') <> '' AND dst_port IN (80, 443, 8080, 8443, 853)) AS browsing,
  dst_port NOT IN (53, 80, 123, 443, 853) AS odd_port
FROM (SELECT *, CASE k % 11 WHEN 0 THEN 'expired.badssl.com' WHEN 1 THEN 'http.badssl.com' WHEN 2 THEN 'login-bank.example.com' WHEN 3 THEN 'telemetry.example.net'
    WHEN 4 THEN '93.184.216.34' WHEN 5 THEN 'evil-phish.zip' WHEN 6 THEN NULL ELSE dst_host END AS site_hint,
  (k % 10) / 10.0 AS look, contains(dst_host, 'xn--') AS puny, ends_with(dst_host, '.xyz') AS tld, k % 13 = 0 AS h3, k % 17 = 0 AS cert FROM flows)
""")
cte("danger_scored", ["danger"], """
SELECT *, greatest(0, least(1, least(0.45, look * 0.45) + CASE WHEN puny THEN 0.22 ELSE 0 END + CASE WHEN tld THEN 0.18 ELSE 0 END
  + CASE WHEN dst_port = 80 AND browsing THEN 0.45 ELSE 0 END + CASE WHEN ends_with(h, '.badssl.com') THEN 0.32 ELSE 0 END
  + CASE WHEN contains(h, 'expired.badssl.com') THEN 0.24 ELSE 0 END + CASE WHEN contains(h, 'http.badssl.com') THEN 0.28 ELSE 0 END
  + CASE WHEN contains(h, 'xn--') OR ends_with(h, '.zip') THEN 0.35 ELSE 0 END + CASE WHEN contains(h, 'login-') THEN 0.25 ELSE 0 END
  + CASE WHEN contains(h, 'telemetry') THEN 0.18 ELSE 0 END + CASE WHEN cert THEN 0.08 ELSE 0 END + CASE WHEN h3 THEN 0.05 ELSE 0 END
  + CASE WHEN regexp_matches(h, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') THEN 0.12 ELSE 0 END + CASE WHEN odd_port THEN 0.12 ELSE 0 END)) AS reputation_score FROM danger
""")


@query("e17_danger_score", with_("danger_scored", select="SELECT flow_id, round(reputation_score, 6) AS reputation_score FROM danger_scored"))
def e17(spark, sf):
    return intel.danger_score(danger_flows(spark, sf)).select("flow_id", r6("reputation_score").alias("reputation_score"))


@query("e18_danger_reasons", with_("danger", select="""
SELECT flow_id, nullif(array_to_string(list_filter([
  CASE WHEN dst_port = 80 AND browsing THEN 'insecure plaintext web destination' END,
  CASE WHEN contains(h, 'expired.badssl.com') THEN 'expired TLS certificate test host' WHEN contains(h, 'http.badssl.com') THEN 'plaintext HTTP security test host' END,
  CASE WHEN contains(h, 'xn--') OR regexp_matches(h, '[.](zip|mov|top|xyz|click|gq|work)$') OR contains(h, 'login-') THEN 'possible phishing-style domain' END,
  CASE WHEN contains(h, 'telemetry') OR contains(h, 'ads.') THEN 'tracking or telemetry destination' END,
  CASE WHEN contains(h, 'phish') THEN 'matches a locally suspicious keyword list' END,
  CASE WHEN regexp_matches(h, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') THEN 'host appears as a direct IP literal' END,
  CASE WHEN look >= 0.55 THEN 'lookalike domain similar to google' END,
  CASE WHEN puny THEN 'punycode domain' END, CASE WHEN tld THEN 'suspicious top-level domain' END,
  CASE WHEN k % 5 = 0 THEN 'plaintext web' END, CASE WHEN k % 5 = 0 AND NOT puny THEN 'punycode domain' END,
  CASE WHEN cert THEN 'tls certificate observed' END, CASE WHEN h3 THEN 'quic/http3 destination' END,
  CASE WHEN odd_port THEN 'unusual destination port ' || dst_port END], lambda x: x IS NOT NULL), ' • '), '') AS danger_summary FROM danger"""))
def e18(spark, sf):
    return intel.danger_reasons(danger_flows(spark, sf)).select("flow_id", "danger_summary")


@query("e18_danger_floor", with_("danger_scored", select="""
SELECT flow_id, CASE WHEN look >= 0.8 THEN 'HIGH' WHEN look >= 0.55 THEN 'MEDIUM' WHEN contains(h, 'expired.badssl.com') THEN 'HIGH'
  WHEN ends_with(h, '.badssl.com') THEN 'MEDIUM' WHEN dst_port = 80 AND browsing THEN 'MEDIUM'
  WHEN reputation_score >= 0.7 THEN 'HIGH' WHEN reputation_score >= 0.3 THEN 'MEDIUM' END AS danger_floor FROM danger_scored"""))
def e18_floor(spark, sf):
    return intel.danger_floor(intel.danger_score(danger_flows(spark, sf))).select("flow_id", "danger_floor")


@query("e31_effective_profile", with_("danger", select="""
SELECT flow_id, CASE WHEN k % 3 = 0 THEN 'TRUSTED' WHEN browsing THEN 'BROWSER' ELSE 'DEFAULT' END AS effective_profile FROM danger"""))
def e31(spark, sf):
    f = danger_flows(spark, sf).withColumn("app_profile", F.when(F.col("k") % 3 == 0, "TRUSTED").otherwise("DEFAULT"))
    return intel.effective_profile(f).select("flow_id", "effective_profile")


# ---- alerts made of scored windows
def window_alerts(spark, sf):
    s = scored(spark, sf)
    b = F.col("window_bucket")
    return s.withColumns({
        "alert_id": F.col("id"), "timestamp": F.col("window_end_ms"), "source_model": F.lit("rule"),
        "severity": F.when(F.col("score") >= 0.55, "HIGH").when(F.col("score") >= 0.4, "MEDIUM").otherwise("LOW"),
        "triage_status": F.when(b % 4 == 0, "FALSE_POSITIVE").when(b % 4 == 1, "RESOLVED").otherwise("OPEN"),
        "top_features": F.when(b % 3 == 0, F.array(F.lit("burstiness"), F.lit("flow_count"))).otherwise(
            F.array(F.lit("novelty_score"), F.lit("Burstiness "), F.lit("byte_rate"), F.lit("alpha"))),
        "confidence": F.col("score_b")})


cte("walerts", ["scored"], """
SELECT *, id AS alert_id, window_end_ms AS timestamp, CASE WHEN score >= 0.55 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE window_bucket % 4 WHEN 0 THEN 'FALSE_POSITIVE' WHEN 1 THEN 'RESOLVED' ELSE 'OPEN' END AS triage_status,
  CASE WHEN window_bucket % 3 = 0 THEN ['burstiness', 'flow_count'] ELSE ['novelty_score', 'burstiness', 'byte_rate', 'alpha'] END AS top_features FROM scored
""")


@query("e21_fp_budget", with_("walerts", select="""
SELECT alert_id, n AS fp_count, CASE WHEN severity <> 'LOW' AND n >= 1 THEN CASE severity WHEN 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END ELSE severity END AS budgeted_severity,
  CASE WHEN severity <> 'LOW' AND n >= 1 THEN 'false_positive_budget_exceeded:' || n || '/1' END AS budget_reason
FROM (SELECT *, count(*) FILTER (triage_status = 'FALSE_POSITIVE') OVER (PARTITION BY app_id ORDER BY timestamp RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS n FROM walerts)"""))
def e21(spark, sf):
    return al.fp_budget(window_alerts(spark, sf), 1).select("alert_id", "fp_count", "budgeted_severity", "budget_reason")


@query("e22_suppress", with_("walerts", select="""
, a AS (SELECT *, app_family = 'browser' AS br, app_family IN ('system', 'service') AS sy, window_bucket % 3 = 0 AS burst,
    score_b < 0.48 AND severity <> 'LOW' AS unsure, window_bucket % 5 = 0 AS danger FROM walerts),
b AS (SELECT *, burst AND NOT danger AND (br OR app_family = 'system') AS explained FROM a)
SELECT alert_id, CASE WHEN explained THEN 'LOW' WHEN unsure THEN CASE severity WHEN 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END ELSE severity END AS final_severity,
  nullif(concat_ws(',', CASE WHEN unsure THEN 'low_confidence' END, CASE WHEN explained THEN 'profile_suppression:' || app_family END), '') AS suppression_reason FROM b"""))
def e22(spark, sf):
    a = window_alerts(spark, sf).withColumns({
        "app_profile": F.upper("app_family"), "danger_summary": F.when(F.col("window_bucket") % 5 == 0, "x"),
        "site_hint": F.lit(None).cast("string"), "dst_port": F.lit(443)})
    out = al.suppress(a)
    return out.select("alert_id", "final_severity",
                      F.regexp_replace("suppression_reason", r"low_confidence:[\d.]+", "low_confidence").alias("suppression_reason"))


EVIDENCE = """(CASE WHEN novelty_score >= 0.35 OR novelty_shift >= 0.18 THEN 1 ELSE 0 END + CASE WHEN destination_diversity >= 0.35 OR destination_transition_rate >= 0.25 THEN 1 ELSE 0 END
  + CASE WHEN port_diversity >= 0.2 OR protocol_diversity >= 0.2 THEN 1 ELSE 0 END + CASE WHEN byte_rate_deviation >= 0.4 OR flow_count_deviation >= 0.4 THEN 1 ELSE 0 END
  + CASE WHEN periodic_beacon_score >= 0.55 THEN 1 ELSE 0 END + CASE WHEN low_volume_periodic_score >= 0.35 THEN 1 ELSE 0 END
  + CASE WHEN destination_risk_score >= 0.35 OR suspicious_destination_ratio >= 0.2 THEN 1 ELSE 0 END
  + CASE WHEN transport_metrics_present >= 0.5 AND (syn_rate_total >= 0.15 OR rst_rate_total >= 0.15 OR fragment_rate_total >= 0.05) THEN 1 ELSE 0 END)"""


@query("e23_evidence_strength", with_("scored", select=f"SELECT app_id, window_bucket, {EVIDENCE} AS evidence_strength FROM scored"))
def e23(spark, sf):
    return al.evidence_strength(scored(spark, sf)).select(*KEYS, "evidence_strength")


DAY2 = 2 * 86_400_000
PARAMS = {"threshold": 0.4, "window_ms": DAY2, "min_evidence": 6, "high_bypass": 0.55, "service_count": 3, "default_count": 2,
          "trend_slack": 0.08}
cte("trailed", ["scored"], f"""
SELECT *, count(*) OVER w AS n, first_value(score) OVER w AS fs, max(ev) OVER w AS me FROM (SELECT *, {EVIDENCE} AS ev FROM scored WHERE score >= 0.4)
WINDOW w AS (PARTITION BY app_id, session_id ORDER BY window_end_ms RANGE BETWEEN {DAY2} PRECEDING AND CURRENT ROW)
""")


@query("e24_alert_policy", with_("trailed", select="""
SELECT app_id, window_bucket, n AS candidate_count, round(fs, 6) AS first_score, me AS max_evidence,
  CASE WHEN (n >= CASE WHEN app_family IN ('service', 'system', 'other_app') THEN 3 ELSE 2 END AND score >= fs - 0.08 AND me >= 6) OR (score >= 0.55 AND ev >= 6) THEN 1 ELSE 0 END AS emitted
FROM trailed"""))
def e24(spark, sf):
    out = al.alert_policy(al.evidence_strength(scored(spark, sf)), PARAMS)
    return out.select(*KEYS, "candidate_count", r6("first_score").alias("first_score"), "max_evidence", "emitted")


def grid_sql(grid: dict[str, list]) -> str:
    """The combinations of a parameter grid as a table."""
    sides = [f"(SELECT unnest({values}) AS {name}) AS {name}_" for name, values in grid.items()]
    return f"grid AS (SELECT {', '.join(grid)} FROM {' CROSS JOIN '.join(sides)})"


SEARCH = f"""
ep AS (SELECT app_id, session_id, window_bucket, label, app_family, sum(nw) OVER (PARTITION BY app_id, session_id ORDER BY window_end_ms) AS e FROM (
  SELECT *, CASE WHEN window_end_ms - lag(window_end_ms) OVER (PARTITION BY app_id, session_id ORDER BY window_end_ms) <= {DAY2} THEN 0 ELSE 1 END AS nw FROM scored)),
hit AS (SELECT t.app_id, t.window_bucket, g.*, CASE WHEN (n >= CASE WHEN t.app_family IN ('service', 'system', 'other_app') THEN service_count ELSE default_count END
    AND score >= fs - 0.08 AND me >= min_evidence) OR (score >= high_bypass AND ev >= min_evidence) THEN 1 ELSE 0 END AS s FROM trailed t CROSS JOIN grid g),
votes AS (SELECT ep.app_family, app_id, session_id, e, service_count, default_count, min_evidence, high_bypass, max(label) AS label, max(coalesce(s, 0)) AS score
  FROM (SELECT ep.*, g.* FROM ep CROSS JOIN grid g) ep LEFT JOIN hit USING (app_id, window_bucket, service_count, default_count, min_evidence, high_bypass) GROUP BY ALL)"""


@query("e25_policy_search", with_("trailed", select=", " + grid_sql(al.GLOBAL_GRID) + "," + SEARCH + f"""
SELECT service_count, default_count, min_evidence, CAST(high_bypass AS DOUBLE) AS high_bypass, tp, fp, fn, tn, {rounded(['precision', 'recall', 'f1'])} FROM (SELECT *, {RATES} FROM (
  SELECT service_count, default_count, min_evidence, high_bypass, {CONF.format(t=0.5)} FROM votes GROUP BY ALL))"""))
def e25(spark, sf):
    s = al.evidence_strength(scored(spark, sf))
    return show(al.policy_search(s, None, 0.4, DAY2), [*al.GLOBAL_GRID, "tp", "fp", "fn", "tn"], ["precision", "recall", "f1"])


@query("e25_family_policies", with_("trailed", select=", " + grid_sql(al.FAMILY_GRID) + "," + SEARCH + f"""
, m AS (SELECT *, {RATES} FROM (SELECT app_family, service_count, default_count, min_evidence, high_bypass, {CONF.format(t=0.5)} FROM votes GROUP BY ALL)),
ok AS (SELECT app_family FROM scored GROUP BY 1 HAVING count(*) >= 100 AND sum(label) > 0 AND sum(label) < count(*))
SELECT app_family, round(o1, 6) AS first_metric, round(o2, 6) AS second_metric FROM (SELECT *, row_number() OVER (PARTITION BY app_family ORDER BY o1 DESC, o2 DESC, o3 DESC) AS rn FROM (
  SELECT *, CASE app_family WHEN 'service' THEN precision WHEN 'malware' THEN recall ELSE f1 END AS o1,
    CASE app_family WHEN 'service' THEN -false_positive_rate ELSE precision END AS o2, CASE app_family WHEN 'malware' THEN f1 ELSE recall END AS o3
  FROM m WHERE app_family IN (SELECT app_family FROM ok))) WHERE rn = 1"""))
def e25_family(spark, sf):
    s = al.evidence_strength(scored(spark, sf))
    best = al.best_policy(al.policy_search(s, None, 0.4, DAY2, by_family=True), True)
    f = F.col("app_family")
    one = F.when(f == "service", F.col("precision")).when(f == "malware", F.col("recall")).otherwise(F.col("f1"))
    two = F.when(f == "service", -F.col("false_positive_rate")).otherwise(F.col("precision"))
    return best.select("app_family", r6(one).alias("first_metric"), r6(two).alias("second_metric"))


CORR = "sha256(app_id || '|rule|' || array_to_string(list_sort(top_features)[1:3], '|'))"


@query("e26_correlate", with_("walerts", select=f"""
SELECT app_id, correlation_key, count(*) AS occurrence_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, round(max(score), 6) AS score,
  CASE max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  arg_max(triage_status, timestamp) AS triage_status
FROM (SELECT *, sum(nw) OVER (PARTITION BY app_id, correlation_key ORDER BY timestamp) AS r FROM (
  SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY app_id, correlation_key ORDER BY timestamp) <= 21600000 THEN 0 ELSE 1 END AS nw
  FROM (SELECT *, {CORR} AS correlation_key FROM walerts))) GROUP BY app_id, correlation_key, r"""))
def e26(spark, sf):
    out = al.correlate_alerts(window_alerts(spark, sf), 21_600_000)
    return out.select("app_id", "correlation_key", "occurrence_count", "first_seen", "last_seen", r6("score").alias("score"),
                      "severity", "triage_status")


@query("e27_pending", with_("walerts", select=f"""
, k AS (SELECT *, {CORR} AS correlation_key, CASE WHEN score >= 0.7 THEN 1 ELSE 0 END AS emitted, {EVIDENCE} AS ev FROM walerts),
r AS (SELECT *, sum(emitted) OVER (PARTITION BY app_id, correlation_key ORDER BY timestamp) AS n, sum(emitted) OVER (PARTITION BY app_id, correlation_key) AS all_n FROM k)
SELECT app_id, correlation_key, round(max(score), 6) AS score, count(*) AS occurrence_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  max(ev) AS max_evidence_strength, arg_max(ev, timestamp) AS evidence_strength FROM r WHERE emitted = 0 AND n = all_n GROUP BY ALL"""))
def e27(spark, sf):
    a = al.evidence_strength(window_alerts(spark, sf)).withColumns({
        "correlation_key": al.correlation_key(), "emitted": (F.col("score") >= 0.7).cast("int")})
    return al.pending_alerts(a).select("app_id", "correlation_key", r6("score").alias("score"), "occurrence_count",
                                       "first_seen", "last_seen", "max_evidence_strength", "evidence_strength")


@query("e28_feedback_thresholds", with_("walerts", recursive=True, select="""
, t AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY timestamp) AS rn FROM walerts),
w AS (SELECT app_id, 0::BIGINT AS rn, 0.35::DOUBLE AS lo, 0.6::DOUBLE AS md, 0.85::DOUBLE AS hi FROM t GROUP BY app_id
  UNION ALL SELECT x.app_id, x.rn, lo2, greatest(lo2, md2), greatest(greatest(lo2, md2), hi2) FROM (SELECT t.app_id, t.rn,
    CASE triage_status WHEN 'FALSE_POSITIVE' THEN least(0.90, lo + 0.02) WHEN 'RESOLVED' THEN greatest(0.02, lo - 0.01) ELSE lo END AS lo2,
    CASE triage_status WHEN 'FALSE_POSITIVE' THEN least(0.95, md + 0.02) WHEN 'RESOLVED' THEN greatest(0.05, md - 0.01) ELSE md END AS md2,
    CASE triage_status WHEN 'FALSE_POSITIVE' THEN least(0.99, hi + 0.02) WHEN 'RESOLVED' THEN greatest(0.15, hi - 0.01) ELSE hi END AS hi2
    FROM w JOIN t ON t.app_id = w.app_id AND t.rn = w.rn + 1) x)
SELECT t.alert_id, round(lo, 6) AS low_after, round(md, 6) AS medium_after, round(hi, 6) AS high_after FROM w JOIN t USING (app_id, rn)"""))
def e28(spark, sf):
    a = window_alerts(spark, sf).select("alert_id", "app_id", "timestamp", "triage_status")
    out = st.feedback_thresholds(a, {"low": 0.35, "medium": 0.6, "high": 0.85}, ["timestamp", "alert_id"])
    return show(out, ["alert_id"], ["low_after", "medium_after", "high_after"])


@query("e29_explanation", with_("scored", select="""
SELECT app_id, window_bucket, 'Top contributors: ' || 'novelty_score (' || CASE WHEN n / m >= 0.66 THEN 'high' WHEN n / m >= 0.33 THEN 'moderate' ELSE 'low' END
  || ' impact), outbound_ratio (' || CASE WHEN o / m >= 0.66 THEN 'high' WHEN o / m >= 0.33 THEN 'moderate' ELSE 'low' END || ' impact).' AS explanation
FROM (SELECT *, novelty_score AS n, outbound_ratio AS o, greatest(novelty_score, outbound_ratio, 1e-9) AS m FROM scored)"""))
def e29(spark, sf):
    s = scored(spark, sf).withColumns({
        "top_features": F.array(F.lit("novelty_score"), F.lit("absent"), F.lit("outbound_ratio")),
        "contributions": F.array(*[F.struct(F.lit(c).alias("feature"), (-F.col(c)).alias("value"))
                                   for c in ("novelty_score", "outbound_ratio")])})
    return s.select(*KEYS, al.explanation_text().alias("explanation"))


@query("e30_blend_search", with_("scored", select=f"""
, {grid_sql(al.BLEND_GRID)},
b AS (SELECT service_weight AS sw, service_cap AS cap, malware_mode AS mode, other_weight AS ow, label, greatest(0, least(1, CASE WHEN app_family IN ('malware', 'remote_access') THEN CASE mode WHEN 'max' THEN greatest(score, score_b) WHEN 'quiet' THEN score_b ELSE 0.35::DOUBLE * score + 0.65::DOUBLE * score_b END
  WHEN app_family IN ('service', 'system', 'other_app') THEN least(sw::DOUBLE * score + (1 - sw::DOUBLE) * score_b, score_b + cap::DOUBLE) ELSE ow::DOUBLE * score + (1 - ow::DOUBLE) * score_b END))::DOUBLE AS score FROM scored CROSS JOIN grid),
s AS (SELECT *, {RATES} FROM (SELECT sw, cap, mode, ow, step, CASE WHEN step = 200 THEN 1.0::DOUBLE ELSE step * (1.0::DOUBLE / 200) END AS threshold, {CONF.format(t='threshold')}
  FROM range(201) r(step) CROSS JOIN b GROUP BY ALL)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sw, cap, mode, ow ORDER BY f1 DESC, precision DESC, recall DESC, threshold) AS rn FROM s) WHERE rn = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sw, cap, mode, ow ORDER BY CASE WHEN false_positive_rate <= 0.1 THEN 0 ELSE 1 END, recall DESC, f1 DESC, precision DESC, threshold) AS rn FROM s) WHERE rn = 1)
SELECT CAST(sw AS DOUBLE) AS service_weight, CAST(cap AS DOUBLE) AS service_cap, mode AS malware_mode, CAST(ow AS DOUBLE) AS other_weight,
  round(f.f1, 6) AS best_f1, round(c.recall, 6) AS constrained_recall FROM f JOIN c USING (sw, cap, mode, ow)"""))
def e30(spark, sf):
    return show(al.blend_search(scored(spark, sf), "score", "score_b", 0.1), list(al.BLEND_GRID), ["best_f1", "constrained_recall"])


# ---- detectors that remember
G1 = st.DRIFT_FEATURES


def _g1(c: str) -> str:
    return f"abs(({c} - coalesce(avg({c}) OVER p, 0)) / CASE WHEN count(*) OVER p >= 2 THEN sqrt(greatest(1e-9, var_samp({c}) OVER p)) ELSE 1 END)"


@query("g01_running_drift", with_("scored", select=f"""
SELECT app_id, window_bucket, round(CASE WHEN n >= 25 THEN least(1, z / {len(G1)} / 5) ELSE 0 END, 6) AS drift_score, CASE WHEN n >= 25 THEN 1 ELSE 0 END AS drift_mature
FROM (SELECT app_id, window_bucket, count(*) OVER p AS n, {' + '.join(_g1(c) for c in G1)} AS z FROM scored
  WINDOW p AS (PARTITION BY app_id ORDER BY window_end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def g01(spark, sf):
    return show(st.running_drift(scored(spark, sf)), [*KEYS, "drift_mature"], ["drift_score"])


@query("g02_beacon_score", with_("flows", select="""
, t AS (SELECT DISTINCT app_id, destination_key, timestamp_end FROM flows),
d AS (SELECT *, (timestamp_end - lag(timestamp_end) OVER (PARTITION BY app_id, destination_key ORDER BY timestamp_end))::DOUBLE AS d FROM t),
s AS (SELECT app_id, destination_key, timestamp_end, count(d) OVER w AS n, avg(d) OVER w AS m, stddev_pop(d) OVER w AS sd FROM d
  WINDOW w AS (PARTITION BY app_id, destination_key ORDER BY timestamp_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT flow_id, round(CASE WHEN n >= 4 THEN 0.75 * greatest(0, least(1, 1 - sd / m)) + 0.25 * CASE WHEN m < 15000 THEN m / 15000 WHEN m > 600000 THEN 600000 / m ELSE 1 END ELSE 0 END, 6) AS beacon_score
FROM flows JOIN s USING (app_id, destination_key, timestamp_end)"""))
def g02(spark, sf):
    return show(st.beacon_score(flow_view(spark, sf)), ["flow_id"], ["beacon_score"])


FLOOR = """least(0.6, greatest(0, CASE WHEN destination_risk_score >= 0.1 THEN least(0.55, 0.04 + destination_risk_score * 0.45) ELSE 0 END,
  CASE WHEN lookalike_score >= 0.35 THEN least(0.45, 0.03 + lookalike_score * 0.34) ELSE 0 END,
  CASE WHEN suspicious_destination_ratio >= 0.1 THEN least(0.36, 0.02 + suspicious_destination_ratio * 0.28) ELSE 0 END,
  CASE WHEN greatest(periodic_beacon_score, low_volume_periodic_score) >= 0.35 THEN greatest(periodic_beacon_score, low_volume_periodic_score) * 0.22 ELSE 0 END,
  CASE WHEN novelty_score >= 0.2 THEN least(0.18, 0.01 + novelty_score * 0.12) ELSE 0 END,
  CASE WHEN novelty_shift >= 0.12 OR destination_diversity_shift >= 0.18 THEN 0.035 + greatest(novelty_shift, destination_diversity_shift) * 0.18 ELSE 0 END,
  CASE WHEN destination_transition_rate >= 0.25 OR destination_diversity >= 0.45 THEN 0.025 + greatest(destination_transition_rate, destination_diversity) * 0.08 ELSE 0 END,
  CASE WHEN transport_metrics_present >= 0.5 AND (syn_rate_total >= 0.2 OR rst_rate_total >= 0.2 OR fragment_rate_total >= 0.05) THEN 0.04 ELSE 0 END,
  CASE WHEN high_port_ratio >= 0.75 AND web_flow_ratio < 0.35 THEN 0.025 ELSE 0 END))"""


@query("g03_risk_floor", with_("scored", select=f"SELECT app_id, window_bucket, round({FLOOR}, 6) AS risk_floor FROM scored"))
def g03_floor(spark, sf):
    return scored(spark, sf).select(*KEYS, r6(st.risk_floor_column()).alias("risk_floor"))


@query("g03_statistical")
def g03(spark, sf):
    out = st.statistical_score(scored(spark, sf))
    return show(out, KEYS, ["statistical_score", "statistical_confidence"])


@query("g04_feedback")
def g04(spark, sf):
    s = scored(spark, sf)
    triage = s.filter("window_bucket % 4 < 2").withColumn(
        "feedback", F.when(F.col("window_bucket") % 4 == 0, "benign").otherwise("dangerous")).withColumn(
        "window_end_ms", F.col("window_end_ms") + 1)
    return show(st.statistical_score_with_feedback(s, triage), KEYS, ["statistical_score"])


@query("g05_multivariate")
def g05(spark, sf):
    return show(st.multivariate_score(scored(spark, sf)), KEYS, ["multivariate_score", "multivariate_confidence"])


@query("g06_bucket_state", with_("scored", select="""
SELECT app_id, window_bucket, CASE WHEN novelty_score >= 0.85 THEN 'exploratory' WHEN novelty_score >= 0.45 THEN 'mixed' ELSE 'stable' END || '|'
  || CASE WHEN byte_rate >= 40000 OR flow_count >= 24 THEN 'burst' WHEN byte_rate >= 8000 OR flow_count >= 8 THEN 'active' ELSE 'quiet' END || '|'
  || CASE WHEN destination_diversity >= 0.8 THEN 'spread' WHEN destination_diversity >= 0.35 THEN 'varied' ELSE 'focused' END || '|'
  || CASE WHEN protocol_diversity >= 0.6 OR port_diversity >= 0.6 THEN 'mixed' WHEN high_port_ratio >= 0.75 THEN 'high_port' ELSE 'narrow' END AS bucket_state FROM scored"""))
def g06_state(spark, sf):
    return scored(spark, sf).select(*KEYS, st.bucket_state().alias("bucket_state"))


@query("g06_sequence")
def g06(spark, sf):
    return show(st.sequence_score(scored(spark, sf)), KEYS, ["sequence_score", "sequence_confidence"])


@query("g07_stability", with_("walerts", recursive=True, select="""
, t AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY timestamp) AS rn FROM walerts),
w AS (SELECT app_id, 0::BIGINT AS rn, 0 AS streak FROM t GROUP BY app_id UNION ALL
  SELECT t.app_id, t.rn, CASE severity WHEN 'HIGH' THEN streak + 1 WHEN 'MEDIUM' THEN greatest(0, streak - 1) ELSE 0 END FROM w JOIN t ON t.app_id = w.app_id AND t.rn = w.rn + 1)
SELECT alert_id, CASE WHEN severity = 'HIGH' AND streak < 3 THEN 'MEDIUM' ELSE severity END AS stable_severity FROM w JOIN t USING (app_id, rn)"""))
def g07(spark, sf):
    return st.stabilize(window_alerts(spark, sf)).select("alert_id", "stable_severity")


@query("g08_smooth", with_("scored", recursive=True, select="""
, t AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY window_end_ms) AS rn FROM scored),
w AS (SELECT app_id, rn, score AS ema, score AS x FROM t WHERE rn = 1 UNION ALL
  SELECT t.app_id, t.rn, 0.35 * t.score + 0.65 * w.ema, t.score FROM w JOIN t ON t.app_id = w.app_id AND t.rn = w.rn + 1)
SELECT t.app_id, t.window_bucket, round(CASE WHEN rn = 1 THEN x ELSE greatest(0, least(1, 0.45 * x + 0.55 * ema)) END, 6) AS smoothed FROM w JOIN t USING (app_id, rn)"""))
def g08(spark, sf):
    return show(st.smooth(scored(spark, sf)), KEYS, ["smoothed"])
