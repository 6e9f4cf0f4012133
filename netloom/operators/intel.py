"""Destination intelligence: hosts, lookalikes, tags, techniques, danger evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.scalars import C, clip, clip01, col, contains_any, flag
from netloom.operators.scoring import when_list

# Protected brand names, in order.
BRANDS = ["google", "microsoft", "apple", "meta", "paypal", "amazon", "github", "facebook", "instagram",
          "whatsapp", "telegram", "outlook", "gmail", "dropbox", "icloud", "netflix", "spotify",
          "bankofamerica", "chase", "wellsfargo"]
# Second-level labels used under two-letter country domains.
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "ac"]
RISKY_TLDS = ["zip", "mov", "top", "xyz", "click", "gq", "work"]
COMMON_PORTS = [53, 80, 123, 443, 853]
BROWSER_PORTS = [80, 443, 8080, 8443, 853]


def _idna(hosts: pd.Series) -> pd.Series:
    def encode(h):
        if h is None or h.isascii():
            return h
        try:
            return h.encode("idna").decode("ascii")
        except UnicodeError:
            return h

    return hosts.map(encode)


def normalize_host(host: C, idna: bool = False) -> Column:
    """Lower case, outer dots and a leading ``www.`` removed; other scripts to ASCII on request."""
    h = F.lower(F.trim(F.trim(col(host)), F.lit(".")))
    if idna:
        h = F.pandas_udf(_idna, "string")(h)
    return F.regexp_replace(h, r"^www\.", "")


def registrable_domain(host: C) -> Column:
    h = col(host)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")

    def at(i: int) -> Column:
        return F.try_element_at(labels, F.lit(i))

    country = (F.length(at(-1)) == 2) & at(-2).isin(SECOND_LEVEL)
    return F.when(F.size(labels) <= 2, h).when(country, F.concat_ws(".", at(-3), at(-2), at(-1))).otherwise(
        F.concat_ws(".", at(-2), at(-1)))


def canonical_name(domain: C) -> Column:
    """First label with look-alike digits replaced by letters."""
    bare = F.lower(F.split_part(col(domain), F.lit("."), F.lit(1)))
    return F.replace(F.translate(bare, "013457", "oleast"), F.lit("rn"), F.lit("m"))


def lookalike_columns(domain: C, brands: Column | None = None) -> dict[str, Column]:
    """Closest brand by edit distance (earlier brand on a tie) and its similarity, if at least 0.45.

    The brand list is an array inside the expression: no join, no shuffle, nothing to skew.
    """
    names = brands if brands is not None else F.array(*[F.lit(b) for b in BRANDS])
    bare = canonical_name(domain)
    ranked = F.transform(names, lambda b, i: F.struct(F.levenshtein(bare, b).alias("d"), i.alias("i"), b.alias("b")))
    best = F.array_min(ranked)
    longest = F.greatest(F.length(bare), F.length(best["b"]), F.lit(1))
    score = F.when(best["d"] == 0, 1.0).otherwise(clip01(1.0 - best["d"] / longest))
    known = (F.length(bare) > 0) & (score >= 0.45)
    return {"brand_match": F.when(known, best["b"]), "lookalike_score": F.when(known, score).otherwise(0.0)}


def lookalike(df: DataFrame, domain: str = "registrable_domain", brands: Column | None = None) -> DataFrame:
    return df.withColumns(lookalike_columns(domain, brands))


def parse_brands(csv: C) -> Column:
    """Brand names from text with one name per line; the default list when there is none."""
    lines = F.transform(F.split(F.coalesce(col(csv), F.lit("")), r"\r?\n"), lambda x: F.lower(F.trim(x)))
    names = F.array_distinct(F.filter(lines, lambda x: x != ""))
    return F.when(F.size(names) > 0, names).otherwise(F.array(*[F.lit(b) for b in BRANDS]))


def first_text(*cols: C) -> Column:
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in cols])


def unusual_port(port: C) -> Column:
    return ~col(port).isin(COMMON_PORTS) & (col(port) > 0)


def analyze_destinations(df: DataFrame, brands: Column | None = None) -> DataFrame:
    """Insight columns from http_host, tls_sni, site_hint, dns_query_name and dst_port."""
    def has(c: str) -> Column:
        return first_text(c).isNotNull() if c in df.columns else F.lit(False)

    hosts = [c for c in ("http_host", "tls_sni", "site_hint", "dns_query_name") if c in df.columns]
    out = df.withColumn("normalized_host", normalize_host(first_text(*hosts)))
    out = out.withColumn("registrable_domain", registrable_domain("normalized_host"))
    out = out.withColumns(lookalike_columns("registrable_domain", brands))
    host = F.coalesce(F.col("normalized_host"), F.lit(""))
    out = out.withColumns({
        "punycode_present": host.contains("xn--"),
        "digit_substitution_present": host.rlike("[0-9]"),
        "suspicious_tld": host.rlike(r"\.(" + "|".join(RISKY_TLDS) + ")$"),
    })
    c = F.col
    tags = when_list([
        (c("punycode_present"), "punycode_domain"),
        (c("suspicious_tld"), "suspicious_tld"),
        (c("lookalike_score") >= 0.55, "phishing_lookalike"),
        (c("digit_substitution_present") & (c("lookalike_score") >= 0.45), "digit_substitution_lookalike"),
        (c("dst_port") == 80, "plaintext_web"),
        (unusual_port("dst_port"), "unusual_destination_port"),
    ])
    out = out.withColumn("threat_tags", tags)
    encrypted = has("tls_sni") | has("site_hint")
    techniques = when_list([
        (encrypted, "T1071.001"),
        (has("dns_query_name"), "T1071.004"),
        (F.exists("threat_tags", lambda t: t.contains("lookalike")), "T1566"),
        (F.array_contains("threat_tags", "unusual_destination_port"), "T1571"),
        (encrypted, "T1573"),
    ])
    return out.withColumn("mitre_techniques", techniques)


def endpoint_techniques(df: DataFrame) -> DataFrame:
    """Technique ids in the order the endpoint finds them."""
    c = F.col
    dns, sni, path = (first_text(n).isNotNull() for n in ("dns_query_name", "tls_sni", "http_path"))
    dots = F.length("dns_query_name") - F.length(F.replace(c("dns_query_name"), F.lit(".")))
    encrypted = sni | c("http3_detected") | first_text("tls_alpn").isNotNull()
    lure = F.exists("threat_tags", lambda t: t.contains("lookalike") | t.contains("phishing"))
    return df.withColumn("mitre_techniques", when_list([
        (lure, "T1566"), (dns, "T1071.004"), (dns & (c("dst_novelty") >= 0.95) & (dots >= 4), "T1568"),
        (encrypted, "T1573"), (encrypted, "T1071.001"), (unusual_port("dst_port"), "T1571"),
        (path & c("http_method").isin("GET", "POST"), "T1105")]))


# Browser packages.
BROWSER_APPS = [
    "com.android.chrome", "org.mozilla.firefox", "org.mozilla.firefox_beta", "org.mozilla.fenix",
    "com.microsoft.emmx", "com.brave.browser", "com.opera.browser", "com.opera.mini.native",
    "com.sec.android.app.sbrowser", "com.duckduckgo.mobile.android", "com.vivaldi.browser",
    "com.kiwibrowser.browser",
]


def browser_like(apps: list[str] | None = None) -> Column:
    web = F.col("dst_port").isin(BROWSER_PORTS)
    return (F.col("app_id").isin(apps or BROWSER_APPS) | (F.col("app_id").startswith("uid:") & web)
            | (first_text("site_hint").isNotNull() & web))


def effective_profile(df: DataFrame, profile: str = "app_profile") -> DataFrame:
    """A DEFAULT profile becomes BROWSER where the flow looks like browsing."""
    base = F.col(profile)
    return df.withColumn("effective_profile", F.when((base == "DEFAULT") & browser_like(), "BROWSER").otherwise(base))


# TLS test hosts and what each of them shows, first match wins.
TEST_HOSTS = {
    "expired.badssl.com": "expired TLS certificate test host",
    "self-signed.badssl.com": "self-signed TLS certificate test host",
    "wrong.host.badssl.com": "TLS hostname mismatch test host",
    "revoked.badssl.com": "revoked TLS certificate test host",
    "pinning-test.badssl.com": "certificate pinning test host",
    "mixed.badssl.com": "mixed-content TLS test host",
    "http.badssl.com": "plaintext HTTP security test host",
}
LURES = ["login-", "verify-", "secure-", "update-", "password-", "billing-"]
TRACKERS = ["doubleclick", "googlesyndication", "tracking", "telemetry"]
BAD_CERT_HOSTS = ["expired.badssl.com", "self-signed.badssl.com", "wrong.host.badssl.com"]
PLAIN_HOSTS = ["http.badssl.com", "neverssl.com"]


def _any(host: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | host.contains(w)
    return out


def _site() -> Column:
    return F.lower(F.coalesce(F.col("site_hint"), F.lit("")))


def _test_host(host: Column) -> Column:
    return host.endswith(".badssl.com") | (host == "badssl.com")


def _ip_literal(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def _observed_cert(df: DataFrame) -> Column:
    return first_text("tls_leaf_subject").isNotNull() if "tls_leaf_subject" in df.columns else F.lit(False)


def _quic(df: DataFrame) -> Column:
    return F.coalesce(F.col("http3_detected"), F.lit(False)) if "http3_detected" in df.columns else F.lit(False)


def danger_score(df: DataFrame, name: str = "reputation_score") -> DataFrame:
    """Additive evidence from host, port and brand similarity, at most 1."""
    h, c = _site(), F.col
    evidence = [
        (clip(c("lookalike_score") * 0.45, 0, 0.45), None),
        (0.22, c("punycode_present")), (0.18, c("suspicious_tld")),
        (0.45, (c("dst_port") == 80) & browser_like()),
        (0.32, _test_host(h)), (0.24, _any(h, BAD_CERT_HOSTS)), (0.28, _any(h, PLAIN_HOSTS)),
        (0.35, h.contains("xn--") | h.endswith(".zip") | h.endswith(".mov")),
        (0.25, _any(h, LURES)), (0.18, _any(h, TRACKERS)),
        (0.08, _observed_cert(df)), (0.05, _quic(df)), (0.12, _ip_literal(h)), (0.12, unusual_port("dst_port")),
    ]
    total = F.lit(0.0)
    for weight, test in evidence:
        total = total + (weight if test is None else flag(test) * weight)
    return df.withColumn(name, clip01(total))


def danger_reasons(df: DataFrame) -> DataFrame:
    """Readable reasons, without repeats, in order; and their joined text (null when none)."""
    h, c = _site(), F.col
    known = F.when(F.lit(False), F.lit(""))
    for needle, text in TEST_HOSTS.items():
        known = known.when(h.contains(needle), text)
    known = known.when(_test_host(h), "TLS security test host").when(
        h.contains("neverssl.com"), "browser plaintext web test host")
    phishing = h.contains("xn--") | h.rlike(r"\.(" + "|".join(RISKY_TLDS) + ")$") | _any(h, [*LURES, "signin-"])
    tracking = _any(h, [*TRACKERS, "googleadservices", "ads."])
    brand = first_text("brand_match")
    head = when_list([
        ((c("dst_port") == 80) & browser_like(), "insecure plaintext web destination"),
        (known.isNotNull(), known),
        (phishing, "possible phishing-style domain"),
        (tracking, "tracking or telemetry destination"),
        (_any(h, ["malware", "phish", "scam"]), "matches a locally suspicious keyword list"),
        (_ip_literal(h), "host appears as a direct IP literal"),
        ((c("lookalike_score") >= 0.55) & brand.isNotNull(), F.concat(F.lit("lookalike domain similar to "), brand)),
        (c("punycode_present"), "punycode domain"),
        (c("suspicious_tld"), "suspicious top-level domain"),
    ])
    tags = F.transform("threat_tags", lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    tail = when_list([
        (_observed_cert(df), "tls certificate observed"),
        (_quic(df), "quic/http3 destination"),
        (unusual_port("dst_port"), F.concat(F.lit("unusual destination port "), c("dst_port").cast("string"))),
    ])
    reasons = F.array_distinct(F.concat(head, tags, tail))
    return df.withColumn("danger_reasons", reasons).withColumn(
        "danger_summary", F.when(F.size("danger_reasons") > 0, F.concat_ws(" • ", "danger_reasons")))


def danger_floor(df: DataFrame, reputation: str = "reputation_score") -> DataFrame:
    """Least severity the evidence demands; null when it demands none."""
    h, c = _site(), F.col
    floor = (F.when(c("lookalike_score") >= 0.80, "HIGH").when(c("lookalike_score") >= 0.55, "MEDIUM")
             .when(_any(h, BAD_CERT_HOSTS), "HIGH").when(_test_host(h), "MEDIUM").when(_any(h, PLAIN_HOSTS), "MEDIUM")
             .when((c("dst_port") == 80) & browser_like(), "MEDIUM")
             .when(c(reputation) >= 0.70, "HIGH").when(c(reputation) >= 0.30, "MEDIUM"))
    return df.withColumn("danger_floor", floor)
