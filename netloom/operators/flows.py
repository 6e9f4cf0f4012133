"""Per-flow preparation: typed columns, calendar parts, transport, port and host features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import constants as K
from netloom.functions.scalars import C, col, contains_any, flag, is_multicast, is_private, limit, number, text, token


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def optional(df: DataFrame, name: str, default: float = 0.0) -> Column:
    return number(name, default) if name in df.columns else F.lit(float(default))


def app_family(app: C) -> Column:
    """Class of an application id by ordered token rules."""
    name = token(app)
    out = F.when(F.lit(False), F.lit(""))
    for prefix, family in K.FAMILY_PREFIXES.items():
        out = out.when(name.startswith(prefix), family)
    for family, words in K.FAMILY_WORDS.items():
        out = out.when(contains_any(name, words), family)
    return out.otherwise(K.DEFAULT_FAMILY)


def calendar_columns(ms: C = "timestamp_end") -> dict[str, Column]:
    at = F.timestamp_millis(col(ms).cast("long"))
    day = (F.weekday(at) + 1).cast("double")
    return {
        "hour_of_day": F.hour(at).cast("double"),
        "day_of_week": day,
        "is_weekend": flag(day >= 6),
        "data_quality_score": F.lit(1.0),
    }


def transport_columns(df: DataFrame) -> dict[str, Column]:
    has_ttl = optional(df, "has_ttl_metrics")
    gap = F.abs(optional(df, "sttl") - optional(df, "rttl")) / 255.0
    given = "ttl_gap" in df.columns
    out = {
        "ttl_gap": limit(optional(df, "ttl_gap"), 0, 1) if given
        else limit(F.when(has_ttl > 0, gap).otherwise(0.0), 0, 1),
        "ttl_metrics_present": limit(has_ttl, 0, 1),
    }
    for rate in K.SUMMED_RATES:
        out[f"{rate}_rate_total"] = limit(optional(df, f"s_{rate}_rate") + optional(df, f"r_{rate}_rate"), 0)
    for source, name in K.HALVED_MEANS.items():
        out[name] = limit((optional(df, f"s_{source}") + optional(df, f"r_{source}")) * 0.5, 0)
    out["transport_metrics_present"] = F.greatest(*[limit(optional(df, c), 0, 1) for c in K.AVAILABILITY_FLAGS])
    return out


def port_columns(port: C = "dst_port", total_bytes: C = "total_bytes") -> dict[str, Column]:
    return {
        "dns_flow": flag(col(port).isin(K.DNS_PORTS)),
        "web_flow": flag(col(port).isin(K.WEB_PORTS)),
        "high_port": flag(col(port) >= K.HIGH_PORT),
        "small_flow": flag(col(total_bytes) <= K.SMALL_FLOW_BYTES),
    }


def destination_host(df: DataFrame) -> Column:
    for name in ("dst_ip", "destination_ip"):
        if name in df.columns:
            return F.coalesce(col(name).cast("string"), F.lit(""))
    key = col("destination_key") if "destination_key" in df.columns else F.lit("unknown:0")
    return F.split_part(F.coalesce(key, F.lit("unknown:0")), F.lit(":"), F.lit(1))


def host_tests(host: C) -> dict[str, Column]:
    h = F.lower(col(host))
    return {
        "suspicious_tld": h.rlike(r"\.(" + "|".join(K.FEATURE_RISKY_TLDS) + ")$"),
        "punycode": h.contains("xn--"),
        "digit_substitution": h.rlike(K.DIGIT_SUBSTITUTION),
        "long_host": F.length(h) >= 32,
        "many_labels": F.length(h) - F.length(F.replace(h, F.lit("."))) >= 4,
    }


def host_risk_columns(df: DataFrame, host: C, tests: dict[str, Column] | None = None) -> dict[str, Column]:
    """Lookalike, threat and risk values of the destination host; ``tests`` may be stored already."""
    tests = tests or host_tests(host)
    given = limit(optional(df, "lookalike_score"), 0, 1)
    derived = limit(flag(tests["digit_substitution"]) * 0.45 + flag(tests["punycode"]) * 0.35, hi=1.0)
    lookalike = F.when(given == 0.0, derived).otherwise(given) if "lookalike_score" in df.columns else derived
    threat = limit(optional(df, "has_threat_tags"), 0, 1)
    suspicious = F.lit(False)
    for t in tests.values():
        suspicious = suspicious | t
    weights = K.HOST_RISK_WEIGHTS
    risk = F.greatest(lookalike, threat * weights["threat_tag"],
                      *[flag(t) * weights[name] for name, t in tests.items()])
    return {
        "destination_risk": limit(risk, 0, 1),
        "lookalike_score_flow": lookalike,
        "suspicious_destination": flag(suspicious),
        "known_identity": flag(F.lower(col(host)).rlike("[a-z]")),
        "mitre_technique_flow": limit(optional(df, "has_mitre_techniques"), 0, 1),
        "threat_tag_flow": threat,
    }


#: Columns made of the destination host and of what is given about it.
HOST_COLUMNS = ["private_destination", "multicast_destination", "destination_risk", "lookalike_score_flow",
                "suspicious_destination", "known_identity"]


def host_inputs(df: DataFrame) -> list[str]:
    """Columns of flows that decide their host columns."""
    host = next((c for c in ("dst_ip", "destination_ip", "destination_key") if c in df.columns), "")
    return [c for c in (host, "lookalike_score", "has_threat_tags") if c in df.columns]


def with_host_columns(df: DataFrame) -> DataFrame:
    df = df.withColumn("_host", F.lower(destination_host(df)))
    # Columns of their own: what is used several times below is evaluated once.
    tests = host_tests("_host")
    df = df.withColumns({f"_t_{n}": t for n, t in tests.items()})
    return df.withColumns({
        "private_destination": flag(is_private("_host")),
        "multicast_destination": flag(is_multicast("_host")),
        **host_risk_columns(df, "_host", {n: F.col(f"_t_{n}") for n in tests}),
    }).drop("_host", *[f"_t_{n}" for n in tests])


def host_risk(df: DataFrame) -> DataFrame:
    return df.withColumns(host_risk_columns(df, destination_host(df)))


def prepare_flows(df: DataFrame) -> DataFrame:
    """Typed flow columns plus every per-flow feature the windows aggregate."""
    require(df, K.REQUIRED_FLOW_COLUMNS)
    base = df.withColumn("timestamp_end", number("timestamp_end", None).cast("long")).filter(
        F.col("timestamp_end").isNotNull())
    base = base.withColumns({
        **{c: number(c) for c in ("bytes_out", "bytes_in", "packets_out", "packets_in")},
        "dst_novelty": limit(number("dst_novelty"), 0, 1),
        "duration_ms": limit(optional(df, "duration_ms"), 0),
        "dst_port": optional(df, "dst_port").cast("long"),
        "protocol": F.upper(text("protocol", "UNKNOWN")) if "protocol" in df.columns else F.lit("UNKNOWN"),
        "destination_key": text("destination_key", "unknown:0") if "destination_key" in df.columns
        else F.lit("unknown:0"),
        **{c: text(c, d) if c in df.columns else F.lit(d) for c, d in K.PROVENANCE.items()},
    })
    if "label" not in base.columns:
        base = base.withColumn("label", optional(base, "is_anomaly").cast("int"))
    base = base.withColumns({
        "label": number("label").cast("int"),
        "total_bytes": F.col("bytes_out") + F.col("bytes_in"),
        "total_packets": limit(F.col("packets_out") + F.col("packets_in"), 1),
    })
    return with_host_columns(base.withColumns({**calendar_columns(), **transport_columns(base), **port_columns()}))
