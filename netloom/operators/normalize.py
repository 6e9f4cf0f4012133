"""Raw flow tables to the canonical flow table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.scalars import C, clip, clip01, col, number
from netloom.operators.flows import app_family
from netloom.operators.metadata import collection_from_path, label_from_column_or_path
from netloom.plans.ordered import exact_quantiles, positions
from netloom.session import materialize

# Column names accepted for each canonical column, first present wins.
ALIASES = {
    "timestamp_end": ["timestamp_end", "timestamp", "time", "ts", "flow_end", "flow_end_ms",
                      "bidirectional_last_seen_ms", "last_seen_ms", "bidirectional_last_seen"],
    "app_id": ["app_id", "app", "application", "application_name", "package_name", "service", "process_name", "category"],
    "bytes_out": ["bytes_out", "src2dst_bytes", "src_to_dst_bytes", "fwd_bytes", "tot_fwd_pkts_len", "total_fwd_bytes",
                  "totlen_fwd_pkts"],
    "bytes_in": ["bytes_in", "dst2src_bytes", "dst_to_src_bytes", "bwd_bytes", "total_bwd_bytes", "totlen_bwd_pkts"],
    "bytes_total": ["total_bytes", "bytes", "tot_bytes", "bidirectional_bytes"],
    "packets_out": ["packets_out", "src2dst_packets", "src_to_dst_packets", "fwd_packets", "tot_fwd_pkts"],
    "packets_in": ["packets_in", "dst2src_packets", "dst_to_src_packets", "bwd_packets", "tot_bwd_pkts"],
    "packets_total": ["packets", "total_packets", "tot_pkts", "bidirectional_packets"],
    "protocol": ["protocol", "proto", "l4_proto"],
    "dst_ip": ["dst_ip", "destination_ip", "dstip", "id_resp_h"],
    "dst_port": ["dst_port", "destination_port", "dstport", "l4_dst_port", "id_resp_p"],
    "dst_host": ["dst_host", "server_name", "host", "domain", "fqdn"],
    "label": ["label", "is_anomaly", "attack", "malicious", "class"],
    "dst_novelty": ["dst_novelty", "novelty_score"],
    "duration_ms": ["duration_ms", "duration", "flow_duration_ms", "dur"],
}
# Metric pairs; each is also accepted without underscores and with src_/dst_ prefixes.
METRICS = ["load", "payload_avg", "inter_packet_avg", "ack_rate", "fin_rate", "psh_rate", "syn_rate", "rst_rate",
           "fragment_rate", "win_tcp", "ack_delay_avg"]
for _m in METRICS:
    for _s, _long in (("s", "src"), ("r", "dst")):
        ALIASES[f"{_s}_{_m}"] = [f"{_s}_{_m}", f"{_s}{_m.replace('_', '')}", f"{_long}_{_m}"]
ALIASES["sttl"], ALIASES["rttl"] = ["sttl", "src_ttl"], ["rttl", "dst_ttl"]

_FLOWMETER = {
    "bytes_out": ["total_length_of_fwd_packet", "subflow_fwd_bytes"],
    "bytes_in": ["total_length_of_bwd_packet", "subflow_bwd_bytes"],
    "packets_out": ["total_fwd_packet", "subflow_fwd_packets"],
    "packets_in": ["total_bwd_packets", "subflow_bwd_packets"],
    "duration_ms": ["flow_duration"],
    "s_payload_avg": ["fwd_packet_length_mean", "fwd_segment_size_avg"],
    "r_payload_avg": ["bwd_packet_length_mean", "bwd_segment_size_avg"],
    "s_inter_packet_avg": ["fwd_iat_mean"], "r_inter_packet_avg": ["bwd_iat_mean"],
    "s_ack_rate": ["ack_flag_count"], "s_fin_rate": ["fin_flag_count"],
    "s_psh_rate": ["psh_flag_count", "fwd_psh_flags"], "s_syn_rate": ["syn_flag_count"],
    "s_rst_rate": ["rst_flag_count"], "s_win_tcp": ["fwd_init_win_bytes"], "r_win_tcp": ["bwd_init_win_bytes"],
}
# What each profile accepts in addition (before the usual names where so marked).
PROFILE_EXTRA = {
    "generic_flow": {}, "parrot": {}, "android_spyware": {}, "android_mischief": {}, "itc_net_blend": {},
    "android_apt_behavior": {},
    "cicflowmeter": {**_FLOWMETER, "timestamp_end": ["timestamp_start"]},
    "westermo": {"timestamp_end": ["end", "enddate"], "bytes_out": ["sbytessum"], "bytes_in": ["rbytessum"],
                 "packets_out": ["spackets"], "packets_in": ["rpackets"], "dst_ip": ["rips", "raddress"]},
    "sdncampus": _FLOWMETER,
}
PROFILE_FIRST = {"westermo": {"label": ["it_b_label", "nst_b_label", "it_m_label", "nst_m_label"]}}
ROW_TIME_PROFILE = "sdncampus"


def profile_aliases(profile: str) -> dict[str, list[str]]:
    extra, first = PROFILE_EXTRA[profile], PROFILE_FIRST.get(profile, {})
    return {k: [*first.get(k, []), *names, *extra.get(k, [])] for k, names in ALIASES.items()}


def canonicalize_columns(df: DataFrame) -> DataFrame:
    """Lower case, other characters to one underscore, trimmed."""
    return df.toDF(*[re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in df.columns])


def resolve_aliases(df: DataFrame, profile: str = "generic_flow") -> tuple[DataFrame, dict[str, str | None]]:
    """(columns under their canonical names, what each was found as). Names only; no data is read."""
    have = set(df.columns)
    mapping = {k: next((a for a in names if a in have), None) for k, names in profile_aliases(profile).items()}
    if profile == ROW_TIME_PROFILE and mapping["app_id"] is None and mapping["label"]:
        mapping["app_id"] = mapping["label"]
    kept = [F.col(f"`{s}`").alias(k) for k, s in mapping.items() if s is not None]
    used = set(mapping.values())
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in mapping]
    return df.select(*kept, *rest), mapping


def numbered(df: DataFrame, name: str = "flow_id") -> DataFrame:
    """Give rows an id where the source has none. Stored, so that a recomputed task cannot change it."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def _one_row(df: DataFrame, **aggs: Column):
    return df.agg(*[c.alias(n) for n, c in aggs.items()])


def to_epoch_ms(df: DataFrame, column: str, name: str = "timestamp_end") -> DataFrame:
    """Epoch milliseconds: mostly numbers are seconds or milliseconds by their median, else text times (UTC)."""
    n = number(column, None)
    share = _one_row(df, _share=F.avg(n.isNotNull().cast("double")))
    median = exact_quantiles(df.select(n.alias("_v")), [], "_v", {"_median": 0.5})
    out = df.crossJoin(F.broadcast(share)).crossJoin(F.broadcast(median))
    as_number = F.when(F.coalesce(F.col("_median"), F.lit(0.0)) < 1e11, F.rint(n * 1000)).otherwise(F.rint(n))
    as_text = F.unix_millis(F.try_to_timestamp(F.col(column).cast("string")))
    ms = F.when(F.col("_share") >= 0.7, as_number.cast("long")).otherwise(as_text)
    return out.withColumn(name, ms).drop("_share", "_median")


def fix_duration(df: DataFrame, source_name: str | None, column: str = "duration_ms") -> DataFrame:
    """A column that was called ``duration`` with a median of at most 100 holds seconds."""
    d = number(column)
    if source_name != "duration":
        return df.withColumn(column, d)
    median = exact_quantiles(df.select(d.alias("_v")), [], "_v", {"_median": 0.5})
    out = df.crossJoin(F.broadcast(median))
    return out.withColumn(column, F.when(F.col("_median") <= 100.0, d * 1000.0).otherwise(d)).drop("_median")


# Protocol numbers.
PROTOCOLS = {"6": "TCP", "17": "UDP", "1": "ICMP", "58": "ICMPV6"}
CAPTURE_PROTOCOLS = ["TCP", "UDP", "TLS", "HTTP", "HTTP2", "QUIC", "DNS"]


def _protocol_name(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv]), c)


def normalize_protocol(c: C) -> Column:
    raw = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    name = F.regexp_replace(F.upper(F.coalesce(_protocol_name(raw), raw)), "[^A-Z0-9]+", "_")
    return F.coalesce(F.nullif(F.trim(name, F.lit("_")), F.lit("")), F.lit("UNKNOWN"))


def capture_protocol(display: C, number_: C) -> Column:
    """Known display name, else the IP protocol number, else whatever was displayed."""
    shown = F.regexp_replace(F.upper(F.trim(F.coalesce(col(display), F.lit("")))), "[/ ]", "-")
    known = F.when(shown.isin(CAPTURE_PROTOCOLS), shown)
    return F.coalesce(known, _protocol_name(F.trim(F.coalesce(col(number_).cast("string"), F.lit("")))),
                      F.nullif(shown, F.lit("")), F.lit("UNKNOWN"))


# Label words; harmless words win.
BENIGN_RE = "benign|normal|background|legitimate|allowed"
MALICIOUS_RE = "attack|mal|anom|bot|spy|phish|intrusion|malware|bad|scan|mitm|ssh"


def normalize_label(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Numbers (if at least 60 % are) cut to 0/1, otherwise keyword rules."""
    n = number(column, None)
    text = F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))
    worded = F.when(text.rlike(BENIGN_RE), 0).when(text.rlike(MALICIOUS_RE), 1).otherwise(0)
    share = _one_row(df, _share=F.avg(n.isNotNull().cast("double")))
    out = df.crossJoin(F.broadcast(share))
    numeric = clip(F.coalesce(n, F.lit(0.0)), 0, 1).cast("int")
    return out.withColumn(name, F.when(F.col("_share") >= 0.6, numeric).otherwise(worded)).drop("_share")


def _text(c: C) -> Column:
    t = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(t.isin("", "nan", "NaN", "None", "<NA>"), None).otherwise(t)


def destination_key(host: C | None, ip: C | None, port: C) -> Column:
    parts = [_text(c) for c in (host, ip) if c is not None]
    return F.concat_ws(":", F.coalesce(*parts, F.lit("unknown")), F.coalesce(_text(port), F.lit("0")))


def derive_app_id(app: C | None, protocol: C | None, ip: C | None, port: C | None) -> Column:
    if app is not None:
        return F.coalesce(F.nullif(F.trim(col(app).cast("string")), F.lit("")), F.lit("unknown_app"))
    proto = F.lower(F.coalesce(_text(protocol), F.lit("unknown"))) if protocol is not None else F.lit("unknown")
    return F.concat_ws(":", F.lit("service"), F.regexp_replace(proto, "[^a-z0-9]+", "_"),
                       F.coalesce(_text(ip), F.lit("unknown")) if ip is not None else F.lit("unknown"),
                       F.coalesce(_text(port), F.lit("0")) if port is not None else F.lit("0"))


def dst_novelty(df: DataFrame, ts: str = "timestamp_end", id_col: str = "flow_id", key: str = "destination_key",
                name: str = "dst_novelty") -> DataFrame:
    """1.0 on the first flow of each (app, destination) by time, 0.0 later.

    The first flow's id is an aggregate; it is joined back on the flow id, which is unique.
    """
    first = df.groupBy("app_id", key).agg(F.min(F.struct(ts, id_col)).alias("_f"))
    ids = first.select(F.col(f"_f.{id_col}").alias("_id"), F.lit(1.0).alias("_first"))
    return df.join(ids, F.col(id_col) == F.col("_id"), "left").withColumn(
        name, F.coalesce("_first", F.lit(0.0))).drop("_id", "_first")


# Availability flags and the columns that set them.
AVAILABILITY = {
    "has_duration_ms": ["duration_ms"], "has_load_metrics": ["s_load", "r_load"],
    "has_payload_metrics": ["s_payload_avg", "r_payload_avg"],
    "has_inter_packet_metrics": ["s_inter_packet_avg", "r_inter_packet_avg"], "has_ttl_metrics": ["sttl", "rttl"],
    "has_tcp_flag_metrics": [f"{s}_{f}_rate" for f in ("ack", "fin", "psh", "syn", "rst") for s in "sr"],
    "has_fragment_metrics": ["s_fragment_rate", "r_fragment_rate"], "has_window_metrics": ["s_win_tcp", "r_win_tcp"],
    "has_ack_delay_metrics": ["s_ack_delay_avg", "r_ack_delay_avg"],
}
FLOAT_COLUMNS = [*[f"{s}_{m}" for m in METRICS[:3] for s in "sr"], "sttl", "rttl",
                 *[f"{s}_{m}" for m in METRICS[3:] for s in "sr"]]


def availability_flags(mapping: dict[str, str | None]) -> dict[str, Column]:
    return {flag: F.lit(1 if any(mapping.get(c) for c in columns) else 0) for flag, columns in AVAILABILITY.items()}


def split_total(df: DataFrame, mapping: dict[str, str | None]) -> dict[str, Column]:
    """Bytes and packets by direction; where one side is absent, a total is halved."""
    out = {}
    for kind in ("bytes", "packets"):
        sides, total = [f"{kind}_out", f"{kind}_in"], f"{kind}_total"
        halve = any(mapping.get(s) is None for s in sides) and mapping.get(total) is not None
        for side, cut in zip(sides, (F.ceil, F.floor)):
            if halve:
                half = number(total) * 0.5
                out[side] = half if kind == "bytes" else cut(half).cast("double")
            else:
                out[side] = number(side) if mapping.get(side) else F.lit(0.0)
    return out


def normalize_flows(df: DataFrame, profile: str = "generic_flow", id_col: str | None = None) -> tuple[DataFrame, dict]:
    """(canonical flows, column mapping). Rows without a readable time are left out; nothing is sorted.

    ``id_col`` names a unique row id, used for row-number times and for ties.
    """
    flows, mapping = resolve_aliases(canonicalize_columns(df), profile)
    if id_col is None or id_col not in flows.columns:
        id_col = "flow_id"
        if id_col not in flows.columns:
            flows = numbered(flows, id_col)
    if mapping["timestamp_end"] is None:
        if profile != ROW_TIME_PROFILE:
            raise ValueError("no timestamp column found")
        flows = positions(flows, [], [id_col], "_rn").withColumn("timestamp_end", F.col("_rn") * 1000).drop("_rn")
        mapping["timestamp_end"] = "row_index_ms"
    else:
        flows = to_epoch_ms(flows, "timestamp_end")
    flows = flows.filter(F.col("timestamp_end").isNotNull())
    flows = fix_duration(flows, mapping["duration_ms"]) if mapping["duration_ms"] else flows.withColumn("duration_ms", F.lit(0.0))

    def have(c: str) -> str | None:
        return c if mapping[c] else None

    port = number("dst_port").cast("long") if mapping["dst_port"] else F.lit(0).cast("long")
    flows = flows.withColumns({
        "protocol": normalize_protocol("protocol") if mapping["protocol"] else F.lit("UNKNOWN"), "dst_port": port})
    flows = flows.withColumns({
        "destination_key": destination_key(have("dst_host"), have("dst_ip"), "dst_port"),
        "_app": derive_app_id(have("app_id"), "protocol", have("dst_ip"), "dst_port")})
    if profile == ROW_TIME_PROFILE or not mapping["label"]:
        flows = flows.withColumn("label", F.lit(0))
    else:
        flows = normalize_label(flows, "label")
    flows = flows.withColumn("app_id", F.col("_app"))
    if mapping["dst_novelty"]:
        flows = flows.withColumn("dst_novelty", clip01(number("dst_novelty")))
    else:
        flows = dst_novelty(flows, id_col=id_col)

    def whole(c: Column) -> Column:
        return F.rint(clip(c, 0)).cast("long")

    totals = split_total(flows, mapping)
    out = flows.select(
        F.col(id_col), "app_id", F.col("timestamp_end").cast("long").alias("timestamp_end"),
        *[whole(totals[c]).alias(c) for c in ("bytes_out", "bytes_in", "packets_out", "packets_in")],
        "dst_novelty", F.col("label").cast("long").alias("label"), "destination_key", "protocol", "dst_port",
        whole(F.col("duration_ms")).alias("duration_ms"),
        *[(clip(number(c), 0) if mapping[c] else F.lit(0.0)).alias(c) for c in FLOAT_COLUMNS],
        *[v.alias(n) for n, v in availability_flags(mapping).items()],
        *([F.col("source_path")] if "source_path" in flows.columns else []))
    return out.withColumn("app_family", app_family("app_id")), mapping


# Column names of public capture tables, compared without case.
PUBLIC = {
    "timestamp_end": ["timestamp_end", "timestamp", "flow end time", "flow_end_time", "time"],
    "bytes_out": ["bytes_out", "totlen fwd pkts", "total length of fwd packets", "fwd bytes", "sbytes"],
    "bytes_in": ["bytes_in", "totlen bwd pkts", "total length of bwd packets", "bwd bytes", "dbytes"],
    "packets_out": ["packets_out", "tot fwd pkts", "total fwd packets", "spkts"],
    "packets_in": ["packets_in", "tot bwd pkts", "total backward packets", "dpkts"],
    "dst_port": ["dst_port", "destination port", "dport", "destination_port"],
    "duration_ms": ["duration_ms", "flow duration", "dur"],
    "protocol": ["protocol", "proto"],
    "app_id": ["app_id", "package", "package_name", "app", "application"],
    "destination": ["destination_key", "dst_ip", "destination ip", "destination_ip", "remote_ip", "dstip"],
}


def adapt_public(df: DataFrame, source: str, path: str = "source_path", id_col: str = "flow_id",
                 novelty_from_label: bool = False) -> DataFrame:
    """Public tables with spaced names; small epochs are moved to a plausible time."""
    names = {c.strip().lower(): c for c in df.columns}

    def find(key: str) -> Column | None:
        hit = next((names[a] for a in PUBLIC[key] if a in names), None)
        return F.col(f"`{hit}`") if hit else None

    def num(key: str, default: float) -> Column:
        c = find(key)
        return F.lit(default) if c is None else number(c, default)

    def text(key: str, default: str) -> Column:
        c = find(key)
        return F.lit(default) if c is None else F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))

    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")
    port = num("dst_port", 0.0).cast("int")
    if id_col not in df.columns:
        df = numbered(df, id_col)
    rows = df.withColumns({"_t": num("timestamp_end", 0.0), "_label": label_from_column_or_path(df, path)})
    top = _one_row(rows, _top=F.max("_t"))
    rows = rows.crossJoin(F.broadcast(top))
    out = rows.select(
        F.col(id_col),
        text("app_id", f"{source}.unknown").alias("app_id"),
        F.when(F.col("_top") < 1e10, (F.col("_t") + 1.7e9) * 1000).otherwise(F.col("_t")).cast("long").alias("timestamp_end"),
        clip(num("bytes_out", 0.0), 0).alias("bytes_out"), clip(num("bytes_in", 0.0), 0).alias("bytes_in"),
        clip(num("packets_out", 1.0), 0).cast("int").alias("packets_out"),
        clip(num("packets_in", 1.0), 0).cast("int").alias("packets_in"),
        clip(num("duration_ms", 0.0), 0).alias("duration_ms"), port.alias("dst_port"),
        text("protocol", "TCP").alias("protocol"),
        F.concat_ws(":", text("destination", "unknown"), port.cast("string")).alias("destination_key"),
        F.col("_label").alias("label"), F.lit(source).alias("dataset_source"),
        collection_from_path(path).alias("dataset_profile"), stem.alias("dataset_variant"),
        F.lit(source).alias("environment_id"), stem.alias("session_id"))
    if novelty_from_label:  # gives the label away; only for exact comparison with older tables
        return out.withColumn("dst_novelty", F.col("label").cast("double"))
    return dst_novelty(out, id_col=id_col)
