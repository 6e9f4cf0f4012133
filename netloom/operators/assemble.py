"""Packets to flows: keys, direction, timed assembly, metrics, evidence, DNS names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import C, clip01, flag, is_private
from netloom.operators.evaluate import gap_groups
from netloom.plans.ordered import carry_last, window
from netloom.session import materialize

IDLE_MS, MAX_MS = 30_000, 20_000
KEY = ["app_id", "protocol", "flow_key"]
ORDER = ["ts_ms", "packet_id"]


def canonical_flow_key(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Endpoints ordered by ``ip:port``, so both directions share a key."""
    a, b = F.concat_ws(":", f"{src}_ip", f"{src}_port"), F.concat_ws(":", f"{dst}_ip", f"{dst}_port")
    return df.withColumn("flow_key", F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def infer_direction(df: DataFrame, capture: str = "capture") -> DataFrame:
    """Outbound if sent by the capture's most frequent private address; else private to public."""
    ends = df.select(capture, F.explode(F.array("src_ip", "dst_ip")).alias("_ip")).filter(is_private("_ip"))
    counts = ends.groupBy(capture, "_ip").count()
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col("_ip")))
    local = counts.groupBy(capture).agg(best.alias("_b")).select(F.col(capture).alias("_cap"), F.col("_b._ip").alias("local_ip"))
    out = df.join(local, df[capture] == F.col("_cap"), "left").drop("_cap")
    s, d = is_private("src_ip"), is_private("dst_ip")
    outbound = F.when(F.col("local_ip").isNull(), True).when(F.col("src_ip") == F.col("local_ip"), True).when(
        F.col("dst_ip") == F.col("local_ip"), False).when(s & ~d, True).when(d & ~s, False).otherwise(True)
    return out.withColumn("outbound", outbound)


def preferred_host(*cols: C) -> Column:
    """First non-blank of SNI, HTTP host and DNS name, lower case, without ``www.``."""
    texts = [F.nullif(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), F.lit("")) for c in cols]
    return F.regexp_replace(F.coalesce(*texts), r"^www\.", "")


def oriented(df: DataFrame) -> DataFrame:
    out = F.col("outbound")
    return df.withColumns({
        "local_ip": F.when(out, F.col("src_ip")).otherwise(F.col("dst_ip")),
        "local_port": F.when(out, F.col("src_port")).otherwise(F.col("dst_port")),
        "remote_ip": F.when(out, F.col("dst_ip")).otherwise(F.col("src_ip")),
        "remote_port": F.when(out, F.col("dst_port")).otherwise(F.col("src_port"))})


def assemble_capture(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One flow per oriented 5-tuple of a capture: partial sums only, hot captures included."""
    keys = [*(extra or ["capture", "app_id"]), "local_ip", "local_port", "remote_ip", "remote_port", "protocol"]
    o = F.col("outbound")
    host = F.col("host")
    return oriented(df).groupBy(*keys).agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("timestamp_end"),
        F.sum(F.when(o, F.col("bytes")).otherwise(0)).alias("bytes_out"),
        F.sum(F.when(~o, F.col("bytes")).otherwise(0)).alias("bytes_in"),
        F.count_if(o).alias("packets_out"), F.count_if(~o).alias("packets_in"),
        F.min_by(host, F.when(host.isNotNull(), F.struct("ts_ms", "packet_id"))).alias("site_hint"),
    ).withColumns({
        "duration_ms": F.col("timestamp_end") - F.col("start_ms"), "dst_port": F.col("remote_port"),
        "destination_key": F.concat_ws(":", F.coalesce("site_hint", "remote_ip"), "remote_port")})


def cut_flows(packets: DataFrame, idle_ms: int = IDLE_MS, max_ms: int = MAX_MS) -> DataFrame:
    """Add ``flow_no`` per (app, protocol, key).

    A silence of min(idle, max) always starts a flow, so the key is first split there by a lag.
    What is left are life cuts: after a start at s, the first packet at or after s + max_ms starts
    the next flow. Only runs that last so long need them; see ``_life_starts``.
    """
    run = [*KEY, "run_no"]
    runs = materialize(gap_groups(packets, KEY, "ts_ms", "packet_id", min(idle_ms, max_ms) - 1, "run_no"), "runs")
    spans = runs.groupBy(*run).agg(F.min("ts_ms").alias("_from"), F.max("ts_ms").alias("_to"))
    spans = spans.filter(F.col("_to") - F.col("_from") >= max_ms).drop("_to")
    spans = spans.select(*[F.col(c).alias(f"_s_{c}") for c in run], "_from", F.monotonically_increasing_id().alias("_run"))
    spans = materialize(spans, "long-runs")
    same = F.lit(True)
    for c in run:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    rows = runs.join(spans, same, "left").drop(*[f"_s_{c}" for c in run])
    rows = rows.withColumn("_at", F.col("ts_ms") - F.col("_from")).withColumn("_pane", F.expr(f"_at div {int(max_ms)}L"))
    starts = _life_starts(rows.filter("_run IS NOT NULL").select("_run", "_pane", "_at").distinct(), max_ms)
    starts = starts.select(F.col("_run").alias("_r"), F.col("_pane").alias("_p"), "_start", "_earlier")
    out = rows.join(starts, (F.col("_run") == F.col("_r")) & (F.col("_pane") == F.col("_p")), "left")
    own = F.when(F.col("_at") >= F.col("_start"), 1).otherwise(0)
    return out.withColumn("cut_no", F.coalesce(F.col("_earlier") + own, F.lit(1)).cast("long")).withColumn(
        "flow_no", F.concat_ws("-", "run_no", "cut_no")).drop("_run", "_from", "_at", "_pane", "_r", "_p", "_start", "_earlier")


def _life_starts(times: DataFrame, max_ms: int) -> DataFrame:
    """Flow starts by pane of max_ms: _run, _pane, _start (or null), _earlier (starts in earlier panes).

    ``times`` holds distinct (_run, _pane, _at). Starts are at least max_ms apart, so a pane holds
    one at most. Each time points to the first one max_ms later, which a sort inside the next pane
    finds; the starts are what the first time of a run reaches, found by pointer doubling: as many
    passes as the number of panes of the longest run has bits, over pairs of ids only.
    """
    nodes = materialize(times.withColumn("_id", F.monotonically_increasing_id()), "times")
    along = Window.partitionBy("_run").orderBy("_pane")
    offset = F.col("_at") - F.col("_pane") * F.lit(int(max_ms))
    panes = nodes.groupBy("_run", "_pane").agg(F.min_by("_id", "_at").alias("_first"))
    none = F.lit(None).cast("long")
    # Where the next pane has no time late enough, the first time after that pane is taken.
    beyond = F.when(F.lead("_pane").over(along) == F.col("_pane") + 1, F.lead("_first", 2).over(along)).otherwise(
        F.lead("_first").over(along))
    ends = panes.select("_run", (F.col("_pane") + 1).alias("_pane"), F.lit(int(max_ms)).cast("long").alias("_off"),
                        none.alias("_asks"), beyond.alias("_id"))
    targets = nodes.select("_run", "_pane", offset.alias("_off"), none.alias("_asks"), "_id")
    probes = nodes.select("_run", (F.col("_pane") + 1).alias("_pane"), offset.alias("_off"), F.col("_id").alias("_asks"),
                          none.alias("_id"))
    late_first = Window.partitionBy("_run", "_pane").orderBy(F.desc("_off"), F.col("_asks").isNotNull()).rowsBetween(
        Window.unboundedPreceding, 0)
    found = ends.unionByName(targets).unionByName(probes).withColumn("_next", F.last("_id", ignorenulls=True).over(late_first))
    links = found.filter("_asks IS NOT NULL AND _next IS NOT NULL").select(F.col("_asks").alias("a"), F.col("_next").alias("b"))
    jumps, longest = [materialize(links, "links")], nodes.agg(F.max("_pane")).first()[0] or 0
    for _ in range(1, longest.bit_length()):
        on = jumps[-1].select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumps.append(materialize(jumps[-1].join(on, "b").select("a", F.col("c").alias("b")), "links"))
    reached = nodes.filter("_at = 0").select(F.col("_id").alias("a"))
    for jump in reversed(jumps):  # sums of powers of two: every step of a chain is met once
        reached = materialize(reached.unionByName(reached.join(jump, "a").select(F.col("b").alias("a"))), "starts")
    starts = nodes.join(reached, F.col("_id") == F.col("a")).select("_run", "_pane", F.col("_at").alias("_start"))
    return panes.select("_run", "_pane").join(starts, ["_run", "_pane"], "left").withColumn(
        "_earlier", F.count("_start").over(along.rowsBetween(Window.unboundedPreceding, -1)))


# Evidence fields in the order they are listed.
EVIDENCE_TEXT = ["dns_query_name", "dns_query_type", "dns_answer_value", "tls_sni", "tls_alpn", "tls_version",
                 "tls_ja3_like", "tls_leaf_subject", "tls_leaf_issuer", "tls_leaf_san", "http_method", "http_host",
                 "http_path", "quic_version"]
EVIDENCE_FLAGS = ["quic_detected", "http3_detected"]


def first_known(c: str, *order: str) -> Column:
    """Earliest non-blank value of a group, as an aggregate that combines partially."""
    v = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return F.min_by(v, F.when(v.isNotNull(), F.struct(*order)))


def merge_evidence(df: DataFrame, order: list[str] = ORDER) -> dict[str, Column]:
    """First non-blank text per field, OR of the flags."""
    out = {c: first_known(c, *order) for c in EVIDENCE_TEXT if c in df.columns}
    out |= {c: F.bool_or(F.coalesce(F.col(c), F.lit(False))) for c in EVIDENCE_FLAGS if c in df.columns}
    return out


def packet_steps(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Positive gap to the previous packet and delay since the last payload packet of the flow.

    A flow lives for a bounded time, so its packets are ordered in one task; the sort can spill.
    """
    w = window(keys, ORDER)
    before = F.lag("ts_ms").over(w)
    paid = F.last(F.when(F.col("payload_bytes") > 0, F.col("ts_ms")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    delay = F.col("ts_ms") - F.col("_paid")
    acked = (F.col("protocol") == "TCP") & F.col("ack") & (delay >= 0)
    return packets.withColumns({
        "gap_ms": F.when(F.col("ts_ms") > before, F.col("ts_ms") - before), "_paid": paid,
    }).withColumn("ack_delay_ms", F.when(acked, delay)).drop("_paid")


def finalize_flows(cut: DataFrame) -> DataFrame:
    """One row per cut flow with its transport metrics and merged evidence."""
    keys = [*KEY, "flow_no"]
    rows = packet_steps(cut, keys)
    c, tcp, o = F.col, F.col("protocol") == "TCP", F.col("outbound")
    tcp_n = F.greatest(F.lit(1), F.count_if(tcp))

    def rate(name: str) -> Column:
        return F.count_if(tcp & c(name)) / tcp_n

    def mean(v: Column) -> Column:
        return F.coalesce(F.avg(v), F.lit(0.0))

    out_ttl, in_ttl = F.avg(F.when(o, c("hop_limit"))), F.avg(F.when(~o, c("hop_limit")))
    place = F.struct(*ORDER)
    first = {f"{side}_{what}": F.min_by(F.when(o, c(f"{a}_{what}")).otherwise(c(f"{b}_{what}")), place)
             for side, a, b in (("local", "src", "dst"), ("remote", "dst", "src")) for what in ("ip", "port")}
    seen = (c("payload_bytes") > 0) | c("hop_limit").isNotNull() | c("fragmented") | tcp
    agg = rows.groupBy(*keys).agg(
        *[v.alias(n) for n, v in first.items()],
        F.min("ts_ms").alias("timestamp_start"), F.max("ts_ms").alias("timestamp_end"),
        F.sum(F.when(o, c("bytes")).otherwise(0)).alias("bytes_out"),
        F.sum(F.when(~o, c("bytes")).otherwise(0)).alias("bytes_in"),
        F.count_if(o).alias("packets_out"), F.count_if(~o).alias("packets_in"),
        first_known("host_hint", *ORDER).alias("site_hint"),
        F.coalesce(clip01(F.abs(out_ttl - in_ttl) / 255.0), F.lit(0.0)).alias("ttl_gap"),
        flag(F.count("hop_limit") > 0).alias("ttl_metrics_present"),
        *[rate(n).alias(f"{n}_rate_total") for n in ("syn", "rst", "ack", "fin", "psh")],
        (F.count_if("fragmented") / F.count(F.lit(1))).alias("fragment_rate_total"),
        mean(F.when(tcp, c("tcp_window"))).alias("tcp_window_mean"), mean(c("ack_delay_ms")).alias("ack_delay_mean"),
        mean(c("gap_ms")).alias("inter_packet_gap_mean"),
        mean(F.when(c("payload_bytes") > 0, c("payload_bytes"))).alias("payload_mean"),
        flag(F.bool_or(seen)).alias("transport_metrics_present"),
        *[v.alias(n) for n, v in merge_evidence(rows).items()])
    duration = F.greatest(F.lit(1), c("timestamp_end") - c("timestamp_start"))
    out = agg.withColumn("duration_ms", duration)
    return out.withColumns({
        "load_mean": (c("bytes_out") + c("bytes_in")) / (c("duration_ms") / 1000.0),
        "destination": F.concat_ws(":", F.coalesce("site_hint", "remote_ip"), "remote_port")})


def flow_novelty(flows: DataFrame, key: str = "destination", order: list[str] | None = None,
                 name: str = "dst_novelty") -> DataFrame:
    """1.0 for the first flow of each (app, destination), 0.0 for later ones.

    The first flow is found by an aggregate and joined back on the order columns, so no group
    of flows is gathered anywhere.
    """
    order = order or ["timestamp_end", "timestamp_start", "flow_key", "flow_no"]
    place = F.struct(*order)
    first = flows.groupBy("app_id", key).agg(F.min(place).alias("_p"))
    first = first.select(F.col("app_id").alias("_a"), F.col(key).alias("_d"),
                         *[F.col(f"_p.{c}").alias(f"_o_{c}") for c in order], F.lit(1.0).alias("_first"))
    cond = (flows["app_id"] == F.col("_a")) & flows[key].eqNullSafe(F.col("_d"))
    for c in order:
        cond = cond & (flows[c] == F.col(f"_o_{c}"))
    out = flows.join(first, cond, "left")
    return out.withColumn(name, F.coalesce("_first", F.lit(0.0))).drop(
        "_a", "_d", "_first", *[f"_o_{c}" for c in order])


def assemble_flows(packets: DataFrame, idle_ms: int = IDLE_MS, max_ms: int = MAX_MS) -> DataFrame:
    """Packets to finished flows; whatever is open when the input ends is closed (force flush)."""
    keyed = packets if "flow_key" in packets.columns else canonical_flow_key(packets)
    return flow_novelty(finalize_flows(cut_flows(keyed, idle_ms, max_ms)))


def dns_enrich(flows: DataFrame, ts: str = "timestamp_end", id_col: str = "flow_id") -> DataFrame:
    """Name of an address from the latest DNS answer before the flow (as-of join by union and carry)."""
    answer = F.nullif(F.trim("dns_answer_value"), F.lit(""))
    named = (answer.isNotNull() & (F.length(F.trim(F.coalesce("dns_query_name", F.lit("")))) > 0)
             & (answer.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | answer.contains(":")))
    answers = flows.filter(named).select(answer.alias("_ip"), F.col(ts), F.col(id_col), F.lit(0).alias("_flow"),
                                         F.col("dns_query_name").alias("_name"))
    probes = flows.select(F.col("dst_ip").alias("_ip"), F.col(ts), F.col(id_col), F.lit(1).alias("_flow"),
                          F.lit(None).cast("string").alias("_name"))
    found = carry_last(answers.unionByName(probes), ["_ip"], [ts, id_col, F.desc("_flow")], {"dns_host": F.col("_name")})
    found = found.filter("_flow = 1").select(F.col(id_col).alias("_id"), "dns_host")
    out = flows.join(found, flows[id_col] == F.col("_id"), "left").drop("_id")
    own = F.nullif(F.trim(F.coalesce("site_hint", F.lit(""))), F.lit(""))
    hosts = [F.nullif(F.trim(c), F.lit("")) for c in ("http_host", "tls_sni", "dns_query_name") if c in flows.columns]
    return out.withColumn("resolved_host", F.coalesce(own, *hosts, F.col("dns_host")))
