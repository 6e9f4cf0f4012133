"""Tumbling feature windows per application, baselines, ablation and the feature contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import constants as K
from netloom.functions.scalars import clip, clip01, flag, ratio
from netloom.operators.flows import HOST_COLUMNS, app_family, host_inputs, prepare_flows, with_host_columns
from netloom.plans.ordered import window
from netloom.plans.panes import with_history

KEYS = ["app_id", "window_bucket"]
#: The same keys without nulls, so that all pieces of a window are joined on one partitioning.
GROUP = ["_app", "_none", "window_bucket"]
ORDER = ["timestamp_end", "flow_id"]
SLICES = 64  # of a window, in time
#: Windows of an application are dealt out by day where each looks at a few before it.
HISTORY_PANE_MS = 86_400_000


def bucketed(flows: DataFrame, window_ms: int) -> DataFrame:
    return prepare_flows(flows).withColumn("window_bucket", F.expr(f"timestamp_end div {int(window_ms)}L"))


def _sum_columns() -> dict[str, Column]:
    """Aggregates that combine partially on the map side; no value is null, so a mean is a sum over the count."""
    n = F.count(F.lit(1))

    def mean(c: str) -> Column:
        return F.sum(c) / n

    return {
        "flow_count": n,
        "total_bytes_out": F.sum("bytes_out"),
        "total_bytes_in": F.sum("bytes_in"),
        "_packets_out": F.sum("packets_out"),
        "_packets_in": F.sum("packets_in"),
        "_bytes": F.sum("total_bytes"),
        "novelty_score": mean("dst_novelty"),
        "_duration": F.sum("duration_ms"),
        "mean_duration_ms": mean("duration_ms"),
        "duration_jitter": F.stddev_pop("duration_ms"),
        "small_flow_ratio": mean("small_flow"),
        "high_port_ratio": mean("high_port"),
        **{name: mean(c) for c, name in K.FLAG_MEANS.items() if c not in HOST_COLUMNS},
        **{c: mean(c) for c in K.TRANSPORT_MEANS},
        "label": F.max("label"),
    }


def _hosts(df: DataFrame) -> DataFrame:
    """Means of the host columns. The tests on host texts run once for each destination of a window."""
    n = F.col("_flows")
    found = with_host_columns(df.groupBy(*GROUP, *host_inputs(df)).agg(F.count(F.lit(1)).alias("_flows")))
    return found.groupBy(*GROUP).agg(*[(F.sum(F.col(c) * n) / F.sum(n)).alias(K.FLAG_MEANS[c]) for c in HOST_COLUMNS])


def _named(df: DataFrame) -> DataFrame:
    """Distinct values and most frequent ones: all text columns counted in one long table."""
    kinds = {"dest": F.col("destination_key"), "port": F.col("dst_port").cast("string"), "protocol": F.col("protocol"),
             "profile": F.concat_ws(":", "protocol", "dst_port"), **{c: F.col(c) for c in K.PROVENANCE}}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in kinds.items()])
    counts = df.select(*GROUP, F.inline(pairs)).groupBy(*GROUP, "name", "value").agg(F.count(F.lit(1)).alias("n"))

    def of(name: str, value: Column) -> Column:
        return F.when((F.col("name") == name) & F.col("value").isNotNull(), value)

    best = F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))  # equal counts: the smaller value
    return counts.groupBy(*GROUP).agg(
        F.count(of("dest", F.lit(1))).cast("double").alias("_dests"), F.max(of("dest", F.col("n"))).alias("_top_dest"),
        *[F.count(of(n, F.lit(1))).alias(f"_{n}s") for n in ("port", "protocol", "profile")],
        *[F.min(of(c, best))["v"].alias(c) for c in K.PROVENANCE])


def _moves(df: DataFrame, window_ms: int) -> DataFrame:
    """Previous destination and interval inside a window, as counts and sums per transition.

    Rows are ordered in slices of the window; the last row of each slice is also put before the
    next one that holds rows, so a busy window is spread and its order stays whole.
    """
    rows = df.select(*GROUP, *ORDER, "destination_key", F.lit(True).alias("_own"),
                     F.expr(f"timestamp_end div {max(1, int(window_ms) // SLICES)}L").alias("_slice"))
    last = rows.groupBy(*GROUP, "_slice").agg(F.max(F.struct(*ORDER, "destination_key")).alias("_l"))
    following = F.lead("_slice").over(Window.partitionBy(*GROUP).orderBy("_slice"))
    carried = last.select(*GROUP, "_l.*", F.lit(False).alias("_own"), following.alias("_slice")).filter("_slice IS NOT NULL")
    w = window([*GROUP, "_slice"], ORDER)
    steps = rows.unionByName(carried).withColumns({
        "_prev": F.lag("destination_key").over(w),
        "_delta": (F.col("timestamp_end") - F.lag("timestamp_end").over(w)).cast("double"),
    }).filter("_own")
    kinds = steps.filter("_delta IS NOT NULL").groupBy(*GROUP, "_prev", "destination_key").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_delta").alias("_d"), F.sum(F.col("_delta") * F.col("_delta")).alias("_dd"))
    n, total, squares = F.sum("_n"), F.sum("_d"), F.sum("_dd")
    return kinds.groupBy(*GROUP).agg(
        n.alias("_intervals"), F.count(F.lit(1)).cast("double").alias("_step_kinds"),
        F.sum(F.when(F.col("_prev") != F.col("destination_key"), F.col("_n")).otherwise(0)).cast("double").alias("_switches"),
        (total / n).alias("_gap_mean"),
        (F.sqrt(F.greatest(F.lit(0.0), n * squares - total * total)) / n).alias("_gap_std"),
        (F.log(n) - F.sum(F.col("_n") * F.log("_n")) / n).alias("_entropy"))


def _sizes(df: DataFrame) -> DataFrame:
    """Mean absolute deviation and quartiles of the flow sizes from counts per distinct size.

    Sizes are cut into slices of about a sixteenth of an octave of e. Slice totals say where the
    mean and the quartiles lie; only the values of those slices are ordered.
    """
    v = F.col("total_bytes")
    values = df.groupBy(*GROUP, "total_bytes").agg(F.count(F.lit(1)).alias("_n"))
    values = values.withColumn("_slice", _size_slice(v))
    slices = values.groupBy(*GROUP, "_slice").agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * v).alias("_sum"))
    whole = Window.partitionBy(*GROUP)
    slices = slices.withColumns({
        "_before": F.sum("_m").over(whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m"),
        "_total": F.sum("_m").over(whole), "_mean": F.sum("_sum").over(whole) / F.sum("_m").over(whole)})
    at, middle = F.col("_slice"), _size_slice(F.col("_mean"))
    places = {f"{side}{q}": f((F.col("_total") - 1) * (q / 100.0)) for q in (25, 75) for side, f in (("lo", F.floor), ("hi", F.ceil))}
    holds = F.lit(False)
    for place in places.values():
        holds = holds | ((F.col("_before") <= place) & (place < F.col("_before") + F.col("_m")))
    slices = slices.withColumns({
        "_away": F.when(at < middle, F.col("_m") * F.col("_mean") - F.col("_sum")).when(
            at > middle, F.col("_sum") - F.col("_m") * F.col("_mean")).otherwise(0.0),
        "_open": holds | (at == middle), "_middle": at == middle})
    # A slice that is not opened stands as one row without a value.
    found = slices.join(values.withColumnsRenamed({c: f"_v_{c}" for c in [*GROUP, "_slice"]}), on=[
        F.col("_open"), *[F.col(c) == F.col(f"_v_{c}") for c in [*GROUP, "_slice"]]], how="left")
    spec = window([*GROUP, "_slice"], ["total_bytes"])
    upto = F.col("_before") + F.sum("_n").over(spec.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumns({"_upto": upto, "_first": F.row_number().over(spec) == 1})

    def value_at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), v))

    near = F.when(F.col("_middle"), F.col("_n") * F.abs(v - F.col("_mean")))
    out = found.groupBy(*GROUP).agg(
        F.sum(F.coalesce(near, F.when(F.col("_first"), F.col("_away")), F.lit(0.0))).alias("_abs_dev"),
        F.max("_total").alias("_total"), *[value_at(place).alias(f"_{n}") for n, place in places.items()])

    def quartile(q: int) -> Column:
        exact = (F.col("_total") - 1) * (q / 100.0)
        return F.col(f"_lo{q}") + (F.col(f"_hi{q}") - F.col(f"_lo{q}")) * (exact - F.floor(exact))

    return out.select(*GROUP, "_abs_dev", (quartile(75) - quartile(25)).alias("flow_size_iqr"))


def _size_slice(v: Column) -> Column:
    """A number that never falls as ``v`` grows.

    It is never null and says so: else a join on it tests it in the scan, and the two uses of the
    counts per size no longer share their shuffle.
    """
    return F.coalesce(F.floor(F.signum(v) * F.log1p(F.abs(v)) * 16.0), F.lit(0))


def _pieces(df: DataFrame, window_ms: int) -> DataFrame:
    """One row per window from aggregates that combine partially, for windows of any size."""
    keyed = df.withColumns({"_app": F.coalesce("app_id", F.lit("")), "_none": F.col("app_id").isNull()})
    out = keyed.groupBy(*GROUP).agg(*[c.alias(n) for n, c in _sum_columns().items()])
    out = out.join(_hosts(keyed), GROUP).join(_named(keyed), GROUP).join(_sizes(keyed), GROUP).join(_moves(keyed, window_ms), GROUP, "left")
    return out.withColumn("app_id", F.when(~F.col("_none"), F.col("_app"))).fillna(
        0, ["_switches", "_intervals", "_step_kinds"])


def dominant(df: DataFrame, keys: list[str], column: str, default: str | None = None) -> DataFrame:
    """Most frequent text per group; equal counts go to the smaller value."""
    value = F.col(column) if default is None else F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))
    counts = df.groupBy(*keys, value.alias(column)).count()
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(column))


def _finish(windows: DataFrame, window_ms: int) -> DataFrame:
    seconds = max(1.0, window_ms / 1000.0)
    n = F.col("flow_count").cast("double")
    packets = F.col("_packets_out") + F.col("_packets_in")
    size, move = F.col("_bytes"), F.col("_switches")
    gap = F.col("_gap_std") / F.nullif(F.col("_gap_mean"), F.lit(0.0))
    out = windows.withColumns({
        "window_start_ms": F.col("window_bucket") * F.lit(int(window_ms)),
        "window_end_ms": (F.col("window_bucket") + 1) * F.lit(int(window_ms)),
        "app_family": app_family("app_id"),
        "mean_packet_size": size / clip(packets, 1),
        "outbound_ratio": F.col("total_bytes_out") / (size + 1.0),
        "burstiness": clip(F.coalesce(ratio(F.col("_abs_dev") / n, size / n), F.lit(0.0)), 0, 4),
        "connection_frequency_delta": F.log1p(n / seconds),
        "bytes_per_flow": size / n,
        "destination_diversity": F.col("_dests") / n,
        "activity_ratio": clip(F.col("_duration") / (seconds * 1000.0), hi=1),
        "byte_rate": size / seconds,
        "packet_rate": packets / seconds,
        "port_diversity": F.col("_ports") / n,
        "protocol_diversity": F.col("_protocols") / n,
        "packet_imbalance": F.abs(F.col("_packets_out") - F.col("_packets_in")) / (packets + 1.0),
        "periodic_beacon_score": F.coalesce(
            F.when(F.col("_intervals") >= 3, clip01(1.0 - gap)), F.lit(0.0)),
        "destination_concentration": F.col("_top_dest") / n,
        "destination_transition_rate": move / clip(n - 1, 1),
        "destination_transition_entropy": F.coalesce(
            F.when(F.round("_step_kinds") > 1, F.col("_entropy") / F.log(F.round("_step_kinds"))), F.lit(0.0)),
        "protocol_port_profile_diversity": F.col("_profiles") / n,
    })
    return out.select(*[c for c in out.columns if not c.startswith("_")])


def raw_windows(flows: DataFrame, window_ms: int) -> DataFrame:
    """Window features without the baselines that look at earlier windows."""
    return _finish(_pieces(bucketed(flows, window_ms), window_ms), window_ms)


def feature_windows(flows: DataFrame, window_ms: int = 60_000) -> DataFrame:
    return rolling_baseline(raw_windows(flows, window_ms))


def rolling_baseline(windows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Deviation from the mean of the previous three windows, trends and burst counts."""
    order = order or ["window_end_ms"]

    def build(df: DataFrame, keys: list[str]) -> DataFrame:
        w = window(keys, order)
        prior = w.rowsBetween(-3, -1)
        flows, rate, novelty, dests = "flow_count", "byte_rate", "novelty_score", "destination_diversity"
        means = {c: F.avg(c).over(prior) for c in (flows, rate, novelty, dests)}

        def off(c: str) -> Column:
            return F.coalesce(F.abs(F.col(c) - means[c]) / (F.abs(means[c]) + 1.0), F.lit(0.0))

        def shift(c: str) -> Column:
            return F.coalesce(F.abs(F.col(c) - means[c]), F.lit(0.0))

        def trend(c: str, relative: bool) -> Column:
            old = F.lag(c, 3).over(w)
            change = F.col(c) - old
            return F.coalesce(clip(change / (F.abs(old) + 1.0), -10, 10) if relative else clip(change, -1, 1),
                              F.lit(0.0))

        out = df.withColumns({
            "flow_count_deviation": off(flows),
            "byte_rate_deviation": off(rate),
            "destination_diversity_shift": shift(dests),
            "novelty_shift": shift(novelty),
            "recent_flow_count_mean": F.coalesce(means[flows], F.lit(0.0)),
            "recent_byte_rate_mean": F.coalesce(means[rate], F.lit(0.0)),
            "recent_novelty_mean": F.coalesce(means[novelty], F.lit(0.0)),
            "flow_count_trend": trend(flows, True),
            "byte_rate_trend": trend(rate, True),
            "novelty_trend": trend(novelty, False),
            "destination_diversity_trend": trend(dests, False),
            "low_volume_periodic_score": F.when(
                F.col(rate) <= K.LOW_VOLUME_BYTE_RATE, F.col("periodic_beacon_score")).otherwise(0.0),
        })
        burst = flag((F.col("flow_count_deviation") >= K.BURST_DEVIATION)
                     | (F.col("byte_rate_deviation") >= K.BURST_DEVIATION))
        return out.withColumn("consecutive_burst_windows", F.sum(burst).over(w.rowsBetween(-2, 0)))

    return with_history(windows, ["app_id"], "window_end_ms", order, 5, HISTORY_PANE_MS, build)


def rolling_baseline_runtime(windows: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """Endpoint form: previous n windows, trend against the oldest, streak of newest bursts."""
    order = order or ["window_end_ms"]

    def build(df: DataFrame, keys: list[str]) -> DataFrame:
        w = window(keys, order)
        prior = w.rowsBetween(-n, -1)
        flows, rate, novelty, dests = "flow_count", "byte_rate", "novelty_score", "destination_diversity"

        def mean(c: str) -> Column:
            return F.avg(c).over(prior)

        def off(c: str) -> Column:
            return F.coalesce(clip(F.abs(F.col(c) - mean(c)) / (F.abs(mean(c)) + 1.0), 0, 10), F.lit(0.0))

        def oldest(c: str) -> Column:
            return F.first(c).over(prior)

        step = df.withColumns({
            "flow_count_deviation": off(flows),
            "byte_rate_deviation": off(rate),
            "destination_diversity_shift": F.coalesce(F.abs(F.col(dests) - mean(dests)), F.lit(0.0)),
            "novelty_shift": F.coalesce(F.abs(F.col(novelty) - mean(novelty)), F.lit(0.0)),
            "recent_flow_count_mean": F.coalesce(mean(flows), F.lit(0.0)),
            "recent_byte_rate_mean": F.coalesce(mean(rate), F.lit(0.0)),
            "recent_novelty_mean": F.coalesce(mean(novelty), F.lit(0.0)),
            "flow_count_trend": F.coalesce(
                clip((F.col(flows) - oldest(flows)) / (F.abs(oldest(flows)) + 1.0), -10, 10), F.lit(0.0)),
            "byte_rate_trend": F.coalesce(
                clip((F.col(rate) - oldest(rate)) / (F.abs(oldest(rate)) + 1.0), -10, 10), F.lit(0.0)),
            "novelty_trend": F.coalesce(clip(F.col(novelty) - oldest(novelty), -1, 1), F.lit(0.0)),
            "destination_diversity_trend": F.coalesce(clip(F.col(dests) - oldest(dests), -1, 1), F.lit(0.0)),
        })
        burst = ((F.col("flow_count_deviation") >= K.BURST_DEVIATION)
                 | (F.col("byte_rate_deviation") >= K.BURST_DEVIATION))
        # Number of bursts in a row, newest first: position of the first calm window among the last n.
        recent = F.reverse(F.collect_list(burst).over(prior))
        streak = F.array_position(recent, F.lit(False))
        return step.withColumns({
            "consecutive_burst_windows": F.when(streak > 0, streak - 1).otherwise(F.size(recent)).cast("double"),
            "low_volume_periodic_score": F.when(
                F.col(rate) <= K.LOW_VOLUME_BYTE_RATE, F.col("periodic_beacon_score")).otherwise(0.0),
        })

    return with_history(windows, ["app_id"], "window_end_ms", order, 2 * n, HISTORY_PANE_MS, build)


# Window columns zeroed by each ablation group.
ABLATION_GROUPS = {
    "volume": [
        "flow_count", "total_bytes_out", "total_bytes_in", "mean_packet_size", "bytes_per_flow",
        "byte_rate", "packet_rate", "flow_count_deviation", "byte_rate_deviation",
        "recent_flow_count_mean", "recent_byte_rate_mean", "flow_count_trend", "byte_rate_trend",
        "consecutive_burst_windows", "payload_mean", "load_mean",
    ],
    "timing": [
        "burstiness", "connection_frequency_delta", "activity_ratio", "mean_duration_ms",
        "duration_jitter", "periodic_beacon_score", "ack_delay_mean", "inter_packet_gap_mean",
        "low_volume_periodic_score",
    ],
    "destination": [
        "novelty_score", "destination_diversity", "destination_concentration",
        "destination_transition_rate", "dns_flow_ratio", "web_flow_ratio",
        "private_destination_ratio", "multicast_destination_ratio", "destination_diversity_shift",
        "novelty_shift", "destination_diversity_trend", "destination_risk_score",
        "lookalike_score", "suspicious_destination_ratio", "known_identity_ratio",
        "mitre_technique_ratio", "threat_tag_ratio", "port_diversity", "protocol_diversity",
        "packet_imbalance", "small_flow_ratio", "high_port_ratio", "ttl_gap",
        "ttl_metrics_present", "syn_rate_total", "rst_rate_total", "ack_rate_total",
        "fin_rate_total", "psh_rate_total", "fragment_rate_total", "tcp_window_mean",
        "recent_novelty_mean", "novelty_trend", "transport_metrics_present",
    ],
}


def ablate(windows: DataFrame, groups: list[str]) -> DataFrame:
    names = {c for g in groups for c in ABLATION_GROUPS[g]}
    return windows.withColumns({c: F.lit(0).cast(windows.schema[c].dataType)
                                for c in windows.columns if c in names})


def check_contract(columns: list[str]) -> None:
    if list(columns) != K.FEATURES:
        raise ValueError(f"feature contract mismatch: expected {K.FEATURES}, got {list(columns)}")


def feature_matrix(windows: DataFrame, columns: list[str] | None = None, output: str = "features") -> DataFrame:
    """Ordered feature vector; nulls count as zero, absent columns are an error."""
    from pyspark.ml.feature import VectorAssembler

    columns = columns or K.FEATURES
    missing = [c for c in columns if c not in windows.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    filled = windows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=columns, outputCol=output).transform(filled)


# Availability flag that gates each transport mean of a service window.
GATED_MEANS = {
    "ttl_gap": "has_ttl_metrics",
    **{f"{r}_rate_total": "has_tcp_flag_metrics" for r in ("syn", "rst", "ack", "fin", "psh")},
    "fragment_rate_total": "has_fragment_metrics",
    "tcp_window_mean": "has_window_metrics",
    "ack_delay_mean": "has_ack_delay_metrics",
    "inter_packet_gap_mean": "has_inter_packet_metrics",
    "payload_mean": "has_payload_metrics",
    "load_mean": "has_load_metrics",
}


def backend_windows(flows: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Service-side windows: transport means count only where the window has the metric group."""
    from netloom.operators.flows import optional

    rows = bucketed(flows, window_ms)
    raw = {f"{r}_rate_total": optional(rows, f"s_{r}_rate") + optional(rows, f"r_{r}_rate")
           for r in K.SUMMED_RATES}
    raw |= {name: (optional(rows, f"s_{s}") + optional(rows, f"r_{s}")) * 0.5
            for s, name in K.HALVED_MEANS.items()}
    raw["ttl_gap"] = F.abs(optional(rows, "sttl") - optional(rows, "rttl")) / 255.0
    present = {f: F.avg(clip01(optional(rows, f))) for f in K.AVAILABILITY_FLAGS}
    at = F.timestamp_millis(F.max("timestamp_end"))
    gated = rows.groupBy(*KEYS).agg(
        *[F.when(present[g] > 0, F.avg(raw[n])).otherwise(0.0).alias(n) for n, g in GATED_MEANS.items()],
        present["has_ttl_metrics"].alias("ttl_metrics_present"),
        F.greatest(*present.values()).alias("transport_metrics_present"),
        F.hour(at).cast("double").alias("hour_of_day"),
        (F.weekday(at) + 1).cast("double").alias("day_of_week"),
        flag(F.weekday(at) >= 5).alias("is_weekend"),
    )
    base = raw_windows(flows, window_ms)
    base = base.drop(*[c for c in gated.columns if c not in KEYS])
    out = base.join(gated, KEYS)
    return out.withColumns({"bytes_out": F.col("total_bytes_out"), "bytes_in": F.col("total_bytes_in")})


# Columns of the service feature map that are log-scaled, and those passed through.
LOG_FEATURES = {
    "flow_count_log": "flow_count", "bytes_out_log": "bytes_out", "bytes_in_log": "bytes_in",
    "mean_packet_size_log": "mean_packet_size", "bytes_per_flow_log": "bytes_per_flow",
    "byte_rate_log": "byte_rate", "packet_rate_log": "packet_rate",
    "mean_duration_ms_log": "mean_duration_ms", "duration_jitter_log": "duration_jitter",
    "tcp_window_mean_log": "tcp_window_mean", "ack_delay_mean_log": "ack_delay_mean",
    "inter_packet_gap_mean_log": "inter_packet_gap_mean", "payload_mean_log": "payload_mean",
    "load_mean_log": "load_mean", "recent_flow_count_mean_log": "recent_flow_count_mean",
    "recent_byte_rate_mean_log": "recent_byte_rate_mean",
}
PLAIN_FEATURES = [
    "outbound_ratio", "burstiness", "novelty_score", "connection_frequency_delta",
    "destination_diversity", "activity_ratio", "periodic_beacon_score", "port_diversity",
    "protocol_diversity", "packet_imbalance", "small_flow_ratio", "high_port_ratio",
    "ttl_metrics_present", "syn_rate_total", "rst_rate_total", "ack_rate_total",
    "fin_rate_total", "psh_rate_total", "fragment_rate_total", "transport_metrics_present",
    "destination_concentration", "destination_transition_rate", "dns_flow_ratio",
    "web_flow_ratio", "private_destination_ratio", "multicast_destination_ratio",
    "flow_count_deviation", "byte_rate_deviation", "destination_diversity_shift",
    "novelty_shift", "recent_novelty_mean", "flow_count_trend", "byte_rate_trend",
    "novelty_trend", "destination_diversity_trend", "consecutive_burst_windows",
    "low_volume_periodic_score", "destination_risk_score", "lookalike_score",
    "suspicious_destination_ratio", "known_identity_ratio", "mitre_technique_ratio",
    "threat_tag_ratio",
]
SERVICE_RISKY_TLDS = ["zip", "mov", "top", "xyz", "click"]
LURE_WORDS = ["login-", "verify-", "secure-", "update-", "account-", "auth-"]
TRACKING_WORDS = ["doubleclick", "googlesyndication", "googleadservices", "tracking", "telemetry", "analytics"]


def backend_features(df: DataFrame, site: str | None = "site_hint") -> DataFrame:
    """The service model's 69 inputs: logs, day/week cycles and host pattern flags."""
    import math

    from netloom.functions.scalars import contains_any
    from netloom.operators.flows import optional

    def value(name: str, default: float = 0.0) -> Column:
        if name in ("bytes_out", "bytes_in") and name not in df.columns:
            name = f"total_{name}"
        return optional(df, name, default)

    hour = F.pmod(value("hour_of_day").cast("int"), F.lit(24))
    day = F.pmod(value("day_of_week").cast("int"), F.lit(7))
    host = F.lower(F.trim(F.coalesce(F.col(site), F.lit("")))) if site and site in df.columns else F.lit("")
    test_host = host.endswith(".badssl.com") | (host == "badssl.com")
    risky = host.rlike(r"\.(" + "|".join(SERVICE_RISKY_TLDS) + ")$") | host.contains("xn--")
    out = {name: F.log1p(clip(value(source), 0)) for name, source in LOG_FEATURES.items()}
    out |= {name: value(name) for name in PLAIN_FEATURES}
    out |= {
        "hour_of_day_sin": F.sin(hour * (2.0 * math.pi) / 24.0),
        "hour_of_day_cos": F.cos(hour * (2.0 * math.pi) / 24.0),
        "day_of_week_sin": F.sin(day * (2.0 * math.pi) / 7.0),
        "day_of_week_cos": F.cos(day * (2.0 * math.pi) / 7.0),
        "is_weekend": flag(value("is_weekend") != 0.0),
        "data_quality_penalty": 1.0 - value("data_quality_score", 1.0),
        "ttl_gap_norm": value("ttl_gap"),
        "phishing_domain_pattern": flag(risky | test_host),
        "credential_lure_pattern": flag(contains_any(host, LURE_WORDS) | test_host),
        "tracking_destination": flag(contains_any(host, TRACKING_WORDS)),
    }
    return df.withColumns(out)


BACKEND_FEATURES = [*LOG_FEATURES, *PLAIN_FEATURES, "hour_of_day_sin", "hour_of_day_cos",
                    "day_of_week_sin", "day_of_week_cos", "is_weekend", "data_quality_penalty",
                    "ttl_gap_norm", "phishing_domain_pattern", "credential_lure_pattern",
                    "tracking_destination"]


def insight_columns() -> dict[str, Column]:
    """Risk of a flow from the destination insight attached to it."""
    tags = F.coalesce(F.size("threat_tags"), F.lit(0)) > 0
    lookalike = F.coalesce(F.col("lookalike_score"), F.lit(0.0))
    odd = F.col("punycode_present") | F.col("digit_substitution_present")
    named = (F.length(F.trim(F.coalesce("normalized_host", F.lit("")))) > 0) | (
        F.length(F.trim(F.coalesce("registrable_domain", F.lit("")))) > 0)
    return {
        "destination_risk": clip01(F.greatest(
            lookalike, flag(tags) * 0.85, flag(F.col("suspicious_tld")) * 0.65, flag(odd) * 0.55,
            F.coalesce(F.col("confidence"), F.lit(0.0)) * 0.35)),
        "lookalike_score_flow": clip01(lookalike),
        "suspicious_destination": flag((lookalike >= 0.55) | odd | F.col("suspicious_tld") | tags),
        "known_identity": flag(named),
        "mitre_technique_flow": flag(F.coalesce(F.size("mitre_techniques"), F.lit(0)) > 0),
        "threat_tag_flow": flag(tags),
    }


INSIGHT_MEANS = {k: K.FLAG_MEANS[k] for k in (
    "destination_risk", "lookalike_score_flow", "suspicious_destination", "known_identity",
    "mitre_technique_flow", "threat_tag_flow")}


def insight_window(df: DataFrame, window_ms: int) -> DataFrame:
    """Destination columns of the endpoint window, from insight fields instead of host text."""
    rows = df.withColumns(insight_columns()).withColumn(
        "window_bucket", F.expr(f"timestamp_end div {int(window_ms)}L"))
    return rows.groupBy(*KEYS).agg(*[F.avg(c).alias(n) for c, n in INSIGHT_MEANS.items()])
