"""Detectors that remember each application: drift, beacons, running baselines, transitions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import clip, clip01, flag
from netloom.plans.fold import fold, fold_stream
from netloom.plans.ordered import bounded, running, window, with_group
from netloom.plans.scan import affine, clamp, scan, then_affine, then_clamp

# Features watched by the drift monitor.
DRIFT_FEATURES = ["flow_count", "total_bytes_out", "total_bytes_in", "mean_packet_size", "outbound_ratio",
                  "burstiness", "novelty_score", "connection_frequency_delta", "bytes_per_flow",
                  "destination_diversity", "activity_ratio", "byte_rate", "packet_rate", "mean_duration_ms",
                  "duration_jitter", "port_diversity", "protocol_diversity", "packet_imbalance",
                  "hour_of_day", "is_weekend"]
ORDER = ["window_end_ms", "window_bucket"]


def running_drift(windows: DataFrame, mature: int = 25, normalizer: float = 5.0,
                  features: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """z of each window against all earlier windows of its app, averaged and scaled by maturity.

    Values are centred on the app's mean first, so the running sums of squares keep their digits.
    """
    features, order = features or DRIFT_FEATURES, order or ORDER
    out = with_group(windows, ["app_id"], **{f"_m_{c}": F.avg(F.col(c).cast("double")) for c in features})
    out = out.withColumns({f"_x_{c}": F.col(c) - F.col(f"_m_{c}") for c in features})
    sums = {"_n": F.lit(1)}
    for c in features:
        sums[f"_s_{c}"] = F.col(f"_x_{c}")
        sums[f"_q_{c}"] = F.col(f"_x_{c}") * F.col(f"_x_{c}")
    out = running(out, ["app_id"], order, sums, inclusive=False)
    n = F.col("_n").cast("double")

    def z(c: str) -> Column:
        var = (F.col(f"_q_{c}") - F.col(f"_s_{c}") * F.col(f"_s_{c}") / n) / (n - 1)
        std = F.when(n >= 2, F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(1.0)
        mean = F.when(n >= 1, F.col(f"_s_{c}") / n + F.col(f"_m_{c}")).otherwise(0.0)
        return F.abs((F.col(c) - mean) / std)

    out = out.withColumns({f"_z_{c}": z(c) for c in features})
    mean_z = sum((F.col(f"_z_{c}") for c in features[1:]), F.col(f"_z_{features[0]}")) / len(features)
    cells = F.array_sort(F.array(*[F.struct((-F.col(f"_z_{c}")).alias("k"), F.lit(i).alias("i"), F.lit(c).alias("f"))
                                   for i, c in enumerate(features)]))
    out = out.withColumns({
        "drift_score": F.when(F.col("_n") >= mature, clip01(mean_z / normalizer)).otherwise(0.0),
        "drift_mature": (F.col("_n") >= mature).cast("int"),
        "drift_features": F.transform(F.slice(cells, 1, 3), lambda x: x["f"]),
    })
    return out.drop("_n", *[f"_{p}_{c}" for c in features for p in "mxsqz"])


def beacon_score(flows: DataFrame, min_intervals: int = 4, max_intervals: int = 12,
                 destination: str = "destination_key") -> DataFrame:
    """Regularity of the last intervals between distinct flow times per (app, destination)."""
    keys = ["app_id", destination]
    times = flows.select(*keys, "timestamp_end").distinct()

    def build(part: DataFrame, names: list[str]) -> DataFrame:
        w = window(names, ["timestamp_end"])
        step = part.withColumn("_d", (F.col("timestamp_end") - F.lag("timestamp_end").over(w)).cast("double"))
        recent = w.rowsBetween(-(max_intervals - 1), 0)
        return step.withColumns({"_n": F.count("_d").over(recent), "_mean": F.avg("_d").over(recent),
                                 "_std": F.stddev_pop("_d").over(recent)}).drop("_d")

    scored = bounded(times, keys, ["timestamp_end"], max_intervals, build)
    mean = F.col("_mean")
    fit = F.when(mean < 15_000.0, clip01(mean / 15_000.0)).when(mean > 600_000.0, clip01(600_000.0 / mean)).otherwise(1.0)
    score = F.when(F.col("_n") >= min_intervals,
                   clip01(0.75 * clip01(1.0 - F.col("_std") / mean) + 0.25 * fit)).otherwise(0.0)
    scored = scored.select(*keys, "timestamp_end", score.alias("beacon_score"))
    return flows.join(scored, [*keys, "timestamp_end"], "left")


def stabilize(df: DataFrame, required: int = 3, order: list[str] | None = None,
              severity: str = "severity") -> DataFrame:
    """HIGH only after enough HIGHs: +1 per HIGH, -1 per MEDIUM down to zero, reset at LOW.

    A walk with a floor at zero equals its sum minus its running minimum, so two running
    aggregates replace the loop.
    """
    order = order or ORDER
    s = F.col(severity)
    out = running(df, ["app_id"], order, {"_reset": (s == "LOW").cast("int")})
    step = F.when(s == "HIGH", 1).when(s == "MEDIUM", -1).otherwise(0)
    out = running(out, ["app_id", "_reset"], order, {"_sum": step})
    out = running(out, ["app_id", "_reset"], order, {"_low": F.col("_sum")}, how="min")
    streak = F.col("_sum") - F.least(F.lit(0), F.col("_low"))
    stable = F.when((s == "HIGH") & (streak < required), "MEDIUM").otherwise(s)
    return out.withColumns({"high_streak": streak, "stable_severity": stable}).drop("_reset", "_sum", "_low")


# Smoothing rate and blend of instant and smoothed score.
ALPHA, INSTANT, SMOOTHED = 0.35, 0.45, 0.55


def smooth(df: DataFrame, score: str = "score", name: str = "smoothed", order: list[str] | None = None) -> DataFrame:
    """Exponential smoothing per app; the first score is taken as it is. Null scores leave the state alone.

    Each row is the affine map x -> (1 - ALPHA) * x + ALPHA * score; the running composition,
    applied to the first score of the app, is the smoothed value.
    """
    x, seen = F.col(score).cast("double"), F.col(score).isNotNull()
    maps = affine(F.when(seen, 1.0 - ALPHA).otherwise(1.0), F.when(seen, ALPHA * x).otherwise(0.0), "_ema_")
    maps |= {"_head": x, "_seen": seen.cast("long")}

    def compose(first: dict, second: dict) -> dict:
        return then_affine(first, second, "_ema_") | {
            "_head": F.coalesce(first["_head"], second["_head"]), "_seen": first["_seen"] + second["_seen"]}

    out = scan(df, ["app_id"], order or ORDER, maps, compose)
    ema = F.col("_ema_factor") * F.col("_head") + F.col("_ema_offset")
    return out.withColumns({
        "ema": ema,
        name: F.when(F.col("_seen") <= 1, F.col(score)).otherwise(clip01(INSTANT * F.col(score) + SMOOTHED * ema))}).drop(
        *maps)


# Statistical detector inputs (window column -> feature) and weights.
STAT_WEIGHTS = {
    "flow_count": 0.70, "total_bytes_out": 0.60, "total_bytes_in": 0.60, "mean_packet_size": 0.65,
    "outbound_ratio": 0.45, "burstiness": 0.22, "novelty_score": 1.10, "connection_frequency_delta": 0.22,
    "periodic_beacon_score": 1.15, "bytes_per_flow": 0.60, "destination_diversity": 0.80,
    "activity_ratio": 0.45, "byte_rate": 0.58, "packet_rate": 0.48, "mean_duration_ms": 0.34,
    "duration_jitter": 0.42, "port_diversity": 0.58, "protocol_diversity": 0.32,
    "packet_imbalance": 0.28, "small_flow_ratio": 0.24, "high_port_ratio": 0.18,
}
STAT_FEATURES = list(STAT_WEIGHTS)
SCALES = (0.35, 0.12, 0.04)            # short, medium, long memory
FEEDBACK_SCALES = (0.55, 0.28, 0.10)
SCALE_MIN_COUNT, SCALE_WEIGHT = np.array([4, 8, 12]), np.array([0.45, 0.35, 0.20])
MIN_STD, Z_NORM, STABLE_WINDOWS, MIN_SAMPLES = 0.05, 6.5, 15, 12
_AT = {name: i for i, name in enumerate(STAT_FEATURES)}
_WEIGHTS = np.array(list(STAT_WEIGHTS.values()))


def risk_floor_column() -> Column:
    """Least score a window deserves by its destination, beacon and novelty evidence."""
    c = F.col

    def rule(test: Column, value: Column) -> Column:
        return F.when(test, value).otherwise(0.0)

    beacon = F.greatest(c("periodic_beacon_score"), c("low_volume_periodic_score"))
    shift = F.greatest(c("novelty_shift"), c("destination_diversity_shift"))
    moves = F.greatest(c("destination_transition_rate"), c("destination_diversity"))
    return clip(F.greatest(
        rule(c("destination_risk_score") >= 0.10, clip(0.04 + c("destination_risk_score") * 0.45, hi=0.55)),
        rule(c("lookalike_score") >= 0.35, clip(0.03 + c("lookalike_score") * 0.34, hi=0.45)),
        rule(c("suspicious_destination_ratio") >= 0.10,
             clip(0.02 + c("suspicious_destination_ratio") * 0.28, hi=0.36)),
        rule((c("threat_tag_ratio") >= 0.05) | (c("mitre_technique_ratio") >= 0.05), F.lit(0.20)),
        rule(beacon >= 0.35, beacon * 0.22),
        rule(c("novelty_score") >= 0.20, clip(0.01 + c("novelty_score") * 0.12, hi=0.18)),
        rule((c("novelty_shift") >= 0.12) | (c("destination_diversity_shift") >= 0.18), 0.035 + shift * 0.18),
        rule((c("destination_transition_rate") >= 0.25) | (c("destination_diversity") >= 0.45), 0.025 + moves * 0.08),
        rule((c("transport_metrics_present") >= 0.5)
             & ((c("syn_rate_total") >= 0.20) | (c("rst_rate_total") >= 0.20) | (c("fragment_rate_total") >= 0.05)),
             F.lit(0.04)),
        rule((c("high_port_ratio") >= 0.75) & (c("web_flow_ratio") < 0.35), F.lit(0.025)),
    ), 0.0, 0.60)


class Scales:
    """Exponentially weighted mean and variance of all features at three memory lengths."""

    def __init__(self, scales: int = 3) -> None:
        self.count = 0
        self.mean = np.zeros((scales, len(STAT_FEATURES)))
        self.var = np.full((scales, len(STAT_FEATURES)), MIN_STD ** 2)

    def update(self, x: np.ndarray, rates: tuple) -> None:
        self.count += 1
        if self.count == 1:
            self.mean[:] = x
            return
        a = np.array(rates)[:, None]
        delta = x - self.mean
        self.mean = self.mean + a * delta
        self.var = (1.0 - a) * self.var + a * delta * delta

    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.var, MIN_STD ** 2))

    def z(self, x: np.ndarray) -> np.ndarray:
        w = np.where(self.count >= SCALE_MIN_COUNT, SCALE_WEIGHT, 0.0)
        return (w[:, None] * np.abs((x - self.mean) / self.std())).sum(axis=0) / max(w.sum(), 1e-9)


def new_statistical_state() -> dict:
    return {"windows": 0, "all": Scales(), "by_context": {}, "benign": None, "dangerous": None}


def _context(row: dict) -> tuple:
    return int(row["hour_of_day"]), int(row["is_weekend"] > 0)


def _exemplar_closeness(x: np.ndarray, exemplar: Scales | None) -> float | None:
    if exemplar is None:
        return None
    return 1.0 / (1.0 + float(np.mean(np.abs(x - exemplar.mean[0]) / exemplar.std()[0])))


def record_feedback(state: dict, row: dict, dangerous: bool) -> None:
    """Triage: a benign window pulls the baselines fast; both kinds keep an exemplar."""
    x = np.array([float(row[f]) for f in STAT_FEATURES])
    if not dangerous:
        state["all"].update(x, FEEDBACK_SCALES)
        state["by_context"].setdefault(_context(row), Scales()).update(x, FEEDBACK_SCALES)
    side, rate = ("dangerous", 0.25) if dangerous else ("benign", 0.35)
    state[side] = state[side] or Scales(1)
    state[side].update(x, (rate,))


def statistical_step(state: dict, row: dict) -> tuple:
    """One window in, (score, confidence, top features) out; the state moves on unless frozen."""
    if row.get("feedback"):
        record_feedback(state, row, row["feedback"] == "dangerous")
        return (None, None, None)
    x = np.array([float(row[f]) for f in STAT_FEATURES])
    everything = state["all"]
    context = state["by_context"].setdefault(_context(row), Scales())
    state["windows"] += 1
    mature = 1.0 if everything.count >= MIN_SAMPLES else 0.0
    z_all, z_context = everything.z(x), context.z(x)
    frozen = (row["novelty_score"] >= 0.75 or row["periodic_beacon_score"] >= 0.65
              or (row["destination_diversity"] >= 0.9 and row["connection_frequency_delta"] >= 1.0))
    if not frozen:
        everything.update(x, SCALES)
        context.update(x, SCALES)
    share = 0.35 if context.count >= MIN_SAMPLES // 2 else 0.0
    z = (1.0 - share) * z_all + share * z_context

    def of(name: str) -> float:
        return float(z[_AT[name]])

    raw = float((z * _WEIGHTS).sum() / _WEIGHTS.sum())
    warm = min(1.0, state["windows"] / STABLE_WINDOWS)
    maturity = 0.35 + 0.65 * mature
    backing = (of("novelty_score") + of("periodic_beacon_score") + of("destination_diversity") + of("port_diversity")) / 4
    bursty = any(of(n) > 1.3 for n in ("burstiness", "connection_frequency_delta", "byte_rate", "packet_rate"))
    factor = 0.58 if bursty and backing < 0.55 else 1.0
    if (state["windows"] <= 6 and (of("flow_count") > 1.4 or of("connection_frequency_delta") > 1.5)
            and of("novelty_score") < 0.75 and of("periodic_beacon_score") < 0.90):
        factor *= 0.52
    if of("activity_ratio") > 0.8 and of("novelty_score") < 0.65 and of("destination_diversity") < 0.85:
        factor *= 0.76
    benign, dangerous = _exemplar_closeness(x, state["benign"]), _exemplar_closeness(x, state["dangerous"])
    if benign is not None:
        factor *= min(1.0, max(0.78, 1.0 - 0.18 * benign))
    boost = 0.0 if dangerous is None else min(0.12, 0.12 * dangerous)
    base = min(1.0, max(0.0, min(1.0, raw / Z_NORM) * warm * maturity * factor + boost))
    floor = float(row["risk_floor"])
    top = [STAT_FEATURES[i] for i in np.argsort(-z, kind="stable")[:3]]
    if floor > base and floor > 0.0:
        top = ["android_feature_risk_floor", *top][:3]
    return max(base, floor), min(1.0, max(0.0, (warm + maturity) / 2.0)), top


STAT_INPUTS = [*STAT_FEATURES, "hour_of_day", "is_weekend", "risk_floor"]
STAT_ADDED = "statistical_score double, statistical_confidence double, statistical_features array<string>"


def _in_context(windows: DataFrame) -> DataFrame:
    return windows.withColumn("risk_floor", risk_floor_column())


def statistical_score(windows: DataFrame, order: list[str] | None = None) -> DataFrame:
    return fold(_in_context(windows), ["app_id"], order or ORDER, STAT_INPUTS, STAT_ADDED,
                new_statistical_state, statistical_step)


def statistical_score_stream(windows: DataFrame, order: list[str] | None = None) -> DataFrame:
    return fold_stream(_in_context(windows), ["app_id"], order or ORDER, STAT_INPUTS, STAT_ADDED,
                       new_statistical_state, statistical_step)


def statistical_score_with_feedback(windows: DataFrame, triage: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Triage rows (window columns plus ``feedback``) enter the fold at their own time."""
    scored = _in_context(windows).withColumn("feedback", F.lit(None).cast("string"))
    told = _in_context(triage).select(*scored.columns)
    out = fold(scored.unionByName(told), ["app_id"], order or ORDER, [*STAT_INPUTS, "feedback"], STAT_ADDED,
               new_statistical_state, statistical_step)
    return out.filter(F.col("feedback").isNull()).drop("feedback")


# Multivariate detector.
MULTI_FEATURES = ["flow_count", "total_bytes_out", "total_bytes_in", "mean_packet_size", "outbound_ratio",
                  "burstiness", "novelty_score", "connection_frequency_delta", "bytes_per_flow",
                  "destination_diversity", "activity_ratio", "periodic_beacon_score", "byte_rate", "packet_rate",
                  "mean_duration_ms", "duration_jitter", "port_diversity", "protocol_diversity",
                  "packet_imbalance", "small_flow_ratio", "high_port_ratio"]
MULTI_MIN, MULTI_CONTEXT_MIN, MULTI_RATE, SHRINK, RIDGE = 18, 10, 0.08, 0.18, 1e-3


class Gaussian:
    """Exponentially weighted mean and covariance."""

    def __init__(self) -> None:
        d = len(MULTI_FEATURES)
        self.count, self.mean, self.cov = 0, np.zeros(d), np.zeros((d, d))

    def update(self, x: np.ndarray) -> None:
        self.count += 1
        if self.count == 1:
            self.mean = x.copy()
            np.fill_diagonal(self.cov, RIDGE)
            return
        delta = x - self.mean
        self.mean = (1.0 - MULTI_RATE) * self.mean + MULTI_RATE * x
        self.cov = (1.0 - MULTI_RATE) * self.cov + MULTI_RATE * np.outer(delta, delta)

    def distance(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        if self.count < 2:
            return 0.0, np.zeros_like(x)
        own = np.diag(self.cov)
        shrunk = (1.0 - SHRINK) * self.cov
        floor = max(np.maximum(own, RIDGE).mean(), RIDGE) * 0.05 + RIDGE
        diag = np.maximum(own, floor)
        np.fill_diagonal(shrunk, diag)
        centred = x - self.mean
        try:
            solved = np.linalg.solve(shrunk, centred)
        except np.linalg.LinAlgError:
            solved = np.zeros_like(x)
        return max(0.0, float(centred @ solved)), centred * centred / np.maximum(diag, RIDGE)


def _tail_score(distance: float, dof: int) -> float:
    if distance <= 0.0:
        return 0.0
    z = (max(distance / dof, 1e-9) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return 0.5 * (1.0 + math.tanh(math.sqrt(2.0 / math.pi) * (z + 0.044715 * z ** 3)))


def multivariate_step(state: dict, row: dict) -> tuple:
    x = np.array([float(row[f]) for f in MULTI_FEATURES])
    whole, context = state["all"], state["by_context"].setdefault(_context(row), Gaussian())
    d_whole, c_whole = whole.distance(x)
    d_context, c_context = context.distance(x)
    ripe, ripe_context = whole.count >= MULTI_MIN, context.count >= MULTI_CONTEXT_MIN
    if ripe and ripe_context:
        distance = 0.65 * d_whole + 0.35 * d_context
    else:
        distance = d_whole if ripe else d_context if ripe_context else 0.0
    warm = min(1.0, max(0.15, whole.count / MULTI_MIN))
    warm_context = min(1.0, max(0.20, context.count / MULTI_CONTEXT_MIN))
    score = min(1.0, max(0.0, _tail_score(distance, len(x)) * (0.5 + 0.5 * warm_context if ripe_context else warm)))
    parts = 0.7 * c_whole + (0.3 * c_context if ripe_context else 0.0)
    top = [MULTI_FEATURES[i] for i in np.argsort(-parts, kind="stable")[:4]]
    odd = (row["novelty_score"] >= 0.80 or row["periodic_beacon_score"] >= 0.72
           or (row["destination_diversity"] >= 0.92 and row["connection_frequency_delta"] >= 0.90))
    if not odd or score < 0.82:
        whole.update(x)
        context.update(x)
    return score, min(0.98, max(0.25, (warm + warm_context) / 2.0)), top


MULTI_INPUTS = [*MULTI_FEATURES, "hour_of_day", "is_weekend"]
MULTI_ADDED = "multivariate_score double, multivariate_confidence double, multivariate_features array<string>"


def new_multivariate_state() -> dict:
    return {"all": Gaussian(), "by_context": {}}


def multivariate_score(windows: DataFrame, order: list[str] | None = None) -> DataFrame:
    return fold(windows, ["app_id"], order or ORDER, MULTI_INPUTS, MULTI_ADDED, new_multivariate_state,
                multivariate_step)


def multivariate_score_stream(windows: DataFrame, order: list[str] | None = None) -> DataFrame:
    return fold_stream(windows, ["app_id"], order or ORDER, MULTI_INPUTS, MULTI_ADDED, new_multivariate_state,
                       multivariate_step)


def bucket_state() -> Column:
    """Text state of a window: novelty, traffic, destination and transport class."""
    c = F.col
    novelty = F.when(c("novelty_score") >= 0.85, "exploratory").when(c("novelty_score") >= 0.45, "mixed").otherwise("stable")
    traffic = F.when((c("byte_rate") >= 40_000) | (c("flow_count") >= 24), "burst").when(
        (c("byte_rate") >= 8_000) | (c("flow_count") >= 8), "active").otherwise("quiet")
    spread = F.when(c("destination_diversity") >= 0.80, "spread").when(
        c("destination_diversity") >= 0.35, "varied").otherwise("focused")
    transport = F.when((c("protocol_diversity") >= 0.60) | (c("port_diversity") >= 0.60), "mixed").when(
        c("high_port_ratio") >= 0.75, "high_port").otherwise("narrow")
    return F.concat_ws("|", novelty, traffic, spread, transport)


# Transition detector.
SEQ_MIN, SEQ_DECAY, SEQ_KEEP = 8, 0.12, 128
SEQ_LAST = ["novelty_score", "destination_diversity", "byte_rate", "packet_rate", "periodic_beacon_score"]


def new_sequence_state() -> dict:
    return {"moves": 0, "counts": {}, "state": None, **{k: 0.0 for k in SEQ_LAST}}


def sequence_step(state: dict, row: dict) -> tuple:
    now, before = row["bucket_state"], state["state"]
    rarity = 0.0
    if before is not None and state["moves"] >= SEQ_MIN:
        out = state["counts"].get(before, {})
        rarity = 1.0 - (out.get(now, 0) + 1.0) / (max(1, sum(out.values())) + len(out) + 1.0)
    shift = 0.0
    if state["moves"] >= 2:
        def relative(c: str) -> float:
            return min(1.0, abs(row[c] - state[c]) / max(abs(state[c]), 1.0))

        shift = min(1.0, 0.34 * abs(row["destination_diversity"] - state["destination_diversity"])
                    + 0.28 * abs(row["novelty_score"] - state["novelty_score"])
                    + 0.22 * relative("byte_rate") + 0.16 * relative("packet_rate"))
    beat = max(0.0, row["periodic_beacon_score"] - state["periodic_beacon_score"])
    fresh = max(0.0, row["novelty_score"] - state["novelty_score"])
    score = min(1.0, max(0.0, 0.52 * rarity + 0.28 * shift + 0.12 * beat + 0.08 * fresh))
    confidence = min(0.96, max(0.20, state["moves"] / (SEQ_MIN * 1.5)))
    if score < 0.90 or row["novelty_score"] < 0.95:
        if before is not None:
            out = state["counts"].setdefault(before, {})
            out[now] = out.get(now, 0) + 1
            state["moves"] += 1
            if state["moves"] > SEQ_KEEP:
                faded = {a: {b: int(n * (1 - SEQ_DECAY)) for b, n in o.items() if n * (1 - SEQ_DECAY) >= 1.0}
                         for a, o in state["counts"].items()}
                state["counts"] = faded
                state["moves"] = sum(sum(o.values()) for o in faded.values())
        state["state"] = now
        state.update({k: row[k] for k in SEQ_LAST})
    return score, confidence


SEQ_INPUTS = ["bucket_state", *SEQ_LAST]
SEQ_ADDED = "sequence_score double, sequence_confidence double"


def sequence_score(windows: DataFrame, order: list[str] | None = None) -> DataFrame:
    return fold(windows.withColumn("bucket_state", bucket_state()), ["app_id"], order or ORDER, SEQ_INPUTS,
                SEQ_ADDED, new_sequence_state, sequence_step)


def sequence_score_stream(windows: DataFrame, order: list[str] | None = None) -> DataFrame:
    return fold_stream(windows.withColumn("bucket_state", bucket_state()), ["app_id"], order or ORDER, SEQ_INPUTS,
                       SEQ_ADDED, new_sequence_state, sequence_step)


# Triage steps and bounds of the threshold feedback.
FEEDBACK_UP, FEEDBACK_DOWN = 0.02, 0.01
CEILINGS, FLOORS = (0.90, 0.95, 0.99), (0.02, 0.05, 0.15)


LEVELS = ("low", "medium", "high")


def threshold_step(state: tuple[float, float, float], status: str | None) -> tuple[float, float, float]:
    """The three thresholds after one triage event."""
    if status == "FALSE_POSITIVE":
        state = tuple(min(c, v + FEEDBACK_UP) for c, v in zip(CEILINGS, state))
    elif status == "RESOLVED":
        state = tuple(max(f, v - FEEDBACK_DOWN) for f, v in zip(FLOORS, state))
    low = min(1.0, max(0.0, state[0]))
    medium = min(1.0, max(low, state[1]))
    return low, medium, min(1.0, max(medium, state[2]))


def feedback_thresholds(triage: DataFrame, defaults: dict[str, float], order: list[str],
                        ranges: int | None = None) -> DataFrame:
    """Thresholds of the app after each triage event, in order.

    The first event puts the thresholds in order and into [0, 1]. From then on every step keeps
    their order (steps are equal, floors and ceilings ascend), so each one is a walk of its own
    and an event is a clamp: a running composition of clamps gives all rows.
    """
    start = tuple(float(defaults[n]) for n in LEVELS)
    status = F.col("triage_status")
    up, down = status == "FALSE_POSITIVE", status == "RESOLVED"
    maps, first = {}, {}
    after = {s: threshold_step(start, s) for s in ("FALSE_POSITIVE", "RESOLVED", None)}
    for i, n in enumerate(LEVELS):
        shift = F.when(up, FEEDBACK_UP).when(down, -FEEDBACK_DOWN).otherwise(0.0)
        maps |= clamp(shift, F.when(down, FLOORS[i]).otherwise(0.0), F.when(up, CEILINGS[i]).otherwise(1.0), f"_{n}_")
        value = F.when(up, after["FALSE_POSITIVE"][i]).when(down, after["RESOLVED"][i]).otherwise(after[None][i])
        first |= clamp(F.lit(0.0), value, value, f"_{n}_")

    def compose(one: dict, two: dict) -> dict:
        return {k: v for n in LEVELS for k, v in then_clamp(one, two, f"_{n}_").items()}

    out = scan(triage, ["app_id"], order, maps, compose, first, ranges)
    return out.withColumns({f"{n}_after": F.col(f"_{n}_floor") for n in LEVELS}).drop(*maps)
