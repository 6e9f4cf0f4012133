"""One feature window per flow: all flows of its application in the trailing horizon.

Windows are taken over time panes (``plans/panes.py``): no window is cut to its newest rows unless
``row_limit`` asks for it, an application of any size is spread over its panes, and no row
carries the rows of its window along. All horizons of a flow come from one pass over its pane,
and a pane of many flows is read a part at a time (``plans/trail.py``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import constants as K
from netloom.functions.scalars import clip, clip01, flag
from netloom.operators.flows import app_family, prepare_flows
from netloom.operators.windows import ORDER, rolling_baseline
from netloom.plans import panes
from netloom.plans.ordered import positions, running, with_group
from netloom.plans.trail import BLOCK, NOTHING, Middle, Near, Trail

SUMMED = ["bytes_out", "bytes_in", "packets_out", "packets_in", "duration_ms", "dst_novelty", "small_flow", "high_port", *K.FLAG_MEANS, *K.TRANSPORT_MEANS, "positive_flow"]
KINDS = ["destination_key", "dst_port", "protocol"]
#: What is known of a window beside its sums.
SHAPE = ["_size_dev", "_duration_dev", "_gap_dev", "_span_ms", "_switches", "_top", *[f"_kinds_{c}" for c in KINDS]]
#: Rows that go back to Spark together: whole parts would be tens of MB outside its heap.
ROWS_OUT = 8_192
EMITTED_ORDER = ["window_end_ms", "flow_id", "adaptive_window_seconds"]


def asked_columns(df: DataFrame, kept: list[str], flags: list[str]) -> DataFrame:
    """The columns ``kept``, those the windows are made of, and the flags."""
    codes = [c for c in KINDS if c not in kept]
    numbers = [c for c in dict.fromkeys([*SUMMED, "total_bytes"]) if c not in kept]
    return df.select(*kept, *codes, *[F.col(c).cast("double").alias(c) for c in numbers], *flags)


def window_schema(asked: DataFrame, kept: list[str]) -> T.StructType:
    return T.StructType([
        *[f for f in asked.schema.fields if f.name in kept], *[T.StructField(c, T.LongType()) for c in ("_h", "_n")],
        *[T.StructField(f"_s_{c}", T.DoubleType()) for c in SUMMED], *[T.StructField(c, T.DoubleType()) for c in SHAPE]])


def shape(number: Callable[[str], np.ndarray], codes: dict[str, np.ndarray] | Near, ms: np.ndarray, gap: np.ndarray, moved: np.ndarray,
          low: np.ndarray, own: np.ndarray, h: int, middle: Middle = NOTHING) -> dict[str, np.ndarray]:
    """What is known of the windows of the rows ``own`` beside their sums: rows from ``low`` on, and all in the middle."""
    begin = low[own]
    n = own - begin + 1 + middle.n
    span = (ms[own] - ms[begin]).astype(np.float64)
    size, duration = number("total_bytes"), number("duration_ms")
    found = {"_h": np.full(len(own), h, np.int64), "_n": n, "_span_ms": span}
    mean = (panes.totals(size, begin, own) + middle.total("total_bytes")) / n
    found["_size_dev"] = panes.distances(size, begin, own, mean, middle, "total_bytes")
    mean = (panes.totals(duration, begin, own) + middle.total("duration_ms")) / n
    found["_duration_dev"] = panes.squares(duration, begin, own, mean) + middle.squares("duration_ms", mean)
    mean = span / 1000.0 / np.maximum(n - 1, 1)
    found["_gap_dev"] = panes.squares(gap, begin + 1, own, mean) + middle.squares("_gap", mean)
    found["_switches"] = panes.totals(moved, np.minimum(begin + 1, own), own) * (n > 1) + middle.total("_moved")
    top = "destination_key"
    found["_top"] = panes.largest(codes[top], low, middle.rows_of(top))[own].astype(np.float64)
    return found | {f"_kinds_{c}": panes.kinds(codes[c], low, middle.rows_of(c))[own].astype(np.float64) for c in KINDS}


def listed(table: pa.Table, places: np.ndarray, found: dict[str, np.ndarray], kept: list[str]) -> pa.Table:
    """The columns ``kept`` of some rows, with what was found of their windows."""
    same = table.select(kept).take(pa.array(places))
    for i, field in enumerate(same.schema):
        if pa.types.is_dictionary(field.type):
            same = same.set_column(i, field.name, same.column(i).cast(field.type.value_type))
    for c in ("_h", "_n", *[f"_s_{c}" for c in SUMMED], *SHAPE):
        same = same.append_column(c, pa.array(found[c]))
    return same


def picks(slow: np.ndarray, recent: np.ndarray, horizons_ms: list[int]) -> np.ndarray:
    """The horizon of each row by the class of its application and the rows in its middle horizon."""
    near, middle, far = horizons_ms
    return np.where(slow | (recent < K.SPARSE_FLOWS), far, np.where(recent > K.BUSY_FLOWS, near, middle))


def describe(table: pa.Table, group: np.ndarray, emit: np.ndarray, horizons_ms: list[int], choose: str | None,
             row_limit: int | None, kept: list[str]) -> Iterator[pa.Table]:
    """Windows of the rows marked in ``emit``; rows are sorted by (group, time, id)."""

    def number(name: str, first: int = 0, last: int | None = None) -> np.ndarray:
        return table.column(name)[first:last].fill_null(0).to_numpy().astype(np.float64)

    def code(name: str) -> np.ndarray:
        column = table.column(name).combine_chunks()
        column = column if pa.types.is_dictionary(column.type) else column.dictionary_encode()
        return column.indices.fill_null(-1).to_numpy() + 1

    at = np.arange(len(table))
    ms = table.column("timestamp_end").to_numpy()
    low = {h: panes.starts(group, ms, h, row_limit) for h in horizons_ms}
    if choose:
        picked = picks(table.column(choose).to_numpy().astype(bool), at - low[horizons_ms[1]] + 1, horizons_ms)
    codes = {c: code(c) for c in KINDS}
    gap = np.concatenate(([0], np.diff(ms))) / 1000.0
    moved = np.concatenate(([0.0], np.diff(codes["destination_key"]) != 0))
    for h in dict.fromkeys(horizons_ms):
        own = at[emit & (picked == h)] if choose else at[emit]
        if not len(own):
            continue
        whole = shape(number, codes, ms, gap, moved, low[h], own, h)
        # The sums of some rows at a time: wide results are never held for a whole pane.
        begin, step = low[h][own], max(panes.TOGETHER, int(whole["_n"].max()) // 8)
        for k in range(0, len(own), step):
            part = slice(k, k + step)
            b, o = begin[part], own[part]
            first, last = int(b.min()), int(o[-1]) + 1
            out = {c: v[part] for c, v in whole.items()}
            out |= {f"_s_{c}": panes.totals(number(c, first, last), b - first, o - first) for c in SUMMED}
            yield listed(table, o, out, kept)


def describe_part(table: pa.Table, emit: np.ndarray, trails: dict[int, Trail], horizons_ms: list[int], choose: str | None,
                  kept: list[str]) -> Iterator[pa.Table]:
    """The same for the next rows of one group, whose earlier rows are in ``trails``, one for each horizon."""
    picked = np.zeros(len(table), np.int64)
    slow = table.column(choose).to_numpy().astype(bool) if choose else None

    def wanted(h: int) -> Callable[[slice, np.ndarray], np.ndarray] | None:
        if not emit.any():
            return None
        if not choose:
            return lambda part, n: emit[part]

        def pick(part: slice, n: np.ndarray) -> np.ndarray:
            if h == horizons_ms[1]:
                picked[part] = picks(slow[part], n, horizons_ms)
            return emit[part] & (picked[part] == h)

        return pick

    order = [horizons_ms[1], *horizons_ms] if choose else horizons_ms  # the middle one decides
    for h in dict.fromkeys(order):
        for places, near, low, own, middle in trails[h].add(table, wanted(h)):
            def number(name: str, near: Near = near) -> np.ndarray:
                return near[name].astype(np.float64)

            found = shape(number, near, near["_ms"], near["_gap"], near["_moved"].astype(np.float64), low, own, h, middle)
            found |= {f"_s_{c}": panes.totals(number(c), low[own], own) + middle.total(c) for c in SUMMED}
            yield listed(table, places, found, kept)


def trail(horizon_ms: int, row_limit: int | None) -> Trail:
    numbers = list(dict.fromkeys([*SUMMED, "total_bytes"]))
    return Trail("timestamp_end", horizon_ms, row_limit, KINDS, "destination_key", numbers, "total_bytes", "duration_ms")


def window_sums(df: DataFrame, horizons_ms: list[int], choose: str | None, row_limit: int | None, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of each row with its horizon (``_h``), the rows of its window (``_n``), their sums and SHAPE.

    With ``choose`` (a boolean column: the application looks far back) one of three horizons is
    taken by activity; else every horizon is emitted. Only rows with ``_emit`` are returned.
    """
    asked = asked_columns(df, kept, ["_emit", *([choose] if choose else [])])
    schema = window_schema(asked, kept)
    passed = [f.name for f in schema.fields if f.name in kept]
    numbers = [c for c in dict.fromkeys([*SUMMED, "total_bytes"]) if c not in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trails: dict[int, Trail] = {}
        for table, group in panes.groups(batches, ["app_id", "_pane"], numbers, BLOCK, parts=True):
            emit = table.column("_emit").to_numpy().astype(bool) & ~table.column("_halo").to_numpy().astype(bool)
            if group[0] and (group[-1] > 1 or len(table) < BLOCK):
                trails = {}
                parts = describe(table, group, emit, horizons_ms, choose, row_limit, passed)
            else:
                if group[0]:
                    trails = {h: trail(h, row_limit) for h in horizons_ms}
                parts = describe_part(table, emit, trails, horizons_ms, choose, passed)
            for found in parts:
                yield from found.combine_chunks().to_batches(max_chunksize=ROWS_OUT)

    return panes.dealt(asked, ["app_id"], "timestamp_end", ORDER, max(horizons_ms)).mapInArrow(run, schema)


def window_columns() -> dict[str, Column]:
    n = F.col("_n").cast("double")
    seconds = F.greatest(F.lit(1.0), F.col("_h") / 1000.0)

    def total(c: str) -> Column:
        return F.col(f"_s_{c}")

    def kinds(c: str) -> Column:
        return F.col(f"_kinds_{c}") / n

    size = total("bytes_out") + total("bytes_in")
    packets_out, packets_in = total("packets_out"), total("packets_in")
    packets = clip(packets_out + packets_in, 1)
    mean_size = size / n
    gap_mean = F.col("_span_ms") / 1000.0 / (n - 1)
    gap_std = F.sqrt(F.col("_gap_dev") / (n - 1))
    out = {
        "window_end_ms": F.col("timestamp_end"),
        "window_start_ms": F.col("timestamp_end") - F.col("_h"),
        "window_bucket": F.expr("timestamp_end div 1000"),
        "adaptive_window_seconds": F.expr("_h div 1000"),
        "app_family": app_family("app_id"),
        "flow_count": F.col("_n").cast("long"),
        "total_bytes_out": total("bytes_out"),
        "total_bytes_in": total("bytes_in"),
        "mean_packet_size": size / packets,
        "outbound_ratio": total("bytes_out") / (size + 1.0),
        "burstiness": F.when(mean_size > 0, clip(F.col("_size_dev") / n / mean_size, 0, 4)).otherwise(0.0),
        "novelty_score": total("dst_novelty") / n,
        "connection_frequency_delta": F.log1p(n / seconds),
        "bytes_per_flow": mean_size,
        "destination_diversity": kinds("destination_key"),
        "activity_ratio": clip01(total("duration_ms") / F.greatest(F.lit(1.0), F.col("_h").cast("double"))),
        "periodic_beacon_score": F.when(
            (F.col("_n") >= 4) & (gap_mean > 0), clip01(1.0 - gap_std / gap_mean)).otherwise(0.0),
        "byte_rate": size / seconds,
        "packet_rate": packets / seconds,
        "mean_duration_ms": total("duration_ms") / n,
        "duration_jitter": F.when(
            F.col("_n") > 1, F.sqrt(F.col("_duration_dev") / n)).otherwise(0.0),
        "port_diversity": kinds("dst_port"),
        "protocol_diversity": kinds("protocol"),
        "packet_imbalance": F.abs(packets_out - packets_in) / (packets + 1.0),
        "small_flow_ratio": total("small_flow") / n,
        "high_port_ratio": total("high_port") / n,
        "destination_concentration": F.col("_top") / n,
        "destination_transition_rate": F.col("_switches") / clip(n - 1, 1),
        **{mean: total(c) / n for c, mean in K.FLAG_MEANS.items()},
        **{c: total(c) / n for c in K.TRANSPORT_MEANS},
        "window_contains_positive": (F.round(total("positive_flow")) > 0).cast("int"),
    }
    return out


def _global_rank(df: DataFrame) -> DataFrame:
    """Position of each flow in (app, time, id) order: rank in the app plus rows of earlier apps."""
    ranked = positions(df, ["app_id"], ORDER, "_rank")
    sizes = df.groupBy("app_id").agg(F.count(F.lit(1)).alias("_rows_of_app"))
    offsets = running(sizes, [], ["app_id"], {"_before": F.col("_rows_of_app")}, inclusive=False)
    offsets = offsets.select(F.col("app_id").alias("_app"), "_before")
    out = ranked.join(offsets, F.col("app_id") == F.col("_app"))
    return out.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_app", "_before")


def sliding_windows(
    flows: DataFrame,
    horizon_ms: int = 60_000,
    *,
    adaptive: bool = False,
    horizons_ms: list[int] | None = None,
    row_limit: int | None = None,
    label_strategy: str = "focal",
    emit_all_horizons: bool = False,
    max_windows: int = 0,
    baseline: bool = True,
) -> DataFrame:
    """Windows ending at every flow; ``adaptive`` picks the horizon by app class and activity.

    A window holds the flows of its horizon, whatever their number; ``row_limit`` keeps the newest.
    """
    short, middle, long_ = horizons_ms or K.HORIZONS_MS
    df = prepare_flows(flows)
    turn = None
    if max_windows > 0:
        ranked = _global_rank(df)
        stride = F.greatest(F.lit(1), F.ceil(F.col("_all") / F.lit(max_windows)))
        df = with_group(ranked, [], _all=F.count(F.lit(1)))
        turn = F.col("_rank") % stride == 0
    focal = label_strategy == "focal"
    kept = ["flow_id", "app_id", *K.PROVENANCE, "label", "timestamp_end"]
    df = df.withColumns({
        "positive_flow": flag(F.col("label") > 0),
        "_turn": F.lit(True) if turn is None else F.coalesce(turn, F.lit(False)),
        "far_sighted": app_family("app_id").isin(K.LONG_HORIZON_FAMILIES)})
    df = df.withColumn("_emit", (F.col("_turn") | (F.col("label") > 0)) if focal else F.lit(True))
    horizons = [short, middle, long_] if adaptive else [int(horizon_ms)]
    choose = "far_sighted" if adaptive and not emit_all_horizons else None
    out = window_sums(df.withColumn("timestamp_end", F.col("timestamp_end").cast("bigint")), horizons, choose, row_limit, [*kept, "_turn"])
    columns = window_columns()
    if turn is not None and not focal:
        out = out.filter(F.col("_turn") | (columns["window_contains_positive"] > 0))
    columns["label"] = F.col("label").cast("int") if focal else columns["window_contains_positive"]
    windows = out.select("flow_id", "app_id", *K.PROVENANCE, *[c.alias(n) for n, c in columns.items()])
    return rolling_baseline(windows, EMITTED_ORDER) if baseline else windows


def adaptive_windows(flows: DataFrame, **options) -> DataFrame:
    return sliding_windows(flows, adaptive=True, **options)


def window_builder(mode: str, **options):
    """Pick a window builder by name; the result is a DataFrame transformation."""
    from netloom.operators.windows import feature_windows

    builders = {
        "bucket": lambda df: feature_windows(df, **options),
        "sliding": lambda df: sliding_windows(df, **options),
        "adaptive": lambda df: adaptive_windows(df, **options),
    }
    if mode not in builders:
        raise ValueError(f"unknown window mode {mode!r}; choose from {sorted(builders)}")
    return builders[mode]


def recent_flows(flows: DataFrame, app: str, since_ms: int, until_ms: int, n: int | None = None) -> DataFrame:
    """Flows of an app that ended inside the interval, newest first; the newest n if asked for."""
    picked = flows.filter((F.col("app_id") == app) & F.col("timestamp_end").between(since_ms, until_ms))
    picked = picked.orderBy(F.desc("timestamp_end"), F.desc("flow_id"))
    return picked if n is None else picked.limit(n)
