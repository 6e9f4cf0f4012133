"""Structured Streaming forms: ingest, windows, sliding features, alerts.

Aggregations and sessions are built-in streaming operators with watermarks. What must remember
each application goes through the ordered fold, whose step function is the batch one.
"""

from __future__ import annotations

import uuid
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import constants as K
from netloom.functions.scalars import flag
from netloom.operators import store as so
from netloom.operators.alerts import correlation_key, evidence_strength
from netloom.operators.flows import app_family, prepare_flows
from netloom.operators.scoring import rule_contributions, rule_score, top_features
from netloom.operators.sliding import SUMMED, asked_columns, describe, sliding_windows, window_columns, window_schema
from netloom.plans import panes
from netloom.plans.fold import fold, fold_stream
from netloom.plans.ordered import positions
from netloom.session import STATE_STORE, shared_dir


def event_time(flows: DataFrame, lateness: str = "0 seconds", ms: str = "timestamp_end") -> DataFrame:
    return flows.withColumn("event_time", F.timestamp_millis(F.col(ms).cast("long"))).withWatermark("event_time", lateness)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/netloom-{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a Parquet table and read it back (append mode)."""
    spark = stream.sparkSession
    path, mark = new_path(spark, "stream"), new_path(spark, "mark")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle, mode: str = "append") -> None:
    q = stream.writeStream.outputMode(mode).foreachBatch(handle).option(
        "checkpointLocation", new_path(stream.sparkSession, "mark")).trigger(availableNow=True).start()
    q.awaitTermination()


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def ingest_stream(source: DataFrame, good_path: str, rejected_path: str, kind: str = "mobile_flow") -> None:
    """Validate events; good and rejected rows go to separate tables, one folder per batch.

    A batch that runs again after a failure overwrites its own folder, so nothing doubles.
    """
    def handle(batch: DataFrame, number: int) -> None:
        good, bad = so.validate_events(batch, kind)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")

    run_batches(source, handle)


def dedup_stream(events: DataFrame, id_col: str = "event_id", lateness: str = "1 hour", ms: str = "timestamp_end") -> DataFrame:
    return event_time(events, lateness, ms).dropDuplicatesWithinWatermark([id_col])


def _window_aggs() -> list:
    size = F.col("bytes_out") + F.col("bytes_in")
    return [
        F.count(F.lit(1)).alias("flow_count"), F.sum("bytes_out").alias("total_bytes_out"),
        F.sum("bytes_in").alias("total_bytes_in"), F.avg("dst_novelty").alias("novelty_score"),
        F.avg("duration_ms").alias("mean_duration_ms"), F.stddev_pop("duration_ms").alias("duration_jitter"),
        F.avg((size <= K.SMALL_FLOW_BYTES).cast("double")).alias("small_flow_ratio"),
        F.size(F.collect_set("dst_port")).alias("ports"),
        F.approx_count_distinct("destination_key").alias("approx_destinations"), F.max("label").alias("label")]


def _bounds(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start_ms": F.unix_millis("window.start"), "window_end_ms": F.unix_millis("window.end")}).drop("window")


def feature_windows_stream(flows: DataFrame, length: str = "60 seconds", lateness: str = "0 seconds") -> DataFrame:
    """Tumbling windows; distinct destinations are approximate (a stream cannot count them exactly)."""
    return _bounds(event_time(flows, lateness).groupBy(F.window("event_time", length), "app_id").agg(*_window_aggs()))


def hopping_windows_stream(flows: DataFrame, length: str, slide: str, lateness: str = "0 seconds") -> DataFrame:
    return _bounds(event_time(flows, lateness).groupBy(F.window("event_time", length, slide), "app_id").agg(*_window_aggs()))


def episodes_stream(rows: DataFrame, gap_ms: int, lateness: str = "0 seconds", ms: str = "timestamp_end") -> DataFrame:
    """Sessions per (app, session). The engine merges gaps below its own, so one millisecond is added."""
    session = F.session_window("event_time", f"{gap_ms + 1} milliseconds")
    out = event_time(rows, lateness, ms).groupBy(session, "app_id", "session_id").agg(
        F.count(F.lit(1)).alias("windows"), F.max("label").alias("label"), F.min(ms).alias("start_ms"), F.max(ms).alias("end_ms"))
    return out.drop("session_window")


def device_activity_stream(events: DataFrame) -> DataFrame:
    return so.max_activity(so.event_activity(events))


def upsert_batches(stream: DataFrame, path: str, key: str, updated: str = "updated_epoch", created: str = "created_epoch",
                   buckets: int = 64) -> DataFrame:
    """Keep the newest row per key in a table of key buckets; a batch rewrites the buckets it touches.

    Each batch has a folder of its own with those buckets as they are from then on, so a repeated
    batch overwrites itself. A bucket's newest folder holds it; readers merge by that.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def handle(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        before = current_rows(spark, path, schema, number) if number else placed.limit(0)
        before = before.join(F.broadcast(placed.select("bucket").distinct()), "bucket", "left_semi")
        out = so.upsert(before.select(schema.names), batch, key, updated, created)
        out.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{path}/v={number}")

    run_batches(stream, handle, "append")
    return current_rows(spark, path, schema).select(schema.names)


def current_rows(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """Rows of every bucket from the newest batch that wrote it (earlier than ``before``, if given)."""
    placed = T.StructType([*schema.fields, T.StructField("v", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(placed).option("basePath", path).parquet(path)
    if before is not None:
        rows = rows.filter(F.col("v") < before)
    # Both columns come from folder names: at most one row per bucket is broadcast.
    newest = rows.groupBy("bucket").agg(F.max("v").alias("v"))
    return rows.join(F.broadcast(newest), ["bucket", "v"], "left_semi")


# ---- one window per flow, kept per application
KEPT = ["flow_id", "app_id", *K.PROVENANCE, "label", "timestamp_end"]
#: State types of Spark's columns, and their Arrow types.
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def sliding_windows_stream(flows: DataFrame, horizon_ms: int = 60_000, *, adaptive: bool = False, horizons_ms: list[int] | None = None,
                           emit_all_horizons: bool = False, row_limit: int | None = None, lateness: str = "0 seconds") -> DataFrame:
    """The windows of ``sliding_windows`` without baselines, in event time.

    Flows are put in order before they count: those of a pane (a quarter of the horizon) wait in
    state until the watermark passes its end, whatever the order in which they come. Then their windows are
    made of all flows of the pane and the horizon before it, so the rows do not depend on how the
    input was cut into batches. State is one typed row per (application, pane): plain arrays by
    column. Panes older than the horizon are removed, by a timer also where nothing else arrives.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    horizons = list(horizons_ms or K.HORIZONS_MS) if adaptive else [int(horizon_ms)]
    choose = "far_sighted" if adaptive and not emit_all_horizons else None
    reach = max(horizons)
    length = max(1, reach // 4)
    df = prepare_flows(event_time(flows, lateness))
    df = df.withColumns({"positive_flow": flag(F.col("label") > 0), "far_sighted": app_family("app_id").isin(K.LONG_HORIZON_FAMILIES),
                         "timestamp_end": F.col("timestamp_end").cast("bigint")})
    asked = asked_columns(df, KEPT, ["far_sighted"])
    schema = window_schema(asked, KEPT)
    stored = [c for c in asked.columns if c != "app_id"]
    kinds = {c: t for c, t in asked.dtypes if c != "app_id"}
    passed, columns = [f.name for f in schema.fields if f.name in KEPT], schema.names
    state_type = ", ".join(f"{c} array<{kinds[c]}>" for c in stored)
    numbers = [c for c in dict.fromkeys([*SUMMED, "total_bytes"]) if c not in KEPT]

    class Panes(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.panes = handle.getMapState("panes", "pane bigint, piece bigint", state_type)
            self.pieces = handle.getValueState("pieces", "stored bigint")
            self.done = handle.getValueState("released", "until_ms bigint")

        def handleInputRows(self, key, rows, timer_values):
            first, piece = None, self.pieces.get()[0] if self.pieces.exists() else 0
            for pdf in rows:
                table = pa.Table.from_pandas(pdf[stored], preserve_index=False).sort_by([("timestamp_end", "ascending")])
                pane = table.column("timestamp_end").to_numpy() // length
                cuts = [0, *(np.flatnonzero(np.diff(pane)) + 1).tolist(), len(pane)]
                for low, high in zip(cuts, cuts[1:]):
                    if low == high:
                        continue
                    # What is stored is not read again: each arrival adds a piece of its own.
                    self.panes.updateValue((int(pane[low]), piece), tuple(c.to_pylist() for c in table.slice(low, high - low).columns))
                piece += 1
                if len(pane):
                    first = int(pane[0]) if first is None else min(first, int(pane[0]))
            self.pieces.update((piece,))
            if first is not None:
                self.handle.registerTimer((first + 1) * length)
            return iter(())

        def _read(self, keys: list, app: str) -> pa.RecordBatch:
            """The rows of a pane, held compactly."""
            parts = [self.panes.getValue(k) for k in keys]
            raw = [pa.array([v for part in parts for v in part[i]], _TYPES[kinds[c]]) for i, c in enumerate(stored)]
            raw.append(pa.array([app] * len(raw[0]), pa.string()))
            return panes.compact(pa.RecordBatch.from_arrays(raw, names=[*stored, "app_id"]), numbers)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            until = timerValues.getCurrentWatermarkInMs() // length * length
            before = self.done.get()[0] if self.done.exists() else None
            if before is not None and until <= before:
                return
            pieces: dict[int, list] = {}
            for k in self.panes.keys():
                pieces.setdefault(int(k[0]), []).append((int(k[0]), int(k[1])))
            held = sorted(pieces)
            open_ = [p for p in held if (p + 1) * length <= until and (before is None or p * length >= before)]
            # Some panes at a time, with those of the horizon before them.
            near: dict[int, pa.RecordBatch] = {}
            while open_:
                begin, rows, many = open_[0], 0, 0
                near = {p: b for p, b in near.items() if (p + 1) * length > begin * length - reach}
                for p in held:
                    if (p + 1) * length <= begin * length - reach or p > open_[-1] or rows >= panes.TOGETHER:
                        continue
                    if p not in near:
                        near[p] = self._read(pieces[p], key[0])
                    if p >= begin:
                        rows, many = rows + len(near[p]), many + 1
                open_ = open_[many:]
                table = panes.joined(list(near.values())).sort_by([("timestamp_end", "ascending"), ("flow_id", "ascending")])
                emit = table.column("timestamp_end").to_numpy() >= begin * length
                for found in describe(table, np.zeros(len(table), np.int64), emit, horizons, choose, row_limit, passed):
                    yield found.select(columns).to_pandas()
            left = [p for p in held if (p + 1) * length > until - reach]
            for p in held[:len(held) - len(left)]:
                for k in pieces[p]:
                    self.panes.removeKey(k)
            self.done.update((int(until),))
            # The next pane to be released; or, if nothing waits, the time from which no pane is needed.
            waiting = [p for p in left if (p + 1) * length > until]
            if left:
                self.handle.registerTimer((waiting[0] + 1) * length if waiting else (left[-1] + 1) * length + reach)

        def close(self) -> None:
            pass

    out = df.select(*asked.columns, "event_time").groupBy("app_id").transformWithStateInPandas(
        statefulProcessor=Panes(), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    made = window_columns()
    made["label"] = F.col("label").cast("int")
    return out.select("flow_id", "app_id", *K.PROVENANCE, *[c.alias(n) for n, c in made.items()])


# ---- alerts
ALERT_INPUTS = ["window_end_ms", "session_id", "score", "evidence_strength", "app_family", "correlation_key"]
ALERT_ADDED = "candidate_count long, emitted int, alert_no long, first_seen long, last_seen long, max_score double"


def alert_step(state: dict, row: dict, threshold: float, window_ms: int, merge_ms: int, required: dict, min_evidence: int,
               bypass: float, slack: float) -> tuple:
    """Persistence policy per session, then merging of emitted alerts of one correlation key whose gap is small enough."""
    now, score, evidence = row["window_end_ms"], row["score"], row["evidence_strength"]
    if score < threshold:
        return (0, 0, None, None, None, None)
    queue = state.setdefault(("queue", row["session_id"]), deque())
    while queue and queue[0][0] < now - window_ms:
        queue.popleft()
    queue.append((now, score, evidence))
    need = required.get(row["app_family"], required["default"])
    persistent = len(queue) >= need and score >= queue[0][1] - slack and max(q[2] for q in queue) >= min_evidence
    if not (persistent or (score >= bypass and evidence >= min_evidence)):
        return (len(queue), 0, None, None, None, None)
    name = ("open", row["correlation_key"])
    open_ = state.get(name)
    if open_ and now - open_["last"] <= merge_ms:
        open_.update(last=now, top=max(open_["top"], score))
    else:
        open_ = state[name] = {"no": (open_["no"] if open_ else 0) + 1, "first": now, "last": now, "top": score}
    return (len(queue), 1, open_["no"], open_["first"], open_["last"], open_["top"])


# Policy of the streaming alert pipeline.
ALERT_POLICY = {"threshold": 0.3, "window_ms": 300_000, "merge_ms": 600_000, "min_evidence": 1, "bypass": 0.94, "slack": 0.08,
                "required": {"service": 2, "system": 2, "other_app": 2, "default": 2}}


def alert_table(rows: DataFrame) -> DataFrame:
    """Current state of every alert from the emitted rows."""
    emitted = rows.filter("emitted = 1")
    return emitted.groupBy("app_id", "correlation_key", "alert_no").agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.max("max_score").alias("score"))


def alert_stream(flows: DataFrame, path: str, horizon_ms: int = 60_000, policy: dict | None = None,
                 lateness: str = "0 seconds") -> DataFrame:
    """Flows to a table of alert rows (one folder per batch), and the alerts they add up to.

    The two stateful steps are two queries: the windows of the first are a table that the second
    reads as its stream, so each keeps its own state and either can restart alone.
    """
    spark = flows.sparkSession
    windows = sliding_windows_stream(flows, horizon_ms, lateness=lateness)
    stage = f"{path}/windows"
    q = windows.writeStream.outputMode("append").format("parquet").option("path", stage).option(
        "checkpointLocation", f"{path}/mark-windows").trigger(availableNow=True).start()
    q.awaitTermination()
    scored = spark.readStream.schema(windows.schema).parquet(stage)
    rows = _alert_fold(fold_stream, scored, policy)
    q = rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option(
        "checkpointLocation", f"{path}/mark-rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return alert_table(spark.read.schema(rows.schema).parquet(f"{path}/rows"))


def _alert_fold(engine, windows: DataFrame, policy: dict | None) -> DataFrame:
    p = {**ALERT_POLICY, **(policy or {})}
    w = evidence_strength(rule_score(windows)).withColumns({
        "app_family": app_family("app_id"), "source_model": F.lit("rule"), "top_features": top_features(rule_contributions(), 3)})
    w = w.withColumn("correlation_key", correlation_key()).select("flow_id", "app_id", *ALERT_INPUTS)
    return engine(w, ["app_id"], ["window_end_ms", "flow_id"], ALERT_INPUTS, ALERT_ADDED, dict,
                  lambda state, row: alert_step(state, row, **p))


def alert_batch(flows: DataFrame, horizon_ms: int = 60_000, policy: dict | None = None) -> DataFrame:
    return alert_table(_alert_fold(fold, sliding_windows(flows, horizon_ms, baseline=False), policy))


# ---- late data and load
def split_late(stream: DataFrame, on_time_path: str, late_path: str, lateness_ms: int, ms: str = "timestamp_end") -> None:
    """Rows older than the newest earlier batch minus the lateness go to their own table.

    Each batch stores the newest time up to it in a row of its own beside the on-time table, so a
    batch reads one row, and a restart goes on where it was.
    """
    spark = stream.sparkSession
    newest = f"{on_time_path.rstrip('/')}-newest"

    def handle(batch: DataFrame, number: int) -> None:
        limit = None
        if number:
            limit = spark.read.schema("newest bigint").parquet(f"{newest}/batch={number - 1}").first()[0]
        top = batch.agg(F.max(ms).cast("bigint").alias("newest"))
        if limit is not None:
            top = top.select(F.greatest("newest", F.lit(int(limit))).alias("newest"))
        top.write.mode("overwrite").parquet(f"{newest}/batch={number}")
        late = F.lit(False) if limit is None else F.col(ms) < int(limit) - lateness_ms
        batch.filter(~late).write.mode("overwrite").parquet(f"{on_time_path}/batch={number}")
        batch.filter(late).write.mode("overwrite").parquet(f"{late_path}/batch={number}")

    run_batches(stream, handle)


def dropped_by_watermark(query) -> int:
    """Rows the engine dropped as too late, from a query's progress reports."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def guard_sample(df: DataFrame, k: int, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Every k-th row in time order (per key if given): load shedding of the data path."""
    out = positions(df, keys or [], order or ["timestamp_end", "flow_id"], "_rn")
    return out.filter(F.col("_rn") % k == 0).drop("_rn")
