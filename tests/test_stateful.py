"""Detectors that remember, and batch / stream agreement."""

import numpy as np
from common import SF, rows
from pyspark.sql import functions as F

from netloom.catalog.evaluate import scored
from netloom.operators import sliding as sl
from netloom.operators import stateful as st
from netloom.sources.tables import flow_stream, flow_view
from netloom.streaming import flows as sf_

HOUR = 3_600_000


def ordered_rows(df, *more):
    return [r.asDict() for r in df.orderBy("app_id", "window_end_ms", "window_bucket").collect()]


def test_sequence_detector_against_a_loop(spark):
    df = scored(spark, SF).withColumn("bucket_state", st.bucket_state())
    got = {(r["app_id"], r["window_bucket"]): r["sequence_score"] for r in st.sequence_score(df.repartition(5)).collect()}
    seen = {}
    for r in ordered_rows(df):
        s = seen.setdefault(r["app_id"], {"n": 0, "last": None, "t": {}})
        last = s["last"]
        rarity = shift = 0.0
        if last is not None and s["n"] >= 8:
            out = s["t"].get(last["bucket_state"], {})
            rarity = 1 - (out.get(r["bucket_state"], 0) + 1) / (max(1, sum(out.values())) + len(out) + 1)
        zero = {c: 0.0 for c in ("destination_diversity", "novelty_score", "byte_rate", "packet_rate", "periodic_beacon_score")}
        p = last or zero
        if s["n"] >= 2:
            def rel(c):
                return min(1.0, abs(r[c] - p[c]) / max(abs(p[c]), 1.0))

            shift = min(1.0, .34 * abs(r["destination_diversity"] - p["destination_diversity"]) + .28 * abs(r["novelty_score"] - p["novelty_score"])
                        + .22 * rel("byte_rate") + .16 * rel("packet_rate"))
        score = min(1.0, .52 * rarity + .28 * shift + .12 * max(0, r["periodic_beacon_score"] - p["periodic_beacon_score"])
                    + .08 * max(0, r["novelty_score"] - p["novelty_score"]))
        assert abs(score - got[r["app_id"], r["window_bucket"]]) < 1e-9
        assert s["n"] <= 128
        if score < 0.9 or r["novelty_score"] < 0.95:
            if last is not None:
                t = s["t"].setdefault(last["bucket_state"], {})
                t[r["bucket_state"]] = t.get(r["bucket_state"], 0) + 1
                s["n"] += 1
            s["last"] = r


def test_multivariate_distance(spark):
    g, rng = st.Gaussian(), np.random.default_rng(3)
    data = rng.normal(size=(60, len(st.MULTI_FEATURES)))
    for x in data:
        g.update(x)
    mean, cov = data[0].copy(), np.diag([1e-3] * data.shape[1])
    for x in data[1:]:
        d = x - mean
        mean, cov = 0.92 * mean + 0.08 * x, 0.92 * cov + 0.08 * np.outer(d, d)
    assert np.allclose(mean, g.mean) and np.allclose(cov, g.cov)
    own = np.diag(cov)
    m = 0.82 * cov
    floor = np.maximum(own, 1e-3).mean() * 0.05 + 1e-3
    m[np.diag_indices_from(m)] = np.maximum(own, floor)
    c = data[5] - mean
    assert np.isclose(g.distance(data[5])[0], c @ np.linalg.inv(m) @ c)


def test_detectors_do_not_depend_on_partitioning(spark):
    df = scored(spark, SF)
    for run, col in ((st.statistical_score, "statistical_score"), (st.multivariate_score, "multivariate_score")):
        a = rows(run(df.coalesce(1)), "app_id", "window_bucket", col)
        b = rows(run(df.repartition(7)), "app_id", "window_bucket", col)
        assert a == b and any(r[2] > 0 for r in a)


def test_feedback_lowers_similar_windows(spark):
    df = scored(spark, SF)
    told = df.filter("app_id = 'com.whatsapp'").withColumn("feedback", F.lit("benign")).withColumn("window_end_ms", F.col("window_end_ms") - 1)
    plain = dict((r[0], r[1]) for r in rows(st.statistical_score(df).filter("app_id = 'com.whatsapp'"), "window_bucket", "statistical_score"))
    out = dict((r[0], r[1]) for r in rows(st.statistical_score_with_feedback(df, told).filter("app_id = 'com.whatsapp'"), "window_bucket", "statistical_score"))
    assert plain.keys() == out.keys() and sum(out.values()) <= sum(plain.values())


def arriving(spark, path, flows, files, seed):
    """The flows in any order over some files, and one flow long after all others."""
    slot = F.pmod(F.xxhash64(F.col("flow_id"), F.lit(seed)), F.lit(files))
    for n in range(files):
        flows.filter(slot == n).coalesce(1).write.mode("append").parquet(path)
    end = flows.agg(F.max("timestamp_end")).first()[0] + 400 * 24 * HOUR
    flows.limit(1).withColumns({"flow_id": F.lit(-1).cast("long"), "timestamp_end": F.lit(end)}).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_sliding_stream_equals_batch_in_any_order(spark, tmp_path):
    sf_.with_rocksdb(spark)
    flows = flow_view(spark, SF)
    cols = ["flow_id", "adaptive_window_seconds", "flow_count", "burstiness", "duration_jitter", "destination_concentration",
            "destination_transition_rate", "port_diversity", "tcp_window_mean", "periodic_beacon_score", "novelty_score", "label"]
    options = {"adaptive": True, "horizons_ms": [HOUR, 6 * HOUR, 24 * HOUR]}
    want = rows(sl.sliding_windows(flows, baseline=False, **options), *cols)
    for files, seed in ((1, 0), (5, 1)):
        stream = arriving(spark, str(tmp_path / f"in{files}"), flows, files, seed)
        assert rows(sf_.run_to_table(sf_.sliding_windows_stream(stream, lateness="60 days", **options)), *cols) == want


def test_late_flows_are_dropped_and_panes_go(spark, tmp_path):
    """A flow behind the watermark changes nothing; others come in the order of their time."""
    sf_.with_rocksdb(spark)
    base = flow_view(spark, SF).limit(1).drop("flow_id", "timestamp_end", "app_id")
    path, m = str(tmp_path / "in"), 60_000
    for part in ([(1, 10 * m), (2, 12 * m)], [(4, 200 * m), (3, 11 * m)], [(5, 201 * m)], [(6, 10 * m), (7, 500 * m)], [(8, 900 * m)]):
        base.crossJoin(spark.createDataFrame(part, "flow_id long, timestamp_end long")).withColumn("app_id", F.lit("a")).coalesce(1).write.mode(
            "append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = sf_.sliding_windows_stream(stream, 4 * m, lateness="1 minute")
    q = out.writeStream.format("memory").queryName("late_flows").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.table("late_flows"), "flow_id", "flow_count")
    # Each batch drops what is behind the watermark of the one before: 3 comes in time, 6 does not.
    assert got == [(1, 1), (2, 3), (3, 2), (4, 1), (5, 2), (7, 1)]
    assert sf_.dropped_by_watermark(q) == 1
    states = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert states[-1] <= 6


def test_alert_stream_equals_batch(spark):
    from netloom.catalog.streaming import padded

    sf_.with_rocksdb(spark)
    policy = {"threshold": 0.3, "window_ms": 6 * HOUR, "merge_ms": 12 * HOUR}
    a = rows(sf_.alert_stream(padded(spark, SF), sf_.new_path(spark, "alerts"), 6 * HOUR, policy, lateness="30 days"))
    b = rows(sf_.alert_batch(flow_view(spark, SF), 6 * HOUR, policy))
    assert a == b and len(a) > 5


def test_state_carries_over_micro_batches(spark, tmp_path):
    """Two files, one per batch: the second continues where the first stopped."""
    sf_.with_rocksdb(spark)
    df = scored(spark, SF).select("app_id", "window_end_ms", "window_bucket", "bucket_state" if False else "novelty_score",
                                  "destination_diversity", "byte_rate", "packet_rate", "periodic_beacon_score", "flow_count",
                                  "protocol_diversity", "port_diversity", "high_port_ratio")
    cut = df.approxQuantile("window_end_ms", [0.5], 0.0)[0]
    path = str(tmp_path / "in")
    df.filter(F.col("window_end_ms") <= cut).coalesce(1).write.mode("append").parquet(path)
    df.filter(F.col("window_end_ms") > cut).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = rows(sf_.run_to_table(st.sequence_score_stream(stream)), "app_id", "window_bucket", "sequence_score")
    assert got == rows(st.sequence_score(df), "app_id", "window_bucket", "sequence_score")


def test_late_rows_are_set_aside(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in ([(1, 10_000_000)], [(2, 10_500_000), (3, 1_000)]):
        spark.createDataFrame(part, "flow_id long, timestamp_end long").coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema("flow_id long, timestamp_end long").option("maxFilesPerTrigger", 1).parquet(path)
    good, late = sf_.new_path(spark, "good"), sf_.new_path(spark, "late")
    sf_.split_late(s, good, late, 60_000)
    assert rows(spark.read.parquet(late), "flow_id") == [(3,)]


def test_upsert_batches_keep_the_newest(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "alert_id string, severity string, updated_epoch long, created_epoch long"
    for part in ([("a", "LOW", 1, 1), ("b", "LOW", 1, 1)], [("a", "HIGH", 5, 5)], [("c", "LOW", 6, 6), ("b", "LOW", 0, 0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = sf_.new_path(spark, "table")
    out = sf_.upsert_batches(s, table, "alert_id")
    assert rows(out) == [("a", "HIGH", 5, 1), ("b", "LOW", 1, 0), ("c", "LOW", 6, 6)]
    # The second batch wrote the bucket of its one key and no other.
    assert rows(spark.read.parquet(f"{table}/v=1"), "alert_id") == [("a",)]


def test_model_documents_reproduce_their_models(spark):
    from netloom.catalog.models import FEATURES
    from netloom.operators import models as mo
    from netloom.operators import scoring as sc

    s = scored(spark, SF).drop("score")
    for doc in (mo.train_linear(s, FEATURES), mo.train_forest(s, FEATURES, trees=4, depth=4), mo.train_boosted(s, FEATURES, rounds=3, depth=3)):
        out = sc.score_document(s, doc, "score").agg(F.avg("score"), F.avg(F.col("label").cast("double"))).first()
        assert abs(out[0] - out[1]) < 0.15
