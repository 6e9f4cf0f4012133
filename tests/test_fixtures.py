"""Small cases with known answers."""

import json

import pytest
from common import rows
from pyspark.sql import functions as F

from netloom.functions import constants as K
from netloom.operators import alerts as al
from netloom.operators import assemble as asm
from netloom.operators import evaluate as ev
from netloom.operators import intel, metadata, normalize, privacy, scoring, splits, stateful, store
from netloom.operators import sequences as sq
from netloom.operators import windows as win
from netloom.sources import readers


def flows(spark, data):
    return spark.createDataFrame(data, "flow_id long, app_id string, timestamp_end long, bytes_out long, bytes_in long, "
                                       "packets_out long, packets_in long, dst_novelty double, label int")


def test_minimal_window(spark):
    f = flows(spark, [(1, "com.test", 1000, 10, 20, 1, 1, 1.0, 0), (2, "com.test", 2000, 15, 25, 1, 1, 0.0, 1)])
    w = win.feature_windows(f, 60_000).collect()
    assert len(w) == 1
    w = w[0]
    assert (w["flow_count"], w["label"], w["total_bytes_out"], w["total_bytes_in"]) == (2, 1, 25.0, 45.0)
    assert w["destination_diversity"] == 0.5 and w["novelty_score"] == 0.5


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="missing columns"):
        win.feature_windows(spark.range(1).withColumnRenamed("id", "flow_id"), 60_000)
    with pytest.raises(ValueError, match="missing feature columns"):
        win.feature_matrix(spark.range(1), ["flow_count"])
    with pytest.raises(ValueError, match="contract"):
        win.check_contract(list(reversed(K.FEATURES)))
    win.check_contract(K.FEATURES)
    assert len(K.FEATURES) == 64 and len(win.BACKEND_FEATURES) == 69


def packets(spark, data):
    cols = ("packet_id long, ts_ms long, bytes long, outbound boolean, payload_bytes int, hop_limit int, tcp_window int, "
            "ack boolean, psh boolean, src_ip string, dst_ip string, host_hint string")
    p = spark.createDataFrame(data, cols)
    return p.withColumns({
        "app_id": F.lit("app"), "protocol": F.lit("TCP"), "src_port": F.lit(5000), "dst_port": F.lit(443),
        **{c: F.lit(False) for c in ("fragmented", "syn", "rst", "fin")}})


def test_single_packet_flow(spark):
    f = asm.assemble_flows(packets(spark, [
        (1, 1000, 160, True, 120, 64, 4096, True, True, "10.0.0.2", "1.1.1.1", "site.example"),
        (2, 1020, 60, True, 0, 64, 4096, True, False, "10.0.0.2", "2.2.2.2", None)]), idle_ms=1, max_ms=20_000)
    one = f.filter("remote_ip = '1.1.1.1'").first()
    assert (one["dst_novelty"], one["ack_rate_total"], one["psh_rate_total"], one["tcp_window_mean"], one["payload_mean"],
            one["ttl_metrics_present"], one["transport_metrics_present"]) == (1.0, 1.0, 1.0, 4096.0, 120.0, 1.0, 1.0)
    assert one["site_hint"] == "site.example"


def test_cut_at_maximum_life(spark):
    data = [(i, t, 10, True, 0, 64, 1, True, False, "10.0.0.2", "1.1.1.1", None) for i, t in enumerate([0, 25, 30, 44, 45, 46])]
    f = asm.assemble_flows(packets(spark, data), idle_ms=1000, max_ms=20)
    assert rows(f, "timestamp_start", "timestamp_end", "packets_out") == [(0, 0, 1), (25, 44, 3), (45, 46, 2)]


def test_severity_gate(spark):
    def run(seq):
        df = spark.createDataFrame([("a", i, s) for i, s in enumerate(seq)], "app_id string, t int, severity string")
        out = stateful.stabilize(df, 3, ["t"]).orderBy("t").collect()
        return [r["stable_severity"][0] for r in out]

    assert run(["HIGH"] * 3) == ["M", "M", "H"]
    assert run(["HIGH", "LOW", "HIGH"]) == ["M", "L", "M"]
    assert run(["HIGH", "HIGH", "MEDIUM", "HIGH", "HIGH"]) == ["M", "M", "M", "M", "H"]
    assert run(["MEDIUM", "HIGH", "HIGH", "HIGH"]) == ["M", "M", "M", "H"]


def test_budget_downgrade(spark):
    df = spark.createDataFrame([(1, "a", 10, "HIGH", "FALSE_POSITIVE"), (2, "a", 20, "HIGH", "OPEN"), (3, "a", 90_000_000, "HIGH", "OPEN")],
                               "alert_id long, app_id string, timestamp long, severity string, triage_status string")
    out = {r["alert_id"]: r for r in al.fp_budget(df, 1).collect()}
    assert out[2]["budgeted_severity"] == "MEDIUM" and out[2]["budget_reason"] == "false_positive_budget_exceeded:1/1"
    assert out[3]["budgeted_severity"] == "HIGH" and out[3]["budget_reason"] is None


def test_rule_score_order(spark):
    df = spark.createDataFrame([(0.1, 10.0, 0.5, 0.1, 100.0, 200.0), (0.9, 400.0, 0.95, 15.0, 9000.0, 10.0)],
                               "novelty_score double, burstiness double, outbound_ratio double, connection_frequency_delta double, "
                               "total_bytes_out double, total_bytes_in double")
    a, b = [r["score"] for r in scoring.rule_score(df).collect()]
    assert 0 <= a < b <= 1


def test_calibration_and_what_if(spark):
    df = spark.createDataFrame([(a, i / 15) for a in "ab" for i in range(15)], "app_id string, score double")
    t = {r["app_id"]: r for r in ev.calibrate_thresholds(df).collect()}
    assert t["a"]["high"] >= t["a"]["medium"] and None in t
    scored = spark.createDataFrame([("a", .2), ("a", .7), ("a", .92), ("b", .58), ("b", .88)], "app_id string, score double")
    over = spark.createDataFrame([("b", .5, .8)], "app_id string, medium double, high double")
    totals = store.policy_what_if_windows(scored, over, {"medium": .6, "high": .85})[0].first()
    assert (totals["rows_evaluated"], totals["LOW"], totals["MEDIUM"], totals["HIGH"]) == (5, 1, 2, 2)


def test_drift_detects_a_level_shift(spark):
    df = spark.createDataFrame([("a", i, (0.9 if i >= 80 else 0.2) + (i % 5) / 100) for i in range(120)],
                               "app_id string, window_end_ms long, score double")
    series = ev.drift_series(df, features=["score"])
    report = {r["app_id"]: r for r in ev.drift_report(series).collect()}
    assert report["a"]["rows"] == 120 and report[None]["apps"] in (0, 1) and report["a"]["high_drift_rows"] > 0
    assert series.filter("window_end_ms < 12").agg(F.max("drift_score")).first()[0] == 0.0


def test_lookalikes(spark):
    df = spark.createDataFrame([("g00gle.com", 443, None), (None, 443, "examp1ebank-login.com")], "site_hint string, dst_port int, tls_sni string")
    one = intel.analyze_destinations(df.filter("site_hint is not null")).first()
    assert one["brand_match"] == "google" and one["lookalike_score"] == 1.0 and "T1566" in one["mitre_techniques"]
    two = intel.analyze_destinations(df.filter("site_hint is null"), F.array(F.lit("examplebank"))).first()
    assert two["brand_match"] == "examplebank" and two["lookalike_score"] >= 0.55
    brands = spark.createDataFrame([("Acme\n\n acme \nZed",), ("",)], "csv string").select(intel.parse_brands("csv").alias("b")).collect()
    assert brands[0]["b"] == ["acme", "zed"] and brands[1]["b"][0] == "google"
    host = spark.createDataFrame([("WWW.bücher.example.",)], "h string").select(intel.normalize_host("h", idna=True)).first()[0]
    assert host == "xn--bcher-kva.example"


def test_sequence_fixture(spark):
    data, i = [], 0
    for app in range(4):
        for session in range(2):
            for step in range(18):
                data.append((i, f"app{app}", 1_700_000_000_000 + step * 11_000, 100 + step, 50, 1, 1, 0.0, 0, f"s{session}"))
                i += 1
    f = spark.createDataFrame(data, "flow_id long, app_id string, timestamp_end long, bytes_out long, bytes_in long, packets_out long, "
                                    "packets_in long, dst_novelty double, label int, session_id string").withColumns({
        "dataset_source": F.lit("src"), "environment_id": F.lit("env"), "protocol": F.lit("TCP"), "dst_port": F.lit(443), "duration_ms": F.lit(5)})
    s = sq.flow_sequences(f, 8, 4, 6)
    assert s.count() == 32
    assert sq.flow_sequences(f, 8, 4, 6, cap=2).count() == 16


def test_public_adapter(spark):
    df = spark.createDataFrame([(10.0, 3, 4, 100, 200, 443, "6", "Benign", "/d/Benign/a.csv")],
                               "`Flow End Time` double, `Total Fwd Packets` int, `Total Backward Packets` int, `Total Length of Fwd Packets` int, "
                               "`Total Length of Bwd Packets` int, `Destination Port` int, Protocol string, Label string, source_path string")
    r = normalize.adapt_public(df, "set").first()
    assert (r["label"], r["bytes_out"], r["bytes_in"], r["dataset_source"]) == (0, 100.0, 200.0, "set")
    assert r["timestamp_end"] == (10 + 1_700_000_000) * 1000


def test_privacy_views_hide_what_they_must(spark):
    data = [(i, "com.browser.alpha", 1_700_000_000_000 + i * 61_000, 100 * i, 50, 2, 1, float(i % 2), i % 2) for i in range(6)]
    views = privacy.privacy_views(win.feature_windows(flows(spark, data), 60_000))
    for name, v in views.items():
        assert set(K.PROVENANCE) <= set(v.columns)
        if name in ("medium", "strict"):
            for word in ("novelty", "diversity", "beacon", "high_port", "concentration", "entropy"):
                assert not [c for c in v.columns if word in c]
    assert views["strict"].count() == 6


def test_retraining_and_feedback(spark, tmp_path):
    p = tmp_path / "samples.json"
    p.write_text(json.dumps({"samples": [
        {"alert_id": "a", "app_id": "x", "anomaly_score": 0.9, "triage_status": "RESOLVED", "timestamp": 5},
        {"alert_id": "a", "app_id": "x", "anomaly_score": 0.1, "triage_status": "RESOLVED", "timestamp": 2},
        {"alert_id": "b", "app_id": "y", "anomaly_score": 0.2, "triage_status": "FALSE_POSITIVE", "timestamp": 3},
        {"alert_id": "c", "app_id": "y", "anomaly_score": 0.2, "triage_status": "OPEN", "timestamp": 3}]}))
    out = metadata.retraining_set(readers.read_records(spark, str(p)))
    assert rows(out, "alert_id", "label", "anomaly_score") == [("a", 1, 0.9), ("b", 0, 0.2)]
    assert metadata.retraining_report(out, 1).first()["sufficient_per_class"] == 1
    alerts = spark.createDataFrame([("1", "x", "FALSE_POSITIVE", 1), ("2", "x", "RESOLVED", 2), ("3", "x", "OPEN", 3)],
                                   "id string, app_id string, triage_status string, timestamp long")
    assert rows(metadata.feedback_to_rows(alerts), "session_id", "label") == [("1", 0), ("2", 1)]


def test_tolerant_scan(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_bytes(b"app_id,bytes_out\na,1\nb\xff,2\nc,3,4,5\n")
    out = readers.read_flows(spark, str(p))
    assert out.count() == 3
    with pytest.raises(ValueError):
        readers.read_flows(spark, str(p), "xlsx")


def test_sampling_keeps_positives(spark):
    df = spark.range(55).select(F.col("id"), (F.col("id") < 5).cast("int").alias("label"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("dataset_source"))
    out = splits.cap_windows(df, benign=10)
    assert out.filter("label = 1").count() == 5 and out.filter("label = 0").count() == 10
    assert splits.cap_windows(df, benign=10, total=12).count() == 12


def test_split_properties(spark):
    df = spark.range(600).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("label"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("dataset_source"),
        F.lit("e").alias("environment_id"), F.concat(F.lit("x"), (F.col("id") % 20).cast("string")).alias("session_id"), F.lit("app").alias("app_id"),
        (F.col("id") * 60_000).alias("window_end_ms"))
    out, used = splits.group_split(df)
    sides = out.groupBy("dataset_source", "session_id").agg(F.countDistinct("split").alias("n"))
    assert used in splits.STRATEGIES and sides.agg(F.max("n")).first()[0] == 1
    lonely = df.withColumns({c: F.lit("one") for c in ("dataset_source", "session_id")}).withColumn("window_end_ms", F.lit(0))
    assert splits.group_split(lonely)[1] == "stratified_random_fallback"
    held = sq.class_holdout(df, "dataset_source", ["session_id"])
    per = held.groupBy("dataset_source").pivot("split", ["train", "test"]).count().collect()
    assert all(r["train"] >= 1 and r["test"] >= 1 for r in per)


def test_incidents_and_quality(spark):
    df = spark.createDataFrame([("1", "d1", "a", "LOW", "corr-key-1", 5, 5, '["zero_bytes_flow"]'), ("2", "d2", "b", "HIGH", "corr-key-1", 9, 9, '["zero_bytes_flow"]')],
                               "alert_id string, device_id string, app_id string, severity string, correlation_key string, last_seen_epoch long, updated_epoch long, warnings string")
    one = store.incidents(df).collect()
    assert len(one) == 1 and one[0]["alert_count"] == 2 and one[0]["max_severity"] == "HIGH"
    assert store.quality_summary(df).first()["count"] == 2


def test_rejections(spark):
    df = spark.createDataFrame([("mobile_flow", "1.1", "device-00", "a", "tcp", 1, 2, "x" * 64, 1, 1, 1, 10, 5)],
                               "event_type string, event_version string, device_id_pseudo string, app_id string, protocol string, src_port int, dst_port int, "
                               "dst_host_hash string, bytes_out long, bytes_in long, duration_ms long, timestamp_start long, timestamp_end long")
    good, bad = store.validate_events(df)
    assert good.count() == 0 and bad.first()["reasons"] == ["timestamp_order"]


def test_aliases_per_profile(spark):
    for profile in normalize.PROFILE_EXTRA:
        names = normalize.profile_aliases(profile)
        for key, aliases in names.items():
            df = spark.createDataFrame([("1",)], f"`{aliases[-1]}` string")
            assert normalize.resolve_aliases(df, profile)[1][key] == aliases[-1] or key in ("timestamp_end", "label", "app_id")


def test_flow_before_the_horizon_leaves_the_window_alone(spark):
    from netloom.operators import sliding

    month, start = 30 * 86_400_000, 1_700_000_000_000
    data, at = [], start
    for i in range(60):
        data.append((i, "com.test", at, 10, 20, 1, 1, 1.0, 0))
        at += 5 if i % 2 else 15
    old = (1000, "com.test", start - month, 10, 20, 1, 1, 1.0, 0)
    cols = ("periodic_beacon_score", "duration_jitter", "flow_count")
    found = []
    for rows_ in (data, [*data, old]):
        out = sliding.sliding_windows(flows(spark, rows_), 60_000, baseline=False).filter("flow_id = 59")
        found.append(rows(out, *cols))
    assert found[0] == found[1] and 0.49 < found[0][0][0] < 0.52


def test_trees_of_any_depth_and_cycles():
    import numpy as np

    n = 100
    chain = {"feature": [0] * n + [-1], "threshold": [-1.0] * n + [0.0], "value": [0.0] * n + [7.0],
             "left": [n] * n + [-1], "right": [*range(1, n + 1), -1]}
    assert scoring.walk_trees(np.zeros((2, 1)), [chain]).tolist() == [[7.0, 7.0]]
    with pytest.raises(ValueError, match="cycle"):
        scoring.walk_trees(np.zeros((1, 1)), [{**chain, "right": [0] * n + [-1]}])
