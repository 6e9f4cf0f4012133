"""Hot keys: the segmented plans give what the plain windows give."""

from common import SF, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.operators import assemble as asm
from netloom.operators import evaluate as ev
from netloom.operators import privacy as pv
from netloom.operators import sequences as sq
from netloom.operators import sliding as sl
from netloom.operators import splits as sp
from netloom.operators import stateful as st
from netloom.operators import windows as win
from netloom.plans import ordered as od
from netloom.sources.tables import flow_view


def skewed(spark, n=400):
    """One key holds most rows, and equal times occur."""
    i = F.col("id")
    return spark.range(n).select(
        i, F.when(i % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), (i % 5).cast("string"))).alias("key"),
        F.expr("id div 3").alias("ts"), ((i * 37) % 101).cast("double").alias("v"),
        F.when(i % 4 == 0, i.cast("string")).alias("note"))


def both(spark, make, *cols):
    plain = rows(make(), *cols)
    spark.conf.set(od.SEGMENT_SETTING, "7")
    try:
        return plain, rows(make(), *cols)
    finally:
        spark.conf.unset(od.SEGMENT_SETTING)


def test_running_and_positions(spark):
    df = skewed(spark)
    for how in ("sum", "min", "max"):
        a, b = both(spark, lambda: od.running(df, ["key"], ["ts", "id"], {"r": F.col("v")}, how=how), "id", "r")
        assert a == b
    a, b = both(spark, lambda: od.positions(df, [], [F.desc("v"), "id"]), "id", "rn")
    assert a == b and len(a) == 400


def test_carry_last(spark):
    df = skewed(spark)
    for inclusive in (False, True):
        a, b = both(spark, lambda: od.carry_last(df, ["key"], ["ts", "id"], {"seen": F.col("note")}, inclusive), "id", "seen")
        assert a == b


def test_bounded_frames(spark):
    df = skewed(spark)
    for reach in (1, 5, 20):
        def build(part, keys, reach=reach):
            w = od.window(keys, ["ts", "id"]).rowsBetween(-reach, -1)
            return part.withColumn("m", F.avg("v").over(w))

        a, b = both(spark, lambda: od.bounded(df, ["key"], ["ts", "id"], reach, build), "id", "m")
        assert a == b


def test_quantiles(spark):
    df = skewed(spark)
    a, b = both(spark, lambda: od.exact_quantiles(df, ["key"], "v", {"q": 0.25, "r": 0.9}), "key", "q", "r")
    assert a == b


def test_trailing_against_brute_force(spark):
    df = skewed(spark, 150)
    got = {r["id"]: r for r in od.trailing(df, ["key"], "ts", "id", 6, sums={"n": F.lit(1)}, firsts={"f": F.col("v")},
                                           maxes={"m": F.col("v")}).collect()}
    data = sorted(df.collect(), key=lambda r: (r["ts"], r["id"]))
    for i, r in enumerate(data):
        seen = [x for x in data[:i + 1] if x["key"] == r["key"] and x["ts"] >= r["ts"] - 6]
        g = got[r["id"]]
        assert (g["n"], g["f"], g["m"]) == (len(seen), seen[0]["v"], max(x["v"] for x in seen))
    a, b = both(spark, lambda: od.trailing(df, ["key"], "ts", "id", 6, sums={"n": F.lit(1)}, firsts={"f": F.col("v")},
                                           maxes={"m": F.col("v")}), "id", "n", "f", "m")
    assert a == b


def test_windows(spark):
    flows = flow_view(spark, SF)
    cols = ["app_id", "window_bucket", "flow_count", "burstiness", "duration_jitter", "periodic_beacon_score",
            "destination_concentration", "destination_transition_rate", "destination_transition_entropy", "flow_size_iqr",
            "destination_diversity", "dataset_source", "consecutive_burst_windows", "flow_count_trend"]
    a, b = both(spark, lambda: win.feature_windows(flows, 86_400_000), *cols)
    assert a == b and len(a) > 50


def test_row_limit_and_ties_against_brute_force(spark):
    flows = flow_view(spark, SF).withColumn("timestamp_end", F.expr("timestamp_end div 3600000 * 3600000"))
    got = {r["flow_id"]: r["flow_count"] for r in sl.sliding_windows(flows, 7_200_000, row_limit=4, baseline=False).collect()}
    data = sorted(flows.select("flow_id", "app_id", "timestamp_end").collect(), key=lambda r: (r[2], r[0]))
    for i, r in enumerate(data):
        own = [x for x in data[:i + 1] if x["app_id"] == r["app_id"]][-4:]
        assert got[r["flow_id"]] == sum(x["timestamp_end"] >= r["timestamp_end"] - 7_200_000 for x in own)


def busy_flows(spark, n=12_000):
    """One application with about 5,000 flows in a horizon of 5,000 ms, and a quiet one."""
    i = F.col("id")
    return flow_view(spark, SF).limit(1).drop("flow_id", "timestamp_end", "app_id", "bytes_out", "duration_ms", "destination_key", "dst_port").crossJoin(
        spark.range(n).select(
            i.alias("flow_id"), (F.lit(1_700_000_000_000) + i - i % 3).alias("timestamp_end"),
            F.when(i % 400 == 7, "quiet").otherwise("busy").alias("app_id"),
            F.when(i % 997 == 0, 10**9).otherwise(i * i % 1013).cast("long").alias("bytes_out"), (i * 37 % 4001).alias("duration_ms"),
            F.concat(F.lit("d"), (i * i % 211).cast("string")).alias("destination_key"), (i % 17).alias("dst_port")))


def test_a_horizon_of_thousands_of_flows_against_numpy(spark):
    import numpy as np

    flows = busy_flows(spark)
    one = rows(sl.sliding_windows(flows.coalesce(1), 5_000, baseline=False), "flow_id", "flow_count", "burstiness", "duration_jitter",
               "destination_diversity", "port_diversity", "destination_concentration", "destination_transition_rate",
               "periodic_beacon_score")
    got = {r[0]: r[1:] for r in one}
    assert len(got) == 12_000
    data = flows.select("flow_id", "app_id", "timestamp_end", "bytes_out", "bytes_in", "duration_ms", "destination_key", "dst_port").toPandas()
    for app, own in data.sort_values(["timestamp_end", "flow_id"]).groupby("app_id"):
        t, size = own["timestamp_end"].to_numpy(), (own["bytes_out"] + own["bytes_in"]).to_numpy(float)
        for j in range(0, len(own), 1 if app == "quiet" else 331):
            low = np.searchsorted(t, t[j] - 5_000)
            w = slice(low, j + 1)
            n, x, d = j + 1 - low, size[w], own["destination_key"].to_numpy()[w]
            gaps = np.diff(t[w]) / 1000.0
            beacon = min(1, max(0, 1 - gaps.std() / gaps.mean())) if n >= 4 and gaps.mean() > 0 else 0.0
            want = (n, min(4, np.abs(x - x.mean()).mean() / x.mean()), own["duration_ms"].to_numpy()[w].std() if n > 1 else 0.0,
                    len(set(d)) / n, len(set(own["dst_port"].to_numpy()[w])) / n, max(np.unique(d, return_counts=True)[1]) / n,
                    (d[1:] != d[:-1]).sum() / max(1, n - 1), beacon)
            assert np.allclose(got[own["flow_id"].to_numpy()[j]], want, atol=2e-6), (app, j)
    assert max(g[0] for g in got.values()) > 4_900


def test_sliding_does_not_depend_on_partitions_or_batches(spark):
    flows = busy_flows(spark, 3_000)
    cols = ["flow_id", "adaptive_window_seconds", "flow_count", "burstiness", "destination_concentration", "flow_count_deviation", "consecutive_burst_windows"]
    make = lambda: sl.adaptive_windows(flows.repartition(5), horizons_ms=[200, 500, 1_500], emit_all_horizons=True)
    first = rows(make(), *cols)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert first == rows(make(), *cols) and len(first) == 9_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_history_over_panes_against_a_plain_window(spark):
    from netloom.plans.panes import with_history

    df = skewed(spark).withColumn("ts", F.col("ts") * (1 + F.col("id") % 2) + F.expr("id div 90") * 70)
    for reach in (1, 3, 6):
        def build(part, keys, reach=reach):
            return part.withColumn("m", F.sum("v").over(od.window(keys, ["ts", "id"]).rowsBetween(-reach, -1)))

        want = rows(build(df, ["key"]), "id", "m")
        assert all(rows(with_history(df, ["key"], "ts", ["ts", "id"], reach, pane, build), "id", "m") == want for pane in (1, 7, 10_000))


def test_ranks_curves_sequences_and_samples(spark):
    df = skewed(spark).withColumns({"label": (F.col("id") % 2).cast("int"), "score": F.col("v") / 101.0})
    for by in (None, ["key"]):
        a, b = both(spark, lambda: pv.rank_levels(df, {"q": F.col("v")}, 5, by), "id", "q")
        assert a == b
    a, b = both(spark, lambda: ev.roc_auc(df, ["key"]), "key", "roc_auc")
    assert a == b
    flows = flow_view(spark, SF)
    a, b = both(spark, lambda: sq.flow_sequences(flows, 8, 4, 6), "sequence_id", "s03_log_total_bytes")
    assert a == b
    a, b = both(spark, lambda: sp.sample_by_source(flows, 101, id_col="flow_id"), "flow_id")
    assert a == b and len(a) == 101
    a, b = both(spark, lambda: st.beacon_score(flows), "flow_id", "beacon_score")
    assert a == b


def test_rank_levels_of_many_columns_against_pandas(spark):
    import math

    df = skewed(spark, 500).withColumns({
        "key": F.when(F.col("id") % 41 == 0, None).otherwise(F.col("key")), "one": F.lit(3.0),
        "u": F.when(F.col("id") % 7 == 0, None).otherwise(-F.col("v") / 3)})
    for by, buckets, ids in ((None, 5, False), (["key"], 4, False), (["key"], 1000, True)):
        parts = {"a": F.col("v"), "b": F.col("u"), "c": F.col("one")}
        got = rows(pv.rank_levels(df.coalesce(1), parts, buckets, by, ids), "id", *parts)
        assert got == rows(pv.rank_levels(df.repartition(64), parts, buckets, by, ids), "id", *parts)
        plain = df.toPandas()
        plain["key"] = plain["key"].fillna("")
        for i, (name, column) in enumerate({"a": "v", "b": "u", "c": "one"}.items()):
            v = plain[column].fillna(0.0)
            groups = plain["key"] if by else v * 0
            rank = v.groupby(groups).rank(pct=True)
            kinds = v.groupby(groups).transform("nunique")
            for j, r, k in zip(plain["id"], rank, kinds):
                level = math.floor(min(r, 0.999999) * buckets) if k > 1 else 0
                have = dict((x[0], x[1 + i]) for x in got) if j == plain["id"][0] else have
                assert abs(have[j] - (level if ids else level / (buckets - 1))) < 1e-5, (by, name, j)
    assert pv.rank_levels(df.limit(0), {"a": F.col("v")}, 5).count() == 0


def test_hash_positions_and_splits_read_the_rows_once(spark):
    from netloom.functions.scalars import rank_by_hash

    df = skewed(spark, 500).withColumn("key", F.when(F.col("id") % 41 == 0, None).otherwise(F.col("key")))
    for keys in ([], ["key"]):
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(rank_by_hash(7, "id"), "id")))
        for parts in (1, 64):
            placed, jobs = jobs_of(spark, lambda: od.hash_positions(df.repartition(parts), keys, 7, ["id"], "rn"))
            assert jobs == 0 and rows(placed, "id", "rn") == rows(want, "id", "rn")
    base = df.select("id", (F.col("id") % 2).cast("int").alias("label"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("dataset_source"),
                     F.lit("e").alias("environment_id"), F.concat(F.lit("x"), (F.col("id") % 20).cast("string")).alias("session_id"),
                     F.lit("app").alias("app_id"), (F.col("id") * 60_000).alias("window_end_ms"))
    counts = [jobs_of(spark, lambda t=t, b=b: sp.group_split(b, tries=t))[1] for t, b in (
        (1, base), (6, base), (6, base.withColumn("label", F.when(F.col("session_id") == "x1", 1).otherwise(0))))]
    assert max(counts) - min(counts) <= 2, counts  # adaptive plans run each stage as a job, give or take one


def test_flow_cut_of_long_runs_against_a_loop(spark):
    """A key that is never silent, with thousands of flows in one run; a null application; equal times; quiet keys."""
    i = F.col("id")
    base = spark.range(9_000).select(
        i.alias("packet_id"), F.when(i % 90 == 1, None).when(i % 30 == 2, "quiet").otherwise("busy").alias("app_id"), F.lit("TCP").alias("protocol"),
        F.when(i % 30 == 2, F.concat(F.lit("k"), (i % 7).cast("string"))).otherwise("k").alias("flow_key"),
        (F.lit(1_000) + i * 3 + F.when(i % 5 == 0, 0).otherwise(i * i % 17) + F.when(i > 6_000, 200).otherwise(0)).alias("ts_ms"))
    for idle, life in ((30, 20), (15, 100), (2_000, 1_000), (300, 40_000)):
        cut = asm.cut_flows(base, idle, life)
        assert "Python" not in cut._jdf.queryExecution().executedPlan().toString()
        want, state = {}, {}
        for r in sorted(base.collect(), key=lambda r: (r["ts_ms"], r["packet_id"])):
            key, t = (r["app_id"], r["flow_key"]), r["ts_ms"]
            start, last, n = state.get(key, (None, None, 0))
            if n == 0 or t >= start + life or t >= last + idle:
                start, n = t, n + 1
            state[key] = (start, t, n)
            want.setdefault((*key, n), []).append(r["packet_id"])
        got = {}
        for r in cut.select("app_id", "flow_key", "flow_no", "packet_id").collect():
            got.setdefault((r["app_id"], r["flow_key"], r["flow_no"]), []).append(r["packet_id"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())), (idle, life)
    assert asm.cut_flows(base.limit(0)).count() == 0


def test_gap_groups_survive_hot_keys(spark):
    df = skewed(spark).withColumn("ts", F.col("ts") + F.expr("id div 50") * 40)
    a, b = both(spark, lambda: ev.gap_groups(df, ["key"], "ts", "id", 10, "g"), "id", "g")
    assert a == b and max(r[1] for r in a) > 3


def jobs_of(spark, build):
    """(result, number of Spark jobs that building it ran)."""
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "build")
    try:
        return build(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_tumbling_windows_have_one_plan_and_no_job_before_the_action(spark):
    import math
    from collections import Counter

    import numpy as np

    flows = busy_flows(spark, 3_000).withColumns({
        "app_id": F.when(F.col("flow_id") % 50 == 3, None).otherwise(F.col("app_id")),
        "bytes_out": F.when(F.col("flow_id") % 11 == 0, -5).otherwise(F.col("bytes_out")),
        "dst_port": F.when(F.col("flow_id") % 13 == 0, None).otherwise(F.col("dst_port"))})
    names = ["app_id", "window_bucket", "flow_count", "burstiness", "flow_size_iqr", "destination_diversity", "destination_concentration",
             "destination_transition_rate", "destination_transition_entropy", "periodic_beacon_score", "port_diversity"]
    out, jobs = jobs_of(spark, lambda: win.raw_windows(flows, 1_000))
    assert jobs == 0
    one = rows(win.raw_windows(flows.coalesce(1), 1_000), *names)
    assert one == rows(win.raw_windows(flows.repartition(64), 1_000), *names) == rows(out, *names)
    prepared = win.bucketed(flows, 1_000).select(
        "app_id", "window_bucket", "timestamp_end", "flow_id", "total_bytes", "destination_key", "dst_port").toPandas()
    got = {(r[0], r[1]): r[2:] for r in one}
    groups = prepared.sort_values(["timestamp_end", "flow_id"]).groupby(["app_id", "window_bucket"], dropna=False)
    assert len(groups) == len(got) and sum(k[0] is None for k in got) > 1
    for (app, bucket), own in groups:
        x, d, t = own["total_bytes"].to_numpy(float), list(own["destination_key"]), own["timestamp_end"].to_numpy()
        n, moves = len(x), list(zip(d, d[1:]))
        gaps, counts = np.diff(t), Counter(moves)
        beacon = min(1, max(0, 1 - gaps.std() / gaps.mean())) if n >= 4 and gaps.mean() > 0 else 0.0
        entropy = -sum(c / len(moves) * math.log(c / len(moves)) for c in counts.values()) / math.log(len(counts)) if len(counts) > 1 else 0.0
        want = (n, min(4, np.abs(x - x.mean()).mean() / x.mean()), np.quantile(x, 0.75) - np.quantile(x, 0.25), len(set(d)) / n,
                max(Counter(d).values()) / n, sum(a != b for a, b in moves) / max(1, n - 1), entropy, beacon, own["dst_port"].nunique() / n)
        assert np.allclose(got[app if isinstance(app, str) else None, bucket], want, atol=2e-6), (app, bucket)
    assert win.raw_windows(flows.limit(0), 1_000).count() == 0


def test_group_limit_in_topk(spark):
    df = skewed(spark)
    plan = od.first_rows(df, ["key"], [F.desc("v"), "id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert Window is not None
