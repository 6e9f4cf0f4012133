"""Running compositions against the loops they replace."""

import math
import random

import pytest

from netloom.operators import stateful as st
from netloom.plans import scan as scans

DEFAULTS = {"low": 0.35, "medium": 0.6, "high": 0.85}


def looped(statuses, start):
    out, state = [], start
    for s in statuses:
        state = st.threshold_step(state, s)
        out.append(state)
    return out


@pytest.mark.parametrize("passes", [1, 10])
@pytest.mark.parametrize("start", [(0.35, 0.6, 0.85), (0.93, 0.2, 1.4), (-0.1, 0.0, 0.1)])
def test_thresholds_against_the_loop(spark, monkeypatch, passes, start):
    monkeypatch.setattr(scans, "PASSES", passes)  # small blocks reach all levels
    rng = random.Random(7)
    events, want = [], {}
    for app, n in (("hot", 150), ("one", 1), (None, 20)):
        statuses = [rng.choice(["FALSE_POSITIVE"] * 3 + ["RESOLVED", "RESOLVED", None, "OPEN"]) for _ in range(n)]
        if app == "hot":
            statuses[60:140] = ["RESOLVED"] * 80
        events += [(app, i, f"{app}-{i}", s) for i, s in enumerate(statuses)]
        want |= {f"{app}-{i}": v for i, v in enumerate(looped(statuses, start))}
    rng.shuffle(events)
    df = spark.createDataFrame(events, "app_id string, timestamp long, alert_id string, triage_status string")
    out = st.feedback_thresholds(df, dict(zip(st.LEVELS, start)), ["timestamp", "alert_id"], ranges=5)
    assert out.columns == [*df.columns, "low_after", "medium_after", "high_after"]
    got = {r.alert_id: r[4:] for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1e-9) for k in want for a, b in zip(got[k], want[k]))


@pytest.mark.parametrize("passes", [2, 10])
def test_smoothing_against_the_loop(spark, monkeypatch, passes):
    monkeypatch.setattr(scans, "PASSES", passes)
    rng = random.Random(3)
    rows, want = [], {}
    for app, n in (("a", 300), ("b", 1), ("nulls", 12)):
        ema = None
        for i in range(n):
            x = None if (app == "nulls" and i in (0, 3, 4)) else rng.random()
            first = ema is None
            if x is not None:
                ema = x if first else st.ALPHA * x + (1 - st.ALPHA) * ema
            want[app, i] = x if x is None or first else min(1.0, max(0.0, st.INSTANT * x + st.SMOOTHED * ema))
            rows.append((app, i, f"{i}", x))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "app_id string, window_end_ms long, window_bucket string, score double")
    got = {(r.app_id, r.window_end_ms): r.smoothed for r in st.smooth(df).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if v is None else math.isclose(got[k], v, abs_tol=1e-12)


def test_one_key_over_many_ranges(spark):
    """A million events of one application in 64 ranges, without a Python worker."""
    n = 1_000_000
    df = spark.range(n).selectExpr(
        "'hot' AS app_id", "id AS timestamp", "id AS alert_id",
        "CASE WHEN pmod(xxhash64(id), 5) < 2 THEN 'FALSE_POSITIVE' WHEN pmod(xxhash64(id), 5) < 4 THEN 'RESOLVED' END AS triage_status")
    out = st.feedback_thresholds(df, DEFAULTS, ["timestamp", "alert_id"], ranges=64)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    got = out.selectExpr("alert_id", "low_after", "medium_after", "high_after").toPandas().sort_values("alert_id")
    want = looped([r[0] for r in df.orderBy("alert_id").select("triage_status").collect()], tuple(DEFAULTS.values()))
    assert len(got) == n and abs(got.iloc[:, 1:].to_numpy() - want).max() < 1e-6


def test_empty(spark):
    df = spark.createDataFrame([], "app_id string, timestamp long, alert_id string, triage_status string")
    assert st.feedback_thresholds(df, DEFAULTS, ["timestamp", "alert_id"]).collect() == []
