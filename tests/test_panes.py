"""Windows over panes: deviations against loops, and what is held of a pane."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from netloom.operators import sliding as sl
from netloom.plans import panes


@pytest.mark.parametrize("n, width", [(1, 1), (7, 3), (300, 40), (3000, 900)])
def test_deviations_against_loops(n, width):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 50, n) / 4.0 if n % 2 else rng.normal(size=n) * 1e3
    low = np.maximum.accumulate(np.maximum(0, np.arange(n) - rng.integers(0, width, n)))
    high = np.arange(n)
    mean = panes.totals(x, low, high) / (high - low + 1)
    spread = list(zip(low, high, mean))
    np.testing.assert_allclose(panes.squares(x, low, high, mean), [((x[a:b + 1] - m) ** 2).sum() for a, b, m in spread], atol=1e-8)
    np.testing.assert_allclose(panes.squares(x, low + 1, high, mean), [((x[a + 1:b + 1] - m) ** 2).sum() for a, b, m in spread], atol=1e-8)
    np.testing.assert_allclose(panes.distances(x, low, high, mean), [np.abs(x[a:b + 1] - m).sum() for a, b, m in spread], atol=1e-8)


def test_constant_values_deviate_by_nothing():
    x, high = np.full(5000, 0.1), np.arange(5000)
    low = np.maximum(0, high - 700)
    assert panes.squares(x, low, high, x).max() == 0


def test_groups_keep_whole_groups_and_values():
    keys = np.repeat(np.arange(9), [1, 5, 40, 2, 2, 100, 1, 7, 42])
    value = np.where(keys == 8, 1e6 + 0.25, keys / 4.0)
    whole = pa.table({"k": keys, "t": [f"t{k}" for k in keys], "v": value}).to_batches(max_chunksize=13)
    found = list(panes.groups(iter(whole), ["k"], ["v"], 20))
    assert np.concatenate([t.column("k").to_numpy() for t, _ in found]).tolist() == keys.tolist()
    assert np.concatenate([t.column("v").to_numpy() for t, _ in found]).tolist() == value.tolist()
    assert sum((t.column("t").to_pylist() for t, _ in found), []) == [f"t{k}" for k in keys]
    assert [len(set(t.column("k").to_pylist())) for t, _ in found] == [len(set(g.tolist())) for _, g in found]
    held = [set(t.column("k").to_pylist()) for t, _ in found]
    assert len(found) > 2 and sum(map(len, held)) == 9  # no group in two tables


def test_a_large_pane_is_described_in_parts():
    """One pane of 150,000 rows: its results come a part at a time, its columns are small."""
    n = 150_000
    numbers = {c: np.ones(n) for c in dict.fromkeys([*sl.SUMMED, "total_bytes"])}
    table = pa.table({"app_id": ["a"] * n, "timestamp_end": np.arange(n), "_pane": np.zeros(n, np.int64), **{c: ["x"] * n for c in sl.KINDS}, **numbers})
    ((held, group),) = panes.groups(iter(table.to_batches(max_chunksize=10_000)), ["app_id", "_pane"], list(numbers))
    assert held.nbytes < n * 80  # 8 bytes a value would be over 350
    parts = list(sl.describe(held, group, np.ones(n, bool), [50_000], None, None, ["app_id", "timestamp_end"]))
    assert len(parts) > 1 and max(map(len, parts)) <= panes.TOGETHER and sum(map(len, parts)) == n
    assert set(parts[-1].column("_s_bytes_out").to_pylist()) == {50_001.0}


def flow_table(n, seed, keys=40):
    """Flows of one application, one group before and one after it; times with ties, bursts and silences."""
    rng = np.random.default_rng(seed)
    step = rng.choice([0, 1, 1, 3, 40, 900], n, p=[0.3, 0.3, 0.2, 0.17, 0.02, 0.01])
    ms = np.cumsum(step) + 1_700_000_000_000
    numbers = {c: rng.integers(0, 4, n) / 4.0 for c in sl.SUMMED}
    numbers["duration_ms"] = np.where(rng.random(n) < 0.01, 1e7, rng.random(n) * 50)
    numbers["total_bytes"] = np.where(rng.random(n) < 0.005, 1e9, rng.integers(0, 3000, n) / 8.0)
    pane = np.concatenate(([0] * 11, [1] * (n - 25), [2] * 14))
    spread = (np.arange(n) // 50 + rng.integers(0, keys, n)) % (n // 3)  # values come, go and come back
    return pa.table({"flow_id": np.arange(n), "app_id": ["a"] * n, "timestamp_end": ms, "_pane": pane, "slow": rng.random(n) < 0.2,
                     "_emit": (np.arange(n) > 300) & (rng.random(n) < 0.9), "destination_key": [None if k % 97 == 5 else f"d{k}" for k in spread],
                     "dst_port": spread % 7, "protocol": [["TCP", "UDP"][k % 2] for k in spread], **numbers})


@pytest.mark.parametrize("horizons, choose, limit", [
    ([60], None, None), ([900], None, None), ([10**9], None, None), ([0], None, None), ([4000], None, 70), ([4000], None, 500),
    ([4000], None, 1), ([30, 400, 3000], "slow", None), ([30, 400, 3000], None, None), ([30, 400, 3000], "slow", 90)])
@pytest.mark.parametrize("together, batch, seed", [(64, 10, 1), (100, 37, 2), (300, 1000, 3)])
def test_a_long_group_in_parts_equals_the_whole(monkeypatch, horizons, choose, limit, together, batch, seed):
    from netloom.plans import trail

    monkeypatch.setattr(trail, "BLOCK", together)
    monkeypatch.setattr(trail, "FILE_BYTES", 20_000)
    numbers, kept = list(dict.fromkeys([*sl.SUMMED, "total_bytes"])), ["flow_id", "app_id"]
    whole = flow_table(3000, seed)
    batches = whole.to_batches(max_chunksize=batch)
    want, got, longest, trails = [], [], 0, {}
    for table, group in panes.groups(iter(batches), ["app_id", "_pane"], numbers):
        emit = table.column("_emit").to_numpy()
        want += [t.to_pandas() for t in sl.describe(table, group, emit, horizons, choose, limit, kept)]
    for table, group in panes.groups(iter(batches), ["app_id", "_pane"], numbers, together, True):
        emit = table.column("_emit").to_numpy()
        longest = max(longest, len(table))
        if group[0] and (group[-1] > 1 or len(table) < together):
            got += [t.to_pandas() for t in sl.describe(table, group, emit, horizons, choose, limit, kept)]
            continue
        trails = {h: sl.trail(h, limit) for h in horizons} if group[0] else trails
        got += [t.to_pandas() for t in sl.describe_part(table, emit, trails, horizons, choose, kept)]
    assert longest < 2 * together + batch  # no table holds the group
    want, got = (pd.concat(x).sort_values(["flow_id", "_h"], ignore_index=True) for x in (want, got))
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-9, atol=1e-7)
    assert want["_n"].max() == min(2975, limit or 2975) or max(horizons) < 10**9


def test_a_horizon_of_many_rows_waits_on_disk(monkeypatch):
    """Rows that belong to all windows are not held: a horizon of 60,000 rows leaves a few thousand in memory."""
    from netloom.plans import trail

    monkeypatch.setattr(trail, "BLOCK", 1000)
    numbers = list(dict.fromkeys([*sl.SUMMED, "total_bytes"]))
    whole, held, rows = flow_table(60_000, 5).slice(11, 59_000), sl.trail(10**12, None), 0
    for first in range(0, len(whole), 1500):
        ((table, _),) = panes.groups(iter(whole.slice(first, 1500).to_batches()), ["app_id", "_pane"], numbers)
        for found in sl.describe_part(table, np.ones(len(table), bool), {10**12: held}, [10**12], None, ["flow_id"]):
            rows += len(found)
        assert sum(b.n for b in held.blocks if b.columns is not None) <= 3000 + 1500
    assert rows == sum(b.n for b in held.blocks) == 59_000
    assert found.column("_n").to_pylist()[-1] == 59_000
    big = whole.column("total_bytes").to_numpy()
    assert found.column("_size_dev").to_pylist()[-1] == pytest.approx(np.abs(big - big.mean()).sum(), rel=1e-12)


def test_flows_are_dealt_by_their_number(spark):
    from common import SF
    from netloom.sources.tables import flow_view

    few = flow_view(spark, SF, dealt=True, rows=10)
    n = flow_view(spark, SF).count()
    assert few.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-n // 10)) > 50
    assert sorted(few.collect()) == sorted(flow_view(spark, SF).collect())
