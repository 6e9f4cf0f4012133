"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) choose data and cores.
Each query is timed once, cold, to the last row through the no-op sink: nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import time

from netloom.session import get_session, tune


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)

    from netloom.catalog import evaluate as cat
    from netloom.operators import assemble as asm
    from netloom.operators import evaluate as ev
    from netloom.operators import normalize as nm
    from netloom.operators import scoring as sc
    from netloom.operators import sliding as sl
    from netloom.operators import stateful as st
    from netloom.operators import windows as win
    from netloom.operators.privacy import privacy_columns
    from netloom.sources.tables import flow_view, packet_view

    hour = 3_600_000
    flows, packets = flow_view(spark, sf_dir), packet_view(spark, sf_dir)
    n_flows = flows.count()

    def windows():
        return win.feature_windows(flows, 6 * hour)

    headline = {
        "feature_windows": windows,
        "scored_windows": lambda: sc.severity(sc.rule_score(windows(), "score")),
        "sliding_windows": lambda: sl.sliding_windows(flows, 6 * hour),
        "adaptive_windows": lambda: sl.adaptive_windows(flows, horizons_ms=[hour, 6 * hour, 24 * hour]),
        "flow_assembly": lambda: asm.assemble_flows(packets, 36 * hour, 24 * hour),
        "dst_novelty": lambda: nm.dst_novelty(flows.drop("dst_novelty")),
        "beacon_score": lambda: st.beacon_score(flows),
        "roc_auc": lambda: ev.roc_auc(cat.scored(spark, sf_dir), ["app_family"]),
        "threshold_sweep": lambda: ev.threshold_sweep(cat.scored(spark, sf_dir), by=["app_family"]),
        "episodes": lambda: ev.episodes(cat.scored(spark, sf_dir), 12 * hour),
        "privacy_columns": lambda: privacy_columns(cat.scored(spark, sf_dir)),
        "statistical_detector": lambda: st.statistical_score(cat.scored(spark, sf_dir)),
    }
    times = {}
    for name, build in headline.items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"), "flows": n_flows,
        "flows_per_sec_feature_windows": round(n_flows / times["feature_windows"], 1),
        "ms_per_sliding_window": round(1000 * times["sliding_windows"] / n_flows, 4)}))
    spark.stop()


if __name__ == "__main__":
    main()
