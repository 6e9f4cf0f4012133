"""Inputs on which queries once failed or left rows out."""

from common import SF
from pyspark.sql import functions as F


def test_cluster_thresholds_without_benign_rows(spark):
    from netloom.operators.models import cluster_thresholds

    df = spark.range(200).select(F.lit(1).alias("label"), (F.col("id") % 2 * 50.0 + F.col("id") % 7).alias("a"),
                                 (F.col("id") % 5).cast("double").alias("b"))
    assert sum(r["rows"] for r in cluster_thresholds(df, ["a", "b"], 2).collect()) == 200
    half = df.withColumn("label", (F.col("b") == 0).cast("int"))
    assert sum(r["rows"] for r in cluster_thresholds(half, ["a", "b"], 2).collect()) == half.filter("label = 0").count()


def orders(spark, keys, day):
    """Orders of one customer on one day, in the columns the alert table is made of."""
    return spark.createDataFrame([(k, 1, "F", 10.0 + n, "1-URGENT" if n else "5-LOW") for n, k in enumerate(keys)],
                                 "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
                                 ).withColumn("o_orderdate", F.to_date(F.lit(day)))


def test_upsert_of_large_row_ids(spark, tmp_path):
    """Row ids beyond a million (as in a larger copy) leave the times as they are and break ties still."""
    from __spark_entry__ import queries

    later = 5000 + 86_400 * 5000  # same remainders, so the same alert and the same time of day
    orders(spark, [5000, later], "1995-03-01").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "C1", "BUILDING")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(
        f"{tmp_path}/customer.parquet")
    got = queries()["d01_upsert"](spark, str(tmp_path)).collect()
    epoch = 794_016_000
    assert [tuple(r) for r in got] == [("alert-0", "HIGH", epoch + 5000, epoch - 100)]


def test_device_status_of_all_devices(spark, tmp_path):
    from __spark_entry__ import queries

    spark.range(100_010).select(F.col("id").alias("c_custkey"), F.lit("C").alias("c_name"),
                                F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    orders(spark, [1], "1995-03-01").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = queries()["d06_device_status"](spark, str(tmp_path))
    own = got.filter(F.substring("device_id", 8, 20).cast("long") < 100_010)
    assert own.count() == 100_010 and got.count() > 175_000


def test_parts_of_a_stream_are_many_files(spark, tmp_path, monkeypatch):
    """A part is no longer written by one task; a batch still is one part, also where it has fewer rows than files."""
    from __spark_entry__ import queries
    from netloom.sources import tables
    from netloom.streaming.flows import run_batches

    few = tables.table(spark, SF, "events").filter("event_id < 300 OR event_id IN (400, 950, 999)")
    few.write.parquet(f"{tmp_path}/in/events.parquet")
    whole = queries()["l07_late_rows"](spark, f"{tmp_path}/in").collect()
    monkeypatch.setattr(tables, "ARRIVAL_ROWS", 4)
    stream = tables.flow_arrivals(spark, f"{tmp_path}/in", f"{tmp_path}/parts", ["flow_id", "arrival"])
    rows = spark.read.schema(stream.schema).parquet(f"{tmp_path}/parts")
    assert rows.count() == few.count() and len(rows.inputFiles()) == 8 * 10
    sizes = {r[0]: r[1] for r in rows.select(
        "arrival", F.input_file_name()).distinct().groupBy("arrival").count().collect()}
    assert max(sizes.values()) == 10 and min(sizes.values()) < 10
    seen = []
    run_batches(stream, lambda batch, number: seen.append([r[0] for r in batch.select("arrival").distinct().collect()]))
    assert len(seen) == 8 and [x for part in seen for x in part] == sorted(sizes)
    assert queries()["l07_late_rows"](spark, f"{tmp_path}/in").collect() == whole


def test_windows_deal_flows_and_test_each_host_once(spark, tmp_path):
    """One row group is work for many tasks, and no host test runs per flow; what is given about a host still counts."""
    from netloom.operators.flows import HOST_COLUMNS, prepare_flows
    from netloom.operators.windows import _sum_columns, raw_windows
    from netloom.functions.constants import FLAG_MEANS
    from netloom.sources.tables import flow_view

    f = flow_view(spark, SF, dealt=True)
    assert f.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    assert not {FLAG_MEANS[c] for c in HOST_COLUMNS} & set(_sum_columns())
    i = F.col("flow_id")
    given = f.withColumns({"dst_ip": F.when(i % 5 != 0, F.col("dst_host")), "lookalike_score": (i % 4) / 8.0, "has_threat_tags": i % 9 == 0})
    for rows in (f, given):
        means = prepare_flows(rows).groupBy("app_id", F.expr("timestamp_end div 3600000L").alias("window_bucket")).agg(
            *[F.avg(c).alias(FLAG_MEANS[c]) for c in HOST_COLUMNS])
        cols = ["app_id", "window_bucket", *[F.round(FLAG_MEANS[c], 9) for c in HOST_COLUMNS]]
        want = sorted(tuple(r) for r in means.select(*cols).collect())
        assert sorted(tuple(r) for r in raw_windows(rows, 3_600_000).select(*cols).collect()) == want and len(want) > 100
