"""Flow, packet and alert tables derived from the driver's generic tables.

Derivations use integer arithmetic and binary fractions only, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text columns of the derived flow table, picked by integer remainder.
APPS = ["com.android.chrome", "service:tcp:10.0.0.1:443", "uid:1000", "com.analytics.sdk",
        "org.openvpn.client", "com.whatsapp", "com.sensor.daemon", "com.spyware.rat",
        "com.example.shop", "com.example.bank"]
HOSTS = ["10.0.0.5", "g00gle.xyz", "xn--pple-43d.com", "224.0.0.251", "cdn.example.com",
         "a.b.c.d.example.net", "paypa1.com", "93.184.216.34"]
PORTS = [53, 80, 443, 8443, 8080, 51820]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def flow_view(spark: SparkSession, sf_dir: str, dealt: bool = False, rows: int | None = None) -> DataFrame:
    """The flows; ``dealt`` over all cores while narrow, as no more tasks read a file than it has row groups.

    With ``rows`` a task makes no more flows than that, on average. What few receivers fetch of one task is
    then small; Spark fetches it as a whole, outside its heap.
    """
    e = table(spark, sf_dir, "events")
    many = spark.sparkContext.defaultParallelism
    many = max(many, -(-e.count() // rows)) if dealt and rows else many
    return flows_of(e.repartition(many, "event_id") if dealt else e)


def flow_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flows as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1)
    return flows_of(source.parquet(sf_dir))


#: Parts a stream of flows arrives in, and rows from which on a part is cut into several files.
ARRIVALS = 8
ARRIVAL_ROWS = 250_000
#: A trigger of the file source keeps no more than 10,000 files in mind.
ARRIVAL_FILES = 1_000


def flow_arrivals(spark: SparkSession, sf_dir: str, path: str, columns: list[str] | None = None) -> DataFrame:
    """The flows as a stream in parts by time, where some flows come one or two parts late.

    Every part is written by as many tasks, into as many files, as the table asks for, the same number for
    each, and a trigger takes that many: so a batch of the stream is a part, whatever its size.
    """
    e = table(spark, sf_dir, "events")
    i, ms = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    ends = e.agg(F.min(ms), F.max(ms), F.count(F.lit(1))).first()
    first, last = (F.lit(x).cast("long") for x in ends[:2])
    files = min(ARRIVAL_FILES, max(1, -(-ends[2] // (ARRIVALS * ARRIVAL_ROWS))))
    delay = F.when(i % 41 == 0, 2).when(i % 13 == 1, 1).otherwise(0)
    slot = F.least(F.lit(ARRIVALS - 1), F.floor((ms - first) * ARRIVALS / (last - first + 1)) + delay)
    for n in range(ARRIVALS):  # the file source goes by modification time
        # Dealt while narrow: the columns of the flows are made by the tasks that write them.
        part = flows_of(e.filter(slot == n).repartition(files)).withColumn("arrival", F.lit(n))
        part = part.select(*(columns or part.columns))
        part.write.mode("append").parquet(path)
        # A part of few rows can have left a task without any, which then writes no file.
        for _ in range(files * (n + 1) - len(spark.read.schema(part.schema).parquet(path).inputFiles())):
            part.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", files).parquet(path)


def flows_of(e: DataFrame) -> DataFrame:
    i, k, u = F.col("event_id"), F.col("k"), F.col("user_id")
    base = e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return base.select(
        i.cast("long").alias("flow_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_end"),
        k,
        pick(APPS, u % 10).alias("app_id"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes_out"),
        (k * 37).alias("bytes_in"),
        (i % 5 + 1).alias("packets_out"),
        (i % 7).alias("packets_in"),
        ((i * 13) % 5000).alias("duration_ms"),
        pick(PORTS, k % 6).cast("long").alias("dst_port"),
        F.when(i % 3 != 0, "TCP").otherwise("UDP").alias("protocol"),
        pick(HOSTS, k % 8).alias("dst_host"),
        F.concat_ws(":", pick(HOSTS, k % 8), pick(PORTS, k % 6)).alias("destination_key"),
        (((i * 7) % 4 == 0).cast("int")).cast("double").alias("dst_novelty"),
        ((F.col("event_type") == "error") & (F.col("value") > 40)).cast("int").alias("label"),
        F.concat(F.lit("src_"), (u % 3).cast("string")).alias("dataset_source"),
        F.concat(F.lit("prof_"), (u % 2).cast("string")).alias("dataset_profile"),
        F.concat(F.lit("var_"), (k % 4).cast("string")).alias("dataset_variant"),
        F.concat(F.lit("env_"), (i % 3).cast("string")).alias("environment_id"),
        F.concat(F.lit("s_"), (u % 7).cast("string")).alias("session_id"),
        F.concat(F.lit("dev_"), (u % 20).cast("string")).alias("device_id"),
        F.lit(64.0).alias("sttl"),
        (F.lit(32.0) + (k % 5) * 16).alias("rttl"),
        (i % 2).cast("double").alias("has_ttl_metrics"),
        (i % 4 != 1).cast("int").cast("double").alias("has_tcp_flag_metrics"),
        F.lit(0.0).alias("has_fragment_metrics"),
        F.lit(1.0).alias("has_window_metrics"),
        (i % 8 == 0).cast("int").cast("double").alias("has_payload_metrics"),
        ((i % 4) / 4.0).alias("s_syn_rate"),
        ((k % 2) / 2.0).alias("r_syn_rate"),
        ((i % 8) / 8.0).alias("s_ack_rate"),
        ((k % 4) / 4.0).alias("r_ack_rate"),
        ((i % 2) / 2.0).alias("s_psh_rate"),
        ((i % 16) * 1024.0).alias("s_win_tcp"),
        ((k % 8) * 512.0).alias("r_win_tcp"),
        (k * 2.0).alias("s_payload_avg"),
        (i % 32).cast("double").alias("r_payload_avg"),
        (k / 4.0).alias("s_inter_packet_avg"),
        (i % 64).cast("double").alias("s_load"),
    )


def packet_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event; direction alternates, so keys have both."""
    f = flow_view(spark, sf_dir)
    u = table(spark, sf_dir, "events").select(F.col("event_id").alias("flow_id"), F.col("user_id").alias("u"))
    i, k, u_ = F.col("flow_id"), F.col("k"), F.col("u")
    out = (i % 2) == 0
    local, remote = F.concat(F.lit("10.0.0."), (u_ % 4).cast("string")), F.concat(F.lit("93.184.216."), (k % 3).cast("string"))
    lport, rport = (u_ % 5 + 40000).cast("int"), F.lit(443)
    none = F.lit(None).cast("string")
    return f.join(u, "flow_id").select(
        i.alias("packet_id"), F.col("timestamp_end").alias("ts_ms"), "app_id",
        F.concat(F.lit("cap_"), (u_ % 3).cast("string")).alias("capture"),
        F.when(u_ % 3 != 0, "TCP").otherwise("UDP").alias("protocol"),
        F.when(out, local).otherwise(remote).alias("src_ip"), F.when(out, lport).otherwise(rport).alias("src_port"),
        F.when(out, remote).otherwise(local).alias("dst_ip"), F.when(out, rport).otherwise(lport).alias("dst_port"),
        out.alias("outbound"), F.col("bytes_out").alias("bytes"),
        F.when(i % 4 != 0, k).otherwise(0).alias("payload_bytes"),
        F.when(i % 5 != 0, F.when(out, 64).otherwise(k % 4 + 48)).alias("hop_limit"),
        (i % 11 == 0).alias("fragmented"), (i % 6 == 0).alias("syn"), (i % 13 == 0).alias("rst"),
        (i % 2 == 1).alias("ack"), (i % 17 == 0).alias("fin"), (i % 3 == 0).alias("psh"),
        ((i % 16) * 1024).alias("tcp_window"),
        F.when(k % 7 == 0, F.concat(F.lit("h"), (k % 5).cast("string"), F.lit(".example.com"))).otherwise(none).alias("host_hint"),
        F.when(k % 4 == 0, F.concat(F.lit("www.Q"), (k % 6).cast("string"), F.lit(".example.net"))).otherwise(none).alias("dns_query_name"),
        F.when(i % 9 == 0, remote).otherwise(F.when(i % 10 == 0, "not-an-address").otherwise(none)).alias("dns_answer_value"),
        F.when(k % 5 == 0, F.concat(F.lit("sni"), (k % 3).cast("string"), F.lit(".example.org"))).otherwise(none).alias("tls_sni"),
        F.when(k % 6 == 0, F.lit("")).when(k % 8 == 0, "Web.Example.com").otherwise(none).alias("http_host"),
        (k % 10 == 0).alias("quic_detected"),
    )
