"""Scans: delimited text, Parquet, JSON documents, folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_flows(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None,
               recursive: bool = False, pattern: str | None = None, with_path: bool = False) -> DataFrame:
    """Read CSV, TSV / TXT or Parquet. Broken lines are kept in ``_corrupt_record``, bad bytes replaced.

    Without a schema, delimited columns are text (one header line is read, no inference pass).
    """
    fmt = (fmt or path.rsplit(".", 1)[-1]).lower()
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if fmt == "parquet":
        out = (reader.schema(schema) if schema else reader).parquet(path)
    elif fmt in ("csv", "tsv", "txt"):
        sep = "," if fmt == "csv" else "\t"
        reader = reader.option("header", "true").option("sep", sep).option("mode", "PERMISSIVE").option(
            "encoding", "UTF-8").option("columnNameOfCorruptRecord", CORRUPT)
        out = (reader.schema(schema) if schema else reader).csv(path)
    else:
        raise ValueError(f"unsupported input format: {fmt}")
    return out.withColumn("source_path", F.input_file_name()) if with_path or recursive else out


# Names of the array a document may hold its records in, first present wins.
RECORD_KEYS = ["alerts", "records", "items", "events", "samples"]


def read_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of JSON documents: a list, or an object holding the list under a known name."""
    doc = spark.read.option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE").json(path)
    for key in RECORD_KEYS:
        if key in doc.columns and isinstance(doc.schema[key].dataType, T.ArrayType):
            return doc.select(F.explode(key).alias("_r")).select("_r.*")
    return doc


# Columns of the packet-field export.
PACKET_FIELDS = ["frame.time_epoch", "frame.len", "ip.src", "ip.dst", "ipv6.src", "ipv6.dst", "tcp.srcport",
                 "tcp.dstport", "udp.srcport", "udp.dstport", "ip.proto", "_ws.col.Protocol",
                 "tls.handshake.extensions_server_name", "http.host", "dns.qry.name"]


def read_packet_fields(spark: SparkSession, path: str) -> DataFrame:
    """The packet-field CSV as packet rows, blanks as nulls."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in PACKET_FIELDS])
    raw = read_flows(spark, path, "csv", schema, with_path=True)

    def f(*names: str):
        return F.coalesce(*[F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names])

    return raw.select(
        F.col("source_path").alias("capture"),
        (f("frame.time_epoch").try_cast("double") * 1000).cast("long").alias("ts_ms"),
        F.coalesce(f("frame.len").try_cast("double").cast("long"), F.lit(0)).alias("bytes"),
        f("ip.src", "ipv6.src").alias("src_ip"), f("ip.dst", "ipv6.dst").alias("dst_ip"),
        F.coalesce(f("tcp.srcport", "udp.srcport").try_cast("int"), F.lit(0)).alias("src_port"),
        F.coalesce(f("tcp.dstport", "udp.dstport").try_cast("int"), F.lit(0)).alias("dst_port"),
        F.col("`_ws.col.Protocol`").alias("raw_protocol"), F.col("`ip.proto`").alias("ip_proto"),
        F.col("`tls.handshake.extensions_server_name`").alias("tls_sni"), F.col("`http.host`").alias("http_host"),
        F.col("`dns.qry.name`").alias("dns_query_name"),
    ).filter("ts_ms is not null and src_ip is not null and dst_ip is not null")
