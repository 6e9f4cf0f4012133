"""Sinks: tables, one-row reports, event exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.privacy import SALT, export_view


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unsupported output format: {fmt}")


def write_report(report: DataFrame, path: str) -> None:
    """A small report (aggregates only) as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


# Element ids and names of the flow export.
ELEMENTS = [(8, "sourceIPv4Address", "src_ip"), (12, "destinationIPv4Address", "dst_ip"),
            (7, "sourceTransportPort", "src_port"), (11, "destinationTransportPort", "dst_port"),
            (4, "protocolIdentifier", "protocol_code"), (2, "packetDeltaCountOut", "packets_out"),
            (1, "octetDeltaCountOut", "bytes_out"), (152, "flowStartMilliseconds", "timestamp_start"),
            (153, "flowEndMilliseconds", "timestamp_end")]
NETFLOW_VERSION, TEMPLATE_ID = 10, 256


def ipfix_elements(df: DataFrame) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.col(c).cast("string").alias("value"))
                     for i, n, c in ELEMENTS if c in df.columns])


def export_flow_events(flows: DataFrame, mode: str = "OFF", options: dict | None = None, salt: str = SALT) -> DataFrame:
    """One JSON document per flow, reduced to the privacy tier, with its element list."""
    out = export_view(flows, mode, options, salt)
    fields = [c for c in out.columns if c not in ("flow_id", "protocol_code")]
    body = F.struct(F.lit("mobile_flow").alias("event_type"), F.lit("1.1").alias("event_version"), *fields,
                    F.lit(NETFLOW_VERSION).alias("netflow_version"), F.lit(TEMPLATE_ID).alias("ipfix_template_id"),
                    ipfix_elements(out).alias("ipfix_elements"))
    return out.select("flow_id", F.to_json(body).alias("payload"))


def export_latest(df: DataFrame, n: int, ts: str = "timestamp_end", id_col: str = "flow_id") -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(id_col)).limit(n)


def export_backfill(flows: DataFrame, alerts: DataFrame, windows: DataFrame, since: int, n: int,
                    ts: str = "timestamp_end", id_col: str = "flow_id") -> tuple[DataFrame, DataFrame]:
    """What an export still owes: newest n rows after ``since``, oldest first; alerts need their window."""
    newest = export_latest(flows, n, ts, id_col).filter(F.col(ts) > since).orderBy(ts, id_col)
    a = alerts.orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(n).filter(F.col("timestamp") > since)
    joined = a.join(windows.withColumnRenamed("app_id", "_w_app"), "feature_window_id", "inner").drop("_w_app")
    return newest, joined.orderBy("timestamp", "alert_id")
