"""Parsed logs, archives and exports written as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.functions.parsers import STORED_TIME
from vigilog.session import cut_lineage

CSV_COLUMNS = ["Timestamp", "Level", "Source", "Message"]
CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "multiLine": "true"}


def write_parsed_batch(
    parsed: DataFrame, path: str, file_format: str = "json", mode: str = "append"
) -> None:
    """Rows of ``ingest.parse_lines`` to one folder per log type, as NDJSON or CSV.

    Every row holds the envelope and the columns of its type; attributes without fixed
    names are one JSON column ``attrs``. The parsed rows are written once before, so
    lines are parsed once however many types there are.
    """
    if file_format not in ("json", "csv"):
        raise ValueError(f"unknown format {file_format!r}")
    spark = parsed.sparkSession
    rows = cut_lineage(spark, parsed.where(F.col("log_type").isNotNull()), "parsed")
    found = {r["log_type"] for r in rows.select("log_type").distinct().collect()}
    for field in parsed.schema.fields:
        if field.name not in found:
            continue
        own = rows.where(F.col("log_type") == field.name)
        if isinstance(field.dataType, T.StructType):
            columns = [F.col(f"{field.name}.{c}").alias(c) for c in field.dataType.fieldNames()]
        else:
            columns = [F.to_json(F.col(field.name)).alias("attrs")]
        writer = own.select("recv_time", "src_ip", "line", *columns).write.mode(mode)
        target = f"{path}/log_type={field.name}"
        if file_format == "csv":
            writer.options(**CSV_OPTIONS).csv(target)
        else:
            writer.json(target)


def archive_lines(envelopes: DataFrame) -> DataFrame:
    """Verbatim archive rows: time, address in brackets, line."""
    when = F.date_format("recv_time", STORED_TIME)
    return envelopes.select(
        F.concat(
            when, F.lit(" ["), F.coalesce("src_ip", F.lit("")), F.lit("] "), F.col("line")
        ).alias("value")
    )


def archive_raw_lines(envelopes: DataFrame, path: str, mode: str = "append") -> None:
    archive_lines(envelopes).write.mode(mode).text(path)


def csv_rows(
    logs: DataFrame, level: str | None = None, since: Column | None = None
) -> DataFrame:
    """Export rows of ``recv_time, level, source, message`` logs, filtered."""
    found = logs
    if level is not None:
        found = found.where(F.col("level") == level)
    if since is not None:
        found = found.where(F.col("recv_time") >= since)
    return found.select(
        F.date_format("recv_time", STORED_TIME).alias("Timestamp"),
        F.col("level").alias("Level"),
        F.col("source").alias("Source"),
        F.col("message").alias("Message"),
    )


def export_logs_csv(
    logs: DataFrame, path: str, level: str | None = None, since: Column | None = None
) -> None:
    """CSV files with a header; quotes inside a value are doubled."""
    csv_rows(logs, level, since).write.options(**CSV_OPTIONS).csv(path)
