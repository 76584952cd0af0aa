"""Log files to envelopes ``recv_time, src_ip, line``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.parsers import event_objects
from vigilog.functions.text import strip

UPLOAD = "file_upload"


def envelopes(
    lines: DataFrame,
    text: str = "value",
    src_ip: Column | str = UPLOAD,
    recv_time: Column | None = None,
) -> DataFrame:
    """Envelopes of text rows, batch or stream; blank lines are dropped.

    Bytes that are not valid text are replaced. One receive time holds for the
    whole load, or for each micro-batch of a stream.
    """
    line = strip(F.make_valid_utf8(F.col(text)))
    origin = F.lit(src_ip) if isinstance(src_ip, str) else src_ip
    rows = lines.select(
        (F.current_timestamp() if recv_time is None else recv_time).alias("recv_time"),
        origin.alias("src_ip"),
        line.alias("line"),
    )
    return rows.where(F.length("line") > 0)


def read_text_logs(
    spark: SparkSession, path: str, src_ip: str = UPLOAD, recv_time: Column | None = None
) -> DataFrame:
    """One envelope per non-blank line of syslog or access log files."""
    return envelopes(spark.read.text(path), src_ip=src_ip, recv_time=recv_time)


def valid_json(line: Column) -> Column:
    """Whether the whole line is one JSON value."""
    alone = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    return F.size(event_objects(line)).eqNullSafe(1) | F.try_variant_get(
        alone, "$[0]", "variant"
    ).isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()


def read_json_logs(
    spark: SparkSession, path: str, src_ip: str = UPLOAD, recv_time: Column | None = None
) -> DataFrame:
    """Envelopes of the lines that are JSON."""
    lines = read_text_logs(spark, path, src_ip, recv_time)
    return lines.where(valid_json(F.col("line")))


def json_line_counts(spark: SparkSession, path: str) -> DataFrame:
    """Number of good and bad lines of JSON log files."""
    good = valid_json(F.col("line"))
    return read_text_logs(spark, path).agg(
        F.count_if(good).alias("good"), F.count_if(~good).alias("bad")
    )


def read_conn_logs(
    spark: SparkSession, path: str, src_ip: str = UPLOAD, recv_time: Column | None = None
) -> DataFrame:
    """Envelopes of connection log files, header lines left out."""
    lines = read_text_logs(spark, path, src_ip, recv_time)
    return lines.where(~F.col("line").startswith("#"))
