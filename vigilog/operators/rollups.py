"""Hourly aggregates of logs, kept up batch by batch, and the reports that read them.

A row counts the logs of one server and source in one hour, the parsed ones among them, and
holds their first and last time; a second table holds a sketch of the addresses seen in an
hour. Rows of several batches for the same hour add up (sums, least and greatest, union of
sketches), so a batch only appends its own and late logs need no rewriting.

Reports read these rows, whose number follows servers x hours, and never the logs. They are
those of ``operators.stats``; ranges of time are whole hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.operators.detect import parsed_view
from vigilog.operators.stats import DETAIL_SOURCES, REPORTED_SOURCES, SEVERITIES, coverage_report
from vigilog.session import cut_lineage

HOURLY = (
    "hour timestamp, server_id bigint, log_source string, logs bigint, parsed bigint, "
    "first_seen timestamp, last_seen timestamp"
)
ADDRESSES = "hour timestamp, log_source string, addresses binary"
KEYS = ["hour", "server_id", "log_source"]


def hourly(logs: DataFrame) -> DataFrame:
    """``HOURLY`` rows of a batch of stored logs."""
    view = parsed_view(logs)
    parsed = F.lit(False)
    for source in DETAIL_SOURCES:
        parsed = parsed | F.col(source).isNotNull()
    rows = view.select(
        F.date_trunc("hour", "recv_time").alias("hour"), "server_id", "log_source", "recv_time", parsed.alias("parsed")
    )
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("logs"),
        F.count_if("parsed").alias("parsed"),
        F.min("recv_time").alias("first_seen"),
        F.max("recv_time").alias("last_seen"),
    )


def hourly_addresses(logs: DataFrame) -> DataFrame:
    """``ADDRESSES`` rows of a batch of stored logs with ``ip_address``."""
    hour = F.date_trunc("hour", "recv_time").alias("hour")
    return logs.groupBy(hour, "log_source").agg(F.hll_sketch_agg("ip_address").alias("addresses"))


def merged(rows: DataFrame) -> DataFrame:
    """One row for each hour, server and source, of the rows of all batches."""
    return rows.groupBy(*KEYS).agg(
        F.sum("logs").alias("logs"),
        F.sum("parsed").alias("parsed"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def distinct_addresses(rows: DataFrame, per: str | None = None) -> DataFrame:
    """About how many addresses were seen, in all or by ``hour`` or ``log_source``."""
    sketch = F.hll_sketch_estimate(F.hll_union_agg("addresses")).alias("addresses")
    return rows.groupBy(*([per] if per else [])).agg(sketch)


def log_totals(rows: DataFrame, servers: DataFrame, alerts: DataFrame) -> DataFrame:
    """``stats.log_totals``."""
    names = F.array(F.lit("logs"), F.concat(F.lit("logs_"), "log_source"))
    out = rows.select(F.explode(names).alias("measure"), "logs").groupBy("measure").agg(F.sum("logs").alias("total"))
    for name, df in (("servers", servers), ("alerts", alerts)):
        out = out.unionByName(df.agg(F.count("*").alias("total")).withColumn("measure", F.lit(name)))
    return out


def server_breakdown(rows: DataFrame, alerts: DataFrame, servers: DataFrame) -> DataFrame:
    """``stats.server_breakdown``."""
    sources = [*REPORTED_SOURCES, "zeek_conn"]
    per_log = rows.groupBy(F.col("server_id").alias("id")).agg(
        *[F.sum(F.when(F.col("log_source") == s, F.col("logs")).otherwise(0)).alias(f"logs_{s}") for s in sources]
    )
    per_alert = alerts.groupBy(F.col("server_id").alias("id")).agg(
        *[F.count_if(F.col("severity") == s).alias(f"alerts_{s}") for s in SEVERITIES],
        F.count_if(F.col("resolved")).alias("resolved_alerts"),
        F.count_if(~F.col("resolved")).alias("active_alerts"),
    )
    named = servers.select("id", "hostname")
    return named.join(per_log, "id", "left").join(per_alert, "id", "left").na.fill(0)


def _last_hour(rows: DataFrame, as_of: Column | None) -> Column:
    """The hour of ``as_of``, or of the newest log."""
    if as_of is not None:
        return F.date_trunc("hour", as_of)
    return F.lit(rows.agg(F.max("hour")).first()[0]).cast("timestamp")


def logs_timeseries(rows: DataFrame, hours: int = 24, as_of: Column | None = None) -> DataFrame:
    """Logs per hour and source in the last whole hours, newest first."""
    first = _last_hour(rows, as_of) - F.expr(f"INTERVAL {hours} HOURS")
    recent = rows.where(F.col("hour") >= first)
    return recent.groupBy("hour", "log_source").agg(F.sum("logs").alias("logs")).orderBy(F.desc("hour"), "log_source")


def server_timeline(
    servers: DataFrame, rows: DataFrame, alerts: DataFrame, hours: int = 24, as_of: Column | None = None
) -> DataFrame:
    """``stats.server_timeline``: logs and alerts of every hour in range, zero where there are none."""
    last = _last_hour(rows, as_of)
    first = last - F.expr(f"INTERVAL {hours - 1} HOURS")
    zero = F.lit(0).cast("bigint")
    logged = rows.where(F.col("hour") >= first).select("server_id", "hour", "logs", zero.alias("alerts"))
    alarmed = alerts.where(F.col("triggered_at") >= first).select(
        "server_id", F.date_trunc("hour", "triggered_at").alias("hour"), zero.alias("logs"), F.lit(1).alias("alerts")
    )
    counts = logged.unionByName(alarmed).groupBy("server_id", "hour").agg(
        F.sum("logs").alias("logs"), F.sum("alerts").alias("alerts")
    )
    every_hour = F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("hour")
    grid = servers.select(F.col("id").alias("server_id"), every_hour)
    return grid.join(counts, ["server_id", "hour"], "left").select(
        "server_id", "hour", F.coalesce("logs", zero).alias("logs"), F.coalesce("alerts", zero).alias("alerts")
    ).orderBy("server_id", "hour")


def parse_coverage(rows: DataFrame) -> DataFrame:
    """``stats.parse_coverage``."""
    counts = rows.rollup("log_source").agg(
        F.grouping("log_source").alias("whole"), F.sum("parsed").alias("parsed"), F.sum("logs").alias("total")
    )
    return coverage_report(counts)


def server_activity_times(rows: DataFrame) -> DataFrame:
    """(server_id, logs, first_seen, last_seen) of every server that has logs."""
    return rows.groupBy("server_id").agg(
        F.sum("logs").alias("logs"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def rolled_up(logs: DataFrame, name: str = "hourly") -> DataFrame:
    """``hourly`` rows written to the shared folder, for reports over a table without a store."""
    return cut_lineage(logs.sparkSession, hourly(logs), name)
