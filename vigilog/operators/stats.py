"""Counts, rankings and time series for reports and dashboards.

Every count is aggregated where the rows are read before it is joined or pivoted,
so a server or source with very many rows costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.text import preview
from vigilog.operators.detect import latest, parsed_view
from vigilog.operators.lookups import newest, since
from vigilog.session import cut_lineage

# Severities from worst to least, and the sources always reported.
SEVERITIES = ["critical", "high", "medium", "low"]
REPORTED_SOURCES = ["linux", "windows", "nginx"]
DETAIL_SOURCES = ["linux", "windows", "nginx"]


def _count(name: str) -> Column:
    return F.count("*").alias(name)


def severity_rank(severity: Column) -> Column:
    """1 for the worst; other texts last."""
    rank = F.when(severity == SEVERITIES[0], 1)
    for i, name in enumerate(SEVERITIES[1:], 2):
        rank = rank.when(severity == name, i)
    return rank.otherwise(len(SEVERITIES) + 1)


def age_status(
    last: Column, now: Column, steps: Sequence[tuple[str, int]], otherwise: str = "offline"
) -> Column:
    """First status whose limit in seconds exceeds the age of ``last``."""
    age = (F.unix_micros(now) - F.unix_micros(last)) / F.lit(1000000)
    out = F.when(last.isNull(), otherwise)
    for name, seconds in steps:
        out = out.when(age < seconds, name)
    return out.otherwise(otherwise)


def log_totals(logs: DataFrame, servers: DataFrame, alerts: DataFrame) -> DataFrame:
    """Total logs, servers and alerts, and logs by type, one row per measure."""
    per_source = logs.groupBy("log_source").agg(_count("n"))
    names = F.array(F.lit("logs"), F.concat(F.lit("logs_"), "log_source"))
    out = per_source.select(F.explode(names).alias("measure"), "n").groupBy("measure").agg(
        F.sum("n").alias("total")
    )
    for name, df in (("servers", servers), ("alerts", alerts)):
        out = out.unionByName(df.agg(_count("total")).withColumn("measure", F.lit(name)))
    return out


def server_activity(
    servers: DataFrame, logs: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Per server: number of logs, first and last time, and status; busiest first."""
    now = newest(logs, "recv_time") if as_of is None else as_of
    seen = logs.groupBy("server_id").agg(
        _count("log_count"),
        F.min("recv_time").alias("first_seen"),
        F.max("recv_time").alias("last_seen"),
    )
    joined = servers.join(seen.withColumnRenamed("server_id", "id"), "id", "left")
    steps = [("online", 300), ("delayed", 3600)]
    return joined.select(
        "id", "hostname", "ip_address",
        F.coalesce("log_count", F.lit(0)).alias("log_count"),
        "first_seen", "last_seen",
        age_status(F.col("last_seen"), now, steps).alias("status"),
    ).orderBy(F.desc("log_count"), "id")


def _alerts_per_server(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.col("server_id").alias("id")).agg(
        _count("total_alerts"), F.count_if(~F.col("resolved")).alias("active_alerts")
    )


def server_stats(
    servers: DataFrame, logs: DataFrame, alerts: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Per server: logs, alerts, open alerts, last time and online within five minutes."""
    now = newest(logs, "recv_time") if as_of is None else as_of
    per_log = logs.groupBy(F.col("server_id").alias("id")).agg(
        _count("total_logs"), F.max("recv_time").alias("last_seen")
    )
    joined = servers.join(per_log, "id", "left").join(_alerts_per_server(alerts), "id", "left")
    online = F.col("last_seen") >= now - F.expr("INTERVAL 5 MINUTES")
    counts = ["total_logs", "total_alerts", "active_alerts"]
    return joined.select(
        "id", "hostname", "ip_address", "server_type",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        "last_seen",
        F.when(online, "online").otherwise("offline").alias("status"),
    )


def fleet_summary(
    servers: DataFrame, logs: DataFrame, alerts: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Servers by type and status with their logs and alerts; type ``all`` is the total."""
    stats = server_stats(servers, logs, alerts, as_of)
    total = F.grouping("server_type") == 1
    return stats.rollup("server_type").agg(
        F.when(total, "all").otherwise(F.col("server_type")).alias("type"),
        _count("servers"),
        F.count_if(F.col("status") == "online").alias("online"),
        F.count_if(F.col("status") == "offline").alias("offline"),
        F.sum("total_logs").alias("logs"),
        F.sum("total_alerts").alias("alerts"),
        F.sum("active_alerts").alias("active_alerts"),
    ).select(
        F.col("type").alias("server_type"),
        "servers", "online", "offline", "logs", "alerts", "active_alerts",
    )


def server_breakdown(logs: DataFrame, alerts: DataFrame, servers: DataFrame) -> DataFrame:
    """Per server: logs by source, alerts by severity, open and resolved alerts."""
    sources = [*REPORTED_SOURCES, "zeek_conn"]
    per_log = logs.groupBy(F.col("server_id").alias("id")).agg(
        *[F.count_if(F.col("log_source") == s).alias(f"logs_{s}") for s in sources]
    )
    per_alert = alerts.groupBy(F.col("server_id").alias("id")).agg(
        *[F.count_if(F.col("severity") == s).alias(f"alerts_{s}") for s in SEVERITIES],
        F.count_if(F.col("resolved")).alias("resolved_alerts"),
        F.count_if(~F.col("resolved")).alias("active_alerts"),
    )
    joined = servers.select("id", "hostname").join(per_log, "id", "left").join(
        per_alert, "id", "left"
    )
    return joined.na.fill(0)


def server_recent_logs(logs: DataFrame, n: int = 20) -> DataFrame:
    """Newest logs of every server, previewed."""
    top = latest(logs, "server_id", [F.desc("recv_time"), F.desc("id")], n)
    return top.select(
        "server_id", F.col("_rank").alias("position"), "id", "log_source",
        preview(F.col("content"), 150).alias("content"), "recv_time",
    )


def server_recent_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    """Newest alerts of every server, previewed."""
    top = latest(alerts, "server_id", [F.desc("triggered_at"), F.desc("alert_id")], n)
    return top.select(
        "server_id", F.col("_rank").alias("position"), "alert_id", "title", "severity",
        preview(F.col("description"), 200).alias("description"), "resolved", "triggered_at",
    )


def latest_log_per_server(logs: DataFrame) -> DataFrame:
    """Most recent log of each server."""
    newest_first = F.struct("recv_time", "id")
    row = F.struct("id", "recv_time", "log_source", "content")
    return logs.groupBy("server_id").agg(F.max_by(row, newest_first).alias("r")).select(
        "server_id", "r.*"
    )


def threat_level(critical: Column, high: Column) -> Column:
    """Level of a number of critical and high alerts."""
    return (
        F.when(critical > 5, "critical")
        .when((critical > 0) | (high > 10), "high")
        .when(high > 0, "medium")
        .otherwise("low")
    )


def dashboard_overview(
    logs: DataFrame, servers: DataFrame, alerts: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """One row: totals, splits, the last hour, and the threat level."""
    now = newest(logs, "recv_time") if as_of is None else as_of
    hour_ago = now - F.expr("INTERVAL 1 HOUR")
    log_side = logs.agg(
        _count("logs_total"),
        *[F.count_if(F.col("log_source") == s).alias(f"logs_{s}") for s in REPORTED_SOURCES],
        F.count_if(F.col("recv_time") >= hour_ago).alias("logs_last_hour"),
    )
    alert_side = alerts.agg(
        F.struct(
            _count("alerts_total"),
            F.count_if(~F.col("resolved")).alias("alerts_active"),
            F.count_if(F.col("resolved")).alias("alerts_resolved"),
            *[F.count_if(F.col("severity") == s).alias(f"alerts_{s}") for s in SEVERITIES],
            F.count_if(F.col("triggered_at") >= hour_ago).alias("alerts_last_hour"),
        )
    )
    joined = log_side.select(
        "*",
        alert_side.scalar().alias("_a"),
        servers.agg(F.count("*")).scalar().alias("servers_total"),
    ).select("*", "_a.*")
    level = threat_level(F.col("alerts_critical"), F.col("alerts_high"))
    return joined.drop("_a").withColumn("threat_level", level)


def threat_levels(alerts: DataFrame) -> DataFrame:
    """Threat level over all alerts and over open alerts."""
    open_alert = ~F.col("resolved")
    counts = alerts.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if((F.col("severity") == "critical") & open_alert).alias("open_critical"),
        F.count_if((F.col("severity") == "high") & open_alert).alias("open_high"),
    )
    return counts.select(
        "*",
        threat_level(F.col("critical"), F.col("high")).alias("threat_level"),
        threat_level(F.col("open_critical"), F.col("open_high")).alias("open_threat_level"),
    )


def alert_stats(alerts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Total, by severity, by log type, resolved or not, and last hour, as measures."""
    now = newest(alerts, "triggered_at") if as_of is None else as_of
    recent = F.col("triggered_at") >= now - F.expr("INTERVAL 1 HOUR")
    groups = alerts.groupBy("severity", "log_source", "resolved").agg(
        _count("n"), F.count_if(recent).alias("recent")
    )
    state = F.when(F.col("resolved"), "acknowledged").otherwise("unacknowledged")
    measures = F.explode(
        F.array(
            F.struct(F.lit("total").alias("measure"), F.col("n").alias("n")),
            F.struct(F.concat(F.lit("severity_"), "severity").alias("measure"), F.col("n")),
            F.struct(F.concat(F.lit("type_"), "log_source").alias("measure"), F.col("n")),
            F.struct(state.alias("measure"), F.col("n")),
            F.struct(F.lit("last_hour").alias("measure"), F.col("recent").alias("n")),
        )
    ).alias("m")
    return groups.select(measures).groupBy(F.col("m.measure").alias("measure")).agg(
        F.sum("m.n").alias("alerts")
    )


def alerts_by_severity_ranked(alerts: DataFrame) -> DataFrame:
    """Alerts per severity, worst first."""
    rank = severity_rank(F.col("severity"))
    return alerts.groupBy("severity").agg(_count("alerts")).orderBy(rank, "severity")


def top_threats(alerts: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent (title, severity) pairs."""
    counts = alerts.groupBy("title", "severity").agg(_count("alerts"))
    return counts.orderBy(F.desc("alerts"), "title", "severity").limit(limit)


def affected_hosts(alerts: DataFrame, servers: DataFrame) -> DataFrame:
    """Per host: distinct alerts, greatest severity as text and by rank.

    The alert id is the key of an alert table, so rows are counted; they are counted per
    server before the names are joined.
    """
    rank = severity_rank(F.col("severity"))
    per_server = alerts.groupBy(F.col("server_id").alias("id")).agg(
        F.count("*").alias("alerts"),
        F.max("severity").alias("max_severity"),
        F.min(rank).alias("best"),
    )
    joined = per_server.join(servers.select("id", "hostname", "ip_address"), "id", "left")
    worst = F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("best") - 1)
    return joined.groupBy("hostname", "ip_address").agg(
        F.sum("alerts").alias("alerts"),
        F.max("max_severity").alias("max_severity"),
        F.min("best").alias("best"),
    ).select(
        "hostname", "ip_address", "alerts", "max_severity", worst.alias("worst_severity")
    ).orderBy(F.desc("alerts"), "hostname")


def alerts_by_server(alerts: DataFrame, servers: DataFrame) -> DataFrame:
    """Alerts per server, named ``ID:<id>`` where the server is unknown."""
    counts = alerts.groupBy("server_id").agg(_count("alerts"))
    named = counts.join(
        servers.select(F.col("id").alias("server_id"), "hostname"), "server_id", "left"
    )
    fallback = F.concat(F.lit("ID:"), F.col("server_id").cast("string"))
    return named.select(F.coalesce("hostname", fallback).alias("server"), "alerts")


def logs_timeseries(logs: DataFrame, hours: int = 24, as_of: Column | None = None) -> DataFrame:
    """Logs per hour and type in the last hours, newest first."""
    now = newest(logs, "recv_time") if as_of is None else as_of
    recent = since(logs, "recv_time", now - F.expr(f"INTERVAL {hours} HOURS"))
    hour = F.date_trunc("hour", "recv_time").alias("hour")
    return recent.groupBy(hour, "log_source").agg(_count("logs")).orderBy(
        F.desc("hour"), "log_source"
    )


def alert_timeline(alerts: DataFrame, hours: int = 24, as_of: Column | None = None) -> DataFrame:
    """Alerts per hour, one column per severity."""
    now = newest(alerts, "triggered_at") if as_of is None else as_of
    recent = since(alerts, "triggered_at", now - F.expr(f"INTERVAL {hours} HOURS"))
    hour = F.date_trunc("hour", "triggered_at").alias("hour")
    return recent.groupBy(hour).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def server_timeline(
    servers: DataFrame,
    logs: DataFrame,
    alerts: DataFrame,
    hours: int = 24,
    server_id: int | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Logs and alerts of every hour in range, zero where there are none.

    Without ``as_of`` the range ends in the hour of the newest log. Logs are counted by
    server and hour once; the counts, which are written, tell the newest hour.
    """
    if server_id is not None:
        servers = servers.where(F.col("id") == server_id)
        alerts = alerts.where(F.col("server_id") == server_id)
        logs = logs.where(F.col("server_id") == server_id) if as_of is not None else logs

    def per_hour(df: DataFrame, time: str, name: str) -> DataFrame:
        return df.groupBy("server_id", F.date_trunc("hour", time).alias("hour")).agg(_count(name))

    if as_of is None:
        logged = cut_lineage(logs.sparkSession, per_hour(logs, "recv_time", "logs"), "server-hours")
        last = F.lit(logged.agg(F.max("hour")).first()[0]).cast("timestamp")
    else:
        last = F.date_trunc("hour", as_of)
    first = last - F.expr(f"INTERVAL {hours - 1} HOURS")
    if as_of is not None:
        logged = per_hour(since(logs, "recv_time", first), "recv_time", "logs")
    zero = F.lit(0).cast("bigint")
    counts = (
        logged.withColumn("alerts", zero)
        .unionByName(per_hour(since(alerts, "triggered_at", first), "triggered_at", "alerts").withColumn("logs", zero))
        .where(F.col("hour") >= first)
        .groupBy("server_id", "hour")
        .agg(F.sum("logs").alias("logs"), F.sum("alerts").alias("alerts"))
    )
    every_hour = F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("hour")
    grid = servers.select(F.col("id").alias("server_id"), every_hour)
    return grid.join(counts, ["server_id", "hour"], "left").select(
        "server_id", "hour",
        F.coalesce("logs", zero).alias("logs"),
        F.coalesce("alerts", zero).alias("alerts"),
    ).orderBy("server_id", "hour")


def app_frequency(linux: DataFrame, limit: int = 5) -> DataFrame:
    """Most frequent programs."""
    counts = linux.where(F.col("app_name") != "").groupBy("app_name").agg(_count("events"))
    return counts.orderBy(F.desc("events"), "app_name").limit(limit)


def ssh_actions(linux: DataFrame) -> DataFrame:
    found = linux.where(F.col("ssh_action").isNotNull())
    return found.groupBy("ssh_action").agg(_count("events"))


def http_histograms(nginx: DataFrame) -> DataFrame:
    """Requests per method and per status, in one pass."""
    groups = nginx.groupBy("request_method", "status").agg(_count("n"))
    kinds = F.explode(
        F.array(
            F.struct(F.lit("method").alias("kind"), F.col("request_method").alias("name")),
            F.struct(F.lit("status").alias("kind"), F.col("status").cast("string").alias("name")),
        )
    ).alias("k")
    named = groups.select(kinds, "n").where(F.col("k.name").isNotNull())
    return named.groupBy(F.col("k.kind").alias("kind"), F.col("k.name").alias("name")).agg(
        F.sum("n").alias("requests")
    )


def source_activity(
    logs: DataFrame,
    servers: DataFrame,
    as_of: Column | None = None,
    online: int = 5,
    delayed: int = 30,
) -> DataFrame:
    """Per source: events of the last minute, all events, last time and status."""
    now = newest(logs, "recv_time") if as_of is None else as_of
    minute_ago = now - F.expr("INTERVAL 1 MINUTE")
    counts = logs.groupBy("server_id").agg(
        F.count_if(F.col("recv_time") > minute_ago).alias("events_per_minute"),
        _count("total_events"),
        F.max("recv_time").alias("last_seen"),
    )
    named = counts.join(
        servers.select(F.col("id").alias("server_id"), "hostname", "ip_address", "server_type"),
        "server_id",
    )
    status = age_status(F.col("last_seen"), now, [("online", online), ("delayed", delayed)])
    return named.select(
        F.col("server_id").alias("source_id"), "hostname", "ip_address",
        F.col("server_type").alias("source_type"),
        "events_per_minute", "total_events", "last_seen",
        F.lit(0).alias("risk_score"), status.alias("status"),
    )


def source_share(logs: DataFrame) -> DataFrame:
    """Whole percent of logs per source."""
    counts = logs.groupBy("log_source").agg(_count("logs"))
    total = counts.agg(F.sum("logs")).scalar()
    share = F.floor(F.col("logs") * 100 / total).cast("bigint")
    return counts.withColumn("percent", share)


def parse_coverage(logs: DataFrame) -> DataFrame:
    """Parsed and total logs per type and overall, with the health of the parser.

    Logs are read and parsed once; the overall row is a level of the same aggregate.
    """
    view = parsed_view(logs)
    parsed = F.col("linux").isNotNull() | F.col("nginx").isNotNull() | F.col("windows").isNotNull()
    counts = view.select("log_source", parsed.alias("parsed")).rollup("log_source").agg(
        F.grouping("log_source").alias("whole"),
        F.count_if("parsed").alias("parsed"),
        _count("total"),
    )
    return coverage_report(counts)


def coverage_report(counts: DataFrame) -> DataFrame:
    """Rate and health of (log_source, whole, parsed, total), where ``whole`` marks the overall row."""
    named = F.when(F.col("whole") == 1, F.lit("all")).otherwise(F.col("log_source"))
    rate = F.when(
        F.col("total") > 0, F.floor(F.col("parsed") * 100 / F.col("total")).cast("bigint")
    ).otherwise(F.lit(0).cast("bigint"))
    health = (
        F.when(F.col("rate") > 80, "Good")
        .when(F.col("rate") > 50, "Needs Attention")
        .otherwise("Poor")
    )
    told = counts.select(
        named.alias("log_source"), F.coalesce("parsed", F.lit(0)).alias("parsed"), F.coalesce("total", F.lit(0)).alias("total")
    )
    return told.withColumn("rate", rate).withColumn("health", health)


def detection_rate(logs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts per hundred logs, whole number."""
    total_logs = logs.agg(_count("logs"))
    counts = total_logs.withColumn("alerts", alerts.agg(F.count("*")).scalar())
    rate = F.when(
        F.col("logs") > 0, F.floor(F.col("alerts") * 100 / F.col("logs")).cast("bigint")
    )
    return counts.withColumn("percent", rate)


SERVER_KEY = ["hostname", "ip_address", "server_type"]


def sightings(records: DataFrame) -> DataFrame:
    """Servers named by ``records`` with the first and last time they were seen there.

    The id is a hash of (hostname, ip, type), so every run gives the same one.
    """
    return records.groupBy(*SERVER_KEY).agg(
        F.min("recv_time").alias("first_seen"), F.max("recv_time").alias("last_seen")
    ).select(F.xxhash64(*SERVER_KEY).alias("id"), *SERVER_KEY, "first_seen", "last_seen")


def registry(seen: DataFrame) -> DataFrame:
    """One row a server from ``sightings`` of any number of batches."""
    return seen.groupBy("id", *SERVER_KEY).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def register_servers(records: DataFrame, known: DataFrame) -> DataFrame:
    """``sightings`` of ``records``, and whether the registry does not hold the server yet."""
    held = known.select(*SERVER_KEY).distinct().withColumn("_held", F.lit(True))
    return sightings(records).join(held, SERVER_KEY, "left").select(
        "id", *SERVER_KEY, "first_seen", "last_seen", F.col("_held").isNull().alias("is_new")
    )
