"""Filters, searches and drill-downs over logs, servers and alerts.

Pages are cut before anything is joined to them: the ordered limit is a top-N per
task, and only the rows of the page meet the other tables. ``as_of`` stands for
"now"; left out, it is the newest time in the data, read by a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.text import blank_to_null, preview


def newest(df: DataFrame, time: str) -> Column:
    """The newest time of a table, as a scalar."""
    return df.agg(F.max(time)).scalar()


def since(df: DataFrame, time: str, start: Column | str) -> DataFrame:
    """Rows from ``start`` on; a ``day`` partition column is filtered too, if there is one."""
    start = F.lit(start) if isinstance(start, str) else start
    found = df.where(F.col(time) >= start)
    return found.where(F.col("day") >= F.to_date(start)) if "day" in df.columns else found


def page(df: DataFrame, time: str, limit: int | None, offset: int = 0) -> DataFrame:
    """Newest rows first, ties by id."""
    ordered = df.orderBy(F.desc(time), F.desc("id"))
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def newest_first(df: DataFrame, time: str, key: str = "id") -> DataFrame:
    """The order of ``page`` again, for rows of a page that were joined since."""
    return df.orderBy(F.desc(time), F.desc(key))


def _server_names(servers: DataFrame) -> DataFrame:
    return servers.select(F.col("id").alias("server_id"), "hostname", "ip_address")


def recent_logs(
    logs: DataFrame,
    servers: DataFrame,
    limit: int | None = 50,
    offset: int = 0,
    log_type: str | None = None,
    server_id: int | None = None,
    start_time: Column | str | None = None,
    end_time: Column | str | None = None,
) -> DataFrame:
    """Newest logs with their server, optionally of one type, server or period."""
    found = logs
    if log_type is not None:
        found = found.where(F.col("log_source") == log_type)
    if server_id is not None:
        found = found.where(F.col("server_id") == server_id)
    if start_time is not None:
        found = since(found, "recv_time", start_time)
    if end_time is not None:
        found = found.where(F.col("recv_time") <= end_time)
    rows = page(found, "recv_time", limit, offset)
    return newest_first(rows.join(_server_names(servers), "server_id", "left"), "recv_time")


def search_logs(
    logs: DataFrame,
    servers: DataFrame,
    text: str | None = None,
    log_type: str | None = None,
    hostname: str | None = None,
    limit: int | None = 50,
    offset: int = 0,
) -> DataFrame:
    """Newest logs whose text contains ``text``; ``%`` and ``_`` act as wildcards."""
    found = logs
    if text:
        found = found.where(F.col("content").ilike(f"%{text}%"))
    if log_type is not None:
        found = found.where(F.col("log_source") == log_type)
    if hostname is not None:
        named = servers.where(F.col("hostname") == hostname)
        found = found.join(named.select(F.col("id").alias("server_id")), "server_id", "left_semi")
    rows = page(found, "recv_time", limit, offset)
    return newest_first(rows.join(_server_names(servers), "server_id", "left"), "recv_time")


def search_servers(
    stats: DataFrame,
    search: str | None = None,
    server_type: str | None = None,
    status: str | None = None,
    limit: int | None = 50,
    offset: int = 0,
) -> DataFrame:
    """Servers of ``stats.server_stats`` by name or address, type and status."""
    found = stats
    if search:
        like = f"%{search}%"
        found = found.where(F.col("hostname").ilike(like) | F.col("ip_address").ilike(like))
    if server_type is not None:
        found = found.where(F.col("server_type") == server_type.lower())
    if status is not None:
        found = found.where(F.col("status") == status.lower())
    ordered = found.orderBy("id").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def filter_alerts(
    alerts: DataFrame,
    severity: str | None = None,
    resolved: bool | None = None,
    server_id: int | None = None,
    hours: int | None = None,
    as_of: Column | None = None,
    limit: int | None = 50,
    offset: int = 0,
) -> DataFrame:
    """Newest alerts that satisfy the filters, with their total number."""
    found = alerts
    if severity is not None:
        found = found.where(F.col("severity") == severity)
    if resolved is not None:
        found = found.where(F.col("resolved") == resolved)
    if server_id is not None:
        found = found.where(F.col("server_id") == server_id)
    if hours is not None:
        now = newest(alerts, "triggered_at") if as_of is None else as_of
        found = since(found, "triggered_at", now - F.expr(f"INTERVAL {hours} HOURS"))
    total = found.agg(F.count("*")).scalar()
    ordered = found.orderBy(F.desc("triggered_at"), F.desc("alert_id")).offset(offset)
    paged = ordered if limit is None else ordered.limit(limit)
    return paged.withColumn("total", total)


def logs_last_hours(
    logs: DataFrame,
    hours: int,
    server_id: int | None = None,
    log_source: str | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Logs of the last hours, of one server or of every server."""
    now = newest(logs, "recv_time") if as_of is None else as_of
    found = since(logs, "recv_time", now - F.expr(f"INTERVAL {hours} HOURS"))
    if server_id is not None:
        found = found.where(F.col("server_id") == server_id)
    if log_source is not None:
        found = found.where(F.col("log_source") == log_source)
    return found


def unparsed_backlog(logs: DataFrame, details: DataFrame, log_source: str) -> DataFrame:
    """Logs of a type that have no detail row yet."""
    return logs.where(F.col("log_source") == log_source).join(
        details.select(F.col("log_entry_id").alias("id")), "id", "left_anti"
    )


def incremental_fetch(
    logs: DataFrame, servers: DataFrame, last_id: int, limit: int | None = 100
) -> DataFrame:
    """Logs after a checkpoint id, in id order, with their server."""
    ordered = logs.where(F.col("id") > last_id).orderBy("id")
    batch = ordered if limit is None else ordered.limit(limit)
    return batch.join(_server_names(servers), "server_id", "left").orderBy("id")


def log_detail(
    logs: DataFrame,
    servers: DataFrame,
    linux: DataFrame,
    windows: DataFrame,
    nginx: DataFrame,
    log_id: int | None = None,
) -> DataFrame:
    """Logs with server and the detail row of their type, each detail one struct."""

    def one(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c != "log_entry_id"]
        return df.select(F.col("log_entry_id").alias("id"), F.struct(*fields).alias(name))

    found = logs if log_id is None else logs.where(F.col("id") == log_id)
    return (
        found.join(one(linux, "linux"), "id", "left")
        .join(one(windows, "windows"), "id", "left")
        .join(one(nginx, "nginx"), "id", "left")
        .join(_server_names(servers), "server_id", "left")
    )


def alerts_for_log(alerts: DataFrame, log_id: int | None = None) -> DataFrame:
    """Alerts of one log, or of every log, newest first within a log."""
    found = alerts if log_id is None else alerts.where(F.col("log_entry_id") == log_id)
    return found.orderBy("log_entry_id", F.desc("triggered_at"), "alert_id")


def nginx_errors(nginx: DataFrame) -> DataFrame:
    return nginx.where(F.col("status") >= 400)


def requests_by_ip(nginx: DataFrame, address: str) -> DataFrame:
    return nginx.where(F.col("remote_addr") == address)


def ssh_events(linux: DataFrame) -> DataFrame:
    return linux.where(F.col("ssh_action").isNotNull())


def windows_events_by_id(windows: DataFrame, event_id: int) -> DataFrame:
    attrs = F.col("attrs")
    found = F.coalesce(attrs["EventID"], attrs["event_id"])
    return windows.where(found == str(event_id))


def critical_open_alerts(alerts: DataFrame, limit: int | None = 50) -> DataFrame:
    found = alerts.where((F.col("severity") == "critical") & ~F.col("resolved"))
    ordered = found.orderBy(F.desc("triggered_at"), F.desc("alert_id"))
    return ordered if limit is None else ordered.limit(limit)


def alert_detail(
    alerts: DataFrame, servers: DataFrame, logs: DataFrame, alert_id: str | None = None
) -> DataFrame:
    """Alerts with their server and log."""
    found = alerts if alert_id is None else alerts.where(F.col("alert_id") == alert_id)
    log = logs.select(F.col("id").alias("log_entry_id"), "content", "recv_time")
    return found.join(log, "log_entry_id", "left").join(
        _server_names(servers), "server_id", "left"
    )


# ---- joins -------------------------------------------------------------------
# Servers are few and logs many. No side is forced to be broadcast: the planner
# does it below its size limit, and beyond it the adaptive skew join splits the
# logs of a server that holds very many of them.

def logs_with_server(logs: DataFrame, servers: DataFrame, how: str = "left") -> DataFrame:
    return logs.join(_server_names(servers), "server_id", how)


def alerts_server_log(alerts: DataFrame, servers: DataFrame, logs: DataFrame) -> DataFrame:
    log = logs.select(F.col("id").alias("log_entry_id"), "content", "recv_time")
    return alerts.join(_server_names(servers), "server_id").join(log, "log_entry_id")


def alerts_left_server(alerts: DataFrame, servers: DataFrame) -> DataFrame:
    joined = alerts.join(_server_names(servers), "server_id", "left")
    return joined.withColumn("hostname", F.coalesce("hostname", F.lit("Unknown")))


def connections_with_log(
    conns: DataFrame, logs: DataFrame, limit: int | None = 50, offset: int = 0
) -> DataFrame:
    """Connections with the log they came from, newest first."""
    log = logs.where(F.col("log_source") == "zeek_conn").select("id", "server_id", "recv_time")
    joined = conns.withColumnRenamed("log_entry_id", "id").join(log, "id")
    return page(joined, "ts", limit, offset)


def host_event_feed(
    logs: DataFrame, servers: DataFrame, windows: DataFrame, linux: DataFrame, last_id: int = 0
) -> DataFrame:
    """Host, time and content of Windows and Linux events after an id."""
    host = F.lower(F.trim("hostname"))
    events = logs.where((F.col("id") > last_id) & F.col("log_source").isin("windows", "linux"))
    named = events.select("id", "server_id", "recv_time", "log_source").join(
        servers.select(F.col("id").alias("server_id"), host.alias("host")), "server_id"
    )
    win = windows.select(F.col("log_entry_id").alias("id"), F.col("content").alias("win_data"))
    lin = linux.select(F.col("log_entry_id").alias("id"), F.col("raw_message").alias("lin_data"))
    joined = named.join(win, "id", "left").join(lin, "id", "left")
    content = F.when(F.col("log_source") == "windows", F.col("win_data")).otherwise(
        F.col("lin_data")
    )
    fed = joined.select("id", "host", "recv_time", "log_source", content.alias("content"))
    return fed.where(blank_to_null(F.col("content")).isNotNull())


def alert_report(
    alerts: DataFrame, logs: DataFrame, servers: DataFrame, limit: int | None = 20
) -> DataFrame:
    """Newest alerts with log type, host and the start of the raw line."""
    ordered = alerts.orderBy(F.desc("triggered_at"), F.desc("alert_id"))
    top = ordered if limit is None else ordered.limit(limit)
    log = logs.select(
        F.col("id").alias("log_entry_id"), F.substring("content", 1, 60).alias("preview")
    )
    joined = top.join(log, "log_entry_id").join(_server_names(servers), "server_id", "left")
    named = joined.withColumn("hostname", F.coalesce("hostname", F.lit("Unknown")))
    return newest_first(named, "triggered_at", "alert_id")


def log_previews(rows: DataFrame, text: str, length: int) -> DataFrame:
    return rows.withColumn(text, preview(F.col(text), length))
