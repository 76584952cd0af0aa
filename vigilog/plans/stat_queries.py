"""Queries of counts, rankings and time series."""

from __future__ import annotations

from vigilog.operators import ingest, stats
from vigilog.plans.catalog import query, sql_time
from vigilog.plans.fixtures import Tables
from vigilog.plans.lookup_queries import STATS_SQL

NOW = "(SELECT max(recv_time) FROM log_entry)"
ALERT_NOW = "(SELECT max(triggered_at) FROM alert)"


@query(
    "log_totals",
    sql="""
SELECT 'logs_' || log_source AS measure, count(*) AS total FROM log_entry GROUP BY log_source
UNION ALL SELECT 'logs', count(*) FROM log_entry
UNION ALL SELECT 'servers', count(*) FROM server
UNION ALL SELECT 'alerts', count(*) FROM alert""",
)
def log_totals(t: Tables):
    return stats.log_totals(t.logs, t.servers, t.alerts)


@query(
    "server_activity",
    sql=f"""
SELECT s.id, s.hostname, s.ip_address, count(l.id) AS log_count,
  {sql_time("min(l.recv_time)")} AS first_seen, {sql_time("max(l.recv_time)")} AS last_seen,
  CASE WHEN {NOW} - max(l.recv_time) < INTERVAL 5 MINUTE THEN 'online'
    WHEN {NOW} - max(l.recv_time) < INTERVAL 1 HOUR THEN 'delayed' ELSE 'offline' END AS status
FROM server s LEFT JOIN log_entry l ON l.server_id = s.id
GROUP BY s.id, s.hostname, s.ip_address""",
)
def server_activity(t: Tables):
    return stats.server_activity(t.servers, t.logs)


@query(
    "server_stats",
    sql=f"SELECT * REPLACE ({sql_time('last_seen')} AS last_seen) FROM ({STATS_SQL})",
)
def server_stats(t: Tables):
    return stats.server_stats(t.servers, t.logs, t.alerts)


@query(
    "fleet_summary",
    sql=f"""
SELECT coalesce(server_type, 'all') AS server_type, count(*) AS servers,
  count(*) FILTER (WHERE status = 'online') AS online,
  count(*) FILTER (WHERE status = 'offline') AS offline,
  CAST(sum(total_logs) AS BIGINT) AS logs, CAST(sum(total_alerts) AS BIGINT) AS alerts,
  CAST(sum(active_alerts) AS BIGINT) AS active_alerts
FROM ({STATS_SQL}) GROUP BY ROLLUP (server_type)""",
)
def fleet_summary(t: Tables):
    return stats.fleet_summary(t.servers, t.logs, t.alerts)


def _filters(column: str, names: list[str], prefix: str, where: str = "") -> str:
    return ", ".join(
        f"coalesce(count(*) FILTER (WHERE {column} = '{n}'{where}), 0) AS {prefix}{n}"
        for n in names
    )


ALL_SOURCES = [*stats.REPORTED_SOURCES, "zeek_conn"]


@query(
    "server_breakdown",
    sql=f"""
WITH per_log AS (SELECT server_id, {_filters("log_source", ALL_SOURCES, "logs_")}
  FROM log_entry GROUP BY server_id),
per_alert AS (SELECT server_id, {_filters("severity", stats.SEVERITIES, "alerts_")},
  count(*) FILTER (WHERE resolved) AS resolved_alerts,
  count(*) FILTER (WHERE NOT resolved) AS active_alerts FROM alert GROUP BY server_id)
SELECT s.id, s.hostname, {", ".join(f"coalesce(l.logs_{n}, 0) AS logs_{n}" for n in ALL_SOURCES)},
  {", ".join(f"coalesce(a.alerts_{n}, 0) AS alerts_{n}" for n in stats.SEVERITIES)},
  coalesce(a.resolved_alerts, 0) AS resolved_alerts,
  coalesce(a.active_alerts, 0) AS active_alerts
FROM server s LEFT JOIN per_log l ON l.server_id = s.id
LEFT JOIN per_alert a ON a.server_id = s.id""",
)
def server_breakdown(t: Tables):
    return stats.server_breakdown(t.logs, t.alerts, t.servers)


@query(
    "server_recent_activity",
    sql=f"""
SELECT server_id, 'log' AS kind, CAST(rn AS INTEGER) AS position, CAST(id AS VARCHAR) AS id,
  CASE WHEN length(content) > 150 THEN substr(content, 1, 150) || '...' ELSE content END AS text,
  {sql_time("recv_time")} AS at
FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY recv_time DESC, id DESC) AS rn
      FROM log_entry) WHERE rn <= 20
UNION ALL
SELECT server_id, 'alert', CAST(rn AS INTEGER), alert_id, title, {sql_time("triggered_at")}
FROM (SELECT *, row_number() OVER (PARTITION BY server_id
        ORDER BY triggered_at DESC, alert_id DESC) AS rn FROM alert) WHERE rn <= 10""",
)
def server_recent_activity(t: Tables):
    logs = stats.server_recent_logs(t.logs).selectExpr(
        "server_id", "'log' AS kind", "position", "CAST(id AS STRING) AS id", "content AS text",
        "recv_time AS at",
    )
    alerts = stats.server_recent_alerts(t.alerts).selectExpr(
        "server_id", "'alert' AS kind", "position", "alert_id AS id", "title AS text",
        "triggered_at AS at",
    )
    return logs.unionByName(alerts)


@query(
    "latest_log_per_server",
    sql=f"""
SELECT server_id, id, {sql_time("recv_time")} AS recv_time, log_source, content FROM log_entry
QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY recv_time DESC, id DESC) = 1""",
)
def latest_log_per_server(t: Tables):
    return stats.latest_log_per_server(t.logs)


LEVEL = """CASE WHEN {c} > 5 THEN 'critical' WHEN {c} > 0 OR {h} > 10 THEN 'high'
  WHEN {h} > 0 THEN 'medium' ELSE 'low' END"""


@query(
    "dashboard_overview",
    sql=f"""
SELECT *, {LEVEL.format(c="alerts_critical", h="alerts_high")} AS threat_level FROM (
 SELECT * FROM (SELECT count(*) AS logs_total,
   {_filters("log_source", stats.REPORTED_SOURCES, "logs_")},
   count(*) FILTER (WHERE recv_time >= {NOW} - INTERVAL 1 HOUR) AS logs_last_hour FROM log_entry),
 (SELECT count(*) AS alerts_total, count(*) FILTER (WHERE NOT resolved) AS alerts_active,
   count(*) FILTER (WHERE resolved) AS alerts_resolved,
   {_filters("severity", stats.SEVERITIES, "alerts_")},
   count(*) FILTER (WHERE triggered_at >= {NOW} - INTERVAL 1 HOUR) AS alerts_last_hour
   FROM alert),
 (SELECT count(*) AS servers_total FROM server))""",
)
def dashboard_overview(t: Tables):
    return stats.dashboard_overview(t.logs, t.servers, t.alerts)


@query(
    "threat_level",
    sql=f"""
SELECT *, {LEVEL.format(c="critical", h="high")} AS threat_level,
  {LEVEL.format(c="open_critical", h="open_high")} AS open_threat_level
FROM (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'critical' AND NOT resolved) AS open_critical,
  count(*) FILTER (WHERE severity = 'high' AND NOT resolved) AS open_high FROM alert)""",
)
def threat_level(t: Tables):
    return stats.threat_levels(t.alerts)


@query(
    "alert_stats",
    sql=f"""
SELECT 'total' AS measure, count(*) AS alerts FROM alert
UNION ALL SELECT 'severity_' || severity, count(*) FROM alert GROUP BY severity
UNION ALL SELECT 'type_' || log_source, count(*) FROM alert GROUP BY log_source
UNION ALL SELECT CASE WHEN resolved THEN 'acknowledged' ELSE 'unacknowledged' END, count(*)
  FROM alert GROUP BY resolved
UNION ALL SELECT 'last_hour', count(*) FILTER (
  WHERE triggered_at >= {ALERT_NOW} - INTERVAL 1 HOUR) FROM alert""",
)
def alert_stats(t: Tables):
    return stats.alert_stats(t.alerts)


@query(
    "alerts_by_severity_ranked",
    sql="SELECT severity, count(*) AS alerts FROM alert GROUP BY severity",
)
def alerts_by_severity_ranked(t: Tables):
    return stats.alerts_by_severity_ranked(t.alerts)


@query(
    "top_threats",
    sql="""
SELECT title, severity, count(*) AS alerts FROM alert GROUP BY title, severity
ORDER BY alerts DESC, title, severity LIMIT 10""",
)
def top_threats(t: Tables):
    return stats.top_threats(t.alerts)


@query(
    "affected_hosts",
    sql="""
SELECT s.hostname, s.ip_address, count(DISTINCT a.alert_id) AS alerts,
  max(a.severity) AS max_severity, (['critical', 'high', 'medium', 'low'])[min(
    CASE a.severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END)]
    AS worst_severity
FROM alert a JOIN log_entry l ON l.id = a.log_entry_id LEFT JOIN server s ON s.id = l.server_id
GROUP BY s.hostname, s.ip_address""",
)
def affected_hosts(t: Tables):
    return stats.affected_hosts(t.alerts, t.servers)


@query(
    "alerts_by_server",
    sql="""
SELECT coalesce(s.hostname, 'ID:' || a.server_id) AS server, count(*) AS alerts
FROM foreign_alert a LEFT JOIN server s ON s.id = a.server_id
GROUP BY a.server_id, s.hostname""",
)
def alerts_by_server(t: Tables):
    return stats.alerts_by_server(t.foreign_alerts, t.servers)


@query(
    "logs_timeseries",
    sql=f"""
SELECT {sql_time("date_trunc('hour', recv_time)")} AS hour, log_source, count(*) AS logs
FROM log_entry WHERE recv_time >= {NOW} - INTERVAL 240 HOUR GROUP BY ALL""",
)
def logs_timeseries(t: Tables):
    return stats.logs_timeseries(t.logs, hours=240)


@query(
    "alert_timeline",
    sql=f"""
SELECT {sql_time("date_trunc('hour', triggered_at)")} AS hour,
  {_filters("severity", stats.SEVERITIES, "")}
FROM alert WHERE triggered_at >= {ALERT_NOW} - INTERVAL 240 HOUR GROUP BY 1""",
)
def alert_timeline(t: Tables):
    return stats.alert_timeline(t.alerts, hours=240)


@query(
    "server_timeline",
    sql=f"""
WITH grid AS (SELECT s.id AS server_id, unnest(generate_series(
    date_trunc('hour', {NOW}) - INTERVAL 23 HOUR, date_trunc('hour', {NOW}), INTERVAL 1 HOUR))
    AS hour FROM server s),
lc AS (SELECT server_id, date_trunc('hour', recv_time) AS hour, count(*) AS n FROM log_entry
  GROUP BY ALL),
ac AS (SELECT server_id, date_trunc('hour', triggered_at) AS hour, count(*) AS n FROM alert
  GROUP BY ALL)
SELECT g.server_id, {sql_time("g.hour")} AS hour, coalesce(lc.n, 0) AS logs,
  coalesce(ac.n, 0) AS alerts
FROM grid g LEFT JOIN lc ON lc.server_id = g.server_id AND lc.hour = g.hour
LEFT JOIN ac ON ac.server_id = g.server_id AND ac.hour = g.hour""",
)
def server_timeline(t: Tables):
    return stats.server_timeline(t.servers, t.logs, t.alerts, hours=24)


@query(
    "app_frequency",
    sql="""
SELECT app_name, count(*) AS events FROM linux_d WHERE app_name <> '' GROUP BY app_name
ORDER BY events DESC, app_name LIMIT 5""",
)
def app_frequency(t: Tables):
    return stats.app_frequency(t.linux)


@query(
    "ssh_action_counts",
    sql="""
SELECT ssh_action, count(*) AS events FROM linux_d WHERE ssh_action IS NOT NULL
GROUP BY ssh_action""",
)
def ssh_action_counts(t: Tables):
    return stats.ssh_actions(t.linux)


@query(
    "http_histograms",
    sql="""
SELECT 'method' AS kind, request_method AS name, count(*) AS requests FROM nginx_d GROUP BY 2
UNION ALL SELECT 'status', CAST(status AS VARCHAR), count(*) FROM nginx_d GROUP BY 2""",
)
def http_histograms(t: Tables):
    return stats.http_histograms(t.nginx)


@query(
    "source_activity",
    sql=f"""
SELECT s.id AS source_id, s.hostname, s.ip_address, s.server_type AS source_type,
  count(*) FILTER (WHERE l.recv_time > {NOW} - INTERVAL 1 MINUTE) AS events_per_minute,
  count(*) AS total_events, {sql_time("max(l.recv_time)")} AS last_seen, 0 AS risk_score,
  CASE WHEN {NOW} - max(l.recv_time) < INTERVAL 5 MINUTE THEN 'online'
    WHEN {NOW} - max(l.recv_time) < INTERVAL 1 DAY THEN 'delayed' ELSE 'offline' END AS status
FROM log_entry l JOIN server s ON s.id = l.server_id
GROUP BY s.id, s.hostname, s.ip_address, s.server_type""",
)
def source_activity(t: Tables):
    return stats.source_activity(t.logs, t.servers, online=300, delayed=86400)


@query(
    "source_share",
    sql="""
SELECT log_source, count(*) AS logs,
  CAST(count(*) * 100 // (SELECT count(*) FROM log_entry) AS BIGINT) AS percent
FROM log_entry GROUP BY log_source""",
)
def source_share(t: Tables):
    return stats.source_share(t.logs)


@query(
    "parse_coverage",
    sql="""
WITH c AS (
 SELECT log_source, count(*) AS total, CASE log_source
   WHEN 'linux' THEN (SELECT count(*) FROM linux_d) WHEN 'nginx' THEN (SELECT count(*) FROM nginx_d)
   WHEN 'windows' THEN (SELECT count(*) FROM windows_d) ELSE 0 END AS parsed
 FROM log_entry GROUP BY log_source),
d AS (SELECT log_source, parsed, total FROM c
  UNION ALL SELECT 'all', CAST(sum(parsed) AS BIGINT), CAST(sum(total) AS BIGINT) FROM c)
SELECT log_source, parsed, total, CAST(parsed * 100 // total AS BIGINT) AS rate,
  CASE WHEN parsed * 100 // total > 80 THEN 'Good' WHEN parsed * 100 // total > 50
    THEN 'Needs Attention' ELSE 'Poor' END AS health FROM d""",
)
def parse_coverage(t: Tables):
    return stats.parse_coverage(t.logs)


@query(
    "detection_rate",
    sql="""
SELECT logs, alerts, CAST(alerts * 100 // logs AS BIGINT) AS percent
FROM (SELECT (SELECT count(*) FROM log_entry) AS logs, (SELECT count(*) FROM alert) AS alerts)""",
)
def detection_rate(t: Tables):
    return stats.detection_rate(t.logs, t.alerts)


@query(
    "ingest_counters",
    sql="""
SELECT count(*) AS received, count(log_type) AS parsed, count(log_type) AS saved,
  count(*) - count(log_type) AS errors, CAST(ceil(count(log_type) / 100.0) AS BIGINT) AS batches
FROM typed_line""",
)
def ingest_counters(t: Tables):
    return ingest.ingest_counters(t.raw_lines)
