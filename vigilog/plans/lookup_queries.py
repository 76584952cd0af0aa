"""Queries of filters, searches, drill-downs and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.operators import ingest, lookups, stats, text_index
from vigilog.plans.catalog import ORACLES, query, sql_time
from vigilog.plans.fixtures import Tables
from vigilog.rules import pack
from vigilog.session import cut_lineage, shared_dir

RECV = sql_time("l.recv_time")
TRIGGERED = sql_time("a.triggered_at")


@query(
    "failed_ssh_by_source",
    sql="""
SELECT ssh_ip, count(*) AS failures, count(DISTINCT ssh_user) AS users FROM linux_d
WHERE ssh_action = 'Failed' GROUP BY ssh_ip""",
)
def failed_ssh_by_source(t: Tables):
    failed = lookups.ssh_events(t.linux).where(F.col("ssh_action") == "Failed")
    return failed.groupBy("ssh_ip").agg(
        F.count("*").alias("failures"), F.countDistinct("ssh_user").alias("users")
    )


@query(
    "recent_logs",
    sql=f"""
SELECT l.id, {RECV} AS recv_time, l.log_source, l.content, l.server_id, s.hostname, s.ip_address
FROM (SELECT * FROM log_entry WHERE log_source = 'nginx'
      AND recv_time >= TIMESTAMP '2024-01-05 00:00:00'
      ORDER BY recv_time DESC, id DESC LIMIT 50 OFFSET 25) l
LEFT JOIN server s ON s.id = l.server_id""",
)
def recent_logs(t: Tables):
    start = F.lit("2024-01-05 00:00:00").cast("timestamp")
    return lookups.recent_logs(
        t.logs, t.servers, limit=50, offset=25, log_type="nginx", start_time=start
    )


@query(
    "search_logs",
    sql=f"""
SELECT l.id, {RECV} AS recv_time, l.log_source, l.content, l.server_id, s.hostname, s.ip_address
FROM (SELECT * FROM log_entry WHERE content ILIKE '%failed password%'
      ORDER BY recv_time DESC, id DESC LIMIT 100) l
LEFT JOIN server s ON s.id = l.server_id""",
)
def search_logs(t: Tables):
    return lookups.search_logs(t.logs, t.servers, text="Failed Password", limit=100)


# The logs lie in one file for each server; files without the text are not read.
@query("search_indexed_logs")
def search_indexed_logs(t: Tables):
    path = shared_dir(t.spark, "searched")
    t.logs.repartition("server_id").write.partitionBy("log_source").parquet(path)
    schema = "id bigint, server_id bigint, recv_time timestamp, content string, log_source string"
    index = cut_lineage(t.spark, text_index.index_files(t.spark.read.schema(schema).parquet(path)), "text-index")
    found = text_index.read_matching(t.spark, index, "Failed Password", schema, path)
    return lookups.search_logs(found, t.servers, limit=100)


ORACLES["search_indexed_logs"] = ORACLES["search_logs"]


STATS_SQL = """
SELECT s.id, s.hostname, s.ip_address, s.server_type, coalesce(l.n, 0) AS total_logs,
  coalesce(a.n, 0) AS total_alerts, coalesce(a.open, 0) AS active_alerts, l.last AS last_seen,
  CASE WHEN l.last >= (SELECT max(recv_time) FROM log_entry) - INTERVAL 5 MINUTE THEN 'online'
    ELSE 'offline' END AS status
FROM server s
LEFT JOIN (SELECT server_id, count(*) AS n, max(recv_time) AS last FROM log_entry
           GROUP BY server_id) l ON l.server_id = s.id
LEFT JOIN (SELECT server_id, count(*) AS n, count(*) FILTER (WHERE NOT resolved) AS open
           FROM alert GROUP BY server_id) a ON a.server_id = s.id"""


@query(
    "search_servers",
    sql=f"""
SELECT * REPLACE ({sql_time("last_seen")} AS last_seen) FROM ({STATS_SQL})
WHERE (hostname ILIKE '%0000001%' OR ip_address ILIKE '%0000001%')
  AND server_type = 'linux' AND status = 'offline' ORDER BY id LIMIT 50""",
)
def search_servers(t: Tables):
    found = stats.server_stats(t.servers, t.logs, t.alerts)
    return lookups.search_servers(
        found, search="0000001", server_type="Linux", status="offline"
    )


ALERT_COLUMNS = f"""a.alert_id, a.log_entry_id, a.server_id, a.log_source, a.rule_id, a.severity,
  a.title, a.description, {TRIGGERED} AS triggered_at, a.resolved"""


@query(
    "filter_alerts",
    sql=f"""
WITH found AS (SELECT * FROM alert WHERE severity = 'high' AND NOT resolved
  AND triggered_at >= (SELECT max(triggered_at) FROM alert) - INTERVAL 72 HOUR)
SELECT {ALERT_COLUMNS}, (SELECT count(*) FROM found) AS total
FROM (SELECT * FROM found ORDER BY triggered_at DESC, alert_id DESC LIMIT 50 OFFSET 10) a""",
)
def filter_alerts(t: Tables):
    return lookups.filter_alerts(
        t.alerts, severity="high", resolved=False, hours=72, limit=50, offset=10
    )


@query(
    "logs_last_hours",
    sql=f"""
SELECT l.id, l.server_id, {RECV} AS recv_time, l.log_source, l.content FROM log_entry l
WHERE recv_time >= (SELECT max(recv_time) FROM log_entry) - INTERVAL 24 HOUR""",
)
def logs_last_hours(t: Tables):
    return lookups.logs_last_hours(t.logs, hours=24)


@query(
    "unparsed_backlog",
    sql=f"""
SELECT l.id, l.server_id, {RECV} AS recv_time, l.log_source, l.content FROM log_entry l
WHERE log_source = 'linux' AND NOT EXISTS (SELECT 1 FROM linux_d d
  WHERE d.log_entry_id = l.id AND d.app_name <> 'sudo')""",
)
def unparsed_backlog(t: Tables):
    parsed = t.linux.where(F.col("app_name") != "sudo")
    return lookups.unparsed_backlog(t.logs, parsed, "linux")


@query(
    "incremental_fetch",
    sql=f"""
SELECT l.id, {RECV} AS recv_time, l.log_source, l.content, l.server_id, s.hostname, s.ip_address
FROM (SELECT * FROM log_entry WHERE id > 500 ORDER BY id LIMIT 100) l
LEFT JOIN server s ON s.id = l.server_id""",
)
def incremental_fetch(t: Tables):
    return lookups.incremental_fetch(t.logs, t.servers, last_id=500, limit=100)


@query(
    "log_detail",
    sql="""
SELECT l.id, l.log_source, s.hostname, d.app_name, d.raw_message,
  json_extract_string(w.content, '$.event_id') AS event_id, n.request_uri, n.status
FROM log_entry l LEFT JOIN server s ON s.id = l.server_id
LEFT JOIN linux_d d ON d.log_entry_id = l.id LEFT JOIN windows_d w ON w.log_entry_id = l.id
LEFT JOIN nginx_d n ON n.log_entry_id = l.id""",
)
def log_detail(t: Tables):
    found = lookups.log_detail(t.logs, t.servers, t.linux, t.windows, t.nginx)
    return found.select(
        "id", "log_source", "hostname", "linux.app_name", "linux.raw_message",
        F.col("windows.attrs")["event_id"].alias("event_id"), "nginx.request_uri", "nginx.status",
    )


@query("alerts_for_log", sql=f"SELECT {ALERT_COLUMNS} FROM alert a")
def alerts_for_log(t: Tables):
    return lookups.alerts_for_log(t.alerts)


NGINX_COLUMNS = f"""log_entry_id, remote_addr, request_method, request_uri, status,
  body_bytes_sent, {sql_time("timestamp")} AS timestamp"""
NGINX_NAMES = [
    "log_entry_id", "remote_addr", "request_method", "request_uri", "status", "body_bytes_sent",
    "timestamp",
]


@query("nginx_errors", sql=f"SELECT {NGINX_COLUMNS} FROM nginx_d WHERE status >= 400")
def nginx_errors(t: Tables):
    return lookups.nginx_errors(t.nginx).select(*NGINX_NAMES)


@query(
    "requests_by_ip",
    sql=f"SELECT {NGINX_COLUMNS} FROM nginx_d WHERE remote_addr = '10.0.0.2'",
)
def requests_by_ip(t: Tables):
    return lookups.requests_by_ip(t.nginx, "10.0.0.2").select(*NGINX_NAMES)


@query("ssh_events", sql="SELECT * FROM linux_d WHERE ssh_action IS NOT NULL")
def ssh_events(t: Tables):
    return lookups.ssh_events(t.linux).drop("content")


@query(
    "windows_events_by_id",
    sql="""
SELECT log_entry_id, content FROM windows_d
WHERE json_extract_string(content, '$.event_id') = '4625'""",
)
def windows_events_by_id(t: Tables):
    return lookups.windows_events_by_id(t.windows, 4625).select("log_entry_id", "content")


@query(
    "critical_open_alerts",
    sql=f"""
SELECT {ALERT_COLUMNS} FROM (SELECT * FROM alert WHERE severity = 'critical' AND NOT resolved
  ORDER BY triggered_at DESC, alert_id DESC LIMIT 50) a""",
)
def critical_open_alerts(t: Tables):
    return lookups.critical_open_alerts(t.alerts)


# Rules joined to the logs of their source, so that the result grows with the logs.
@query(
    "active_rules_for_source",
    sql="""
SELECT r.rule_id, count(*) AS logs FROM rule_text r JOIN log_entry l ON l.log_source = 'nginx'
WHERE r.rule_id LIKE 'web-%' GROUP BY r.rule_id""",
)
def active_rules_for_source(t: Tables):
    active = pack.active_rules_for_source(pack.rules_frame(t.spark), "nginx")
    per_source = t.logs.groupBy("log_source").agg(F.count("*").alias("logs"))
    return active.join(per_source, "log_source").select(F.col("id").alias("rule_id"), "logs")


@query(
    "alert_detail",
    sql=f"""
SELECT {ALERT_COLUMNS}, s.hostname, s.ip_address, l.content, {RECV} AS recv_time
FROM alert a LEFT JOIN server s ON s.id = a.server_id
LEFT JOIN log_entry l ON l.id = a.log_entry_id""",
)
def alert_detail(t: Tables):
    return lookups.alert_detail(t.alerts, t.servers, t.logs)


LOG_SERVER = f"""
SELECT l.id, l.server_id, {RECV} AS recv_time, l.log_source, l.content, s.hostname, s.ip_address
FROM log_entry l"""


@query("logs_left_server", sql=f"{LOG_SERVER} LEFT JOIN server s ON s.id = l.server_id")
def logs_left_server(t: Tables):
    return lookups.logs_with_server(t.logs, t.servers)


@query("logs_inner_server", sql=f"{LOG_SERVER} JOIN server s ON s.id = l.server_id")
def logs_inner_server(t: Tables):
    return lookups.logs_with_server(t.logs, t.servers, "inner")


@query(
    "alerts_server_log",
    sql=f"""
SELECT {ALERT_COLUMNS}, s.hostname, s.ip_address, l.content, {RECV} AS recv_time
FROM alert a JOIN server s ON s.id = a.server_id JOIN log_entry l ON l.id = a.log_entry_id""",
)
def alerts_server_log(t: Tables):
    return lookups.alerts_server_log(t.alerts, t.servers, t.logs)


@query(
    "alerts_left_server",
    sql=f"""
SELECT {ALERT_COLUMNS}, coalesce(s.hostname, 'Unknown') AS hostname, s.ip_address
FROM foreign_alert a LEFT JOIN server s ON s.id = a.server_id""",
)
def alerts_left_server(t: Tables):
    return lookups.alerts_left_server(t.foreign_alerts, t.servers)


@query(
    "connections_with_log",
    sql=f"""
SELECT l.id, l.server_id, {RECV} AS recv_time, {sql_time("c.ts")} AS ts, c.uid, c.orig_h,
  c.resp_h, c.resp_p, c.orig_bytes
FROM conn_d c JOIN log_entry l ON l.id = c.log_entry_id
ORDER BY c.ts DESC, l.id DESC LIMIT 50 OFFSET 5""",
)
def connections_with_log(t: Tables):
    return lookups.connections_with_log(t.conns, t.logs, limit=50, offset=5).select(
        "id", "server_id", "recv_time", "ts", "uid", "orig_h", "resp_h", "resp_p", "orig_bytes"
    )


@query(
    "host_event_feed",
    sql=f"""
SELECT l.id, lower(trim(s.hostname)) AS host, {RECV} AS recv_time, l.log_source,
  CASE WHEN l.log_source = 'windows' THEN w.content ELSE d.raw_message END AS content
FROM log_entry l JOIN server s ON s.id = l.server_id
LEFT JOIN windows_d w ON w.log_entry_id = l.id LEFT JOIN linux_d d ON d.log_entry_id = l.id
WHERE CASE WHEN l.log_source = 'windows' THEN w.content ELSE d.raw_message END <> ''
  AND l.id > 0""",
)
def host_event_feed(t: Tables):
    return lookups.host_event_feed(t.logs, t.servers, t.windows, t.linux)


@query(
    "alert_log_server_report",
    sql=f"""
SELECT {ALERT_COLUMNS}, coalesce(s.hostname, 'Unknown') AS hostname, s.ip_address,
  substr(l.content, 1, 60) AS preview
FROM (SELECT * FROM alert ORDER BY triggered_at DESC, alert_id DESC LIMIT 20) a
JOIN log_entry l ON l.id = a.log_entry_id LEFT JOIN server s ON s.id = l.server_id""",
)
def alert_log_server_report(t: Tables):
    return lookups.alert_report(t.alerts, t.logs, t.servers)


@query(
    "register_servers",
    sql=f"""
SELECT hostname, ip_address, server_type, {sql_time("min(recv_time)")} AS first_seen,
  {sql_time("max(recv_time)")} AS last_seen,
  NOT EXISTS (SELECT 1 FROM server s WHERE s.hostname = x.hostname
    AND s.ip_address = x.ip_address AND s.server_type = x.server_type) AS is_new
FROM (SELECT r.log_type AS server_type, r.src_ip AS ip_address, r.recv_time,
  CASE r.log_type WHEN 'linux' THEN s.hostname
   WHEN 'windows' THEN json_extract_string(r.t, '$.hostname')
   WHEN 'nginx' THEN regexp_extract(r.t, '^([0-9.]+)', 1)
   ELSE string_split(r.t, chr(9))[3] END AS hostname
  FROM typed_line r LEFT JOIN server s ON s.ip_address = r.src_ip
  WHERE r.log_type IS NOT NULL) x
GROUP BY hostname, ip_address, server_type""",
)
def register_servers(t: Tables):
    parsed = ingest.parse_lines(t.raw_lines).where(F.col("log_type").isNotNull())
    records = parsed.select(
        "hostname", F.col("src_ip").alias("ip_address"), F.col("log_type").alias("server_type"),
        "recv_time",
    )
    return stats.register_servers(records, t.servers).drop("id")
