"""Queries of parsing, normalisation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.functions import parsers as P
from vigilog.functions import text as X
from vigilog.operators import detect, ingest
from vigilog.plans.catalog import query, sql_time
from vigilog.plans.fixtures import ACCESS_SQL, ACCESS_TAIL_SQL, FILE_TIME, Tables, _q


@query("detect_log_type", sql="SELECT line_id, log_type FROM typed_line")
def detect_log_type(t: Tables):
    return ingest.parse_lines(t.raw_lines).select("line_id", "log_type")


@query(
    "parse_syslog",
    sql="SELECT log_entry_id, timestamp, hostname, app_name, pid, raw_message FROM linux_d",
)
def parse_syslog(t: Tables):
    return t.linux.select(
        "log_entry_id", "timestamp", "hostname", "app_name", "pid", "raw_message"
    )


@query(
    "enrich_ssh",
    sql="SELECT log_entry_id, app_name, ssh_action, ssh_user, ssh_ip FROM linux_d",
)
def enrich_ssh(t: Tables):
    return t.linux.select("log_entry_id", "app_name", "ssh_action", "ssh_user", "ssh_ip")


HEAD_GROUPS = ", ".join(f"regexp_extract(t, {_q(ACCESS_SQL)}, {i})" for i in range(1, 9))
TAIL_GROUPS = ", ".join(f"regexp_extract(t, {_q(ACCESS_TAIL_SQL)}, {i})" for i in range(1, 4))
ACCESS_LINES = f"""
SELECT line_id, [{HEAD_GROUPS}] AS g, [{TAIL_GROUPS}] AS h FROM typed_line
WHERE log_type = 'nginx'"""


@query(
    "parse_nginx_access",
    sql=f"""
SELECT line_id, g[1] AS remote_addr, g[2] AS remote_user, g[3] AS time_local,
  g[4] AS request_method, g[5] AS request_uri, g[6] AS server_protocol,
  TRY_CAST(g[7] AS INTEGER) AS status, TRY_CAST(g[8] AS BIGINT) AS body_bytes_sent,
  CASE WHEN h[1] <> '' THEN h[2] END AS http_referer,
  CASE WHEN h[1] <> '' THEN h[3] END AS http_user_agent
FROM ({ACCESS_LINES})""",
)
def parse_nginx_access(t: Tables):
    parsed = ingest.parse_lines(t.raw_lines).where(F.col("log_type") == "nginx")
    return parsed.select("line_id", "nginx.*").drop("timestamp", "status_category")


@query(
    "parse_nginx_strict",
    sql=f"""
SELECT line_id, g[1] AS remote_addr, g[5] AS request_uri, h[2] AS http_referer,
  h[3] AS http_user_agent
FROM ({ACCESS_LINES}) WHERE h[1] <> ''""",
)
def parse_nginx_strict(t: Tables):
    parsed = ingest.parse_lines(t.raw_lines, ingest.ParserRegistry([ingest.NGINX_STRICT]))
    return parsed.where(F.col("log_type") == "nginx").select(
        "line_id", "nginx.remote_addr", "nginx.request_uri", "nginx.http_referer",
        "nginx.http_user_agent",
    )


@query(
    "nginx_event_time",
    sql=f"""
SELECT log_entry_id, {sql_time("timestamp")} AS event_time,
  coalesce(remote_addr, 'unknown') AS hostname FROM nginx_d""",
)
def nginx_event_time(t: Tables):
    return t.nginx.select(
        "log_entry_id",
        P.access_time(F.col("time_local")).alias("event_time"),
        F.coalesce("remote_addr", F.lit("unknown")).alias("hostname"),
    )


@query(
    "http_status_category",
    sql="""
SELECT log_entry_id, status, CASE WHEN status = 0 THEN NULL
  WHEN status BETWEEN 200 AND 299 THEN 'success' WHEN status BETWEEN 300 AND 399 THEN 'redirect'
  WHEN status BETWEEN 400 AND 499 THEN 'client_error'
  WHEN status BETWEEN 500 AND 599 THEN 'server_error'
  WHEN status IS NOT NULL THEN 'unknown' END AS status_category
FROM nginx_d""",
)
def http_status_category(t: Tables):
    return t.nginx.select("log_entry_id", "status", "status_category")


@query(
    "parse_windows_event",
    sql=f"""
SELECT l.id, {sql_time("l.recv_time")} AS recv_time, s.ip_address AS src_ip,
  json_extract_string(l.content, '$.timestamp') AS event_time,
  json_extract_string(l.content, '$.channel') AS channel,
  json_extract_string(l.content, '$.event_id') AS event_id,
  json_extract_string(l.content, '$.NewProcessName') AS new_process,
  json_extract_string(l.content, '$.message') AS message
FROM log_entry l JOIN server s ON l.server_id = s.id
WHERE l.log_source = 'windows' AND json_valid(l.content)""",
)
def parse_windows_event(t: Tables):
    parsed = ingest.parse_lines(t.raw_lines).where(F.col("log_type") == "windows")
    record = ingest.event_record(parsed.withColumn(
        "recv_time", F.date_format("recv_time", P.STORED_TIME)
    ))
    attrs = F.col("windows")
    return record.select(
        F.substring("line_id", 2, 20).cast("bigint").alias("id"),
        attrs["recv_time"].alias("recv_time"),
        attrs["src_ip"].alias("src_ip"),
        attrs["timestamp"].alias("event_time"),
        attrs["channel"].alias("channel"),
        attrs["event_id"].alias("event_id"),
        attrs["NewProcessName"].alias("new_process"),
        attrs["message"].alias("message"),
    )


# The SQL twin numbers the lines and carries the last header forward with a window.
MESSAGE_SQL = """
SELECT log_entry_id, n, CASE WHEN section = '' THEN '' ELSE section || '_' END
  || replace(k, ' ', '_') AS key, v AS value
FROM (SELECT *, coalesce(last_value(CASE WHEN v = '' THEN replace(k, ' ', '') END IGNORE NULLS)
        OVER (PARTITION BY log_entry_id ORDER BY n), '') AS section
      FROM (SELECT log_entry_id, n, trim(substr(line, 1, instr(line, ':') - 1)) AS k,
              trim(substr(line, instr(line, ':') + 1)) AS v
            FROM (SELECT log_entry_id, n, trim(parts[n], ' ' || chr(9)) AS line
                  FROM (SELECT log_entry_id, parts, unnest(generate_series(1, len(parts))) AS n
                        FROM (SELECT log_entry_id, string_split(replace(
                                json_extract_string(content, '$.message'), chr(13), ''),
                                chr(10)) AS parts FROM windows_d)))
            WHERE contains(line, ':')))
WHERE v <> ''"""


@query(
    "flatten_event_message",
    sql=f"""
WITH pair AS ({MESSAGE_SQL})
SELECT log_entry_id, max(CASE WHEN key = 'Subject_Security_ID' THEN value END) AS security_id,
  max(CASE WHEN key = 'Subject_Account_Name' THEN value END) AS account_name,
  max(CASE WHEN key = 'LogonInformation_Logon_Type' THEN value END) AS logon_type,
  max(CASE WHEN key = 'FailureInformation_Status' THEN value END) AS failure_status,
  max(CASE WHEN key = 'ProcessInformation_Process_Name' THEN value END) AS process_name,
  count(*) AS fields
FROM pair GROUP BY log_entry_id""",
)
def flatten_event_message(t: Tables):
    entries = P.distinct_entries(P.message_entries(F.col("attrs")["message"]))
    fields = t.windows.select("log_entry_id", F.map_from_entries(entries).alias("m"))
    m = F.col("m")
    return fields.where(F.size("m") > 0).select(
        "log_entry_id",
        m["Subject_Security_ID"].alias("security_id"),
        m["Subject_Account_Name"].alias("account_name"),
        m["LogonInformation_Logon_Type"].alias("logon_type"),
        m["FailureInformation_Status"].alias("failure_status"),
        m["ProcessInformation_Process_Name"].alias("process_name"),
        F.size("m").cast("bigint").alias("fields"),
    )


@query(
    "explode_message_fields",
    sql=f"""
WITH pair AS ({MESSAGE_SQL})
SELECT log_entry_id, key, value FROM pair
QUALIFY row_number() OVER (PARTITION BY log_entry_id, key ORDER BY n DESC) = 1""",
)
def explode_message_fields(t: Tables):
    entries = P.distinct_entries(P.message_entries(F.col("attrs")["message"]))
    return t.windows.select("log_entry_id", F.inline(entries))


@query(
    "normalize_sigma_fields",
    sql="""
SELECT log_entry_id, json_extract_string(content, '$.CommandLine') AS cmdline,
  json_extract_string(content, '$.ParentProcessName') AS parent,
  json_extract_string(content, '$.NewProcessName') AS name,
  json_extract_string(content, '$.Image') AS image,
  json_extract_string(content, '$.TargetUserName') AS user_name,
  coalesce(json_extract_string(content, '$.channel'),
    json_extract_string(content, '$.LogName')) AS channel
FROM windows_d""",
)
def normalize_sigma_fields(t: Tables):
    return ingest.canonical_events(t.windows).select(
        "log_entry_id", "cmdline", "parent", "name", "image",
        F.col("user").alias("user_name"), "channel",
    )


@query(
    "path_basename",
    sql=r"""
SELECT log_entry_id, string_split(json_extract_string(content, '$.ParentProcessName'), '\')[-1]
    AS parent_name,
  string_split(json_extract_string(content, '$.NewProcessName'), '\')[-1] AS process_name,
  string_split(json_extract_string(content, '$.NewProcessName'), '\')[-1] AS process_basename
FROM windows_d""",
)
def path_basename(t: Tables):
    return ingest.canonical_events(t.windows).select(
        "log_entry_id", "parent_name", "process_name", "process_basename"
    )


@query(
    "parse_zeek_conn",
    sql=f"SELECT * REPLACE ({sql_time('ts')} AS ts) FROM conn_d",
)
def parse_zeek_conn(t: Tables):
    return t.conns.drop("tunnel_parents")


@query(
    "unparsed_lines",
    sql="SELECT line_id, line FROM typed_line WHERE log_type IS NULL",
)
def unparsed_lines(t: Tables):
    return ingest.unparsed_lines(t.raw_lines).select("line_id", "line")


@query(
    "categorize_message",
    sql=r"""
SELECT category, count(*) AS lines FROM (SELECT CASE
  WHEN contains(m, 'tp-link') OR contains(m, 'archer') OR contains(m, 'tl-')
    OR contains(m, 'tplink') THEN 'tplink_router'
  WHEN regexp_matches(m, '(sshd|failed password|sudo:)') THEN 'linux_auth'
  WHEN regexp_matches(m, '(deny|block|drop|ufw|iptables|firewall)') THEN 'firewall_network'
  ELSE 'linux_syslog' END AS category FROM (SELECT lower(line) AS m FROM raw_line))
GROUP BY category""",
)
def categorize_message(t: Tables):
    category = X.categorize_message(F.col("line")).alias("category")
    return t.raw_lines.groupBy(category).agg(F.count("*").alias("lines"))


def _records(t: Tables):
    parsed = ingest.parse_lines(t.raw_lines).where(F.col("log_type").isNotNull())
    return parsed.select(
        "line_id",
        "hostname",
        F.lit(None).cast("string").alias("source_ip"),
        "src_ip",
        F.lit("").alias("log_source"),
        "log_type",
        F.col("line").alias("raw_line"),
        "line",
        ingest.record_timestamp().alias("timestamp"),
    )


RECORD_SQL = """
SELECT line_id, log_type, src_ip, line, CASE log_type
  WHEN 'linux' THEN (SELECT max(hostname) FROM linux_d d
     WHERE 'e' || d.log_entry_id = r.line_id)
  WHEN 'windows' THEN json_extract_string(t, '$.hostname')
  WHEN 'nginx' THEN regexp_extract(t, '^([0-9.]+)', 1)
  ELSE string_split(t, chr(9))[3] END AS hostname
FROM typed_line r WHERE log_type IS NOT NULL"""


@query(
    "resolve_envelope_defaults",
    sql=f"""
SELECT line_id, coalesce(hostname, 'unknown') AS hostname, coalesce(src_ip, '0.0.0.0')
  AS ip_address, log_type AS log_source, line AS content FROM ({RECORD_SQL})""",
)
def resolve_envelope_defaults(t: Tables):
    stored = ingest.resolve_envelope(_records(t), F.lit(FILE_TIME).cast("timestamp"))
    return stored.select("line_id", "hostname", "ip_address", "log_source", "content")


@query(
    "resolve_recv_time",
    sql=f"""
SELECT line_id, log_type AS log_source, CASE WHEN log_type = 'linux' THEN '{FILE_TIME}'
  WHEN line_id LIKE 'p%' THEN '2024-01-15 10:23:45'
  ELSE {sql_time("recv_time")} END AS recv_time
FROM typed_line WHERE log_type IS NOT NULL""",
)
def resolve_recv_time(t: Tables):
    stored = ingest.resolve_envelope(_records(t), F.lit(FILE_TIME).cast("timestamp"))
    return stored.select("line_id", "log_source", "recv_time")


@query(
    "preview_text",
    sql="""
SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END
  AS short_preview,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS long_preview,
  substr(text, 1, 500) AS cut
FROM documents""",
)
def preview_text(t: Tables):
    text = F.col("text")
    return t.read("documents").select(
        "doc_id",
        X.preview(text, 150).alias("short_preview"),
        X.preview(text, 200).alias("long_preview"),
        F.substring(text, 1, detect.RAW_LINE_LENGTH).alias("cut"),
    )


@query(
    "shannon_entropy",
    sql="""
SELECT d.doc_id, coalesce(round(e.entropy, 6), 0.0) AS entropy FROM documents d LEFT JOIN (
  SELECT doc_id, -sum(p * log2(p)) AS entropy FROM (
    SELECT doc_id, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents)
    GROUP BY doc_id, ch) GROUP BY doc_id) e USING (doc_id)""",
)
def shannon_entropy(t: Tables):
    return t.read("documents").select(
        "doc_id", F.round(X.shannon_entropy(F.col("text")), 6).alias("entropy")
    )


# Event keys that name the host, user and process, in order.
HOST_KEYS = ["hostname", "Computer", "ingest_src_ip"]
USER_KEYS = [
    "SubjectUserName", "Subject_Account_Name", "User_Account_Name", "user", "TargetUserName",
]
PROCESS_KEYS = [
    "ProcessName", "ProcessInformation_Process_Name", "CallerProcessName", "NewProcessName",
]


@query(
    "first_present_key",
    sql=r"""
SELECT log_entry_id, coalesce(lower(trim(json_extract_string(content, '$.hostname'))), 'unknown')
    AS host,
  coalesce(lower(trim(json_extract_string(content, '$.TargetUserName'))), 'unknown')
    AS user_name,
  lower(string_split(json_extract_string(content, '$.NewProcessName'), '\')[-1]) AS process
FROM windows_d""",
)
def first_present_key(t: Tables):
    attrs = F.col("attrs")
    return t.windows.select(
        "log_entry_id",
        X.first_present(attrs, HOST_KEYS).alias("host"),
        X.first_present(attrs, USER_KEYS).alias("user_name"),
        X.basename(X.first_present(attrs, PROCESS_KEYS)).alias("process"),
    )


@query(
    "app_name_heuristic",
    sql="""
SELECT line_id, CASE WHEN len(string_split(line, ':')) > 2
  THEN string_split(trim(string_split(line, ':')[3], ' ' || chr(9)), '[')[1]
  ELSE 'unknown' END AS app_name FROM raw_line""",
)
def app_name_heuristic(t: Tables):
    return t.raw_lines.select("line_id", X.app_name_heuristic(F.col("line")).alias("app_name"))


@query(
    "alert_metadata_json",
    sql="""
SELECT alert_id, log_source, severity, raw_line, message FROM alert_text""",
)
def alert_metadata_json(t: Tables):
    alerts = detect.run_rules(t.logs, t.rules)
    stored = alerts.select("severity", detect.alert_metadata(alerts).alias("metadata"))
    meta = detect.metadata_fields(F.col("metadata"))
    return stored.select(
        meta["alert_id"].alias("alert_id"),
        meta["log_source"].alias("log_source"),
        "severity",
        meta["raw_line"].alias("raw_line"),
        F.get_json_object(meta["matched_fields"], "$.message").alias("message"),
    )


@query(
    "matched_fields",
    sql=f"""
SELECT l.id, {sql_time("l.recv_time")} AS event_time, d.app_name AS program,
  coalesce(d.raw_message, json_extract_string(w.content, '$.message')) AS message,
  json_extract_string(w.content, '$.event_id') AS event_id,
  json_extract_string(w.content, '$.channel') AS channel,
  n.request_method AS method, n.request_uri AS path, CAST(n.status AS VARCHAR) AS status_code
FROM log_entry l LEFT JOIN linux_d d ON d.log_entry_id = l.id
LEFT JOIN windows_d w ON w.log_entry_id = l.id LEFT JOIN nginx_d n ON n.log_entry_id = l.id""",
)
def matched_fields(t: Tables):
    view = detect._with_host(detect.parsed_view(t.logs))
    found = F.from_json(detect.matched_fields(), "map<string,string>")
    names = ["program", "message", "event_id", "channel", "method", "path", "status_code"]
    return view.select("id", found.alias("m")).select(
        "id", F.col("m")["timestamp"].alias("event_time"),
        *[F.col("m")[n].alias(n) for n in names],
    )
