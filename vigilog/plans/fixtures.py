"""The given tables seen as security logs, in Spark and as SQL text.

``Tables`` builds each view as a DataFrame; ``CTES`` holds the same views as SQL
for the side-by-side check. ``documents`` and ``pages`` join the raw lines so that
parsers also meet text that is not a log.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.operators import detect, ingest
from vigilog.rules.pack import packaged_rules
from vigilog.session import cut_lineage, prepare

SOURCES = ["linux", "windows", "nginx", "zeek_conn"]
PAGE_TIME = "15/Jan/2024:10:23:45 +0000"
FILE_TIME = "2024-01-31 00:00:00"
FOREIGN = 100_000_000  # added to ids of servers to make them unknown


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _by_type(cases: dict[str, str | Column], default: str | Column) -> Column:
    def value(v):
        return F.lit(v) if isinstance(v, str) else v

    items = list(cases.items())
    out = F.when(F.col("event_type") == items[0][0], value(items[0][1]))
    for name, v in items[1:]:
        out = out.when(F.col("event_type") == name, value(v))
    return out.otherwise(value(default))


def linux_line() -> Column:
    user = _text("u", F.col("server_id") % 7)
    app = _by_type({"error": "sshd", "signup": "sshd", "click": "CRON", "view": "systemd"}, "sudo")
    message = _by_type(
        {
            "error": _text(
                "Failed password for invalid user ", user, " from ",
                F.col("ip_address"), " port 50022 ssh2",
            ),
            "signup": _text(
                "Accepted publickey for ", user, " from ", F.col("ip_address"), " port 50022 ssh2"
            ),
            "click": "(root) CMD (run-parts /etc/cron.hourly)",
            "view": "Started session",
        },
        "oper7 : TTY=pts/4 ; PWD=/srv/jobs ; USER=root ; COMMAND=/bin/zsh",
    )
    when = F.date_format("recv_time", "MMM dd HH:mm:ss")
    pid = 1000 + F.col("id") % 9000
    return _text(when, " ", F.col("hostname"), " ", app, "[", pid, "]: ", message)


def nginx_line() -> Column:
    method = _by_type({"purchase": "POST", "signup": "PUT"}, "GET")
    uri = _by_type(
        {
            "click": "/api/items",
            "view": "/lookup?term=<object>",
            "purchase": "/login",
            "signup": "/admin/login",
        },
        "/../../etc/passwd",
    )
    status = _by_type(
        {"click": "200", "view": "302", "purchase": "401", "signup": "403"}, "500"
    )
    agent = F.when(F.col("id") % 5 == 0, "sqlmap/1.7").otherwise("Mozilla/5.0")
    return _text(
        F.col("ip_address"), " - - [", F.date_format("recv_time", "dd/MMM/yyyy:HH:mm:ss"),
        " +0000] \"", method, " ", uri, " HTTP/1.1\" ", status, " ",
        F.floor(F.col("value") * 100).cast("bigint"), " \"-\" \"", agent, "\"",
    )


# JSON escapes, as they stand in the stored text.
WINDOWS_DIR = r"C:\\Windows\\"
MESSAGE_HEAD = r"An event was recorded.\nSubject:\n\tSecurity ID: S-1-5-21-"
MESSAGE_USER = r"\n\tAccount Name: u"
MESSAGE_LOGON = r"\nLogon Information:\n\tLogon Type: "
MESSAGE_FAILURE = (
    r"\nFailure Information:\n\tFailure Reason: Unknown user name or bad password."
    r"\n\tStatus: 0xC000006D"
)
MESSAGE_PROCESS = r"\nProcess Information:\n\tProcess Name: "


def windows_line() -> Column:
    event_id = _by_type({"error": "4625", "signup": "4624"}, "4688")
    process = _by_type(
        {"click": "System32\\\\cmd.exe", "view": "Temp\\\\svchost.exe"}, "explorer.exe"
    )
    parent = _by_type({"click": "winword.exe", "purchase": "services.exe"}, "explorer.exe")
    command = _by_type(
        {
            "click": "powershell.exe -enc SQBFAFgA",
            "purchase": "vssadmin delete shadows /all",
        },
        "notepad.exe",
    )
    failure = _by_type({"error": MESSAGE_FAILURE}, "")
    user = F.col("server_id") % 7
    return _text(
        '{"timestamp":"', F.date_format("recv_time", "yyyy-MM-dd HH:mm:ss"),
        '","hostname":"', F.col("hostname"), '","channel":"Security","event_id":', event_id,
        ',"NewProcessName":"', WINDOWS_DIR, process, '","ParentProcessName":"', WINDOWS_DIR, parent,
        '","CommandLine":"', command, '","TargetUserName":"u', user,
        '","message":"', MESSAGE_HEAD, user, MESSAGE_USER, user, MESSAGE_LOGON,
        F.col("id") % 4 + 2, failure, MESSAGE_PROCESS, WINDOWS_DIR, process, '"}',
    )


def conn_line() -> Column:
    port = _by_type({"click": "443", "view": "80"}, "22")
    sent = _by_type({"error": "-"}, F.floor(F.col("value") * 10).cast("bigint").cast("string"))
    return F.concat_ws(
        "\t",
        _text(F.unix_seconds("recv_time"), ".000000"),
        _text("C", F.col("id")),
        "ip_address",
        (1024 + F.col("id") % 60000).cast("string"),
        _text("192.168.0.", F.col("id") % 20),
        port,
        *[F.lit(x) for x in ("tcp", "-", "-")],
        sent,
        *[F.lit(x) for x in ("0", "SF", "-", "0", "ShADadF", "4", "216", "3", "164")],
    )


class Tables:
    """Fixture views over one folder of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def servers(self) -> DataFrame:
        key = F.col("c_custkey")
        kind = key % 4
        return self.read("customer").select(
            key.alias("id"),
            F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("hostname"),
            _text(
                "10.", F.floor(key / 65536), ".", F.floor(key / 256) % 256, ".", key % 256
            ).alias("ip_address"),
            F.when(kind == 0, "linux").when(kind == 1, "windows").when(kind == 2, "nginx")
            .otherwise("zeek_conn").alias("server_type"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        events = self.read("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("server_id"),
            F.col("ts").cast("timestamp").alias("recv_time"),
            "event_type",
            "value",
        )
        joined = events.join(self.servers.withColumnRenamed("id", "server_id"), "server_id")
        source = F.col("server_type")
        content = (
            F.when(source == "linux", linux_line())
            .when(source == "windows", windows_line())
            .when(source == "nginx", nginx_line())
            .otherwise(conn_line())
        )
        return joined.select(
            "id", "server_id", "recv_time", source.alias("log_source"), content.alias("content")
        )

    @cached_property
    def raw_lines(self) -> DataFrame:
        """Envelopes: every stored log, page request and document line."""
        file_time = F.lit(FILE_TIME).cast("timestamp")
        logs = self.logs.join(
            self.servers.select(F.col("id").alias("server_id"), "ip_address"), "server_id"
        ).select(
            _text("e", F.col("id")).alias("line_id"),
            "recv_time",
            F.col("ip_address").alias("src_ip"),
            F.col("content").alias("line"),
        )
        pages = self.read("pages").select(
            _text("p", F.col("page_id")).alias("line_id"),
            file_time.alias("recv_time"),
            F.lit("file_upload").alias("src_ip"),
            _text(
                "10.200.", F.floor(F.col("page_id") / 256) % 256, ".", F.col("page_id") % 256,
                " - - [", PAGE_TIME, "] \"GET ",
                F.regexp_replace("url", "^https?://[^/]+", ""),
                " HTTP/1.1\" 200 ", F.length("html"), " \"", F.col("url"), "\" \"Mozilla/5.0\"",
            ).alias("line"),
        )
        documents = self.read("documents").select(
            "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")
        ).select(
            _text("d", F.col("doc_id"), "-", F.col("n")).alias("line_id"),
            file_time.alias("recv_time"),
            F.lit("file_upload").alias("src_ip"),
            "line",
        )
        return logs.unionByName(pages).unionByName(documents)

    @cached_property
    def linux(self) -> DataFrame:
        return ingest.linux_details(self.logs)

    @cached_property
    def nginx(self) -> DataFrame:
        return ingest.nginx_details(self.logs)

    @cached_property
    def windows(self) -> DataFrame:
        return ingest.windows_details(self.logs)

    @cached_property
    def conns(self) -> DataFrame:
        return ingest.conn_details(self.logs)

    @cached_property
    def rules(self):
        return packaged_rules()

    @cached_property
    def alerts(self) -> DataFrame:
        """Alerts of the packaged rules; every third log's alerts are resolved.

        They are written once, so a query that uses them several times derives them once.
        """
        found = detect.run_rules(self.logs, self.rules)
        rows = found.select(
            "alert_id", "log_entry_id", "server_id", "log_source", "rule_id",
            "severity", "title", "description",
            F.col("recv_time").alias("triggered_at"),
            (F.col("log_entry_id") % 3 == 0).alias("resolved"),
        )
        return cut_lineage(self.spark, rows, "alerts")

    @property
    def foreign_alerts(self) -> DataFrame:
        """The alerts, every seventh log's with a server that the registry does not hold."""
        foreign = F.when(F.col("log_entry_id") % 7 == 0, F.col("server_id") + FOREIGN)
        return self.alerts.withColumn("server_id", F.coalesce(foreign, "server_id"))


# ---- the same views as SQL ----------------------------------------------------

def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HEADER_SQL = (
    r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[\.\d]*[Z\+\-\:0-9]*|\S+\s+\S+\s+\S+|\S+)"
    r"\s+(\S+)\s+([^:\[\s]+)(?:\[(\d+)\])?:\s+(.*)"
)
SSH_SQL = (
    r"(Accepted|Failed)\s+(?:password|publickey)\s+for\s+(?:invalid\s+user\s+)?"
    r"(\S+)\s+from\s+(\S+)"
)
ACCESS_SQL = (
    r"^([\d\.]+)\s+-\s+(\S+)\s+\[(.*?)\]\s+"
    r'"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d+)\s+(\d+)'
)
ACCESS_TAIL_SQL = (
    r"^[\d\.]+\s+-\s+\S+\s+\[.*?\]\s+"
    r'"\S+\s+\S+\s+[^"]+"\s+\d+\s+\d+(\s+"([^"]*)"\s+"([^"]*)")'
)
CONN_SQL = (
    r"^(\d+\.\d+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\S+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+"
    r"(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\S+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)"
    r"(?:\s+\(empty\)|\s+\S+)?$"
)
IPV4_SQL = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+"

CTES: dict[str, str] = {
    "server": """
SELECT c_custkey AS id, lower(replace(c_name, '#', '-')) AS hostname,
  '10.' || (c_custkey // 65536) || '.' || ((c_custkey // 256) % 256) || '.' || (c_custkey % 256)
    AS ip_address,
  CASE c_custkey % 4 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' WHEN 2 THEN 'nginx'
    ELSE 'zeek_conn' END AS server_type
FROM customer""",
    "log_entry": f"""
SELECT e.event_id AS id, e.user_id AS server_id, e.ts AS recv_time, s.server_type AS log_source,
 CASE s.server_type
 WHEN 'linux' THEN strftime(e.ts, '%b %d %H:%M:%S') || ' ' || s.hostname || ' ' ||
   CASE e.event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'sshd' WHEN 'click' THEN 'CRON'
     WHEN 'view' THEN 'systemd' ELSE 'sudo' END || '[' || (1000 + e.event_id % 9000) || ']: ' ||
   CASE e.event_type
     WHEN 'error' THEN 'Failed password for invalid user u' || (e.user_id % 7) || ' from '
       || s.ip_address || ' port 50022 ssh2'
     WHEN 'signup' THEN 'Accepted publickey for u' || (e.user_id % 7) || ' from '
       || s.ip_address || ' port 50022 ssh2'
     WHEN 'click' THEN '(root) CMD (run-parts /etc/cron.hourly)'
     WHEN 'view' THEN 'Started session'
     ELSE 'oper7 : TTY=pts/4 ; PWD=/srv/jobs ; USER=root ; COMMAND=/bin/zsh' END
 WHEN 'windows' THEN '{{"timestamp":"' || strftime(e.ts, '%Y-%m-%d %H:%M:%S')
   || '","hostname":"' || s.hostname || '","channel":"Security","event_id":'
   || CASE e.event_type WHEN 'error' THEN '4625' WHEN 'signup' THEN '4624' ELSE '4688' END
   || ',"NewProcessName":"' || {_q(WINDOWS_DIR)} ||
   CASE e.event_type WHEN 'click' THEN 'System32\\\\cmd.exe' WHEN 'view' THEN 'Temp\\\\svchost.exe'
     ELSE 'explorer.exe' END
   || '","ParentProcessName":"' || {_q(WINDOWS_DIR)} ||
   CASE e.event_type WHEN 'click' THEN 'winword.exe' WHEN 'purchase' THEN 'services.exe'
     ELSE 'explorer.exe' END
   || '","CommandLine":"' ||
   CASE e.event_type WHEN 'click' THEN 'powershell.exe -enc SQBFAFgA'
     WHEN 'purchase' THEN 'vssadmin delete shadows /all' ELSE 'notepad.exe' END
   || '","TargetUserName":"u' || (e.user_id % 7)
   || '","message":"' || {_q(MESSAGE_HEAD)} || (e.user_id % 7) || {_q(MESSAGE_USER)}
   || (e.user_id % 7) || {_q(MESSAGE_LOGON)} || (e.event_id % 4 + 2)
   || CASE e.event_type WHEN 'error' THEN {_q(MESSAGE_FAILURE)} ELSE '' END
   || {_q(MESSAGE_PROCESS)} || {_q(WINDOWS_DIR)} ||
   CASE e.event_type WHEN 'click' THEN 'System32\\\\cmd.exe' WHEN 'view' THEN 'Temp\\\\svchost.exe'
     ELSE 'explorer.exe' END || '"}}'
 WHEN 'nginx' THEN s.ip_address || ' - - [' || strftime(e.ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "'
   || CASE e.event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END || ' '
   || CASE e.event_type WHEN 'click' THEN '/api/items'
       WHEN 'view' THEN '/lookup?term=<object>' WHEN 'purchase' THEN '/login'
       WHEN 'signup' THEN '/admin/login' ELSE '/../../etc/passwd' END || ' HTTP/1.1" '
   || CASE e.event_type WHEN 'click' THEN '200' WHEN 'view' THEN '302' WHEN 'purchase' THEN '401'
       WHEN 'signup' THEN '403' ELSE '500' END
   || ' ' || CAST(floor(e.value * 100) AS BIGINT) || ' "-" "'
   || CASE WHEN e.event_id % 5 = 0 THEN 'sqlmap/1.7' ELSE 'Mozilla/5.0' END || '"'
 ELSE CAST(floor(epoch(e.ts)) AS BIGINT) || '.000000' || chr(9) || 'C' || e.event_id || chr(9)
   || s.ip_address || chr(9) || (1024 + e.event_id % 60000) || chr(9)
   || '192.168.0.' || (e.event_id % 20) || chr(9)
   || CASE e.event_type WHEN 'click' THEN '443' WHEN 'view' THEN '80' ELSE '22' END || chr(9)
   || 'tcp' || chr(9) || '-' || chr(9) || '-' || chr(9)
   || CASE e.event_type WHEN 'error' THEN '-'
       ELSE CAST(CAST(floor(e.value * 10) AS BIGINT) AS VARCHAR) END || chr(9)
   || array_to_string(['0','SF','-','0','ShADadF','4','216','3','164'], chr(9))
 END AS content
FROM events e JOIN server s ON e.user_id = s.id""",
    "raw_line": f"""
SELECT 'e' || l.id AS line_id, l.recv_time, s.ip_address AS src_ip, l.content AS line
FROM log_entry l JOIN server s ON l.server_id = s.id
UNION ALL
SELECT 'p' || page_id, TIMESTAMP '{FILE_TIME}', 'file_upload',
  '10.200.' || ((page_id // 256) % 256) || '.' || (page_id % 256) || ' - - [{PAGE_TIME}] "GET '
  || regexp_replace(url, '^https?://[^/]+', '') || ' HTTP/1.1" 200 ' || length(html)
  || ' "' || url || '" "Mozilla/5.0"'
FROM pages
UNION ALL
SELECT 'd' || doc_id || '-' || (n - 1), TIMESTAMP '{FILE_TIME}', 'file_upload', parts[n]
FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS n
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))""",
    "typed_line": f"""
SELECT *, CASE
  WHEN t LIKE '{{%' AND json_valid(t) THEN 'windows'
  WHEN regexp_matches(t, {_q(CONN_SQL)}) THEN 'zeek_conn'
  WHEN regexp_matches(t, {_q(IPV4_SQL)}) AND contains(t, '[') AND contains(t, ']')
    AND contains(t, '"') AND regexp_matches(t, {_q(ACCESS_SQL)}) THEN 'nginx'
  WHEN t NOT LIKE '{{%' AND NOT regexp_matches(t, {_q(IPV4_SQL + "-")})
    AND regexp_matches(t, {_q(HEADER_SQL)}) THEN 'linux' END AS log_type
FROM (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM raw_line)""",
    "linux_d": f"""
SELECT log_entry_id, g[1] AS timestamp, g[2] AS hostname, g[3] AS app_name,
  TRY_CAST(nullif(g[4], '') AS BIGINT) AS pid, g[5] AS raw_message,
  CASE WHEN h THEN x[1] END AS ssh_action, CASE WHEN h THEN x[2] END AS ssh_user,
  CASE WHEN h THEN x[3] END AS ssh_ip
FROM (SELECT *, g[3] = 'sshd' AND regexp_matches(g[5], {_q(SSH_SQL)}) AS h,
        [regexp_extract(g[5], {_q(SSH_SQL)}, 1), regexp_extract(g[5], {_q(SSH_SQL)}, 2),
         regexp_extract(g[5], {_q(SSH_SQL)}, 3)] AS x
      FROM (SELECT id AS log_entry_id, [{", ".join(
          f"regexp_extract(content, {_q(HEADER_SQL)}, {i})" for i in range(1, 6))}] AS g
            FROM log_entry WHERE log_source = 'linux'
            AND regexp_matches(content, {_q(HEADER_SQL)})))""",
    "nginx_d": f"""
SELECT log_entry_id, g[1] AS remote_addr, g[2] AS remote_user, g[3] AS time_local,
  g[4] AS request_method, g[5] AS request_uri, g[6] AS server_protocol,
  TRY_CAST(g[7] AS INTEGER) AS status, TRY_CAST(g[8] AS BIGINT) AS body_bytes_sent,
  CASE WHEN h[1] <> '' THEN h[2] END AS http_referer,
  CASE WHEN h[1] <> '' THEN h[3] END AS http_user_agent,
  try_strptime(string_split(g[3], ' ')[1], '%d/%b/%Y:%H:%M:%S') AS timestamp
FROM (SELECT id AS log_entry_id, [{", ".join(
    f"regexp_extract(content, {_q(ACCESS_SQL)}, {i})" for i in range(1, 9))}] AS g,
    [{", ".join(
    f"regexp_extract(content, {_q(ACCESS_TAIL_SQL)}, {i})" for i in range(1, 4))}] AS h
      FROM log_entry WHERE log_source = 'nginx'
      AND regexp_matches(content, {_q(ACCESS_SQL)}))""",
    "windows_d": """
SELECT id AS log_entry_id, content FROM log_entry
WHERE log_source = 'windows' AND json_valid(content)""",
    "conn_d": f"""
SELECT log_entry_id, make_timestamp(CAST(round(CAST(g[1] AS DOUBLE) * 1000000) AS BIGINT)) AS ts,
  g[2] AS uid, g[3] AS orig_h, TRY_CAST(g[4] AS INTEGER) AS orig_p, g[5] AS resp_h,
  TRY_CAST(g[6] AS INTEGER) AS resp_p, g[7] AS proto, g[8] AS service, g[9] AS duration,
  TRY_CAST(g[10] AS BIGINT) AS orig_bytes, TRY_CAST(g[11] AS BIGINT) AS resp_bytes,
  g[12] AS conn_state, g[13] AS local_orig, TRY_CAST(g[14] AS BIGINT) AS missed_bytes,
  g[15] AS history, TRY_CAST(g[16] AS BIGINT) AS orig_pkts,
  TRY_CAST(g[17] AS BIGINT) AS orig_ip_bytes, TRY_CAST(g[18] AS BIGINT) AS resp_pkts,
  TRY_CAST(g[19] AS BIGINT) AS resp_ip_bytes
FROM (SELECT id AS log_entry_id, regexp_split_to_array(content, '\\s+') AS g
      FROM log_entry WHERE log_source = 'zeek_conn'
      AND regexp_matches(content, {_q(CONN_SQL)}))""",
}


def with_views(body: str) -> str:
    """``body`` preceded by the views it names, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, sql in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(sql)

    visit(body)
    views = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in needed]
    body = body.strip()
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body
