"""Queries of sources, sinks, exports, streams and extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.functions.text import strip
from vigilog.operators import detect, hooks, ingest, snapshots
from vigilog.plans.catalog import query, sql_time
from vigilog.plans.fixtures import ACCESS_SQL, FILE_TIME, HEADER_SQL, Tables, _q
from vigilog.session import shared_dir
from vigilog.sources import exports, files, sinks
from vigilog.streaming import live
from vigilog.streaming.store import LogStore

# An example key; a caller passes its own.
EXAMPLE_KEY = "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"


def file_time():
    return F.lit(FILE_TIME).cast("timestamp")


def written(t: Tables, lines, name: str) -> str:
    """Lines written as text files to the shared folder."""
    path = shared_dir(t.spark, name)
    lines.write.text(path)
    return path


def content(t: Tables, *sources: str):
    return t.logs.where(F.col("log_source").isin(*sources)).select("content")


@query(
    "read_text_logs",
    sql=f"""
SELECT '{FILE_TIME}' AS recv_time, 'file_upload' AS src_ip, t AS line FROM typed_line
WHERE t <> ''""",
)
def read_text_logs(t: Tables):
    path = written(t, t.raw_lines.select(F.concat(F.lit("  "), "line", F.lit(" \t"))), "text")
    return files.read_text_logs(t.spark, path, recv_time=file_time())


@query(
    "read_json_logs",
    sql="""
SELECT 'file_upload' AS src_ip, content AS line FROM log_entry WHERE log_source = 'windows'""",
)
def read_json_logs(t: Tables):
    good = content(t, "windows")
    broken = good.select(F.concat("content", F.lit('"')).alias("content"))
    other = content(t, "linux")
    path = written(t, good.unionByName(broken).unionByName(other), "json")
    return files.read_json_logs(t.spark, path, recv_time=file_time()).drop("recv_time")


@query(
    "json_line_counts",
    sql="""
SELECT count(*) FILTER (WHERE log_source = 'windows') AS good,
  count(*) FILTER (WHERE log_source = 'linux') AS bad FROM log_entry""",
)
def json_line_counts(t: Tables):
    path = written(t, content(t, "windows", "linux"), "json")
    return files.json_line_counts(t.spark, path)


@query(
    "read_conn_logs",
    sql="""
SELECT 'file_upload' AS src_ip, content AS line FROM log_entry
WHERE log_source = 'zeek_conn'""",
)
def read_conn_logs(t: Tables):
    rows = content(t, "zeek_conn")
    headers = rows.select(F.concat(F.lit("#fields\t"), "content").alias("content"))
    path = written(t, rows.unionByName(headers), "conn")
    return files.read_conn_logs(t.spark, path, recv_time=file_time()).drop("recv_time")


@query(
    "write_parsed_batch",
    sql=f"""
SELECT log_type, src_ip, line, CASE log_type
  WHEN 'linux' THEN regexp_extract(t, {_q(HEADER_SQL)}, 3)
  WHEN 'nginx' THEN regexp_extract(t, {_q(ACCESS_SQL)}, 4)
  WHEN 'zeek_conn' THEN string_split(t, chr(9))[2]
  ELSE json_extract_string(t, '$.channel') END AS field
FROM typed_line WHERE log_type IS NOT NULL""",
)
def write_parsed_batch(t: Tables):
    path = shared_dir(t.spark, "parsed")
    sinks.write_parsed_batch(ingest.parse_lines(t.raw_lines), path, "csv")
    field = {"linux": "app_name", "nginx": "request_method", "zeek_conn": "uid", "windows": "attrs"}
    out = None
    for log_type, name in field.items():
        rows = t.spark.read.options(**sinks.CSV_OPTIONS).csv(f"{path}/log_type={log_type}")
        value = F.get_json_object(name, "$.channel") if log_type == "windows" else F.col(name)
        rows = rows.select(F.lit(log_type).alias("log_type"), "src_ip", "line", value.alias("field"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "archive_raw_lines",
    sql=f"""
SELECT {sql_time("recv_time")} || ' [' || src_ip || '] ' || line AS value FROM raw_line""",
)
def archive_raw_lines(t: Tables):
    path = shared_dir(t.spark, "archive")
    sinks.archive_raw_lines(t.raw_lines, path)
    return t.spark.read.text(path)


@query(
    "export_logs_csv",
    sql=f"""
SELECT {sql_time("recv_time")} AS "Timestamp", 'ERROR' AS "Level", log_source AS "Source",
  content AS "Message" FROM log_entry
WHERE (contains(lower(content), 'fail') OR contains(content, '" 500 '))
  AND recv_time >= (SELECT max(recv_time) FROM log_entry) - INTERVAL 240 HOUR""",
)
def export_logs_csv(t: Tables):
    from vigilog.operators.lookups import newest

    failed = F.lower("content").contains("fail") | F.col("content").contains('" 500 ')
    logs = t.logs.select(
        "recv_time", F.when(failed, "ERROR").otherwise("INFO").alias("level"),
        F.col("log_source").alias("source"), F.col("content").alias("message"),
    )
    path = shared_dir(t.spark, "csv")
    since = newest(t.logs, "recv_time") - F.expr("INTERVAL 240 HOURS")
    sinks.export_logs_csv(logs, path, level="ERROR", since=since)
    schema = ", ".join(f"{c} string" for c in sinks.CSV_COLUMNS)
    return t.spark.read.schema(schema).options(**sinks.CSV_OPTIONS).csv(path)


@query(
    "export_ocsf",
    sql="""
SELECT l.id, 1 AS activity_id, 1001 AS class_uid, 1 AS severity_id,
  epoch_us(l.recv_time) // 1000 AS time, s.hostname, s.ip_address AS ip, l.log_source AS original_source,
  CASE WHEN l.log_source = 'windows' THEN coalesce(json_extract_string(w.content, '$.message'),
    l.content) ELSE l.content END AS message, d.app_name AS process_name, d.pid AS process_pid
FROM log_entry l JOIN server s ON s.id = l.server_id
LEFT JOIN linux_d d ON d.log_entry_id = l.id LEFT JOIN windows_d w ON w.log_entry_id = l.id""",
)
def export_ocsf(t: Tables):
    events = exports.ocsf_events(t.logs, t.servers, t.linux)
    return events.select(
        "id", "activity_id", "class_uid", "severity_id", "time", "device.hostname", "device.ip",
        "metadata.original_source", "message",
        F.col("process.name").alias("process_name"), F.col("process.pid").alias("process_pid"),
    )


def _alert_export(t: Tables):
    names = t.servers.select(F.col("id").alias("server_id"), "hostname")
    return exports.alert_rows(t.foreign_alerts.join(names, "server_id", "left"))


# Sealed text is a 12-byte nonce, the JSON of the alert and a 16-byte tag.
@query(
    "export_alerts_encrypted",
    sql="""
SELECT CAST(strlen('{"alert_id":"' || a.alert_id || '","title":"' || a.title
  || '","description":"' || a.description || '","severity":"' || a.severity || '","resolved":'
  || CASE WHEN a.resolved THEN 'true' ELSE 'false' END || ',"triggered_at":"'
  || strftime(a.triggered_at, '%Y-%m-%dT%H:%M:%S.%f') || '","hostname":"'
  || coalesce(s.hostname, 'Unknown') || '","metadata":"{' || chr(92) || '"rule_id' || chr(92)
  || '":' || chr(92) || '"' || a.rule_id || chr(92) || '",' || chr(92) || '"log_source' || chr(92)
  || '":' || chr(92) || '"' || a.log_source || chr(92) || '",' || chr(92) || '"log_entry_id'
  || chr(92) || '":' || a.log_entry_id || '}"}') + 28 AS INTEGER) AS bytes
FROM foreign_alert a LEFT JOIN server s ON s.id = a.server_id""",
)
def export_alerts_encrypted(t: Tables):
    sealed = exports.encrypt_alerts(_alert_export(t), EXAMPLE_KEY)
    return sealed.select(F.length(F.unbase64("encrypted_data")).alias("bytes"))


@query(
    "import_alerts_encrypted",
    sql="""
SELECT a.alert_id, a.title, a.description, a.severity, a.resolved,
  strftime(a.triggered_at, '%Y-%m-%dT%H:%M:%S.%f') AS triggered_at,
  coalesce(s.hostname, 'Unknown') AS hostname, '{"rule_id":"' || a.rule_id || '","log_source":"'
    || a.log_source || '","log_entry_id":' || a.log_entry_id || '}' AS metadata
FROM foreign_alert a LEFT JOIN server s ON s.id = a.server_id""",
)
def import_alerts_encrypted(t: Tables):
    path = shared_dir(t.spark, "sealed")
    exports.encrypt_alerts(_alert_export(t), EXAMPLE_KEY).write.text(path)
    sealed = t.spark.read.text(path).withColumnRenamed("value", "encrypted_data")
    return exports.decrypt_alerts(sealed, EXAMPLE_KEY)


# ---- streams, run to the end of what was written ---------------------------------

@query(
    "stream_raw_logs",
    sql="SELECT 'file_upload' AS src_ip, t AS line FROM typed_line WHERE t <> ''",
)
def stream_raw_logs(t: Tables):
    path = written(t, t.raw_lines.select("line"), "lines")
    out = shared_dir(t.spark, "received")
    raw = live.stream_raw_logs(t.spark, path, files_per_batch=4)
    write = raw.writeStream.option("checkpointLocation", shared_dir(t.spark, "checkpoint"))
    write.trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    schema = "recv_time timestamp, src_ip string, line string"
    return t.spark.read.schema(schema).parquet(out).select("src_ip", "line")


def _appended(t: Tables) -> LogStore:
    path = written(t, t.raw_lines.select("line"), "lines")
    store = shared_dir(t.spark, "store")
    raw = live.stream_raw_logs(t.spark, path, files_per_batch=4)
    live.append_log_store(raw, store, shared_dir(t.spark, "checkpoint")).awaitTermination()
    return LogStore(t.spark, store)


# A log row has one id, its details are those of its own text, and its server's span of
# times holds its time; the store is compacted in between.
@query(
    "append_log_store",
    sql="""
SELECT log_type AS log_source, count(*) AS logs, count(*) AS ids, count(*) AS details,
  CAST(sum(length(line)) AS BIGINT) AS chars, sum(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT))::BIGINT AS texts,
  count(*) AS seen FROM typed_line WHERE log_type IS NOT NULL GROUP BY log_type""",
)
def append_log_store(t: Tables):
    log_store = _appended(t)
    log_store.compact(live.STORE_SCHEMAS, live.STORE_PARTITIONS)
    logs = log_store.table("log_entry", live.LOG_SCHEMA)
    details = None
    for table, (source, _) in live.DETAILS.items():
        rows = log_store.table(table, "log_entry_id decimal(38,0), batch bigint").select(
            F.lit(source).alias("log_source"), F.col("log_entry_id").alias("id")
        )
        details = rows if details is None else details.unionByName(rows)
    servers = live.store_servers(t.spark, log_store.path).select(
        F.col("id").alias("server_id"), "first_seen", "last_seen"
    )
    found = logs.join(details.withColumn("detail", F.lit(1)), ["log_source", "id"], "left").join(
        servers, "server_id", "left"
    )
    text = F.conv(F.substring(F.md5("content"), 1, 8), 16, 10).cast("bigint")
    return found.groupBy("log_source").agg(
        F.count("*").alias("logs"),
        F.countDistinct("id").alias("ids"),
        F.count("detail").alias("details"),
        F.sum(F.length("content")).alias("chars"),
        F.sum(text).alias("texts"),
        F.count_if(F.col("recv_time").between(F.col("first_seen"), F.col("last_seen"))).alias("seen"),
    )


@query(
    "store_counters",
    sql="""
SELECT count(*) AS received, count(log_type) AS parsed, count(log_type) AS saved,
  count(*) - count(log_type) AS errors FROM typed_line WHERE t <> ''""",
)
def store_counters(t: Tables):
    told = _appended(t).counters()
    names = ["received", "parsed", "saved", "errors"]
    return t.spark.createDataFrame([tuple(told[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


def _log_table(t: Tables) -> str:
    path = shared_dir(t.spark, "logs")
    t.logs.write.parquet(path)
    return path


@query(
    "stream_detection",
    sql=f"""
SELECT alert_id, log_entry_id, rule_id, severity, {sql_time("triggered_at")} AS recv_time
FROM alert""",
)
def stream_detection(t: Tables):
    out = shared_dir(t.spark, "alerts")
    logs = live.stream_table(t.spark, _log_table(t), t.logs.schema, files_per_batch=4)
    checkpoint = shared_dir(t.spark, "checkpoint")
    live.stream_detection(logs, t.rules, out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).select(
        "alert_id", "log_entry_id", "rule_id", "severity", "recv_time"
    )


@query(
    "stream_parse",
    sql="SELECT log_type, t AS line FROM typed_line WHERE log_type IS NOT NULL",
)
def stream_parse(t: Tables):
    path = written(t, t.raw_lines.select("line"), "lines")
    out = shared_dir(t.spark, "parsed")
    raw = live.stream_raw_logs(t.spark, path, files_per_batch=4)
    live.stream_parse(raw, out, shared_dir(t.spark, "checkpoint")).awaitTermination()
    return t.spark.read.schema("line string, batch bigint, log_type string").parquet(out).select(
        "log_type", "line"
    )


@query(
    "stream_counters",
    sql="SELECT log_source, count(*) AS logs FROM log_entry GROUP BY log_source",
)
def stream_counters(t: Tables):
    out = shared_dir(t.spark, "counters")
    logs = live.stream_table(t.spark, _log_table(t), t.logs.schema)
    checkpoint = shared_dir(t.spark, "checkpoint")
    live.stream_counters(logs, out, checkpoint).awaitTermination()
    schema = "log_source string, logs bigint, batch bigint"
    return live.latest_counters(t.spark.read.schema(schema).parquet(out))


# ---- extensions -------------------------------------------------------------------

TURN = r"^turn (\d+)/(\d+) (\w+): ((?s:.*))$"


def turn_parser() -> ingest.LineParser:
    """Lines of a conversation: number, turn, role and text."""

    def groups(line):
        return F.array(*[F.regexp_extract(line, TURN, i) for i in range(1, 5)])

    def record(raw):
        return F.struct(
            F.get(raw, 0).try_cast("bigint").alias("conv_id"),
            F.get(raw, 1).try_cast("bigint").alias("turn"),
            F.get(raw, 2).alias("role"),
            F.get(raw, 3).alias("text"),
        )

    return ingest.LineParser(
        "turn",
        lambda line: line.rlike(TURN),
        groups,
        lambda raw: raw.isNotNull(),
        record,
        lambda r: F.col(f"{r}.role"),
    )


@query(
    "register_parser",
    sql="""
SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text
FROM conversations""",
)
def register_parser(t: Tables):
    line = F.concat(
        F.lit("turn "), F.col("conv_id").cast("string"), F.lit("/"),
        F.col("turn").cast("string"), F.lit(" "), "role", F.lit(": "), strip(F.col("text")),
    )
    turns = t.read("conversations").select(F.lit("upload").alias("src_ip"), line.alias("line"))
    logs = t.raw_lines.select("src_ip", "line")
    parsers = ingest.DEFAULT_PARSERS.register(turn_parser(), priority=0)
    parsed = ingest.parse_lines(turns.unionByName(logs), parsers)
    return parsed.where(F.col("log_type") == "turn").select("turn.*")


@query(
    "log_hooks",
    sql="""
SELECT id, upper(log_source) AS log_source, CAST(length(content) AS INTEGER) AS size FROM log_entry
WHERE log_source <> 'zeek_conn'""",
)
def log_hooks(t: Tables):
    def without_connections(logs):
        return logs.where(F.col("log_source") != "zeek_conn")

    def failing(logs):
        return logs.select("no_such_column")

    def unchanged(logs):
        return None

    def with_size(logs):
        return logs.select(
            "id", F.upper("log_source").alias("log_source"), F.length("content").alias("size")
        )

    def failing_on_most(record):
        return {"content": record["content"], "server_id": 1 // (record["id"] % 2)}

    record_hooks = [hooks.record_hook(failing_on_most)]
    return hooks.run_log_hooks(
        t.logs, [without_connections, failing, unchanged, *record_hooks, with_size]
    )


@query(
    "resolve_alerts",
    sql="""
SELECT alert_id, CASE WHEN log_entry_id % 7 = 0 THEN false WHEN log_entry_id % 5 = 0 THEN true
  ELSE resolved END AS resolved, log_entry_id % 2 = 0 AS acknowledged FROM alert""",
)
def resolve_alerts(t: Tables):
    log = F.col("log_entry_id")

    def action(name, every, hours):
        return t.alerts.where(log % every == 0).select(
            "alert_id", F.lit(name).alias("action"),
            (F.col("triggered_at") + F.expr(f"INTERVAL {hours} HOURS")).alias("at"),
        )

    actions = action("resolve", 5, 1).unionByName(action("reopen", 7, 2)).unionByName(
        action("acknowledge", 2, 3)
    )
    return snapshots.current_alerts(t.alerts, actions).select(
        "alert_id", "resolved", "acknowledged"
    )


@query(
    "action_results",
    sql="""
SELECT alert_id, true AS found FROM alert
UNION ALL SELECT 'missing_' || id, false FROM log_entry""",
)
def action_results(t: Tables):
    at = F.current_timestamp().alias("at")
    real = t.alerts.select("alert_id", F.lit("resolve").alias("action"), at)
    missing = t.logs.select(
        F.concat(F.lit("missing_"), F.col("id").cast("string")).alias("alert_id"),
        F.lit("resolve").alias("action"), at,
    )
    return snapshots.action_results(t.alerts, real.unionByName(missing)).select(
        "alert_id", "found"
    )
