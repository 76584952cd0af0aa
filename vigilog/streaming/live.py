"""Continuous forms: lines to a log store, logs to alerts, counts and thresholds.

Each query is its batch operator on a stream. Batches are written below a folder
named after the batch number in overwrite mode, so a batch that is run again after
a failure replaces what it wrote before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog.operators import detect, ingest, rollups, stats, text_index
from vigilog.rules.pack import Rule
from vigilog.sources.files import UPLOAD, envelopes
from vigilog.streaming.store import Entry, LogStore, at_once, observed, row_id

DETAILS = {
    "linux_log_details": ("linux", ingest.linux_details),
    "nginx_log_details": ("nginx", ingest.nginx_details),
    "windows_log_details": ("windows", ingest.windows_details),
    "zeek_conn_details": ("zeek_conn", ingest.conn_details),
}
LOG_SCHEMA = (
    "id decimal(38,0), server_id bigint, recv_time timestamp, hostname string, ip_address string, "
    "content string, batch bigint, log_source string, day date"
)


def stream_raw_logs(
    spark: SparkSession, path: str, src_ip: str = UPLOAD, files_per_batch: int | None = None
) -> DataFrame:
    """Envelopes of the lines that arrive in a folder.

    ``sources.files.envelopes`` takes the rows of any other streaming source.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return envelopes(reader.text(path), src_ip=src_ip)


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int | None = None):
    """Rows appended to a Parquet table."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def start(
    rows: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Run ``write`` on every batch: to the end of what is there, or every interval."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.foreachBatch(write).trigger(**trigger).start()


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def append_log_store(
    raw: DataFrame, store: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Lines to ``log_entry``, the detail tables and the server registry of a store.

    A batch of log rows is written first and its details are parsed from what was
    written, so ids are given once. Lines are counted while they are written. The batch is
    seen by readers of ``LogStore`` once all its tables are there. Files per batch and
    interval bound a batch.
    """
    log_store = LogStore(raw.sparkSession, store)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not log_store.has(batch_id):
            log_store.commit(write_batch(log_store, batch, batch_id))

    return start(raw, checkpoint, write, every=every)


def write_batch(log_store: LogStore, batch: DataFrame, batch_id: int) -> Entry:
    """Write the tables of a batch of envelopes; what is to be committed."""
    counted = Observation(f"ingest-{batch_id}-{uuid.uuid4().hex}")
    parsed = ingest.parse_lines(batch).observe(
        counted, F.count("*").alias("received"), F.count("log_type").alias("parsed")
    )
    rows = stored_logs(parsed, batch_id).withColumn("day", F.to_date("recv_time"))
    saved = Observation(f"saved-{batch_id}-{uuid.uuid4().hex}")
    rows = rows.observe(saved, F.count("*").alias("saved"))
    path = log_store.folder("log_entry", batch_id)
    # Few files for each folder; a large one is still written by many tasks.
    dealt = rows.hint("rebalance", "log_source", "day")
    with observed(rows.sparkSession):
        dealt.write.mode("overwrite").partitionBy("log_source", "day").parquet(path)
    base = f"{log_store.path}/log_entry"
    logs = log_store.spark.read.schema(LOG_SCHEMA).option("basePath", base).parquet(path)
    servers = logs.withColumnRenamed("log_source", "server_type")
    tables: dict[str, Callable[[], DataFrame]] = {
        **{table: lambda details=details: details(logs) for table, (_, details) in DETAILS.items()},
        "server": lambda: stats.sightings(servers),
        "hourly": lambda: rollups.hourly(logs),
        "hourly_addresses": lambda: rollups.hourly_addresses(logs),
        "text_index": lambda: index_logs(log_store, batch_id),
    }

    def write(table: str) -> None:
        tables[table]().write.mode("overwrite").parquet(log_store.folder(table, batch_id))

    at_once(log_store.spark, [lambda table=table: write(table) for table in tables])
    told = counted.get
    return Entry(
        batch_id, (*STORE_SCHEMAS, "text_index"), (), told["received"], told["parsed"], saved.get["saved"]
    )


def index_logs(log_store: LogStore, batch: int) -> DataFrame:
    """The skip index of a batch's log rows."""
    folder, base = log_store.folder("log_entry", batch), f"{log_store.path}/log_entry"
    return text_index.index_files(log_store.spark.read.schema(LOG_SCHEMA).option("basePath", base).parquet(folder))


def search_store(spark: SparkSession, store: str, text: str) -> DataFrame:
    """Log rows that hold ``text``; only files that may hold it are read."""
    log_store = LogStore(spark, store)
    plain = [log_store.folder("log_entry", e.batch) for e in log_store.entries() if "text_index" not in e.tables]
    index = log_store.table("text_index", f"{text_index.INDEX}, batch bigint")
    return text_index.read_matching(spark, index, text, LOG_SCHEMA, f"{log_store.path}/log_entry", plain)


def compact_store(spark: SparkSession, store: str) -> int | None:
    """Join the batches of a store, their skip index anew for the new files."""
    log_store = LogStore(spark, store)
    return log_store.compact(STORE_SCHEMAS, STORE_PARTITIONS, {"text_index": index_logs})


def store_logs(spark: SparkSession, store: str) -> DataFrame:
    """Log rows of the whole batches of a store."""
    return LogStore(spark, store).table("log_entry", LOG_SCHEMA)


SERVER_SCHEMA = (
    "id bigint, hostname string, ip_address string, server_type string, "
    "first_seen timestamp, last_seen timestamp, batch bigint"
)


#: What ``LogStore.compact`` needs to know of the store's tables.
STORE_PARTITIONS = {"log_entry": ["log_source", "day"]}
STORE_SCHEMAS = {
    "log_entry": LOG_SCHEMA,
    "server": SERVER_SCHEMA,
    "hourly": f"{rollups.HOURLY}, batch bigint",
    "hourly_addresses": f"{rollups.ADDRESSES}, batch bigint",
    **dict.fromkeys(DETAILS),
}


def store_hourly(spark: SparkSession, store: str) -> DataFrame:
    """The hourly rows that reports read, of all whole batches."""
    return rollups.merged(LogStore(spark, store).table("hourly", STORE_SCHEMAS["hourly"]))


def store_servers(spark: SparkSession, store: str) -> DataFrame:
    """The registry: each server with the first and last time of all batches."""
    return stats.registry(LogStore(spark, store).table("server", SERVER_SCHEMA))


def stored_logs(parsed: DataFrame, batch_id: int = 0) -> DataFrame:
    """Log rows of a batch of parsed lines; lines that do not parse are left out."""
    parsed = parsed.where(F.col("log_type").isNotNull())
    none = F.lit(None).cast("string")
    records = parsed.select(
        F.col("recv_time").alias("_received"),
        "hostname", none.alias("source_ip"), "src_ip", none.alias("log_source"), "log_type",
        F.col("line").alias("raw_line"), "line",
        ingest.record_timestamp().alias("timestamp"),
    )
    resolved = ingest.resolve_envelope(records, F.col("_received"))
    return resolved.select(
        row_id(batch_id).alias("id"),
        F.xxhash64("hostname", "ip_address", "log_source").alias("server_id"),
        "recv_time", "hostname", "ip_address", "content", "log_source",
    )


def stream_parse(
    raw: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Parsed lines, one folder per log type."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = ingest.parse_lines(batch).where(F.col("log_type").isNotNull())
        parsed.write.mode("overwrite").partitionBy("log_type").parquet(
            batch_folder(path, batch_id)
        )

    return start(raw, checkpoint, write, every=every)


def stream_detection(
    logs: DataFrame,
    rules: Sequence[Rule],
    path: str,
    checkpoint: str,
    mode: str = "intent",
    every: str | None = None,
) -> StreamingQuery:
    """Alerts of arriving logs. The checkpoint holds how far the logs were read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        detect.run_rules(batch, rules, mode).write.mode("overwrite").parquet(
            batch_folder(path, batch_id)
        )

    return start(logs, checkpoint, write, every=every)


def stream_alerts_once(alerts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of alerts without repeated ids; state is kept for ``delay``."""
    return alerts.withWatermark("recv_time", delay).dropDuplicatesWithinWatermark(["alert_id"])


def stream_threshold(
    matches: DataFrame,
    key: str,
    timeframe: str,
    limit: int,
    path: str,
    checkpoint: str,
    delay: str = "10 minutes",
    every: str | None = None,
) -> StreamingQuery:
    """Windows of a key with more than ``limit`` matches, updated as they grow.

    Each batch writes the windows that changed; ``latest_windows`` gives the last
    state of each. Windows older than the delay leave the state.
    """
    counts = (
        matches.withWatermark("recv_time", delay)
        .groupBy(F.window("recv_time", timeframe), key)
        .agg(F.count("*").alias("matches"))
        .where(F.col("matches") > limit)
        .select(key, F.col("window.start").alias("window_start"), "matches")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return start(counts, checkpoint, write, mode="update", every=every)


def latest_windows(updates: DataFrame, key: str) -> DataFrame:
    """Last state of every window of ``stream_threshold``; counts only grow."""
    return updates.groupBy(key, "window_start").agg(F.max("matches").alias("matches"))


def stream_counters(
    logs: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Running number of logs per source; each batch writes the totals so far."""
    totals = logs.groupBy("log_source").agg(F.count("*").alias("logs"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return start(totals, checkpoint, write, mode="complete", every=every)


def latest_counters(totals: DataFrame) -> DataFrame:
    """Totals of the last batch of ``stream_counters``; totals only grow."""
    return totals.groupBy("log_source").agg(F.max("logs").alias("logs"))
