"""Lookups, statistics, exports and the streamed store on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilog.operators import ingest, lookups, snapshots, stats
from vigilog.rules.pack import packaged_rules
from vigilog.session import shared_dir
from vigilog.sources import exports, sinks
from vigilog.streaming import live
from vigilog.streaming.store import LogStore, row_id

NOW = datetime(2025, 12, 6, 12)
F_TIME = datetime(2025, 12, 6, 11)
LINES = [
    (1, "linux", "Dec  6 10:00:00 host1 syslog[1]: Test one", 120),
    (2, "windows", '{"event_id": 4625, "channel": "Security", "message": "Test two"}', 60),
    (3, "nginx", '10.0.0.5 - - [06/Dec/2025:11:59:30 +0000] "GET /Test HTTP/1.1" 404 10', 0),
]


@pytest.fixture(scope="module")
def tables(spark):
    logs = spark.createDataFrame(
        [(i, 7, NOW - timedelta(minutes=m), s, c) for i, s, c, m in LINES],
        "id bigint, server_id bigint, recv_time timestamp, log_source string, content string",
    )
    servers = spark.createDataFrame(
        [(7, "host1", "10.0.0.1", "linux"), (8, "idle", "10.0.0.2", "nginx")],
        "id bigint, hostname string, ip_address string, server_type string",
    )
    alerts = spark.createDataFrame(
        [
            ("a_1", 1, 7, "linux", "a", "high", "A", "d", NOW, False),
            ("b_2", 2, 9, "windows", "b", "critical", "B", None, NOW - timedelta(hours=2), True),
        ],
        "alert_id string, log_entry_id bigint, server_id bigint, log_source string, "
        "rule_id string, severity string, title string, description string, "
        "triggered_at timestamp, resolved boolean",
    )
    return logs, servers, alerts


def test_lookups(tables):
    logs, servers, _ = tables
    newest = lookups.recent_logs(logs, servers, limit=2).orderBy(F.desc("recv_time")).collect()
    assert [r.log_source for r in newest] == ["nginx", "windows"]
    assert lookups.recent_logs(logs, servers, log_type="linux").count() == 1
    assert lookups.search_logs(logs, servers, text="Test").count() == 3
    assert lookups.search_logs(logs, servers, text="t_st", hostname="host1").count() == 3
    assert lookups.search_logs(logs, servers, hostname="idle").count() == 0
    assert lookups.incremental_fetch(logs, servers, 1, 1).first().id == 2
    linux = ingest.linux_details(logs)
    assert linux.first().app_name == "syslog"
    assert lookups.unparsed_backlog(logs, linux, "linux").count() == 0
    detail = lookups.log_detail(
        logs, servers, linux, ingest.windows_details(logs), ingest.nginx_details(logs), log_id=3
    ).collect()
    assert len(detail) == 1 and detail[0].nginx.status == 404 and detail[0].linux is None


def test_server_statistics(tables):
    logs, servers, alerts = tables
    activity = {r.id: r for r in stats.server_activity(servers, logs).collect()}
    assert (activity[7].log_count, activity[7].status) == (3, "online")
    assert (activity[8].log_count, activity[8].status) == (0, "offline")
    later = F.lit(NOW + timedelta(minutes=30))
    assert stats.server_activity(servers, logs, later).first().status == "delayed"
    found = lookups.search_servers(stats.server_stats(servers, logs, alerts), search="HOST")
    assert [(r.id, r.total_alerts, r.active_alerts) for r in found.collect()] == [(7, 1, 1)]
    named = {r.server: r.alerts for r in stats.alerts_by_server(alerts, servers).collect()}
    assert named == {"host1": 1, "ID:9": 1}
    overview = stats.dashboard_overview(logs, servers, alerts).first()
    assert (overview.logs_last_hour, overview.alerts_active, overview.threat_level) == (
        2, 1, "high",
    )
    timeline = stats.server_timeline(servers, logs, alerts, hours=3, server_id=7).collect()
    assert [(r.hour.hour, r.logs, r.alerts) for r in timeline] == [
        (10, 1, 0), (11, 1, 0), (12, 1, 1),
    ]


@pytest.mark.parametrize(
    "critical, high, level",
    [(6, 0, "critical"), (5, 0, "high"), (0, 11, "high"), (0, 10, "medium"), (0, 0, "low")],
)
def test_threat_levels(spark, critical, high, level):
    df = spark.range(1).select(stats.threat_level(F.lit(critical), F.lit(high)))
    assert df.first()[0] == level


def test_alert_pages_and_states(tables):
    _, _, alerts = tables
    page = lookups.filter_alerts(alerts, hours=1).collect()
    assert [(r.alert_id, r.total) for r in page] == [("a_1", 1)]
    page = lookups.filter_alerts(alerts, limit=1, offset=1).collect()
    assert [(r.alert_id, r.total) for r in page] == [("b_2", 2)]
    spark = alerts.sparkSession
    actions = spark.createDataFrame(
        [
            ("a_1", "resolve", NOW), ("a_1", "reopen", NOW - timedelta(hours=1)),
            ("b_2", "acknowledge", NOW), ("zz", "resolve", NOW),
        ],
        "alert_id string, action string, at timestamp",
    )
    state = {r.alert_id: r for r in snapshots.current_alerts(alerts, actions).collect()}
    assert (state["a_1"].resolved, state["a_1"].acknowledged) == (True, False)
    assert (state["b_2"].resolved, state["b_2"].acknowledged) == (True, True)
    found = {r.alert_id: r.found for r in snapshots.action_results(alerts, actions).collect()}
    assert found == {"a_1": True, "b_2": True, "zz": False}


KEY = "ab" * 32


def test_encrypted_export(tables):
    _, servers, alerts = tables
    rows = exports.alert_rows(lookups.alerts_left_server(alerts, servers))
    sealed = exports.encrypt_alerts(rows, KEY)
    assert not any("\n" in r[0] for r in sealed.collect())
    back = {r.alert_id: r for r in exports.decrypt_alerts(sealed, KEY).collect()}
    assert (back["a_1"].hostname, back["b_2"].hostname) == ("host1", "Unknown")
    wrong = exports.decrypt_alerts(sealed, "cd" * 32).collect()
    assert [r.alert_id for r in wrong] == [None, None]
    with pytest.raises(ValueError):
        exports.encrypt_alerts(rows, "abcd")


def test_csv_export_doubles_quotes(spark, tmp_path):
    rows = [(NOW, "ERROR", "nginx", 'say "hi", now\nnext'), (NOW, "INFO", "linux", "x")]
    logs = spark.createDataFrame(
        rows, "recv_time timestamp, level string, source string, message string"
    )
    path = str(tmp_path / "csv")
    sinks.export_logs_csv(logs, path, level="ERROR")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '"say ""hi"", now\nnext"' in text and text.startswith("Timestamp,Level,Source,Message")
    schema = ", ".join(f"{c} string" for c in sinks.CSV_COLUMNS)
    back = spark.read.schema(schema).options(**sinks.CSV_OPTIONS).csv(path).collect()
    assert [r.Message for r in back] == ['say "hi", now\nnext']


def test_parsed_batch_formats(spark, tmp_path):
    rows = [(NOW, "10.0.0.1", c) for _, _, c, _ in LINES] + [(NOW, "10.0.0.1", "junk")]
    parsed = ingest.parse_lines(
        spark.createDataFrame(rows, "recv_time timestamp, src_ip string, line string")
    )
    for kind in ("json", "csv"):
        path = tmp_path / kind
        sinks.write_parsed_batch(parsed, str(path), kind)
        folders = sorted(p.name for p in path.iterdir() if p.is_dir())
        assert folders == ["log_type=linux", "log_type=nginx", "log_type=windows"]
        reader = spark.read.options(**sinks.CSV_OPTIONS) if kind == "csv" else spark.read
        linux = getattr(reader, kind)(f"{path}/log_type=linux").first()
        assert (linux.app_name, linux.raw_message, linux.hostname) == ("syslog", "Test one", "host1")
        nginx = getattr(reader, kind)(f"{path}/log_type=nginx").first()
        assert (int(nginx.status), nginx.request_uri) == (404, "/Test")
        windows = getattr(reader, kind)(f"{path}/log_type=windows").first()
        assert '"event_id":"4625"' in windows.attrs
    with pytest.raises(ValueError):
        sinks.write_parsed_batch(parsed, str(tmp_path / "x"), "xml")


def test_store_is_appended_batch_by_batch(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    checkpoint = str(tmp_path / "checkpoint")

    def run(name: str, *lines: str):
        (folder / name).write_bytes(b"\n".join(x.encode("latin-1") for x in lines))
        raw = live.stream_raw_logs(spark, str(folder))
        live.append_log_store(raw, store, checkpoint).awaitTermination()

    line = "Dec  6 10:00:03 web1 sshd[1]: Failed password for root from 10.1.1.1 port 1 ssh2"
    run("one.log", line, line, "  ", "no log", LINES[1][2])
    run("two.log", line, "Dec  6 10:00:04 web2 app: caf\xe9")
    logs = spark.read.schema(live.LOG_SCHEMA).parquet(f"{store}/log_entry")
    assert logs.count() == 5 and logs.select("id").distinct().count() == 5
    details = spark.read.parquet(f"{store}/linux_log_details")
    assert details.join(logs, details.log_entry_id == logs.id).count() == 4
    assert details.where("ssh_user = 'root'").count() == 3
    assert details.where("raw_message = 'caf\ufffd'").count() == 1
    servers = {r.hostname: r for r in live.store_servers(spark, store).collect()}
    assert sorted(servers) == ["unknown", "web1", "web2"]
    seen = logs.where("hostname = 'web1'").agg(F.min("recv_time"), F.max("recv_time")).first()
    assert (servers["web1"].first_seen, servers["web1"].last_seen) == tuple(seen)
    assert {(int(r.id) >> 64, r.batch) for r in logs.collect()} == {(0, 0), (1, 1)}
    store = LogStore(spark, store)
    assert store.counters() == {"received": 6, "parsed": 5, "saved": 5, "errors": 1, "batches": 2}


def test_ids_have_no_limit(spark):
    rows = spark.range(0, 3, 1, 1).select(row_id(1 << 40).alias("id"))
    first = [int(r.id) for r in rows.collect()]
    assert [i - (1 << 104) for i in first] == [0, 1, 2]
    # As large as a task's rows may get, and more tasks than any job has.
    top = F.lit(str((1 << 60) << 64)).cast("decimal(38,0)") + F.lit(2**63 - 1).cast("decimal(38,0)")
    assert int(spark.range(1).select(top.cast("decimal(38,0)").alias("x")).first().x) == (1 << 124) + 2**63 - 1


def envelopes_of(spark, *lines):
    rows = [(F_TIME, "10.0.0.1", x) for x in lines]
    return spark.createDataFrame(rows, "recv_time timestamp, src_ip string, line string")


LINE = "Dec  6 10:00:03 web1 sshd[1]: Failed password for root from 10.1.1.1 port 1 ssh2"


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "store"))
    assert store.entries() == [] and store.table("log_entry", live.LOG_SCHEMA).count() == 0
    store.commit(live.write_batch(store, envelopes_of(spark, LINE, "no log", LINE), 0))
    seen = live.store_logs(spark, store.path)

    def fails(rows):
        raise OSError("lost between two tables")

    with monkeypatch.context() as patch:
        patch.setattr(live.stats, "sightings", fails)
        with pytest.raises(OSError):
            store.commit(live.write_batch(store, envelopes_of(spark, LINE), 1))
    # Its log rows and details lie there, but no manifest names them.
    assert spark.read.parquet(store.folder("log_entry", 1)).count() == 1
    assert live.store_logs(spark, store.path).count() == 2 == store.table("linux_log_details").count()
    store.commit(live.write_batch(store, envelopes_of(spark, LINE), 1))
    assert live.store_logs(spark, store.path).count() == 3 and seen.count() == 2
    assert store.counters() == {"received": 4, "parsed": 3, "saved": 3, "errors": 1, "batches": 2}


def test_a_batch_without_a_log_is_counted(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    excluded = spark.conf.get("spark.sql.adaptive.optimizer.excludedRules", None)
    store.commit(live.write_batch(store, envelopes_of(spark, "no log", "none either"), 0))
    store.commit(live.write_batch(store, envelopes_of(spark), 1))
    assert store.counters() == {"received": 2, "parsed": 0, "saved": 0, "errors": 2, "batches": 1}
    assert live.store_logs(spark, store.path).count() == 0 == store.table("linux_log_details").count()
    store.commit(live.write_batch(store, envelopes_of(spark, LINE), 2))
    assert live.compact_store(spark, store.path) == -1
    assert live.store_logs(spark, store.path).count() == 1 == store.table("linux_log_details").count()
    assert live.search_store(spark, store.path, "failed password").count() == 1
    assert spark.conf.get("spark.sql.adaptive.optimizer.excludedRules", None) == excluded


def test_a_batch_of_a_stream_without_a_log_is_counted(spark, tmp_path):
    folder, store = tmp_path / "in", LogStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "one.log").write_text("no log\nnone either\n\n")
    live.append_log_store(live.stream_raw_logs(spark, str(folder)), store.path, str(tmp_path / "c")).awaitTermination()
    assert store.counters() == {"received": 2, "parsed": 0, "saved": 0, "errors": 2, "batches": 1}


def test_a_committed_batch_is_not_written_again(spark, tmp_path):
    folder, store = tmp_path / "in", LogStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "one.log").write_text(LINE)
    store.commit(live.write_batch(store, envelopes_of(spark, LINE, LINE), 0))
    files = sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet"))
    # A query that lost its checkpoint after the commit meets the batch again.
    live.append_log_store(live.stream_raw_logs(spark, str(folder)), store.path, str(tmp_path / "c")).awaitTermination()
    assert sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet")) == files
    assert live.store_logs(spark, store.path).count() == 2


def test_readers_during_a_compaction(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "store"))
    for i in range(3):
        store.commit(live.write_batch(store, envelopes_of(spark, LINE, LINE.replace("web1", f"web{i}")), i))
    before = live.store_logs(spark, store.path)
    want = sorted(map(tuple, before.drop("batch").collect()))
    commit = LogStore.commit

    def seen_before_commit(self, entry):
        # Everything is written, nothing is named: readers have the old batches.
        assert sorted(map(tuple, live.store_logs(spark, store.path).drop("batch").collect())) == want
        commit(self, entry)

    monkeypatch.setattr(LogStore, "commit", seen_before_commit)
    number = store.compact(live.STORE_SCHEMAS, live.STORE_PARTITIONS)
    monkeypatch.setattr(LogStore, "commit", commit)
    after = live.store_logs(spark, store.path)
    assert number == -1 and {r.batch for r in after.collect()} == {-1}
    assert sorted(map(tuple, after.drop("batch").collect())) == want == sorted(map(tuple, before.drop("batch").collect()))
    assert store.table("linux_log_details").count() == 6
    assert len(live.store_servers(spark, store.path).collect()) == 3
    assert store.counters()["batches"] == 3 and store.compact(live.STORE_SCHEMAS) is None
    store.commit(live.write_batch(store, envelopes_of(spark, LINE), 3))
    assert live.store_logs(spark, store.path).count() == 7
    assert store.vacuum() == [0, 1, 2] and live.store_logs(spark, store.path).count() == 7
    assert store.compact(live.STORE_SCHEMAS, live.STORE_PARTITIONS) == -2
    assert live.store_logs(spark, store.path).count() == 7


def test_streamed_alerts_equal_batch_alerts(spark, tables, tmp_path):
    from vigilog.operators import detect

    logs, _, _ = tables
    path, out = str(tmp_path / "logs"), str(tmp_path / "alerts")
    logs.repartition(3).write.parquet(path)
    rows = live.stream_table(spark, path, logs.schema, files_per_batch=1)
    live.stream_detection(rows, packaged_rules(), out, str(tmp_path / "c")).awaitTermination()
    got = sorted(r.alert_id for r in spark.read.parquet(out).collect())
    want = sorted(r.alert_id for r in detect.run_rules(logs, packaged_rules()).collect())
    assert got == want and "win-logon-failed_2" in want


class NamedFolder:
    """A session whose settings name a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.checkpoint.dir": "file:/shared/place/"}.get(key, default)


class Cluster(NamedFolder):
    class conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "yarn"}.get(key, default)


def test_shared_folder_comes_from_the_session():
    first, second = (shared_dir(NamedFolder, "x") for _ in range(2))
    assert first.startswith("file:/shared/place/x-") and first != second
    with pytest.raises(ValueError):
        shared_dir(Cluster, "x")


def test_pages_keep_their_order_without_broadcast(spark):
    from vigilog.operators import lookups

    rows = [(i, i % 7, f"2024-01-{1 + i % 28:02d}", "linux", f"line {i}") for i in range(200)]
    logs = spark.createDataFrame(
        rows, "id bigint, server_id bigint, t string, log_source string, content string"
    ).selectExpr("id", "server_id", "CAST(t AS timestamp) AS recv_time", "log_source", "content")
    servers = spark.createDataFrame([(i, f"h{i}", "a") for i in range(7)], "id bigint, hostname string, ip_address string")
    alerts = logs.selectExpr("concat('a', id) AS alert_id", "id AS log_entry_id", "server_id", "recv_time AS triggered_at")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        recent = [(r.recv_time, r.id) for r in lookups.recent_logs(logs, servers, 30).collect()]
        found = [(r.recv_time, r.id) for r in lookups.search_logs(logs, servers, "line", limit=30).collect()]
        after = [r.id for r in lookups.incremental_fetch(logs, servers, 50, 30).collect()]
        report = [(r.triggered_at, r.alert_id) for r in lookups.alert_report(alerts, logs, servers, 30).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert recent == sorted(recent, reverse=True) and found == recent and len(recent) == 30
    assert after == list(range(51, 81))
    assert report == sorted(report, reverse=True) and len(report) == 30


def test_registry_times_move(spark):
    at = lambda *days: spark.createDataFrame(
        [("h", "a", "linux", NOW + timedelta(days=d)) for d in days],
        "hostname string, ip_address string, server_type string, recv_time timestamp",
    )
    seen = stats.sightings(at(1, 2)).unionByName(stats.sightings(at(5, 0)))
    row = stats.registry(seen).collect()
    assert [(r.first_seen, r.last_seen) for r in row] == [(NOW, NOW + timedelta(days=5))]
    assert [r.is_new for r in stats.register_servers(at(1), at(0)).collect()] == [False]
    assert [r.is_new for r in stats.register_servers(at(1), at()).collect()] == [True]


def test_record_hooks_skip_the_records_they_fail_on(spark, tables):
    from vigilog.operators import hooks

    def change(record):
        if record["id"] == 2:
            raise RuntimeError("no")
        return {"content": record["content"].upper(), "other": 1} if record["id"] == 1 else None

    logs = tables[0]
    got = {r.id: r.content for r in hooks.run_log_hooks(logs, [hooks.record_hook(change)]).collect()}
    assert got == {1: LINES[0][2].upper(), 2: LINES[1][2], 3: LINES[2][2]}


def test_threshold_stream_drops_late_rows(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "server_id bigint, recv_time timestamp"
    for days in ([0, 0, 0], [5], [5], [0, 0]):
        rows = [(1, NOW + timedelta(days=d)) for d in days]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    rows = live.stream_table(spark, path, schema, files_per_batch=1)
    live.stream_threshold(rows, "server_id", "1 day", 1, out, str(tmp_path / "c"), "1 day").awaitTermination()
    updates = spark.read.parquet(out)
    got = live.latest_windows(updates, "server_id").orderBy("window_start").collect()
    assert [r.matches for r in got] == [3, 2]


def test_the_key_stands_in_no_plan(spark, capsys):
    key = "0f" * 32
    rows = spark.createDataFrame([("a", "t")], "alert_id string, title string")
    sealed = exports.encrypt_alerts(rows, key)
    opened = exports.decrypt_alerts(sealed, key)
    for df in (sealed, opened):
        told = df._jdf.queryExecution().toString().lower()
        assert key not in told and "0f, 0f" not in told
    assert opened.first().title == "t"
    assert exports.decrypt_alerts(sealed, "0e" * 32).first().alert_id is None


def test_reports_read_rollups_and_no_logs(spark, tmp_path):
    from vigilog.operators import rollups

    store = LogStore(spark, str(tmp_path / "store"))
    lines = [LINE.replace("10:00", f"{h:02d}:0{m}").replace("web1", f"web{h % 3}") for h in range(8, 14) for m in range(3)]
    for n in range(3):  # each hour's logs come in three batches
        store.commit(live.write_batch(store, envelopes_of(spark, *lines[n::3], "no log"), n))
    rows, logs = live.store_hourly(spark, store.path), live.store_logs(spark, store.path)
    assert rows.agg(F.sum("logs")).first()[0] == logs.count() == len(lines)
    assert rows.count() == logs.select(F.date_trunc("hour", "recv_time"), "server_id", "log_source").distinct().count()
    servers = live.store_servers(spark, store.path)
    alerts = spark.createDataFrame([], "server_id long, triggered_at timestamp, severity string, resolved boolean")
    for name, args in (
        ("server_timeline", (servers, "logs", alerts, 24)), ("log_totals", ("logs", servers, alerts)),
        ("server_breakdown", ("logs", alerts, servers)), ("parse_coverage", ("logs",)),
    ):
        rolled, whole = (
            getattr(module, name)(*[table if a == "logs" else a for a in args])
            for module, table in ((rollups, rows), (stats, logs))
        )
        assert sorted(map(tuple, rolled.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
        assert not any("log_entry" in f for f in rolled.inputFiles())
    seen = store.table("hourly_addresses", live.STORE_SCHEMAS["hourly_addresses"])
    assert rollups.distinct_addresses(seen).first().addresses == logs.select("ip_address").distinct().count()
    store.compact(live.STORE_SCHEMAS, live.STORE_PARTITIONS)
    again = live.store_hourly(spark, store.path)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_search_reads_matching_files_only(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    for n, word in enumerate(("alpha", "Bravo", "charlie")):
        lines = [LINE.replace("root", f"{word}{i}") for i in range(5)]
        store.commit(live.write_batch(store, envelopes_of(spark, *lines), n))
    whole = live.store_logs(spark, store.path)

    def found(text):
        rows = live.search_store(spark, store.path, text)
        want = whole.where(F.col("content").ilike(f"%{text}%"))
        assert sorted(r.id for r in rows.collect()) == sorted(r.id for r in want.collect())
        return rows

    for text, files in (("bravo3", 1), ("BRAVO", 1), ("for _lpha4", 1), ("for%charlie", 1), ("nothing here", 0)):
        assert len(found(text).inputFiles()) == files
    for text in ("a", "%", "f_r", "f\u00e9", "10.1.1.1"):
        assert len(found(text).inputFiles()) == 3 or text == "f\u00e9"
    # Batches without an index are read whole; a compaction makes the index anew.
    store.commit(live.write_batch(store, envelopes_of(spark, LINE), 3))
    entry = [e for e in store.committed() if e.batch == 3][0]
    assert "text_index" in entry.tables
    whole = live.store_logs(spark, store.path)
    assert live.compact_store(spark, store.path) == -1
    assert live.search_store(spark, store.path, "bravo3").count() == 1
    assert all("batch=-1" in f for f in live.search_store(spark, store.path, "bravo3").inputFiles())


def test_index_of_odd_texts(spark, tmp_path):
    from vigilog.operators import text_index

    path = str(tmp_path / "rows")
    rows = [(1, None), (2, ""), (3, "ab"), (4, "x" * 300_000 + "Needle"), (5, "\u0130stanbul K\u212aelvin")]
    spark.createDataFrame(rows, "id long, content string").repartition(3).write.parquet(path)
    table = spark.read.schema("id long, content string").parquet(path)
    index = text_index.index_files(table)
    for text in ("needle", "ab", "stanbul", "kkelvin", "\u0130stanbul", "", "zzz"):
        got = text_index.read_matching(spark, index, text, "id long, content string", path)
        want = table.where(F.col("content").ilike(f"%{text}%"))
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), text
