"""Literal lines and the fields they must give."""

import pytest
from pyspark.sql import functions as F

from vigilog.functions import parsers as P
from vigilog.functions import text as X
from vigilog.operators import ingest

TIME = "2025-12-06 10:00:00"


def parse(spark, *lines, **options):
    rows = [(i, TIME, "192.0.2.9", line) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "n int, recv_time string, src_ip string, line string")
    return ingest.parse_lines(df, **options).orderBy("n").collect()


SYSLOG = [
    (
        "Dec  4 17:06:42 lap-7 systemd-resolved[157]: Clock moved. Dropping caches.",
        ("Dec  4 17:06:42", "lap-7", "systemd-resolved", 157,
         "Clock moved. Dropping caches.", None, None, None),
    ),
    (
        "Dec  4 17:10:17 lap-7 night-job42: it works TEST TEST",
        ("Dec  4 17:10:17", "lap-7", "night-job42", None,
         "it works TEST TEST", None, None, None),
    ),
    (
        "Mar 14 05:12:59 quay-3 sshd[808]: Failed password for invalid user mira "
        "from 172.20.4.9 port 51514 ssh2",
        ("Mar 14 05:12:59", "quay-3", "sshd", 808,
         "Failed password for invalid user mira from 172.20.4.9 port 51514 ssh2",
         "Failed", "mira", "172.20.4.9"),
    ),
    (
        "<86>Feb 3 21:44:08 quay-5 sshd[77]: Accepted publickey for tove from 172.20.4.31",
        ("<86>Feb 3 21:44:08", "quay-5", "sshd", 77,
         "Accepted publickey for tove from 172.20.4.31", "Accepted", "tove", "172.20.4.31"),
    ),
    (
        "2023-08-19T07:41:30Z quay-9 tool: k m: z",
        ("2023-08-19T07:41:30Z quay-9 tool:", "k", "m", None, "z", None, None, None),
    ),
    (
        "2023-08-19 07:41:31 quay-9 su: Failed password for ola from 172.20.4.2",
        ("2023-08-19 07:41:31", "quay-9", "su", None, "Failed password for ola from 172.20.4.2",
         None, None, None),
    ),
]


def test_syslog_lines(spark):
    found = parse(spark, *[line for line, _ in SYSLOG])
    for row, (line, expected) in zip(found, SYSLOG):
        assert row.log_type == "linux", line
        assert tuple(row.linux) == expected
        assert row.hostname == expected[1]


def test_lines_no_parser_takes(spark):
    lines = [
        "[172.20.8.1] <30>Feb  8 02:09:41 quay-2 cron[5150]: job done",
        '[172.20.8.2] 198.51.100.7 - - [08/Feb/2023:02:09:44 +0000] "GET /stock/7 HTTP/1.1" '
        '204 31 "-" "w3m/0.5"',
        '172.20.8.3 - - [08/Feb/2023:02:09:47] "HEAD /stock HTTP/1.1" 304',
        '{"broken": ',
        '{"a": 1} trailing',
        "",
        "   ",
        "plain text",
    ]
    assert [row.log_type for row in parse(spark, *lines)] == [None] * len(lines)


def test_relay_prefix_is_removed_on_request(spark):
    line = "[172.20.8.1] <86>Feb  8 02:10:05 quay-2 sshd[515]: Accepted password for a from b"
    row = parse(spark, line, strip_prefix=True)[0]
    assert (row.log_type, row.linux.timestamp, row.linux.hostname, row.linux.ssh_user) == (
        "linux", "Feb  8 02:10:05", "quay-2", "a",
    )


def test_access_lines(spark):
    plain, odd, full, dash = parse(
        spark,
        '172.20.9.40 - - [11/May/2023:23:58:01 +0000] "GET /stock/9 HTTP/1.1" 200 1234',
        "10.0.0.1 - bob [11/May/2023:23:58:02 +0000] \"GET /find?k=it's a 'b' HTTP/1.1\" "
        '200 512 "-" "w3m/0.5"',
        '10.0.0.1 - - [06/dec/2025:4:17:07 +0000] "GET /x HTTP/1.1" 404 0 "" "agent"',
        '10.0.0.1 - - [no time] "GET /x HTTP/1.1" 0 0 "-" "-"',
    )
    assert plain.log_type == "nginx"
    n = plain.nginx
    assert (n.status, n.body_bytes_sent, n.http_referer, n.http_user_agent) == (
        200, 1234, None, None,
    )
    assert str(n.timestamp) == "2023-05-11 23:58:01" and n.status_category == "success"
    assert plain.hostname == "172.20.9.40"
    assert odd.nginx.request_uri == "/find?k=it's"
    assert odd.nginx.server_protocol == "a 'b' HTTP/1.1"
    assert (odd.nginx.remote_user, odd.nginx.http_user_agent) == ("bob", "w3m/0.5")
    assert full.nginx.http_referer == "" and full.nginx.status_category == "client_error"
    assert str(full.nginx.timestamp) == "2025-12-06 04:17:07"
    assert dash.nginx.timestamp is None and dash.nginx.status_category is None


def test_strict_access_needs_referer_and_agent(spark):
    lines = [
        '10.0.0.1 - - [06/Dec/2025:04:17:07 +0000] "GET /x HTTP/1.1" 200 1',
        '10.0.0.1 - - [06/Dec/2025:04:17:07 +0000] "GET /x HTTP/1.1" 200 1 "-" "a"',
    ]
    strict = ingest.ParserRegistry([ingest.NGINX_STRICT])
    assert [r.log_type for r in parse(spark, *lines, parsers=strict)] == [None, "nginx"]


def test_windows_lines(spark):
    line = '{"timestamp":"2025-12-06 04:06:30","hostname":"LAP-7","channel":"Security","event_id":4799}'
    row, repeated, nested = parse(
        spark, line, '{"a": 1, "a": 2}', '{"a": {"b": [1, 2]}, "c": null}'
    )
    assert row.log_type == "windows" and row.hostname == "LAP-7"
    assert row.windows["event_id"] == "4799"
    assert repeated.windows == {"a": "2"}
    assert nested.windows == {"a": '{"b":[1,2]}', "c": None}


def test_conn_lines(spark):
    fields = "1700000000.250000 Cabc 10.0.0.1 50000 10.0.0.2 443 tcp ssl 1.5 100 - SF - 0 ShADadF 4 216 3 164"
    with_tail, short = parse(spark, fields.replace(" ", "\t") + "\t(empty)", fields[:-4])
    z = with_tail.zeek_conn
    assert with_tail.log_type == "zeek_conn" and with_tail.hostname == "10.0.0.1"
    assert (z.orig_p, z.orig_bytes, z.resp_bytes, z.duration, z.tunnel_parents) == (
        50000, 100, None, "1.5", None,
    )
    assert str(z.ts) == "2023-11-14 22:13:20.250000"
    assert short.log_type is None


MESSAGE = (
    "A user logged on.\r\nSubject:\r\n\tSecurity ID: S-1-5-18\r\n\tAccount Name: SYSTEM\r\n"
    "no colon here\r\nLogon Information:\r\n\tLogon Type: 3\r\n\tLogon Type: 10\r\n:\r\nTail: a:b "
)


def test_message_fields(spark):
    df = spark.createDataFrame([(MESSAGE,), ("",), (None,)], "m string")
    entries = P.message_entries(F.col("m"))
    rows = df.select(entries.alias("all"), P.distinct_entries(entries).alias("one")).collect()
    assert [tuple(e) for e in rows[0]["all"]] == [
        ("Subject_Security_ID", "S-1-5-18"),
        ("Subject_Account_Name", "SYSTEM"),
        ("LogonInformation_Logon_Type", "3"),
        ("LogonInformation_Logon_Type", "10"),
        ("Tail", "a:b"),
    ]
    assert len(rows[0]["one"]) == 4 and ("LogonInformation_Logon_Type", "10") in map(
        tuple, rows[0]["one"]
    )
    assert rows[1]["all"] == [] and rows[2]["all"] is None


def test_event_record_overrides(spark):
    line = '{"src_ip": "event", "recv_time": "event", "message": "Src:\\n ip: 1\\nrecv_time"}'
    rows = [(TIME, "192.0.2.9", line)]
    df = spark.createDataFrame(rows, "recv_time string, src_ip string, line string")
    row = ingest.event_record(ingest.parse_lines(df)).first()
    assert row.windows["src_ip"] == "192.0.2.9" and row.windows["recv_time"] == TIME
    assert row.windows["Src_ip"] == "1"


def test_canonical_events_are_decided_per_row(spark):
    rows = [
        ({"NewProcessName": r"C:\Windows\cmd.exe", "CallerProcessName": r"C:\a.exe"},),
        ({"CallerProcessName": r"C:\x\b.exe", "channel": "System", "LogName": "Security"},),
    ]
    df = spark.createDataFrame(rows, "attrs map<string,string>")
    new, caller = ingest.canonical_events(df).collect()
    assert (new.process_name, new.process_basename) == ("cmd.exe", "cmd.exe")
    assert (caller.process_name, caller.process_basename, caller.channel) == (
        r"C:\x\b.exe", "b.exe", "System",
    )


def test_registered_parser_has_priority(spark):
    csv = ingest.LineParser(
        "pair",
        lambda line: line.contains("="),
        lambda line: F.split(line, "=", 2),
        ingest.has_groups(2),
        lambda raw: F.struct(F.get(raw, 0).alias("key"), F.get(raw, 1).alias("value")),
        lambda r: F.col(f"{r}.key"),
    )
    line = "Dec  6 10:00:03 host app: a=b"
    first = ingest.DEFAULT_PARSERS.register(csv, priority=0)
    last = ingest.DEFAULT_PARSERS.register(csv)
    assert first.types()[0] == "pair" and last.types()[-1] == "pair"
    assert parse(spark, line, parsers=first)[0].log_type == "pair"
    assert parse(spark, line, "x=1", parsers=last)[0].log_type == "linux"
    assert parse(spark, line, "x=1", parsers=last)[1].pair.value == "1"


@pytest.mark.parametrize(
    "text, bits", [("abca", 1.5), ("", 0.0), ("aaaa", 0.0), ("ab", 1.0), ("añ漢😀", 2.0)]
)
def test_entropy(spark, text, bits):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.shannon_entropy(F.col("t"))).first()[0] == pytest.approx(bits)


def test_entropy_of_a_very_long_text(spark):
    df = spark.range(1).select(F.repeat(F.lit("ab "), 200_000).alias("t"))
    expected = 1.584962500721156
    assert df.select(X.shannon_entropy(F.col("t"))).first()[0] == pytest.approx(expected)


def test_small_text_functions(spark):
    df = spark.createDataFrame(
        [("TP-Link Archer up",), ("sshd: x",), ("UFW BLOCK",), ("hello",)], "m string"
    )
    got = [r[0] for r in df.select(X.categorize_message(F.col("m"))).collect()]
    assert got == ["tplink_router", "linux_auth", "firewall_network", "linux_syslog"]
    one = spark.createDataFrame([("a:b: cron[12]: x", "x" * 151)], "l string, t string")
    row = one.select(
        X.app_name_heuristic(F.col("l")).alias("app"), X.preview(F.col("t"), 150).alias("p")
    ).first()
    assert row.app == "cron" and row.p == "x" * 150 + "..."


def test_envelope_defaults(spark):
    schema = ", ".join(f"{c} string" for c in ingest.ENVELOPE_FIELDS)
    rows = [
        (None, "", "10.0.0.1", "", "linux", "", "line", "Dec  6 10:00:03"),
        ("h", "10.0.0.2", None, "nginx", None, "raw", "line", "2025-12-06 04:17:07"),
        (None, None, None, None, None, None, None, None),
    ]
    ingest_time = F.lit("2030-01-01 00:00:00").cast("timestamp")
    a, b, c = ingest.resolve_envelope(spark.createDataFrame(rows, schema), ingest_time).collect()
    assert (a.hostname, a.ip_address, a.log_source, a.content) == (
        "unknown", "10.0.0.1", "linux", "line",
    )
    assert str(a.recv_time) == "2030-01-01 00:00:00"
    assert (b.hostname, b.ip_address, b.log_source, b.content) == ("h", "10.0.0.2", "nginx", "raw")
    assert str(b.recv_time) == "2025-12-06 04:17:07"
    assert (c.ip_address, c.log_source, c.content) == ("0.0.0.0", "unknown", "{}")


def test_private_use_characters_are_kept(spark):
    (row,) = parse(spark, "Dec  4 17:06:42 lap-7 app[157]: a\ue000b \ue001 c")
    assert row.linux.raw_message == "a\ue000b \ue001 c"
