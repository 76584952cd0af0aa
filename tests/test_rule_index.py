"""Rules met through the index beside the plain pass."""

import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilog.functions import keyscan
from vigilog.operators import detect, rule_index
from vigilog.rules.pack import Rule, collect_rules, packaged_rules, rules_frame

LOG = "id long, server_id long, recv_time timestamp, log_source string, content string"


def rule(n, source, detection, condition="selection", **more):
    return Rule(f"r{n}", f"t{n}", "", "low", "stable", source, {**detection, "condition": condition}, **more)


def lines():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        user, ip = rng.choice(["root", "alice", "bob"]), f"10.0.0.{rng.randrange(5)}"
        rows.append(rng.choice([
            ("linux", f"Jan 15 10:00:{i % 60:02d} host sshd[{i}]: Failed password for {user} from {ip} port 22 ssh2"),
            ("linux", f"Jan 15 10:00:{i % 60:02d} host sudo[{i}]: {user} : TTY=pts/0 ; COMMAND=/bin/cat /etc/shadow"),
            ("nginx", f'{ip} - - [15/Jan/2024:10:00:00 +0000] "GET /a?user={user} HTTP/1.1" {rng.choice([200, 404])} 5 "-" "curl/7"'),
            ("windows", f'{{"event_id": "{rng.choice([4624, 4625])}", "channel": "Security", "message": "logon of {user}"}}'),
            ("linux", "no log line with /etc/shadow"), ("windows", None), ("other", "root"),
        ]))
    return [(i, i % 4, None, *r) for i, r in enumerate(rows)]


SHAPES = [
    {"selection": {"Message|contains": ["failed", "SHADOW"]}},
    {"selection": {"Message|contains": "a"}},  # too short for a key
    {"selection": {"ProcessName": ["sshd", "cron"], "User|startswith": "ro"}},
    {"selection": {"User": "Alice"}},
    {"selection": {"EventID": 4625, "Message|endswith": "root"}},
    {"selection": {"StatusCode|in": ["404", "500"]}},
    {"selection": {"StatusCode|not_in": ["404"], "Url|contains": "user="}},
    {"selection": {"Url|re": "user=(root|bob)$"}},
    {"selection": {"Url": "/a*root"}},
    {"selection": {"Referer|empty": "true"}},
    {"selection": {"Referer|empty": "false", "UserAgent|contains": "curl"}},
    {"selection": {"BytesSent|gte": 3}},
    {"selection": ["password", "cat"]},
    {"selection": [{"Message|contains": "bob"}, {"ProcessName": "sudo"}]},
    {"selection": {"Message|contains": ""}},
    {"selection": {"Message|contains": "two\nlines"}},
    {"selection": {}, "other": {"m": 1}},
]


def rules():
    made = [rule(f"{k}-{s}", s, d) for k, d in enumerate(SHAPES) for s in ("linux", "windows", "nginx")]
    two = {"a": {"Message|contains": "root"}, "b": {"Message|contains": "failed"}}
    for k, c in enumerate(["a and b", "a or b", "a and not b", "not b", "b and not a", "1 of a", "a or not b"]):
        made += [rule(f"c{k}-{s}", s, two, c) for s in ("linux", "windows", "nginx")]
    made += [rule(f"f{k}", "linux", d, require_fields=True) for k, d in enumerate(SHAPES[:4])]
    return made + [r for r in packaged_rules()]


@pytest.mark.parametrize("mode", ["intent", "compat"])
def test_same_alerts_as_the_plain_pass(spark, mode):
    logs = spark.createDataFrame(lines(), LOG)
    active = rules()
    want = sorted(tuple(map(str, r)) for r in detect.run_rules(logs, active, mode).collect())
    got = sorted(tuple(map(str, r)) for r in rule_index.run_rules(logs, active, mode).collect())
    assert got == want and len({r[1] for r in want}) > 15
    indexes, plain = rule_index.split_rules(detect.row_rules(active, mode), mode)
    assert plain and sum(len(i.trees) for i in indexes.values()) > len(plain) / 2


def test_needed_texts():
    def needed(detection, condition="selection"):
        tree = rule_index.condition_tree(rule(0, "linux", detection, condition))
        return None if tree is None else rule_index.needed_texts(tree)

    assert needed(SHAPES[0]) == {"failed", "shadow"}
    assert needed(SHAPES[2]) == {"sshd", "cron"} or needed(SHAPES[2]) == {"ro"}
    assert needed(SHAPES[1]) is needed(SHAPES[7]) is needed(SHAPES[9]) is needed(SHAPES[15]) is None
    two = {"a": {"Message|contains": "root"}, "b": {"Message|contains": "failed"}}
    assert needed(two, "a and b") == {"failed"} and needed(two, "a or b") == {"root", "failed"}
    assert needed(two, "a and not b") == {"root"} and needed(two, "not b") is None


def test_no_rules_and_no_logs(spark):
    logs = spark.createDataFrame(lines(), LOG)
    assert rule_index.run_rules(logs, []).collect() == []
    assert rule_index.run_rules(logs.limit(0), rules()).collect() == []


def test_many_rules_cost_little(spark):
    logs = spark.createDataFrame(lines() * 40, LOG).repartition(4).cache()
    logs.count()

    def many(n):
        decoys = [rule(f"d{i}", "linux", {"selection": {"Message|contains": f"marker {i * 7919} of a campaign"}}) for i in range(n)]
        return [*decoys, rule("x", "linux", {"selection": {"Message|contains": "failed"}})]

    def run(n):
        start = time.perf_counter()
        found = rule_index.run_rules(logs, many(n)).select("rule_id").collect()
        return time.perf_counter() - start, [r[0] for r in found]

    run(10)
    few, want = run(200)
    lots, got = run(20_000)
    assert got == want and set(got) == {"rx"}
    print(f"200 rules {few:.2f} s, 20,000 rules {lots:.2f} s")
    assert lots < 5 * few + 10
    logs.unpersist()


def as_table(spark, rules):
    return rules_frame(spark, [vars(r) for r in rules]).repartition(3)


@pytest.mark.parametrize("mode", ["intent", "compat"])
def test_a_rule_table_gives_the_same_alerts(spark, mode):
    logs = spark.createDataFrame([*lines(), *lines()[:50]], LOG)  # some rows twice
    odd = [
        rule("u1", "linux", {"selection": {"Message|contains": ["FAILED PASSWORD", "password for", "never"]}}),
        rule("u2", "nginx", {"selection": {"Url|contains": "é" * 40}}),
        rule("u3", "linux", {"selection": {"Message|contains": "shadow"}}, enabled=False),
        rule("u4", "linux", {"selection": {"count|gte": 2}, "more": {"Message|contains": "shadow"}}, "selection or more"),
        rule("u5", "other", {"selection": {"Message|contains": "root"}}),
    ]
    table = as_table(spark, [*rules(), *odd])
    listed = [rule("listed", "linux", {"selection": {"Message|contains": "shadow"}})]
    want = sorted(tuple(map(str, r)) for r in detect.run_rules(logs, [*collect_rules(table), *listed], mode).collect())
    got = sorted(tuple(map(str, r)) for r in rule_index.run_rules(logs, listed, mode, table=table).collect())
    assert got == want and len({r[1] for r in want}) > 15


def test_a_text_beyond_utf8_is_no_key():
    own = rule("s", "linux", {"selection": {"Message|contains": ["\ud800x", "Shadow"]}})
    assert rule_index._compiled_row({**vars(own), "detection": json.dumps(own.detection)}, "intent")["keys"] == ["shadow"]


def test_a_rule_table_stays_off_the_driver(spark, monkeypatch):
    many = spark.range(5000).selectExpr("'linux' AS log_source", "concat('d', id) AS id", "concat('marker ', id * 7919, ';') AS text")
    table = many.select(
        "id", *[F.lit("x").alias(n) for n in ("title", "description", "level", "status")], "log_source",
        F.lit(True).alias("enabled"), F.lit(False).alias("require_fields"),
        *[F.array().cast("array<string>").alias(n) for n in ("falsepositives", "references")], F.lit("a").alias("author"),
        F.to_json(F.struct(F.struct(F.col("text").alias("Message|contains")).alias("selection"))).alias("detection"),
    )
    log = "Jan 15 10:00:00 host app[1]: marker 7919; and marker 39595000; and marker 15838; x"
    logs = spark.createDataFrame([(1, 1, None, "linux", log), (2, 1, None, "windows", log)], LOG)
    read = []
    monkeypatch.setattr(rule_index, "rule_from_row", read.append)  # tasks have their own
    compiled = rule_index.compile_table(table)
    assert compiled.where("tree IS NOT NULL").count() == 5000
    found = rule_index.run_rules(logs, [], table=table)
    assert sorted(r.rule_id for r in found.collect()) == ["d1", "d2"] and not read
    assert "d4321" not in found._jdf.queryExecution().toString()


def test_a_scan_misses_no_key():
    rng = random.Random(1)
    letters = "abcdé ü0€"
    keys = sorted({"".join(rng.choices(letters, k=rng.choice([2, 3, 4, 7, 8, 9, 16, 31, 33, 70]))) for _ in range(400)})
    whole, begun, lengths = keyscan.key_hashes(keys)
    bits = keyscan.bits_for(len(keys))
    data = np.zeros(1 << (bits - 3), np.uint8)
    batches = [pa.RecordBatch.from_arrays([pa.array(whole), pa.array(begun)], ["hash", "begun"])]
    for piece in keyscan.packed_pieces(keyscan.filter_pieces(iter(batches), bits, 12), 12):
        for number, own in zip(piece["piece"].to_pylist(), piece["bytes"].to_pylist()):
            data[number * 512 : (number + 1) * 512] = np.frombuffer(own, np.uint8)
    known = keyscan.KeyFilter(bits, data, sorted(set(lengths.tolist())))
    texts = [None, "", *("".join(rng.choices(letters, k=rng.randrange(60))) + rng.choice(keys) for _ in range(200))]
    told = known.scan(pa.array(texts))
    of = dict(zip(whole.tolist(), keys))
    for text, found in zip(texts, told.to_pylist()):
        assert {k for k in keys if text and k in text} <= {of.get(h) for h in found} and len(found) == len(set(found))
    assert known.scan(pa.array(texts)[50:90]).to_pylist() == told.to_pylist()[50:90]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(keyscan, "_AT_ONCE", 64)  # keys over the borders of what is read at once
        assert known.scan(pa.array(texts)) == told
