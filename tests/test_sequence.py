"""Order-dependent operators against plain Python on small data with a hot key."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigilog.operators import correlate, sequence, snapshots, templates

START = datetime(2024, 1, 1)


def hot_events(n=600, seed=3):
    """A third of the rows on one key, with repeated times and long gaps."""
    rng = random.Random(seed)
    rows, now = [], 0.0
    for i in range(n):
        now += rng.choice([0, 0, 0.25, 1, 7, 120, 4000 if i % 50 == 0 else 2])
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(9)}"
        rows.append((i, key, START + timedelta(seconds=now)))
    return rows


def events(spark, rows):
    return spark.createDataFrame(rows, "id bigint, key string, at timestamp").repartition(7)


def test_inter_arrival_across_buckets(spark):
    rows = hot_events()
    last, want = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = (at - last[key]).total_seconds() if key in last else 0.0
        last[key] = at
    for pieces in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(pieces))
        got = sequence.inter_arrival(events(spark, rows), "key", "at", "id").collect()
        assert {r.id: round(r.delta, 6) for r in got} == want
        assert sum(r.is_first for r in got) == len(last)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_positions_continue_from_a_start(spark):
    rows = hot_events(200)
    df = events(spark, rows).withColumn("start", F.lit(40).cast("bigint"))
    got = sequence.in_order(df, ["key"], "at", "id", first_position="start").collect()
    want, seen = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = 40 + seen.get(key, 0)
        seen[key] = seen.get(key, 0) + 1
    assert {r.id: r.position for r in got} == want


def test_trailing_counts_across_buckets(spark):
    rows = [(i, k, at.replace(microsecond=0)) for i, k, at in hot_events()]
    for seconds, bucket in ((300, 300), (300, 3600), (10, 15)):
        got = sequence.trailing_counts(events(spark, rows), "key", "at", seconds, bucket).collect()
        found = {(r.key, r.second): r.recent for r in got}
        assert len(found) == len(got)
        for _, key, at in rows:
            recent = sum(
                1 for _, k, t in rows if k == key and 0 <= (at - t).total_seconds() <= seconds
            )
            second = int((at - datetime(1970, 1, 1)).total_seconds())
            assert found[(key, second)] == recent


def test_brute_force_defaults(spark):
    rows = [(i, "a", START + timedelta(seconds=50 * i)) for i in range(8)]
    rows += [(100 + i, "b", START + timedelta(seconds=100 * i)) for i in range(8)]
    got = correlate.brute_force(events(spark, rows), "key", time="at").collect()
    assert sorted((r.id, r.recent) for r in got) == [(5, 6), (6, 7), (7, 7)]


def test_threshold_of_a_rule(spark):
    from vigilog.rules.pack import packaged_rules

    line = '10.0.0.9 - - [01/Jan/2024:00:00:00 +0000] "GET /api/items HTTP/1.1" 200 5 "-" "a"'
    rows = [(i, 1, START + timedelta(seconds=i), "nginx", line) for i in range(60)]
    rows += [(i, 1, START + timedelta(seconds=120 + i), "nginx", line) for i in range(40)]
    logs = spark.createDataFrame(
        rows, "id bigint, server_id bigint, recv_time timestamp, log_source string, content string"
    )
    got = correlate.threshold_alerts(logs, packaged_rules()).collect()
    assert correlate.threshold_alerts(logs, [r for r in packaged_rules() if r.log_source == "windows"]).collect() == []
    assert [(r.rule_id, r.source, r.matches) for r in got] == [("web-item-rush", "10.0.0.9", 60)]


def test_snapshot_diff(spark):
    rows = [("1", "a"), ("1", "b"), ("3", "b"), ("3", "c"), ("3", "c"), ("4", "a")]
    df = spark.createDataFrame(rows, "snapshot string, item string")
    got = {tuple(r) for r in snapshots.snapshot_diff(df).collect()}
    assert got == {
        ("3", "a", "removed"), ("3", "c", "added"),
        ("4", "a", "added"), ("4", "b", "removed"), ("4", "c", "removed"),
    }


def test_template_merge_rounds(spark):
    messages = [(f"user u{i} logged in from <IP> at door d{j}",) for i in range(4) for j in range(3)]
    messages += [("completely different text",)]
    df = spark.createDataFrame(messages, "m string")
    masked = templates.masked_templates(df, "m")
    assert masked.count() == 13
    merged = {r.template: r.size for r in templates.merge_templates(masked).collect()}
    assert merged == {
        "user <*> logged in from <IP> at door <*>": 12, "completely different text": 1,
    }


def test_masks(spark):
    df = spark.createDataFrame([("from 10.0.0.1 port 22 id 0xFFa1 u7 v1.2",)], "m string")
    got = df.select(templates.mask_variables(F.col("m"))).first()[0]
    assert got == "from <IP> port <NUM> id <HEX> u7 v1.<NUM>"
