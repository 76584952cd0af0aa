"""Operators with state along a stream: late rows, restarts, initial and read-back state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigilog.operators import anomaly, correlate
from vigilog.rules.compiler import branches_of, check_counts, count_range, counting_of, plain_part
from vigilog.rules.pack import Rule
from vigilog.session import shared_dir
from vigilog.streaming import live, stateful

START = dt.datetime(2024, 1, 1)
EVENT = "id long, host string, log_source string, recv_time timestamp, slots array<int>, entropy double"
MODEL = {"window": 20, "threshold": 0.4}


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


class Stream:
    """A table that grows file by file, and an operator that is stopped and started between."""

    def __init__(self, spark, schema, operator):
        self.spark, self.schema, self.operator = spark, spark.createDataFrame([], schema).schema, operator
        self.path, self.out, self.checkpoint = (shared_dir(spark, n) for n in ("rows", "out", "checkpoint"))

    def feed(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        found = self.operator(live.stream_table(self.spark, self.path, self.schema))
        stateful.start(found, self.out, self.checkpoint).awaitTermination()
        return self.spark.read.schema(found.schema).parquet(self.out).collect()


def host_rows(n=240, seed=0):
    rng = random.Random(seed)
    return [
        (
            i, rng.choice("ab"), rng.choice(["linux", "windows"]), at(i * 7 + rng.random() * 5),
            [rng.choice([1, -1]) * rng.randrange(1, 4) for _ in range(3)], 6.0 if rng.random() < 0.03 else rng.random(),
        )
        for i in range(n)
    ]


def scores(rows):
    return {r["id"]: (r["host"], r["recv_time"], round(r["delta"], 9), round(r["score"], 12), r["anomaly"]) for r in rows}


def test_scores_with_late_rows_and_restarts(spark):
    rows = host_rows()
    batch = spark.createDataFrame(rows, EVENT)
    want = scores(anomaly.host_anomaly_score(batch, **MODEL).collect())
    arriving = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=100 if r[0] % 5 == 0 else 0))
    stream = Stream(spark, EVENT, lambda s: stateful.score_stream(s, delay="3 minutes", **MODEL))
    early = scores(stream.feed(arriving[:120]))
    assert early and all(want[i] == s for i, s in early.items())
    clock = (None, None, None, at(10_000), None, None)
    assert scores(stream.feed([*arriving[120:], clock])) == want
    # What the state holds is what the batch operator keeps for later events.
    held = stateful.host_models(spark, stream.checkpoint).collect()
    kept = anomaly.next_state(anomaly.score_events(batch, **MODEL), 20)
    last = kept.groupBy("host", "log_source").agg(F.max("position").alias("p"), F.max(F.unix_micros("recv_time")).alias("t"))
    assert {(r["host"], r["log_source"], r["position"], r["last"]) for r in held if r["host"]} == {
        (r["host"], r["log_source"], r["p"] + 1, r["t"]) for r in last.collect()
    }


def test_a_stream_goes_on_from_a_batch(spark):
    rows = host_rows(seed=3)
    want = scores(anomaly.host_anomaly_score(spark.createDataFrame(rows, EVENT), **MODEL).collect())
    first = anomaly.score_events(spark.createDataFrame(rows[:130], EVENT), **MODEL)
    state = anomaly.next_state(first, 20)
    stream = Stream(spark, EVENT, lambda s: stateful.score_stream(s, state, delay="1 minute", **MODEL))
    later = stream.feed([*rows[130:], (None, None, None, at(10_000), None, None)])
    assert scores(later) | scores(anomaly.verdicts(first).collect()) == want and len(later) == 110


FAILURE = "ip string, id long, recv_time timestamp"


def test_brute_force_like_the_batch(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), i, at(rng.randrange(0, 900) + rng.choice([0, 0.25, 0.9995]))) for i in range(150)]
    frame = spark.createDataFrame(rows, FAILURE)
    want = {(r["ip"], r["id"], r["recent"]) for r in correlate.brute_force(frame, "ip", seconds=60, limit=3).collect()}
    rows.sort(key=lambda r: r[2])
    late = [r for r in rows[:75] if r[1] % 6 == 0]
    stream = Stream(spark, FAILURE, lambda s: stateful.brute_force_stream(s, "ip", 60, 3, delay="10 minutes"))
    stream.feed([r for r in rows[:75] if r not in late])
    got = stream.feed([*rows[75:], *late, (None, None, at(5000))])
    assert {(r["ip"], r["id"], r["recent"]) for r in got} == want and want
    assert len(got) == len(want)


def test_rows_later_than_the_watermark_are_left_out(spark):
    stream = Stream(spark, FAILURE, lambda s: stateful.brute_force_stream(s, "ip", 60, 1, delay="1 minute"))
    stream.feed([("x", 1, at(0)), ("x", 2, at(1)), (None, None, at(500))])
    got = stream.feed([("x", 3, at(2)), ("x", 4, at(600)), (None, None, at(5000))])
    assert [(r["id"], r["recent"]) for r in got] == [(2, 2)]


LOG = "id long, server_id long, recv_time timestamp, log_source string, content string"


def request(i, ip, seconds, method="GET", path="/a"):
    stamp = at(seconds).strftime("%d/%b/%Y:%H:%M:%S")
    return (i, 7, at(seconds), "nginx", f'{ip} - - [{stamp} +0000] "{method} {path} HTTP/1.1" 200 5 "-" "agent"')


def count_rules():
    def rule(name, detection, condition="selection"):
        return Rule(name, name, "", "low", "stable", "nginx", {**detection, "condition": condition})

    every = {"Url|contains": "/"}
    return [
        rule("by-ip", {"selection": every, "aggregation": {"timeframe": "1m", "SourceIp|count": ">2"}}, "selection and aggregation"),
        rule("by-server", {"selection": {**every, "count|gte": 4, "Url|count|gte": "<4"}}),
        rule("either", {"selection": {"RequestMethod": "PUT", "count|gte": 1}, "more": {**every, "count|gte": 6}}, "selection or more"),
    ]


def test_threshold_rules_like_the_batch(spark):
    rng = random.Random(4)
    rows = [
        request(i, f"10.0.0.{rng.randrange(3)}", rng.randrange(0, 400), rng.choice(["GET", "GET", "GET", "PUT"]), f"/{rng.randrange(3)}")
        for i in range(70)
    ]
    want = {tuple(r) for r in correlate.threshold_alerts(spark.createDataFrame(rows, LOG), count_rules()).collect()}
    rows.sort(key=lambda r: r[2])
    late = [r for r in rows[:40] if r[0] % 5 == 0]
    stream = Stream(spark, LOG, lambda s: stateful.threshold_stream(s, count_rules(), delay="5 minutes"))
    stream.feed([r for r in rows[:40] if r not in late])
    got = stream.feed([*rows[40:], *late, (None, None, at(9000), "nginx", None)])
    most = {}
    for rule, level, source, start, matches in map(tuple, got):
        most[rule, level, source, start] = max(matches, most.get((rule, level, source, start), 0))
    assert {(*k, n) for k, n in most.items()} == want
    assert {r[0] for r in want} == {"by-ip", "by-server", "either"}


def test_windows_are_counted_without_a_call_for_each_key(spark):
    stream = Stream(spark, LOG, lambda s: stateful.threshold_stream(s, count_rules()))
    spark.createDataFrame([], stream.schema).write.parquet(stream.path)
    plan = stream.operator(live.stream_table(spark, stream.path, stream.schema))._jdf.queryExecution().toString()
    assert "EventTimeWatermark" in plan and "Python" not in plan and "TransformWithState" not in plan


def test_a_log_counts_until_its_window_is_over(spark):
    hourly = Rule(
        "hourly", "", "", "low", "stable", "nginx",
        {"selection": {"Url|contains": "/"}, "aggregation": {"timeframe": "1h", "SourceIp|count": ">2"}, "condition": "selection and aggregation"},
    )
    stream = Stream(spark, LOG, lambda s: stateful.threshold_stream(s, [hourly], delay="1 minute"))
    assert stream.feed([request(1, "10.0.0.1", 10), request(2, "10.0.0.1", 20), (3, 7, at(1800), "linux", "no match")]) == []
    assert stream.feed([request(4, "10.0.0.1", 30), (None, None, at(3659), "nginx", None)]) == []
    got = stream.feed([(None, None, at(3660), "nginx", None)])
    assert [(r.rule_id, r.source, r.window_start, r.matches) for r in got] == [("hourly", "10.0.0.1", at(0), 3)]
    # The window is over: nothing of it is counted or told again.
    assert len(stream.feed([request(5 + i, "10.0.0.1", 40 + i) for i in range(4)] + [(None, None, at(9000), "nginx", None)])) == 1


# ---- what a rule counts --------------------------------------------------------------


@pytest.mark.parametrize(
    "limit, met",
    [(">5", {6, 7, 8}), (">=5", {5, 6, 7, 8}), ("<3", {1, 2}), ("<=2", {1, 2}), ("= 4", {4}), ("==4", {4}), ("6", {6, 7, 8}), ("~4", None), ("many", None)],
)
def test_limits(limit, met):
    found = count_range(limit)
    assert (found and {n for n in range(1, 9) if found[0] <= n <= found[1]}) == met


def rule_of(condition="selection", **blocks):
    return Rule("r", "", "", "low", "", "linux", {**blocks, "condition": condition})


def shape(rule):
    return [[(c.group, c.distinct, c.ranges[0][0]) for c in b.counts] for b in branches_of(rule)]


def test_every_count_and_connective_is_read():
    both = {"Message|contains": "a", "count|gte": [50, 5], "destination|count|gte": 3}
    assert shape(rule_of(selection=both)) == [[(None, None, 50), (None, "destination", 3)]]
    assert branches_of(rule_of(selection=both))[0].counts[0].least == 5
    assert shape(rule_of("a or b", a={"count|gte": 2}, b={"x|count|gte": 9})) == [[(None, None, 2)], [(None, "x", 9)]]
    assert shape(rule_of(selection=[{"count|gte": 2}, {"y|count": ">3"}])) == [[(None, None, 2)], [("y", None, 4)]]
    assert shape(rule_of("a and b", a={"count|gte": 2}, b=[{"m": 1}, {"count|gte": 7}])) == [
        [(None, None, 2)], [(None, None, 2), (None, None, 7)],
    ]
    assert shape(rule_of("(a or b)", a={"count|gte": 2})) == []


def test_what_is_left_for_single_rows():
    mixed = rule_of("plain or heavy", plain={"Message": "x"}, heavy={"count|gte": 2})
    assert plain_part(mixed).detection == {"way0_plain": {"Message": "x"}, "condition": "way0_plain"}
    assert plain_part(rule_of(selection={"count|gte": 2})) is None


@pytest.mark.parametrize(
    "rule",
    [
        rule_of(selection={"count|gte": "~5"}),
        rule_of(selection={"count|gte": [5, "many"]}),
        rule_of(selection={"x|duplicate": "twice"}),
        rule_of("plain", plain={"m": 1}, selection={"count|gte": 5}),
        rule_of("plain and not heavy", plain={"count|gte": 1}, heavy={"count|gte": 5}),
        rule_of("a and b", a={"count|gte": 2}, b={"x|count": ">3"}),
    ],
)
def test_counts_without_meaning_are_refused(rule):
    assert counting_of(rule)
    with pytest.raises(ValueError, match="rule r"):
        check_counts(rule)


def test_sound_counts_are_accepted():
    for rule in (rule_of(selection={"m": 1}), rule_of(selection={"count|gte": "<5", "x|count|gte": 2}), *count_rules()):
        assert check_counts(rule) is rule
