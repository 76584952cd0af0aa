"""Properties of the per-host scores."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigilog.operators import anomaly

START = datetime(2024, 1, 1)


def host_rows(n=900, hosts=2, odd=850):
    rng = random.Random(11)
    rows = []
    for h in range(hosts):
        for i in range(n):
            slots = [1, 2 + rng.randrange(2), -5] if i != odd else [17, 19, 20]
            rows.append(
                (h * n + i, f"h{h}", "windows", START + timedelta(seconds=i * 30), slots, 0.0)
            )
    return rows


SCHEMA = (
    "id bigint, host string, log_source string, recv_time timestamp, slots array<int>, "
    "entropy double"
)


def scores(df, state=None):
    rows = anomaly.host_anomaly_score(df, state).select("id", "score", "anomaly").collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: (round(r.score, 9), r.anomaly) for r in rows}


def test_outlier_scores_higher_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame(host_rows(), SCHEMA)
    first = scores(df.repartition(2))
    assert first == scores(df.repartition(11, "id"))
    assert len(first) == 1800
    assert all(first[i][0] == 0.0 for i in range(250))
    usual = [first[i][0] for i in range(500, 900) if i != 850]
    assert first[850][0] > max(usual)


def test_state_makes_two_runs_equal_to_one(spark):
    df = spark.createDataFrame(host_rows(), SCHEMA)
    whole = scores(df)
    for cut in (100, 250, 260, 780):
        at = F.lit(START + timedelta(seconds=cut * 30 - 1))
        earlier, later = df.where(F.col("recv_time") < at), df.where(F.col("recv_time") >= at)
        first = anomaly.score_events(earlier)
        state = anomaly.next_state(first)
        assert state.groupBy("host").count().agg(F.max("count")).first()[0] <= 500
        parts = {r.id: (round(r.score, 9), r.anomaly) for r in anomaly.verdicts(first).collect()}
        assert {**parts, **scores(later, state)} == whole


def along_the_host(rows, window):
    """Scores by one run along each host, window after window."""
    import numpy as np
    import pandas as pd

    from vigilog.functions import halfspace as H

    out = {}
    for host in sorted({r[1] for r in rows}):
        own = sorted((r for r in rows if r[1] == host), key=lambda r: (r[3], r[0]))
        times = [r[3] for r in own]
        delta = [0.0] + [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        points = anomaly._points(
            pd.Series([np.array(r[4]) for r in own]), pd.Series(delta), pd.Series([r[5] for r in own]), False
        )
        leaf, mass = H.leaves(points), None
        for at in range(0, len(own), window):
            here = leaf[at : at + window]
            score = np.zeros(len(here)) if mass is None else H.scores(here, mass, window)
            mass = H.masses(here[score < anomaly.WINDOWS_LEARN_BELOW])
            out.update({r[0]: round(float(x), 9) for r, x in zip(own[at : at + window], score)})
    return out


def test_passes_give_the_scores_of_one_run_along_the_host(spark, monkeypatch):
    rng = random.Random(3)
    rows = [
        (1000 * h + i, f"h{h}", "windows", START + timedelta(seconds=i),
         [1 + rng.randrange(20) for _ in range(3)] if (i // 7) % 3 else [2, 3, -4], 0.0)
        for h in range(2) for i in range(300)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = along_the_host(rows, 10)
    assert len(set(want.values())) > 20 and any(x >= anomaly.WINDOWS_LEARN_BELOW for x in want.values())
    for group in (1, 3, 64):
        monkeypatch.setattr(anomaly, "GROUP_WINDOWS", group)
        got = anomaly.host_anomaly_score(df, window=10).select("id", "score").collect()
        assert {r.id: round(r.score, 9) for r in got} == want


def test_one_busy_host_spreads_over_tasks(spark):
    from vigilog.operators.sequence import in_order

    df = spark.range(0, 40_000, 1, 4).selectExpr(
        "id", "'h' AS host", "timestamp_millis(1700000000000 + id % 1000) AS t"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = in_order(df, ["host"], "t", "id")
        pieces = rows.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(pieces) == 8 and max(r["count"] for r in pieces) < 20_000
    want = sorted((i % 1000, i) for i in range(40_000))
    got = sorted((r.position, r.id) for r in rows.select("position", "id").collect())
    assert [i for _, i in got] == [i for _, i in want] and got[0][0] == 0 and got[-1][0] == 39_999


def test_linux_limits(spark):
    rows = [
        (1, "h", "linux", START, [1, 2, 3], 2.0),
        (2, "h", "linux", START + timedelta(milliseconds=5), [1, 2, 3], 2.0),
        (3, "h", "linux", START + timedelta(seconds=5), [1, 2, 3], 5.6),
        (4, "h", "linux", START + timedelta(seconds=9), [1, 2, 3], 5.5),
    ]
    got = scores(spark.createDataFrame(rows, SCHEMA))
    assert [got[i] for i in (1, 2, 3, 4)] == [
        (0.0, False), (1.0, True), (1.0, True), (0.0, False),
    ]


def test_hashed_features(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],)], "t array<string>")
    one, none = [r[0] for r in df.select(anomaly.hash_features(F.col("t"), 20)).collect()]
    assert len(one) == 20 and sorted(map(abs, one), reverse=True)[:2] in ([2.0, 1.0], [3.0, 0.0])
    assert none == [0.0] * 20
