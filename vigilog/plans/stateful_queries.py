"""Queries of operators that keep state along a stream.

A table becomes a stream of slices at quantiles of its times. Some rows of each slice come
one slice late. The query is stopped after a slice and started again from its checkpoint for
the next; a clock row ends the last one. The SQL twins are those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.operators import anomaly, correlate, detect
from vigilog.plans.catalog import query, sql_time
from vigilog.plans.detect_queries import BRUTE_FORCE_SQL, THRESHOLD_SQL
from vigilog.plans.fixtures import Tables
from vigilog.plans.window_queries import MODEL_THRESHOLD, MODEL_WINDOW, SCORES_SQL
from vigilog.session import cut_lineage, shared_dir
from vigilog.streaming import live, stateful

SLICES = 3
LATE_SECONDS, DELAY = 86_400, "2 days"  # the watermark waits longer than a row may be late
MODEL = {"window": MODEL_WINDOW, "threshold": MODEL_THRESHOLD}


def in_slices(t: Tables, rows: DataFrame, run: Callable[[DataFrame], None], slices: int = SLICES) -> None:
    """Feed ``rows`` to a stream slice by slice; ``run`` starts the query and waits for it."""
    rows = cut_lineage(t.spark, rows, "stream-rows")
    seconds = F.unix_seconds("recv_time")
    parts = [i / slices for i in range(1, slices)]
    told = rows.agg(F.percentile_approx(seconds, parts).alias("cuts"), F.max("recv_time").alias("end")).first()
    late = F.when(F.xxhash64("id") % 7 == 0, LATE_SECONDS).otherwise(0)
    number = sum((((seconds + late) > cut).cast("int") for cut in told["cuts"] or []), start=F.lit(0))
    path = shared_dir(t.spark, "stream")
    for i in range(slices):
        part = rows.where(number == i)
        if i == slices - 1 and told["end"] is not None:
            after = F.lit(told["end"]) + F.expr("INTERVAL 100 DAYS")
            clock = [(after if f.name == "recv_time" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]
            part = part.unionAll(t.spark.range(1).select(*clock))
        part.write.mode("append").parquet(path)
        run(live.stream_table(t.spark, path, rows.schema))


def to_table(t: Tables, rows: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an operator appends to its table along the slices of ``rows``."""
    out, checkpoint, schemas = shared_dir(t.spark, "stateful"), shared_dir(t.spark, "checkpoint"), []

    def run(source: DataFrame) -> None:
        found = operator(source)
        schemas.append(found.schema)
        stateful.start(found, out, checkpoint).awaitTermination()

    in_slices(t, rows, run)
    return t.spark.read.schema(schemas[0]).parquet(out)


@query("stream_host_scores", sql=SCORES_SQL)
def stream_host_scores(t: Tables):
    events = anomaly.host_events(t.logs, t.servers)
    scored = to_table(t, events, lambda s: stateful.score_stream(s, delay=DELAY, **MODEL))
    return scored.withColumn("score", F.round("score", 6))


# A batch over the first half of the month, then a stream that starts from its models.
@query("stream_from_models", sql=SCORES_SQL)
def stream_from_models(t: Tables):
    events = cut_lineage(t.spark, anomaly.host_events(t.logs, t.servers), "host-events")
    half = F.timestamp_seconds(F.lit(events.agg(F.percentile_approx(F.unix_seconds("recv_time"), 0.5)).first()[0]))
    first = anomaly.score_events(events.where(F.col("recv_time") < half), **MODEL)
    state = cut_lineage(t.spark, anomaly.next_state(first, MODEL_WINDOW), "host-models")
    later = to_table(
        t,
        events.where(F.col("recv_time") >= half),
        lambda s: stateful.score_stream(s, state, delay=DELAY, **MODEL),
    )
    return anomaly.verdicts(first).unionByName(later).withColumn("score", F.round("score", 6))


@query("stream_brute_force", sql=BRUTE_FORCE_SQL)
def stream_brute_force(t: Tables):
    failed = detect.parsed_view(correlate.failed_password_lines(t.logs))
    failures = failed.where("linux IS NOT NULL").select("id", "recv_time", F.col("linux.ssh_ip").alias("ssh_ip"))
    found = to_table(
        t, failures, lambda s: stateful.brute_force_stream(s, "ssh_ip", seconds=86400, limit=2, delay=DELAY)
    )
    return found.select(F.col("id").alias("log_entry_id"), "ssh_ip", "recv_time", "recent")


@query("stream_threshold_rules", sql=THRESHOLD_SQL)
def stream_threshold_rules(t: Tables):
    return to_table(
        t, t.logs, lambda s: stateful.threshold_stream(s, t.rules, timeframe="1d", least=3, delay=DELAY)
    )


@query(
    "stream_threshold",
    sql=f"""
SELECT server_id, {sql_time("date_trunc('day', triggered_at)")} AS window_start, count(*) AS matches
FROM alert WHERE rule_id = 'lin-ssh-failed' GROUP BY ALL HAVING count(*) > 1""",
)
def stream_threshold(t: Tables):
    out, checkpoint = shared_dir(t.spark, "windows"), shared_dir(t.spark, "checkpoint")
    rules = [r for r in t.rules if r.id == "lin-ssh-failed"]

    def run(source: DataFrame) -> None:
        found = detect.run_rules(source, rules)
        live.stream_threshold(found, "server_id", "1 day", 1, out, checkpoint, delay=DELAY).awaitTermination()

    in_slices(t, t.logs, run)
    schema = "server_id bigint, window_start timestamp, matches bigint, batch bigint"
    return live.latest_windows(t.spark.read.schema(schema).parquet(out), "server_id")
