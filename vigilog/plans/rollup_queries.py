"""Reports over hourly rows that several batches have appended to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.operators import rollups
from vigilog.plans.catalog import ORACLES, query, sql_time
from vigilog.plans.fixtures import Tables
from vigilog.plans.stat_queries import NOW
from vigilog.session import cut_lineage, shared_dir
from vigilog.streaming.store import Entry, LogStore

BATCHES = 3


def kept_up(t: Tables) -> DataFrame:
    """The rows of a store to which the logs came in batches, in no order of time."""
    store = LogStore(t.spark, shared_dir(t.spark, "rollups"))
    logs = cut_lineage(t.spark, t.logs, "rollup-logs")
    for n in range(BATCHES):
        part = logs.where(F.pmod(F.xxhash64("id"), F.lit(BATCHES)) == n)
        rollups.hourly(part).write.parquet(store.folder("hourly", n))
        store.commit(Entry(n, ("hourly",)))
    return rollups.merged(store.table("hourly", f"{rollups.HOURLY}, batch bigint"))


@query("rolled_log_totals")
def rolled_log_totals(t: Tables):
    return rollups.log_totals(kept_up(t), t.servers, t.alerts)


@query("rolled_server_breakdown")
def rolled_server_breakdown(t: Tables):
    return rollups.server_breakdown(kept_up(t), t.alerts, t.servers)


@query("rolled_server_timeline")
def rolled_server_timeline(t: Tables):
    return rollups.server_timeline(t.servers, kept_up(t), t.alerts, hours=24)


@query("rolled_parse_coverage")
def rolled_parse_coverage(t: Tables):
    return rollups.parse_coverage(kept_up(t))


# The reports over all logs have the same rows, so the same SQL.
for _key in ("log_totals", "server_breakdown", "server_timeline", "parse_coverage"):
    ORACLES[f"rolled_{_key}"] = ORACLES[_key]


@query(
    "rolled_timeseries",
    sql=f"""
SELECT {sql_time("date_trunc('hour', recv_time)")} AS hour, log_source, count(*) AS logs
FROM log_entry WHERE date_trunc('hour', recv_time) >= date_trunc('hour', {NOW}) - INTERVAL 240 HOUR
GROUP BY ALL""",
)
def rolled_timeseries(t: Tables):
    return rollups.logs_timeseries(kept_up(t), hours=240)


@query(
    "rolled_activity",
    sql=f"""
SELECT server_id, count(*) AS logs, {sql_time("min(recv_time)")} AS first_seen,
  {sql_time("max(recv_time)")} AS last_seen FROM log_entry GROUP BY server_id""",
)
def rolled_activity(t: Tables):
    return rollups.server_activity_times(kept_up(t))
