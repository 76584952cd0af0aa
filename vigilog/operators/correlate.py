"""Rules over groups of logs: thresholds, counts, distinct counts, sliding windows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.operators import detect
from vigilog.operators.sequence import trailing_counts
from vigilog.rules.compiler import FIELD_MAP, NEVER, SERVER, Branch, branches_of, counting_of
from vigilog.rules.pack import Rule

UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

# A brute force is more than 5 failures within 300 seconds.
BRUTE_FORCE_SECONDS = 300
BRUTE_FORCE_LIMIT = 5


def timeframe_seconds(timeframe: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([smhd])", timeframe).groups()
    return int(number) * UNIT_SECONDS[unit]


ALERT_GROUPS = (
    "rule_id string, severity string, source string, window_start timestamp, matches bigint"
)


def threshold_alerts(
    logs: DataFrame,
    rules: Sequence[Rule],
    timeframe: str | None = None,
    least: int | None = None,
) -> DataFrame:
    """Groups of matches that meet a counting rule, per rule, source and window.

    All counting rules are decided in one pass. Rows are first counted for each counted
    value, then the values for each group, so a busy source is small when it is grouped.
    A branch of a rule holds when all its counts are met; a rule gives one row for a group
    and window, with the largest of its branches' first counts as ``matches``.
    ``timeframe`` and ``least`` replace the values written in the rules. Without a
    counting rule there are no rows.
    """
    counting = counting_branches(rules)
    if not counting:
        return logs.sparkSession.createDataFrame([], ALERT_GROUPS)
    counted = counted_values(logs, counting, timeframe)
    found = counts_of_windows(counted, counting, "window_start").select(
        "branch", "source", "window_start", verdict(counting, least).alias("matches")
    )
    return named_groups(found.where("matches IS NOT NULL"), counting)


def counting_branches(rules: Sequence[Rule]) -> list[Branch]:
    """The branches with counts of all enabled rules."""
    active = [r for r in rules if r.enabled and r.log_source in FIELD_MAP]
    return [b for r in active if counting_of(r) for b in branches_of(r) if b.counts]


def counted_values(
    logs: DataFrame, counting: Sequence[Branch], timeframe: str | None = None, with_others: bool = False
) -> DataFrame:
    """(branch, source, window_start, window_end, part, value, recv_time), a row for each
    matching log and count of a branch; ``part`` numbers the counts of the branch, and
    ``value`` is what is counted when different values are. Streams are accepted.
    ``with_others`` adds a row with its time alone for each log, whether it matches or not.
    """
    view = detect._with_host(detect.parsed_view(logs))
    found = detect.matched_rules(view, [b.rule for b in counting], "intent")
    if with_others:
        none = F.array(F.lit(None).cast("int"))
        hits = found.select("*", F.explode(F.concat(F.coalesce("_hits", F.array().cast("array<int>")), none)).alias("branch"))
    else:
        hits = found.select("*", F.explode_outer("_hits").alias("branch")).where(F.col("branch").isNotNull())

    def field(rule: Rule, name: str | None) -> str:
        if name is None or name == SERVER:
            return "CAST(server_id AS STRING)"
        return detect.field_sql(rule.log_source, name, "intent")

    def values(b: Branch) -> str:
        told = [field(b.rule, c.distinct) if c.distinct else "CAST(NULL AS STRING)" for c in b.counts]
        return f"array({', '.join(told)})"

    groups = F.expr(f"array({', '.join(field(b.rule, b.counts[0].group) for b in counting)})")
    asked = F.expr(f"array({', '.join(map(values, counting))})")
    branch = F.col("branch")
    frames = window_seconds(counting, timeframe)
    width = F.get(F.array(*map(F.lit, frames)), branch)
    start = F.floor(F.unix_seconds("recv_time") / width) * width
    return hits.select(
        "branch",
        F.get(groups, branch).alias("source"),
        F.timestamp_seconds(start).alias("window_start"),
        F.timestamp_seconds(start + width).alias("window_end"),
        "recv_time",
        F.posexplode_outer(F.get(asked, branch)).alias("part", "value"),
    ).where("branch IS NULL OR source IS NOT NULL")


def window_seconds(counting: Sequence[Branch], timeframe: str | None = None) -> list[int]:
    """The width of each branch's windows."""
    return [timeframe_seconds(timeframe or b.counts[0].timeframe) for b in counting]


def counts_of_windows(counted: DataFrame, counting: Sequence[Branch], *window: str) -> DataFrame:
    """(branch, source, window, n0, d0, n1, ...): rows and different values of each count.

    Rows are first counted for each value, so a busy source is small when it is grouped.
    """
    by_value = counted.groupBy("branch", "source", *window, "part", "value").agg(F.count("*").alias("n"))
    parts = range(max(len(b.counts) for b in counting))
    of_part = F.col("part")
    return by_value.groupBy("branch", "source", *window).agg(
        *[F.sum(F.when(of_part == p, F.col("n"))).alias(f"n{p}") for p in parts],
        *[F.count(F.when(of_part == p, F.col("value"))).alias(f"d{p}") for p in parts],
    )


def verdict(counting: Sequence[Branch], least: int | None = None) -> Column:
    """The first count of a branch (columns n0, d0, n1, ...) if all its counts are met, else null."""
    out = None
    for i, b in enumerate(counting):
        told = [F.col(f"d{p}" if c.distinct else f"n{p}") for p, c in enumerate(b.counts)]
        met = F.lit(True)
        for count, c in zip(told, b.counts):
            ranges = c.ranges if least is None else ((least, NEVER),)
            inside = F.lit(False)
            for low, high in ranges:
                inside = inside | count.between(F.lit(low), F.lit(high))
            met = met & inside
        chosen = F.when(met, told[0])
        out = F.when(F.col("branch") == i, chosen) if out is None else out.when(F.col("branch") == i, chosen)
    return out


def named_groups(found: DataFrame, counting: Sequence[Branch]) -> DataFrame:
    """One row of ``ALERT_GROUPS`` for a rule, source and window of ``named_rows``."""
    named, ids = named_rows(found, counting), [b.rule.id for b in counting]
    if len(set(ids)) == len(ids):
        return named
    keys = ["rule_id", "severity", "source", "window_start"]
    return named.groupBy(*keys).agg(F.max("matches").alias("matches"))


def named_rows(found: DataFrame, counting: Sequence[Branch]) -> DataFrame:
    """``ALERT_GROUPS`` of (branch, source, window_start, matches), a row for each branch."""
    ids = [b.rule.id for b in counting]
    return found.select(
        F.get(F.array(*map(F.lit, ids)), F.col("branch")).alias("rule_id"),
        F.get(F.array(*[F.lit(b.rule.level) for b in counting]), F.col("branch")).alias("severity"),
        "source", "window_start", "matches",
    )


def failed_password_lines(logs: DataFrame) -> DataFrame:
    return logs.where(F.lower("content").contains("failed password"))


def brute_force(
    failures: DataFrame,
    key: str,
    time: str = "recv_time",
    seconds: int = BRUTE_FORCE_SECONDS,
    limit: int = BRUTE_FORCE_LIMIT,
) -> DataFrame:
    """Failures that are the latest of more than ``limit`` in the trailing ``seconds``."""
    hot = trailing_counts(failures, key, time, seconds).where(F.col("recent") > limit)
    events = failures.withColumn("second", F.unix_seconds(time))
    return events.join(hot, [key, "second"]).drop("second")
