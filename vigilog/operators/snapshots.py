"""Differences between consecutive inventory snapshots, and state kept as actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(snapshots: DataFrame) -> DataFrame:
    """Items added to and removed from each ``snapshot`` since the one before it.

    Takes ``snapshot, item`` rows. The order of snapshots comes from their distinct
    names, one row each; items meet their neighbour snapshot by an outer join.
    """
    members = snapshots.select("snapshot", "item").distinct()
    order = Window.orderBy("snapshot")
    days = members.select("snapshot").distinct()
    next_of = days.select(
        "snapshot",
        F.lead("snapshot").over(order).alias("next"),
        F.lag("snapshot").over(order).isNull().alias("is_first"),
    )
    here = members.join(next_of, "snapshot")
    carried = here.where(F.col("next").isNotNull()).select(
        F.col("next").alias("snapshot"), "item", F.lit(True).alias("was")
    )
    present = here.where(~F.col("is_first")).select(
        "snapshot", "item", F.lit(True).alias("is_now")
    )
    both = present.join(carried, ["snapshot", "item"], "full")
    changed = both.where(F.col("was").isNull() | F.col("is_now").isNull())
    change = F.when(F.col("was").isNull(), "added").otherwise("removed")
    return changed.select("snapshot", "item", change.alias("change"))


def current_alerts(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with the state set by the latest action on each.

    ``actions`` holds appended ``alert_id, action, at`` rows, ``action`` being
    ``resolve``, ``reopen`` or ``acknowledge``.
    """
    state = F.struct("at", "action")

    def latest(names: list[str]):
        return F.max(F.when(F.col("action").isin(names), state))

    last = actions.groupBy("alert_id").agg(
        latest(["resolve", "reopen"]).alias("_state"), latest(["acknowledge"]).alias("_ack")
    )
    joined = alerts.join(last, "alert_id", "left")
    decided = F.col("_state").isNotNull()
    resolved = F.when(decided, F.col("_state.action") == "resolve").otherwise(F.col("resolved"))
    return joined.withColumn("resolved", resolved).withColumn(
        "acknowledged", F.col("_ack").isNotNull()
    ).drop("_state", "_ack")


def action_results(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Each action with whether its alert exists."""
    known = alerts.select("alert_id").distinct().withColumn("found", F.lit(True))
    return actions.join(known, "alert_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )
