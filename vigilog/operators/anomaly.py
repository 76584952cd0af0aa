"""Per-host anomaly scores of Windows and Linux events.

A host's events are numbered and cut into windows. The events of a window are scored
with the node masses of the window before, to which an event counts only if it looked
usual itself when it was scored. Consecutive windows form small groups that are worked
through in order; what a group needs of the one before is which events of its last
window counted. Passes start from a guess (all but flagged events) and repeat until no
such decision changes, which gives the same scores as one run along each host, without
a task per host.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.functions import halfspace as H
from vigilog.functions.text import app_name_heuristic, basename, first_present, shannon_entropy
from vigilog.operators.detect import parsed_view
from vigilog.operators.sequence import in_order
from vigilog.operators.templates import mask_variables
from vigilog.session import cut_lineage

# Feature buckets, decision limits, and keys naming user and process.
WINDOWS_BUCKETS = 20
LINUX_BUCKETS = 40
THRESHOLD = 0.70
WINDOWS_LEARN_BELOW = 0.85
BURST_SECONDS = 0.01
HIGH_ENTROPY = 5.5
USER_KEYS = [
    "SubjectUserName", "Subject_Account_Name", "User_Account_Name", "user", "TargetUserName",
]
PROCESS_KEYS = [
    "ProcessName", "ProcessInformation_Process_Name", "CallerProcessName", "NewProcessName",
]
GROUP_WINDOWS = 16  # windows of a host that one group works through


def token_hash(token: Column) -> Column:
    """Whole number of the first 60 bits of the token's MD5."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint")


def signed_slot(token: Column, buckets: int) -> Column:
    """Bucket of a token, 1 to ``buckets``, negative for half of the tokens."""
    h = token_hash(F.coalesce(token, F.lit("")))
    slot = (F.pmod(h, F.lit(buckets)) + 1).cast("int")
    return F.when(F.shiftright(h, 40).bitwiseAND(F.lit(1)) == 1, -slot).otherwise(slot)


def hash_features(tokens: Column, buckets: int) -> Column:
    """Signed counts of the tokens that fall into each bucket."""
    slots = F.transform(tokens, lambda t: signed_slot(t, buckets))

    def bucket(i: Column) -> Column:
        return F.aggregate(
            slots,
            F.lit(0.0),
            lambda acc, s: acc + F.when(s == i, 1.0).when(s == -i, -1.0).otherwise(0.0),
        )

    return F.transform(F.sequence(F.lit(1), F.lit(buckets)), bucket)


def windows_tokens(attrs: Column) -> Column:
    return F.array(
        F.coalesce(attrs["event_id"], F.lit("0")),
        basename(first_present(attrs, PROCESS_KEYS)),
        first_present(attrs, USER_KEYS),
    )


def linux_tokens(message: Column) -> Column:
    template = mask_variables(message)
    return F.array(
        F.md5(template), app_name_heuristic(message), template
    )


def host_events(logs: DataFrame, servers: DataFrame) -> DataFrame:
    """Windows and Linux events with host, feature slots and entropy.

    Records are parsed from the logs as they are read, so the logs are neither read
    again nor joined to their details.
    """
    host = F.lower(F.trim("hostname"))
    named = servers.select(F.col("id").alias("server_id"), host.alias("host"))
    own = logs.where(F.col("log_source").isin("windows", "linux"))
    base = own.select("id", "server_id", "recv_time", "log_source", "content")
    view = parsed_view(base.join(named, "server_id"))
    message = F.col("linux.raw_message")
    masked = view.withColumn("_template", mask_variables(message))

    def slots(tokens: Column, buckets: int) -> Column:
        return F.transform(tokens, lambda t: signed_slot(t, buckets))

    windows, linux = F.col("windows").isNotNull(), message != ""
    return masked.where(windows | linux).select(
        "id", "host", "log_source", "recv_time",
        F.when(windows, slots(windows_tokens(F.col("windows")), WINDOWS_BUCKETS))
        .otherwise(slots(linux_tokens(message), LINUX_BUCKETS)).alias("slots"),
        F.when(linux, shannon_entropy(F.col("_template"))).otherwise(0.0).alias("entropy"),
    )


def flagged(log_source: Column, delta: Column, is_first: Column, entropy: Column) -> Column:
    """Linux events that are a burst or have high entropy, whatever the model says."""
    burst = ~is_first & (delta < BURST_SECONDS)
    return (log_source == "linux") & (burst | (entropy > HIGH_ENTROPY))


STATE_COLUMNS = [
    "id", "host", "log_source", "recv_time", "slots", "entropy", "delta", "flag", "position", "learned",
]


def numbered(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Events, and kept ones of ``state``, with position, delta and flag per host."""
    fresh = events.select(
        "id", "host", "log_source", "recv_time", "slots", "entropy",
        F.lit(None).cast("double").alias("_delta"),
        F.lit(None).cast("boolean").alias("_flag"),
        F.lit(None).cast("bigint").alias("_position"),
        F.lit(None).cast("boolean").alias("_learned"),
    )
    if state is not None:
        kept = state.select(
            "id", "host", "log_source", "recv_time", "slots", "entropy",
            F.col("delta").alias("_delta"), F.col("flag").alias("_flag"),
            F.col("position").alias("_position"), F.col("learned").alias("_learned"),
        )
        fresh = fresh.unionByName(kept)
    ordered = in_order(
        fresh, ["host", "log_source"], "recv_time", "id", first_position="_position"
    )
    micros = F.unix_micros("recv_time") - F.unix_micros("prev_time")
    delta = F.coalesce("_delta", micros / F.lit(1000000.0), F.lit(0.0))
    out = ordered.withColumn("delta", delta)
    flag = flagged(
        F.col("log_source"), F.col("delta"), F.col("prev_time").isNull(), F.col("entropy")
    )
    return out.select(
        "id", "host", "log_source", "recv_time", "slots", "entropy", "delta",
        F.coalesce("_flag", flag).alias("flag"), "position", "last_position",
        F.col("_learned").alias("learned"), F.col("_position").isNotNull().alias("is_kept"),
    )


@F.pandas_udf(T.ArrayType(T.ShortType()))
def leaf_numbers(
    log_source: pd.Series, slots: pd.Series, delta: pd.Series, entropy: pd.Series
) -> pd.Series:
    """The event's leaf in every tree; it fixes all nodes on the way."""
    out = np.zeros((len(log_source), H.TREES), dtype=np.int16)
    is_linux = (log_source == "linux").to_numpy()
    for linux in (False, True):
        own = np.flatnonzero(is_linux == linux)
        if len(own):
            out[own] = H.leaves(_points(slots.iloc[own], delta.iloc[own], entropy.iloc[own], linux))
    return pd.Series(list(out))


def _points(slots: pd.Series, delta: pd.Series, entropy: pd.Series, is_linux: bool) -> np.ndarray:
    buckets = LINUX_BUCKETS if is_linux else WINDOWS_BUCKETS
    out = np.zeros((len(slots), buckets + (2 if is_linux else 1)))
    at = np.arange(len(slots))
    for column in np.stack(slots.to_numpy()).T:
        np.add.at(out, (at, np.abs(column) - 1), np.sign(column))
    out[:, buckets] = delta
    if is_linux:
        out[:, buckets + 1] = entropy
    return out


PASS_SCHEMA = "host string, log_source string, position bigint, id bigint, score double, learned boolean"


def _score_group(rows: pd.DataFrame, window: int, threshold: float) -> pd.DataFrame:
    """Scores of the windows of one group, in order, from the window before the first.

    Masses are counts, so the order of the rows within a window does not matter.
    """
    rows = rows.sort_values("position", kind="stable")
    number = rows["position"].to_numpy() // window
    flag, border = rows["flag"].to_numpy(), rows["border"].to_numpy()
    known, kept = rows["known"].to_numpy(), rows["is_kept"].to_numpy()
    leaf = np.stack(rows["leaves"].to_numpy()).astype(np.int64)
    below = rows["log_source"].iloc[0] != "linux"
    learned = np.where(border | kept, known, ~flag).astype(bool)
    score = np.zeros(len(rows))
    mass, previous = None, None
    for n in np.unique(number):
        own = np.flatnonzero(number == n)
        new = own[~border[own]]
        if mass is not None and previous == n - 1 and len(new):
            score[new] = H.scores(leaf[new], mass, window)
            usual = score[new] < WINDOWS_LEARN_BELOW if below else score[new] <= threshold
            fresh = ~kept[new]
            learned[new[fresh]] = (~flag[new] & usual)[fresh]
        mass, previous = H.masses(leaf[own[learned[own]]]), n
    done = ~border
    out = rows.loc[done, ["host", "log_source", "position", "id"]]
    return out.assign(score=score[done], learned=learned[done])


def score_events(
    events: DataFrame, state: DataFrame | None = None, window: int = H.WINDOW, threshold: float = THRESHOLD
) -> DataFrame:
    """``numbered`` rows with ``score``, ``anomaly`` and whether the model learned them.

    Rows kept in ``state`` are among them, with the decision they were kept with.
    """
    spark = events.sparkSession
    leaf = leaf_numbers("log_source", "slots", "delta", "entropy")
    rows = numbered(events, state).withColumn("leaves", leaf)
    number = F.floor(F.col("position") / F.lit(window))
    group = F.floor(number / F.lit(GROUP_WINDOWS))
    is_last = (number + 1) % GROUP_WINDOWS == 0
    last_group = F.floor(F.floor(F.col("last_position") / F.lit(window)) / F.lit(GROUP_WINDOWS))
    guess = F.coalesce("learned", ~F.col("flag"))
    rows = cut_lineage(
        spark, rows.withColumn("window", number).withColumn("grp", group).withColumn("known", guess), "host-rows"
    )
    small = ["host", "log_source", "position", "id", "flag", "known", "is_kept", "leaves"]

    def copies(table: DataFrame) -> DataFrame:
        own = table.select(*small, "grp", F.lit(False).alias("border"))
        behind = table.where(is_last & (F.col("grp") < last_group)).select(
            *small, (F.col("grp") + 1).alias("grp"), F.lit(True).alias("border")
        )
        return own.unionByName(behind)

    decided = rows
    while True:
        scored = cut_lineage(
            spark,
            copies(decided).groupBy("host", "log_source", "grp").applyInPandas(
                lambda pdf: _score_group(pdf, window, threshold), PASS_SCHEMA
            ),
            "host-pass",
        )
        key = ["host", "log_source", "position", "id"]
        now = scored.select(*key, "score", F.col("learned").alias("now"))
        joined = decided.drop("score").join(now, key)
        changed = joined.where(is_last & (F.col("grp") < last_group) & (F.col("now") != F.col("known")))
        settled = changed.isEmpty()
        decided = joined.withColumn("known", F.col("now")).drop("now")
        if settled:
            break
        decided = cut_lineage(spark, decided, "host-decided")
    score = F.when(F.col("flag"), F.lit(1.0)).otherwise(F.col("score"))
    return decided.select(
        "id", "host", "log_source", "recv_time", "slots", "entropy", "delta", "flag", "position",
        "last_position", "is_kept", F.col("known").alias("learned"), score.alias("score"),
        (F.col("flag") | (score > threshold)).alias("anomaly"),
    )


def host_anomaly_score(
    events: DataFrame, state: DataFrame | None = None, window: int = H.WINDOW, threshold: float = THRESHOLD
) -> DataFrame:
    """Score and verdict of every event of ``host_events``.

    With the ``state`` left by earlier events of the hosts, scores are the same as
    if earlier and new events had been scored together.
    """
    return verdicts(score_events(events, state, window, threshold))


def verdicts(scored: DataFrame) -> DataFrame:
    return scored.where("NOT is_kept").select(
        "id", "host", "log_source", "recv_time", "delta", "entropy", "score", "anomaly"
    )


def next_state(scored: DataFrame, window: int = H.WINDOW) -> DataFrame:
    """What scoring later events needs of ``score_events`` rows: two windows per host at most."""
    following = F.floor((F.col("last_position") + 1) / F.lit(window))
    kept = scored.where(F.floor(F.col("position") / F.lit(window)) >= following - 1)
    return kept.select(*STATE_COLUMNS)


def burst_and_entropy_flags(linux_events: DataFrame) -> DataFrame:
    """Linux events with the score and verdict of the fixed limits alone."""
    rows = numbered(linux_events.where(F.col("log_source") == "linux"))
    return rows.select(
        "id", "host", "delta", "entropy",
        F.when(F.col("flag"), 1.0).otherwise(0.0).alias("score"),
        F.col("flag").alias("anomaly"),
    )
