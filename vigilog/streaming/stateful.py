"""Operators that keep a state for each key of a stream.

Rows may arrive out of order by as much as the watermark's delay. What depends on order
waits in the state until the watermark passes it, so results are those of the batch
operator on the same rows; rows later than that are dropped by the watermark. State lives
in the checkpoint: a query that is started again goes on where it ended, and Spark's state
source reads it (``host_models``).

A row of a *clock* moves the watermark and is nothing else: rows of quiet keys, and the
last rows of a stream, leave the state once a clock has passed them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vigilog.functions import halfspace as H
from vigilog.functions.parsers import fence
from vigilog.operators import anomaly, correlate
from vigilog.rules.pack import Rule
from vigilog.session import ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


@contextmanager
def _importable(spark: SparkSession):
    """Lets the driver's own Python worker, which gets no shipped files, import this package."""
    environment = ship_package(spark).sparkContext.environment
    before = environment.get("PYTHONPATH")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, before)))
    try:
        yield
    finally:
        if before is None:
            del environment["PYTHONPATH"]
        else:
            environment["PYTHONPATH"] = before


def keyed(
    rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str, initial: DataFrame | None = None
) -> DataFrame:
    """Rows of a stream with a watermark, handed to a processor by key."""
    with _importable(rows.sparkSession):
        return rows.groupBy(*keys).transformWithStateInPandas(
            processor, schema, "Append", "EventTime", initialState=None if initial is None else initial.groupBy(*keys)
        )


def start(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the rows of a stateful operator to a Parquet table, each exactly once."""
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    with state_store(rows.sparkSession):
        return writer.format("parquet").option("path", path).trigger(**trigger).start()


class InOrder(StatefulProcessor):
    """Rows of a key, handed on in order of time once no earlier row can come.

    ``WAITING`` names the columns a row is kept with: microseconds first, then what tells
    rows of one time apart. A subclass takes released rows in ``take``.
    """

    WAITING = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.alarm = handle.getValueState("alarm", "at bigint")

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def take(self, key: tuple, rows: list[tuple]) -> pd.DataFrame | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [r for frame in rows for r in self.rows_of(frame)]
        yield from self._release(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()  # an alarm that has gone off is no more
        yield from self._release(key, [], timerValues)

    def _release(self, key, fresh: list[tuple], timer_values) -> Iterator[pd.DataFrame]:
        until = self.until(timer_values.getCurrentWatermarkInMs())
        kept = [tuple(list(v) if isinstance(v, np.ndarray) else v for v in r) for r in self.waiting.get()]
        ready = sorted(r for r in (*kept, *fresh) if r[0] <= until)
        if ready:
            later = [r for r in (*kept, *fresh) if r[0] > until]
            self.waiting.put(later) if later else self.waiting.clear()
        else:
            later = [*kept, *fresh]
            if fresh:
                self.waiting.appendList(fresh)
        self._set_alarm(min((r[0] for r in later), default=None))
        if ready:
            out = self.take(key, ready)
            if out is not None and len(out):
                yield out

    def until(self, watermark: int) -> int:
        """The last microsecond whose rows can all have come, at a watermark in milliseconds."""
        return watermark * 1000

    def due(self, micros: int) -> int:
        """The first watermark that releases a row."""
        return -(-micros // 1000)

    def _set_alarm(self, micros: int | None) -> None:
        """One timer a key, for its earliest row."""
        now = self.alarm.get()[0] if self.alarm.exists() else None
        at = None if micros is None else self.due(micros)
        if at == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if at is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def close(self) -> None:
        pass


# ---- scores of hosts ----------------------------------------------------------------

SCORES = (
    "host string, log_source string, id bigint, recv_time timestamp, "
    "delta double, entropy double, score double, anomaly boolean"
)
#: A host's model: events so far, time of the last, and the leaves (all trees of one event
#: after the other, 16 bits each) of the learned events of the window before and of this one.
MODEL = "position bigint, last bigint, before binary, current binary"


class HostScorer(InOrder):
    """``anomaly.host_anomaly_score`` along a stream: one model for each host and source."""

    WAITING = "micros bigint, id bigint, slots array<int>, entropy double"

    def __init__(self, window: int = H.WINDOW, threshold: float = anomaly.THRESHOLD):
        self.window, self.threshold = window, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.model = handle.getValueState("model", MODEL)

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        own = frame[frame["id"].notna()]  # rows of a clock have none
        micros = own["recv_time"].astype("datetime64[us]").astype("int64")
        slots = [[int(s) for s in row] for row in own["slots"]]
        return list(zip(micros.tolist(), own["id"].astype("int64").tolist(), slots, own["entropy"].tolist()))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Go on from a model of ``initial_models``."""
        row = initialState.iloc[0]
        events = sorted((dict(e) for e in row["events"]), key=lambda e: e["position"])
        position = int(row["position"])
        this, linux = position // self.window, key[1] == "linux"
        held = []
        for number in (this - 1, this):
            own = [e for e in events if e["position"] // self.window == number and e["learned"]]
            held.append(self._leaves([(0, 0, e["slots"], e["entropy"]) for e in own], [e["delta"] for e in own], linux))
        self._keep(position, int(row["last"]), *held)

    def take(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        linux = key[1] == "linux"
        position, last, before, current = self._known()
        micros = np.array([r[0] for r in rows], dtype=np.int64)
        behind = np.concatenate([[micros[0] if last is None else last], micros[:-1]])
        delta = (micros - behind) / 1e6
        entropy = np.array([r[3] for r in rows])
        burst = delta < anomaly.BURST_SECONDS
        if last is None:
            burst[0] = False
        flag = (burst | (entropy > anomaly.HIGH_ENTROPY)) if linux else np.zeros(len(rows), dtype=bool)
        leaf = self._leaves(rows, delta, linux)
        score = np.zeros(len(rows))
        done = 0
        while done < len(rows):
            # The rest of the window that the next event falls into.
            end = min(len(rows), done + self.window - position % self.window)
            own = slice(done, end)
            learned = ~flag[own]
            if position >= self.window:
                score[own] = H.scores(leaf[own].astype(np.int64), H.masses(before.astype(np.int64)), self.window)
                learned &= (score[own] <= self.threshold) if linux else (score[own] < anomaly.WINDOWS_LEARN_BELOW)
            current = np.concatenate([current, leaf[own][learned]])
            position += end - done
            done = end
            if position % self.window == 0:
                before, current = current, current[:0]
        self._keep(position, int(micros[-1]), before, current)
        score = np.where(flag, 1.0, score)
        return pd.DataFrame(
            {
                "host": key[0], "log_source": key[1], "id": [r[1] for r in rows],
                "recv_time": pd.to_datetime(micros, unit="us"), "delta": delta, "entropy": entropy,
                "score": score, "anomaly": flag | (score > self.threshold),
            }
        )

    def _leaves(self, rows: list[tuple], delta: Sequence[float], linux: bool) -> np.ndarray:
        if not len(rows):
            return np.zeros((0, H.TREES), np.int16)
        told = pd.Series([np.array(r[2]) for r in rows]), pd.Series(np.asarray(delta)), pd.Series([r[3] for r in rows])
        return H.leaves(anomaly._points(*told, linux)).astype(np.int16)

    def _known(self) -> tuple:
        none = np.zeros((0, H.TREES), np.int16)
        if not self.model.exists():
            return 0, None, none, none
        position, last, before, current = self.model.get()
        shaped = [np.frombuffer(bytes(b), np.int16).reshape(-1, H.TREES) for b in (before, current)]
        return position, last, *shaped

    def _keep(self, position: int, last: int, before: np.ndarray, current: np.ndarray) -> None:
        self.model.update((position, last, before.tobytes(), current.tobytes()))


def initial_models(state: DataFrame) -> DataFrame:
    """What ``HostScorer`` starts from, of ``anomaly.next_state`` rows: one row a host and source.

    A host keeps two windows of events at most, so a row is bounded.
    """
    event = F.struct("position", "slots", "delta", "entropy", "learned")
    return state.groupBy("host", "log_source").agg(
        (F.max("position") + 1).alias("position"),
        F.max(F.unix_micros("recv_time")).alias("last"),
        F.collect_list(event).alias("events"),
    )


def score_stream(
    events: DataFrame,
    state: DataFrame | None = None,
    window: int = H.WINDOW,
    threshold: float = anomaly.THRESHOLD,
    delay: str = "10 minutes",
) -> DataFrame:
    """Scores of a stream of ``anomaly.host_events``, equal to those of one batch over it.

    Rows without an id are a clock. ``state`` is what ``anomaly.next_state`` left of earlier
    events. A host's events are scored one after the other by nature of the model; a stream
    is as parallel as it has hosts, and a batch as large as its trigger lets it be.
    """
    own = events.select("id", "host", "log_source", "recv_time", "slots", "entropy")
    initial = None if state is None else initial_models(state)
    model = HostScorer(window, threshold)
    return keyed(own.withWatermark("recv_time", delay), ["host", "log_source"], model, SCORES, initial)


def host_models(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """(host, log_source, position, last) and leaves of the models in a checkpoint."""
    reader = spark.read.format("statestore").option("stateVarName", "model")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    with state_store(spark):
        return reader.load(checkpoint).select("key.*", "value.*")


# ---- brute force ----------------------------------------------------------------------

TRAILING = "{key} string, id bigint, recv_time timestamp, recent bigint"


class TrailingCount(InOrder):
    """Rows that are the latest of more than ``limit`` in the trailing ``seconds`` of a key.

    The state holds a ring of the seconds that still count, each with its number of rows.
    """

    WAITING = "micros bigint, id bigint"

    def __init__(self, key: str, seconds: int, limit: int):
        self.key, self.seconds, self.limit = key, seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getValueState("ring", "seconds array<bigint>, rows array<bigint>")

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        own = frame[frame["id"].notna()]
        micros = own["recv_time"].astype("datetime64[us]").astype("int64")
        return list(zip(micros.tolist(), own["id"].astype("int64").tolist()))

    # A second is counted as a whole, so its rows wait for its end.

    def until(self, watermark: int) -> int:
        return watermark // 1000 * 1_000_000 - 1

    def due(self, micros: int) -> int:
        return (micros // 1_000_000 + 1) * 1000

    def take(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        micros = np.array([r[0] for r in rows], dtype=np.int64)
        own, place, times = np.unique(micros // 1_000_000, return_inverse=True, return_counts=True)
        held, counts = self.ring.get() if self.ring.exists() else ([], [])
        seconds = np.concatenate([np.array(held, np.int64), own])
        counts = np.concatenate([np.array(counts, np.int64), times])
        sums = np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(seconds, own - self.seconds)
        recent = sums[len(held) + 1 :] - sums[first]
        still = seconds >= own[-1] - self.seconds
        self.ring.update((seconds[still].tolist(), counts[still].tolist()))
        hot = recent[place] > self.limit
        return pd.DataFrame(
            {
                self.key: key[0],
                "id": np.array([r[1] for r in rows])[hot],
                "recv_time": pd.to_datetime(micros[hot], unit="us"),
                "recent": recent[place][hot],
            }
        )


def brute_force_stream(
    failures: DataFrame,
    key: str,
    seconds: int = correlate.BRUTE_FORCE_SECONDS,
    limit: int = correlate.BRUTE_FORCE_LIMIT,
    delay: str = "10 minutes",
) -> DataFrame:
    """``correlate.brute_force`` on a stream of (id, recv_time, key).

    Rows without an id or a key are a clock.
    """
    of_key = F.when(F.col(key).isNotNull(), F.col("id")).alias("id")
    own = failures.select(F.col(key).cast("string").alias(key), of_key, "recv_time")
    count = TrailingCount(key, seconds, limit)
    return keyed(own.withWatermark("recv_time", delay), [key], count, TRAILING.format(key=key))


# ---- counting rules ---------------------------------------------------------------------

def threshold_stream(
    logs: DataFrame,
    rules: Sequence[Rule],
    timeframe: str | None = None,
    least: int | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """``correlate.threshold_alerts`` on a stream of logs: every counting rule, its own windows.

    Spark's own aggregations hold the windows of all rules: first the rows of each value of a
    source and window, combined in each task before they are grouped, then those of the window,
    when it is over. A row is given when the watermark has passed the window's end. Logs later
    than that are left out; logs without a match move the watermark like any other. A branch of
    a rule that is met gives a row of its own.
    """
    counting = correlate.counting_branches(rules)
    widest = max(correlate.window_seconds(counting, timeframe), default=0)
    hits = correlate.counted_values(logs, counting, timeframe, with_others=True)
    # The watermark follows the ends of windows and the time of every log, both as much later
    # as the widest window: so it stays ``delay`` behind the logs.
    clock = F.col("recv_time") + F.make_interval(secs=F.lit(widest))
    timed = hits.withColumn("window_end", F.coalesce("window_end", clock)).withWatermark("window_end", f"{delay} {widest} seconds")
    # Behind the fence the rows of the clock are not dropped before they have moved the watermark.
    counted = fence(timed, "branch").where("branch IS NOT NULL AND window_end IS NOT NULL")
    windows = correlate.counts_of_windows(counted, counting, "window_start", "window_end")
    found = windows.select("branch", "source", "window_start", correlate.verdict(counting, least).alias("matches"))
    return correlate.named_rows(found.where("matches IS NOT NULL"), counting)
