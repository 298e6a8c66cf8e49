"""Watch sessions as a keyed state machine over a stream (STM-12), with a reorder buffer behind the watermark (STM-10).

Commands (event time, number, command) of a key arrive in any order.  They wait in list state
until the watermark has passed them, and are applied in order of time and number, so the
result is the same however the rows were split and shuffled.  A key has one timer, for the
first of what it waits for; when it expires, all that the watermark has passed is applied at
once, so that the list is read once a key and batch and not once a command.  A watch
is value state: ``start`` opens one unless one is open, ``mark`` counts only while one is
open, ``stop``, ``cancel`` and ``restart`` end it as completed, cancelled and interrupted, and
its deadline, which the timer waits for too, ends it as expired.  What is open is one row a key; what has ended
leaves the state.  State and timers lie in the checkpoint, so a stream that is started again
goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ENDS = {"stop": "completed", "cancel": "cancelled", "restart": "interrupted"}
OUTPUT = "started long, ended long, status string, markers int, last_marker long, refused int"


class Watches(StatefulProcessor):
    """Times are microseconds; timers are milliseconds."""

    def __init__(self, key: str, seconds: float) -> None:
        self.key, self.limit = key, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, number long, command string")
        self.due = handle.getValueState("due", "at long")
        self.watch = handle.getValueState("watch", "started long, markers int, last_marker long, refused int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        first = None
        for frame in rows:
            frame = frame[frame["at"] // 1000 >= now]  # what is older came too late
            if len(frame):
                self.waiting.appendList(list(zip(frame["at"].tolist(), frame["number"].tolist(), frame["command"].tolist(), strict=True)))
                first = min(int(frame["at"].min()) // 1000, first if first is not None else 1 << 62)
        if first is not None:
            self.wake(first + 1)
        return iter(())

    def wake(self, at: int) -> None:
        """The key's one timer, moved if it is due later than that."""
        held = self.due.get()[0] if self.due.exists() else None
        if held is None or at < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        held = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in held if r[0] < until]
        rest = held[len(ready) :]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        state = tuple(self.watch.get()) if self.watch.exists() else None
        before, ended = state, []

        def end(state: tuple, at: int, status: str) -> None:
            started, markers, last, refused = state
            ended.append((key[0], started, at, status, markers, None if last < 0 else last, refused))

        for at, _, command in ready:
            if state and at >= state[0] + self.limit:
                end(state, state[0] + self.limit, "expired")
                state = None
            if state is None:
                if command == "start":
                    state = (at, 0, -1, 0)
            elif command in ENDS:
                end(state, at, ENDS[command])
                state = None
            elif command == "mark":
                state = (state[0], state[1] + 1, at, state[3])
            elif command == "start":
                state = (*state[:3], state[3] + 1)
        if state and state[0] + self.limit < until:
            end(state, state[0] + self.limit, "expired")
            state = None
        if state != before:
            self.watch.update(state) if state else self.watch.clear()
        nexts = [r[0] for r in rest[:1]] + ([state[0] + self.limit] if state else [])
        if nexts:
            self.wake(min(nexts) // 1000 + 1)
        if ended:
            yield pd.DataFrame(ended, columns=[self.key, "started", "ended", "status", "markers", "last_marker", "refused"]).astype({"last_marker": "Int64"})

    def close(self) -> None:
        pass


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed processors with timers need this state store; the session's own is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def watches(commands: DataFrame, key: str, seconds: float = 90.0) -> DataFrame:
    """(key, started, ended, status, markers, last_marker, refused) of the watches that have ended; times in microseconds.

    commands: a stream (key, ts, number, command) with a watermark on ts.  refused counts the
    starts that an open watch turned away.  A watch of a null key is one of its own key.
    """
    kind = commands.schema[key].dataType.simpleString()
    rows = commands.select(key, "ts", F.unix_micros("ts").alias("at"), "number", "command").where("at is not null")
    return rows.groupBy(key).transformWithStateInPandas(Watches(key, seconds), f"{key} {kind}, {OUTPUT}", "append", "EventTime")
