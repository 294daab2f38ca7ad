"""Order-dependent rules on streams: throttling and discoveries with state and timers.

A key's events wait in its state until the watermark has passed them and are then
taken in (ts, id) order, so a stream gives what the batch rules give, however its
events are split into micro-batches.  One timer a key stands at the earliest
waiting event.  The throttle's state goes once no event can be held back by it any
more, so idle keys cost nothing.

Defined results: an event that is not later than the watermark when it comes is
late and dropped; events without a time are left out; those without a key are
one key's.  A row without an id only moves time: a heartbeat after the last
event lets everything before it out.  A key's memory is its events of one
``delay``.

Needs the RocksDB state store (``state_store`` sets it for a session).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "us long, id long, counter double"


def state_store(spark: SparkSession) -> None:
    """Keep this session's streaming state in RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Calls ``take`` for each event in order once the watermark has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.memory = handle.getValueState("memory", "value double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [(r.us, r.id, r.counter) for r in rows if r.id is not None and r.us > passed]
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(us for us, _, _ in fresh))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due, rest = sorted(x for x in held if x[0] <= passed), [x for x in held if x[0] > passed]
        before = self.memory.get()[0] if self.memory.exists() else None
        now, out = before, []
        for us, event, counter in due:
            made, now = self.take(now, us, event, counter)
            if made is not None:
                out.append(Row(key=key[0], **made))
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self._wake(min(x[0] for x in rest))
        end = self.forget_at(now)
        if now is None or end is not None and end <= passed and not rest:
            if before is not None:
                self.memory.clear()
        elif now != before:
            self.memory.update((now,))
            if end is not None:
                self._wake(end)
        return iter(out)

    def _wake(self, us: float) -> None:
        self.handle.registerTimer(int(-(-us // 1000)))

    def take(self, memory: float | None, us: int, event: int, counter: float | None) -> tuple[dict | None, float | None]:
        raise NotImplementedError

    def forget_at(self, memory: float | None) -> float | None:
        """When the memory no longer matters; None: never."""
        return None

    def close(self) -> None:
        pass


class Throttle(InOrder):
    """Passes an event if the last passed one is far enough; remembers its time."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def take(self, memory, us, event, counter):
        if memory is None or us - memory >= self.gap:
            return {"id": event, "us": us}, float(us)
        return None, memory

    def forget_at(self, memory):
        return None if memory is None else memory + self.gap


class Discovery(InOrder):
    """Passes an event whose counter is above the one before; remembers the counter.

    A missing counter is remembered as missing: the next one is compared with 0.
    """

    def take(self, memory, us, event, counter):
        if counter is not None and counter > (memory or 0):
            return {"id": event, "us": us, "counter": counter, "before": memory}, counter
        return None, counter


def _run(events: DataFrame, key: Column, counter: Column, processor: InOrder, delay: str, out: str) -> DataFrame:
    timed = events.select(key.alias("key"), "id", F.col("ts").cast("timestamp").alias("ts"), counter.cast("double").alias("counter")).where(F.col("ts").isNotNull())
    rows = timed.withWatermark("ts", delay).select("key", "id", "ts", F.unix_micros("ts").alias("us"), "counter")
    kind = timed.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithState(processor, f"key {kind}, {out}", "append", "eventTime")


def throttle_in_order(events: DataFrame, key: str, interval_ms: int = 200, *, delay: str = "10 seconds") -> DataFrame:
    """(key, id, ts) of the events of a stream (key, id, ts) that pass the throttle."""
    passed = _run(events, F.col(key), F.lit(None), Throttle(interval_ms * 1000), delay, "id long, us long")
    return passed.select("key", "id", F.timestamp_micros("us").alias("ts"))


def discoveries_in_order(events: DataFrame, key: str, counter: Column, *, delay: str = "10 seconds") -> DataFrame:
    """(key, id, ts, counter, before) of the events whose counter has grown."""
    found = _run(events, F.col(key), counter, Discovery(), delay, "id long, us long, counter double, before double")
    return found.select("key", "id", F.timestamp_micros("us").alias("ts"), "counter", "before")
