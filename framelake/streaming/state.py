"""Event-time state: events wait in buckets by time until the watermark has passed them, then are taken in order.

A key's buckets are entries of a map state, so a batch reads and writes only the buckets that its rows fall into; an event-time timer
at a bucket's end takes it out.  What a job has become is a value state beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_state_store(spark: SparkSession) -> None:
    """Map states and timers need a state store that keeps them on disk; a store that is set already stays."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, ROCKS)


class InOrder(StatefulProcessor):
    """Hands events to ``taken`` in the order of their time and of what follows it in a row.

    Rows have ``t`` (microseconds) first and then ``columns``.  Buckets are ``width`` microseconds wide, so an event waits at most so long
    after the watermark has passed it.  Events of a bucket that has been taken come too late and are dropped.
    """

    def __init__(self, columns: list[str], kinds: str, value: str, width: int):
        self.columns, self.kinds, self.value, self.width = columns, kinds, value, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket bigint", f"events array<struct<t:bigint,{self.kinds}>>")
        self.state = handle.getValueState("state", f"taken bigint, {self.value}")

    def close(self) -> None:
        pass

    # What a subclass says: the state before anything, what events do to it, and until when (microseconds, or None) it waits for more.
    def start(self) -> tuple:
        raise NotImplementedError

    def taken(self, key: Any, state: tuple, events: list[tuple]) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def waits(self, state: tuple) -> int | None:
        raise NotImplementedError

    def passed(self, key: Any, state: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        """(state, rows) once the watermark has passed what it waited for and no event came; no state: the key is forgotten."""
        raise NotImplementedError

    def result(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def get(self) -> tuple[int, tuple]:
        found = self.state.get() if self.state.exists() else None
        return (found[0], tuple(found[1:])) if found is not None else (-(1 << 62), self.start())

    def end(self, bucket: int) -> int:
        """The first millisecond at which no event of the bucket can come."""
        return ((bucket + 1) * self.width - 1) // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        taken, new = self.get()[0], {}
        for b in rows:
            plain = b[["t", *self.columns]].astype(object).where(b[["t", *self.columns]].notna(), None)
            for event in plain.itertuples(index=False, name=None):
                if event[0] // self.width > taken:
                    new.setdefault(event[0] // self.width, []).append(tuple(event))
        for bucket, events in new.items():
            if self.buckets.containsKey((bucket,)):
                events = [tuple(e) for e in self.buckets.getValue((bucket,))[0]] + events
            else:
                self.handle.registerTimer(self.end(bucket))
            self.buckets.updateValue((bucket,), (events,))
        yield self.result([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        last, state = self.get()
        ready = sorted(b for (b,) in self.buckets.keys() if self.end(b) <= now)
        out: list[tuple] = []
        for bucket in ready:
            events = [tuple(e) for e in self.buckets.getValue((bucket,))[0]]
            self.buckets.removeKey((bucket,))
            state, rows = self.taken(key, state, sorted(events, key=lambda e: [(x is not None, x if x is not None else 0) for x in e]))
            last = bucket
            out += rows
        until = self.waits(state)
        waiting = until is not None and any(b * self.width <= until for (b,) in self.buckets.keys())  # these events come first
        if not ready and until is not None and until // 1000 + 1 <= now and not waiting:
            state, rows = self.passed(key, state, now * 1000)
            out += rows
            until = self.waits(state) if state is not None else None
        if state is None:
            self.state.clear()
        else:
            self.state.update((last, *state))
            if until is not None and not waiting:
                self.handle.registerTimer(max(until // 1000 + 1, now + 1))
        yield self.result(out)


def in_order(rows: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    """``processor`` over a stream with columns key, t and its own, and a watermark."""
    use_state_store(rows.sparkSession)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
