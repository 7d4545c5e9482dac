"""Streams: rate admission and job life cycles."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sync_status
from ..operators import scans
from ..operators.admission import admit
from .state import InOrder, in_order

#: Status to the statuses that may follow it.
TRANSITIONS = {
    "pending": {"processing", "transcoding", "failed"}, "transcoding": {"completed", "failed"}, "processing": {"completed", "failed"}, "completed": {"archived"}, "failed": set(), "archived": set(),
}

#: Statuses in which a job is waited for.
AT_WORK = ("transcoding", "processing")

#: Events of one array.
CHUNK = 1_000


#: Microseconds of events that are taken together.
BUCKET = 1_000_000


class Admission(InOrder):
    """State: accepted times that are still in the window."""

    def __init__(self, limit: int, window: int):
        super().__init__(["id"], "id:bigint", "kept array<bigint>", BUCKET)
        self.limit, self.window = limit, window

    def start(self) -> tuple:
        return ([],)

    def taken(self, key: Any, state: tuple, events: list[tuple]) -> tuple[tuple, list[tuple]]:
        accepted, kept = admit([t for t, _ in events], self.limit, self.window, [int(k) for k in state[0]])
        return (kept,), [(key[0], i, ok) for (_, i), ok in zip(events, accepted, strict=True)]

    def waits(self, state: tuple) -> int | None:
        return int(state[0][-1]) + self.window if len(state[0]) else None

    def passed(self, key: Any, state: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        return None if next(iter(self.buckets.keys()), None) is None else ([],), []

    def result(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "id", "accepted"]).astype({"id": "int64", "accepted": "bool"})


def admission_stream(requests: DataFrame, key: str, at: str, order: str, limit: int, window_seconds: int, lateness: str = "10 seconds") -> DataFrame:
    """As ``operators.admission`` over a stream, by event time.

    A request is decided once the watermark has passed its second, so rows that come late, but within ``lateness``, are decided in
    their place; later ones are dropped.  Accepted times are the state; a key is forgotten when they have all left the
    window.  Rows without a time have no place and are dropped.
    """
    slim = requests.withWatermark(at, lateness).where(F.col(at).isNotNull())
    slim = slim.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(order).cast("long").alias("id"), F.col(at))
    return in_order(slim, Admission(limit, window_seconds * 1_000_000), "key string, id long, accepted boolean")


class LifeCycle(InOrder):
    """State: status, number of changes, time of the last event, step and progress within processing."""

    def __init__(self, limit: int):
        super().__init__(["seq", "asked", "ok", "step", "progress"], "seq:bigint,asked:string,ok:boolean,step:string,progress:double", "status string, steps int, last bigint, step string, progress double", BUCKET)
        self.limit = limit

    def start(self) -> tuple:
        return "pending", 0, 0, None, None

    def taken(self, key: Any, state: tuple, events: list[tuple]) -> tuple[tuple, list[tuple]]:
        now, steps, last, step, progress = state
        out = []

        def become(to: str, reason: str | None, new_step: str | None, new_progress: float | None) -> None:
            nonlocal now, steps, step, progress
            if (to, new_step, new_progress) != (now, step, progress):
                steps += to != now
                now, step, progress = to, new_step, new_progress
                out.append((key[0], now, steps, reason, step, progress))

        for t, _, asked, ok, at_step, at_progress in events:
            if now in AT_WORK and t > last + self.limit:
                become("failed", "TIMEOUT", None, None)
            if now in AT_WORK or now == "pending" or ok:
                to = next_status(now, asked) if ok else next_status(now, "failed")
                told = ok and asked == to and to in AT_WORK
                become(to, None if ok else "unusable", *((at_step, at_progress) if told else (step, progress) if to == now else (None, None)))
            last = t
        return (now, steps, last, step, progress), out

    def waits(self, state: tuple) -> int | None:
        return state[2] + self.limit if state[0] in AT_WORK else None

    def passed(self, key: Any, state: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        return ("failed", state[1] + 1, state[2], None, None), [(key[0], "failed", state[1] + 1, "TIMEOUT", None, None)]

    def result(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "status", "steps", "reason", "step", "progress"]).astype({"steps": "int32", "progress": "float64"})


def lifecycle_stream(events: DataFrame, key: str, at: str, seq: str, status: str, usable: str, timeout_seconds: int = 600, lateness: str = "10 seconds", step: str | None = None, progress: str | None = None) -> DataFrame:
    """(key, status, steps, reason, step, progress) after each change of a job, by event time.

    An event asks for a status; one that may not follow the present one changes nothing, and one that isn't ``usable`` (say, a
    job without a reference to what it works on) makes a live job fail.  An event that asks for the status in which the job already is at work tells its
    ``step`` (say, chunking, then analysing) and ``progress``; they end with that status.  A job that is at work and hears nothing for
    ``timeout_seconds`` fails, too: its reason is the value TIMEOUT, no exception.
    """
    slim = events.withWatermark(at, lateness).where(F.col(at).isNotNull())
    told = [(F.col(c) if c else F.lit(None)).cast(kind).alias(name) for c, kind, name in ((step, "string", "step"), (progress, "double", "progress"))]
    slim = slim.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(seq).cast("long").alias("seq"), F.col(status).alias("asked"), F.coalesce(usable, F.lit(False)).alias("ok"), *told, F.col(at))
    return in_order(slim, LifeCycle(timeout_seconds * 1_000_000), "key string, status string, steps int, reason string, step string, progress double")


def next_status(now: str, asked: str) -> str:
    return asked if asked in TRANSITIONS.get(now, set()) else now


def lifecycle(events: DataFrame, key: str, seq: str, status: str, hot_rows: int | None = None) -> DataFrame:
    """(key, status, steps) after all events in order; a transition that isn't allowed is ignored.

    Events in order are cut into chunks of CHUNK.  A chunk becomes a map from each status before it to
    (status after it, steps); CHUNK maps in turn become one, so no array grows with a key's events before
    the last one, which has an entry for each CHUNK * CHUNK of them.
    """
    states = list(TRANSITIONS)
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in sorted(v)]).cast("array<string>"))])
    same = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(0).alias("steps")) for s in states])

    def step(state, event):  # noqa: ANN001, ANN202
        ok = F.coalesce(F.array_contains(allowed[state["status"]], event), F.lit(False))
        return F.struct(F.when(ok, event).otherwise(state["status"]).alias("status"), (state["steps"] + ok.cast("int")).alias("steps"))

    def after(done, chunk):  # noqa: ANN001, ANN202
        then = lambda x: F.get(chunk, F.array_position(F.lit(states), x["status"]).cast("int") - 1)
        return F.transform(done, lambda x: F.struct(then(x)["status"].alias("status"), (x["steps"] + then(x)["steps"]).alias("steps")))

    rows = scans.positions(events.select(key, seq, status), [key], [seq, status], "__i", hot_rows).withColumn("__c", F.floor(F.col("__i") / CHUNK))
    chunks = rows.groupBy(key, "__c").agg(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), F.col(status).alias("to")))).alias("e"))
    maps = chunks.select(key, "__c", F.aggregate(F.transform("e", lambda x: x["to"]), same, lambda done, to: F.transform(done, lambda x: step(x, to))).alias("m"))

    def folded(by: list[str], at: str) -> DataFrame:
        parts = maps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), "m"))).alias("e"))
        return parts.select(*by, F.aggregate(F.transform("e", lambda x: x["m"]), same, after).alias("m"))

    maps = maps.withColumn("__d", F.floor(F.col("__c") / CHUNK))
    maps = folded([key, "__d"], "__c")
    return folded([key], "__d").select(key, F.get("m", F.lit(states.index("pending"))).alias("r")).select(key, "r.status", "r.steps")


def claimed(pending: DataFrame, kind: str, key: str, n: int = 3) -> DataFrame:
    """The first n jobs of each kind in order of their keys: what one cycle pulls.  Of each kind every task keeps n rows before they meet."""
    local = pending.withColumn("__p", F.spark_partition_id())
    few = local.withColumn("__r", F.row_number().over(Window.partitionBy(kind, "__p").orderBy(key))).where(F.col("__r") <= n).drop("__r", "__p")
    return few.withColumn("__r", F.row_number().over(Window.partitionBy(kind).orderBy(key))).where(F.col("__r") <= n).drop("__r")


def polled(stream: DataFrame, stages: list[Callable[[DataFrame, int], None]], checkpoint: str, seconds: int = 5):  # noqa: ANN201
    """A started query that hands each cycle's rows to the stages in their fixed order."""
    def cycle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for stage in stages:
            stage(batch, batch_id)
        batch.unpersist()

    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def promoted(rows: DataFrame, index: DataFrame, key: str, stored: str, fresh: str) -> DataFrame:
    """Rows with the state they show: pending ones have the index's, once it has one; ``changed`` are those whose stored state is to be updated."""
    seen = rows.join(index.select(key, F.col(fresh).alias("__fresh")), key, "left")
    state = sync_status(F.col(stored), F.col("__fresh"))
    return seen.withColumn("shown", state).withColumn("changed", (F.col(stored) == "pending") & F.col("shown").isin("ready", "error")).drop("__fresh")


def append_once(batch: DataFrame, batch_id: int, path: str, key: str) -> None:
    """foreachBatch sink: a batch has its own folder, so that a replay overwrites it instead of adding to it."""
    batch.dropDuplicates([key]).withColumn("seq", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
