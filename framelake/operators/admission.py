"""Rate admission: a request is let in if fewer than the limit were let in within the window before it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import client_ip, expiry
from . import scans


def admit(times: Iterable[int], limit: int, window: int, accepted: Iterable[int] = ()) -> tuple[list[bool], list[int]]:
    """(let in or not, accepted times still in the window).  Only accepted requests count; one exactly a window old still does."""
    kept, out = deque(accepted), []
    for t in times:
        while kept and kept[0] < t - window:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, list(kept)


def admission(requests: DataFrame, keys: list[str], at: str, order: str, limit: int, window_seconds: int, hot_rows: int | None = None) -> DataFrame:
    """(keys, order, accepted) per request.

    A request more than a window after the one before it finds no accepted ones, so there a key's requests
    are cut into runs.  Where a run never has more than ``limit`` requests within a window, all are let in.  Only other runs are
    dealt out, and sorted ones stream through a task that only keeps the
    accepted times in the window.  What leads there are scans, which deal a hot key over tasks; in a run that is over its limit, each answer
    depends on those before it, so such a run is one task's.
    A request without a time has no place in any window and isn't let in.
    """
    window = window_seconds * 1_000_000
    slim = requests.select(*keys, order, F.unix_micros(F.col(at).cast("timestamp")).alias("__t"))
    names = [n for n, _ in slim.dtypes if n != "__t"]
    schema = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes if n != "__t") + ", accepted boolean"
    timed = scans.trailing(slim.where(F.col("__t").isNotNull()), keys, "__t", window, "__n", order=[order], hot_rows=hot_rows).withColumn("__starts", F.col("__n") == 1)
    timed = scans.running(timed, keys, ["__t", F.col("__starts").desc(), order], F.col("__starts").cast("long"), "__run", hot_rows)
    most = timed.groupBy(*keys, "__run").agg((F.max("__n") > limit).alias("__busy"))
    named = [F.col(f"r.`{c}`") for c in [*names, "__t", "__starts", "__run"]]
    timed = timed.alias("r").join(most.alias("b"), scans.same("r", "b", [*keys, "__run"])).select(*named, "b.__busy")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[int] = []
        for b in batches:
            times, cuts, accepted = b["__t"].tolist(), [0, *[k for k in b["__starts"].to_numpy().nonzero()[0].tolist() if k], len(b)], []
            for a, e in zip(cuts, cuts[1:], strict=False):
                got, kept = admit(times[a:e], limit, window, () if a < e and b["__starts"].iloc[a] else kept)
                accepted += got
            yield b[names].assign(accepted=accepted)

    busy = timed.where("__busy").repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", "__t", F.col("__starts").desc(), order)
    calm = timed.where("not __busy").select(*names, F.lit(True).alias("accepted"))
    return busy.mapInPandas(step, schema).unionByName(calm).unionByName(slim.where(F.col("__t").isNull()).select(*names, F.lit(False).alias("accepted")))


def client_admission(requests: DataFrame, forwarded: str, host: str, group: str, at: str, order: str, limit: int = 2, window_minutes: int = 10, hot_rows: int | None = None) -> DataFrame:
    """``requests`` with client_ip, accepted, expires and retry_after.

    A client is the first forwarded address, else the host, else ``unknown``; limits hold for each client and ``group``.  An accepted request
    is recorded and expires a window later; a refused one isn't recorded and may come again after ``retry_after`` seconds.
    ``order`` is a request's number and tells requests apart.  A request without a time is refused.
    """
    named = requests.withColumn("client_ip", client_ip(F.col(forwarded), F.col(host)))
    got = admission(named, ["client_ip", group], at, order, limit, window_minutes * 60, hot_rows)
    out = named.alias("r").join(got.select(order, "accepted").alias("a"), order)
    yes = F.col("accepted")
    return out.select(*[F.col(f"r.`{c}`") for c in named.columns], "accepted").withColumn("expires", F.when(yes, expiry(F.col(at), window_minutes))).withColumn("retry_after", F.when(~yes, window_minutes * 60))
