"""Scans of hot keys against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators import admission as A
from framelake.operators import scans as S
from framelake.streaming import jobs as J

HOT = 50


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(2)
    rows = [(k, "hot" if k % 3 == 0 else None if k % 7 == 0 else f"u{r.randint(0, 40)}", None if k % 97 == 0 else r.randint(0, 300) * 10 + (k % 2) * 100_000, r.choice(list(J.TRANSITIONS))) for k in range(1500)]
    return spark.createDataFrame(rows, "id long, user string, t long, ask string").withColumn("odd.name", F.lit(1))


def bag(df):
    return sorted(map(str, df.collect()))


def tasks_with_rows(df):
    """Chunks that the hot key's rows lie in."""
    return df.where("user = 'hot'").select("__c").distinct().count()


def test_positions(spark, events):
    want = events.withColumn("p", F.row_number().over(Window.partitionBy("user").orderBy("t", "id")) - 1)
    assert bag(S.positions(events, ["user"], ["t", "id"], "p", HOT)) == bag(want) == bag(S.positions(events, ["user"], ["t", "id"], "p"))
    assert S.positions(events.limit(0), ["user"], ["t", "id"], "p", HOT).count() == 0
    assert tasks_with_rows(S.in_chunks(events, ["user"], ["t", "id"], 16)) > 3


def test_running_sum(events):
    want = events.withColumn("s", F.sum("id").over(Window.partitionBy("user").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert bag(S.running(events, ["user"], ["t", "id"], F.col("id"), "s", HOT)) == bag(want)


@pytest.mark.parametrize("width", [0, 35, 1_000_000])
def test_trailing(events, width):
    want = events.withColumn("n", F.count("*").over(Window.partitionBy("user").orderBy("t").rangeBetween(-width, 0)))
    assert bag(S.trailing(events, ["user"], "t", width, "n", hot_rows=HOT)) == bag(want) == bag(S.trailing(events, ["user"], "t", width, "n"))


def test_trailing_in_order(events):
    rows = [(r["user"], -1 if r["t"] is None else r["t"], r["t"] is None, r["id"]) for r in events.collect()]
    want = {(u, i): sum(v == u and m == none and t - 35 <= s and (s, j) <= (t, i) for v, s, m, j in rows) for u, t, none, i in rows}
    for hot in (HOT, None):
        got = S.trailing(events, ["user"], "t", 35, "n", order=["id"], hot_rows=hot)
        assert {(r["user"], r["id"]): r["n"] for r in got.collect()} == want


def test_no_partition_of_a_hot_key_in_one_window(events):
    plan = S.trailing(events, ["user"], "t", 35, "n", hot_rows=HOT)._jdf.queryExecution().toString()
    assert "Join LeftAnti" in plan and "__c" in plan


def test_admission_and_life_cycle_of_a_hot_key(events):
    timed = events.withColumn("at", F.timestamp_seconds("t"))
    assert bag(A.admission(timed, ["user"], "at", "id", 2, 40, HOT)) == bag(A.admission(timed, ["user"], "at", "id", 2, 40))
    want = set()
    for user in {r["user"] for r in events.collect()}:
        own = sorted((r["t"], r["id"]) for r in events.collect() if r["user"] == user and r["t"] is not None)
        want |= {(user, i, ok) for (_, i), ok in zip(own, A.admit([t for t, _ in own], 2, 40)[0], strict=True)}
    assert {tuple(r) for r in A.admission(timed, ["user"], "at", "id", 2, 40, HOT).where("id % 97 != 0").collect()} == want
    assert bag(J.lifecycle(events, "user", "id", "ask", HOT)) == bag(J.lifecycle(events, "user", "id", "ask"))
