"""Calls of outside services: retries, errors by row, and one logged answer for each request."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from framelake.operators import providers as U


def test_retries_wait_twice_as_long_each_time():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ConnectionError
        return x

    assert U.with_retries(flaky, 1, wait=waits.append) == 1 and waits == [2.0, 4.0]
    for fault, tried in ((TimeoutError, 3), (KeyError, 1)):
        calls.clear()

        def bad(x, fault=fault):
            calls.append(x)
            raise fault

        with pytest.raises(fault):
            U.with_retries(bad, 1, wait=waits.append)
        assert len(calls) == tried


@pytest.fixture
def service(tmp_path):
    """Writes a file for each call; odd requests fail passingly at first, 13 always, 17 not passingly."""
    folder = str(tmp_path / "calls")
    os.makedirs(folder)

    def call(request, digest):
        n = sum(f.startswith(digest) for f in os.listdir(folder))
        open(f"{folder}/{digest}-{n}-{request['x']}-{threading.get_ident()}", "w").close()
        time.sleep(0.02)
        x = request["x"]
        if x == 17:
            raise ValueError("no such thing")
        if x == 13 or (x is not None and x % 2 and n == 0):
            raise TimeoutError("busy")
        return f"answer to {x}"

    return call, folder


def test_each_request_has_one_logged_answer(spark, tmp_path, service):
    call, folder = service
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(k, k % 20 if k % 21 else None) for k in range(60)], "id long, x int").repartition(4)
    got = U.called(rows, ["x"], call, log, delay=0.01).collect()
    assert len(got) == 60
    for r in got:
        if r["x"] == 17:
            assert r["answer"] is None and r["error"] == "ValueError: no such thing"
        elif r["x"] == 13:
            assert r["answer"] is None and r["error"] == "TimeoutError: busy"
        else:
            assert r["answer"] == f"answer to {r['x']}" and r["error"] is None
    logged = spark.read.parquet(log)
    assert logged.count() == logged.select("digest").distinct().count() == 19  # 20 numbers and null, but 13 and 17
    made = os.listdir(folder)
    assert sum("-13-" in f for f in made) == 3 and sum("-17-" in f for f in made) == 1 and sum("-4-" in f for f in made) == 1 and sum("-5-" in f for f in made) == 2
    assert len({f.rsplit("-", 1)[1] for f in made}) > 1  # side by side
    again = U.called(rows, ["x"], call, log, delay=0.01).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    more = os.listdir(folder)[:]
    assert len(more) - len(made) == 4  # 13 three times and 17 once; all others come from the log
    assert U.called(rows.limit(1), ["x"], call, log, version="2", delay=0.01).count() == 1 and spark.read.parquet(log).count() == 20
    assert U.called(rows.limit(0), ["x"], call, log).count() == 0


def test_a_lost_task_calls_with_the_same_key_and_logs_once(spark, tmp_path):
    folder = str(tmp_path)

    def call(request, digest):
        mark = f"{folder}/{digest}"
        if os.path.exists(mark):
            return open(mark).read()  # a service that knows the key
        with open(mark, "w") as f:
            f.write(f"first answer to {request['x']}")
        return f"first answer to {request['x']}"

    rows = spark.createDataFrame([(k,) for k in range(20)], "x int").repartition(2)
    for _ in range(2):
        U.called(rows, ["x"], call, f"{folder}/log")
        lost = spark.read.parquet(f"{folder}/log").limit(0)
        lost.write.mode("overwrite").parquet(f"{folder}/log2")
    assert spark.read.parquet(f"{folder}/log").count() == 20 and len([f for f in os.listdir(folder) if len(f) == 64]) == 20


def test_adapted_images(spark, tmp_path):
    def call(request, digest):
        if request["aspect_ratio"] == "bad":
            raise ValueError("ratio")
        return f'{{"in": {len(request["prompt"])}, "out": 7}}'

    jobs = spark.createDataFrame([("a", "cat", ["1:1", "9:16", "1:1"]), ("b", "dog", ["bad"]), ("c", "x", []), ("d", "x", None), ("e", "cat", ["1:1", "bad"])], "job string, prompt string, ratios array<string>")
    used = lambda a: (F.get_json_object(a, "$.in").cast("long"), F.get_json_object(a, "$.out").cast("long"))
    results, done = U.adapted(jobs, "job", "ratios", ["prompt"], call, str(tmp_path / "log"), used)
    assert results.count() == 6 and results.where("error is null").count() == 4
    assert {r["job"]: tuple(r)[1:] for r in done.collect()} == {"a": (9, 21, 3, 0, "completed"), "b": (0, 0, 0, 1, "failed"), "c": (0, 0, 0, 0, "completed"), "d": (0, 0, 0, 0, "completed"), "e": (3, 7, 1, 1, "completed")}
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_hashed_embedding_counts_signs_by_place(spark):
    text = "one two three four five six seven two " * 20
    got = spark.createDataFrame([(text,)], "t string").select(U.hashed_embedding(F.col("t"), 8).alias("v"), F.transform(F.split(F.col("t"), " "), lambda w: F.xxhash64(w)).alias("h")).first()
    want = [0] * 8
    for w, h in zip(text.split(" "), got["h"], strict=True):
        if w:
            want[h % 8] += 1 if h & (1 << 40) == 0 else -1
    norm = sum(x * x for x in want) ** 0.5
    assert got["v"] == pytest.approx([x / norm for x in want])
