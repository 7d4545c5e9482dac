"""Streams with state: restarts, late rows, timeouts and a key of very many events."""

import os

import pytest
from pyspark.sql import functions as F

from framelake.operators import admission as A
from framelake.streaming import jobs as J


def feed(spark, tmp_path, k, rows, schema):
    """One file, which is one batch."""
    spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / f"made-{k}"))
    (file,) = (tmp_path / f"made-{k}").glob("*.parquet")
    target = tmp_path / "in" / f"{k:03d}.parquet"
    target.parent.mkdir(exist_ok=True)
    target.write_bytes(file.read_bytes())
    os.utime(target, (1_000_000 + k * 1000,) * 2)


def run(spark, tmp_path, schema, of):
    """A started and ended query over the files so far; what all runs have put out."""
    source = spark.createDataFrame([], schema).withColumn("at", F.timestamp_seconds("s")).schema
    stream = of(spark.readStream.schema(source).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()), key=repr)


@pytest.fixture(autouse=True)
def few_stores(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_admission_goes_on_after_a_restart(spark, tmp_path):
    schema = "u string, id long, s long"
    data = [("hot" if i % 4 else "cold", i, 1000 + i * 3) for i in range(60)]
    of = lambda x: J.admission_stream(x, "u", "at", "id", 3, 40, "5 seconds")
    feed(spark, tmp_path, 0, data[:30], schema)
    first = run(spark, tmp_path, schema, of)
    assert 0 < len(first) < 31
    feed(spark, tmp_path, 1, [*data[30:], ("cold", 900, 1000)], schema)  # with a row that comes far too late
    feed(spark, tmp_path, 2, [("end", 901, 9000)], schema)
    got = run(spark, tmp_path, schema, of)
    table = spark.createDataFrame(data, schema).withColumn("at", F.timestamp_seconds("s"))
    want = sorted(map(tuple, A.admission(table, ["u"], "at", "id", 3, 40).collect()), key=repr)
    assert [r for r in got if r[0] != "end"] == want and set(first) <= set(got)
    assert any(not ok for *_, ok in want)


def test_life_cycle_with_steps_timeout_and_restart(spark, tmp_path):
    schema = "k string, id long, s long, asked string, ok boolean, step string, done double"
    of = lambda x: J.lifecycle_stream(x, "k", "at", "id", "asked", "ok", 600, "20 seconds", "step", "done")
    feed(spark, tmp_path, 0, [("a", 1, 10, "processing", True, "chunking", 0.0), ("a", 2, 20, "processing", True, "analyzing", 0.25), ("b", 1, 10, "transcoding", True, None, None), ("c", 1, 11, "processing", None, None, None)], schema)
    feed(spark, tmp_path, 1, [("a", 4, 45, "completed", True, None, None), ("a", 3, 40, "processing", True, "analyzing", 1.0), ("end", 1, 100, "processing", True, None, None)], schema)
    first = run(spark, tmp_path, schema, of)
    assert ("a", "completed", 2, None, None, None) in first and not any(r[0] == "b" and r[1] == "failed" for r in first)
    feed(spark, tmp_path, 2, [("b", 2, 30, "completed", True, None, None), ("a", 5, 300, "archived", True, None, None), ("end", 2, 2000, "completed", True, None, None)], schema)  # b's comes too late
    feed(spark, tmp_path, 3, [("end", 3, 9000, "archived", True, None, None)], schema)
    got = [r for r in run(spark, tmp_path, schema, of) if r[0] != "end"]
    assert got == sorted([
        ("a", "processing", 1, None, "chunking", 0.0), ("a", "processing", 1, None, "analyzing", 0.25), ("a", "processing", 1, None, "analyzing", 1.0), ("a", "completed", 2, None, None, None), ("a", "archived", 3, None, None, None),
        ("b", "transcoding", 1, None, None, None), ("b", "failed", 2, "TIMEOUT", None, None), ("c", "failed", 1, "unusable", None, None),
    ], key=repr)


def test_a_key_of_very_many_events(spark, tmp_path):
    schema = "u string, id long, s double"
    n = 100_000
    for k in range(4):
        rows = spark.range(k * n // 4, (k + 1) * n // 4).select(F.lit("hot").alias("u"), "id", (F.col("id") * 0.01 + 100).alias("s"))
        feed(spark, tmp_path, k, rows.collect(), schema)
    feed(spark, tmp_path, 4, [("hot", n, 5000.0)], schema)
    got = run(spark, tmp_path, schema, lambda x: J.admission_stream(x, "u", "at", "id", 5, 10, "1 seconds"))
    ids, accepted = [r[1] for r in got], [r[1] for r in got if r[2]]
    assert sorted(ids) == list(range(n))
    want, kept = A.admit([100_000_000 + i * 10_000 for i in range(n)], 5, 10_000_000)
    assert sorted(accepted) == [i for i, ok in enumerate(want) if ok]
