"""Snapshot and log: what is read is the log's newest rows, whatever was compacted, and only newer rows move."""

import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators import relations as R
from framelake.operators import snapshots as S

OF = S.Log("k", "seq")


@pytest.fixture(scope="module")
def log(spark):
    r = random.Random(4)
    rows = [(None if k % 11 == 0 else f"key{r.randint(0, 60) if k % 3 else 0}", k, r.choice(["put", "put", "delete"]), r.choice([None, k])) for k in range(600)]
    return spark.createDataFrame(rows, "k string, seq long, op string, v long").repartition(6)


def bag(df):
    return sorted(map(str, df.collect()))


def by_window(log):
    newest = Window.partitionBy("k").orderBy(F.desc("seq"), "op", F.to_json(F.struct("*")))
    return log.withColumn("r", F.row_number().over(newest)).where("r = 1 and op != 'delete'").drop("r")


@pytest.mark.parametrize("seq", ["seq", "cast(seq as double)", "timestamp_seconds(seq)", "cast(seq as decimal(20,2))", "cast(nullif(seq % 50, 7) as int)"])
def test_current_is_the_windows_first_row(log, seq):
    rows = log.withColumn("seq", F.expr(seq)).unionByName(log.limit(50).withColumn("seq", F.expr(seq)))
    assert bag(R.current(rows, "k", "seq", "op")) == bag(by_window(rows))


def test_current_combines_before_the_exchange(log):
    plan = R.current(log, "k", "seq", "op")._jdf.queryExecution().sparkPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_snapshot_and_log(spark, tmp_path, log):
    name, path = f"snap_{uuid.uuid4().hex}", str(tmp_path / "list")
    want = lambda upto: bag(by_window(log.where(F.col("seq") <= upto)).drop("seq", "op"))
    assert bag(S.current(spark, path, log, OF)) == want(600)
    try:
        for upto in (200, 400):
            table, last = S.compact(spark, path, name, log, OF, 4, upto)
            assert last == upto and bag(spark.table(table)) == want(upto)
            assert bag(S.current(spark, path, log, OF)) == want(600)
        assert S.compact(spark, path, name, log, OF, 4, upto=300) == (table, 400)  # nothing is newer
        # A job that died before it listed its snapshot leaves a table that counts for nothing.
        spark.range(3).write.mode("overwrite").saveAsTable(f"{name}_v3")
        assert bag(S.current(spark, path, log, OF)) == want(600)
        table, last = S.compact(spark, path, name, log, OF, 4)
        assert (table, last) == (f"{name}_v3", 599) and bag(spark.table(table)) == want(600)
        assert S.compact(spark, path, name, log, OF, 4) == (table, 599)
        assert S.newer(log, OF, last).count() == 0 and bag(S.current(spark, path, log, OF)) == want(600)
    finally:
        for v in (1, 2, 3):
            spark.sql(f"drop table if exists {name}_v{v}")


def test_the_snapshot_does_not_move(spark, tmp_path, log):
    name, path = f"snap_{uuid.uuid4().hex}", str(tmp_path / "list")
    try:
        S.compact(spark, path, name, log, OF, 8, 500)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = S.current(spark, path, log, OF)._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "Scan parquet" in line and name in line)
        before = plan[: plan.index(scan)].splitlines()
        assert "Bucketed: true" in scan and not any("Exchange" in line for line in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table if exists {name}_v1")
