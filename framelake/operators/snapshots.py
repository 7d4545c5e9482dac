"""Current state as a bucketed snapshot and the log written since.

A snapshot is a table bucketed by key with the number of the last log row in it.  Reading merges only newer rows of the log, and joins
them to the snapshot's buckets, which don't move.  A new snapshot counts once its line in the list of snapshots is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relations as R

LIST = "version bigint, name string, last bigint"


@dataclass(frozen=True)
class Log:
    """An append log's columns: its key, its numbers in the order of writing, and its operation, of which ``delete`` removes a key."""

    key: str
    seq: str
    op: str = "op"


def latest(spark: SparkSession, path: str) -> tuple[int, str | None, int | None]:
    """(version, table, last number) of the newest snapshot listed at ``path``; none yet: (0, None, None)."""
    try:
        row = spark.read.schema(LIST).parquet(path).orderBy(F.desc("version"), "name").first()
    except AnalysisException:  # nothing has been listed
        row = None
    return (row["version"], row["name"], row["last"]) if row else (0, None, None)


def newer(log: DataFrame, of: Log, last: int | None) -> DataFrame:
    """Rows of the log after the snapshot; the filter reaches the scan."""
    return log if last is None else log.where(F.col(of.seq) > last)


def merged(snapshot: DataFrame | None, log: DataFrame, of: Log) -> DataFrame:
    """The snapshot's rows whose keys the log doesn't name, and the log's newest row of each other key that isn't deleted.  Null keys are a key."""
    rows = R.newest_of(log, of.key, of.seq, of.op)
    kept = rows.where(F.col(of.op) != "delete").drop(of.seq, of.op)
    if snapshot is None:
        return kept
    key = F.col(f"`{of.key}`")
    untouched = snapshot.where(key.isNotNull()).join(rows.select(key), of.key, "left_anti")  # plain equality, which buckets serve
    null = snapshot.where(key.isNull()).join(F.broadcast(rows.where(key.isNull()).select(F.lit(True).alias("__null")).limit(1)), F.col("__null"), "left_anti")  # at most a row each
    return untouched.unionByName(null).unionByName(kept)


def current(spark: SparkSession, path: str, log: DataFrame, of: Log) -> DataFrame:
    """The state after all rows of ``log``."""
    _, name, last = latest(spark, path)
    return merged(spark.table(name) if name else None, newer(log, of, last), of)


def compact(spark: SparkSession, path: str, name: str, log: DataFrame, of: Log, buckets: int, upto: int | None = None) -> tuple[str | None, int | None]:
    """(table, last number) of a new snapshot of ``log`` up to ``upto`` (or to its end as of now), listed at ``path``.

    Rows must be numbered in the order in which they are written: a row that arrives later with a number that a snapshot covers isn't seen.
    A job that dies before its snapshot is listed has changed nothing, and its table is overwritten by the next one.
    Without newer rows nothing is written.
    """
    version, old, last = latest(spark, path)
    rows = newer(log, of, last)
    end = rows.agg(F.max(of.seq)).first()[0] if upto is None else upto
    if end is None or (last is not None and end <= last):
        return old, last
    new = f"{name}_v{version + 1}"
    state = merged(spark.table(old) if old else None, rows.where(F.col(of.seq) <= end), of)
    state.write.mode("overwrite").bucketBy(buckets, of.key).sortBy(of.key).saveAsTable(new)
    spark.createDataFrame([(version + 1, new, end)], LIST).coalesce(1).write.mode("append").parquet(path)
    return new, end
