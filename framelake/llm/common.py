"""Shared folder, materialised tables and small column helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise, new_path, path_exists, shared_dir

__all__ = ["discard", "materialise", "new_path", "path_exists", "shared_dir", "small_batches", "table", "text_or_empty"]


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Python, and read from Parquet, at most so many rows at once, for rows that are large."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    was = {k: spark.conf.get(k) for k in keys}
    for k, v in was.items():
        spark.conf.set(k, str(min(rows, int(v)) if int(v) > 0 else rows))
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
