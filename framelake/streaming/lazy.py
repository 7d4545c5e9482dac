"""An embedding as a column that fills itself: rows are there at once, their vectors come later, and a row's state follows when it is read.

Three steps, each of which may run again: rows are appended in batches, a stream over them writes a vector or an error for each, and a refresh
shows every row's state and writes down the states that have changed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import embedding_status, is_blank
from ..operators import relations as R
from ..operators.providers import hashed_embedding
from ..sources.shared import path_exists
from .jobs import append_once, promoted

VECTOR = "struct<embedding:array<double>,status:string>"
VECTORS = {"embedding": "array<double>", "status": "string"}


def offline(text: Column) -> Column:
    """VECTOR of a text without a model; a blank text has none."""
    blank = is_blank(text)
    return F.struct(F.when(~blank, hashed_embedding(text)).alias("embedding"), F.when(blank, "nothing to embed").otherwise("").alias("status"))


def by_model(call: Callable[[list[str]], list[list[float] | None]]) -> Callable[[Column], Column]:
    """VECTOR by a model that takes texts.  If a batch fails, it is asked text by text, and a text that fails has its error as status."""
    def one(texts: list[str]) -> list[tuple[list[float] | None, str]]:
        try:
            return [(v, "" if v is not None else "no embedding") for v in call(texts)]
        except Exception as e:  # noqa: BLE001  an outside service may fail in any way
            return [(None, f"{type(e).__name__}: {e}")] if len(texts) == 1 else [x for t in texts for x in one([t])]

    @F.pandas_udf("embedding array<double>, status string")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(one([t or "" for t in texts]), columns=["embedding", "status"])

    return of


def append(rows: DataFrame, batch: int, path: str, key: str) -> None:
    """Adds rows as a batch of their own; a replay writes the same folder again."""
    append_once(rows, batch, path, key)


def enrich_stream(spark: SparkSession, path: str, schema: str, key: str, text: str, out: str, checkpoint: str, embed: Callable[[Column], Column] = offline, **trigger: Any):  # noqa: ANN201
    """A started query that writes (key, embedding, status) to ``out`` for the rows appended at ``path``.

    Each batch has its folder, so a batch that runs again after a fault replaces what it had written.
    """
    def fill(batch: DataFrame, batch_id: int) -> None:
        v = batch.select(key, embed(F.col(text)).alias("v")).select(key, "v.embedding", "v.status")
        append_once(v, batch_id, out, key)

    rows = spark.readStream.schema(f"{schema}, seq bigint").option("recursiveFileLookup", True).parquet(path)
    return rows.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def vectors(spark: SparkSession, out: str, key: str, kind: str) -> DataFrame:
    """(key, embedding, status): the newest of each key.  Before anything is written there are none."""
    schema = f"{key} {kind}, " + ", ".join(f"{k} {v}" for k, v in VECTORS.items())
    if not path_exists(spark, out):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(f"{schema}, seq bigint, batch int").parquet(out).withColumn("op", F.lit("put"))
    return R.current(log, key, "seq", "op").select(key, *VECTORS)


def refreshed(spark: SparkSession, rows: DataFrame, out: str, key: str, stored: str) -> DataFrame:
    """``rows`` with the state that they show and whether it has changed (see ``promoted``), as their vectors are now.  A row without a vector yet stays pending."""
    found = vectors(spark, out, key, rows.schema[key].dataType.simpleString())
    fresh = found.select(key, embedding_status(F.size("embedding"), F.col("status")).alias("fresh"))
    return promoted(rows, fresh, key, stored, "fresh")


def write_back(spark: SparkSession, rows: DataFrame, out: str, states: str, batch: int, key: str, stored: str) -> None:
    """The states of ``rows`` that have changed, as a batch of the log at ``states``."""
    changed = refreshed(spark, rows, out, key, stored).where("changed").select(key, F.col("shown").alias("state"))
    append_once(changed, batch, states, key)


def with_states(spark: SparkSession, rows: DataFrame, states: str, key: str, stored: str) -> DataFrame:
    """``rows`` with the newest state written back, where there is one."""
    if not path_exists(spark, states):
        return rows
    log = spark.read.schema(f"{key} {rows.schema[key].dataType.simpleString()}, state string, seq bigint, batch int").parquet(states).withColumn("op", F.lit("put"))
    return R.patched(rows, R.current(log, key, "seq", "op").select(key, F.col("state").alias(stored)), key, [stored])
