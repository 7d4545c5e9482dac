"""Bringing results into the search index: a batch changes the index and the results' stored states, both or neither, and once however often it runs.

A batch first writes down what it is going to do (its intent), then its rows of two logs, each in a folder of its own, and at last that it
is done.  Readers see the rows of batches that are done.  A batch that runs again finds its intent and does the same again, so that
states which its first run changed don't change its decisions; one that is done does nothing.  Batches are numbered in order and
run one at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..sources.shared import path_exists
from . import relations as R

INDEX = {
    "result_id": "string", "video_id": "string", "video_filename": "string", "scene_job_id": "string", "chunk_index": "bigint", "text_content": "string", "timestamp_start": "string", "timestamp_end": "string",
    "result_data_json": "string", "gcs_path": "string",
}
STATES = {"result_id": "string", "bq_sync_status": "string", "bq_sync_error": "string"}
INTENT = ", ".join([*(f"{k} {v}" for k, v in INDEX.items()), "action string, error string, times bigint, was_in boolean"])
IN_INDEX = ("pending", "ready")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing a table there."""
    return path_exists(spark, f"{path}/_SUCCESS")


def in_folder(root: str, table: str, batch: int) -> str:
    return f"{root}/{table}/batch={batch}"


def read_log(spark: SparkSession, root: str, table: str, columns: dict[str, str]) -> DataFrame:
    """A log's rows of all batches that are done."""
    schema = ", ".join(f"{k} {v}" for k, v in {**columns, "op": "string"}.items()) + ", batch int"
    for t, kind in ((table, schema), ("done", "one int, batch int")):
        if not path_exists(spark, f"{root}/{t}"):
            return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{root}/{table}")
    return rows.join(spark.read.schema("one int, batch int").parquet(f"{root}/done").select("batch"), "batch", "left_semi")


def index_now(spark: SparkSession, root: str) -> DataFrame:
    """The index: one row for each result in it."""
    return R.current(read_log(spark, root, "index", INDEX), "result_id", "batch", "op").select(*INDEX)


def states_now(spark: SparkSession, root: str, results: DataFrame) -> DataFrame:
    """(result_id, bq_sync_status, bq_sync_error): of results that a batch has touched what it stored, of others what they came with."""
    stored = R.current(read_log(spark, root, "states", STATES), "result_id", "batch", "op").select(*STATES).alias("s")
    own = results.select("result_id", "bq_sync_status", "bq_sync_error").alias("r")
    touched = F.col("s.result_id").isNotNull()
    pick = lambda c: F.when(touched, F.col(f"s.{c}")).otherwise(F.col(f"r.{c}")).alias(c)
    return own.join(stored, F.col("r.result_id") == F.col("s.result_id"), "left").select("r.result_id", pick("bq_sync_status"), pick("bq_sync_error"))


def object_or_null(raw: Column, json: Column) -> Column:
    """Whether a text, whose value is ``json``, is a JSON object; a missing one counts as an empty object."""
    return raw.isNull() | F.coalesce(F.schema_of_variant(json).startswith("OBJECT"), F.lit(False))


def decided(asked: DataFrame, results: DataFrame, states: DataFrame, videos: DataFrame, resync: bool) -> DataFrame:
    """INTENT of a batch: for each distinct key asked for how often it was, what happens, and the index's row.

    A result whose state is pending or ready is in the index: it is skipped, or with ``resync`` its row goes and a fresh one comes.  What isn't among
    the results, or whose data is no JSON object, is an error; in the second case a row that was to be replaced has already gone.
    """
    times = asked.where("result_id is not null").groupBy("result_id").agg(F.count("*").alias("times"))
    one = results.drop("bq_sync_status", "bq_sync_error").dropDuplicates(["result_id"]).withColumn("found", F.lit(True))
    rows = times.join(one, "result_id", "left").join(states.dropDuplicates(["result_id"]).select("result_id", "bq_sync_status"), "result_id", "left")
    files = videos.dropDuplicates(["video_id"]).select(F.concat(F.lit("v"), "video_id").alias("of"), F.struct("filename", "gcs_path").alias("file"))
    rows = rows.withColumn("video_id", F.coalesce("video_id", F.lit("")))
    # Rows without a video have no file, and each a key of its own: with one key they would all be one task's, and so their texts.
    of = F.when(F.col("video_id") != "", F.concat(F.lit("v"), "video_id")).otherwise(F.concat(F.lit("r"), "result_id"))
    rows = rows.withColumn("of", of).join(files, "of", "left")
    rows = rows.withColumn("json", D.json_or_null(F.col("result_data")))  # columns of their own: named many times below
    was_in = F.coalesce(F.col("bq_sync_status").isin(*IN_INDEX), F.lit(False))
    action = F.when(F.col("found").isNull(), "not_found").when(was_in & ~F.lit(resync), "skip").when(~object_or_null(F.col("result_data"), F.col("json")), "failed").otherwise("put")
    error = F.when(F.col("action") == "not_found", F.concat(F.lit("Result "), F.col("result_id"), F.lit(" not found"))).when(F.col("action") == "failed", F.concat(F.lit("Result "), F.col("result_id"), F.lit(": result_data is no JSON object")))
    rows = rows.withColumn("was_in", was_in).withColumn("action", action).withColumn("error", error)
    raw, put = F.col("result_data"), F.col("action") == "put"
    rows = rows.withColumn("parsed", D.parse(F.when(put, raw), F.when(put, F.col("json"))))
    of_video = lambda c: F.when(F.col("video_id") != "", F.coalesce(F.col(f"file.{c}"), F.lit("")))
    nested = F.try_variant_get("json", "$.chunk_index", "bigint")
    built = {
        "video_filename": of_video("filename"), "gcs_path": of_video("gcs_path"), "chunk_index": F.coalesce("chunk_index", nested), "result_data_json": F.when(~F.coalesce(raw.rlike(r"^\s*\{\s*\}\s*$"), F.lit(True)), raw),
        "text_content": D.embedding_text(F.col("parsed"), F.when(put, raw)),
    }
    value = lambda c: F.when(put, built.get(c, F.col(c))).cast(INDEX[c]).alias(c) if c != "result_id" else F.col(c)
    return rows.select(*[value(c) for c in INDEX], "action", "error", "times", "was_in")


def commit(spark: SparkSession, root: str, batch: int, intent: Callable[[], DataFrame]) -> DataFrame:
    """INTENT of the batch, after it is done."""
    path = in_folder(root, "intent", batch)
    if not exists(spark, path):
        intent().write.mode("overwrite").parquet(path)
    rows = spark.read.schema(INTENT).parquet(path)
    if not exists(spark, in_folder(root, "done", batch)):
        gone = rows.where("action = 'delete' or action = 'failed' and was_in")
        index = rows.where("action = 'put'").select(*INDEX, F.lit("put").alias("op")).unionByName(gone.select(*INDEX, F.lit("delete").alias("op")))
        states = rows.where("action in ('put', 'failed', 'delete')").select("result_id", F.when(F.col("action") == "put", "pending").when(F.col("action") == "failed", "error").alias("bq_sync_status"), F.when(F.col("action") == "failed", F.col("error")).alias("bq_sync_error"), F.lit("put").alias("op"))
        index.write.mode("overwrite").parquet(in_folder(root, "index", batch))
        states.write.mode("overwrite").parquet(in_folder(root, "states", batch))
        spark.range(1).select(F.lit(1).alias("one")).coalesce(1).write.mode("overwrite").parquet(in_folder(root, "done", batch))
    return rows


def sync_batch(spark: SparkSession, root: str, batch: int, asked: DataFrame, results: DataFrame, videos: DataFrame, resync: bool = False) -> DataFrame:
    """INTENT after the asked results (result_id, repeats count) were brought into the index at ``root``.

    results: INDEX's own columns but text and file, result_data (JSON text), bq_sync_status, bq_sync_error; videos: video_id, filename, gcs_path.  Null
    ids asked for are ignored; of repeated results or videos one counts; an empty table of any kind is fine.  A key never has two rows in the index,
    also where a result in state error still has one.
    """
    return commit(spark, root, batch, lambda: decided(asked, results, states_now(spark, root, results), videos, resync))


def remove_batch(spark: SparkSession, root: str, batch: int, asked: DataFrame) -> DataFrame:
    """The asked results leave the index, and their states and errors are cleared."""
    def intent() -> DataFrame:
        keys = asked.where("result_id is not null").groupBy("result_id").agg(F.count("*").alias("times"))
        empty = [F.lit(None).cast(k).alias(c) for c, k in INDEX.items() if c != "result_id"]
        return keys.select("result_id", *empty, F.lit("delete").alias("action"), F.lit(None).cast("string").alias("error"), "times", F.lit(True).alias("was_in"))

    return commit(spark, root, batch, intent)


def report(outcome: DataFrame) -> DataFrame:
    """(synced_count, errors): each request counts, a skipped one as synced."""
    n = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("times"))), F.lit(0)).cast("long")
    return outcome.agg(n(F.col("error").isNull()).alias("synced_count"), n(F.col("error").isNotNull()).alias("errors"))


def errors(outcome: DataFrame) -> DataFrame:
    """A message for each request that failed."""
    return outcome.where("error is not null").select(F.explode(F.array_repeat("error", F.col("times").cast("int"))).alias("error"))
