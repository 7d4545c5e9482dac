"""Object storage: metadata, contents and labelled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mime_of


def object_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, time and content type (by extension) of objects; their bytes aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("updated"), mime_of(F.col("path")).alias("content_type"))


def object_contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content", F.md5("content").alias("md5_hash"))


def existing(asked: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    return asked.join(listing, key, "left_semi")


def with_existence(asked: DataFrame, listing: DataFrame, out: str = "exists", key: str = "path") -> DataFrame:
    """``asked`` with ``out``: whether each object is there.  A null path isn't."""
    there = listing.select(key).distinct().withColumn("__there", F.lit(True))
    return asked.join(there, key, "left").withColumn(out, F.coalesce("__there", F.lit(False))).drop("__there")


def context_text(spark: SparkSession, items: DataFrame, path: str) -> DataFrame:
    """(job, context): a job's items in order, each under its label.  items: job, position, path, description, filename, context_id.

    The label is the description, else the file's name.  An item that is missing or isn't UTF-8 is skipped; a job of which none is left
    has the empty text.  A job's items are some few files, which its text holds whole.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    texts = read.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null")
    name = F.coalesce("filename", F.concat(F.lit("context_"), F.col("context_id").cast("string"), F.lit(".txt")))
    label = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.concat(F.lit("Context file: "), name))
    lines = items.join(texts, "path", "left").withColumn("part", F.concat(F.lit("=== "), label, F.lit(" ===\n"), "text"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("position", "part")))), lambda x: x["part"])
    return lines.groupBy("job").agg(F.array_join(parts, "\n\n").alias("context"))


def decoded_audio(c: Column) -> Column:
    """Bytes of base64 text; null if it isn't base64."""
    return F.try_to_binary(c, F.lit("base64"))
