"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup
from .common import discard, materialise, new_path, path_exists, table, text_or_empty

CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; a cache that isn't there yet is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    cache = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version)
    return cache.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))  # a replayed append is harmless


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
    normalise: Callable | None = None,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    Digests of the (normalised) content and of the tokenizer's version are looked up in the
    cache at ``cache_path``.  First only digests meet it.  Then the texts of those that it lacks are picked where they lie, by a filter that
    is broadcast and never larger than a bound, and each distinct one is encoded; its count is
    appended.  So a full cache moves no text at all.  ``normalise`` maps a text column to the form that is counted
    and must be the identity where equal counts aren't certain; the default changes nothing.
    Copies of a text meet already on the map side (a partial aggregate), so a hot text moves once
    per task.  Null texts count as empty (0 tokens); null ids and repeated rows each keep their row;
    an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    version = bpe.tokenizer_version(tokenizer_path)
    text = text_or_empty(text_col)
    text = normalise(text) if normalise else text
    keyed = docs.select(F.col(id_col).alias(id_col), text.alias("__text")).select(
        id_col, "__text", F.unhex(F.sha2(F.col("__text"), 256)).alias("digest"), F.octet_length("__text").cast("long").alias("n_bytes")
    )
    missing = keyed.select("digest").distinct().join(read_cache(spark, cache_path, version), "digest", "left_anti")
    missing = materialise(missing, "missing")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = bpe.codec(tokenizer_path)
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "version": version, "n_tokens": [len(codec.encode(t)) for t in b["text"]]})

    if not missing.isEmpty():
        likely = exact_dedup.possibly_in(keyed.select("digest", "__text"), missing, "digest", "__in").where("__in")
        misses = likely.join(missing, "digest", "left_semi").groupBy("digest").agg(F.first("__text").alias("text"))
        misses.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    discard(missing)
    counts = materialise(read_cache(spark, cache_path, version), "counts")  # so that both sides of the join are plain exchanges, and a hot digest can be split
    return keyed.select(id_col, "digest", "n_bytes").join(counts, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str, cache_path: str | None = None) -> DataFrame:
    """A job keeps its ``cache_path``; without one the cache starts empty."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache_path or new_path(spark, "token-cache"))
