"""Calls of models as steps of a query, with an offline stand-in for embeddings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip
from ..sources.shared import materialise

DIMENSIONS = 64


def enrich(df: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``call`` on each Arrow batch: rows in, rows of ``schema`` and an ``error`` out.

    A batch that fails is called again row by row, and a row that fails stays, with its input's columns of that schema and the error's text.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def tried(b: pd.DataFrame) -> pd.DataFrame:
        try:
            return call(b)[names].assign(error=None)
        except Exception as e:  # noqa: BLE001  an outside service may fail in any way
            if len(b) > 1:
                return pd.concat([tried(b.iloc[k : k + 1]) for k in range(len(b))])
            return pd.DataFrame({c: b[c].to_numpy() if c in b else [None] for c in names}).assign(error=str(e))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield tried(b.reset_index(drop=True))

    return df.mapInPandas(step, schema + ", error string")


def fanned_out(jobs: DataFrame, ratios: str, out: str) -> DataFrame:
    """One row for each requested ratio of a job; a job without any has none."""
    return jobs.withColumn(out, F.explode(ratios))


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A deterministic vector of unit length from a text's words: signed counts by hash; of a blank text all zeros."""
    words = F.filter(F.split(F.lower(strip(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: w != "")
    place = lambda h: F.pmod(h, F.lit(dimensions)).cast("int")
    sign = lambda h: F.when(h.bitwiseAND(F.lit(1 << 40)) == 0, 1).otherwise(-1)
    # In one pass: words sorted by place, and for each place the running sum of signs where it ends less that where it begins.
    marks = F.array_sort(F.concat(F.transform(words, lambda w: F.struct(place(F.xxhash64(w)).alias("p"), F.lit(0).alias("end"), sign(F.xxhash64(w)).alias("s"))), F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.struct(i.alias("p"), F.lit(1).alias("end"), F.lit(0).alias("s")))))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<double>").alias("out"))
    step = lambda a, m: F.when(m["end"] == 0, F.struct((a["sum"] + m["s"]).alias("sum"), a["out"].alias("out"))).otherwise(F.struct(F.lit(0).alias("sum"), F.array_append(a["out"], a["sum"].cast("double")).alias("out")))
    counts = F.aggregate(marks, start, step)["out"]
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scaled = F.transform(F.array(counts), lambda v: F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0])
    return scaled[0]


def needs_interpreting(query: Column) -> Column:
    """Only a query with other than ASCII characters goes to a model; the rest is used as it is, stripped."""
    return F.octet_length(query) != F.char_length(query)


#: Faults after which a call is worth another try.
PASSING = (TimeoutError, ConnectionError)
ATTEMPTS, DELAY, AT_ONCE = 3, 2.0, 10


def with_retries(call: Callable[..., Any], *args: Any, attempts: int = ATTEMPTS, delay: float = DELAY, passing: tuple[type[Exception], ...] = PASSING, wait: Callable[[float], None] = time.sleep) -> Any:
    """``call``'s answer; after a passing fault it is called again ``delay``, twice ``delay``, ... seconds later, any other goes through at once."""
    for k in range(attempts):
        try:
            return call(*args)
        except passing:
            if k == attempts - 1:
                raise
            wait(delay * 2**k)
    raise ValueError("at least one attempt is needed")


def digest_of(columns: list[str], version: str) -> Column:
    """What tells requests apart: their columns' values, nulls too, and the version of what answers them."""
    return F.sha2(F.concat(F.lit(version + "\n"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})), 256)


LOG = "digest string, answer string, attempts int"


def answers_in(spark: SparkSession, path: str) -> DataFrame:
    """The log's answer to each request; a log that isn't there yet is empty."""
    spark.createDataFrame([], LOG).write.mode("append").parquet(path)
    return spark.read.schema(LOG).parquet(path).groupBy("digest").agg(F.min_by("answer", F.struct("attempts", "answer")).alias("answer"))


def called(
    requests: DataFrame, columns: list[str], call: Callable[[dict[str, Any], str], str], log: str, version: str = "1", at_once: int = AT_ONCE, attempts: int = ATTEMPTS, delay: float = DELAY, passing: tuple[type[Exception], ...] = PASSING,
) -> DataFrame:
    """``requests`` with ``answer`` and ``error``: what an outside service says to the ``columns`` of each row.

    ``call`` gets a request and its digest, which is an idempotency key: a service that honours it does nothing twice even if a
    lost task is run again.  Answers go to the log at ``log`` by digest, and only what it lacks is called: equal rows of one job once, and rows that an
    earlier job has an answer for not at all.  A task's files join the log when the task is done, and only those of
    one attempt of it, so each request has one answer there.  Within a task ``at_once`` calls run side by side, each with its retries.

    A request that fails has a null answer and its error, isn't logged, and is called again by the next job.  Null columns are values;
    an empty table gives none, and columns named answer and error are replaced.
    """
    spark = requests.sparkSession
    keyed = requests.drop("answer", "error").withColumn("__digest", digest_of(columns, version))
    known = answers_in(spark, log)
    missing = keyed.select("__digest", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("request")).join(known.select(F.col("digest").alias("__digest")), "__digest", "left_anti")
    missing = missing.groupBy("__digest").agg(F.first("request").alias("request"))

    def one(request: dict[str, Any], digest: str) -> tuple[str | None, int, str | None]:
        tries = [0]

        def counted() -> str:
            tries[0] += 1
            return call(request, digest)

        try:
            return with_retries(counted, attempts=attempts, delay=delay, passing=passing), tries[0], None
        except Exception as e:  # noqa: BLE001  an outside service may fail in any way
            return None, tries[0], f"{type(e).__name__}: {e}"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:  # not by pandas, which has no whole numbers beside nulls
                digests = b.column(0).to_pylist()
                got = list(pool.map(one, b.column(1).to_pylist(), digests))
                schema = pa.schema([("digest", pa.string()), ("answer", pa.string()), ("attempts", pa.int32()), ("error", pa.string())])
                yield pa.RecordBatch.from_pylist([{"digest": d, "answer": a, "attempts": n, "error": e} for d, (a, n, e) in zip(digests, got, strict=True)], schema)

    fresh = materialise(missing.select("__digest", "request").mapInArrow(step, LOG + ", error string"), "calls")
    fresh.where("error is null").select("digest", "answer", "attempts").write.mode("append").parquet(log)
    told = answers_in(spark, log).withColumnRenamed("digest", "__digest").join(fresh.where("error is not null").select(F.col("digest").alias("__digest"), "error"), "__digest", "full_outer")
    return keyed.join(materialise(told, "answers"), "__digest", "left").drop("__digest")


def adapted(jobs: DataFrame, job: str, ratios: str, columns: list[str], call: Callable[[dict[str, Any], str], str], log: str, usage: Callable[[Column], tuple[Column, Column]], **how: Any) -> tuple[DataFrame, DataFrame]:
    """(results, jobs): an answer for each requested ratio of a job, and of each job what was used, how many answers and failures it has, and its status.

    ``usage`` gives an answer's input and output tokens.  A ratio asked for twice is one call and two results; a job without ratios has
    no results and is completed; one fails if none of its ratios has an answer.
    """
    asked = jobs.select(job, *columns, F.explode(F.coalesce(F.col(ratios), F.array())).alias("aspect_ratio"))
    results = materialise(called(asked, [*columns, "aspect_ratio"], call, log, **how), "adapts")
    spent = [F.coalesce(c, F.lit(0)) for c in usage(F.col("answer"))]
    sums = results.groupBy(job).agg(
        F.sum(F.when(F.col("error").isNull(), spent[0])).alias("input_tokens"), F.sum(F.when(F.col("error").isNull(), spent[1])).alias("output_tokens"), F.count_if(F.col("error").isNull()).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "answered", "failed")]
    done = jobs.select(job).join(sums, job, "left").select(job, *zero)
    return results, done.withColumn("status", F.when((F.col("answered") == 0) & (F.col("failed") > 0), "failed").otherwise("completed"))
