"""Exact vector search and what is built on its hits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import confidence, filled, is_ascii, match_reason, strip
from ..sources.shared import discard, materialise, small_batches

THRESHOLD = 1.1
LIMIT = 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vector_search(index: DataFrame, query: list[float], k: int = LIMIT, where: Column | None = None, below: float = THRESHOLD, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The ``k`` nearest rows to a query vector, nearest first, then those below the threshold.

    The query is a literal, so the scan of the index computes distances and keeps k rows per task
    (TakeOrderedAndProject); nothing is shuffled but k rows a task.  ``where`` is applied before.
    """
    rows = index if where is None else index.where(where)
    q, length = F.array(*[F.lit(float(x)) for x in query]), math.sqrt(sum(float(x) ** 2 for x in query))
    near = rows.withColumn("distance", F.round(1 - dot(F.col(vector), q) / (F.sqrt(dot(F.col(vector), F.col(vector))) * F.lit(length)), 6))
    return near.drop(vector).orderBy("distance", key).limit(k).where(F.col("distance") < below)


def best_per_group(hits: DataFrame, group: str, key: str) -> DataFrame:
    """One row per group: its nearest hit, distance and number of hits, nearest group first."""
    best = hits.groupBy(group).agg(F.min(F.struct("distance", key)).alias("b"), F.count("*").alias("chunk_count"))
    return best.select(group, F.col(f"b.{key}").alias("best"), F.col("b.distance").alias("score"), "chunk_count").orderBy("score", group)


def fallback_curation(hits: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First hits with a confidence, for when no model curates them."""
    return hits.orderBy("distance", key).limit(n).select(key, F.round(confidence(F.col("distance")), 6).alias("confidence"))


#: Index rows and queries of one block, and parts of the index that each query is sent to.
INDEX_ROWS, QUERY_ROWS, PARTS = 4_096, 512, 16
TEXT_LIMIT = 500
NO_HITS = "No results found for your search query."


def packed(rows: DataFrame, key: str, vector: str, size: int, parts: int) -> DataFrame:
    """(part, keys, units): blocks of about ``size`` rows with their vectors at length 1 as one matrix, so norms are computed once.

    Null keys and vectors, zero and non-finite vectors can't be found and are left out.  Keys are integers.
    """
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = rows.where(F.col(key).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    slim = usable.select(F.col(key).cast("long").alias("key"), v.cast("array<double>").alias("v")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for part, g in b.groupby("part"):
                for width, same in g.groupby(g["v"].map(len)):
                    x = np.stack(same["v"])
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    keys = same["key"].to_numpy("<i8")
                    out += [(part, width, keys[k : k + size].tobytes(), unit[k : k + size].tobytes()) for k in range(0, len(keys), size)]
            yield pd.DataFrame(out, columns=["part", "width", "keys", "units"])

    return slim.repartition("part").mapInPandas(pack, "part int, width int, keys binary, units binary")


def best_of(distance: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances, ties by key."""
    at = np.arange(len(distance))
    if len(at) > k:
        at = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
    return at[np.lexsort((keys[at], distance[at]))[:k]]


def vector_search_many(
    index: DataFrame, queries: DataFrame, k: int = LIMIT, below: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "embedding", parts: int = PARTS,
) -> DataFrame:
    """(query, key, distance): the ``k`` nearest rows of the index to each query, then those below the threshold; as ``vector_search`` for each.

    Both sides are packed into blocks.  Each query block meets every block of the index: it is sent to each of ``parts`` parts of the
    index, which doesn't move again, and a pair of blocks is one matrix product.  A task keeps k rows for the query block that it has before it, as
    blocks of one part come in its order, and k rows of each query and part meet at the end.  Vectors of another
    length aren't compared.  Empty sides give nothing; of repeated keys each is a row.
    """
    spark = index.sparkSession
    # Blocks are written down, so that they are packed from large batches and paired in small ones.
    blocks = materialise(packed(index, key, vector, INDEX_ROWS, parts), "index-blocks")
    asked = materialise(packed(queries, query_key, query_vector, QUERY_ROWS, max(1, parts // 8)), "query-blocks")
    tables = blocks, asked
    asked = asked.select("width", F.col("keys").alias("qkeys"), F.col("units").alias("qunits"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = asked.join(blocks, ["part", "width"]).sortWithinPartitions("part", "width", "qkeys")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best = None, {}

        def done() -> pd.DataFrame:
            ids = np.frombuffer(now, "<i8") if now else np.empty(0, "<i8")
            rows = [(ids[q], x, d) for q, (ds, xs) in best.items() for d, x in zip(ds, xs, strict=True)]
            return pd.DataFrame(rows, columns=["query", "found", "distance"]).astype({"query": "int64", "found": "int64", "distance": "float64"})

        for b in batches:
            for width, qkeys, qunits, keys, units in zip(b["width"], b["qkeys"], b["qunits"], b["keys"], b["units"], strict=True):
                if qkeys != now:
                    yield done()
                    now, best = qkeys, {}
                ids = np.frombuffer(keys, "<i8")
                distances = np.round(1 - np.frombuffer(qunits).reshape(-1, width) @ np.frombuffer(units).reshape(-1, width).T, 6) + 0.0  # no negative zero
                for q, row in enumerate(distances):
                    at = best_of(row, ids, k)
                    d, x = row[at], ids[at]
                    if q in best:
                        d, x = np.append(best[q][0], d), np.append(best[q][1], x)
                        at = best_of(d, x, k)
                        d, x = d[at], x[at]
                    best[q] = d, x
        yield done()

    with small_batches(spark, 8):  # a row is two blocks, some MB
        local = materialise(pairs.mapInPandas(nearest, "query bigint, found bigint, distance double"), "nearest")
    discard(*tables)
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "found"))
    top = local.withColumn("__r", place).where((F.col("__r") <= k) & (F.col("distance") < below))
    return top.select(F.col("query").alias(query_key), F.col("found").alias(key), "distance")


def interpreted(queries: DataFrame, text: str, call: Callable[[pd.Series], pd.Series] | None = None, audio: str | None = None) -> DataFrame:
    """``queries`` with ``search_text``, and with ``interpreted_query`` where that differs from the stripped text.

    ASCII text without audio is used stripped, and no model sees it.  Others go to ``call`` (texts to English texts); an empty answer, a failing call or
    none at all leave the stripped text.  A query with neither text nor audio has no text to search for (null).
    """
    t, heard = F.col(f"`{text}`"), F.col(f"`{audio}`").isNotNull() if audio else F.lit(False)
    blank = F.coalesce(t, F.lit("")) == ""

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        some = texts[texts.notna()]
        out = pd.Series([None] * len(texts), index=texts.index, dtype="object")
        if call is not None and len(some):
            try:
                out[some.index] = call(some)
            except Exception:  # noqa: BLE001  an outside service may fail in any way
                pass
        return out

    simple = ~blank & ~heard & is_ascii(t)
    answer = filled(strip(ask(F.when(~simple & ~(blank & ~heard), F.coalesce(t, F.lit(""))))))
    found = queries.withColumn("search_text", F.when(simple, strip(t)).when(~(blank & ~heard), F.coalesce(answer, filled(strip(t)))))
    return found.withColumn("interpreted_query", F.when(F.col("search_text") != F.coalesce(strip(t), F.lit("")), F.col("search_text")))


def by_asset(hits: DataFrame, query: str, asset: str, key: str, fields: list[str]) -> DataFrame:
    """(query, asset, best hit's key and ``fields``, score, chunk_count): one row for each query and asset, of hits already cut by rank and threshold."""
    best = hits.groupBy(query, asset).agg(F.min_by(F.struct(key, *fields), F.struct("distance", key)).alias("b"), F.min("distance").alias("score"), F.count("*").alias("chunk_count"))
    return best.select(query, asset, "b.*", "score", "chunk_count")


def recommendations(hits: DataFrame, query: str, key: str, filename: str, path: str, n: int = 10) -> DataFrame:
    """(query, rank, asset's columns, recommendation_type, title, reason, confidence): a query's first hits, for when no model curates them."""
    first = hits.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("distance", key))).where(F.col("rank") <= n)
    return first.select(
        query, "rank", key, F.coalesce(filename, F.lit("")).alias("video_filename"), F.coalesce(path, F.lit("")).alias("gcs_path"), F.lit("full_video").alias("recommendation_type"),
        F.coalesce(filename, F.lit("Untitled")).alias("title"), match_reason(F.col("distance")).alias("reason"), F.round(confidence(F.col("distance")), 6).alias("confidence"),
    )


ANSWER = "response_text string, recommendations array<struct<video_id:string,title:string,reason:string,confidence:double>>"


def answered(queries: DataFrame, hits: DataFrame, query: str, text: str, key: str, filename: str, path: str, curate: Callable[[str, list[dict]], dict] | None = None) -> DataFrame:
    """(query, response_text, recommendations): each query's answer.

    Without hits the fixed sentence; with ``curate`` (the query's text and its hits, nearest first) its answer; where there is none or it
    fails, the hits' number and the first ten.  ``hits`` holds at most a search's limit for each query.
    """
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("distance", F.col(key).cast("string").alias("video_id"), F.col(filename).alias("filename"), F.col(path).alias("gcs_path")))), lambda h: h)
    grouped = hits.groupBy(query).agg(ranked.alias("hits"))
    rows = queries.select(query, text).join(grouped, query, "left").withColumn("n", F.coalesce(F.size("hits"), F.lit(0)))

    @F.pandas_udf(ANSWER)
    def ask(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for t, hs in zip(texts, found, strict=True):
            try:
                got = curate(t, [dict(h) for h in hs]) if curate is not None and hs is not None and len(hs) else None
                out.append((got["response_text"], got["recommendations"]) if got else (None, None))
            except Exception:  # noqa: BLE001  an outside service may fail in any way
                out.append((None, None))
        return pd.DataFrame(out, columns=["response_text", "recommendations"])

    first = F.transform(F.slice("hits", 1, 10), lambda h: F.struct(h["video_id"].alias("video_id"), F.coalesce(h["filename"], F.lit("Untitled")).alias("title"), match_reason(h["distance"]).alias("reason"), F.round(confidence(h["distance"]), 6).alias("confidence")))
    count = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(' result(s) matching "'), F.coalesce(text, F.lit("")), F.lit('". Showing raw results (AI curation unavailable).'))
    asked = rows.withColumn("a", ask(F.col(text), F.col("hits"))) if curate else rows.withColumn("a", F.lit(None).cast(f"struct<{ANSWER.replace(' string', ':string', 1).replace('recommendations array', 'recommendations:array')}>"))
    none = F.array().cast("array<struct<video_id:string,title:string,reason:string,confidence:double>>")
    hit, curated = F.col("n") > 0, F.col("a.response_text").isNotNull()
    return asked.select(
        query, F.when(~hit, NO_HITS).when(curated, F.col("a.response_text")).otherwise(count).alias("response_text"), F.when(~hit, none).when(curated, F.coalesce("a.recommendations", none)).otherwise(first).alias("recommendations"),
    )
