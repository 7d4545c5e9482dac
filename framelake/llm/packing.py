"""Packing by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialise, table, text_or_empty

SEQUENCE = 2048
END = 1  # the id after each document
#: Pieces of one length that one task ranks, about.
BUCKET_ROWS = 20_000
PIECE_SCHEMA = "id string, h bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of lengths, how often) that use every length exactly as often as ``counts`` has it.

    Longest lengths first.  Each goes to the shortest pack that it still fits, whole batches of equal
    packs at a time; a batch that isn't used up splits.  Work depends on ``size``, not on the number of documents.
    """
    done: list[tuple[tuple[int, ...], int]] = []
    batches: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    shortest: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        if (total := sum(pattern)) == size:
            done.append((pattern, n))
            return
        if not batches.setdefault(total, []):
            heapq.heappush(shortest, total)
        batches[total].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left, new = counts[length], []
        while left:
            while shortest and not batches.get(shortest[0]):
                heapq.heappop(shortest)
            if not shortest or shortest[0] + length > size:
                new.append(((length,), left))
                left = 0
                break
            pattern, n = batches[shortest[0]].pop()
            if n > left:
                batches[shortest[0]].append((pattern, n - left))
            used = min(n, left)
            left -= used
            put((*pattern, length), used)
            if not left:
                break
        for pattern, n in new:
            # Packs of this length alone: as many in each as fit, the rest in one shorter pack.
            each = size // length
            if n // each:
                put((length,) * each, n // each)
            if n % each:
                put((length,) * (n % each), 1)
    return done + [b for batch in batches.values() for b in batch]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each length, by rank: first rank of each slot, its pattern's first sequence, offset there and the pattern's total."""
    by: dict[int, list[list[int]]] = {}
    first = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows = by.setdefault(length, [])
            rows.append([rows[-1][0] + rows[-1][4] if rows else 0, first, offset, sum(pattern), n])
            offset += length
        first += n
    return {k: tuple(np.array(v, dtype=np.int64).T[:4]) for k, v in by.items()}, first


def marked_words(text: Column) -> Column:
    """Lower case, each word of the vocabulary's split followed by its end mark; null where only the library itself will do."""
    return F.when(text.rlike(bpe.SAFE_WORDS) & ~text.contains("<|"), F.regexp_replace(F.lower(text), bpe.JAVA_WORDS, "$0" + bpe.WORD_END))


def token_ids(codec: bpe.Codec, marked: str | None, text: str | None) -> np.ndarray:
    ids = codec.encode(text) if marked is None else codec.encode_marked(marked)
    return np.append(ids, np.uint32(END)).astype("<u4")


def readable(rows: DataFrame, fast: bool) -> DataFrame:
    """(id, h, marked, text): text only where marked is null."""
    marked = marked_words(F.col("text")) if fast else F.lit(None).cast("string")
    return rows.withColumn("marked", marked).select("id", "h", "marked", F.when(F.col("marked").isNull(), F.col("text")).alias("text"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, recut_below: float = 0.9) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids (no special tokens added) and the end id.  It is cut every ``size`` ids; the
    histogram of the pieces' lengths, at most ``size`` numbers, is packed on the driver, and patterns are
    joined back to pieces by each piece's rank within its length.  Ranks come from counts by bucket and
    length, so a length that a third of all pieces share is ranked by many tasks.
    Packs filled below ``recut_below`` are cut at powers of two, which need no padding; only their few
    documents are encoded again, for the new pieces' checksums.
    Null texts count as empty (the end id alone); null ids and repeated rows are packed like any other;
    an empty table gives no rows; other columns are ignored.  An id column named as one of the result's columns comes out as ``id``.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    # Ids travel as text: pandas has no whole numbers beside nulls.
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), text_or_empty(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("text"))
    fast = bpe.codec(tokenizer_path).kind == "words"
    schema = PIECE_SCHEMA

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = bpe.codec(tokenizer_path)
        for b in batches:
            out = []
            for i, h, marked, text in zip(b["id"], b["h"], b["marked"], b["text"], strict=True):
                ids = token_ids(codec, marked, text)
                out += [(i, h, a, len(p := ids[a : a + size]), crc(p), len(ids)) for a in range(0, len(ids), size)]
            yield pd.DataFrame(out, columns=["id", "h", "start", "length", "ids_crc32", "doc_tokens"])

    pieces = materialise(readable(rows, fast).mapInPandas(cut, schema).withColumn("tie", F.monotonically_increasing_id()), "pieces")
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    plan, sequences = slots(pack_histogram(histogram, size))
    plan_on_workers = spark.sparkContext.broadcast(plan)  # bounded by the patterns of ``size`` lengths

    buckets = max(16, -(-sum(histogram.values()) // BUCKET_ROWS))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("tie"), F.lit(buckets)).cast("int"))  # by row, so that repeated rows spread
    counts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    local = spread.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("tie")))
    ranked = local.join(before, ["length", "bucket"]).withColumn("rank", F.col("r") - 1 + F.coalesce("before", F.lit(0)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = np.empty((len(b), 3), dtype=np.int64)
            for length, at in b.groupby("length").indices.items():
                first_rank, first_sequence, offset, total = plan_on_workers.value[int(length)]
                rank = b["rank"].to_numpy()[at]
                k = np.searchsorted(first_rank, rank, side="right") - 1
                got[at] = np.stack([first_sequence[k] + rank - first_rank[k], offset[k], total[k]], axis=1)
            yield b.drop(columns="rank").assign(sequence_id=got[:, 0], offset=got[:, 1], total=got[:, 2])

    placed = ranked.select("id", "h", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInPandas(place, schema + ", sequence_id bigint, `offset` bigint, total bigint")
    placed = materialise(placed, "placed")
    power = F.expr("total & (total - 1)") == 0
    poor = ~power & (F.col("total") < F.lit(size * recut_below))
    whole = placed.where(~poor).drop("h", "total")

    # A poor pack of total T holds one sequence for each binary digit of T, largest first.
    digits = F.expr("filter(sequence(62, 0), k -> shiftright(total, k) & 1 = 1)")
    begin = F.expr("cast(shiftleft(shiftright(total, k + 1), k + 1) as bigint)")
    segments = placed.where(poor).withColumn("k", F.explode(digits)).withColumn("seg", begin).withColumn("seg_end", F.expr("seg + shiftleft(1L, k)"))
    low, high = F.greatest("offset", "seg"), F.least(F.col("offset") + F.col("length"), F.col("seg_end"))
    cut_rows = materialise(
        segments.where(low < high).select(
            "id", "h", (F.col("start") + low - F.col("offset")).alias("start"), (high - low).alias("length"), "doc_tokens",
            (F.lit(sequences) + F.col("sequence_id") * 64 + F.col("k")).alias("sequence_id"), (low - F.col("seg")).alias("offset"),
        ), "recut",
    )
    wanted = materialise(cut_rows.groupBy("id", "h").agg(F.collect_set(F.struct("start", "length")).alias("ranges")), "wanted")
    again = rows.alias("d").join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.h") == F.col("w.h")))
    again = readable(again.select("d.id", "d.h", "text").dropDuplicates(["id", "h"]), fast).alias("d").join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.h") == F.col("w.h"))).select("d.id", "d.h", "marked", "text", "ranges")

    def checksums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = bpe.codec(tokenizer_path)
        for b in batches:
            out = []
            for i, h, marked, text, ranges in zip(b["id"], b["h"], b["marked"], b["text"], b["ranges"], strict=True):
                ids = token_ids(codec, marked, text)
                out += [(i, h, r["start"], r["length"], crc(ids[r["start"] : r["start"] + r["length"]])) for r in ranges]
            yield pd.DataFrame(out, columns=["id", "h", "start", "length", "ids_crc32"])

    sums = again.mapInPandas(checksums, "id string, h bigint, start bigint, length bigint, ids_crc32 bigint")
    same = F.col("c.id").eqNullSafe(F.col("s.id")) & (F.col("c.h") == F.col("s.h")) & (F.col("c.start") == F.col("s.start")) & (F.col("c.length") == F.col("s.length"))
    recut = cut_rows.alias("c").join(sums.alias("s"), same).select("c.id", "c.start", "c.length", "s.ids_crc32", "c.doc_tokens", "c.sequence_id", "c.offset")
    out = whole.unionByName(recut)
    return out.select(F.col("id").cast(id_type).alias("id" if id_col in out.columns else id_col), *[c for c in out.columns if c != "id"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
