"""Exact deduplication by two passes over Bloom bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, new_path, table, text_or_empty

BITS_PER_ROW = 16
HASHES = 2
#: A filter is broadcast and never larger than this.  More rows are dealt into ranges of their digests, each with a filter of its own.
MAX_FILTER_BYTES = 64 << 20
WORD = 32768  # bits of one value of bitmap_construct_agg


def bitmap(places: DataFrame) -> DataFrame:
    """(bucket, bits) of the distinct values of ``p``, from 0."""
    return places.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bits"))


def with_bit(df: DataFrame, bits: DataFrame, p: Column, out: str) -> DataFrame:
    """Adds ``out``: whether the bitmap, which is broadcast, has bit p."""
    words = F.broadcast(bits.select(F.col("bucket").alias("__b"), F.col("bits").alias("__w")))
    df = df.withColumn("__p", p).join(words, F.expr("bitmap_bucket_number(__p + 1)") == F.col("__b"), "left")
    test = F.expr(f"coalesce(cast(conv(hex(substring(__w, cast(__p % {WORD} div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(__p % 8 as int)), 0) != 0")
    return df.withColumn(out, test).drop("__p", "__b", "__w")


def possibly_in(df: DataFrame, keys: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: false only for rows whose ``key`` is surely not among ``keys``.  At most MAX_FILTER_BYTES are broadcast."""
    size = max(WORD, min(MAX_FILTER_BYTES * 8, keys.count() * BITS_PER_ROW))
    place = F.pmod(F.xxhash64(key, F.lit("in")), F.lit(size))
    return with_bit(df, bitmap(keys.select(place.alias("p"))), place, out)


def positions(digest: Column, bits: int) -> list[Column]:
    """Bloom positions; hash i has a segment of its own, so segments never mix."""
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(bits)) + F.lit(i * bits) for i in range(HASHES)]


def ranges_of(rows: int, most: int) -> tuple[int, int]:
    """(ranges, bits of each hash's segment of one range's filter)."""
    ranges = max(1, -(-rows * BITS_PER_ROW // (most * 8)))
    return ranges, max(1, -(-(-(-rows // ranges)) * BITS_PER_ROW // WORD) // HASHES) * WORD


def repeated_bits(digests: DataFrame, bits: int) -> DataFrame:
    """First pass: the Bloom bits that at least two rows set, as bitmaps (bucket, bits).

    Counts of positions are combined on the map side, so a hash shared by a third of all rows
    moves once per task.  Only 8-byte positions move, never rows.
    """
    at = digests.select(F.explode(F.array(*positions(F.col("digest"), bits))).alias("p"))
    return bitmap(at.groupBy("p").agg(F.count("*").alias("n")).where("n > 1"))


def possibly_repeated(df: DataFrame, filter_: DataFrame, bits: int) -> DataFrame:
    """Second pass: adds ``__maybe``, true only if every Bloom bit of ``digest`` is set twice."""
    for i, p in enumerate(positions(F.col("digest"), bits)):
        df = with_bit(df, filter_, p, f"__t{i}")
    names = [f"__t{i}" for i in range(HASHES)]
    return df.withColumn("__maybe", F.expr(" and ".join(names))).drop(*names)


def marked_rows(rows: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """``rows`` (with ``digest``) and ``__maybe``, after both passes over each range of digests in turn.

    Up to ``most`` bytes of filter (some 33 million rows) there is one range and rows stream through.  Beyond, rows are
    written once by range, without an exchange, and each range is marked with its own filter, so that
    a filter has as many bits for a row at any size; ranges take turns, as each broadcasts one.
    """
    ranges, bits = ranges_of(n, most or MAX_FILTER_BYTES)
    if ranges == 1:
        return possibly_repeated(rows, materialise(repeated_bits(rows, bits), "bloom"), bits)
    spark = rows.sparkSession
    dealt, done = new_path(spark, "by-range"), new_path(spark, "marked")
    rows.withColumn("__range", F.pmod(F.xxhash64("digest", F.lit("range")), F.lit(ranges)).cast("int")).write.partitionBy("__range").parquet(dealt)
    schema = rows.withColumn("__range", F.lit(0)).schema
    for r in range(ranges):
        part = spark.read.schema(schema).parquet(dealt).where(F.col("__range") == r).drop("__range")
        filter_ = materialise(repeated_bits(part, bits), "bloom")
        possibly_repeated(part, filter_, bits).write.mode("append").parquet(done)
        discard(filter_)
    return spark.read.parquet(done)


def digest_of(text_col: str) -> Column:
    return F.sha2(text_or_empty(text_col), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts the largest id stays
    (null ids are smallest); of repeated rows with the same id and text exactly one is ``kept``.
    An empty table gives no rows; other columns are ignored.

    Digests are written once; rows whose Bloom bits nobody else sets go straight to the result and
    only the possibly repeated ones shuffle.  Their groups are aggregated with map-side combination
    and written, so that the join back is between two plain exchanges, which adaptive execution
    splits when a group is hot.
    """
    digests = materialise(docs.select(F.col(id_col).alias("id"), F.unhex(digest_of(text_col)).alias("digest"), F.monotonically_increasing_id().alias("tie")), "digests")
    marked = marked_rows(digests, digests.count(), most)
    maybe = marked.where("__maybe")
    groups = materialise(maybe.groupBy("digest").agg(F.max(F.struct("id", "tie")).alias("keep"), F.count("*").alias("group_size")), "groups")
    alone = marked.where("not __maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    together = maybe.join(groups, "digest").select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("tie") == F.col("keep.tie")).alias("kept"), "digest")
    return alone.unionByName(together).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts one with the largest id.

    Null texts count as empty and null ids as smallest; of repeated rows one stays, and of rows of one id and text
    that differ elsewhere the one with the largest digest of the whole row.  An empty table stays empty.
    Rows pass straight through unless their digest may be repeated; those meet in one aggregate
    that carries the row, combined on the map side.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.unhex(digest_of(f"`{text_col}`")).alias("digest"))
    marked = marked_rows(rows, docs.count(), most)
    order = F.struct(F.col(f"__row.`{id_col}`"), F.sha2(F.to_json("__row"), 256))
    firsts = marked.where("__maybe").groupBy("digest").agg(F.max_by("__row", order).alias("__row"))
    return marked.where("not __maybe").select("__row").unionByName(firsts.select("__row")).select("__row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
