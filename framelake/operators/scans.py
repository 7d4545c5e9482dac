"""Scans in order within a key that no task has to hold: positions, running sums and counts within a window before each row.

A key with few rows is one window partition, as usual.  Rows of a hot key are dealt over chunks by range of (key, order), each
chunk is scanned by itself, and what the chunks before it add up to is carried in: one row for each key and chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise

#: A key with more rows is hot, or with more than a MOST_HOT-th of all: so at most MOST_HOT keys are, and they may be broadcast.
HOT_ROWS, MOST_HOT = 2_000_000, 1_000


def same(a: str, b: str, keys: list[str]) -> Column:
    """Equal keys; nulls are one key, as in a window's partition."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return out


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame, int]:
    """(hot keys, rows that they have).  Counts are combined before the exchange."""
    counts = materialise(rows.groupBy(*keys).agg(F.count("*").alias("__n")), "key-counts")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = counts.where(F.col("__n") > max(hot_rows, total // MOST_HOT))
    n = hot.agg(F.sum("__n")).first()[0] or 0
    if not n:
        discard(counts)
    return hot, n


def split(rows: DataFrame, keys: list[str], hot_rows: int | None, plain: Callable[[DataFrame], DataFrame], dealt: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``plain`` over the rows of most keys, and ``dealt`` (rows, chunks) over those of hot ones."""
    most = hot_rows or HOT_ROWS
    hot, n = hot_keys(rows, keys, most)
    if not n:
        return plain(rows)
    hot = F.broadcast(hot.select(*keys))  # at most MOST_HOT keys
    calm = rows.alias("r").join(hot.alias("h"), same("r", "h", keys), "left_anti")
    crowded = rows.alias("r").join(hot.alias("h"), same("r", "h", keys), "left_semi")
    return plain(calm).unionByName(dealt(crowded, -(-n // most) + 1))


def in_chunks(rows: DataFrame, keys: list[str], order: list[str], chunks: int) -> DataFrame:
    """``rows`` with their chunk ``__c``: a range of (keys, order), so rows that are equal there lie in one."""
    # Ranges come from a sample, so they are written down once.
    return materialise(rows.repartitionByRange(chunks, *keys, *order).withColumn("__c", F.spark_partition_id()), "chunks")


def carried(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``rows`` of ``in_chunks`` with ``__before``: the sum of ``value`` over the key's earlier chunks."""
    sums = rows.groupBy(*keys, "__c").agg(F.sum(value).alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(earlier), F.lit(0))).drop("__s")
    named = [F.col(f"r.`{c}`") for c in rows.columns]
    return rows.alias("r").join(before.alias("b"), same("r", "b", [*keys, "__c"])).select(*named, F.col("b.__before"))


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, hot_rows: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the sum of the whole numbers ``value`` over the key's rows up to each in ``order``, which should tell rows apart.

    Rows that are equal in keys and order get places among them in any order.  An empty table stays empty.
    """
    def local(by: list[str]) -> Column:
        return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    def dealt(hot: DataFrame, chunks: int) -> DataFrame:
        summed = carried(in_chunks(hot, keys, order, chunks), keys, value)
        return summed.withColumn(out, local([*keys, "__c"]) + F.col("__before")).drop("__c", "__before")

    return split(rows, keys, hot_rows, lambda r: r.withColumn(out, local(keys)), dealt)


def positions(rows: DataFrame, keys: list[str], order: list[str], out: str, hot_rows: int | None = None) -> DataFrame:
    """``rows`` with ``out``: their place within their key, from 0."""
    return running(rows, keys, order, F.lit(1).cast("long"), out, hot_rows).withColumn(out, F.col(out) - 1)


def trailing(rows: DataFrame, keys: list[str], at: str, width: int, out: str, order: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """``rows`` with ``out``: how many of the key's rows have a time from ``width`` before each row's up to it; ``at`` is a whole number.

    Rows of the same time count for each other; with ``order``, only those up to the row in (at, order) do.
    A row without a time has the rows without a time in its window, and no others.
    For a hot key, each row asks for two numbers of rows: up to its own time, and before its window; each is a running count at a mark
    that lies in its time's chunk, and the two meet again by the row's number.
    """
    first = Window.partitionBy(*keys).orderBy(at)

    def plain(r: DataFrame) -> DataFrame:
        if order is None:
            return r.withColumn(out, F.count("*").over(first.rangeBetween(-width, 0)))
        before = F.when(F.col(at).isNotNull(), F.count("*").over(first.rangeBetween(Window.unboundedPreceding, -width - 1))).otherwise(0)
        return r.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(at, *order)) - before)

    def dealt(hot: DataFrame, chunks: int) -> DataFrame:
        hot = materialise(hot.withColumn("__id", F.monotonically_increasing_id()), "numbered")
        names = [F.col(f"`{k}`") for k in keys]
        # Marks: 1 a row itself, in order; 0 the end of a window.  A row without a time stands before all others, and nothing before it.
        own = hot.select(*names, F.col(at).alias("__t"), F.lit(0).alias("__kind"), *[F.col(f"`{c}`") for c in order or []], "__id", F.lit(1).alias("__one"))
        low = hot.where(F.col(at).isNotNull()).select(*names, (F.col(at) - width - 1).alias("__t"), F.lit(1).alias("__kind"), *[F.lit(None).cast(hot.schema[c].dataType).alias(c) for c in order or []], "__id", F.lit(0).alias("__one"))
        by = ["__t"] if order is None else ["__t", "__kind", *order]
        marks = carried(in_chunks(own.unionByName(low), keys, by, 2 * chunks), keys, F.col("__one"))
        frame = Window.partitionBy(*keys, "__c").orderBy(*by)
        up_to = F.sum("__one").over(frame.rangeBetween(Window.unboundedPreceding, 0) if order is None else frame.rowsBetween(Window.unboundedPreceding, 0))
        marks = marks.select("__id", F.when(F.col("__kind") == 0, 1).otherwise(-1).alias("__sign"), (up_to + F.col("__before")).alias("__n"))
        counts = marks.groupBy("__id").agg(F.sum(F.col("__sign") * F.col("__n")).alias(out))
        return hot.join(counts, "__id").drop("__id")

    return split(rows, keys, hot_rows, plain, dealt)
