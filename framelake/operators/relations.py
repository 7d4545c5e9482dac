"""Lookups, counts, roll-ups and current state over append logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DatetimeType, FractionalType

from ..functions.scalars import cutoff


def lookup(df: DataFrame, key: str, value) -> DataFrame:  # noqa: ANN001
    """The row of a key, or none.  The filter reaches the scan; no other file or row group is read whose bounds exclude it."""
    return df.where(F.col(key) == value).limit(1)


def key_set(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def with_all(df: DataFrame, terms: dict[str, object | None]) -> DataFrame:
    """Rows equal to every term that is given; a null term asks for nothing."""
    for column, value in terms.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def recent(df: DataFrame, terms: dict[str, object | None], at: str, now: Column, minutes: int) -> DataFrame:
    """Rows equal to every term that is given, of the last ``minutes`` before ``now``; one exactly so old counts.  The filters reach the scan."""
    return with_all(df, terms).where(F.col(at) >= cutoff(now, minutes))


def among(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows whose key is one of a short list; of an empty list none, without a scan."""
    return df.where(F.col(key).isin(values)) if values else df.limit(0)


def newest(df: DataFrame, at: str, key: str, n: int | None = 50, where: Column | None = None) -> DataFrame:
    """Newest first, n or all; rows without a time are left out."""
    df = df if where is None else df.where(where)
    df = df.where(F.col(at).isNotNull()).orderBy(F.col(at).desc(), key)
    return df if n is None else df.limit(n)


def limit_then_sort(df: DataFrame, where: Column, key: str, at: str, n: int) -> DataFrame:
    """The first n by key, and only then in order of time: not the n oldest."""
    return df.where(where).orderBy(key).limit(n).orderBy(F.coalesce(at, F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz")), key)


def oldest(df: DataFrame, where: Column, key: str, at: str, n: int) -> DataFrame:
    return df.where(where).orderBy(at, key).limit(n)


def nest(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children's list in order of ``fields``; none is an empty list.  Children combine before they join."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array()))


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def unreferenced(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children, key, "left_anti")


def roll_up(rows: DataFrame, job: str, tokens: Column, cost: Column, reason: Column, order: list[str]) -> DataFrame:
    """Per job: tokens, cost rounded once, and the last reason that isn't missing in the order given.  Leave error rows out before."""
    return rows.groupBy(job).agg(
        F.sum(F.coalesce(tokens, F.lit(0))).alias("total_tokens"), F.round(F.sum(F.coalesce(cost, F.lit(0)).cast("decimal(30,8)")), 6).cast("double").alias("total_cost"),
        F.coalesce(F.max_by(reason, F.when(reason.isNotNull(), F.struct(*order))), F.lit("completed")).alias("stop_reason"),
    )


def newest_of(log: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """The newest row of each key of an append log, deletions too.

    Tasks keep one row of each key before rows move.  ``seq`` is a number or a time, and null before all others.  Of different rows of one place in
    the order the smaller op and then the smaller row counts.
    """
    at, kind = F.col(f"`{seq}`"), log.schema[seq].dataType
    at = F.unix_micros(at.cast("timestamp")) if isinstance(kind, DatetimeType) else at
    backwards = -at if isinstance(kind, FractionalType) else F.bitwise_not(at)  # which no whole number overflows
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    order = F.struct(at.isNull(), backwards, F.col(f"`{op}`"), F.to_json(row))
    return log.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.min_by(row, order).alias("__row")).select("__row.*")


def current(log: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """Latest row per key of an append log; a deleted key has none.  Replayed rows change nothing."""
    return newest_of(log, key, seq, op).where(F.col(op) != "delete")


def patched(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Patch columns that are null leave the base's value."""
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return base.join(p, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def merged(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """As ``patched``, and keys that only the patch has appear."""
    b, p = base.select(key, *columns).alias("b"), patch.select(key, *columns).alias("p")
    return b.join(p, F.col(f"b.{key}") == F.col(f"p.{key}"), "full_outer").select(F.coalesce(f"b.{key}", f"p.{key}").alias(key), *[F.coalesce(f"p.{c}", f"b.{c}").alias(c) for c in columns])


def merged_maps(old: Column, new: Column) -> Column:
    """Shallow merge of maps, the new one wins; needs no session setting."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(new, F.create_map().cast("map<string,string>")))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}


def analysis_deleted(manifests: DataFrame, chunks: DataFrame, tables: dict[str, DataFrame], gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(paths of objects to delete, rows deleted per table) when the analyses of some assets go; the assets themselves stay.

    A manifest names a compressed copy and audio, where it has them; chunks have a path each.
    """
    own = manifests.join(gone, key, "left_semi").select(F.explode(F.array("compressed_path", "audio_path")).alias("path"))
    blobs = own.unionByName(chunks.join(gone, key, "left_semi").select("path")).where("path is not null")
    counts = [t.join(gone, key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, t in tables.items()]
    return blobs, reduce(DataFrame.unionByName, counts)


def moved_to(rows: DataFrame, asked: Column, status: str, only: str, to: str) -> DataFrame:
    """Rows that are asked for get a new status, if they have the one that it may follow."""
    return rows.withColumn(status, F.when(asked & (F.col(status) == only), to).otherwise(F.col(status)))


def guarded_delete(rows: DataFrame, asked: DataFrame, users: DataFrame, key: str, busy: Column | None = None) -> DataFrame:
    """Rows that remain: those asked for go unless something refers to them or they are busy."""
    goes = asked.join(users, key, "left_anti")
    if busy is not None:
        goes = goes.join(rows.where(busy), key, "left_anti")
    return rows.join(goes, key, "left_anti")


def appended(log: DataFrame, rows: DataFrame, id_col: str, of: list[str]) -> DataFrame:
    """``log`` and ``rows`` with an id made from some of their columns, so that a replay makes the same one; ids already there are left out."""
    made = rows.withColumn(id_col, F.substring(F.sha2(F.to_json(F.struct(*of), {"ignoreNullFields": "false"}), 256), 1, 20)).dropDuplicates([id_col])
    return log.unionByName(made.join(log, id_col, "left_anti"), allowMissingColumns=True)


def without_keys(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key).distinct(), key, "left_anti")


def without_fields(rows: DataFrame, keys: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The fields of the given keys' rows are removed (null), as when a result leaves the index."""
    gone = rows.join(keys.select(key).distinct().withColumn("__gone", F.lit(True)), key, "left")
    return gone.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def seeded(rows: DataFrame, defaults: DataFrame, kind: str) -> DataFrame:
    """Defaults join in for each kind that has no row yet."""
    return rows.unionByName(defaults.join(rows, kind, "left_anti"), allowMissingColumns=True)


def patches_with_a_value(patches: DataFrame, columns: list[str]) -> DataFrame:
    """Patches that change something; one with nothing but nulls is refused."""
    return patches.dropna("all", subset=columns)


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in rows.columns])


def progress(rows: DataFrame, key: str, done: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count_if(done).alias("completed"), F.count("*").alias("total"))


def classify_sync(asked: DataFrame, results: DataFrame, indexed: DataFrame, key: str, resync: bool = False) -> DataFrame:
    """Per requested key: insert, replace, skip or not_found."""
    r, i = results.select(key).distinct().withColumn("__r", F.lit(True)), indexed.select(key).distinct().withColumn("__i", F.lit(True))
    known = F.when(F.lit(resync), "replace").otherwise("skip")
    return asked.distinct().join(r, key, "left").join(i, key, "left").select(key, F.when(F.col("__r").isNull(), "not_found").when(F.col("__i").isNotNull(), known).otherwise("insert").alias("action"))


def synced(index: DataFrame, results: DataFrame, asked: DataFrame, key: str, state: str, resync: bool = False) -> tuple[DataFrame, DataFrame]:
    """(index afterwards, outcome per asked key) of bringing results into the index.

    A result whose ``state`` is pending or ready is in it: it's skipped, and with ``resync`` replaced.  Others are
    inserted; what ``results`` lacks is an error.  Rows of the index under a replaced key go first, so a key never has two.
    """
    known = asked.select(key).distinct().join(results, key, "left").withColumn("__in", F.col(state).isin("pending", "ready"))
    action = F.when(F.col("__found").isNull(), "not_found").when(F.coalesce("__in", F.lit(False)), "replace" if resync else "skip").otherwise("insert")
    found = results.select(key).distinct().withColumn("__found", F.lit(True))
    rated = known.join(found, key, "left").withColumn("action", action).drop("__in", "__found")
    new = rated.where(F.col("action").isin("insert", "replace")).select(*index.columns)
    after = without_keys(index, rated.where(F.col("action") == "replace"), key).unionByName(new)
    return after, rated.select(key, "action", F.when(F.col("action") == "not_found", F.concat(F.lit("Result "), F.col(key).cast("string"), F.lit(" not found"))).alias("error"))


def sync_report(outcome: DataFrame) -> DataFrame:
    """Counts as the caller is told them: skipped results count as synced."""
    return outcome.agg(F.count_if(F.col("action") != "not_found").alias("synced_count"), F.count_if(F.col("action") == "not_found").alias("errors"))
