"""Fixed-length segments of long assets, and their export."""

from __future__ import annotations

import decimal
import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from ..functions.scalars import chunk_name
from . import scans

HIDDEN = ("gemini_file_uri", "chunk_metadata", "blocked")
ARRAY_LIMIT, SAMPLE, INDEXED, MAX_DEPTH = 50, 3, 10, 10
#: Lists of a document whose items have times, and these.
TIMED, TIMES = ("scenes", "events", "moments", "highlights"), ("timestamp", "start_time", "end_time")


def chunk_array(total: Column, length: Column, on: Column | None = None) -> Column:
    """Segments [start, end) of ``length`` that cover ``total``; one segment if chunking is off or either is unknown or not positive."""
    on = F.lit(True) if on is None else F.coalesce(on, F.lit(False))
    last = F.ceil(total / length).cast("int") - 1
    one = F.array(F.struct(F.lit(0).alias("index"), F.lit(0.0).alias("start_time"), total.cast("double").alias("end_time"), chunk_name(F.lit(0)).alias("filename")))
    many = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.struct(i.alias("index"), (i * length).cast("double").alias("start_time"), F.least((i + 1) * length, total).cast("double").alias("end_time"), chunk_name(i).alias("filename")),
    )
    return F.when(F.coalesce(on & (total > 0) & (length > 0), F.lit(False)), many).otherwise(one)


def chunk_rows(df: DataFrame, total: str, length: Column) -> DataFrame:
    """One row per segment; nothing for an asset without a positive length."""
    return df.where(F.col(total) > 0).select(*df.columns, F.explode(chunk_array(F.col(total), length)).alias("c")).select(*df.columns, "c.*")


def with_offset(df: DataFrame, group: str, order: str, length: Column) -> DataFrame:
    """Position within its asset, from 0 in the order given, times the segment's length."""
    return scans.positions(df, [group], [order], "offset").withColumn("offset", F.col("offset") * length)


def joined_text(df: DataFrame, group: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Non-empty texts of a group, in order, as one."""
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col(text) != "", F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))), lambda x: x["t"])
    return df.groupBy(group).agg(F.array_join(parts, separator).alias("joined"))


def number(x: float) -> str:
    """A number as a browser writes it: no exponent from 1e-7 up to 1e21, no trailing zeros, nothing for what isn't finite."""
    if math.isnan(x) or math.isinf(x):
        return ""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    if 1e-6 <= abs(x) < 1e21:
        return format(decimal.Decimal(repr(x)), "f").rstrip("0").rstrip(".")
    return re.sub(r"e([+-])0*(\d)", r"e\1\2", repr(x))


def as_json(x: Any) -> str:
    """Compact JSON with numbers as ``number`` writes them."""
    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    if isinstance(x, float):
        return number(x) or "null"
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{as_json(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(as_json, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def text_of(x: Any) -> str:
    """One value of a list: objects, lists and null as JSON, texts as they are."""
    return x if isinstance(x, str) else as_json(x)


def plain(x: Any) -> str:
    """One value as a browser prints it within a text."""
    match x:
        case dict():
            return "[object Object]"
        case list():
            return ",".join("" if i is None else plain(i) for i in x)
        case float():
            return number(x) or ("NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity")
        case _:
            return text_of(x)


def keyed(x: Any) -> dict:
    """The fields of an object, or the places of a list or text; anything else has none."""
    return x if isinstance(x, dict) else {str(k): v for k, v in enumerate(x)} if isinstance(x, list | str) else {}


def cells_of(name: str, x: Any, depth: int) -> Iterator[tuple[str, str]]:
    """Cells of a value under its dotted name.

    =====================================================  ==========================================
    a text, number, truth value                            itself
    null, an empty list, a number that isn't finite        an empty cell
    a list of more than ARRAY_LIMIT                        its size, and a sample of SAMPLE joined by ``; ``
    at most INDEXED parts whose keys the first one has     each part under name[index]
    another list that starts with an object or a list      all joined by `` | ``
    a list that starts otherwise                           all but nulls joined by ``; ``
    an object                                              its own cells
    =====================================================  ==========================================

    A part is an object or a list, whose keys are its places.
    """
    match x:
        case dict():
            yield from flat_items(x, name, depth + 1)
        case list() if len(x) > ARRAY_LIMIT:
            yield from ((name, f"[{len(x)} items]"), (f"{name}_sample", "; ".join(map(text_of, x[:SAMPLE]))))
        case [dict() | list() as first, *_] if len(x) <= INDEXED and all(isinstance(i, dict | list) and keyed(i).keys() <= keyed(first).keys() for i in x):
            for n, i in enumerate(x):
                yield from flat_items(keyed(i), f"{name}[{n}]", depth + 1)
        case [dict() | list(), *_]:
            yield name, " | ".join(map(text_of, x))
        case list():
            yield name, "; ".join(plain(i) for i in x if i is not None)
        case None:
            yield name, ""
        case float():
            yield name, number(x)
        case _:
            yield name, text_of(x)


def flat_items(x: dict, prefix: str = "", depth: int = 0) -> Iterator[tuple[str, str]]:
    """Dotted keys of a nested value; hidden keys and those that hold ``chunk_`` or ``video_`` are left out; what lies too deep stays JSON."""
    if depth > MAX_DEPTH:
        yield prefix, as_json(x)
        return
    for k, v in x.items():
        if k not in HIDDEN and "chunk_" not in k and "video_" not in k:
            yield from cells_of(f"{prefix}.{k}" if prefix else k, v, depth)


def with_times(x: Any, position: int, length: float) -> Any:
    """A chunk's document with its place in the whole: chunk_metadata, and times of its timed items from the whole's start.

    Only times that are numbers move; the item keeps them, and has them again as ``chunk_`` and ``video_`` times.
    """
    start = position * length

    def moved(item: Any) -> Any:
        item = keyed(item)
        times = {k: v for k, v in item.items() if k in TIMES and isinstance(v, int | float) and not isinstance(v, bool)}
        return item | {f"video_{k}": start + v for k, v in times.items()} | {f"chunk_{k}": v for k, v in times.items()}

    lists = {k: [moved(i) for i in x[k]] for k in TIMED if isinstance(x.get(k), list)}
    place = {"chunk_index": position, "chunk_start_time": start, "chunk_duration": length, "video_timestamp_start": start, "video_timestamp_end": start + length}
    return x | lists | {"chunk_metadata": place}


@F.pandas_udf(StringType())
def timed(raw: pd.Series, position: pd.Series, length: pd.Series) -> pd.Series:
    """JSON of a chunk with times from the start of the whole; what is no JSON object stays as it is."""
    def one(x: str | None, k: int, n: float) -> str | None:
        try:
            v = json.loads(x) if x else None
        except ValueError:
            return x
        return as_json(with_times(v, k, n)) if isinstance(v, dict) else x

    return pd.Series([one(x, int(k), float(n)) for x, k, n in zip(raw, position, length, strict=True)], dtype="object")


def sequential(df: DataFrame, group: str, order: str, raw: str, length: float) -> DataFrame:
    """Chunks of an asset in order: result_id (their place as text), position, and ``raw`` with times from the asset's start."""
    df = scans.positions(df, [group], [order], "position").withColumn("result_id", F.col("position").cast("string"))
    return df.withColumn(raw, timed(F.col(raw), F.col("position"), F.lit(float(length))))


def export_json(df: DataFrame, job: str, video: Column, filename: Column, order: str, raw: str, length: float) -> DataFrame:
    """(job, export): one JSON object per job with all its results in order.  A job's results are one array: its chunks, some hundreds."""
    results = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(raw).alias("r")))), lambda x: x["r"])
    one = df.groupBy(job).agg(F.first(video).alias("v"), F.first(filename).alias("f"), F.count("*").alias("n"), results.alias("r"))
    head = F.to_json(F.struct(F.col(job).cast("string").alias("job_id"), F.col("v").alias("video_id"), F.col("f").alias("filename"), F.lit(length).alias("chunk_duration"), F.col("n").alias("total_chunks")))
    return one.select(job, F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"results":['), F.array_join("r", ","), F.lit("]}")).alias("export"))


@F.pandas_udf(MapType(StringType(), StringType()))
def flattened(raw: pd.Series) -> pd.Series:
    """JSON of any shape as dotted keys; bad JSON gives an empty map."""
    def one(x: str | None) -> dict[str, str]:
        try:
            v = json.loads(x or "{}")
        except ValueError:
            return {}
        return dict(flat_items(v)) if isinstance(v, dict) else {}

    return raw.map(one)


#: Columns that every scene has, before those that its job's scenes have.
SCENE_COLUMNS = (
    "Chunk Index", "Chunk Video Start (s)", "Chunk Video End (s)", "Scene Index", "Scene Video Start (s)", "Scene Video End (s)", "Scene Chunk Start (s)", "Scene Chunk End (s)",
)
SCENE = ArrayType(StructType().add("fixed", ArrayType(StringType())).add("cells", MapType(StringType(), StringType())))


@F.pandas_udf(SCENE)
def scenes_of(raw: pd.Series) -> pd.Series:
    """Each scene of a chunk's document with times (see ``timed``): its SCENE_COLUMNS and its own cells.  A document without scenes is one, of its own cells."""
    def first(x: dict, *names: str) -> str:
        return next((plain(x[n]) for n in names if x.get(n) is not None), "")

    def one(x: str | None) -> list[dict]:
        try:
            v = keyed(json.loads(x)) if x else {}
        except ValueError:
            v = {}
        place = v.get("chunk_metadata") or {}
        head = [first(place, n) for n in ("chunk_index", "video_timestamp_start", "video_timestamp_end")]
        scenes = v["scenes"] if isinstance(v.get("scenes"), list) else []
        if not scenes:
            return [{"fixed": [*head, "", "", "", "", ""], "cells": dict(flat_items(v))}]
        times = (("video_start_time", "video_timestamp"), ("video_end_time",), ("chunk_start_time", "chunk_timestamp"), ("chunk_end_time",))
        return [{"fixed": [*head, str(n), *(first(s, *t) for t in times)], "cells": dict(flat_items(s))} for n, s in enumerate(map(keyed, scenes))]

    return raw.map(one)


def csv_cell(x: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line feed."""
    return F.when(x.rlike("[,\"\n]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def scene_rows(df: DataFrame, job: str, order: str, raw: str, length: float) -> DataFrame:
    """(job, position, scene, fixed, cells): a row for each scene of a job's results in order, or for a result without scenes."""
    rows = sequential(df.select(job, order, raw), job, order, raw, length)
    return rows.select(job, "position", F.posexplode(scenes_of(raw)).alias("scene", "s")).select(job, "position", "scene", "s.fixed", "s.cells")


def scene_csv(df: DataFrame, job: str, order: str, raw: str, length: float) -> DataFrame:
    """(job, line_no, line): each job's CSV, line 0 its header.  Sort by both to print it.

    The header has SCENE_COLUMNS and the sorted keys that any scene of the job has; cells that a scene lacks are empty.
    Headers are found in the cluster: keys combine before they move, and a job's scenes meet its header in a join, so no job and no header comes to the
    driver.  A line holds all of its job's columns.  Jobs without results have no lines.
    """
    rows = scene_rows(df, job, order, raw, length)
    keys = rows.select(job, F.explode_outer(F.map_keys("cells")).alias("k")).groupBy(job).agg(F.array_sort(F.collect_set("k")).alias("__keys"))
    comma = lambda xs: F.array_join(F.transform(xs, csv_cell), ",")
    header = keys.select(job, F.lit(0).cast("long").alias("line_no"), comma(F.concat(F.array(*[F.lit(c) for c in SCENE_COLUMNS]), "__keys")).alias("line"))
    placed = scans.positions(rows, [job], ["position", "scene"], "line_no").withColumn("line_no", F.col("line_no") + 1)
    met = placed.alias("r").join(keys.alias("k"), F.col(f"r.{job}").eqNullSafe(F.col(f"k.{job}"))).select(f"r.{job}", "line_no", "fixed", "cells", "__keys")
    cells = F.transform("__keys", lambda k: F.coalesce(F.try_element_at("cells", k), F.lit("")))
    return header.unionByName(met.select(job, "line_no", comma(F.concat("fixed", cells)).alias("line")))


def write_scene_csv(df: DataFrame, job: str, order: str, raw: str, length: float, path: str) -> None:
    """A folder for each job with its CSV in one file, lines in order.  A job's lines stream through one task's writer."""
    lines = scene_csv(df, job, order, raw, length).withColumn("job", F.col(job).cast("string")).repartition("job").sortWithinPartitions("job", "line_no")
    lines.select("job", "line").write.mode("overwrite").partitionBy("job").text(path)


#: Columns of one table of all jobs; open keys (ids as keys) may be far more.
MOST_COLUMNS = 10_000


def csv_columns(df: DataFrame, flat: str, most: int = MOST_COLUMNS) -> list[str]:
    """Sorted union of all keys, for one CSV of all rows: distinct keys only come to the driver, and more than ``most`` are refused."""
    keys = df.select(F.explode(F.map_keys(flat)).alias("k")).distinct()
    found = sorted(r[0] for r in keys.limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} different keys: export by job, or in long form")
    return found


def write_csv(df: DataFrame, flat: str, fixed: list[str], path: str) -> None:
    cells = [F.coalesce(F.col(flat)[k], F.lit("")).alias(k) for k in csv_columns(df, flat)]
    df.select(*fixed, *cells).write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)
