"""Nested analysis documents: parsing, metadata, text for embedding."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import filled, first_filled, is_blank, label_of, strip

SCHEMA = (
    "genre string, type string, content_type string, category string, sub_category string, chunk_summary string, prompt_type string, chunk_index int, "
    "token_usage struct<prompt_tokens:bigint,candidates_tokens:bigint,total_tokens:bigint,cost:double>, finish_reason string, "
    "scenes array<struct<scene_number:int,start_time:string,end_time:string,summary:string,people:array<struct<label:string>>,"
    "mood:struct<tone:string,energy:string>,setting:struct<location:string>>>, notable_observations array<string>"
)
LABELLED = ("genre", "type", "content_type", "category", "sub_category")
SKIPPED = frozenset({"token_usage", "gcs_path", "finish_reason"})
DEPTH = 5
ANONYMOUS = "Person"


TEXTS = (*LABELLED, "chunk_summary")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def json_or_null(text: Column) -> Column:
    """The JSON value that is the whole text; null if it isn't JSON, or if anything but white space follows the value.

    Spark's parsers stop after the first value, so the text is parsed within a list and within an object: what could follow the value in
    one of them (a bracket, or a comma and another value) can't in the other.
    """
    listed, nested = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when(listed.isNotNull(), F.try_variant_get(nested, "$.x", "variant"))


def parse(text: Column, value: Column | None = None) -> Column:
    """The document as a struct; bad JSON gives a struct of nulls.  A text field that holds no string is null, as is one of scenes that is no list.

    ``value`` is the text's ``json_or_null`` where that is known.  The text is read once for all fields, also by a plan that names them one by one.
    """
    def fields(v: Column, d: Column) -> Column:
        kept = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", d[k]).alias(k) for k in TEXTS]
        return F.struct(*kept, *[d[k].alias(k) for k in ("prompt_type", "chunk_index", "token_usage", "finish_reason", "scenes", "notable_observations")])

    return let(json_or_null(text) if value is None else value, lambda v: let(F.from_json(F.when(v.isNotNull(), text), SCHEMA), lambda d: fields(v, d)))


def parse_model_answer(text: Column) -> Column:
    """JSON of an answer that may be wrapped in a code fence; null if it isn't JSON."""
    return json_or_null(F.regexp_replace(strip(text), r"^```(?:json)?\s*|\s*```$", ""))


def answer_or_error(text: Column) -> Column:
    """The answer's JSON text, or an object that says it can't be parsed and holds the raw answer."""
    got = parse_model_answer(text)
    error = F.to_json(F.struct(F.lit("Failed to parse response").alias("error"), text.alias("raw_response")))
    return F.coalesce(F.to_json(got), error)


def analysis_result(text: Column, reason: Column, structured: Column) -> Column:
    """struct(data, raw_text, raw_response, parse_error, finish_reason) of a model's answer: a failure to parse stays a row."""
    data = json_or_null(text)
    bad = structured & data.isNull()
    return F.struct(
        F.when(structured, F.to_json(data)).alias("data"), F.when(~structured, text).alias("raw_text"), F.when(bad, text).alias("raw_response"),
        F.when(bad, "invalid JSON").alias("parse_error"), reason.alias("finish_reason"),
    )


def candidate_context(raw: Column, text: Column) -> Column:
    """struct(analysis, text_content): the full analysis where there is one, else the text."""
    has = F.coalesce(filled(raw), F.lit("")) != ""
    return F.struct(F.when(has, raw).alias("analysis"), F.when(~has, F.coalesce(text, F.lit(""))).alias("text_content"))


def usage(prompt: Column, answer: Column, cost: Column) -> Column:
    """Token use of one result, as its document nests it."""
    return F.struct(prompt.cast("long").alias("prompt_tokens"), answer.cast("long").alias("candidates_tokens"), (prompt + answer).cast("long").alias("total_tokens"), cost.alias("estimated_cost_usd"))


def serialised(document: Column) -> Column:
    """JSON of a document; an empty one is null."""
    text = F.to_json(document)
    return F.nullif(text, F.lit("{}"))


def names_of(scenes: Column) -> Column:
    """Distinct named people in order of first appearance."""
    labels = F.flatten(F.transform(F.coalesce(scenes, F.array()), lambda s: F.coalesce(F.transform(s["people"], lambda p: p["label"]), F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(labels, lambda x: filled(x).isNotNull() & ~x.startswith(ANONYMOUS)))


def metadata(d: Column) -> Column:
    first = F.try_element_at(d["scenes"], F.lit(1))
    mood = filled(F.concat_ws(" ", filled(first["mood"]["tone"]), filled(first["mood"]["energy"])))
    return F.struct(
        filled(d["chunk_summary"]).alias("description"), filled(d["genre"]).alias("genre"), first_filled(d["type"], d["content_type"]).alias("content_type"), mood.alias("mood"),
        filled(first["setting"]["location"]).alias("setting"), F.when(F.size(names_of(d["scenes"])) > 0, names_of(d["scenes"])).alias("actors"),
    )


def embedding_text(d: Column, raw: Column) -> Column:
    """Labelled fields, summary, first scene's mood and setting, then each scene's summary and newly seen people, then observations.

    A document without any of these falls back to all its strings in order.
    """
    labelled = [F.when(~is_blank(d[k]), F.concat(label_of(F.lit(k)), F.lit(": "), strip(d[k]))) for k in LABELLED]
    summary = F.when(filled(d["chunk_summary"]).isNotNull(), F.concat(F.lit("Summary: "), strip(d["chunk_summary"])))
    scenes = F.coalesce(d["scenes"], F.array())
    first = F.try_element_at(scenes, F.lit(1))
    tone, energy = F.coalesce(first["mood"]["tone"], F.lit("")), F.coalesce(first["mood"]["energy"], F.lit(""))
    mood = F.when((tone != "") | (energy != ""), strip(F.concat(F.lit("Mood: "), tone, F.lit(" "), energy)))
    setting = F.when(filled(first["setting"]["location"]).isNotNull(), F.concat(F.lit("Setting: "), first["setting"]["location"]))
    empty = F.array().cast("array<string>")

    def step(state: Column, scene: Column) -> Column:
        names = F.filter(F.transform(F.coalesce(scene["people"], F.array()), lambda p: p["label"]), lambda x: filled(x).isNotNull() & ~x.startswith(ANONYMOUS))
        new = F.array_except(F.array_distinct(names), state["seen"])
        said = F.when(filled(scene["summary"]).isNotNull(), F.array(strip(scene["summary"]))).otherwise(empty)
        return F.struct(F.concat(state["seen"], new).alias("seen"), F.concat(state["out"], said, F.transform(new, lambda x: F.concat(F.lit("Actor: "), x))).alias("out"))

    told = F.aggregate(scenes, F.struct(empty.alias("seen"), empty.alias("out")), step)["out"]
    notes = F.transform(F.filter(F.coalesce(d["notable_observations"], empty), lambda x: ~is_blank(x)), strip)
    parts = F.concat(F.filter(F.array(*labelled, summary, mood, setting), lambda x: x.isNotNull()), told, notes)
    joined = let(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, " ")))
    # Functions run before conditions choose, so a document with a summary, which surely has a part, isn't handed to Python.
    rest = F.coalesce(all_text(F.when(filled(d["chunk_summary"]).isNull(), raw)), F.lit(""))
    return F.coalesce(joined, rest)


def strings_in(x: Any, depth: int = 0) -> list[str]:
    if depth > DEPTH:
        return []
    if isinstance(x, str):
        return [s] if (s := x.strip()) else []
    if isinstance(x, dict):
        return [s for k, v in x.items() if k not in SKIPPED for s in strings_in(v, depth + 1)]
    return [s for v in x for s in strings_in(v, depth + 1)] if isinstance(x, list) else []


@F.pandas_udf(StringType())
def all_text(raw: pd.Series) -> pd.Series:
    """Every string of a JSON text in its own key order, which no native type keeps."""
    def one(x: str | None) -> str | None:
        try:
            return " ".join(strings_in(json.loads(x))) if x else x
        except ValueError:
            return ""

    return raw.map(one)
