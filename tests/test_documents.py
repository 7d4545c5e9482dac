"""Documents with nested, null, empty and wrong-typed content; operators that no registered query calls."""

import json

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framelake.functions import documents as D
from framelake.functions import scalars as S
from framelake.operators import providers as U
from framelake.operators import relations as R
from framelake.operators import segments as G
from framelake.sources import files
from framelake.streaming import jobs as J


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


DOCUMENTS = {
    '{"genre": 5, "type": "x", "scenes": "y"}': "Type: x",
    '{"genre": " ", "chunk_summary": "", "scenes": [], "deep": {"a": [" t ", 1, {"b": "u"}], "gcs_path": "no"}}': "t u",
    '{"scenes": [{"mood": {"tone": null, "energy": "low"}, "people": null}, {"people": [{"label": "Ann"}, {"label": null}, {"label": "Person"}], "summary": " s "}], "notable_observations": ["n", "", null]}': "Mood:  low s Actor: Ann n",
    "not json": "", "": "", "[]": "", '{"a": {"b": {"c": {"d": {"e": "six"}}}}}': "six", '{"a": {"b": {"c": {"d": {"e": {"f": "seven"}}}}}}': "",
}


@pytest.mark.parametrize("raw", [*DOCUMENTS, None])
def test_embedding_text(spark, raw):
    got = one(spark, raw).withColumn("d", D.parse(F.col("x"))).select(D.embedding_text(F.col("d"), F.col("x"))).first()[0]
    assert got == DOCUMENTS.get(raw, "")


def test_metadata(spark):
    raw = '{"genre": 5, "chunk_summary": "c", "type": "", "content_type": "film", "scenes": [{"mood": {"tone": "t"}, "people": [{"label": "A"}, {"label": "Person 2"}]}, {"people": [{"label": "B"}, {"label": "A"}]}]}'
    m = one(spark, raw).select(D.metadata(D.parse(F.col("x")))).first()[0]
    assert m.asDict() == {"description": "c", "genre": None, "content_type": "film", "mood": "t", "setting": None, "actors": ["A", "B"]}
    assert set(one(spark, "nope").select(D.metadata(D.parse(F.col("x")))).first()[0].asDict().values()) == {None}


@pytest.mark.parametrize(("raw", "good"), [('```json\n{"a": 1}\n```', True), ('{"a": 1}', True), ("```\n[1]\n```", True), ("sorry", False), ("", False), (None, False)])
def test_model_answers(spark, raw, good):
    answer, result = one(spark, raw).select(D.answer_or_error(F.col("x")), D.analysis_result(F.col("x"), F.lit("STOP"), F.lit(True))).first()
    assert ("error" not in json.loads(answer)) == good
    assert (result["parse_error"] is None) == (raw == '{"a": 1}') and result["finish_reason"] == "STOP"
    free = one(spark, raw).select(D.analysis_result(F.col("x"), F.lit("STOP"), F.lit(False))).first()[0]
    assert free["raw_text"] == raw and free["parse_error"] is None


def test_strip_tries_no_pattern_at_every_place(spark):
    ends = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = spark.createDataFrame([(f"{c}{d} a{c}{d}b {d}{c}",) for c in ends for d in (" ", "\u3000")] + [("",), (" \t",), ("é",)], "x string").select("x", S.strip(F.col("x")).alias("y"))
    assert all(r["y"] == r["x"].strip() for r in rows.collect())
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()


REST = [("7100234916554344 With. That", False), ('{"a": 1} {"b": 2}', False), ('{"a": 1}]', False), ('{"a": 1}}', False), ('{"a": 1}, {"b": 2}', False), ('{"a": 1}, "y": 2', False), ('"a", "b": 2', False), ('"a"] , "b"', False), (' {"a": [1, "]}"]} \n', True), ("12", True), ("null", True), ('"a"', True), ("{}", True)]


@pytest.mark.parametrize(("raw", "whole"), REST)
def test_a_value_is_the_whole_text(spark, raw, whole):
    """As by the json module."""
    r = one(spark, raw).select(D.analysis_result(F.col("x"), F.lit("STOP"), F.lit(True)).alias("r"), D.parse(F.concat(F.lit('{"genre": "g"}'), F.col("x")))["genre"].alias("genre"), F.to_json(D.parse_model_answer(F.col("x"))).alias("answer")).first()
    assert (r["r"]["parse_error"] is None) == whole and r["genre"] is None and (r["answer"] is not None) == whole
    if whole:
        assert json.loads(r["answer"]) == json.loads(raw)


FLAT = [
    ({"a": [{"x": 1}, 3]}, {"a": '{"x":1} | 3'}), ({"a": [[1, 2], ["b"]]}, {"a[0].0": "1", "a[0].1": "2", "a[1].0": "b"}), ({"a": [[1], [2, 3]]}, {"a": "[1] | [2,3]"}), ({"a": [[], {}]}, {}), ({"a": [1, {"b": 2}, [3, None, 4]]}, {"a": "1; [object Object]; 3,,4"}), ({"a": [1, None, "b", True]}, {"a": "1; b; true"}), ({"a": []}, {"a": ""}), ({"a": {}}, {}), ({"a": None}, {"a": ""}),
    ({"a": [{"x": 1}, {"y": 2}]}, {"a": '{"x":1} | {"y":2}'}), ({"a": [{"x": 1, "y": 1e-5}, {"y": 2e-7}]}, {"a[0].x": "1", "a[0].y": "0.00001", "a[1].y": "2e-7"}), ({"a": [{"x": k} for k in range(11)]}, {"a": " | ".join(f'{{"x":{k}}}' for k in range(11))}),
    ({"a": list(range(51))}, {"a": "[51 items]", "a_sample": "0; 1; 2"}), ({"chunk_x": 1, "a": {"video_y": 1, "z": 1e21}, "blocked": True}, {"a.z": "1e+21"}),
]


@pytest.mark.parametrize(("value", "want"), FLAT)
def test_flat_items(value, want):
    assert dict(G.flat_items(value)) == want


def test_what_lies_too_deep_stays_json():
    x = {"v": 1}
    for _ in range(12):
        x = {"k": x}
    assert dict(G.flat_items(x)) == {".".join(["k"] * 11): '{"k":{"v":1}}'}


def test_timed(spark):
    raw = json.dumps({"scenes": [{"timestamp": 1, "start_time": "0:01", "end_time": True}, "x"], "events": [{"end_time": 2.5}], "moments": "none"})
    rows = spark.createDataFrame([("j", 1, raw), ("j", 2, raw), ("j", 3, None), ("j", 4, "no"), ("j", 5, "[1]")], "j string, o int, raw string")
    got = {r["o"]: r for r in G.sequential(rows, "j", "o", "raw", 30.0).collect()}
    second = json.loads(got[2]["raw"])
    assert second["scenes"] == [{"timestamp": 1, "start_time": "0:01", "end_time": True, "video_timestamp": 31, "chunk_timestamp": 1}, {"0": "x"}]
    assert second["events"] == [{"end_time": 2.5, "video_end_time": 32.5, "chunk_end_time": 2.5}] and second["moments"] == "none"
    assert second["chunk_metadata"] == {"chunk_index": 1, "chunk_start_time": 30, "chunk_duration": 30, "video_timestamp_start": 30, "video_timestamp_end": 60}
    assert [got[k]["raw"] for k in (3, 4, 5)] == [None, "no", "[1]"] and got[5]["result_id"] == "4"


def test_names(spark):
    long = "a_very_long_file_name_that_goes_on.mp4"
    shown = {x: one(spark, x).select(S.shorten(F.col("x")), S.compact(F.col("x"))).first() for x in (long, "short.mp4", "x" * 40, "a." + "e" * 30, "", None)}
    assert shown[long][0] == "a_very_long...t_goes_on.mp4"[:0] + long[:12] + "..." + long[:-4][-11:] + ".mp4" and len(shown[long][0]) == 30
    assert shown[long][1] == "a_ve...s_on.mp4" and shown["x" * 40] == ("x" * 27 + "...", "xxxx...xxxx") and shown["a." + "e" * 30][0] == "a." + "e" * 25 + "..."
    assert shown["short.mp4"] == ("short.mp4",) * 2 and shown[""] == ("", "") and shown[None] == (None, None)
    assert one(spark, "scene_ANALYSIS_x").select(S.title_of(F.col("x"))).first()[0] == "Scene ANALYSIS X"
    assert one(spark, "　 x  \x1c").select(S.strip(F.col("x"))).first()[0] == "x"


def test_other_scalars(spark):
    got = one(spark, 1.2345, "double").select(S.match_reason(F.col("x")), S.percent(F.col("x")), S.seconds_and_nanos(F.col("x")), S.finite(F.lit(float("inf"))), S.finite(F.lit(float("nan"))), S.finite(F.col("x")), S.aspect_name(F.lit("9:16"))).first()
    assert got[0] == "Matched search query with distance 1.235" or got[0].endswith("1.234")
    assert got[1] == 123 and got[2]["seconds"] == 1 and abs(got[2]["nanos"] - 234_500_000) <= 1 and got[3] is None and got[4] is None and got[5] == 1.2345 and got[6] == "9_16"
    with pytest.raises(PySparkException):
        one(spark, "http://x").select(*S.checked_object_path(F.col("x"))).collect()
    assert tuple(one(spark, "gs://b/c/d").select(*S.checked_object_path(F.col("x"))).first()) == ("b", "c/d")
    assert one(spark, "😀a").select(S.utf16_length(F.col("x"))).first()[0] == 3


def test_maps_and_sets(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (None, {"x": "1"}), ({"y": "1"}, None)], "o map<string,string>, n map<string,string>")
    assert [r[0] for r in df.select(R.merged_maps(F.col("o"), F.col("n"))).collect()] == [{"a": "1", "b": "3", "c": "4"}, {"x": "1"}, {"y": "1"}]
    t = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert sorted(r[0] for r in R.key_set(t, "k").collect()) == [1, 2]
    assert files.existing(t, spark.createDataFrame([(2,)], "k int"), "k").count() == 1
    assert [r[0] for r in R.oldest(t.where("k is not null"), F.lit(True), "k", "k", 1).collect()] == [1]
    log = spark.createDataFrame([("a", 1, "put", 1), ("a", 1, "put", 2)], "k string, s int, op string, v int")
    assert [r["v"] for r in R.current(log, "k", "s", "op").collect()] == [r["v"] for r in R.current(log.orderBy(F.desc("v")), "k", "s", "op").collect()] == [1]


def test_next_status():
    assert J.next_status("pending", "transcoding") == "transcoding" and J.next_status("failed", "completed") == "failed" and J.next_status("completed", "archived") == "archived"


def test_provider_keeps_rows_that_fail(spark):
    def call(b: pd.DataFrame) -> pd.DataFrame:
        if (b["x"] == 3).any():
            raise ValueError("three")
        return b.assign(y=b["x"] * 2)

    rows = spark.createDataFrame([(k,) for k in range(6)], "x long").coalesce(1)
    got = sorted((r["x"], r["y"], r["error"]) for r in U.enrich(rows, call, "x long, y double").collect())
    assert [g for g in got if g[0] != 3] == [(k, 2.0 * k, None) for k in range(6) if k != 3] and got[3][2] == "three"
    jobs = spark.createDataFrame([("j", ["1:1", "9:16"]), ("k", [])], "j string, r array<string>")
    assert sorted(r["ratio"] for r in U.fanned_out(jobs, "r", "ratio").collect()) == ["1:1", "9:16"]


def test_offline_embedding(spark):
    df = spark.createDataFrame([("The cat sat",), ("the  CAT sat ",), ("other words",), ("",), (None,)], "t string")
    v = [r[0] for r in df.select(U.hashed_embedding(F.col("t"))).collect()]
    assert v[0] == v[1] != v[2] and v[3] == v[4] == [0.0] * U.DIMENSIONS and abs(sum(x * x for x in v[0]) - 1) < 1e-9


def test_scene_csv(spark, tmp_path):
    rows = [
        ("j", 1, {"scenes": [{"start_time": 1, "end_time": 2.5, "a": 'q "r", s', "chunk_summary": "hidden"}, {"timestamp": 4, "b": {"c": None}}, None]}),
        ("j", 2, {"scenes": [], "genre": "x\ny"}), ("j", 3, {"genre": "last", "scenes": None}), ("k", 1, {"scenes": [[7, "z"], "é", 5]}), ("l", 1, None), (None, 1, {"d": 1}),
    ]
    df = spark.createDataFrame([(j, o, json.dumps(r) if r is not None else None) for j, o, r in rows], "job string, o int, raw string")
    got = {}
    for r in sorted(G.scene_csv(df, "job", "o", "raw", 30.0).collect(), key=lambda r: (str(r["job"]), r["line_no"])):
        got.setdefault(r["job"], []).append(r["line"])
    head = ",".join(G.SCENE_COLUMNS)
    assert got["j"] == [
        head + ",a,b.c,end_time,genre,scenes,start_time,timestamp", '0,0,30,0,1,2.5,1,2.5,"q ""r"", s",,2.5,,,1,', "0,0,30,1,4,,4,,,,,,,,4", "0,0,30,2,,,,,,,,,,,",
        '1,30,60,,,,,,,,,"x\ny",,,', "2,60,90,,,,,,,,,last,,,",
    ]
    assert got["k"] == [head + ",0,1", "0,0,30,0,,,,,7,z", "0,0,30,1,,,,,é,", "0,0,30,2,,,,,,"]
    assert got["l"] == [head, ",,,,,,,"] and got[None] == [head + ",d", "0,0,30,,,,,,1"]
    assert G.scene_csv(df.limit(0), "job", "o", "raw", 30.0).count() == 0
    G.write_scene_csv(df.where("job = 'k'"), "job", "o", "raw", 30.0, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv" / "job=k").glob("*.txt")
    assert file.read_text().splitlines() == got["k"]


def test_chunks_without_a_length_keep_their_places(spark):
    df = spark.createDataFrame([("j", k, "{}") for k in range(3)], "j string, o int, raw string")
    got = [json.loads(r["raw"])["chunk_metadata"]["chunk_index"] for r in G.sequential(df, "j", "o", "raw", 0.0).orderBy("o").collect()]
    assert got == [0, 1, 2]


def test_too_many_columns_are_refused(spark):
    df = spark.createDataFrame([({str(k): "v" for k in range(5)},)], "flat map<string,string>")
    assert G.csv_columns(df, "flat", 5) == list("01234")
    with pytest.raises(ValueError):
        G.csv_columns(df, "flat", 4)
