"""Many queries at once, interpreted queries and answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.operators import search as V


@pytest.mark.parametrize("rows", [4096, 7])
def test_many_queries_find_what_each_finds(spark, monkeypatch, rows):
    monkeypatch.setattr(V, "INDEX_ROWS", rows)
    monkeypatch.setattr(V, "QUERY_ROWS", rows)
    r = np.random.default_rng(1)
    data = [(k, [float(x) for x in r.normal(size=6)]) for k in range(200)]
    data += [(300 + k, data[k][1]) for k in range(10)] + [(400, [0.0] * 6), (401, None), (402, [None] + [1.0] * 5), (403, [float("nan")] * 6), (404, [1.0] * 5), (None, data[0][1])]
    index = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    queries = index.where("vec_id % 17 = 0 or vec_id > 399").withColumnRenamed("vec_id", "query_id")
    got = {}
    for x in V.vector_search_many(index, queries, k=5, below=0.9, parts=4).collect():
        got.setdefault(x["query_id"], set()).add((x["vec_id"], x["distance"]))
    usable = index.where("vec_id < 400")
    for q, v in data:
        if q is not None and q % 17 == 0 and q < 400:
            assert got.pop(q) == {(x["vec_id"], x["distance"]) for x in V.vector_search(usable, v, k=5, below=0.9).collect()}
    assert got.keys() == {404}  # its own length only
    assert V.vector_search_many(index.limit(0), queries, parts=4).count() == V.vector_search_many(index, queries.limit(0), parts=4).count() == 0


def test_interpreted(spark):
    def call(texts: pd.Series) -> pd.Series:
        assert not texts.str.contains("plain").any()
        if texts.str.contains("fails").any():
            raise ConnectionError
        return texts.map(lambda t: "" if "?" in t else f" english {t} ")

    rows = spark.createDataFrame([("1", " plain ", None), ("2", "été", None), ("3", "é?", None), ("4", "spoken", b"a"), ("5", None, b"a"), ("6", "", None), ("7", None, None)], "id string, q string, audio binary")
    got = {r["id"]: (r["search_text"], r["interpreted_query"]) for r in V.interpreted(rows, "q", call, "audio").collect()}
    assert got == {"1": ("plain", None), "2": ("english été", "english été"), "3": ("é?", None), "4": ("english spoken", "english spoken"), "5": ("english", "english"), "6": (None, None), "7": (None, None)}
    bad = V.interpreted(rows.where("id = '2'").withColumn("q", F.lit(" é fails ")), "q", call).first()
    assert (bad["search_text"], bad["interpreted_query"]) == ("é fails", None)
    assert V.interpreted(rows, "q").where("id = '2'").first()["search_text"] == "été"


def test_answers(spark):
    queries = spark.createDataFrame([(1, "cats"), (2, "none"), (3, "fails")], "query_id long, q string")
    hits = spark.createDataFrame([(q, v, 0.05 * v + q / 10, f"f{v}.mp4" if v % 2 else None, "gs://b") for q in (1, 3) for v in range(12)], "query_id long, vid long, distance double, filename string, path string")

    def curate(text, found):
        if text == "fails":
            raise TimeoutError
        assert [h["distance"] for h in found] == sorted(h["distance"] for h in found)
        return {"response_text": f"about {text}", "recommendations": [{"video_id": found[0]["video_id"], "title": "t", "reason": "r", "confidence": 0.5}]}

    got = {r["query_id"]: r for r in V.answered(queries, hits, "query_id", "q", "vid", "filename", "path", curate).collect()}
    assert got[1]["response_text"] == "about cats" and [tuple(x) for x in got[1]["recommendations"]] == [("0", "t", "r", 0.5)]
    assert got[2]["response_text"] == "No results found for your search query." and got[2]["recommendations"] == []
    assert got[3]["response_text"] == 'Found 12 result(s) matching "fails". Showing raw results (AI curation unavailable).' and len(got[3]["recommendations"]) == 10
    assert tuple(got[3]["recommendations"][0]) == ("0", "Untitled", "Matched search query with distance 0.300", 0.7) and got[3]["recommendations"][1]["title"] == "f1.mp4"
    plain = {r["query_id"]: r for r in V.answered(queries, hits, "query_id", "q", "vid", "filename", "path").collect()}
    assert plain[1]["response_text"].startswith("Found 12 result(s)") and plain[2]["recommendations"] == []
    rec = V.recommendations(hits, "query_id", "vid", "filename", "path").where("query_id = 1").orderBy("rank").collect()
    assert len(rec) == 10 and (rec[0]["title"], rec[0]["video_filename"], rec[0]["recommendation_type"]) == ("Untitled", "", "full_video")
    best = V.by_asset(hits, "query_id", "filename", "vid", ["path"]).where("query_id = 1 and filename is null").first()
    assert (best["vid"], best["chunk_count"], best["score"]) == (0, 6, 0.1)
