"""Batches into the index: all columns, failures by row, replays, and a run that dies at any step."""

import json

import pytest
from pyspark.sql import functions as F

from framelake.operators import index_sync as X

RESULTS = [
    ("a", "v1", "j1", 3, "0", "9", {"genre": "drama", "chunk_index": 7}, None), ("b", "v2", None, None, None, None, {"chunk_summary": " s ", "chunk_index": 2}, "pending"), ("c", "v9", None, None, None, None, {"x": "only text"}, "error"),
    ("d", None, None, None, None, None, {}, "ready"), ("e", "v1", None, None, None, None, [1], "ready"), ("f", "v1", None, None, None, None, None, ""), ("g", "v1", None, None, None, None, "no", None),
]
ROWS = {
    "a": ("v1", "one.mp4", "j1", 3, "Genre: drama", "0", "9", '{"genre": "drama", "chunk_index": 7}', "gs://b/1"), "b": ("v2", "", None, 2, "Summary: s", None, None, '{"chunk_summary": " s ", "chunk_index": 2}', "gs://b/2"),
    "c": ("v9", "", None, None, "only text", None, None, '{"x": "only text"}', ""), "d": ("", None, None, None, "", None, None, None, None), "f": ("v1", "one.mp4", None, None, "", None, None, None, "gs://b/1"),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(*r[:6], r[6] if isinstance(r[6], str | None) else json.dumps(r[6]), r[7], None) for r in RESULTS]
    return spark.createDataFrame(rows, "result_id string, video_id string, scene_job_id string, chunk_index long, timestamp_start string, timestamp_end string, result_data string, bq_sync_status string, bq_sync_error string")


@pytest.fixture(scope="module")
def videos(spark):
    return spark.createDataFrame([("v1", "one.mp4", "gs://b/1"), ("v2", None, "gs://b/2"), ("v1", "one.mp4", "gs://b/1")], "video_id string, filename string, gcs_path string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", "e", "f", "g", "zz", "zz", "a", None]], "result_id string")


def index(spark, root):
    return {r["result_id"]: tuple(r)[1:] for r in X.index_now(spark, root).collect()}


def states(spark, root, results):
    return {r["result_id"]: (r["bq_sync_status"], (r["bq_sync_error"] or "").split(": ")[-1]) for r in X.states_now(spark, root, results).collect()}


def test_batches(spark, tmp_path, results, videos, asked):
    root = str(tmp_path)
    assert index(spark, root) == {} and states(spark, root, results)["b"] == ("pending", "")
    first = X.sync_batch(spark, root, 1, asked, results, videos)
    assert index(spark, root) == {k: ROWS[k] for k in "acf"}
    bad = ("error", "result_data is no JSON object")
    after = {"a": ("pending", ""), "b": ("pending", ""), "c": ("pending", ""), "d": ("ready", ""), "e": ("ready", ""), "f": ("pending", ""), "g": bad}
    assert states(spark, root, results) == after
    assert tuple(X.report(first).first()) == (7, 3)  # a twice
    assert sorted(r["error"] for r in X.errors(first).collect()) == ["Result g: result_data is no JSON object", "Result zz not found", "Result zz not found"]
    again = X.sync_batch(spark, root, 1, asked, results, videos)  # a replay
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect())) and index(spark, root).keys() == set("acf") and states(spark, root, results) == after
    assert tuple(X.report(X.sync_batch(spark, root, 2, asked.where("result_id in ('b', 'd', 'e')"), results, videos, resync=True)).first()) == (2, 1)
    assert index(spark, root) == ROWS and states(spark, root, results) == {**after, "d": ("pending", ""), "e": bad}
    X.remove_batch(spark, root, 3, asked.where("result_id in ('a', 'zz')"))
    assert index(spark, root) == {k: v for k, v in ROWS.items() if k != "a"} and states(spark, root, results)["a"] == (None, "")
    X.sync_batch(spark, root, 1, asked, results, videos)  # an old batch that comes back
    assert index(spark, root).keys() == set("bcdf")


def test_a_failed_resync_takes_the_old_row(spark, tmp_path, results, videos, asked):
    root = str(tmp_path)
    good = results.withColumn("result_data", F.when(F.col("result_id") == "e", F.lit("{}")).otherwise(F.col("result_data")))
    X.sync_batch(spark, root, 1, asked.where("result_id = 'e'"), good, videos, resync=True)
    assert index(spark, root).keys() == {"e"}
    X.sync_batch(spark, root, 2, asked.where("result_id = 'e'"), results, videos, resync=True)
    assert index(spark, root) == {} and states(spark, root, results)["e"][0] == "error"


@pytest.mark.parametrize("step", ["intent", "index", "states"])
def test_a_run_that_dies_is_not_seen_and_done_again(spark, tmp_path, results, videos, asked, step, monkeypatch):
    root, real = str(tmp_path), X.in_folder
    later = {"intent": "index", "index": "states", "states": "done"}[step]

    def dies(root, table, batch):
        if table == later:
            raise RuntimeError("lost")
        return real(root, table, batch)

    with monkeypatch.context() as m:
        m.setattr(X, "in_folder", dies)
        with pytest.raises(RuntimeError):
            X.sync_batch(spark, root, 1, asked, results, videos)
    assert index(spark, root) == {} and states(spark, root, results)["a"] == (None, "")
    X.sync_batch(spark, root, 1, asked, results, videos)
    assert index(spark, root) == {k: ROWS[k] for k in "acf"}


def test_rows_without_a_video_are_spread_and_texts_are_read_once(spark, results, videos):
    keys = spark.range(200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("result_id"))
    asked, conf = keys.unionByName(results.select("result_id")), {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = X.decided(asked, results, results.select("result_id", "bq_sync_status"), videos, False)
        at = rows.select("action", "gcs_path", F.spark_partition_id().alias("at")).collect()
        assert len({r["at"] for r in at if r["action"] == "not_found"}) > 1
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_empty_tables(spark, tmp_path, results, videos, asked):
    X.sync_batch(spark, str(tmp_path), 1, asked.limit(0), results.limit(0), videos.limit(0))
    assert index(spark, str(tmp_path)) == {}
    assert tuple(X.report(X.sync_batch(spark, str(tmp_path), 2, asked, results.limit(0), videos.limit(0))).first()) == (0, 10)
