"""Rows whose embeddings come later: pending, ready and error, replays and states written back."""

import pytest
from pyspark.sql import functions as F

from framelake.streaming import lazy as L

SCHEMA = "id string, text string, state string"


def model_that_fails_for_bad_texts():
    def call(texts):
        if any("bad" in t for t in texts):
            raise ConnectionError("busy")
        return [[float(len(t)), 1.0] if t else None for t in texts]

    return call


def enrich(spark, tmp_path, embed):
    q = L.enrich_stream(spark, str(tmp_path / "rows"), SCHEMA, "id", "text", str(tmp_path / "v"), str(tmp_path / "c"), embed, availableNow=True)
    assert q.awaitTermination(120)


def shown(spark, rows, tmp_path):
    return {r["id"]: (r["shown"], r["changed"]) for r in L.refreshed(spark, rows, str(tmp_path / "v"), "id", "state").collect()}


@pytest.mark.parametrize("model", ["fake", "offline"])
def test_states_follow_the_vectors(spark, tmp_path, model):
    embed = L.by_model(model_that_fails_for_bad_texts()) if model == "fake" else L.offline
    bad = "bad luck" if model == "fake" else " \t"
    rows = spark.createDataFrame([("a", "one", "pending"), ("b", bad, "pending"), ("c", "three", None), ("d", "", "pending")], SCHEMA)
    assert shown(spark, rows, tmp_path) == {"a": ("pending", False), "b": ("pending", False), "c": ("not_synced", False), "d": ("pending", False)}
    L.append(rows, 0, str(tmp_path / "rows"), "id")
    assert shown(spark, rows, tmp_path)["a"] == ("pending", False)  # the row is there, its vector isn't
    enrich(spark, tmp_path, embed)
    assert shown(spark, rows, tmp_path) == {"a": ("ready", True), "b": ("error", True), "c": ("not_synced", False), "d": ("error", True)}
    found = {r["id"]: r for r in L.vectors(spark, str(tmp_path / "v"), "id", "string").collect()}
    assert found["b"]["embedding"] is None and found["b"]["status"] == ("ConnectionError: busy" if model == "fake" else "nothing to embed") and found["a"]["status"] == ""

    L.write_back(spark, rows, str(tmp_path / "v"), str(tmp_path / "s"), 0, "id", "state")
    L.write_back(spark, rows, str(tmp_path / "v"), str(tmp_path / "s"), 0, "id", "state")  # a replay
    after = L.with_states(spark, rows, str(tmp_path / "s"), "id", "state")
    assert {r["id"]: r["state"] for r in after.collect()} == {"a": "ready", "b": "error", "c": None, "d": "error"}
    assert not any(changed for _, changed in shown(spark, after, tmp_path).values())

    more = spark.createDataFrame([("e", "five", "pending"), ("b", "good now", "pending")], SCHEMA)
    L.append(more, 1, str(tmp_path / "rows"), "id")
    L.append(more, 1, str(tmp_path / "rows"), "id")
    enrich(spark, tmp_path, embed)
    assert shown(spark, more, tmp_path) == {"e": ("ready", True), "b": ("ready", True)}  # the newest counts
    assert L.with_states(spark, rows, str(tmp_path / "none"), "id", "state").count() == 4


def test_empty_batches(spark, tmp_path):
    rows = spark.createDataFrame([], SCHEMA)
    L.append(rows.withColumn("text", F.lit(None).cast("string")), 0, str(tmp_path / "rows"), "id")
    enrich(spark, tmp_path, L.offline)
    assert shown(spark, rows, tmp_path) == {}
