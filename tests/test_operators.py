"""Hand-made tables for what the driver's tables lack."""

import base64
import csv
import glob
import hashlib

from pyspark.sql import functions as F

from framelake.functions import scalars as S
from framelake.operators import admission as A
from framelake.operators import relations as R
from framelake.operators import search as V
from framelake.operators import segments as G
from framelake.sources import files, objects
from framelake.streaming import jobs as J


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_search_threshold_is_after_the_limit(spark):
    index = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)] + [(9, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in V.vector_search(index, [1.0, 0.0], k=3).collect()] == [0, 1, 2]
    assert [r["vec_id"] for r in V.vector_search(index, [-1.0, 0.0], k=2).collect()] == [9]
    assert V.vector_search(index.limit(0), [1.0, 0.0]).count() == 0


def test_equal_distances_go_by_key(spark):
    index = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in V.vector_search(index, [1.0, 0.0]).collect()] == [1, 2]


def test_segments(spark):
    df = spark.createDataFrame([(None,), (0.0,), (60.0,), (65.0,)], "d double")
    got = {r["d"]: [(s["start_time"], s["end_time"]) for s in r["c"]] for r in df.select("d", G.chunk_array(F.col("d"), F.lit(30)).alias("c")).collect()}
    assert got[None] == [(0.0, None)] and got[0.0] == [(0.0, 0.0)]
    assert got[60.0] == [(0.0, 30.0), (30.0, 60.0)] and got[65.0][-1] == (60.0, 65.0)


def test_log(spark):
    log = spark.createDataFrame([("a", 1, "put", 1), ("a", 2, "put", 2), ("b", 1, "put", 3), ("b", 2, "delete", None), ("a", 2, "put", 2)], "k string, seq int, op string, v int")
    assert [(r["k"], r["v"]) for r in R.current(log, "k", "seq", "op").collect()] == [("a", 2)]


def test_patch_and_merge(spark):
    base = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, x int, y int")
    patch = spark.createDataFrame([("a", None, 9), ("c", 7, None)], "k string, x int, y int")
    assert rows(R.patched(base, patch, "k", ["x", "y"])) == [("a", 1, 9), ("b", 3, 4)]
    assert rows(R.merged(base, patch, "k", ["x", "y"])) == [("a", 1, 9), ("b", 3, 4), ("c", 7, None)]


def test_guarded_delete(spark):
    t = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    assert rows(R.guarded_delete(t("a", "b", "c"), t("a", "b"), t("b"), "k")) == [("b",), ("c",)]


def test_classify_sync(spark):
    t = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    assert rows(R.classify_sync(t("a", "b", "z", "a"), t("a", "b"), t("b"), "k")) == [("a", "insert"), ("b", "skip"), ("z", "not_found")]


def test_admission_boundary():
    assert A.admit([0, 10, 20, 60, 61], limit=2, window=60)[0] == [True, True, False, False, True]


def streamed(spark, tmp_path, batches, schema, of, name):
    """What a query over files, one batch each, has put out."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k}"))
    source = spark.createDataFrame([], schema).withColumn("at", F.timestamp_seconds("s")).schema
    for k in range(len(batches)):  # a file a batch, in order
        folder = tmp_path / "in" / f"b={k}"
        file = next(folder.glob("*.parquet"))
        target = tmp_path / "files" / f"{k:03d}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(file.read_bytes())
        import os

        os.utime(target, (1_000_000 + k * 1000,) * 2)
    stream = spark.readStream.schema(source).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "files"))
    q = of(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return {tuple(r) for r in spark.table(name).collect()}


def test_admission_stream_equals_batch(spark, tmp_path):
    data = [("u" + str(i % 3), i, 1000 + i * 7 % 50 + i) for i in range(60)]
    late = [x for x in data if x[1] % 5 == 0]  # within the lateness, in a later batch
    batches = [[x for x in data if x[1] % 5 and x[1] < 30], [x for x in late if x[1] < 30] + [x for x in data if x[1] % 5 and x[1] >= 30], [x for x in late if x[1] >= 30], [("end", 900, 1500)], [("end", 901, 1900)]]
    table = spark.createDataFrame(data, "u string, id long, s long").withColumn("at", F.timestamp_seconds("s"))
    got = streamed(spark, tmp_path, batches, "u string, id long, s long", lambda x: J.admission_stream(x, "u", "at", "id", 3, 20, "100 seconds"), "admitted")
    want = {(r["u"], r["id"], r["accepted"]) for r in A.admission(table, ["u"], "at", "id", 3, 20).collect()}
    assert {r for r in got if r[0] != "end"} == want and len(want) == 60


def test_lifecycle_stream(spark, tmp_path):
    schema = "k string, id long, s long, asked string, ok boolean"
    batches = [
        [("a", 1, 10, "processing", True), ("b", 1, 10, "transcoding", True), ("c", 1, 12, "transcoding", False)], [("a", 3, 40, "archived", True), ("a", 2, 30, "completed", True)],
        [("end", 1, 300, "processing", True)], [("b", 2, 800, "completed", True), ("end", 2, 1000, "completed", True)], [("end", 3, 3000, "archived", True)],
    ]
    got = streamed(spark, tmp_path, batches, schema, lambda x: J.lifecycle_stream(x, "k", "at", "id", "asked", "ok", 600, "20 seconds"), "lives")
    assert {r[:4] for r in got if r[0] != "end"} == {
        ("a", "processing", 1, None), ("a", "completed", 2, None), ("a", "archived", 3, None), ("b", "transcoding", 1, None), ("b", "failed", 2, "TIMEOUT"), ("c", "failed", 1, "unusable"),
    }


def test_polled_stages_in_order(spark, tmp_path):
    seen = []
    spark.createDataFrame([(k, "scene" if k % 2 else "media") for k in range(20)], "k long, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, kind string").parquet(str(tmp_path / "in"))
    q = J.polled(stream, [lambda b, i: seen.append(("media", b.count())), lambda b, i: seen.append(("claimed", sorted(map(tuple, J.claimed(b, "kind", "k").collect()))))], str(tmp_path / "c"), 1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen[0] == ("media", 20) and seen[1] == ("claimed", [(0, "media"), (1, "scene"), (2, "media"), (3, "scene"), (4, "media"), (5, "scene")])


def test_lifecycle(spark):
    e = spark.createDataFrame([("a", 1, "processing"), ("a", 2, "archived"), ("a", 3, "completed"), ("b", 1, "failed"), ("b", 2, "processing")], "k string, s int, st string")
    assert rows(J.lifecycle(e, "k", "s", "st")) == [("a", "completed", 2), ("b", "failed", 1)]


def test_replayed_batch_is_harmless(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        J.append_once(batch, 0, str(tmp_path / "log"), "k")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_flattened_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("j", '{"a":{"b":1.0},"t":["x",null,"y"],"chunk_no":3,"o":[{"p":true},{"p":"q, \\"r\\""}]}'), ("k", "not json"), ("l", None)], "job string, raw string").withColumn("flat", G.flattened("raw"))
    got = {r["job"]: r["flat"] for r in df.collect()}
    assert got["j"] == {"a.b": "1", "t": "x; y", "o[0].p": "true", "o[1].p": 'q, "r"'}
    assert got["k"] == got["l"] == {}
    G.write_csv(df, "flat", ["job"], str(tmp_path / "csv"))
    lines = [r for p in glob.glob(str(tmp_path / "csv/*.csv")) for r in csv.DictReader(open(p), escapechar=None)]
    assert {r["job"] for r in lines} == {"j", "k", "l"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("world")
    meta = files.object_metadata(spark, str(tmp_path))
    assert sorted(r["size"] for r in meta.collect()) == [5, 5]
    assert files.object_contents(spark, str(tmp_path)).where("md5_hash = md5('hello')").count() == 1
    at = {r["path"].rsplit("/", 1)[1]: r["path"] for r in meta.collect()}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "bad.txt").write_bytes(b"\xff\xfe broken")
    bad = at["b.txt"].replace("b.txt", "sub/bad.txt")
    rows = [("j", 1, at["b.txt"], "", "b.txt", "1"), ("j", 0, at["a.txt"], "D", "x", "2"), ("j", 2, bad, "D", "x", "3"), ("j", 3, at["a.txt"] + "gone", "D", "x", "4"), ("j", 4, at["a.txt"], None, None, "9"), ("k", 0, bad, "D", "x", "5"), ("k", 1, None, "D", "x", "6")]
    items = spark.createDataFrame(rows, "job string, position int, path string, description string, filename string, context_id string")
    got = {r["job"]: r["context"] for r in files.context_text(spark, items, str(tmp_path)).collect()}
    assert got == {"j": "=== D ===\nhello\n\n=== Context file: b.txt ===\nworld\n\n=== Context file: context_9.txt ===\nhello", "k": ""}
    there = files.with_existence(items.select("context_id", "path"), files.object_metadata(spark, str(tmp_path)))
    assert {r["context_id"]: r["exists"] for r in there.collect()} == {"1": True, "2": True, "3": True, "4": False, "5": True, "6": False, "9": True}
    audio = spark.createDataFrame([(base64.b64encode(b"abc").decode(),)], "a string").select(files.decoded_audio(F.col("a"))).first()[0]
    assert bytes(audio) == b"abc"


def test_object_source(spark, tmp_path):
    objects.register(spark)
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    made = {"top.mp4": b"video", "a/x.TXT": b"text", "a/deep/y": b"", "a/deep/z.json": b"{}" * 600_000}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "a" / "broken.png").symlink_to(tmp_path / "nowhere")
    df = spark.read.format("objects").option("path", str(tmp_path)).option("md5", "true").load()
    got = {r["path"].split(f"{tmp_path}/")[1]: r for r in df.collect()}
    assert got.keys() - {"a/broken.png"} == made.keys()  # a link to nothing is no object, or one with an error
    assert {k: (r["size"], r["md5_hash"], r["error"]) for k, r in got.items() if k in made} == {k: (len(d), hashlib.md5(d).hexdigest(), None) for k, d in made.items()}
    assert (got["top.mp4"]["content_type"], got["a/x.TXT"]["content_type"], got["a/deep/y"]["content_type"]) == ("video/mp4", "text/plain", "application/octet-stream")
    assert all(r["updated"] is not None for r in got.values()) and df.rdd.getNumPartitions() == 3
    one = spark.read.format("objects").option("path", f"file://{tmp_path}/top.mp4").load().collect()
    assert [(r["size"], r["md5_hash"]) for r in one] == [(5, None)]
    assert spark.read.format("objects").option("path", str(tmp_path / "none")).load().count() == 0


def test_scalars_at_their_edges(spark):
    df = spark.createDataFrame([("\t x\n",), ("é",), ("a" * 200,), ("a" * 201,), ("",), (None,)], "t string")
    got = df.select(S.strip(F.col("t")), S.is_ascii(F.col("t")), F.length(S.preview(F.col("t"))), S.is_blank(F.col("t"))).collect()
    assert got[0][0] == "x" and got[1][1] is False
    assert [got[2][2], got[3][2]] == [200, 203]
    assert [r[3] for r in got] == [False, False, False, False, True, True]


def test_admission_of_one_crowded_user_streams(spark):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    times = [(k * k * 7919 % 1000) + (k // 200) * 1500 for k in range(2000)]
    data = [("hot" if k % 5 else "cold", k, t) for k, t in enumerate(times)]
    table = spark.createDataFrame(data, "u string, id long, s long").withColumn("at", F.timestamp_seconds("s"))
    want = set()
    for u in ("hot", "cold"):
        own = sorted((t, k) for v, k, t in data if v == u)
        want |= {(u, k, ok) for (_, k), ok in zip(own, A.admit([t for t, _ in own], 3, 300)[0], strict=True)}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = A.admission(table, ["u"], "at", "id", 3, 300)
        assert set(map(tuple, got.collect())) == want
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # no group as one frame
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_admission_without_a_time(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 10), ("a", 3, None), ("a", 4, 11), ("a", 5, 12)], "u string, id long, s long").withColumn("at", F.timestamp_seconds("s"))
    assert {r["id"]: r["accepted"] for r in A.admission(rows, ["u"], "at", "id", 2, 60).collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}
    assert A.admission(rows.limit(0), ["u"], "at", "id", 2, 60).count() == 0


def test_lifecycle_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 3)
    states = list(J.TRANSITIONS)
    data = [(f"u{u}", k, states[(k * k + u * k + u) % 7 % 6]) for u in range(12) for k in range(40)]
    want = []
    for u in range(12):
        now, steps = "pending", 0
        for _, _, asked in (x for x in data if x[0] == f"u{u}"):
            steps += asked in J.TRANSITIONS[now]
            now = J.next_status(now, asked)
        want.append((f"u{u}", now, steps))
    assert rows(J.lifecycle(spark.createDataFrame(data, "k string, s int, st string"), "k", "s", "st")) == sorted(want, key=repr)
