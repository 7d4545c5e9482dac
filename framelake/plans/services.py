"""Queries of whole services: admission by client, export by scene, sync into the index, search with answers, and snapshots.

Results are documents, whose analyses are JSON texts that Spark parses and that the SQL reads with its own JSON functions; videos are pages, jobs conversations.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators import admission as A
from ..operators import index_sync as X
from ..operators import providers as U
from ..operators import relations as R
from ..operators import search as V
from ..operators import segments as G
from ..operators import snapshots as N
from ..sources.shared import new_path
from ..streaming import lazy as L
from .catalog import query, read
from .composites import stripped

ACCEPTED = """
    WITH RECURSIVE q AS (SELECT event_id, event_type, ts, CASE event_id % 3 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'h' || (user_id % 5) ELSE 'unknown' END AS ip, epoch_us(ts) AS t FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY ip, event_type ORDER BY ts, event_id) AS i FROM q),
    s AS (SELECT event_id, ip, event_type, ts, i, true AS accepted, [t] AS kept FROM r WHERE i = 1
          UNION ALL
          SELECT r.event_id, r.ip, r.event_type, r.ts, r.i, len(list_filter(s.kept, lambda x: x >= r.t - 3600000000)) < 2,
                 CASE WHEN len(list_filter(s.kept, lambda x: x >= r.t - 3600000000)) < 2 THEN list_append(list_filter(s.kept, lambda x: x >= r.t - 3600000000), r.t) ELSE list_filter(s.kept, lambda x: x >= r.t - 3600000000) END
          FROM s JOIN r ON r.ip = s.ip AND r.event_type = s.event_type AND r.i = s.i + 1)"""


@query("q81_client_admission", f"{ACCEPTED} SELECT event_id, ip AS client_ip, accepted, CASE WHEN accepted THEN ts + INTERVAL 60 MINUTES END AS expires, CASE WHEN NOT accepted THEN 3600 END AS retry_after FROM s")
def client_admission(spark: SparkSession, d: str) -> DataFrame:
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    rows = read(spark, d, "events").select("event_id", "event_type", "ts", F.when(k == 0, F.concat(F.lit(" u"), u, F.lit(" , proxy"))).alias("forwarded"), F.when(k == 1, F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string"))).alias("host"))
    return A.client_admission(rows, "forwarded", "host", "event_type", "ts", "event_id", 2, 60).select("event_id", "client_ip", "accepted", "expires", "retry_after")


def scene_results(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a conversation with none, one or two scenes of different fields."""
    t, n = F.char_length("text"), (F.col("conv_id") + F.col("turn")) % 3
    kind = "struct<start_time:double,end_time:int,summary:string,timestamp:int,tags:array<array<bigint>>>"
    first = F.struct((t % 20 + 0.5).alias("start_time"), (t % 20 + 7).alias("end_time"), F.col("text").alias("summary"), F.lit(None).cast("int").alias("timestamp"), F.lit(None).cast("array<array<bigint>>").alias("tags"))
    second = F.struct(F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("int").alias("end_time"), F.lit(None).cast("string").alias("summary"), (t % 9).alias("timestamp"), F.array(F.array(F.col("turn"), F.lit(1).cast("long")), F.array(F.lit(2).cast("long"))).alias("tags"))
    scenes = F.slice(F.array(first.cast(kind), second.cast(kind)), F.lit(1), n.cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.col("turn").alias("chunk_index"), F.col("role").alias("genre"), scenes.alias("scenes"))).alias("raw"))


CELL = "CASE WHEN regexp_matches(x, '[,\"\\n]') THEN '\"' || replace(x, '\"', '\"\"') || '\"' ELSE x END"


@query("q82_scene_csv", f"""
    WITH c AS (SELECT conv_id, role, turn, text, length(text) AS t, (conv_id + turn) % 3 AS n, 30 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS a FROM conversations),
    s AS (SELECT conv_id, a, 0 AS i, ['', '', '', '', ''] AS f, MAP {{'genre': role, 'scenes': ''}} AS m FROM c WHERE n = 0
      UNION ALL SELECT conv_id, a, 0, ['0', (a + t % 20) || '.5', '' || (a + t % 20 + 7), (t % 20) || '.5', '' || (t % 20 + 7)], MAP {{'start_time': (t % 20) || '.5', 'end_time': '' || (t % 20 + 7), 'summary': text}} FROM c WHERE n > 0
      UNION ALL SELECT conv_id, a, 1, ['1', '' || (a + t % 9), '', '' || (t % 9), ''], MAP {{'timestamp': '' || (t % 9), 'tags[0].0': '' || turn, 'tags[0].1': '1', 'tags[1].0': '2'}} FROM c WHERE n = 2),
    k AS (SELECT conv_id, list_sort(list_distinct(flatten(list(map_keys(m))))) AS ks FROM s GROUP BY conv_id)
    SELECT conv_id, 0::BIGINT AS line_no, '{",".join(G.SCENE_COLUMNS)},' || list_aggregate(ks, 'string_agg', ',') AS line FROM k
    UNION ALL SELECT s.conv_id, row_number() OVER (PARTITION BY s.conv_id ORDER BY a, i),
      list_aggregate(list_transform(list_concat(['' || (a // 30), '' || a, '' || (a + 30)], f, list_transform(ks, lambda x: coalesce(m[x], ''))), lambda x: {CELL}), 'string_agg', ',') FROM s JOIN k USING (conv_id)""")
def scene_csv(spark: SparkSession, d: str) -> DataFrame:
    return G.scene_csv(scene_results(spark, d), "conv_id", "turn", "raw", 30.0)


def analyses(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their analysis as JSON; German ones have a text that is none."""
    scene = F.struct(
        F.lit(" first ").alias("summary"), F.array(F.struct(F.col("source").alias("label")), F.struct(F.lit("Person 1").alias("label"))).alias("people"), F.struct(F.col("source").alias("tone")).alias("mood"), F.struct(F.col("lang").alias("location")).alias("setting"),
    )
    raw = F.to_json(F.struct(F.col("lang").alias("genre"), F.col("source").alias("type"), F.col("text").alias("chunk_summary"), F.col("n_chars").alias("chunk_index"), F.array(scene).alias("scenes"), F.array(F.lit(" seen "), F.lit("\t")).alias("notable_observations")))
    return read(spark, d, "documents").select("doc_id", "lang", "source", "text", "n_chars", F.when(F.col("lang") == "de", F.col("text")).otherwise(raw).alias("raw"))


RAW = """json_object('genre', lang, 'type', source, 'chunk_summary', text, 'chunk_index', n_chars, 'scenes', json_array(json_object('summary', ' first ', 'people', json_array(json_object('label', source), json_object('label', 'Person 1')),
    'mood', json_object('tone', source), 'setting', json_object('location', lang))), 'notable_observations', json_array(' seen ', chr(9)))"""
PARSED = f"""a AS (SELECT *, {RAW} AS j FROM documents),
    p AS (SELECT doc_id, lang, n_chars, j::VARCHAR AS raw, j->>'genre' AS genre, j->>'type' AS kind, j->>'chunk_summary' AS summary, j->>'$.scenes[0].mood.tone' AS mood, j->>'$.scenes[0].setting.location' AS place, j->>'$.scenes[0].people[0].label' AS who,
      (j->>'chunk_index')::BIGINT AS chunk_index FROM a),
    t AS (SELECT p.*, quality, toxic, concat_ws(' ', 'Genre: ' || {stripped('genre')}, 'Type: ' || {stripped('kind')}, CASE WHEN summary <> '' THEN 'Summary: ' || {stripped('summary')} END, 'Mood: ' || mood, 'Setting: ' || place, 'first', 'Actor: ' || who, 'seen') AS text_content
      FROM p LEFT JOIN labels USING (doc_id))"""


def stored_results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, videos, asked keys by document): stored states come from labels."""
    state = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "pending")
    i = F.col("doc_id").cast("string")
    rows = analyses(spark, d).join(read(spark, d, "labels"), "doc_id", "left").select(
        i.alias("result_id"), F.when(F.col("lang") != "fr", F.concat(F.lit("v"), i)).alias("video_id"), F.concat(F.lit("j"), i).alias("scene_job_id"), F.lit(None).cast("long").alias("chunk_index"), F.lit("0").alias("timestamp_start"),
        F.col("n_chars").cast("string").alias("timestamp_end"), F.col("raw").alias("result_data"), state.alias("bq_sync_status"), F.lit(None).cast("string").alias("bq_sync_error"),
    )
    k = F.col("page_id").cast("string")
    videos = read(spark, d, "pages").select(F.concat(F.lit("v"), k).alias("video_id"), F.col("url").alias("filename"), F.concat(F.lit("gs://b/"), k).alias("gcs_path"))
    return rows, videos, rows.select("result_id")


def two_batches(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """(where the index lies, results): all results, then good ones once more, then the first batch again, which changes nothing."""
    root = new_path(spark, "index")
    results, videos, asked = stored_results(spark, d)
    X.sync_batch(spark, root, 1, asked, results, videos)
    X.sync_batch(spark, root, 2, read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("result_id")), results, videos, resync=True)
    X.sync_batch(spark, root, 1, asked, results, videos)
    return root, results


@query("q83_synced_index", f"""
    WITH {PARSED} SELECT doc_id::VARCHAR AS result_id, CASE WHEN lang <> 'fr' THEN 'v' || doc_id ELSE '' END AS video_id, CASE WHEN lang <> 'fr' THEN coalesce(url, '') END AS video_filename, 'j' || doc_id AS scene_job_id, chunk_index, text_content,
      '0' AS timestamp_start, n_chars::VARCHAR AS timestamp_end, raw AS result_data_json, CASE WHEN lang <> 'fr' THEN CASE WHEN page_id IS NULL THEN '' ELSE 'gs://b/' || page_id END END AS gcs_path
    FROM t LEFT JOIN pages ON page_id = doc_id WHERE lang <> 'de' AND NOT coalesce(quality = 0 AND toxic = 0, false)""")
def synced_index(spark: SparkSession, d: str) -> DataFrame:
    return X.index_now(spark, two_batches(spark, d)[0])


@query("q84_synced_states", """
    SELECT doc_id::VARCHAR AS result_id, CASE WHEN lang = 'de' AND NOT coalesce(quality = 0 AND toxic = 0, false) THEN 'error' ELSE 'pending' END AS bq_sync_status,
      CASE WHEN lang = 'de' AND NOT coalesce(quality = 0 AND toxic = 0, false) THEN 'Result ' || doc_id || ': result_data is no JSON object' END AS bq_sync_error FROM documents LEFT JOIN labels USING (doc_id)""")
def synced_states(spark: SparkSession, d: str) -> DataFrame:
    root, results = two_batches(spark, d)
    return X.states_now(spark, root, results)


@query("q85_sync_errors", """
    SELECT unnest([CASE WHEN NOT known THEN 'Result ' || k || ' not found' WHEN lang = 'de' AND NOT coalesce(quality = 0 AND toxic = 0, false) AND NOT coalesce(quality = 1 AND toxic = 0, false) THEN 'Result ' || k || ': result_data is no JSON object' END]) AS error
    FROM (SELECT k, d.doc_id IS NOT NULL AS known, lang, quality, toxic FROM (SELECT doc_id AS k FROM documents UNION ALL SELECT doc_id FROM labels UNION ALL SELECT -doc_id - 1 FROM documents) LEFT JOIN documents d ON d.doc_id = k LEFT JOIN labels l ON l.doc_id = k)
    WHERE NOT known OR (lang = 'de' AND NOT coalesce(quality = 0 AND toxic = 0, false) AND NOT coalesce(quality = 1 AND toxic = 0, false))""")
def sync_errors(spark: SparkSession, d: str) -> DataFrame:
    results, videos, asked = stored_results(spark, d)
    more = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("result_id")).unionByName(read(spark, d, "documents").select((-F.col("doc_id") - 1).cast("string").alias("result_id")))
    return X.errors(X.sync_batch(spark, new_path(spark, "index"), 1, asked.unionByName(more), results, videos))


@query("q86_snapshot_and_log", "SELECT user_id, value FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, value FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND op <> 'delete'")
def snapshot_and_log(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of earlier parts of the log, and the log since."""
    log = read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), "value")
    of, path, name = N.Log("user_id", "event_id"), new_path(spark, "snapshots"), f"users_{uuid.uuid4().hex}"
    for upto in log.agg(F.percentile_approx("event_id", [0.4, 0.8])).first()[0] or []:
        N.compact(spark, path, name, log, of, buckets=spark.sparkContext.defaultParallelism, upto=upto)
    return N.current(spark, path, log, of)


@query("q87_search_many", """
    WITH n AS (SELECT q.vec_id AS query_id, i.vec_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings i WHERE q.label IN (0, 1))
    SELECT * FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 20) WHERE distance < 1.1""")
def search_many(spark: SparkSession, d: str) -> DataFrame:
    index = read(spark, d, "embeddings")
    return V.vector_search_many(index, index.where("label in (0, 1)").withColumnRenamed("vec_id", "query_id"))


def translated(texts: pd.Series) -> pd.Series:
    """Stands for a model that interprets queries."""
    return texts.map(lambda t: f"a text of {len(t)} characters")


def searches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(queries, hits): a query for each nation, with the text and vector of its number."""
    asked = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"))
    vectors = read(spark, d, "embeddings")
    texts = V.interpreted(asked.join(read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text"), "query_id"), "text", translated)
    hits = V.vector_search_many(vectors, asked.join(vectors.withColumnRenamed("vec_id", "query_id"), "query_id"))
    return texts, hits.join(vectors.select("vec_id", "label"), "vec_id").withColumn("doc_id", F.col("vec_id"))


HITS = """h AS (SELECT n_nationkey::BIGINT AS query_id, i.vec_id, i.label, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS distance FROM nation JOIN embeddings q ON q.vec_id = n_nationkey, embeddings i
      QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY distance, i.vec_id) <= 20),
    b AS (SELECT query_id, label, arg_min(vec_id, (distance, vec_id)) AS best, min(distance) AS score, count(*) AS chunk_count FROM h WHERE distance < 1.1 GROUP BY ALL)"""


@query("q88_video_search", f"""
    WITH {PARSED}, {HITS}
    SELECT query_id, label, best, score, chunk_count, CASE WHEN lang = 'de' THEN '' ELSE text_content[1:500] END AS top_match_text, CASE WHEN lang <> 'de' THEN nullif(summary, '') END AS description, CASE WHEN lang <> 'de' THEN genre END AS genre,
      CASE WHEN lang <> 'de' THEN kind END AS content_type, CASE WHEN lang <> 'de' THEN mood END AS mood, CASE WHEN lang <> 'de' THEN place END AS setting, CASE WHEN lang <> 'de' THEN who END AS actors
    FROM b LEFT JOIN t ON doc_id = best""")
def video_search(spark: SparkSession, d: str) -> DataFrame:
    best = V.by_asset(searches(spark, d)[1], "query_id", "label", "vec_id", []).withColumnRenamed("vec_id", "best")
    found = analyses(spark, d).join(best.select(F.col("best").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("parsed", D.parse(F.col("raw")))
    of = found.select(F.col("doc_id").alias("best"), F.substring(D.embedding_text(F.col("parsed"), F.col("raw")), 1, V.TEXT_LIMIT).alias("top_match_text"), D.metadata(F.col("parsed")).alias("m"))
    out = best.join(of, "best", "left")
    return out.select("query_id", "label", "best", "score", "chunk_count", "top_match_text", "m.description", "m.genre", "m.content_type", "m.mood", "m.setting", F.array_join("m.actors", ",").alias("actors"))


def curated(text: str, found: list[dict]) -> dict:
    """Stands for a model that curates hits, and fails for every text of odd length."""
    if len(text) % 2:
        raise TimeoutError
    return {"response_text": f"{len(found)} for a text of {len(text)}", "recommendations": [{"video_id": found[-1]["video_id"], "title": "last", "reason": "the farthest", "confidence": 0.25}]}


@query("q89_search_answers", f"""
    WITH {HITS}, q AS (SELECT n_nationkey::BIGINT AS query_id, text, {stripped('text')} AS s, strlen(text) = length(text) AS simple FROM nation JOIN documents ON doc_id = n_nationkey),
    x AS (SELECT query_id, CASE WHEN simple THEN s ELSE 'a text of ' || length(text) || ' characters' END AS search_text, CASE WHEN NOT simple THEN 'a text of ' || length(text) || ' characters' END AS interpreted_query FROM q),
    f AS (SELECT query_id, count(*) AS n, arg_max(vec_id, (distance, vec_id)) AS last, arg_min(vec_id, (distance, vec_id)) AS first, min(distance) AS d FROM h WHERE distance < 1.1 GROUP BY query_id)
    SELECT query_id, interpreted_query, CASE WHEN n IS NULL THEN 'No results found for your search query.' WHEN length(search_text) % 2 = 0 THEN n || ' for a text of ' || length(search_text)
        ELSE 'Found ' || n || ' result(s) matching "' || search_text || '". Showing raw results (AI curation unavailable).' END AS response_text,
      CASE WHEN n IS NULL THEN 0 WHEN length(search_text) % 2 = 0 THEN 1 ELSE least(n, 10) END::INT AS recommended, CASE WHEN length(search_text) % 2 = 0 THEN last ELSE first END::VARCHAR AS video_id,
      CASE WHEN length(search_text) % 2 = 0 THEN 'last' ELSE coalesce(url, 'Untitled') END AS title, CASE WHEN length(search_text) % 2 = 0 THEN 0.25 ELSE round(greatest(0, 1 - d), 6) END::DOUBLE AS confidence
    FROM x LEFT JOIN f USING (query_id) LEFT JOIN pages ON page_id = first""")
def search_answers(spark: SparkSession, d: str) -> DataFrame:
    texts, hits = searches(spark, d)
    named = hits.join(read(spark, d, "pages").select(F.col("page_id").alias("vec_id"), F.col("url").alias("filename")), "vec_id", "left").withColumn("path", F.lit("gs://b"))
    answers = V.answered(texts, named, "query_id", "search_text", "vec_id", "filename", "path", curated)
    first = F.get("recommendations", F.lit(0))
    out = answers.join(texts.select("query_id", "interpreted_query"), "query_id")
    return out.select("query_id", "interpreted_query", "response_text", F.size("recommendations").alias("recommended"), first["video_id"].alias("video_id"), first["title"].alias("title"), first["confidence"].alias("confidence"))


@query("q90_lazy_embeddings", f"""
    SELECT doc_id, CASE WHEN {stripped("coalesce(text, '')")} = '' THEN 'error' ELSE 'ready' END AS sync_status, true AS changed, CASE WHEN {stripped("coalesce(text, '')")} <> '' THEN 64 END AS dimensions FROM documents""")
def lazy_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """All documents appended, their vectors filled in by the stream, and what a reader then sees."""
    rows, out, checkpoint = (new_path(spark, x) for x in ("appended", "vectors", "checkpoint"))
    docs = read(spark, d, "documents").select("doc_id", "text", F.lit("pending").alias("state"))
    L.append(docs, 0, rows, "doc_id")
    q = L.enrich_stream(spark, rows, "doc_id bigint, text string, state string", "doc_id", "text", out, checkpoint, availableNow=True)
    q.awaitTermination()
    seen = L.refreshed(spark, docs, out, "doc_id", "state")
    return seen.join(L.vectors(spark, out, "doc_id", "bigint"), "doc_id", "left").select("doc_id", F.col("shown").alias("sync_status"), "changed", F.size("embedding").alias("dimensions"))


@query("q91_recent_requests", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 2880 MINUTES")
def recent_requests(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    return R.recent(e, {"event_type": "click", "user_id": None}, "ts", F.lit(now).cast(e.schema["ts"].dataType), 2880).select("event_id", "user_id")


def adapt(request: dict, digest: str) -> str:
    """Stands for a model that adapts images, and knows no ratio ``odd``."""
    if request["aspect_ratio"] == "odd":
        raise ValueError("ratio")
    return f'{{"input": {len(request["c_name"])}, "output": {len(request["aspect_ratio"])}}}'


@query("q92_image_adapts", """
    WITH j AS (SELECT c_custkey, c_name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['1:1', '16:9'] WHEN 'BUILDING' THEN ['9:16', '9:16', 'odd'] WHEN 'MACHINERY' THEN ['odd'] WHEN 'FURNITURE' THEN [] END AS ratios FROM customer),
    r AS (SELECT c_custkey, unnest(ratios) AS ratio FROM j)
    SELECT c_custkey, coalesce(sum(CASE WHEN ratio <> 'odd' THEN length(c_name) END), 0)::BIGINT AS input_tokens, coalesce(sum(CASE WHEN ratio <> 'odd' THEN length(ratio) END), 0)::BIGINT AS output_tokens, count(*) FILTER (ratio <> 'odd') AS answered,
      count(*) FILTER (ratio = 'odd') AS failed, CASE WHEN count(*) FILTER (ratio <> 'odd') = 0 AND count(*) FILTER (ratio = 'odd') > 0 THEN 'failed' ELSE 'completed' END AS status FROM j LEFT JOIN r USING (c_custkey) GROUP BY c_custkey""")
def image_adapts(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"AUTOMOBILE": ["1:1", "16:9"], "BUILDING": ["9:16", "9:16", "odd"], "MACHINERY": ["odd"], "FURNITURE": []}
    ratios = F.lit(None).cast("array<string>")
    for segment, xs in kinds.items():
        ratios = F.when(F.col("c_mktsegment") == segment, F.array(*[F.lit(x) for x in xs]).cast("array<string>")).otherwise(ratios)
    jobs = read(spark, d, "customer").select("c_custkey", "c_name", ratios.alias("ratios"))
    used = lambda a: (F.get_json_object(a, "$.input").cast("long"), F.get_json_object(a, "$.output").cast("long"))
    return U.adapted(jobs, "c_custkey", "ratios", ["c_name"], adapt, new_path(spark, "adapts"), used)[1]
