"""Queries made of several operators, as a user asks them, each with SQL for an independent engine.

Results are documents, their jobs labels, assets pages and customers, chunks conversations, requests events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import scalars as S
from ..operators import relations as R
from ..operators import scans
from ..operators import search as V
from ..operators import segments as G
from ..streaming import jobs as J
from .catalog import NEAR, hits, query, read

SPACES = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def stripped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACES}+', ''), '{SPACES}+$', '')"


def results(spark: SparkSession, d: str) -> DataFrame:
    """Scene results: result_id, job, own type, stored state, analysis as a struct and as JSON."""
    i = F.col("doc_id")
    analysis = F.struct(
        F.when(i % 3 == 0, F.col("lang")).alias("genre"), F.when(i % 4 == 1, F.concat(F.lit(" "), F.col("source"), F.lit("\t"))).alias("type"), F.lit(None).cast("string").alias("content_type"), F.when(i % 5 == 2, "").alias("category"),
        F.lit(None).cast("string").alias("sub_category"), F.when(i % 2 == 0, F.col("text")).alias("chunk_summary"),
        F.when(i % 7 == 3, F.array(
            F.struct(F.array(*[F.struct(F.lit(x).alias("label")) for x in ("Ann", "Person 1", "Bo")]).alias("people"), F.struct(F.lit("calm").alias("tone"), F.when(i % 2 == 0, "low").alias("energy")).alias("mood"), F.struct(F.when(i % 4 != 0, F.col("lang")).alias("location")).alias("setting"), F.lit(" first ").alias("summary")),
            F.struct(F.array(*[F.struct(F.lit(x).alias("label")) for x in ("Bo", "", "Cy")]).alias("people"), F.lit(None).cast("struct<tone:string,energy:string>").alias("mood"), F.lit(None).cast("struct<location:string>").alias("setting"), F.lit(None).cast("string").alias("summary")),
        )).alias("scenes"),
        F.when(i % 6 == 5, F.array(F.lit(" seen "), F.lit("\t"))).alias("notable_observations"),
    )
    raw = F.to_json(F.struct(F.struct(F.col("source").alias("b"), F.lit("hidden").alias("gcs_path"), F.array(F.lit(" x "), F.lit("")).alias("c")).alias("z"), F.col("n_chars").alias("n"), F.col("lang").alias("a")))
    return read(spark, d, "documents").select(
        i, "lang", "source", F.when(i % 4 == 0, "scene_analysis").when(i % 4 == 1, "subtitling").alias("own"), F.when(i % 5 != 0, F.element_at(F.array(*[F.lit(x) for x in ("", "pending", "ready", "error")]), (i % 5).cast("int"))).alias("state"),
        analysis.alias("analysis"), raw.alias("raw"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(secs=(i * 1001 + F.when(i % 2 == 0, F.lit("0.25").cast("decimal(8,6)")).otherwise(F.lit(0).cast("decimal(8,6)"))).cast("decimal(18,6)"))).alias("created"),
    )


def result_jobs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "completed").otherwise("pending").alias("status"), F.when(F.col("doc_id") % 3 == 0, "custom").otherwise("other").alias("job_type"))


TEXT = f"""
    text_of AS (SELECT doc_id, lang, source, n_chars, text,
      nullif(concat_ws(' ', CASE WHEN doc_id % 3 = 0 AND {stripped('lang')} <> '' THEN 'Genre: ' || {stripped('lang')} END, CASE WHEN doc_id % 4 = 1 AND {stripped('source')} <> '' THEN 'Type: ' || {stripped('source')} END,
        CASE WHEN doc_id % 2 = 0 AND text <> '' THEN 'Summary: ' || {stripped('text')} END, CASE WHEN doc_id % 7 = 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'Mood: calm low' ELSE 'Mood: calm' END END,
        CASE WHEN doc_id % 7 = 3 AND doc_id % 4 <> 0 THEN 'Setting: ' || lang END, CASE WHEN doc_id % 7 = 3 THEN 'first Actor: Ann Actor: Bo Actor: Cy' END, CASE WHEN doc_id % 6 = 5 THEN 'seen' END), '') AS got FROM documents),
    texts AS (SELECT doc_id, lang, source, n_chars, coalesce(got, concat_ws(' ', nullif({stripped('source')}, ''), 'x', nullif({stripped('lang')}, ''))) AS text_content FROM text_of)"""


@query("q34_embedding_text", f"WITH {TEXT} SELECT doc_id, text_content FROM texts")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("doc_id", D.embedding_text(F.col("analysis"), F.col("raw")).alias("text_content"))


@query("q51_metadata", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN nullif(text, '') END AS description, CASE WHEN doc_id % 3 = 0 THEN nullif(lang, '') END AS genre, CASE WHEN doc_id % 4 = 1 THEN ' ' || source || chr(9) END AS content_type,
           CASE WHEN doc_id % 7 = 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'calm low' ELSE 'calm' END END AS mood, CASE WHEN doc_id % 7 = 3 AND doc_id % 4 <> 0 THEN nullif(lang, '') END AS setting, CASE WHEN doc_id % 7 = 3 THEN 'Ann,Bo,Cy' END AS actors FROM documents""")
def metadata(spark: SparkSession, d: str) -> DataFrame:
    m = results(spark, d).select("doc_id", D.metadata(F.col("analysis")).alias("m"))
    return m.select("doc_id", "m.description", "m.genre", "m.content_type", "m.mood", "m.setting", F.array_join("m.actors", ",").alias("actors"))


STATE = "CASE doc_id % 5 WHEN 1 THEN '' WHEN 2 THEN 'pending' WHEN 3 THEN 'ready' WHEN 4 THEN 'error' END"
ELIGIBLE = """coalesce(status, '') NOT IN ('archived', 'failed') AND CASE WHEN own IS NOT NULL THEN own IN ('scene_analysis', 'custom') ELSE coalesce(status = 'completed' AND job_type IN ('scene_analysis', 'custom'), false) END"""


@query("q54_sync_status", f"""
    WITH {TEXT}, r AS (SELECT *, {STATE} AS state, CASE doc_id % 4 WHEN 0 THEN 'scene_analysis' WHEN 1 THEN 'subtitling' END AS own FROM texts),
    j AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'custom' ELSE 'other' END AS job_type FROM labels)
    SELECT r.doc_id, coalesce(url, '') AS filename, CASE WHEN state = 'pending' AND v.vec_id IS NOT NULL THEN CASE WHEN vec_id % 4 = 1 THEN 'error' WHEN vec_id % 3 <> 0 THEN 'ready' ELSE 'pending' END ELSE coalesce(nullif(state, ''), 'not_synced') END AS sync_status,
           CASE WHEN length(text_content) > 200 THEN text_content[1:200] || '...' ELSE text_content END AS text_preview, text_content,
           strftime(TIMESTAMP '2024-01-01' + to_microseconds(r.doc_id * 1001000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN r.doc_id % 2 = 0 THEN '.250000' ELSE '' END AS created_at
    FROM r LEFT JOIN j ON j.doc_id = r.doc_id LEFT JOIN pages ON page_id = r.doc_id LEFT JOIN embeddings v ON vec_id = r.doc_id WHERE {ELIGIBLE}""")
def sync_status(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).join(result_jobs(spark, d), "doc_id", "left").where(S.searchable(F.col("status"), F.col("job_type"), F.col("own")))
    v = F.col("vec_id")
    index = read(spark, d, "embeddings").select(v.alias("doc_id"), S.embedding_status(F.when(v % 3 != 0, F.size("embedding")), F.when(v % 4 == 1, "quota").otherwise("")).alias("fresh"))
    names = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("filename"))
    shown = J.promoted(rows, index, "doc_id", "state", "fresh").join(names, "doc_id", "left").withColumn("text_content", D.embedding_text(F.col("analysis"), F.col("raw")))
    return shown.select("doc_id", F.coalesce("filename", F.lit("")).alias("filename"), F.col("shown").alias("sync_status"), S.preview(F.col("text_content")).alias("text_preview"), "text_content", S.iso_time(F.col("created")).alias("created_at"))


@query("q55_search_with_metadata", f"""
    WITH {NEAR.format(where='')}, g AS (SELECT label, arg_min(vec_id, (distance, vec_id)) AS best, min(distance) AS score, count(*) AS chunk_count FROM near WHERE distance < 1.1 GROUP BY label)
    SELECT label, best, score, chunk_count, text[1:500] AS top_match_text, CASE WHEN best % 2 = 0 THEN nullif(text, '') END AS description, CASE WHEN best % 3 = 0 THEN nullif(lang, '') END AS genre,
           CASE WHEN best % 4 = 1 THEN ' ' || source || chr(9) END AS content_type, CASE WHEN best % 7 = 3 THEN CASE WHEN best % 2 = 0 THEN 'calm low' ELSE 'calm' END END AS mood, CASE WHEN best % 7 = 3 AND best % 4 <> 0 THEN nullif(lang, '') END AS setting,
           CASE WHEN best % 7 = 3 THEN 'Ann,Bo,Cy' END AS actors FROM g LEFT JOIN documents ON doc_id = best""")
def search_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    best = V.best_per_group(hits(spark, d), "label", "vec_id")  # at most as many rows as the search's limit
    keys = F.broadcast(best.select(F.col("best").alias("doc_id")))
    found = results(spark, d).join(keys, "doc_id", "left_semi").select(F.col("doc_id").alias("best"), D.metadata(F.col("analysis")).alias("m"))
    text = read(spark, d, "documents").join(keys, "doc_id", "left_semi").select(F.col("doc_id").alias("best"), F.substring("text", 1, 500).alias("top_match_text"))
    out = best.join(found, "best", "left").join(text, "best", "left")
    return out.select("label", "best", "score", "chunk_count", "top_match_text", "m.description", "m.genre", "m.content_type", "m.mood", "m.setting", F.array_join("m.actors", ",").alias("actors"))


@query("q56_assets_page", """
    WITH page AS (SELECT * FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment < 'F' THEN 'video/mp4' WHEN c_mktsegment < 'I' THEN 'audio/mpeg' ELSE 'image/png' END AS ct FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) WHERE ct LIKE 'video/%' OR ct LIKE 'audio/%')
    SELECT c_custkey, ct AS content_type, CASE WHEN ct LIKE 'audio/%' THEN 'audio' ELSE 'video' END AS source_type, count(o_orderkey) AS jobs, coalesce(bool_or(o_orderstatus = 'F' AND o_totalprice > 200000), false) AS has_compressed,
           coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS job_ids FROM page LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, ct""")
def assets_page(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") < "F", "video/mp4").when(F.col("c_mktsegment") < "I", "audio/mpeg").otherwise("image/png")
    page = R.newest(read(spark, d, "customer").select("c_custkey", "c_acctbal", kind.alias("content_type")), "c_acctbal", "c_custkey").where(S.is_media(F.col("content_type")))
    jobs = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").join(F.broadcast(page.select("c_custkey")), "c_custkey", "left_semi")  # a page of 50 keys
    nested = R.nest(page, jobs, "c_custkey", ["o_orderkey", "o_orderstatus", "o_totalprice"], "jobs")
    done = F.exists("jobs", lambda j: (j["o_orderstatus"] == "F") & (j["o_totalprice"] > 200000))
    ids = F.array_join(F.transform("jobs", lambda j: j["o_orderkey"].cast("string")), ",")
    return nested.select("c_custkey", "content_type", S.source_type(F.col("content_type")).alias("source_type"), F.size("jobs").cast("long").alias("jobs"), done.alias("has_compressed"), ids.alias("job_ids"))


@query("q57_prompts_with_counts", """
    SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END, 'Prompt ' || substr(c_custkey::VARCHAR, 1, 8)) AS name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'scene_analysis' END, 'custom') AS type,
           (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS jobs_count, coalesce(CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END, 'none') AS response_schema FROM customer""")
def prompts_with_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = S.prompt_name(F.when(k % 3 == 0, F.col("c_name")), F.when(k % 3 == 1, F.col("c_mktsegment")), k.cast("string"))
    prompts = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", name.alias("name"), F.coalesce(F.when(k % 2 == 0, "scene_analysis"), F.lit("custom")).alias("type"), "c_mktsegment")
    counted = R.with_count(R.newest(prompts, "c_acctbal", "c_custkey", n=None), read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "jobs_count")
    schemas = read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("has"))
    return counted.join(schemas, "c_nationkey", "left").select("c_custkey", "name", "type", "jobs_count", F.coalesce(F.when(F.col("has"), F.col("c_mktsegment")), F.lit("none")).alias("response_schema"))


def sync_parts(spark: SparkSession, d: str, resync: bool) -> tuple[DataFrame, DataFrame]:
    rows = results(spark, d).select("doc_id", "state", D.embedding_text(F.col("analysis"), F.col("raw")).alias("text_content"), D.serialised(F.struct("lang", "source")).alias("result_data_json"))
    index = rows.where(F.col("state").isin("pending", "ready")).select("doc_id", F.lit("old").alias("text_content"), F.lit(None).cast("string").alias("result_data_json"))
    asked = read(spark, d, "documents").select(F.explode(F.array(F.col("doc_id"), -F.col("doc_id") - 1)).alias("doc_id")).where("doc_id % 3 = 0")
    return R.synced(index, rows, asked, "doc_id", "state", resync)


@query("q58_index_after_sync", f"""
    WITH {TEXT} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text_content ELSE 'old' END AS text_content, CASE WHEN doc_id % 3 = 0 THEN '{{"lang":"' || lang || '","source":"' || source || '"}}' END AS result_data_json
    FROM texts WHERE doc_id % 3 = 0 OR doc_id % 5 IN (2, 3)""")
def index_after_sync(spark: SparkSession, d: str) -> DataFrame:
    return sync_parts(spark, d, resync=True)[0]


@query("q59_sync_report", """
    WITH asked AS (SELECT DISTINCT k FROM (SELECT doc_id AS k FROM documents UNION ALL SELECT -doc_id - 1 FROM documents) WHERE k % 3 = 0)
    SELECT count(*) FILTER (k IN (SELECT doc_id FROM documents)) AS synced_count, count(*) FILTER (k NOT IN (SELECT doc_id FROM documents)) AS errors FROM asked""")
def sync_report(spark: SparkSession, d: str) -> DataFrame:
    return R.sync_report(sync_parts(spark, d, resync=False)[1])


@query("q48_sync_actions", f"""
    SELECT k AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN d.doc_id % 5 IN (2, 3) THEN 'skip' ELSE 'insert' END AS action, CASE WHEN d.doc_id IS NULL THEN 'Result ' || k || ' not found' END AS error
    FROM (SELECT DISTINCT k FROM (SELECT doc_id AS k FROM documents UNION ALL SELECT -doc_id - 1 FROM documents) WHERE k % 3 = 0) LEFT JOIN documents d ON d.doc_id = k""")
def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    return sync_parts(spark, d, resync=False)[1]


def chunk_results(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with times: every third has a text for its start, every fourth no scenes."""
    t, i = F.char_length("text"), F.col("conv_id") + F.col("turn")
    start = F.when(i % 3 == 0, F.lit('"0:10"')).otherwise((t % 20 + 0.5).cast("string"))
    scenes = F.when(i % 4 == 0, F.lit("null")).otherwise(F.concat(F.lit('[{"start_time":'), start, F.lit(',"end_time":'), (t % 20 + 7).cast("string"), F.lit(',"mood":{"tone":null,"tags":["a",null,1.50]}}]')))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(F.lit('{"chunk_index":'), F.col("turn").cast("string"), F.lit(',"scenes":'), scenes, F.lit(',"role":"'), F.col("role"), F.lit('"}')).alias("raw"))


@query("q60_timed_scenes", """
    WITH c AS (SELECT conv_id, turn, length(text) AS t, (conv_id + turn) AS i, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS p FROM conversations)
    SELECT conv_id, turn, p::VARCHAR AS result_id, CASE WHEN i % 4 <> 0 AND i % 3 <> 0 THEN p * 30 + t % 20 + 0.5 END::DOUBLE AS video_start, CASE WHEN i % 4 <> 0 THEN p * 30 + t % 20 + 7 END::DOUBLE AS video_end,
           (p * 30 + 30)::DOUBLE AS chunk_end, CASE WHEN i % 4 <> 0 AND i % 3 <> 0 THEN t % 20 + 0.5 END::DOUBLE AS chunk_start FROM c""")
def timed_scenes(spark: SparkSession, d: str) -> DataFrame:
    rows = G.sequential(chunk_results(spark, d), "conv_id", "turn", "raw", 30.0)
    at = lambda p: F.get_json_object("raw", p).cast("double")
    return rows.select("conv_id", "turn", "result_id", at("$.scenes[0].video_start_time").alias("video_start"), at("$.scenes[0].video_end_time").alias("video_end"), at("$.chunk_metadata.video_timestamp_end").alias("chunk_end"), at("$.scenes[0].chunk_start_time").alias("chunk_start"))


@query("q39_flattened", """
    SELECT conv_id, turn, role, CASE WHEN i % 4 = 0 THEN NULL WHEN i % 3 = 0 THEN '0:10' ELSE (t % 20)::VARCHAR || '.5' END AS "scenes[0].start_time", CASE WHEN i % 4 <> 0 THEN (t % 20 + 7)::VARCHAR END AS "scenes[0].end_time",
           CASE WHEN i % 4 <> 0 THEN '' END AS "scenes[0].mood.tone", CASE WHEN i % 4 <> 0 THEN 'a; 1.5' END AS "scenes[0].mood.tags", CASE WHEN i % 4 = 0 THEN '' END AS scenes, NULL::VARCHAR AS chunk_index
    FROM (SELECT conv_id, turn, role, length(text) AS t, conv_id + turn AS i FROM conversations)""")
def flattened(spark: SparkSession, d: str) -> DataFrame:
    flat = chunk_results(spark, d).select("conv_id", "turn", G.flattened("raw").alias("f"))
    return flat.select("conv_id", "turn", *[F.col("f")[k].alias(k) for k in ("role", "scenes[0].start_time", "scenes[0].end_time", "scenes[0].mood.tone", "scenes[0].mood.tags", "scenes", "chunk_index")])


@query("q40_key_union", "SELECT unnest(['role', 'scenes', 'scenes[0].end_time', 'scenes[0].mood.tags', 'scenes[0].mood.tone', 'scenes[0].start_time']) AS key")
def key_union(spark: SparkSession, d: str) -> DataFrame:
    return chunk_results(spark, d).select(F.explode(F.map_keys(G.flattened("raw"))).alias("key")).distinct().orderBy("key")


@query("q61_json_export", """
    SELECT conv_id, '{"job_id":"' || conv_id || '","video_id":"v' || conv_id || '","filename":"f.mp4","chunk_duration":30,"total_chunks":' || count(*) || ',"results":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']}' AS export
    FROM conversations GROUP BY conv_id""")
def json_export(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("turn", "role")).alias("raw"))
    return G.export_json(rows, "conv_id", F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("f.mp4"), "turn", "raw", 30)


@query("q62_settings", """
    SELECT p_partkey, CASE r WHEN '360p' THEN 360 WHEN '720p' THEN 720 WHEN '1080p' THEN 1080 WHEN '2160p' THEN 2160 ELSE 480 END AS height, CASE c WHEN 'mp3' THEN 'mp3' WHEN 'wav' THEN 'pcm_s16le' ELSE 'aac' END AS codec,
           CASE b WHEN '96k' THEN 96000 WHEN '320k' THEN 320000 ELSE 128000 END AS bits, CASE c WHEN 'aac' THEN 'm4a' ELSE c END AS container
    FROM (SELECT p_partkey, ['360p', '480p', '720p', '1080p', '2160p', '8k'][p_size % 7 + 1] AS r, ['aac', 'mp3', 'wav', 'flac'][p_size % 5 + 1] AS c, ['96k', '128k', '320k', '1k'][p_partkey % 5 + 1] AS b FROM part)""")
def settings(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs, at: F.get(F.array(*[F.lit(x) for x in xs]), at.cast("int"))
    p = read(spark, d, "part").select(
        "p_partkey", pick(("360p", "480p", "720p", "1080p", "2160p", "8k"), F.col("p_size") % 7).alias("r"), pick(("aac", "mp3", "wav", "flac"), F.col("p_size") % 5).alias("c"), pick(("96k", "128k", "320k", "1k"), F.col("p_partkey") % 5).alias("b"),
    )
    return p.select("p_partkey", S.height_of(F.col("r")).alias("height"), S.audio_codec(F.col("c")).alias("codec"), S.audio_bitrate(F.col("b")).alias("bits"), S.audio_container(F.col("c")).alias("container"))


NAMES = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.mp4' WHEN 2 THEN p_type || ' ' || p_name || '.tar.gz' ELSE 'a.' || repeat('e', p_size) END"


@query("q63_file_names", f"""
    WITH f AS (SELECT p_partkey, n, contains(n, '.') AS dotted, CASE WHEN contains(n, '.') THEN split_part(n, '.', -1) ELSE '' END AS ext, CASE WHEN contains(n, '.') THEN n[1:length(n) - length(split_part(n, '.', -1)) - 1] ELSE n END AS stem FROM (SELECT p_partkey, {NAMES} AS n FROM part))
    SELECT p_partkey, CASE WHEN length(n) <= 30 THEN n WHEN ext = '' THEN stem[1:27] || '...' WHEN 26 - length(ext) <= 0 THEN n[1:27] || '...'
             ELSE stem[1:ceil((26 - length(ext)) / 2.0)::INT] || '...' || right(stem, floor((26 - length(ext)) / 2.0)::INT) || '.' || ext END AS shown,
           CASE WHEN length(stem) > 12 THEN stem[1:4] || '...' || right(stem, 4) || CASE WHEN dotted THEN '.' || ext ELSE '' END ELSE n END AS compact,
           regexp_replace(n, '\\.[^/.]+$', '') || '_' || regexp_replace(n, '[^A-Za-z0-9]', '_', 'g') || '_2025-01-02-03-04-05.csv' AS export_name FROM f""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    n, now = F.col("n"), F.lit("2025-01-02 03:04:05").cast("timestamp_ntz")
    return read(spark, d, "part").select("p_partkey", F.expr(NAMES).alias("n")).select("p_partkey", S.shorten(n).alias("shown"), S.compact(n).alias("compact"), S.export_name(n, n, F.lit("x"), now, "csv").alias("export_name"))


@query("q64_times", """
    SELECT o_orderkey, floor(o_totalprice / 7)::BIGINT AS seconds, floor((o_totalprice / 7 - floor(o_totalprice / 7)) * 4)::BIGINT AS quarter, ceil(o_orderkey % 5000 / 60.0)::BIGINT AS retry_after, floor(o_orderkey % 1000 / 1000.0 * 100 + 0.5)::BIGINT AS percent,
           o_orderdate - INTERVAL 1440 MINUTES AS cutoff, o_orderdate + INTERVAL 1440 MINUTES AS ttl,
           CASE WHEN o_orderstatus = 'F' THEN CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END END AS elapsed
    FROM (SELECT *, o_orderkey * 37 % 9000 AS s FROM orders)""")
def times(spark: SparkSession, d: str) -> DataFrame:
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    sec = S.seconds_and_nanos(F.col("o_totalprice") / 7)
    end = F.col("o_orderdate") + F.make_interval(secs=(k * 37 % 9000).cast("decimal(18,6)"))
    return o.select(
        k, sec["seconds"].alias("seconds"), F.floor(sec["nanos"] / 250_000_000).alias("quarter"), S.retry_after_minutes(k % 5000).alias("retry_after"), S.percent(k % 1000 / 1000).alias("percent"),
        S.cutoff(F.col("o_orderdate"), 1440).alias("cutoff"), S.expiry(F.col("o_orderdate"), 1440).alias("ttl"), S.elapsed_label(F.col("o_orderdate"), end, F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending")).alias("elapsed"),
    )


@query("q65_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.lookup(read(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_totalprice")


@query("q66_conjunctive", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def conjunctive(spark: SparkSession, d: str) -> DataFrame:
    some = R.with_all(read(spark, d, "orders"), {"o_orderstatus": "F", "o_custkey": None})
    return R.among(some, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey").unionByName(R.among(some, "o_orderpriority", []).select("o_orderkey"))


@query("q67_unsynced", f"SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN {STATE} END AS state FROM documents WHERE NOT (doc_id % 7 = 0)")
def unsynced(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).select("doc_id", "state")
    return R.without_fields(R.without_keys(rows, rows.where("doc_id % 7 = 0"), "doc_id"), rows.where("doc_id % 10 = 3"), "doc_id", ["state"])


@query("q68_usage", """
    SELECT o_custkey, sum(p) AS input_tokens, sum(a) AS output_tokens, round(sum(p * 2.00 + a * 12.00)::DECIMAL(28,8) * 0.000001, 6)::DOUBLE AS cost, round(sum(p * 2.00)::DECIMAL(28,8) * 0.000001, 6)::DOUBLE AS input_cost,
           count(*) AS results, count(*) FILTER (o_orderstatus = 'F') AS completed, arg_max(o_orderpriority, o_orderkey) AS stop_reason
    FROM (SELECT *, o_orderkey % 9000 AS p, o_orderkey % 700 AS a FROM orders WHERE o_orderstatus <> 'P') GROUP BY o_custkey""")
def usage(spark: SparkSession, d: str) -> DataFrame:
    k, model = F.col("o_orderkey"), F.lit("gemini-3-pro")
    rows = read(spark, d, "orders").where("o_orderstatus <> 'P'").withColumn("u", D.usage(k % 9000, k % 700, S.token_cost(model, k % 9000, k % 700)))  # error rows don't count
    cost = lambda a, b: F.round(F.sum(S.token_cost(model, a, b).cast("decimal(28,8)")), 6).cast("double")
    p, a = F.col("u.prompt_tokens"), F.col("u.candidates_tokens")
    return rows.groupBy("o_custkey").agg(
        F.sum(p).alias("input_tokens"), F.sum(a).alias("output_tokens"), F.round(F.sum(F.col("u.estimated_cost_usd").cast("decimal(28,8)")), 6).cast("double").alias("cost"), cost(p, F.lit(0)).alias("input_cost"),
        F.count("*").alias("results"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.max_by("o_orderpriority", "o_orderkey").alias("stop_reason"),
    )


@query("q69_subtitle_lengths", "SELECT conv_id, sum(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10ffff}]', '', 'g')))::BIGINT AS characters, count(*) FILTER (role = 'assistant') AS completed, count(*) AS total FROM conversations GROUP BY conv_id")
def subtitle_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations")
    return rows.groupBy("conv_id").agg(F.sum(S.utf16_length(F.col("text"))).alias("characters")).join(R.progress(rows, "conv_id", F.col("role") == "assistant"), "conv_id")


ANSWER = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '```json' || chr(10) || '{\"a\":' || doc_id || '}' || chr(10) || '```' WHEN 2 THEN ' {\"b\":\"' || lang || '\"} ' ELSE '{\"c\":' END"


@query("q70_model_answers", f"""
    SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '{{"a":' || doc_id || '}}' WHEN 2 THEN '{{"b":"' || lang || '"}}' END AS answer, doc_id % 4 IN (0, 3) AS failed, CASE WHEN doc_id % 4 = 2 THEN NULL ELSE 'invalid JSON' END AS parse_error,
           CASE WHEN doc_id % 4 = 2 THEN NULL ELSE a END AS raw_response FROM (SELECT doc_id, lang, {ANSWER} AS a FROM documents)""")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "documents").select("doc_id", F.expr(ANSWER).alias("a"))
    a = a.withColumn("got", D.answer_or_error(F.col("a"))).withColumn("r", D.analysis_result(F.col("a"), F.lit("STOP"), F.lit(True)))
    failed = F.get_json_object("got", "$.error").isNotNull()
    return a.select("doc_id", F.when(~failed, F.col("got")).alias("answer"), failed.alias("failed"), "r.parse_error", "r.raw_response")


@query("q71_candidate_context", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND lang <> '' THEN lang END AS analysis, CASE WHEN NOT (doc_id % 3 = 0 AND lang <> '') THEN text END AS text_content FROM documents")
def candidate_context(spark: SparkSession, d: str) -> DataFrame:
    c = D.candidate_context(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, ""), F.col("text"))
    return read(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.analysis", "c.text_content")


@query("q72_claimed_jobs", "SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 3")
def claimed_jobs(spark: SparkSession, d: str) -> DataFrame:
    return J.claimed(read(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey")


@query("q73_request_with_schema", """
    SELECT o_orderkey, c_name, n_name AS response_schema FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def request_with_schema(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    schemas = read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("response_schema"))
    return o.join(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey").join(schemas, "c_nationkey", "left").select("o_orderkey", "c_name", "response_schema")


@query("q74_log_and_seeds", """
    WITH log AS (SELECT DISTINCT event_type, user_id % 10 AS u FROM events) SELECT event_type, u, count(*) OVER () AS n FROM log UNION ALL SELECT 'seed', NULL, (SELECT count(*) FROM log)""")
def log_and_seeds(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("u"))
    log = R.appended(rows.limit(0).withColumn("id", F.lit("")), rows, "id", ["event_type", "u"])
    log = R.appended(log, rows.where("u % 2 = 0"), "id", ["event_type", "u"])  # a replay adds nothing
    first = log.select("event_type").distinct().orderBy("event_type").limit(1)
    seeds = first.unionByName(spark.createDataFrame([("seed",)], "event_type string"))
    n = log.agg(F.count("*").alias("n"))
    return R.seeded(log.select("event_type", "u"), seeds, "event_type").crossJoin(F.broadcast(n))  # one row


@query("q75_visible_jobs", """
    SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, 'custom') AS prompt_type, '1.0' AS version FROM orders
    WHERE o_orderstatus <> 'P' AND coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, 'custom') IN ('custom', '5-LOW') AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)""")
def visible_jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(k, F.when(k % 3 > 0, F.col("o_orderpriority")).alias("prompt_type"), F.when(k % 2 > 0, "1.0").alias("version"))
    kept = R.patches_with_a_value(rows, ["prompt_type", "version"])
    return R.among(R.with_defaults(kept, {"prompt_type": "custom", "version": "1.0"}), "prompt_type", ["custom", "5-LOW"])


@query("q76_client_limits", """
    WITH r AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'h' || (user_id % 5) ELSE 'unknown' END AS ip FROM events)
    SELECT event_id, ip, count(*) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND CURRENT ROW) AS seen FROM r""")
def client_limits(spark: SparkSession, d: str) -> DataFrame:
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    ip = S.client_ip(F.when(k == 0, F.concat(F.lit(" u"), u, F.lit(" , proxy"))), F.when(k == 1, F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string"))))
    rows = read(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), ip.alias("ip"))
    return scans.trailing(rows, ["ip"], "t", 600_000_000, "seen").select("event_id", "ip", "seen")


@query("q77_deleted_analysis", """
    WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 0)
    SELECT 'blob' AS what, 'c/' || k || '.mp4' AS item, NULL::BIGINT AS n FROM gone WHERE k % 20 = 0 UNION ALL SELECT 'blob', 'o/' || o_orderkey, NULL FROM orders JOIN gone ON k = o_custkey
    UNION ALL SELECT 'jobs', NULL, count(*) FROM orders JOIN gone ON k = o_custkey UNION ALL SELECT 'results', NULL, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN gone ON k = o_custkey
    UNION ALL SELECT 'assets', NULL, count(*) FROM customer""")
def deleted_analysis(spark: SparkSession, d: str) -> DataFrame:
    assets = read(spark, d, "customer").select(F.col("c_custkey").alias("asset"))
    jobs = read(spark, d, "orders").select(F.col("o_custkey").alias("asset"), "o_orderkey")
    found = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(jobs, "o_orderkey")
    chunks = jobs.select("asset", F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"))
    manifests = assets.select("asset", F.when(F.col("asset") % 20 == 0, F.concat(F.lit("c/"), F.col("asset").cast("string"), F.lit(".mp4"))).alias("compressed_path"), F.lit(None).cast("string").alias("audio_path"))
    blobs, deleted = R.analysis_deleted(manifests, chunks, {"jobs": jobs, "results": found}, assets.where("asset % 10 = 0"), "asset")
    kept = assets.agg(F.count("*").alias("n")).select(F.lit("assets").alias("what"), F.lit(None).cast("string").alias("item"), "n")
    return blobs.select(F.lit("blob").alias("what"), F.col("path").alias("item"), F.lit(None).cast("long").alias("n")).unionByName(deleted.select("what", F.lit(None).cast("string").alias("item"), "n")).unionByName(kept)


@query("q78_archived", """
    SELECT o_orderkey, CASE WHEN s = 'completed' AND o_orderkey % 2 = 0 THEN 'archived' ELSE s END AS status, 'adapts/' || o_orderkey || '/9_16.jpg' AS path, o_totalprice <= 200000 AND o_orderkey % 3 <> 2 AS accepted
    FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS s FROM orders)""")
def archived(spark: SparkSession, d: str) -> DataFrame:
    k, status = F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    kind = F.when(k % 3 == 0, "video/mp4").when(k % 3 == 1, "image/png").otherwise("text/plain")
    rows = read(spark, d, "orders").select(k, status.alias("status"), F.concat(F.lit("adapts/"), k.cast("string"), F.lit("/"), S.aspect_name(F.lit("9:16")), F.lit(".jpg")).alias("path"), S.uploadable(kind, F.col("o_totalprice"), 200_000).alias("accepted"))
    return R.moved_to(rows, k % 2 == 0, "status", "completed", "archived")


@query("q79_index_totals", "SELECT count(*) FILTER (vec_id % 4 = 1) AS error, count(*) FILTER (vec_id % 4 <> 1 AND vec_id % 3 = 0) AS pending, count(*) FILTER (vec_id % 4 <> 1 AND vec_id % 3 <> 0) AS ready FROM embeddings")
def index_totals(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    status = S.embedding_status(F.when(v % 3 != 0, F.size("embedding")), F.when(v % 4 == 1, "quota").when(v % 4 == 2, ""))
    return read(spark, d, "embeddings").agg(*[F.count_if(status == s).alias(s) for s in ("error", "pending", "ready")])


@query("q80_valid_requests", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def valid_requests(spark: SparkSession, d: str) -> DataFrame:
    assets = read(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    prompts = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    asked = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return asked.join(prompts, "l_suppkey", "left_semi").join(assets, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")
