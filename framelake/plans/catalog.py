"""Registered queries over the driver's tables, each with SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import scalars as S
from ..operators import admission as A
from ..operators import relations as R
from ..operators import scans
from ..operators import search as V
from ..operators import segments as G
from ..streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Search: row 0 of embeddings is the query, label the asset.

NEAR = """near AS (SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings {where} ORDER BY distance, vec_id LIMIT 20)"""


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return read(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def hits(spark: SparkSession, d: str, where: Column | None = None, below: float = V.THRESHOLD) -> DataFrame:
    return V.vector_search(read(spark, d, "embeddings"), query_vector(spark, d), where=where, below=below)


@query("q01_search", f"WITH {NEAR.format(where='')} SELECT * FROM near WHERE distance < 1.1")
def search_top_k(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d)


@query("q02_search_in_asset", f"WITH {NEAR.format(where='WHERE label = 3')} SELECT * FROM near WHERE distance < 1.1")
def search_in_asset(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d, F.col("label") == 3)


@query("q03_search_threshold_after", f"WITH {NEAR.format(where='')} SELECT * FROM near WHERE distance < 0.7")
def search_threshold(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d, below=0.7)


@query("q04_best_per_asset", f"WITH {NEAR.format(where='')} SELECT label, arg_min(vec_id, (distance, vec_id)) AS best, min(distance) AS score, count(*) AS chunk_count FROM near WHERE distance < 1.1 GROUP BY label")
def best_per_asset(spark: SparkSession, d: str) -> DataFrame:
    return V.best_per_group(hits(spark, d), "label", "vec_id")


@query("q05_fallback_curation", f"WITH {NEAR.format(where='')} SELECT vec_id, round(greatest(0.0, 1 - distance), 6) AS confidence FROM (SELECT * FROM near WHERE distance < 1.1 ORDER BY distance, vec_id LIMIT 10)")
def curation(spark: SparkSession, d: str) -> DataFrame:
    return V.fallback_curation(hits(spark, d), "vec_id")


@query("q06_bands", f"WITH {NEAR.format(where='')} SELECT vec_id, CASE WHEN 1 - distance >= 0.85 THEN 'high' WHEN 1 - distance >= 0.6 THEN 'medium' END AS band FROM near WHERE distance < 1.1 AND 1 - distance >= 0.6")
def bands(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("vec_id", S.band(1 - F.col("distance")).alias("band")).where("band is not null")


# Scalars.

MODELS = "CASE event_id % 5 WHEN 0 THEN 'models/gemini-3-pro' WHEN 1 THEN 'gemini-2.5-flash' WHEN 2 THEN 'gemini-pro' WHEN 3 THEN 'flash-lite' ELSE 'other' END"


@query("q07_token_cost", f"""
    WITH u AS (SELECT event_id, {MODELS} AS model, user_id * 997 AS p, event_id % 5000 AS c FROM events)
    SELECT event_id, regexp_replace(model, '^models/', '') AS model, round((CASE
      WHEN contains(model, 'gemini-3') THEN CASE WHEN p <= 200000 THEN p * 2.00 + c * 12.00 ELSE p * 4.00 + c * 18.00 END
      WHEN contains(model, 'gemini-2.5') OR contains(model, 'gemini-pro') THEN CASE WHEN p <= 128000 THEN p * 1.25 + c * 5.00 ELSE p * 2.50 + c * 10.00 END
      WHEN contains(model, 'flash') THEN p * 0.10 + c * 0.40 ELSE 0 END)::DECIMAL(28,8) * 0.000001, 6)::DOUBLE AS cost FROM u""")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("model", F.expr(MODELS))
    return e.select("event_id", S.model_name(F.col("model")).alias("model"), S.token_cost(F.col("model"), F.col("user_id") * 997, F.col("event_id") % 5000).alias("cost"))


@query("q08_image_cost", "SELECT event_id, round((user_id * 0.0025 + (event_id % 100) * 0.0050)::DECIMAL(28,8) * 0.001, 6)::DOUBLE AS cost FROM events")
def image_cost(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", S.image_cost(F.col("user_id"), F.col("event_id") % 100).alias("cost"))


TABLE = ", ".join(f"({k}, {v})" for k, v in S.CRF_BITRATES.items())


@query("q09_crf_bitrate", f"""
    SELECT p_partkey, crf, (arg_min(v, (abs(crf - k), k)) * pow(1080 / 480.0, 1.5))::DOUBLE AS exact, floor(arg_min(v, (abs(crf - k), k)) * pow(1080 / 480.0, 1.5))::BIGINT AS bitrate
    FROM (SELECT p_partkey, p_size % 60 AS crf FROM part), (VALUES {TABLE}) t(k, v) GROUP BY p_partkey, crf""".replace("(arg_min(v, (abs(crf - k), k)) * pow(1080 / 480.0, 1.5))::DOUBLE AS exact, ", ""))
def crf_bitrate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", (F.col("p_size") % 60).alias("crf")).select("p_partkey", "crf", S.crf_to_bitrate(F.col("crf"), F.lit(1080)).alias("bitrate"))


@query("q10_percent_saved", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice > 0 AND l_quantity - 10 > 0 THEN round((1 - (l_quantity - 10) / l_extendedprice) * 100, 1) ELSE 0.0 END AS saved FROM lineitem")
def percent_saved(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.percent_saved(F.col("l_extendedprice"), F.col("l_quantity") - 10).alias("saved"))


@query("q11_duration_estimate", "SELECT doc_id, CASE WHEN n_chars > 0 AND doc_id % 7 * 1000 > 0 THEN round(n_chars * 8 / (doc_id % 7 * 1000), 2) END AS seconds FROM documents")
def duration_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", S.duration_estimate(F.col("n_chars"), F.col("doc_id") % 7 * 1000).alias("seconds"))


FILES = "concat('folder/item.', doc_id, CASE doc_id % 5 WHEN 0 THEN '.MP3' WHEN 1 THEN '.wav' WHEN 2 THEN '.webm' WHEN 3 THEN '.mp4' ELSE '' END)"


@query("q12_mime_and_source", f"""
    SELECT doc_id, CASE WHEN lower(p) LIKE '%.mp3' THEN 'audio/mpeg' WHEN lower(p) LIKE '%.wav' THEN 'audio/wav' WHEN lower(p) LIKE '%.webm' THEN 'video/webm' ELSE 'video/mp4' END AS mime,
           CASE WHEN regexp_matches(lower(p), '\\.(mp3|wav|aac|m4a)$') THEN 'audio' ELSE 'video' END AS source FROM (SELECT doc_id, {FILES} AS p FROM documents)""")
def mime_and_source(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").withColumn("p", F.expr(FILES)).select("doc_id", S.mime_of(F.col("p")).alias("mime"), S.source_label(F.col("p")).alias("source"))


@query("q13_object_path", "SELECT page_id, CASE WHEN regexp_matches(url, '^https://([^/]*)/(.*)$') THEN regexp_extract(url, '^https://([^/]*)/(.*)$', 1) END AS bucket, CASE WHEN regexp_matches(url, '^https://([^/]*)/(.*)$') THEN regexp_extract(url, '^https://([^/]*)/(.*)$', 2) END AS name FROM pages")
def object_path(spark: SparkSession, d: str) -> DataFrame:
    bucket, name = S.object_path(F.col("url"), "https")
    return read(spark, d, "pages").select("page_id", bucket.alias("bucket"), name.alias("name"))


@query("q14_id_and_extension", f"SELECT doc_id, split_part(split_part(p, '/', -1), '.', 1) AS asset, CASE WHEN contains(p, '.') THEN split_part(p, '.', -1) ELSE 'mp4' END AS ext FROM (SELECT doc_id, {FILES} AS p FROM documents)")
def id_and_extension(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").withColumn("p", F.expr(FILES)).select("doc_id", S.id_of_path(F.col("p")).alias("asset"), S.extension(F.col("p"), "mp4").alias("ext"))


@query("q15_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview, text[1:500] AS top FROM documents")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"), F.substring("text", 1, 500).alias("top"))


@query("q16_ascii", "SELECT doc_id, strlen(text) = length(text) AS ascii, length(trim(text)) = 0 AS blank FROM documents")
def ascii_flag(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", S.is_ascii(F.col("text")).alias("ascii"), S.is_blank(F.col("text")).alias("blank"))


@query("q17_timecodes", """
    SELECT event_id, t, CASE WHEN len(string_split(t, ':')) = 3 THEN split_part(t, ':', 1)::DOUBLE * 3600 + split_part(t, ':', 2)::DOUBLE * 60 + split_part(t, ':', 3)::DOUBLE ELSE split_part(t, ':', 1)::DOUBLE * 60 + split_part(t, ':', 2)::DOUBLE END AS seconds FROM (
      SELECT event_id, CASE WHEN s // 3600 > 0 THEN concat(s // 3600, ':', lpad((s % 3600 // 60)::VARCHAR, 2, '0'), ':', lpad((s % 60)::VARCHAR, 2, '0')) WHEN s > 0 THEN concat(s // 60, ':', lpad((s % 60)::VARCHAR, 2, '0')) ELSE '0:00' END AS t
      FROM (SELECT event_id, event_id * 37 % 20000 AS s FROM events))""")
def timecodes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", S.format_duration(F.col("event_id") * 37 % 20000).alias("t"))
    return e.withColumn("seconds", S.timecode_seconds(F.col("t")))


@query("q18_labels", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Genre' WHEN 1 THEN 'Type' WHEN 2 THEN 'Content Type' WHEN 3 THEN 'Category' ELSE 'Sub Category' END AS label FROM documents")
def labels(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in D.LABELLED])
    return read(spark, d, "documents").select("doc_id", S.label_of(F.element_at(keys, (F.col("doc_id") % 5 + 1).cast("int"))).alias("label"))


# Jobs: orders; their chunks: lineitem; prompts: customer.

@query("q19_newest", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest(spark: SparkSession, d: str) -> DataFrame:
    return R.newest(read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), "o_orderdate", "o_orderkey")


@query("q20_newest_by_status", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_by_status(spark: SparkSession, d: str) -> DataFrame:
    return R.newest(read(spark, d, "orders"), "o_orderdate", "o_orderkey", where=F.col("o_orderstatus") == "P").select("o_orderkey", "o_orderdate")


@query("q21_limit_then_sort", "SELECT o_orderkey, o_orderdate FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 3) ORDER BY o_orderdate, o_orderkey")
def limit_then_sort(spark: SparkSession, d: str) -> DataFrame:
    return R.limit_then_sort(read(spark, d, "orders"), F.col("o_orderstatus") == "O", "o_orderkey", "o_orderdate", 3).select("o_orderkey", "o_orderdate")


@query("q22_limit_then_join", """
    WITH top AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50), items AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey, o_orderdate, n FROM top JOIN items ON o_orderkey = l_orderkey""")
def limit_then_join(spark: SparkSession, d: str) -> DataFrame:
    top = R.newest(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(F.broadcast(top), "o_orderkey")  # 50 rows
    return rows.groupBy("o_orderkey", "o_orderdate").agg(F.count("*").alias("n"))


@query("q23_assets_with_jobs", """
    SELECT c_custkey, count(o_orderkey) AS jobs, coalesce(bool_or(o_orderstatus = 'F' AND o_totalprice > 200000), false) AS has_compressed, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS job_ids
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def assets_with_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    nested = R.nest(read(spark, d, "customer").select("c_custkey"), jobs, "c_custkey", ["o_orderkey", "o_orderstatus", "o_totalprice"], "jobs")
    done = F.exists("jobs", lambda j: (j["o_orderstatus"] == "F") & (j["o_totalprice"] > 200000))
    ids = F.array_join(F.transform("jobs", lambda j: j["o_orderkey"].cast("string")), ",")
    return nested.select("c_custkey", F.size("jobs").cast("long").alias("jobs"), done.alias("has_compressed"), ids.alias("job_ids"))


@query("q24_references", "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS jobs_count FROM customer")
def references(spark: SparkSession, d: str) -> DataFrame:
    return R.with_count(read(spark, d, "customer").select("c_custkey", "c_name"), read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "jobs_count")


@query("q25_unreferenced", "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def unreferenced(spark: SparkSession, d: str) -> DataFrame:
    return R.unreferenced(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels"), "doc_id")


@query("q26_parent_exists", "SELECT doc_id, quality FROM labels WHERE EXISTS (SELECT 1 FROM documents WHERE documents.doc_id = labels.doc_id AND lang = 'en')")
def parent_exists(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").join(read(spark, d, "documents").where("lang = 'en'"), "doc_id", "left_semi").select("doc_id", "quality")


@query("q27_status_counts", "SELECT count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS processing, count(*) AS total FROM orders")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "completed"), ("O", "pending"), ("P", "processing"))], F.count("*").alias("total"))


@query("q28_distinct_types", "SELECT DISTINCT event_type FROM events")
def distinct_types(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_type").distinct().orderBy("event_type")


LAST = "l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query("q29_job_roll_up", f"""
    SELECT l_orderkey, sum(l_quantity)::DOUBLE AS total_tokens, round(sum(l_extendedprice::DECIMAL(30,8)), 6)::DOUBLE AS total_cost,
           arg_max(l_returnflag, ({LAST})) AS stop_reason FROM lineitem GROUP BY l_orderkey""")
def job_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return R.roll_up(read(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_returnflag"), LAST.split(", "))


# Documents.

@query("q30_json_field", "SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("k"))


@query("q31_embedding_status", "SELECT vec_id, CASE WHEN vec_id % 4 = 1 THEN 'error' WHEN vec_id % 3 = 0 THEN 'pending' ELSE 'ready' END AS status FROM embeddings")
def embedding_status(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("vec_id") % 3 != 0, F.size("embedding"))
    return read(spark, d, "embeddings").select("vec_id", S.embedding_status(size, F.when(F.col("vec_id") % 4 == 1, "quota").when(F.col("vec_id") % 4 == 2, "")).alias("status"))


@query("q32_sync_eligible", """
    SELECT d.doc_id FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'scene_analysis' WHEN 1 THEN 'subtitling' END AS own FROM documents) d
    LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'custom' ELSE 'other' END AS type FROM labels) l ON d.doc_id = l.doc_id
    WHERE coalesce(status, '') NOT IN ('archived', 'failed') AND CASE WHEN own IS NOT NULL THEN own IN ('scene_analysis', 'custom') ELSE coalesce(status = 'completed' AND type IN ('scene_analysis', 'custom'), false) END""")
def sync_eligible(spark: SparkSession, d: str) -> DataFrame:
    jobs = read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "completed").otherwise("pending").alias("status"), F.when(F.col("doc_id") % 3 == 0, "custom").otherwise("other").alias("type"))
    own = F.when(F.col("doc_id") % 4 == 0, "scene_analysis").when(F.col("doc_id") % 4 == 1, "subtitling")
    return read(spark, d, "documents").select("doc_id").join(jobs, "doc_id", "left").where(S.searchable(F.col("status"), F.col("type"), own)).select("doc_id")


@query("q33_back_fill", """
    SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END, 'Prompt ' || substr(c_custkey::VARCHAR, 1, 8)) AS name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'scene_analysis' END, 'custom') AS type FROM customer""")
def back_fill(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = S.prompt_name(F.when(k % 3 == 0, F.col("c_name")), F.when(k % 3 == 1, F.col("c_mktsegment")), k.cast("string"))
    return read(spark, d, "customer").select("c_custkey", name.alias("name"), F.coalesce(F.when(k % 2 == 0, "scene_analysis"), F.lit("custom")).alias("type"))


@query("q35_names_in_order", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS names FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def names_in_order(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))  # bounded: one row a role
    return first.groupBy("conv_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"])), ",").alias("names"))


# Segments and export.

@query("q36_chunks", "SELECT doc_id, i::INT AS index, i * 500.0::DOUBLE AS start_time, least((i + 1) * 500, n_chars)::DOUBLE AS end_time, printf('chunk_%04d.mp4', i) AS filename FROM (SELECT doc_id, n_chars, unnest(range(((n_chars + 499) // 500)::BIGINT)) AS i FROM documents WHERE n_chars > 0)")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return G.chunk_rows(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", F.lit(500)).drop("n_chars")


@query("q37_offsets", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 30 AS \"offset\" FROM conversations")
def offsets(spark: SparkSession, d: str) -> DataFrame:
    return G.with_offset(read(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", F.lit(30))


@query("q38_joined_text", "SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> ''), '') AS joined FROM conversations GROUP BY conv_id")
def joined_text(spark: SparkSession, d: str) -> DataFrame:
    return G.joined_text(read(spark, d, "conversations"), "conv_id", "turn", "text")


# Current state.

LOG = "SELECT user_id, event_id, CASE WHEN event_type = 'login' THEN 'delete' ELSE 'set' END AS op, value FROM events"


@query("q41_current", f"SELECT user_id, event_id, value FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND op <> 'delete'")
def current(spark: SparkSession, d: str) -> DataFrame:
    log = read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "login", "delete").otherwise("set").alias("op"), "value")
    return R.current(log, "user_id", "event_id", "op").drop("op")


@query("q42_patch", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang) AS lang, d.source FROM documents d LEFT JOIN labels l USING (doc_id)")
def patch(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"))
    return R.patched(read(spark, d, "documents").select("doc_id", "lang", "source"), p, "doc_id", ["lang"])


@query("q43_cascade_delete", "SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 10 = 0)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    left = R.cascade({"orders": orders, "lineitem": read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))}, orders.where("k % 10 = 0"), "k")
    one, two = (left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("orders", "lineitem"))
    return one.union(two)


@query("q44_upsert", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    return R.merged(c.where("k % 3 <> 0").select("k", F.col("c_name").alias("v")), c.where("k % 2 = 0").select("k", F.when(F.col("k") % 4 == 0, F.col("c_mktsegment")).alias("v")), "k", ["v"])


# Windows and state.

@query("q45_trailing_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM events")
def trailing_count(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return scans.trailing(e, ["user_id", "event_type"], "t", 86_400_000_000, "n").select("event_id", "n")


@query("q46_admission", """
    WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT event_id, user_id, i, true AS accepted, [t] AS kept FROM r WHERE i = 1
          UNION ALL
          SELECT r.event_id, r.user_id, r.i, len(list_filter(s.kept, lambda x: x >= r.t - 86400000000)) < 2,
                 CASE WHEN len(list_filter(s.kept, lambda x: x >= r.t - 86400000000)) < 2 THEN list_append(list_filter(s.kept, lambda x: x >= r.t - 86400000000), r.t) ELSE list_filter(s.kept, lambda x: x >= r.t - 86400000000) END
          FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
    SELECT event_id, user_id, accepted FROM s""")
def admission(spark: SparkSession, d: str) -> DataFrame:
    return A.admission(read(spark, d, "events"), ["user_id"], "ts", "event_id", limit=2, window_seconds=86_400).select("event_id", "user_id", "accepted")


@query("q47_daily_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@query("q49_guarded_delete", "SELECT doc_id FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'de')")
def guarded_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang")
    return R.guarded_delete(docs, docs.where("doc_id % 5 = 0").select("doc_id"), read(spark, d, "labels").select("doc_id"), "doc_id", busy=F.col("lang") == "de").select("doc_id")


@query("q50_lifecycle", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'archived' END AS ask, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT user_id, 0::BIGINT AS i, 'pending' AS status, 0 AS steps FROM (SELECT DISTINCT user_id FROM events)
          UNION ALL SELECT e.user_id, e.i, CASE WHEN ok THEN ask ELSE status END, steps + ok::INT FROM (SELECT e.user_id, e.i, ask, status, steps,
            (status = 'pending' AND ask IN ('processing', 'failed')) OR (status = 'processing' AND ask IN ('completed', 'failed')) OR (status = 'completed' AND ask = 'archived') AS ok FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) e)
    SELECT user_id, arg_max(status, i) AS status, max(steps)::INT AS steps FROM s GROUP BY user_id""")
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    asks = F.element_at(F.array(*[F.lit(s) for s in ("processing", "completed", "failed", "archived")]), (F.col("event_id") % 4 + 1).cast("int"))
    return J.lifecycle(read(spark, d, "events").select("user_id", "event_id", asks.alias("ask")), "user_id", "event_id", "ask")


@query("q52_format_bytes", """
    SELECT o_orderkey, CASE WHEN b <= 0 THEN '0 Bytes' ELSE regexp_replace(round(b / pow(1024, u), 2)::DECIMAL(20,2)::VARCHAR, '\\.?0+$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB', 'TB'][u + 1] END AS size
    FROM (SELECT *, (b >= 1024)::INT + (b >= 1048576)::INT + (b >= 1073741824)::INT AS u FROM (SELECT o_orderkey, (o_orderkey * 1048573 % 3000000)::BIGINT AS b FROM orders))""")
def sizes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", S.format_bytes(F.col("o_orderkey") * 1048573 % 3000000).alias("size"))


@query("q53_newest_media", "SELECT doc_id, source FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/png' END AS ct FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) WHERE coalesce(ct LIKE 'video/%' OR ct LIKE 'audio/%', false)")
def newest_media(spark: SparkSession, d: str) -> DataFrame:
    ct = F.when(F.col("doc_id") % 3 == 0, "video/mp4").when(F.col("doc_id") % 3 == 1, "image/png")
    return read(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(50).where(S.is_media(ct)).select("doc_id", "source")
