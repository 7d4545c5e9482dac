"""Each query under its registered name, over the smallest tables, against the library or plain Python."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framelake.llm import registry, token_counts
from framelake.llm.common import new_path, table

IDS = {"op3_warc": ("pages", "page_id"), "op4_url_filter": ("pages", "page_id")}
COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_token_counts": "doc_id n_bytes n_tokens over_limit", "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_url_filter": "page_id host path rule verdict", "op5_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_quality": "doc_id held_out score predicted", "op8_simhash": "doc_id fingerprint component_id", "op9_merkle": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, sf, texts, name):
    df = registry.QUERIES[name](spark, sf)
    assert set(COLUMNS[name].split()) <= set(df.columns) and len(set(df.columns)) == len(df.columns)
    source, key = IDS.get(name, ("documents", "doc_id"))
    rows = [r.asDict() for r in df.collect()]
    want = sorted(r[0] for r in table(spark, sf, source).select(key).collect())
    got = sorted(r[key] for r in rows)
    assert (sorted(set(got)) if name == "op6_packing" else got) == want
    encode = lambda f, t: Tokenizer.from_file(public_tokenizers.path(f)).encode(t, add_special_tokens=False).ids
    some = rows[:: max(1, len(rows) // 12)]
    if name == "op2_token_counts":
        assert all(r["n_tokens"] == len(encode("byte_bpe_50k.json", texts[r["doc_id"]])) and r["n_bytes"] == len(texts[r["doc_id"]].encode()) for r in some)
    if name == "op6_packing":
        ids = {r["doc_id"]: np.array([*encode("word_bpe_49k.json", texts[r["doc_id"]]), 1], "<u4") for r in some}
        assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in some)
    if name == "op10_bpe":
        assert all(hashlib.sha256(np.array(encode("byte_bpe_50k.json", texts[r["doc_id"]]), "<u4").tobytes()).hexdigest() == r["ids_sha256"] for r in some)
        assert all((r["joins"] > 0) == (len(texts[r["doc_id"]]) > 512) for r in rows)


def test_a_kept_cache_is_used(spark, sf):
    cache = new_path(spark, "kept-cache")
    first = sorted(map(tuple, token_counts.op2_token_counts(spark, sf, cache).collect()))
    stored = spark.read.parquet(cache).count()
    assert sorted(map(tuple, token_counts.op2_token_counts(spark, sf, cache).collect())) == first
    assert spark.read.parquet(cache).count() == stored


def test_pipeline_as_a_whole(spark, sf, texts):
    rows = registry.QUERIES["pipeline"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} <= texts.keys() and len({r["doc_id"] for r in rows}) > len(texts) / 4
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_a_full_cache_moves_no_text(spark, sf, monkeypatch):
    cache = new_path(spark, "kept-cache")
    token_counts.op2_token_counts(spark, sf, cache).count()
    plans = []
    real = token_counts.materialise
    monkeypatch.setattr(token_counts, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    again = token_counts.op2_token_counts(spark, sf, cache)
    plans.append(again._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3
    for plan in plans:  # nothing is encoded, and no aggregate or join carries a text to an exchange
        assert "MapInPandas" not in plan and "first(__text" not in plan and "__in" not in plan
