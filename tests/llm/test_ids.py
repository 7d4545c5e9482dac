"""Ids that no floating point number holds, beside null ids, and columns whose names clash: every operator and stage gives them back unchanged."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framelake.llm import bpe_codec, exact_dedup, merkle, packing, pii, pipeline, quality, simhash, token_counts, url_filter, warc
from framelake.llm.common import new_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BIG = (1 << 53) + 1
LONG = " ".join(f"word{k * 7919 % 1009}" for k in range(3000))  # several sequences, and so re-cut pieces
TEXTS = {BIG: "The quick brown fox jumps over the lazy dog, and so on.", None: LONG, BIG + 2: "Another text of an altogether different kind, mail me@example.org.", BIG + 4: LONG + " end"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t), 1, 2, 3, 4) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `odd.name` int, __rid int, __id int, start int").coalesce(1)


@pytest.fixture(scope="module")
def weights():
    return quality.start_weights()


def same_ids(df, name="doc_id"):
    assert sorted((r[name] for r in df.collect()), key=repr) == sorted(TEXTS, key=repr)


def test_per_row_operators(spark, docs, weights):
    same_ids(pii.detect(docs, selector=pii.train_selector(docs)))
    same_ids(token_counts.count_tokens(docs, BYTES, new_path(spark, "cache")))
    same_ids(exact_dedup.exact_groups(docs))
    same_ids(quality.score_documents(docs, weights))
    same_ids(simhash.near_groups(docs))
    same_ids(merkle.edited_fingerprints(docs))


def test_pages(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://example.com/x").alias("url"), F.col("text").alias("html"), "`odd.name`")
    same_ids(url_filter.judge_urls(pages), "page_id")
    path = new_path(spark, "archives")
    warc.write_archives(pages, path)
    got = warc.captures(warc.read_records(spark, path))
    assert got.count() == len(TEXTS)


def test_encoded_and_decoded(docs):
    encoded = bpe_codec.encode_documents(docs, BYTES)
    same_ids(encoded)
    with_more = encoded.withColumn("odd.name", F.lit("kept"))
    back = {r["doc_id"]: (r["text"], r["odd.name"]) for r in bpe_codec.decode_documents(with_more, BYTES).collect()}
    assert back == {i: (t, "kept") for i, t in TEXTS.items()}


def test_packed(docs):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(docs, WORDS).collect()
    for i, t in TEXTS.items():
        ids = np.array([*hf.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert [s for s, *_ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1].tolist()] and sum(n for _, n, _ in own) == len(ids)
        assert all(packing.crc(ids[s : s + n]) == c for s, n, c in own)
    renamed = docs.select(F.col("doc_id").alias("start"), "text")
    out = packing.pack_documents(renamed, WORDS, id_col="start")
    assert out.columns.count("start") == 1 and {r["id"] for r in out.collect()} == set(TEXTS)


def test_rows_that_stay(docs, weights):
    for kept in (simhash.drop_near_copies(docs), exact_dedup.drop_copies(docs), quality.keep_good(docs, weights, threshold=0.0), pii.redact(docs, pii.train_selector(docs))):
        assert kept.columns == docs.columns
        assert all((r["odd.name"], r["__rid"], r["__id"], r["start"]) == (1, 2, 3, 4) for r in kept.collect())
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()} == {BIG, None, BIG + 2}  # of two near copies the smaller id, null, stays


def test_stages(spark, sf, docs):
    for name, stage in pipeline.STAGES:
        got = {r["doc_id"]: hashlib.sha256(str(r).encode()).hexdigest() for r in stage(spark, docs, sf).collect()}
        assert set(got) <= set(TEXTS) and (name in ("quality", "near") or set(got) == set(TEXTS)), name
