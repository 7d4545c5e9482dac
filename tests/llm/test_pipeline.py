"""Each stage against brute force on the rows that it was given."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import pipeline as P
from framelake.llm import quality
from framelake.llm.common import materialise, table


def rows(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def grams(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    stages = dict(P.STAGES)
    good = materialise(stages["quality"](spark, docs, sf), "a")
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, quality.train(docs, table(spark, sf, "labels"))).collect()}
    assert rows(good).keys() == {i for i, s in scores.items() if s >= 0.3}

    single = materialise(stages["exact"](spark, good, sf), "b")
    last = {}
    for i, t in sorted(rows(good).items()):
        last[t] = i
    assert rows(single) == {i: t for t, i in last.items()}

    apart = materialise(stages["near"](spark, single, sf), "c")
    before, after = {i: grams(t) for i, t in rows(single).items()}, rows(apart).keys()
    root = {i: i for i in before}
    for a in sorted(before):
        for b in sorted(before):
            if a < b and alike(before[a], before[b]) >= 0.8:
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert after == set(root.values())

    clean = materialise(stages["pii"](spark, apart, sf), "d")
    assert rows(clean).keys() == after
    assert clean.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count() == 0
    assert clean.where("n_chars != char_length(text)").count() == 0
    assert all(x.columns == P.COLUMNS for x in (good, single, apart, clean))

    hf, texts, seen = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), rows(clean), {}
    for r in stages["packing"](spark, clean, sf).collect():
        ids = np.array([*hf.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == len(ids)
    assert seen == {i: len(hf.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_stages_take_an_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = materialise(stage(spark, docs, sf), "none")
    assert docs.count() == 0
