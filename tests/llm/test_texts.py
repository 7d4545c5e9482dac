"""Operators on texts against plain brute force, over the smallest tables and a table of hard cases."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import bpe, bpe_codec, exact_dedup, merkle, packing, pii, quality, simhash, token_counts
from framelake.llm.common import new_path, table

SCHEMA = "doc_id long, text string, id int, digest string, h string, key string, n_chars string, tie int, base string, spans string, total int, rank int"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def hard_texts():
    r = np.random.default_rng(3)
    letters = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    return [
        (1, "Write to a.b+c@mail.example.org or call +1 (555) 010-9999 or 555-010-7777; host 10.0.0.255, not 10.0.0.256 or 1.2.3.4.5."), (2, None), (3, ""), (None, "no id"), (4, "the same\n\ntext"), (5, "the same\n\ntext"), (5, "the same\n\ntext"),
        (6, "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 5500000000000004; a@b a@b.c@d.e @x.y"), (7, letters(30_000)), (8, " ".join(letters(int(k)) for k in r.integers(1, 12, 20_000))),
        (9, "   \n\t "), (10, "<|endoftext|> in a text <|endoftext|>"), (11, "日本語のテキスト😀 Ünïcödé İstanbul ǅ ß \u200b" * 3), (12, letters(9_000) + " " * 5_000 + "<|endoftext|>" + letters(9_000)), (13, "\x00\x1f 'S don't WON'T"),
        (14, "emojis 😀 before me@here.example.com and " + "1" * 5_000 + " +" + "1-" * 300), (15, "+12 345 6789\n+12 345 67890 " * 3),
    ]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, *[None] * 10) for i, t in hard_texts()], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return table(spark, sf, "documents")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return sorted(rows, key=repr)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            out += [(m.start(), order, m.end(), kind)] * ok
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


@pytest.mark.parametrize("which", ["documents", "hard"])
def test_pii(request, documents, which):
    docs = request.getfixturevalue(which)
    got = bag((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.detect(docs, selector=pii.NOTHING).collect())
    want = []
    for i, t in texts(docs):
        spans = base_spans(t)
        want.append((i, *[sum(s.startswith(k) for s in spans) for k in BASE], hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert got == bag(want)


@pytest.fixture(scope="module")
def selector(spark):
    return pii.train_selector(table(spark, "/root/testdata/sf0.01", "documents"))


def test_pii_trees_add_spans_and_keep_the_base(spark, selector):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    assert selector.trees
    found = pii.find_spans(documents, selector).select("doc_id", "text", "base", "spans").collect()
    many = 0
    for r in found:
        assert set(r["base"]) <= set(r["spans"])
        added = [s for s in r["spans"] if s not in r["base"]]
        many += len(added)
        for k, s in enumerate(added):
            assert all(s["end"] <= o["start"] or o["end"] <= s["start"] for o in [*r["base"], *added[:k]])
    assert many > 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(documents, selector).collect()}
    for r in found:
        marks, at = [], 0  # overlapping spans become one, named after the first
        for s in sorted(r["spans"]):
            if marks and s["start"] < marks[-1][1]:
                marks[-1][1] = max(marks[-1][1], s["end"])
            else:
                marks.append([s["start"], s["end"], s["kind"]])
        want = ""
        for a, b, kind in marks:
            want, at = want + r["text"][at:a] + f"[{kind.upper()}]", b
        assert clean[r["doc_id"]] == want + r["text"][at:]


def test_pii_spans_beyond_the_base_patterns(spark, documents, selector):
    """Planted forms that no base pattern has, and numbers and hashes that are nobody's, in passages of real texts."""
    r = np.random.default_rng(11)
    d = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    x = lambda n: "".join("0123456789abcdef"[k] for k in r.integers(0, 16, n))
    def card():
        body = d(15)
        return body + next(c for c in "0123456789" if luhn(body + c))

    planted = lambda: [f"call ({d(3)}) 555-{d(4)}", f"tel. {d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", "jo.smith [at] example [dot] org", "ann_b(at)mail.net", "write to kim at example dot com", ".".join(re.findall("....", card())), f'token = "{x(40)}"', f"api_key: {x(32)}"]
    others = lambda: [f"2024-05-1{d(1)} 10:{d(2)}", f"commit {x(40)}", f"order {d(10)}", f"total $ {d(1)},{d(3)},{d(3)}.{d(2)}", f"version 2.{d(2)}.{d(4)}.1", f"id {x(8)}-{x(4)}-{x(4)}-{x(4)}-{x(12)}", f"0.{d(13)}"]
    prose = [t for _, t in texts(documents) if len(t) > 400 and not re.search("[0-9@]", t)]
    rows = []
    for k, t in enumerate(prose):
        for v in [*planted(), *others()]:
            rows.append((len(rows), f"{t[k : k + 60]} {v} {t[100:160]}", v, k))
        if k >= 12:
            break
    bad = {v for v in [w for _, _, w, _ in rows] if re.match(r"2024|commit|order|total|version|id |0\.", v)}
    got = {q["doc_id"]: q["spans"] for q in pii.find_spans(spark.createDataFrame([q[:2] for q in rows], "doc_id int, text string"), selector).collect()}
    hits = sum(bool(got[i]) for i, _, v, _ in rows if v not in bad)
    false = sum(bool(got[i]) for i, _, v, _ in rows if v in bad)
    positives = sum(v not in bad for _, _, v, _ in rows)
    print(f"recall {hits / positives:.3f}, precision {hits / max(1, hits + false):.3f}, of {positives} and {len(rows) - positives}")
    assert hits / positives > 0.9 and hits / (hits + false) > 0.95


def test_pii_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.cc", "x", "y", "z", "t"), (1, "a@b.cc", "x", "y", "z", "t"), (None, None, None, None, None, None)], "doc_id int, text string, base string, spans string, candidates string, `odd.name` string")
    got = pii.redact(docs, pii.NOTHING)
    assert got.columns == docs.columns
    assert bag(map(tuple, got.collect())) == bag([(1, "[EMAIL]", "x", "y", "z", "t")] * 2 + [(None,) * 6])
    assert [r["spans"] for r in pii.detect(docs, selector=pii.NOTHING).collect()] == ["email:0:6", "email:0:6", ""]


def test_pii_redaction_of_many_and_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "a@b.cc, " * 90), (2, None), (3, "é +378282246310005 x")], "doc_id int, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.NOTHING).collect()} == {1: "[EMAIL], " * 90, 2: None, 3: "é [PHONE] x"}


def test_pii_redaction_of_a_span_over_very_many(spark):
    long = "_".join(["10.0.0.1"] * 3_000) + "@mail.example.org"
    docs = spark.createDataFrame([(1, f"from {long} to {long}.")], "doc_id int, text string")
    assert pii.redact(docs, pii.NOTHING).first()["text"] == "from [EMAIL] to [EMAIL]."


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1_000])
def test_running_sums_and_maxima(spark, n):
    x = np.random.default_rng(n).integers(0, 100, n).tolist()
    got = spark.createDataFrame([(x,)], "x array<int>").select(pii.running(F.col("x")), pii.running(F.col("x"), fold=pii.largest, join=F.greatest)).first()
    assert got[0] == np.cumsum(x).tolist() and got[1] == np.maximum.accumulate(np.array(x, dtype=int)).tolist()


@pytest.mark.parametrize("which", ["documents", "hard"])
def test_token_counts_and_cache(request, spark, which):
    docs, cache = request.getfixturevalue(which), new_path(spark, "cache")
    hf = Tokenizer.from_file(BYTES)
    want = bag((i, len(t.encode()), n := len(hf.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts(docs))
    for _ in range(2):
        assert bag(map(tuple, token_counts.count_tokens(docs, BYTES, cache).collect())) == want
        assert spark.read.parquet(cache).count() == len({t for _, t in texts(docs)})


@pytest.mark.parametrize("which", ["documents", "hard"])
@pytest.mark.parametrize("part", [bpe_codec.PART_CHARS, 1_000])
def test_bpe_round_trip(request, monkeypatch, which, part):
    monkeypatch.setattr(bpe_codec, "PART_CHARS", part)
    monkeypatch.setattr(bpe_codec, "PARTS_JOINED", 3)
    docs = request.getfixturevalue(which)
    hf = Tokenizer.from_file(BYTES)
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(docs, BYTES), BYTES).join(docs.select("doc_id", F.char_length("text").alias("n")).distinct(), "doc_id").collect()
    assert all((r["joins"] > 0) == (r["n"] > bpe_codec.LEAF_CHARS) for r in back if r["n"])
    got = bag((r["doc_id"], list(np.frombuffer(r["ids"], "<u4")), r["text"]) for r in bpe_codec.decode_documents(bpe_codec.encode_documents(docs, BYTES), BYTES).collect())
    want = []
    for i, t in texts(docs):
        ids = hf.encode(t, add_special_tokens=False).ids
        want.append((i, list(np.array(ids, "<u4")), hf.decode(ids, skip_special_tokens=False)))
    assert got == bag(want)


def test_joins_at_any_place_are_exact():
    """Leaves of one to 40 characters, so that joins fall into words, contractions, characters and white space."""
    hf, codec, r = Tokenizer.from_file(BYTES), bpe.codec(BYTES), np.random.default_rng(4)
    pools = ["'s're ally'll ve ", "  \n\t a", "abcdefgh'", "!?.'s t", "ab12 ", "\u65e5\u672c\u8a9e\U0001f600 \xe9'", "\u3000\xa0 x\u200b\xdf", "aaaaaaa", "'' 'll'l", " the and of ing"]
    for _ in range(1_500):
        pool = "".join(pools[k] for k in r.integers(0, len(pools), r.integers(1, 5)))
        text = "".join(pool[k] for k in r.integers(0, len(pool), r.integers(2, 120)))
        ids, joins = bpe_codec.encode_tree(text, codec, leaf := int(r.choice([1, 2, 3, 5, 8, 16, 40])))
        assert ids == hf.encode(text, add_special_tokens=False).ids, repr(text)
        assert (joins > 0) == (len(text) > leaf)


@pytest.mark.parametrize("which", ["documents", "hard"])
def test_exact_dedup(request, which):
    docs = request.getfixturevalue(which)
    got = exact_dedup.exact_groups(docs).collect()
    groups = {}
    for i, t in texts(docs):
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    rank = lambda i: -1 if i is None else i
    assert bag((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == bag((i, max(g, key=rank), len(g), s) for s, g in groups.items() for i in g)
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns
    assert bag(r["doc_id"] for r in stay.collect()) == bag(max(g, key=rank) for g in groups.values())


@pytest.mark.parametrize("which", ["documents", "hard"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    hf = Tokenizer.from_file(WORDS)
    want = {}
    for i, t in texts(docs):
        want.setdefault(i, []).append([*hf.encode(t, add_special_tokens=False).ids, 1])
    got = packing.pack_documents(docs, WORDS).collect()
    sequences, pieces = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in want[r["doc_id"]])
    assert pieces.keys() == want.keys()
    for i, docs_ in want.items():
        assert sorted(k for r in pieces[i] for k in range(r["start"], r["start"] + r["length"])) == sorted(k for d in docs_ for k in range(len(d)))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.05 * sum(len(d) for x in want.values() for d in x)


def test_packing_uses_every_length_as_often_as_it_occurs():
    counts = {k: (k * 7919) % 13 + 1 for k in range(1, 2049, 3)}
    used = {}
    for pattern, n in packing.pack_histogram(counts):
        assert sum(pattern) <= 2048
        for k in pattern:
            used[k] = used.get(k, 0) + n
    assert used == counts


def test_quality_on_held_out_documents(spark, documents, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    weights = quality.train(docs, labels)
    scored = quality.score_documents(docs, weights)
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.8
    kept = {r["doc_id"] for r in quality.keep_good(docs, weights).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}


def plain_features(text):
    """One list per passage, by plain loops over bytes."""
    data = text.encode()
    if not data:
        return [[0.0] * quality.FEATURES]
    kinds = [int(quality.CLASS_OF[b]) for b in data]
    lines, at = [], 0
    for line in data.split(b"\n"):
        end = min(at + len(line) + 1, len(data))
        if at < end:
            lines.append((at, end))
        at += len(line) + 1
    starts = {a for a, _ in lines}
    for a, b in lines:
        for place in range(a + 400, b, 400) if b - a > 400 else ():
            after = next((k + 1 for k in range(place - 1, len(data)) if data[k] == 32 and k + 1 >= place), len(data))
            starts |= {after} if after < len(data) else set()
    starts = sorted(starts)
    bounds = list(zip(starts, [*starts[1:], len(data)]))
    words, k = [], 0
    while k < len(data):
        e = k
        while e < len(data) and kinds[e] not in (1, 2):
            e += 1
        if e > k:
            words.append((k, e, sum((b + 1) ** 5 * 2654435761 for b in data[k:e]) % (1 << 64)))
        k = e + 1
    out = []
    for a, b in bounds:
        x = [0.0] * quality.FEATURES
        for k in range(max(a, 1), b):
            x[kinds[k - 1] * quality.CLASSES + kinds[k]] += 1 / (b - a)
        own = [w for w in words if a <= w[0] < b]
        if words:
            n, sizes = max(1, len(own)), [e - s for s, e, _ in own]
            mean = sum(sizes) / n
            repeats = sum(u[2] == v[2] for u, v in zip(own, own[1:]))
            x[-10:-3] = [np.log1p(len(own)) / 5, mean / 10, max(0, sum(z * z for z in sizes) / n - mean**2) ** 0.5 / 10, len({w[2] for w in own}) / n, repeats / n, len({w[2] for w in words}) / len(words), np.log1p(len(words)) / 10]
        x[-3:] = [np.log1p(b - a) / 6, np.log1p(len(bounds)) / 6, 1.0]
        out.append(x)
    return out


def plain_score(p, text):
    """Gated attention over passages, one number at a time."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    dot = lambda x, m, j: sum(x[i] * m[i][j] for i in range(len(x)))
    hidden, weights = [], []
    for x in plain_features(text):
        h = [np.tanh(dot(x, p["E"], j)) for j in range(quality.HIDDEN)]
        hidden.append(h)
        weights.append(np.exp(sum(np.tanh(dot(h, p["V"], j)) * sigmoid(dot(h, p["U"], j)) * p["w"][j] for j in range(quality.GATE))))
    z = [sum(w * h[j] for w, h in zip(weights, hidden)) / sum(weights) for j in range(quality.HIDDEN)]
    return sigmoid(sum(z[j] * p["c"][j] for j in range(quality.HIDDEN)) + p["b"][0])


def test_quality_against_loops(monkeypatch):
    weights = quality.start_weights(3)
    for text in ["", "one line of words words words\nand another, with 12 digits!\n\n  ", "x" * 900 + " " + "yz " * 300 + "\nlast", "日本語 のテキスト\t\x01", " ", "a|b|c\n" * 30]:
        assert np.allclose(quality.encode(text), plain_features(text), atol=1e-5)
        want = plain_score(weights, text)
        assert abs(quality.score(weights, text) - want) < 1e-5
        monkeypatch.setattr(quality, "STEP", 2)  # a step of passages at a time gives the same
        assert abs(quality.score(weights, text) - want) < 1e-5
        monkeypatch.undo()


def test_quality_training_leaves_out_whole_rows_only(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "good words here\n" * (k % 7 + 1)) for k in range(60)] + [(0, "twice")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, None), (None, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.append((bags, y)) or quality.start_weights())
    quality.train(docs, labels, passages_most=20)
    bags, y = seen[0]
    assert 14 <= sum(len(b) for b in bags) <= 20 and len(bags) == len(y) and {len(b) for b in bags} <= set(range(1, 8))


def test_quality_of_hard_texts(spark, hard):
    weights = quality.train(hard, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.score_documents(hard, weights).collect()
    assert len(got) == len(hard_texts()) and all(0 <= r["score"] <= 1 for r in got)


def plain_fingerprint(text, size=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    grams = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["documents", "hard"])
def test_simhash(request, which):
    docs = request.getfixturevalue(which)
    rows = [(i, plain_fingerprint(t)) for i, t in texts(docs)]
    root = {f: f for _, f in rows}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    codes = sorted(root)
    for a in codes:
        for b in codes:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = bag((i, f"{f:016x}", least.get(find(f))) for i, f in rows)
    assert bag(map(tuple, simhash.near_groups(docs).collect())) == want


def test_index_finds_what_brute_force_finds():
    r = np.random.default_rng(1)
    codes = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = codes[:500] ^ (np.uint64(1) << r.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 500, dtype=np.uint64))
    index = simhash.HierarchicalIndex(np.unique(np.concatenate([codes, near])))
    q, c = index.search(codes, 2)
    want = {(i, int(x)) for i, code in enumerate(codes) for x in index.codes[np.bitwise_count(index.codes ^ code) <= 2]}
    assert {(int(i), int(index.codes[k])) for i, k in zip(q, c)} == want


@pytest.mark.parametrize("block", [64, 1])
def test_links_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = np.random.default_rng(2)
    codes = [int(x) for x in r.integers(0, 1 << 63, 150)] + [5 << 40 | int(x) for x in r.integers(0, 64, 300)]  # and one crowded block
    codes += [c ^ 1 << 63 ^ 1 << 62 for c in codes[:50]]
    codes = sorted({simhash.signed(c) for c in codes})
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    got = {x["node"]: x["root"] for x in simhash.components(simhash.links(df, len(codes))).collect()}
    group = {c: c for c in codes}
    for _ in codes:
        new = {a: min(group[b] for b in codes if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2) for a in codes}
        if new == group:
            break
        group = new
    assert {c: got.get(c, c) for c in codes} == group


def shingle_sets(rows, n=5):
    out = []
    for i, t in rows:
        w = t.lower().split()
        out.append((i, {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    return out


def test_near_copies(spark):
    r = np.random.default_rng(5)
    text = lambda n: [f"w{x}" for x in r.integers(0, 5000, n)]
    rows = []
    for k in range(20):
        base = text(300)
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[:150] + ["new"] + base[151:])), (10 * k + 2, " ".join(base[:120] + text(180)))]
    rows += [(900, None), (901, " \n"), (902, "short"), (903, "Short"), (None, "lonely words here")]
    docs = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, rid string")
    got = {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()}
    assert got == {10 * k for k in range(20)} | {10 * k + 2 for k in range(20)} | {900, 902, None}


def test_short_and_crowded_near_copies(spark):
    """Edited texts of 13 to 80 words, and copies that only meet in groups of one shared footer, against all pairs."""
    r = np.random.default_rng(7)
    text = lambda n: [f"w{x}" for x in r.integers(0, 5000, n)]
    edited = lambda t, k: [*t[:k], "new", *t[k + 1 :]]
    words = []
    for n in range(13, 81):
        base = text(n)
        words += [base, edited(base, n - 1), edited(base, n // 2)]
    footer = text(60)
    for _ in range(60):
        own = text(8)
        words += [own + footer, edited(own, 4) + footer]
    a, b = text(50), text(50)
    words += [a, edited(a, 2), edited(edited(a, 2), 47), b, b + text(12), b[6:]]  # a chain, and other lengths
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in words]
    root = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8 and root[x] != root[y]:
                low, high = sorted((root[x], root[y]))
                root = [low if k == high else k for k in root]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.drop_near_copies(docs).collect()} == set(root)


@pytest.mark.parametrize("which", ["documents", "hard"])
def test_merkle(request, which):
    docs = request.getfixturevalue(which)
    rows = sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    got = merkle.edited_fingerprints(docs).collect()
    assert bag((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == bag(want)
    text_of = dict(rows)
    by = {}
    for r in got:
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (hashlib.sha256(text_of[r["doc_id"]].encode()).hexdigest() == r["edited_sha256"])
        by.setdefault(text_of[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)
    assert bag((r["doc_id"], r["fingerprint"]) for r in merkle.fingerprint_documents(docs).collect()) == bag((r["doc_id"], r["fingerprint"]) for r in got)


def test_leaves_of_unspaced_texts(spark):
    r = np.random.default_rng(9)
    rows = [(k, "".join(chr(0x4E00 + x) for x in r.integers(0, 5000, 8_000))) for k in range(3)]
    got = merkle.edited_fingerprints(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert all(0.7 < x["near_edited"] < 0.8 and x["near_next"] < 0.01 for x in got)


def plain_tree(text):
    """Sections of (hash, paragraphs of (hash, leaves)), by plain loops over the same rules."""
    long = lambda x: x - (1 << 64) if x >> 63 else x
    def fold(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
        return long(h)

    sections, now = [], []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        words = [m[0].encode() for m in re.finditer(r"[^ \t-\r]{1,32}[ \t-\r]*", line)]
        leaves, h = [], 42
        for n, w in enumerate(words):
            h = xxhash.xxh64_intdigest(w, h)
            if n == len(words) - 1 or xxhash.xxh64_intdigest(w, 42) % 8 == 0:
                leaves, h = [*leaves, long(h)], 42
        now.append((fold(leaves), leaves))
        if k == len(lines) - 1 or now[-1][0] % 8 == 0:
            sections.append((fold([h for h, _ in now]), now))
            now = []
    return sections


def plain_comparison(a, b):
    ta, tb = plain_tree(a), plain_tree(b)
    ha, hb = {s[0] for s in ta}, {s[0] for s in tb}
    pa = [p for h, s in ta if h not in hb for p in s]
    pb = [(p, i, k) for i, (h, s) in enumerate(tb) if h not in ha for k, p in enumerate(s)]
    la, lb = {x for _, l in pa for x in l}, {x for (_, l), _, _ in pb for x in l}
    total = sum(len({x for _, s in t for _, l in s for x in l}) for t in (ta, tb))
    like = 1.0 if a == b or not total else 1 - (len(la - lb) + len(lb - la)) / total
    return like, ",".join(f"{i}:{k}" for (h, _), i, k in pb if h not in {g for g, _ in pa})


@pytest.mark.parametrize("which", ["documents", "hard"])
def test_merkle_trees_against_loops(request, which):
    docs = request.getfixturevalue(which)
    rows = sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        near, differing = plain_comparison(t, edited)
        printed = lambda x: ".".join(f"{h % (1 << 64):016x}({';'.join(''.join(f'{l % (1 << 64):016x}' for l in p) for _, p in s)})" for h, s in plain_tree(x))
        want.append((i, printed(t), printed(edited), round(near, 9), round(plain_comparison(t, after)[0], 9), differing))
    got = [(r["doc_id"], r["fingerprint"][33:], r["edited_fingerprint"][33:], round(r["near_edited"], 9), round(r["near_next"], 9), r["differing"]) for r in merkle.edited_fingerprints(docs).collect()]
    assert bag(got) == bag(want)


def test_a_word_in_front_moves_no_other_leaf(spark):
    r = np.random.default_rng(10)
    words = [f"w{x}" for x in r.integers(0, 5000, 400)]
    rows = [(" ".join(words), " ".join(["new", *words])), (" ".join(words), " ".join([*words[:200], "new", *words[201:]])), (" ".join(words), " ".join(words[7:]))]
    df = merkle.with_tree(merkle.with_tree(spark.createDataFrame(rows, "a string, b string"), "a", "ta"), "b", "tb")
    assert all(x[0] > 0.9 for x in merkle.with_comparison(df, "ta", "tb", "c").select("c.likeness").collect())


def test_differing_branches_locate_an_edit(spark):
    lines = [f"paragraph {k} has the words number {k * k} and some more of its own" for k in range(80)]
    df = spark.createDataFrame([("\n".join(lines), "\n".join([*lines[:40], "an edited paragraph", *lines[41:]]))], "a string, b string")
    df = merkle.with_tree(merkle.with_tree(df, "a", "ta"), "b", "tb")
    same, edit = merkle.with_comparison(merkle.with_comparison(df, "ta", "ta", "x"), "ta", "tb", "y").select("x.branches", "y.branches").first()
    assert same == [] and len(edit) == 1
    sections = plain_tree("\n".join([*lines[:40], "an edited paragraph", *lines[41:]]))
    assert sum(len(s) for _, s in sections[: edit[0]["section"]]) + edit[0]["paragraph"] == 40


@pytest.mark.parametrize("rows", [1, 4])
def test_neighbours_over_many_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(merkle, "BLOCK_ROWS", rows)
    ids = [None, *range(-5, 300, 3), *range(1 << 40, (1 << 40) + 40)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["id"]: r["next_text"] for r in merkle.neighbours(docs, "doc_id", "text").collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_empty_tables(spark, hard):
    none = hard.limit(0)
    frames = [
        pii.detect(none), token_counts.count_tokens(none, BYTES, new_path(spark, "cache")), exact_dedup.exact_groups(none), exact_dedup.drop_copies(none), packing.pack_documents(none, WORDS),
        simhash.near_groups(none), simhash.drop_near_copies(none), merkle.edited_fingerprints(none), bpe_codec.encode_documents(none, BYTES),
        quality.score_documents(none, quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_bloom_ranges_keep_most_rows_out_of_the_shuffle(spark):
    rows = [(k, f"text {k}") for k in range(20_000)] + [(20_000 + k, f"text {k % 100}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    digests = docs.select("doc_id", F.unhex(exact_dedup.digest_of("text")).alias("digest"))
    assert exact_dedup.ranges_of(len(rows), 8_192)[0] == 5
    marked = exact_dedup.marked_rows(digests, len(rows), 8_192)
    assert marked.count() == len(rows) and marked.where("__maybe").count() < 0.1 * len(rows)  # 2 % are repeated
    want = bag(map(tuple, exact_dedup.exact_groups(docs).collect()))
    assert bag(map(tuple, exact_dedup.exact_groups(docs, most=8_192).collect())) == want
    kept = {r[0] for r in want if r[3]}
    assert {r["doc_id"] for r in exact_dedup.drop_copies(docs, most=8_192).collect()} == {r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()} == kept
