"""Near vectors, hard negatives and runs of words against plain loops."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from framelake.llm import hard_negatives as H
from framelake.llm import periodic as P
from framelake.llm import projections as J
from framelake.llm import registry
from framelake.llm.common import table

BIG = 9007199254740993


def groups(x, similarity=0.95):
    """(links, smallest place reached) of each row by all pairs."""
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in x]
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if o else None for v, o in zip(x, ok, strict=True)]
    near = [[b for b in range(len(x)) if a != b and ok[a] and ok[b] and len(x[a]) == len(x[b]) and unit[a] @ unit[b] >= similarity] for a in range(len(x))]
    root = list(range(len(x)))
    for _ in x:
        new = [min([root[a], *(root[b] for b in near[a])]) for a in range(len(x))]
        if new == root:
            break
        root = new
    return [len(n) for n in near], root


@pytest.mark.parametrize("cell", [2048, 16])
def test_near_vectors(spark, cell):
    r = np.random.default_rng(3)
    x = [r.normal(size=24) for _ in range(150)]
    for k in range(120):  # some just beside the threshold, some chains
        other = r.normal(size=24)
        x.append(x[int(r.integers(len(x)))] + other / np.linalg.norm(other) * r.uniform(0.5, 1.9))
    x += [x[0] * 3, x[1] * 1e-300, x[2] * 1e300, x[5], x[5], x[5], *(x[9] + r.normal(size=24) * 0.05 for _ in range(90))]
    x = [list(map(float, v)) for v in x] + [None, [], [0.0] * 24, [1.0] * 23, [1.0] * 23 + [None], [1.0] * 23 + [float("nan")], [1.0] * 23 + [float("inf")]]
    n, root = groups(x)
    rows = spark.createDataFrame([(k, v, "x", "y") for k, v in enumerate(x)], "vec_id long, embedding array<double>, node string, `odd.name` string")
    got = J.near_vectors(rows, cell=cell).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(k, n[k], root[k], root[k] == k) for k in range(len(x))]
    assert max(n) > 60


def test_near_vectors_keep_ids(spark):
    v = [1.0, 2.0]
    rows = spark.createDataFrame([(BIG, v), (None, v), (BIG + 2, v), (BIG + 2, v), (None, None), (BIG + 4, [2.0, -1.0])], "vec_id long, embedding array<float>").coalesce(1)
    got = sorted(map(tuple, J.near_vectors(rows).collect()), key=repr)
    assert got == sorted([(BIG, 3, BIG, True), (None, 3, BIG, False), (BIG + 2, 3, BIG, False), (BIG + 2, 3, BIG, False), (None, 0, None, False), (BIG + 4, 0, BIG + 4, True)], key=repr)
    assert J.near_vectors(rows.limit(0)).count() == 0


def test_chances_of_a_pair_at_the_threshold():
    need, half = J.collisions_needed(), J.HALF_WINDOW * math.sqrt(0.1)
    r = np.random.default_rng(5)
    a = r.normal(size=(4000, 3))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = np.cross(a, r.normal(size=a.shape))
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1)[:, None]
    hits = [(np.abs(u @ d - v @ d) <= half).sum() >= need for u, v in zip(a, b, strict=True) for d in [r.normal(size=(3, J.PROJECTIONS))]]
    assert np.mean(hits) >= 0.998 and need > J.PROJECTIONS / 3
    for cuts in (1, 5, 20):
        meet = (1 - math.acos(0.95) / math.pi) ** cuts
        assert 1 - (1 - meet) ** J.views_needed(cuts, 0.95) >= J.RECALL


def plain_negatives(rows, anchors):
    out = []
    for a, label, x in anchors:
        own = [(sum(map(int.__mul__, x, y)), b, k) for k, (b, m, y) in enumerate(rows) if m == label and y is not x]
        other = [(sum(map(int.__mul__, x, y)), b, k) for k, (b, m, y) in enumerate(rows) if m != label]
        for s, p, _ in sorted(own, key=lambda t: (-t[0], t[1:]))[:5]:
            fits = sorted((t for t in other if 80 * s <= 100 * t[0] <= 100 * s), key=lambda t: (-t[0], t[1:]))[:5]
            out += [(a, p, k + 1, t[1], s, t[0]) for k, t in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("cell", [1024, 12])
def test_hard_negatives(spark, cell):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 10))
    data = []
    for k in range(420):
        label = "hot" if k % 3 == 0 else f"l{k % 5}"
        data.append((BIG + k // 2 * 2 if k < 40 else k, label, [float(c) for c in (centres[k % 6] * (k % 7 != 0) + r.normal(size=10) * (0.05 if k % 2 else 0.5))]))
    data += [(500, "l1", data[50][2]), (500, "l1", data[50][2]), (501, None, data[3][2]), (None, "l1", data[3][2]), (502, "l2", None), (503, "l2", [None] + [1.0] * 9), (504, "l2", [float("nan")] + [1.0] * 9), (505, "l2", [1.0] * 9), (506, "l3", [0.0] * 10)]
    rows = spark.createDataFrame([(*t, 1) for t in data], "vec_id long, label string, embedding array<double>, x int")
    whole = [(i, m, [math.floor(256 * c) for c in v]) for i, m, v in data if i is not None and m is not None and v is not None and len(v) == 10 and all(c is not None and math.isfinite(c) for c in v)]
    want = plain_negatives(whole, [t for t in whole if t[0] % 10 == 0])
    got = H.hard_negatives(rows, rows["vec_id"] % 10 == 0, cell=cell)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    assert H.hard_negatives(rows.limit(0), rows["vec_id"] % 10 == 0).count() == 0


def test_searches_broadcast_no_table_that_grows(spark, monkeypatch):
    plans, real = [], H.materialise

    def kept(df, name):
        if name == "best":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(H, "materialise", kept)
    r = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, f"l{k % 3}", [float(c) for c in r.normal(size=4)]) for k in range(300)], "vec_id long, label string, embedding array<double>")
    assert H.hard_negatives(rows, rows["vec_id"] % 10 == 0, cell=12).count() > 50
    assert sum("SortMergeJoin" in p for p in plans) >= 2 and not any("BroadcastHashJoin" in p for p in plans)


def test_cells_left_out_cannot_matter():
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(40, 8)) * 3 + c for c in r.normal(size=(8, 8)) * 200]).round()
    books = [H.codebook(x[:, :4], 5), H.codebook(x[:, 4:], 5)]
    (i, d1), (j, d2) = H.nearest(x[:, :4], books[0]), H.nearest(x[:, 4:], books[1])
    import pandas as pd

    cells = pd.DataFrame({"cell": i * 5 + j, "r1": d1, "r2": d2}).groupby("cell").agg(n=("r1", "size"), r1=("r1", "max"), r2=("r2", "max")).reset_index()
    index, visited = H.MultiIndex(*books, cells), 0
    for q in x[::9]:
        s = x @ q
        found = list(index.sequence(q))
        assert {c for c, *_ in found} == set(cells["cell"])
        for k, (cell, rest, high, low) in enumerate(found):
            own = s[i * 5 + j == cell]
            later = np.isin(i * 5 + j, [c for c, *_ in found[k:]])
            assert low <= own.min() and own.max() <= high and s[later].max() <= rest
        least, seen = np.sort(s)[-5], 0
        while seen >= 0:
            more, seen = H.visits(index, q, seen, 2, least, np.inf)
            visited += len(more)
    assert visited < 0.7 * len(x[::9]) * len(cells)  # bounds do leave cells out


def test_scores_are_whole_numbers():
    assert H.scores(np.array([[1 << 30, 1]]), np.array([[1 << 30, 1]])).tolist() == [[(1 << 60) + 1]]


def plain_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                best[s, i - s + q] = min(q, best.get((s, i - s + q), q))
            i += 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_plain_loops():
    r = random.Random(1)
    found = 0
    for _ in range(8000):
        w = [b"%d" % r.randint(0, r.choice([1, 2, 3])) for _ in range(r.randint(0, 40))]
        if w and r.random() < 0.5:
            a, p = r.randrange(len(w)), r.randint(1, 6)
            w = [w[k] if k < a else w[min(a + (k - a) % p, len(w) - 1)] for k in range(len(w))]
        assert P.runs_of(w) == plain_runs(w)
        found += len(plain_runs(w))
    assert found > 1000


def test_runs_of_long_texts():
    assert P.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert P.runs_of([b"a", b"b"] * 50_000 + [b"c"]) == [(0, 100_000, 2)]
    lines = [w for k in range(20_000) for w in (b"same", b"line", b"in", b"each", b"place", b"again", b"%d" % k)]
    assert P.runs_of(lines) == []


def test_with_runs(spark):
    data = [(BIG, "x a a a a a a y"), (None, None), (BIG + 2, "  "), (BIG + 2, "  "), (1, "p q\tp\nq p q p q é"), (2, "A a A a a a")]
    rows = spark.createDataFrame([(*t, "kept") for t in data], "doc_id long, text string, `odd.name` string").coalesce(1)
    got = {(r["doc_id"], r["text"]): ([tuple(x) for x in r["runs"]], r["collapsed"], r["odd.name"]) for r in P.with_runs(rows).collect()}
    assert got[BIG, "x a a a a a a y"] == ([(1, 6, 1)], "x a y", "kept")
    assert got[None, None] == ([], "", "kept") and got[BIG + 2, "  "] == ([], "", "kept")
    assert got[1, "p q\tp\nq p q p q é"] == ([(0, 8, 2)], "p q é", "kept") and got[2, "A a A a a a"] == ([], "A a A a a a", "kept")
    assert P.with_runs(rows).count() == 6 and P.with_runs(rows.limit(0)).count() == 0


def test_op13_runs(spark, sf):
    rows = {r["doc_id"]: r for r in registry.QUERIES["op13_runs"](spark, sf).collect()}
    changed = 0
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for i, text in docs:
        w, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, changed = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)], changed + 1
        runs, r = plain_runs(w), rows[i]
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        assert (r["n_runs"], r["runs_sha256"]) == (len(runs), hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest())
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert changed > 5
