"""SimHash near-duplicates through a hierarchical index in Gray order."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exact_dedup
from .common import discard, materialise, small_batches, table, text_or_empty

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Fingerprints of one block of the index, about, and children of a node.
BLOCK = 65_536
FANOUT = 8
#: Candidates that one step of a search holds at once.
FRONTIER = 200_000


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    import xxhash

    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[size - 1 :] - 1).tolist() if len(words) > size else [len(joined)]
    h64 = xxhash.xxh64_intdigest
    return np.array([h64(joined[s:e], SEED) for s, e in zip([0, *ends[: n - 1].tolist()], stops, strict=True)], dtype="<u8")


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Bit i is 1 if set in over half of the shingles' XXH64; no words: 0."""
    hashes = shingle_hashes(words, size)
    votes = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 65_536):  # a very long text in steps
        votes += np.unpackbits(hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp bigint) per row; A-Z lower-cased, words between ASCII white space, nulls as empty."""
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:  # ids stay out of pandas, which has no whole numbers beside nulls
        return pd.Series([signed(fingerprint(t.encode().lower().split(), shingle)) for t in texts], dtype="int64")

    return docs.select(F.col(f"`{id_col}`").alias("id"), of(text_or_empty(f"`{text_col}`")).alias("fp"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, in which neighbours differ in one bit."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class HierarchicalIndex:
    """Codes sorted by Gray rank; each node holds the bits that all codes below it share and its parent lacks."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        levels = [(np.full(len(codes), ~np.uint64(0)), self.codes)]  # (bits shared below a node, their values)
        while len(levels[0][0]) > 1:
            mask, value = levels[0]
            at = np.arange(0, len(mask), FANOUT)
            first = np.repeat(value[at], np.diff(np.append(at, len(mask))))
            shared = np.bitwise_and.reduceat(mask & ~(value ^ first), at)
            levels.insert(0, (shared, value[at] & shared))
        self.levels = [levels[0], *[(m & ~np.repeat(up, FANOUT)[: len(m)], v) for (up, _), (m, v) in zip(levels, levels[1:], strict=False)]]

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) positions within ``most`` bits.

        Differences add up on the way down; a node where they exceed ``most`` takes its whole group with it.
        """
        found_q, found_c = [], []
        for a in range(0, len(queries), 16_384):
            q = np.arange(a, min(a + 16_384, len(queries)))
            todo = [(0, q, np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64))]
            while todo:
                level, q, node, so_far = todo.pop()
                if len(q) > FRONTIER:
                    h = len(q) // 2
                    todo += [(level, q[:h], node[:h], so_far[:h]), (level, q[h:], node[h:], so_far[h:])]
                    continue
                mask, value = self.levels[level]
                so_far = so_far + np.bitwise_count((queries[q] ^ value[node]) & mask[node])
                keep = so_far <= most
                q, node, so_far = q[keep], node[keep], so_far[keep]
                if not len(q):
                    continue
                if level == len(self.levels) - 1:
                    found_q.append(q)
                    found_c.append(node)
                    continue
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, so_far = np.repeat(q, FANOUT), np.repeat(so_far, FANOUT)
                real = child < len(self.levels[level + 1][0])
                todo.append((level + 1, q[real], child[real], so_far[real]))
        none = np.empty(0, dtype=np.int64)
        return (np.concatenate(found_q), np.concatenate(found_c)) if found_q else (none, none)


def forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edges (code, smallest code) that connect what the given edges connect, one for each code."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        for x in (a, b):
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, x, low)
        root = root[root]
        if (root == was).all():
            break
    moved = root != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[root[moved]]], axis=1)


def routes(prefix: int, distance: int) -> list[int]:
    """Masks over ``prefix`` bits with at most ``distance`` of them set."""
    masks = [0]
    for d in range(distance):
        masks += [m | 1 << i for m in masks if bin(m).count("1") == d for i in range(prefix) if not m >> i]
    return sorted(set(masks))


def links(codes: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b), a > b, that connect exactly the distinct codes with a chain of steps of at most ``distance`` bits.

    Blocks of the index are the codes with equal upper bits, which is a range in Gray order, too; they
    are the index's uppermost nodes.  A code is searched in its own block and in each block whose
    pattern differs in at most ``distance`` bits and is smaller (the other way round the pair is the
    same), so all other blocks are pruned before any row moves.
    A block with many times the expected codes is dealt over slices, each with its own tree, and its
    queries visit them all.  Each code has at most 2,080 codes within two bits, and a task returns a
    forest, not pairs.
    """
    prefix = max(0, (max(1, n) // BLOCK).bit_length())
    block = F.expr(f"shiftrightunsigned(fp, {64 - prefix})") if prefix else F.lit(0).cast("long")
    masks = F.array(*[F.lit(m).cast("long") for m in routes(prefix, distance)])
    rows = codes.select("fp", block.alias("home"))
    large = materialise(rows.groupBy(F.col("home").alias("block")).agg(F.count("*").alias("n")).where(F.col("n") > 4 * BLOCK).select("block", F.ceil(F.col("n") / BLOCK).alias("slices")), "large-blocks")
    lower = F.filter(masks, lambda m: (m == 0) | (F.col("home").bitwiseXOR(m) < F.col("home")))
    asked = rows.select("fp", F.explode(lower).alias("m"), "home").select(F.expr("home ^ m").alias("block"), "fp", (F.col("m") == 0).alias("own"))
    sliced = asked.join(large, "block", "left").withColumn("slices", F.coalesce("slices", F.lit(1).cast("long")))
    asked = sliced.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select("block", "slice", "fp", (F.col("own") & (F.expr("pmod(xxhash64(fp), slices)") == F.col("slice"))).alias("own"))

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        code = group["fp"].to_numpy().view(np.uint64)
        own = group["own"].to_numpy()
        index = HierarchicalIndex(code[own]) if own.any() else None
        if index is None:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        q, c = index.search(code, distance)
        a, b = code[q].view(np.int64), index.codes[c].view(np.int64)
        return pd.DataFrame(forest(a[a != b], b[a != b]), columns=["a", "b"]) if (a != b).any() else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})

    return asked.groupBy("block", "slice").applyInPandas(search, "a bigint, b bigint")


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of edges u to v has one edge up and none down, or the other way round.  As u > v, each v then is the smallest node that its u reach."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    degrees = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return degrees.where("up > 1 or up = 1 and n > 1").limit(1).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node that can be reached, for every node of ``edges``.

    Large-star and small-star steps in turn (Kiveris and others, 2014) until only stars are left, which is proven to come about; what
    are stars already costs no step.  Each step is written to the
    shared folder.  Minima are combined on the map side and written before they join back, so a
    node with very many neighbours is split by adaptive execution.
    """
    edges = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        discard(edges, least)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(small.where("u != v").distinct(), "edges")
        discard(large, low)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id that can be reached).

    Rows with one fingerprint are one node, so copies never become pairs.  Null and blank texts have
    the fingerprint zero and are linked like any other; null ids keep their row, and are never a
    component's id unless it has no other; repeated rows keep theirs; an empty table gives none.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), nodes.count(), distance))
    rooted = materialise(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialise(rooted.join(least, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


NEAR_WORDS = 5
SIMILARITY = 0.8
#: Classes of shingles whose occurrences are counted for the order of a text's shingles (a power of two), and parts in which the counts travel.
CLASSES, CLASS_PARTS = 1 << 20, 64
#: Groups that are dealt over several tasks at most, and over how many.
HOT_GROUPS, SALTS = 10_000, 32
#: Texts that a Python worker holds with their shingles at once, and pairs with both sets.
SLICE = 500
#: 64-bit words of a set's parity bitmap.
PARITY_WORDS = 8


def prefix_size(n: int, similarity: float) -> int:
    """Two sets alike to ``similarity`` share one of the first so many elements of each in any common order."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def parity(hashes: np.ndarray) -> list[int]:
    """Bit k says whether an odd number of elements fall on it; so two bitmaps differ in at most as many bits as their sets in elements."""
    odd = np.bincount((hashes & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def class_counts(sets: DataFrame) -> np.ndarray:
    """Occurrences of shingles by class over all sets: an estimate of document frequency, from above."""
    step = CLASSES // CLASS_PARTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES, dtype="<i8")
        for b in batches:
            h = np.frombuffer(b"".join(b["s"]), "<u8")
            total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=CLASSES)
        yield pd.DataFrame({"part": np.arange(CLASS_PARTS), "counts": [zlib.compress(total[k * step : (k + 1) * step].tobytes(), 1) for k in range(CLASS_PARTS)]})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, dtype="<i8")
        for x in group["counts"]:
            total += np.frombuffer(zlib.decompress(x), "<i8")
        return pd.DataFrame({"part": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    found = sets.select("s").mapInPandas(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    out = np.zeros(CLASSES, dtype="<i8")
    for r in found:
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return out


def meet(rows: DataFrame, groups: DataFrame, spread: str = "sid") -> DataFrame:
    """Join on ``g`` with one row a group, which has its size n; rows of a hot group are dealt over SALTS keys.

    Hot are groups with more than a HOT_GROUPS-th of all rows, so there are at most that many, and they may be broadcast.
    """
    limit = (groups.agg(F.sum("n")).first()[0] or 0) // HOT_GROUPS + 1
    hot = F.broadcast(groups.where(F.col("n") > limit).select("g", F.lit(True).alias("__hot")))
    salted = rows.join(hot, "g", "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("__hot")
    salts = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(groups.withColumn("__salt", F.explode(salts)), ["g", "__salt"]).drop("__salt")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike to ``similarity`` or more, checked on the whole sets."""
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0)
        return pd.Series(out, dtype="float64")

    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "wanted")
    likely = exact_dedup.possibly_in(sets, wanted, "sid", "__in").where("__in").drop("__in")  # so that other sets don't move
    texts = materialise(likely.join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "shingles")
    rated = pairs.join(texts.toDF("a", "sa"), "a").join(texts.toDF("b", "sb"), "b")
    out = materialise(rated.where(F.pandas_udf(jaccard, "double")("sa", "sb") >= similarity).select("a", "b"), "alike")
    discard(wanted, texts)
    return out


def near_links(rows: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(nodes: rid, id, sid; links: a, b over sid) of rows (rid, id, text) that connect exactly what pairs of sets of five-word shingles alike to ``similarity`` or more connect.

    Texts with equal sets are one node, sid.  Two alike sets share one of the first ``prefix_size``
    shingles of each in any order that all texts use; the order is by frequency, so these are the rarest.
    First, each text is compared with one leader, that of most of its groups (one shingle in the prefix, or fingerprints that the
    hierarchical index links), where a group's leader is its text with the largest groups; this mostly makes one component of a cluster of copies.  Then
    every pair that shares such a shingle and isn't yet in one component is compared, whatever the
    group's size.  Only proven bounds sort out pairs: sizes, shingles shared within the prefixes, parity bitmaps.
    """
    @F.pandas_udf("sid bigint, fp bigint, n int, bits array<bigint>, s binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        out = []
        for t in texts:
            words = t.encode().lower().split()
            h = np.unique(shingle_hashes(words, NEAR_WORDS))
            s = h.tobytes()
            out.append((signed(xxhash.xxh64_intdigest(s)), signed(fingerprint(words)), len(h), parity(h), s))
        return pd.DataFrame(out, columns=["sid", "fp", "n", "bits", "s"])

    nodes = materialise(rows.select("rid", "id", of("text").alias("x")).select("rid", "id", "x.*"), "near-nodes")
    sets = nodes.select("sid", "s")
    slim = materialise(nodes.groupBy("sid").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits")), "near-sets")
    counts = rows.sparkSession.sparkContext.broadcast(class_counts(sets))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, sizes = [], []
            for s in b["s"]:
                h = np.frombuffer(s, "<u8")
                keys.append(h[np.lexsort((h, counts.value[(h >> np.uint64(44)).astype(np.int64)]))[: prefix_size(len(h), similarity)]])
                sizes.append(len(keys[-1]))
            if sum(sizes):
                yield pd.DataFrame({"g": np.concatenate(keys).view("<i8"), "sid": np.repeat(b["sid"].to_numpy(), sizes), "at": np.concatenate([np.arange(k, dtype="<i4") for k in sizes])})

    filed = sets.mapInPandas(prefixes, "g bigint, sid bigint, at int")  # computed twice: cheaper than a table of a fifth of all shingles
    shared = materialise(filed.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = materialise(meet(filed, shared).groupBy("g", "sid").agg(F.min("at").alias("at"), F.first("n").alias("n")), "members")

    fps = slim.select("fp").distinct()
    roots = components(links(fps, fps.count(), distance))
    linked = slim.select("sid", "fp").join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("g"), "sid")
    degrees = materialise(members.groupBy("sid").agg(F.sum("n").alias("degree")), "degrees")
    ranked = members.select("g", "sid").join(degrees, "sid").unionByName(linked.join(degrees, "sid", "left").select("g", "sid", F.coalesce("degree", F.lit(0)).alias("degree")))
    ranked = materialise(ranked, "ranked")
    leads = ranked.groupBy("g").agg(F.max(F.struct("degree", "sid"))["sid"].alias("lead"), F.min("sid").alias("low"), F.max("sid").alias("high"), F.count("*").alias("n"))
    leads = materialise(leads.where("low < high").select("g", "lead", "n"), "leads")
    led = meet(ranked.select("g", "sid"), leads).where("sid != lead").groupBy("sid", "lead").agg(F.count("*").alias("n"))
    best = led.groupBy("sid").agg(F.max(F.struct("n", "lead")).alias("x")).select(F.col("sid").alias("a"), F.col("x.lead").alias("b"), F.col("x.n").alias("c"))
    best = materialise(best, "best")
    discard(shared, degrees, ranked, leads)
    part = similarity / (1 + similarity)
    bound = f"(n + m) * {1 - 2 * part} + 1e-6"  # most elements that alike sets of n and m differ in
    unlike = " + ".join(f"bit_count(bits[{k}] ^ others[{k}])" for k in range(PARITY_WORDS))
    # At most c shingles in common within both prefixes, and those beyond the one that ends first.
    within = f"c + greatest(n, m) - floor(greatest(n, m) * {1 - similarity} + 1e-6) - 1 >= (n + m) * {part} - 1e-6 and least(n, m) >= greatest(n, m) * {similarity} - 1e-6"
    other = slim.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("others"))
    stars = best.join(slim.select(F.col("sid").alias("a"), "n", "bits"), "a").join(other, "b")
    stars = materialise(stars.where(f"{within} and {unlike} <= {bound}").select("a", "b"), "stars")  # what c counts too low is left to the next step
    first = alike(stars, sets, similarity)

    comps = components(first)
    placed = members.select("g", "sid", "at").join(comps, F.col("sid") == F.col("node"), "left").select("g", "sid", "at", F.coalesce("root", "sid").alias("c"))
    placed = materialise(placed, "placed-members")
    apart = placed.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high").select("g", "n")
    apart = materialise(apart, "apart")
    discard(best, stars, members)
    left = materialise(meet(placed, apart).drop("n").join(slim.select("sid", "n", "bits"), "sid"), "left")
    right = left.select("g", F.col("sid").alias("other"), F.col("at").alias("place"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("bits").alias("others"))
    meets = f"sid < other and c != d and {unlike} <= {bound}"
    discard(placed, apart)
    met = left.join(right, "g").where(meets).groupBy(F.col("sid").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    rest = materialise(met.where(within).select("a", "b"), "rest")
    found = comps.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))  # connects what ``first`` does
    if not rest.isEmpty():
        found = found.unionByName(alike(rest, sets, similarity))
    discard(left, rest, slim, first)
    narrow = materialise(nodes.select("rid", "id", "sid"), "near-ids")
    discard(nodes)
    return narrow, found


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each near-duplicate group (the smallest id), with all their columns.

    Blank texts are alike; nulls count as blank and null ids as smallest.  Repeated rows of one id and
    text stay or go together.  An empty table stays empty.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column's name can clash
    i, text = F.col(f"`{id_col}`"), text_or_empty(f"`{text_col}`")
    key = F.unhex(F.substring(F.sha2(F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit("\n"), text), 256), 1, 32))  # 128 bits
    rows = docs.select(whole, i.alias("id"), key.alias("rid"))
    with small_batches(docs.sparkSession, SLICE):
        nodes, near = near_links(docs.select(key.alias("rid"), i.alias("id"), text.alias("text")), distance, similarity)
    roots = components(near)
    placed = materialise(nodes.join(roots, F.col("sid") == F.col("node"), "left").select("rid", "id", F.coalesce("root", "sid").alias("root")), "placed")
    least = materialise(placed.groupBy("root").agg(F.min(F.struct("id", "rid")).alias("stays"), F.count("*").alias("n")).where("n > 1").select("root", "stays"), "stays")
    gone = materialise(placed.join(least, "root").where(F.col("rid") != F.col("stays.rid")).select("rid").distinct(), "gone")
    return rows.join(gone, "rid", "left_anti").select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
