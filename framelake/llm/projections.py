"""Embedding near-duplicates by counting collisions in sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import discard, materialise, table
from .simhash import components, forest

SIMILARITY = 0.95
#: Projections whose collisions are counted, and half a window in standard deviations of the projected difference of a pair at the threshold.
PROJECTIONS, HALF_WINDOW = 16, 1.5
#: Chance that a pair just at the threshold has enough collisions, and that it meets in one of the views.  Closer pairs have more.
RECALL = 0.9995
#: Vectors of one cell, about; more than CROWDED times as many are dealt over slices.
CELL, CROWDED = 2_048, 4
#: Queries that count at once, and pairs that are verified at once.
QUERIES, PAIRS = 256, 16_384
SEED = 11


def window_chance(half: float = HALF_WINDOW) -> float:
    """A Gaussian projection of a pair's difference is normal with the pair's distance as its deviation, in any number of dimensions."""
    return math.erf(half / math.sqrt(2))


def collisions_needed(m: int = PROJECTIONS, p: float | None = None, recall: float = RECALL) -> int:
    """Most collisions out of ``m`` that a pair at the threshold still reaches with chance ``recall``."""
    p = window_chance() if p is None else p
    tail, need = 0.0, m + 1
    while need > 0 and tail < recall:
        need -= 1
        tail += math.comb(m, need) * p**need * (1 - p) ** (m - need)
    return need


def views_needed(cuts: int, similarity: float, recall: float = RECALL) -> int:
    """Views after which a pair at the threshold has been on one side of all of a view's ``cuts`` with chance ``recall``."""
    meet = (1 - math.acos(similarity) / math.pi) ** cuts
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def directions(dim: int, n: int, what: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, what]).standard_normal((dim, n))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def pairs_within(a: np.ndarray, b: np.ndarray, half: float, need: int, triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) in steps of a few queries: rows of projections ``a`` and ``b`` that collide at least ``need`` times.

    Each projection of ``b`` is sorted; the query's window around its own value is a range of places there, and a row
    collides if its place is in the range.  With ``triangle``, a is b, and only i < j is given.
    """
    order = np.argsort(b, axis=0, kind="stable")
    place = np.empty(b.shape, dtype=np.uint32)
    np.put_along_axis(place, order, np.arange(len(b), dtype=np.uint32)[:, None], axis=0)
    ordered = np.take_along_axis(b, order, axis=0)
    low = np.stack([np.searchsorted(ordered[:, k], a[:, k] - half, side="left") for k in range(b.shape[1])]).astype(np.uint32)
    width = np.stack([np.searchsorted(ordered[:, k], a[:, k] + half, side="right") for k in range(b.shape[1])]).astype(np.uint32) - low
    small = np.uint16 if len(b) < 1 << 16 else np.uint32
    place, low, width = np.ascontiguousarray(place.T).astype(small), low.astype(small), width.astype(small)
    for s in range(0, len(a), QUERIES):
        e, first = min(s + QUERIES, len(a)), s if triangle else 0
        count = np.zeros((e - s, len(b) - first), dtype=np.uint8)
        for k in range(b.shape[1]):
            count += (place[k, None, first:] - low[k, s:e, None]) < width[k, s:e, None]  # places below the range wrap around
        i, j = np.nonzero(count >= need)
        i, j = i + s, j + first
        if triangle:
            i, j = i[i < j], j[i < j]
        yield i, j


def cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    parts = [np.einsum("ij,ij->i", x[i[k : k + PAIRS]], y[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
    return np.concatenate(parts) / (nx[i] * ny[j]) if parts else np.empty(0)


def counted(group: pd.DataFrame, kind: str, view: int, similarity: float, half: float, need: int, one_slice: bool) -> pd.DataFrame:
    """(a, b, n) of one cell: for each vector a the number n of rows that it links to, and with n = 0 a forest of the links, a to b.

    A pair that already met in an earlier view was counted there: it has the same collisions in every view.
    """
    side = group["side"].to_numpy()
    at = [np.arange(len(group))] * 2 if one_slice else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    x = scaled(np.frombuffer(b"".join(group["vec"]), kind).reshape(len(group), -1).astype(np.float64))
    p = np.frombuffer(b"".join(group["places"]), "<f4").reshape(len(group), -1)
    codes = np.frombuffer(b"".join(group["codes"]), "<i4").reshape(len(group), -1)
    node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    total, edges = np.zeros(len(group), dtype=np.int64), np.empty((0, 2), dtype=np.int64)
    if all(len(k) for k in at):
        for i, j in pairs_within(p[at[0]], p[at[1]], half, need, one_slice):
            i, j = at[0][i], at[1][j]
            new = ~(codes[i, :view] == codes[j, :view]).any(axis=1) if view else np.ones(len(i), dtype=bool)
            i, j = i[new], j[new]
            linked = cosines(x, x, i, j) >= similarity
            i, j = i[linked], j[linked]
            total += np.bincount(i, copies[j], len(total)).astype(np.int64) + np.bincount(j, copies[i], len(total)).astype(np.int64)
            edges = forest(np.append(edges[:, 0], node[i]), np.append(edges[:, 1], node[j]))
    some = np.flatnonzero(total)
    rows = np.zeros((len(some) + len(edges), 3), dtype=np.int64)
    rows[: len(some), 0], rows[: len(some), 2] = node[some], total[some]
    rows[len(some) :, :2] = edges
    return pd.DataFrame(rows, columns=["a", "b", "n"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept (id = component_id).

    Rows link where their cosine is ``similarity`` or more.  Equal vectors are one node with a number of copies, so copies
    never become pairs.  A pair is a candidate if it collides in enough of PROJECTIONS sorted Gaussian projections: their windows
    are centred on the query, and the count is the most that a pair just at the threshold reaches with chance ``recall``.  Candidates
    are verified on the whole vectors, so no link is wrong.

    So that tasks stay small, vectors count collisions within cells: the halves of further sorted projections, cut at 0, as many as
    make a cell some ``cell`` vectors; a pair that one view's cuts part meets in another, and there are as
    many views as give chance ``recall`` for a pair at the threshold.  Cells are disjoint in a view, and a pair counts in the first view in which it
    meets.  A crowded cell of n vectors is dealt over slices, each pair of which is a task: it moves n * n / ``cell`` rows.

    Null, zero and non-finite vectors link with nothing; vectors of different lengths don't link.  Null ids keep their rows: they count as
    others do but are no component's id unless it has no other, and are never kept; repeated rows link with each other.  An empty table gives none;
    other columns are ignored.
    """
    v = F.col(f"`{vector_col}`")
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == FloatType() else "<f8"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else (np.asarray(x, dtype=kind) + 0.0).astype(kind).tobytes())  # -0 as 0

    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), packed(F.when(usable, v)).alias("vec"))
    rows = materialise(rows.withColumn("digest", F.unhex(F.sha2("vec", 256))), "vectors")
    nodes = rows.where("vec is not null").groupBy("digest").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("copies"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    cuts = max(0, math.ceil(math.log2(max(1, nodes.count()) / cell)))
    views, need = views_needed(cuts, similarity, recall), collisions_needed(recall=recall)
    half = HALF_WINDOW * math.sqrt(2 - 2 * similarity)
    width = int(kind[-1])

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby(b["vec"].map(len) // width):
                x = scaled(np.frombuffer(b"".join(g["vec"]), kind).reshape(len(g), dim).astype(np.float64))
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                sides = (x @ directions(dim, views * cuts, 1) >= 0).reshape(len(g), views, cuts)
                codes = (sides << np.arange(cuts)).sum(axis=2).astype("<i4")
                places = (x @ directions(dim, PROJECTIONS, 2)).astype("<f4")
                yield g[["node", "copies", "vec"]].assign(dim=dim, codes=[c.tobytes() for c in codes], cells=list(codes), places=[p.tobytes() for p in places])

    schema = "node bigint, copies bigint, vec binary, dim int, codes binary, cells array<int>, places binary"
    dealt = materialise(nodes.select("node", "copies", "vec").mapInPandas(projected, schema), "projected")
    at = dealt.select("dim", F.posexplode("cells").alias("view", "cell"))
    sizes = at.groupBy("dim", "view", "cell").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED * cell)
    sizes = materialise(sizes.select("dim", "view", "cell", F.ceil(F.col("n") / cell).cast("int").alias("slices")), "crowded")
    each = dealt.select("*", F.posexplode("cells").alias("view", "cell")).drop("cells").join(sizes, ["dim", "view", "cell"], "left")
    each = each.withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    each = each.select("node", "copies", "vec", "codes", "places", "dim", "view", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def task(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, view, _, low, high = key
        return counted(group, kind, view, similarity, half, need, low == high)

    found = materialise(each.groupBy("dim", "view", "cell", "low", "high").applyInPandas(task, "a bigint, b bigint, n bigint"), "links")
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0").select("a", "b"))
    placed = nodes.select("digest", "node", "least", "copies").join(links, F.col("node") == F.col("a"), "left").drop("a")
    placed = placed.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("digest", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    placed = materialise(placed, "placed")
    least = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialise(placed.join(least, "root").select("digest", "n_links", "component_id"), "named")
    discard(nodes, dealt, sizes, found, placed, least)
    linked = rows.where("digest is not null").select("id", "digest").join(named, "digest").select("id", "n_links", "component_id")
    alone = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op11_near_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id AS i, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND list_bool_and([c IS NOT NULL AND isfinite(c) FOR c IN embedding]) AND list_bool_or([c <> 0 FOR c IN embedding])),
        links AS (SELECT a.i AS a, b.i AS b FROM v a, v b WHERE a.i <> b.i AND list_cosine_similarity(a.x, b.x) >= 0.95),
        reach AS (SELECT a AS i, b AS r FROM links UNION SELECT reach.i, b FROM reach JOIN links ON a = r)
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, (SELECT min(r) FROM reach WHERE i = vec_id)) AS component_id,
               vec_id = least(vec_id, (SELECT min(r) FROM reach WHERE i = vec_id)) AS kept FROM embeddings"""
}
