"""Hard negatives by exact search in an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches, table

#: Rows that the codebooks are fitted on at most: those with the smallest hashes of their ids.  All rows are indexed.
MAX_TRAIN = 20_000
#: Rows of a cell, about, and codewords of a codebook at most: so there are at most MAX_WORDS * MAX_WORDS cells, whose sizes and radii the driver holds.
CELL, MAX_WORDS = 1_024, 256
#: Cells that a search visits in its first round; each further round visits GROWTH times as many.
FIRST_CELLS, GROWTH = 16, 8
#: Queries of one pack.
PACK = 256
ROUNDS_OFF = 1e-6  # bounds are floating point, scores are integers


def codebook(x: np.ndarray, k: int, steps: int = 10, seed: int = 12) -> np.ndarray:
    """Centres of k-means."""
    r = np.random.default_rng(seed)
    centres = x[np.sort(r.choice(len(x), min(k, len(x)), replace=False))].astype(np.float64) if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(steps if len(x) else 0):
        own = nearest(x, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, distance from it)."""
    own = np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(1))


class MultiIndex:
    """Two codebooks over halves of vectors, and of each cell (a pair of codewords) its number of rows and the radii of its halves."""

    def __init__(self, first: np.ndarray, second: np.ndarray, cells: pd.DataFrame):
        self.books = first, second
        self.rows = {int(c): int(n) for c, n in zip(cells["cell"], cells["n"], strict=True)}
        self.radii = {int(c): (a, b) for c, a, b in zip(cells["cell"], cells["r1"], cells["r2"], strict=True)}
        width = len(second)
        self.widest = np.zeros(len(first)), np.zeros(width)
        for c, (a, b) in self.radii.items():
            self.widest[0][c // width] = max(self.widest[0][c // width], a)
            self.widest[1][c % width] = max(self.widest[1][c % width], b)

    def sequence(self, q: np.ndarray) -> Iterator[tuple[int, float, float, float]]:
        """(cell, most that any row of this and later cells can score, most and least that a row of this cell can score), best first.

        Codewords of each half go by q . c + |q| r, the most that a row of theirs can score on that half; a heap visits pairs by the
        sum.  A pair enters when its neighbours on either side have left.
        """
        halves = q[: self.books[0].shape[1]], q[self.books[0].shape[1] :]
        inner = [b @ h for b, h in zip(self.books, halves, strict=True)]
        length = [float(np.sqrt((h * h).sum())) for h in halves]
        bound = [i + n * w for i, n, w in zip(inner, length, self.widest, strict=True)]
        order = [np.argsort(-b, kind="stable") for b in bound]
        heap, seen, width = [(-(bound[0][order[0][0]] + bound[1][order[1][0]]), 0, 0)], {(0, 0)}, len(order[1])
        while heap:
            most, i, j = heapq.heappop(heap)
            a, b = int(order[0][i]), int(order[1][j])
            if (cell := a * width + b) in self.rows:
                r = length[0] * self.radii[cell][0] + length[1] * self.radii[cell][1]
                slack = ROUNDS_OFF * (1 + abs(most))
                yield cell, -most + slack, inner[0][a] + inner[1][b] + r + slack, inner[0][a] + inner[1][b] - r - slack
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(order[0]) and y < width and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(bound[0][order[0][x]] + bound[1][order[1][y]]), x, y))


def visits(index: MultiIndex, q: np.ndarray, seen: int, batch: int, least: float, most: float) -> tuple[list[int], int]:
    """(cells to visit next, cells of the sequence that are dealt with; -1 once no row of a later cell can score ``least`` to ``most``)."""
    cells: list[int] = []
    for k, (cell, rest, high, low) in enumerate(index.sequence(q)):
        if rest < least:
            return cells, -1
        if k >= seen:
            if len(cells) == batch:
                return cells, k
            if high >= least and low <= most:
                cells.append(cell)
    return cells, -1


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in floating point below 2^53, else with whole numbers of any size."""
    if not q.size or not x.size or float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ x.astype(object).T).astype(np.int64)


def best(score: np.ndarray, ok: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores among ``ok``, of equal ones the first."""
    at = np.flatnonzero(ok)
    if len(at) > n:
        at = at[score[at] >= np.partition(score[at], -n)[-n]]
    return at[np.argsort(-score[at], kind="stable")[:n]]


def build(rows: DataFrame, cell: int = CELL) -> tuple[MultiIndex | None, DataFrame, DataFrame]:
    """(index, rows with their cell, blocks of rows) of ``rows``: rid, id, label, x (array of whole numbers, all of one length).

    A cell's rows are packed into blocks of about ``cell`` rows in order of their ids, dealt by hash, so that a cell with a third of all
    rows is many blocks.
    """
    n = rows.count()
    some = np.array([r["x"] for r in rows.orderBy(F.xxhash64("id", "rid"), "rid").limit(MAX_TRAIN).select("x").collect()], dtype=np.float64)
    dim = some.shape[1] if some.size else 0
    k = max(1, min(MAX_WORDS, math.ceil(math.sqrt(n / cell))))
    books = [codebook(some[:, : dim // 2], k), codebook(some[:, dim // 2 :], k)] if dim else [np.zeros((1, 0))] * 2

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["x"]).astype(np.int64)
            (i, r1), (j, r2) = (nearest(h.astype(np.float64), c) for h, c in zip((x[:, : dim // 2], x[:, dim // 2 :]), books, strict=True))
            yield b[["rid", "id", "label"]].assign(x=[v.tobytes() for v in x], cell=i * len(books[1]) + j, r1=r1, r2=r2)

    placed = materialise(rows.select("rid", "id", "label", "x").mapInPandas(assign, "rid bigint, id bigint, label string, x binary, cell int, r1 double, r2 double"), "index")
    sizes = materialise(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")), "cells")
    cells = sizes.toPandas()  # at most MAX_WORDS^2 rows
    index = MultiIndex(books[0], books[1], cells) if len(cells) else None
    parts = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / cell).alias("parts")))  # no literals: they would stand in each copy of the plan
    spread = placed.join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))

    def block(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["id", "rid"], kind="stable")
        return pd.DataFrame({"cell": [g["cell"].iloc[0]], "rids": [g["rid"].to_numpy("<i8").tobytes()], "ids": [g["id"].to_numpy("<i8").tobytes()], "labels": [g["label"].tolist()], "xs": [b"".join(g["x"])]})

    blocks = spread.groupBy("cell", "block").applyInPandas(block, "cell int, rids binary, ids binary, labels array<string>, xs binary")
    return index, placed, materialise(blocks, "blocks")


WINDOW = "struct<key:bigint,low:bigint,high:bigint>"


def search(queries: DataFrame, blocks: DataFrame, index: MultiIndex, same: bool, n: int) -> DataFrame:
    """(rid, key, score, id, other): for each window of each query its ``n`` best rows with the query's label (or with another one), ties by smaller id.

    queries: rid, label, x, windows (key, low, high): scores from low to high count.  Rounds visit each query's cells in the
    order of its sequence.  Joins are by sorting: from a table's files, or from rows before an array is exploded, Spark takes these tables for far
    smaller than they are, and would broadcast them through the driver.  A window is certified when it has n rows and no cell left can beat the last, or when none left can reach
    its low end; a query whose windows all are, leaves.  Nothing but the bounds ends a search, so the result is exact.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(index)  # at most MAX_WORDS^2 cells
    state = materialise(queries.select("rid", "label", "x", "windows", F.lit(0).alias("seen"), F.transform("windows", lambda w: w["low"]).alias("needs")), "queries")
    top = materialise(spark.createDataFrame([], "rid bigint, key bigint, score bigint, id bigint, other bigint"), "best")
    batch, active = FIRST_CELLS, state.count()

    while active:
        def plan(batches: Iterator[pd.DataFrame], batch: int = batch) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = []
                for x, ws, needs, seen in zip(b["x"], b["windows"], b["needs"], b["seen"], strict=True):
                    got.append(visits(shared.value, np.frombuffer(x, "<i8").astype(np.float64), seen, batch, float(min(needs)), float(max(w["high"] for w in ws))))
                yield b.assign(cells=[c for c, _ in got], seen=[s for _, s in got])

        schema = f"rid bigint, label string, x binary, windows array<{WINDOW}>, seen int, needs array<bigint>"
        planned = materialise(state.mapInPandas(plan, schema + ", cells array<int>"), "plan")
        packs = -(-active // PACK)
        asked = planned.select(F.explode("cells").alias("cell"), F.pmod(F.xxhash64("rid"), F.lit(packs)).alias("pack"), F.struct("rid", "label", "x", "windows", "needs").alias("q"))
        asked = asked.groupBy("cell", "pack").agg(F.collect_list("q").alias("qs"))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for qs, rids, ids, labels, xs in zip(b["qs"], b["rids"], b["ids"], b["labels"], b["xs"], strict=True):
                    rid, number = np.frombuffer(rids, "<i8"), np.frombuffer(ids, "<i8")
                    s = scores(np.stack([np.frombuffer(q["x"], "<i8") for q in qs]), np.frombuffer(xs, "<i8").reshape(len(rid), -1))
                    label = np.asarray(labels, dtype=object)
                    for q, row in zip(qs, s, strict=True):
                        fits = (label == q["label"]) & (rid != q["rid"]) if same else label != q["label"]
                        for w, need in zip(q["windows"], q["needs"], strict=True):
                            for k in best(row, fits & (row >= need) & (row <= w["high"]), n):
                                out.append((q["rid"], w["key"], row[k], number[k], rid[k]))
                yield pd.DataFrame(out, columns=["rid", "key", "score", "id", "other"]).astype("int64")

        with small_batches(spark, 16):
            fresh = blocks.join(asked.hint("merge"), "cell").select("qs", "rids", "ids", "labels", "xs").mapInPandas(score, "rid bigint, key bigint, score bigint, id bigint, other bigint")
            order = [F.col("score").desc(), "id", "other"]
            every = top.unionByName(fresh)
            local = every.withColumn("__p", F.spark_partition_id()).withColumn("__r", F.row_number().over(Window.partitionBy("rid", "key", "__p").orderBy(*order))).where(F.col("__r") <= n).drop("__r", "__p")
            ranked = local.withColumn("__r", F.row_number().over(Window.partitionBy("rid", "key").orderBy(*order))).where(F.col("__r") <= n).drop("__r")
            new_top = materialise(ranked, "best")
        full = new_top.groupBy("rid", "key").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") == n)
        lasts = full.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("key", "last"))).alias("lasts"))  # a query's windows: few
        left = planned.where("seen >= 0").drop("cells").join(lasts.hint("merge"), "rid", "left")
        need = F.transform("windows", lambda w: F.coalesce(F.try_element_at("lasts", w["key"]), w["low"]))
        new_state = materialise(left.select("rid", "label", "x", "windows", "seen", need.alias("needs")), "queries")
        discard(state, top, planned)
        state, top, batch = new_state, new_top, batch * GROWTH
        active = state.count()
    discard(state)
    return top


LOWEST, HIGHEST = -(1 << 62), 1 << 62


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 5, floor_percent: int = 80, cell: int = CELL,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Components become floor(scale * x) and scores are inner products.  An anchor's positives are its best other rows of the same label; the
    negatives of each are the best rows of other labels that score from ``floor_percent`` of the positive's score up to it.  Ties go by smaller id.

    Two codebooks over the halves of a vector, fitted on a bounded sample, form the cells of an inverted multi-index of all rows.  Each anchor visits
    cells by a heap over the sum of what its halves can score with a codeword and its radius at most, first until its positives are certain, then
    until the windows below them are.  Rows of a cell are blocks and anchors packs, so no task holds all of a
    cell or all anchors, and only at most MAX_WORDS^2 radii are broadcast.  Vectors without structure have loose bounds: then
    every cell is visited, in blocks.

    Rows without id, label or vector, or with a null or non-finite component, take no part, nor do vectors of
    another length than most; a score must fit in 64 bits.  Repeated rows are rows of their own: an anchor's copy may be
    its positive, and repeated anchors each give rows.  An anchor without positives, a negative positive score and an empty window give
    no rows, as does an empty table; other columns are ignored.
    """
    x = F.col(f"`{vector_col}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.when(finite, x).alias("v"), is_anchor.alias("anchor"))
    rows = rows.where("id is not null and label is not null and size(v) > 0").select("id", "label", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"), "anchor")
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    widths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("x") == (widths["n"] if widths else 0))
    index, placed, blocks = build(rows, cell)
    if index is None:
        return rows.select(*[F.lit(None).cast(t).alias(c) for c, t in OUT.items()]).limit(0)
    anchors = placed.select("rid", "id", "label", "x").join(rows.where("anchor").select("rid"), "rid", "left_semi")
    every = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
    good = search(anchors.select("rid", "label", "x", every.alias("windows")), blocks, index, True, positives)
    pairs = good.withColumn("key", F.row_number().over(Window.partitionBy("rid").orderBy(F.col("score").desc(), "id", "other")).cast("long"))
    pairs = materialise(pairs.where("score >= 0").select("rid", "key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low = F.ceil(F.col("positive_score") * F.lit(floor_percent).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = pairs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("key", low.alias("low"), F.col("positive_score").alias("high")))).alias("windows"))
    bad = search(anchors.join(windows.hint("merge"), "rid").select("rid", "label", "x", "windows"), blocks, index, False, negatives)
    rank = F.row_number().over(Window.partitionBy("rid", "key").orderBy(F.col("score").desc(), "id", "other"))
    out = bad.withColumn("rank", rank).join(pairs.hint("merge"), ["rid", "key"]).join(anchors.select("rid", F.col("id").alias("anchor_id")).hint("merge"), "rid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OUT = {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


ORACLE = {
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
          FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and([c IS NOT NULL AND isfinite(c) FOR c IN embedding])),
        s AS (SELECT a.i AS a, b.i AS b, a.l = b.l AS same, list_inner_product(a.x, b.x)::BIGINT AS s FROM v a, v b WHERE a.i % 100 = 0 AND a.i <> b.i),
        p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b))::INT AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
        FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND n.s <= p.s QUALIFY rank <= 5"""
}
