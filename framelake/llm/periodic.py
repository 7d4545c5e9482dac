"""Periodic runs of words by enumeration of maximal pairs on a bottom-up LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The two copies of a run of period q, q words apart, share max(6 - q, 3 q) words: at least these.
SHORTEST = min(max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) for q in range(1, LEAST_WORDS))

Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers, from 1, for equal words."""
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(w, len(number) + 1) for w in words], dtype=np.int64)


def repeated_places(w: np.ndarray) -> np.ndarray:
    """Places whose next SHORTEST words occur elsewhere, too.  Only they lie below an interval that can hold a run.

    By 64-bit hashes: one that collides adds a place, and the tree then finds that it shares fewer words.
    """
    n = len(w) - SHORTEST + 1
    if n < 2:
        return np.empty(0, dtype=np.int64)
    mixed = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHORTEST):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    ordered = np.sort(h)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return np.flatnonzero(again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h) if len(again) else np.empty(0, dtype=np.int64)


def suffix_order(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places ``at`` in the order of the suffixes that begin there, words that each shares with the one before it).

    Ranks of stretches of 1, 2, 4, ... words; from the longest down, they also say how much two neighbours share.
    """
    n, span = len(w), 1
    levels = [np.append(w, 0).astype(np.int32)]
    while span < n and len(np.unique(levels[-1][at])) < len(at):
        r = levels[-1].astype(np.int64)
        key = r[:n] * (int(r.max()) + 1) + r[np.minimum(np.arange(n) + span, n)]
        levels.append(np.append(np.unique(key, return_inverse=True)[1] + 1, 0).astype(np.int32))
        span *= 2
    order = at[np.argsort(levels[-1][at], kind="stable")]
    i, j = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][i] == levels[k][j]
        i[same] += 1 << k
        j[same] += 1 << k
    return order, np.append(0, i - order[:-1])


class Interval:
    """Places below an interval: all of them in order, and a list for each word to the left of them."""

    __slots__ = ("classes", "places")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}


def joined(a: Interval, b: Interval, shared: int, left: list[int], found: dict[tuple[int, int], int]) -> Interval:
    """One interval of both; adds to ``found`` the maximal pairs across them: ``shared`` words, then different ones, and different words to the left.

    Only those whose distance q allows a run: q + shared >= LEAST_WORDS and shared >= 3 q.  The smaller side looks up its
    places in the larger one: among those near enough, or class by class, whichever are fewer.
    """
    if len(a.places) < len(b.places):
        a, b = b, a
    most = shared // (LEAST_PERIODS - 1)
    for own, mine in b.classes.items():
        for p in mine:
            lo, hi = bisect_left(a.places, p - most), bisect_right(a.places, p + most)
            if hi - lo <= len(a.classes):
                near = [x for x in a.places[lo:hi] if left[x] != own]
            else:
                near = [x for other, xs in a.classes.items() if other != own for x in xs[bisect_left(xs, p - most) : bisect_right(xs, p + most)]]
            for x in near:
                q, start = abs(x - p), min(x, p)
                if q + shared >= LEAST_WORDS:
                    found[start, q + shared] = min(q, found.get((start, q + shared), q))
    for own, mine in b.classes.items():
        to = a.classes.setdefault(own, [])
        for p in mine:
            insort(to, p)
    for p in b.places:
        insort(a.places, p)
    return a


def runs_of(words: list[bytes]) -> list[Run]:
    """All runs by start, then period: stretches of words with smallest period q, max(6, 4 q) words or more, that no neighbour extends.

    Two places q apart that share exactly m words, with different words before and after, are the
    ends of a stretch of q + m words with period q that can't be extended.  So those pairs that the tree gives and whose distance
    is short enough are the runs; a multiple of a run's period gives the same stretch, of which the smallest period counts.
    """
    w = numbered(words)
    at = repeated_places(w)
    if not len(at):
        return []
    order, shares = suffix_order(w, at)
    left = [0, *w[:-1].tolist()]  # nothing stands left of the first word
    found: dict[tuple[int, int], int] = {}
    above: list[tuple[int, Interval]] = []
    places, shared = order.tolist(), [*shares[1:].tolist(), 0]
    for place, common in zip(places, shared, strict=True):
        node = Interval(place, left[place])
        while above and above[-1][0] > common:
            m, to = above.pop()
            node = joined(to, node, m, left, found)
        if above and above[-1][0] == common:
            above[-1] = (common, joined(above[-1][1], node, common, left, found))
        elif common >= SHORTEST:
            above.append((common, node))
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that stay when every run is cut to its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def with_runs(docs: DataFrame, text_col: str = "text", runs: str = "runs", out: str = "collapsed") -> DataFrame:
    """``docs`` with ``runs``, array<struct<start, length, period>> by start and period in words, and ``out``, the text without repetitions.

    Words lie between ASCII white space and are compared by their bytes.  A null or blank text has no runs and collapses to
    nothing.  A text is read whole by one task; every row is on its own, so there is no shuffle, repeated rows and null ids
    keep their rows, and an empty table gives none.  Columns named like the results are replaced.
    """
    @F.pandas_udf("flat array<bigint>, text string")
    def of(texts: pd.Series) -> pd.DataFrame:
        flat, kept = [], []
        for t in texts:
            words = t.encode().split()
            found = runs_of(words)
            flat.append(np.array(found, dtype=np.int64).ravel())
            kept.append(b" ".join(collapsed(words, found)).decode())
        return pd.DataFrame({"flat": flat, "text": kept})

    names = [c for c in docs.columns if c not in (runs, out)]
    got = docs.select(*[F.col(f"`{c}`") for c in names], of(text_or_empty(f"`{text_col}`")).alias("__runs"))
    place = F.sequence(F.lit(0), F.floor(F.size("__runs.flat") / 3).cast("int") - 1)
    one = lambda k: F.struct(*[F.get("__runs.flat", k * 3 + i).alias(n) for i, n in enumerate(("start", "length", "period"))])
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    listed = F.when(F.size("__runs.flat") > 0, F.transform(place, one)).otherwise(none)
    return got.select(*[F.col(f"`{c}`") for c in names], listed.alias(runs), F.col("__runs.text").alias(out))


def with_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every tenth document, by the checksum of its id, goes on from some word in a loop; null ids have no checksum."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text_or_empty(text_col), "[\\x20\\t-\\r]+"), lambda x: x != "")
    chosen = docs.select(F.col(id_col), F.col(text_col), F.when(h % 10 == 0, words).alias("w"), g.alias("g")).withColumn("n", F.size("w"))
    placed = chosen.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    looped = F.expr("array_join(concat(slice(w, 1, a), transform(sequence(a, n - 1), i -> element_at(w, cast(a + (i - a) % p + 1 as int)))), ' ')")
    return placed.select(id_col, F.when(F.col("a").isNotNull(), looped).otherwise(F.col(text_col)).alias(text_col))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(with_tail(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    digest: Column = F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
    first = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)))
    top = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(first, F.lit(0)).alias("top"), digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return top.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
