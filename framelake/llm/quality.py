"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty

#: Labelled rows that are fitted at most: those with the smallest hashes of their ids.
MAX_TRAIN = 6_000
#: Their passages at most (some 60 MB of features on the driver): rows that would exceed it are left out whole.
MAX_PASSAGES = 120_000
THRESHOLD = 0.3
PASSAGE_BYTES = 400
#: Passages of one document that are encoded at once; a longer document is read in such steps.
STEP = 4_096
#: Byte classes: control, space, newline, lower, upper, digit, common punctuation, other punctuation, UTF-8 lead, UTF-8 tail, pipe.
CLASSES = 11
FEATURES = CLASSES * CLASSES + 10
HIDDEN, GATE = 24, 12


def byte_classes() -> np.ndarray:
    c = np.full(256, 7, dtype=np.uint8)
    c[:32], c[127], c[128:192], c[192:] = 0, 0, 9, 8
    c[[9, 11, 12, 13, 32]], c[10], c[97:123], c[65:91], c[48:58] = 1, 2, 3, 4, 5
    c[[ord(x) for x in ".,;:!?'\"-()"]], c[ord("|")] = 6, 10
    return c


CLASS_OF = byte_classes()


def passages(data: np.ndarray) -> np.ndarray:
    """Starts of passages: each line, and a long line at the first space after every PASSAGE_BYTES."""
    n = len(data)
    ends = np.append(np.flatnonzero(data == 10) + 1, n)
    starts = np.append(0, ends[:-1])
    keep = starts < n
    starts, ends = starts[keep], ends[keep]
    if len(starts) and (ends - starts).max() > PASSAGE_BYTES:
        spaces = np.append(np.flatnonzero(data == 32) + 1, n)
        extra = [np.arange(a + PASSAGE_BYTES, b, PASSAGE_BYTES) for a, b in zip(starts, ends, strict=True) if b - a > PASSAGE_BYTES]
        at = np.concatenate(extra)
        moved = spaces[np.searchsorted(spaces, at)]
        starts = np.unique(np.concatenate([starts, moved[moved < n]]))
    return starts


def encode(text: str) -> np.ndarray:
    """One row of FEATURES per passage: rates of neighbouring byte classes, word lengths, repetition, length.  An empty text is one blank passage."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data):
        return np.zeros((1, FEATURES), dtype=np.float32)
    starts = passages(data)
    m, n = len(starts), len(data)
    sizes = np.diff(np.append(starts, n))
    owner = np.repeat(np.arange(m), sizes)
    c = CLASS_OF[data].astype(np.int64)
    pairs = owner[1:] * (CLASSES * CLASSES) + c[:-1] * CLASSES + c[1:]
    rates = np.bincount(pairs, minlength=m * CLASSES * CLASSES).reshape(m, -1) / sizes[:, None]
    blank = (c == 1) | (c == 2)
    begins = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    out = np.zeros((m, FEATURES), dtype=np.float32)
    out[:, : CLASSES * CLASSES] = rates
    if len(begins):
        stops = np.append(np.flatnonzero(~blank[:-1] & blank[1:]) + 1, n)[: len(begins)]
        # A word's hash from prefix sums of mixed bytes: equal words have equal hashes; other collisions don't matter here.
        mixed = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) ** np.uint64(5) * np.uint64(2654435761), out=mixed[1:])
        word = mixed[stops] - mixed[begins]
        at, length = owner[begins], (stops - begins).astype(np.float64)
        words = np.bincount(at, minlength=m)
        some = np.maximum(words, 1)
        mean = np.bincount(at, length, m) / some
        order = np.lexsort((word, at))
        new = np.append(True, (word[order][1:] != word[order][:-1]) | (at[order][1:] != at[order][:-1]))
        distinct = np.bincount(at[order][new], minlength=m)
        same = np.append(False, (word[1:] == word[:-1]) & (at[1:] == at[:-1]))
        everywhere = len(np.unique(word)) / len(word)
        out[:, -10] = np.log1p(words) / 5
        out[:, -9] = mean / 10
        out[:, -8] = np.sqrt(np.maximum(0, np.bincount(at, length**2, m) / some - mean**2)) / 10
        out[:, -7] = distinct / some
        out[:, -6] = np.bincount(at, same, m) / some
        out[:, -5] = everywhere
        out[:, -4] = np.log1p(len(word)) / 10
    out[:, -3] = np.log1p(sizes) / 6
    out[:, -2] = np.log1p(m) / 6
    out[:, -1] = 1
    return out


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    shape = {"E": (FEATURES, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}
    return {k: r.normal(0, 1 / np.sqrt(s[0]), s) if k != "b" else np.zeros(1) for k, s in shape.items()}


def forward(p: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
    """Gated attention (Ilse and others, 2018): weights softmax(w . tanh(hV) * sigmoid(hU)) within a bag; score of the weighted mean."""
    h = np.tanh(x @ p["E"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
    e = np.exp(np.clip((t * s) @ p["w"], -30, 30))
    a = e / np.bincount(bag, e, bags)[bag]
    z = np.stack([np.bincount(bag, a * h[:, j], bags) for j in range(h.shape[1])], axis=1)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, f: dict[str, np.ndarray], d: np.ndarray) -> dict[str, np.ndarray]:
    """d: of the loss by each bag's logit."""
    dz = d[:, None] * p["c"]
    da = (dz[bag] * f["h"]).sum(1)
    dl = f["a"] * (da - np.bincount(bag, f["a"] * da, len(d))[bag])
    dts = dl[:, None] * p["w"]
    dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
    dh = (f["a"][:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
    return {"E": x.T @ dh, "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ dl, "c": f["z"].T @ d, "b": np.array([d.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the log loss, classes weighted alike."""
    p, r = start_weights(seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    share = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())]) / max(1, len(labels))
    for epoch in range(epochs if len(bags) else 0):
        order = r.permutation(len(bags))
        for k in range(0, len(order), batch):
            take = order[k : k + batch]
            x = np.concatenate([bags[i] for i in take]).astype(np.float64)
            bag = np.repeat(np.arange(len(take)), [len(bags[i]) for i in take])
            f = forward(p, x, bag, len(take))
            g = gradients(p, x, bag, f, (f["y"] - labels[take]) / share[labels[take]] / len(take) / 2)
            step += 1
            for n in p:
                grad = g[n] + 1e-4 * p[n]
                m[n], v[n] = 0.9 * m[n] + 0.1 * grad, 0.999 * v[n] + 0.001 * grad**2
                p[n] = p[n] - rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return p


def score(p: dict[str, np.ndarray], text: str) -> float:
    x = encode(text)
    if len(x) <= STEP:
        return float(forward(p, x, np.zeros(len(x), dtype=np.int64), 1)["y"][0])
    total, z = 0.0, 0.0  # the same softmax, a step of passages at a time
    for k in range(0, len(x), STEP):
        h = np.tanh(x[k : k + STEP] @ p["E"])
        e = np.exp(np.clip((np.tanh(h @ p["V"]) / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))) @ p["w"], -30, 30))
        total, z = total + e.sum(), z + e @ h
    return float(1 / (1 + np.exp(-np.clip(z / total @ p["c"] + p["b"][0], -30, 30))))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAIN, passages_most: int = MAX_PASSAGES) -> dict[str, np.ndarray]:
    """Weights from at most ``most`` labelled rows that aren't held out (a bound on the sample, not on the corpus scored).

    Rows are taken in the order of their ids' hashes, whole texts with all their passages; a row that would bring the
    passages over ``passages_most`` is left out.  Only their passages' features come to the driver.  Without labels of both
    classes, scores are near 0.5.  Of repeated labels of one id the larger counts, of repeated
    documents the longest; null labels and ids are left out.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    chosen = materialise(chosen.orderBy(F.xxhash64(id_col), id_col).limit(most), "train")
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text")).join(F.broadcast(chosen), id_col).select(id_col, "__text", "__label")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, label, t in zip(b[id_col], b["__label"], b["__text"], strict=True):
                x = encode(t)
                yield pd.DataFrame({"id": [str(i)], "label": [int(label)], "n": [len(x)], "x": [x.astype("<f2").tobytes() if len(x) <= passages_most else None]})

    found = rows.mapInPandas(features, "id string, label int, n int, x binary")
    got = materialise(found.groupBy("id").agg(F.max(F.struct("n", "label", "x")).alias("one")).select("id", "one.*"), "features")
    sizes = got.select("id", "label", "n", F.xxhash64("id").alias("h")).orderBy("h", "id", "label", "n").toPandas()  # a row a labelled document
    total, taken = 0, set()
    for k, n in enumerate(sizes["n"]):
        if total + n <= passages_most:
            total += n
            taken.add(sizes["id"].iloc[k])
    kept = got.where(F.col("x").isNotNull() & F.col("id").isin(list(taken))).select("id", "label", "x").toPandas().sort_values(["id", "label"])
    return fit([np.frombuffer(x, "<f2").reshape(-1, FEATURES) for x in kept["x"]], kept["label"].to_numpy(dtype=np.int64))


def score_documents(docs: DataFrame, weights: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Only the text is an input; null counts as empty; null ids aren't held out; repeated rows keep their rows; an empty table gives none; no shuffle.
    """
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:  # ids stay out of pandas, which has no whole numbers beside nulls
        return texts.map(lambda t: score(weights, t))

    out = docs.select(F.col(f"`{id_col}`").alias(id_col), held_out(F.col(f"`{id_col}`")).alias("held_out"), of(text_or_empty(f"`{text_col}`")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, weights: dict[str, np.ndarray], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns.

    Null texts are scored as empty; repeated rows stay or go alike; an empty table stays empty.
    """
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: score(weights, t or ""))

    return docs.where(of(text_or_empty(text_col)) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
