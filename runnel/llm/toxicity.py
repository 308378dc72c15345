"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (binary): each lower-cased word without outer punctuation,
its prefixes of four and six characters, word pairs at distance one (bigrams),
two and three (skip-grams), all hashed to ``DIMS`` coordinates.

Training reads a bounded sample of labelled rows (``max_train``, by a hash of
the id; the bound is a parameter because a linear model stops gaining from
rows long before 100 TB).  The sample is dealt to ``PARTS`` tasks; each runs
FTRL-proximal with per-coordinate rates and L1, and the states are averaged
(iterative parameter mixing); between rounds a part
gives up the state of coordinates with |z| of at most ``KEPT`` times the L1 bound, whose weight is
zero anyway (all touched ones need more than the driver's memory allows: 1,546 MB).  L1 leaves a few thousand weights, at most
``DIMS`` of twelve bytes, which go to the scoring tasks.

Defined results: a null or empty text is scored by the bias alone.  Repeated
rows are scored row by row.  A label that is null, or whose id no document
has, is ignored; of several labels of one id the largest counts.  Without any
label, or with one class only, all scores are the base rate (0 without labels).
A null id is in no training set and not held out.  An empty table gives no rows;
long texts are scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, pieces

DIMS = 1 << 20
PARTS = 4
THRESHOLD, KEPT = 0.3, 0.6
_EDGE = re.compile(r"^\W+|\W+$")
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """Word to its row in ``table`` (hashes of the word and of its prefixes); forgets all when full."""

    LIMIT = 150_000

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((1 << 16, 3), np.uint64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        w = _EDGE.sub("", word.lower())
        self.table[n] = [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (f"w {w}", f"4 {w[:4]}", f"6 {w[:6]}")]
        self[word] = n
        return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _P
    return ((x ^ (x >> np.uint64(29))) * _Q) >> np.uint64(40)


def features(text: str, words: Words) -> np.ndarray:
    """Hashed coordinates of a text, with repeats."""
    if len(words) > Words.LIMIT:
        words.clear()
    tokens = text.split()
    rows = words.table[:0] if not tokens else None
    if rows is None:
        idx = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        rows = words.table[idx]
    h = rows[:, 0]
    grams = [rows.ravel()] + [h[:-d] * _Q + h[d:] + np.uint64(d) for d in (1, 2, 3) if len(h) > d]
    return (_mix(np.concatenate(grams)) % np.uint64(DIMS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal logistic regression; coordinate ``DIMS`` is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 2.0, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(self, f: np.ndarray) -> np.ndarray:
        z, n = self.z[f], self.n[f]
        l1 = np.where(f == DIMS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, f: np.ndarray, y: float) -> None:
        w = self.weights(f)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        n = self.n[f]
        self.z[f] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[f] = n + g * g


def _train_part(epochs: int, start: tuple | None):
    def run(part: pa.Table) -> pa.Table:
        words, model = Words(), Ftrl()
        if start is not None:
            model.z[start[0]], model.n[start[0]] = start[1], start[2]
        part = part.sort_by("doc_id")
        texts, ys = part.column("text"), part.column("y").to_pylist()
        rows = [(np.append(np.unique(features(t.as_py(), words)), np.int32(DIMS)), float(y)) for t, y in zip(texts, ys, strict=True)]
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                model.learn(*rows[i])
        f = np.nonzero((np.abs(model.z) > KEPT * model.l1) | (np.arange(DIMS + 1) == DIMS))[0]
        return pa.table({"f": pa.array(f, pa.int64()), "z": model.z[f], "n": model.n[f]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = 16_000, rounds: int = 2, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights as (coordinates, values), from rows that are not held out."""
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1) AND crc32(cast(doc_id AS string)) % 4 != 2")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return np.array([DIMS]), np.array([-30.0])
    if ones in (0, n):
        return np.array([DIMS]), np.array([30.0 if ones else -30.0])
    share = min(1.0, max_train / n)
    rows = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 < share) if share < 1 else F.lit(True))
    # At most about max_train ids of sixteen bytes: a proven bound for the broadcast.
    train = doc_rows(docs).join(F.broadcast(rows), "doc_id").select("doc_id", "text", "y")
    train = train.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    state = None
    for _ in range(rounds):
        parts = train.applyInArrow(_train_part(epochs, state), "f long, z double, n double")
        mean = parts.groupBy("f").agg((F.sum("z") / PARTS).alias("z"), (F.sum("n") / PARTS).alias("n")).toPandas()
        state = (mean["f"].to_numpy(), mean["z"].to_numpy(), mean["n"].to_numpy())
    model = Ftrl()
    model.z[state[0]], model.n[state[0]] = state[1], state[2]
    f = np.sort(state[0])
    w = model.weights(f)
    return f[w != 0].astype(np.int64), w[w != 0]


def scorer(weights: tuple[np.ndarray, np.ndarray]):
    """A function from texts to scores, to be made once a task."""
    table = np.zeros(DIMS + 1, np.float32)
    table[weights[0]] = weights[1]
    words = Words()

    def score(texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            f = features(t or "", words)
            f = np.unique(f[table[f] != 0])
            out[i] = table[f].sum(dtype=np.float64) + table[DIMS]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    return score


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = scorer(weights)
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f(b.column("text").to_pylist()))], ["doc_id", "score"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 4 = 2"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = scorer(weights)
        for b in pieces(batches, "text"):
            yield b.filter(pa.array(f(b.column(b.schema.names.index("text")).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
