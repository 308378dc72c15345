"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Only the counts of the vote patterns (at most ``3 ** labellers``) go to the
driver, where expectation-maximisation estimates the share of good documents
and each labeller's votes given the class.  The posterior of each pattern is
the soft label of its documents.  A hashed linear scorer over word shapes is
then trained on a bounded sample (``max_train`` rows by a hash of the id) and
scores every document.

Defined results: a null or empty text has no words, so the length labeller
votes bad; repeated rows count each; no labels, language, source or id is an
input; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, pieces, saved

DIMS, PARTS = 1 << 14, 4
#: Name, bad if below or above, good if within. A vote between the two is an abstention. Ratios are per word, line or letter.
LABELLERS = (
    ("words", (10, np.inf), (30, np.inf)),
    ("symbols", (-1, 0.15), (-1, 0.02)),
    ("marked", (-1, 0.15), (-1, 0.02)),
    ("marks", (-1, 0.04), (-1, 0.005)),
    ("repeats", (-1, 0.2), (-1, 0.05)),
    ("distinct", (0.35, 2), (0.6, 2)),
    ("upper", (-1, 0.2), (-1, 0.06)),
    ("lines", (-1, 0.5), (-1, 0.1)),
    ("length", (3.0, 12.0), (4.2, 6.2)),
    ("adjacent", (-1, 0.2), (-1, 0.03)),
)
_SYMBOL, _LETTERS = re.compile(r"[#*$%&|<>]"), (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))
_A = np.uint64(0x9E3779B97F4A7C15)


class Shapes(dict):
    """Word to its row in ``table``: length, symbols, capitals, hash of its shape."""

    LIMIT = 150_000

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((1 << 16, 4), np.int64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        shape = _LETTERS[0].sub(lambda m: ("A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a") + ("" if len(m[0]) < 16 else "+"), word)
        shape = _LETTERS[1].sub("0", shape)
        self.table[n] = len(word), len(_SYMBOL.findall(word)), sum(c.isupper() for c in word), zlib.crc32(shape.encode("utf-8", "surrogatepass"))
        self[word] = n
        return n


def describe(text: str, shapes: Shapes) -> tuple[str, np.ndarray, np.ndarray]:
    """(votes, coordinates, values) of a text; a vote is 0 bad, 1 good, 2 abstain."""
    if len(shapes) > Shapes.LIMIT:
        shapes.clear()
    words = text.split()
    n = len(words)
    ids = np.fromiter(map(shapes.__getitem__, words), np.int64, n)
    rows = shapes.table[ids]
    chars = max(1, int(rows[:, 0].sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    five = np.zeros(max(0, n - 4), np.uint64)
    for j in range(5):
        five = five * _A + ids[j : j + len(five)].astype(np.uint64) + np.uint64(1)
    values = {
        "words": n,
        "symbols": rows[:, 1].sum() / max(1, n),
        "marked": float((rows[:, 1] > 0).mean()) if n else 0.0,
        "marks": rows[:, 1].sum() / chars,
        "repeats": 1 - len(np.unique(five)) / len(five) if len(five) else 0.0,
        "distinct": len(np.unique(ids)) / max(1, n),
        "upper": rows[:, 2].sum() / chars,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "length": chars / max(1, n),
        "adjacent": float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
    }
    votes = "".join("0" if not b[0] <= values[k] <= b[1] else "1" if g[0] <= values[k] <= g[1] else "2" for k, b, g in LABELLERS)
    s = rows[:, 3].astype(np.uint64)
    grams, counts = np.unique(np.concatenate([s, s[:-1] * _A + s[1:]]), return_counts=True)
    coords = [((grams * _A) >> np.uint64(40)) % np.uint64(DIMS)]
    levels = [f"{k} {min(9, int(10 * values[k]))}" for k in ("repeats", "distinct", "upper", "lines", "adjacent")]
    levels += [f"length {min(15, int(values['length']))}", f"words {int(n).bit_length()}"]
    coords.append(np.array([zlib.crc32(x.encode()) % DIMS for x in levels], np.uint64))
    x = np.concatenate([counts / max(1, n), np.ones(len(levels))])
    return votes, np.concatenate(coords).astype(np.int64), x


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for b in pieces(batches, "text"):
        rows = [describe(t, shapes) for t in b.column("text").to_pylist()]
        cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[2].astype(np.float32) for r in rows], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "votes", "f", "x"])


def posteriors(patterns: list[str], counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Chance of good per vote pattern, and each labeller's estimated accuracy."""
    v = np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(LABELLERS))
    good, bad = (v == 1).sum(1), (v == 0).sum(1)
    post = (good + 0.5) / (good + bad + 1.0)
    post = np.where(bad >= 2, np.minimum(post, 0.1), post)  # a start: bad votes are rare, so two of them count for more than many good ones
    hot = np.stack([v == k for k in range(3)], 2).astype(float)
    rate = np.zeros((2, v.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        for c in (0, 1):
            rate[c] = (np.einsum("p,plk->lk", weight[c], hot) + 1.0) / (weight[c].sum() + 3.0)
        log = np.log((weight.sum(1) + 1.0) / (counts.sum() + 2.0))[:, None] + np.einsum("plk,clk->cp", hot, np.log(rate))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    prior = (counts * post).sum() / max(1.0, counts.sum())
    accuracy = {k[0]: float(prior * rate[1, i, 1] + (1 - prior) * rate[0, i, 0]) for i, k in enumerate(LABELLERS)}
    return post, accuracy


def _train(part: pa.Table) -> pa.Table:
    part = part.sort_by("doc_id")
    rows = [(np.array(f), np.array(x, float), y) for f, x, y in zip(*[part.column(c).to_pylist() for c in ("f", "x", "posterior")], strict=True)]
    w, g2, order = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-4), np.random.default_rng(5)
    for _ in range(5):
        for i in order.permutation(len(rows)):
            f, x, y = rows[i]
            e = 1 / (1 + np.exp(-np.clip((w[f] * x).sum() + w[DIMS], -30, 30))) - y
            for at, g in ((f, e * x + 1e-5 * w[f]), (DIMS, e)):
                g2[at] += g * g
                w[at] -= 0.3 * g / np.sqrt(g2[at])
    at = np.nonzero(w)[0]
    return pa.table({"at": at, "w": w[at]})


def classify(docs: DataFrame, max_train: int = 12_000) -> DataFrame:
    """Per row: doc_id, votes, posterior (of the labellers), score (of the linear scorer), predicted."""
    spark = docs.sparkSession
    rows = saved(doc_rows(docs).mapInArrow(_described, "doc_id long, votes string, f array<int>, x array<float>"))
    seen = rows.groupBy("votes").agg(F.count("*").alias("c")).orderBy("votes").collect()  # 3 ** 10 patterns at most
    post, _ = posteriors([r["votes"] for r in seen], np.array([r["c"] for r in seen], float))
    table = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(seen, post, strict=True)], "votes string, posterior double")
    rows = rows.join(F.broadcast(table), "votes", "left")
    n = sum(r["c"] for r in seen)
    share = min(1.0, max_train / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "votes"), F.lit(1_000_003)) / 1_000_003.0 < share)
    parts = sample.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")).applyInArrow(_train, "at long, w double")
    mean = parts.groupBy("at").agg((F.sum("w") / PARTS).alias("w")).toPandas()  # DIMS + 1 rows at most
    w = np.zeros(DIMS + 1)
    w[mean["at"].to_numpy(np.int64)] = mean["w"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, x = b.column("f"), b.column("x")
            starts = np.asarray(f.offsets)[:-1] - f.offsets[0].as_py()
            size = np.diff(np.asarray(f.offsets))
            flat = w[f.flatten().to_numpy(zero_copy_only=False)] * x.flatten().to_numpy(zero_copy_only=False)
            total = np.add.reduceat(np.append(flat, 0.0), starts) * (size > 0) + w[DIMS] if len(starts) else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("votes"), b.column("posterior"), pa.array(score)], ["doc_id", "votes", "posterior", "score"])

    out = rows.select("doc_id", "votes", "posterior", "f", "x").mapInArrow(run, "doc_id long, votes string, posterior double, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
