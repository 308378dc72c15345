"""Near-duplicate classes by Order MinHash and banded alignment.

Exact copies are collapsed first, by a hash of the text.  Of each different
text, the five-word shingles are labelled with their occurrence number, which
makes them unique.  Each of ``SKETCHES`` sketches takes the ``PICKS`` shingles
that are smallest under its own hash and keeps them in the order of the text,
so that two texts share a sketch when they share those shingles in that order.
With ``PICKS`` = 3 and 48 sketches, a pair with a changed word in ten (some 42 %
of the shingles in common) shares one with probability 0.97.

Texts that share a sketch and a class of length are candidates.  First the
smallest id of each shared sketch meets the others of it.  A sketch whose
members then are in one component is done; a sketch that a third of the corpus
shares costs as many rows as it has texts if they are near copies.  Sketches
that keep several components mostly come from a common passage, and comparing
their members one by one grows with the square of their number.  Their texts go
through an exact prefix filter: with all words, labelled by occurrence, in one
order from rare to common, two near texts of n words at least have a word in
common among the first n - ceil(``SIMILARITY`` n) + 1 of each, so each of these
words is a finer key.  A passage that many texts have is common by itself and
seldom among them.

Of two texts, no word before the first common one, in that order, matches, so what
is left from its place on bounds their match.  A text with ``room`` words from a
key on can be near, through that key, texts of its own to room / ``SIMILARITY``
words, and two texts meet there only if these spans overlap.

In each finer key the smallest id meets the others of other components.  Keys
that have several components even then are compared whole: each pair of texts
of different components meets once, whichever of them has the smallest id, if
the parities of their labelled words in ``BITS`` slots allow it.  Every slot
that differs holds a word that only one of them has, so the words they can match
are bounded exactly, and no near pair is lost.

Most pairs of a shared sketch that are not near end at a signature of ``SLOTS`` bytes a text: its words, labelled
by occurrence, fall into slots, and each slot keeps a byte of its smallest hash.
Two texts of which ``SIMILARITY`` of the words match have two thirds of all
words in common at least, so that share of slots agrees; a pair is given up four
standard deviations below (about one near pair in 30,000 at the threshold).

What is left is verified by banded alignment of the words: ``m`` is the
longest common subsequence of the two word sequences inside the diagonals that
the threshold allows (bit-parallel, one machine word for 64 words).  The pair
is near when ``m`` is at least ``SIMILARITY`` of the longer sequence.  Classes
are the connected components of the near pairs.

Defined results: texts without words are copies of each other only if equal; a
text of fewer than five words is one shingle; repeated ids count as one
document, near what any of its texts is near; a null id has a null class; an
empty table gives no rows; long texts are aligned whole, in memory of the order
of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, dropped, joined, pieces, saved
from .graphs import components

WORDS, PICKS, SKETCHES, SIMILARITY, SPOKES, SLOTS = 5, 3, 48, 0.8, 256, 64
BITS = 4096
COUNTS, RAREST = 1 << 20, 16  # counters of words: those that share one have one place in the order, which any order allows
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ROWS = np.arange(SKETCHES)
_SEEDS = (np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]


class WordHash(dict):
    """Word to 64-bit hash; a task's memory of them stays bounded."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return (x ^ (x >> np.uint64(29))) * _B


def word_hashes(text: str, words: WordHash) -> np.ndarray:
    tokens = text.split()
    return np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))


def shingles(w: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Occurrence-labelled shingle hashes of word hashes, in order; no two are the same."""
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(size, len(w))):
        h = _mix(h + w[j : j + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])
    at = np.arange(n)
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    h[order] = _mix(s + occurrence.astype(np.uint64) * _B)  # in texts without repeats too, so that hashes agree
    return h


def sketches(h: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """One hash per sketch: the smallest ``PICKS`` shingles of each, in text order; long texts block by block."""
    k = min(PICKS, len(h))
    values, places = np.empty((SKETCHES, 0), np.uint64), np.empty((SKETCHES, 0), np.int64)
    for s in range(0, len(h), block):
        v = _mix(h[None, s : s + block] ^ _SEEDS)
        at = np.empty((SKETCHES, min(k, v.shape[1])), np.int64)
        low = np.empty(at.shape, np.uint64)
        for j in range(at.shape[1]):
            at[:, j] = v.argmin(axis=1)
            low[:, j] = v[_ROWS, at[:, j]]
            v[_ROWS, at[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        values, places = np.hstack([values, low]), np.hstack([places, at + s])
        if values.shape[1] > k:
            best = np.argsort(values, axis=1, kind="stable")[:, :k]
            values, places = np.take_along_axis(values, best, 1), np.take_along_axis(places, best, 1)
    places.sort(axis=1)
    out = _SEEDS.ravel().copy()
    for j in range(k):
        out = _mix(out + h[places[:, j]])
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Words that an alignment inside the band matches, as a share of the longer sequence; 0 when it can't reach the threshold."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    need = math.ceil(SIMILARITY * longer - 1e-9)
    if min(len(a), len(b)) < need:
        return 0.0
    n = min(len(a), len(b))
    differ = np.nonzero(a[:n] != b[:n])[0]
    head = int(differ[0]) if len(differ) else n
    differ = np.nonzero(a[::-1][: n - head] != b[::-1][: n - head])[0]
    tail = int(differ[0]) if len(differ) else n - head
    a, b, same = a[head : len(a) - tail], b[head : len(b) - tail], head + tail
    if not len(a) or not len(b):
        return same / longer
    x, y, counts = *np.split(np.unique(np.concatenate([a, b]), return_inverse=True)[1], [len(a)]), None
    kinds = int(max(x.max(), y.max())) + 1
    counts = np.minimum(np.bincount(x, minlength=kinds), np.bincount(y, minlength=kinds))
    if same + int(counts.sum()) < need:  # not even in any order
        return 0.0
    # What is left on each side has at most ``longer - need`` words without a match, which bounds the shift between matches.
    band = max(len(a), len(b)) - (need - same)
    masks: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        if counts[w]:
            masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, window = full, (1 << (2 * band + 1)) - 1
    for j, w in enumerate(y.tolist()):
        m = masks.get(w, 0)
        if m:
            m &= window << (j - band) if j >= band else window >> (band - j)
            u = v & m
            v = ((v + u) | (v - u)) & full
    return (same + len(a) - v.bit_count()) / longer


def signature(w: np.ndarray) -> bytes:
    """Of the occurrence-labelled words: per slot a byte of the smallest hash, 0 for an empty slot."""
    h = np.sort(shingles(w, 1))[::-1]
    out = np.zeros(SLOTS, np.uint8)
    out[(h % np.uint64(SLOTS)).astype(np.int64)] = (_mix(h) % np.uint64(255) + np.uint64(1)).astype(np.uint8)  # the last, smallest one stays
    return out.tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of signatures may be near."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    share = SIMILARITY / (2 - SIMILARITY)
    return same >= share * used - 4 * np.sqrt(share * (1 - share) * used)


_SKETCHED = "doc_id long, h long, n long, keys array<long>, sig binary"


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for b in pieces(batches, "text"):
        n, keys, sigs = [], [], []
        for t in b.column("text").to_pylist():
            w = word_hashes(t, words)
            n.append(len(w))
            keys.append(sketches(shingles(w)).view(np.int64) if len(w) else None)
            sigs.append(signature(w) if len(w) else None)
        cols = [b.column("doc_id"), b.column("h"), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "n", "keys", "sig"])


def starred(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (a, salt, b, value), sorted: for distinct pairs (a, b) first the value of the centre ``a``, where b is null, then those of its spokes.

    The spokes are dealt by (a, salt), with a salt for every ``SPOKES`` of them,
    and the centre's value goes once to each salt, not to every spoke.
    """
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPOKES).alias("salts"))
    dealt = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b")
    spokes = dealt.join(values.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "value")
    heads = stars.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    heads = heads.join(values.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "value")
    return heads.union(spokes).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, centre, held = WordHash(), None, []  # the texts of a centre: several only if its id repeats
    for b in pieces(batches, "value"):
        ca, cb = [], []
        for x, s, y, t in zip(*[b.column(c).to_pylist() for c in ("a", "salt", "b", "value")], strict=True):
            w = word_hashes(t, words)
            if y is None:
                held = [*held, w] if centre == (x, s) else [w]
                centre = (x, s)
            elif any(aligned(c, w) >= SIMILARITY for c in held):
                ca.append(x)
                cb.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(ca, pa.int64()), pa.array(cb, pa.int64())], ["a", "b"])


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures allow it; where an id repeats, so that a centre has several signatures, all pairs."""
    last, several = np.zeros((1, SLOTS), np.uint8), False
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sigs = np.frombuffer(b"".join(b.column("value").to_pylist()), np.uint8).reshape(n, SLOTS)
        head = np.asarray(b.column("b").is_null())
        at = np.maximum.accumulate(np.where(head, np.arange(n), -1))
        second = head & np.append(False, head[:-1]) & np.append(False, (b.column("a").to_numpy()[1:] == b.column("a").to_numpy()[:-1]) & (b.column("salt").to_numpy()[1:] == b.column("salt").to_numpy()[:-1]))
        many = np.where(at >= 0, second[at], several)
        centre = np.concatenate([sigs, last])[at]
        ok = pa.array(~head & (many | alike(centre, sigs)))
        last, several = centre[-1:], bool(many[-1])
        yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])


def shared_keys(rows: DataFrame) -> DataFrame:
    """The rows (k, rep, n) whose key several texts have."""
    shared = rows.groupBy("k").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("k")
    return rows.join(shared, "k").select("k", "rep", "n")


def members(reps: DataFrame) -> DataFrame:
    """Rows (k, rep, n, top) of the sketches that several texts share, from rows (rep, n, keys); ``top`` is the length of the longest text that can be near."""
    # Classes of length a factor 1.5 wide; odd sketches have them half a class off, so near lengths meet somewhere.
    log = F.log(F.col("n").cast("double")) / F.log(F.lit(1.5))
    keys = F.transform("keys", lambda k, t: F.xxhash64(k, t, F.floor(log + F.when(t % 2 == 1, 0.5).otherwise(0.0))))
    shared = shared_keys(reps.where("keys IS NOT NULL").select(F.explode(keys).alias("k"), "rep", "n"))
    return shared.withColumn("top", F.floor(F.col("n") / SIMILARITY + 1e-9))


def unsettled(rest: DataFrame) -> DataFrame:
    """The rows of the keys with several components ``c``, with the key's centre ``x``: its smallest id.  Reads ``rest`` twice."""
    keys = rest.groupBy("k").agg(F.min(F.struct("rep", "c", "n", "top")).alias("x"), F.min("c").alias("low"), F.max("c").alias("high"))
    return rest.join(keys.where("low < high"), "k").drop("low", "high")


def starry(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each key's centre and its members of other components whose spans n to top overlap."""
    met = rows.where("c != x.c").where(F.greatest("n", "x.n") <= F.least("top", "x.top"))
    return met.select(F.least("rep", "x.rep").alias("a"), F.greatest("rep", "x.rep").alias("b")).distinct()


def parity(h: np.ndarray) -> np.ndarray:
    """Of labelled words: whether each of ``BITS`` slots has an odd number of them, 64 slots a number."""
    odd = np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _parity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for b in pieces(batches, "value"):
        bits = [parity(shingles(word_hashes(t, words), 1)) for t in b.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(bits, pa.list_(pa.int64()))], ["rep", "bits"])


def crossed(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members of other components whose spans n to top and parities (``bits``) allow the threshold.

    A pair that has some of its ``rarest`` keys in common meets at the first of those only, the one from which the spans count.
    """
    y = rows.select("k", F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("top").alias("ta"), F.col("rarest").alias("ra"), F.col("bits").alias("ba"))
    both = F.array_intersect("rarest", "ra")  # in the order of ``rarest``
    met = y.join(rows, "k").where("a < rep AND c != ca").where(F.greatest("n", "na") <= F.least("top", "ta"))
    met = met.where((F.size(both) == 0) | (F.get(both, F.lit(0)) == F.col("k")))
    apart = F.aggregate(F.zip_with("bits", "ba", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    met = met.where(apart <= F.col("n") + F.col("na") - 2 * F.ceil(SIMILARITY * F.greatest("n", "na") - 1e-9))  # as ``needed``
    return met.select("a", F.col("rep").alias("b")).distinct()


def needed(n: int) -> int:
    """Words of ``n`` that a near text has too, at least."""
    return math.ceil(SIMILARITY * n - 1e-9)


def longest(room: np.ndarray) -> np.ndarray:
    """Words of the longest text of which ``room`` words are enough."""
    return np.floor(room / SIMILARITY + 1e-9).astype(np.int64)


def rare_first(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest labelled words of a text, one of which every near text has among its own."""
    order = np.lexsort((h, counts[(h % np.uint64(len(counts))).astype(np.int64)]))
    return h[order[: len(h) - needed(len(h)) + 1]]


def word_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often labelled words occur in ``texts`` (value, c), and whether in several components, in ``COUNTS`` counters: bounded, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = WordHash(), np.zeros(COUNTS, np.int64)
        low, high = np.full(COUNTS, np.iinfo(np.int64).max), np.full(COUNTS, np.iinfo(np.int64).min)
        for b in pieces(batches, "value"):
            for t, c in zip(b.column("value").to_pylist(), b.column("c").to_pylist(), strict=True):
                at = (shingles(word_hashes(t, words), 1) % np.uint64(COUNTS)).astype(np.int64)
                np.add.at(counts, at, 1)
                low[at], high[at] = np.minimum(low[at], c), np.maximum(high[at], c)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, counts[at], low[at], high[at])], ["at", "n", "low", "high"])

    total = texts.select("value", "c").mapInArrow(run, "at long, n long, low long, high long").groupBy("at")
    total = total.agg(F.least(F.sum("n"), F.lit((1 << 31) - 1)).cast("int").alias("n"), (F.min("low") < F.max("high")).alias("mixed")).toArrow()
    counts, mixed = np.zeros(COUNTS, np.int32), np.zeros(COUNTS, bool)
    at = total.column("at").to_numpy()
    counts[at], mixed[at] = total.column("n").to_numpy(), total.column("mixed").to_numpy()
    return counts, mixed


def prefixes(texts: DataFrame) -> DataFrame:
    """Rows (k, rep, rarest, n, top, c) of the prefix filter over ``texts`` (id, value, c).

    Any two near ones of different components share a ``k`` where their spans from n, their words, to top overlap; ``rarest`` are
    the first ``RAREST`` of a text, in order.  Words that only one component has are no keys.
    """
    counts, mixed = word_counts(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in pieces(batches, "value"):
            keys, n, tops = [], [], []
            for t in b.column("value").to_pylist():
                h = shingles(word_hashes(t, words), 1)
                k = rare_first(h, counts)
                places = np.nonzero(mixed[(k % np.uint64(COUNTS)).astype(np.int64)])[0]
                keys.append(k[places].view(np.int64))
                n.append(len(h))
                tops.append(longest(len(h) - places))
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            rarest = pa.array([k[:RAREST] for k in keys], pa.list_(pa.int64()))
            rep, rarest, n, c = (x.take(at) for x in (b.column("id"), rarest, pa.array(n, pa.int64()), b.column("c")))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), rep, rarest, n, pa.array(np.concatenate(tops)), c], ["k", "rep", "rarest", "n", "top", "c"])

    return texts.mapInArrow(run, "k long, rep long, rarest array<long>, n long, top long, c long")


def picked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, value) of the saved ``ids``; all texts of an id that repeats, each once."""
    return joined(texts, ids, "id", "left_semi").distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The near ones of the saved ``pairs``."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    near = saved(starred(pairs, picked(texts, ids)).mapInArrow(_verify, "a long, b long").distinct())
    dropped(ids)
    return near


def labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows that were no centre of their key, with their components now."""
    left = rows.where("NOT (rep = x.rep AND n = x.n AND top = x.top)").drop("c", "x").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return left.withColumn("c", F.coalesce("label", "rep")).drop("label")


def near_pairs(reps: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The near pairs (a, b) found, and (node, label) of their components."""
    rows = saved(unsettled(members(reps).withColumn("c", F.col("rep"))))
    pairs = saved(starry(rows))
    likely = saved(starred(pairs, reps.select(F.col("rep").alias("id"), F.col("sig").alias("value"))).mapInArrow(_sieve, "a long, b long"))
    near = verified(likely, texts)
    label = components(near)
    # Sketches with several components: by finer keys.  What is read twice is saved first.
    moved = saved(labelled(rows, label))
    left = saved(unsettled(moved).select(F.col("rep").alias("id"), "c").distinct())
    dropped(rows, moved, likely)
    ids = saved(left.select("id").distinct())
    values = saved(picked(texts, ids))
    found = saved(prefixes(joined(values, left, "id", "inner")))
    rows = saved(unsettled(found))
    dropped(left, ids, found)
    stars = saved(starry(rows).join(pairs, ["a", "b"], "left_anti"))
    new = verified(stars, values)
    near, label = near.union(new), components(new, label)
    moved = saved(labelled(rows, label))
    dropped(rows)
    rows = saved(unsettled(moved))
    bits = saved(values.mapInArrow(_parity_rows, "rep long, bits array<long>"))
    whole = saved(joined(rows, bits, "rep", "inner"))
    rest = saved(crossed(whole).join(pairs.union(stars), ["a", "b"], "left_anti"))
    dropped(moved, rows, bits, whole)
    new = verified(rest, values)
    near, label = near.union(new), components(new, label)
    dropped(values)
    return near, label


def classes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id (smallest id of the class), n_links (near texts among those it was compared with)."""
    rows = doc_rows(docs).withColumn("h", F.xxhash64("text", F.length("text"), F.crc32("text")))
    sigs = saved(rows.mapInArrow(_sketch_rows, _SKETCHED))
    reps = saved(sigs.where("doc_id IS NOT NULL").groupBy("h").agg(F.min(F.struct("doc_id", "n", "keys", "sig")).alias("r")).select("h", F.col("r.doc_id").alias("rep"), "r.n", "r.keys", "r.sig"))
    texts = doc_rows(docs).select(F.col("doc_id").alias("id"), F.col("text").alias("value"))
    near, label = near_pairs(reps, texts)
    links = near.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    found = label.withColumnRenamed("node", "rep").join(links, "rep", "left")
    member = sigs.select("doc_id", "h").join(reps.select("h", "rep"), "h", "left")
    out = member.join(found, "rep", "left")
    return out.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the first of their class; rows with a null id stay."""
    gone = saved(classes(docs).where("class_id != doc_id").select(F.col("doc_id").alias("__gone")).distinct())
    return joined(docs, gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
