"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words where no piece reaches: before a run of spaces and
around line feeds.  Only the different words of the corpus are encoded:

1. Each task counts its words; the counts are summed by word.  Counts only choose
   what is encoded beforehand (see 4), so a word that a task sees once among
   150,000 different ones is not counted.
2. The lattice: every substring of a word of up to the longest piece's length is
   exploded and equi-joined to the piece table (broadcast: its size is the
   vocabulary's).  Its edges are grouped by word.
3. A fold of the edges gives the word's ids.  For a unigram model that is Viterbi:
   the best score up to each end, then back from the last.  A BPE model has no
   best path; its result is defined by the order of merges, so its fold takes,
   step by step, the edge with the best score (the leftmost of equal ones) that
   joins two neighbours of what is cut so far.
   Both folds are higher-order ``aggregate`` functions.
4. Texts look up the ``FREQUENT`` commonest words of the corpus, encoded once by
   the ``aggregate`` fold, in a broadcast table of that bounded size.  Each task
   encodes the other words of its texts through the same lattice and fold in
   arrays (``Lattice``); their joins to a table would move more than the texts.

A word of more than ``LONG`` = 60 characters, such as a text without spaces, has
no lattice, whose cuts are bits of a long; its ids come from the library in
linear memory.

Defined results: a null or empty text has no ids; characters without a piece
become byte pieces (or the unknown id, if the model has none); repeated rows are
encoded each; a null doc_id stays null.  Decoding gives the text back, but for
U+2581, which the format itself reads as a space.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_rows, pieces, saved

LONG, FREQUENT, UNKNOWN_COST = 60, 100_000, 10.0
SPACE = "▁"


@dataclass(frozen=True)
class Model:
    """The piece table of a model file."""

    path: str | None
    kind: str  # "unigram" or "bpe"
    pieces: tuple[tuple[str, int, float], ...]  # (piece with spaces, id, score)
    bytes_: tuple[int, ...]  # ids of the 256 byte pieces, or none
    unknown: int
    texts: tuple[bytes, ...]  # of every id

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    kind = {1: "unigram", 2: "bpe"}[m.trainer_spec.model_type]
    pieces, bytes_, texts, unknown = [], [0] * 256, [], 0
    for i, p in enumerate(m.pieces):
        text = p.piece.replace(SPACE, " ")
        if p.type == 6:
            bytes_[int(p.piece[3:5], 16)] = i
            texts.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type == 2:
            unknown = i
            texts.append(" ⁇ ".encode())
        elif p.type == 3:
            texts.append(b"")
        else:
            pieces.append((text, i, float(p.score)))
            texts.append(text.encode())
    return Model(path, kind, tuple(pieces), tuple(bytes_) if m.trainer_spec.byte_fallback else (), unknown, tuple(texts))


def word_pattern(model: Model) -> re.Pattern:
    """Words, with the spaces before them.  No piece crosses from one to the next; that is checked against the table."""
    if any("\n" in p or " " in p.lstrip(" ") for p, _, _ in model.pieces):
        raise ValueError("the model has pieces that cross words")
    return re.compile(r" *[^ \n]+| +|\n+")


def words_of(text: str, pattern: re.Pattern) -> list[str]:
    """The words of a text after the space that the format puts before it."""
    return pattern.findall(" " + text.replace(SPACE, " ")) if text else []


def corpus_words(docs: DataFrame, model: Model) -> DataFrame:
    """(word, n): words that are common in the texts, with their counts where a task sees them again."""
    pattern = word_pattern(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            again = [(w, n) for w, n in seen.items() if n > 1]
            out = pa.RecordBatch.from_arrays([pa.array([w for w, _ in again], pa.string()), pa.array([n for _, n in again], pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in pieces(batches, "text"):
            for t in b.column("text").to_pylist():
                seen.update(words_of(t, pattern))
                if len(seen) > 150_000:
                    yield rows()
        yield rows()

    return doc_rows(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, model: Model, least: int) -> DataFrame:
    """(word, n, edges): the pieces of at least ``least`` characters in each word, cheapest and leftmost first.

    ``ends`` has a bit for each end of an edge, ``inner`` for each place between.
    The empty span keeps words without a piece.  ``words`` are dealt by word, and
    so are the edges: grouping them needs no other exchange.
    """
    spark = words.sparkSession
    table = spark.createDataFrame([("", -1, 0.0), *model.pieces], "piece string, id int, score double")  # the vocabulary: a fixed size
    most = max(model.longest, least)
    spans = f"""concat(array(named_struct('a', 0, 'b', 0)), flatten(transform(sequence(0, greatest(length(word) - {least}, 0)),
        a -> transform(sequence({least}, greatest(least({most}, length(word) - a), {least})), k -> named_struct('a', a, 'b', a + k)))))"""
    subs = words.select("word", "n", F.explode(F.expr(spans)).alias("s")).selectExpr("word", "n", "s.a", "s.b", "substr(word, s.a + 1, s.b - s.a) AS piece")
    edges = subs.where("b <= length(word)").join(F.broadcast(table), "piece")
    ends, inner = "shiftleft(1L, a) | shiftleft(1L, b)", "(shiftleft(1L, b) - 1L) & ~(shiftleft(1L, a + 1) - 1L)"
    edge = F.expr(f"named_struct('cost', -score, 'a', a, 'b', b, 'id', id, 'ends', {ends}, 'inner', {inner})")
    return edges.groupBy("word").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(edge)).alias("edges"))  # LONG * longest at most


def viterbi(edges: Column, n: Column) -> Column:
    """Segments (a, b, id) of the cheapest path over ``n`` characters; id -1: a character that no piece reaches."""
    worst = F.coalesce(F.array_max(F.transform(edges, lambda e: e["cost"])), F.lit(0.0)) + UNKNOWN_COST

    def step(best: Column, i: Column) -> Column:
        ending = F.transform(
            F.filter(edges, lambda e: e["b"] == i),
            lambda e: F.struct((F.get(best, e["a"])["cost"] + e["cost"]).alias("cost"), e["a"].alias("a"), e["id"].alias("id")),
        )
        single = F.exists(edges, lambda e: (e["b"] == i) & (e["a"] == i - 1))
        unknown = F.struct((F.get(best, i - 1)["cost"] + worst).alias("cost"), (i - 1).alias("a"), F.lit(-1).alias("id"))
        return F.concat(best, F.array(F.array_min(F.when(single, ending).otherwise(F.concat(ending, F.array(unknown))))))

    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(-1).alias("a"), F.lit(-1).alias("id")))
    best = F.aggregate(F.sequence(F.lit(1), n), start, step)

    def back(path: Column, i: Column) -> Column:
        e = F.get(best, path["at"])
        segment = F.struct(e["a"].alias("a"), path["at"].alias("b"), e["id"].alias("id"))
        return F.when(path["at"] > 0, F.struct(e["a"].alias("at"), F.concat(F.array(segment), path["segments"]).alias("segments"))).otherwise(path)

    end = F.struct(n.alias("at"), F.expr("cast(array() as array<struct<a:int,b:int,id:int>>)").alias("segments"))
    return F.aggregate(F.sequence(F.lit(1), n), end, back)["segments"]


def merges() -> Column:
    """The cuts that BPE leaves in column ``word`` with its ``edges``, as bits: bit i is set where a piece starts or the word ends.

    An edge is applicable when both its ends are cuts and exactly one cut is
    inside.  Edges that have lost an end leave the state, so later steps are cheap.
    """
    alive = "filter(edges, e -> e.b > e.a)"
    edge = "struct<ends:bigint,inner:bigint>"
    return F.expr(
        f"""aggregate(sequence(1, length(word)),
          named_struct('cuts', shiftleft(1L, length(word) + 1) - 1L, 'edges', cast(transform({alive}, e -> named_struct('ends', e.ends, 'inner', e.inner)) as array<{edge}>)),
          (s, i) -> CASE WHEN size(s.edges) = 0 THEN s ELSE aggregate(
              array(coalesce(get(filter(s.edges, e -> bit_count(s.cuts & e.inner) = 1), 0).inner, -1L)),
              s,
              (t, gone) -> CASE WHEN gone = -1L THEN named_struct('cuts', t.cuts, 'edges', cast(array() as array<{edge}>))
                ELSE named_struct('cuts', t.cuts & ~gone, 'edges', filter(t.edges, e -> (e.ends & gone & t.cuts) = 0L AND (e.inner & t.cuts & ~gone) != 0L)) END) END,
          s -> s.cuts)"""
    )


def _finish(model: Model):
    """Segments (a, b, id) of words to ids: byte pieces for what has no piece."""
    single = {p: i for p, i, _ in model.pieces}

    def ids(word: str, segments: list[dict]) -> list[int]:
        out: list[int] = []
        for s in segments:
            piece = word[s["a"] : s["b"]]
            i = s["id"] if s["id"] >= 0 else single.get(piece, -1)
            if i >= 0:
                out.append(i)
            elif model.bytes_:
                out.extend(model.bytes_[c] for c in piece.encode())
            elif not out or out[-1] != model.unknown:
                out.append(model.unknown)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [ids(w, s) for w, s in zip(b.column("word").to_pylist(), b.column("segments").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(rows, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return run


class Lattice:
    """The lattice of many words at once, in arrays: the same explode, equi-join, grouping and fold as above."""

    _P = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: Model) -> None:
        self.model, self.longest = model, model.longest
        rows = sorted((len(p), p, i, s) for p, i, s in model.pieces)
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for _, p, _, _ in rows]
        self.codes = np.zeros((len(rows), self.longest), np.uint32)
        for k, c in enumerate(codes):
            self.codes[k, : len(c)] = c
        self.size = np.array([r[0] for r in rows], np.int64)
        self.id, self.cost = np.array([r[2] for r in rows], np.int32), -np.array([r[3] for r in rows])
        h = np.zeros(len(rows), np.uint64)
        for k in range(self.longest):
            h = np.where(k < self.size, self._step(h, self.codes[:, k]), h)
        order = np.argsort(h)
        self.hash, self.row = h[order], order
        slots = np.zeros(1 << 20, bool)  # most substrings are no piece: a first sieve
        slots[h >> np.uint64(44)] = True
        self.slots = slots
        self.ids = {p: i for p, i, _ in model.pieces}
        self.single = np.full(0x110000, -1, np.int32)
        for p, i, _ in model.pieces:
            if len(p) == 1:
                self.single[ord(p)] = i
        self.rank = np.unique(self.cost, return_inverse=True)[1].astype(np.uint64)

    def _step(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        x = (h ^ (c.astype(np.uint64) + np.uint64(1))) * self._P
        return x ^ (x >> np.uint64(29))

    def edges(self, flat: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, piece) of all pieces of two characters or more; ``left`` has the characters to the word's end."""
        at, h, found = np.arange(len(flat)), np.zeros(len(flat), np.uint64), []
        for k in range(self.longest):
            keep = left[at] > k
            at, h = at[keep], h[keep]
            h = self._step(h, flat[at + k])
            if not k:
                continue
            some = np.nonzero(self.slots[h >> np.uint64(44)])[0]
            pos = np.minimum(np.searchsorted(self.hash, h[some]), len(self.hash) - 1)
            hit = self.hash[pos] == h[some]
            place, row = at[some[hit]], self.row[pos[hit]]
            same = self.size[row] == k + 1
            for j in range(k + 1):
                same &= self.codes[row, j] == flat[place + j]
            found.append((place[same], np.full(same.sum(), k + 1), row[same]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def merged(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Per word its cuts as bits (see ``merges``) and its length; of all characters the code, the word, the place, and the piece that starts there."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(words)), size)
        offset = np.arange(len(flat)) - start[owner]
        piece = self.single[flat]
        place, k, row = self.edges(flat, size[owner] - offset)
        one = np.uint64(1)
        key = owner[place].astype(np.uint64) << np.uint64(32) | self.rank[row] << np.uint64(8) | offset[place].astype(np.uint64)
        order = np.argsort(key)
        place, row, word = place[order], row[order], owner[place[order]]
        a, b = offset[place].astype(np.uint64), (offset[place] + k[order]).astype(np.uint64)
        ends, inner = (one << a) | (one << b), ((one << b) - one) & ~((one << (a + one)) - one)
        cuts = (one << (size + 1).astype(np.uint64)) - one
        while len(word):
            ready = np.nonzero(np.bitwise_count(cuts[word] & inner) == 1)[0]
            if not len(ready):
                break
            best = ready[np.append(True, word[ready[1:]] != word[ready[:-1]])]
            cuts[word[best]] &= ~inner[best]
            piece[place[best]] = self.id[row[best]]
            moved = np.zeros(len(words), bool)
            moved[word[best]] = True
            now = cuts[word]
            alive = moved[word] & ((now & ends) == ends) & ((now & inner) != 0)  # words that did not move are done
            word, ends, inner, place, row = word[alive], ends[alive], inner[alive], place[alive], row[alive]
        return cuts, size, owner, offset, piece

    def cuts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merged(words)[:2]

    def packed(self, words: list[str]) -> list[bytes]:
        """The ids of each word as 32-bit integers."""
        if not words:
            return []
        cuts, size, owner, offset, piece = self.merged(words)
        starts = (cuts[owner] >> offset.astype(np.uint64)) & np.uint64(1) == 1
        ids, of = piece[starts], owner[starts]
        ends = 4 * np.cumsum(np.bincount(of, minlength=len(words)))
        raw = ids.tobytes()
        out = [raw[x:y] for x, y in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
        for i in np.unique(of[ids < 0]).tolist():
            out[i] = np.array(self._odd(words[i], int(cuts[i]), int(size[i])), np.int32).tobytes()
        return out

    def _odd(self, w: str, c: int, n: int) -> list[int]:
        """The ids of a word with characters that have no piece."""
        ids, a = [], 0
        for b in range(1, n + 1):
            if c >> b & 1:
                i = self.ids.get(w[a:b])
                if i is not None:
                    ids.append(i)
                elif self.model.bytes_:
                    ids.extend(self.model.bytes_[x] for x in w[a:b].encode())
                elif not ids or ids[-1] != self.model.unknown:
                    ids.append(self.model.unknown)
                a = b
        return ids

    def encode(self, words: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(words)]


def _arrays(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Lattice(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(net.encode(b.column("word").to_pylist()), pa.list_(pa.int32()))], ["word", "n", "ids"])

    return run


def _library(path: str):
    """Long words by the library: after a line feed, which no piece crosses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = len(sp.encode("\n"))
        for b in batches:
            rows = [sp.encode("\n" + w)[skip:] for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(rows, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return run


def _with_long(done: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    if model.path is None:
        return done
    return done.union(words.where(F.length("word") > LONG).mapInArrow(_library(model.path), "word string, n long, ids array<int>"))


def encode_words(words: DataFrame, model: Model, native: bool | None = None) -> DataFrame:
    """(word, n) to (word, n, ids).  ``native``: DataFrame functions make and fold the
    lattice (unigram models always); else array operations do, on batches of words,
    about 27 times faster."""
    kind, out = model.kind, "word string, n long, ids array<int>"
    short = words.where((F.length("word") <= LONG) & (F.length("word") > 0))
    if kind == "bpe" and not native:
        return _with_long(short.mapInArrow(_arrays(model), out), words, model)
    rows = lattice(short, model, 2 if kind == "bpe" else 1)
    n = F.length("word")
    if kind == "bpe":
        rows = rows.select("word", "n", merges().alias("cuts"))
        rows = rows.withColumn("at", F.filter(F.sequence(F.lit(0), n), lambda i: F.getbit("cuts", i) == 1))
        segments = F.transform(F.slice("at", 1, F.size("at") - 1), lambda a, i: F.struct(a.alias("a"), F.get("at", i + 1).alias("b"), F.lit(-1).alias("id")))
    else:
        rows = rows.withColumn("edges", F.filter("edges", lambda e: e["b"] > e["a"]))
        segments = viterbi(F.col("edges"), n)
    done = rows.withColumn("segments", segments).select("word", "n", "segments").mapInArrow(_finish(model), out)
    return _with_long(done, words, model)


def common_words(words: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` of the commonest words that are not long: those with a rounded count at or above a cutoff."""
    unit = F.pow(F.lit(10), F.length(F.col("n").cast("string")) - 2).cast("long")
    level = F.when(F.col("n") < 100, F.col("n")).otherwise(F.col("n") - F.col("n") % unit)
    rows = words.where(F.length("word") <= LONG).withColumn("level", level)
    levels = rows.groupBy("level").agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect()  # some hundred levels at most
    cutoff, total = None, 0
    for r in levels:
        total += r["c"]
        if total > limit:
            break
        cutoff = r["level"]
    return rows.where(F.lit(False) if cutoff is None else F.col("level") >= cutoff).select("word", "n")


def _lists(parts: list[bytes]) -> pa.Array:
    sizes = np.array([len(p) // 4 for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


class Rest:
    """The ids of words outside the broadcast table, as bytes.  When ``new`` is full it
    becomes ``old``; words that are met again come back from there."""

    LIMIT = 300_000

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.net = Lattice(load(path))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.skip = len(self.library.encode("\n"))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of ``words``."""
        if len(self.new) > self.LIMIT:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        unknown = []
        for w in words:
            if w not in new:
                x = old.get(w)
                if x is None:
                    unknown.append(w)
                else:
                    new[w] = x
        short = [w for w in unknown if len(w) <= LONG]
        for i in range(0, len(short), 16_000):
            new.update(zip(short[i : i + 16_000], self.net.packed(short[i : i + 16_000]), strict=True))
        for w in unknown:
            if len(w) > LONG:
                new[w] = np.array(self.library.encode("\n" + w)[self.skip :], np.int32).tobytes()
        return new


@functools.lru_cache(maxsize=1)
def _rest(path: str) -> Rest:
    """One for all tasks of a worker process."""
    return Rest(path)


def encode(docs: DataFrame, path: str, frequent: int = FREQUENT, digest: bool = False) -> DataFrame:
    """Per row: doc_id, ids (array<int>) of the whole text; with ``digest`` also decoded_sha256, of the text that they decode to."""
    spark: SparkSession = docs.sparkSession
    model = load(path)
    pattern = word_pattern(model)
    common = saved(encode_words(common_words(saved(corpus_words(docs, model)), frequent), model, native=True)).toArrow()
    ids = [np.array(i, np.int32).tobytes() for i in common.column("ids").to_pylist()]
    table = spark.sparkContext.broadcast(dict(zip(common.column("word").to_pylist(), ids, strict=True)))  # at most ``frequent`` words of LONG characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rest = table.value, _rest(path)
        model = load(path)
        for b in pieces(batches, "text", chars=1 << 20):
            words = [words_of(t, pattern) for t in b.column("text").to_pylist()]
            parts = [list(map(known.get, w)) for w in words]
            odd = [k for k, p in enumerate(parts) if None in p]
            learnt = rest.learn({w for k in odd for w, p in zip(words[k], parts[k], strict=True) if p is None})
            for k in odd:
                parts[k] = [learnt[w] if p is None else p for w, p in zip(words[k], parts[k], strict=True)]
            out = list(map(b"".join, parts))
            columns, names = [b.column("doc_id"), _lists(out)], ["doc_id", "ids"]
            if digest:
                back = [decode_ids(np.frombuffer(x, np.int32).tolist(), model.texts) for x in out]
                columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()))
                names.append("decoded_sha256")
            yield pa.RecordBatch.from_arrays(columns, names)

    return doc_rows(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded_sha256 string" * digest)


def decode_ids(ids: list[int], texts: tuple[bytes, ...]) -> str:
    raw = b"".join([texts[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids) with ``text`` added, as the format decodes them."""
    texts = load(path).texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat, offsets = ids.flatten().to_numpy(), np.asarray(ids.offsets) - ids.offsets[0].as_py()
            out = [decode_ids(flat[x:y].tolist(), texts) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(out, pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, decoded_sha256 (of the text that the ids decode to)."""
    rows = encode(docs, path, digest=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")
