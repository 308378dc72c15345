"""Removal of repeated passages by sorting suffixes, deep-shallow style.

A byte goes when it is covered by a string of ``LEN`` = 50 bytes that also
starts in a document with a smaller id.

1. Exact copies are settled by a hash of the text: all but the smallest id go
   whole (if they have ``LEN`` bytes).  Only different texts go on.
2. Of every 50-byte string, the smallest hash among its ``GRAM``-byte grams
   picks an anchor, wherever the string stands.  Anchors are about one byte in
   eighteen.  Each task sends every gram once per window of texts, with the
   smallest id that has it there; grams in one document only drop out.  What is
   left are rows (doc_id, gram), one for each shared anchor.
3. For the shared anchors, the task that reads the text takes the stretch that
   holds the strings which chose the anchor.  A stretch that a text repeats is
   one row with its first place and how far on the others are.  Suffixes that meet in a window of
   the task are settled there: only those of the smallest id are sent, keyed by
   the gram, so a passage of every document costs a row per window.
4. Each group sorts the 50-byte suffixes of its stretches: multikey quicksort on
   eight-byte characters to a shallow depth, then blind tries for what still
   has a common prefix.  Equal suffixes meet, and those of larger ids go.
   A gram of more than ``SPLIT`` stretches is made longer: the strings of a
   stretch whose starts lie in the same block of ``BLOCK`` places before the
   anchor share 42 bytes around it, which take the gram's place.  A stretch has
   at most four blocks.  What more than ``SPLIT`` blocks still share is split by
   the 50 bytes themselves.  All go through the same sort.

The runs are merged per document and cut from the bytes.

Defined results: a null or empty text has no bytes; rows that repeat an id
never count as smaller than each other; a null id counts as larger than all
ids; an empty table gives no rows; texts of more than ``PIECE`` bytes are read
in overlapping pieces, with the same result; UTF-8 sequences may be cut apart,
and the text form drops such halves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, dropped, joined, pieces, saved

LEN, GRAM, SHALLOW, PIECE = 50, 16, 16, 1 << 21
GRAMS_HELD, STRETCHES_HELD, SPLIT, CHUNK, BLOCK = 1 << 20, 1 << 16, 4_000, 12_000, 9
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LAST = (1 << 63) - 1


def words_at(b: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from every place on, as a number; zeros follow the end."""
    pad = np.concatenate([b, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(pad, 8)[: len(b)].copy().view(order).ravel()


def _hashes(b: np.ndarray) -> np.ndarray:
    """The hash of the ``GRAM`` bytes at every place that has as many."""
    n = len(b) - GRAM + 1
    u = words_at(b)
    h = (u[:n] * _A) ^ (u[8 : 8 + n] >> np.uint64(7))
    h = (h ^ (h >> np.uint64(31))) * _B
    h = ((h ^ (h >> np.uint64(29))) + u[8 : 8 + n]) * _A
    return h ^ (h >> np.uint64(32))


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, last): of each anchor its gram's hash and the starts of the 50-byte strings that chose it."""
    n, w = len(b) - GRAM + 1, LEN - GRAM + 1
    if n < w:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    if len(b) > PIECE:
        parts = [anchors(b[i : i + PIECE]) for i in range(0, len(b) - LEN + 1, PIECE - LEN + 1)]
        shift = [i for i in range(0, len(b) - LEN + 1, PIECE - LEN + 1)]
        return tuple(np.concatenate([p[k] + (s if k else p[0].dtype.type(0)) for p, s in zip(parts, shift, strict=True)]) for k in range(4))
    h = _hashes(b)
    low = (h & ~np.uint64(PIECE * 2 - 1)) | np.arange(n, dtype=np.uint64)  # of equal hashes the leftmost
    width = 1
    while width < w:
        d = min(width, w - width)
        low = np.minimum(low[:-d], low[d:])
        width += d
    at = (low & np.uint64(PIECE * 2 - 1)).astype(np.int64)
    first = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
    last = np.append(first[1:] - 1, len(at) - 1)
    return h[at[first]], at[first], first, last


def equal_suffixes(rows: np.ndarray) -> np.ndarray:
    """Class numbers of equal rows (n, LEN) of bytes, by deep-shallow sorting.

    Shallow: multikey quicksort whose characters are eight bytes; every pass
    sorts the groups that are still equal by their next character.  Deep: each
    remaining group is a blind trie, grown path by path.  Its first member is a
    path from the root to a leaf; every other member is compared with it once,
    which gives the place where it leaves the path.  Members that leave at one
    place by one character are the next group, whose path starts there.
    """
    n = len(rows)
    wide = np.zeros((n, -(-LEN // 8) * 8), np.uint8)
    wide[:, :LEN] = rows
    chars = wide.view(">u8").astype(np.uint64)
    order = np.argsort(chars[:, 0], kind="quicksort")
    group = np.cumsum(np.append(False, chars[order[1:], 0] != chars[order[:-1], 0]))
    for d in range(1, SHALLOW // 8):
        c = chars[order, d]
        again = np.lexsort((c, group))
        order, group, c = order[again], group[again], c[again]
        group = np.cumsum(np.append(False, (group[1:] != group[:-1]) | (c[1:] != c[:-1])))
    out = np.empty(n, np.int64)
    free, depth = 0, SHALLOW // 8
    while len(order):
        head = np.append(True, group[1:] != group[:-1])
        number = np.cumsum(head) - 1
        differs = chars[order, depth:] != chars[order[head], depth:][number]
        on_path = ~differs.any(axis=1)
        out[order[on_path]] = free + number[on_path]
        free += int(head.sum())
        order, number, at = order[~on_path], number[~on_path], depth + np.argmax(differs[~on_path], axis=1)
        c = chars[order, at]
        again = np.lexsort((c, at, number))
        order, number, at, c = order[again], number[again], at[again], c[again]
        group = np.cumsum(np.append(False, (number[1:] != number[:-1]) | (at[1:] != at[:-1]) | (c[1:] != c[:-1]))) if len(order) else order
    return out


def _blob(k: np.ndarray, ids: np.ndarray, many: np.ndarray) -> bytes:
    """Grams, an id for each, and a bit for each: several documents of the batch have it."""
    base = int(ids.min())
    d = ids.astype(object) - base if int(ids.max()) - base >= 1 << 62 else ids - base
    kind = "<u4" if int(d.max()) < 1 << 32 else "<u8"
    head = np.array([len(k), base, int(kind[2])], "<i8")
    return b"".join([head.tobytes(), k.astype("<u8").tobytes(), d.astype(kind).tobytes(), np.packbits(many).tobytes()])


def _unblob(x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, base, size = (int(v) for v in np.frombuffer(x, "<i8", 3))
    ids = (np.frombuffer(x, f"<u{size}", n, 24 + 8 * n).astype(np.uint64) + np.array(base, np.int64).astype(np.uint64)).astype(np.int64)
    return np.frombuffer(x, "<u8", n, 24), ids, np.unpackbits(np.frombuffer(x, np.uint8, -1, 24 + (8 + size) * n))[:n].astype(bool)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.nonzero(np.append(True, x[1:] != x[:-1]))[0] if len(x) else np.zeros(0, np.int64)


_GRAMS = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("gram", pa.int64())])


def _grams(buckets: int):
    """Per window of texts: a blob of its grams for each bucket, with the smallest id of
    each; and, for the ids that are not the smallest, rows of their grams (known as shared)."""

    def rows(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        k, d = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        first = _starts(k)
        more = np.ones(len(k), bool)
        more[first] = False
        more &= d != np.repeat(d[first], np.diff(np.append(first, len(k))))
        many = np.logical_or.reduceat(more, first)
        known, grams = d[more], k[more].view(np.int64)
        k, d = k[first], d[first]
        bucket = (k % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        k, d, many, bucket = k[order], d[order], many[order], bucket[order]
        cut = np.append(_starts(bucket), len(k))
        blobs = [_blob(k[s:e], d[s:e], many[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
        n, m = len(blobs), len(known)
        cols = [
            pa.array(np.append(bucket[cut[:-1]], (known ^ grams) % buckets)),  # known rows need no meeting: dealt evenly
            pa.array(blobs + [None] * m, pa.binary()),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(known)]),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(grams)]),
        ]
        return pa.RecordBatch.from_arrays(cols, schema=_GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for b in pieces(batches, "text"):
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                k = np.unique(anchors(np.frombuffer(t.encode(), np.uint8))[0])
                if len(k):
                    keys.append(k)
                    ids.append(np.full(len(k), d, np.int64))
                    held += len(k)
            if held > GRAMS_HELD:
                yield rows(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield rows(keys, ids)

    return run


def _shared(part: pa.Table) -> pa.Table:
    """(doc_id, gram): what is shared, of a bucket; each window counts as one document with its smallest id."""
    known = part.filter(part.column("doc_id").is_valid()).select(["doc_id", "gram"])
    blobs = [_unblob(x) for x in part.column("blob").drop_null().to_pylist()]
    if not blobs:
        return known
    k, d, many = (np.concatenate([r[i] for r in blobs]) for i in range(3))
    order = np.lexsort((d, k))
    k, d, many = k[order], d[order], many[order]
    first = _starts(k)
    last = d[np.append(first[1:], len(k)) - 1]
    found = np.repeat((last > d[first]) | np.logical_or.reduceat(many, first), np.diff(np.append(first, len(k))))
    return pa.concat_tables([known, pa.table({"doc_id": d[found], "gram": k[found].view(np.int64)})])


_MORE = pa.list_(pa.int64())
_STRETCH = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("bytes", pa.binary()), ("more", _MORE)])


def _settled(gram: np.ndarray, ids: np.ndarray, h: np.ndarray, begin: np.ndarray, data: list[bytes], more: list) -> pa.RecordBatch:
    """The rows of a window: stretches to send, and, without bytes, spans that a smaller id of the window settles."""
    order = np.argsort(gram, kind="stable")
    first = np.append(_starts(gram[order]), len(gram))
    size = np.diff(first)
    alone = order[np.repeat(size == 1, size)]
    meet = order[np.repeat(size > 1, size)]
    cols = [gram[alone], ids[alone], h[alone], begin[alone], begin[alone] + np.array([len(data[i]) for i in alone], np.int64)]
    out, far = [data[i] for i in alone], [more[i] for i in alone]
    # Whole grams at a time, so that no more than about CHUNK stretches are suffixes at once.
    cuts, s = np.cumsum(size[size > 1]), 0
    while s < len(meet):
        e = int(cuts[max(np.searchsorted(cuts, s + CHUNK, side="right") - 1, np.searchsorted(cuts, s, side="right"))])
        rows = meet[s:e]
        strings, owner, place = _suffixes([data[i] for i in rows], begin[rows])
        cls = equal_suffixes(strings)
        least = np.full(cls.max() + 1, _LAST)
        np.minimum.at(least, cls, ids[rows][owner])
        gone = ids[rows][owner] > least[cls]
        o, b, n = _runs(gone, place, owner)
        cols = [np.append(c, x) for c, x in zip(cols, (gram[rows[o]], ids[rows[o]], h[rows[o]], b, n), strict=True)]
        out += [None] * len(o)
        far += [more[r] for r in rows[o]]
        o, b, n = _runs(~gone, place, owner)
        cols = [np.append(c, x) for c, x in zip(cols, (gram[rows[o]], ids[rows[o]], h[rows[o]], b, n), strict=True)]
        out += [data[r][x - y : z - y] for r, x, z, y in zip(rows[o].tolist(), b.tolist(), n.tolist(), begin[rows[o]].tolist(), strict=True)]
        far += [more[r] for r in rows[o]]
        s = e
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(out, pa.binary()), pa.array(far, _MORE)], schema=_STRETCH)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    n = 0

    def window() -> pa.RecordBatch:
        gram, ids, h, begin = (np.concatenate([x[i] for x in held]) for i in range(4))
        out = _settled(gram, ids, h, begin, *([y for x in held for y in x[i]] for i in (4, 5)))
        held.clear()
        return out

    for b in pieces(batches, "text"):
        grams = b.column("grams")
        for i, (d, h, t) in enumerate(zip(*[b.column(c).to_pylist() for c in ("doc_id", "h", "text")], strict=True)):
            raw = t.encode()
            k, _, first, last = anchors(np.frombuffer(raw, np.uint8))
            k = k.view(np.int64)
            at = np.nonzero(np.isin(k, grams[i].values.to_numpy(zero_copy_only=False)))[0]
            data = [raw[s:e] for s, e in zip(first[at].tolist(), (last[at] + LEN).tolist(), strict=True)]
            begin, places = first[at], {}
            for j, x in enumerate(data):
                places.setdefault(x, []).append(j)
            one = np.array([v[0] for v in places.values()], np.int64)
            more = [(begin[v[1:]] - begin[v[0]]).tolist() if len(v) > 1 else None for v in places.values()]
            held.append((k[at][one], np.full(len(one), d), np.full(len(one), h), begin[one], list(places), more))
            n += len(one)
            if n > STRETCHES_HELD:
                yield window()
                n = 0
    if n:
        yield window()


def _runs(dup: np.ndarray, place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges neighbouring duplicate starts of an owner to (owner, begin, end)."""
    p, o = place[dup], owner[dup]
    new = _starts_of(p, o)
    end = np.append(new[1:], len(p)) - 1 if len(p) else new
    return o[new], p[new], p[end] + LEN


def _starts_of(p: np.ndarray, o: np.ndarray) -> np.ndarray:
    return np.nonzero(np.append(True, (p[1:] != p[:-1] + 1) | (o[1:] != o[:-1])))[0] if len(p) else np.zeros(0, np.int64)


def _suffixes(data: list[bytes], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All 50-byte strings of the stretches: rows of bytes, their stretch, their place in the document."""
    size = np.array([len(x) for x in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    each = size - LEN + 1
    owner = np.repeat(np.arange(len(data)), each)
    offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    start = np.repeat(np.cumsum(size) - size, each) + offset
    return np.lib.stride_tricks.sliding_window_view(flat, LEN)[start], owner, begin[owner] + offset


def _sorted(part: pa.Table) -> pa.Table:
    """The spans of a bucket that start in a smaller id too; whole subgroups, some at a time."""
    part = part.sort_by([("gram", "ascending"), ("sub", "ascending")])
    gram, sub = part.column("gram").to_numpy(), part.column("sub").to_numpy()
    first = np.append(np.nonzero(np.append(True, (gram[1:] != gram[:-1]) | (sub[1:] != sub[:-1])))[0], len(gram))
    out, s = [], 0
    while s < len(gram):
        e = int(first[max(np.searchsorted(first, s + CHUNK, side="right") - 1, np.searchsorted(first, s, side="right"))])
        rows = part.slice(s, e - s)
        ids = rows.column("doc_id").to_numpy()
        strings, owner, place = _suffixes(rows.column("bytes").to_pylist(), rows.column("begin").to_numpy())
        cls = equal_suffixes(strings)
        least = np.full(cls.max() + 1, _LAST)
        np.minimum.at(least, cls, ids[owner])
        o, b, n = _runs(ids[owner] > least[cls], place, owner)
        out.append(pa.table({"doc_id": ids[o], "h": rows.column("h").to_numpy()[o], "begin": b, "end": n, "more": rows.column("more").take(pa.array(o))}))
        s = e
    return pa.concat_tables(out)


_SPLIT = "gram long, sub long, doc_id long, h long, begin long, bytes binary, more array<long>"


_BLOCK = ["gram", "sub", "doc_id", "h", "begin", "bytes", "more"]


def _blocks(width: int):
    """Stretches of common grams cut where ``start // width``, counted back from the anchor, changes.

    All strings of a block have the ``LEN + 1 - width`` bytes from its place on
    in common; their hash is the subgroup.  With a width of 1 it is the string's.
    """
    size = LEN + 1 - width

    def cut_up(b: pa.RecordBatch) -> pa.RecordBatch:
        data, gram, begin = b.column("bytes").to_pylist(), b.column("gram").to_numpy(), b.column("begin").to_numpy()
        length = np.array([len(x) for x in data], np.int64)
        flat, start = np.frombuffer(b"".join(data), np.uint8), np.cumsum(length) - length
        whose = np.repeat(np.arange(len(data)), length)
        hit = np.nonzero(_hashes(flat) == gram.view(np.uint64)[whose[: len(flat) - GRAM + 1]])[0]
        hit = hit[hit + GRAM <= (start + length)[whose[hit]]]
        anchor = hit[_starts(whose[hit])]  # the first in each stretch: of equal grams the leftmost was taken
        each = length - LEN + 1
        owner = np.repeat(np.arange(len(data)), each)
        s = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + start[owner]
        block = (anchor[owner] - s) // width
        first = np.nonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])))[0]
        end = s[np.append(first[1:], len(s)) - 1] + LEN
        s, o, at = s[first], owner[first], anchor[owner[first]] - block[first] * width
        common = np.lib.stride_tricks.sliding_window_view(flat, size)[at]
        x = np.zeros(len(o), np.uint64)
        for k in [*range(0, size - 8, 8), size - 8]:
            x = (x ^ common[:, k : k + 8].copy().view("<u8").ravel()) * _A
            x ^= x >> np.uint64(29)
        x = (x ^ block[first].astype(np.uint64)) * _B
        x ^= x >> np.uint64(32)
        text = [data[i][p:q] for i, p, q in zip(o.tolist(), (s - start[o]).tolist(), (end - start[o]).tolist(), strict=True)]
        cols = [gram[o], x.view(np.int64), *[b.column(c).to_numpy()[o] for c in ("doc_id", "h")], begin[o] + s - start[o]]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(text, pa.binary()), b.column("more").take(pa.array(o))], _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                yield cut_up(whole.slice(i, CHUNK))

    return run


def ranges(docs: DataFrame) -> DataFrame:
    """One row per (__id, __h) with __r, the list of byte ranges to remove, overlapping, of rows (doc_id, h, text)."""
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = saved(docs.select("doc_id", "h", F.octet_length("text").cast("long").alias("n")).distinct())
    least = sizes.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1").select("h", "least")
    copies = saved(sizes.join(least, "h").where("doc_id > least").select("doc_id", "h", "n"))
    rest = joined(docs, copies.select("doc_id", "h"), ["doc_id", "h"], "left_anti")
    sent = rest.select("doc_id", "text").mapInArrow(_grams(buckets), "bucket long, blob binary, doc_id long, gram long")
    shared = saved(sent.groupBy("bucket").applyInArrow(_shared, "doc_id long, gram long"))
    by_doc = shared.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))  # no more than a document has
    found = rest.join(by_doc.hint("shuffle_hash"), "doc_id").select("doc_id", "h", "text", "grams")
    stretches = saved(found.mapInArrow(_stretches, "gram long, doc_id long, h long, begin long, end long, bytes binary, more array<long>"))
    dropped(shared)
    settled = stretches.where("bytes IS NULL").select("doc_id", "h", "begin", "end", "more")
    todo = stretches.where("bytes IS NOT NULL").select("gram", "doc_id", "h", "begin", "bytes", "more")
    common = saved(todo.groupBy("gram").count().where(F.col("count") > SPLIT).select("gram"))
    rare = joined(todo, common, "gram", "left_anti").withColumn("sub", F.lit(0).cast("long"))
    blocks = saved(joined(todo, common, "gram", "left_semi").mapInArrow(_blocks(BLOCK), _SPLIT))
    still = saved(blocks.groupBy("gram", "sub").count().where(F.col("count") > SPLIT).select("gram", "sub"))
    single = joined(blocks, still, ["gram", "sub"], "left_semi").select(todo.columns).mapInArrow(_blocks(1), _SPLIT)
    groups = rare.unionByName(joined(blocks, still, ["gram", "sub"], "left_anti")).unionByName(single)
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("gram", "sub"), F.lit(buckets)))
    met = groups.groupBy("bucket").applyInArrow(_sorted, "doc_id long, h long, begin long, end long, more array<long>")
    whole = copies.where(F.col("n") >= LEN).select("doc_id", "h", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"))
    spans = settled.union(met).unionByName(whole, allowMissingColumns=True)
    far = F.explode(F.concat(F.array(F.lit(0).cast("long")), F.coalesce("more", F.expr("cast(array() as array<long>)")))).alias("far")
    spans = spans.select("doc_id", "h", "begin", "end", far).withColumns({c: F.col(c) + F.col("far") for c in ("begin", "end")})
    out = saved(spans.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set(F.struct("begin", "end")).alias("__r")))
    dropped(stretches, common, blocks, still, copies, sizes)
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(ranges):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def cut(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``raw``, and the number of maximal removed runs."""
    gone = merged(ranges)
    at, kept = 0, []
    for b, e in gone:
        kept.append(raw[at:b])
        at = e
    return b"".join([*kept, raw[at:]]), len(gone)


def _keyed(docs: DataFrame) -> DataFrame:
    return doc_rows(docs).select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.xxhash64("text", F.length("text"), F.crc32("text")).alias("h"), "text")


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows = []
            for d, t, r in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "__r")], strict=True):
                raw = t.encode()
                kept, n = cut(raw, [(x["begin"], x["end"]) for x in r or ()])
                rows.append((None if d == _LAST else d, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    r = ranges(_keyed(docs)).hint("shuffle_hash")  # as many as there are repeats, so never broadcast
    rows = _keyed(docs)
    rows = rows.join(r, (rows["doc_id"] == r["__id"]) & (rows["h"] == r["__h"]), "left").select("doc_id", "text", "__r")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text`` and ``n_chars`` (if there) counted anew; no row goes."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts = b.column("text").to_pylist()
            left = [
                t if not r else cut(t.encode(), [(x["begin"], x["end"]) for x in r])[0].decode("utf-8", "ignore")
                for t, r in zip(texts, b.column("__r").to_pylist(), strict=True)
            ]
            new = {"text": left, "n_chars": [None if t is None else len(t) for t in left]}
            cols = [pa.array(new[c], b.schema.field(c).type) if c in new else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    r = ranges(_keyed(docs)).hint("shuffle_hash")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"__i": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "__x": F.xxhash64(text, F.length(text), F.crc32(text))})
    rows = rows.join(r, (F.col("__i") == F.col("__id")) & (F.col("__x") == F.col("__h")), "left")
    return rows.select(*[F.col(f"`{c}`") for c in names], "__r").mapInArrow(run, docs.schema)
