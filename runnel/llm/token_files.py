"""Token ids in binary files of patched frame-of-reference blocks.

A file (shard) holds the ids of a range of documents in ascending doc_id::

    magic | blocks | index | trailer

Each block of up to ``BLOCK`` ids subtracts its minimum, packs the differences
at the width of their ``PERCENTILE``-th percentile and stores the few wider
ones in an exception list (place, value).  The index has the place of every
block in the file and every document's id and length, so that a reader can
open any document without the rest.

Shards are written by Spark tasks into the shared folder, under a name of the
attempt's own that is renamed at the end: a rerun task replaces its file.

Defined results: a null or empty text has the end id alone; a null doc_id
comes first; repeated ids are stored row by row, in order of their texts; an
empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_rows, pieces, saved, shared_dir

BLOCK, PERCENTILE, END = 4096, 95, 0
MAGIC = b"RPF1"
_HEAD = struct.Struct("<HBHI")  # ids, width, exceptions, minimum
_TAIL = struct.Struct("<QQQQ4s")  # place of the index, blocks, documents, ids
_NULL = -(1 << 63)


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    d = (ids - low).astype("<u4")
    width = int(np.percentile(d, PERCENTILE, method="higher")).bit_length()
    wide = np.nonzero(d >> np.uint32(width))[0] if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(d.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return b"".join([_HEAD.pack(len(d), width, len(wide), low), np.packbits(bits, bitorder="little").tobytes(), wide.astype("<u2").tobytes(), d[wide].tobytes()])


def unpack_block(data: bytes) -> np.ndarray:
    n, width, wide, low = _HEAD.unpack_from(data)
    size = (n * width + 7) // 8
    at = _HEAD.size
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    d = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()
    if wide:
        d[np.frombuffer(data, "<u2", wide, at + size)] = np.frombuffer(data, "<u4", wide, at + size + 2 * wide)
    return d + np.uint32(low)


class Writer:
    """Appends documents' ids to an open binary stream."""

    def __init__(self, out) -> None:
        self.out, self.at, self.held, self.n_held, self.n_ids = out, len(MAGIC), [], 0, 0
        self.starts, self.ids, self.lens = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(_NULL if doc_id is None else doc_id)
        self.lens.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        if not self.n_held:
            return
        ids = np.concatenate(self.held)
        upto = len(ids) if last else len(ids) - len(ids) % BLOCK
        for i in range(0, upto, BLOCK):
            data = pack_block(ids[i : min(i + BLOCK, upto)])
            self.starts.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.n_ids += upto
        self.held, self.n_held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        for a, kind in ((self.starts, "<u8"), (self.ids, "<i8"), (self.lens, "<u8")):
            self.out.write(np.array(a, kind).tobytes())
        self.out.write(_TAIL.pack(self.at, len(self.starts), len(self.ids), self.n_ids, MAGIC))


def read_shard(file, size: int, piece: int = 256) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document, ``piece`` blocks in memory at a time."""
    file.seek(size - _TAIL.size)
    at, blocks, docs, n_ids, magic = _TAIL.unpack(file.read(_TAIL.size))
    file.seek(at)
    index = file.read(size - _TAIL.size - at)
    starts = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(at)).astype(np.int64)
    ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
    lens = np.frombuffer(index, "<u8", docs, 8 * (blocks + docs)).astype(np.int64)
    if magic != MAGIC or lens.sum() != n_ids:
        raise ValueError("not a whole token file")
    held, d = np.zeros(0, np.uint32), 0
    for b in range(0, blocks, piece):
        e = min(b + piece, blocks)
        file.seek(int(starts[b]))
        data = file.read(int(starts[e] - starts[b]))
        cut = starts[b : e + 1] - starts[b]
        held = np.concatenate([held, *[unpack_block(data[cut[i] : cut[i + 1]]) for i in range(e - b)]])
        done = 0
        while d < docs and done + lens[d] <= len(held):
            yield (None if ids[d] == _NULL else int(ids[d])), held[done : done + lens[d]]
            done += lens[d]
            d += 1
        held = held[done:]
    while d < docs:
        yield (None if ids[d] == _NULL else int(ids[d])), held[:0]
        d += 1


class Encoder:
    """Whole texts to ids with the tokenizers library.

    The pattern of a byte-level tokenizer always cuts before a space that
    stands between two other characters.  So a text is cut there, and each word
    is encoded once and then looked up.
    """

    LIMIT = 1_200_000  # words kept; the first ones seen stay, as frequent words come early
    _OTHER = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # white space but space and line feed
    _CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.size[i] = len(t)
        self.kind = "<u2" if len(self.size) <= 1 << 16 else "<u4"
        self.head: dict[str, bytes] = {}  # first words of texts
        self.rest: dict[str, bytes] = {}  # words after a space

    def _learn(self, words: list[str]) -> None:
        """Encodes new words after a space, many in one call."""
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            ids = np.array(self.tok.encode("".join([" " + w for w in part]), add_special_tokens=False).ids, np.int64)
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            cuts = np.searchsorted(np.cumsum(self.size[ids]), ends)
            if (np.cumsum(self.size[ids])[np.minimum(cuts, len(ids) - 1)] != ends).any():
                raise ValueError("a token spans two words")
            data, at = ids.astype(self.kind).tobytes(), 0
            for w, c in zip(part, ((cuts + 1) * int(self.kind[2])).tolist(), strict=True):
                self.rest[w] = self._kept(data[at:c])
                at = c

    def _plain(self, t: str) -> bool:
        """True if every space stands between two characters that are no white space."""
        return t[:1] != " " and t[-1:] != " " and not ("  " in t or "\n " in t or " \n" in t or self._OTHER.search(t))

    def _kept(self, ids: bytes) -> bytes | int:
        """What is looked up of a word's ids."""
        return ids

    def _words(self, texts: list[str]) -> list[list[str]]:
        """The texts cut into words, all of them known."""
        cut = [t.split(" ") if self._plain(t) else self._CUT.split(t) for t in texts]
        new = set().union(*[c[1:] for c in cut]).difference(self.rest)
        if new:
            self._learn(list(new))
        new = {c[0] for c in cut}.difference(self.head)
        for w, e in zip(new, self.tok.encode_batch_fast(list(new), add_special_tokens=False), strict=True):
            self.head[w] = self._kept(np.array(e.ids, self.kind).tobytes())
        return cut

    def _forget(self) -> None:
        for held in (self.rest, self.head):
            while len(held) > self.LIMIT:
                held.popitem()  # the last learned

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = self._words(texts)
        get, end = self.rest.__getitem__, np.array([END], self.kind).tobytes()
        out = [np.frombuffer(b"".join([self.head[c[0]], *map(get, c[1:]), end]), self.kind).astype(np.uint32) for c in cut]
        self._forget()
        return out


class Lengths(Encoder):
    """Keeps the number of a word's ids only, of fewer words: it shares its worker's memory with what stages before it left."""

    LIMIT = 500_000

    def _kept(self, ids: bytes) -> bytes | int:
        return len(ids) // int(self.kind[2])

    def lengths(self, texts: list[str]) -> list[int]:
        """Ids of each text with the end id."""
        cut = self._words(texts)
        out = [self.head[c[0]] + sum(map(self.rest.__getitem__, c[1:])) + 1 for c in cut]
        self._forget()
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """One for all tasks of a worker process, so that its words stay known."""
    return kind(path)


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:/") else "file://" + uri[5:])


def write(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes the shards into ``folder`` (a URI); one row per shard: shard, path, size, n_docs, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        final, temp = f"{base}/shard-{shard:06d}.rpf", f"{base}/_{shard:06d}-{uuid.uuid4().hex}"
        enc, w = encoder(tokenizer), None
        for b in pieces(batches, "text"):
            if w is None:
                out = fs.open_output_stream(temp)
                w = Writer(out)
            for d, t in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                w.add(d, t)
        if w is not None:
            w.close()
            out.close()
            if fs.get_file_info(final).type != pafs.FileType.NotFound:  # of an earlier run or attempt: not every store replaces
                fs.delete_file(final)
            fs.move(temp, final)
            row = [shard, final, fs.get_file_info(final).size, len(w.ids), w.n_ids]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["shard", "path", "size", "n_docs", "n_tokens"])

    rows = doc_rows(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return saved(rows.mapInArrow(run, "shard long, path string, size long, n_docs long, n_tokens long"))


def read_back(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, read from the files.

    The manifest has one row a shard, so their offsets are summed on the driver.
    """
    shards = manifest.orderBy("shard").collect()
    rows, at = [], 0
    for s in shards:
        rows.append((s["path"], s["size"], at))
        at += s["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for b in batches:
            for path, size, start in zip(*[b.column(c).to_pylist() for c in ("path", "size", "start")], strict=True):
                out = []
                with fs.open_input_file(path) as f:
                    for d, ids in read_shard(f, size):
                        out.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                kinds = ("doc_id", "start", "n_tokens", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], list(kinds))

    todo = spark.createDataFrame(rows, "path string, size long, start long").repartition(max(1, len(rows)))
    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_back(spark, write(docs, tokenizer, folder), folder)
