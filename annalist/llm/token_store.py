"""Token ids as bit-plane files.

A file holds the documents of one range of ids: blocks of ``block`` ids, each transposed into byte planes (all lowest bytes, then
all second bytes, ...) or bit planes and each plane compressed with zstandard; then the index (documents' ids and lengths, and each
block's place and plane sizes), its length, and the magic. High planes of small ids are almost all zeros and vanish.
"""

from __future__ import annotations

import itertools
import json
import struct
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import cut, fresh_path, id_text, restore_id, table
from annalist.llm.files import attempt_name, open_new, resolve
from annalist.llm.text import LOWER, Rolling, chunks, member, ranges, release

MAGIC = b"BPLANES1"
BLOCK = 1 << 16
#: Distinct parts of texts whose ids a worker remembers, in some 40 bytes each.
CACHE = 1_000_000
#: Id bytes that the reader gathers before it hands on rows.
BATCH = 4 << 20


def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def join_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class Writer:
    def __init__(self, sink, block: int = BLOCK, planes: str = "byte", level: int = 3):
        self.sink, self.block, self.planes, self.level = sink, block, planes, level
        self.open, self.waiting, self.at, self.total = [], 0, 0, 0
        self.blocks, self.docs, self.lengths = [], [], []

    def add(self, docs: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Ids of some documents end to end, and how many each has."""
        self.docs.append(docs)
        self.lengths.append(count)
        self.total += len(ids)
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.open)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._write(ids[i : i + self.block])
            self.open, self.waiting = [ids[whole:].copy()], len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        squeeze = zstandard.ZstdCompressor(level=self.level)
        parts = [squeeze.compress(p) for p in split_planes(ids, self.planes)]
        self.blocks.append([self.at, len(ids), [len(p) for p in parts]])
        for p in parts:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.waiting:
            self._write(np.concatenate(self.open))
        squeeze = zstandard.ZstdCompressor(level=self.level)
        head = {"blocks": self.blocks, "block": self.block, "planes": self.planes, "docs": sum(map(len, self.docs))}
        parts = [squeeze.compress(x) for x in (json.dumps(head).encode(), np.concatenate(self.docs).astype("<i8").tobytes(), np.concatenate(self.lengths).astype("<i8").tobytes())]
        index = struct.pack("<3q", *map(len, parts)) + b"".join(parts)
        self.sink.write(index + struct.pack("<q", len(index)) + MAGIC)
        self.sink.close()


class Reader:
    """Any range of ids of one file; only the blocks that hold it are read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a bit-plane file")
        (n,) = struct.unpack("<q", tail[:8])
        index = source.read_at(n, size - 16 - n)
        a, b, c = struct.unpack_from("<3q", index)
        self.squeezed = zstandard.ZstdDecompressor()
        self.head = json.loads(self.squeezed.decompress(index[24 : 24 + a]))
        self.docs = np.frombuffer(self.squeezed.decompress(index[24 + a : 24 + a + b]), "<i8")
        self.lengths = np.frombuffer(self.squeezed.decompress(index[24 + a + b : 24 + a + b + c]), "<i8")
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.last = (-1, np.zeros(0, np.uint32))

    def _block(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            at, n, sizes = self.head["blocks"][i]
            body, parts, p = self.source.read_at(sum(sizes), at), [], 0
            for s in sizes:
                parts.append(self.squeezed.decompress(body[p : p + s]))
                p += s
            self.last = (i, join_planes(parts, n))
        return self.last[1]

    def read(self, start: int, end: int) -> np.ndarray:
        size = self.head["block"]
        parts = [self._block(i)[max(0, start - i * size) : end - i * size] for i in range(start // size, -(-end // size))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class Encoder:
    """Ids of whole texts through the tokenizers library.

    ``by_part``: for a tokenizer that lower-cases, drops white space, separates letters from marks, and ends words with a marked token, so that a
    text's ids are those of its parts: runs without white space, cut also between ASCII letters and other ASCII marks (but
    not behind an apostrophe, which may begin a contraction). Each distinct part is encoded once while the worker remembers it, found again by
    its 64-bit hash; parts of letters alone are encoded as one string, in which each ends at a word-end token. Texts that hold
    a special token are encoded whole.
    """

    def __init__(self, path: str, end: int, by_part: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.by_part = Tokenizer.from_file(path), end, by_part
        self.keys, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, "<u4"), 0
        if by_part:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            self.length = np.zeros(len(self.last), np.int64)
            for t, i in vocabulary.items():
                self.length[i] = len(t.removesuffix("</w>"))
            self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array("I", x.ids), "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelt(self, letters: list[str], ids: np.ndarray, ends: np.ndarray) -> bool:
        """Whether the tokens up to each end are as long in bytes as that part; a part with two ends beside one with none would not be."""
        size = np.diff(np.r_[0, np.cumsum(self.length[ids])[ends - 1]]) if len(ends) else np.zeros(0, np.int64)
        return bool((size == [len(x.encode()) for x in letters]).all())

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        alpha = np.array([t.isalpha() for t in texts], bool)
        letters = list(itertools.compress(texts, alpha))
        ids = np.array(self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        # a part ends at one token and starts behind the last one's: its tokens then spell just its own letters
        whole = len(ends) == len(letters) and (not len(ends) or ends[-1] == len(ids))
        if whole and not self._spelt(letters, ids, ends):  # a letter that the normaliser turns into something else
            whole = False
        if not whole:
            found = self._plain(letters)
            ids, ends = np.concatenate(found), np.cumsum([len(x) for x in found])
        others = self._plain(list(itertools.compress(texts, ~alpha)))
        count = np.zeros(len(texts), np.int64)
        count[alpha] = np.diff(ends, prepend=0)
        count[~alpha] = [len(x) for x in others]
        body = np.concatenate([ids, *others]) if others else ids
        start = np.zeros(len(texts), np.int64)
        start[alpha] = ends - count[alpha]
        start[~alpha] = len(ids) + np.cumsum(count[~alpha]) - count[~alpha]
        return body[ranges(start, count)], count

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """keys ascending, none of them known."""
        if len(self.keys) + len(keys) > CACHE:
            self.keys, self.at, self.count, self.used = self.keys[:0], self.at[:0], self.count[:0], 0
        ids, count = self._encode(texts)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool[: self.used], np.zeros(max(len(self.pool) // 2, len(ids)), "<u4")]
        self.pool[self.used : self.used + len(ids)] = ids
        spot = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, spot, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, spot, count)
        self.keys = np.insert(self.keys, spot, keys)
        self.used += len(ids)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end with their ends, and how many each has."""
        docs = len(offsets) - 1
        if not self.by_part:
            body = data.tobytes()
            found = [np.r_[x, np.uint32(self.end)] for x in self._plain([body[a:b].decode("utf-8") for a, b in zip(offsets[:-1], offsets[1:], strict=True)])]
            return np.concatenate(found), np.array([len(x) for x in found])
        low = LOWER[data]
        start, end = parts(low, offsets)
        keys, first, where = np.unique(Rolling(low)(start, end), return_index=True, return_inverse=True)
        new = np.flatnonzero(~member(keys, self.keys))
        if len(new):
            body = low.tobytes()
            if len(self.keys) + len(new) > CACHE:  # all of this chunk's parts are learned anew
                self.keys, new = self.keys[:0], np.arange(len(keys))
            texts = [body[a:b].decode("utf-8") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            self._learn(keys[new], texts)
        known = np.searchsorted(self.keys, keys)
        # each document's parts, then the end: one more part whose id is kept behind the pool's
        owner = np.searchsorted(start, offsets)
        per_doc = np.diff(owner)
        slot = np.arange(len(start)) + np.repeat(np.arange(docs), per_doc)
        at, count = np.full(len(start) + docs, -1, np.int64), np.ones(len(start) + docs, np.int64)
        at[slot], count[slot] = self.at[known][where], self.count[known][where]
        spot = ranges(at, count)
        ids = self.pool[spot]
        ids[spot < 0] = self.end
        total = np.r_[0, np.cumsum(count)][owner + np.arange(docs + 1)]
        body = data.tobytes()
        if not any(s in body for s in self.special):
            return ids, np.diff(total)
        out = []
        for i in range(docs):
            text = body[offsets[i] : offsets[i + 1]]
            special = any(s in text for s in self.special)
            out.append(np.r_[self._plain([text.decode("utf-8")])[0], np.uint32(self.end)] if special else ids[total[i] : total[i + 1]])
        return np.concatenate(out), np.array([len(x) for x in out])


#: 0 white space, 1 ASCII letter, 2 ASCII mark, 3 anything else (apostrophes, digits, controls, bytes of other characters).
KIND = np.full(256, 3, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[97:123] = 1
KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2


def parts(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each part, and the byte after it."""
    n = len(low)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[low]
    cut_ = np.ones(n, bool)  # whether something ends before this byte
    a, b = kind[:-1], kind[1:]
    cut_[1:] = (a == 0) | (b == 0) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    cut_[offsets[:-1][offsets[:-1] < n]] = True
    here = kind != 0
    start = np.flatnonzero(cut_ & here)
    return start, np.flatnonzero(np.r_[cut_[1:], True] & here) + 1


_encoders: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    """One for each Python worker."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]


MANIFEST = "file string, first long, docs long, ids long"


def _write(folder, tokenizer, end, by_part, block, planes):
    def run(batches):
        encode, out, first = _encoder(tokenizer, end, by_part), None, None
        for part, data, offsets in chunks(batches):
            if out is None:
                sink, name = open_new(folder, attempt_name("ids", ".bpl"))
                out = Writer(sink, block, planes)
            docs = part.column("doc_id").to_numpy()
            first = int(docs[0]) if first is None else first
            ids, count = encode(data, offsets)
            out.add(docs, ids, count)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first": [first], "docs": [sum(map(len, out.docs))], "ids": [out.total]})
        release()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None, by_part: bool = True, block: int = BLOCK, planes: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end``, and write ids in ascending order of doc_id; returns the manifest: file, first (doc_id), docs, ids, start.

    Null and empty texts are just ``end``. A null id comes first. Rows that share an id are all written, by text. Extra columns are
    pruned; an empty table gives no files. ``by_part``: see ``Encoder``.
    The tokenizer file must be at the same path on every machine.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(_write(folder or fresh_path(spark, "tokens"), tokenizer, end, by_part, block, planes), MANIFEST)
    manifest = cut(made, "manifest")
    # one row per file; ranges of ids do not overlap
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(batches):
    for part in batches:
        for name, base in zip(part.column("file").to_pylist(), part.column("start").to_pylist(), strict=True):
            fs, path = resolve(name)
            with fs.open_input_file(path) as source:
                reader = Reader(source)
                i, n = 0, len(reader.docs)
                while i < n:
                    j = max(i + 1, int(np.searchsorted(reader.starts, reader.starts[i] + BATCH // 4)) - 1)
                    s, e = int(reader.starts[i]), int(reader.starts[j])
                    body = reader.read(s, e).astype("<u4").tobytes()
                    cuts = (reader.starts[i : j + 1] - s) * 4
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.docs[i:j], pa.int64()), pa.array(base + reader.starts[i:j], pa.int64()), pa.array(reader.lengths[i:j], pa.int64()),
                            pa.array([body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    i = j


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, a file a task."""
    files = max(1, manifest.count())
    rows = manifest.select("file", "start").repartitionByRange(files, "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
    return rows.withColumn("doc_id", restore_id("doc_id"))


def token_rows(docs: DataFrame) -> DataFrame:
    """Production settings: write, read back, and sum up each document."""
    import public_tokenizers

    manifest = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"))
