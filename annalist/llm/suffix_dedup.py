"""Substring dedup by longest previous factors, over partitions of the corpus that hold all places of a string.

A byte is removed if it lies in a ``length``-byte string that also starts earlier. To bring equal strings together without
sorting every suffix in one place, each ``length``-byte window is sent where its anchor says: the smallest k-gram hash
in the window, leftmost on ties, which depends on the window's bytes alone. Consecutive windows with one anchor travel as one
segment. In a partition the windows whose hash has a twin are sorted as suffixes, by doubling (8, 16, 32, 64, then ``length`` bytes);
the bytes of neighbours in suffix order give their common prefixes, and each window's previous and next smaller places in that order give its
longest previous factor, up to ``length``. Where that reaches ``length``, the window stands earlier too.

Segments that are equal as a whole collapse before the shuffle (once in each task's buffer) and again before sorting, keeping
the earliest, so a text copied a million times costs one segment a task and not a group in one of them. k-grams that many documents share
(counted in a sample) are anchors only of windows that hold no others: what stands around a common line is dealt by what differs.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import id_text, labels, partitions, restore_id, table
from annalist.llm.text import CHUNK, Rolling, chunks, inside, ranges, release, sliding_min

LENGTH = 100
K = 12
#: zstandard level of dealt segments.
LEVEL = 5
#: Longer documents are taken in pieces of so many bytes that overlap by length - 1.
PIECE = 8 << 20
#: Segment bytes that a task buffers before it deals them out.
BUFFER = 16 << 20
#: A k-gram is common if more than COMMON_SHARE / deals of the documents hold it, in a sample of SAMPLE documents a deal; common k-grams are known by so many bits.
COMMON_SHARE, SAMPLE, COMMON_BITS = 4, 16, 20
U64 = np.uint64


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of starts in order of their first ``length`` bytes, and the eight bytes at every position as one number."""
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    head = np.zeros(n, U64)
    for j in range(8):
        head = (head << U64(8)) | padded[j : j + n]
    h = min(8, length)
    ranks = np.unique(head >> U64(64 - 8 * h), return_inverse=True)[1].astype(U64)
    while h < length:
        step = min(h, length - h)
        at = np.arange(n - step) if h + step < length else starts
        pair = (ranks[at] << U64(32)) | ranks[at + step]
        new = np.unique(pair, return_inverse=True)[1].astype(U64)
        if h + step < length:
            ranks = np.r_[new, np.zeros(step, U64)]
        else:
            ranks = new
        h += step
    if len(ranks) != len(starts):
        ranks = ranks[starts]
    return np.argsort(ranks, kind="stable"), head


def common_prefix(head: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the strings at a and at b have in common, up to ``length``."""
    out = np.full(len(a), length, np.int64)
    left = np.arange(len(a))
    for j in range(0, length, 8):
        x = head[a[left] + j] ^ head[b[left] + j]
        differ = x != 0
        same = sum((x[differ] < U64(1 << 8 * (8 - i))).astype(np.int64) for i in range(1, 8))
        out[left[differ]] = np.minimum(length, j + same)
        left = left[~differ]
        if not len(left):
            break
    return out


def before_smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each entry the least of ``common`` on the way back to the nearest entry of smaller place; 0 if there is none.

    common: of each entry and the one before it. Links skip entries of no smaller place, all at once, and so grow like powers of two."""
    link, least = np.arange(len(place)) - 1, common.copy()
    open_ = np.arange(1, len(place))
    open_ = open_[place[link[open_]] >= place[open_]]
    while len(open_):
        by = link[open_]
        least[open_] = np.minimum(least[open_], least[by])
        link[open_] = link[by]
        open_ = open_[link[open_] >= 0]
        open_ = open_[place[link[open_]] >= place[open_]]
    least[link < 0] = 0
    return least


def previous_factors(data: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For each start the longest prefix of its ``length`` bytes that also stands at a start of smaller place.

    That is the longer of those shared with the previous and the next smaller place in suffix order."""
    if not len(starts):
        return np.zeros(0, np.int64)
    order, head = suffix_order(data, starts, length)
    at, place = starts[order], place[order]
    common = np.r_[0, common_prefix(head, at[:-1], at[1:], length)]
    back = before_smaller(place, common)
    ahead = before_smaller(place[::-1], np.r_[0, common[:0:-1]])[::-1]
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(back, ahead)
    return out


def planes(x: np.ndarray) -> bytes:
    """64-bit integers by byte planes, of which the high ones vanish in compression."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def place_order(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Dense rank of (doc, pos)."""
    order = np.lexsort((pos, doc))
    new = np.r_[0, (np.diff(doc[order]) != 0) | (np.diff(pos[order]) != 0)].astype(np.int64)[: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def segments(data: np.ndarray, offsets: np.ndarray, length: int, k: int, common: np.ndarray | None = None):
    """First and last window of each segment, and its anchor. common: which k-grams, by the first bits of their hashes, are anchors at need only."""
    n = len(data)
    size = np.diff(offsets)
    whole = np.flatnonzero(size >= length)
    if not len(whole):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    roll = Rolling(data)
    at = np.arange(n - k + 1)
    gram = roll(at, at + k)
    last_choice = common[gram >> U64(64 - COMMON_BITS)].astype(U64) << U64(63) if common is not None else U64(0)
    gram = ((gram >> U64(1)) & ~U64(0xFFFFFF)) | last_choice | at.astype(U64)
    anchor = (sliding_min(gram, length - k + 1) & U64(0xFFFFFF)).astype(np.int64)
    ok = np.zeros(n - length + 2, np.int8)
    np.add.at(ok, offsets[whole], 1)
    np.add.at(ok, offsets[whole + 1] - length + 1, -1)
    ok = np.cumsum(ok[:-1], dtype=np.int8).astype(bool)
    new = np.r_[True, anchor[1:] != anchor[:-1]]
    first = np.flatnonzero(ok & (new | ~np.r_[False, ok[:-1]]))
    last = np.flatnonzero(ok & (np.r_[new[1:], True] | ~np.r_[ok[1:], False]))
    return first, last, anchor[first]


class Buffer:
    """Segments of one task until they are dealt out: copies collapse to the earliest."""

    def __init__(self, length: int, k: int, deals: int, common: np.ndarray | None = None):
        self.length, self.k, self.deals, self.common, self.parts, self.size = length, k, deals, common, [], 0

    def add(self, ids, base, data, offsets):
        first, last, anchor = segments(data, offsets, self.length, self.k, self.common)
        if len(first):
            doc = np.searchsorted(offsets, first, "right") - 1
            n = last - first + self.length
            self.parts.append((ids[doc], first - offsets[doc] + base[doc], last - first + 1, anchor - first, data[ranges(first, n)]))
            self.size += int(n.sum())

    def flush(self):
        """(deal, payload) rows; what is removed already goes along as plain ranges."""
        if not self.parts:
            return
        doc, pos, run, shift, data = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        akey, skey, at, n = keys(data, run, shift, self.length, self.k)
        stay, gone = copies(data, akey, skey, at, n, doc, pos)
        deal = (akey >> U64(40)).astype(np.int64) % self.deals
        r_doc, r_s, r_e = union(doc[gone], pos[gone], pos[gone] + run[gone] - 1 + self.length)
        r_deal = np.abs(r_doc) % self.deals
        stay = np.sort(stay)  # as read: neighbours of a block have close ids and like text, which compresses better
        stay = stay[np.argsort(deal[stay], kind="stable")]
        cut = np.searchsorted(deal[stay], np.arange(self.deals + 1))
        by = np.argsort(r_deal, kind="stable")
        r_cut = np.searchsorted(r_deal[by], np.arange(self.deals + 1))
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for d in np.flatnonzero((np.diff(cut) > 0) | (np.diff(r_cut) > 0)):
            s, r = stay[cut[d] : cut[d + 1]], by[r_cut[d] : r_cut[d + 1]]
            body = b"".join([
                struct.pack("<qq", len(s), len(r)),
                *(planes(x) for x in (np.diff(doc[s], prepend=0), pos[s], run[s], shift[s], r_doc[r], r_s[r], r_e[r])),
                data[ranges(at[s], n[s])].tobytes(),
            ])
            yield int(d), squeeze.compress(body)


def keys(data, run, shift, length, k):
    """Anchor and content hash of packed segments, and where their bytes are."""
    n = run + length - 1
    at = np.r_[0, np.cumsum(n)[:-1]]
    akey, skey = np.zeros(len(n), U64), np.zeros(len(n), U64)
    i = 0
    while i < len(n):  # in parts, so that temporaries stay small
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK)))
        lo, hi = at[i], at[j] if j < len(n) else at[-1] + n[-1]
        roll = Rolling(data[lo:hi])
        akey[i:j] = roll(at[i:j] - lo + shift[i:j], at[i:j] - lo + shift[i:j] + k)
        skey[i:j] = roll(at[i:j] - lo, at[i:j] - lo + n[i:j])
        i = j
    return akey, skey, at, n


def copies(data, akey, skey, at, n, doc, pos):
    """Segments that stay, in order of their anchors, and those that are later copies of one of them.

    Copies have equal hashes and equal bytes; of segments at one place (a repeated row) none is earlier."""
    order = np.lexsort((pos, doc, skey, akey))
    first = np.r_[True, (np.diff(akey[order]) != 0) | (np.diff(skey[order]) != 0)]
    owner = order[first][np.cumsum(first) - 1]
    copy = ~first
    copy[copy] = same_bytes(data, at[order[copy]], at[owner[copy]], n[order[copy]], n[owner[copy]])
    stay, copy, owner = order[~copy], order[copy], owner[copy]
    return stay, copy[(doc[copy] != doc[owner]) | (pos[copy] != pos[owner])]


def same_bytes(data, a, b, n, m) -> np.ndarray:
    """Which of the byte strings at a, n long, equal those at b, m long."""
    same = n == m
    check = np.flatnonzero(same)
    end = np.cumsum(n[check])
    i = 0
    while i < len(check):  # in parts, so that temporaries stay small
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + CHUNK)))
        some = check[i:j]
        differ = data[ranges(a[some], n[some])] != data[ranges(b[some], n[some])]
        same[some] = ~np.logical_or.reduceat(differ, np.r_[0, np.cumsum(n[some])[:-1]])
        i = j
    return same


def union(doc, s, e):
    """Ranges of each document, overlapping and touching ones merged."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    # running maximum of the ends, started anew by document: lift each document above all before it
    rank = np.cumsum(np.r_[0, np.diff(doc) != 0])
    lift = rank * (int(e.max()) + 1)
    top = np.maximum.accumulate(e + lift)
    new = np.r_[True, (s + lift)[1:] > top[:-1]] | np.r_[True, np.diff(doc) != 0]
    at = np.flatnonzero(new)
    return doc[at], s[at], (top - lift)[np.r_[at[1:] - 1, len(doc) - 1]]


def _grams(k: int):
    def run(batches):
        for _, data, offsets in chunks(batches):
            at = np.flatnonzero(inside(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), k))
            found, count = np.unique(Rolling(data)(at, at + k), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], names=["gram", "n"])
        release()

    return run


def common_grams(base: DataFrame, k: int, deals: int) -> np.ndarray:
    """Which k-grams, by the first COMMON_BITS bits of their hashes, more than COMMON_SHARE / deals of the documents hold.

    Counted in a sample of about SAMPLE * deals documents, by id. This decides where windows meet and not which are equal: other samples give the same result."""
    rows = base.count()
    share = min(1.0, SAMPLE * deals / max(rows, 1))
    some = base.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    seen = some.mapInArrow(_grams(k), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = seen.where(F.col("n") > max(SAMPLE * COMMON_SHARE // 2, int(share * rows * COMMON_SHARE / deals))).select(F.shiftrightunsigned("gram", 64 - COMMON_BITS).alias("gram")).distinct()
    out = np.zeros(1 << COMMON_BITS, bool)  # and so at most as many rows reach the driver
    out[found.toArrow()["gram"].to_numpy()] = True
    return out


def _deal(length: int, k: int, label: list[int], common=None):
    def run(batches):
        buffer = Buffer(length, k, len(label), common.value if common is not None else None)

        def out():
            rows = list(buffer.flush())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([label[d] for d, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["label", "payload"])

        for part, data, offsets in chunks(batches, size=min(CHUNK, PIECE)):
            ids = part.column("doc_id").to_numpy()
            if len(data) <= PIECE:
                buffer.add(ids, np.zeros(len(ids), np.int64), data, offsets)
            else:  # one long document
                for s in range(0, len(data) - length + 1, PIECE - length + 1):
                    piece = data[s : s + PIECE]
                    buffer.add(ids, np.array([s]), piece, np.array([0, len(piece)]))
                    if buffer.size >= BUFFER:
                        yield from out()
            if buffer.size >= BUFFER:
                yield from out()
        yield from out()
        release()

    return run


def find(payloads, length: int, k: int):
    """Removed ranges that the segments of one deal show: doc, start, end."""
    open_ = zstandard.ZstdDecompressor()
    parts, done = [], []
    for body in payloads:
        body = open_.decompress(body)
        m, r = struct.unpack_from("<qq", body)
        cols, at = [], 16
        for n in (m, m, m, m, r, r, r):
            cols.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel())
            at += 8 * n
        parts.append((np.cumsum(cols[0]), *cols[1:4], np.frombuffer(body, np.uint8, offset=at)))
        done.append(np.stack(cols[4:]))
    gone = [np.concatenate(done, axis=1)]
    doc, pos, run, shift, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts, body  # the bytes are held once
    if len(doc):
        akey, skey, at, n = keys(data, run, shift, length, k)
        rep, copy = copies(data, akey, skey, at, n, doc, pos)
        gone.append(np.stack([doc[copy], pos[copy], pos[copy] + n[copy]]))
        same = np.diff(akey[rep]) == 0
        rep = rep[np.r_[False, same] | np.r_[same, False]]
        if len(rep):
            gone.append(windows(doc[rep], pos[rep], run[rep], n[rep], data[ranges(at[rep], n[rep])], length))
    return union(*np.concatenate(gone, axis=1))


def windows(doc, pos, run, n, data, length):
    """Removed ranges among different segments: windows whose hash is alone have no equal, the others are sorted."""
    at = np.r_[0, np.cumsum(n)[:-1]]
    start = ranges(at, run)
    hashes = np.zeros(len(start), U64)
    own = np.repeat(np.arange(len(n)), run)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK)))
        a, b = at[lo], at[hi - 1] + n[hi - 1]
        i, j = np.searchsorted(start, a), np.searchsorted(start, b)
        hashes[i:j] = Rolling(data[a:b])(start[i:j] - a, start[i:j] - a + length)
        lo = hi
    by = np.argsort(hashes, kind="stable")
    tie = np.diff(hashes[by]) == 0
    twin = np.zeros(len(start), bool)
    twin[by] = np.r_[False, tie] | np.r_[tie, False]
    use = np.zeros(len(n), bool)
    use[own[twin]] = True
    if not use.any():
        return np.zeros((3, 0), np.int64)
    # pack the segments that have such windows
    kept = np.flatnonzero(use)
    moved = np.cumsum(np.r_[0, n[kept]])[:-1] - at[kept]
    shift = np.zeros(len(n), np.int64)
    shift[kept] = moved
    s, o = start[twin], own[twin]
    place = pos[o] + s - at[o]
    hit = previous_factors(data[ranges(at[kept], n[kept])], s + shift[o], place_order(doc[o], place), length) >= length
    return np.stack([doc[o][hit], place[hit], place[hit] + length])


def _find(length: int, k: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        doc, s, e = find(frame["payload"], length, k)
        release()
        return pd.DataFrame({"doc_id": doc, "s": s, "e": e})

    return run


def _keep(batches):
    for part, data, offsets in chunks(batches):
        lists = part.column("gone")
        count = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
        if lists.null_count:
            count = np.where(np.asarray(lists.is_null()), 0, count)
        flat = lists.flatten()
        s, e = np.asarray(flat.field("s")).astype(np.int64), np.asarray(flat.field("e")).astype(np.int64)
        row = np.repeat(np.arange(part.num_rows), count)
        size = np.diff(offsets)
        s, e = np.minimum(s, size[row]), np.minimum(e, size[row])  # rows that share an id but not a text
        row, s, e = union(row, s, e)
        row, s, e = row[e > s], s[e > s], e[e > s]
        mark = np.zeros(len(data) + 1, np.int32)
        np.add.at(mark, offsets[row] + s, 1)
        np.add.at(mark, offsets[row] + e, -1)
        stays = np.cumsum(mark[:-1]) == 0
        left = np.r_[0, np.cumsum(stays)][offsets]
        body = data[stays]
        span_at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["s", "e"])
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array(size, pa.int64()),
                pa.ListArray.from_arrays(pa.array(span_at), spans),
                pa.array([body[a:b].tobytes() for a, b in zip(left[:-1], left[1:], strict=True)], pa.binary()),
            ],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = K, deals: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes: s inclusive, e exclusive), kept (remaining bytes).

    Earlier means a smaller id, or a smaller start in the same document; strings are judged on the input and never cross documents.
    Null text is empty; texts shorter than ``length`` lose nothing. ``kept`` is binary, for a cut may part a character. A null id
    sorts first and comes back as null. Rows that repeat an id count as one document: equal places are no earlier copy of
    each other, and each such row loses the ranges found for any of them. Extra columns are pruned; an empty table gives an empty result.
    """
    if not 8 <= k < length:
        raise ValueError("k must be at least 8 and less than length")
    base = id_text(docs, id_col, text_col)
    label = labels(docs.sparkSession, deals or 2 * partitions(docs.sparkSession))
    common = docs.sparkSession.sparkContext.broadcast(common_grams(base, k, len(label)))  # 1 << COMMON_BITS bytes
    dealt = base.mapInArrow(_deal(length, k, label, common), "label int, payload binary")
    gone = dealt.repartition(len(label), "label").groupBy("label").applyInPandas(_find(length, k), "doc_id long, s long, e long")
    ranges_ = gone.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    return (
        base.join(ranges_, "doc_id", "left").mapInArrow(_keep, "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary")
        .withColumn("doc_id", restore_id("doc_id"))
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
