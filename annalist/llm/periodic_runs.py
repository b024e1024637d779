"""Periodic runs of words: stretches that repeat their first few words at least four times over, found and collapsed.

Aligned blocks of 2, 4, 8, ... words of a document become the keys of an Aho-Corasick automaton (``pyahocorasick`` over sequences of
integers), which finds every other occurrence of each of them in one pass a scale. A run of period q and at least 4q words
holds, for the one scale B with (2B - 1) / 3 <= q <= (4B - 2) / 3, an aligned block that occurs q words later inside it. So only occurrences at
such a distance are seeds, and each seed is extended to both sides word by word as long as words at that distance are equal.

Each row is found by itself within its own task: nothing is shuffled, and a task's memory follows its longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import NULL_ID, id_text, restore_id, table
from annalist.llm.text import KEEP_CASE, chunks, grams, inside, mix64, ranges, release, words

U64 = np.uint64
#: A run has at least so many words, and so many times its period.
LEAST, REPEATS = 6, 4
#: Rounds of the filter; each leaves less, and none takes a word of a run.
FILTER_ROUNDS = 4
RUNS = "array<struct<start:long,length:long,period:long>>"


def _stretches(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values."""
    edge = np.diff(np.r_[False, ok, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def candidates(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of stretches of words outside which no run lies.

    Every three consecutive words of a run stand in it three times at least, so a run lies where all word triples occur three times in the
    document, and then three times in that stretch.
    """
    three, at, part = grams(hashes, 3), np.arange(max(0, len(hashes) - 2)), doc
    keep = inside(doc, 3)
    start = end = np.zeros(0, np.int64)
    for _ in range(FILTER_ROUNDS):
        at = at[keep]
        if not len(at):
            return at, at
        key = mix64(three[at] ^ mix64(part[at].astype(U64)))
        order = np.argsort(key, kind="stable")
        first = np.r_[True, key[order][1:] != key[order][:-1]]
        size = np.diff(np.r_[np.flatnonzero(first), len(key)])
        often = np.empty(len(at), bool)
        often[order] = np.repeat(size >= REPEATS - 1, size)
        ok = np.zeros(len(three) + 1, bool)
        ok[at[often]] = True
        # triples of different documents are never neighbours: the two at a document's end are not inside it
        start, end = _stretches(ok)
        long = end - start >= LEAST - 2
        start, end = start[long], end[long]
        left = ranges(start, end - start)
        if len(left) == len(at):
            break
        part = np.zeros(len(hashes), np.int64)
        part[left] = np.repeat(np.arange(len(start)), end - start)
        keep, at = np.ones(len(left), bool), left
    return start, end + 2


def _reach(ids: np.ndarray, x: int, d: int, forward: bool) -> int:
    """How many words from x on (forward) or before x (backward) equal those d words later."""
    n, done, step = len(ids) - d - x if forward else x, 0, 32
    while done < n:
        step = min(step, n - done)
        a = x + done if forward else x - done - step
        different = ids[a : a + step] != ids[a + d : a + d + step]
        if different.any():
            return done + (int(different.argmax()) if forward else int(different[::-1].argmax()))
        done, step = done + step, step * 2
    return done


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of integers below 2**32, by start and period: stretches with smallest period q of at least
    max(6, 4q) words that cannot be extended."""
    n, found, block = len(ids), [], 2
    #: The furthest end of the runs of smaller period over each word.
    reach = np.zeros(n, np.int64)
    whole = tuple(ids.tolist())
    while True:
        low, high = (2 * block + 1) // 3, (4 * block - 2) // 3
        if max(LEAST, REPEATS * low) > n:
            return sorted(found, key=lambda r: (r[0], r[2]))
        x = np.arange(0, n - block + 1, block)
        # an occurrence inside a run of smaller period, together with its block, leads to nothing but that run
        after = np.maximum(x + low, reach[x] - block + 1)
        open_ = after <= np.minimum(x + high, n - block)
        x, after = x[open_], after[open_]
        if len(x):
            automaton, keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
            key_of = [keys.setdefault(whole[a : a + block], len(keys)) for a in x.tolist()]
            for key, number in keys.items():
                automaton.add_word(key, number)
            automaton.make_automaton()
            hits = np.array(list(automaton.iter(whole)), np.int64).reshape(-1, 2)
            del automaton, keys
            order = np.argsort(hits[:, 1], kind="stable")
            place, owner = hits[order, 0] - block + 1, hits[order, 1]
            # one ascending order of (key, place) for all searches
            flat, key = owner * (n + 1) + place, np.array(key_of, np.int64)
            a, b = np.searchsorted(flat, key * (n + 1) + after), np.searchsorted(flat, key * (n + 1) + np.minimum(x + high, n), "right")
            from_ = np.repeat(x, b - a)
            distance = place[ranges(a, b - a)] - from_
            order = np.lexsort((from_, distance))
            last, done = 0, 0
            for d, at in zip(distance[order].tolist(), from_[order].tolist(), strict=True):
                if d != last:
                    last, done = d, 0
                if at < done or reach[at] >= at + d + block:
                    continue
                start, end = at - _reach(ids, at, d, False), at + _reach(ids, at, d, True)
                done = end
                if end + d - start >= max(LEAST, REPEATS * d) and reach[start] < end + d:
                    found.append((start, end + d - start, d))
                    np.maximum(reach[start : end + d], end + d, out=reach[start : end + d])
        block *= 2


def _runs_of_chunk(hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of all documents of a chunk, by start."""
    for a, b in zip(*candidates(hashes, doc), strict=True):
        _, ids = np.unique(hashes[a:b], return_inverse=True)
        for start, length, period in find_runs(ids):
            yield int(a) + start, length, period


def _collapsed(batches: Iterable[pa.RecordBatch], rewrite: Callable[[int, int], np.ndarray | None] | None) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches):
        found = words(data, offsets, fold=KEEP_CASE)
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
        at = np.arange(len(found.hash))
        for i in range(len(ids)) if rewrite else ():
            a, b = found.first[i : i + 2]
            order = rewrite(int(ids[i]), int(b - a)) if b > a else None
            if order is not None:
                at[a:b] = a + order
        doc = found.doc
        n_docs, per_doc, gone = len(ids), [[] for _ in ids], np.zeros(len(at) + 1, np.int64)
        for start, length, period in _runs_of_chunk(found.hash[at], doc):
            i = int(doc[start])
            per_doc[i].append({"start": start - int(found.first[i]), "length": length, "period": period})
            gone[start + period] += 1
            gone[start + length] -= 1
        stay = np.cumsum(gone)[:-1] == 0
        start, end = found.start[at][stay], found.end[at][stay]
        # words with the byte after each, which becomes the blank between them
        size = end - start + 1
        text = np.r_[data, np.uint8(0x20)][ranges(start, size)]
        text[np.cumsum(size) - 1] = 0x20
        upto = np.zeros(n_docs + 1, np.int64)
        upto[1:] = np.cumsum(np.bincount(doc[stay], weights=size, minlength=n_docs)[:n_docs].astype(np.int64))
        body = text.tobytes()
        joined = [body[upto[i] : max(upto[i], upto[i + 1] - 1)].decode() for i in range(n_docs)]
        yield pa.record_batch(
            [rows.column("doc_id"), pa.array(np.diff(found.first)), pa.array(per_doc, pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))), pa.array(joined, pa.string())],
            names=["doc_id", "n_words", "runs", "text"],
        )
    release()


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period), and text: the words that no run holds after its first period, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, known by 64-bit hashes. ``rewrite(doc_id, n_words)`` may give, for each place, the number of the word to take there (None: the text as it is).
    Null text counts as empty and gives no runs and empty text; a null id comes back as null; each row is judged by itself, so ids may repeat. Extra columns are pruned,
    and an empty table gives an empty result. A text of any length is handled whole by one task.
    """
    out = id_text(docs, id_col, text_col).mapInArrow(lambda batches: _collapsed(batches, rewrite), f"doc_id long, n_words long, runs {RUNS}, text string")
    return out.withColumn("doc_id", restore_id("doc_id"))


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """The query's rewriting: a tenth of the documents end in repetitions of some of their words. A null id is left as it is."""
    h = 1 if doc_id == NULL_ID else crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    # the longest run; of several the first, and of those the one of smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    line: Column = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(line.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
