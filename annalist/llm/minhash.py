"""MinHash near-duplicates with SuperMinHash signatures (Ertl, 2017).

Each shingle draws a random permutation of the signature's places and a uniform rank at each step j, worth rank + j, so
a signature's entries are correlated and their variance is lower. Steps are done level by level over many documents at
once; a document whose places are all filled stops early, for later steps only bring larger values.

Documents with equal shingle sets are one class from the start, so copies are never paired. Classes that share a
band become candidates by one edge each to the band's smallest id; the connected components of these edges bound where
links can be. Inside a component the links are found on whole shingle sets by breadth-first search: a document taken
from the queue is compared, through an inverted index, with the documents not yet reached, so a group of thousands of
near copies costs little more than one comparison each and no pair is ever written. A large component is cut into blocks, and
each pair of blocks is one task that gives the forest of its links, so the largest group is neither one task nor one task's memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import cut, id_text, join_small, restore_id, table
from annalist.llm.components import components
from annalist.llm.text import chunks, grams, inside, mix64, release, words

SHINGLE = 5
#: 24 bands of 4: a pair at similarity 0.80 shares none with probability 3e-6, one at 0.85 with 2e-8.
BANDS, ROWS = 24, 4
BLOCK_SHINGLES = 6_000_000
#: A component is spread over up to FAN blocks of at least SPREAD_SHINGLES; past FAN * BLOCK_SHINGLES over as many as memory asks for.
SPREAD_SHINGLES, FAN = 75_000, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted in each document, and where each document's begin."""
    found = words(data, offsets)
    n_words = np.diff(found.first)
    docs = len(n_words)
    whole = grams(found.hash, k)
    ok = inside(found.doc, k)
    parts = [(found.doc[: len(whole)][ok], whole[ok])]
    for n in range(1, k):  # documents of fewer words: the sequence as one shingle
        short = np.flatnonzero(n_words == n)
        if len(short):
            at = found.first[short]
            picked = (at[:, None] + np.arange(n)[None, :]).ravel()
            parts.append((short, grams(found.hash[picked], n)[::n]))
    doc, shingle = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    keep = np.r_[True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])][: len(doc)]
    return shingle[keep], np.searchsorted(doc[keep], np.arange(docs + 1))


def superminhash(sets: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """(documents, m) signature values, step in the upper and rank in the lower 32 bits; empty sets keep the maximum."""
    docs = len(first) - 1
    size = np.diff(first)
    doc = np.repeat(np.arange(docs), size)
    out = np.full(docs * m, np.iinfo(np.uint64).max, np.uint64)
    seed, places = mix64(sets), None
    for j in range(m):
        draw = mix64(seed + np.uint64(int(_STEP) * (j + 1) % 2**64))
        swap = j + ((draw >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        value = (draw & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32)
        if places is None:
            place = swap
        else:
            row = np.arange(len(seed))
            place = places[row, swap].astype(np.int64)
            places[row, swap] = places[:, j]
            places[:, j] = place
        np.minimum.at(out, doc * m + place, value)
        open_ = (out.reshape(docs, m).max(axis=1) == np.iinfo(np.uint64).max) & (size > 0)
        going = open_[doc]
        if not going.any():
            break
        if places is None:
            seed, doc, swap = seed[going], doc[going], swap[going]
            places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(seed), 1))
            row = np.arange(len(seed))
            places[row, swap] = 0
            places[:, 0] = swap
        elif not going.all():
            seed, doc, places = seed[going], doc[going], places[going]
    return out.reshape(docs, m)


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        for part, data, offsets in chunks(batches):
            sets, first = shingle_sets(data, offsets, k)
            n = np.diff(first)
            signature = superminhash(sets, first, bands * rows).reshape(len(n), bands, rows)
            keys = np.zeros((len(n), bands), np.uint64)
            for r in range(rows):
                keys = mix64(keys + signature[:, :, r] + np.arange(bands, dtype=np.uint64)[None, :] * _STEP)
            sums = [np.add.reduceat(np.r_[mix64(sets ^ np.uint64(c)), np.uint64(0)], np.minimum(first[:-1], len(sets))) for c in (1, 2)]
            bands_at = pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(s.view(np.int64)) for s in sums], pa.ListArray.from_arrays(bands_at, pa.array(keys.ravel().view(np.int64)))],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"],
            )
        release()

    return run


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, as (position, position)."""
    g = len(sets)
    size = np.array([len(s) for s in sets])
    left = np.flatnonzero(size)
    forest: list[tuple[int, int]] = []
    _, ids = np.unique(np.concatenate(sets), return_inverse=True) if g else (None, np.zeros(0, np.int64))
    at = np.r_[0, np.cumsum(size)]
    owner = np.repeat(np.arange(g), size)
    waiting = np.zeros(g, bool)
    waiting[left] = True
    post = start = None
    indexed = 0
    queue: list[int] = []
    remaining = int(waiting.sum())
    cursor = 0
    while remaining:
        if not queue:
            while not waiting[left[cursor]]:
                cursor += 1
            waiting[left[cursor]] = False
            remaining -= 1
            queue.append(int(left[cursor]))
            if not remaining:
                break
        if post is None or remaining * 2 < indexed:  # index again once half of it is reached
            live = waiting[owner]
            order = np.argsort(ids[live], kind="stable")
            post = owner[live][order]
            start = np.searchsorted(ids[live][order], np.arange((ids.max() if len(ids) else 0) + 2))
            indexed = remaining
        x = queue.pop()
        mine = ids[at[x] : at[x + 1]]
        count = start[mine + 1] - start[mine]
        total = int(count.sum())
        if not total:
            continue
        inner = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[mine], count)
        both = np.bincount(post[inner], minlength=g)
        linked = np.flatnonzero(waiting & (both > 0) & (100 * both >= percent * (size[x] + size - both)))
        waiting[linked] = False
        remaining -= len(linked)
        forest += [(x, int(y)) for y in linked]
        queue += linked.tolist()
    return forest


def _verify(k: int, percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        sets = []
        for body in frame["text"]:
            raw = np.frombuffer(body.encode("utf-8", "surrogatepass"), np.uint8)
            sets.append(shingle_sets(raw, np.array([0, len(raw)]), k)[0])
        ids = frame["doc_id"].to_numpy()
        found = links(sets, percent)
        del sets
        release()
        return pd.DataFrame({"a": ids[[a for a, _ in found]], "b": ids[[b for _, b in found]]}, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept.

    Links: 100 * |A & B| >= percent * |A | B| on the sets of distinct k-word shingles; a document of fewer words has its
    sequence as one shingle. Null, empty and wordless texts have no shingles, link with nothing and stay. Rows that
    repeat an id are one document to the links, and each of them is returned. A null id sorts before all others
    and comes back as null. Extra columns are pruned; an empty table gives an empty result.
    """
    base = id_text(docs, id_col, text_col)
    rows_ = cut(base.mapInArrow(_signatures(k, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "signatures")
    # one representative for each distinct set; copies collapse before the shuffle, and no set's rows meet in one task
    classes = rows_.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copied = cut(classes.where("n > 1").select("s1", "s2", "n_shingles", "rep"), "classes")
    members = join_small(rows_, copied, ["s1", "s2", "n_shingles"]).withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")))
    reps = members.where("rep = doc_id")
    banded = cut(reps.select("doc_id", "n_shingles", F.explode("bands").alias("key")), "bands")
    shared = cut(banded.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader"), "buckets")
    edges = join_small(banded, shared, ["key"], "inner", salts=8).where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    group = components(edges)
    sizes = group.join(reps.select(F.col("doc_id").alias("node"), "n_shingles").dropDuplicates(["node"]), "node")
    total = sizes.groupBy("root").agg(F.sum("n_shingles").alias("shingles"))
    size = F.least(F.lit(float(block)), F.greatest(F.lit(float(SPREAD_SHINGLES)), F.col("shingles") / FAN))
    total = cut(total.select("root", F.ceil(F.col("shingles") / size).cast("int").alias("nb")), "sizes")
    # a component of nb blocks: its members go to each pair of blocks that holds theirs (a pair finds the links inside both)
    mine = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    tasks = (
        join_small(group, total, ["root"], "inner")
        .withColumn("mine", mine)
        .select("root", F.col("node").alias("doc_id"), "mine", "nb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
        .where("nb = 1 or mine <> other")
        .select("root", "doc_id", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    texts = base.join(tasks, "doc_id").select("root", "i", "j", "doc_id", "text")
    linked = texts.groupBy("root", "i", "j").applyInPandas(_verify(k, percent), "a long, b long")
    final = components(linked)
    out = join_small(members.select("doc_id", "n_shingles", "rep"), final.select(F.col("node").alias("rep"), "root"), ["rep"])
    component = F.coalesce("root", "rep", "doc_id")
    return out.select(
        restore_id("doc_id").alias("doc_id"), "n_shingles", restore_id(component).alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
