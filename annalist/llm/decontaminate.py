"""Benchmark decontamination by winnowing.

A window of ``window`` words holds ``window - k + 1`` k-grams; the smallest k-gram hash in it is the window's fingerprint, so a span that
training and test text share has equal fingerprints in both. An item of fewer words is one window of its own length, and its fingerprint is its
hash. Fingerprints of both sides are joined; each hit is extended to the whole windows around it, which are joined by a second hash of all
their words; the words of windows that test text holds are hit.

Both sides are tables of any size, and neither ever reaches the driver. Before the join a document's fingerprints pass a bit filter of the test
fingerprints, whose size is fixed; what it lets through by chance the join drops. Joins are by distinct fingerprint or window first, so that
a passage that many documents or items share is one row in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import cut, id_text, join_small, restore_id, table
from annalist.llm.text import NOT_ALNUM, chunks, grams, inside, mix64, release, sliding_min, words

WINDOW, K = 13, 6
#: The filter has 2 ** FILTER_BITS bits (2 MB), two of them for each test fingerprint.
FILTER_BITS = 24
_SECOND = np.uint64(0x51ED270B1F2C3D47)


def grams_at(hashes: np.ndarray, spots: np.ndarray, k: int) -> np.ndarray:
    """``grams`` at some positions only."""
    if not len(spots):
        return np.zeros(0, np.uint64)
    picked = (spots[:, None] + np.arange(k)[None, :]).ravel()
    return grams(hashes[picked], k)[::k]


def fingerprints(hashes: np.ndarray, doc: np.ndarray, n: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of n words inside one document, and their fingerprints."""
    at = np.flatnonzero(inside(doc, n))
    every = grams(hashes, n) if n < window else sliding_min(grams(hashes, k), window - k + 1)
    return at, every[at]


def extended(hashes: np.ndarray, at: np.ndarray, n: int, window: int) -> np.ndarray:
    """A hash of all words of the runs at these starts; of another kind than the runs' fingerprints."""
    return grams_at(hashes if n == window else mix64(hashes ^ _SECOND), at, n)


def _windows(window: int, k: int):
    def run(batches):
        for rows, data, offsets in chunks(batches):
            found = words(data, offsets, NOT_ALNUM)
            ids, size = rows.column("doc_id").to_numpy(), np.diff(found.first)
            for n in sorted({min(int(x), window) for x in size if x}):
                at, prints = fingerprints(found.hash, found.doc, n, window, k)
                owner = found.doc[at]
                mine = size[owner] >= window if n == window else size[owner] == n
                at, prints, owner = at[mine], prints[mine], owner[mine]
                columns = [ids[owner], np.full(len(at), n, np.int32), prints.view(np.int64), extended(found.hash, at, n, window).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "n", "print", "key"])
        release()

    return run


def bit_filter(windows: DataFrame, filter_bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set of 2 ** filter_bits bits, whatever the table's size, in which each fingerprint sets two."""
    mask = (1 << filter_bits) - 1
    bits = windows.select("print").distinct().select(F.explode(F.array(F.col("print").bitwiseAND(mask), F.shiftrightunsigned("print", filter_bits).bitwiseAND(mask))).alias("bit"))
    found = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (filter_bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints may be among those of the filter."""
    ok = np.ones(len(prints), bool)
    filter_bits = 6 + (len(bits) - 1).bit_length()
    for shift in (0, filter_bits):
        bit = (prints >> np.uint64(shift)) & np.uint64((1 << filter_bits) - 1)
        ok &= (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return ok


SCAN = "doc_id long, n_words long, found array<struct<n:int,at:int,print:long,key:long>>"


def _scan(shared, lengths: list[int], window: int, k: int):
    def run(batches):
        bits = shared.value
        for rows, data, offsets in chunks(batches):
            found = words(data, offsets, NOT_ALNUM)
            doc, parts = found.doc, []
            for n in lengths:
                at, prints = fingerprints(found.hash, doc, n, window, k)
                good = passes(bits, prints)
                at = at[good]
                parts.append((np.full(len(at), n, np.int32), at, prints[good], extended(found.hash, at, n, window)))
            n, at, prints, keys = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.int32, np.int64, np.uint64, np.uint64))
            order = np.argsort(at, kind="stable")
            n, at, prints, keys = n[order], at[order], prints[order], keys[order]
            struct = pa.StructArray.from_arrays(
                [pa.array(n), pa.array((at - found.first[doc[at]]).astype(np.int32)), pa.array(prints.view(np.int64)), pa.array(keys.view(np.int64))], names=["n", "at", "print", "key"]
            )
            where = np.searchsorted(at, found.first).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(found.first), pa.int64()), pa.ListArray.from_arrays(pa.array(where), struct)], names=["doc_id", "n_words", "found"]
            )
        release()

    return run


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, hits (runs of hit words: s inclusive, e exclusive), n_hit, items (ids with an occurring window), one row for each row of docs.

    Null or empty text has no words and no hits; a document without words is not contaminated. Null, empty or
    wordless items match nothing; rows that repeat an item's id are one item of several texts, and a null id is one item whose id is null. Rows of docs that
    repeat an id or have none are each judged by their own text. Extra columns are pruned; either table may be empty.
    Windows are equal if two 64-bit hashes of their words are.
    """
    spark = docs.sparkSession
    made = id_text(bench, item_col, text_col).mapInArrow(_windows(window, k), "item long, n int, print long, key long")
    windows = cut(made.distinct(), "test-windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most ``window`` numbers
    bits = spark.sparkContext.broadcast(bit_filter(windows, filter_bits))
    scanned = id_text(docs, id_col, text_col).mapInArrow(_scan(bits, lengths, window, k), SCAN)
    scanned = cut(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    asked = cut(found.select("n", "print", "key").distinct(), "asked")
    # the fingerprint join, then the windows of the fingerprints that both sides have
    prints = cut(asked.select("print").distinct().join(windows.select("print").distinct(), "print", "left_semi"), "prints")
    near = join_small(asked, prints, ["print"], "inner")
    both = cut(near.join(windows.select("n", "print", "key").distinct(), ["n", "print", "key"], "left_semi"), "shared-windows")
    hits = cut(join_small(found, both, ["n", "print", "key"], "inner"), "hits")
    inner = Window.partitionBy("row").orderBy("s")
    ends = hits.groupBy("row", F.col("at").alias("s")).agg(F.max(F.col("at") + F.col("n")).alias("e"))
    ends = ends.withColumn("before", F.max("e").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("run", F.count_if(F.coalesce(F.col("s") > F.col("before"), F.lit(True))).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    runs = ends.groupBy("row", "run").agg(F.min("s").cast("long").alias("s"), F.max("e").cast("long").alias("e"))
    spans = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("hits"), F.sum(F.col("e") - F.col("s")).alias("n_hit"))
    owners = cut(windows.join(both, ["n", "print", "key"], "left_semi").select("n", "print", "key", "item"), "owners")
    items = join_small(hits.select("row", "n", "print", "key").distinct(), owners, ["n", "print", "key"], "inner").select("row", "item").distinct()
    items = items.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = scanned.select("row", "doc_id", "n_words").join(spans, "row", "left").join(items, "row", "left")
    return out.select(
        restore_id("doc_id").alias("doc_id"), "n_words",
        F.coalesce("hits", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("hits"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.transform(F.coalesce("items", F.array().cast("array<bigint>")), restore_id).alias("items"),
    )


def contaminated(found: DataFrame) -> DataFrame:
    """Adds the rule: some word is hit, and at least a twentieth of all."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
