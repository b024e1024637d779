"""Hard negatives by one-dimensional distance keys.

The largest inner products with an anchor are the smallest distances once each vector x has one more component, sqrt(M^2 - |x|^2), that brings all
to length M, and the anchor a zero. A vector's key is its distance to the nearest of some pivots; the index holds all vectors in order of (pivot, key), in
blocks that know their range of keys. By the triangle inequality a block of pivot p with keys from a to b holds nothing nearer to the
anchor than |anchor - p| lies off that range, and nothing farther than |anchor - p| + b: an annulus, which bounds its scores.

A search first scans the blocks with the best bounds. Their k-th best score is what others have to reach, so the scan then
widens to all key intervals whose bound reaches it; the bound of what remains certifies the answer. Scores are integers and bounds have slack,
so the answer is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import NULL_ID, cut, numbered, restore_id, small_batches, table
from annalist.llm.text import release

#: Rows of a block, and the most blocks: with more rows than their product blocks grow, so that the list of their key ranges has a bounded size.
BLOCK_ROWS, MOST_BLOCKS = 1024, 1 << 16
#: Pivots are means of a sample of at most so many rows, those of smallest hash.
PIVOTS, SAMPLE, SWEEPS = 16, 2000, 5
#: Anchors that visit blocks together, about.
GROUP = 256
#: Blocks that a group scans first.
SEEDS = 8
#: Score bounds of a search without any.
LOWEST, HIGHEST = -(2**62), 2**62
#: Scores up to here are exact in floating point.
EXACT = 2.0**52

INDEX = "block long, pivot int, low double, high double, n_anchors int, n int, rows binary, ids binary, labels binary, anchors binary, vectors binary"
FOUND = "anchor long, slot int, score long, id long, row long"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """List values as rows of a matrix, zeros after the end of shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that brings them to the longest one's length."""
    x = x.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(1)))]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def _pivots(sample: np.ndarray) -> np.ndarray:
    pivots = sample[:PIVOTS].copy()
    for _ in range(SWEEPS):
        nearest = _distances(sample, pivots).argmin(1)
        for j in range(len(pivots)):
            if (nearest == j).any():
                pivots[j] = sample[nearest == j].mean(0)
    return pivots


class _Shape:
    """What all tasks know of the vectors: dimensions, longest squared length, stored integer type, pivots."""

    def __init__(self, dims: int, longest: float, most: int, sample: np.ndarray):
        self.dims, self.longest = dims, longest
        self.kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
        self.pivots = _pivots(_lifted(sample, longest))

    def vectors(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.kind).reshape(-1, self.dims) if self.dims else np.zeros((0, 0), self.kind)

    def keyed(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their pivot and key, vectors packed."""
        for batch in batches:
            x = _matrix(batch.column("vector"), self.dims)
            far = _distances(_lifted(x, self.longest), self.pivots)
            pivot = far.argmin(1)
            packed = [v.tobytes() for v in x.astype(self.kind)]
            yield pa.record_batch(
                [batch.column(c) for c in ("row", "id", "label", "is_anchor")] + [pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(x)), pivot]), pa.array(packed, pa.binary())],
                names=["row", "id", "label", "is_anchor", "pivot", "key", "vector"],
            )
        release()


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks of at most ``size`` rows of one pivot. A block's number has the task's above its own."""
    from pyspark import TaskContext

    number, rest = TaskContext.get().partitionId() << 32, None

    def pack(part: pa.Table) -> pa.RecordBatch:
        nonlocal number
        key = part["key"].to_numpy()
        anchors = part["is_anchor"].to_numpy()
        data = {
            "block": [number], "pivot": [part["pivot"][0].as_py()], "low": [float(key.min())], "high": [float(key.max())], "n_anchors": [int(anchors.sum())], "n": [len(key)],
            "rows": [part["row"].to_numpy().tobytes()], "ids": [part["id"].to_numpy().tobytes()], "labels": [part["label"].to_numpy().tobytes()],
            "anchors": [anchors.astype(np.uint8).tobytes()], "vectors": [b"".join(part["vector"].to_pylist())],
        }
        number += 1
        kinds = {"block": pa.int64(), "pivot": pa.int32(), "low": pa.float64(), "high": pa.float64(), "n_anchors": pa.int32(), "n": pa.int32()}
        return pa.record_batch([pa.array(v, kinds.get(k, pa.binary())) for k, v in data.items()], names=list(data))

    for batch in batches:
        have = pa.Table.from_batches([batch])
        have = have if rest is None else pa.concat_tables([rest, have])
        pivot, at = have["pivot"].to_numpy(), 0
        edges = [*(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), len(pivot)]
        for edge in edges:
            while edge - at > size or (edge - at and edge < len(pivot)):
                take = min(size, edge - at)
                yield pack(have.slice(at, take))
                at += take
        rest = have.slice(at) if at < len(pivot) else None
    if rest is not None and len(rest):
        yield pack(rest)
    release()


class _Search:
    """One search of all anchors: for each slot of an anchor (a range of scores) the k best rows of its label, or of other labels."""

    def __init__(self, shape: _Shape, meta: np.ndarray, same: bool, k: int):
        self.shape, self.meta, self.same, self.k = shape, meta, same, k

    def _bounds(self, anchors: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """The least and largest score that a block may hold, for each anchor, some blocks at a time."""
        a = anchors.astype(np.float64)
        far = _distances(np.c_[a, np.zeros(len(a))], self.shape.pivots)
        total = (a * a).sum(1)[:, None] + self.shape.longest
        slack = total * 1e-9 + 1
        for i in range(0, len(self.meta), 2048):
            part = self.meta[i : i + 2048]
            d = far[:, part["pivot"]]
            near = np.maximum(0, np.maximum(d - part["high"], part["low"] - d))
            yield slice(i, i + len(part)), (total - (d + part["high"]) ** 2) / 2 - slack, (total - near**2) / 2 + slack

    def visits(self, batches: Iterable[pa.RecordBatch], seeds: int | None) -> Iterator[pa.RecordBatch]:
        """For each group of anchors the blocks that it has to see: any that may hold a score in one of its ranges, or only the ``seeds`` best of them."""
        for batch in batches:
            for group in batch.column("anchors").to_pylist():
                group.sort(key=lambda r: r["row"])
                vectors = self.shape.vectors(b"".join(r["vector"] for r in group)) if self.shape.dims else np.zeros((len(group), 0), np.int64)
                owner = np.repeat(np.arange(len(group)), [len(r["low"]) for r in group])
                low, high = (np.array([v for r in group for v in r[c]], np.int64) for c in ("low", "high"))
                wanted, best = np.zeros(len(self.meta), bool), np.zeros(len(self.meta))
                for part, least, most in self._bounds(vectors):
                    wanted[part] = ((most[owner] >= low[:, None]) & (least[owner] <= high[:, None])).any(0)
                    best[part] = most.mean(0)
                chosen = np.flatnonzero(wanted)
                if seeds is not None and len(chosen) > seeds:
                    chosen = chosen[np.argsort(-best[chosen], kind="stable")[:seeds]]
                row, label = (np.array([r[c] for r in group], np.int64) for c in ("row", "label"))
                n = len(chosen)
                for i in range(0, n, 16):
                    blocks = self.meta["block"][chosen[i : i + 16]]
                    fields = {"a_rows": row, "a_labels": label, "owner": owner.astype(np.int32), "low": low, "high": high, "a_vectors": vectors}
                    yield pa.record_batch(
                        [pa.array(blocks)] + [pa.array([v.tobytes()] * len(blocks), pa.binary()) for v in fields.values()], names=["block", *fields]
                    )
        release()

    def scan(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best rows of a block for each slot of each anchor that visits it."""
        for batch in batches:
            for r in batch.to_pylist():
                rows, ids, labels = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "labels"))
                a_rows, a_labels, low, high = (np.frombuffer(r[c], np.int64) for c in ("a_rows", "a_labels", "low", "high"))
                owner = np.frombuffer(r["owner"], np.int32)
                x, q = self.shape.vectors(r["vectors"]), self.shape.vectors(r["a_vectors"])
                first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]).astype(np.int64)
                # some anchors at a time, so that a matrix of scores has a bounded size however many anchors a group has
                most = max(1, (4 << 20) // max(1, len(rows) * 8))
                for i in range(0, len(first) - 1, most):
                    a, b = first[i], first[min(len(first) - 1, i + most)]
                    yield from self._best(rows, ids, labels, x, a_rows, a_labels, q, owner[a:b], np.arange(a, b) - first[np.searchsorted(first, np.arange(a, b), "right") - 1], low[a:b], high[a:b])
        release()

    def _best(self, rows, ids, labels, x, a_rows, a_labels, q, owner, slot, low, high) -> Iterator[pa.RecordBatch]:
        mine = np.unique(owner)
        if self.shape.longest <= EXACT:
            score = x.astype(np.float64) @ q[mine].astype(np.float64).T
        else:
            score = x.astype(np.int64) @ q[mine].astype(np.int64).T
        score = score.astype(np.int64) if self.shape.dims else np.zeros((len(rows), len(mine)), np.int64)
        fits = (labels[:, None] == a_labels[mine]) == self.same
        if self.same:
            fits &= rows[:, None] != a_rows[mine]
        at = np.searchsorted(mine, owner)
        score, fits = score[:, at], fits[:, at] & (score[:, at] >= low) & (score[:, at] <= high)
        many = np.flatnonzero(fits.sum(0) > self.k)
        if len(many):
            held = np.where(fits[:, many], score[:, many], np.iinfo(np.int64).min)
            fits[:, many] &= score[:, many] >= np.partition(held, len(rows) - self.k, axis=0)[len(rows) - self.k]
        row, column = np.nonzero(fits)
        if not len(row):
            return
        value = score[row, column]
        order = np.lexsort((rows[row], ids[row], -value, column))
        row, column, value = row[order], column[order], value[order]
        start = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        nth = np.arange(len(column)) - np.repeat(start, np.diff(np.r_[start, len(column)]))
        keep = nth < self.k
        row, column, value = row[keep], column[keep], value[keep]
        yield pa.record_batch(
            [pa.array(a_rows[owner[column]]), pa.array(slot[column].astype(np.int32)), pa.array(value), pa.array(ids[row]), pa.array(rows[row])], names=["anchor", "slot", "score", "id", "row"]
        )

    def __call__(self, index: DataFrame, anchors: DataFrame) -> DataFrame:
        """anchors (group, row, label, vector, low array<long>, high array<long>) -> anchor, slot, nth, score, id, row, of the k best rows of each slot, by score (highest first), id and row."""
        body = index.select("block", "rows", "ids", "labels", "vectors")
        best = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id", "row")

        def scanned(asking: DataFrame, seeds: int | None) -> DataFrame:
            groups = asking.groupBy("group").agg(F.collect_list(F.struct("row", "label", "vector", "low", "high")).alias("anchors")).drop("group")
            payload = ", ".join(f"{c} binary" for c in ("a_rows", "a_labels", "owner", "low", "high", "a_vectors"))
            visits = groups.mapInArrow(lambda b: self.visits(b, seeds), f"block long, {payload}")
            met = visits.hint("merge").join(body, "block").mapInArrow(self.scan, FOUND)
            return met.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= self.k)

        if len(self.meta) > SEEDS:
            reached = scanned(anchors, SEEDS).where(F.col("nth") == self.k).groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
            raised = F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("reached", i), v)))
            anchors = cut(anchors.join(reached, "row", "left").withColumn("low", raised).drop("reached"), "anchors")
        return scanned(anchors, None)


def _floor_of(x: Column, by: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first ``positives`` other rows of its label, the first ``negatives``
    rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's.

    Components become floor(scale * x), a score is the inner product of those integers, higher first, ties by smaller id (null lowest, back as null), then by place in the table's files.
    Rows with a null label, a null vector or a null or non-finite component take no part. Rows are told apart by their place, so ids and vectors may repeat; shorter vectors
    end in zeros. Where ``is_anchor`` is null a row is no anchor. Pairs without a negative, and anchors without a positive, have no rows; an empty table gives an empty result.
    Scores (times 100) have to fit a long.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    placed, row = numbered(vectors)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    base = placed.where(label.isNotNull() & vector.isNotNull() & ~bad).select(
        F.col(row).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")).alias("vector"),
    )
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    known = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims"), F.max(square).alias("longest"), F.max(F.array_max(F.transform("vector", lambda v: F.abs(v)))).alias("most")).first()
    final = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not known.n:
        return spark.createDataFrame([], final)
    sample = base.orderBy(F.xxhash64("row")).limit(SAMPLE).select("vector").toArrow()
    shape = _Shape(known.dims, known.longest, known.most or 0, _matrix(sample["vector"], known.dims))

    size = max(BLOCK_ROWS, -(-known.n // MOST_BLOCKS))
    keyed = base.mapInArrow(shape.keyed, "row long, id long, label long, is_anchor boolean, pivot int, key double, vector binary")
    # equal vectors share pivot and key; the row's hash cuts them, too, into ranges
    ordered = keyed.repartitionByRange("pivot", "key", F.xxhash64("row")).sortWithinPartitions("pivot", "key", "row")
    index = cut(ordered.mapInArrow(lambda b: _blocks(b, size), INDEX), "index")
    meta = index.select("block", "pivot", "low", "high", "n_anchors").orderBy("block").toArrow()
    ranges_ = np.zeros(len(meta), [("block", np.int64), ("pivot", np.int32), ("low", np.float64), ("high", np.float64)])
    for c in ranges_.dtype.names:
        ranges_[c] = meta[c].to_numpy()
    # neighbouring blocks' anchors visit together
    group_of = np.cumsum(meta["n_anchors"].to_numpy()) // GROUP

    def anchors_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chosen = np.flatnonzero(np.frombuffer(r["anchors"], np.uint8))
                group = int(group_of[np.searchsorted(ranges_["block"], r["block"])])
                x = shape.vectors(r["vectors"])
                packed = [x[i].tobytes() if shape.dims else b"" for i in chosen]
                long = [np.frombuffer(r[c], np.int64)[chosen] for c in ("rows", "ids", "labels")]
                yield pa.record_batch([pa.array(np.full(len(chosen), group, np.int64)), *map(pa.array, long), pa.array(packed, pa.binary())], names=["group", "row", "id", "label", "vector"])

    chosen = index.where("n_anchors > 0").select("block", "rows", "ids", "labels", "anchors", "vectors").mapInArrow(anchors_of, "group long, row long, id long, label long, vector binary")
    anchors = cut(chosen, "anchors")
    first = _Search(shape, ranges_, True, positives)(index, anchors.withColumns({"low": F.array(F.lit(LOWEST)), "high": F.array(F.lit(HIGHEST))}))
    pairs = cut(first.select(F.col("anchor"), F.col("nth"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    window = pairs.select("anchor", F.struct("nth", (-_floor_of(-low * F.col("positive_score"), 100)).alias("low"), _floor_of(high * F.col("positive_score"), 100).alias("high")).alias("w"))
    window = window.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list("w")).alias("w"))
    asking = anchors.join(window, "row").select("group", "row", "label", "vector", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    second = _Search(shape, ranges_, False, negatives)(index, asking).select("anchor", (F.col("slot") + 1).alias("nth"), F.col("nth").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(second, ["anchor", "nth"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select(
        restore_id("anchor_id").alias("anchor_id"), restore_id("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), restore_id("negative_id").alias("negative_id"), "positive_score", "negative_score"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), is_anchor=F.col("vec_id") % 50 == 0, label_col=shifted)


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e AS a, e WHERE a.vec_id % 50 = 0 AND e.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3
"""
