"""Language-model scores by deleted interpolation.

P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1); the weights depend on the bucket of the context's frequency, and are
learned by expectation-maximisation on documents whose own counts were deleted.

All n-grams of the training documents are counted, and every document is scored with exact counts, without exploding tokens into
rows: a task turns a batch of documents into its distinct keys (64-bit hashes of words and word pairs) with their counts, and deals these
in sorted, packed blocks by key range. Each range adds up its keys over all batches and answers every block with the totals, in the
block's order. A batch then scores its documents from its answers, a chunk of about 1 MB of text at a time. A frequent word is one key in each batch, so no key is hot; the driver
gets only sums and the histogram of EM.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import NULL_ID, cut, fresh_path, labels, partitions, restore_id, small_batches, table
from annalist.llm.files import attempt_name, resolve
from annalist.llm.language_id import in_fold
from annalist.llm.text import chunks, distinct, mix64, raw, release, words

U64 = np.uint64
#: Tokens of a batch, unless one document has more.
BATCH_TOKENS = 1_000_000
#: Answer bytes that a key range gathers before it hands on rows.
ANSWER_BYTES = 1 << 20
END, START = U64(0x5EED0E4D), U64(0x5EED057A)
_Q = U64(0xC2B2AE3D27D4EB4F)
#: EM: steps of log2(p / p0) per octave, and rounds.
GRAIN, ROUNDS = 4, 60
KINDS = (1, 2)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the tokens (words, then END), of their contexts' counts (START is counted by END), and where documents begin."""
    found = words(data, offsets)
    docs = len(offsets) - 1
    first = found.first + np.arange(docs + 1)
    unit = np.full(len(found.hash) + docs, END, U64)
    unit[np.arange(len(found.hash)) + np.repeat(np.arange(docs), np.diff(found.first))] = found.hash
    context = np.r_[END, unit[:-1]] if len(unit) else unit
    context[first[:-1]] = END
    return unit, context, first


def pair_keys(unit: np.ndarray, context: np.ndarray, first: np.ndarray) -> np.ndarray:
    context = context.copy()
    context[first[:-1]] = START
    return mix64(context * _Q + unit)


def pack(sorted_keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Differences of sorted keys and counts, by byte planes."""
    parts = [np.diff(sorted_keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()]
    parts += [c.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in counts]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(sorted_keys)) + b"".join(parts))


def unpack(body: bytes, counts: int) -> tuple[np.ndarray, ...]:
    body = zstandard.ZstdDecompressor().decompress(body)
    (n,) = struct.unpack_from("<q", body)
    raw = np.frombuffer(body, np.uint8, offset=8)
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=U64)
    return keys, *(np.ascontiguousarray(raw[8 * n + 4 * n * i : 8 * n + 4 * n * (i + 1)].reshape(4, n).T).view("<i4").ravel() for i in range(counts))


def pack_counts(*counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in counts))


def unpack_counts(body: bytes, counts: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    n = len(raw) // (8 * counts)
    return [np.ascontiguousarray(raw[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view("<i8").ravel() for i in range(counts)]


def pack_rows(ids, flags, data, offsets) -> bytes:
    """Documents of one chunk, compressed."""
    head = struct.pack("<qq", len(ids), len(data)) + ids.astype("<i8").tobytes() + flags.astype(np.uint8).tobytes() + offsets.astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + data.tobytes())


def unpack_rows(body: bytes):
    body = zstandard.ZstdDecompressor().decompress(body)
    n, size = struct.unpack_from("<qq", body)
    ids = np.frombuffer(body, "<i8", n, 16)
    flags = np.frombuffer(body, np.uint8, n, 16 + 8 * n)
    offsets = np.frombuffer(body, "<i8", n + 1, 16 + 9 * n)
    return ids, flags, np.frombuffer(body, np.uint8, size, 16 + 9 * n + 8 * (n + 1)), offsets


def save_batch(folder: str, stem: str, chunks_: list[bytes]) -> str:
    """Write a batch's chunks and return its name, which holds a hash of them: a task that runs again over rows in another order makes
    another batch, and never writes over one whose counts are already known."""
    body = struct.pack(f"<q{len(chunks_)}q", len(chunks_), *map(len, chunks_)) + b"".join(chunks_)
    name = f"{stem}-{hashlib.blake2b(body, digest_size=12).hexdigest()}"
    fs, path = resolve(folder)
    fs.create_dir(path, recursive=True)
    own = attempt_name(name, ".tmp")
    with fs.open_output_stream(f"{path}/{own}", compression=None) as out:
        out.write(body)
    fs.move(f"{path}/{own}", f"{path}/{name}")
    return name


def load_batch(folder: str, name: str) -> Iterator[tuple]:
    """The documents of each chunk in turn."""
    fs, path = resolve(folder)
    with fs.open_input_file(f"{path}/{name}") as source:
        (n,) = struct.unpack("<q", source.read(8))
        for size in struct.unpack(f"<{n}q", source.read(8 * n)):
            yield unpack_rows(source.read(size))


def _sum_up(keys: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their counts."""
    every = np.concatenate(keys)
    order = np.argsort(every)
    every = every[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
    return every[first], *(np.add.reduceat(np.concatenate(c)[order], first) if len(first) else np.zeros(0, np.int64) for c in counts)


def _distinct(keys: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys of a chunk with how often they stand in rows to learn from, and in rows to tune with."""
    return _sum_up([keys], [(flag & 1).astype(np.int64)], [(flag >> 1 & 1).astype(np.int64)])


def _deal(folder: str, label: list[int]):
    deals = len(label)

    def blocks(stem, texts, counts):
        name, rows = save_batch(folder, stem, texts), []
        for kind in KINDS:
            keys, learn, tune = _sum_up(*zip(*counts[kind], strict=True))
            counts[kind].clear()
            edges = np.searchsorted(keys, np.array([(d << 64) // deals for d in range(1, deals)], U64))
            for d, (a, b) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(keys)], strict=True)):
                if a < b:
                    rows.append((label[d], d, name, kind, pack(keys[a:b], learn[a:b], tune[a:b])))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], names=["label", "deal", "batch", "kind", "payload"])

    def run(batches):
        task, made = TaskContext.get().partitionId(), itertools.count()
        # documents that tune go to batches of their own, so that EM reads no others
        open_ = {kind: ([], {k: [] for k in KINDS}, []) for kind in ("tune", "rest")}

        def close(kind):
            texts, counts, size = open_[kind]
            if texts:
                yield blocks(f"{kind}-{task:06d}-{next(made):05d}", texts, counts)
            texts.clear(), size.clear()

        for whole, *_ in chunks(batches):
            for kind in open_:
                part = whole.filter(whole.column("tune") if kind == "tune" else pc.invert(whole.column("tune")))
                if not part.num_rows:
                    continue
                texts, counts, size = open_[kind]
                data, offsets = raw(part.column("text"))
                unit, context, first = tokens(data, offsets)
                flags = np.asarray(part.column("learn").cast(pa.uint8())) | np.asarray(part.column("tune").cast(pa.uint8())) << 1
                texts.append(pack_rows(part.column("doc_id").to_numpy(), flags, data, offsets))
                flag = np.repeat(flags, np.diff(first))
                counts[1].append(_distinct(unit, flag))
                counts[2].append(_distinct(pair_keys(unit, context, first), flag))
                size.append(len(unit))
                if sum(size) >= BATCH_TOKENS:
                    yield from close(kind)
        for kind in open_:
            yield from close(kind)
        release()

    return run


ANSWER = "batch string, deal int, kind int, payload binary, n long, v long, n_kept long, v_kept long"
_ANSWER = pa.schema([("batch", pa.string()), ("deal", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary()), *[(c, pa.int64()) for c in ("n", "v", "n_kept", "v_kept")]])


def _answer(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ANSWER, strict=True)], schema=_ANSWER)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of one key range; a row without batch has the range's share of N and V, of all training documents and of those kept by EM."""
    seen: dict[int, list] = {k: [] for k in KINDS}
    deal = 0
    for rows in (b for b in batches if b.num_rows):
        deal = rows.column("deal")[0].as_py()
        for name, kind, body in zip(rows.column("batch").to_pylist(), rows.column("kind").to_pylist(), rows.column("payload"), strict=True):
            seen[kind].append((name, *unpack(body.as_buffer(), 2)))
    for kind, own in seen.items():
        if not own:
            continue
        names, key_lists, learns, tunes = zip(*own, strict=True)
        seen[kind] = own = None
        keys, learn, tune = _sum_up(key_lists, learns, tunes)
        del learns, tunes
        if kind == 1:
            kept = learn - tune
            yield _answer([(None, deal, 0, None, int(learn.sum()), int((learn > 0).sum()), int(kept.sum()), int((kept > 0).sum()))])
        out, size = [], 0
        for name, mine in zip(names, key_lists, strict=True):
            at = np.searchsorted(keys, mine)
            out.append((name, deal, kind, pack_counts(learn[at], tune[at]), None, None, None, None))
            size += len(out[-1][3])
            if size >= ANSWER_BYTES:
                yield _answer(out)
                out, size = [], 0
        if out:
            yield _answer(out)
    release()


def bucket(context_count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.frexp(context_count.astype(float))[1]


def answered(folder: str, batches: Iterable[pa.RecordBatch]):
    """For each chunk of a batch its documents and, for each token, totals of its word, its context and the pair: (learn, tune) each."""
    got: dict[int, dict[int, bytes]] = {k: {} for k in KINDS}
    name = ""
    for rows in (b for b in batches if b.num_rows):
        name = rows.column("batch")[0].as_py()
        for kind, deal, body in zip(rows.column("kind").to_pylist(), rows.column("deal").to_pylist(), rows.column("payload").to_pylist(), strict=True):
            got[kind][deal] = body
    parts = []
    for ids, flags, data, offsets in load_batch(folder, name):
        unit, context, first = tokens(data, offsets)
        found = [np.unique(x, return_inverse=True) for x in (unit, pair_keys(unit, context, first))]
        parts.append((ids, flags, first, [(keys, where.astype(np.int32)) for keys, where in found]))
    every, totals = [], []
    for i, kind in enumerate(KINDS):
        every.append(distinct(np.concatenate([found[i][0] for *_, found in parts])))
        blocks = [unpack_counts(got[kind].pop(d), 2) for d in sorted(got[kind])]
        totals.append([np.concatenate([b[j] for b in blocks]) for j in (0, 1)])
        if len(totals[i][0]) != len(every[i]):
            raise RuntimeError(f"{name}: answers are incomplete")
    end = np.searchsorted(every[0], END)
    for ids, flags, first, found in parts:
        # a chunk's own keys ascend, so looking them up runs through the batch's keys once
        at, pair_at = (np.searchsorted(keys, mine)[where] for keys, (mine, where) in zip(every, found, strict=True))
        before = np.r_[end, at[:-1]][: len(at)]
        before[first[:-1]] = end  # a document's first token stands behind START, which END counts
        yield ids, flags, first, [t[at] for t in totals[0]], [t[before] for t in totals[0]], [t[pair_at] for t in totals[1]]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _tune(folder: str, n: int, v: int):
    """Histogram of (bucket, log2(p2/p0), log2(p1/p0)) over the tokens of tuning documents, with their own counts deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flags, first, one, context, two in answered(folder, batches):
            use = np.repeat((flags >> 1 & 1).astype(bool), np.diff(first))
            if not use.any():
                continue
            c1, cc, c2 = (x[0][use] - x[1][use] for x in (one, context, two))
            steps = []
            for p in (_ratio(c2, cc), c1 / max(n, 1)):
                steps.append(np.where(p > 0, np.round(np.log2(np.maximum(p * (v + 1), 1e-300)) * GRAIN), -(10**6)).astype(np.int64))
            half = 1 << 20  # all three in one number
            bins, count = np.unique((bucket(cc).astype(np.int64) << 42) | (steps[0] + half << 21) | (steps[1] + half), return_counts=True)
            rows = (bins >> 42, (bins >> 21 & (2 * half - 1)) - half, (bins & (2 * half - 1)) - half)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows, count)], names=["b", "r2", "r1", "count"])
        release()

    return run


def em(histogram: list[tuple[int, int, int, int]], rounds: int = ROUNDS) -> np.ndarray:
    """(bucket, [l0, l1, l2]) from rows of (bucket, r2, r1, count). Buckets without rows take the sums of all."""
    out = np.full((66, 3), np.nan)

    def learn(rows):
        rows = np.array(rows, float)
        ratio = np.stack([np.ones(len(rows)), *(np.where(rows[:, i] > -(10**5), 2.0 ** (rows[:, i] / GRAIN), 0) for i in (2, 1))], axis=1)
        weight = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = ratio * weight
            share /= share.sum(axis=1, keepdims=True)
            weight = (share * rows[:, 3:4]).sum(axis=0) + 1e-3
            weight /= weight.sum()
        return weight

    everything = learn(histogram) if histogram else np.array([0.1, 0.6, 0.3])
    for b in {r[0] for r in histogram}:
        out[b] = learn([r for r in histogram if r[0] == b])
    out = np.where(np.isnan(out), everything, out)
    out[0, 2] = 0  # an unseen context has no estimate
    return out / out.sum(axis=1, keepdims=True)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(folder: str, n: int, v: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, first, one, context, two in answered(folder, batches):
            c1, cc, c2 = one[0], context[0], two[0]
            w = weights[bucket(cc)]
            p = w[:, 0] / (v + 1) + w[:, 1] * c1 / max(n, 1) + w[:, 2] * _ratio(c2, cc)
            if n == 0:
                p = np.ones(len(p))
            add = lambda x, at=first[:-1]: np.add.reduceat(x, at)  # noqa: E731  every document has a token at least
            columns = [ids, np.diff(first), add((c1 > 0).astype(np.int64)), add(np.log10((c1 + 1) / (n + v + 1))), add(np.log10(p))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        release()

    return run


def deleted_interpolation(docs: DataFrame, learn: Column, tune: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row.

    ``learn``: rows to learn from; ``tune``: those of them whose counts are deleted to learn the weights. Null and empty texts have
    one token, the end. Without training rows all scores are 0; without tuning rows the weights are fixed. Null ids come back as null,
    repeated rows count and are scored as often as they stand there. Extra columns are pruned; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder, label = fresh_path(spark, "lm-batches"), labels(spark, 2 * partitions(spark))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
        F.coalesce(learn & tune, F.lit(False)).alias("tune"),
    )
    dealt = rows.mapInArrow(_deal(folder, label), "label int, deal int, batch string, kind int, payload binary")
    answers = cut(dealt.repartition(len(label), "label").groupBy("label").applyInArrow(_count, ANSWER), "lm-counts")
    sums = answers.where("batch is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_kept", "v_kept")]).first()
    of = lambda names: answers.where(F.col("batch").startswith(names)).select("batch", "deal", "kind", "payload").groupBy("batch")
    seen = of("tune-").applyInArrow(_tune(folder, sums.n_kept, sums.v_kept), "b long, r2 long, r1 long, count long")
    histogram = [tuple(r) for r in seen.groupBy("b", "r2", "r1").agg(F.sum("count").alias("count")).collect()]  # bins, however large the corpus
    scored = of("").applyInArrow(_score(folder, sums.n, sums.v, em(sorted(histogram))), SCORES)
    return scored.withColumn("train_tokens", F.lit(sums.n).cast("long")).withColumn("doc_id", restore_id("doc_id"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 7, 2)
    out = deleted_interpolation(docs, learn=~held_out, tune=in_fold(F.col("doc_id"), 7, 3))
    return out.withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
