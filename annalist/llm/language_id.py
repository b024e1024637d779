"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its 1- to 4-byte strings inside words (lower-cased UTF-8, word ends marked by a space), hashed to
``BUCKETS`` embeddings; their mean goes through one linear layer. Training is stochastic gradient descent in numpy with a step size
per parameter, on a bounded sample of labelled rows; a part of the sample that training does not see calibrates a temperature and the
score below which a prediction is rejected. As the model is linear in the mean, prediction needs only a table of class
scores by bucket, and adds up the entries of every subword of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import NULL_ID, cut, discard, fresh, restore_id, small_batches, table
from annalist.llm.text import chunks, raw, release

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
#: Labelled rows that training and calibration see, at most, and bytes of their subword counts (whatever a first row has); they are those of smallest hash of id and text.
SAMPLE, SAMPLE_BYTES = 4000, 200 << 20
EPOCHS, STEP, BATCH = 8, 0.3, 64
#: Of the calibration texts that are predicted right, at most this share may be rejected.
LOSS = 0.002
UNKNOWN = "und"
LETTER = r"\p{L}"
_MARK = np.arange(256, dtype=np.uint8)
_MARK[:128] = 32
_MARK[97:123] = np.arange(97, 123)


def subwords(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the string at each byte (-1: none), and where each document's bytes begin."""
    data, offsets = raw(pc.utf8_lower(column))
    docs = len(offsets) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(docs), np.diff(offsets)) + 1
    body = np.full(len(data) + docs + 1, 32, np.uint8)
    body[at] = _MARK[data]
    starts = offsets + np.arange(docs + 1)
    gap = body == 32
    out = []
    for n in ORDERS:
        size = max(0, len(body) - n + 1)
        code = np.zeros(size, np.uint32)
        ok = np.ones(size, bool)
        for j in range(n):
            code = (code << np.uint32(8)) | body[j : j + size]
            if 0 < j < n - 1 or n == 1:
                ok &= ~gap[j : j + size]  # spaces stand at the ends only
        if n > 1:
            ok &= ~(gap[:size] & gap[n - 1 :])
        bucket = ((code * np.uint32(0x9E3779B1 + 2 * 0x1000193 * n)) >> np.uint32(17)).astype(np.int32)
        bucket[~ok] = -1
        out.append(bucket)
    return out, starts


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts of each text."""
    found, starts = subwords(column)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        here = np.concatenate([f[a:b] for f in found])
        out.append(np.unique(here[here >= 0], return_counts=True))
    return out


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        found, starts = subwords(column)
        total, sums = np.zeros(len(starts) - 1), np.zeros((len(starts) - 1, len(self.langs)))
        tables = [np.r_[self.scores[:, c], np.float32(0)] for c in range(len(self.langs))]  # bucket -1 adds nothing
        for bucket in found:
            if not len(bucket):
                continue
            at = np.minimum(starts[:-1], len(bucket) - 1)
            here = np.r_[bucket, np.int32(-1)]
            total += np.add.reduceat((here >= 0).astype(np.int64), at)
            for c, scores in enumerate(tables):
                sums[:, c] += np.add.reduceat(scores[here], at, dtype=np.float64)
        return sums / np.maximum(total, 1)[:, None] + self.bias

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(column) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], held: np.ndarray, seed: int = 7) -> Model:
    """rows: buckets and counts; held: which rows calibrate."""
    langs = sorted(set(labels))
    y = np.searchsorted(langs, labels)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    e = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    w, b = rng.normal(0, 0.1, (DIMENSIONS, len(langs))), np.zeros(len(langs))
    ge, gw, gb = np.full(e.shape, 1e-8), np.full(w.shape, 1e-8), np.full(b.shape, 1e-8)
    use = np.array([i for i in np.flatnonzero(~held) if len(rows[i][0])], np.int64)

    def packed(some):
        index = np.concatenate([rows[i][0] for i in some]).astype(np.int64)
        part = np.concatenate([rows[i][1] / rows[i][1].sum() for i in some])
        return index, part, np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some]), np.r_[0, np.cumsum([len(rows[i][0]) for i in some])[:-1]]

    for _ in range(EPOCHS):
        rng.shuffle(use)
        for i in range(0, len(use), BATCH):
            some = use[i : i + BATCH]
            index, part, owner, start = packed(some)
            mean = np.add.reduceat(e[index] * part[:, None], start)
            d = softmax(mean @ w + b)
            d[np.arange(len(some)), y[some]] -= 1
            d /= len(some)
            hit, where = np.unique(index, return_inverse=True)
            back = (d @ w.T)[owner] * part[:, None]
            grad = np.stack([np.bincount(where, back[:, k], len(hit)) for k in range(DIMENSIONS)], axis=1)
            dw, db = mean.T @ d, d.sum(axis=0)
            ge[hit] += grad**2
            gw += dw**2
            gb += db**2
            e[hit] -= STEP * grad / np.sqrt(ge[hit])
            w -= STEP * dw / np.sqrt(gw)
            b -= STEP * db / np.sqrt(gb)
    model = Model(langs, (e @ w).astype(np.float32), b)
    tests = [i for i in np.flatnonzero(held) if len(rows[i][0])]
    if tests:
        logits = []
        for i in range(0, len(tests), BATCH):
            index, part, _, start = packed(tests[i : i + BATCH])
            logits.append(np.add.reduceat(model.scores[index] * part[:, None], start) + b)
        logits = np.concatenate(logits)
        truth = y[tests]
        grid = np.exp(np.linspace(np.log(0.1), np.log(20), 80))
        loss = [-np.mean(np.log(softmax(logits / t)[np.arange(len(tests)), truth] + 1e-12)) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / model.temperature)
        right = p.argmax(axis=1) == truth
        if right.any():
            model.reject_below = float(min(0.5, np.quantile(p.max(axis=1)[right], LOSS)))
    return model


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _sampled(batches):
    for batch in batches:
        for part, _, _ in chunks([batch]):
            text = part.column("text")
            whole = features(text)
            # a few words from inside of each text, so that short texts are learned and calibrated as well
            short = []
            for t, h in zip(text.to_pylist(), part.column("h").to_pylist(), strict=True):
                split = t.split()
                at = h % max(1, len(split) - 8)
                short.append(" ".join(split[at : at + 2 + h % 7]))
            short = features(pa.array(short, pa.string()))
            for rows in (whole, short):
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("lang"), part.column("h"),
                        pa.array([i.astype("<u2").tobytes() for i, _ in rows], pa.binary()),
                        pa.array([c.astype("<u4").tobytes() for _, c in rows], pa.binary()),
                    ],
                    names=["doc_id", "lang", "h", "buckets", "counts"],
                )


def train(docs: DataFrame, where: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from at most ``sample`` rows with text and label (all rows if there are no more) that satisfy ``where``.

    Which rows: those whose ids and texts have the smallest hash, equal rows as one, and of those as many as have SAMPLE_BYTES of counts together. All subwords of a row count.
    Only the counts reach the driver, 6 bytes a distinct subword. Without a labelled row the model knows no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
    )
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (where if where is not None else F.lit(True)))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    place = F.struct("h", "lang")
    last = rows.select("h", "lang").distinct().orderBy("h", "lang").limit(sample).agg(F.max(place)).first()[0]
    if last is None:
        return fit([], [], np.zeros(0, bool))
    upto = lambda at: (F.col("h") < at[0]) | (F.col("h") == at[0]) & (F.col("lang") <= at[1])
    chosen = rows.where(upto(last)).groupBy("doc_id", "h", "lang").agg(F.first("text").alias("text"))
    counted = cut(chosen.mapInArrow(_sampled, "doc_id long, lang string, h long, buckets binary, counts binary"), "subwords")
    sizes = counted.groupBy("h", "lang").agg(F.sum(F.octet_length("buckets") + F.octet_length("counts")).alias("size")).orderBy("h", "lang").toArrow()
    fits = int(np.searchsorted(np.cumsum(sizes["size"].to_numpy()), SAMPLE_BYTES, "right"))
    at = max(0, min(len(sizes), fits) - 1)
    found = counted.where(upto((sizes["h"][at].as_py(), sizes["lang"][at].as_py()))).toArrow().combine_chunks()
    discard(counted)
    ids, h, labels = found["doc_id"].to_numpy(), found["h"].to_numpy(), found["lang"].to_pylist()
    pairs = list(zip(_views(found["buckets"], "<u2"), _views(found["counts"], "<u4"), strict=True))
    order = sorted(range(len(h)), key=lambda i: (h[i], ids[i], labels[i], -len(pairs[i][0]), pairs[i][0].tobytes()))
    model = fit([pairs[i] for i in order], [labels[i] for i in order], (h[order] >> 8) % 5 == 0)
    del found, pairs, ids, h
    release()  # the driver lives on for all later stages
    return model


def _views(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    """The numbers of each binary value, without a copy."""
    data, offsets = raw(column)
    return [data[a:b].view(kind) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _judge(m: Model, text: pa.Array, letters: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and acceptance of each text."""
    known = np.asarray(letters.fill_null(False))
    langs, score = [UNKNOWN] * len(known), np.zeros(len(known))
    if m.langs:
        best, p = m.predict(text)
        score = np.where(known, p, 0.0)
        langs = [m.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    return langs, score, known & (score >= m.reject_below) & bool(m.langs)


def _identify(model):
    def run(batches):
        for part, _, _ in chunks(batches):
            langs, score, accepted = _judge(model.value, part.column("text"), part.column("letters"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "accepted"])
        release()

    return run


def _accepted(model, body: str):
    def run(batches):
        for part, _, _ in chunks(batches, column=body):
            good = _judge(model.value, part.column(body).fill_null(""), part.column(part.num_columns - 1))[2]
            kept = part.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(kept.columns[:-2], names=kept.schema.names[:-2])
        release()

    return run


def accepted_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is identified with a score that the model accepts. Each row is judged by its own text, ids play no part, and nothing is shuffled.

    Null and empty texts and those without a letter go, as do all rows if the model knows no language; repeated rows stay or go together.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body, letters = fresh(docs, "body", "letters")
    text = F.col(text_col).cast("string")
    rows = docs.select("*", text.alias(body), F.coalesce(text.rlike(LETTER), F.lit(False)).alias(letters))
    return rows.mapInArrow(_accepted(shared, body), docs.schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability, 0 to 1), accepted, for every row and its whole text.

    ``und`` with score 0, and not accepted: null and empty text, text without a letter, or a model without languages. Scores
    under the model's threshold keep their prediction and are not accepted. Repeated rows get equal rows; extra columns are pruned; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_identify(shared), "doc_id long, lang_pred string, score double, accepted boolean").withColumn("doc_id", restore_id("doc_id"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    return identify(docs, train(docs, where=~held_out)).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "accepted")
