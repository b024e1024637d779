"""I-Match fingerprints, periodic runs and hard negatives against plain versions."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.llm import hard_negatives, imatch, periodic_runs
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, corpus


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


# I-Match


def test_imatch_equals_brute_force(spark, docs, rows):
    out = imatch.imatch_edits(docs.withColumns({"_band": F.lit(1), "fp": F.lit("x"), "row": F.lit(2)})).collect()
    want = brute.imatch([(r[0], r[1]) for r in rows])
    assert len(out) == len(want)
    for r in out:
        w = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == w[:4]
        assert (r.near_edited, r.near_next) == pytest.approx(w[4:])


def test_imatch_tells_edited_from_other_texts(spark):
    rng = random.Random(3)
    common = ["the", "of", "and"] * 30
    texts = [" ".join(rng.sample(common, 60) + [f"t{rng.randrange(100_000)}" for _ in range(rng.choice([30, 300, 3000]))]) for _ in range(60)]
    out = imatch.imatch_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.near_edited for r in out) / len(out) > 0.1 > max(r.near_next for r in out)


def test_imatch_edges(spark):
    text = "alpha beta gamma delta"
    rows = [(None, text), (None, text), (None, None), (7, text), (7, text), (7, ""), (9, "z"), (9, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit(1), "_bucket": F.lit("x"), "next_text": F.lit(0)})
    out = imatch.imatch_edits(df).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    by_text = {}
    for d, t in rows:
        by_text.setdefault(t or "", []).append(d)
    prints = {r.fingerprint for r in out if r.n_chars == len(text)}
    assert len(prints) == 1 and len({r.fingerprint for r in out}) == len(by_text)
    assert all(r.near_edited == 1.0 for r in out if r.n_chars < 2)
    alone = imatch.imatch_edits(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256((text[:11] + text[:11]).encode()).hexdigest()
    assert imatch.imatch_edits(df.limit(0)).count() == 0
    assert {r.fingerprint for r in imatch.fingerprints(df).collect()} == {r.fingerprint for r in out}


def test_next_rows_when_one_id_has_a_third_of_all(spark):
    from annalist.llm.common import numbered

    df, row = numbered(spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(50)).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text")))
    out = imatch.with_next(df, "doc_id", row, ["doc_id", "text"]).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == 3000 and sorted(r.next_text for r in out) == sorted(r.text for r in out)
    after = {r.text: r.next_doc_id for r in out}
    smaller = sorted(set(ids))
    for r in out:
        assert after[r.text] == r.doc_id or after[r.text] == (smaller[smaller.index(r.doc_id) - 1])


# periodic runs


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9), st.integers(0, 40), st.integers(0, 60))
def test_runs_equal_brute_force(words, period, start, length):
    for i in range(start + period, min(len(words), start + length)):
        words[i] = words[i - period]
    assert periodic_runs.find_runs(np.array(words, np.int64)) == brute.periodic_runs(words)


def test_highly_repetitive_texts_are_quick():
    assert periodic_runs.find_runs(np.ones(200_000, np.int64)) == [(0, 200_000, 1)]
    assert len(periodic_runs.find_runs(np.array(([1] * 300 + [2]) * 60))) == 61


def _collapsed(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_collapse_runs(spark, docs, rows):
    more = [(1000, "go " * 50, *[None] * 3, 1, "b", "k"), (1001, "x a b a b a b a b a b y y y y y y z", *[None] * 3, 1, "b", "k"), (1002, "ü é " * 3 + "\n" + "ü é\t" * 2, *[None] * 3, 1, "b", "k")]
    df = docs.unionByName(spark.createDataFrame(more, SCHEMA)).withColumn("runs", F.lit("clash"))
    want = {}
    for r in [*rows, *more]:
        words = brute.SPACED.findall(r[1] or "")
        runs = brute.periodic_runs(words) if len(words) < 3000 else None
        want[r[0]] = (len(words), runs, _collapsed(words, runs) if runs is not None else None)
    out = periodic_runs.collapse_runs(df).collect()
    assert len(out) == len(want)
    for r in out:
        n, runs, text = want[r.doc_id]
        assert r.n_words == n
        if runs is not None:
            assert ([tuple(x) for x in r.runs], r.text) == (runs, text)
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in out}[1001] == [(1, 10, 2), (11, 6, 1)]


def test_collapse_edges(spark):
    df = spark.createDataFrame([(None, "a a a a a a"), (None, None), (3, ""), (3, "b " * 6), (3, "b " * 6)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.text, len(r.runs)) for r in periodic_runs.collapse_runs(df).collect()), key=repr)
    assert out == sorted([(None, "a", 1), (None, "", 0), (3, "", 0), (3, "b", 1), (3, "b", 1)], key=repr)
    assert periodic_runs.collapse_runs(df.limit(0)).count() == 0


def test_planted_repetitions_follow_the_contract():
    doc = next(d for d in range(100) if crc32(str(d).encode()) % 10 == 0)
    n, g = 100, crc32(str(doc).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    assert periodic_runs.planted(doc, n).tolist() == [i if i < a else a + (i - a) % p for i in range(n)]
    assert periodic_runs.planted(next(d for d in range(100) if crc32(str(d).encode()) % 10), n) is None


# hard negatives

VECTORS = "vec_id long, label int, embedding array<float>, row int, key string"


def vectors(n, seed, dims=6, hot=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (4, dims))
    out = []
    for i in range(n):
        v = centres[i % 4] + rng.normal(0, 0.1, dims)
        if rng.random() < hot:
            v = centres[0]
        out.append((i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in v], 1, "k"))
    return out


@pytest.mark.parametrize("blocks", [16, 1024])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks):
    """A third of all vectors are equal, so ties abound; blocks of 16 make the search seed, widen and certify."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", blocks)
    rows = vectors(700, 1)
    rows[5] = (5, None, *rows[5][2:])
    rows[50] = (50, 1, None, 1, "k")
    rows[60] = (60, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "k")
    rows[70] = (70, 1, [float("nan")] * 6, 1, "k")
    rows[80] = (80, 1, [float("inf")] + [0.0] * 5, 1, "k")
    rows[90] = (90, 1, [0.5, 0.5], 1, "k")
    rows[100] = (100, 2, [], 1, "k")
    rows[110] = (None, 2, *rows[110][2:])
    df = spark.createDataFrame(rows, VECTORS).coalesce(1)
    out = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    want = brute.hard_negatives([r[:3] for r in rows], lambda i: i % 10 == 0)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr) and len(want) > 500


def test_hard_negatives_repeated_ids_and_exact_large_scores(spark):
    rows = [(0, 1, [3e4, 1e4, 7.0]), (0, 1, [3e4, 1e4, 7.0]), (1, 1, [2e4, 1e4, 5.0]), (2, 2, [2e4, 5e3, 1.0]), (2, 2, [2e4, 5e3, 1.0]), (3, 2, [1.5e4, 5e3, 2.0])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], VECTORS).coalesce(1)
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") == 0, scale=4096).collect()), key=repr)
    assert got == sorted(brute.hard_negatives(rows, lambda i: i == 0, scale=4096), key=repr) and got


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame(vectors(20, 2), VECTORS)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.hard_negatives(df.withColumn("label", F.lit(None).cast("int")), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.hard_negatives(df.where("vec_id > 0"), F.col("vec_id") == 0).count() == 0
    one = hard_negatives.hard_negatives(df.where("vec_id = 0"), F.col("vec_id") == 0)
    assert one.count() == 0 and one.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
