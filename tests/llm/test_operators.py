import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annalist.llm import (
    common,
    decontaminate,
    exact_dedup,
    language_id,
    language_model,
    minhash,
    mixing,
    suffix_dedup,
    text,
    token_store,
    warc,
)
from annalist.llm.common import labels
from annalist.llm.components import components
from tests.llm import brute

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, payload string, deal int, batch string, kept string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empty and very long texts, in rows with columns whose names operators use inside."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(50)]
    texts += texts[:6] + [texts[3]] * 8
    for t in texts[:8]:
        words = (t + " " + prose(rng, 80)).split(" ")
        near = list(words)
        near[rng.randrange(len(near))] = "changed"
        texts += [" ".join(words), " ".join(near)]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, rng.randint(0, 20)) for _ in range(12)]
    texts += [None, "", "   ", "x", "A a B", "aaaa" * 100, "ü" * 130, "ü" * 130, "it's <|endoftext|> ½ É. 'S a..b x́", prose(rng, 9000), "y" * 60000]
    rng.shuffle(texts)
    return [(i * 3, t, None if i % 9 == 0 else ["en", "de"][i % 2], None if i % 7 == 0 else f"s{i % 3}", "p", 1, "b", "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and repeated rows."""
    t = "one two three four five six seven"
    return spark.createDataFrame([(None, t, "en", "s", *"p1bk")[:5] + (1, "b", "k"), (None, None, None, None, None, None, None, None), (5, t, "en", "s", "p", 1, "b", "k"), (5, t, "en", "s", "p", 1, "b", "k")], SCHEMA)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_word_hashes_follow_words():
    t = pa.array(["Ab  ab\x0bAB", "", None, "é é x", "x"])
    data, offsets = text.raw(t)
    w = text.words(data, offsets)
    assert list(np.diff(w.first)) == [3, 0, 0, 2, 1] and w.hash[0] == w.hash[1] == w.hash[2] and w.hash[4] == w.hash[5] != w.hash[3]
    assert text.raw(t.slice(3))[0].tobytes() == "é é xx".encode()


@pytest.mark.parametrize("w", [1, 2, 3, 7, 8, 20])
def test_sliding(w):
    x = np.random.default_rng(w).integers(0, 100, 50).astype(np.uint64)
    assert list(text.sliding_min(x, w)) == [min(x[i : i + w]) for i in range(50 - w + 1)]
    assert list(text.sliding_max(x, w)) == [max(x[i : i + w]) for i in range(50 - w + 1)]


@pytest.mark.parametrize("n", [1, 3, 50])
def test_labels_are_dealt_evenly(spark, n):
    label = labels(spark, n)
    df = spark.createDataFrame([(x,) for x in label], "v int").repartition(n, "v")
    assert [r.v for r in df.withColumn("p", F.spark_partition_id()).orderBy("p").collect()] == label


def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    """The same numbers whatever the splits and columns read; frames that are no files are written first."""
    spark.range(1000).withColumn("_row", F.lit("x")).repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rows, row = common.numbered(df)
    want = {r.id: r[row] for r in rows.collect()}
    assert row == "_row_" and len(set(want.values())) == 1000 and min(want.values()) >= 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    assert {r.id: r[row] for r in rows.select(row, "id").collect()} == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    other, name = common.numbered(spark.range(10))
    assert {r.id: r[name] for r in other.collect()} == {r.id: r[name] for r in other.collect()} and other.columns == ["id", "_row"]
    empty, _ = common.numbered(df.where("false"))
    assert empty.count() == 0


# 1


def test_suffix_dedup(docs, rows):
    out = suffix_dedup.suffix_dedup(docs, deals=3).collect()
    got = {}
    for r in out:
        import hashlib

        got[r.doc_id] = (r.n_bytes, sum(s.e - s.s for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
    assert got == brute.suffix_dedup(pairs(rows))


@pytest.mark.parametrize(("length", "k", "piece"), [(30, 10, 50), (100, 12, 333), (16, 8, 8 << 20)])
def test_suffix_dedup_in_pieces(length, k, piece, rows, monkeypatch):
    """Long documents in pieces, small buffers, and other lengths, without Spark."""
    monkeypatch.setattr(suffix_dedup, "PIECE", max(piece, length))
    monkeypatch.setattr(suffix_dedup, "BUFFER", 5000)
    some = [r for r in rows if len(r[1] or "") < 3000]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in some], "text": [r[1] or "" for r in some]})
    deals = {}
    for b in suffix_dedup._deal(length, k, [0, 1, 2, 3])([batch]):
        for d, p in zip(b.column("label").to_pylist(), b.column("payload").to_pylist(), strict=True):
            deals.setdefault(d, []).append(p)
    gone = {r[0]: set() for r in some}
    for payloads in deals.values():
        for d, s, e in zip(*suffix_dedup.find(payloads, length, k), strict=True):
            gone[d].update(range(s, e))
    want = brute.suffix_dedup(pairs(some), length)
    assert {d: len(g) for d, g in gone.items()} == {d: w[1] for d, w in want.items()}


@pytest.mark.parametrize("seed", range(12))
def test_previous_factors(seed):
    """Against the definition, with places in text order and in any other, some of them equal."""
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99 + seed % 3, 150).astype(np.uint8)
    length = int(rng.integers(8, 40))
    starts = np.sort(rng.choice(len(data) - length + 1, 60, replace=False))
    body = data.tobytes()
    for place in (starts, rng.permutation(60) // 2):
        got = suffix_dedup.previous_factors(data, starts, place, length)
        for i, a in enumerate(starts):
            shared = [next((m for m in range(length) if body[a + m] != body[b + m]), length) for b, p in zip(starts, place, strict=True) if p < place[i]]
            assert got[i] == max(shared, default=0)


def test_nearest_smaller_places_at_scale():
    """Sorted, reversed and constant places, for which a walk back by one would be quadratic."""
    n = 200_000
    ones = np.r_[0, np.full(n - 1, 100)]
    for place in (np.arange(n), np.arange(n)[::-1], np.zeros(n, np.int64)):
        got = suffix_dedup.before_smaller(place, ones)
        assert (got[1:] == (100 if place[1] > place[0] else 0)).all() and got[0] == 0


def test_copies_are_compared_by_bytes():
    """Two segments whose hashes collide are not copies."""
    data = np.frombuffer(b"aaaabbbbaaaa", np.uint8)
    at, n, same = np.array([0, 4, 8]), np.array([4, 4, 4]), np.zeros(3, np.uint64)
    stay, copy = suffix_dedup.copies(data, same, same, at, n, np.array([1, 2, 3]), np.zeros(3, np.int64))
    assert sorted(stay) == [0, 1] and list(copy) == [2]


def test_suffix_dedup_with_a_line_in_every_document(spark):
    """One line stands in all documents, between texts that differ: no deal gets what stands around it, and the result is the definition's."""
    rng = random.Random(11)
    line = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its files."
    rows = [(i, "".join(rng.choice("abcdefghijklmnop ") for _ in range(150)) + line + "".join(rng.choice("qrstuvwxyz ") for _ in range(150))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    base, deals = common.id_text(docs), 64
    known = suffix_dedup.common_grams(base, suffix_dedup.K, deals)
    assert 60 <= known.sum() <= 120  # the line's own k-grams

    def largest(some):
        data, offsets = text.raw(pa.array([t for _, t in rows]))
        first, last, anchor = suffix_dedup.segments(data, offsets, 100, suffix_dedup.K, some)
        n = last - first + 100
        dealt = {(bytes(data[a : a + suffix_dedup.K]), bytes(data[f : f + m])) for a, f, m in zip(anchor, first, n, strict=True)}  # copies collapse
        return max(Counter(a for a, _ in dealt).values())

    assert largest(None) > 200 > 40 > largest(known)
    out = {r.doc_id: (r.n_bytes, sum(s.e - s.s for s in r.spans)) for r in suffix_dedup.suffix_dedup(docs, deals=deals).collect()}
    assert out == {d: w[:2] for d, w in brute.suffix_dedup(rows).items()}


@pytest.mark.parametrize("n", [1, 4])
def test_suffix_dedup_of_repeated_rows(spark, n):
    """Long rows at one place take nothing from each other, in one task's buffer and in several; a later document loses its copy."""
    rng = random.Random(1)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(5, a), (5, a), (None, b), (None, b), (6, a + " " + c), (6, a + " " + c), (7, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(n, F.monotonically_increasing_id())
    want = {5: (a, []), None: (b, []), 6: (" " + c, [(0, len(a))]), 7: ("", [(0, len(c))])}
    out = suffix_dedup.suffix_dedup(df).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in rows)
    for r in out:
        assert (r.kept.decode(), [(x.s, x.e) for x in r.spans]) == want[r.doc_id]


# 2


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, rows, keep):
    groups = {}
    for d, t in pairs(rows):
        groups.setdefault(t or "", []).append(d)
    pick = min if keep == "smallest" else max
    want = {d: (pick(g), len(g), d == pick(g)) for g in groups.values() for d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, keep=keep).collect()} == want


def test_exact_dedup_normalises(spark):
    df = spark.createDataFrame([(1, "A "), (2, "a"), (3, "b")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(df, normalise=lambda c: F.lower(F.trim(c))).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


# 3


def test_mix(docs, rows):
    sizes, target = brute.mix([(r[0], r[1], r[3]) for r in rows])
    out = mixing.mix(docs).collect()
    longest, taken = {}, {}
    for r in out:
        assert r.size == len(brute.SPACED.findall(dict(pairs(rows))[r.doc_id] or "")) and 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    for s in target:
        assert abs(target[s] - taken[s]) <= longest[s] / 2 + 1e-6
    assert {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()} == {(r.doc_id, r.taken) for r in out}


@pytest.mark.parametrize("seed", range(6))
def test_targets_are_the_fixed_point(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10_000]) for i in range(rng.randint(1, 9))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    _, want = brute.mix([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())])
    got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1), 3).collect()}
    assert got == pytest.approx(want)


# 4


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("word_bpe_49k.json")), public.path("word_bpe_49k.json")


@pytest.mark.parametrize(("by_part", "planes", "block"), [(True, "byte", 1 << 16), (False, "bit", 64)])
def test_token_files(docs, rows, tokenizer, by_part, planes, block):
    manifest = token_store.write_tokens(docs, tokenizer[1], end=2, by_part=by_part, planes=planes, block=block)
    out = token_store.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert sorted(map(tuple, out)) == sorted(brute.tokens(pairs(rows), tokenizer[0]))


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    for n in (0, 1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        assert (token_store.join_planes(token_store.split_planes(ids, planes), n) == ids).all()


def test_encoder_keeps_contractions_and_marks(tokenizer):
    odd = ["it's I'VE don't 'S x's. É... a.. b., ½ ñ. \x85 a b \x1c x", "$$$a'''s \"'s\" -'t", "", " ", "İstanbul ΑΣ ǅ ﬁ 1,234.5", "<|endoftext|> <|ENDOFTEXT|>", "rock'n'roll a.b-c d'é"]
    e = token_store.Encoder(tokenizer[1], 2, True)
    for _ in range(2):  # the second time all parts are known
        data, offsets = text.raw(pa.array(odd))
        ids, count = e(data, offsets)
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [[*tokenizer[0].encode(t, add_special_tokens=False).ids, 2] for t in odd]


# 5


def test_language_model(docs, rows):
    held = language_id.in_fold(F.col("doc_id"), 7, 2)
    out = language_model.deleted_interpolation(docs, ~held, language_id.in_fold(F.col("doc_id"), 7, 3)).collect()
    want = brute.base_scores(pairs(rows))
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in out} == {d: w[1:4] for d, w in want.items()}
    assert {r.doc_id: r.base_score for r in out} == pytest.approx({d: w[4] for d, w in want.items()})
    # the words are drawn from one vocabulary, so on unseen texts the model is no worse than counts of words
    unseen = [r for r in out if want[r.doc_id][0]]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_language_model_scores_by_its_formula(docs, rows, monkeypatch):
    weights = np.tile([0.2, 0.5, 0.3], (66, 1))
    monkeypatch.setattr(language_model, "em", lambda histogram: weights)
    monkeypatch.setattr(language_model, "BATCH_TOKENS", 500)
    held = language_id.in_fold(F.col("doc_id"), 7, 2)
    out = language_model.deleted_interpolation(docs, ~held, language_id.in_fold(F.col("doc_id"), 7, 3)).collect()
    assert {r.doc_id: r.score for r in out} == pytest.approx(brute.interpolated(pairs(rows), weights), rel=1e-6)


@pytest.mark.parametrize("batch", [500, 1_000_000])
def test_em_learns_from_deleted_counts(docs, rows, monkeypatch, batch):
    seen, real = [], language_model.em
    monkeypatch.setattr(language_model, "em", lambda histogram: seen.append(histogram) or real(histogram))
    monkeypatch.setattr(language_model, "BATCH_TOKENS", batch)
    language_model.deleted_interpolation(docs, ~language_id.in_fold(F.col("doc_id"), 7, 2), language_id.in_fold(F.col("doc_id"), 7, 3)).count()
    fold = lambda d: zlib.crc32(str(d).encode()) % 7
    want = brute.em_histogram(pairs(rows), lambda d: fold(d) != 2, lambda d: fold(d) == 3)
    assert {tuple(r[:3]): r[3] for r in seen[0]} == want


def test_batch_names_follow_their_rows(tmp_path):
    a, b = [language_model.pack_rows(np.array([i]), np.array([0]), np.frombuffer(t, np.uint8), np.array([0, len(t)])) for i, t in ((1, b"x y"), (2, b"z"))]
    names = {language_model.save_batch(str(tmp_path), "batch-0", c) for c in ([a, b], [b, a], [a, b])}
    assert len(names) == 2
    for n in names:
        assert sorted(int(ids[0]) for ids, *_ in language_model.load_batch(str(tmp_path), n)) == [1, 2]


def test_em_finds_the_mixture():
    w = language_model.em([(3, 8, -(10**6), 900), (3, -(10**6), 8, 100), (0, -(10**6), 8, 50)])
    assert w[3, 2] > 0.8 and w[0, 2] == 0 and np.allclose(w.sum(axis=1), 1)


def test_packed_keys_round_trip():
    k = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    c = np.arange(len(k))
    got = language_model.unpack(language_model.pack(k, c, c * 2), 2)
    assert (got[0] == k).all() and (got[1] == c).all() and (got[2] == c * 2).all()


# 7


@pytest.fixture(scope="module")
def pages(spark):
    big, small = "<p>" + "é" * 800, "<p>x"
    return spark.createDataFrame([(1, "http://a/ü b", big), (2, None, big), (9, "http://a\r\nWARC-Type: evil", big), (3, "u", small), (4, "u", small), (5, "u", None), (None, "u", ""), (6, "u", "z" * 3_000_000)], "page_id long, url string, html string")


def test_warc_round_trip(spark, pages):
    folder = warc.write_warc(pages.repartition(3))
    out = {r.record_id: r for r in warc.read_warc(spark, folder).collect()}
    assert {k: r.record_type for k, r in out.items()} == {f"urn:page:{i}": "revisit" if i in (1, 2) else "response" for i in (1, 2, 9, 3, 4, 5, "null", 6)}
    assert out["urn:page:1"].refers_to == "urn:page:9" and out["urn:page:1"].payload is None and out["urn:page:1"].payload_length == 1603
    assert out["urn:page:9"].payload.decode() == "<p>" + "é" * 800 and "\n" not in out["urn:page:9"].target_uri
    assert out["urn:page:2"].target_uri is None and len(out["urn:page:6"].payload) == 3_000_000
    import hashlib

    for r in out.values():
        if r.payload is not None:
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_length


def test_warc_pushdown(spark, pages):
    folder = warc.write_warc(pages)
    df = warc.read_warc(spark, folder, payload="")
    assert {r.record_id for r in df.where("record_type = 'revisit'").collect()} == {"urn:page:1", "urn:page:2"}
    assert [r.payload for r in df.where(F.col("record_id").isin("urn:page:6", "urn:page:9")).collect()] == [None, None]
    reader = warc.WarcReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 1), In(("record_id",), ("a", "b"))]))
    assert len(rest) == 1 and len(reader.wanted) == 2


@pytest.mark.parametrize("plain", [True, False])
def test_warc_reads_other_archives(spark, tmp_path, plain):
    """Records without the size field, and not compressed at all."""
    import gzip

    body = [warc.record("response", f"urn:page:{i}", "http://x", "00" * 20, b"p" * n, n, None) for i, n in enumerate((10, 200_000, 0))]
    body.insert(1, b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n")
    name = "x.warc" if plain else "x.warc.gz"
    (tmp_path / name).write_bytes(b"".join(body if plain else map(gzip.compress, body)))
    out = warc.read_warc(spark, str(tmp_path), payload="response,warcinfo").collect()
    assert [len(r.payload) for r in out] == [10, 4, 200_000, 0]


# 8


def test_language_id(spark):
    rng = random.Random(1)
    words = {"aa": ["thing", "other", "wheel"], "bb": ["öder", "über", "größe"], "cc": ["niño", "año", "señor"]}
    data = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(1, 30))), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(300))]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    fold = language_id.in_fold(F.col("doc_id"), 3, 1)
    model = language_id.train(df, where=~fold)
    out = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    unseen = [(i, k) for i, _, k in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(out[i].lang_pred == k for i, k in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 for r in out.values())
    extra = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "é"), (5, "größe über")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(extra, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [got[i].score for i in (1, 2, 3)] == [0.0] * 3 and not got[1].accepted
    assert got[4].lang_pred in words and got[5].lang_pred == "bb" and got[5].accepted


def test_language_id_without_labels(spark, empty):
    model = language_id.train(empty)
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score, r.accepted) for r in language_id.identify(df, model).collect()] == [("und", 0.0, False)]


# 9


@pytest.mark.parametrize("block", [minhash.BLOCK_SHINGLES, 100])
def test_near_duplicates(docs, rows, block):
    out = minhash.near_duplicates(docs, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute.near_duplicates(pairs(rows))


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    errors = []
    for i in range(40):
        cut = 10 * (i % 20)
        a, b = base[: len(base) - cut], base[cut:]
        s = minhash.superminhash(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), 128)
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(base))
        base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_superminhash_small_sets_fill_every_place():
    for n in (1, 2, 30):
        s = minhash.superminhash(np.arange(1, n + 1, dtype=np.uint64), np.array([0, n, n]), 64)
        assert (s[0] < np.iinfo(np.uint64).max).all() and (s[1] == np.iinfo(np.uint64).max).all()


def test_links_span_what_pairs_span():
    rng = np.random.default_rng(3)
    for _ in range(20):
        seed = rng.integers(0, 60, 40)
        sets = [np.unique(np.where(rng.random(40) < rng.random() * 0.2, rng.integers(0, 60, 40), seed)) for _ in range(15)]
        parent = list(range(15))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(15):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 70 * (len(sets[i]) + len(sets[j]) - n):
                    parent[find(i)] = find(j)
        got = list(range(15))
        for a, b in minhash.links(sets, 70):
            got[find(a, got)] = find(b, got)
        assert len({(find(i), find(i, got)) for i in range(15)}) == len({find(i) for i in range(15)}) == len({find(i, got) for i in range(15)})


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (1, 2), (2, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for x in {x for e in edges if e[0] != e[1] for x in e}}
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


# 10


@pytest.mark.parametrize(("broadcast", "bits"), [(20_000, 24), (0, 24), (20_000, 8)])
def test_contamination(spark, docs, rows, monkeypatch, broadcast, bits):
    """With small sides broadcast and not, and with a filter that lets through nearly everything."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rng = random.Random(9)
    long = [t for _, t in pairs(rows) if t and len(t.split()) > 40]
    items = [(i, " ".join(rng.choice(long).upper().split()[3 : 3 + n])) for i, n in enumerate((30, 13, 12, 5, 14, 20, 1, 40))]
    items += [(90, None), (91, ""), (92, "!!"), (93, items[0][1]), (94, "never seen words in here at all"), (95, "x"), (96, "x"), (96, items[1][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    out = decontaminate.contamination(docs, bench, filter_bits=bits).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in out} == brute.contamination(pairs(rows), items)
    for r in out:
        assert all(0 <= h.s < h.e <= r.n_words for h in r.hits) and r.n_hit == sum(h.e - h.s for h in r.hits)
        assert all(a.e < b.s for a, b in zip(r.hits[:-1], r.hits[1:], strict=True))


def test_contamination_is_by_row(spark):
    """Rows of one id, or of none, are judged by their own text; an item without an id is found as such."""
    rng = random.Random(3)
    passage, clean = " ".join(prose(rng, 14).replace("\n", " ").split()), " ".join(f"c{i}" for i in range(14))
    docs = spark.createDataFrame([(1, passage), (1, clean), (1, passage), (None, clean), (None, passage + " " + clean), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (7, passage), (7, passage)], "item_id long, text string")
    n = len(brute.ALNUM.findall(passage))
    out = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()), key=repr)
    assert out == sorted([(1, n, n, [None, 7]), (1, 14, 0, []), (1, n, n, [None, 7]), (0, 14, 0, []), (0, n + 14, n, [None, 7]), (0, 0, 0, [])], key=repr)


def test_filter_has_one_size(spark):
    for n in (0, 1, 5000):
        rng = np.random.default_rng(n)
        prints = rng.integers(-(2**63), 2**63 - 1, n)
        bits = decontaminate.bit_filter(spark.createDataFrame([(int(p),) for p in prints], "print long"))
        assert bits.nbytes == 1 << 21 and decontaminate.passes(bits, prints.astype(np.int64).view(np.uint64)).all()
        assert decontaminate.passes(bits, rng.integers(0, 2**63, 1000).astype(np.uint64)).mean() < 0.01


# All of them on empty tables, null ids and repeated rows


def run_all(docs, bench, pages):
    held = language_id.in_fold(F.col("doc_id"), 7, 2)
    public = pytest.importorskip("public_tokenizers")
    return {
        "suffix": suffix_dedup.suffix_dedup(docs), "exact": exact_dedup.exact_dedup(docs), "mix": mixing.mix(docs),
        "tokens": token_store.read_tokens(token_store.write_tokens(docs, public.path("word_bpe_49k.json"), end=2)),
        "lm": language_model.deleted_interpolation(docs, ~held, held), "lang": language_id.identify(docs, language_id.train(docs)),
        "near": minhash.near_duplicates(docs), "bench": decontaminate.contamination(docs, bench), "warc": warc.read_warc(docs.sparkSession, warc.write_warc(pages)),
    }


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for name, df in run_all(empty, bench, pages).items():
        assert df.count() == 0, name


def test_null_ids_and_repeated_rows(spark, odd):
    bench = spark.createDataFrame([(None, "two three four")], "item_id long, text string")
    pages = spark.createDataFrame([(None, None, None), (1, "u", "x" * 2000), (1, "u", "x" * 2000)], "page_id long, url string, html string")
    out = {k: df.collect() for k, df in run_all(odd, bench, pages).items()}
    for name, found in out.items():
        assert len(found) == (3 if name == "warc" else 4), name
        if name != "warc":
            assert sum(r.doc_id is None for r in found) == 2, name
    assert sum(r.kept for r in out["exact"] if r.group_size == 3) == 1
    assert all(r.n_hit == 3 for r in out["bench"] if r.n_words)
    assert [r.start for r in sorted(out["tokens"], key=lambda r: r.start)][0] == 0


def test_language_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    """3,000 rows without ids, a third of them equal: at most 100 rows are learned from, whole and in part, and no more bytes than are allowed."""
    rng = random.Random(1)
    words = lambda: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(30))
    rows = [(None, "same words again" if i % 3 == 0 else words(), "ab"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, real = [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda pairs, *a: seen.append(pairs) or real(pairs, *a))
    language_id.train(df, sample=100)
    assert 150 < len(seen[0]) <= 200
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 20_000)
    language_id.train(df, sample=100)
    assert 0 < sum(b.nbytes + c.nbytes for b, c in seen[1]) <= 20_000 < sum(b.nbytes + c.nbytes for b, c in seen[0])


def test_language_features_are_all_kept(spark, monkeypatch):
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(6000))
    seen, real = [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda pairs, *a: seen.append(pairs) or real(pairs, *a))
    language_id.train(spark.createDataFrame([(1, long, "a"), (2, "b c", "b")], "doc_id long, text string, lang string"))
    assert max(len(b) for b, _ in seen[0]) == len(language_id.features(pa.array([long]))[0][0]) > 20_000


def test_warc_digests_and_long_http_headers(spark, tmp_path):
    """MD5 digests are no base32, and a length behind 20 KB of headers is read without the payload."""
    head = b"HTTP/1.1 200 OK\r\n" + b"".join(b"X-Pad-%d: %s\r\n" % (i, b"p" * 90) for i in range(200)) + b"Content-Length: 7\r\n\r\n"
    for name, make in (("a.warc", lambda r: r), ("b.warc.gz", lambda r: __import__("gzip").compress(r))):
        out = b""
        for i, digest in enumerate(("md5:d41d8cd98f00b204e9800998ecf8427e", "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ", "sha1:3i42h3s6nnfq2msvx7xzkyayscx5qbyj")):
            block = head + b"payload"
            out += make(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: %s\r\nContent-Length: %d\r\n\r\n" % (i, digest.encode(), len(block)) + block + b"\r\n\r\n")
        (tmp_path / name).write_bytes(out)
    for payload in ("response", ""):
        rows = warc.read_warc(spark, f"file://{tmp_path}", payload=payload).collect()
        assert len(rows) == 6 and {r.payload_length for r in rows} == {7} and {r.payload_digest for r in rows} == {"d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709"}
        assert {bytes(r.payload) if r.payload is not None else None for r in rows} == ({b"payload"} if payload else {None})


def test_training_gives_the_drivers_memory_back(spark, monkeypatch):
    import pyarrow as pa

    from annalist.llm import language_id

    left = []
    monkeypatch.setattr(language_id, "release", lambda: left.append(pa.total_allocated_bytes()))
    before = pa.total_allocated_bytes()
    docs = spark.createDataFrame([(i, " ".join(f"{w}{i * j}" for j in range(50)), lang) for i in range(40) for w, lang in [("der", "de"), ("the", "en")]], "doc_id long, text string, lang string")
    assert language_id.train(docs).langs == ["de", "en"] and left and left[-1] <= before
