"""The registered queries on the driver's tables: against their SQL, or against brute force."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest

from annalist.llm import queries
from tests.llm import brute

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def run(spark, name):
    return queries.QUERIES[name](spark, str(DATA))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = run(spark, name)
    result = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == want


def test_op1(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op1_suffix_dedup").collect()}
    assert got == brute.suffix_dedup(docs)


def test_op4(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    want = brute.tokens(docs, Tokenizer.from_file(public.path("word_bpe_49k.json")))
    assert sorted(tuple(r) for r in run(spark, "op4_tokens").collect()) == sorted(want)


def test_op5(spark, docs, monkeypatch):
    from annalist.llm import language_model

    seen, real = [], language_model.em
    monkeypatch.setattr(language_model, "em", lambda histogram: seen.append(real(histogram)) or seen[-1])
    want = brute.base_scores(docs)
    out = run(spark, "op5_language_model").collect()
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out} == {d: w[:4] for d, w in want.items()}
    assert {r.doc_id: r.base_score for r in out} == pytest.approx({d: w[4] for d, w in want.items()}, rel=1e-9)
    assert {r.doc_id: r.score for r in out} == pytest.approx(brute.interpolated(docs, seen[0]), rel=1e-9)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op6(spark, docs):
    """Every entity of every document has one surrogate wherever it stands, different ones have different ones, and no real value is left."""
    from annalist.llm import surrogates as S

    out = {r.doc_id: r for r in run(spark, "op6_surrogates").collect()}
    assert sorted(out) == sorted(d for d, _ in docs)
    made, real = {}, set()
    for d, text in docs:
        found = S.detect(text or "")
        assert out[d].n_entities == len(found) and list(out[d].kinds) == [e.kind for e in found]
        new, at = out[d].text, 0
        for e, following in zip(found, [*found[1:], None][: len(found)], strict=True):
            # what stands between entities is kept, so the surrogate ends where that begins
            between = text[e.end : following.start if following else len(text)]
            lead = text[at : e.start]
            assert new.startswith(lead)
            rest = new[len(lead) :]
            end = rest.index(between) if between and following else len(rest) - len(between)
            value = rest[:end]
            if e.kind in ("person", "family"):
                words, news = e.value.split(" "), value.split(" ")
                pairs = [(("family", w), n) for w, n in zip(words, news, strict=True) if w in S.family_words(e.value)]
            else:
                pairs = [((e.kind, S.identity(e.kind, e.value)), S.identity(e.kind, value))]
            for key, n in pairs:
                assert made.setdefault(key, n) == n
                if key[0] != "birth":
                    real.add(S.reading(key[1]))
            new, at = rest[end:], e.end
        assert new == (text or "")[at:] if text is not None else new is None
    assert len(made) > 15 and len({S.reading(n) for k, n in made.items()}) == len(made)
    assert not real & {S.reading(n) for k, n in made.items() if k[0] != "birth"}


def test_op8(spark, duck):
    """Predictions against the model's definition, subword by subword, and held-out accuracy; nothing but the text counts."""
    from pyspark.sql import functions as F

    from annalist.llm import language_id

    rows = duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(table, where=~language_id.in_fold(F.col("doc_id"), 3, 1))
    out = {r.doc_id: r for r in run(spark, "op8_language_id").collect()}
    for d, text, _ in rows:
        lang, score = brute.language(model, text)
        assert out[d].lang_pred == lang and out[d].score == pytest.approx(score, abs=1e-5), d
        assert out[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
    held = [r for r in rows if out[r[0]].held_out]
    assert sum(out[d].lang_pred == lang for d, _, lang in held) >= 0.95 * len(held)


def test_op9(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in run(spark, "op9_minhash").collect()}
    assert got == brute.near_duplicates(docs)


def test_op10(spark, duck, docs):
    want = brute.contamination(docs, duck.execute("SELECT item_id, text FROM benchmark").fetchall())
    for r in run(spark, "op10_decontaminate").collect():
        n_words, n_hit, items = want[r.doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words)


def test_pipeline(spark, duck):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows, steps = duck.execute("SELECT doc_id, text, source FROM documents").fetchall(), []
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(DATA)).collect(), docs.schema)
        assert docs.columns == columns
        steps.append((name, sorted(r.doc_id for r in docs.collect())))
    texts, sources = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    known = set(steps[0][1])
    assert known >= {d for d, t in texts.items() if t and len(t) > 100}
    near = brute.near_duplicates([(d, texts[d]) for d in known], percent=80)  # the stage's own threshold
    assert steps[1][1] == sorted(d for d, r in near.items() if r[2])
    hits = brute.contamination([(d, texts[d]) for d in steps[1][1]], duck.execute("SELECT item_id, text FROM benchmark").fetchall())
    assert steps[2][1] == sorted(d for d, (n, h, _) in hits.items() if not (h > 0 and 20 * h >= n))
    sizes, target = brute.mix([(d, texts[d], sources[d]) for d in steps[2][1]])
    taken = {}
    for d in steps[3][1]:
        taken[sources[d]] = taken.get(sources[d], 0) + len(brute.SPACED.findall(texts[d]))
    longest = max(len(brute.SPACED.findall(texts[d])) for d in steps[2][1])
    assert all(abs(target[s] - taken.get(s, 0)) <= longest / 2 + 1e-6 for s in target)
    want = brute.tokens([(d, texts[d]) for d in steps[3][1]], Tokenizer.from_file(public.path("word_bpe_49k.json")))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(DATA)).collect()) == sorted(want)


def test_pipeline_dedup_is_by_row(spark):
    """Rows without an id, or of one id, are duplicates only if their texts link."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    near = lambda t: t + " more"
    rows = [
        (None, texts[0]), (None, texts[1]),  # unlike, without id
        (1, near(texts[0])), (2, near(texts[1])),  # each like one of those, not like each other
        (3, texts[2]), (3, texts[3]), (3, texts[2]),  # one id: unlike, and equal
        (4, near(texts[3])),
        (5, texts[4]), (6, near(texts[4])),
        (7, ""), (7, " "), (7, ""), (8, ""), (None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.minhash_dedup(spark, df, "")
    assert out.columns == ["doc_id", "text"]
    want = [(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (5, texts[4]), (7, ""), (7, " "), (8, ""), (None, None)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_pipeline_dedup_takes_similarity_of_eight_tenths(spark):
    """A pair between 0.80 and 0.85 is a duplicate to the stage, one under 0.80 is not."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:168], *(f"x{i}" for i in range(5))])), (3, " ".join(f"v{i}" for i in range(200))), (4, " ".join(f"v{i}" for i in range(155)))]
    a, b, c, d = (brute.shingles(t) for _, t in rows)
    assert 0.80 <= len(a & b) / len(a | b) < 0.85 and len(c & d) / len(c | d) < 0.80
    out = corpus_pipeline.minhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _row long, _key string, copies int, body string, letters string, k string, salt int, _salt int, threshold string, row string, at int, found string, hits int"


def odd_documents(spark, n=0):
    """Null ids, ids shared by unlike texts, repeated rows, null and empty texts, one of a million bytes, in columns whose names stages use inside."""
    texts = [" ".join(f"{c}{c}{i} the and" for i in range(40)) for c in "abcdefgh"]
    rows = [(None, texts[0]), (None, texts[1]), (None, None), (1, texts[2]), (1, texts[3]), (1, texts[2]), (2, ""), (2, ""), (3, "one two"), (4, texts[4] * 700), (5, "12 34")]
    rows = [(d, t, "en" if i % 2 else "de", None if i % 3 == 0 else "s", 1, i, "key", 7, "b", "l", "k", 1, 2, "t", "r", 3, "f", 4) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(rows[: n or None] if n >= 0 else [], CLASH).repartition(3)


@pytest.mark.parametrize("n", [0, -1])
def test_pipeline_stages_keep_odd_rows_and_columns(spark, tmp_path, n):
    """Each stage by itself: columns come back as they were, and rows are judged each by itself."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd_documents(spark, n)
    item = " ".join(f"dd{i} the and" for i in range(20))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [tuple(r) for r in docs.collect()]
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got[name] = sorted((tuple(r) for r in out.collect()), key=repr)
        assert set(got[name]) <= set(rows)
    tokens = corpus_pipeline.tokenize(spark, docs, "").collect()
    assert len(tokens) == len(rows) and sum(r.doc_id is None for r in tokens) == sum(r[0] is None for r in rows)
    if n == -1:
        assert not any(got.values())
        return
    long = [r for r in rows if r[1] and len(r[1]) > 100]
    assert set(got["language_id"]) >= set(long) and not any(not r[1] or r[1] == "12 34" for r in got["language_id"])
    shown = lambda some: sorted(((r[0], (r[1] or "")[:20]) for r in some), key=repr)
    once = {(r[0], r[1] or ""): r for r in rows}  # of the repeated rows one stays, of null and empty texts one for each id
    assert shown(got["minhash_dedup"]) == shown(once.values())
    assert got["decontaminate"] == sorted((r for r in rows if "dd0 " not in (r[1] or "")), key=repr)
    taken = {s: sum(len((r[1] or "").split()) for r in got["mix_sources"] if r[3] == s) for s in (None, "s")}
    assert taken["s"] > 0 and all(got["mix_sources"].count(r) <= 3 for r in rows)


def test_op11(spark, docs):
    out = {r.doc_id: r for r in run(spark, "op11_imatch").collect()}
    want = brute.imatch(docs)
    assert {d: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for d, r in out.items()} == {d: w[:4] for d, w in want.items()}
    assert {d: r.near_edited for d, r in out.items()} == pytest.approx({d: w[4] for d, w in want.items()})
    assert {d: r.near_next for d, r in out.items()} == pytest.approx({d: w[5] for d, w in want.items()})
