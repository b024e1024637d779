import json
import random

import pytest

from annalist.operators import memory, sidecar
from annalist.operators.sidecar import Locator

L = Locator("pi", "sess", "prod")


def event(id_, kind="source.covered", bytes_=10, prefix="a" * 64, **more):
    return {
        "protocolVersion": 1, "eventId": id_, "kind": kind, "producer": {"id": "prod", "version": "1"}, "source": {"kind": "pi", "sessionId": "sess"},
        "sourceCheckpoint": {"streams": [{"streamId": "main", "committedBytes": bytes_, "prefixSha256": prefix, "selectedLeafEntryId": None}]}, "recordedAt": "2024-01-01T00:00:00Z", **more,
    }


def obs(id_="a" * 12, content="c", entry="e1"):
    return {"id": id_, "content": content, "timestamp": "2024-01-01T00:00:00.000Z", "relevance": "high", "sourceEntries": [{"streamId": "main", "entryId": entry}], "tokenCount": 3}


def ref(id_="b" * 12, supports=("a" * 12,), content="r"):
    return {"id": id_, "content": content, "supportingObservationIds": list(supports), "tokenCount": 1}


def statuses(*events):
    return [(r["status"], r["diagnostics"]) for r in sidecar.fold([e if isinstance(e, str) else json.dumps(e) for e in events], L)]


OK = ("accepted", [])


def test_valid_events():
    got = statuses(event("1", "observations.recorded", observations=[obs()]), event("2", "reflections.recorded", reflections=[ref()]), event("3", "observations.dropped", observationIds=["a" * 12]), event("4"))
    assert got == [OK] * 4


def test_replay_conflict_and_latch():
    assert statuses(event("1"), event("1"), event("1", bytes_=11), event("2", bytes_=12)) == [OK, ("replay", ["idempotent-replay"]), ("conflict", ["immutable-event-conflict"]), ("blocked", ["stream-conflicted"])]


def test_key_order_is_no_conflict():
    e = event("1")
    assert statuses(e, dict(reversed(e.items())))[1][0] == "replay"


def test_regression_skips_but_takes_the_id():
    got = statuses(event("1", bytes_=10), event("2", bytes_=9), event("2", bytes_=20), event("3", bytes_=30))
    assert got == [OK, ("skipped", ["checkpoint-regression"]), ("conflict", ["immutable-event-conflict"]), ("blocked", ["stream-conflicted"])]
    assert statuses(event("1"), event("2", prefix="b" * 64))[1] == ("skipped", ["checkpoint-regression"])


@pytest.mark.parametrize(
    ("bad", "reason"),
    [
        ("{", "malformed-json"), ("", "malformed-json"), ("[]", "invalid-envelope"), (event("1") | {"protocolVersion": 2}, "unsupported-version"), (event("1", "new.kind"), "unsupported-kind"),
        (event("1") | {"eventId": ""}, "invalid-envelope"), (event("1") | {"recordedAt": "2024"}, "invalid-envelope"), (event("1", observations=[obs()]), "invalid-envelope"),
        (event("1", "observations.recorded", observations=[obs(), obs()]), "invalid-envelope"), (event("1", "observations.recorded", observations=[obs() | {"sourceEntries": [{"streamId": "x", "entryId": "e"}]}]), "invalid-envelope"),
        (event("1", "reflections.recorded", reflections=[ref(content="a\nb")]), "invalid-envelope"), (event("1") | {"producer": {"id": "else", "version": "1"}}, "producer-mismatch"),
        (event("1") | {"source": {"kind": "pi", "sessionId": "other"}}, "source-mismatch"), (event("1") | {"note": "\ud800"}, "invalid-envelope"),
    ],
)
def test_first_failure(bad, reason):
    assert statuses(bad) == [("skipped", [reason])]


REC = "source_kind string, source_session_id string, producer_id string, ordinal long, raw_json string"


def rows(producer, *events):
    return [("pi", "sess", producer, i, json.dumps(e if producer == "prod" else e | {"producer": {"id": producer, "version": "1"}})) for i, e in enumerate(events)]


def classified(spark, *parts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([r for p in parts for r in p], REC)
    return sidecar.classify(df).withColumn("record_id", F.concat_ws("/", "producer_id", "ordinal"))


def test_batch_equals_fold(spark):
    events = [event("1"), event("1"), event("2", bytes_=5), event("2", bytes_=50)]
    got = classified(spark, rows("prod", *events)).orderBy("ordinal").collect()
    assert [(r.semantic_status, r.diagnostics) for r in got] == statuses(*events)


def test_first_definition_wins_and_drops_in_any_order(spark):
    a, b = "a" * 12, "b" * 12
    df = classified(
        spark,
        rows("prod", event("1", "observations.recorded", observations=[obs(a, "first")]), event("2", "observations.recorded", observations=[obs(a, "second"), obs(b, "kept")])),
        rows("q", event("1", "observations.dropped", observationIds=[a]), event("2", "observations.recorded", observations=[obs(a, "other")])),
    )
    m = memory.fold(df)
    got = {(r.producer, r.memory_id): (r.content, r.dropped) for r in m.observations.collect()}
    assert got == {("prod", a): ("first", False), ("prod", b): ("kept", False), ("q", a): ("other", True)}
    notes = m.diagnostics.collect()
    assert [(r.producer, r.memory_id, r.reason) for r in notes] == [("prod", a, "conflicting-memory-definition")]


def test_diagnostics_are_capped_and_replays_give_none(spark):
    df = classified(spark, rows("prod", event("1"), event("1"), *[event(str(i), "new.kind") for i in range(150)]))
    notes = memory.fold(df).diagnostics.collect()
    assert len(notes) == 100 and {r.reason for r in notes} == {"unsupported-kind"}


def test_embedded_memories(spark):
    def entry(i, kind, data):
        return ("pi", "sess", i, f"e{i}", json.dumps({"type": "custom", "id": f"e{i}", "parentId": None, "customType": kind, "data": data}))

    o = {"id": "a" * 12, "content": "c", "timestamp": "t", "relevance": "low", "sourceEntryIds": ["e0"], "tokenCount": 1.5}
    data = [
        entry(0, "om.observations.recorded", {"coversUpToId": "x", "observations": [o]}), entry(1, "om.reflections.recorded", {"coversUpToId": "x", "reflections": [{"id": "b" * 12, "content": "r", "supportingObservationIds": ["a" * 12], "tokenCount": 2}]}),
        entry(2, "om.observations.dropped", {"coversUpToId": "x", "observationIds": ["a" * 12]}), entry(3, "om.observations.recorded", {"version": 2, "coversUpToId": "x", "observations": []}),
        entry(4, "om.observations.dropped", {"coversUpToId": "x", "observationIds": []}), entry(5, "else", {}),
    ]
    df = spark.createDataFrame(data, "source_kind string, source_session_id string, ordinal long, entry_id string, raw_json string")
    empty = classified(spark, rows("prod", event("1"))).limit(0)
    m = memory.fold(empty, [memory.embedded(df, "user", "om")])
    r = m.observations.collect()
    assert len(r) == 1 and r[0].dropped and r[0].token_count == 1.5 and r[0].source_entries[0].stream_id == "main" and r[0].recording_event_id.startswith("pi-")
    assert m.reflections.count() == 1
    assert [(d.record_id, d.reason) for d in m.diagnostics.orderBy("ordinal").collect()] == [("e3", "unsupported-version"), ("e4", "invalid-record")]


def test_unresolved_references(spark):
    df = classified(spark, rows("prod", event("1", "observations.recorded", observations=[obs(entry="gone")]), event("2", "reflections.recorded", reflections=[ref(supports=["c" * 12])])))
    m = memory.fold(df)
    entries = spark.createDataFrame([("pi", "sess", None, "e1")], "source_kind string, source_session_id string, stream_id string, entry_id string")
    got = {(r.memory_id, r.entry_id, r.observation_id) for r in memory.unresolved(m.observations, m.reflections, entries).collect()}
    assert got == {("a" * 12, "gone", None), ("b" * 12, None, "c" * 12)}


@pytest.fixture
def keyed(spark):
    from annalist.streaming.sidecar import PROVIDER

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield
    spark.conf.set(name, before)


def streamed(spark, tmp_path, parts, *, restart_after=None, **options):
    """Rows that come out when each part is a file and a micro-batch; the query is started anew after ``restart_after`` parts."""
    from annalist.streaming.sidecar import classify_stream

    progress = []
    for stage in (parts[:restart_after], parts[restart_after:]) if restart_after else (parts,):
        done = len(list(tmp_path.glob("in/*")))
        for i, part in enumerate(stage):
            spark.createDataFrame(part, REC).coalesce(1).write.json(str(tmp_path / f"in/{done + i:04d}"))
        stream = spark.readStream.schema(REC).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        q = classify_stream(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        progress += [p for p in q.recentProgress if p.numInputRows]
    return spark.read.parquet(str(tmp_path / "out")), progress


def test_stream_equals_batch(spark, tmp_path, keyed):
    events = [event("1"), event("2", bytes_=5), event("1"), event("2", bytes_=50), event("3", bytes_=60)]
    data = rows("prod", *events)
    out, _ = streamed(spark, tmp_path, [data[:2], data[1:4], data[4:]], restart_after=2)  # the second file delivers a record again
    assert [(r.semantic_status, r.diagnostics) for r in out.orderBy("ordinal").collect()] == statuses(*events)


def test_random_micro_batches_and_a_restart_change_nothing(spark, tmp_path, keyed):
    rng = random.Random(11)
    data = []
    for producer in ("prod", "q", "r"):
        at, events = 10, []
        for i in range(60):
            at += rng.choice([0, 1, 1, -3 if i % 9 == 8 else 1])
            known = rng.randrange(i) if i and rng.random() < 0.2 else i
            events.append(event(f"{known}", bytes_=at) if known == i or (producer == "r" and i > 40) else events[known])
        data.append(rows(producer, *events))
    parts = [[] for _ in range(5)]
    for log in data:
        cuts = sorted(rng.sample(range(len(log)), 4))
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(log)], strict=True)):
            parts[i] += log[max(0, a - 2) : b]  # some are delivered again
    for p in parts:
        rng.shuffle(p)
    want = {(r.producer_id, r.ordinal): (r.semantic_status, r.diagnostics, r.event_hash) for r in classified(spark, *data).collect()}
    assert {v[0] for v in want.values()} == {"accepted", "replay", "skipped", "conflict", "blocked"}
    out, _ = streamed(spark, tmp_path, [p for p in parts if p], restart_after=3)
    got = out.collect()
    assert len(got) == len(want) and {(r.producer_id, r.ordinal): (r.semantic_status, r.diagnostics, r.event_hash) for r in got} == want


def test_state_grows_by_the_batch(spark, tmp_path, keyed):
    """After 300 events, a micro-batch of 3 writes their 3 entries and the log's one value."""
    data = rows("prod", *[event(str(i), bytes_=10 + i) for i in range(303)])
    _, progress = streamed(spark, tmp_path, [data[:300], data[300:]])
    first, second = [p.stateOperators[0] for p in progress]
    assert first.numRowsUpdated >= 300 and second.numRowsUpdated <= 4 and second.numRowsTotal >= 303
    kept = spark.read.format("statestore").option("stateVarName", "hashes").load(str(tmp_path / "cp"))
    assert kept.count() == 303


def test_stream_needs_its_state_provider(spark):
    from annalist.streaming.sidecar import classify_stream

    with pytest.raises(RuntimeError, match="providerClass"):
        classify_stream(spark.readStream.format("rate").load().selectExpr("'a' source_kind", "'b' source_session_id", "'c' producer_id", "value ordinal", "'' raw_json"))
