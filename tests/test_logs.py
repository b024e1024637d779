import hashlib
import json

import pytest

from annalist.operators.sync import byte_batches, contiguous, plan_sync
from annalist.plans.restore import materialize
from annalist.sources import logs
from annalist.sources.framing import LogError, scan_session, scan_sidecar, scan_transcript


def lines(*values):
    return b"".join(json.dumps(v).encode() + b"\n" for v in values)


HEADER = {"type": "session", "id": "s1", "version": 3, "cwd": "/w"}
ENTRIES = [
    {"type": "message", "id": "a", "parentId": None, "message": {"role": "user", "content": "hi"}},
    {"type": "future-entry", "id": "b", "parentId": "a", "extra": {"x": 1}},
    {"type": "message", "id": "c", "parentId": "a", "message": {"role": "assistant", "content": []}},
    {"type": "session_info", "id": "d", "parentId": "c", "name": "named"},
]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_session_framing():
    data = lines(HEADER) + b"\n" + lines(*ENTRIES)
    records, summary = scan_session(data)
    assert [r["ordinal"] for r in records] == [0, 1, 2, 3]
    assert [r["parent_id"] for r in records] == [None, "a", "a", "c"]
    assert [r["role"] for r in records] == ["user", None, "assistant", None]
    assert summary["log_hash"] == sha(data) and summary["log_bytes"] == len(data) and summary["name"] == "named"
    first = len(lines(HEADER)) + 1
    assert records[0]["byte_offset"] == first
    assert records[0]["prefix_hash"] == sha(data[: first + len(lines(ENTRIES[0]))])


def test_session_tail_without_newline_counts():
    data = lines(HEADER, *ENTRIES)[:-1]
    records, summary = scan_session(data)
    assert len(records) == 4 and not summary["has_final_newline"] and summary["log_hash"] == sha(data)


@pytest.mark.parametrize(
    ("data", "reason"),
    [
        (lines(ENTRIES[0]), "missing-session-header"),
        (b"", "missing-session-header"),
        (lines(HEADER, ENTRIES[0], ENTRIES[0]), "duplicate-entry-id"),
        (lines(HEADER, {"type": "m", "id": "x"}), "invalid-parent"),
        (lines(HEADER, {"type": "m", "id": "x", "parentId": "y"}), "unknown-parent"),
        (lines(HEADER) + b"{\n", "malformed-json"),
    ],
)
def test_session_errors(data, reason):
    with pytest.raises(LogError) as e:
        scan_session(data)
    assert e.value.reason == reason


def test_transcript_framing():
    rows = [{"type": "user", "uuid": "u1", "parentUuid": None, "sessionId": "s"}, {"type": "assistant", "uuid": "u2", "parentUuid": "gone", "sessionId": "s"}, {"type": "note", "sessionId": "s"}]
    records, summary = scan_transcript(lines(*rows) + b'{"type": "us', "s")
    assert [r["parent_id"] for r in records] == [None, None, None]
    assert records[2]["record_uuid"] is None and len(records[2]["entry_id"]) == 64
    assert summary["incomplete_tail_bytes"] == 12 and summary["log_bytes"] == len(lines(*rows))
    assert len(scan_transcript(lines(*rows) + b'{"type": "x"}', "s")[0]) == 4


def test_sidecar_framing():
    records, summary = scan_sidecar(b'{"a":1}\n\n{"b":2}')
    assert [r["raw_json"] for r in records] == ['{"a":1}', ""] and summary["incomplete_tail_bytes"] == 7
    records, summary = scan_sidecar(b"{}\n\xff\n{}\n")
    assert len(records) == 1 and (summary["physical_conflict"], summary["conflict_line"]) == ("invalid-utf8", 2)
    records, summary = scan_sidecar(b"{}\n" + b"x" * (1 << 20) + b"y\n")
    assert len(records) == 1 and summary["physical_conflict"] == "record-too-large"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "good.jsonl").write_bytes(lines(HEADER, *ENTRIES))
    (tmp_path / "bad.jsonl").write_bytes(b"nonsense\n")
    (tmp_path / "other.txt").write_bytes(b"x")
    return tmp_path


def test_readers_isolate_broken_logs(spark, folder):
    source = logs.files(spark, str(folder))
    assert logs.session_entries(source).count() == 4
    by_error = {r.error: r.record_count for r in logs.session_summaries(source).collect()}
    assert by_error == {None: 4, "malformed-json": None}
    assert [(r.id, r.cwd) for r in logs.in_directory(logs.headers(spark, str(folder)), "/w").collect()] == [("s1", "/w")]


def test_restore_round_trip(spark, folder, tmp_path):
    source = logs.files(spark, str(folder / "good.jsonl"))
    s = logs.session_summaries(source).selectExpr("session_id as id", "header_json", "path as source_file", "record_count as entry_count", "log_hash", "log_bytes", "has_final_newline")
    out = tmp_path / "out"
    e = logs.session_entries(source)
    assert [r.status for r in materialize(e, s, str(out)).collect()] == ["restored"]
    assert (out / "good.jsonl").read_bytes() == (folder / "good.jsonl").read_bytes()
    assert [r.status for r in materialize(e.where("ordinal <> 1"), s, str(out)).collect()] == ["incomplete"]
    assert [(r.status, r.file) for r in materialize(e, s, f"file://{tmp_path}/other/place").collect()] == [("restored", f"file://{tmp_path}/other/place/good.jsonl")]
    assert sorted(p.name for p in tmp_path.glob("other/place/*")) == ["good.jsonl"]
    (out / "good.jsonl").write_bytes(b"mine")
    assert [r.status for r in materialize(e, s, str(out)).collect()] == ["exists"]
    assert (out / "good.jsonl").read_bytes() == b"mine"


CP = "session_id string, cp_ordinal long, cp_byte_offset long, cp_prefix_hash string, cp_log_hash string, cp_entry_count long"


def test_plan_sync(spark, folder):
    source = logs.files(spark, str(folder / "good.jsonl"))
    entries = logs.session_entries(source).cache()
    summary = logs.session_summaries(source).withColumnRenamed("record_count", "entry_count")
    at = {r.ordinal: r for r in entries.collect()}

    def plan(*row):
        p, pending = plan_sync(summary, entries, spark.createDataFrame([("s1", *row)] if row else [], CP))
        r = p.first()
        return r.status, r.reason, sorted(x.ordinal for x in pending.collect())

    log = summary.first()
    assert plan() == ("pending", None, [0, 1, 2, 3])
    assert plan(1, at[1].next_byte_offset, at[1].prefix_hash, None, None) == ("pending", None, [2, 3])
    assert plan(1, at[1].next_byte_offset, "other", None, None) == ("conflict", "prefix-mismatch", [])
    assert plan(1, 7, at[1].prefix_hash, None, None) == ("conflict", "checkpoint-out-of-range", [])
    assert plan(9, 7, at[1].prefix_hash, None, None) == ("conflict", "checkpoint-out-of-range", [])
    # an unchanged log is recognised before its checkpoint is looked at
    assert plan(1, 7, "other", log.log_hash, 4) == ("unchanged", None, [])


def test_byte_batches_cut_only_beyond_the_limit(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 1, 20, 1])], "k string, ordinal long, payload_bytes long")
    assert [r.batch for r in byte_batches(df, ["k"], 10).orderBy("ordinal").collect()] == [0, 0, 1, 2, 3]
    with pytest.raises(ValueError):
        byte_batches(df, ["k"], 0)


def test_contiguous(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("b", 0, 5), ("b", 6, 9)], "stream_id string, start_offset long, end_offset long")
    assert {r.stream_id: r.ok for r in contiguous(df).collect()} == {"a": True, "b": False}
