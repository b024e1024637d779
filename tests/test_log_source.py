import hashlib
import io
import json
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from annalist.sources import log_source
from annalist.sources.framing import LogError, scan_session
from annalist.sources.log_source import range_records, split_ranges, split_records, split_sessions, with_prefix_hash
from tests.test_sidecar import keyed  # noqa: F401


def entry(i, parent=None, **more):
    return {"type": "message", "id": i, "parentId": parent, "message": {"role": "user", "content": f"text of {i} ü" * (1 + len(i) % 7)}, **more}


def log(*lines, end="\n"):
    return ("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + end).encode()


HEADER = {"type": "session", "id": "s", "cwd": "/r"}


@pytest.mark.parametrize("tail", [True, False])
@pytest.mark.parametrize("body", [b"", b"\n", b"a", b"a\n", b"\n\na\n", b"abc\nd\n\n efg", b"abc\nd\n\n efg\n", b"x" * 50 + b"\n" + b"y" * 3])
def test_any_cut_gives_each_record_once(body, tail):
    lines = body.split(b"\n")
    want = [(line, True) for line in lines[:-1]] + ([(lines[-1], False)] if tail and lines[-1] else [])
    for width in range(1, len(body) + 2):
        edges = [*range(0, len(body), width), len(body)]
        got = [r for a, b in zip(edges, edges[1:], strict=False) for r in range_records(io.BytesIO(body), a, b, tail and b == len(body))]
        assert [(raw, complete) for _, raw, complete in got] == want
        assert all(body[at : at + len(raw)] == raw for at, raw, _ in got)


class Virtual:
    """A log of 3 GB, made as it is read: records of 100 bytes."""

    size, asked = 3_000_000_000, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        n = min(n, self.size - self.at)
        self.asked += n
        out = (b"r" * 99 + b"\n") * (n // 100 + 2)
        out = out[self.at % 100 :][:n]
        self.at += n
        return out


def test_a_range_of_a_log_above_2_gb_takes_its_own_bytes_only():
    f, start = Virtual(), 2_500_000_050
    tracemalloc.start()
    got = sum(1 for at, raw, _ in range_records(f, start, start + (8 << 20), False) if len(raw) == 99 and at % 100 == 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == ((start + (8 << 20)) // 100 - start // 100)
    assert f.asked <= (8 << 20) + log_source.BACK and peak < 30 << 20


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("logs")
    rng = random.Random(4)
    chain = [HEADER] + [entry(f"e{i}", f"e{rng.randrange(i)}" if i else None) for i in range(60)]
    (where / "good.jsonl").write_bytes(log(*chain[:20], "", "   ", *chain[20:], end=""))
    (where / "sub").mkdir()
    (where / "sub/long.jsonl").write_bytes(log(HEADER | {"id": "t"}, entry("a"), entry("b" * 3000, "a"), entry("c", "b" * 3000)))
    for name, lines in {
        "twice": [HEADER, entry("a"), entry("a")], "orphan": [HEADER, entry("a", "b"), entry("b")], "itself": [HEADER, entry("a", "a")], "headless": [entry("a")], "broken": [HEADER, "{", entry("a"), entry("a")],
        "list": [HEADER, "[]"], "blank": [HEADER, entry("a") | {"id": ""}], "number": [HEADER, entry("a", 5)], "both": [HEADER, entry("a"), {"type": "m", "id": "a"}], "keyless": [HEADER, {"type": "m", "id": "a"}],
    }.items():
        (where / f"{name}.jsonl").write_bytes(log(*lines))
    (where / "empty.jsonl").write_bytes(b"")
    (where / "spaces.jsonl").write_bytes(b"\n\n")
    (where / "ignored.txt").write_bytes(b"x\n")
    return where


def full(folder):
    """Each log by the sequential scan."""
    out = {}
    for p in folder.rglob("*.jsonl"):
        try:
            out[p.stem] = scan_session(p.read_bytes())
        except LogError as e:
            out[p.stem] = e.reason
    return out


@pytest.mark.parametrize("split", [37, 400, 1 << 20])
def test_split_scan_equals_full_scan(spark, folder, split):
    records = split_records(spark, str(folder), split_bytes=split)
    entries, logs = split_sessions(records)
    want = full(folder)
    name = lambda path: path.rsplit("/", 1)[-1].removesuffix(".jsonl")
    told = {name(r.path): r for r in logs.collect()}
    assert set(told) == set(want) - {"empty"}
    hashes = {(name(r.path), r.byte_offset): r for r in with_prefix_hash(records).collect()}
    found = {}
    for r in entries.collect():
        found.setdefault(name(r.path), []).append(r)
    for k, r in told.items():
        if isinstance(want[k], str):
            assert (r.error, k in found) == (want[k], False), k
            continue
        rows, summary = want[k]
        assert (r.error, r.session_id, r.cwd, r.record_count, r.largest_record_bytes, r.last_entry_id, r.log_bytes, r.has_final_newline) == (
            None, summary["session_id"], summary["cwd"], summary["record_count"], summary["largest_record_bytes"], summary["last_entry_id"], summary["log_bytes"], summary["has_final_newline"])
        got = sorted(found[k], key=lambda x: x.ordinal)
        keys = ["ordinal", "entry_id", "parent_id", "type", "role", "byte_offset", "next_byte_offset", "payload_bytes", "raw_json"]
        assert [[x[c] for c in keys] for x in got] == [[x[c] for c in keys] for x in rows]
        assert [(hashes[k, x.byte_offset].prefix_hash, hashes[k, x.byte_offset].payload_hash) for x in got] == [(x["prefix_hash"], x["payload_hash"]) for x in rows]


def test_filters_on_type_reach_the_reader(spark, folder):
    reader = log_source.FilteringLogReader({"path": str(folder), "ranges": ""})
    kept = list(reader.pushFilters([log_source.EqualTo(("type",), "session")]))
    assert reader.kinds == ("session",) and len(kept) == 1
    part = log_source.Range(str(folder / "good.jsonl"), 0, 10**6, True)
    assert [r["type"] for b in reader.read(part) for r in b.to_pylist()] == ["session"]
    escaped = folder / "escaped.txt"
    escaped.write_bytes(b'{"type":"\\u0073ession"}\n{"type":"x"}\n')
    assert [(r["ordinal"], r["type"]) for b in reader.read(log_source.Range(str(escaped), 0, 100, True)) for r in b.to_pylist()] == [(0, "session")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        records = split_records(spark, str(folder), split_bytes=100)
        assert records.where("type = 'session'").count() == records.where("type in ('session', 'none')").count() == sum(json.loads(x or "{}")["type"] == "session" for p in folder.rglob("*.jsonl") for x in p.read_text().split("\n")[:1] if x)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_ranges_state_where_they_begin(spark, folder):
    r = split_ranges(spark, str(folder), split_bytes=100).where(F.col("path").endswith("good.jsonl")).orderBy("range_start").collect()
    assert len(r) > 10 and r[-1].tail and not any(x.tail for x in r[:-1]) and r[0].first == 0
    assert all(b.first == a.first + a.records for a, b in zip(r, r[1:], strict=False)) and r[-1].first + r[-1].records == 61
    assert split_records(spark, str(folder), suffix=".none").count() == 0


def test_tail_reads_what_is_appended(spark, tmp_path, keyed):  # noqa: F811
    """Logs grow between runs, in the middle of records; each run reads the new bytes and the beginnings of unfinished lines."""
    from annalist.streaming.logs import numbered_tail, tail

    logs = tmp_path / "logs"
    logs.mkdir()
    rng = random.Random(8)
    bodies = {f"{n}.jsonl": log(HEADER | {"id": n}, *[entry(f"{n}{i}", *([f"{n}{i - 1}"] if i else [])) for i in range(40)], "", entry("last" + n)) for n in "abc"}
    cuts = {n: sorted(rng.sample(range(1, len(b)), 2)) for n, b in bodies.items()}

    def run():
        q = numbered_tail(tail(spark, str(logs), split_bytes=500)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return spark.read.parquet(str(tmp_path / "out")).count()

    def grow(step):
        for n, b in bodies.items():
            a, z = [0, *cuts[n]][step], [*cuts[n], len(b)][step]
            with open(logs / n, "ab") as f:
                f.write(b[a:z])

    counts = []
    for step in range(3):
        grow(step)
        counts.append(run())
    upto = lambda step: sum(sum(1 for x in b[: [*cuts[n], len(b)][step]].split(b"\n")[:-1] if x) for n, b in bodies.items())
    assert counts == [upto(0), upto(1), upto(2)]
    want = {(r.path.rsplit("/", 1)[-1], r.ordinal): (r.byte_offset, r.payload_hash, r.chain_hash) for r in with_prefix_hash(split_records(spark, str(logs))).where("ordinal is not null").collect()}
    got = {(r.path.rsplit("/", 1)[-1], r.ordinal): (r.byte_offset, r.payload_hash, r.chain_hash) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
    with open(logs / "a.jsonl", "wb") as f:
        f.write(b"{}\n")
    with pytest.raises(Exception, match="shorter"):
        run()


def test_tail_plans_only_new_bytes(tmp_path):
    """Bytes read by three micro-batches are the bytes appended and, once for each cut, the beginning of the line it cut."""
    p = tmp_path / "a.jsonl"
    line = b"x" * 99 + b"\n"
    reader, offsets, read = log_source.TailReader({"path": str(tmp_path), "splitBytes": "1000", "maxBytes": "2500"}), [{}], []
    reader.initialOffset()
    p.write_bytes(line * 60 + b"unfinished")

    class Counting(io.FileIO):
        def read(self, n=-1):
            body = super().read(n)
            read.append(len(body))
            return body

    found = []
    while True:
        now = reader.latestOffset()
        if now == offsets[-1]:
            break
        for part in reader.partitions(offsets[-1], now):
            found += [raw for _, raw, _ in range_records(Counting(p), part.start, part.end, part.tail)]
        offsets.append(now)
    assert [list(o.values()) for o in offsets] == [[], [2500], [5000], [6010]] and found == [line[:-1]] * 60
    assert sum(read) <= 6010 + 7 * log_source.BACK
    with open(p, "ab") as f:
        f.write(b" line\n")
    later = reader.latestOffset()
    (part,) = reader.partitions(offsets[-1], later)
    assert [raw for _, raw, _ in range_records(Counting(p), part.start, part.end, part.tail)] == [b"unfinished line"]
    assert hashlib.sha256(b"").hexdigest() == log_source.CHAIN
