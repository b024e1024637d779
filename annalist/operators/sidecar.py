"""Meaning of a producer's event log: envelope inspection, then the stateful fold of replay, conflict, regression and blocking.

The fold is one pure function over the records of a log, which the streaming form runs with its state by key. The batch form (``classify``) splits it: envelopes and ids are columns and
windows, and what is left to do in order is a pass with a state of one checkpoint.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.canonical import CanonicalError, event_hash, parse_json

# Fixed values of protocol version 1.
KINDS = {"observations.recorded": "observations", "reflections.recorded": "reflections", "observations.dropped": "observationIds", "source.covered": None}
RELEVANCE = ("low", "medium", "high", "critical")
SAFE_INTEGER = 2**53 - 1

_CONTROL = re.compile("[\x00-\x1f\x7f]")


def text_within(v: object, low: int, high: int) -> bool:
    return isinstance(v, str) and low <= len(v.encode("utf-8", "surrogatepass")) <= high


def protocol_id(v: object) -> bool:
    return text_within(v, 1, 128) and re.fullmatch("[a-z0-9][a-z0-9._-]{0,127}", v) is not None


def stable_id(v: object) -> bool:
    return text_within(v, 1, 256) and re.fullmatch("[A-Za-z0-9][A-Za-z0-9._-]{0,255}", v) is not None


def host_id(v: object) -> bool:
    return text_within(v, 1, 512) and not _CONTROL.search(v)


def memory_id(v: object) -> bool:
    return isinstance(v, str) and re.fullmatch("[a-f0-9]{12}", v) is not None


def count(v: object) -> bool:
    """A non-negative safe integer; 1.0 is one."""
    return isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and (math.isinf(v) or v != v)) and float(v).is_integer() and 0 <= v <= SAFE_INTEGER


def timestamp(v: object) -> bool:
    if not text_within(v, 1, 64) or not v.endswith("Z"):
        return False
    try:
        datetime.fromisoformat(v)
    except ValueError:
        return False
    return True


def _list(v: object, check, key=lambda x: x) -> bool:
    """1 to 256 valid items, none twice."""
    return isinstance(v, list) and 1 <= len(v) <= 256 and all(map(check, v)) and len({key(x) for x in v}) == len(v)


def _checkpoint(value: dict) -> list[dict] | None:
    streams = value["sourceCheckpoint"].get("streams") if isinstance(value.get("sourceCheckpoint"), dict) else None

    def ok(s: object) -> bool:
        return (
            isinstance(s, dict) and host_id(s.get("streamId")) and count(s.get("committedBytes")) and isinstance(s.get("prefixSha256"), str)
            and re.fullmatch("[a-f0-9]{64}", s["prefixSha256"]) is not None and "selectedLeafEntryId" in s
            and (s["selectedLeafEntryId"] is None or host_id(s["selectedLeafEntryId"]))
        )

    if not _list(streams, ok, lambda s: s["streamId"]):
        return None
    names = [s["streamId"] for s in streams]
    return streams if names == sorted(names, key=lambda n: n.encode("utf-16-be", "surrogatepass")) else None


def regressed(before: list[dict], now: list[dict]) -> bool:
    """Whether a stream of the last accepted checkpoint is gone, shorter, or as long with another prefix."""
    have = {s["streamId"]: s for s in now}

    def back(s: dict) -> bool:
        c = have.get(s["streamId"])
        return c is None or c["committedBytes"] < s["committedBytes"] or (c["committedBytes"] == s["committedBytes"] and c["prefixSha256"] != s["prefixSha256"])

    return any(map(back, before))


def _content(o: dict) -> bool:
    return memory_id(o.get("id")) and text_within(o.get("content"), 1, 65536) and count(o.get("tokenCount"))


def _observation(streams: set[str]):
    def cited(e: object) -> bool:
        return isinstance(e, dict) and host_id(e.get("streamId")) and host_id(e.get("entryId")) and e["streamId"] in streams

    def ok(o: object) -> bool:
        return isinstance(o, dict) and _content(o) and timestamp(o.get("timestamp")) and o.get("relevance") in RELEVANCE and _list(o.get("sourceEntries"), cited, lambda e: (e["streamId"], e["entryId"]))

    return ok


def _reflection(r: object) -> bool:
    return isinstance(r, dict) and _content(r) and not re.search("[\r\n]", r["content"]) and _list(r.get("supportingObservationIds"), memory_id)


def _shape(value: dict, checkpoint: list[dict]) -> bool:
    own = KINDS[value["kind"]]
    if not stable_id(value.get("eventId")) or not timestamp(value.get("recordedAt")):
        return False
    if any(k in value for k in KINDS.values() if k and k != own):
        return False
    if own is None:
        return True
    if own == "observations":
        return _list(value.get(own), _observation({s["streamId"] for s in checkpoint}), lambda o: o["id"])
    return _list(value.get(own), _reflection, lambda r: r["id"]) if own == "reflections" else _list(value.get(own), memory_id)


@dataclass(frozen=True)
class Locator:
    source_kind: str
    source_session_id: str
    producer_id: str

    def valid(self) -> bool:
        return protocol_id(self.source_kind) and host_id(self.source_session_id) and protocol_id(self.producer_id)


def inspect(raw: str, locator: Locator) -> dict:
    """status accepted with the event's identity, or skipped with the first reason that applies."""
    skip = lambda why: {"status": "skipped", "diagnostics": [why]}
    try:
        value = parse_json(raw)
    except (ValueError, RecursionError):
        return skip("malformed-json")
    if not isinstance(value, dict):
        return skip("invalid-envelope")
    version = value.get("protocolVersion")
    if isinstance(version, bool) or version != 1:
        return skip("unsupported-version")
    if not isinstance(value.get("kind"), str) or value["kind"] not in KINDS:
        return skip("unsupported-kind")
    producer, source, checkpoint = value.get("producer"), value.get("source"), _checkpoint(value)
    if not (
        isinstance(producer, dict) and protocol_id(producer.get("id")) and text_within(producer.get("version"), 1, 128) and checkpoint is not None
        and isinstance(source, dict) and protocol_id(source.get("kind")) and host_id(source.get("sessionId")) and _shape(value, checkpoint)
    ):
        return skip("invalid-envelope")
    if producer["id"] != locator.producer_id:
        return skip("producer-mismatch")
    if (source["kind"], source["sessionId"]) != (locator.source_kind, locator.source_session_id):
        return skip("source-mismatch")
    try:
        identity = event_hash(value)
    except CanonicalError:
        return skip("invalid-envelope")
    return {"status": "accepted", "diagnostics": [], "event_id": value["eventId"], "event_hash": identity, "kind": value["kind"], "checkpoint": checkpoint}


@dataclass
class State:
    """By log: hash of each event id seen, the last accepted checkpoint, and the latch."""

    hashes: dict[str, str] = field(default_factory=dict)
    checkpoint: list[dict] | None = None
    conflict: str | None = None

    def apply(self, event: dict) -> dict:
        if event["status"] != "accepted":
            return event
        turn = lambda status, why: event | {"status": status, "diagnostics": [why]}
        known = self.hashes.get(event["event_id"])
        if self.conflict:
            return turn("blocked", "stream-conflicted")
        if known == event["event_hash"]:
            return turn("replay", "idempotent-replay")
        if known is not None:
            self.conflict = "immutable-event-conflict"
            return turn("conflict", self.conflict)
        self.hashes[event["event_id"]] = event["event_hash"]  # even if the event is skipped below, its id is taken
        if self.checkpoint is not None and regressed(self.checkpoint, event["checkpoint"]):
            return turn("skipped", "checkpoint-regression")
        self.checkpoint = event["checkpoint"]
        return event


def fold(records: Iterable[str], locator: Locator, state: State | None = None) -> list[dict]:
    state = state or State()
    return [state.apply(inspect(raw, locator)) for raw in records]


SEMANTICS = "source_kind string, source_session_id string, producer_id string, ordinal long, semantic_status string, diagnostics array<string>, event_id string, event_hash string, kind string, raw_json string"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statuses of inspected records in order of log and ordinal. What the fold keeps is one checkpoint and one latch, whatever a log's length."""
    log, before, latched = None, None, False
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in LOG), strict=True))
        checkpoints, out = batch.column("checkpoint"), []
        for i, (key, reason, known) in enumerate(zip(keys, batch.column("reason").to_pylist(), batch.column("known").to_pylist(), strict=True)):
            if key != log:
                log, before, latched = key, None, False
            if reason is not None:
                out.append(("skipped", [reason]))
            elif latched:
                out.append(("blocked", ["stream-conflicted"]))
            elif known == "same":
                out.append(("replay", ["idempotent-replay"]))
            elif known == "other":
                latched = True
                out.append(("conflict", ["immutable-event-conflict"]))
            else:
                now = checkpoints[i].as_py()
                if before is not None and regressed(before, now):
                    out.append(("skipped", ["checkpoint-regression"]))
                else:
                    before = now
                    out.append(("accepted", []))
        status, why = zip(*out, strict=True) if out else ((), ())
        columns = [*LOG, "ordinal", "event_id", "event_hash", "kind"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(status, pa.string()), pa.array(why, pa.list_(pa.string()))], names=[*columns, "semantic_status", "diagnostics"])


LOG = ["source_kind", "source_session_id", "producer_id"]


def classify(records: DataFrame) -> DataFrame:
    """records(source_kind, source_session_id, producer_id, ordinal, raw_json) -> the same with semantic_status, diagnostics, event_id, event_hash, kind.

    Records are inspected in the JVM (``envelope.inspected``). Whether an event's id is known, and with another hash, is told by the first record with that id, over the ids; only checkpoints
    and the latch need a log's records in order, and that pass sees neither texts nor the ids that came before.
    """
    from annalist.operators.envelope import inspected
    from annalist.operators.walks import durable

    seen = durable(inspected(records).drop("raw_json"))
    # records without an id are by themselves
    same = Window.partitionBy(*LOG, "event_id", F.when(F.col("event_id").isNull(), F.col("ordinal"))).orderBy("ordinal")
    first = F.first("event_hash").over(same)
    seen = seen.withColumn("known", F.when(F.row_number().over(same) == 1, "new").when(F.col("event_hash") == first, "same").otherwise("other"))
    ordered = seen.select(*LOG, "ordinal", "reason", "event_id", "event_hash", "kind", "known", "checkpoint").repartition(*LOG).sortWithinPartitions(*LOG, "ordinal")
    told = ordered.mapInArrow(_turns, "source_kind string, source_session_id string, producer_id string, ordinal long, event_id string, event_hash string, kind string, semantic_status string, diagnostics array<string>")
    return records.select(*LOG, "ordinal", "raw_json").join(told, [*LOG, "ordinal"]).select(*[c.split()[0] for c in SEMANTICS.split(", ")])
