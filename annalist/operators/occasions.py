"""Verified occasions: the user request behind a cited entry, found by walking the session's tree.

Walks branch and need the whole session at hand, so a session (and, for copied entries, its forks) is one task; forks are brought in by joins.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from annalist.functions.canonical import parse_json

# Texts and origins of requests that a program wrote.
INJECTED = ("<task-notification>", "<teammate-message", "<bash-stdout>", "<bash-stderr>", "<local-command-stdout>", "<local-command-stderr>", "<system-reminder>", "[Request interrupted by user")
INJECTED_UNLESS_ORIGIN_KNOWN = ("<command-message>", "<command-name>", "<bash-input>")
ORIGINS = {"promptSource": {"typed", "suggestion_accepted", "sdk"}, "turnOrigin": {"human", "sdk"}, "userType": {"external"}}
SESSION, TRANSCRIPT = "pi", "claude-code"


def _dict(v: object) -> dict:
    return v if isinstance(v, dict) else {}


def _blocks(value: dict) -> list[dict]:
    content = _dict(value.get("message")).get("content")
    return [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []


def is_request(content: object) -> bool:
    """Text that is not blank, or blocks with such text, an image or a document."""
    if isinstance(content, str):
        return bool(content.strip())
    if not isinstance(content, list) or not content or not all(isinstance(b, dict) for b in content):
        return False
    return any(b.get("type") in ("image", "document") or (b.get("type") == "text" and isinstance(b.get("text"), str) and b["text"].strip()) for b in content)


def is_injected(value: dict) -> bool:
    message = _dict(value.get("message"))
    origin = {k: value[k] for k in ORIGINS if k in value}
    valid = all(isinstance(v, str) and v in ORIGINS[k] for k, v in origin.items())
    known = valid and ("turnOrigin" in origin or "promptSource" in origin)
    content = message.get("content")
    text = content if isinstance(content, str) else "\n".join(b["text"] for b in _blocks(value) if b.get("type") == "text" and isinstance(b.get("text"), str))
    marks = INJECTED if known else INJECTED + INJECTED_UNLESS_ORIGIN_KNOWN
    return not valid or bool(value.get("isSynthetic")) or bool(message.get("isSynthetic")) or text.lstrip().startswith(marks)


def is_summary(value: dict) -> bool:
    return any(value.get(k) for k in ("isCompactSummary", "isSessionTranscriptOnly", "isMeta", "isSynthetic")) or value.get("subtype") == "compact_boundary"


@dataclass
class Session:
    """One session's records by (stream, entry); an id that occurs twice is unusable."""

    id: str
    kind: str
    native_id: str
    records: dict = field(default_factory=dict)
    calls: dict = field(default_factory=dict)
    agents: dict = field(default_factory=dict)
    fragments: dict = field(default_factory=dict)
    hashes: dict = field(default_factory=dict)

    @classmethod
    def of(cls, id: str, kind: str, native_id: str, rows) -> Session:
        s, twice = cls(id, kind, native_id), set()
        for stream, entry, raw in rows:
            try:
                value = parse_json(raw)
            except (ValueError, TypeError):
                continue
            if not isinstance(value, dict) or value.get("id" if kind == SESSION else "uuid") != entry:
                continue
            if kind != SESSION and (value.get("sessionId") != native_id or stream not in ("main", f"agent:{value.get('agentId')}")):
                continue
            key = (stream, entry)
            if key in s.records:
                twice.add(key)
            s.records[key], s.hashes[key] = value, hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()
        for key in twice:
            del s.records[key]
        call = "toolCall" if kind == SESSION else "tool_use"
        for key, value in s.records.items():
            if _dict(value.get("message")).get("role") == "assistant":
                for b in _blocks(value):
                    if b.get("type") == call and isinstance(b.get("id"), str):
                        s.calls.setdefault((key[0], b["id"]), []).append(key)
            agent = _dict(value.get("toolUseResult")).get("agentId")
            if key[0] == "main" and agent is not None:
                s.agents.setdefault(agent, []).append(key)
            if isinstance(value.get("requestId"), str):
                s.fragments.setdefault((key[0], value["requestId"]), []).append(key)
        return s

    def anchor(self, stream: str, entry: str) -> tuple[str, str] | None:
        """(stream, entry) of the user request behind an entry; None if there is none, or more than one."""
        return self._linear(stream, entry) if self.kind == SESSION else self._branching((stream, entry), frozenset(), True)

    def _linear(self, stream: str, entry: str | None) -> tuple[str, str] | None:
        seen = set()
        while (stream, entry) in self.records and entry not in seen:
            seen.add(entry)
            value = self.records[stream, entry]
            message = _dict(value.get("message"))
            if value.get("type") != "message" or value.get("isSynthetic") or message.get("isSynthetic"):
                return None
            role = message.get("role")
            if role == "user":
                return (stream, entry) if is_request(message.get("content")) and not is_injected(value) else None
            if role == "assistant":
                entry = value.get("parentId")
            elif role == "toolResult" and isinstance(message.get("toolCallId"), str):
                made = self.calls.get((stream, message["toolCallId"]), [])
                if len(made) != 1:
                    return None
                entry = made[0][1]
            else:
                return None
        return None

    def _parent(self, stream: str, entry: object) -> tuple[str, str] | None:
        """The next message upwards, across compaction boundaries."""
        seen = set()
        while (stream, entry) in self.records and entry not in seen:
            seen.add(entry)
            value = self.records[stream, entry]
            if value.get("isCompactSummary") or value.get("isSessionTranscriptOnly") or value.get("subtype") == "compact_boundary":
                entry = value.get("logicalParentUuid") or value.get("parentUuid")
            else:
                return (stream, entry) if value.get("type") in ("user", "assistant") else None
        return None

    def _calls_of(self, key: tuple[str, str]) -> list[tuple[str, str]] | None:
        """The calls that a record's results answer, each once; None unless every result has exactly one call in the message it names."""
        value = self.records[key]
        results = [b for b in _blocks(value) if b.get("type") == "tool_result"]
        out = []
        for b in results:
            made = self.calls.get((key[0], b.get("tool_use_id")), [])
            if len(made) != 1 or made[0][1] != value.get("sourceToolAssistantUUID"):
                return None
            out.append(made[0])
        return list(dict.fromkeys(out)) or None

    def _branching(self, key, seen: frozenset, fragments: bool) -> tuple[str, str] | None:
        while key in self.records and key not in seen:
            value, (stream, _) = self.records[key], key
            message, kind = _dict(value.get("message")), value.get("type")
            if is_summary(value) or kind not in ("user", "assistant") or message.get("role") != kind:
                return None
            seen |= {key}
            if stream != "main":  # only a structured result of an agent leads back to its parent
                parents = self.agents.get(stream.removeprefix("agent:"), []) if stream.startswith("agent:") else []
                calls = self._calls_of(parents[0]) if len(parents) == 1 else None
                if not calls:
                    return None
                ids = {b.get("id") for c in calls for b in _blocks(self.records[c]) if b.get("type") == "tool_use" and b.get("name") == "Agent"}
                if not all(b.get("tool_use_id") in ids for b in _blocks(self.records[parents[0]]) if b.get("type") == "tool_result"):
                    return None
                key, fragments = parents[0], False
                continue
            if any(b.get("type") == "tool_result" for b in _blocks(value)):
                calls = self._calls_of(key)
                if not calls:
                    return None
                if len(calls) > 1:
                    found = {self._branching(c, seen, False) for c in calls}
                    return found.pop() if len(found) == 1 else None
                key, fragments = calls[0], False
                continue
            if kind == "user":
                return key if is_request(message.get("content")) and not is_injected(value) else None
            up = self._parent(stream, value.get("parentUuid"))
            if up is not None:
                key = up
                continue
            if fragments and isinstance(value.get("requestId"), str):
                found = {self._branching(k, seen, False) for k in self.fragments.get((stream, value["requestId"]), [])} - {None}
                return found.pop() if len(found) == 1 else None
            return None
        return None

    def requests(self) -> list[tuple[str, str]]:
        """User requests of the parent stream, by which copies between sessions are found."""
        return [
            k for k, v in self.records.items()
            if k[0] == "main" and v.get("type") == "user" and not any(b.get("type") == "tool_result" for b in _blocks(v))
            and not is_summary(v) and not is_injected(v) and is_request(_dict(v.get("message")).get("content"))
        ]


_ANCHOR = "session_id string, stream_id string, entry_id string, anchor_stream string, anchor_entry string, raw_hash string"


def anchors(entries: DataFrame, citations: DataFrame, sessions: DataFrame) -> DataFrame:
    """entries(session_id, stream_id, entry_id, raw_json), citations(session_id, stream_id, entry_id), sessions(id, source_kind, source_session_id)
    -> for each citation with a request behind it: the request's stream, entry and hash."""
    cited = citations.select("session_id", "stream_id", "entry_id").distinct().withColumn("cited", F.lit(True))
    rows = entries.join(citations.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "stream_id", "entry_id", "raw_json")
    rows = rows.join(cited, ["session_id", "stream_id", "entry_id"], "left")
    rows = rows.join(sessions.select(F.col("id").alias("session_id"), "source_kind", "source_session_id"), "session_id")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        sid = frame["session_id"].iloc[0]
        s = Session.of(sid, frame["source_kind"].iloc[0], frame["source_session_id"].iloc[0], zip(frame["stream_id"], frame["entry_id"], frame["raw_json"], strict=True))
        out = []
        for stream, entry in frame.loc[frame["cited"].fillna(False).astype(bool), ["stream_id", "entry_id"]].drop_duplicates().itertuples(index=False):
            found = s.anchor(stream, entry)
            if found:
                out.append((sid, stream, entry, *found, s.hashes[found]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ANCHOR.split(", ")])

    return rows.groupBy("session_id").applyInPandas(walk, _ANCHOR)


def copied_requests(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """(stream_id, entry_id) of transcript requests that stand in more than one session: none of these is anyone's own occasion."""
    own = sessions.where(F.col("source_kind") == TRANSCRIPT).select(F.col("id").alias("session_id"), F.coalesce("source_session_id", "id").alias("native"))
    seen = entries.where("coalesce(stream_id, 'main') = 'main'").join(own, "session_id")
    return seen.groupBy("entry_id").agg(F.count_distinct("native").alias("copies")).where("copies > 1").select(F.lit("main").alias("stream_id"), "entry_id")


def originals(found: DataFrame, entries: DataFrame, sessions: DataFrame, most: int = 128) -> DataFrame:
    """Follows each anchor through fork parents to the session where it was first written, over at most ``most`` forks.

    sessions(id, user_id, source_kind, parent_session, parent_ids array). A step is taken while the one parent of same kind and owner holds the same entry with the same bytes.
    Several parents, a parent that is declared but not there, a copy that differs, an entry that stands twice in its session, and a cycle give no occasion.

    Each copy of an anchored entry is a node that points to its copy one fork up, ends here, or breaks off. A round replaces what a node points to by what that points to, so paths double: 128 forks are
    7 rounds and 8 written tables, and what still points somewhere after them is on a cycle or too deep.
    """
    from annalist.operators.walks import durable

    at = ["anchor_stream", "anchor_entry"]
    copies = entries.select("session_id", F.col("stream_id").alias("anchor_stream"), F.col("entry_id").alias("anchor_entry"), "raw_json").join(found.select(*at).distinct(), at, "left_semi")
    copies = copies.groupBy("session_id", *at).agg(F.count(F.lit(1)).alias("n"), F.first(F.sha2(F.col("raw_json").cast("binary"), 256)).alias("hash")).where("n = 1").drop("n")
    s = sessions.select(F.col("id").alias("session_id"), F.col("user_id").alias("_u"), F.col("source_kind").alias("_k"), F.col("parent_session").isNotNull().alias("_declared"), F.coalesce("parent_ids", F.array().cast("array<string>")).alias("_parents"))
    p = sessions.select(F.col("id").alias("_p"), F.col("user_id").alias("_pu"), F.col("source_kind").alias("_pk"))
    forks = s.withColumn("_p", F.when(F.size("_parents") == 1, F.get("_parents", F.lit(0)))).join(p, "_p", "left")
    same = F.coalesce((F.col("_pu") == F.col("_u")) & (F.col("_pk") == F.col("_k")), F.lit(False))
    forks = forks.select("session_id", (F.size("_parents").eqNullSafe(0) & ~F.col("_declared")).alias("_root"), F.when(same, F.col("_p")).alias("_p"))
    above = copies.select(F.col("session_id").alias("_p"), *at, F.col("hash").alias("_copy"))
    steps = copies.join(forks, "session_id").join(above, ["_p", *at], "left")
    ends = F.col("_root") | F.col("_p").isNotNull() & F.col("_copy").isNull()
    # to: the session that a node's path has come to; live: whether it may go on from there
    nodes = steps.select("session_id", *at, "hash", F.when(ends, F.col("session_id")).when(F.col("_copy") == F.col("hash"), F.col("_p")).alias("to"), (~ends).alias("live"), F.when(ends, 0).otherwise(1).alias("forks"))
    nodes, reach = durable(nodes.where("to is not null")), 1
    while reach < most:
        on = nodes.select(F.col("session_id").alias("to"), *at, F.col("to").alias("_to"), F.col("live").alias("_live"), F.col("forks").alias("_forks"))
        # a live path that meets a node which broke off has no row any more
        grown = nodes.where("live").join(on, ["to", *at]).select("session_id", *at, "hash", F.col("_to").alias("to"), F.col("_live").alias("live"), (F.col("forks") + F.col("_forks")).alias("forks"))
        nodes, reach = durable(nodes.where("not live").unionByName(grown)), reach * 2
        if nodes.where("live").isEmpty():
            break
    # a path of ``most`` forks may have come to its end, which its own node tells
    ended = nodes.where("not live and forks = 0").select("session_id", *at)
    last = nodes.where("live").join(ended.withColumnRenamed("session_id", "to"), ["to", *at], "left_semi") if reach >= most else nodes.limit(0)
    done = nodes.where("not live").unionByName(last).where(F.col("forks") <= most)
    return found.join(done.select("session_id", *at, F.col("hash").alias("raw_hash"), F.col("to").alias("origin_session")), ["session_id", *at, "raw_hash"]).select("session_id", "stream_id", "entry_id", *at, "origin_session")


def verified_occasions(memories: DataFrame, entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """memories(id, session_id, source_entries) -> id, source_occasions: distinct sorted (session_id, stream_id, entry_id) of requests behind the citations."""
    cited = memories.select("id", "session_id", F.explode("source_entries").alias("s")).select("id", "session_id", F.coalesce("s.stream_id", F.lit("main")).alias("stream_id"), F.col("s.entry_id").alias("entry_id"))
    found = originals(anchors(entries, cited, sessions), entries, sessions)
    copied = copied_requests(entries, sessions).select(F.col("stream_id").alias("anchor_stream"), F.col("entry_id").alias("anchor_entry"))
    kinds = sessions.select(F.col("id").alias("session_id"), "source_kind")
    found = found.join(kinds, "session_id")
    found = found.where(F.col("source_kind") != TRANSCRIPT).unionByName(found.where(F.col("source_kind") == TRANSCRIPT).join(copied, ["anchor_stream", "anchor_entry"], "left_anti").select(*found.columns))
    o = F.struct(F.col("origin_session").alias("session_id"), F.col("anchor_stream").alias("stream_id"), F.col("anchor_entry").alias("entry_id"))
    seen = cited.join(found, ["session_id", "stream_id", "entry_id"]).groupBy("id").agg(F.array_sort(F.collect_set(o)).alias("source_occasions"))
    none = F.array().cast("array<struct<session_id:string,stream_id:string,entry_id:string>>")
    return memories.select("id").join(seen, "id", "left").select("id", F.coalesce("source_occasions", none).alias("source_occasions"))


# Fields that a compact record keeps, if they are strings, numbers or booleans.
RECORD_FIELDS = ("id", "uuid", "sessionId", "agentId", "type", "subtype", "parentId", "parentUuid", "logicalParentUuid", "requestId", "sourceToolAssistantUUID",
                 "isMeta", "isSynthetic", "isCompactSummary", "isSessionTranscriptOnly", "promptSource", "turnOrigin", "userType")
MESSAGE_FIELDS = ("role", "toolCallId", "isSynthetic")
BLOCK_FIELDS = ("type", "id", "name", "tool_use_id")
ORIGIN_FIELDS = ("promptSource", "turnOrigin", "userType")
#: UTF-16 units of a user's text that a compact record keeps.
TEXT_UNITS = 512


def _scalars(value: dict, fields: tuple[str, ...]) -> dict:
    return {f: value[f] for f in fields if isinstance(value.get(f), (str, bool, int, float))}


def _opening(text: str) -> str:
    return text.lstrip().encode("utf-16-le", "surrogatepass")[: 2 * TEXT_UNITS].decode("utf-16-le", "ignore")


def compact_record(raw: str) -> dict | None:
    """What occasions need of a raw record: listed scalar fields, and of messages the listed fields of blocks and the opening of what users wrote. None: no JSON object."""
    try:
        value = parse_json(raw)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    out = _scalars(value, RECORD_FIELDS)
    message = value.get("message")
    if isinstance(message, dict):
        user, content, kept = message.get("role") == "user", message.get("content"), None
        if isinstance(content, str):
            kept = _opening(content) if user else None
        elif isinstance(content, list):
            kept = []
            for b in content:
                b = b if isinstance(b, dict) else {}
                kept.append(_scalars(b, BLOCK_FIELDS) | ({"text": _opening(b["text"])} if user and isinstance(b.get("text"), str) else {}))
        out["message"] = _scalars(message, MESSAGE_FIELDS) | {"content": kept}
    out["originMalformed"] = any(f in value and not isinstance(value[f], str) for f in ORIGIN_FIELDS)
    if isinstance(value.get("toolUseResult"), dict):
        out["toolUseResult"] = _scalars(value["toolUseResult"], ("agentId",))
    return out


@F.pandas_udf(StringType())
def compact_json(raw: pd.Series) -> pd.Series:
    """``compact_record`` as JSON; null for what is no JSON object."""
    found = [compact_record(r) if isinstance(r, str) else None for r in raw]
    return pd.Series([None if r is None else json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in found], dtype=object)
