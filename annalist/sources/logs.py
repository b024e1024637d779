"""Log files as DataFrames: ``binaryFile`` for exact bytes, one file a task-local fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.walks import durable
from annalist.sources.framing import LogError, scan_session, scan_sidecar, scan_transcript

ENTRY = (
    "path string, session_id string, stream_id string, ordinal long, entry_id string, record_uuid string, parent_id string, logical_parent_id string, type string, role string, "
    "timestamp string, request_id string, cwd string, agent_id string, byte_offset long, next_byte_offset long, prefix_hash string, payload_hash string, payload_bytes long, raw_json string"
)
SUMMARY = (
    "path string, session_id string, stream_id string, record_count long, log_hash string, log_bytes long, largest_record_bytes long, last_entry_id string, current_leaf_id string, "
    "has_final_newline boolean, incomplete_tail_bytes long, header_json string, header_next_byte_offset long, header_prefix_hash string, cwd string, parent_session string, "
    "created_at string, name string, physical_conflict string, conflict_line long, error string, error_line long"
)
RECORD = "path string, ordinal long, byte_offset long, next_byte_offset long, prefix_hash string, payload_hash string, payload_bytes long, raw_json string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def files(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, content of every matching file below a folder (or of one file)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = _names(schema)
    out = pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)
    kinds = {n: {"long": "Int64", "boolean": "boolean"}.get(c.split()[1], "object") for n, c in zip(names, schema.split(", "), strict=True)}
    return out.astype(kinds)


#: Rows, or characters of raw records, that a task hands on at once.
FRAME_ROWS, FRAME_TEXT = 5000, 4 << 20
#: Entries and summaries in one frame.
BOTH = ", ".join(["kind string", *ENTRY.split(", "), *[c for c in SUMMARY.split(", ") if c not in ENTRY.split(", ")]])


def _scan(source: DataFrame, scan: Callable[[dict], tuple[list[dict], dict]], schema: str, summaries: bool | None) -> DataFrame:
    def found(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for frame in frames:
            for row in frame.to_dict("records"):
                base = {k: v for k, v in row.items() if k != "content"}
                try:
                    records, summary = scan(row)
                except LogError as e:  # one broken log never stops the others
                    records, summary = [], {"error": e.reason, "error_line": e.line}
                if summaries is not False:
                    yield base | ({"kind": "summary"} if summaries is None else {}) | {k: v for k, v in summary.items() if v is not None}
                if not summaries:
                    shared = base | {k: summary[k] for k in ("session_id",) if summary.get(k)} | ({"kind": "entry"} if summaries is None else {})
                    yield from (shared | r for r in records)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # logs are many and small, and a frame for each would cost more than its scan
        rows, size = [], 0
        for r in found(frames):
            rows.append(r)
            size += len(r.get("raw_json") or "")
            if len(rows) >= FRAME_ROWS or size >= FRAME_TEXT:
                yield _frame(rows, schema)
                rows, size = [], 0
        if rows:
            yield _frame(rows, schema)

    return source.mapInPandas(run, schema)


def session_scan(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, summaries) of session logs, from one scan that is written once."""
    rows = durable(_scan(source.select("path", "content", F.lit("main").alias("stream_id")), lambda r: scan_session(bytes(r["content"])), BOTH, None))
    return rows.where("kind = 'entry'").select(*_names(ENTRY)), rows.where("kind = 'summary'").select(*_names(SUMMARY))


def session_entries(source: DataFrame) -> DataFrame:
    """Entries of session logs (``files``); logs that break a rule have none, and an error in ``session_summaries``."""
    return _scan(source.select("path", "content"), lambda r: scan_session(bytes(r["content"])), ENTRY, False)


def session_summaries(source: DataFrame) -> DataFrame:
    return _scan(source.select("path", "content", F.lit("main").alias("stream_id")), lambda r: scan_session(bytes(r["content"])), SUMMARY, True)


def _transcript(r: dict):
    return scan_transcript(bytes(r["content"]), r["session_id"], r["stream_id"], r.get("agent_id"))


def located(source: DataFrame, locators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transcripts with their identity, missing ones): locators(session_id, agent_id, transcript_path); the parent has a null agent_id."""
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    stream = F.when(F.col("agent_id").isNull(), F.lit("main")).otherwise(F.concat(F.lit("agent:"), F.col("agent_id")))
    wanted = locators.select(bare(F.col("transcript_path")).alias("_p"), "session_id", "agent_id", stream.alias("stream_id"))
    have = source.withColumn("_p", bare(F.col("path")))
    return have.join(wanted, "_p").drop("_p"), wanted.join(have.select("_p"), "_p", "left_anti").withColumnRenamed("_p", "transcript_path")


def transcript_entries(found: DataFrame) -> DataFrame:
    return _scan(found.select("path", "content", "session_id", "stream_id", "agent_id"), _transcript, ENTRY, False)


def transcript_summaries(found: DataFrame) -> DataFrame:
    return _scan(found.select("path", "content", "session_id", "stream_id", "agent_id"), _transcript, SUMMARY, True)


def sidecar_records(source: DataFrame) -> DataFrame:
    """Physical records of event logs; their meaning is ``operators.sidecar``."""
    return _scan(source.select("path", "content"), lambda r: scan_sidecar(bytes(r["content"])), RECORD, False)


def sidecar_summaries(source: DataFrame) -> DataFrame:
    return _scan(source.select("path", "content"), lambda r: scan_sidecar(bytes(r["content"])), SUMMARY, True)


#: A first line beyond this is no header.
HEADER_BYTES = 1 << 20


def _first_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path in frame["path"]:
            fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
            with fs.open_input_file(name) as f:
                line = f.read(HEADER_BYTES).partition(b"\n")[0]
            out.append((path, line.decode("utf-8", "replace") if len(line) < HEADER_BYTES else None))
        yield pd.DataFrame(out, columns=["path", "line"])


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Only the header of each session log: path, id, cwd, parent_session. Of a file no more than the first 1 MiB is read; a longer first line is no header."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path).select("path")  # contents are not read
    h = listed.mapInPandas(_first_lines, "path string, line string").select("path", F.try_parse_json("line").alias("v"))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    return h.where(text("type") == "session").select("path", text("id").alias("id"), text("cwd").alias("cwd"), text("parentSession").alias("parent_session"))


def in_directory(found: DataFrame, cwd: str | None) -> DataFrame:
    return found if cwd is None else found.where(F.col("cwd").isNull() | (F.col("cwd") == cwd))


def has_key(raw: Column, key: str) -> Column:
    """Whether a JSON object has the key at all; from_json cannot tell missing from null."""
    return F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))
