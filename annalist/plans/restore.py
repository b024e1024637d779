"""Session logs written back from the replica, byte for byte."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.sources.log_source import file_system

_REPORT = "session_id string, file string, status string, log_bytes long"


def restored_name(session_id: str, source_file: str | None) -> str:
    base = (source_file or "").rpartition("/")[2]
    return base or f"restored_{session_id}.jsonl"


def validated(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """entries(session_id, ordinal, entry_id, parent_id, raw_json, payload_hash, payload_bytes), sessions(id, header_json, source_file, entry_count, log_hash, log_bytes, has_final_newline)
    -> session_id, name, status, log_bytes, log. The log is there (status ``valid``) if every ordinal, size, hash, parent and the whole log's hash hold, else the status says what does not.

    A session is one task, and its log one value.
    """
    rows = entries.select("session_id", "ordinal", "entry_id", "parent_id", "raw_json", "payload_hash", "payload_bytes").join(
        sessions.select(F.col("id").alias("session_id"), "header_json", "source_file", "entry_count", "log_hash", "log_bytes", "has_final_newline"), "session_id"
    )

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        one = frame.iloc[0]

        def verdict() -> tuple[str, bytes | None]:
            if list(frame["ordinal"]) != list(range(len(frame))) or len(frame) != one["entry_count"]:
                return "incomplete", None
            seen: set[str] = set()
            for e, p, raw, h, n in frame[["entry_id", "parent_id", "raw_json", "payload_hash", "payload_bytes"]].itertuples(index=False):
                body = raw.encode()
                if len(body) != n or hashlib.sha256(body).hexdigest() != h:
                    return "payload-mismatch", None
                if isinstance(p, str) and p not in seen:
                    return "parent-missing", None
                seen.add(e)
            log = "\n".join([one["header_json"], *frame["raw_json"]]).encode() + (b"\n" if one["has_final_newline"] else b"")
            if len(log) != one["log_bytes"] or hashlib.sha256(log).hexdigest() != one["log_hash"]:
                return "log-mismatch", None
            return "valid", log

        return pd.DataFrame([(one["session_id"], restored_name(one["session_id"], one["source_file"]), *verdict(), int(one["log_bytes"]))], columns=["session_id", "name", "status", "log", "log_bytes"])

    return rows.groupBy("session_id").applyInPandas(check, "session_id string, name string, status string, log binary, log_bytes long")


def materialize(entries: DataFrame, sessions: DataFrame, folder: str) -> DataFrame:
    """``validated`` logs as files -> session_id, file, status, log_bytes. A file appears whole or not at all, and an existing one is never overwritten (status ``exists``, unless it is the same).

    ``folder`` is a path or URI that executors share, of any file system that Arrow knows. Local files get their name by a link; elsewhere a file that is written is moved to a name that was free.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for sid, name, status, log, size in frame[["session_id", "name", "status", "log", "log_bytes"]].itertuples(index=False):
                path = f"{folder.rstrip('/')}/{name}"
                out.append((sid, path, _place(path, log) if status == "valid" else status, size))
            yield pd.DataFrame(out, columns=["session_id", "file", "status", "log_bytes"])

    return validated(entries, sessions).mapInPandas(write, _REPORT)


def _place(uri: str, log: bytes) -> str:
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"

    def there() -> str:
        with fs.open_input_stream(path) as f:
            return "restored" if f.readall() == log else "exists"

    with fs.open_output_stream(own, compression=None) as out:
        out.write(log)
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(own, path)  # fails if the name is taken, so nothing is overwritten
        except FileExistsError:
            return there()
        finally:
            os.unlink(own)
        return "restored"
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(own)
        return there()
    fs.move(own, path)
    return "restored"
