"""Append-only logs as a data source: ranges of bytes cut at record ends, as a batch or as a stream.

A range holds the records whose newline lies in it; the reader looks back from the range's first newline for the beginning of that record. So any cut of a log gives
each record once and whole, whether the ranges are dealt to tasks of one batch or are what micro-batches find appended, and an
unfinished last line waits for its newline. Blank lines are records without a number.

As a batch, a first pass counts each range's records, and running sums over the ranges of a log give every record its ordinal in the second.
As a stream, an offset is the number of bytes of each file; ``streaming.logs`` numbers its records.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from annalist.functions.canonical import parse_json
from annalist.operators.walks import durable

#: Bytes of a range, of a read, of the first look back, and of the rows handed on at once.
SPLIT, CHUNK, BACK, HANDED = 64 << 20, 1 << 20, 1 << 12, 4 << 20
RECORDS = "path string, range_start long, ordinal long, byte_offset long, next_byte_offset long, type string, complete boolean, raw binary"
RANGES = "path string, range_start long, range_end long, records long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in schema.split(", "))])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def list_logs(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(URI, bytes) of each log below a folder, or of the one file, by URI."""
    fs, path = file_system(folder)
    info = fs.get_file_info(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
    scheme = folder[: folder.index("://") + 3] if "://" in folder else ""
    host = folder[len(scheme) : folder.index(path)] if scheme and path in folder else ""
    hidden = lambda x: any(p.startswith(("_", ".")) for p in x.path[len(path) :].split("/"))
    return sorted((f"{scheme}{host}{x.path}", x.size) for x in found if x.is_file and x.path.endswith(suffix) and (info.is_file or not hidden(x)))


def _line_start(f, at: int) -> bytes:
    """The bytes before ``at`` that belong to the same line."""
    parts, step = [], BACK
    while at > 0:
        step = min(step, at)
        f.seek(at - step)
        body = f.read(step)
        cut = body.rfind(b"\n")
        parts.append(body[cut + 1 :])
        if cut >= 0:
            break
        at, step = at - step, step * 2
    return b"".join(reversed(parts))


def range_records(f, start: int, end: int, tail: bool) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, bytes without the newline, whether a newline follows) of the records whose newline lies from start to before end, and with ``tail`` of the last line if it
    has none. At most one record and one read are held."""
    at, first, parts = start, True, []
    begin = start
    while at < end:
        f.seek(at)
        body = f.read(min(CHUNK, end - at))
        if not body:
            break
        lines = body.split(b"\n")
        for line in lines[:-1]:
            if first:
                head, first = _line_start(f, start), False
                begin, parts = start - len(head), [head, *parts]
            parts.append(line)
            raw = b"".join(parts)
            yield begin, raw, True
            begin, parts = begin + len(raw) + 1, []
        parts.append(lines[-1])
        at += len(body)
    if tail:
        if first and start < end:
            head = _line_start(f, start)
            begin, parts = start - len(head), [head, *parts]
        raw = b"".join(parts)
        if raw:
            yield begin, raw, False


def _type(raw: bytes) -> str | None:
    try:
        value = parse_json(raw.decode("utf-8", "replace"))
    except (ValueError, RecursionError):
        return None
    found = value.get("type") if isinstance(value, dict) else None
    return found if isinstance(found, str) else None


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, tail: bool, ordinal: int = 0):
        self.path, self.start, self.end, self.tail, self.ordinal = path, start, end, tail, ordinal


def _cuts(path: str, start: int, end: int, split: int, tail: bool) -> list[Range]:
    edges = [*range(start, end, split), end]
    return [Range(path, a, b, tail and b == end) for a, b in zip(edges, edges[1:], strict=False)]


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options):
        self.folder, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.split, self.types = int(options.get("splitBytes", SPLIT)), options.get("types", "true") == "true"
        self.kinds: tuple[str, ...] | None = None

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there is no log
            return
        fs, path = file_system(part.path)
        schema, rows, size, ordinal = _arrow(RECORDS), [], 0, part.ordinal
        # a string without escapes stands in JSON as it is, so a record without any wanted kind's bytes and without escapes is of another kind
        marks = None if self.kinds is None else [json.dumps(k, ensure_ascii=False).encode() for k in self.kinds]
        with fs.open_input_file(path) as f:
            for at, raw, complete in range_records(f, part.start, part.end, part.tail):
                number = None
                if raw.strip():
                    number, ordinal = ordinal, ordinal + 1
                if marks is not None and b"\\" not in raw and not any(m in raw for m in marks):
                    continue
                rows.append((part.path, part.start, number, at, at + len(raw) + complete, _type(raw) if self.types else None, complete, raw))
                size += 200 + len(raw)
                if size >= HANDED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class RangeReader(DataSourceReader):
    """How many records each range of each log has."""

    def __init__(self, options):
        self.reading = _Reading(options)

    def partitions(self):
        return [r for path, size in list_logs(self.reading.folder, self.reading.suffix) for r in _cuts(path, 0, size, self.reading.split, True)]

    def read(self, part: Range | None):
        if part is None:
            return
        fs, path = file_system(part.path)
        with fs.open_input_file(path) as f:
            n = sum(1 for _, raw, _ in range_records(f, part.start, part.end, part.tail) if raw.strip())
        yield (part.path, part.start, part.end, n)


class LogReader(_Reading, DataSourceReader):
    """The records of ranges that are listed, with their first ordinals, in a table."""

    def __init__(self, options):
        super().__init__(options)
        self.ranges = options["ranges"]

    def partitions(self):
        fs, path = file_system(self.ranges)
        return [Range(r["path"], r["range_start"], r["range_end"], r["tail"], r["first"]) for r in pads.dataset(path, filesystem=fs).to_table().to_pylist()]


class FilteringLogReader(LogReader):
    """A reader that takes filters may only be used where the session hands them on."""

    def pushFilters(self, filters):
        for f in filters:
            if f.__class__ in (EqualTo, In) and f.attribute == ("type",) and self.kinds is None:
                self.kinds = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
            yield f  # a record is only passed over if it cannot be of the kind, so Spark still judges


class TailReader(_Reading, DataSourceStreamReader):
    """What is appended to the logs of a folder. Offset: bytes of each file, by URI.

    ``maxBytes``: about how much a micro-batch may take (unlimited where a query is started anew, for its first one). A log that got shorter fails the query: it was not appended to.
    """

    def __init__(self, options):
        super().__init__(options)
        self.most = int(options.get("maxBytes", 0))
        self.upto: dict[str, int] | None = None

    def initialOffset(self):
        self.upto = {}
        return {}

    def latestOffset(self):
        have = dict(list_logs(self.folder, self.suffix))
        if self.most and self.upto is not None:
            left = self.most
            for path, size in have.items():
                begin = self.upto.get(path, 0)
                have[path] = begin + max(0, min(size - begin, left))
                left -= have[path] - begin
            have = {p: n for p, n in have.items() if n}
        return have

    def partitions(self, start, end):
        for path, n in start.items():
            if end.get(path, 0) < n:
                raise ValueError(f"{path} is shorter than it was")
        self.upto = dict(end)
        return [r for path, size in sorted(end.items()) for r in _cuts(path, start.get(path, 0), size, self.split, False)]


class LogSource(DataSource):
    """``spark.read.format("annalist_logs")`` and ``spark.readStream``. Options: path, suffix, splitBytes, mode (``ranges``: the ranges are what is read), ranges (the table of ranges of a batch), filters (whether the session hands filters on), types, maxBytes (stream)."""

    @classmethod
    def name(cls):
        return "annalist_logs"

    def schema(self):
        return RANGES if self.options.get("mode") == "ranges" else RECORDS

    def reader(self, schema):
        if self.options.get("mode") == "ranges":
            return RangeReader(self.options)
        return FilteringLogReader(self.options) if self.options.get("filters") == "true" else LogReader(self.options)

    def streamReader(self, schema):
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    try:
        spark.dataSource.register(LogSource)
    except AnalysisException as e:  # a session made from another one has its sources already
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def split_ranges(spark: SparkSession, folder: str, suffix: str = ".jsonl", split_bytes: int = SPLIT) -> DataFrame:
    """path, range_start, range_end, records, first (ordinal of the range's first record), tail (whether it ends the log), as a written table: one row a range."""
    register(spark)
    counted = spark.read.format("annalist_logs").options(mode="ranges", suffix=suffix, splitBytes=split_bytes).load(folder)
    before = Window.partitionBy("path").orderBy("range_start")
    first = F.coalesce(F.sum("records").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return durable(counted.select("*", first.alias("first"), F.lead("range_start").over(before).isNull().alias("tail")))


def split_records(spark: SparkSession, folder: str, suffix: str = ".jsonl", split_bytes: int = SPLIT, ranges: DataFrame | None = None, types: bool = True) -> DataFrame:
    """Records of all logs below a folder: path, range_start, ordinal (null for blank lines), byte_offset, next_byte_offset, type (of a JSON object), complete (a newline follows), raw.

    Logs are cut into ranges of ``split_bytes``, one a task, so a log of any size is read by many, and a task holds one record beside what it hands on. Filters on ``type`` (equality, IN) reach
    the reader where the session's ``spark.sql.python.filterPushdown.enabled`` is true; without ``types`` that column is null and no record is parsed. Files that grow meanwhile are read up to their size at the first pass. Empty files have no records.
    """
    ranges = split_ranges(spark, folder, suffix, split_bytes) if ranges is None else ranges
    table = ranges.inputFiles()
    where = table[0].rsplit("/", 1)[0] if table else None
    if where is None:
        return spark.createDataFrame([], RECORDS)
    return spark.read.format("annalist_logs").options(ranges=where, suffix=suffix, types=str(types).lower(), filters=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(folder)


def link(chain: str, payload_hash: str) -> str:
    """The next link of a log's chain of digests: it stands for all lines so far, and needs none of them again."""
    return hashlib.sha256((chain + payload_hash).encode()).hexdigest()


#: The chain in front of a log's first line.
CHAIN = hashlib.sha256(b"").hexdigest()


def with_prefix_hash(records: DataFrame) -> DataFrame:
    """Records of ``split_records`` with payload_hash, payload_bytes, prefix_hash (the SHA-256 of all bytes of the log up to the record's end) and chain_hash (``link`` over all lines).

    The prefix hash is the one thing that needs a log's bytes in order: a task reads them sorted, batch by batch, and holds only the running hash.
    """
    schema = records.withColumns({c: F.lit("") for c in ("payload_hash", "prefix_hash", "chain_hash")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, running, chain = None, None, CHAIN
        for batch in batches:
            out = []
            for p, raw, complete in zip(batch.column("path").to_pylist(), batch.column("raw").to_pylist(), batch.column("complete").to_pylist(), strict=True):
                if p != path:
                    path, running, chain = p, hashlib.sha256(), CHAIN
                running.update(raw)
                if complete:
                    running.update(b"\n")
                own = hashlib.sha256(raw).hexdigest()
                chain = link(chain, own)
                out.append((own, running.copy().hexdigest(), chain))
            more = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    hashed = records.repartition("path").sortWithinPartitions("path", "byte_offset").mapInArrow(run, schema)
    return hashed.withColumn("payload_bytes", F.octet_length("raw").cast("long"))


FIELDS = "path string, ordinal long, byte_offset long, next_byte_offset long, payload_bytes long, reason string, entry_id string, parent_id string, type string, role string, timestamp string, cwd string, parent_session string, raw_json string"


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a session log's record says by itself, or the first rule that it breaks; ordinal 0 is the header."""
    schema = _arrow(FIELDS)
    for batch in batches:
        out = []
        for r in batch.select(["path", "ordinal", "byte_offset", "next_byte_offset", "raw"]).to_pylist():
            raw = r.pop("raw")
            text = raw.decode("utf-8", "replace")
            r |= {"payload_bytes": len(raw), "raw_json": text}
            try:
                value = parse_json(text)
            except (ValueError, RecursionError):
                out.append(r | {"reason": "malformed-json"})
                continue
            if not isinstance(value, dict):
                out.append(r | {"reason": "not-an-object"})
                continue
            said = lambda v, k: v[k] if isinstance(v, dict) and isinstance(v.get(k), str) and v[k] else None
            message, parent = value.get("message"), value.get("parentId")
            r |= {"entry_id": said(value, "id"), "type": said(value, "type"), "role": said(message, "role"), "timestamp": said(value, "timestamp"), "cwd": said(value, "cwd"), "parent_session": said(value, "parentSession")}
            if r["ordinal"] == 0:
                if r["type"] != "session" or r["entry_id"] is None:
                    r["reason"] = "missing-session-header"
            elif r["type"] is None or r["entry_id"] is None:
                r["reason"] = "invalid-entry"
            elif "parentId" not in value or not (parent is None or isinstance(parent, str)):
                # an id that stands before is the rule in front of this one, and no record alone can tell
                r["reason"] = "invalid-parent"
            else:
                r["parent_id"] = parent
            out.append(r)
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def split_sessions(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, logs) of session logs from ``split_records``: the rules of ``framing.scan_session`` over logs that many tasks read.

    entries: path, session_id, ordinal (the header has none), entry_id, parent_id, type, role, timestamp, byte_offset, next_byte_offset, payload_bytes, raw_json; none of a log that breaks a rule.
    logs: path, session_id, cwd, parent_session, record_count, largest_record_bytes, last_entry_id, log_bytes, has_final_newline, error and error_ordinal (of the first broken rule).
    Repeated ids and unknown parents are found by joins on (path, id), so no task holds a log.
    """
    body = records.where("ordinal is not null")
    rows = durable(body.mapInArrow(_fields, FIELDS))
    entries = rows.where("ordinal > 0")
    first = entries.where("entry_id is not null").groupBy("path", "entry_id").agg(F.min("ordinal").alias("seen"))
    # rows without a parent meet nothing, each under a name of its own
    parent = F.coalesce(F.concat(F.lit("p"), "parent_id"), F.concat(F.lit("n"), F.col("ordinal").cast("string")))
    placed = entries.select("path", "ordinal", "entry_id", "parent_id", "reason", parent.alias("_parent")).join(first, ["path", "entry_id"], "left")
    placed = placed.join(first.select("path", F.concat(F.lit("p"), "entry_id").alias("_parent"), F.col("seen").alias("parent_seen")), ["path", "_parent"], "left")
    judged = placed.select(
        "path", "ordinal",
        F.when(F.col("reason").isNotNull() & (F.col("reason") != "invalid-parent"), F.col("reason"))
        .when(F.col("seen") < F.col("ordinal"), "duplicate-entry-id")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("parent_id").isNotNull() & (F.col("parent_seen").isNull() | (F.col("parent_seen") >= F.col("ordinal"))), "unknown-parent").alias("error"),
    )
    broken = judged.where("error is not null").unionByName(rows.where("ordinal = 0 and reason is not null").select("path", "ordinal", F.col("reason").alias("error")))
    errors = broken.groupBy("path").agg(F.min_by("error", "ordinal").alias("error"), F.min("ordinal").alias("error_ordinal"))
    ends = records.groupBy("path").agg(F.max("next_byte_offset").alias("log_bytes"), F.min("complete").alias("has_final_newline"))
    header = rows.where("ordinal = 0").select("path", F.col("entry_id").alias("session_id"), "cwd", "parent_session")
    told = rows.groupBy("path").agg(
        F.count(F.when(F.col("ordinal") > 0, 1)).alias("record_count"), F.max(F.when(F.col("ordinal") > 0, F.col("payload_bytes"))).alias("largest_record_bytes"),
        F.max_by(F.when(F.col("ordinal") > 0, F.col("entry_id")), "ordinal").alias("last_entry_id"),
    )
    logs = durable(ends.join(header, "path", "left").join(told, "path", "left").join(errors, "path", "left"))
    # a log without any record has no header either
    lacking = F.col("session_id").isNull() & F.col("error").isNull()
    logs = logs.withColumn("error", F.when(lacking, "missing-session-header").otherwise(F.col("error")))
    sound = logs.where("error is null").select("path", "session_id")
    kept = entries.select("path", (F.col("ordinal") - 1).alias("ordinal"), "entry_id", "parent_id", "type", "role", "timestamp", "byte_offset", "next_byte_offset", "payload_bytes", "raw_json")
    return kept.join(sound, "path"), logs
