"""WARC archives: a writer with revisit records, and a PySpark data source that reads them.

Records are gzip members whose extra field 'SL' holds the member's size, so the reader inflates just the header of a record it does
not want and steps to the next. The source plans a partition for each file, takes equality and IN predicates on header columns
(``record_type``, ``target_uri``, ``record_id``, ``payload_digest``, ``refers_to``), parses headers first, and decodes a payload only for
records that pass, of the types that option ``payload`` names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from annalist.llm.common import NULL_ID, cut, fresh_path, join_small, small_batches, table
from annalist.llm.files import attempt_name, open_new, resolve

#: Payloads of fewer bytes are always written whole.
LEAST = 1000
#: A file is closed beyond so many bytes.
FILE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, payload binary"
)
HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to")


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member that states its own size."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    stated = size if size < 1 << 32 else 0  # 0: not stated, and the reader inflates the member to find its end
    return (
        b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HII", 8, stated, len(record) & 0xFFFFFFFF)
        + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    )


def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _urn(page: int) -> str:
    return f"urn:page:{'null' if page == NULL_ID else page}"


def _write(folder: str, file_bytes: int):
    def run(batches):
        sink, name, at, n = None, None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    (sink, name), at, n = open_new(folder, attempt_name("pages", ".warc.gz")), 0, 0
                payload = row["text"].encode("utf-8", "surrogatepass")
                old = row["refers_to"]
                digest = hashlib.sha1(payload).hexdigest()
                body = member(record("response" if old is None else "revisit", _urn(row["doc_id"]), row["url"], digest, payload if old is None else b"", len(payload), None if old is None else _urn(old)))
                sink.write(body)
                at, n = at + len(body), n + 1
                if at >= file_bytes:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [at]})
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [at]})

    return run


def write_warc(pages: DataFrame, folder: str | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> str:
    """Write a record per row and return the folder; its ``_manifest.json`` names the files that count.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is written whole, and the others as revisits of it; shorter
    payloads are always whole. Null payloads are empty, a null url is left out, a null id comes back as null. Rows that repeat the
    largest id with an equal payload are all written whole. Extra columns are pruned; an empty table gives an empty archive.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("text"),
    ).withColumns({"digest": F.sha1("text"), "strong": F.sha2("text", 256), "size": F.octet_length("text")})  # fmt: skip  equal payloads have equal SHA-256, whatever their SHA-1
    again = cut(
        rows.where(F.col("size") >= least).groupBy("digest", "strong", "size").agg(F.max("doc_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "strong", "size", "largest"),
        "revisits",
    )
    marked = join_small(rows, again, ["digest", "strong", "size"])
    marked = marked.select("doc_id", "url", "text", F.when(F.col("largest") != F.col("doc_id"), F.col("largest")).alias("refers_to"))
    made = cut(marked.mapInArrow(_write(folder, file_bytes), "file string, records long, bytes long"), "warc-files")
    files = [[r.file.rpartition("/")[2], r.records] for r in made.toLocalIterator()]  # a name and a count per file
    fs, path = resolve(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/_manifest.json") as out:
        out.write(json.dumps(files).encode())
    return folder


class Records:
    """Records of one archive in turn, plain or gzipped by record: headers first, payload on demand."""

    def __init__(self, source):
        self.source, self.at, self.size = source, 0, source.size()

    def __iter__(self) -> Iterator[Record]:
        while self.at < self.size:
            head = self.source.read_at(min(4096, self.size - self.at), self.at)
            if head[:2] != b"\x1f\x8b":
                if head[:2] == b"\r\n":
                    self.at += 2
                    continue
                item = Plain(self, self.at)
            elif len(head) >= 24 and head[3] & 4 and head[12:14] == b"SL" and struct.unpack("<I", head[16:20])[0]:
                item = Zipped(self, self.at, head, struct.unpack("<I", head[16:20])[0])
            else:
                item = Zipped(self, self.at, head, None)
            yield item
            self.at = item.end()


class Record:
    def parse(self, text: bytes) -> dict[str, str]:
        lines = text.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Zipped(Record):
    def __init__(self, records: Records, at: int, head: bytes, size: int | None):
        self.source, self.at, self.limit, self.size = records.source, at, records.size, size
        self.inflate, self.text, self.fed = zlib.decompressobj(31), b"", 0
        self._feed(head[: size or len(head)])
        while b"\r\n\r\n" not in self.text and not self.inflate.eof:
            self._more()
        cut_ = self.text.index(b"\r\n\r\n")
        self.headers = self.parse(self.text[:cut_])
        self.block_at = cut_ + 4

    def _feed(self, data: bytes) -> None:
        self.fed += len(data)
        self.text += self.inflate.decompress(data)

    def _more(self, n: int = 1 << 16) -> None:
        stop = self.at + self.size if self.size else self.limit
        data = self.source.read_at(min(n, stop - self.at - self.fed), self.at + self.fed)
        if not data:
            raise ValueError("a record is cut off")
        self._feed(data)

    def block(self, n: int | None = None) -> bytes:
        whole = int(self.headers["content-length"])
        n = whole if n is None else min(n, whole)
        parts = [self.text]
        have = len(self.text)
        while have < self.block_at + n and not self.inflate.eof:
            self.text = b""
            self._more(1 << 20)
            parts.append(self.text)
            have += len(self.text)
        self.text = b"".join(parts)
        return self.text[self.block_at : self.block_at + n]

    def end(self) -> int:
        if self.size:
            return self.at + self.size
        while not self.inflate.eof:
            self.text = self.text[:0]
            self._more(1 << 20)
        return self.at + self.fed - len(self.inflate.unused_data)


class Plain(Record):
    def __init__(self, records: Records, at: int):
        self.source, text, n = records.source, b"", 4096
        while b"\r\n\r\n" not in text:
            more = self.source.read_at(min(n, records.size - at - len(text)), at + len(text))
            if not more:
                raise ValueError("a record is cut off")
            text += more
        cut_ = text.index(b"\r\n\r\n")
        self.headers = self.parse(text[:cut_])
        self.block_at = at + cut_ + 4
        self.length = int(self.headers["content-length"])

    def block(self, n: int | None = None) -> bytes:
        return self.source.read_at(self.length if n is None else min(n, self.length), self.block_at)

    def end(self) -> int:
        return self.block_at + self.length + 4


class FilePartition(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


def _bare(x: str | None) -> str | None:
    return x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x


def _hex(x: str | None) -> str | None:
    """A digest without its label, in hex: SHA-1 is often written in base32. Others stay as they are, in lower case."""
    if x is None:
        return None
    label, _, value = x.rpartition(":")
    if label.lower() in ("", "sha1", "sha-1") and re.fullmatch("[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return value.lower()


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.payload = [x for x in options.get("payload", "response,resource,revisit").split(",") if x]
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and name in HEADER_COLUMNS:
                self.wanted.append((name, (f.value,)))
            elif isinstance(f, In) and name in HEADER_COLUMNS:
                self.wanted.append((name, tuple(f.value)))
            else:
                yield f

    def partitions(self):
        fs, path = resolve(self.folder)
        try:
            with fs.open_input_file(f"{path}/_manifest.json") as source:
                names = [x[0] for x in json.loads(source.readall())]
        except FileNotFoundError:
            from pyarrow.fs import FileSelector

            names = sorted(x.base_name for x in fs.get_file_info(FileSelector(path)) if x.base_name.endswith((".warc", ".warc.gz")))
        return [FilePartition(f"{self.folder}/{n}") for n in names]

    def read(self, partition):
        if partition is None:
            return
        fs, path = resolve(partition.file)
        kind = pa.schema([(n, pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string()) for n in (x.split()[0] for x in SCHEMA.split(", "))])
        rows, size = [], 0
        with fs.open_input_file(path) as source:
            for item in Records(source):
                h = item.headers
                row = {
                    "record_type": h.get("warc-type"), "record_id": _bare(h.get("warc-record-id")), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
                    "payload_digest": _hex(h.get("warc-payload-digest")), "refers_to": _bare(h.get("warc-refers-to")), "payload_length": None, "payload": None,
                }
                if not all(row[name] in values for name, values in self.wanted):
                    continue
                if h.get("content-type", "").startswith("application/http"):
                    want = row["record_type"] in self.payload
                    block, n = item.block(None if want else 4096), 4096
                    while not want and b"\r\n\r\n" not in block and len(block) == n:  # headers may be of any length
                        n *= 4
                        block = item.block(n)
                    top, _, body = block.partition(b"\r\n\r\n")
                    length = next((int(x.partition(b":")[2]) for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    row["payload_length"] = length
                    row["payload"] = body if want else None
                elif row["record_type"] in self.payload:
                    row["payload"] = item.block()
                    row["payload_length"] = len(row["payload"])
                rows.append(row)
                size += 200 + len(row["payload"] or b"")
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``. Options: payload (record types whose payload is decoded; empty: none)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, folder: str, payload: str = "response") -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_warc(spark, write_warc(table(spark, sf_dir, "pages")), payload="response")
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    whole = F.col("record_type") == "response"
    return found.where(F.col("record_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
r AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""
