"""Logs as they grow: each micro-batch reads what was appended, and a log's running count and digest are its state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from annalist.sources.log_source import CHAIN, SPLIT, link, register
from annalist.streaming.sidecar import keyed_state

NUMBERED = "path string, ordinal long, byte_offset long, next_byte_offset long, type string, payload_hash string, chain_hash string, raw binary"


def tail(spark: SparkSession, folder: str, suffix: str = ".jsonl", split_bytes: int = SPLIT, max_bytes: int = 0) -> DataFrame:
    """A stream of the records of all logs below a folder, from their first byte: path, range_start, byte_offset, next_byte_offset, type, complete, raw.

    A record comes when its newline has come, in the micro-batch that finds it; of bytes read before only those of its beginning are read again. Files that appear later are
    read from their start. ``max_bytes``: about how much a micro-batch may take (0: all there is)."""
    register(spark)
    stream = spark.readStream.format("annalist_logs").options(suffix=suffix, splitBytes=split_bytes, maxBytes=max_bytes).load(folder)
    return stream.drop("ordinal")


class LogNumbers(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "records long, upto long, chain string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, upto, chain = self.place.get() if self.place.exists() else (0, 0, CHAIN)
        frame = pd.concat(list(rows)).sort_values("byte_offset", kind="stable").drop_duplicates("byte_offset")
        out = []
        for r in frame[frame["byte_offset"] >= upto].itertuples(index=False):
            own = hashlib.sha256(r.raw).hexdigest()
            chain, upto = link(chain, own), r.next_byte_offset
            if r.raw.strip():
                out.append((r.path, n, r.byte_offset, r.next_byte_offset, r.type, own, chain, r.raw))
                n += 1
        self.place.update((n, int(upto), chain))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NUMBERED.split(", ")])

    def close(self) -> None:
        pass


def numbered_tail(stream: DataFrame) -> DataFrame:
    """Records of ``tail`` (blank lines left out) with ordinal, payload_hash and chain_hash, which stands for all lines of the log up to the record: what a full scan says of them
    (``log_source.with_prefix_hash``). The state of a log is three values; records at offsets that were taken are redeliveries and dropped."""
    keyed_state(stream.sparkSession)
    return stream.select("path", "byte_offset", "next_byte_offset", "type", "raw").groupBy("path").transformWithStateInPandas(LogNumbers(), NUMBERED, "append", "none")
