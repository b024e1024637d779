"""Event logs as a stream: the fold of ``operators.sidecar`` with its state kept by log and by event.

A log's state is a map from event id to hash, and one value: last ordinal, last accepted checkpoint, latch. An event touches its own entry
of the map alone, so what a micro-batch writes follows its events and not the log's history.

Physical order is the only authority (never timestamps), so there is no watermark: rows of a log are taken in order of ordinal within a micro-batch, and
an ordinal at or below the last one taken is a redelivery and dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from annalist.operators.sidecar import SEMANTICS, Locator, State, inspect

KEYS = ["source_kind", "source_session_id", "producer_id"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State by event needs the RocksDB provider; it is the session's to choose, before the stream starts."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")


class _Known:
    """The hashes of a log's events as ``State`` uses them, in the state store."""

    def __init__(self, kept: MapState):
        self.kept = kept

    def get(self, event_id: str) -> str | None:
        return self.kept.getValue((event_id,))[0] if self.kept.containsKey((event_id,)) else None

    def __setitem__(self, event_id: str, value: str) -> None:
        self.kept.updateValue((event_id,), (value,))


class EventLog(StatefulProcessor):
    """One log's records, a micro-batch at a time. ``ttl_ms``: how long an event id is remembered after it was taken (none: for ever); an id that comes again later is a new event."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getMapState("hashes", "event_id string", "event_hash string", self.ttl_ms)
        self.place = handle.getValueState("place", "last long, checkpoint string, conflict string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, checkpoint, conflict = self.place.get() if self.place.exists() else (-1, "null", None)
        state, locator, out = State(_Known(self.hashes), json.loads(checkpoint), conflict), Locator(*key), []
        frame = pd.concat(list(rows)).sort_values("ordinal", kind="stable").drop_duplicates("ordinal")
        frame = frame[frame["ordinal"] > last]
        for ordinal, raw in zip(frame["ordinal"], frame["raw_json"], strict=True):
            e = state.apply(inspect(raw, locator))
            out.append((*key, int(ordinal), e["status"], e["diagnostics"], e.get("event_id"), e.get("event_hash"), e.get("kind"), raw))
            last = int(ordinal)
        if out:
            self.place.update((last, json.dumps(state.checkpoint), state.conflict))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEMANTICS.split(", ")])

    def close(self) -> None:
        pass


def classify_stream(records: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming twin of ``operators.sidecar.classify``: records(source_kind, source_session_id, producer_id, ordinal, raw_json). ``ttl_ms`` bounds the state of logs whose
    ids are known not to come again after that time of processing; without it a stream answers as the batch does."""
    keyed_state(records.sparkSession)
    rows = records.select(*KEYS, "ordinal", "raw_json")
    return rows.groupBy(*KEYS).transformWithStateInPandas(EventLog(ttl_ms), SEMANTICS, "append", "none" if ttl_ms is None else "processingTime")


def commit_each(catalog, name: str, keys: list[str], payload: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: insert rows whose key is new; a batch that is delivered again changes nothing, a known key with another payload fails the query."""

    def commit(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        try:
            if not rows.isEmpty():
                catalog.insert_new(name, rows, keys, payload)
        finally:
            rows.unpersist()

    return commit
