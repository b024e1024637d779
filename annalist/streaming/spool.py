"""The memory spool as a stream: new notification files are validated, grouped by log, and handed to a drain; what waits too long is parked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from annalist.sources.spool import PARK_AFTER_MS, groups, memory_notifications

FILES = "path string, modificationTime timestamp, length long, content binary"
KEYS = ["source_kind", "source_session_id", "producer_id"]
STATE = "ids string, locator string"
OUT = "source_kind string, source_session_id string, producer_id string, locator string, ids array<string>, state string"


def read_spool(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Every notification once, when its file appears."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return memory_notifications(raw)


def drain(work: Callable[[dict], None], failed: Callable[[dict, Exception], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``work`` runs once for each log with its last notification; a group that fails is reported and stops no other.

    Groups are a micro-batch's distinct logs, taken one partition at a time in the order in which they were first queued.
    """

    def run(batch: DataFrame, _: int) -> None:
        for row in groups(batch.where("state = 'pending'"), KEYS, ["queued_at", "id"]).orderBy("first_place").toLocalIterator():
            try:
                work(row.asDict(recursive=True))
            except Exception as e:
                failed(row.asDict(recursive=True), e)

    return run


def waiting(notifications: DataFrame, sources: DataFrame, window_ms: int = PARK_AFTER_MS) -> DataFrame:
    """Streams of notifications and of sources that appeared (KEYS minus producer_id): a log's notifications are ``ready`` once its source is there, and
    ``parked`` if it does not come within ``window_ms`` of processing time."""
    from pyspark.sql import functions as F

    n = notifications.where("state = 'pending'").select(*KEYS, "id", "locator")
    s = sources.select(*KEYS, F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("locator"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        ids, locator = ([], None) if not kept.exists else (kept.get[0].split("\n"), kept.get[1])
        if kept.hasTimedOut:
            kept.remove()
            yield pd.DataFrame([(*key, locator, ids, "parked")], columns=[c.split()[0] for c in OUT.split(", ")])
            return
        there = False
        for frame in frames:
            there |= bool(frame["id"].isna().any())
            mine = frame.dropna(subset=["id"])
            ids = list(dict.fromkeys([*ids, *mine["id"]]))
            locator = mine["locator"].iloc[-1] if len(mine) else locator
        if there and ids:
            if kept.exists:
                kept.remove()
            yield pd.DataFrame([(*key, locator, ids, "ready")], columns=[c.split()[0] for c in OUT.split(", ")])
        elif ids:
            first = not kept.exists
            kept.update(("\n".join(ids), locator))
            if first:
                kept.setTimeoutDuration(window_ms)

    return n.unionByName(s).groupBy(*KEYS).applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
