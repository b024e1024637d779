"""Drains on executors: groups of notifications are dealt to tasks, each gets its work done or not, and the outcomes say which notifications may go."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, wait

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.walks import durable
from annalist.sources.spool import PARK_AFTER_MS, drain_report, expire, groups

KEYS = ["source_kind", "source_session_id", "producer_id"]
OUTCOMES = "source_kind string, source_session_id string, producer_id string, ids array<string>, status string, detail string, notifications long"
#: Groups that a task works at on the same time, seconds that a group may take, and characters of a failure that are kept.
THREADS, SECONDS, DETAIL = 8, 60.0, 500


def _outcomes(work: Callable[[dict], str | None], threads: int, seconds: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(row: dict, f: Future | None) -> dict:
            if row["state"] != "pending":
                status, detail = ("expired" if row["state"] == "parked" else "waiting"), None
            elif f is None or not f.done():
                status, detail = "failed", f"no end within {seconds} s"
            elif f.exception() is not None:
                status, detail = "failed", f"{type(f.exception()).__name__}: {f.exception()}"[:DETAIL]
            else:
                status, detail = "ok", f.result()
            return {k: row[k] for k in KEYS} | {"ids": row["ids"], "status": status, "detail": detail, "notifications": len(row["ids"])}

        schema = pa.schema([*((k, pa.string()) for k in KEYS), ("ids", pa.list_(pa.string())), ("status", pa.string()), ("detail", pa.string()), ("notifications", pa.int64())])
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), threads):
                # as many threads as groups, so that each has its whole time and none waits for another's
                some = rows[i : i + threads]
                pool = ThreadPoolExecutor(threads)
                running = [pool.submit(work, r) if r["state"] == "pending" else None for r in some]
                wait([f for f in running if f is not None], timeout=seconds)
                pool.shutdown(wait=False, cancel_futures=True)
                yield pa.RecordBatch.from_pylist([told(r, f) for r, f in zip(some, running, strict=True)], schema=schema)

    return run


def worked(grouped: DataFrame, work: Callable[[dict], str | None], tasks: int | None = None, threads: int = THREADS, seconds: float = SECONDS) -> DataFrame:
    """grouped(KEYS, ids, state, ...: one row a group) -> an outcome row for each: ok with what ``work`` returned, failed, expired (parked) or waiting.

    ``work`` gets the group's row as a dict, on an executor, for pending groups alone. A failing group fails by itself; one that takes longer than ``seconds`` fails and its thread is left behind. A task that
    is run again does its groups again, so work has to bear that; the outcomes are written once, and everything after reads them there.
    """
    spark = grouped.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return durable(grouped.repartition(n, *KEYS).mapInArrow(_outcomes(work, threads, seconds), OUTCOMES))


def _delete(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))
        for batch in batches:
            names = [i for ids in batch.column("ids").to_pylist() for i in ids if i and "/" not in i and i not in (".", "..")]
            for i in names:
                with contextlib.suppress(FileNotFoundError):  # gone already is fine
                    fs.delete_file(f"{path}/{i}.json")
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], names=["gone"])

    return run


def settle(outcomes: DataFrame, folder: str) -> DataFrame:
    """Removes the notifications of groups whose work is done, from tasks, and gives the counters of ``drain_report``. What failed, waits or expired stays where it is; settling again changes nothing."""
    outcomes.where("status = 'ok'").select("ids").mapInArrow(_delete(folder), "gone long").agg(F.sum("gone")).collect()
    return drain_report(outcomes)


def drain_folder(notifications: DataFrame, work: Callable[[dict], str | None], folder: str, now_ms: int, window_ms: int = PARK_AFTER_MS, missing_sources: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(outcomes, counters) of one pass over a spool's valid notifications (``spool.memory_notifications``): one group a log, its last notification's fields and all its ids. With ``missing_sources``
    (source_kind, source_session_id) their groups wait, or are parked once their oldest notification is older than the window; without it nothing expires."""
    valid = notifications.where("state = 'pending'")
    grouped = groups(valid, KEYS, ["queued_at", "id"]).drop("state")
    if missing_sources is None:
        return (out := worked(grouped.withColumn("state", F.lit("pending")), work, **how)), settle(out, folder)
    gone = missing_sources.select("source_kind", "source_session_id", F.lit(True).alias("_missing")).distinct()
    parked = expire(valid, now_ms, window_ms, missing_sources).where("state = 'parked'").select(*KEYS, F.lit(True).alias("_parked")).distinct()
    marked = grouped.join(gone, ["source_kind", "source_session_id"], "left").join(parked, KEYS, "left")
    state = F.when(F.col("_parked"), "parked").when(F.col("_missing"), "waiting").otherwise("pending")
    out = worked(marked.withColumn("state", state).drop("_missing", "_parked"), work, **how)
    return out, settle(out, folder)
