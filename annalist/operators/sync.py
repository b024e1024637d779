"""Incremental planning: which entries of a log are new to a replica, and in which batches they go."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payload bytes of a batch.
BATCH_BYTES = 4 * 1024 * 1024


def byte_batches(entries: DataFrame, by: list[str], limit: int = BATCH_BYTES) -> DataFrame:
    """Adds batch: entries in order of ordinal, a new batch where the current one has rows and would exceed ``limit``.

    The greedy sum starts anew at each cut, so it is a fold over a log in order. A log is in one task, which passes over its sorted logs and holds an Arrow batch of rows at a time.
    """
    if limit <= 0:
        raise ValueError("the batch limit must be positive")

    def fold(parts):
        log, batch, size, rows = None, 0, 0, 0
        for part in parts:
            out = []
            for key, n in zip(part.column("_log").to_pylist(), part.column("payload_bytes").to_pylist(), strict=True):
                if key != log:
                    log, batch, size, rows = key, 0, 0, 0
                n = n or 0  # an unknown size counts as none
                if rows and size + n > limit:
                    batch, size, rows = batch + 1, 0, 0
                size, rows = size + n, rows + 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.int64())], names=[*part.schema.names[:-1], "batch"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema) + ", batch long"
    ordered = entries.repartition(*by).sortWithinPartitions(*by, "ordinal")
    return ordered.withColumn("_log", F.to_json(F.struct(*by))).mapInArrow(fold, schema)


def plan_sync(summaries: DataFrame, entries: DataFrame, checkpoints: DataFrame, key: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """(plan: key, status, reason; pending: entries to write).

    summaries(key, log_hash, entry_count, log_bytes, header_next_byte_offset, header_prefix_hash), entries(key, ordinal, next_byte_offset, prefix_hash, ...),
    checkpoints(key, cp_ordinal, cp_byte_offset, cp_prefix_hash, cp_log_hash, cp_entry_count). An unchanged log is recognised before its checkpoint is
    verified. A checkpoint whose entry is gone or lies elsewhere is ``checkpoint-out-of-range``, one whose prefix differs ``prefix-mismatch``.
    """
    at = entries.select(key, F.col("ordinal").alias("cp_ordinal"), F.col("next_byte_offset").alias("_offset"), F.col("prefix_hash").alias("_prefix"))
    rows = summaries.join(checkpoints, key, "left").join(at, [key, "cp_ordinal"], "left")
    first = F.coalesce(F.col("cp_ordinal"), F.lit(-1)) == -1
    known = F.col("cp_prefix_hash").isNotNull()
    prefix = F.when(first, F.col("header_prefix_hash")).otherwise(F.col("_prefix"))
    offset = F.when(first, F.col("header_next_byte_offset")).otherwise(F.col("_offset"))
    reason = (
        F.when(~known, None)
        .when(~first & F.col("_prefix").isNull(), "checkpoint-out-of-range")
        .when(F.col("cp_prefix_hash") != prefix, "prefix-mismatch")
        .when(F.col("cp_byte_offset") != offset, "checkpoint-out-of-range")
    )
    same = (F.col("cp_log_hash") == F.col("log_hash")) & (F.col("cp_entry_count") == F.col("entry_count"))
    rows = rows.withColumn("reason", F.when(F.coalesce(same, F.lit(False)), None).otherwise(reason))
    status = F.when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("reason").isNotNull(), "conflict").otherwise("pending")
    plan = rows.select(key, status.alias("status"), "reason", F.coalesce("cp_ordinal", F.lit(-1)).alias("_after"))
    pending = entries.join(plan.where("status = 'pending'").select(key, "_after"), key).where("ordinal > _after").drop("_after")
    return plan.drop("_after"), pending


def contiguous(ranges: DataFrame, key: str = "stream_id") -> DataFrame:
    """ranges(key, start_offset, end_offset) in any order -> key, ok: each byte range starts where the one before it ends."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("start_offset", "end_offset")
    gap = F.coalesce(F.col("start_offset") != F.lag("end_offset").over(w), F.lit(False))
    return ranges.select(key, gap.alias("gap")).groupBy(key).agg((~F.bool_or("gap")).alias("ok"))
