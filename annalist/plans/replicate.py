"""Scanned logs carried into a replica: planned, written in batches and completed, for any number of logs in one commit.

A log in conflict stops before its first offending batch and is marked; it holds up no other. What is written of a log, its checkpoint and its mark become visible together,
and a writer that started from an older replica fails with ``SnapshotConflict`` and plans again, so that a checkpoint never moves back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.sync import BATCH_BYTES, byte_batches, plan_sync
from annalist.operators.walks import durable
from annalist.plans.catalog import Catalog

STREAMS = (
    "log_id string, ordinal long, byte_offset long, prefix_hash string, entry_count long, log_hash string, log_bytes long, largest_entry_bytes long, has_final_newline boolean, "
    "conflicted boolean, conflict_class string, conflict_reason string, conflict_source_file string"
)
#: What an entry needs to be planned; its payload stays where it is until it is written.
_NARROW = ["log_id", "ordinal", "id", "payload_hash", "payload_bytes", "next_byte_offset", "prefix_hash"]
_POINT = ["ordinal", "byte_offset", "prefix_hash"]


def stopped(placed: DataFrame, stored: DataFrame | None) -> DataFrame:
    """log_id, stop: the first batch with an entry whose id has another payload, in the replica or else in the first new entry of that id in order of log and ordinal."""
    own = F.struct("payload_hash")
    first = placed.groupBy("id").agg(F.min_by(own, F.struct("log_id", "ordinal")).alias("_known"))
    if stored is not None:
        there = stored.join(placed.select("id").distinct(), "id", "left_semi").select("id", F.struct("payload_hash").alias("_stored"))
        first = first.join(there, "id", "left").select("id", F.coalesce("_stored", "_known").alias("_known"))
    return placed.join(first, "id").where(~own.eqNullSafe(F.col("_known"))).groupBy("log_id").agg(F.min("batch").alias("stop"))


def _marked(conflict: Column, reason: Column, semantic: Column, before: Column | None) -> list[Column]:
    """The columns of a conflict's mark: physical if the log does not fit the replica, semantic if its events contradict each other, else what ``before`` says."""
    keep = lambda c: F.lit(None) if before is None else before[c]
    return [
        F.when(conflict | semantic, True).otherwise(F.coalesce(keep("conflicted"), F.lit(False))).alias("conflicted"),
        F.when(conflict, "physical").when(semantic, "semantic").otherwise(keep("conflict_class")).cast("string").alias("conflict_class"),
        F.when(conflict, reason).otherwise(keep("conflict_reason")).cast("string").alias("conflict_reason"),
        F.when(conflict, F.col("source_file")).otherwise(keep("conflict_source_file")).cast("string").alias("conflict_source_file"),
    ]


def replicate(catalog: Catalog, logs: DataFrame, entries: DataFrame, limit: int = BATCH_BYTES, sessions: bool = False, clears: bool = True) -> DataFrame:
    """log_id, status, reason, entries_written, batches_written of each log, after the commit.

    logs(log_id, log_hash, entry_count, log_bytes, header_next_byte_offset, header_prefix_hash, largest_entry_bytes, has_final_newline, source_file; optional
    semantic_conflict; with ``sessions`` session_id), entries(log_id, id, ordinal, payload_hash, payload_bytes, next_byte_offset, prefix_hash, any more). Tables of the catalog: ``records``
    (entries by id, written once and never changed), ``members`` (log_id, ordinal, id), ``streams`` (a checkpoint and a mark of each log).

    Status: unchanged, mirrored, conflict (reason prefix-mismatch, checkpoint-out-of-range or payload-mismatch; nothing counts as written, though batches before the offending
    one stay), rejected (missing-source-session: with ``sessions``, the log's session is not in that table). ``sessions`` also raises memory_revision of each session whose logs
    were looked at. A log that fits again loses its mark; with ``clears`` false a mark stays. An empty table of logs changes nothing.
    """
    spark, base = catalog.spark, catalog.number()
    there = catalog.tables(base)
    rows = lambda name: catalog._rows(there[name]) if name in there else None
    stored = rows("streams") if "streams" in there else spark.createDataFrame([], STREAMS)
    if "semantic_conflict" not in logs.columns:
        logs = logs.withColumn("semantic_conflict", F.lit(False))
    logs = durable(logs.withColumn("log_id", F.col("log_id").cast("string")))
    entries = entries.withColumn("log_id", F.col("log_id").cast("string"))
    known = logs
    if sessions:
        known = logs.join(catalog._rows(there["sessions"]).select(F.col("id").alias("session_id")), "session_id", "left_semi")
    points = stored.select("log_id", *[F.col(c).alias(f"cp_{c}") for c in ("ordinal", "byte_offset", "prefix_hash", "log_hash", "entry_count")])
    plan, pending = plan_sync(known, entries.select(*_NARROW), points, "log_id")
    plan = durable(plan)
    placed = durable(byte_batches(pending.select(*_NARROW), ["log_id"], limit))
    stops = durable(stopped(placed, rows("records")))
    written = placed.join(stops, "log_id", "left").where("stop is null or batch < stop")
    last = written.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("_entries"), (F.max("batch") + 1).alias("_batches"),
        F.max_by(F.struct("ordinal", F.col("next_byte_offset").alias("byte_offset"), "prefix_hash"), "ordinal").alias("_last"),
    )
    facts = known.join(plan, "log_id").join(stops, "log_id", "left").join(last, "log_id", "left")
    facts = durable(facts.withColumn("reason", F.when(F.col("stop").isNotNull(), "payload-mismatch").otherwise(F.col("reason"))).drop("stop"))

    old = stored.select("log_id", F.struct(*[c for c in stored.columns if c != "log_id"]).alias("_old"))
    conflict, semantic = F.col("reason").isNotNull(), F.coalesce("semantic_conflict", F.lit(False))
    start = F.struct(F.lit(-1).cast("long").alias("ordinal"), F.col("header_next_byte_offset").alias("byte_offset"), F.col("header_prefix_hash").alias("prefix_hash"))
    now = F.col("_now")
    whole = lambda c: F.when(~conflict, F.col(c)).when(F.col("_last").isNull(), F.col("_old")[c]).alias(c)
    new = facts.join(old, "log_id", "left").withColumn("_now", F.coalesce("_last", F.when(F.col("_old.byte_offset").isNotNull(), F.struct(*[F.col("_old")[c].alias(c) for c in _POINT])), F.when(~conflict, start)))
    new = new.select(
        "log_id", *[now[c].alias(c) for c in _POINT], *[whole(c) for c in ("entry_count", "log_hash", "log_bytes", "largest_entry_bytes", "has_final_newline")],
        *_marked(conflict, F.col("reason"), ~conflict & semantic, None if clears else F.col("_old")),
    )
    places = written.select("log_id", "ordinal", "id")
    fresh = entries.join(places.select("log_id", "ordinal"), ["log_id", "ordinal"], "left_semi").drop("log_id", "ordinal").dropDuplicates(["id"])
    if "records" in there:
        fresh = fresh.join(rows("records").select("id"), "id", "left_anti")
    made = {
        "streams": catalog._written("streams", stored.join(facts.select("log_id"), "log_id", "left_anti").unionByName(new), there.get("streams")),
        "records": catalog.appended("records", fresh, there.get("records")), "members": catalog.appended("members", places, there.get("members")),
    }
    if sessions:
        touched = known.select(F.col("session_id").alias("id")).distinct()
        part, buckets = catalog._part("sessions", there["sessions"], touched, "id")
        raised = part.join(touched.withColumn("_touched", F.lit(1)), "id", "left").withColumn("memory_revision", F.coalesce("memory_revision", F.lit(0)) + F.coalesce("_touched", F.lit(0)))
        made["sessions"] = catalog._written("sessions", raised.select(*[F.col(c).cast(part.schema[c].dataType) for c in part.columns]), there["sessions"], buckets)
    catalog.commit(made, base)

    report = logs.select("log_id").join(facts.select("log_id", "status", "reason", "_entries", "_batches"), "log_id", "left")
    status = F.when(F.col("status").isNull(), "rejected").when(F.col("reason").isNotNull(), "conflict").when(F.col("status") == "pending", "mirrored").otherwise(F.col("status"))
    count = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    return report.select(
        "log_id", status.alias("status"), F.when(F.col("status").isNull(), "missing-source-session").otherwise(F.col("reason")).alias("reason"),
        F.coalesce(count("_entries"), F.lit(0)).cast("long").alias("entries_written"), F.coalesce(count("_batches"), F.lit(0)).cast("long").alias("batches_written"),
    )


def with_leaves(sessions: DataFrame, leaves: DataFrame) -> DataFrame:
    """Sessions (id, current_leaf_id, ...) whose leaf is the one that ``leaves`` (id, current_leaf_id) names, null too; the others keep theirs."""
    new = leaves.select("id", F.col("current_leaf_id").alias("_leaf"), F.lit(True).alias("_named"))
    leaf = F.when(F.col("_named"), F.col("_leaf")).otherwise(F.col("current_leaf_id"))
    return sessions.join(new, "id", "left").withColumn("current_leaf_id", leaf).select(*sessions.columns)
