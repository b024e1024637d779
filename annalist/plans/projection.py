"""From scanned logs to the graph's tables: ids, entry trees, lineage, and the full replacement of a session's memories and evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import exprs as X
from annalist.operators.evidence import link_observations
from annalist.operators.memory import SESSION, Memories, capped, unresolved, with_urns
from annalist.plans.catalog import Catalog


def sessions_table(summaries: DataFrame, user: Column, kind: str) -> DataFrame:
    """Session rows of log summaries that scanned without error."""
    ok = summaries.where("error is null").withColumn("source_kind", F.lit(kind))
    return ok.select(
        X.session_urn(user, F.lit(kind), F.col("session_id")).alias("id"), X.user_urn(user).alias("user_id"), "source_kind", F.col("session_id").alias("source_session_id"), "header_json", "cwd", "created_at", "parent_session", "name",
        F.coalesce("current_leaf_id", "last_entry_id").alias("current_leaf_id"), F.col("path").alias("source_file"), F.col("record_count").alias("entry_count"), "log_hash", "log_bytes", "largest_record_bytes", "has_final_newline",
    )


def entries_table(entries: DataFrame, user: Column, kind: str) -> DataFrame:
    stream = F.coalesce("stream_id", F.lit("main"))
    return entries.withColumn("source_session_id", F.col("session_id")).withColumn("source_kind", F.lit(kind)).withColumns({
        "id": X.entry_urn(user, F.lit(kind), F.col("session_id"), F.col("entry_id")), "stream_id": stream, "session_id": X.session_urn(user, F.lit(kind), F.col("session_id")),
    })


def parent_edges(entries: DataFrame, column: str = "parent_id") -> DataFrame:
    """(child, parent) ids where the parent exists in the same stream."""
    up = entries.select("session_id", "stream_id", F.col("id").alias("child"), F.col(column).alias("entry_id")).where("entry_id is not null")
    return up.join(entries.select("session_id", "stream_id", "entry_id", F.col("id").alias("parent")), ["session_id", "stream_id", "entry_id"]).select("child", "parent")


def fork_edges(sessions: DataFrame) -> DataFrame:
    """(child, parent) of sessions whose header names another session of the same user and kind: its id, or the id of the log file it names. Whichever log arrives first."""
    by_file = F.element_at(F.split("source_file", "/"), -1)
    parents = sessions.select("user_id", "source_kind", F.col("id").alias("parent"), F.explode(F.array("source_session_id", by_file)).alias("named")).where("named is not null").distinct()
    children = sessions.select("user_id", "source_kind", F.col("id").alias("child"), F.element_at(F.split("parent_session", "/"), -1).alias("named")).where("named is not null")
    return children.join(parents, ["user_id", "source_kind", "named"]).where("child <> parent").select("child", "parent").distinct()


@dataclass
class Projection:
    observations: DataFrame
    reflections: DataFrame
    about: DataFrame
    sourced_from: DataFrame
    supported_by: DataFrame
    diagnostics: DataFrame


def project(memories: Memories, entries: DataFrame, touches: DataFrame, user: Column, by_stream: bool = True) -> Projection:
    """Memories of sessions with their edges: citations to entries, supports within one producer, files through evidence.

    entries(id, session_id, source_kind, source_session_id, stream_id, entry_id), touches(session_id, stream_id, entry_id, file_id).
    """
    place = lambda df: df.withColumn("session_id", X.session_urn(user, F.col("source_kind"), F.col("source_session_id")))
    o, r = place(with_urns(memories.observations, user, "observation")), place(with_urns(memories.reflections, user, "reflection"))
    cited = o.select(F.col("id").alias("observation_id"), *SESSION, F.explode("source_entries").alias("s")).select("observation_id", *SESSION, F.coalesce("s.stream_id", F.lit("main")).alias("stream_id"), F.col("s.entry_id").alias("entry_id"))
    sourced = cited.join(entries.select(*SESSION, "stream_id", "entry_id", F.col("id").alias("entry_urn")), [*SESSION, "stream_id", "entry_id"]).select("observation_id", "entry_urn").distinct()
    supports = r.select(F.col("id").alias("reflection_id"), *SESSION, "producer", F.explode("supporting_observation_ids").alias("memory_id"))
    supported = supports.join(o.select(*SESSION, "producer", "memory_id", F.col("id").alias("observation_id")), [*SESSION, "producer", "memory_id"]).select("reflection_id", "observation_id").distinct()
    lost = unresolved(o, r, entries).withColumns({"origin": F.lit(2), "ordinal": F.lit(0).cast("long"), "at": F.lit(0), "record_id": F.lit(None).cast("string"), "memory_kind": F.lit(None).cast("string")})
    notes = capped(memories.diagnostics.drop("nth").unionByName(lost.select(*[c for c in memories.diagnostics.columns if c != "nth"])))
    return Projection(o, r, link_observations(o, touches, by_stream), sourced, supported, notes)


def replace_projection(catalog: Catalog, p: Projection, sessions: DataFrame, evidence: tuple[DataFrame, DataFrame] | None = None, guard: Callable[[], bool] | None = None) -> dict[str, str]:
    """Everything that ``sessions`` (session_id) remember is replaced by the projection, in one commit; other sessions keep theirs. Ids are stable, so edges from elsewhere stay valid.

    evidence: (touches, diagnostics) of the sessions, replaced in the same commit; guard: checked just before it (``unchanged``).
    """
    scope = sessions.select("session_id").distinct()
    owned_o, owned_r = p.observations.select(F.col("id").alias("observation_id"), "session_id"), p.reflections.select(F.col("id").alias("reflection_id"), "session_id")
    tables = {
        "observations": p.observations, "reflections": p.reflections, "about": p.about.join(owned_o, "observation_id"),
        "sourced_from": p.sourced_from.join(owned_o, "observation_id"), "supported_by": p.supported_by.join(owned_r, "reflection_id"),
    }
    if evidence is not None:
        tables |= {"touches": evidence[0], "evidence_diagnostics": evidence[1]}
    return catalog.replace_all(tables, scope, ["session_id"], guard)


def unchanged(catalog: Catalog, expected: DataFrame) -> Callable[[], bool]:
    """A guard: the catalog's sessions still have the log hash, size and leaf that a projection was computed from. expected(id, log_hash, log_bytes, current_leaf_id)."""
    columns = ["id", "log_hash", "log_bytes", "current_leaf_id"]
    return lambda: expected.select(*columns).exceptAll(catalog.read("sessions").select(*columns)).isEmpty()


def import_status(local: DataFrame, stored: DataFrame) -> DataFrame:
    """local(id, log_hash, error), stored(id, log_hash, conflicted): full outer union of what is in files and in the replica."""
    both = local.select("id", F.col("log_hash").alias("_l"), F.col("error").alias("_e"), F.lit(True).alias("_local")).join(
        stored.select("id", F.col("log_hash").alias("_s"), F.coalesce("conflicted", F.lit(False)).alias("_c"), F.lit(True).alias("_stored")), "id", "full_outer"
    )
    status = F.when(F.col("_c"), "conflict").when(F.col("_e").isNotNull(), "malformed").when(F.col("_local").isNull(), "remote").when(F.col("_stored").isNull(), "local").otherwise("local+remote")
    return both.select("id", status.alias("status"))


def fill_missing(scanned: DataFrame, missing: DataFrame, mirrored: DataFrame) -> DataFrame:
    """Entries of streams whose files are gone, taken from the replica: missing(session_id, stream_id)."""
    kept = mirrored.join(missing.select("session_id", "stream_id"), ["session_id", "stream_id"], "left_semi")
    return scanned.unionByName(kept.select(*scanned.columns))
