"""Saved runs as tables: publication, reading with per-row status, repair of dependency edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.canonical import snapshot_json

RUN = "id string, derivation_id string, created_at string, depth string, run_json string, input_memory_ids array<string>, input_fingerprint string, configuration_fingerprint string, input_memory_count long, comparison_run_id string"
CONCLUSION = "id string, run_id string, content string, category string, basis string, scope_type string, scope_subject_ids array<string>, supporting_memory_ids array<string>, conflicting_memory_ids array<string>"
LINK = "from_id string, to_id string, relation string"


@dataclass
class RunTables:
    runs: DataFrame
    conclusions: DataFrame
    links: DataFrame
    used_memory: DataFrame  # run_id, memory_id, roles


def to_tables(spark: SparkSession, run: dict) -> RunTables:
    """One finished run (``derive.complete``) as rows; run_json is the authority."""
    k = lambda d, *names: tuple(d.get(n) for n in names)
    row = k(run, "id", "derivation-id", "created-at", "depth") + (snapshot_json(run),) + k(run, "input-memory-ids", "input-fingerprint", "configuration-fingerprint", "input-memory-count", "comparison-run-id")
    cs = [(c["id"], run["id"]) + k(c, "content", "category", "basis", "scope-type", "scope-subject-ids", "supporting-memory-ids", "conflicting-memory-ids") for c in run["conclusions"]]
    used = [(run["id"], m, sorted(run["dependency-roles"].get(m, []))) for m in run["input-memory-ids"]]
    return RunTables(spark.createDataFrame([row], RUN), spark.createDataFrame(cs, CONCLUSION), spark.createDataFrame([k(x, "from", "to", "relation") for x in run["links"]], LINK), spark.createDataFrame(used, "run_id string, memory_id string, roles array<string>"))


def dependency_edges(runs: DataFrame, memories: DataFrame) -> DataFrame:
    """used_memory rebuilt from the ids that runs state, for runs all of whose memories exist."""
    ids = runs.select(F.col("id").alias("run_id"), F.explode("input_memory_ids").alias("memory_id"))
    found = ids.join(memories.select(F.col("id").alias("memory_id"), F.lit(True).alias("_ok")), "memory_id", "left")
    whole = found.groupBy("run_id").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("ok")).where("ok")
    return found.join(whole, "run_id", "left_semi").select("run_id", "memory_id")


def run_status(runs: DataFrame, used: DataFrame, memories: DataFrame, reader_id: str, grants: DataFrame) -> DataFrame:
    """id, status for one reader: unresolved-evidence if a stated memory is gone or has no edge, unauthorized if one's owner grants the reader nothing, else available.

    Owners are counted: a memory with several owners or sessions is unresolved.
    """
    ids = runs.select("id", F.explode_outer("input_memory_ids").alias("memory_id"))
    edges = used.select(F.col("run_id").alias("id"), "memory_id", F.lit(True).alias("_edge")).distinct()
    owned = memories.groupBy(F.col("id").alias("memory_id")).agg(F.count_distinct("owner_id").alias("_owners"), F.count_distinct("session_id").alias("_sessions"), F.min("owner_id").alias("owner_id"))
    may = grants.where((F.col("permission") == "read") & (F.col("reader_id") == reader_id)).select("owner_id", F.lit(True).alias("_may")).distinct()
    facts = ids.join(edges, ["id", "memory_id"], "left").join(owned.join(may, "owner_id", "left"), "memory_id", "left")
    resolved = F.col("memory_id").isNull() | (F.coalesce("_edge", F.lit(False)) & (F.coalesce("_owners", F.lit(0)) == 1) & (F.coalesce("_sessions", F.lit(0)) == 1))
    allowed = F.col("owner_id").isNull() | (F.col("owner_id") == reader_id) | F.coalesce("_may", F.lit(False))
    whole = facts.groupBy("id").agg(F.bool_and(resolved).alias("whole"), F.bool_and(allowed).alias("allowed"))
    return whole.select("id", F.when(~F.col("whole"), "unresolved-evidence").when(~F.col("allowed"), "unauthorized").otherwise("available").alias("status"))


def read_runs(runs: DataFrame, limit: int, history: bool = False, name: str | None = None, derivations: DataFrame | None = None) -> tuple[list, bool]:
    """Newest runs first (ties by id), only each derivation's latest unless ``history``; and whether there are more."""
    if name is not None and derivations is not None:
        runs = runs.join(derivations.where(F.col("name") == name).select(F.col("id").alias("derivation_id")), "derivation_id", "left_semi")
    if not history:
        # a run without a time counts as the newest; of equal times the smallest id
        newest = runs.groupBy("derivation_id").agg(F.max(F.struct(F.col("created_at").isNull().alias("n"), F.col("created_at").alias("t"))).alias("m"))
        top = runs.join(newest, "derivation_id").where(F.col("created_at").eqNullSafe(F.col("m.t"))).groupBy("derivation_id").agg(F.min("id").alias("id"))
        runs = runs.join(top, ["derivation_id", "id"], "left_semi")
    found = runs.orderBy(F.desc_nulls_first("created_at"), "id").take(limit + 1)
    return found[:limit], len(found) > limit


def sessions_newest_first(sessions: DataFrame) -> DataFrame:
    """Sessions by creation, newest first; those without a time stand before all others, equal ones are in order of id."""
    return sessions.orderBy(F.desc_nulls_first("created_at"), "id")


def evidence_runs(runs: DataFrame, conclusions: DataFrame, memory_id: str) -> DataFrame:
    """Runs with a conclusion that a memory supports or contradicts; any run, not only the latest."""
    cited = conclusions.where(F.array_contains("supporting_memory_ids", memory_id) | F.array_contains("conflicting_memory_ids", memory_id))
    return runs.join(cited.select(F.col("run_id").alias("id")), "id", "left_semi")


def broken_links(runs: DataFrame, conclusions: DataFrame, links: DataFrame) -> DataFrame:
    """Ids of runs that cite memories outside their inputs, or whose links end nowhere."""
    ids = runs.select(F.col("id").alias("run_id"), "input_memory_ids")
    outside = conclusions.join(ids, "run_id").where(F.size(F.array_except(F.concat("supporting_memory_ids", "conflicting_memory_ids"), "input_memory_ids")) > 0).select("run_id")
    ends = links.join(conclusions.select(F.col("id").alias("from_id"), "run_id"), "from_id")
    nowhere = ends.join(conclusions.select(F.col("id").alias("to_id")), "to_id", "left_anti").select("run_id")
    return outside.union(nowhere).distinct()


@dataclass
class Lease:
    """A refresh lease: one token at a time, until it runs out."""

    token: str | None = None
    until_ms: int = 0

    def acquire(self, token: str, now_ms: int, length_ms: int) -> bool:
        if self.token is not None and self.until_ms > now_ms:
            return False
        self.token, self.until_ms = token, now_ms + length_ms
        return True

    def held(self, token: str, now_ms: int) -> bool:
        return self.token == token and self.until_ms > now_ms

    def renew(self, token: str, now_ms: int, length_ms: int) -> bool:
        if not self.held(token, now_ms):
            return False
        self.until_ms = now_ms + length_ms
        return True

    def release(self, token: str) -> bool:
        if self.token != token:
            return False
        self.token, self.until_ms = None, 0
        return True
