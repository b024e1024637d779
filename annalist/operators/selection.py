"""Input selection of a derivation: authorised, not dropped, filtered, by depth; supports expanded; roles accumulated."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import exprs as X
from annalist.operators.access import readable

DEPTHS = ("full", "active", "observations", "reflections")


class SelectionError(ValueError):
    """``code``: invalid-memory, unresolved-evidence, unauthorized or invalid-selector."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def union_roles(tagged: dict[str, DataFrame], key: str) -> DataFrame:
    """key, roles: which of the sets hold the key, sorted."""
    parts = [df.select(key, F.lit(role).alias("role")) for role, df in tagged.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(X.distinct_sorted("role").alias("roles"))


def filter_predicate(kind: str = "none", value: str | None = None) -> Column:
    """Selector over memory rows with session_id, repository_origins and linked_paths."""
    if kind == "none":
        return F.lit(True)
    if kind == "session":
        return F.col("session_id") == value
    if kind == "repository":
        return F.coalesce(F.exists("repository_origins", lambda o: F.coalesce(X.normalize_origin(o) == X.normalize_origin(F.lit(value)), F.lit(False))), F.lit(False))
    if kind == "language":
        return F.coalesce(F.exists("linked_paths", lambda p: X.in_language(p, value)), F.lit(False))
    raise SelectionError("invalid-selector", f"unknown filter {kind}")


def depth_predicate(depth: str) -> Column:
    if depth not in DEPTHS:
        raise SelectionError("invalid-selector", f"unknown depth {depth}")
    return {"observations": F.col("kind") == "observation", "reflections": F.col("kind") == "reflection"}.get(depth, F.lit(True))


def visible(depth: str) -> Column:
    """Which selected rows are shown as evidence; the others are dependencies of authorisation and freshness only."""
    shown = F.array_contains("roles", "evidence")
    return shown | F.array_contains("roles", "historical-support") if depth == "full" else shown


@dataclass
class Selection:
    memories: DataFrame  # the rows, with roles
    candidates: DataFrame  # id
    comparison_available: bool | None


def select_input(memories: DataFrame, reader_id: str, grants: DataFrame, filter_kind: str = "none", filter_value: str | None = None, depth: str = "full", comparison_ids: DataFrame | None = None) -> Selection:
    """memories(id, owner_id, session_id, kind, dropped, supporting_memory_ids, repository_origins, linked_paths, ...).

    Raises SelectionError for repeated ids, supports that are missing or not observations, or supports of other owners that grant nothing. A comparison run
    whose inputs (``comparison_ids``: id) are not all readable is left out.
    """
    if not memories.groupBy("id").count().where("count > 1").isEmpty():
        raise SelectionError("invalid-memory", "memory identities must be unique")
    allowed = readable(memories, reader_id, grants)
    dropped = (F.col("kind") == "observation") & F.coalesce(F.col("dropped"), F.lit(False))
    candidates = allowed.where(~dropped & filter_predicate(filter_kind, filter_value) & depth_predicate(depth))
    cited = candidates.where("kind = 'reflection'").select("id", F.explode_outer("supporting_memory_ids").alias("support"))
    state = memories.select(F.col("id").alias("support"), F.col("kind").alias("_kind")).join(allowed.select(F.col("id").alias("support"), F.lit(True).alias("_ok")), "support", "left")
    checked = cited.join(state, "support", "left").agg(
        F.bool_or(F.col("_kind").isNull()).alias("missing"),
        F.bool_or(F.col("_kind").isNotNull() & F.col("_ok").isNull()).alias("forbidden"),
        F.bool_or(F.col("_kind") != "observation").alias("kind"),
    ).first()
    for bad, code, text in ((checked.missing, "unresolved-evidence", "a memory dependency is missing"), (checked.forbidden, "unauthorized", "a memory dependency is not authorized"), (checked.kind, "unresolved-evidence", "reflections must cite observations")):
        if bad:
            raise SelectionError(code, text)
    tagged = {"evidence": candidates.select("id"), "historical-support": cited.select(F.col("support").alias("id"))}
    available = None
    if comparison_ids is not None:
        available = comparison_ids.join(allowed, "id", "left_anti").isEmpty()
        if available:
            tagged["comparison-dependency"] = comparison_ids.select("id")
    return Selection(memories.join(union_roles(tagged, "id"), "id"), candidates.select("id"), available)


def occasion_counts(conclusions: DataFrame, memories: DataFrame) -> DataFrame:
    """conclusions(id, supporting_memory_ids), memories(id, kind, supporting_memory_ids, source_occasions) -> id, occasions: distinct verified occasions
    behind the supports; the owner is not part of an occasion, and reflections count through their observations."""
    cited = conclusions.select("id", F.explode("supporting_memory_ids").alias("memory"))
    m = memories.select(F.col("id").alias("memory"), "kind", F.col("supporting_memory_ids").alias("via"))
    cited = cited.join(m, "memory").select("id", F.explode(F.when(F.col("kind") == "reflection", F.col("via")).otherwise(F.array("memory"))).alias("memory"))
    seen = cited.join(memories.select(F.col("id").alias("memory"), "source_occasions"), "memory").select("id", F.explode("source_occasions").alias("o"))
    native = F.regexp_extract("o.session_id", r"^urn:[^:\s]+:session:[^:\s]+:([^:\s]+:[^\s]+)$", 1)
    counted = seen.where(native != "").groupBy("id").agg(F.count_distinct(native, F.col("o.stream_id"), F.col("o.entry_id")).alias("occasions"))
    return conclusions.select("id").join(counted, "id", "left").select("id", F.coalesce("occasions", F.lit(0)).alias("occasions"))
