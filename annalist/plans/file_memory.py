"""The flagship query: what is remembered about a file, for one user, with provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import exprs as X
from annalist.operators.evidence import origin_path_ok

ORDER = ["kind", "memory_id", "producer", "source_kind", "source_session_id"]


@dataclass
class Graph:
    """Tables keyed by URN; columns as in the catalog's schemas."""

    sessions: DataFrame  # id, user_id, source_kind, source_session_id
    observations: DataFrame  # id, session_id, memory_id, producer, content, timestamp, relevance, dropped
    reflections: DataFrame  # id, session_id, memory_id, producer, content
    about: DataFrame  # observation_id, file_id
    supported_by: DataFrame  # reflection_id, observation_id
    sourced_from: DataFrame  # observation_id, entry_urn
    entries: DataFrame  # id, entry_id, stream_id
    touches: DataFrame  # entry_urn, file_id, commit, branch, dirty
    files: DataFrame  # id, repository_id, relative_path


class QueryError(ValueError):
    """``code``: missing-path, invalid-origin, invalid-origin-path, repository-not-found or path-outside-repository."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _sources(g: Graph) -> DataFrame:
    """entry_urn, observation_id, entry_id, stream_id: the entries that observations cite."""
    return g.sourced_from.join(g.entries.select(F.col("id").alias("entry_urn"), "entry_id", F.coalesce("stream_id", F.lit("main")).alias("stream_id")), "entry_urn")


def _touched(g: Graph) -> DataFrame:
    return g.touches.where("commit is not null").select("entry_urn", "file_id", "commit", "branch", F.coalesce("dirty", F.lit(False)).alias("dirty"))


def _contexts(hits: DataFrame, src: DataFrame, touched: DataFrame) -> DataFrame:
    """hits(observation_id, file_id) -> and contexts: what the cited entries touched of the same file."""
    seen = hits.join(src, "observation_id").join(touched, ["entry_urn", "file_id"])
    return seen.groupBy("observation_id", "file_id").agg(F.array_sort(F.collect_set(F.struct("stream_id", "entry_id", "commit", "branch", "dirty"))).alias("contexts"))


def _provenance(pairs: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame]:
    """pairs(observation_id, file_id, more) -> observation_id, entry_ids, source_entries: what observations cite; and observation_id, file_id, contexts: what these entries touched of the same file.

    The lists are distinct and sorted. What an observation cites is the same for all its files, so it is gathered once an observation; entries meet files only where a file was touched at all.
    """
    src = _sources(g).join(pairs.select("observation_id").distinct(), "observation_id", "left_semi")
    cited = src.groupBy("observation_id").agg(F.array_sort(F.collect_set("entry_id")).alias("entry_ids"), F.array_sort(F.collect_set(F.struct("stream_id", "entry_id"))).alias("source_entries"))
    touched = _touched(g)
    hits = pairs.select("observation_id", "file_id").distinct().join(touched.select("file_id").distinct(), "file_id", "left_semi")
    return cited, _contexts(hits, src, touched)


def file_memory(g: Graph, user_id: str, repository_id: str, path: str, limit: int = 20) -> DataFrame:
    """Active observations about the file and reflections supported by any observation about it (dropped ones too), of the user's own sessions.

    Dropped observations are removed before ordering and the limit. Ordered by kind, memory_id, producer, source kind and session.
    """
    file = g.files.where((F.col("repository_id") == repository_id) & (F.col("relative_path") == path)).select(F.col("id").alias("file_id")).limit(1)  # one row by key
    mine = g.sessions.where(F.col("user_id") == user_id).select(F.col("id").alias("session_id"), "source_kind", "source_session_id")
    about = g.about.join(F.broadcast(file), "file_id").select("observation_id", "file_id").distinct()
    o = g.observations.where(~F.coalesce("dropped", F.lit(False))).join(mine, "session_id")
    obs = about.join(o.withColumnRenamed("id", "observation_id"), "observation_id")
    obs = obs.select(F.lit("observation").alias("kind"), F.col("observation_id").alias("id"), "observation_id", "file_id", "memory_id", "producer", "content", "timestamp", "relevance", "source_kind", "source_session_id")
    r = g.reflections.join(mine, "session_id").withColumnRenamed("id", "reflection_id")
    ref = g.supported_by.select("reflection_id", "observation_id").distinct().join(about, "observation_id").join(r, "reflection_id")
    none = F.lit(None).cast("string")
    ref = ref.select(F.lit("reflection").alias("kind"), F.col("reflection_id").alias("id"), "observation_id", "file_id", "memory_id", "producer", "content", none.alias("timestamp"), none.alias("relevance"), "source_kind", "source_session_id")
    rows = obs.unionByName(ref)
    cited, contexts = _provenance(rows, g)
    joined = rows.join(cited, "observation_id", "left").join(contexts, ["observation_id", "file_id"], "left")
    keys = ["kind", "id", "memory_id", "producer", "content", "timestamp", "relevance", "source_kind", "source_session_id"]
    merged = joined.groupBy(*keys).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("entry_ids", "source_entries", "contexts")])
    return merged.orderBy(*ORDER, "id").limit(limit)


def probe(rows: DataFrame, shown: int) -> tuple[DataFrame, bool]:
    """A page of a result that was asked for one row more, and whether it was cut."""
    found = rows.take(shown + 1)
    page = rows.sparkSession.createDataFrame(found[:shown], rows.schema)
    return page, len(found) > shown


def query_file(g: Graph, repositories: DataFrame, user_id: str, path: str | None, origin: str | None = None, worktree: tuple[str, str] | None = None, limit: int = 20) -> DataFrame:
    """The query as a user asks it: by origin and relative path, or by a path inside a worktree (repository id, root). Errors are typed."""
    import posixpath

    if not path or not path.strip():
        raise QueryError("missing-path")
    spark = repositories.sparkSession
    if origin is not None:
        name, ok = spark.range(1).select(X.normalize_origin(F.lit(origin)), origin_path_ok(F.lit(path.strip()))).first()
        if name is None:
            raise QueryError("invalid-origin")
        if not ok:
            raise QueryError("invalid-origin-path")
        found = repositories.where(F.col("normalized_origin") == name).select("id").take(1)
        if not found:
            raise QueryError("repository-not-found")
        return file_memory(g, user_id, found[0].id, path.strip(), limit)
    if worktree is None:
        raise QueryError("repository-not-found")
    repository, root = worktree
    full = posixpath.normpath(posixpath.join(root, path))
    relative = posixpath.relpath(full, root)
    if relative in (".", "..") or relative.startswith("../"):
        raise QueryError("path-outside-repository")
    return file_memory(g, user_id, repository, relative, limit)


def rendered(rows: DataFrame, content_limit: int = 500) -> DataFrame:
    """Adds text: one line per memory with its state, source and the distinct contexts it was seen in."""
    context = F.transform(
        "contexts",
        lambda c: F.concat(c["stream_id"], F.lit(" · "), F.coalesce(c["branch"], F.lit("detached")), F.lit(" @ "), F.substring(c["commit"], 1, 7), F.when(c["dirty"], F.lit(" (dirty)")).otherwise(F.lit(""))),
    )
    seen = F.array_join(F.array_distinct(context), "; ")
    line: Column = F.concat(
        F.lit("["), F.col("kind"), F.lit(" "), F.col("memory_id"), F.lit("] "), X.compact("content", content_limit),
        F.when(F.size("entry_ids") > 0, F.concat(F.lit(" | entries: "), F.array_join("entry_ids", ", "))).otherwise(F.lit("")),
        F.when(seen != "", F.concat(F.lit(" | "), seen)).otherwise(F.lit("")),
    )
    return rows.withColumn("text", line)
