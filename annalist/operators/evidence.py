"""Which entries touched which files: tool calls, their results, and the repository that contains the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import exprs as X
from annalist.operators.containment import closest_root, relative_path

# Tools whose path argument names a file.
SESSION_TOOLS = ("read", "edit", "write")
TRANSCRIPT_TOOLS = ("Read", "Edit", "Write")

_SESSION_MESSAGE = "struct<message:struct<role:string,toolCallId:string,content:array<struct<type:string,id:string,name:string,arguments:struct<path:string>>>>>"
_BLOCKS = "array<struct<type:string,id:string,name:string,tool_use_id:string,input:struct<file_path:string>>>"
_TRANSCRIPT_MESSAGE = "struct<sourceToolAssistantUUID:string,message:struct<content:array<struct<type:string,id:string,name:string,tool_use_id:string,input:struct<file_path:string>>>>>"


def absolute_path(cwd: Column, path: Column) -> Column:
    """The path resolved against cwd (null: the root), without . and .. segments; null for a blank path."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.coalesce(cwd, F.lit("/")), F.lit("/"), path))
    segments = F.filter(F.split(full, "/"), lambda s: ~s.isin("", "."))
    # a .. takes the segment before it along; at the root there is none
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda out, s: F.when(s != "..", F.array_append(out, s)).when(F.size(out) > 0, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out))
    kept = F.when(full.contains(".."), kept).otherwise(segments)
    return F.when(F.trim(path) != "", F.concat(F.lit("/"), F.array_join(kept, "/")))


def origin_path_ok(path: Column) -> Column:
    """A normalised relative POSIX path that stays inside."""
    segments = F.split(path, "/")
    bad = F.exists(segments, lambda s: s.isin("", ".", ".."))
    return F.coalesce((F.trim(path) == path) & (path != "") & ~path.contains("\\") & ~path.rlike("^[A-Za-z]:/") & ~bad, F.lit(False))


def _may_hold(word: str) -> Column:
    """Whether a raw record may hold a word: as it is, or with an escaped letter. Most records hold neither, and are not parsed."""
    return F.col("raw_json").contains(word) | F.col("raw_json").contains("\\u00")


def session_tool_uses(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls: session_id, entry_id, ordinal, at, call_id, path; results: session_id, entry_id, call_id) of selected session entries."""
    m = F.from_json("raw_json", _SESSION_MESSAGE)["message"]
    # outer, for the inner form would parse again to see whether there is anything; blocks of other roles and types go right after
    content = entries.where(_may_hold("toolCall")).select("session_id", "entry_id", "ordinal", F.when(m["role"] == "assistant", m["content"]).alias("content"))
    blocks = content.select("session_id", "entry_id", "ordinal", F.posexplode_outer("content").alias("at", "b"))
    named = (F.col("b.type") == "toolCall") & F.col("b.id").isNotNull() & F.col("b.name").isin(*SESSION_TOOLS) & (F.trim("b.arguments.path") != "")
    calls = blocks.where(named).select("session_id", "entry_id", "ordinal", "at", F.col("b.id").alias("call_id"), F.col("b.arguments.path").alias("path"))
    # results carry a string or blocks as content; only their call matters
    r = F.from_json("raw_json", "struct<message:struct<role:string,toolCallId:string>>")["message"]
    results = entries.where(_may_hold("toolResult")).select("session_id", "entry_id", F.when(r["role"] == "toolResult", r["toolCallId"]).alias("call_id")).where("call_id is not null")
    return calls, results


def resolve(calls: DataFrame, worktrees: DataFrame, cwd: Column) -> DataFrame:
    """Adds the file of each call: worktrees(repository_id, root, commit, branch, dirty); the innermost root wins."""
    from annalist.operators.walks import durable

    # records are parsed once; each distinct path is resolved once, and a null folder is the root
    calls = durable(calls.withColumn("_cwd", F.coalesce(cwd, F.lit("/"))))
    full = calls.select("_cwd", "path").distinct().withColumn("absolute", absolute_path(F.col("_cwd"), F.col("path"))).where("absolute is not null")
    found = closest_root(full, worktrees, path="absolute", order=["repository_id"])
    found = found.withColumn("relative_path", relative_path(F.col("absolute"), F.col("root"))).withColumn("file_id", X.file_urn(F.col("repository_id"), F.col("relative_path")))
    return calls.join(durable(found), ["_cwd", "path"]).drop("_cwd")


def file_repositories(locators: DataFrame, worktrees: DataFrame, boundaries: DataFrame) -> DataFrame:
    """locators(cwd, path, ...) with absolute, root, repository_id and nested; a locator outside all roots keeps nulls.

    The innermost of worktrees(repository_id, root) covers a path, unless a directory between its root and the file holds a repository of its own, boundaries(directory):
    then repository_id is null, nested true and root that directory, which is to be looked up. A worktree's own root is no boundary to it.
    """
    full = locators.withColumn("absolute", absolute_path(F.col("cwd"), F.col("path")))
    roots = worktrees.select("root", "repository_id", F.lit(False).alias("nested")).unionByName(boundaries.select(F.col("directory").alias("root"), F.lit(None).cast("string").alias("repository_id"), F.lit(True).alias("nested")))
    found = closest_root(full.select("absolute").where("absolute is not null").distinct(), roots, path="absolute", order=["nested", "repository_id"])
    return full.join(found, "absolute", "left").select(*locators.columns, "absolute", "root", "repository_id", F.coalesce("nested", F.lit(False)).alias("nested"))


def session_evidence(entries: DataFrame, worktrees: DataFrame, cwd: Column) -> tuple[DataFrame, DataFrame]:
    """(files, touches) of session entries on the selected branch; of calls that share an id the last one names a result's file."""
    calls, results = session_tool_uses(entries)
    calls = resolve(calls, worktrees, cwd)
    place = ["file_id", "repository_id", "relative_path", "commit", "branch", "dirty"]
    last = calls.groupBy("session_id", "call_id").agg(F.max_by(F.struct(*place), F.struct("ordinal", "at")).alias("_l")).select("session_id", "call_id", "_l.*")
    hits = calls.select("session_id", "entry_id", *place, F.struct("ordinal", "at").alias("_o")).unionByName(
        results.join(last.select("session_id", "call_id", *place), ["session_id", "call_id"]).select("session_id", "entry_id", *place, F.struct(F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("at")).alias("_o"))
    )
    return _evidence(hits.withColumn("stream_id", F.lit("main")))


def _evidence(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    touches = hits.groupBy("session_id", "stream_id", "entry_id", "file_id").agg(F.max_by(F.struct("commit", "branch", F.coalesce("dirty", F.lit(False)).alias("dirty")), "_o").alias("b"))
    files = hits.select(F.col("file_id").alias("id"), "repository_id", "relative_path").distinct()
    return files, touches.select("session_id", "stream_id", "entry_id", "file_id", "b.*")


def transcript_evidence(entries: DataFrame, worktrees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, touches, diagnostics) of selected transcript entries: a result counts if exactly one call has its id and comes from the message it names."""
    v = F.from_json("raw_json", _TRANSCRIPT_MESSAGE)
    blocks = entries.select("session_id", "stream_id", "entry_id", "record_uuid", "ordinal", "cwd", v["sourceToolAssistantUUID"].alias("source"), F.posexplode(v["message"]["content"]).alias("at", "b"))
    named = (F.col("b.type") == "tool_use") & F.col("b.id").isNotNull() & F.col("b.name").isin(*TRANSCRIPT_TOOLS) & (F.trim("b.input.file_path") != "") & F.col("cwd").isNotNull()
    calls = blocks.where(named).select("session_id", "stream_id", "entry_id", "record_uuid", "ordinal", "at", "cwd", F.col("b.id").alias("call_id"), F.col("b.input.file_path").alias("path"))
    calls = resolve(calls, worktrees, F.col("cwd"))
    again = calls.groupBy("session_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("entry_id")).alias("entry_ids")).where("n > 1")
    diagnostics = again.select("session_id", F.lit("duplicate-tool-use-id").alias("reason"), F.col("call_id").alias("tool_use_id"), "entry_ids")
    place = ["file_id", "repository_id", "relative_path", "commit", "branch", "dirty"]
    results = blocks.where("b.type = 'tool_result' and b.tool_use_id is not null").select("session_id", "stream_id", "entry_id", F.col("b.tool_use_id").alias("call_id"), F.col("source").alias("record_uuid"))
    once = calls.groupBy("session_id", "call_id", "record_uuid").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*place)).alias("f")).where("n = 1").select("session_id", "call_id", "record_uuid", "f.*")
    hits = calls.select("session_id", "stream_id", "entry_id", *place, F.struct("ordinal", "at").alias("_o")).unionByName(
        results.join(once, ["session_id", "call_id", "record_uuid"]).select("session_id", "stream_id", "entry_id", *place, F.struct(F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("at")).alias("_o"))
    )
    files, touches = _evidence(hits)
    return files, touches, diagnostics


def selected_session_entries(entries: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Entries on the path from the current leaf (given by session, else the last entry) to the root."""
    from annalist.operators.walks import ancestors

    if leaves is None:
        leaves = entries.groupBy("session_id").agg(F.max_by("entry_id", "ordinal").alias("_leaf"))
    else:
        leaves = leaves.select("session_id", F.col("current_leaf_id").alias("_leaf"))
    marked = entries.join(leaves, "session_id").withColumn("is_leaf", F.coalesce(F.col("entry_id") == F.col("_leaf"), F.lit(False)))
    return entries.join(ancestors(marked).select("session_id", "entry_id"), ["session_id", "entry_id"], "left_semi")


def transcript_links(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the parent stream's records: nodes(session_id, node, up) by uuid, the parent before the logical parent; edges(session_id, node, to) from a record to those that are
    selected with it: from results to the message they name, between fragments of one request, and from calls to their results.

    A request is a node between its fragments, so that a request of n records has 2n edges and not n². ``r`` and ``q`` keep records and requests apart.
    """
    v = F.from_json("raw_json", _TRANSCRIPT_MESSAGE)
    ids = lambda kind, field: F.array_distinct(F.filter(F.transform(F.filter(F.coalesce(F.col("b"), F.array().cast(_BLOCKS)), lambda b: b["type"] == kind), lambda b: b[field]), lambda x: x.isNotNull() & (x != "")))
    main = entries.where("stream_id = 'main' and record_uuid is not null").withColumn("v", v).select("session_id", F.concat(F.lit("r"), "record_uuid").alias("node"), "parent_id", "logical_parent_id", "request_id", F.col("v.sourceToolAssistantUUID").alias("source"), F.col("v.message.content").alias("b"))
    said = lambda c: F.when(F.col(c) != "", F.concat(F.lit("r"), c))
    main = main.select("session_id", "node", F.coalesce(said("parent_id"), said("logical_parent_id")).alias("up"), "request_id", said("source").alias("source"), ids("tool_use", "id").alias("calls"), ids("tool_result", "tool_use_id").alias("results"))
    results = main.where(F.col("source").isNotNull() & (F.size("results") > 0))
    named = results.select("session_id", "node", F.col("source").alias("to")).join(main.select("session_id", F.col("node").alias("to")), ["session_id", "to"], "left_semi")
    part = main.where("request_id is not null").select("session_id", "node", F.concat(F.lit("q"), "request_id").alias("to"))
    made = main.select("session_id", "node", F.explode("calls").alias("call"))
    given = results.select("session_id", F.col("source").alias("node"), F.col("node").alias("to"), F.explode("results").alias("call"))
    answered = made.join(given, ["session_id", "node", "call"]).select("session_id", "node", "to")
    edges = named.select("session_id", "node", "to").unionByName(part).unionByName(part.select("session_id", F.col("to").alias("node"), F.col("node").alias("to"))).unionByName(answered)
    return main.select("session_id", "node", "up"), edges


def selected_transcript_entries(entries: DataFrame, leaves: DataFrame) -> DataFrame:
    """Selected records of the parent stream, and all records of subagent streams. leaves(session_id, current_leaf_id).

    Selected are the leaf's ancestry, and with a record the messages that its results name, the fragments of its request and the results of its calls, as long as that adds any. A session of any size
    is joined by keys of its records; of a session without a leaf nothing of the parent stream is selected."""
    from annalist.operators.walks import climb, durable, reachable

    nodes, edges = transcript_links(durable(entries.select("session_id", "stream_id", "record_uuid", "parent_id", "logical_parent_id", "request_id", "raw_json")))
    starts = leaves.where("current_leaf_id is not null").select("session_id", F.concat(F.lit("r"), "current_leaf_id").alias("node"))
    chosen = reachable(climb(nodes, starts), edges).where(F.col("node").startswith("r")).select("session_id", F.substr("node", F.lit(2)).alias("record_uuid"))
    main = entries.where("stream_id = 'main'").join(chosen, ["session_id", "record_uuid"], "left_semi")
    return main.select(*entries.columns).unionByName(entries.where("stream_id <> 'main'"))


def link_observations(observations: DataFrame, touches: DataFrame, by_stream: bool = True) -> DataFrame:
    """(id, file_id): files that an observation's citations touched. ``by_stream``: citations name a stream; the older form matches entries alone."""
    cited = observations.select(F.col("id").alias("observation_id"), "session_id", F.explode("source_entries").alias("s")).select("observation_id", "session_id", F.coalesce("s.stream_id", F.lit("main")).alias("stream_id"), F.col("s.entry_id").alias("entry_id"))
    on = ["session_id", "stream_id", "entry_id"] if by_stream else ["session_id", "entry_id"]
    return cited.join(touches.select(*on, "file_id"), on).select("observation_id", "file_id").distinct()
