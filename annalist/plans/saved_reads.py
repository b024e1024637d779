"""Saved runs as text: what a reader may see of them, with the evidence of one conclusion on demand. The wording is this engine's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import exprs as X


def _line(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _quoted_list(ids: Column) -> Column:
    return F.array_join(F.transform(ids, X.quoted), ", ")


def _provenance(conclusions: DataFrame, memories: DataFrame) -> DataFrame:
    """run_id, id, proof: a line for each memory that supports or contradicts a conclusion, supports first; a memory that the reader does not have is named only."""
    cite = lambda c, rank: conclusions.select("run_id", "id", F.lit(rank).alias("_rank"), F.posexplode(c).alias("_at", "memory"))
    cited = cite("supporting_memory_ids", "supported by").unionByName(cite("conflicting_memory_ids", "contradicted by"))
    m = memories.select(F.col("id").alias("memory"), "owner_id", "session_id", "producer", "kind", "content", "source_entries")
    entries = F.when(F.size("source_entries") > 0, _line(", citing ", F.array_join(F.transform(F.array_sort(F.array_distinct("source_entries")), lambda e: F.concat_ws("/", X.quoted(e["stream_id"]), X.quoted(e["entry_id"]))), ", "))).otherwise("")
    known = _line("    ", F.col("_rank"), " ", X.quoted("memory"), ": ", F.col("kind"), " of ", X.quoted("producer"), ", owner ", X.quoted("owner_id"), ", session ", X.quoted("session_id"), entries, "\n      ", X.quoted("content"))
    text = F.coalesce(known, _line("    ", F.col("_rank"), " ", X.quoted("memory"), ": not available"))
    return cited.join(m, "memory", "left").groupBy("run_id", "id").agg(F.array_sort(F.collect_list(F.struct((F.col("_rank") != "supported by").alias("b"), F.col("_at").alias("at"), text.alias("t")))).alias("proof"))


def rendered_runs(items: DataFrame, conclusions: DataFrame, links: DataFrame, memories: DataFrame, evidence: str | None = None) -> DataFrame:
    """position, status, text of each saved run, in order of position.

    items(position, id, name, filter_type, filter_value, depth, status, freshness, created_at, model; status of ``runs.run_status``), conclusions(run_id, position, id, content, category, basis, scope_type,
    scope_subject_ids, supporting_memory_ids, conflicting_memory_ids), links(from_id, to_id, relation), memories(id, owner_id, session_id, producer, kind, content, source_entries): readable ones.
    A run that is not available, or whose freshness is unavailable, shows its status alone: unauthorized, else unavailable. Links name both ends only if both conclusions belong to runs that are shown.
    ``evidence``: of the available runs only those with this conclusion, with it and its links alone, and with the text and origin of each memory that it cites.
    """
    shown = (F.col("status") == "available") & (F.coalesce("freshness", F.lit("unknown")) != "unavailable")
    items = items.withColumn("status", F.when(shown, "available").when(F.col("status") == "unauthorized", "unauthorized").otherwise("unavailable"))
    open_ = items.where("status = 'available'").select(F.col("id").alias("run_id"))
    mine = conclusions.join(open_, "run_id", "left_semi")
    ends = mine.select(F.col("id").alias("_end"), "run_id").distinct()
    if evidence is not None:
        mine, links = mine.where(F.col("id") == evidence), links.where((F.col("from_id") == evidence) | (F.col("to_id") == evidence))
    count = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))).cast("string")
    doubt = F.when(F.size("conflicting_memory_ids") > 0, " (there is evidence against it)").otherwise("")
    body = _line(
        "  ", X.quoted("id"), " [", F.col("basis"), ", ", F.col("category"), "] ", X.quoted("content"), "\n    about ", F.col("scope_type"), " ", _quoted_list(F.col("scope_subject_ids")),
        "; supports: ", count("supporting_memory_ids"), ", conflicts: ", count("conflicting_memory_ids"), doubt,
    )
    if evidence is not None:
        mine = mine.join(_provenance(mine, memories), ["run_id", "id"], "left")
        body = F.concat_ws("\n", body, F.transform("proof", lambda p: p["t"]))
    said = mine.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(F.col("position").alias("p"), body.alias("t")))).alias("said"))
    joined = links.join(ends.select(F.col("_end").alias("from_id"), "run_id"), "from_id").join(ends.select(F.col("_end").alias("to_id"), F.lit(True).alias("_known")).distinct(), "to_id", "left")
    relation = F.when(F.col("_known"), _line("  ", X.quoted("from_id"), " ", F.col("relation"), " ", X.quoted("to_id"))).otherwise("  a relation to a result that is not shown")
    told = joined.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("from_id", "to_id", relation.alias("t")))).alias("told"))
    rows = items.join(said, F.col("id") == said["run_id"], "left").drop("run_id").join(told, F.col("id") == told["run_id"], "left").drop("run_id")
    if evidence is not None:
        rows = rows.where("status <> 'available' or said is not null")
    sought = F.when(F.col("filter_value").isNotNull(), _line(" ", X.quoted("filter_value"))).otherwise("")
    head = _line(X.quoted("name"), " for ", F.col("filter_type"), sought, ", depth ", F.coalesce("depth", F.lit("full")), ", ", F.coalesce("freshness", F.lit("unknown")), "\n  run ", X.quoted("id"), " of ", X.quoted("created_at"), " by ", X.quoted("model"))
    texts = lambda c: F.transform(c, lambda x: x["t"])
    whole = F.concat_ws("\n", head, F.when(F.col("said").isNull(), "  no conclusions"), texts("said"), texts("told"))
    text = F.when(F.col("status") == "available", whole).otherwise(_line("a saved result that is ", F.col("status")))
    return rows.select("position", "status", text.alias("text")).orderBy("position")


def saved_text(rendered: DataFrame, more: bool = False, evidence: str | None = None) -> str:
    """A page of rendered runs as one text; pages of it by cursor are ``pages.page``'s."""
    found = [r.text for r in rendered.collect()]  # as many as a page of runs has
    if not found:
        return "No saved result with this conclusion." if evidence is not None else "No saved results."
    return "\n\n".join(found) + ("\n\nThere are more saved results." if more else "")
