"""The corpus that a derivation may read: every memory of the reader and of owners that grant it read, with its evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import exprs as X
from annalist.operators.access import readable
from annalist.operators.selection import SelectionError
from annalist.operators.walks import durable

#: Fixed value: the producer that a session's memories have when they name none.
DEFAULT_PRODUCER = "pi-observational-memory"


@dataclass
class Tables:
    """Of the catalog; ids are URNs."""

    memories: DataFrame  # id, kind, owner_id, session_id, source_kind, source_session_id, producer, memory_id, content, dropped, supporting_observation_ids, more
    sourced_from: DataFrame  # observation_id, session_id, stream_id, entry_id
    supported_by: DataFrame  # reflection_id, observation_id
    about: DataFrame  # observation_id, file_id
    files: DataFrame  # id, repository_id, relative_path
    repositories: DataFrame  # id, normalized_origin
    worked_on: DataFrame  # session_id, repository_id


def supports(mine: DataFrame, t: Tables) -> DataFrame:
    """id, supporting_memory_ids, ok of reflections: ok if their edges lead, one to one, to the observations they declare, of the same session and producer."""
    r = mine.where("kind = 'reflection'").select("id", "session_id", "producer", F.coalesce("supporting_observation_ids", F.array().cast("array<string>")).alias("declared"))
    edges = t.supported_by.select(F.col("reflection_id").alias("id"), F.col("observation_id").alias("support")).distinct().join(r.select("id"), "id", "left_semi")
    home = t.memories.withColumnRenamed("id", "support").join(edges.select("support"), "support", "left_semi").groupBy("support")
    home = home.agg(F.min("session_id").alias("_low"), F.max("session_id").alias("_high"), F.min("source_kind").alias("_kind"), F.min("producer").alias("_producer"), F.min("memory_id").alias("_memory"))
    home = home.select("support", "_low", "_high", X.input_producer("_kind", F.col("_producer"), DEFAULT_PRODUCER).alias("_producer"), "_memory")
    up = r.join(edges, "id", "left").join(home, "support", "left")
    fits = F.array_contains("declared", F.col("_memory")) & (F.col("_producer") == F.col("producer")) & (F.col("_low") == F.col("session_id")) & (F.col("_high") == F.col("session_id"))
    out = up.groupBy("id").agg(
        F.first("declared").alias("declared"), F.sort_array(F.collect_list("support")).alias("supporting_memory_ids"), F.count_distinct("_memory").alias("_found"), F.bool_and(F.coalesce(fits, F.lit(False))).alias("_fit")
    )
    ok = F.col("_fit") & (F.size("declared") > 0) & (F.size(F.array_distinct("declared")) == F.size("declared")) & (F.size("supporting_memory_ids") == F.size("declared")) & (F.col("_found") == F.size("declared"))
    return out.select("id", "supporting_memory_ids", ok.alias("ok"))


def _observed(wanted: DataFrame, t: Tables) -> DataFrame:
    """wanted(observation_id) -> observation_id, session_id (null where no memory is the observation), paths of its files, and repository_ids and origins by ``observation_scope``; a row a session.

    Edges meet files once, for paths, repositories and origins alike.
    """
    named = t.repositories.select(F.col("id").alias("repository_id"), "normalized_origin")
    files = t.files.select(F.col("id").alias("file_id"), "repository_id", "relative_path").join(named, "repository_id", "left")
    linked = t.about.select("observation_id", "file_id").join(wanted, "observation_id", "left_semi").join(files, "file_id", "left").groupBy("observation_id")
    linked = linked.agg(X.distinct_sorted("repository_id").alias("evidenced"), X.distinct_sorted("normalized_origin").alias("_origins"), X.distinct_sorted("relative_path").alias("paths"), F.count(F.lit(1)).alias("links"))
    contexts = t.worked_on.join(named, "repository_id", "left").groupBy("session_id").agg(X.distinct_sorted("repository_id").alias("contexts"), X.distinct_sorted("normalized_origin").alias("_context_origins"))
    there = t.memories.where("kind = 'observation'").select(F.col("id").alias("observation_id"), "session_id").distinct().withColumn("_there", F.col("session_id").isNotNull())
    rows = wanted.join(there, "observation_id", "left").join(linked, "observation_id", "left").join(contexts, "session_id", "left")
    none = F.array().cast("array<string>")
    at = lambda of_files, of_session: F.when(F.col("_there"), F.when(F.col("links") > 0, F.col(of_files)).when(F.size("contexts") == 1, F.col(of_session)).otherwise(none))
    return rows.select("observation_id", "session_id", "paths", at("evidenced", "contexts").alias("repository_ids"), at("_origins", "_context_origins").alias("origins"))


def input_rows(t: Tables, reader_id: str, grants: DataFrame) -> DataFrame:
    """Every readable memory with its evidence and ``ok``; dropped ones too, for a selection decides on these.

    Adds source_entries (stream_id, entry_id of its own session), linked_paths (its files', and for a reflection its supports'), repository_ids and repository_origins by scope, and
    supporting_memory_ids; all lists are sorted. Not ok: an id of several owners or sessions, or a reflection whose supports are not what it declares.
    """
    keys = t.memories.groupBy("id").agg((F.min("owner_id") == F.max("owner_id")).alias("_one_owner"), (F.min("session_id") == F.max("session_id")).alias("_one_session"))
    mine = readable(t.memories, reader_id, grants).withColumn("producer", X.input_producer("source_kind", F.col("producer"), DEFAULT_PRODUCER))
    mine = mine.withColumn("dropped", (F.col("kind") == "observation") & F.coalesce("dropped", F.lit(False))).dropDuplicates(["id"])
    mine = durable(mine.join(keys, "id"))
    cited = t.sourced_from.select(F.col("observation_id").alias("id"), "session_id", F.struct(F.coalesce("stream_id", F.lit("main")).alias("stream_id"), "entry_id").alias("e"))
    cited = cited.groupBy("id", "session_id").agg(F.array_sort(F.collect_set("e")).alias("source_entries"))
    own = mine.where("kind = 'observation'").select(F.col("id").alias("observation_id"), F.col("session_id").alias("_session"))
    edges = t.supported_by.select(F.col("reflection_id").alias("id"), "observation_id").distinct().join(mine.select("id"), "id", "left_semi")
    observed = durable(_observed(own.select("observation_id").unionByName(edges.select("observation_id")).distinct(), t))
    lists = ("paths", "repository_ids", "origins")
    direct = observed.join(own, "observation_id").where("session_id <=> _session").select(F.col("observation_id").alias("id"), *[F.col(c).alias(f"_own_{c}") for c in lists])
    through = edges.join(observed, "observation_id").groupBy("id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(f"_up_{c}") for c in lists])
    rows = mine.drop("supporting_observation_ids").join(cited, ["id", "session_id"], "left").join(direct, "id", "left").join(through, "id", "left").join(supports(mine, t), "id", "left")
    none = F.array().cast("array<string>")
    of = lambda c: F.when(F.col("kind") == "observation", F.coalesce(f"_own_{c}", none)).when(F.col("kind") == "reflection", F.array_sort(F.coalesce(f"_up_{c}", none))).otherwise(none)
    ok = F.coalesce(F.col("_one_owner") & F.col("_one_session"), F.lit(False)) & F.coalesce("ok", F.lit(True))
    return rows.withColumns({
        "linked_paths": F.array_sort(F.array_union(F.coalesce("_own_paths", none), F.coalesce("_up_paths", none))), "repository_ids": of("repository_ids"), "repository_origins": of("origins"),
        "source_entries": F.coalesce("source_entries", F.array().cast("array<struct<stream_id:string,entry_id:string>>")), "ok": ok,
    }).drop("_one_owner", "_one_session", *[f"_{k}_{c}" for k in ("own", "up") for c in lists])


def load_input(t: Tables, reader_id: str, grants: DataFrame) -> DataFrame:
    """``input_rows`` if all are ok; otherwise SelectionError says how many are not, and nothing is read."""
    rows = input_rows(t, reader_id, grants)
    bad = rows.where("not ok").count()
    if bad:
        raise SelectionError("unresolved-evidence", f"{bad} memories cannot be resolved")
    return rows.drop("ok")
