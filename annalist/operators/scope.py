"""Repository scope of observations and reflections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import exprs as X


def subject_scope(evidenced: Column, contexts: Column) -> Column:
    """What file evidence names; without evidence the session's repository if it has exactly one; else nothing."""
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(evidenced, none)) > 0, evidenced).when(F.size(F.coalesce(contexts, none)) == 1, contexts).otherwise(none)


def observation_scope(observations: DataFrame, about: DataFrame, files: DataFrame, worked_on: DataFrame) -> DataFrame:
    """observations(id, session_id), about(observation_id, file_id), files(id, repository_id), worked_on(session_id, repository_id) -> id, session_id, repository_ids.

    A file whose repository is unknown still is evidence, of nothing: its session's repository is then not assumed.
    """
    linked = about.join(files.select(F.col("id").alias("file_id"), "repository_id"), "file_id", "left")
    linked = linked.groupBy(F.col("observation_id").alias("id")).agg(X.distinct_sorted("repository_id").alias("evidenced"), F.count(F.lit(1)).alias("links"))
    contexts = worked_on.groupBy("session_id").agg(X.distinct_sorted("repository_id").alias("contexts"))
    rows = observations.select("id", "session_id").join(linked, "id", "left").join(contexts, "session_id", "left")
    none = F.array().cast("array<string>")
    scope = F.when(F.col("links") > 0, F.col("evidenced")).otherwise(subject_scope(none, F.col("contexts")))
    return rows.select("id", "session_id", scope.alias("repository_ids"))


def reflection_scope(reflections: DataFrame, observed: DataFrame) -> DataFrame:
    """reflections(id, session_id, support_ids), observed: result of ``observation_scope`` -> id, session_id, repository_ids: union over the supports."""
    up = reflections.select("id", "session_id", F.explode_outer("support_ids").alias("support"))
    up = up.join(observed.select(F.col("id").alias("support"), "repository_ids"), "support", "left").select("id", "session_id", F.explode_outer("repository_ids").alias("r"))
    return up.groupBy("id", "session_id").agg(X.distinct_sorted("r").alias("repository_ids"))


def repository_origins(sessions: DataFrame, worked_on: DataFrame, repositories: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct origins of repositories that readable sessions with any memory worked on, sorted (a top-level list for completion)."""
    mine = sessions.join(owners.select(F.col("owner_id").alias("user_id")), "user_id", "left_semi").select(F.col("id").alias("session_id"))
    seen = worked_on.join(mine, "session_id", "left_semi").select(F.col("repository_id").alias("id")).distinct()
    return repositories.join(seen, "id", "left_semi").where("normalized_origin is not null").select("normalized_origin").distinct().orderBy("normalized_origin")
