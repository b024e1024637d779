"""Walks over entry trees and session lineage."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _chain(frame: pd.DataFrame) -> pd.DataFrame:
    parents = dict(zip(frame["entry_id"], frame["parent_id"], strict=True))
    out, seen = [], set()
    for leaf in frame.loc[frame["is_leaf"].fillna(False).astype(bool), "entry_id"]:
        at, depth = leaf, 0
        while at in parents and at not in seen:  # a cycle or an unknown parent ends the walk
            seen.add(at)
            out.append((frame["session_id"].iloc[0], at, depth))
            at, depth = parents[at], depth + 1
    return pd.DataFrame(out, columns=["session_id", "entry_id", "depth"]).astype({"depth": "int64"})


def ancestors(entries: DataFrame) -> DataFrame:
    """entries(session_id, entry_id, parent_id, is_leaf) -> session_id, entry_id, depth of each entry on a path from a leaf to its root.

    One task walks a whole session, in time linear in its entries: branches are thousands of entries deep, far more than a join a level allows.
    """
    rows = entries.select("session_id", "entry_id", "parent_id", "is_leaf")
    return rows.groupBy("session_id").applyInPandas(_chain, "session_id string, entry_id string, depth long")


def fresh_folder(df_or_session: DataFrame | SparkSession, what: str) -> str:
    """A new folder name below the checkpoint folder, which driver and executors share. Where none is set, a local one is taken if driver and executors are one process."""
    spark = df_or_session.sparkSession if isinstance(df_or_session, DataFrame) else df_or_session
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints/annalist"
    return f"{folder.rstrip('/')}/annalist/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The rows as a table in a ``fresh_folder``: they are computed once, lineage ends there, and losing an executor loses nothing."""
    path = fresh_folder(df, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lineage(ids: DataFrame, edges: DataFrame, most: int = 128) -> DataFrame:
    """ids(id), edges(child, parent) -> id, ancestor, depth (0: itself), over at most ``most`` edges; each pair once, at its least depth.

    Rounds double: once paths of up to n edges are known, two of them make one of up to 2n, so 128 edges take 7 joins.
    Several parents and cycles are allowed. Ids without edges have only themselves.
    """
    edges = edges.where("child <> parent").select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    reach, known, n = durable(edges), 1, edges.isEmpty()
    while known < most and not n:
        step = reach.select("id", F.col("ancestor").alias("_by"), "depth").join(reach.select(F.col("id").alias("_by"), "ancestor", F.col("depth").alias("_more")), "_by")
        step = step.select("id", "ancestor", (F.col("depth") + F.col("_more")).alias("depth")).where((F.col("depth") <= most) & (F.col("id") != F.col("ancestor")))
        grown = durable(reach.unionByName(step).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        known, n, reach = known * 2, grown.where(F.col("depth") > known).isEmpty(), grown
    own = ids.select("id").distinct()
    return own.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(reach.join(own, "id", "left_semi").select("id", "ancestor", F.col("depth").cast("int").alias("depth")))


def climb(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """nodes(session_id, node, up), starts(session_id, node) -> session_id, node of every start and of all nodes above it, each once; a start or an ``up`` that is no node ends its path.

    Paths may be as long as a session: a round joins what is reached with jumps of 1, 2, 4, ... steps, so n steps take log2(n) rounds, and a cycle ends where nothing new comes.
    """
    known = durable(nodes.select("session_id", "node", "up").dropDuplicates(["session_id", "node"]))
    at = known.select("session_id", "node")
    jump = durable(known.join(at.withColumnRenamed("node", "up"), ["session_id", "up"]).select("session_id", "node", F.col("up").alias("to")))
    reached = durable(starts.select("session_id", "node").distinct().join(at, ["session_id", "node"], "left_semi"))
    while True:
        more = reached.join(jump, ["session_id", "node"]).select("session_id", F.col("to").alias("node")).distinct()
        more = durable(more.join(reached, ["session_id", "node"], "left_anti"))
        if more.isEmpty():
            return reached
        reached = durable(reached.unionByName(more))
        on = jump.select("session_id", F.col("node").alias("to"), F.col("to").alias("_further"))
        jump = durable(jump.join(on, ["session_id", "to"]).select("session_id", "node", F.col("_further").alias("to")))


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """starts(session_id, node), edges(session_id, node, to) -> session_id, node of all that is reached over any number of edges, starts included, each once.

    Semi-naive: a round joins the nodes of the last one with the edges, and those that are new make the next, so each edge is used once; the rounds are as many as the longest shortest path.
    """
    edges = durable(edges.select("session_id", "node", "to").distinct())
    reached = new = durable(starts.select("session_id", "node").distinct())
    rounds = 0
    while True:
        found = new.join(edges, ["session_id", "node"]).select("session_id", F.col("to").alias("node")).distinct()
        new = durable(found.join(reached, ["session_id", "node"], "left_anti"))
        if new.isEmpty():
            return reached
        rounds += 1
        reached = reached.unionByName(new)
        if rounds % 8 == 0:  # a plan of few tables, however many rounds there are
            reached = durable(reached)
