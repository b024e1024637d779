"""Connected components of an edge table, without collecting it: alternate large-star and small-star rounds
(Kiveris et al., 2014). A round shuffles each edge twice; every node ends up pointing at its component's smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import cut, join_small


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> node, root for each node with an edge to another; root is the smallest id it reaches.

    Loops and repeated edges are ignored; an empty table gives an empty result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs, "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a hub has many edges, so its minimum goes to them by broadcast or salted, never by a plain join
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "minima")
        large = join_small(both, low, ["u"], "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u keeps an edge to its smallest neighbour only, and hands the others on to that one
        large = cut(large, "edges")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        kept = low.select("u", F.col("m").alias("v"))
        handed = join_small(large, low, ["u"], "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(kept.unionByName(handed).distinct(), "edges")
        # roots have no edge of their own; once all edges end in roots and each node has one, nothing changes
        mark = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
