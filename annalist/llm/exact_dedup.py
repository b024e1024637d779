"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised text (``repartitionByRange``), the external sort of the window
operator places equal texts next to each other, and the window compares each row's whole text with its
neighbour's. Splitters are the text's first characters and a 64-bit hash of all of it, in place of the whole text, so the sample that the driver sorts
stays small however long the texts are, and many texts with one beginning still spread; what is equal is decided on whole texts alone. To let no group of copies land in one task, rows are first dealt by (text, salt): each salted run
finds its representative, and only representatives - at most ``salts`` a text - take part in the second sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import id_text, partitions, restore_id, table

#: Characters of the text in a splitter.
HEAD = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lambda c: c, keep: str = "smallest", salts: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are equal. ``keep``: which id of equal texts stays. Rows that
    share id and text are one group member each; of those with the kept id one row is kept. A null id sorts
    lowest and comes back as null. ``salts``: how many runs a group of copies is dealt into by id, unless given one for each shuffle partition
    (32 at least), so that a group of any size keeps all tasks busy. Extra columns are pruned; an empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    salts = salts or max(32, partitions(docs.sparkSession))
    rows = id_text(docs, id_col, text_col)
    rows = rows.select("doc_id", normalise(F.col("text")).alias("body")).withColumns(
        {"salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"), "head": F.substring("body", 1, HEAD), "mark": F.xxhash64("body")}
    )
    order: Column = F.col("doc_id").desc() if keep == "largest" else F.col("doc_id").asc()
    run = Window.partitionBy("head", "mark", "salt", "body")
    first = rows.repartitionByRange("head", "mark", "salt").select(
        "doc_id", "body", "salt", "head", "mark",
        F.row_number().over(run.orderBy(order)).alias("nth"),
        F.first("doc_id").over(run.orderBy(order)).alias("rep"),
        F.count(F.lit(1)).over(run).alias("n"),
    )
    group = Window.partitionBy("head", "mark", "body")
    best = (
        first.where("nth = 1").select("body", "salt", "head", "mark", "rep", "n").repartitionByRange("head", "mark")
        .select(
            F.sha2(F.col("body").cast("binary"), 256).alias("digest"), "salt", "rep",
            F.first("rep").over(group.orderBy(F.col("rep").desc() if keep == "largest" else F.col("rep").asc())).alias("keep"),
            F.sum("n").over(group).alias("group_size"),
        )
    )
    members = first.select("doc_id", "salt", "rep", "nth", F.sha2(F.col("body").cast("binary"), 256).alias("digest"))
    # each member has its representative; a left join derives no null filters, so both sides share one sorted exchange
    out = members.join(best, ["digest", "salt", "rep"], "left")
    return out.select(
        restore_id("doc_id").alias("doc_id"),
        restore_id("keep").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("doc_id") == F.col("keep")) & (F.col("nth") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
