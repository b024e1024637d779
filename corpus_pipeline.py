"""The corpus pipeline: each stage calls one operator of the training-data subpackage on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of ``documents``; the last returns the
token index. Between stages the rows are a Parquet table that is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import NULL_ID, cut, fresh, fresh_path, join_small, numbered, table
from annalist.llm.decontaminate import contaminated, contamination
from annalist.llm.language_id import accepted_rows, train
from annalist.llm.minhash import near_duplicates
from annalist.llm.mixing import mixed_rows
from annalist.llm.token_store import token_rows


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """Rows whose number is not among ``gone`` (column: row). Numbers are unique, so the join has no hot key."""
    return rows.join(gone.select(row).hint("merge"), row, "left_anti").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification accepts; the model learns from the stage's own labelled rows. Each row is judged by its text; null, empty and letterless texts go."""
    return accepted_rows(docs, train(docs))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (similarity of 0.8 or more), that of smallest id (null first). Each row is a node of its own, so rows that share an id or have none
    go only if their texts link; wordless texts link with nothing, and of those only rows of equal id and text are one."""
    rows, row = numbered(docs)
    found = near_duplicates(rows, id_col=row).select(F.col("doc_id").alias("_row"), "n_shingles", "component_id")
    ids = rows.select(F.col(row).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    wordless = F.col("n_shingles") == 0
    group = [F.when(~wordless, F.col("component_id")).alias("a"), F.when(wordless, F.col("id")).alias("b"), F.when(wordless, F.col("digest")).alias("c")]
    placed = cut(ids.join(found, "_row").select(*group, F.struct("id", "digest", "_row").alias("place")), "placed")
    first = placed.groupBy("a", "b", "c").agg(F.min("place").alias("place")).select("place._row")
    gone = placed.select("place._row").join(first, "_row", "left_anti").select(F.col("_row").alias(row))
    return _without(rows, row, gone).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items; each row is judged by its own text, whatever its id."""
    rows, row = numbered(docs)
    found = contaminated(contamination(rows, table(spark, sf_dir, "benchmark"), id_col=row))
    gone = cut(found.where("contaminated").select(F.col("doc_id").alias(row)), "contaminated")
    return join_small(rows, gone, [row], "left_anti", salt_col=fresh(rows, "_salt")[0]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that share an id and a source are taken alike."""
    return mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document (and copy) as read back from the token files."""
    return token_rows(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: A trained model, near-duplicate components and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
