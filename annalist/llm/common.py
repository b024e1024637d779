"""Shared plumbing of the training-data operators: inputs, durable cuts, joins behind a size check."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null id while rows travel through numpy; ``restore_id`` turns it back into null.
NULL_ID = -(2**63)
#: Bytes of an Arrow batch (a longer row is a batch of its own).
ARROW_BYTES = 4 << 20
#: A side of a join is broadcast only if it has been counted and has no more rows than this.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ARROW_BYTES, so that a batch of long texts takes no more memory than one of short ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (null: NULL_ID) and the text (null: empty); other columns, whatever their names, are pruned."""
    small_batches(df.sparkSession)
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def restore_id(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col != F.lit(NULL_ID), col)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local one is set if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            folder = found.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            folder = "file:///tmp/checkpoints/annalist"
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark)}/annalist/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends in files that outlive any executor."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that ``cut`` wrote; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n)
        out.append(n)
    return out


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of a table of Parquet files with a number of their own, the same in every scan, and that column's name.

    A number is a hash of the row's file, with a seed for which the hashes of all files differ, and its place in the file. What is not read from Parquet files is written first."""
    (row,) = fresh(df, "_row")
    try:
        meta = df.metadataColumn("_metadata")
        placed = df.select("*", meta["file_path"].alias(row), meta["row_index"].alias(f"{row}_at"))
        placed.schema  # noqa: B018  resolved here, or not at all
    except AnalysisException:
        return numbered(cut(df, "rows"))
    found = placed.agg(F.count_distinct(row).alias("files"), F.coalesce(F.max(f"{row}_at"), F.lit(0)).alias("most")).first()
    bits = max(20, int(found.most).bit_length())
    for seed in range(1000):
        key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(row)), bits + 1)
        if seed or found.files > 1:
            if placed.agg(F.count_distinct(key)).first()[0] != found.files:
                continue
        return placed.withColumn(row, F.shiftleft(key, bits).bitwiseOR(F.col(f"{row}_at"))).drop(f"{row}_at"), row
    raise RuntimeError("no seed tells all files apart")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers of which hash partitioning into n partitions sends the j-th to partition j, so that n groups make n equal tasks."""
    found: dict[int, int] = {}
    step = 16 * n + 1000
    while len(found) < n:
        start = len(found) and max(found.values()) + 1
        ids = spark.range(start, start + step).select(F.col("id").cast("int").alias("v"))
        for r in ids.groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p")).agg(F.min("v").alias("v")).collect():
            found.setdefault(r.p, r.v)
    return [found[j] for j in range(n)]


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", salts: int = 16, hint: DataFrame | None = None, salt_col: str = "_salt") -> DataFrame:
    """Join with a side that is usually small. It is counted (``hint``: a cheaper frame with as many rows);
    up to BROADCAST_ROWS it is broadcast, beyond that both sides are shuffled with ``salts`` salts, so that
    no key of the left side lands in one task."""
    if (hint if hint is not None else right).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn(salt_col, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn(salt_col, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    # a merge join by name: Spark would guess the salted side's size from its files, without the salts
    return dealt.join(salted.hint("merge"), [*on, salt_col], how).drop(salt_col)
