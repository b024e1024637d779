"""Who may read what: one-hop, directed read grants, evaluated when read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def authorized_owners(readers: DataFrame, grants: DataFrame) -> DataFrame:
    """readers(reader_id), grants(owner_id, reader_id, permission) -> reader_id, owner_id: itself, and owners that grant it read."""
    own = readers.select("reader_id", F.col("reader_id").alias("owner_id"))
    granted = grants.where("permission = 'read'").join(readers, "reader_id", "left_semi").select("reader_id", "owner_id")
    return own.union(granted).distinct()


def readable(rows: DataFrame, reader_id: str, grants: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Rows of the reader or of an owner that grants it read; applied before any other predicate."""
    allowed = grants.where((F.col("permission") == "read") & (F.col("reader_id") == reader_id)).select(F.col("owner_id").alias(owner))
    own = grants.sparkSession.range(1).select(F.lit(reader_id).alias(owner))
    return rows.join(allowed.unionByName(own).distinct(), owner, "left_semi").select(*rows.columns)
