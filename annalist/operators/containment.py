"""Longest-prefix containment of paths in roots, as an equi-join: a path has few ancestors, roots may be many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestor_paths(path: str | Column) -> Column:
    """All proper ancestors of a normalised path, shortest first; of an absolute one the first is ``/``."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, i), "/"), F.lit("")), F.lit("/")))


def closest_root(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root", order: list[str] | None = None) -> DataFrame:
    """Adds the columns of the longest root that contains each path; paths outside all roots are left out, repeated rows stay repeated.

    Of equal roots (in several repositories) the smallest in order of ``order`` wins, by default of all other columns; nulls come first.
    Each distinct path is resolved once, and the rows then meet their path's root.
    """
    rest = [c for c in roots.columns if c != root]
    first = roots.groupBy(root).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("_rest")) if rest else roots.select(root).distinct()
    up = paths.select(path).distinct().select(F.col(path), F.explode(ancestor_paths(path)).alias(root)).where(F.col(path) != "/")
    # the roots that contain a path differ in length, so the longest is one
    found = up.join(first, root).groupBy(path).agg(F.max_by(F.struct(root, *(["_rest"] if rest else [])), F.length(root)).alias("_best"))
    found = found.select(path, F.col(f"_best.{root}").alias(root), *[F.col(f"_best._rest.{c}").alias(c) for c in rest])
    return paths.join(found, path).select(*paths.columns, root, *rest)


def relative_path(path: Column, root: Column) -> Column:
    """What is left of a path below its root; the root ``/`` ends where the path's first part begins."""
    return F.substring(path, F.when(root == "/", 2).otherwise(F.length(root) + 2), F.length(path))
