"""Tables as snapshots: a commit writes new files, and creating one small version file makes them current.

A version file lists the snapshot of every table, so a commit of several tables is one step: a reader sees all of it or nothing. Versions are numbered, and
the file of a number can be created once only: of two writers that start from one version the second finds its number taken and fails with
``SnapshotConflict``. A table may be split into buckets by a hash of its scope (a session, say); a change then writes the buckets
it touches anew, and the new snapshot names the old files of all others. Readers keep the version they began with whatever is committed meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SnapshotConflict(RuntimeError):
    """The table changed since the caller looked at it, or its guard does not hold any more."""


class Catalog:
    """Tables below one folder of any file system that Spark reaches and that can create a file only if it is not there.

    ``buckets``: tables split into buckets, {name: (column, how many)}.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: dict[str, tuple[str, int]] | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets or {}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def _version_path(self, n: int):
        return self._path(f"{self.root}/_versions/{n:012d}")

    def number(self) -> int:
        """Of the current version; 0 before the first commit."""
        folder = self._path(f"{self.root}/_versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def tables(self, n: int | None = None) -> dict[str, dict]:
        """{table: {snapshot, folders: {bucket or "": folder}}} of a version (the current one)."""
        n = self.number() if n is None else n
        if n == 0:
            return {}
        stream = self._fs.open(self._version_path(n))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self, name: str) -> str | None:
        return self.tables().get(name, {}).get("snapshot")

    def missing(self, names: list[str]) -> list[str]:
        """Tables of the list that have no snapshot yet: readiness of a fresh catalog."""
        have = self.tables()
        return [n for n in names if n not in have]

    def read(self, name: str, snapshot: str | None = None) -> DataFrame:
        """A table as it is, or as an earlier version had it."""
        found = self.tables().get(name)
        if snapshot is not None and (found is None or found["snapshot"] != snapshot):
            found = next((t[name] for n in range(self.number(), 0, -1) if (t := self.tables(n)).get(name, {}).get("snapshot") == snapshot), None)
        if found is None:
            raise KeyError(name)
        return self._rows(found)

    def _rows(self, table: dict) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        paths = sorted(table["folders"].values())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # commits

    def _written(self, name: str, df: DataFrame, old: dict | None, touched: list[int] | None = None) -> dict:
        """Files of a new snapshot of df. touched: df has the rows of these buckets only, and the others stay as they are."""
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        table = {"snapshot": snapshot, "schema": json.loads(df.schema.json())}
        if name not in self.buckets:
            df.write.parquet(folder := f"{self.root}/{name}/{snapshot}")
            return table | {"folders": {"": folder}}
        column, n = self.buckets[name]
        placed = df.withColumn("_bucket", bucket_of(column, n))
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{snapshot}")
        made = {f.getPath().getName().partition("=")[2]: f"{self.root}/{name}/{snapshot}/{f.getPath().getName()}" for f in self._fs.listStatus(self._path(f"{self.root}/{name}/{snapshot}")) if f.isDirectory()}
        kept = {} if touched is None or old is None else {b: f for b, f in old["folders"].items() if int(b) not in touched}
        if kept.keys() & made.keys():
            raise ValueError(f"{name}: rows outside the scope of the change")
        return table | {"folders": kept | made}

    def commit(self, tables: dict[str, dict], base: int, guard: Callable[[], bool] | None = None) -> int:
        """Make snapshots current in one step, if ``base`` is still the last version; otherwise nothing changes.

        A table that another commit has changed since ``base`` is a conflict; commits to other tables are taken over and the step is tried again.
        """
        before = self.tables(base)
        while True:
            now = self.number()
            current = self.tables(now)
            changed = [t for t in tables if current.get(t, {}).get("snapshot") != before.get(t, {}).get("snapshot")]
            if changed or (guard is not None and not guard()):
                raise SnapshotConflict(", ".join(changed) or "the guard does not hold")
            if self._create(now + 1, current | tables):
                return now + 1

    def _create(self, n: int, tables: dict[str, dict]) -> bool:
        """Create a version's file, whole, unless it is there."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        target = self._version_path(n)
        staged = self._path(f"{self.root}/_staged/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        if self._fs.getScheme() == "file":
            # the local file system's rename looks first and moves then; a hard link is one step
            files, paths = jvm.java.nio.file.Files, jvm.java.nio.file.Paths
            at = lambda p: paths.get(p.toUri().getPath(), gateway.new_array(jvm.java.lang.String, 0))
            step = lambda: files.createLink(at(target), at(staged))
        else:
            step = lambda: jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, target, none)
        try:
            step()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(staged, False)
        return True

    def write(self, name: str, df: DataFrame, expect: str | None | object = ..., guard: Callable[[], bool] | None = None, unique: list[str] | None = None) -> str:
        """Commit df as the table. ``expect``: the snapshot that the change was computed from; ``guard``: checked just before the commit; ``unique``: a key that no two rows may share."""
        base = self.number()
        old = self.tables(base).get(name)
        if expect is not ... and (old or {}).get("snapshot") != expect:
            raise SnapshotConflict(name)
        table = self._written(name, df, old)
        if unique and not self._rows(table).groupBy(*unique).count().where("count > 1").isEmpty():
            raise SnapshotConflict(f"{name}: {', '.join(unique)} is not unique")
        self.commit({name: table}, base, guard)
        return table["snapshot"]

    def appended(self, name: str, rows: DataFrame, table: dict | None) -> dict:
        """Files of a snapshot with these rows as well; those that are there are kept as they are. For ``commit``; the table must not be bucketed."""
        made = self._written(name, rows, table)
        old = {} if table is None else {f: path for f, path in enumerate(table["folders"].values())}
        return made | {"folders": {str(i): path for i, path in enumerate([*old.values(), *made["folders"].values()])}}

    def _part(self, name: str, table: dict | None, rows: DataFrame, on: str | None) -> tuple[DataFrame | None, list[int] | None]:
        """(the table's rows that a change by ``rows`` may touch, the buckets they are in; no buckets: the whole table)."""
        if table is None:
            return None, None
        if on is None or self.buckets.get(name, ("",))[0] != on:
            return self._rows(table), None
        touched = [r.b for r in rows.select(bucket_of(on, self.buckets[name][1]).alias("b")).distinct().collect()]  # at most as many as there are buckets
        return self._rows(table | {"folders": {b: f for b, f in table["folders"].items() if int(b) in touched}}), touched

    def upsert(self, name: str, rows: DataFrame, keys: list[str], overwrite_null: list[str] | None = None) -> str:
        """Merge rows by their keys; of a bucketed table whose column is a key, only the touched buckets are read and written."""
        base = self.number()
        table = self.tables(base).get(name)
        old, touched = self._part(name, table, rows, next((k for k in keys if k == self.buckets.get(name, ("",))[0]), None))
        made = self._written(name, rows if old is None else merge_rows(old, rows, keys, overwrite_null), table, touched)
        self.commit({name: made}, base)
        return made["snapshot"]

    def replaced(self, base: int, name: str, rows: DataFrame, scope: DataFrame, on: list[str]) -> dict:
        """Files of a snapshot in which the rows that ``scope`` names are replaced by ``rows``; for ``commit``."""
        table = self.tables(base).get(name)
        named = scope.select(*on).distinct()
        old, touched = self._part(name, table, named, on[0] if len(on) == 1 else None)
        return self._written(name, rows if old is None else old.join(named, on, "left_anti").unionByName(rows), table, touched)

    def replace_scope(self, name: str, rows: DataFrame, scope: DataFrame, on: list[str]) -> str:
        """Full replacement of the rows that ``scope`` names (for instance the sessions projected anew); ``rows`` must lie in the scope."""
        return self.replace_all({name: rows}, scope, on)[name]

    def replace_all(self, tables: dict[str, DataFrame], scope: DataFrame, on: list[str], guard: Callable[[], bool] | None = None) -> dict[str, str]:
        """``replace_scope`` of several tables in one commit."""
        base = self.number()
        made = {name: self.replaced(base, name, rows, scope, on) for name, rows in tables.items()}
        self.commit(made, base, guard)
        return {name: t["snapshot"] for name, t in made.items()}

    def insert_new(self, name: str, rows: DataFrame, keys: list[str], payload: str) -> str:
        """Append rows whose key is new. A key with two payloads, among the rows or between them and the table, is a conflict, and nothing is written; null is a payload like others."""
        base = self.number()
        table = self.tables(base).get(name)
        old, touched = self._part(name, table, rows, next((k for k in keys if k == self.buckets.get(name, ("",))[0]), None))
        if not payload_conflicts(rows, old, keys, payload).isEmpty():
            raise SnapshotConflict(f"{name}: immutable payload differs")
        once = rows.dropDuplicates(keys)
        made = self._written(name, once if old is None else old.unionByName(once.join(old.select(*keys), keys, "left_anti")), table, touched)
        self.commit({name: made}, base)
        return made["snapshot"]


def bucket_of(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def payload_conflicts(rows: DataFrame, old: DataFrame | None, keys: list[str], payload: str) -> DataFrame:
    """Keys of ``rows`` that have more than one payload among the rows and the table."""
    new = rows.select(*keys, F.struct(payload).alias("_p"))
    every = new if old is None else new.unionByName(old.select(*keys, F.struct(payload).alias("_p")).join(rows.select(*keys).distinct(), keys, "left_semi"))
    return every.groupBy(*keys).agg(F.min("_p").alias("_a"), F.max("_p").alias("_b")).where("not (_a <=> _b)").select(*keys)


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str], overwrite_null: list[str] | None = None) -> DataFrame:
    """Upsert: new values win unless they are null; columns in ``overwrite_null`` are taken from new rows even then."""
    hard = set(overwrite_null or [])
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in keys])
    m = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_is_new"))
    both = o.join(m, keys, "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"_o_{c}")
        if c in hard:
            return F.when(F.col("_is_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
        return F.coalesce(f"_n_{c}", f"_o_{c}")

    return both.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


def snapshot_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one and not the other, with repeats: side is missing or extra."""
    side = lambda a, b, name: a.exceptAll(b).select(F.lit(name).alias("side"), "*")
    return side(expected, actual, "missing").unionByName(side(actual, expected, "extra"))


def same_snapshot(expected: DataFrame, actual: DataFrame) -> bool:
    return snapshot_difference(expected, actual).isEmpty()


def key_report(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Whether the keys are unique. Counted by key first, so no single task sees all rows."""
    by_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    out = by_key.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    return out.select(F.lit(name).alias("name"), "n_rows", "n_keys", (F.col("n_rows") == F.col("n_keys")).alias("is_key"))


def advance_checkpoints(current: DataFrame, offered: DataFrame, key: str = "session_id") -> DataFrame:
    """Compare-and-set: an offered checkpoint is applied if there is none, if it is further, or if it repeats the stored one.

    Columns of both: key, byte_offset, prefix_hash, ordinal. Adds applied.
    """
    old = current.select(key, *[F.col(c).alias(f"_{c}") for c in ("byte_offset", "prefix_hash", "ordinal")])
    both = offered.join(old, key, "full_outer")
    ok = F.col("byte_offset").isNotNull() & (
        F.col("_byte_offset").isNull() | (F.col("byte_offset") > F.col("_byte_offset")) | ((F.col("byte_offset") == F.col("_byte_offset")) & (F.col("prefix_hash") == F.col("_prefix_hash")))
    )
    ok = F.coalesce(ok, F.lit(False))
    return both.select(key, *[F.when(ok, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("byte_offset", "prefix_hash", "ordinal")], ok.alias("applied"))


def drop_orphans(repositories: DataFrame, worked_on: DataFrame) -> DataFrame:
    return repositories.join(worked_on.select(F.col("repository_id").alias("id")), "id", "left_semi")


def rekey(df: DataFrame, new_id: Column, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Identity migration: rows under their new ids, and the new ids that more than one old id maps to."""
    moved = df.withColumn("_old", F.col(id_col)).withColumn(id_col, new_id)
    collisions = moved.groupBy(id_col).agg(F.count_distinct("_old").alias("n")).where("n > 1")
    return moved.drop("_old"), collisions


def effective_version(sessions: DataFrame, user: str = "user_id", version: str = "code_memory_version", declared: DataFrame | None = None) -> DataFrame:
    """A user's version: the declared one, else the smallest of the sessions' (a session without one counts 1), else 1."""
    low = sessions.groupBy(user).agg(F.min(F.coalesce(version, F.lit(1))).alias("_low"))
    if declared is None:
        return low.select(user, F.col("_low").alias(version))
    return declared.join(low, user, "full_outer").select(user, F.coalesce(version, "_low", F.lit(1)).alias(version))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
