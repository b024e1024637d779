"""An inverted table from files to what is remembered about them, so that a question about a file reads that file's rows and not the edges of all.

One row a file, user and memory, with the provenance that ``file_memory`` would collect for it. Rows lie in buckets by the hash of (repository, path) and are sorted by that hash in
their files, so a question is one bucket by partition pruning and some pages of it by statistics. Buckets hold about ``BUCKET_ROWS`` rows however many files there are. A file of more
rows than a bucket's is dealt by the hash of its memories, so that one with a third of all memories is written by many tasks. Rows know their place among what a user remembers about a
file (of such a large file, among those of their cut), so the first of each are read and not looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.operators.walks import durable, fresh_folder
from annalist.plans.file_memory import ORDER, Graph, _contexts, _sources, _touched

BUCKET_ROWS = 20_000
#: Buckets that a task writes at most, in a build: what it sorts stays in memory.
TASK_BUCKETS = 50
#: A build of more buckets than these is done in rounds, at most so many: files go to their round by bucket, and what a round moved is given back before the next.
ROUND_BUCKETS = 250
ROUNDS = 8
#: Questions up to here name their buckets, and are broadcast.
FEW = 20_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FILE = ["repository_id", "relative_path"]
_MEMORY = ["user_id", "kind", "id", "memory_id", "producer", "content", "timestamp", "relevance", "source_kind", "source_session_id"]
_LISTS = ["entry_ids", "source_entries", "contexts"]
#: What is moved and held of the lists: entry_ids are in source_entries. An empty list is null.
_HELD = ["source_entries", "contexts"]
#: What is much the same in all rows comes first, and what varies in length last: rows are compressed.
_MOVED = ["kind", "producer", "source_kind", "timestamp", "relevance", "user_id", "content", "id", "memory_id", "source_session_id", *_FILE, *_HELD]


def _key(repository: str | Column, path: str | Column) -> Column:
    return F.xxhash64(repository, path)


def file_rows(g: Graph) -> tuple[int, DataFrame | None]:
    """How many rows the index has: a memory's observations and reflections about a file make a row each at most. And file_id, _cuts of files with more than a bucket's, how many tasks their rows are
    worth; none if there is none.

    The edges of all files are counted, by observations and by files; only those of files that may be large are joined with what rests on them."""
    supports = g.supported_by.groupBy("observation_id").agg(F.count(F.lit(1)).alias("_supports"))
    about = g.about.groupBy("observation_id").agg(F.count(F.lit(1)).alias("_files")).join(supports, "observation_id", "left")
    n, most = about.agg(F.sum(F.col("_files") * (1 + F.coalesce("_supports", F.lit(0)))), F.coalesce(F.max("_supports"), F.lit(0))).first()
    may = durable(g.about.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * (1 + most) > BUCKET_ROWS).select("file_id"))
    if may.isEmpty():
        return n or 0, None
    rows = g.about.select("observation_id", "file_id").join(may, "file_id").join(supports, "observation_id", "left").groupBy("file_id").agg(F.sum(1 + F.coalesce("_supports", F.lit(0))).alias("_rows"))
    large = durable(rows.where(F.col("_rows") > BUCKET_ROWS).select("file_id", F.ceil(F.col("_rows") / BUCKET_ROWS).alias("_cuts")))
    return n or 0, None if large.isEmpty() else large


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back as it ends; otherwise they lie on the executors' disks until the driver collects garbage."""
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


@dataclass(frozen=True)
class Parts:
    """What the rows of an index are joined of, by observation."""

    pairs: DataFrame  # observation_id, _FILE, contexts; not distinct
    alone: DataFrame  # observation_id, _MEMORY, source_entries: memories that one observation supports
    several: DataFrame  # the same for each support of those that more do

    def durable(self, folder: str, rounds: int, of_round: Column) -> Parts:
        """The parts as tables below a new folder, pairs by their round."""
        self.pairs.withColumn("_round", F.pmod(of_round, F.lit(rounds)).cast("int")).write.partitionBy("_round").parquet(folder)
        return Parts(self.pairs.sparkSession.read.parquet(folder), durable(self.alone), durable(self.several))

    def round(self, i: int) -> Parts:
        return Parts(self.pairs.where(F.col("_round") == i).drop("_round"), self.alone, self.several)

    def rows(self) -> DataFrame:
        # edges are dealt by their observation once: that makes them distinct, and there they meet memories
        pairs = self.pairs.repartition("observation_id").distinct()
        alone = pairs.join(self.alone, "observation_id").select(*_MOVED)
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        several = pairs.join(self.several, "observation_id").groupBy(*_FILE, *_MEMORY).agg(*[merged(c).alias(c) for c in _HELD])
        several = several.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in _HELD}).select(*_MOVED)
        return alone.unionByName(several)


def index_parts(g: Graph, files: DataFrame | None = None) -> Parts:
    """The parts for all files or those of ``files`` (columns as Graph.files)."""
    whole = files is None
    files = (g.files if whole else files).select(F.col("id").alias("file_id"), *_FILE)
    about, touched, src = g.about.select("observation_id", "file_id"), _touched(g), _sources(g)
    pairs = about.join(files, "file_id")
    hits = (about if whole else pairs).join(durable(touched.select("file_id").distinct()), "file_id", "left_semi").select("observation_id", "file_id").distinct()
    # few files were touched, or all; once they are known a few are broadcast
    contexts = durable(_contexts(durable(hits), src, touched))
    pairs = pairs.join(contexts, ["observation_id", "file_id"], "left") if not contexts.isEmpty() else pairs.withColumn("contexts", F.lit(None).cast(contexts.schema["contexts"].dataType))
    if not whole:
        src = src.join(pairs.select("observation_id").distinct(), "observation_id", "left_semi")
    # memories meet what their observation cites before they meet its files, so texts and lists are moved once and not at every step of a file
    cited = src.groupBy("observation_id").agg(F.array_sort(F.collect_set(F.struct("stream_id", "entry_id"))).alias("source_entries"))
    mine = g.sessions.select(F.col("id").alias("session_id"), "user_id", "source_kind", "source_session_id")
    none = F.lit(None).cast("string")
    o = g.observations.where(~F.coalesce("dropped", F.lit(False))).join(mine, "session_id").withColumns({"observation_id": F.col("id"), "kind": F.lit("observation")})
    r = g.reflections.join(mine, "session_id").withColumns({"reflection_id": F.col("id"), "kind": F.lit("reflection"), "timestamp": none, "relevance": none})
    # a reflection with one support is all that is known of it, as an observation is; of others what several observations cite is merged file by file
    edges = g.supported_by.select("reflection_id", "observation_id").distinct().withColumn("_supports", F.count(F.lit(1)).over(Window.partitionBy("reflection_id")))
    r = edges.join(r.select("reflection_id", *_MEMORY), "reflection_id")
    alone = o.select("observation_id", *_MEMORY).unionByName(r.where("_supports = 1").select("observation_id", *_MEMORY)).repartition("observation_id").distinct()
    several = r.where("_supports > 1").select("observation_id", *_MEMORY)
    return Parts(pairs.select("observation_id", *_FILE, "contexts"), alone.join(cited, "observation_id", "left"), several.join(cited, "observation_id", "left"))


def with_cuts(rows: DataFrame, g: Graph, large: DataFrame | None) -> DataFrame:
    """And _cuts, how many tasks a file's rows are worth by ``large`` (as file_rows has it)."""
    if large is None:
        return rows.withColumn("_cuts", F.lit(1).cast("long"))
    cuts = large.join(g.files.select(F.col("id").alias("file_id"), *_FILE), "file_id").groupBy(*_FILE).agg(F.sum("_cuts").alias("_cuts"))
    return rows.join(cuts, _FILE, "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1)).cast("long"))


def index_rows(g: Graph, files: DataFrame | None = None, large: DataFrame | None = None) -> DataFrame:
    """repository_id, relative_path, user_id and the columns of ``file_memory`` but entry_ids, of all users, for all files or those of ``files``; and _cuts."""
    return with_cuts(index_parts(g, files).rows(), g, large)


@dataclass(frozen=True)
class FileIndex:
    spark: SparkSession
    folder: str
    buckets: int

    @staticmethod
    def build(g: Graph, folder: str) -> FileIndex:
        """Write the index of a whole graph to a new folder."""
        spark = g.files.sparkSession
        with released(spark):
            n, large = file_rows(g)
            made = FileIndex(spark, folder, max(1, -(-n // BUCKET_ROWS)))
            rounds = min(ROUNDS, -(-made.buckets // ROUND_BUCKETS))
            tasks = -(-made.buckets // (TASK_BUCKETS * rounds))
            parts = index_parts(g)
            if rounds == 1:
                made._write(with_cuts(parts.rows(), g, large), "errorifexists", tasks)
            else:
                parts = parts.durable(fresh_folder(spark, "pairs"), rounds, made.bucket())
                for i in range(rounds):
                    made._write(with_cuts(parts.round(i).rows(), g, large), "append" if i else "errorifexists", tasks)
        spark.createDataFrame([(made.buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/about")
        return made

    @staticmethod
    def open(spark: SparkSession, folder: str) -> FileIndex:
        return FileIndex(spark, folder, spark.read.parquet(f"{folder}/about").first().buckets)

    def bucket(self) -> Column:
        return F.pmod(_key(*_FILE), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, mode: str, tasks: int = 1) -> None:
        by = {"bucket": self.bucket(), "_cut": F.pmod(F.xxhash64("kind", "memory_id", "id"), F.col("_cuts"))}
        # dealt by a hash, as ranges would need all rows twice; hashes are not moved but made again
        many = tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(*[tasks] * many, *by.values()).withColumns({**by, "key": _key(*_FILE)})
        # one sort for places and for files
        order = Window.partitionBy(*by, "key", *_FILE, "user_id", F.col("kind").isNull()).orderBy(*ORDER, "id")
        placed = dealt.withColumns({"place": F.row_number().over(order), "cut": F.col("_cuts") > 1}).drop("_cut", "_cuts")
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/rows")

    def rows(self) -> DataFrame:
        """The columns of ``index_rows`` and entry_ids; place, a row's among those of its user and file in the order of ``file_memory``, and cut: the file was dealt, and places are those among its cut's."""
        found = self.spark.read.parquet(f"{self.folder}/rows").where("kind is not null").withColumns({c: F.coalesce(c, F.array()) for c in _HELD})
        return found.withColumn("entry_ids", F.array_sort(F.array_distinct(F.filter(F.col("source_entries.entry_id"), lambda e: e.isNotNull()))))

    def refresh(self, g: Graph, changed: DataFrame) -> None:
        """Write the buckets of ``changed`` files (repository_id, relative_path) anew from the graph; other buckets are not touched. A file about which nothing is left keeps a row without a memory,
        so that its bucket is replaced as well. A reader in between may find a bucket's old or new rows."""
        bucket = self.bucket()
        hit = changed.select(bucket.alias("_bucket")).distinct()
        rows = index_rows(g, g.files.withColumn("_bucket", bucket).join(hit, "_bucket", "left_semi").drop("_bucket"))
        held = changed.select(*_FILE).distinct()
        for f in rows.schema.fields:
            if f.name not in _FILE:
                held = held.withColumn(f.name, F.lit(1 if f.name == "_cuts" else None).cast(f.dataType))
        self._write(rows.unionByName(held), "overwrite")

    def file_memory(self, user_id: str, repository_id: str, path: str, limit: int = 20) -> DataFrame:
        """What ``file_memory.file_memory`` answers, from one bucket."""
        key = _key(F.lit(repository_id), F.lit(path))
        found = self.rows().where((F.col("bucket") == F.pmod(key, F.lit(self.buckets)).cast("int")) & (F.col("key") == key) & (F.col("repository_id") == repository_id) & (F.col("relative_path") == path) & (F.col("user_id") == user_id) & (F.col("place") <= limit))
        return found.select(*[c for c in _MEMORY if c != "user_id"], *_LISTS).orderBy(*ORDER, "id").limit(limit)

    def files_memory(self, asked: DataFrame | None = None, limit: int = 20) -> DataFrame:
        """The same for many questions at once: asked(user_id, repository_id, relative_path), by default every user's about every file -> those columns and the first ``limit`` memories of each, with
        their place (rank)."""
        rows = self.rows().where(F.col("place") <= limit)
        if asked is not None:
            asked = durable(asked.select("user_id", *_FILE).distinct())
            if asked.limit(FEW + 1).count() <= FEW:
                buckets = asked.select(self.bucket().alias("bucket")).distinct()
                rows = rows.where(F.col("bucket").isin([r.bucket for r in buckets.collect()]))
                asked = F.broadcast(asked)
            rows = rows.join(asked, ["user_id", *_FILE], "left_semi")
        out = [*_FILE, *_MEMORY, *_LISTS, "rank"]
        found = rows.where(~F.col("cut")).withColumn("rank", F.col("place")).select(*out)
        # the first of a large file are among the first of its cuts
        nth = F.row_number().over(Window.partitionBy("user_id", *_FILE).orderBy(*ORDER, "id"))
        return found.unionByName(rows.where("cut").withColumn("rank", nth).where(F.col("rank") <= limit).select(*out))
