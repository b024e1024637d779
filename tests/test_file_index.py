from pyspark.sql import functions as F

from annalist.plans.file_index import FileIndex
from annalist.plans.file_memory import Graph, file_memory


def graph(spark, files, each=3, dropped=False):
    """``each`` observations about every file, of two users, every third of them dropped and under a reflection; cited entries touch their file."""
    n = F.col("id")
    o = spark.range(files * each).withColumn("file", F.floor(n / each))
    s = lambda c: c.cast("string")
    return Graph(
        sessions=spark.createDataFrame([("s0", "me", "pi", "n0"), ("s1", "you", "pi", "n1")], "id string, user_id string, source_kind string, source_session_id string"),
        observations=o.select(F.concat(F.lit("o"), n).alias("id"), F.concat(F.lit("s"), n % 2).alias("session_id"), F.concat(F.lit("m"), n).alias("memory_id"), F.lit("p").alias("producer"), F.repeat(s(n), 40).alias("content"), F.lit("t").alias("timestamp"), F.lit("low").alias("relevance"), ((n % 3 == 0) | F.lit(dropped)).alias("dropped")),
        reflections=o.where("id % 3 = 0").select(F.concat(F.lit("r"), n).alias("id"), F.concat(F.lit("s"), n % 2).alias("session_id"), F.concat(F.lit("m"), n).alias("memory_id"), F.lit("p").alias("producer"), F.lit("sum").alias("content")),
        about=o.select(F.concat(F.lit("o"), n).alias("observation_id"), s(F.col("file")).alias("file_id")),
        supported_by=o.where("id % 3 = 0").select(F.concat(F.lit("r"), n).alias("reflection_id"), F.concat(F.lit("o"), n).alias("observation_id")),
        sourced_from=o.select(F.concat(F.lit("o"), n).alias("observation_id"), F.concat(F.lit("e"), n).alias("entry_urn")),
        entries=o.select(F.concat(F.lit("e"), n).alias("id"), F.concat(F.lit("x"), n).alias("entry_id"), F.lit(None).cast("string").alias("stream_id")),
        touches=o.where("id % 2 = 0").select(F.concat(F.lit("e"), n).alias("entry_urn"), s(F.col("file")).alias("file_id"), F.lit("abc").alias("commit"), F.lit("main").alias("branch"), F.lit(None).cast("boolean").alias("dirty")),
        files=spark.range(files).select(s(n).alias("id"), F.concat(F.lit("R"), n % 5).alias("repository_id"), F.concat(F.lit("src/f"), n).alias("relative_path")),
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_index_answers_as_the_graph_does(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("annalist.plans.file_index.BUCKET_ROWS", 100)
    g = graph(spark, 200)
    FileIndex.build(g, str(tmp_path / "index"))
    index = FileIndex.open(spark, str(tmp_path / "index"))
    assert index.buckets == 8
    for user, f, limit in (("me", 7, 20), ("you", 7, 20), ("me", 12, 1), ("me", 199, 20), ("nobody", 7, 20)):
        want = file_memory(g, user, f"R{f % 5}", f"src/f{f}", limit)
        got = index.file_memory(user, f"R{f % 5}", f"src/f{f}", limit)
        assert got.columns == want.columns and rows(got) == rows(want)
    assert index.file_memory("me", "R0", "src/f7").count() == 0
    asked = g.files.where("cast(id as int) < 30").select(F.lit("me").alias("user_id"), "repository_id", "relative_path")
    for few in (20_000, 5):
        monkeypatch.setattr("annalist.plans.file_index.FEW", few)
        many = index.files_memory(asked.unionByName(asked), limit=1)
        want = [r for f in range(30) for r in rows(file_memory(g, "me", f"R{f % 5}", f"src/f{f}", 1).select("id", "content"))] if few == 5 else None
        assert many.groupBy("relative_path").count().where("count > 1").count() == 0
        if want is not None:
            assert sorted(rows(many.select("id", "content"))) == sorted(want)


def bytes_read(df):
    """Bytes of the files that the scans of a collected plan chose."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(p.plan())
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            out.append(p.metrics().apply("filesSize").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(out)


def test_a_question_reads_no_more_of_a_larger_graph(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("annalist.plans.file_index.BUCKET_ROWS", 200)
    read = {}
    for n in (300, 3000):
        index = FileIndex.build(graph(spark, n), str(tmp_path / f"i{n}"))
        whole = bytes_read(index.rows())
        read[n] = [bytes_read(index.file_memory("me", f"R{f % 5}", f"src/f{f}")) for f in (3, 77, 250)]
        assert all(0 < r < whole for r in read[n])
    assert max(read[3000]) <= 2 * max(read[300])


def test_refresh_replaces_the_buckets_of_changed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("annalist.plans.file_index.BUCKET_ROWS", 100)
    old, new = graph(spark, 100), graph(spark, 100, dropped=True)
    index = FileIndex.build(old, str(tmp_path / "index"))
    before = {r.relative_path for r in index.rows().where("kind = 'observation'").select("relative_path").distinct().collect()}
    changed = old.files.where("id in ('7', '8')").select("repository_id", "relative_path")
    index.refresh(new, changed)
    after = {r.relative_path for r in index.rows().where("kind = 'observation'").select("relative_path").distinct().collect()}
    assert {"src/f7", "src/f8"} & after == set() and after < before
    assert rows(index.file_memory("me", "R2", "src/f7")) == rows(file_memory(new, "me", "R2", "src/f7"))
    empty = Graph(**{k: v.limit(0) if k != "files" else v for k, v in vars(new).items()})
    index.refresh(empty, changed)
    assert index.file_memory("me", "R2", "src/f7").count() == 0 and index.file_memory("you", "R2", "src/f7").count() == 0


def exchanges_of(df, column):
    """Shuffles of a plan, before it runs, that carry a column."""
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.initialPlan())
        if p.getClass().getSimpleName() == "ShuffleExchangeExec":
            names = p.output()
            out.append(column in {names.apply(i).name() for i in range(names.size())})
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(out)


def test_texts_are_not_moved_at_every_step_of_a_file(spark):
    from annalist.plans.file_index import index_rows

    g = graph(spark, 50)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges_of(index_rows(g), "content") <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_supports_of_a_reflection_are_merged_and_large_files_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("annalist.plans.file_index.BUCKET_ROWS", 50)
    g = graph(spark, 20)
    # one file has a third of all memories, and a reflection rests on three observations about it and one about another
    more = spark.range(400).select(F.concat(F.lit("o1"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("observation_id"), F.lit("5").alias("file_id"))
    seen = more.select(F.col("observation_id").alias("id"), F.lit("s0").alias("session_id"), F.col("observation_id").alias("memory_id"), F.lit("p").alias("producer"), F.lit("c").alias("content"), F.lit("t").alias("timestamp"), F.lit("low").alias("relevance"), F.lit(False).alias("dropped"))
    edges = spark.createDataFrame([("r0", "o15"), ("r0", "o16"), ("r0", "o17"), ("r0", "o17")], "reflection_id string, observation_id string")
    g = Graph(**{**vars(g), "about": g.about.unionByName(more), "observations": g.observations.unionByName(seen), "supported_by": g.supported_by.unionByName(edges)})
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = FileIndex.build(g, str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    for f in (0, 5):
        want = rows(file_memory(g, "me", f"R{f % 5}", f"src/f{f}", 1000))
        assert rows(index.file_memory("me", f"R{f % 5}", f"src/f{f}", 1000)) == want
        asked = spark.createDataFrame([("me", f"R{f % 5}", f"src/f{f}")], "user_id string, repository_id string, relative_path string")
        assert len(want) == index.files_memory(asked, 1000).count()
    merged = index.file_memory("me", "R0", "src/f5", 1000).where("id = 'r0'").first()
    assert merged.entry_ids == ["x15", "x16", "x17"] and [c.entry_id for c in merged.contexts] == ["x16"]
    files = index.rows().where("relative_path = 'src/f5'").select(F.input_file_name()).distinct().count()
    assert 2 <= files <= 9


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_a_build_gives_its_disk_back_and_goes_in_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("annalist.plans.file_index.BUCKET_ROWS", 100)
    g = graph(spark, 200)
    # one file has more memories than a bucket: it is cut, and places count within cuts
    more = spark.range(300).select(F.concat(F.lit("o1"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("observation_id"), F.lit("5").alias("file_id"))
    seen = more.select(F.col("observation_id").alias("id"), F.lit("s0").alias("session_id"), F.col("observation_id").alias("memory_id"), F.lit("p").alias("producer"), F.lit("c").alias("content"), F.lit("t").alias("timestamp"), F.lit("low").alias("relevance"), F.lit(False).alias("dropped"))
    edges = spark.createDataFrame([("r0", "o15"), ("r0", "o16"), ("r0", "o31")], "reflection_id string, observation_id string")
    g = Graph(**{**vars(g), "about": g.about.unionByName(more), "observations": g.observations.unionByName(seen), "supported_by": g.supported_by.unionByName(edges)})
    answers, was = {}, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    for rounds in (1, 3):
        monkeypatch.setattr("annalist.plans.file_index.ROUNDS", rounds)
        monkeypatch.setattr("annalist.plans.file_index.ROUND_BUCKETS", 2)
        before = shuffle_files(spark)
        index = FileIndex.build(g, str(tmp_path / f"index{rounds}"))
        assert shuffle_files(spark) - before == set()
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
        first = index.files_memory(limit=3)
        answers[rounds] = sorted(rows(first.select("user_id", "relative_path", "rank", "id", "content", "entry_ids")))
    assert answers[1] == answers[3] and len({r[:3] for r in answers[1]}) == len(answers[1])
    # the rows of the index are not moved for its first rows, but for those of cut files
    assert exchanges_of(first.where("relative_path <> 'src/f5'"), "content") <= 1
    assert exchanges_of(index.rows().where("not cut and place <= 3"), "content") == 0
    for f in (0, 5, 6, 10):
        for user in ("me", "you"):
            want = [(r.id, r.content, r.entry_ids) for r in file_memory(g, user, f"R{f % 5}", f"src/f{f}", 3).collect()]
            assert [r[3:] for r in answers[3] if r[:2] == (user, f"src/f{f}")] == want
