"""Replication of scanned logs, and the corpus a derivation reads."""

import pytest
from pyspark.sql import functions as F

from annalist.operators import derive, inputs
from annalist.operators.evidence import file_repositories
from annalist.operators.selection import SelectionError
from annalist.plans.catalog import Catalog, SnapshotConflict
from annalist.plans.projection import fill_missing
from annalist.plans.replicate import replicate, with_leaves
from annalist.plans.saved_reads import rendered_runs, saved_text

LOG = "log_id string, session_id string, log_hash string, entry_count long, log_bytes long, header_next_byte_offset long, header_prefix_hash string, largest_entry_bytes long, has_final_newline boolean, source_file string, semantic_conflict boolean"
ENTRY = "log_id string, id string, ordinal long, payload_hash string, payload_bytes long, next_byte_offset long, prefix_hash string, raw_json string"


def scan(spark, logs, semantic=(), start="h"):
    """logs: {log: [payload of each entry, or (id, payload)]}; an entry is 10 bytes, and its prefix hash names all payloads up to it."""
    summaries, entries = [], []
    for log, values in logs.items():
        prefix = start
        for i, v in enumerate(values):
            id_, body = v if isinstance(v, tuple) else (f"{log}{i}", v)
            prefix += body
            entries.append((log, id_, i, body, 10, 10 * (i + 2), prefix, body * 3))
        summaries.append((log, log[0], prefix, len(values), 10 * (len(values) + 1), 10, start, 10, True, f"/{log}", log in semantic))
    return spark.createDataFrame(summaries, LOG), spark.createDataFrame(entries, ENTRY)


def report(df):
    return {r.log_id: (r.status, r.reason, r.entries_written, r.batches_written) for r in df.collect()}


def streams(catalog):
    return {r.log_id: r for r in catalog.read("streams").collect()}


def test_logs_grow_and_conflict_each_by_itself(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    assert report(replicate(c, *scan(spark, {"a": "xyz", "b": "x", "e": ""}), limit=20)) == {"a": ("mirrored", None, 3, 2), "b": ("mirrored", None, 1, 1), "e": ("mirrored", None, 0, 0)}
    assert [(r.ordinal, r.byte_offset, r.prefix_hash, r.entry_count, r.log_bytes) for r in (streams(c)["a"], streams(c)["e"])] == [(2, 40, "hxyz", 3, 40), (-1, 10, "h", 0, 10)]
    # a is as it was, b was rewritten, d's second batch holds a known id with another payload, e has grown
    again = {"a": "xyz", "b": "yy", "d": ["p", "q", "r", ("a0", "other"), "s"], "e": "k"}
    assert report(replicate(c, *scan(spark, again), limit=20)) == {
        "a": ("unchanged", None, 0, 0), "b": ("conflict", "prefix-mismatch", 0, 0), "d": ("conflict", "payload-mismatch", 0, 0), "e": ("mirrored", None, 1, 1)
    }
    s = streams(c)
    assert (s["d"].ordinal, s["d"].byte_offset, s["d"].entry_count, s["d"].conflicted, s["d"].conflict_class, s["d"].conflict_source_file) == (1, 30, None, True, "physical", "/d")
    assert (s["b"].ordinal, s["b"].log_hash, s["b"].conflict_reason) == (0, "hx", "prefix-mismatch")
    assert sorted(r.id for r in c.read("records").collect()) == ["a0", "a1", "a2", "b0", "d0", "d1", "e0"]
    assert {r.raw_json for r in c.read("records").where("id = 'a0'").collect()} == {"xxx"}
    # d is mended and goes on where it stopped; b's shorter log does not reach its checkpoint
    assert report(replicate(c, *scan(spark, {"b": "", "d": "pqrs"}), limit=20)) == {"b": ("conflict", "checkpoint-out-of-range", 0, 0), "d": ("mirrored", None, 2, 1)}
    assert not streams(c)["d"].conflicted and streams(c)["d"].conflict_reason is None and c.read("members").where("log_id = 'd'").count() == 4


def test_known_payloads_are_shared_and_clashes_between_new_logs_are_found(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    got = report(replicate(c, *scan(spark, {"a": [("i", "x"), ("i", "x"), ("j", "y")], "b": [("i", "x"), ("j", "z")]}), limit=10))
    assert got == {"a": ("mirrored", None, 3, 3), "b": ("conflict", "payload-mismatch", 0, 0)}
    assert c.read("records").count() == 2 and c.read("members").count() == 4


def test_sessions_marks_and_semantic_conflicts(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c", {"sessions": ("id", 2)})
    c.write("sessions", spark.createDataFrame([("a", None, "l"), ("z", 4, "m")], "id string, memory_revision long, current_leaf_id string"))
    assert report(replicate(c, *scan(spark, {"a1": "x", "a2": "y", "q1": "x"}, semantic=["a2"]), sessions=True)) == {"a1": ("mirrored", None, 1, 1), "a2": ("mirrored", None, 1, 1), "q1": ("rejected", "missing-source-session", 0, 0)}
    assert (streams(c)["a2"].conflicted, streams(c)["a2"].conflict_class) == (True, "semantic") and "q1" not in streams(c)
    assert sorted((r.id, r.memory_revision) for r in c.read("sessions").collect()) == [("a", 1), ("z", 4)]
    replicate(c, *scan(spark, {"a2": "y"}), sessions=True, clears=False)
    assert streams(c)["a2"].conflicted
    replicate(c, *scan(spark, {"a2": "y"}), sessions=True)
    assert not streams(c)["a2"].conflicted and c.read("sessions").where("id = 'a'").first().memory_revision == 3
    leaves = spark.createDataFrame([("a", None), ("new", "n")], "id string, current_leaf_id string")
    assert sorted((r.id, r.current_leaf_id) for r in with_leaves(c.read("sessions"), leaves).collect()) == [("a", None), ("z", "m")]


def test_nothing_and_two_writers(spark, tmp_path, monkeypatch):
    c = Catalog(spark, f"file://{tmp_path}/c")
    assert report(replicate(c, *scan(spark, {}))) == {}
    written = c._written

    def slow(name, *args):
        monkeypatch.setattr(c, "_written", written)
        replicate(Catalog(spark, c.root), *scan(spark, {"a": "x"}))
        return written(name, *args)

    monkeypatch.setattr(c, "_written", slow)
    with pytest.raises(SnapshotConflict):
        replicate(c, *scan(spark, {"a": "xy"}))
    assert streams(c)["a"].ordinal == 0
    assert report(replicate(c, *scan(spark, {"a": "xy"}))) == {"a": ("mirrored", None, 1, 1)}


def test_generation_input(spark):
    m = [
        ("o1", "observation", "u", "s", "pi", "n", " ", "m1", "one", None, None), ("o2", "observation", "u", "s", "pi", "n", "p", "m2", "two", True, None), ("o3", "observation", "v", "t", "cc", "n", "p", "m3", "three", False, None),
        ("x", "observation", "w", "k", "pi", "n", "p", "m9", "hidden", False, None), ("twice", "observation", "u", "s", "pi", "n", "p", "m4", "t", False, None), ("twice", "observation", "w", "k", "pi", "n", "p", "m4", "t", False, None),
        ("r1", "reflection", "u", "s", "pi", "n", None, "m5", "sum", None, ["m1"]), ("r2", "reflection", "u", "s", "pi", "n", "p", "m6", "sum", None, ["m1"]), ("r3", "reflection", "u", "s", "pi", "n", "p", "m7", "sum", None, ["m2", "m2"]),
    ]
    t = inputs.Tables(
        spark.createDataFrame(m, "id string, kind string, owner_id string, session_id string, source_kind string, source_session_id string, producer string, memory_id string, content string, dropped boolean, supporting_observation_ids array<string>"),
        spark.createDataFrame([("o1", "s", None, "e"), ("o1", "s", None, "e"), ("o1", "other", "main", "f")], "observation_id string, session_id string, stream_id string, entry_id string"),
        spark.createDataFrame([("r1", "o1"), ("r2", "o1"), ("r3", "o2")], "reflection_id string, observation_id string"),
        spark.createDataFrame([("o1", "f1"), ("o3", "f2")], "observation_id string, file_id string"),
        spark.createDataFrame([("f1", "A", "a.py"), ("f2", None, "b.py")], "id string, repository_id string, relative_path string"),
        spark.createDataFrame([("A", "h/a"), ("B", None)], "id string, normalized_origin string"),
        spark.createDataFrame([("s", "B"), ("t", "B")], "session_id string, repository_id string"),
    )
    grants = spark.createDataFrame([("v", "u", "read"), ("w", "u", "write")], "owner_id string, reader_id string, permission string")
    got = {r.id: r for r in inputs.input_rows(t, "u", grants).collect()}
    assert sorted(got) == ["o1", "o2", "o3", "r1", "r2", "r3", "twice"]
    assert {i for i, r in got.items() if not r.ok} == {"twice", "r2", "r3"}  # two owners, another producer, a support declared twice
    assert got["o1"].producer == got["r1"].producer == inputs.DEFAULT_PRODUCER and [tuple(e) for e in got["o1"].source_entries] == [("main", "e")]
    assert (got["r1"].linked_paths, got["r1"].repository_ids, got["r1"].repository_origins, got["r1"].supporting_memory_ids) == (["a.py"], ["A"], ["h/a"], ["o1"])
    assert got["o2"].dropped and got["o2"].repository_ids == ["B"] and got["o2"].repository_origins == []
    assert got["o3"].repository_ids == [] and got["o3"].linked_paths == ["b.py"]  # a file of no known repository
    with pytest.raises(SelectionError) as e:
        inputs.load_input(t, "u", grants)
    assert e.value.code == "unresolved-evidence" and "3 " in str(e.value)
    t.memories = t.memories.where("id in ('o1', 'o3', 'r1')")
    assert "ok" not in inputs.load_input(t, "u", grants).columns and inputs.load_input(t, "nobody", grants).count() == 0


def test_generation_input_reads_edges_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    n = F.col("id").cast("string")
    ids = spark.range(40)
    m = ids.select(F.concat(F.lit("o"), n).alias("id"), F.lit("observation").alias("kind"), F.lit("u").alias("owner_id"), F.lit("s").alias("session_id"), F.lit("pi").alias("source_kind"), F.lit("n").alias("source_session_id"), F.lit("p").alias("producer"),
                   n.alias("memory_id"), F.lit("c").alias("content"), F.lit(False).alias("dropped"), F.lit(None).cast("array<string>").alias("supporting_observation_ids"))
    m = m.unionByName(m.withColumns({"id": F.concat(F.lit("r"), "id"), "kind": F.lit("reflection"), "supporting_observation_ids": F.array("memory_id")}))
    m = m.withColumn("session_id", F.when(F.col("id") != "o7", F.col("session_id")))
    about = ids.select(F.concat(F.lit("o"), n).alias("observation_id"), F.concat(F.lit("f"), (F.col("id") % 4).cast("string")).alias("file_id"))
    files = spark.createDataFrame([("f0", "A", "a"), ("f1", "B", "b"), ("f2", None, "c")], "id string, repository_id string, relative_path string")
    up = ids.select(F.concat(F.lit("ro"), n).alias("reflection_id"), F.concat(F.lit("o"), n).alias("observation_id")).unionByName(spark.createDataFrame([("ro3", "o0"), ("ro3", "gone")], "reflection_id string, observation_id string"))
    t = inputs.Tables(m, spark.createDataFrame([], "observation_id string, session_id string, stream_id string, entry_id string"), up, about.mapInArrow(counted, about.schema), files,
                      spark.createDataFrame([("A", "h/a"), ("B", "h/b")], "id string, normalized_origin string"), spark.createDataFrame([("s", "W")], "session_id string, repository_id string"))
    got = {r.id: r for r in inputs.input_rows(t, "u", spark.createDataFrame([], "owner_id string, reader_id string, permission string")).collect()}
    assert len(got) == 80 and reads.value == 40
    assert (got["ro3"].linked_paths, got["ro3"].repository_ids, got["ro3"].repository_origins, got["ro3"].ok) == (["a"], ["A"], ["h/a"], False)
    # a file that is not known is evidence of nothing; an observation of no session has paths and no scope
    assert (got["o3"].linked_paths, got["o3"].repository_ids) == ([], []) and (got["o7"].linked_paths, got["o7"].repository_ids, got["o7"].ok) == ([], [], False)
    assert (got["ro4"].linked_paths, got["ro4"].repository_ids, got["ro4"].ok) == (["a"], ["A"], True) and got["o2"].repository_ids == [] and got["o2"].linked_paths == ["c"]


def test_nested_repositories(spark):
    locators = spark.createDataFrame([(1, "/w", "a/x.py"), (2, "/w", "a/sub/x.py"), (3, "/w/a", "../b.py"), (4, None, "/w/a/sub/deep/y"), (5, "/w", " "), (6, "/w", "a/sub")], "n int, cwd string, path string")
    worktrees = spark.createDataFrame([("A", "/w/a"), ("D", "/w/a/sub/deep")], "repository_id string, root string")
    own = spark.createDataFrame([("/w/a",), ("/w/a/sub",), ("/w/a/sub/deep",)], "directory string")
    got = {r.n: (r.repository_id, r.root, r.nested) for r in file_repositories(locators, worktrees, own).collect()}
    assert got == {1: ("A", "/w/a", False), 2: (None, "/w/a/sub", True), 3: (None, None, False), 4: ("D", "/w/a/sub/deep", False), 5: (None, None, False), 6: ("A", "/w/a", False)}


def test_token_estimate():
    assert derive.token_estimate(len)("abc", "de") == 32 + 6 and derive.token_estimate(len)("") == 32 and derive.token_estimate(len)("x" * 11) == 32 + 14
    named = {"m": "o200k_base", "old": "p50k_base"}.get
    assert [derive.model_encoding({"provider": p, "id": i}, named) for p, i in (("openai", "m"), ("openai", "old"), ("openai-codex", "new"), ("other", "m"))] == ["o200k_base", None, "o200k_base", None]


def test_saved_runs_as_text(spark):
    items = spark.createDataFrame(
        [(1, "r1", "style", "language", "py", None, "available", "current", "2026", "m"), (2, "r2", "style", "none", None, "active", "unauthorized", None, "2026", "m"), (3, "r3", "s", "none", None, "full", "available", "unavailable", "2026", "m"),
         (4, "r4", 'a"b', "none", None, "full", "available", None, "2026", "m")],
        "position int, id string, name string, filter_type string, filter_value string, depth string, status string, freshness string, created_at string, model string",
    )
    conclusions = spark.createDataFrame(
        [("r1", 1, "c2", "two", "x", "agreement", "user", ["u"], ["m1"], ["gone"]), ("r1", 0, "c1", "one", "x", "agreement", "repository", ["A", "B"], ["m1", "m2"], []), ("r3", 0, "c3", "secret", "x", "y", "user", ["u"], ["m1"], [])],
        "run_id string, position int, id string, content string, category string, basis string, scope_type string, scope_subject_ids array<string>, supporting_memory_ids array<string>, conflicting_memory_ids array<string>",
    )
    links = spark.createDataFrame([("c1", "c2", "refines"), ("c2", "c3", "replaces")], "from_id string, to_id string, relation string")
    memories = spark.createDataFrame([("m1", "u", "s", "p", "observation", "seen\n", [("main", "e2"), ("main", "e1"), ("main", "e2")]), ("m2", "v", "t", "p", "reflection", "sum", [])], "id string, owner_id string, session_id string, producer string, kind string, content string, source_entries array<struct<stream_id:string,entry_id:string>>")
    rows = rendered_runs(items, conclusions, links, memories).collect()
    assert [(r.position, r.status) for r in rows] == [(1, "available"), (2, "unauthorized"), (3, "unavailable"), (4, "available")]
    assert rows[0].text.split("\n") == [
        '"style" for language "py", depth full, current', '  run "r1" of "2026" by "m"', '  "c1" [agreement, x] "one"', '    about repository "A", "B"; supports: 2, conflicts: 0',
        '  "c2" [agreement, x] "two"', '    about user "u"; supports: 1, conflicts: 1 (there is evidence against it)', '  "c1" refines "c2"', "  a relation to a result that is not shown",
    ]
    assert rows[1].text == "a saved result that is unauthorized" and rows[3].text == '"a\\"b" for none, depth full, unknown\n  run "r4" of "2026" by "m"\n  no conclusions'
    assert not any("secret" in r.text or "c3" in r.text for r in rows)
    one = rendered_runs(items, conclusions, links, memories, evidence="c2").collect()
    assert [r.position for r in one] == [1, 2, 3] and "c1\" [" not in one[0].text
    assert one[0].text.split("\n")[4:7] == ['    supported by "m1": observation of "p", owner "u", session "s", citing "main"/"e1", "main"/"e2"', '      "seen\\n"', '    contradicted by "gone": not available']
    assert saved_text(rendered_runs(items.limit(0), conclusions, links, memories)) == "No saved results."
    assert saved_text(rendered_runs(items, conclusions, links, memories), more=True).endswith("There are more saved results.")


def test_streams_whose_files_are_gone_come_from_the_replica(spark):
    schema = "session_id string, stream_id string, entry_id string"
    scanned, mirrored = spark.createDataFrame([("s", "main", "1")], schema), spark.createDataFrame([("s", "main", "old"), ("s", "agent", "2"), ("t", "agent", "3")], schema)
    got = fill_missing(scanned, spark.createDataFrame([("s", "agent")], "session_id string, stream_id string"), mirrored)
    assert sorted(tuple(r) for r in got.collect()) == [("s", "agent", "2"), ("s", "main", "1")]
