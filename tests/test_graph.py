import json

import pytest
from pyspark.sql import functions as F

from annalist.operators import evidence, memory, occasions, scope, walks
from annalist.operators.containment import closest_root
from annalist.plans.file_memory import Graph, QueryError, file_memory, probe, query_file, rendered


def graph(spark, **rows):
    schema = {
        "sessions": "id string, user_id string, source_kind string, source_session_id string",
        "observations": "id string, session_id string, memory_id string, producer string, content string, timestamp string, relevance string, dropped boolean",
        "reflections": "id string, session_id string, memory_id string, producer string, content string",
        "about": "observation_id string, file_id string", "supported_by": "reflection_id string, observation_id string", "sourced_from": "observation_id string, entry_urn string",
        "entries": "id string, entry_id string, stream_id string", "touches": "entry_urn string, file_id string, commit string, branch string, dirty boolean", "files": "id string, repository_id string, relative_path string",
    }
    return Graph(**{k: spark.createDataFrame(rows.get(k, []), s) for k, s in schema.items()})


@pytest.fixture(scope="module")
def g(spark):
    o = lambda i, m, text, dropped: (i, "s1", m, "p", text, None, "high", dropped)
    return graph(
        spark,
        sessions=[("s1", "u", "pi", "n1"), ("s2", "other", "pi", "n2")],
        observations=[o("o1", "a", "Dropped one", True), o("o2", "b", "Dropped two", True), o("o3", "c", "Dropped three", True), o("o4", "e", "Legacy", None), o("o5", "f", "Active", False), ("x1", "s2", "z", "p", "Foreign", None, "low", False)],
        reflections=[("r1", "s1", "d", "p", "Reflection")],
        about=[(f"o{i}", "f1") for i in range(1, 6)] + [("x1", "f1")],
        supported_by=[("r1", "o1")],
        sourced_from=[("o4", "E1"), ("o4", "E2"), ("o1", "E1"), ("o5", "E9")],
        entries=[("E1", "e1", None), ("E2", "e2", "agent:1")],
        touches=[("E1", "f1", "abcdef0123", "main", True), ("E1", "f2", "other", "main", False), ("E2", "f1", None, None, None)],
        files=[("f1", "repo", "src/a.py"), ("f2", "repo", "src/b.py")],
    )


def test_dropped_are_removed_before_the_limit(g):
    got = file_memory(g, "u", "repo", "src/a.py").collect()
    assert [(r.kind, r.content) for r in got] == [("observation", "Legacy"), ("observation", "Active"), ("reflection", "Reflection")]
    assert [r.content for r in file_memory(g, "u", "repo", "src/a.py", limit=2).collect()] == ["Legacy", "Active"]


def test_provenance(g):
    legacy, active, reflection = file_memory(g, "u", "repo", "src/a.py").collect()
    assert legacy.entry_ids == ["e1", "e2"]
    assert [(s.stream_id, s.entry_id) for s in legacy.source_entries] == [("agent:1", "e2"), ("main", "e1")]
    assert [(c.entry_id, c.commit, c.branch, c.dirty) for c in legacy.contexts] == [("e1", "abcdef0123", "main", True)]
    assert active.entry_ids == [] and reflection.entry_ids == ["e1"]


def test_isolation(g):
    assert [r.content for r in file_memory(g, "other", "repo", "src/a.py").collect()] == ["Foreign"]
    assert file_memory(g, "nobody", "repo", "src/a.py").count() == 0


def test_rendering_and_probe(g):
    rows = file_memory(g, "u", "repo", "src/a.py", limit=3)
    assert rendered(rows).first().text == "[observation e] Legacy | entries: e1, e2 | main · main @ abcdef0 (dirty)"
    page, more = probe(rows, 2)
    assert page.count() == 2 and more


def test_typed_errors(spark, g):
    repos = spark.createDataFrame([("repo", "h/o/r")], "id string, normalized_origin string")
    ask = lambda *a, **k: query_file(g, repos, "u", *a, **k)
    assert ask("src/a.py", origin="git@h:o/r.git").count() == 3
    assert ask("a.py", worktree=("repo", "/w/src/..")).count() == 0
    for args, code in (((" ",), "missing-path"), (("a", "nonsense"), "invalid-origin"), (("../a", "git@h:o/r"), "invalid-origin-path"), (("a/./b", "git@h:o/r"), "invalid-origin-path"), (("a", "git@h:o/x"), "repository-not-found")):
        with pytest.raises(QueryError) as e:
            ask(*args)
        assert e.value.code == code
    with pytest.raises(QueryError) as e:
        ask("/else/a", worktree=("repo", "/w"))
    assert e.value.code == "path-outside-repository"


def test_closest_root(spark):
    paths = spark.createDataFrame([("/w/a/x.py",), ("/w/a/nested/y.py",), ("/wide/z",), ("/w",)], "path string")
    roots = spark.createDataFrame([("/w", "r0"), ("/w/a", "r1"), ("/w/a/nested", "r2")], "root string, repository_id string")
    assert {(r.path, r.repository_id) for r in closest_root(paths, roots).collect()} == {("/w/a/x.py", "r1"), ("/w/a/nested/y.py", "r2")}


E = "session_id string, stream_id string, entry_id string, record_uuid string, parent_id string, logical_parent_id string, request_id string, ordinal long, cwd string, raw_json string"


def session_rows(*values):
    return [("s", "main", v["id"], None, v["parentId"], None, None, i, None, json.dumps(v)) for i, v in enumerate(values)]


def call(id_, parent, *calls):
    return {"type": "message", "id": id_, "parentId": parent, "message": {"role": "assistant", "content": [{"type": "text", "text": "x"}, *[{"type": "toolCall", "id": c, "name": n, "arguments": {"path": p}} for c, n, p in calls]]}}


def result(id_, parent, call_id):
    return {"type": "message", "id": id_, "parentId": parent, "message": {"role": "toolResult", "toolCallId": call_id, "content": "text"}}


def test_the_root_of_all_contains_all(spark):
    from annalist.operators.containment import ancestor_paths, relative_path

    paths = spark.createDataFrame([("/w/a.py",), ("/x.py",), ("/",), ("rel/y.py",), ("",)], "path string")
    roots = spark.createDataFrame([("all", "/"), ("w", "/w"), ("none", "")], "repository_id string, root string")
    found = closest_root(paths, roots).withColumn("rest", relative_path(F.col("path"), F.col("root")))
    assert {(r.path, r.repository_id, r.rest) for r in found.collect()} == {("/w/a.py", "w", "a.py"), ("/x.py", "all", "x.py")}
    assert spark.range(1).select(ancestor_paths(F.lit("/a/b/c"))).first()[0] == ["/", "/a", "/a/b"]


def user(id_, parent, content="do it", **more):
    return {"type": "message", "id": id_, "parentId": parent, "message": {"role": "user", "content": content}, **more}


def trees(spark):
    return spark.createDataFrame([("R", "/w", "c1", "main", False), ("N", "/w/sub", "c2", None, True)], "repository_id string, root string, commit string, branch string, dirty boolean")


def test_session_evidence(spark):
    values = [user("u", None), call("a", "u", ("t1", "read", "src/a.py"), ("t2", "bash", "x"), ("t3", "edit", "/w/sub/b.py")), result("r1", "a", "t1"), result("r2", "r1", "t9"), call("off", "u", ("t1", "write", "other.py"))]
    df = spark.createDataFrame(session_rows(*values), E)
    leaf = spark.createDataFrame([("s", "r2")], "session_id string, current_leaf_id string")
    chosen = evidence.selected_session_entries(df, leaf)
    assert {r.entry_id for r in chosen.collect()} == {"u", "a", "r1", "r2"}
    files, touches = evidence.session_evidence(chosen, trees(spark), F.lit("/w"))
    assert {(f.repository_id, f.relative_path) for f in files.collect()} == {("R", "src/a.py"), ("N", "b.py")}
    paths = {f.id: f.relative_path for f in files.collect()}
    assert {(t.entry_id, paths[t.file_id], t.commit, t.dirty) for t in touches.collect()} == {("a", "src/a.py", "c1", False), ("a", "b.py", "c2", True), ("r1", "src/a.py", "c1", False)}


def transcript_rows(*values, stream="main"):
    out = []
    for i, v in enumerate(values):
        out.append(("s", stream, v["uuid"], v["uuid"], v.get("parentUuid"), v.get("logicalParentUuid"), v.get("requestId"), i, "/w", json.dumps(v | {"sessionId": "n"} | ({"agentId": stream[6:]} if stream != "main" else {}))))
    return out


def t_use(uuid, parent, *calls, request=None, name="Read"):
    return {"type": "assistant", "uuid": uuid, "parentUuid": parent, "requestId": request, "message": {"role": "assistant", "content": [{"type": "tool_use", "id": c, "name": name, "input": {"file_path": p}} for c, p in calls]}}


def t_result(uuid, parent, source, *calls, **more):
    return {"type": "user", "uuid": uuid, "parentUuid": parent, "sourceToolAssistantUUID": source, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": c, "content": "x"} for c in calls]}, **more}


def t_user(uuid, parent, content="please", **more):
    return {"type": "user", "uuid": uuid, "parentUuid": parent, "message": {"role": "user", "content": content}, **more}


def test_transcript_selection_and_evidence(spark):
    values = [
        t_user("u", None), t_use("a1", "u", ("t1", "a.py"), request="q"), t_use("a2", "a1", ("t2", "b.py"), request="q"), t_result("r1", "a1", "a1", "t1"), t_result("r2", "a2", "a2", "t2"),
        t_use("lost", "u", ("t8", "gone.py")), t_result("bad", "r1", "nobody", "t1"), t_use("end", "r1", ("t3", "c.py")),
    ]
    df = spark.createDataFrame(transcript_rows(*values) + transcript_rows(t_use("k", None, ("t4", "d.py")), stream="agent:1"), E)
    leaves = spark.createDataFrame([("s", "end")], "session_id string, current_leaf_id string")
    chosen = evidence.selected_transcript_entries(df, leaves)
    assert {r.entry_id for r in chosen.collect()} == {"u", "a1", "a2", "r1", "r2", "end", "k"}
    files, touches, notes = evidence.transcript_evidence(chosen, trees(spark))
    paths = {f.id: f.relative_path for f in files.collect()}
    assert {(t.stream_id, t.entry_id, paths[t.file_id]) for t in touches.collect()} == {
        ("main", "a1", "a.py"), ("main", "a2", "b.py"), ("main", "r1", "a.py"), ("main", "r2", "b.py"), ("main", "end", "c.py"), ("agent:1", "k", "d.py"),
    }
    assert notes.count() == 0
    twice = spark.createDataFrame(transcript_rows(t_use("a1", None, ("t1", "a.py")), t_use("a2", "a1", ("t1", "b.py"))), E)
    assert [(n.tool_use_id, n.entry_ids) for n in evidence.transcript_evidence(twice, trees(spark))[2].collect()] == [("t1", ["a1", "a2"])]


def test_deep_and_cyclic_ancestry(spark):
    deep = [("d", str(i), str(i - 1) if i else None, i == 4999) for i in range(5000)]
    cycle = [("c", "x", "y", True), ("c", "y", "x", False)]
    df = spark.createDataFrame(deep + cycle, "session_id string, entry_id string, parent_id string, is_leaf boolean")
    assert {r.session_id: r["count"] for r in walks.ancestors(df).groupBy("session_id").count().collect()} == {"d": 5000, "c": 2}


def test_lineage_with_cycle_and_bound(spark):
    ids = spark.createDataFrame([("a",), ("z",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "b")], "child string, parent string")
    assert {(r.id, r.ancestor, r.depth) for r in walks.lineage(ids, edges).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("z", "z", 0)}
    assert walks.lineage(ids, edges, most=1).count() == 3


def anchor(kind, rows, stream, entry):
    return occasions.Session.of("S", kind, "n", [(r[1], r[2], r[9]) for r in rows]).anchor(stream, entry)


@pytest.mark.parametrize(
    ("values", "at", "want"),
    [
        ([user("u", None), call("a", "u", ("t", "read", "x")), result("r", "a", "t")], "r", "u"),
        ([user("u", None), call("a", "u")], "a", "u"),
        ([user("u", None, [{"type": "image"}])], "u", "u"),
        ([user("u", None, "  ")], "u", None),
        ([user("u", None, isSynthetic=True)], "u", None),
        ([user("u", None, "<system-reminder> x")], "u", None),
        ([user("u", None), {"type": "compaction", "id": "k", "parentId": "u"}, call("a", "k")], "a", None),
        ([call("a", "b"), call("b", "a")], "a", None),
        ([user("u", None), call("a", "u", ("t", "read", "x")), call("b", "u", ("t", "read", "x")), result("r", "a", "t")], "r", None),
        ([user("u", None)], "nope", None),
    ],
)
def test_session_occasions(values, at, want):
    assert anchor("pi", session_rows(*values), "main", at) == (("main", want) if want else None)


def test_transcript_occasions():
    parent = transcript_rows(
        t_user("u", None), t_use("a", "u", ("t1", "x"), ("t2", "y"), name="Agent", request="q"), t_result("r", "a", "a", "t1", "t2", toolUseResult={"agentId": "7"}),
        {"type": "system", "uuid": "cut", "parentUuid": None, "logicalParentUuid": "r", "subtype": "compact_boundary"}, t_use("b", "cut", ("t3", "z"), request="q2"), t_use("frag", None, ("t4", "z"), request="q2"),
        t_user("meta", "b", isMeta=True), t_user("cmd", "b", "<command-name>x"), t_user("typed", "b", "<command-name>x", promptSource="typed"), t_user("odd", "b", promptSource="robot"),
    )
    child = transcript_rows(t_user("c0", None), t_use("c1", "c0", ("k", "x")), stream="agent:7")
    rows = parent + child
    ask = lambda stream, entry: anchor("claude-code", rows, stream, entry)
    assert ask("main", "r") == ask("main", "a") == ask("main", "b") == ("main", "u")
    assert ask("main", "frag") == ("main", "u")  # through the other fragment of its request
    assert ask("agent:7", "c1") == ("main", "u")
    assert ask("main", "meta") is None and ask("main", "cmd") is None and ask("main", "odd") is None
    assert ask("main", "typed") == ("main", "typed")


def test_verified_occasions_follow_forks_and_drop_copies(spark):
    base, more = [user("u", None), call("a", "u")], [user("u2", "a"), call("b", "u2")]
    rows = [("P", *r[1:]) for r in session_rows(*base)] + [("C", *r[1:]) for r in session_rows(*base, *more)] + [("X", *r[1:]) for r in session_rows(*base)]
    entries = spark.createDataFrame(rows, E)
    S = "id string, user_id string, source_kind string, source_session_id string, parent_session string, parent_ids array<string>"
    sessions = spark.createDataFrame([("P", "me", "pi", "p", None, []), ("C", "me", "pi", "c", "p.jsonl", ["P"]), ("X", "me", "pi", "x", "unknown.jsonl", [])], S)
    cite = lambda i, s, *e: (i, s, [("main", x) for x in e])
    m = spark.createDataFrame([cite("m1", "C", "a", "b"), cite("m2", "P", "a"), cite("m3", "X", "a")], "id string, session_id string, source_entries array<struct<stream_id:string,entry_id:string>>")
    got = {r.id: [(o.session_id, o.entry_id) for o in r.source_occasions] for r in occasions.verified_occasions(m, entries, sessions).collect()}
    assert got == {"m1": [("C", "u2"), ("P", "u")], "m2": [("P", "u")], "m3": []}


def test_copied_transcript_requests_are_nobodys(spark):
    rows = [(s, *r[1:]) for s in ("A", "B") for r in transcript_rows(t_user("u", None))] + [("A", *r[1:]) for r in transcript_rows(t_user("v", None))]
    rows = [r[:9] + (json.dumps(json.loads(r[9]) | {"sessionId": r[0]}),) for r in rows]
    sessions = spark.createDataFrame([(s, "me", "claude-code", s, None, []) for s in "AB"], "id string, user_id string, source_kind string, source_session_id string, parent_session string, parent_ids array<string>")
    m = spark.createDataFrame([("m1", "A", [("main", "u")]), ("m2", "A", [("main", "v")])], "id string, session_id string, source_entries array<struct<stream_id:string,entry_id:string>>")
    got = {r.id: len(r.source_occasions) for r in occasions.verified_occasions(m, spark.createDataFrame(rows, E), sessions).collect()}
    assert got == {"m1": 0, "m2": 1}


def test_repository_scope(spark):
    obs = spark.createDataFrame([("oa", "s1"), ("ob", "s1"), ("un", "s1"), ("un2", "s2"), ("lost", "s1")], "id string, session_id string")
    about = spark.createDataFrame([("oa", "fa"), ("ob", "fb"), ("lost", "fx")], "observation_id string, file_id string")
    files = spark.createDataFrame([("fa", "A"), ("fb", "B")], "id string, repository_id string")
    worked = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s2", "B")], "session_id string, repository_id string")
    seen = scope.observation_scope(obs, about, files, worked)
    assert {r.id: r.repository_ids for r in seen.collect()} == {"oa": ["A"], "ob": ["B"], "un": ["A"], "un2": [], "lost": []}
    refs = spark.createDataFrame([("mixed", "s1", ["oa", "ob"]), ("ctx", "s1", ["un", "ob"]), ("none", "s2", ["un2"])], "id string, session_id string, support_ids array<string>")
    assert {r.id: r.repository_ids for r in scope.reflection_scope(refs, seen).collect()} == {"mixed": ["A", "B"], "ctx": ["A", "B"], "none": []}


def test_projection_end_to_end(spark, tmp_path):
    from annalist.operators.memory import Memories
    from annalist.plans import projection
    from annalist.plans.catalog import Catalog

    base = "source_kind string, source_session_id string, producer string, memory_id string, content string"
    o = spark.createDataFrame([("pi", "n", "p", "a" * 12, "text", [("main", "e1"), ("main", "gone")], False)], base + ", source_entries array<struct<stream_id:string,entry_id:string>>, dropped boolean")
    r = spark.createDataFrame([("pi", "n", "p", "b" * 12, "sum", ["a" * 12])], base + ", supporting_observation_ids array<string>")
    notes = spark.createDataFrame([], "source_kind string, source_session_id string, producer string, origin int, ordinal long, at int, record_id string, memory_id string, reason string, memory_kind string, nth int")
    u = F.lit("user")
    entries = projection.entries_table(spark.createDataFrame([("n", "main", "e1")], "session_id string, stream_id string, entry_id string"), u, "pi")
    sid = entries.first().session_id
    touches = spark.createDataFrame([(sid, "main", "e1", "f1")], "session_id string, stream_id string, entry_id string, file_id string")
    p = projection.project(Memories(o, r, notes), entries, touches, u)
    assert p.about.count() == 1 and p.sourced_from.count() == 1 and p.supported_by.count() == 1
    assert [(d.reason, d.memory_id) for d in p.diagnostics.collect()] == [("unresolved-reference", "a" * 12)]
    catalog = Catalog(spark, str(tmp_path / "cat"))
    scope_ = spark.createDataFrame([(sid,)], "session_id string")
    for _ in range(2):  # a repeated replacement changes nothing
        projection.replace_projection(catalog, p, scope_)
        assert catalog.read("observations").count() == 1 and catalog.read("about").count() == 1
    sessions = spark.createDataFrame([("p1", "u", "pi", "x", None, "/a/p.jsonl"), ("c1", "u", "pi", "y", "/else/p.jsonl", "/a/c.jsonl"), ("d1", "v", "pi", "z", "x", "/a/d.jsonl"), ("self", "u", "pi", "w", "w", "/a/w.jsonl")], "id string, user_id string, source_kind string, source_session_id string, parent_session string, source_file string")
    assert [(e.child, e.parent) for e in projection.fork_edges(sessions).collect()] == [("c1", "p1")]
    assert memory.MAX_DIAGNOSTICS == 100
