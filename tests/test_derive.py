import json
import uuid

import pytest

from annalist.operators import derive, runs, selection
from annalist.plans import pages
from annalist.plans.catalog import Catalog, SnapshotConflict, advance_checkpoints, effective_version, rekey
from annalist.sources import recipes, spool

M = "id string, owner_id string, session_id string, kind string, dropped boolean, supporting_memory_ids array<string>, repository_origins array<string>, linked_paths array<string>, source_occasions array<struct<session_id:string,stream_id:string,entry_id:string>>"
G = "owner_id string, reader_id string, permission string"


def occ(user, kind, session, entry):
    return (f"urn:x:session:{user}:{kind}:{session}", "main", entry)


@pytest.fixture(scope="module")
def memories(spark):
    o = lambda i, owner="me", dropped=False, origins=(), paths=(), occasions=(): (i, owner, f"s-{owner}", "observation", dropped, None, list(origins), list(paths), list(occasions))
    return spark.createDataFrame(
        [
            o("o1", origins=["git@h:o/r.git"], paths=["a.py"], occasions=[occ("me", "pi", "n", "e1")]), o("o2", dropped=True, occasions=[occ("me", "pi", "n", "e2")]), o("o3", owner="friend", occasions=[occ("friend", "pi", "n", "e1")]), o("o4", owner="stranger"),
            ("r1", "me", "s-me", "reflection", None, ["o1", "o2"], [], [], []),
        ],
        M,
    )


@pytest.fixture(scope="module")
def grants(spark):
    return spark.createDataFrame([("friend", "me", "read"), ("stranger", "me", "write"), ("me", "stranger", "read")], G)


def chosen(memories, grants, **more):
    s = selection.select_input(memories, "me", grants, **more)
    return {r.id: r.roles for r in s.memories.collect()}, sorted(r.id for r in s.candidates.collect()), s


def test_selection(memories, grants):
    roles, candidates, _ = chosen(memories, grants)
    assert candidates == ["o1", "o3", "r1"]
    assert roles == {"o1": ["evidence", "historical-support"], "o2": ["historical-support"], "o3": ["evidence"], "r1": ["evidence"]}
    assert chosen(memories, grants, depth="observations")[1] == ["o1", "o3"]
    roles, candidates, s = chosen(memories, grants, depth="reflections")
    assert candidates == ["r1"] and set(roles) == {"o1", "o2", "r1"}  # supports stay dependencies
    assert [r.id for r in s.memories.where(selection.visible("reflections")).collect()] == ["r1"]
    assert chosen(memories, grants, filter_kind="repository", filter_value="https://h/o/r")[1] == ["o1"]
    assert chosen(memories, grants, filter_kind="language", filter_value="py")[1] == ["o1"]
    assert chosen(memories, grants, filter_kind="session", filter_value="s-friend")[1] == ["o3"]


def test_comparison_needs_all_inputs(spark, memories, grants):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    roles, _, s = chosen(memories, grants, comparison_ids=ids("o3"))
    assert s.comparison_available and roles["o3"] == ["comparison-dependency", "evidence"]
    assert not chosen(memories, grants, comparison_ids=ids("o4"))[2].comparison_available


def test_selection_errors(spark, memories, grants):
    def code(rows):
        with pytest.raises(selection.SelectionError) as e:
            selection.select_input(memories.unionByName(spark.createDataFrame(rows, M)), "me", grants)
        return e.value.code

    ref = lambda *s: ("r9", "me", "s", "reflection", None, list(s), [], [], [])
    assert code([ref("gone")]) == "unresolved-evidence"
    assert code([ref("o4")]) == "unauthorized"
    assert code([ref("r1")]) == "unresolved-evidence"
    assert code([("o1", "me", "s", "observation", None, None, [], [], [])]) == "invalid-memory"


def test_distinct_occasions(spark, memories):
    c = spark.createDataFrame([("c1", ["r1"]), ("c2", ["o1", "o3"]), ("c3", ["o4"])], "id string, supporting_memory_ids array<string>")
    got = {r.id: r.occasions for r in selection.occasion_counts(c, memories).collect()}
    assert got == {"c1": 2, "c2": 1, "c3": 0}  # the owner is not part of an occasion


RECIPE = {"version": 1, "guidance": "g", "scope-types": ["personal", "group"], "inferred-min-distinct-occasions": 2, "limits": {"max-output-tokens": 100}, "categories": {"style": "x"}}
MODEL = {"provider": "p", "id": "m", "context-window": 10_000, "max-output-tokens": 500}


def mem(i, owner="me", roles=("evidence",), **more):
    return {"id": i, "owner-id": owner, "session-id": "s", "kind": "observation", "producer": "p", "content": "text", "roles": set(roles), **more}


def conclusion(i="c", **more):
    return {"id": i, "content": "x", "category": "style", "basis": "explicit", "scope-type": "personal", "scope-subject-ids": ["me"], "supporting-memory-ids": ["a"], "conflicting-memory-ids": [], **more}


def prepared(**more):
    base = {"reader": "me", "name": "n", "filter_": {"type": "none"}, "depth": "full", "recipe": RECIPE, "model": MODEL, "memories": [mem("a"), mem("b", "you")], "candidate_ids": ["a", "b"]}
    return derive.prepare(**(base | more))


def test_prepare_reuse_and_freshness():
    p = prepared()
    assert p["status"] == "prepared" and json.loads(p["request"]["payload"])["candidate-memory-ids"] == ["i0", "i1"]
    run = derive.complete(p["run"], {"conclusions": [conclusion()], "links": []}, "t", "2024")
    assert prepared(cached=run)["status"] == "reused"
    for change in ({"memories": [mem("a", content="new"), mem("b", "you")]}, {"recipe": RECIPE | {"version": 2}}, {"model": MODEL | {"id": "z"}}, {"depth": "active"}, {"name": "other"}):
        assert prepared(cached=run, **change)["status"] == "prepared"
    ms = {m["id"]: m for m in (mem("a"), mem("b", "you"))}
    seen = dict(identity=run["derivation-id"], readable_ids={"a", "b"}, input_print=run["input-fingerprint"], config_print=run["configuration-fingerprint"], by_id=ms)
    assert derive.freshness(run, **seen) == "current"
    assert derive.freshness(run, **(seen | {"readable_ids": {"a"}})) == "unavailable"
    assert derive.freshness(run, **(seen | {"by_id": {"a": mem("a"), "b": mem("b", "you", content="edited")}})) == "outdated"
    assert derive.freshness(run, **(seen | {"input_print": None})) == "outdated"


def test_budget():
    with pytest.raises(derive.TooLarge) as e:
        prepared(measure=lambda t: 9000)
    assert e.value.available == 10_000 - 100 - 1024


def test_payload_order_and_unknown_keys_do_not_matter():
    a = {"id": "a", "linked-paths": ["y", "x", "x"], "repository-origins": ["git@h:o/r.git", "h/o/r"], "extra": 1}
    b = {"id": "a", "linked-paths": ["x", "y"], "repository-origins": ["https://h/o/r"], "dropped?": None}
    assert derive.payload(a) == derive.payload(b)


def test_aliases_avoid_ids_and_come_back():
    short = derive.aliases(["i1", "z", "a", None])
    assert short == {"a": "i0", "i1": "i2", "z": "i3"}
    back = derive.restore({"conclusions": [conclusion("i3", **{"supporting-memory-ids": ["i0"]})], "links": [{"relation": "contradicts", "from": "new", "to": "i3"}]}, short, prior=["z"])
    assert back["conclusions"][0]["supporting-memory-ids"] == ["a"] and back["conclusions"][0]["id"] == "z" and back["links"][0]["to"] == "z"


@pytest.mark.parametrize(
    ("response", "reason"),
    [
        ({"conclusions": [conclusion(category="BAD")], "links": []}, "response-shape"),
        ({"conclusions": [conclusion(), conclusion()], "links": []}, "response-shape"),
        ({"conclusions": [conclusion(category="other")], "links": []}, "category-not-configured"),
        ({"conclusions": [conclusion(**{"scope-type": "session"})], "links": []}, "scope-not-configured"),
        ({"conclusions": [conclusion(**{"supporting-memory-ids": ["b"]})], "links": []}, "support-not-eligible"),
        ({"conclusions": [conclusion(**{"conflicting-memory-ids": ["q"]})], "links": []}, "conflict-not-eligible"),
        ({"conclusions": [conclusion(**{"scope-subject-ids": ["nobody"]})], "links": []}, "subject-not-in-evidence"),
        ({"conclusions": [conclusion(basis="inferred")], "links": []}, "inferred-below-threshold"),
        ({"conclusions": [conclusion("old")], "links": []}, "conclusion-id-collision"),
        ({"conclusions": [conclusion()], "links": [{"relation": "contradicts", "from": "c", "to": "nowhere"}]}, "link-endpoint"),
        ({"conclusions": [conclusion(), conclusion("d")], "links": [{"relation": "supersedes", "from": "c", "to": "d"}]}, "supersedes-target-not-prior"),
        ({"conclusions": [conclusion(), conclusion("d", **{"scope-type": "group", "scope-subject-ids": ["me", "you"]})], "links": [{"relation": "contradicts", "from": "c", "to": "d"}]}, "link-scope-mismatch"),
        ({"conclusions": [conclusion()], "links": [{"relation": "supersedes", "from": "c", "to": "old"}]}, None),
    ],
)
def test_output_checks(response, reason):
    ok = derive.allowed([mem("a"), mem("b", "you")], ["a"], "full", [conclusion("old")], lambda ids: 1)
    if reason is None:
        assert derive.validate_output(RECIPE, ok, response) is response
        return
    with pytest.raises(derive.OutputRejected) as e:
        derive.validate_output(RECIPE, ok, response)
    assert e.value.reason == reason


def test_decode():
    for text, reason in (("{", "response-json"), ('{"conclusions":[]}', "response-wire-shape")):
        with pytest.raises(derive.OutputRejected) as e:
            derive.decode_output(text)
        assert e.value.reason == reason


def test_refresh_isolates_failures():
    def one(name, recipe):
        if name == "b":
            raise derive.TooLarge(5, 3)
        if name == "c":
            raise RuntimeError("quotes a source")
        return {"status": "generated"}

    got = derive.refresh_all({"c": {}, "a": {}, "b": {}}, one)
    assert [(r["name"], r["status"], r.get("code")) for r in got] == [("a", "generated", None), ("b", "failed", "input-too-large"), ("c", "failed", "executor-failed")]


def test_run_tables_and_status(spark):
    run = derive.complete(prepared()["run"], {"conclusions": [conclusion()], "links": []}, "t1", "2024-01-01")
    t = runs.to_tables(spark, run)
    ms = spark.createDataFrame([("a", "me", "s"), ("b", "you", "s")], "id string, owner_id string, session_id string")
    g = spark.createDataFrame([("you", "me", "read")], G)
    status = lambda used, m: {who: runs.run_status(t.runs, used, m, who, g).first().status for who in ("me", "you")}
    assert status(t.used_memory, ms) == {"me": "available", "you": "unauthorized"}
    assert status(t.used_memory, ms.where("id = 'a'")) == {"me": "unresolved-evidence", "you": "unresolved-evidence"}
    assert status(t.used_memory.limit(1), ms)["me"] == "unresolved-evidence"
    assert runs.dependency_edges(t.runs, ms).count() == 2 and runs.dependency_edges(t.runs, ms.limit(1)).count() == 0
    assert runs.evidence_runs(t.runs, t.conclusions, "a").count() == 1 and runs.evidence_runs(t.runs, t.conclusions, "b").count() == 0
    assert runs.broken_links(t.runs, t.conclusions, t.links).count() == 0
    two = t.runs.unionByName(runs.to_tables(spark, derive.complete(prepared()["run"], {"conclusions": [], "links": []}, "t2", "2024-02-01")).runs)
    page, more = runs.read_runs(two, 1, history=True)
    assert page[0].created_at == "2024-02-01" and more
    assert len(runs.read_runs(two, 5)[0]) == 1
    prints = spark.createDataFrame([("a", run["dependency-fingerprints"]["a"]), ("b", "changed")], "id string, fingerprint string")
    deps = spark.createDataFrame([("r1", run["dependency-fingerprints"]), ("r2", {"a": run["dependency-fingerprints"]["a"]})], "id string, dependency_fingerprints map<string,string>")
    assert {r.id: r.status for r in derive.changed_dependencies(deps, prints).collect()} == {"r1": "outdated", "r2": "current"}


def test_lease():
    lease = runs.Lease()
    assert lease.acquire("a", 0, 10) and not lease.acquire("b", 5, 10) and lease.renew("a", 5, 10) and not lease.renew("b", 5, 10)
    assert lease.acquire("b", 20, 10) and not lease.release("a") and lease.release("b")


def test_pages():
    text = "zeile ü😀\n" * 40
    got, cursor = "", None
    while True:
        part, cursor = pages.page(text, cursor, size=17)
        got += part
        if cursor is None:
            break
    assert got == text
    with pytest.raises(pages.StaleCursor):
        pages.page("other", pages.page(text, None, 17)[1])
    assert pages.truncate("a\nb\nc", lines=2) == ("a\nb", True) and pages.truncate("üü", size=3) == ("ü", True) and pages.truncate("x") == ("x", False)


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    df = lambda *r: spark.createDataFrame(list(r), "id string, a string, leaf string")
    first = c.upsert("t", df(("1", "x", "l"), ("2", "y", "l")), ["id"])
    c.upsert("t", df(("1", None, None), ("3", "z", "l")), ["id"], overwrite_null=["leaf"])
    assert {tuple(r) for r in c.read("t").collect()} == {("1", "x", None), ("2", "y", "l"), ("3", "z", "l")}
    assert c.read("t", first).count() == 2  # an old snapshot stays readable
    with pytest.raises(SnapshotConflict):
        c.write("t", df(), expect=first)
    with pytest.raises(SnapshotConflict):
        c.write("t", df(), guard=lambda: False)
    with pytest.raises(SnapshotConflict):
        c.write("t", df(("5", "a", "l"), ("5", "b", "l")), unique=["id"])
    assert c.missing(["t", "u"]) == ["u"]
    c.insert_new("t", df(("4", "w", "l"), ("2", "y", "other")), ["id"], "a")
    assert c.read("t").count() == 4
    with pytest.raises(SnapshotConflict):
        c.insert_new("t", df(("2", "changed", "l")), ["id"], "a")
    c.replace_scope("t", df(("9", "n", "l")), df(("1", "", ""), ("2", "", "")), ["id"])
    assert {r.id for r in c.read("t").collect()} == {"3", "4", "9"}


def test_two_writers_of_one_table(spark, tmp_path):
    """Of two that start from one version the second fails; writers of other tables do not disturb each other; no commit is lost."""
    a, b = Catalog(spark, str(tmp_path / "c")), Catalog(spark, str(tmp_path / "c"))
    df = lambda *r: spark.createDataFrame([(x,) for x in r], "id string")
    a.write("t", df("1"))
    base = b.number()
    slow = b._written("t", df("late"), b.tables(base).get("t"))
    a.write("t", df("1", "2"))
    with pytest.raises(SnapshotConflict):
        b.commit({"t": slow}, base)
    assert {r.id for r in b.read("t").collect()} == {"1", "2"}
    base = b.number()
    other = b._written("u", df("x"), None)
    a.write("t", df("3"))
    b.commit({"u": other}, base)
    assert {r.id for r in a.read("t").collect()} == {"3"} and a.read("u").count() == 1
    n = a.number()
    assert a._create(n + 1, a.tables()) and not b._create(n + 1, {}) and b.read("t").count() == 1  # one number, one file


def test_commit_of_several_tables_is_one_step(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"), {"o": ("s", 4), "e": ("s", 4)})
    rows = lambda *r: spark.createDataFrame(list(r), "s string, v int")
    every = [(f"s{i}", i) for i in range(12)]
    c.replace_all({"o": rows(*every), "e": rows(*every)}, rows(*every), ["s"])
    old, before = c.tables(), c.read("o")
    with pytest.raises(SnapshotConflict):
        c.replace_all({"o": rows(("s1", 9)), "e": rows()}, rows(("s1", 0)), ["s"], guard=lambda: False)
    assert c.tables() == old
    c.replace_all({"o": rows(("s1", 9)), "e": rows()}, rows(("s1", 0)), ["s"])
    assert {tuple(r) for r in c.read("o").collect()} == {*every} - {("s1", 1)} | {("s1", 9)} and {tuple(r) for r in c.read("e").collect()} == {*every} - {("s1", 1)}
    assert len({*old["o"]["folders"].values()} & {*c.tables()["o"]["folders"].values()}) == len(old["o"]["folders"]) - 1  # other buckets' files are as they were
    assert {tuple(r) for r in before.collect()} == set(every)  # readers keep what they began with
    c.upsert("o", rows(("s2", 20), ("new", 1)), ["s"])
    assert {tuple(r) for r in c.read("o").collect()} == {*every} - {("s1", 1), ("s2", 2)} | {("s1", 9), ("s2", 20), ("new", 1)}
    with pytest.raises(ValueError):
        c.replace_all({"o": rows(*every)}, rows(("s1", 0)), ["s"])


def test_inserted_payloads_are_immutable(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    df = lambda *r: spark.createDataFrame(list(r), "id string, p string")
    with pytest.raises(SnapshotConflict):
        c.insert_new("t", df(("1", "a"), ("1", "b")), ["id"], "p")
    c.insert_new("t", df(("1", "a"), ("1", "a"), ("2", None)), ["id"], "p")
    assert c.read("t").count() == 2
    for clash in (("1", None), ("2", "x")):
        with pytest.raises(SnapshotConflict):
            c.insert_new("t", df(clash, ("3", "n")), ["id"], "p")
    c.insert_new("t", df(("2", None), ("3", "n")), ["id"], "p")
    assert {tuple(r) for r in c.read("t").collect()} == {("1", "a"), ("2", None), ("3", "n")}


def test_published_under_a_lease(spark, tmp_path):
    from annalist.operators.runs import CONCLUSION, LINK, RUN, RunTables
    from annalist.plans import publish as P

    c = Catalog(spark, str(tmp_path / "c"))

    def run(i, t):
        return RunTables(spark.createDataFrame([(i, "d", t, "full", f"json {i}", ["m1", "m2"], "f", "g", 2, None)], RUN), spark.createDataFrame([(f"c{i}", i, "text", None, None, None, [], ["m1"], [])], CONCLUSION), spark.createDataFrame([], LINK), spark.createDataFrame([(i, "m1", ["evidence"]), (i, "m2", [])], "run_id string, memory_id string, roles array<string>"))

    assert not P.reusable(c, "d", "json r1")
    assert P.acquire(c, "d", "a", 0, 100) and not P.acquire(c, "d", "b", 50, 100) and P.held(c, "d", "a", 99) and not P.held(c, "d", "a", 100)
    P.publish(c, run("r1", "2024"), "a", 50)
    with pytest.raises(SnapshotConflict):
        P.publish(c, run("r1", "2024"), "a", 50)
    assert P.acquire(c, "d", "b", 200, 100) and not P.renew(c, "d", "a", 210, 100) and P.renew(c, "d", "b", 210, 100)
    with pytest.raises(SnapshotConflict):  # the first owner was slow, and another has the lease
        P.publish(c, run("r2", "2025"), "a", 220)
    assert c.read("runs").count() == 1 and P.reusable(c, "d", "json r1") and not P.reusable(c, "d", "json r2")
    P.publish(c, run("r2", "2025"), "b", 220)
    assert c.read("runs").count() == 2 and c.read("conclusions").count() == 2 and P.reusable(c, "d", "json r2") and not P.reusable(c, "d", "json r1")
    times = iter([220, 400])  # the lease runs out between two publications of one owner
    P.publish(c, run("r3", "2026"), "b", lambda: next(times))
    with pytest.raises(SnapshotConflict):
        P.publish(c, run("r4", "2027"), "b", lambda: next(times))
    assert c.read("runs").count() == 3
    assert P.release(c, "d", "b") and not P.release(c, "d", "b") and P.acquire(c, "d", "z", 230, 1) and P.acquire(c, "other", "y", 230, 1)


def test_checkpoints_and_versions(spark):
    s = "session_id string, byte_offset long, prefix_hash string, ordinal long"
    old = spark.createDataFrame([("a", 10, "h", 1), ("b", 10, "h", 1), ("c", 10, "h", 1)], s)
    new = spark.createDataFrame([("a", 20, "k", 2), ("b", 5, "k", 0), ("c", 10, "other", 1), ("d", 1, "x", 0)], s)
    got = {r.session_id: (r.byte_offset, r.applied) for r in advance_checkpoints(old, new).collect()}
    assert got == {"a": (20, True), "b": (10, False), "c": (10, False), "d": (1, True)}
    v = spark.createDataFrame([("u", 3), ("u", None), ("w", 2)], "user_id string, code_memory_version int")
    assert {r.user_id: r.code_memory_version for r in effective_version(v).collect()} == {"u": 1, "w": 2}
    from pyspark.sql import functions as F

    moved, clash = rekey(spark.createDataFrame([("A",), ("a",), ("b",)], "id string"), F.lower("id"))
    assert moved.count() == 3 and [r.id for r in clash.collect()] == ["a"]


def test_spool(spark, tmp_path):
    import hashlib

    def note(**more):
        i = str(uuid.uuid4())
        own = f"pi/{hashlib.sha256(b'sess').hexdigest()}/prod.jsonl"
        n = {"version": 1, "id": i, "sourceKind": "pi", "sourceSessionId": "sess", "producerId": "prod", "sidecarLocator": f"/root/{own}", "queuedAt": "2024-01-01T00:00:00.000Z"} | more
        (tmp_path / f"{i}.json").write_text(json.dumps(n))
        return i

    good = note()
    note(extra=1), note(version=2), note(sidecarLocator="/else.jsonl"), note(queuedAt="later"), note(producerId="UP")
    (tmp_path / "junk.json").write_text("{")
    rows = spool.scan_memory(spark, str(tmp_path)).cache()
    assert sorted(r.rejection_reason for r in rows.where("state = 'rejected'").collect()) == ["invalid-identity", "invalid-locator", "invalid-queued-at", "malformed-json", "unexpected-shape", "unsupported-version"]
    assert [r.id for r in spool.pending(rows).collect()] == [good]
    mtime = int(rows.where("state = 'pending'").first().file_mtime_ms)
    assert spool.expire(rows, mtime + 599_999).where("state = 'parked'").count() == 0
    assert spool.expire(rows, mtime + 600_000).where("state = 'parked'").count() == 1
    with pytest.raises(ValueError):
        spool.expire(rows, 0, 10)
    g = spool.groups(rows.where("state = 'pending'"), ["source_kind", "source_session_id"], ["queued_at", "id"]).first()
    assert g.ids == [good] and g.producer_id == "prod"
    done = spark.createDataFrame([("a", "ok", 2), ("b", "failed", 1), ("c", "ok", 1)], "group string, status string, notifications long")
    assert tuple(spool.drain_report(done).first()) == (3, 1, 0, 0)


def test_worktrees(spark):
    z = "worktree /w\0HEAD abc\0branch refs/heads/main\0\0worktree /w/x\0HEAD def\0detached\0\0worktree /b\0bare\0\0"
    got = spool.parse_worktrees(spark.createDataFrame([("r", z)], "repository_id string, porcelain string")).collect()
    assert {(r.root, r.commit, r.branch, r.bare) for r in got} == {("/w", "abc", "main", False), ("/w/x", "def", None, False), ("/b", None, None, True)}


def test_recipes(spark):
    text = json.dumps({"style": {k: v for k, v in RECIPE.items()}})
    assert recipes.recipe_table(spark, recipes.read_recipes(text)).count() == 1
    for bad in ("[]", json.dumps({"Bad Name": RECIPE}), json.dumps({"a": RECIPE | {"extra": 1}}), json.dumps({"a": RECIPE | {"limits": {}}}), "x" * (300 * 1024)):
        with pytest.raises(recipes.RecipeError):
            recipes.read_recipes(bad)


def test_records_are_read_once_and_paths_resolved_once(spark):
    from pyspark.sql import functions as F

    from annalist.operators.evidence import resolve

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def path_of(i):
        read.add(1)
        return f"{i % 3}/./x.py"

    calls = spark.range(0, 60, 1, 2).select(F.col("id"), path_of("id").alias("path"), F.when(F.col("id") % 2 == 0, "/w").alias("cwd"))
    roots = spark.createDataFrame([("R", "/w", "c")], "repository_id string, root string, commit string")
    found = resolve(calls, roots, F.col("cwd"))
    assert {(r.id, r.relative_path) for r in found.collect()} == {(i, f"{i % 3}/x.py") for i in range(0, 60, 2)} and read.value == 60
