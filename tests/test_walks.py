import json
import random
import time

from pyspark.sql import functions as F

from annalist.operators import evidence, occasions, walks

ENTRIES = "session_id string, stream_id string, ordinal long, record_uuid string, parent_id string, logical_parent_id string, request_id string, raw_json string"


def selected(records, leaf):
    """The plain fixpoint. records: uuid -> dict(up, request, source, calls, results)."""
    chosen, at = set(), leaf
    while at in records and at not in chosen:
        chosen.add(at)
        at = records[at]["up"]
    while True:
        more = set(chosen)
        for u in list(more):
            r = records[u]
            if r["results"] and r["source"] in records:
                more.add(r["source"])
        requests = {records[u]["request"] for u in more} - {None}
        more |= {u for u, r in records.items() if r["request"] in requests}
        more |= {u for u, r in records.items() if r["source"] in more and set(r["results"]) & set(records[r["source"]]["calls"])}
        if more == chosen:
            return chosen
        chosen = more


def test_selection_equals_the_plain_fixpoint(spark):
    rng = random.Random(2)
    rows, leaves, want = [], [], set()
    for s in range(40):
        n, records = rng.randrange(1, 25), {}
        for i in range(n):
            records[f"u{i}"] = {
                "up": rng.choice([None, f"u{rng.randrange(n)}", f"u{i - 1}"]) if rng.random() < 0.3 else (f"u{i - 1}" if i else None), "request": rng.choice([None, None, f"q{rng.randrange(n)}"]),
                "source": rng.choice([None, f"u{rng.randrange(n)}", "u99"]), "calls": [f"c{rng.randrange(6)}" for _ in range(rng.randrange(3))], "results": [f"c{rng.randrange(6)}" for _ in range(rng.randrange(3))],
            }
        for i, (u, r) in enumerate(records.items()):
            blocks = [{"type": "tool_use", "id": c} for c in r["calls"]] + [{"type": "tool_result", "tool_use_id": c} for c in r["results"]] + [{"type": "text", "text": "x"}]
            raw = {"uuid": u, "message": {"content": blocks if r["calls"] or r["results"] else "plain"}} | ({"sourceToolAssistantUUID": r["source"]} if r["source"] else {})
            up = (None, r["up"]) if i % 2 else (r["up"], None)
            rows.append((f"s{s}", "main", i, u, *up, r["request"], json.dumps(raw)))
        rows += [(f"s{s}", "main", 90, None, None, None, None, "{"), (f"s{s}", "agent:1", 0, "u0", None, None, None, "{}")]
        leaf = rng.choice([f"u{n - 1}", f"u{rng.randrange(n)}", "gone"])
        leaves.append((f"s{s}", leaf))
        want |= {(f"s{s}", "main", u) for u in selected(records, leaf)} | {(f"s{s}", "agent:1", "u0")}
    df = spark.createDataFrame(rows, ENTRIES)
    got = evidence.selected_transcript_entries(df, spark.createDataFrame([*leaves, ("other", "u0"), ("s1", None)], "session_id string, current_leaf_id string"))
    out = got.select("session_id", "stream_id", "record_uuid").collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want and got.columns == df.columns


def test_selection_in_a_session_of_a_million_records(spark):
    """A branch of 3,000 among them; the others hang on it or on each other, and one request has a third of all records."""
    n, deep = 1_000_000, 3000
    i = F.col("id")
    up = F.when(i == 0, F.lit(None)).when(i < deep, i - 1).otherwise(i - deep + F.pmod(i, F.lit(7)))
    rows = spark.range(0, n, 1, 8).select(
        F.lit("s").alias("session_id"), F.lit("main").alias("stream_id"), i.alias("ordinal"), i.cast("string").alias("record_uuid"), up.cast("string").alias("parent_id"), F.lit(None).cast("string").alias("logical_parent_id"),
        F.when(i % 3 == 1, F.lit("big")).when(i % 1000 == 0, F.concat(F.lit("q"), i)).alias("request_id"), F.lit('{"message":{"content":[]}}').alias("raw_json"),
    )
    leaf = spark.createDataFrame([("s", str(deep - 1))], "session_id string, current_leaf_id string")
    began = time.time()
    got = evidence.selected_transcript_entries(rows, leaf).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("ordinal") < deep, 1)).alias("branch")).first()
    assert got.branch == deep and got.n == deep + sum(1 for k in range(deep, n) if k % 3 == 1)
    assert time.time() - began < 600


def test_climb_ends_at_cycles_and_strangers(spark):
    nodes = spark.createDataFrame([("a", "x", "y"), ("a", "y", "z"), ("a", "z", "y"), ("a", "off", "x"), ("b", "x", "gone"), ("b", "x", "gone"), ("c", "x", None)], "session_id string, node string, up string")
    starts = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "gone"), ("c", "x"), ("d", "x")], "session_id string, node string")
    assert sorted(tuple(r) for r in walks.climb(nodes, starts).collect()) == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("c", "x")]
    assert walks.climb(nodes.limit(0), starts).count() == 0


SESSIONS = "id string, user_id string, source_kind string, parent_session string, parent_ids array<string>"


def chain(prefix, n, root=True):
    return [(f"{prefix}{i}", "u", "pi", f"{prefix}{i - 1}" if i or not root else None, [f"{prefix}{i - 1}"] if i else []) for i in range(n)]


def test_originals_over_128_forks_in_eight_tables(spark, monkeypatch):
    """129 and more forks, cycles, changed and doubled copies, unknown and several parents have no original."""
    sessions = chain("a", 131) + chain("lost", 3, root=False) + [("c0", "u", "pi", "c1", ["c1"]), ("c1", "u", "pi", "c0", ["c0"]), ("two", "u", "pi", "a0", ["a0", "a1"]), ("theirs", "v", "pi", "a0", ["a0"]), ("own", "u", "pi", "x", ["x"]), ("x", "u", "pi", None, []), ("dup", "u", "pi", None, []), ("d1", "u", "pi", "dup", ["dup"]), ("m", "u", "pi", "a0", ["a0"])]
    rows = [(s[0], "main", "e", "copy" if s[0] != "m" else "other") for s in sessions if s[0] != "x"] + [("dup", "main", "e", "copy")]
    entries = spark.createDataFrame(rows, "session_id string, stream_id string, entry_id string, raw_json string")
    found = entries.distinct().select("session_id", "stream_id", "entry_id", F.col("stream_id").alias("anchor_stream"), F.col("entry_id").alias("anchor_entry"), F.sha2(F.col("raw_json").cast("binary"), 256).alias("raw_hash"))
    written, real = [], walks.durable
    monkeypatch.setattr(walks, "durable", lambda df: written.append(1) or real(df))
    got = {r.session_id: r.origin_session for r in occasions.originals(found, entries, spark.createDataFrame(sessions, SESSIONS)).collect()}
    # a fork of a session that holds the entry twice looks like one whose parent lacks it
    assert got == {f"a{i}": "a0" for i in range(129)} | {"own": "own", "d1": "d1"}
    assert len(written) <= 8
    assert {r.session_id for r in occasions.originals(found, entries, spark.createDataFrame(sessions, SESSIONS), most=1).collect()} == {"a0", "a1", "own", "d1"}
