"""Inspection by columns against the definition, on events that are changed at random."""

import copy
import json
import random

from annalist.operators import sidecar
from annalist.operators.envelope import inspected
from annalist.operators.sidecar import Locator, inspect
from tests.test_sidecar import REC, L, event, obs, ref

VALUES = [None, True, 0, 1, 1.0, 1.5, -1, -0.0, 2**53 - 1, 2**53, 1e300, 12345678901234567890, "", "x", "a" * 12, "A b", "é", "\U0001f600", "\ud800", "a\nb", "\x7f", "x" * 129, "x" * 600, "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123456789Z",
          "2024-02-30T00:00:00Z", "20240101T000000Z", "2024-01-01", "9" * 20, [], {}, [1], {"id": "a"}, ["a" * 12, "a" * 12], ["a" * 12] * 300, [None]]


def places(value, path=()):
    yield path
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from places(v, (*path, k))


def changed(rng, value):
    value = copy.deepcopy(value)
    for _ in range(rng.choice([1, 1, 1, 2, 3])):
        *way, last = rng.choice([p for p in places(value) if p])
        at = value
        for k in way:
            at = at[k]
        what = rng.random()
        if what < 0.25 and isinstance(at, dict):
            del at[last]
        elif what < 0.35 and isinstance(at, list):
            at.append(copy.deepcopy(at[last]))
        elif what < 0.45 and isinstance(at, dict):
            at[rng.choice(["note", "\U00010000", "￿", "observations", "reflections", "observationIds"])] = copy.deepcopy(rng.choice(VALUES))
        else:
            at[last] = copy.deepcopy(rng.choice(VALUES))
        if not value:
            break
    return value


def written(rng, value):
    raw = json.dumps(value, ensure_ascii=rng.random() < 0.3, separators=rng.choice([None, (",", ":"), (" ,\n", ":\t")]))
    if rng.random() < 0.04:
        raw = rng.choice([raw + " x", raw + "}", raw[:-1], " " + raw + "\n", raw.replace("/", "\\/"), raw.replace('"kind"', '"kind":"x","kind"', 1), raw.replace("1", "1e0", 1), "[" + raw + "]", "﻿" + raw])
    return raw


def test_columns_say_what_the_definition_says(spark):
    rng = random.Random(9)
    two = {"streams": [{"streamId": s, "committedBytes": 5, "prefixSha256": "b" * 64, "selectedLeafEntryId": "leaf"} for s in ("a", "main")]}
    sound = [
        event("1"), event("2", "observations.recorded", observations=[obs(), obs("b" * 12, "é\n\"q\" \\ \t \x01 😀")]), event("3", "reflections.recorded", reflections=[ref(), ref("c" * 12, ("a" * 12, "d" * 12))]),
        event("4", "observations.dropped", observationIds=["a" * 12, "b" * 12]), event("5") | {"sourceCheckpoint": two}, event("6") | {"sourceCheckpoint": {"streams": two["streams"][::-1]}}, event("7", note={"deep": [{"x": [1, [2, {"y": None}]]}], "b": True}),
    ]
    values = sound * 3 + [changed(rng, rng.choice(sound)) for _ in range(4000)]
    raws = [json.dumps(v) for v in sound] + [written(rng, v) for v in values] + ["", "null", "1", '"x"', "{}", "nul", "[" * 3000]
    rows = [("pi", "sess", "prod", i, r) for i, r in enumerate(raws)] + [("pi", "sess", "prod", len(raws), None)]
    rows = [r for r in rows if r[4] is None or "\ud800" not in r[4]]  # a lone surrogate is no text of Spark's; its escape is
    out = inspected(spark.createDataFrame(rows, REC).repartition(8)).collect()
    assert len(out) == len(rows)
    seen = set()
    by = {r[3]: r[4] for r in rows}
    for r in out:
        raw = by[r.ordinal]
        want = inspect(raw or "", L)
        seen.add(r.reason)
        streams = want.get("checkpoint") and [(s["streamId"], s["committedBytes"], s["prefixSha256"]) for s in want["checkpoint"]]
        assert (r.reason, r.event_id, r.event_hash, r.kind, r.checkpoint and [tuple(s) for s in r.checkpoint]) == ((want["diagnostics"] or [None])[0], want.get("event_id"), want.get("event_hash"), want.get("kind"), streams), raw
    assert seen >= {None, "malformed-json", "invalid-envelope", "unsupported-version", "unsupported-kind", "producer-mismatch", "source-mismatch"}


def test_records_in_the_usual_form_need_no_python(spark, monkeypatch):
    from pyspark.sql import functions as F

    from annalist.operators import envelope

    @F.pandas_udf(envelope.INSPECTED)
    def never(raw, a, b, c):
        assert raw.isna().all(), "a record was handed on"
        import pandas as pd

        return pd.DataFrame({k: [None] * len(raw) for k in ("reason", "event_id", "event_hash", "kind", "checkpoint")}, dtype=object)

    monkeypatch.setattr(envelope, "_inspected", never)
    rows = [("pi", "sess", "prod", i, json.dumps(e, ensure_ascii=False)) for i, e in enumerate([event("1"), event("2", "observations.recorded", observations=[obs(content="müde, 12.5 %")]), event("3") | {"eventId": ""}])]
    assert [r.reason for r in inspected(spark.createDataFrame(rows, REC)).orderBy("ordinal").collect()] == [None, None, "invalid-envelope"]


def test_classify_takes_logs_apart(spark):
    """Random logs of several producers, with replays, conflicts and regressions, against the fold."""
    rng = random.Random(4)
    logs = {}
    for p in ("prod", "q", "r"):
        at, lines = 50, []
        for i in range(80):
            at += rng.choice([0, 1, 2, -40 if i % 13 == 5 else 1])
            known = rng.random() < 0.15 and lines
            e = event(str(i), bytes_=max(0, at), prefix=rng.choice("ab") * 64) | {"producer": {"id": p, "version": "1"}}
            if p == "r" and i == 60:
                e["eventId"] = "3"
            lines.append(rng.choice(lines) if known else rng.choice(["{", json.dumps(e), json.dumps(e), json.dumps(e)]))
        logs[p] = lines
    rows = [("pi", "sess", p, i, raw) for p, lines in logs.items() for i, raw in enumerate(lines)]
    got = {(r.producer_id, r.ordinal): (r.semantic_status, r.diagnostics, r.event_id, r.event_hash, r.kind, r.raw_json) for r in sidecar.classify(spark.createDataFrame(rows, REC).repartition(7)).collect()}
    want = {(p, i): (e["status"], e["diagnostics"], e.get("event_id"), e.get("event_hash"), e.get("kind"), logs[p][i]) for p, lines in logs.items() for i, e in enumerate(sidecar.fold(lines, Locator("pi", "sess", p)))}
    assert got == want and {v[0] for v in got.values()} == {"accepted", "replay", "skipped", "conflict", "blocked"}
    assert sidecar.classify(spark.createDataFrame([], REC)).count() == 0


def test_a_record_is_read_in_few_passes(spark):
    plan = inspected(spark.createDataFrame([("pi", "sess", "prod", 0, "{}")], REC))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") <= 6 and "translate(" not in plan


def test_lists_of_odd_items_are_judged_as_by_the_definition(spark):
    """Items that are no objects, lists that are none, and numbers behind brackets or in texts."""
    base = event("1", "observations.recorded", observations=[obs()])
    odd = [base | {k: v} for k in ("observations", "reflections", "observationIds", "producer", "source", "sourceCheckpoint") for v in (None, 7, "x", [], {}, [None], [[1.5]], [{"id": 1}], {"streams": [None]}, {"streams": 3})]
    odd += [base | {"observations": [obs() | {k: v}]} for k in ("sourceEntries", "supportingObservationIds", "content", "tokenCount") for v in (None, 7, ["x"], [None], [{}], "at 00:00:00.5,1.5")]
    texts = [json.dumps(e, ensure_ascii=False) for e in odd] + ["1.5", "12345678901234567", "[1.5]", '"a\\tb"', ' {"a" :\t1}\r\n', json.dumps(base).replace(" ", "\t"), json.dumps(base | {"n": [1, 2.5]})]
    got = inspected(spark.createDataFrame([("pi", "sess", "prod", i, x) for i, x in enumerate(texts)], REC)).orderBy("ordinal").collect()
    want = [inspect(x, Locator("pi", "sess", "prod")) for x in texts]
    assert [(r.reason, r.event_hash) for r in got] == [(next(iter(w["diagnostics"]), None), w.get("event_hash")) for w in want]
