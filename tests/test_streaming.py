import hashlib
import json
import uuid

import pandas as pd

from annalist.streaming import spool
from annalist.streaming.sidecar import commit_each


def note(folder, producer="prod", session="sess"):
    i = str(uuid.uuid4())
    own = f"pi/{hashlib.sha256(session.encode()).hexdigest()}/{producer}.jsonl"
    n = {"version": 1, "id": i, "sourceKind": "pi", "sourceSessionId": session, "producerId": producer, "sidecarLocator": f"/r/{own}", "queuedAt": "2024-01-01T00:00:00.000Z"}
    (folder / f"{i}.json").write_text(json.dumps(n))
    return i


def test_drain_isolates_groups_and_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    a, b = {note(inbox), note(inbox)}, {note(inbox, "bad")}
    (inbox / "junk.json").write_text("{")
    done, failed = [], []

    def work(g):
        if g["producer_id"] == "bad":
            raise RuntimeError
        done.append(set(g["ids"]))

    def run():
        q = spool.read_spool(spark, str(inbox)).writeStream.foreachBatch(spool.drain(work, lambda g, e: failed.append(set(g["ids"])))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    assert (done, failed) == ([a], [b])
    c = note(inbox)
    run()
    assert done == [a, {c}] and failed == [b]


class Kept:
    """Stands in for the engine's state of one key."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, v):
        self.value = v

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_waiting_is_ready_with_its_source_or_parked(spark, monkeypatch):
    steps = []
    import pyspark.sql.group as g

    monkeypatch.setattr(g.GroupedData, "applyInPandasWithState", lambda self, f, *a: steps.append(f))
    n = spark.createDataFrame([], "source_kind string, source_session_id string, producer_id string, id string, locator string, state string")
    spool.waiting(n, n, window_ms=5000)
    step, key = steps[0], ("pi", "s", "p")
    rows = lambda *r: iter([pd.DataFrame(r, columns=["id", "locator"])])
    kept = Kept()
    assert list(step(key, rows(("1", "/l"), ("1", "/l")), kept)) == [] and kept.timeout == 5000
    kept.timeout = None
    assert list(step(key, rows(("2", "/m")), kept)) == [] and kept.timeout is None  # the first notification's time counts
    out = list(step(key, rows((None, None)), kept))[0].iloc[0]
    assert (out["ids"], out["locator"], out["state"]) == (["1", "2"], "/m", "ready") and not kept.exists
    list(step(key, rows(("3", "/l")), kept))
    kept.hasTimedOut = True
    assert list(step(key, iter([]), kept))[0].iloc[0]["state"] == "parked" and not kept.exists


def test_commits_are_idempotent(spark, tmp_path):
    from annalist.plans.catalog import Catalog

    catalog = Catalog(spark, str(tmp_path / "c"))
    commit = commit_each(catalog, "t", ["k"], "v")
    batch = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    commit(batch, 0)
    commit(batch, 0)
    assert catalog.read("t").count() == 2


def test_notifications_are_queued_parked_and_acknowledged(spark, tmp_path):
    import os
    import uuid

    import pytest

    from annalist.sources import spool

    active, archive = str(tmp_path / "active"), str(tmp_path / "archive")
    import hashlib

    def made():
        return {"id": str(uuid.uuid4()), "queued_at": "2024-01-01T00:00:00Z", "source_kind": "pi", "source_session_id": "s1", "producer_id": "p", "locator": "/x/pi/" + hashlib.sha256(b"s1").hexdigest() + "/p.jsonl"}

    a, b = made(), made()
    for n in (a, b):
        spool.enqueue(spark, active, n)
    with pytest.raises(FileExistsError):
        spool.enqueue(spark, active, a)
    seen = spool.scan_memory(spark, active).collect()
    assert {r.id for r in seen} == {a["id"], b["id"]} and {r.state for r in seen} == {"pending"}
    one, two = spool.park(spark, active, archive, a), spool.park(spark, active, archive, b)
    assert one == two and len(os.listdir(active)) == sum(x.endswith(".crc") for x in os.listdir(active))  # one for the locator
    again = str(uuid.uuid4())
    spool.requeue(spark, active, one, a, again)
    assert [r.id for r in spool.scan_memory(spark, active).collect()] == [again] and not os.path.exists(one)
    spool.acknowledge(spark, active, a | {"id": again})
    spool.acknowledge(spark, active, a | {"id": again})  # gone already
    for bad in ("../x", ".."):
        with pytest.raises(ValueError):
            spool.acknowledge(spark, active, a | {"id": bad})
    with pytest.raises(ValueError):
        spool.enqueue(spark, active, a | {"producer_id": "p" * 5000})


def test_waiting_requests_coalesce_but_not_across_explicit_ones(spark):
    from annalist.sources.spool import coalesced

    rows = [(1, "a", True, "x"), (2, "b", True, "y"), (3, "a", True, "z"), (4, "a", False, "now"), (5, "a", True, "u"), (6, "a", False, "now"), (7, None, True, "n"), (8, None, True, "m")]
    got = coalesced(spark.createDataFrame([("q", *r) for r in rows], "q string, at int, path string, automatic boolean, body string"), ["q"], "at", "path", "automatic")
    assert [(r.place, r.at, r.body, r.coalesced) for r in got.orderBy("place").collect()] == [(1, 3, "z", 2), (2, 2, "y", 1), (4, 4, "now", 1), (5, 5, "u", 1), (6, 6, "now", 1), (7, 8, "m", 2)]


def test_of_many_writers_of_one_name_one_has_it(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    n = {"id": str(uuid.uuid4()), "queued_at": "2024-01-01T00:00:00.000Z", "source_kind": "pi", "source_session_id": "s", "locator": "/l"}

    def write(i):
        try:
            return spool.enqueue(spark, str(tmp_path / "box"), n | {"producer_id": f"p{i}"}) and i
        except FileExistsError:
            return None

    from annalist.sources import spool

    with ThreadPoolExecutor(8) as pool:
        won = [i for i in pool.map(write, range(8)) if i is not None]
    (left,) = [p for p in (tmp_path / "box").iterdir() if not p.name.endswith(".crc")]
    assert len(won) == 1 and json.loads(left.read_text())["producerId"] == f"p{won[0]}"
