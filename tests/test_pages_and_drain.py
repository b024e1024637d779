import json
import time
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from annalist.plans import keyset
from annalist.plans.catalog import Catalog
from annalist.plans.keyset import Order, encode, page, pages
from annalist.plans.pages import StaleCursor
from annalist.sources.spool import scan_memory
from annalist.streaming.drain import drain_folder, settle
from tests.test_streaming import note

ROWS = [(i, None if i % 5 == 0 else i % 3, Decimal(i % 4).scaleb(-1), None if i % 7 == 0 else f"t{i % 2}") for i in range(60)]


@pytest.fixture
def table(spark):
    df = spark.createDataFrame(ROWS, "id int, a int, d decimal(5,2), s string").repartition(4)
    return df.withColumn("at", F.to_timestamp(F.concat(F.lit("2024-01-0"), F.col("id") % 3 + 1)))


@pytest.mark.parametrize("falls", [(), ("a",), ("a", "id"), ("s",), ("d", "at")])
def test_pages_are_the_sorted_table(table, falls):
    for columns in (("a", "id"), ("s", "d", "at", "id")):
        order = Order(columns, frozenset(falls) & frozenset(columns))
        want = [r.id for r in table.orderBy(*order.by()).collect()]
        for size in (7, 60, 100):
            assert [r.id for p in pages(table, order, size) for r in p.collect()] == want


@pytest.mark.parametrize(("columns", "falls"), [(("a", "id"), ()), (("a", "id"), ("a", "id")), (("s", "d", "at", "id"), ("d", "at"))])
def test_large_pages_are_the_sorted_table(table, columns, falls, monkeypatch):
    monkeypatch.setattr(keyset, "TOP", 0)
    order = Order(columns, frozenset(falls))
    want = [r.id for r in table.orderBy(*order.by()).collect()]
    assert [[r.id for r in p.collect()] for p in pages(table, order, 20)] == [want[:20], want[20:40], want[40:]]
    found, cursor = page(table, order, 25, "v")
    rest, end = page(table, order, 35, "v", cursor)
    assert [r.id for r in found.collect()] == want[:25] and [r.id for r in rest.collect()] == want[25:] and end is None


def test_the_driver_gets_keys_and_no_page(spark, monkeypatch):
    """However many rows a page has, a plan that brings rows to the driver brings the keys that end pages."""
    sent = []
    collect = DataFrame.collect

    def counted(df):
        plan = df._jdf.queryExecution().executedPlan()
        assert "TakeOrdered" not in plan.getClass().getName()
        sent.append(collect(df))
        return sent[-1]

    monkeypatch.setattr(DataFrame, "collect", counted)
    rows = spark.range(0, 40_000, 1, 8).select((F.col("id") * 7919 % 40_000).alias("id"))
    found = list(pages(rows, Order(("id",)), 5_000))
    assert sum(map(len, sent)) < 100
    assert [p.agg(F.min("id"), F.max("id")).first() for p in found] == [(5_000 * i, 5_000 * i + 4_999) for i in range(8)]
    assert page(rows, Order(("id",)), 500)[1] == encode(None, Order(("id",)), [499])


def test_a_page_is_a_range_and_a_top_k(table, tmp_path, spark):
    table.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    _, cursor = page(t, Order(("id",)), 10, "v1")
    found, _ = page(t, Order(("id",)), 10, "v1", cursor)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(id,9)" in plan
    with pytest.raises(ValueError, match="row at least"):
        page(t, Order(("id",)), 0)
    assert page(t.limit(0), Order(("id",)), 5)[1] is None


def test_a_commit_in_between_is_refused(spark, table, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.write("orders", table)
    order, before = Order(("id",)), catalog.version("orders")
    found, cursor = page(catalog.read("orders"), order, 25, before)
    assert [r.id for r in found.collect()] == list(range(25))
    catalog.write("orders", table.where("id > 3"))
    now = catalog.version("orders")
    for bad, snapshot in ((cursor, now), ("junk", before), (encode(before, Order(("id",), frozenset({"id"})), [3]), before), (cursor[:-8], before)):
        with pytest.raises(StaleCursor):
            page(catalog.read("orders"), order, 25, snapshot, bad)
    rest, cursor = page(catalog.read("orders", before), order, 100, before, cursor)  # the old snapshot still goes on
    assert [r.id for r in rest.collect()] == list(range(25, 60)) and cursor is None


def _work(group):
    if group["source_session_id"] == "bad":
        raise RuntimeError("broken log")
    if group["source_session_id"] == "slow":
        time.sleep(30)
    return group["locator"][-10:]


def test_no_group_holds_up_another(spark, tmp_path):
    """A failing, a slow, a waiting and an expired group beside fifty good ones; only done work is acknowledged."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    ids = {s: [note(inbox, session=s) for _ in range(2)] for s in ["bad", "slow", "late", "lost", *(f"s{i}" for i in range(50))]}
    for i in ids["lost"]:
        body = json.loads((inbox / f"{i}.json").read_text()) | {"queuedAt": "2023-01-01T00:00:00.000Z"}
        (inbox / f"{i}.json").write_text(json.dumps(body))
    (inbox / f"{uuid.uuid4()}.json").write_text("{")
    seen = scan_memory(spark, str(inbox)).withColumn("file_mtime_ms", F.lit(None).cast("long"))
    missing = spark.createDataFrame([("pi", "late"), ("pi", "lost")], "source_kind string, source_session_id string")
    began, now = time.time(), 1_704_067_200_000 + 1000  # a second after the others were queued
    outcomes, counters = drain_folder(seen, _work, str(inbox), now, missing_sources=missing, tasks=3, threads=4, seconds=2.0)
    assert time.time() - began < 25
    got = {r.source_session_id: (r.status, r.notifications) for r in outcomes.collect()}
    assert got == {"bad": ("failed", 2), "slow": ("failed", 2), "late": ("waiting", 2), "lost": ("expired", 2)} | {f"s{i}": ("ok", 2) for i in range(50)}
    details = {r.source_session_id: r.detail for r in outcomes.collect()}
    assert details["bad"] == "RuntimeError: broken log" and details["slow"] == "no end within 2.0 s" and details["s1"].endswith(".jsonl")
    report = counters.first()
    assert (report.acknowledged, report.failed, report.expired, report.waiting) == (100, 4, 2, 2)
    left = {p.stem for p in inbox.glob("*.json")}
    assert left >= {i for s in ("bad", "slow", "late", "lost") for i in ids[s]} and len(left) == 9
    assert settle(outcomes, str(inbox)).first() == report


def test_an_empty_spool(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "x.json").write_text("{")
    outcomes, counters = drain_folder(scan_memory(spark, str(inbox)), _work, str(inbox), 0)
    assert outcomes.count() == 0 and counters.first().acknowledged == 0
