"""Finished runs made public: a lease that a catalog holds, and commits that its owner alone can make."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.runs import RunTables
from annalist.plans.catalog import Catalog, SnapshotConflict, merge_rows

LEASE = "derivation_id string, token string, until_ms long"


def _lease(catalog: Catalog, key: str, version: int) -> tuple[str | None, int]:
    table = catalog.tables(version).get("leases")
    row = catalog._rows(table).where(F.col("derivation_id") == key).first() if table else None
    return (row.token, row.until_ms) if row and row.token is not None else (None, 0)


def held(catalog: Catalog, key: str, token: str, now_ms: int) -> bool:
    """Whether the token's lease on a derivation still runs."""
    owner, until = _lease(catalog, key, catalog.number())
    return owner == token and until > now_ms


def _set(catalog: Catalog, key: str, token: str | None, until_ms: int, base: int) -> bool:
    row = catalog.spark.createDataFrame([(key, token, until_ms)], LEASE)
    table = catalog.tables(base).get("leases")
    rows = row if table is None else merge_rows(catalog._rows(table), row, ["derivation_id"], overwrite_null=["token"])
    try:
        catalog.commit({"leases": catalog._written("leases", rows, table)}, base)
    except SnapshotConflict:  # somebody else's lease has changed meanwhile, of this derivation or another
        return False
    return True


def acquire(catalog: Catalog, key: str, token: str, now_ms: int, length_ms: int) -> bool:
    """Take the lease if nobody holds it; of two that try at once one gets it."""
    base = catalog.number()
    owner, until = _lease(catalog, key, base)
    return (owner is None or until <= now_ms) and _set(catalog, key, token, now_ms + length_ms, base)


def renew(catalog: Catalog, key: str, token: str, now_ms: int, length_ms: int) -> bool:
    base = catalog.number()
    owner, until = _lease(catalog, key, base)
    return owner == token and until > now_ms and _set(catalog, key, token, now_ms + length_ms, base)


def release(catalog: Catalog, key: str, token: str) -> bool:
    base = catalog.number()
    return _lease(catalog, key, base)[0] == token and _set(catalog, key, None, 0, base)


def publish(catalog: Catalog, run: RunTables, token: str, now_ms: int | Callable[[], int]) -> int:
    """Append a run's tables in one commit, fenced by its derivation's lease: one whose lease has run out, or was taken over, publishes nothing.

    ``now_ms``: a clock, asked when the commit is made, after the tables are written; a number stands still.

    A run that is there already is a conflict, as is a table that changes meanwhile.
    """
    base = catalog.number()
    key = run.runs.first().derivation_id
    there, made = catalog.tables(base), {}
    new: dict[str, DataFrame] = {"runs": run.runs, "conclusions": run.conclusions, "links": run.links, "used_memory": run.used_memory}
    if "runs" in there and not catalog._rows(there["runs"]).join(run.runs.select("id"), "id", "left_semi").isEmpty():
        raise SnapshotConflict("the run is published already")
    for name, rows in new.items():
        made[name] = catalog.appended(name, rows, there.get(name))
    return catalog.commit(made, base, guard=lambda: held(catalog, key, token, now_ms() if callable(now_ms) else now_ms))


def reusable(catalog: Catalog, derivation_id: str, run_json: str) -> bool:
    """Whether a derivation's newest stored run is this one byte for byte, with an edge to each memory that it states."""
    if catalog.missing(["runs", "used_memory"]):
        return False
    runs = catalog.read("runs").where(F.col("derivation_id") == derivation_id)
    newest = runs.orderBy(F.desc_nulls_first("created_at"), "id").first()
    if newest is None or newest.run_json != run_json:
        return False
    used = catalog.read("used_memory").where(F.col("run_id") == newest.id).select("memory_id").distinct().count()
    return used == len(set(newest.input_memory_ids)) == newest.input_memory_count
