"""Pages of a sorted result by the last key that was shown: no page reads what came before. A page of up to TOP rows is a range filter and a top-k, a larger one all rows between two keys."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.walks import durable
from annalist.plans.pages import StaleCursor

#: A top-k of more rows would bring so many of each partition into one task.
TOP = 1_000


def _plain(v: object) -> object:
    return [type(v).__name__, v.isoformat() if isinstance(v, (datetime, date)) else str(v)] if isinstance(v, (datetime, date, Decimal)) else v


def _typed(v: object) -> object:
    if not isinstance(v, list):
        return v
    return {"datetime": datetime.fromisoformat, "date": date.fromisoformat, "Decimal": Decimal}[v[0]](v[1])


@dataclass(frozen=True)
class Order:
    """A sort by columns that together are different for every row; ``descending`` names those that fall. Nulls come first where values rise and last where they fall, as Spark sorts them."""

    columns: tuple[str, ...]
    descending: frozenset[str] = frozenset()

    def by(self) -> list[Column]:
        return [F.col(c).desc() if c in self.descending else F.col(c).asc() for c in self.columns]

    def after(self, last: list[object]) -> Column:
        """Rows behind the one with these values. The condition on the first column stands by itself as well, so that a scan can skip by it."""
        behind = []
        same = F.lit(True)
        for c, v in zip(self.columns, last, strict=True):
            falls = c in self.descending
            if v is None:  # behind nulls are all values, or nothing
                beyond = F.lit(False) if falls else F.col(c).isNotNull()
            else:
                beyond = (F.col(c) < F.lit(v)) | F.col(c).isNull() if falls else F.col(c) > F.lit(v)
            behind.append(same & beyond)
            same = same & F.col(c).eqNullSafe(F.lit(v))
        out = behind[0]
        for b in behind[1:]:
            out = out | b
        first, v = self.columns[0], last[0]
        if v is not None:
            out = out & ((F.col(first) <= F.lit(v)) | F.col(first).isNull() if first in self.descending else F.col(first) >= F.lit(v))
        return out

    def upto(self, last: list[object]) -> Column:
        """The row with these values and all in front of it; again with a condition on the first column."""
        out = ~F.coalesce(self.after(last), F.lit(False))
        first, v = self.columns[0], last[0]
        if first in self.descending:
            return out if v is None else out & (F.col(first) >= F.lit(v))
        return out & (F.col(first).isNull() if v is None else (F.col(first) <= F.lit(v)) | F.col(first).isNull())


def encode(snapshot: str | None, order: Order, last: list[object]) -> str:
    body = {"snapshot": snapshot, "columns": list(order.columns), "descending": sorted(order.descending), "last": [_plain(v) for v in last]}
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode()


def decode(cursor: str, snapshot: str | None, order: Order) -> list[object]:
    """The last values of a cursor; StaleCursor if it is none, of another order, or of another snapshot of the table."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor))
        fits = body["columns"] == list(order.columns) and body["descending"] == sorted(order.descending) and len(body["last"]) == len(order.columns)
        last = [_typed(v) for v in body["last"]]
    except (ValueError, KeyError, TypeError) as e:
        raise StaleCursor(cursor) from e
    if not fits or body["snapshot"] != snapshot:
        raise StaleCursor(cursor)
    return last


def _ends(rows: DataFrame, order: Order, size: int, first: bool = False) -> Iterator[list[object]]:
    """The last values of each page but the last one, or of the first alone. Keys are sorted by ranges and numbered inside each of them; to the driver come a count a range and the keys that end pages."""
    keys = order.columns
    sorted_ = durable(rows.select(*keys).repartitionByRange(*order.by()).withColumn("_range", F.spark_partition_id()))
    counts, before, starts = dict(sorted_.groupBy("_range").count().collect()), 0, []
    for r in sorted(counts):
        starts.append((r, before))
        before += counts[r]
    if before <= size:
        return
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _start long"))
    at = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(*order.by()))
    ends = sorted_.join(starts, "_range").withColumn("_at", at).where((F.col("_at") % size == 0) & (F.col("_at") < before))
    for e in sorted((ends.where(F.col("_at") == size) if first else ends).collect(), key=lambda e: e["_at"]):
        yield [e[c] for c in keys]


def page(rows: DataFrame, order: Order, size: int, snapshot: str | None = None, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """(the next ``size`` rows in order, the cursor behind them or None at the end).

    ``snapshot`` names the state of the table that ``rows`` reads (``Catalog.version``); a cursor of another one is refused, as pages of two states do not fit together. The page is a plan of its own,
    and of it one row comes to the driver, the last.
    """
    if size < 1:
        raise ValueError("a page has a row at least")
    left = rows if cursor is None else rows.where(order.after(decode(cursor, snapshot, order)))
    if size > TOP:
        last = next(_ends(left, order, size, first=True), None)
        return (left if last is None else left.where(order.upto(last))).orderBy(*order.by()), last and encode(snapshot, order, last)
    found = left.orderBy(*order.by()).limit(size)
    nth = left.select(*order.columns).orderBy(*order.by()).limit(size + 1)
    # the row in front of the one that would be the first of the next page, and that one; a top-k that is collected would send so many rows of each partition to the driver
    tail = nth.offset(size - 1).agg(F.collect_list(F.struct(*order.columns)).alias("k")).first().k
    return found, encode(snapshot, order, list(tail[0])) if len(tail) == 2 else None


def pages(rows: DataFrame, order: Order, size: int, snapshot: str | None = None) -> Iterator[DataFrame]:
    """All pages, one after the other. The ends of large ones are found at once."""
    if size > TOP:
        left = rows
        for last in _ends(rows, order, size):
            yield left.where(order.upto(last)).orderBy(*order.by())
            left = rows.where(order.after(last))
        yield left.orderBy(*order.by())
        return
    cursor = None
    while True:
        found, cursor = page(rows, order, size, snapshot, cursor)
        yield found
        if cursor is None:
            return
