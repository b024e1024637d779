"""Every query on the driver's tables against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from annalist.plans import graph_queries, log_queries, surrogates, tail_queries  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(surrogates.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = surrogates.QUERIES[name](spark, str(DATA))
    result = duck.execute(surrogates.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == want


def test_every_query_has_sql():
    assert set(surrogates.QUERIES) == set(surrogates.ORACLE_SQL)


def test_the_registry_needs_no_session():
    """The driver imports the entry before it starts Spark."""
    import subprocess
    import sys

    root = __file__.rsplit("/", 2)[0]
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
