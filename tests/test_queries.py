"""Every query with a SQL twin against it on the smallest tables; the driver's contract."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verify import plain

FOLDER = "/root/testdata/sf0.001"
CORE = [n for n in entry._registry().queries if not n.startswith(("p3_", "p5_", "p6_", "p7_", "p8_"))]
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns) and all(c == c.lower() for c in columns)
    own = [df.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[i]) for i in own) for r in df.collect()), key=repr)
    if (sql := entry.oracle_sql().get(name)) is None:
        return
    cursor = duck.execute(sql)
    there = [d[0] for d in cursor.description]
    assert sorted(there) == columns
    assert got == sorted((tuple(plain(r[i]) for i in map(there.index, columns)) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_session():
    """The catalogue can be listed before a session exists."""
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, cwd=Path(entry.__file__).parent)
