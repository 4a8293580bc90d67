"""The queries of this subpackage on the smallest tables, against their SQL twins or plain versions."""

from pathlib import Path

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from millrace.catalog import Tables  # noqa: E402
from millrace.llm.queries import registry  # noqa: E402
from tests.llm.test_repetition import plain as units  # noqa: E402
from verify import plain  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.mark.parametrize("name", registry.queries)
def test_query(spark, name):
    df = registry.queries[name](Tables(spark, FOLDER))
    columns = sorted(df.columns)
    own = [df.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[i]) for i in own) for r in df.collect()), key=repr)
    if (sql := registry.oracles.get(name)) is None:
        assert got
        return
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cursor = con.execute(sql)
    there = [d[0] for d in cursor.description]
    assert sorted(there) == columns
    assert got == sorted((tuple(plain(r[i]) for i in map(there.index, columns)) for r in cursor.fetchall()), key=repr)


def test_found_repetition(spark):
    t = Tables(spark, FOLDER)
    want = []
    for r in t.documents.select("doc_id", "text").collect():
        n, again, _ = units(r.text)
        if n >= 20 and again * 5 >= 2 * n:
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in registry.queries["p8_found"](t).collect()) == sorted(want)
