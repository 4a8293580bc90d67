"""Foreign keys, triggers and changes by SQL, against what a database does."""

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Tables
from millrace.plans.statements import execute
from millrace.sources.table import ChangeableTable, Conflict, ForeignKey, Trigger, Violation
from tests.conftest import rows


def schema(text):
    return T._parse_datatype_string(text)


@pytest.fixture
def family(spark, tmp_path):
    def make(on_delete):
        parent = ChangeableTable.create(spark, f"{tmp_path}/p_{on_delete}", schema("a int, x string"), primary=["a"])
        child = ChangeableTable.create(spark, f"{tmp_path}/c_{on_delete}", schema("k int, a int"), primary=["k"], references=[ForeignKey(["a"], parent.path, ["a"], on_delete)])
        parent.insert(spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "a int, x string"))
        child.insert(spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, None)], "k int, a int"))
        return parent, child

    return make


def test_foreign_keys(spark, family):
    parent, child = family("restrict")
    one = lambda *r: spark.createDataFrame([r], "k int, a int")
    for bad in (lambda: child.insert(one(40, 9)), lambda: child.update(F.col("k") == 10, a=F.lit(9)), lambda: child.upsert(one(10, 9)), lambda: parent.delete(F.col("a") == 1),
                lambda: parent.update(F.col("a") == 2, a=F.lit(7)), lambda: parent.truncate()):
        before = parent.versions(), child.versions()
        with pytest.raises(Violation):
            bad()
        assert (parent.versions(), child.versions()) == before
    with pytest.raises(PySparkException):
        parent.insert(spark.createDataFrame([(None, "none")], "a int, x string"))
    parent.delete(F.col("a") == 3)
    parent.update(F.col("a") == 1, x=F.lit("uno"))
    child.update(F.col("k") == 20, a=F.lit(1))
    parent.delete(F.col("a") == 2)
    assert rows(parent.read()) == [(1, "uno")] and rows(child.read()) == [(10, 1), (11, 1), (20, 1), (30, None)]
    with pytest.raises(ValueError):
        ChangeableTable.create(spark, child.path + "x", schema("k int, a int"), references=[ForeignKey(["k"], parent.path, ["x"])])


@pytest.mark.parametrize(("on_delete", "left"), [("cascade", [(20, 2), (30, None)]), ("set_null", [(10, None), (11, None), (20, 2), (30, None)])])
def test_on_delete(family, on_delete, left):
    parent, child = family(on_delete)
    parent.delete(F.col("a") == 1)
    assert rows(child.read()) == left and rows(parent.read(), "a") == [(2,), (3,)]


def test_self_reference(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = ChangeableTable.create(spark, path, schema("k int, up int"), primary=["k"], references=[ForeignKey(["up"], path, ["k"], "cascade")])
    table.insert(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4)], "k int, up int"))
    with pytest.raises(Violation):
        table.insert(spark.createDataFrame([(6, 7)], "k int, up int"))
    table.delete(F.col("k") == 1)
    assert rows(table.read()) == [(4, None), (5, 4)]


def test_triggers(spark, tmp_path):
    table = ChangeableTable.create(spark, f"{tmp_path}/t", schema("k int, v int, note string"), primary=["k"])
    log = ChangeableTable.create(spark, f"{tmp_path}/log", schema("what string, k int, v int"))
    one = lambda *r: spark.createDataFrame([r], "k int, v int, note string")
    table.add_trigger(Trigger("sums", "INSERT", "SELECT 'inserted' AS what, count(*) AS k, sum(v) AS v FROM {new_rows}", log.path, when="(SELECT max(v) FROM {new_rows}) > 5"))
    table.add_trigger(Trigger("raised", "UPDATE", "SELECT 'raised' AS what, new_k AS k, new_v - old_v AS v FROM {changed}", log.path, when="new_v > old_v", columns=["v"], each_row=True))
    table.add_trigger(Trigger("moved", "UPDATE", "SELECT 'both' AS what, (SELECT count(*) FROM {old_rows}) AS k, (SELECT sum(v) FROM {new_rows}) AS v", log.path))
    table.add_trigger(Trigger("gone", "DELETE", "SELECT 'gone' AS what, k, v FROM {old_rows}", log.path))
    table.add_trigger(Trigger("no_negative", "UPDATE", "SELECT 1 FROM {changed} WHERE new_v < 0", each_row=True))
    table.add_trigger(Trigger("noted", "INSERT", when="new_note IS NULL", each_row=True, assign={"note": "concat('v', new_v)"}))
    table.insert(spark.createDataFrame([(1, 1, None), (2, 2, "x")], "k int, v int, note string"))
    table.insert(one(3, 9, None))
    table.update(F.col("k") <= 2, v=F.col("v") * 2 - 1)  # 1 stays 1, 2 becomes 3
    table.update(F.col("k") == 3, note=F.lit("y"))
    with pytest.raises(Violation):
        table.update(F.col("k") == 1, v=F.lit(-1))
    table.delete(F.col("k") == 3)
    table.upsert(spark.createDataFrame([(1, 8, "z"), (4, 6, None)], "k int, v int, note string"))
    assert rows(table.read()) == [(1, 8, "z"), (2, 3, "x"), (4, 6, None)]
    want = [("inserted", 1, 9), ("raised", 2, 1), ("both", 2, 4), ("both", 1, 9), ("gone", 3, 9), ("raised", 1, 7), ("both", 1, 8), ("inserted", 1, 6)]
    assert rows(log.read()) == sorted(want, key=repr)
    table.drop_trigger("gone")
    table.delete(F.lit(True))
    assert log.read().where("what = 'gone'").count() == 1


def test_triggers_that_never_end(spark, tmp_path):
    table = ChangeableTable.create(spark, f"{tmp_path}/t", schema("k int"))
    table.add_trigger(Trigger("again", "INSERT", "SELECT k + 1 AS k FROM {new_rows}", table.path))
    with pytest.raises(Violation):
        table.insert(spark.createDataFrame([(1,)], "k int"))


STATEMENTS = [
    "INSERT INTO stock VALUES (1, 'nail', 10.5), (2, 'screw', NULL), (3, 'bolt; (x)', 7)",
    "INSERT INTO stock (what, k) SELECT n_name, 100 + n_nationkey FROM nation WHERE n_regionkey = 1",
    "UPDATE stock SET what = upper(what), n = coalesce(n, 0) + 1 WHERE k < 100 AND what <> 'WHERE'",
    "UPDATE stock AS s SET n = s.k / 2.0 WHERE s.k IN (SELECT 100 + n_nationkey FROM nation WHERE n_nationkey > 5)",
    "DELETE FROM stock WHERE n IS NULL AND k > (SELECT 102)",
    "DELETE FROM stock WHERE k NOT IN (SELECT 100 + n_nationkey FROM nation) AND n > 11",
    "MERGE INTO stock s USING (SELECT n_nationkey + 100 AS k, n_name AS name FROM nation WHERE n_nationkey BETWEEN 4 AND 8) u ON s.k = u.k WHEN MATCHED AND s.n > 1 THEN UPDATE SET n = s.n * 10, what = u.name WHEN NOT MATCHED THEN INSERT (k, what) VALUES (u.k, lower(u.name))",
    "MERGE INTO stock s USING (SELECT * FROM nation WHERE n_nationkey < 3) u ON s.k = 100 + u.n_nationkey WHEN MATCHED THEN DELETE",
    "UPDATE stock SET n = -1",
]


def test_changes_by_sql(spark, tmp_path):
    """Every statement against another database."""
    folder = "/root/testdata/sf0.001"
    t, db = Tables(spark, folder), duckdb.connect()
    t.attach("stock", ChangeableTable.create(spark, f"{tmp_path}/stock", schema("k int, what string, n double"), primary=["k"]))
    db.execute(f"CREATE VIEW nation AS SELECT * FROM '{folder}/nation.parquet'")
    db.execute("CREATE TABLE stock (k INTEGER, what VARCHAR, n DOUBLE)")
    for i, text in enumerate(STATEMENTS):
        assert execute(t, text).first().version == i + 1
        db.execute(text)
        assert sorted(map(tuple, execute(t, "SELECT k, what, n FROM stock").collect()), key=repr) == sorted(db.execute("SELECT k, what, n FROM stock").fetchall(), key=repr), text
    with pytest.raises(Violation):
        execute(t, "INSERT INTO stock (k) SELECT k FROM stock")
    with pytest.raises(Violation):
        execute(t, "MERGE INTO stock s USING (VALUES (107), (107)) u(k) ON s.k = u.k WHEN MATCHED THEN UPDATE SET n = 5")
    for bad in ("DELETE FROM nation", "INSERT INTO stock (k, nothing) VALUES (1, 2)", "INSERT INTO stock (k) VALUES (1, 2)"):
        with pytest.raises(ValueError):
            execute(t, bad)
    assert execute(t, "TRUNCATE TABLE stock").first().version == len(STATEMENTS) + 1 and t.stock.count() == 0


def test_manifests(spark, tmp_path, monkeypatch):
    """Manifests name changes only, and a broken one is no version."""
    from millrace.sources import table as module

    monkeypatch.setattr(module, "FULL", 3)
    table = ChangeableTable.create(spark, f"{tmp_path}/t", schema("k int"))
    for i in range(7):
        table.insert(spark.createDataFrame([(i,)], "k int").coalesce(1))
    table.delete(F.col("k") == 2)
    assert ["files" in table._text(v) and '"files"' in table._text(v) for v in table.versions()] == [v % 3 == 0 for v in range(9)]
    assert [table.read(v).count() for v in table.versions()] == [0, 1, 2, 3, 4, 5, 6, 7, 6]
    with open(f"{tmp_path}/t/versions/000000009.json", "w") as f:
        f.write('{"version"')
    assert table.read().count() == 6
    with pytest.raises(Conflict):
        table.delete(F.lit(True))
    assert table.repair() == [9] and table.delete(F.col("k") == 3) == 9
    table.vacuum(2)
    assert table.versions() == [8, 9] and [table.read(v).count() for v in (8, 9)] == [6, 5]
