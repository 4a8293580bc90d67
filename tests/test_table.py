"""Changeable tables: random changes against a dictionary, versions, constraints, conflicts."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.table import ChangeableTable, Conflict, Violation
from tests.conftest import rows

SCHEMA = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("v", T.StringType()), T.StructField("n", T.LongType())])


def test_random_changes(spark, tmp_path):
    rng = random.Random(8)
    table, held, states = ChangeableTable.create(spark, str(tmp_path / "t"), SCHEMA, ["k"]), {}, [[]]
    for _ in range(14):
        step = rng.choice(["insert", "update", "delete", "upsert"])
        if step == "insert":
            new = {k: (k, rng.choice(["a", None]), rng.randrange(9)) for k in rng.sample(range(60), 6) if k not in held}
            table.insert(spark.createDataFrame(list(new.values()), SCHEMA))
            held |= new
        elif step == "update":
            table.update(F.col("n") > 4, n=F.col("n") - 3, v=F.concat("v", F.lit("!")))
            held = {k: (k, v + "!" if v else None, n - 3) if n is not None and n > 4 else (k, v, n) for k, (_, v, n) in held.items()}
        elif step == "delete":
            table.delete(F.col("v") == "a")
            held = {k: r for k, r in held.items() if r[1] != "a"}
        else:
            new = {k: (k, "u", None) for k in rng.sample(range(60), 5)}
            table.upsert(spark.createDataFrame(list(new.values()), SCHEMA))
            held |= new
        states.append(sorted(held.values(), key=repr))
        assert rows(table.read()) == states[-1]
    for v in (0, 3, 9, 14):
        assert rows(table.read(v)) == states[v]
    assert table.restore(5) == 15 and rows(table.read()) == states[5]
    assert table.truncate() == 16 and table.read().count() == 0 and table.history().count() == 17
    table.restore(14)
    table.vacuum()
    assert rows(table.read()) == states[14] and len(table.versions()) == 1


def test_constraints(spark, tmp_path):
    table = ChangeableTable.create(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["n < 10"])
    one = lambda *r: spark.createDataFrame([r], "k int, v string, n bigint")
    table.insert(one(1, "a", None))
    with pytest.raises(Violation):
        table.insert(one(1, "b", 2))
    with pytest.raises(Violation):
        table.insert(one(2, "b", 2).unionAll(one(2, "c", 3)))
    for bad in ((None, "x", 1), (3, "x", 11)):
        with pytest.raises(PySparkException):
            table.insert(one(*bad))
    with pytest.raises(PySparkException):
        table.update(F.lit(True), n=F.lit(99))
    assert rows(table.read()) == [(1, "a", None)] and table.versions() == [0, 1]
    table.insert(spark.createDataFrame([(5,)], "k int"), {"v": F.lit("d")})
    assert rows(table.read()) == [(1, "a", None), (5, "d", None)]


def test_only_touched_files_are_rewritten(spark, tmp_path):
    table = ChangeableTable.create(spark, str(tmp_path / "t"), SCHEMA)
    for low in (0, 100, 200):
        table.insert(spark.range(low, low + 50).selectExpr("cast(id AS int) AS k", "'x' AS v", "id AS n").coalesce(1))
    before = set(table._latest()["files"])
    table.update(F.col("k") == 120, v=F.lit("y"))
    after = set(table._latest()["files"])
    assert len(before & after) == 2 and table.read().where("v = 'y'").count() == 1 and table.read().count() == 150


def test_transition_tables(spark, tmp_path):
    table = ChangeableTable.create(spark, str(tmp_path / "t"), SCHEMA)
    table.insert(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (2, "b", 2)], SCHEMA))
    at = table.insert(spark.createDataFrame([(3, "c", 3)], SCHEMA))
    table.update(F.col("k") == 1, v=F.lit("z"))
    table.delete(F.col("k") == 3)
    old, new = table.changes(at)
    assert rows(old) == [(1, "a", 1), (3, "c", 3)] and rows(new) == [(1, "z", 1)]
    assert [d.count() for d in table.changes(0, at)] == [0, 4]


def test_conflict_and_time(spark, tmp_path):
    table = ChangeableTable.create(spark, str(tmp_path / "t"), SCHEMA)
    m = table._latest()
    moment = dt.datetime.now(dt.timezone.utc)
    table.insert(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    with pytest.raises(Conflict):
        table._next(m, "late", [], [])
    assert table.read(as_of=moment).count() == 0 and table.read(as_of=dt.datetime.now(dt.timezone.utc)).count() == 1
    with pytest.raises(ValueError):
        table.read(as_of=dt.datetime(2000, 1, 1))


def test_adapter(spark, tmp_path):
    """The data source reads what the table writes, in any version, and the other way round; keys are not its business."""
    from millrace.sources.adapter import ChangeableSource

    spark.dataSource.register(ChangeableSource)
    kinds = "k int not null, at timestamp, local timestamp_ntz, day date, n decimal(9,2), a array<int>, b binary, r struct<x:int,y:string>"
    path = f"{tmp_path}/t"
    table = ChangeableTable.create(spark, path, spark.createDataFrame([], kinds).schema)
    when = dt.datetime(2025, 3, 4, 5, 6, 7, 8)
    one = spark.createDataFrame([(1, when, when, when.date(), None, [1, None], b"x", (1, None)), (2, *[None] * 7)], kinds)
    table.insert(one)
    load = lambda **o: spark.read.format("changeable").options(**o).load(path)
    assert rows(load()) == rows(one) and load().dtypes == one.dtypes
    one.where("k = 1").write.format("changeable").mode("append").save(path)
    assert rows(table.read()) == rows(one.unionAll(one.where("k = 1"))) and load(version="1").count() == 2
    one.where("k = 2").write.format("changeable").mode("overwrite").save(path)
    assert rows(table.read()) == rows(load()) == rows(one.where("k = 2")) and table.versions() == [0, 1, 2, 3]
    with pytest.raises(PySparkException):
        spark.sql("SELECT cast(null AS int) AS k").join(one.drop("k").limit(1)).write.format("changeable").mode("append").save(path)
    with pytest.raises(PySparkException):
        one.select("k").write.format("changeable").mode("append").save(path)
    keyed = ChangeableTable.create(spark, f"{tmp_path}/keyed", SCHEMA, ["k"])
    with pytest.raises(PySparkException):
        spark.createDataFrame([], SCHEMA).write.format("changeable").mode("append").save(keyed.path)
    assert table.versions() == [0, 1, 2, 3] and load(version="0").count() == 0
