"""Joins, changes, user-defined aggregates, statistics, sources and sinks on small tables."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.arrowops import local_aggregate
from millrace.operators import dml
from millrace.operators import joins as J
from millrace.operators import statistics as St
from millrace.operators import udfs as U
from millrace.sources import readers as R
from millrace.sources import writers as W
from tests.conftest import rows


def at(s):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)


def test_local_aggregate(spark):
    df = spark.createDataFrame([(1, None, 3, "x"), (1, None, 5, "y"), (None, 2, None, "z")], "a int, b bigint, n int, extra string").coalesce(1)
    assert rows(local_aggregate(df, ["a", "b"], {"n": "max"})) == [(1, None, 5), (None, 2, None)]
    assert rows(local_aggregate(df, ["a"])) == [(1,), (None,)]
    assert local_aggregate(df.limit(0), ["a"]).count() == 0


def test_range_join(spark):
    left = spark.createDataFrame([(1, at(0), at(250)), (1, at(100), at(50)), (None, at(0), at(9))], "k int, lo timestamp_ntz, hi timestamp_ntz")
    right = spark.createDataFrame([(1, at(0)), (1, at(250)), (1, at(251)), (1, None), (2, at(5))], "k int, p timestamp_ntz")
    got = J.range_join(left, right, keys=["k"], low="lo", high="hi", point="p", width_s=100)
    assert rows(got, "p") == [(at(0),), (at(250),)]


def test_nearest_before(spark):
    left = spark.createDataFrame([(1, at(5), "a"), (1, at(0), "b"), (2, at(9), "c"), (None, at(9), "d")], "k int, t timestamp_ntz, x string")
    right = spark.createDataFrame([(1, at(5), 50), (1, at(4), 40), (3, at(0), 0)], "k int, t timestamp_ntz, v int")
    assert rows(J.nearest_before(left, right, keys=["k"], at="t", values=["v"]), "x", "v") == [("a", 50), ("b", None), ("c", None), ("d", None)]


def test_bounded_broadcast(spark):
    small = spark.range(10)
    assert "broadcast" in J.bounded_broadcast(small)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in J.bounded_broadcast(small, 1)._jdf.queryExecution().logical().toString().lower()


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(2, "b"), (None, "m"), (3, "c")], "k int, v string")
    assert rows(dml.upsert(t, s, ["k"])) == [(1, "a"), (2, "b"), (3, "c"), (None, "m")]
    assert rows(dml.delete_rows(t, F.col("v") == "a")) == [(2, None), (None, "n")]
    assert rows(dml.update_rows(t, F.col("v") == "a", k=F.col("k") + 1)) == [(2, "a"), (2, None), (None, "n")]
    assert rows(dml.update_from(t, s, ["k"], ["v"])) == [(1, "a"), (2, "b"), (None, "n")]
    assert rows(dml.insert_rows(t, spark.createDataFrame([(9,)], "k int"), {"v": F.lit("d")}))[-2:] == [(9, "d"), (None, "n")]
    assert dml.upsert(t.limit(0), s.limit(0), ["k"]).count() == 0


def test_constraints(spark):
    t = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (None, 7)], "k int, v int")
    assert rows(dml.duplicate_keys(t, ["k"])) == [(1, 2)]
    assert rows(dml.missing_parents(t, "v", spark.createDataFrame([(5,), (6,)], "p int"), "p")) == [(7,)]
    assert rows(dml.null_violations(t, ["k"])) == [(None, 7), (None, 7)]
    assert rows(dml.check_violations(t, F.col("k") > 1)) == [(1, 5), (1, 6)]
    with pytest.raises(PySparkException):
        dml.enforced(t, F.col("v") < 7, "too large").collect()


def test_normalize(spark):
    target = T.StructType([T.StructField("a", T.ShortType(), False), T.StructField("b", T.VarcharType(3))])
    assert rows(dml.normalize(spark.createDataFrame([("7", "xy ")], "p string, q string"), target)) == [(7, "xy ")]
    for bad in ((None, "x"), ("1", "abcd")):
        with pytest.raises(PySparkException):
            dml.normalize(spark.createDataFrame([bad], "p string, q string"), target).collect()


def test_user_aggregate(spark):
    parts = {"init": lambda: [], "accumulate": lambda s, v: s + v.tolist(), "merge": lambda a, b: a + b, "terminate": lambda s: float(sorted(s)[len(s) // 2]) if s else None, "name": "m", "returns": "double"}
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), (None, 4.0), ("b", None)], "k string, v double").repartition(3)
    assert rows(U.aggregate(df, ["k"], "v", **parts)) == [("a", 2.0), ("b", None), (None, 4.0)]
    assert rows(U.aggregate(df.limit(0), [], "v", **parts)) == [(None,)]


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "bb")], "x int, s string")
    assert rows(St.column_statistics(df, exact=True)) == [("s", 3, 1, 2, "a", "bb", 1.5), ("x", 3, 0, 2, "1", "2", 1.0)]
    assert rows(St.frequencies(df, "x", 1)) == [(2, 2)]
    assert rows(St.quantiles(df, "x", [0.0, 1.0])) == [(0.0, 1), (1.0, 2)]
    assert rows(St.selectivity(df.limit(0), F.col("x") > 1)) == [(0, 0, None)]


def test_import_threshold(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1,a\nx,b\n,c\n")
    schema = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("v", T.StringType())])
    assert rows(R.import_csv(spark, str(tmp_path / "in.csv"), schema, bad_path=str(tmp_path / "bad"), allowed=2)) == [(1, "a")]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "bad")).collect()) == [",c", "x,b"]
    with pytest.raises(R.TooManyBadRecords):
        R.import_csv(spark, str(tmp_path / "in.csv"), schema, allowed=1)


def test_export_quoting(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b'), (2, None)], "k int, v string").coalesce(1)
    assert W.export_files(df, f"'{tmp_path}/x'", "null", "1", "'UTF-8'", "';'", "'\"'", "'ALWAYS'").first()[0] == 2
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    assert '"1";"a""b"' in text


def test_bucketed_join_needs_no_shuffle(spark):
    for name in ("left_b", "right_b"):
        W.bucketed_table(spark.range(50).withColumnRenamed("id", "k"), name, ["k"], 4)
    joined = spark.table("left_b").hint("merge").join(spark.table("right_b"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString() and joined.count() == 50
    St.analyze_table(spark, "left_b")


def test_filters_reach_the_scan(spark):
    path = "/root/testdata/sf0.001/lineitem.parquet"
    plan = spark.read.parquet(path).where(F.col("l_orderkey").isin(1, 2)).select("l_orderkey", "l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(l_orderkey" in plan and "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in plan


def test_whole_groups_split_no_group():
    import random

    import pyarrow as pa

    from millrace.arrowops import columns_of, whole_groups

    rng = random.Random(6)
    data = sorted(((rng.choice([None, 1, 2, 3]), rng.choice([None, *range(9)])) for _ in range(500)), key=lambda r: tuple((x is not None, x or 0) for x in r))
    table = pa.table({"a": pa.array([r[0] for r in data], pa.int64()), "b": pa.array([r[1] for r in data], pa.int64())})
    for rows_ in (1, 7, 40, 10**6):
        out = list(whole_groups(iter(table.to_batches(max_chunksize=13)), ["a", "b"], rows_))
        assert pa.concat_tables(out).equals(table)
        groups = [set(zip(t["a"].to_pylist(), t["b"].to_pylist())) for t in out]
        assert sum(map(len, groups)) == len(set(data))
    assert list(whole_groups(iter([]), ["a"])) == [] and columns_of(table, ["a"], -1)[0].min() == -1


def test_export_of_nothing(spark, tmp_path):
    assert W.export_files(spark.range(5).where("id > 9"), f"'{tmp_path}/none'", kind="'parquet'").first()[0] == 0
    assert W.export_files(spark.createDataFrame([], "k int"), f"'{tmp_path}/none'").first()[0] == 0
    assert W.export_files(spark.createDataFrame([(1e-7,), (1.5,)], "x double").coalesce(1), f"'{tmp_path}/plain'", floats="'plain'").first()[0] == 2
    assert sorted("".join(p.read_text() for p in (tmp_path / "plain").glob("part-*")).split()) == ["0.000000100", "1.500000000"]


def test_nearest_before_across_ranges(spark):
    """Against a plain loop: hot key, nulls, values that are carried over many ranges."""
    import datetime as dt
    import random

    rng = random.Random(4)
    time = lambda: rng.choice([None, *(dt.datetime(2025, 1, 1) + dt.timedelta(minutes=rng.randrange(5000)) for _ in range(20))])
    left = [(rng.choice([1, 1, 1, 2, None]), time(), i) for i in range(200)]
    right = list({(k, t): (k, t, v) for k, t, v in ((rng.choice([1, 1, 2, None]), time(), i) for i in range(60))}.values())
    want = []
    for k, t, i in left:
        before = [r for r in right if r[0] == k and t is not None and r[1] is not None and r[1] <= t]
        want.append((k, t, i, max(before, key=lambda r: r[1])[2] if before else None))
    a, b = spark.createDataFrame(left, "k int, t timestamp_ntz, i int").repartition(3), spark.createDataFrame(right, "k int, t timestamp_ntz, v int")
    for width in (60, 3600, 86_400, 10**9):
        assert rows(J.nearest_before(a, b, keys=["k"], at="t", values=["v"], width_s=width)) == sorted(want, key=repr)


def test_pushed_bounds():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual, StringContains

    from millrace.sources.readers import FilteredNumbers

    reader = FilteredNumbers({"upto": "1000", "parts": "3"}).reader(None)
    other = StringContains(("n",), "5")
    assert list(reader.pushFilters([IsNotNull(("n",)), GreaterThan(("n",), 10), LessThanOrEqual(("n",), 20), other])) == [other]
    assert [n for p in reader.partitions() for b in reader.read(p) for n in b.column(0).to_pylist()] == list(range(11, 21))
    assert list(reader.pushFilters([EqualTo(("n",), 5)])) == [] and reader.partitions() == [] and list(reader.read(None)) == []
