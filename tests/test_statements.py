"""Statements beside queries, results, Avro and JDBC."""

import datetime as dt
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.operators.results import ScrollResult, explained, result_batches
from millrace.plans.statements import Called, call_statement, execute, procedures
from millrace.sources import avro
from millrace.sources import readers as R
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def t(spark):
    return Tables(spark, FOLDER)


def test_call(t):
    procedures.create("DOUBLED", lambda t, n, s: t.spark.range(1).select(F.lit(n * 2).alias("n"), F.lit(s).alias("s")))
    assert rows(execute(t, "CALL SYSCS.DOUBLED(21, 'it''s, (so)');")) == [(42, "it's, (so)")]
    assert execute(t, "CALL COLLECT_STATISTICS('nation')").where("column_name = 'n_nationkey'").first().n_rows == 25
    with pytest.raises(ValueError):
        execute(t, "CALL NOTHING()")


def test_explain_and_properties(t):
    assert "Filter" in execute(t, "EXPLAIN OPTIMIZED SELECT TOP 3 n_name FROM nation WHERE n_nationkey > 3").first()[0]
    assert "FileScan" in execute(t, "EXPLAIN SELECT n_name FROM nation").first()[0]
    assert "UnresolvedRelation" in explained(t.spark.sql("SELECT 1"), "logical") or explained(t.spark.sql("SELECT 1"), "analyzed")
    before = t.spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert rows(execute(t, "SET SESSION PROPERTY olapShufflePartitions = 6")) == [("olapshufflepartitions", "6")]
    finally:
        t.spark.conf.set("spark.sql.shuffle.partitions", before)


def test_signal(t):
    with pytest.raises(PySparkException, match="75001"):
        execute(t, "SIGNAL SQLSTATE '75001' ('too late')").collect()


def test_results(spark):
    df = spark.range(25).selectExpr("(id * 7) % 25 AS k")
    assert [len(b) for b in result_batches(df, 10)] == [10, 10, 5]
    s = ScrollResult(df, [F.col("k")])
    assert (s.n, s.next().k, s.relative(3).k, s.previous().k, s.absolute(-1).k, s.next(), s.absolute(99)) == (25, 0, 3, 2, 24, None, None)


def test_refresh_and_pinned(spark):
    df = spark.range(3)
    assert not R.is_pinned(df)
    df.persist()
    assert R.is_pinned(df)
    df.unpersist()
    R.refresh(spark, FOLDER)
    assert rows(R.from_rdd(spark.sparkContext.parallelize([(1,)]), "x int")) == [(1,)]


SCHEMA = "b boolean, s smallint, i int not null, l bigint, f float, d double, t string, y binary, day date, at timestamp, local timestamp_ntz, a array<int>, m map<string,double>, r struct<x:int,y:string>"


@pytest.mark.parametrize("codec", ["null", "deflate", "zstandard"])
def test_avro_round_trip(spark, tmp_path, monkeypatch, codec):
    spark.dataSource.register(avro.AvroSource)
    full = (True, -3, 7, -(2**63), 0.5, 1e300, "ü\n", b"\x00\xff", dt.date(1, 1, 1), dt.datetime(1969, 12, 31, 23), dt.datetime(2400, 2, 29, 1, 2, 3, 4), [1, None, -2], {"k": 1.5}, (1, None))
    data = [full, (None, None, 0, *[None] * 11)] + [(i % 2 == 0, i, i, 2**62 + i, 0.0, float(i), "x" * (i % 50), b"", None, None, None, [], {}, None) for i in range(9000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    df.write.format("avro_files").mode("overwrite").option("codec", codec).save(str(tmp_path / "a"))
    monkeypatch.setattr(avro, "SPLIT_BYTES", 1 << 14)
    back = spark.read.format("avro_files").load(str(tmp_path / "a"))
    assert back.dtypes == [(n, "int" if k == "smallint" else k) for n, k in df.dtypes]
    assert rows(back.drop("m")) == rows(df.drop("m").withColumn("s", F.col("s").cast("int")))
    reader = avro.AvroReader(str(tmp_path / "a"), back.schema)
    parts = reader.partitions()
    assert len(parts) > 6 and sum(1 for p in parts for _ in reader.read(p)) == len(data)  # every block in one split
    df.limit(1).write.format("avro_files").mode("append").save(str(tmp_path / "a"))
    assert spark.read.format("avro_files").load(str(tmp_path / "a")).select("i").count() == len(data) + 1


def test_avro_refuses_what_it_cannot_hold(spark):
    with pytest.raises(ValueError):
        avro.avro_schema(spark.sql("SELECT INTERVAL 1 DAY AS x").schema, False)
    with pytest.raises(ValueError):
        avro.spark_type(["int", "string"])


def test_jdbc(spark):
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no embedded database on the class path")
    url = f"jdbc:derby:memory:t{random.randrange(10**9)};create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("id AS k", "cast(id % 7 AS int) AS g").write.format("jdbc").options(url=url, dbtable="x", **options).save()
    assert R.jdbc_query(spark, url, 'SELECT "g", count(*) AS n FROM x GROUP BY "g"', **options).count() == 7
    parts = R.jdbc_query(spark, url, 'SELECT "k" FROM x', partitionColumn="k", lowerBound="0", upperBound="100", numPartitions="4", **options)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 100


def test_jdbc_by_driver(spark, monkeypatch):
    """Whatever the number of rows is against the size of a chunk, all of them come, with their types and nulls."""
    url, options = f"jdbc:derby:memory:t{random.randrange(10**9)}", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    connection = R.jdbc_connection(spark, f"{url};create=true", **options)
    connection.createStatement().execute("CREATE TABLE x (k BIGINT, d DECIMAL(9,2), s VARCHAR(20), w TIMESTAMP, f DOUBLE, b VARCHAR(4) FOR BIT DATA)")
    connection.createStatement().execute("INSERT INTO x VALUES (0, NULL, NULL, NULL, NULL, NULL)")
    for k in range(1, 10):
        connection.createStatement().execute(f"INSERT INTO x VALUES ({k}, {k}.25, 'it''s {k}', '2024-02-29 23:59:0{k}.000001', {k}e10, X'0{k}ff')")
    connection.close()
    for query in ("SELECT * FROM x", "SELECT k, s FROM x WHERE k < 0", "SELECT count(*) AS n, max(w) AS w FROM x"):
        want = R.jdbc_query(spark, url, query, **options)
        for chunk in (1, 5, 9, 10, 11, 100):
            monkeypatch.setattr(R, "CHUNK", chunk)
            got = R.jdbc_query_by_driver(spark, url, query, **options)
            assert got.dtypes == want.dtypes and rows(got) == rows(want), (query, chunk)
    monkeypatch.setattr(R, "CHUNK_BYTES", 1)
    monkeypatch.setattr(R, "GROUP", 3)
    got = R.jdbc_query_by_driver(spark, url, "SELECT k FROM x", **options)
    assert rows(got) == [(k,) for k in range(10)] and len(got.inputFiles()) >= 4  # a chunk per group
    with pytest.raises(Exception, match="NOWHERE"):
        R.jdbc_query_by_driver(spark, url, "SELECT * FROM nowhere", **options)
    with pytest.raises(Exception, match="dropped"):
        R.jdbc_connection(spark, f"{url};drop=true", **options)


def test_jdbc_table_where_executors_are_other_processes(tmp_path):
    """The database is in the driver's process: executors have none of it."""
    script = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.config(map={{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}"}}).getOrCreate()
print("found", sorted(map(tuple, entry.queries()["jdbc_table"](spark, "{FOLDER}").collect())))
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert "found [(0, 5), (1, 5), (2, 5), (3, 5), (4, 5)]" in done.stdout, done.stderr[-2000:]


def test_csv_line_ends_and_quotes(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("v", T.StringType())])
    for name, end in (("lf", "\n"), ("crlf", "\r\n"), ("cr", "\r")):
        (tmp_path / name).write_bytes(f'1,a{end}2,"b,""c"""{end}'.encode())
        assert rows(R.import_csv(spark, str(tmp_path / name), schema, escape='"')) == [(1, "a"), (2, 'b,"c"')]
    (tmp_path / "multi").write_bytes(b'1,"two\nlines"\n')
    assert rows(R.import_csv(spark, str(tmp_path / "multi"), schema, multiLine="true")) == [(1, "two\nlines")]


def test_avro_overwrite(spark, tmp_path):
    """An overwrite that fails leaves what was there; one that succeeds replaces it; file URLs are paths too."""
    spark.dataSource.register(avro.AvroSource)
    path = f"file://{tmp_path}/a"
    write = lambda df: df.write.format("avro_files").mode("overwrite").save(path)
    read = lambda: rows(spark.read.format("avro_files").load(path))
    write(spark.range(5).repartition(2))
    with pytest.raises(PySparkException):
        write(spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id")))
    assert read() == [(i,) for i in range(5)]
    write(spark.range(3))
    assert read() == [(0,), (1,), (2,)] and not [p.name for p in (tmp_path / "a").iterdir() if not p.name.endswith((".avro", ".crc"))]


def test_out_parameters(t):
    procedures.create("BOTH", lambda t, a, out, b: Called([t.spark.range(a), t.spark.range(b)], {"n": a + b}))
    done = call_statement(t, "CALL both(2, ?, 3)")
    assert [s.count() for s in done.sets] == [2, 3] and done.out == {"n": 5}
    procedures.create("ONLY_OUT", lambda t: Called(out={"x": 1, "y": None}))
    assert execute(t, "CALL ONLY_OUT()").collect() == [("1", None)]


def test_kafka_records_and_statement(t, monkeypatch):
    from millrace.sources import writers

    sent = []
    monkeypatch.setattr(writers, "export_kafka", lambda df, servers, topic, key=None: sent.append((rows(writers.kafka_records(df, key)), servers, topic)))
    execute(t, "EXPORT_KAFKA('host:9092', 'nations', 'n_nationkey') SELECT n_nationkey, nullif(n_regionkey, 0) AS r FROM nation WHERE n_nationkey < 2")
    assert sent == [([("0", '{"n_nationkey":0,"r":null}'), ("1", '{"n_nationkey":1,"r":1}')], "host:9092", "nations")]
