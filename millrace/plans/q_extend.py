"""User-defined functions, aggregates and table functions; statistics; sources and sinks, read back after a write."""

from __future__ import annotations

import csv
import tempfile
import uuid
from contextlib import suppress
from functools import reduce

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Tables, table_columns, table_sizes
from millrace.operators import statistics as St
from millrace.operators import udfs as U
from millrace.operators.results import materialized, result_batches
from millrace.plans.statements import Called, call_statement, execute, procedures
from millrace.registry import Registry
from millrace.sources import readers as R
from millrace.sources import writers as W
from millrace.sources.table import ChangeableTable

registry = Registry()
query = registry.query


@query("udf_scalar", "SELECT c_custkey, round(c_acctbal * 180 / pi(), 6) AS degrees FROM customer")
def udf_scalar(t: Tables) -> DataFrame:
    """A vectorised function of the user's."""
    degrees = U.scalar_function(lambda x: x * (180 / 3.141592653589793), "double")
    return t.customer.select("c_custkey", F.round(degrees("c_acctbal"), 6).alias("degrees"))


@query("udf_sql_registered", "SELECT s_suppkey, length(s_name)::BIGINT * 2 AS n FROM supplier")
def udf_sql_registered(t: Tables) -> DataFrame:
    U.register(t.spark, "twice_length", lambda s: s.str.len() * 2, "bigint")
    return t.sql("SELECT s_suppkey, twice_length(s_name) AS n FROM {supplier}", "supplier")


@query("udaf_grouped", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 8) AS geo_mean FROM lineitem GROUP BY 1")
def udaf_grouped(t: Tables) -> DataFrame:
    """init, accumulate, merge, terminate: a geometric mean."""
    d = U.aggregate(
        t.lineitem, ["l_returnflag"], "l_quantity", init=lambda: (0, 0.0), accumulate=lambda s, v: (s[0] + len(v), s[1] + float(np.log(v).sum())), merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
        terminate=lambda s: float(np.exp(s[1] / s[0])) if s[0] else None, name="geo_mean", returns="double",
    )
    return d.select("l_returnflag", F.round("geo_mean", 8).alias("geo_mean"))


@query("udtf_table", "SELECT p_partkey, i::INTEGER AS place, string_split(p_name, ' ')[i] AS word FROM part, range(1, 6) r(i) WHERE i <= len(string_split(p_name, ' '))")
def udtf_table(t: Tables) -> DataFrame:
    """A table function in a lateral join."""
    t.spark.udtf.register("words_of", U.Words)
    return t.sql("SELECT p_partkey, place, word FROM {part} AS p, LATERAL words_of(p.p_name)", "part")


@query("udtf_builtin", "SELECT p_partkey, i::INTEGER AS place, string_split(p_name, ' ')[i] AS word FROM part, range(1, 6) r(i) WHERE i <= len(string_split(p_name, ' '))")
def udtf_builtin(t: Tables) -> DataFrame:
    """The same table function as built-in expressions."""
    return U.word_table(t.part, "p_name").select("p_partkey", "place", "word")


@query("udt_struct", "SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey = 1")
def udt_struct(t: Tables) -> DataFrame:
    """A user-defined type as a struct: built, compared and taken apart."""
    d = t.nation.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("place"))
    return d.where("place.region = 1").select("n_nationkey", "place.name", "place.region")


@query(
    "stats_columns",
    """SELECT 'o_custkey' AS column_name, count(*) AS n_rows, count(*) - count(o_custkey) AS n_null, count(DISTINCT o_custkey) AS n_distinct, min(o_custkey)::VARCHAR AS low, max(o_custkey)::VARCHAR AS high, round(avg(length(o_custkey::VARCHAR)), 6) AS avg_width FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus), round(avg(length(o_orderstatus)), 6) FROM orders""",
)
def stats_columns(t: Tables) -> DataFrame:
    return St.column_statistics(t.orders, ["o_custkey", "o_orderstatus"], exact=True).withColumn("avg_width", F.round("avg_width", 6))


@query("stats_quantiles", "SELECT p::DOUBLE AS point, true AS within_error FROM (VALUES (0.1), (0.25), (0.5), (0.75), (0.9)) v(p)")
def stats_quantiles(t: Tables) -> DataFrame:
    """Approximate quantiles: whether each one's rank is within the stated error of the rows."""
    q = St.quantiles(t.lineitem, "l_extendedprice", [0.1, 0.25, 0.5, 0.75, 0.9], 1000)
    n = t.lineitem.agg(F.count("l_extendedprice")).scalar()
    ranked = t.lineitem.select("l_extendedprice").join(F.broadcast(q), F.col("l_extendedprice") <= F.col("value")).groupBy("point").agg(F.count(F.lit(1)).alias("below"))
    return ranked.select("point", (F.abs(F.col("below") - F.col("point") * n) <= n / 500 + 1).alias("within_error"))


@query("stats_frequencies", "SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value ASC NULLS LAST LIMIT 5")
def stats_frequencies(t: Tables) -> DataFrame:
    return St.frequencies(t.documents, "source", 5)


@query("stats_selectivity", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_quantity < 10) AS n_match, count(*) FILTER (WHERE l_quantity < 10) / count(*) AS selectivity FROM lineitem")
def stats_selectivity(t: Tables) -> DataFrame:
    return St.selectivity(t.lineitem, F.col("l_quantity") < 10)


@query("stats_theta_sketch", "SELECT true AS within_error")
def stats_theta_sketch(t: Tables) -> DataFrame:
    """Distinct customers in total from mergeable sketches per order status: whether they are within 5 % of the exact number."""
    d = t.orders.groupBy("o_orderstatus").agg(F.theta_sketch_agg("o_custkey").alias("sketch"))
    exact = t.orders.agg(F.count_distinct("o_custkey")).scalar()
    return d.agg(F.theta_sketch_estimate(F.theta_union_agg("sketch")).alias("customers")).select((F.abs(F.col("customers") - exact) <= 0.05 * exact).alias("within_error"))


@query("export_csv_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def export_csv_roundtrip(t: Tables) -> DataFrame:
    path = W.scratch(t.spark, "csv")
    d = t.customer.select("c_custkey", "c_name", "c_acctbal")
    W.export_files(d, f"'{path}'", "'gz'", None, None, "'|'")
    return R.read_external(t.spark, path, "csv", d.schema, sep="|")


@query("export_statement", "SELECT count(*) AS exported_rows FROM orders WHERE o_orderstatus = 'F'")
def export_statement(t: Tables) -> DataFrame:
    from millrace.plans.sqlfront import run_sql

    path = W.scratch(t.spark, "export")
    return run_sql(t, f"EXPORT('{path}', 'none', 1, 'UTF-8', ';', '\"', 'ALWAYS') SELECT * FROM orders WHERE o_orderstatus = 'F'")


@query("export_parquet_partitioned", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def export_parquet_partitioned(t: Tables) -> DataFrame:
    """Written by flag; the scan reads the folder of one flag only."""
    path = W.scratch(t.spark, "parquet")
    W.write_external(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), path, "parquet", ["l_returnflag"], "zstd")
    return R.read_external(t.spark, path, "P").where("l_returnflag = 'R'")


@query("export_orc", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_totalprice > 400000")
def export_orc(t: Tables) -> DataFrame:
    path = W.scratch(t.spark, "orc")
    W.write_external(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), path, "orc", compression="zlib")
    return R.read_external(t.spark, path, "O").where("o_totalprice > 400000")


@query("external_empty", "SELECT r_regionkey, r_name FROM region WHERE 1 = 0")
def external_empty(t: Tables) -> DataFrame:
    path = W.scratch(t.spark, "empty")
    W.create_empty(t.spark, t.region.schema, path)
    return R.read_external(t.spark, path, "P", t.region.schema)


@query("bulk_load_sorted", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 20")
def bulk_load_sorted(t: Tables) -> DataFrame:
    path = W.scratch(t.spark, "bulk")
    W.bulk_load(t.orders.select("o_orderkey", "o_custkey"), path, ["o_custkey", "o_orderkey"], 8)
    return t.spark.read.parquet(path).where("o_custkey BETWEEN 10 AND 20")


@query("import_bad_records", "SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (4, 'd,e', 2.5::DOUBLE), (6, NULL, NULL)) v(id, name, x)")
def import_bad_records(t: Tables) -> DataFrame:
    """Good rows of a file with a wrong number, a missing key and a surplus column."""
    path, bad = W.scratch(t.spark, "import"), W.scratch(t.spark, "bad")
    text = ['1,a,1.5', 'x,b,2', ',c,3', '4,"d,e",2.5', '5,f,1,9', '6,,']
    t.spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(path)
    schema = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])
    return R.import_csv(t.spark, path, schema, bad_path=bad, allowed=3)


@query("whole_file_read", "SELECT 1 AS n_files, true AS same_size")
def whole_file_read(t: Tables) -> DataFrame:
    path = W.scratch(t.spark, "whole")
    t.region.select("r_name").coalesce(1).write.text(path)
    files, text = R.whole_files(t.spark, f"{path}/part-*"), R.lines(t.spark, path)
    size = text.agg(F.sum(F.octet_length("value") + 1)).scalar()
    return files.agg(F.count(F.lit(1)).cast("int").alias("n_files"), (F.sum("length") == size).alias("same_size"))


@query("schema_inference", "SELECT 'CREATE EXTERNAL TABLE ext (r_regionkey INT, r_name STRING) PARTITIONED BY (r_name) STORED AS PARQUET LOCATION ''/x''' AS ddl")
def schema_inference(t: Tables) -> DataFrame:
    path = W.scratch(t.spark, "infer")
    t.region.select("r_regionkey", "r_name").write.option("header", "true").csv(path)
    inferred = R.read_external(t.spark, path, "T", header="true")
    return t.spark.createDataFrame([(R.suggested_ddl("ext", inferred, "/x", partition_by=["r_name"]),)], "ddl string")


@query("python_data_source", "SELECT n FROM range(1, 101) r(n)")
def python_data_source(t: Tables) -> DataFrame:
    t.spark.dataSource.register(R.NaturalNumbers)
    return t.spark.read.format("natural_numbers").option("upto", 100).load()


@query("data_source_pushdown", "SELECT n FROM range(1000, 1100) r(n) WHERE n % 7 = 0")
def data_source_pushdown(t: Tables) -> DataFrame:
    """A data source that takes bounds of the query: of a thousand million numbers it makes a hundred."""
    t.spark.dataSource.register(R.FilteredNumbers)
    t.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return t.spark.read.format("filtered_numbers").option("upto", 10**9).load().where("n >= 1000 AND n < 1100 AND n % 7 = 0")


@query("catalog_tables", "SELECT table_name, count(*)::INTEGER AS n_columns, true AS has_size FROM information_schema.columns WHERE table_name IN ('region', 'orders', 'lineitem') GROUP BY 1")
def catalog_tables(t: Tables) -> DataFrame:
    return table_sizes(t, ["region", "orders", "lineitem"]).select("table_name", "n_columns", ((F.col("n_bytes") > 0) & (F.col("n_files") > 0)).alias("has_size"))


@query("table_from_rows", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, 'y')) v(k, s)")
def table_from_rows(t: Tables) -> DataFrame:
    return R.from_rows(t.spark, iter([(1, "x"), (2, "y")]), "k bigint, s string")


@query("table_from_pandas", "SELECT r_regionkey::BIGINT AS k, r_name AS s FROM region")
def table_from_pandas(t: Tables) -> DataFrame:
    """A small table of fixed size through pandas and back."""
    frame: pd.DataFrame = t.region.toPandas()
    return t.spark.createDataFrame(frame).select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("s"))


@query("avro_roundtrip", "SELECT event_id, ts, user_id, event_type, value FROM events")
def avro_roundtrip(t: Tables) -> DataFrame:
    """Written and read as Avro container files, without Spark's Avro package."""
    from millrace.sources.avro import AvroSource

    t.spark.dataSource.register(AvroSource)
    path = W.scratch(t.spark, "avro")
    t.events.select("event_id", "ts", "user_id", "event_type", "value").write.format("avro_files").mode("overwrite").save(path)
    return t.spark.read.format("avro_files").load(path)


@query("call_procedure", "SELECT column_name, n_rows FROM (SELECT 'r_regionkey' AS column_name, count(*) AS n_rows FROM region UNION ALL SELECT 'r_name', count(*) FROM region)")
def call_procedure(t: Tables) -> DataFrame:
    from millrace.plans.statements import execute

    return execute(t, "CALL SYSCS_UTIL.COLLECT_STATISTICS('region')").select("column_name", "n_rows")


@query("materialized_scroll", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def materialized_scroll(t: Tables) -> DataFrame:
    """The numbered rows of a scroll-insensitive result."""
    from millrace.operators.results import ScrollResult

    d = t.orders.select("o_orderkey", "o_totalprice")
    return ScrollResult(d, [F.desc("o_totalprice"), F.col("o_orderkey")]).rows.select("o_orderkey", F.col("_place").alias("place"))


@query("catalog_columns", "SELECT table_name, column_name, ordinal_position::INTEGER AS position FROM information_schema.columns WHERE table_name IN ('region', 'orders', 'lineitem') GROUP BY ALL")
def catalog_columns(t: Tables) -> DataFrame:
    return table_columns(t, ["region", "orders", "lineitem"]).select("table_name", "column_name", "position")


@query("read_by_extension", "SELECT c_custkey, c_name FROM customer")
def read_by_extension(t: Tables) -> DataFrame:
    """Files whose ending alone says what they are."""
    path = W.scratch(t.spark, "ending")
    d = t.customer.select("c_custkey", "c_name")
    parts = {"orc": d.where("c_custkey % 3 = 0"), "json": d.where("c_custkey % 3 = 1"), "parquet": d.where("c_custkey % 3 = 2")}
    for kind, part in parts.items():
        W.write_external(part, f"{path}.{kind}", kind)
    return reduce(DataFrame.unionByName, (R.read_external(t.spark, f"{path}.{kind}") for kind in parts))


@query("external_refresh", "SELECT count(*) AS n FROM nation UNION ALL SELECT 2 * count(*) FROM nation")
def external_refresh(t: Tables) -> DataFrame:
    """Files that others add to an external table are seen after a refresh."""
    path = W.scratch(t.spark, "external")
    W.write_external(t.nation, path)
    table = t.spark.read.parquet(path)
    before = table.agg(F.count(F.lit(1)).alias("n")).collect()
    W.write_external(t.nation, path, mode="append")
    R.refresh(t.spark, path)
    return t.spark.createDataFrame(before, "n bigint").unionAll(t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")))


@query("pinned_table", "SELECT false AS before, true AS during, false AS after")
def pinned_table(t: Tables) -> DataFrame:
    d = t.nation
    seen = [R.is_pinned(d), R.is_pinned(d.persist()), R.is_pinned(d.unpersist())]
    return t.spark.createDataFrame([tuple(seen)], "before boolean, during boolean, after boolean")


@query("table_from_rdd", "SELECT n_nationkey * 2 AS twice, n_name FROM nation")
def table_from_rdd(t: Tables) -> DataFrame:
    return R.from_rdd(t.nation.rdd.map(lambda r: (r.n_nationkey * 2, r.n_name)), "twice int, n_name string")


@query("jdbc_table", "SELECT n_regionkey AS g, count(*)::INTEGER AS n FROM nation GROUP BY 1")
def jdbc_table(t: Tables) -> DataFrame:
    """A query of another database, the small one that comes with Spark; in the driver's memory, where no executor reaches it."""
    url, options = f"jdbc:derby:memory:t{uuid.uuid4().hex}", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    connection = R.jdbc_connection(t.spark, f"{url};create=true", **options)
    connection.createStatement().execute("CREATE TABLE x (k INT, g INT)")
    with tempfile.NamedTemporaryFile("w", suffix=".csv") as file:
        csv.writer(file, lineterminator="\n").writerows(t.nation.select("n_nationkey", "n_regionkey").toLocalIterator())
        file.flush()
        connection.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'X', '{file.name}', NULL, NULL, NULL, 0)")
    connection.close()
    out = R.jdbc_query_by_driver(t.spark, url, "SELECT g, count(*) AS n FROM x GROUP BY g", **options).toDF("g", "n")
    with suppress(Py4JJavaError):  # that is how this database reports that it is gone
        R.jdbc_connection(t.spark, f"{url};drop=true", **options)
    return out


@query("bucketed_index", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey BETWEEN 100 AND 220")
def bucketed_index(t: Tables) -> DataFrame:
    """Tables laid out by a key, as an index on it would be: they meet without a shuffle."""
    left, right = (f"millrace_{uuid.uuid4().hex}" for _ in range(2))
    W.bucketed_table(t.orders.select("o_orderkey"), left, ["o_orderkey"], 4)
    W.bucketed_table(t.lineitem.select("l_orderkey", "l_linenumber"), right, ["l_orderkey"], 4)
    joined = t.spark.table(left).join(t.spark.table(right), F.col("o_orderkey") == F.col("l_orderkey")).where("o_orderkey BETWEEN 100 AND 220").select("o_orderkey", "l_linenumber")
    out = materialized(joined)
    for name in (left, right):
        t.spark.sql(f"DROP TABLE {name}")
    return out


@query("row_counts", "SELECT 'read' AS stage, count(*) AS n FROM lineitem UNION ALL SELECT 'filtered', count(*) FROM lineitem WHERE l_quantity > 30 UNION ALL SELECT 'joined', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 30 AND o_orderstatus = 'F'")
def row_counts(t: Tables) -> DataFrame:
    """Rows that pass each step, counted while the query runs."""
    read, kept, joined = (Observation() for _ in range(3))
    n = F.count(F.lit(1)).alias("n")
    d = t.lineitem.observe(read, n).where("l_quantity > 30").observe(kept, n)
    d = d.join(t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).observe(joined, n)
    d.write.mode("overwrite").format("noop").save()
    return t.spark.createDataFrame([(name, o.get["n"]) for name, o in (("read", read), ("filtered", kept), ("joined", joined))], "stage string, n bigint")


@query("result_streaming", "SELECT (n - 1) // 1000 AS batch, count(*) AS n FROM (SELECT row_number() OVER () AS n FROM orders) GROUP BY 1")
def result_streaming(t: Tables) -> DataFrame:
    """A result that comes to the client in batches, a partition at a time."""
    return t.spark.createDataFrame([(i, len(b)) for i, b in enumerate(result_batches(t.orders.select("o_orderkey"), 1000))], "batch bigint, n bigint")


@query("explain_statement", "SELECT kind, true AS shows FROM (VALUES ('logical'), ('analyzed'), ('optimized'), ('executed')) v(kind)")
def explain_statement(t: Tables) -> DataFrame:
    """EXPLAIN of every kind names what it should."""
    text = "SELECT TOP 3 n_name FROM nation WHERE n_nationkey > 3"
    marks = {"logical": "Limit", "analyzed": "Filter", "optimized": "Relation", "executed": "FileScan"}
    plans = {kind: execute(t, f"EXPLAIN {kind.upper()} {text}").first()[0] for kind in marks}
    return t.spark.createDataFrame([(kind, mark in plans[kind]) for kind, mark in marks.items()], "kind string, shows boolean")


@query("session_property", "SELECT 'recursivequeryiterationlimit' AS property, '77' AS value")
def session_property(t: Tables) -> DataFrame:
    setting = "spark.sql.cteRecursionLevelLimit"
    before = t.spark.conf.get(setting)
    try:
        return t.spark.createDataFrame(execute(t, "SET SESSION PROPERTY recursiveQueryIterationLimit = 77").collect(), "property string, value string")
    finally:
        t.spark.conf.set(setting, before)


@query("signal_sqlstate", "SELECT true AS raised, true AS with_state, true AS with_text")
def signal_sqlstate(t: Tables) -> DataFrame:
    try:
        execute(t, "SIGNAL SQLSTATE '75001' ('too late')").collect()
        said = ""
    except PySparkException as e:
        said = str(e)
    return t.spark.createDataFrame([(bool(said), "75001" in said, "too late" in said)], "raised boolean, with_state boolean, with_text boolean")


@query("procedure_out", "SELECT 'out' AS what, count(*) AS n FROM nation UNION ALL SELECT 'first', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'second', count(*) FROM nation WHERE n_regionkey <> 1")
def procedure_out(t: Tables) -> DataFrame:
    """A procedure with an OUT parameter and two result sets."""
    procedures.create("SPLIT_NATIONS", lambda t, region, n: Called([t.nation.where(F.col("n_regionkey") == region), t.nation.where(F.col("n_regionkey") != region)], {"n": t.nation.count()}))
    done = call_statement(t, "CALL SPLIT_NATIONS(1, ?)")
    return t.spark.createDataFrame([("out", done.out["n"]), *((w, s.count()) for w, s in zip(("first", "second"), done.sets))], "what string, n bigint")


@query("statistics_sampled", "SELECT 'l_orderkey' AS column_name, true AS near UNION ALL SELECT 'l_quantity', true")
def statistics_sampled(t: Tables) -> DataFrame:
    """Statistics of a sample: whether the number of rows scaled up is near the true one."""
    n = t.lineitem.agg(F.count(F.lit(1))).scalar()
    d = execute(t, "CALL COLLECT_STATISTICS('lineitem', 20)").where("column_name IN ('l_orderkey', 'l_quantity')")
    return d.select("column_name", (F.abs(F.col("n_rows") - n) < 0.1 * n + 50).alias("near"))


@query("statistics_catalog", "SELECT count(*) AS n_rows FROM nation")
def statistics_catalog(t: Tables) -> DataFrame:
    """Statistics collected into the catalog, where the optimizer finds them."""
    name = f"millrace_{uuid.uuid4().hex}"
    t.nation.write.saveAsTable(name)
    St.analyze_table(t.spark, name, ["n_nationkey"])
    said = {r.col_name: r.data_type for r in t.spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.createDataFrame([(int(said["Statistics"].split(", ")[1].split()[0]),)], "n_rows bigint")


@query("kafka_record_format", "SELECT n_nationkey::VARCHAR AS key, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"region\":' || CASE WHEN n_regionkey = 0 THEN 'null' ELSE n_regionkey::VARCHAR END || '}' AS value FROM nation")
def kafka_record_format(t: Tables) -> DataFrame:
    """The records that EXPORT_KAFKA sends."""
    return W.kafka_records(t.nation.select("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(0)).alias("region")), "n_nationkey")


@query("kafka_records_read", "SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def kafka_records_read(t: Tables) -> DataFrame:
    """A table sent as records and read back from them."""
    d = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    return W.records_to_rows(W.kafka_records(d, "c_custkey"), d.schema)


@query("system_procedures", "SELECT 'property' AS what, '64' AS value UNION ALL SELECT 'tables', '2' UNION ALL SELECT 'level', 'ERROR' UNION ALL SELECT 'cached', 'false'")
def system_procedures(t: Tables) -> DataFrame:
    """Properties, statistics of several tables, the level of logging, caches."""
    name, before = "spark.sql.cteRecursionLevelLimit", t.spark.conf.get("spark.sql.cteRecursionLevelLimit")
    execute(t, f"CALL SYSCS_UTIL.SET_PROPERTY('{name}', '64')")
    found = execute(t, f"CALL SYSCS_UTIL.GET_PROPERTY('{name}')").first().value
    t.spark.conf.set(name, before)
    tables = execute(t, "CALL SYSCS_UTIL.COLLECT_SCHEMA_STATISTICS('nation,region')").select("table_name").distinct().count()
    level = execute(t, "CALL SYSCS_UTIL.SET_LOGGER_LEVEL('ERROR')").first().level
    d = t.nation.persist()
    execute(t, "CALL SYSCS_UTIL.EMPTY_CACHES()")
    return t.spark.createDataFrame([("property", found), ("tables", str(tables)), ("level", level), ("cached", str(R.is_pinned(d)).lower())], "what string, value string")


@query("transition_tables", "SELECT 'old' AS side, n_nationkey, n_name FROM nation WHERE n_regionkey = 2 OR n_nationkey = 0 UNION ALL SELECT 'new', n_nationkey, upper(n_name || '!') FROM nation WHERE n_regionkey = 2")
def transition_tables(t: Tables) -> DataFrame:
    """Old and new rows of the changes since a version."""
    table = ChangeableTable.create(t.spark, W.scratch(t.spark, "table"), t.nation.select("n_nationkey", "n_name", "n_regionkey").schema, ["n_nationkey"])
    at = table.insert(t.nation)
    table.update(F.col("n_regionkey") == 2, n_name=F.upper(F.concat("n_name", F.lit("!"))))
    table.delete(F.col("n_nationkey") == 0)
    sides = [d.select(F.lit(side).alias("side"), "n_nationkey", "n_name") for side, d in zip(("old", "new"), table.changes(at))]
    return sides[0].unionAll(sides[1])


@query("iterator_in_chunks", "SELECT range AS k, 'x' || range AS v FROM range(2500)")
def iterator_in_chunks(t: Tables) -> DataFrame:
    """An iterator that the driver never holds whole."""
    before, R.CHUNK = R.CHUNK, 1000
    try:
        return R.from_rows(t.spark, ((i, f"x{i}") for i in range(2500)), "k bigint, v string")
    finally:
        R.CHUNK = before
