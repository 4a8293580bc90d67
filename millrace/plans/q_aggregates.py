"""Aggregation: scalar, grouped, distinct, rollup, cube, grouping sets, strings, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.functions import numbers as N
from millrace.functions import strings as S
from millrace.registry import Registry

registry = Registry()
query = registry.query


@query("agg_scalar", "SELECT count(*) AS n, sum(l_quantity) AS qty, round(avg(l_discount), 9) AS disc, min(l_shipdate) AS first, max(l_extendedprice) AS dearest FROM lineitem")
def agg_scalar(t: Tables) -> DataFrame:
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 9).alias("disc"), F.min("l_shipdate").alias("first"), F.max("l_extendedprice").alias("dearest")
    )


@query("agg_empty_input", "SELECT count(*) AS n, count(l_tax) AS taxed, sum(l_quantity) AS qty, avg(l_tax) AS tax, min(l_shipdate) AS first FROM lineitem WHERE l_quantity < 0")
def agg_empty_input(t: Tables) -> DataFrame:
    """One row even for no input."""
    d = t.lineitem.where("l_quantity < 0")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("taxed"), F.sum("l_quantity").alias("qty"), F.avg("l_tax").alias("tax"), F.min("l_shipdate").alias("first"))


@query("agg_grouped", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_extendedprice) AS low, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2")
def agg_grouped(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.min("l_extendedprice").alias("low"), F.max("l_shipdate").alias("last"))


@query("agg_expression_key", "SELECT year(o_orderdate)::INTEGER AS y, o_totalprice > 200000 AS dear, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_expression_key(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), (F.col("o_totalprice") > 200000).alias("dear")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_null_group", "SELECT lang, count(*) AS n, count(store_nbr) AS placed, count(DISTINCT store_nbr) AS stores FROM documents GROUP BY lang")
def agg_null_group(t: Tables) -> DataFrame:
    """Null is a group of its own."""
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("store_nbr").alias("placed"), F.count_distinct("store_nbr").alias("stores"))


@query("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, sum(DISTINCT year(o_orderdate))::BIGINT AS years FROM orders GROUP BY 1")
def agg_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.sum_distinct(F.year("o_orderdate")).alias("years"))


@query(
    "agg_multi_distinct",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_linenumber) AS lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1",
)
def agg_multi_distinct(t: Tables) -> DataFrame:
    """Several distinct aggregates beside a plain one: an Expand step."""
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_linenumber").alias("lines"), F.sum("l_quantity").alias("qty")
    )


@query("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 3 AND sum(o_totalprice) > 500000")
def agg_having(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    return d.where("n > 3 AND s > 500000").select("o_custkey", "n", F.round("s", 2).alias("total"))


@query(
    "agg_rollup",
    """SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::TINYINT AS g_flag, grouping(l_linestatus)::TINYINT AS g_status, count(*) AS n, sum(l_quantity) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def agg_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").alias("g_flag"), F.grouping("l_linestatus").alias("g_status"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("agg_cube", "SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS gid, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))


@query(
    "agg_grouping_sets",
    "SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority, year(o_orderdate)), ())",
)
def agg_grouping_sets(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"))
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority"), F.col("y")], []]
    return d.groupingSets(sets, "o_orderstatus", "o_orderpriority", "y").agg(F.count(F.lit(1)).alias("n"))


@query("agg_stddev", "SELECT l_returnflag, round(stddev_pop(l_quantity), 8) AS sp, round(stddev_samp(l_quantity), 8) AS ss, round(var_pop(l_discount), 10) AS vp, round(var_samp(l_discount), 10) AS vs FROM lineitem GROUP BY 1")
def agg_stddev(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.stddev_pop("l_quantity"), 8).alias("sp"), F.round(F.stddev_samp("l_quantity"), 8).alias("ss"), F.round(F.var_pop("l_discount"), 10).alias("vp"), F.round(F.var_samp("l_discount"), 10).alias("vs")
    )


@query("agg_string", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, string_agg(CASE WHEN n_nationkey < 0 THEN n_name END, ',') AS none FROM nation GROUP BY 1")
def agg_string(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(S.string_agg("n_name", "|").alias("names"), S.string_agg(F.when(F.col("n_nationkey") < 0, F.col("n_name"))).alias("none"))


@query("agg_sum_exact", "SELECT sum(x)::DECIMAL(38,0)::VARCHAR AS total FROM (SELECT 9223372036854775807::HUGEINT - l_linenumber AS x FROM lineitem)")
def agg_sum_exact(t: Tables) -> DataFrame:
    """A sum of 64-bit integers beyond their range, upgraded to a decimal."""
    d = t.lineitem.select((F.lit(9223372036854775807) - F.col("l_linenumber")).alias("x"))
    return d.agg(N.sum_exact("x").cast("string").alias("total"))


@query("agg_avg_decimal", "SELECT l_returnflag, round(sum(cast(l_extendedprice AS DECIMAL(15,2)))::DOUBLE / count(*), 4) AS mean FROM lineitem GROUP BY 1")
def agg_avg_decimal(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return d.select("l_returnflag", F.round(F.col("s").cast("double") / F.col("n"), 4).alias("mean"))


@query("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS dear, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 0), 2) AS urgent FROM orders GROUP BY 1")
def agg_filter(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(
        F.count(F.when(F.col("o_totalprice") > 200000, 1)).alias("dear"), F.round(F.coalesce(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))), F.lit(0.0)), 2).alias("urgent")
    )


@query("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 50000) AS every_, bool_or(o_orderstatus = 'F') AS some_ FROM orders GROUP BY 1")
def agg_bool(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.every(F.col("o_totalprice") > 50000).alias("every_"), F.some(F.col("o_orderstatus") == "F").alias("some_"))


@query("agg_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def agg_pivot(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    return d.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("agg_approx_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS within_error FROM lineitem GROUP BY 1")
def agg_approx_distinct(t: Tables) -> DataFrame:
    """Whether the approximation is within three times its stated standard error of the exact number."""
    d = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.count_distinct("l_partkey").alias("exact"))
    return d.select("l_returnflag", "exact", (F.abs(F.col("parts") - F.col("exact")) <= 0.06 * F.col("exact")).alias("within_error"))


@query("agg_skewed_two_phase", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def agg_skewed_two_phase(t: Tables) -> DataFrame:
    """A salted first phase for keys that hold most rows; built-in aggregates also combine before the shuffle by themselves."""
    salted = t.events.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(16))).groupBy("event_type", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return salted.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 4).alias("total"))
