"""Sort, limit, top-k, set operations and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.registry import Registry

registry = Registry()
query = registry.query


@query("sort_null_order", "SELECT doc_id, lang, store_nbr FROM documents ORDER BY store_nbr DESC NULLS FIRST, lang ASC NULLS LAST, doc_id")
def sort_null_order(t: Tables) -> DataFrame:
    """Nulls are high: last when ascending, first when descending."""
    return t.documents.select("doc_id", "lang", "store_nbr").orderBy(F.col("store_nbr").desc_nulls_first(), F.col("lang").asc_nulls_last(), "doc_id")


@query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def limit_offset(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10)


@query("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk(t: Tables) -> DataFrame:
    """Sort and limit become one TakeOrderedAndProject: no global sort."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@query("distinct_sort", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY 1, 2")
def distinct_sort(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct().orderBy("o_orderstatus", "o_orderpriority")


@query("topk_per_group", "SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def topk_per_group(t: Tables) -> DataFrame:
    """The limit reaches the map side (WindowGroupLimit), so that a hot group sends three rows per task."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 3").select("c_nationkey", "c_custkey", "rn")


@query("range_partition_sort", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def range_partition_sort(t: Tables) -> DataFrame:
    """Range partitions, each sorted: the total order of a bulk load, without one final task."""
    return t.orders.select("o_orderkey", "o_orderdate").repartitionByRange("o_orderdate", "o_orderkey").sortWithinPartitions("o_orderdate", "o_orderkey")


_A, _B = "SELECT c_nationkey AS k FROM {c} WHERE c_acctbal > 0", "SELECT s_nationkey AS k FROM {s}"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))


def _sql(op: str) -> str:
    return f"{_A} {op} {_B}".format(c="customer", s="supplier")


@query("union_all", _sql("UNION ALL"))
def union_all(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.unionAll(b)


@query("union_distinct", _sql("UNION"))
def union_distinct(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.union(b).distinct()


@query("intersect", _sql("INTERSECT"))
def intersect(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.intersect(b)


@query("intersect_all", _sql("INTERSECT ALL"))
def intersect_all(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.intersectAll(b)


@query("except", "SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation")
def except_(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_size").alias("k")).subtract(t.nation.select("n_nationkey"))


@query("except_all", _sql("EXCEPT ALL"))
def except_all(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.exceptAll(b)


@query("setop_nulls", "SELECT lang FROM documents WHERE store_nbr IS NULL INTERSECT SELECT lang FROM documents WHERE text IS NULL")
def setop_nulls(t: Tables) -> DataFrame:
    """In set operations nulls match each other."""
    return t.documents.where("store_nbr IS NULL").select("lang").intersect(t.documents.where("text IS NULL").select("lang"))


_PRECEDENCE = "SELECT 1 AS x UNION SELECT n_nationkey FROM {n} INTERSECT SELECT s_nationkey FROM {s} EXCEPT SELECT r_regionkey FROM {r}"


@query("setop_precedence", _PRECEDENCE.format(n="nation", s="supplier", r="region"))
def setop_precedence(t: Tables) -> DataFrame:
    """INTERSECT binds closer than UNION and EXCEPT."""
    return t.spark.sql(_PRECEDENCE, n=t.nation, s=t.supplier, r=t.region)


_VALUES = "SELECT * FROM (VALUES (1), (2), (2), (NULL)) a(x) EXCEPT SELECT * FROM (VALUES (2), (3)) b(x)"


@query("setop_values", _VALUES)
def setop_values(t: Tables) -> DataFrame:
    return t.spark.sql(_VALUES)


_ORDER = "SELECT r_regionkey AS k, r_name AS name FROM {r} UNION ALL SELECT n_nationkey, n_name FROM {n} ORDER BY 2 DESC, k LIMIT 8"


@query("setop_order_ordinal", _ORDER.format(r="region", n="nation"))
def setop_order_ordinal(t: Tables) -> DataFrame:
    return t.spark.sql(_ORDER, r=t.region, n=t.nation)


_TREE = """WITH RECURSIVE tree(id, parent, depth) AS (
SELECT n_nationkey, cast(NULL AS integer), 0 FROM {n} WHERE n_nationkey = 0
UNION ALL SELECT n_nationkey, tree.id, tree.depth + 1 FROM tree JOIN {n} ON (n_nationkey - 1) {div} 2 = tree.id AND n_nationkey > 0)
SELECT id, parent, depth FROM tree"""


@query("recursive_cte", _TREE.format(n="nation", div="//"))
def recursive_cte(t: Tables) -> DataFrame:
    """A tree of the nations' numbers, a level per step."""
    return t.spark.sql(_TREE.replace("{div}", "div"), n=t.nation)


_SERIES = "WITH RECURSIVE s(n, f) AS (SELECT 1, cast(1 AS bigint) UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 15) SELECT n, f FROM s"


@query("recursive_series", _SERIES)
def recursive_series(t: Tables) -> DataFrame:
    return t.spark.sql(_SERIES)
