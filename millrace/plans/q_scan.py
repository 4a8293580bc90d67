"""Scans, projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.functions import numbers as N
from millrace.registry import Registry

registry = Registry()
query = registry.query


@query("scan_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def scan_project(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("scan_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def scan_distinct(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("scan_multi_probe", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 7, 32, 1000, 5000, 999999999)")
def scan_multi_probe(t: Tables) -> DataFrame:
    """IN list on a key: pushed to the scan as one In filter."""
    return t.orders.where(F.col("o_orderkey").isin(1, 7, 32, 1000, 5000, 999999999)).select("o_orderkey", "o_custkey")


@query("scan_sysdummy", "SELECT 1 AS one")
def scan_sysdummy(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).alias("one"))


@query("scan_natural_numbers", "SELECT n FROM range(1, 2049) r(n)")
def scan_natural_numbers(t: Tables) -> DataFrame:
    return t.spark.range(1, 2049).withColumnRenamed("id", "n")


@query("scan_empty", "SELECT o_orderkey, o_totalprice FROM orders WHERE 1 = 0")
def scan_empty(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").limit(0)


@query("values_rows", "SELECT * FROM (VALUES (1, 'a', NULL), (2, NULL, 2.5::DOUBLE), (3, 'c', -1.0::DOUBLE)) v(id, name, x)")
def values_rows(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "a", None), (2, None, 2.5), (3, "c", -1.0)], "id int, name string, x double")


@query("sample_scan", "SELECT true AS about_a_tenth, true AS all_known")
def sample_scan(t: Tables) -> DataFrame:
    """A sampling operator: a tenth of the rows, by a fixed seed; whether they are that many, and rows of the table."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]
    some = t.lineitem.sample(0.1, 42).select(*keys)
    n, unknown = t.lineitem.agg(F.count(F.lit(1))).scalar(), some.join(t.lineitem.select(*keys), keys, "left_anti").agg(F.count(F.lit(1))).scalar()
    return some.agg(F.count(F.lit(1)).alias("k")).select((F.abs(F.col("k") - 0.1 * n) <= 5 * F.sqrt(0.09 * n)).alias("about_a_tenth"), (unknown == 0).alias("all_known"))


@query("filter_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 30 AND l_discount <> 0.05 AND l_tax < 0.06 AND l_extendedprice > 20000")
def filter_compare(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.where((c("l_quantity") >= 30) & (c("l_discount") != 0.05) & (c("l_tax") < 0.06) & (c("l_extendedprice") > 20000)).select("l_orderkey", "l_linenumber")


@query(
    "filter_between",
    "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' AND o_totalprice NOT BETWEEN 100000 AND 300000",
)
def filter_between(t: Tables) -> DataFrame:
    date = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.orders.where(F.col("o_orderdate").between(date("1995-01-01"), date("1995-12-31")) & ~F.col("o_totalprice").between(100000, 300000)).select("o_orderkey")


@query("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def filter_in_list(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@query("filter_tuple_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O')) AND l_linenumber = 1")
def filter_tuple_in(t: Tables) -> DataFrame:
    return t.sql(
        "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O')) AND l_linenumber = 1", "lineitem"
    )


@query("filter_tuple_equal", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) = ('F', '1-URGENT')")
def filter_tuple_equal(t: Tables) -> DataFrame:
    return t.orders.where(F.struct("o_orderstatus", "o_orderpriority") == F.struct(F.lit("F"), F.lit("1-URGENT"))).select("o_orderkey")


@query("filter_like_escape", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%r_ng%' OR p_name LIKE 'red!_%' ESCAPE '!' OR p_brand NOT LIKE 'Brand#1%'")
def filter_like_escape(t: Tables) -> DataFrame:
    return t.sql("SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%r_ng%' OR p_name LIKE 'red!_%' ESCAPE '!' OR p_brand NOT LIKE 'Brand#1%'", "part")


_LOGIC = """SELECT a, b, a AND b AS and_, a OR b AS or_, NOT a AS not_, a IS TRUE AS is_true, a IS NOT TRUE AS is_not_true, a IS FALSE AS is_false,
(a AND b) IS NULL AS is_unknown, a IS NOT DISTINCT FROM b AS same
FROM (VALUES (true), (false), (cast(NULL AS boolean))) x(a) CROSS JOIN (VALUES (true), (false), (cast(NULL AS boolean))) y(b)"""


@query("filter_null_logic", _LOGIC)
def filter_null_logic(t: Tables) -> DataFrame:
    """Three-valued logic over all nine pairs of constants."""
    return t.spark.sql(_LOGIC)


@query("filter_is_null", "SELECT doc_id, lang IS NULL AS no_lang, store_nbr IS NOT NULL AS has_store FROM documents WHERE text IS NULL OR lang IS NULL")
def filter_is_null(t: Tables) -> DataFrame:
    d = t.documents.where(F.col("text").isNull() | F.col("lang").isNull())
    return d.select("doc_id", F.col("lang").isNull().alias("no_lang"), F.col("store_nbr").isNotNull().alias("has_store"))


@query(
    "case_expr",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
)
def case_expr(t: Tables) -> DataFrame:
    band = F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low")
    return t.orders.select("o_orderkey", band.alias("band"), F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END").alias("code"))


@query(
    "cast_matrix",
    """SELECT l_orderkey, l_linenumber, cast(l_quantity AS INTEGER) AS q_int, cast(l_linenumber AS SMALLINT) AS ln_small, cast(l_orderkey AS VARCHAR) AS key_text,
cast(l_shipdate AS DATE) AS ship_date, cast(cast(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE) AS price, cast('17' AS INTEGER) AS seventeen, try_cast('x' AS INTEGER) AS none FROM lineitem""",
)
def cast_matrix(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", c("l_quantity").cast("int").alias("q_int"), c("l_linenumber").cast("smallint").alias("ln_small"), c("l_orderkey").cast("string").alias("key_text"),
        c("l_shipdate").cast("date").alias("ship_date"), c("l_extendedprice").cast("decimal(15,2)").cast("double").alias("price"), F.lit("17").cast("int").alias("seventeen"), F.lit("x").try_cast("int").alias("none"),
    )


@query("coalesce_nullif", "SELECT doc_id, coalesce(lang, source, '?') AS label, nullif(source, 'faq') AS other, coalesce(store_nbr, -1)::INTEGER AS store FROM documents")
def coalesce_nullif(t: Tables) -> DataFrame:
    d = t.documents
    return d.select("doc_id", F.coalesce("lang", "source", F.lit("?")).alias("label"), F.nullif("source", F.lit("faq")).alias("other"), F.coalesce("store_nbr", F.lit(-1)).cast("int").alias("store"))


@query(
    "least_greatest",
    """SELECT c_custkey, least(c_acctbal, 500.0::DOUBLE) AS low, greatest(c_acctbal, 500.0::DOUBLE) AS high,
CASE WHEN nullif(c_nationkey, 3) IS NULL THEN NULL ELSE least(c_nationkey, 5) END AS strict_min FROM customer""",
)
def least_greatest(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", F.least("c_acctbal", F.lit(500.0)).alias("low"), F.greatest("c_acctbal", F.lit(500.0)).alias("high"), N.scalar_min(F.nullif("c_nationkey", F.lit(3)), F.lit(5)).alias("strict_min")
    )


@query(
    "arithmetic",
    """SELECT l_orderkey, l_linenumber, -l_quantity AS neg, abs(-l_quantity) AS pos, l_orderkey % 7 AS rest, l_extendedprice / l_quantity AS unit,
l_orderkey // 10 AS tens, round(sqrt(l_quantity), 9) AS root, (cast(l_quantity AS DECIMAL(15,2)) * cast(l_tax AS DECIMAL(15,2)))::DECIMAL(31,6)::DOUBLE AS product FROM lineitem""",
)
def arithmetic(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", (-c("l_quantity")).alias("neg"), F.abs(-c("l_quantity")).alias("pos"), (c("l_orderkey") % 7).alias("rest"), (c("l_extendedprice") / c("l_quantity")).alias("unit"),
        N.int_divide("l_orderkey", F.lit(10)).alias("tens"), F.round(F.sqrt("l_quantity"), 9).alias("root"), N.multiply_alt(c("l_quantity").cast("decimal(15,2)"), c("l_tax").cast("decimal(15,2)")).cast("double").alias("product"),
    )


@query("concat_pipe", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label, c_name || NULL AS none FROM customer")
def concat_pipe(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.concat("c_name", F.lit("/"), "c_mktsegment").alias("label"), F.concat("c_name", F.lit(None).cast("string")).alias("none"))


@query("parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'P'")
def parameters(t: Tables) -> DataFrame:
    """Statement parameters, bound by name."""
    return t.spark.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 250000, "status": "P"}, orders=t.orders)
