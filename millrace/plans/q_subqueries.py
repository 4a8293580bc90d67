"""Sub-queries, quantified comparisons and the dialect's SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.catalog import Tables
from millrace.plans.sqlfront import run_sql
from millrace.registry import Registry

registry = Registry()
query = registry.query


@query("sub_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)")
def sub_scalar(t: Tables) -> DataFrame:
    return t.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM {orders})", "orders")


_CORRELATED = "SELECT o_orderkey FROM {orders} o WHERE o_totalprice >= (SELECT max(x.o_totalprice) FROM {orders} x WHERE x.o_custkey = o.o_custkey)"


@query("sub_correlated_scalar", _CORRELATED.format(orders="orders"))
def sub_correlated_scalar(t: Tables) -> DataFrame:
    return t.sql(_CORRELATED, "orders")


_SELECT_LIST = "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer}"


@query("sub_in_select_list", _SELECT_LIST.format(orders="orders", customer="customer"))
def sub_in_select_list(t: Tables) -> DataFrame:
    return t.sql(_SELECT_LIST, "orders", "customer")


_IN = "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity = 50)"


@query("sub_in", _IN.format(part="part", lineitem="lineitem"))
def sub_in(t: Tables) -> DataFrame:
    return t.sql(_IN, "part", "lineitem")


_NOT_IN = "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT nullif(c_nationkey, 3) FROM {customer} WHERE c_acctbal > 9900)"


@query("sub_not_in_nulls", _NOT_IN.format(supplier="supplier", customer="customer"))
def sub_not_in_nulls(t: Tables) -> DataFrame:
    """NOT IN is null-aware: a null in the list leaves nothing."""
    return t.sql(_NOT_IN, "supplier", "customer")


_EXISTS = "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_discount = 0.1) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"


@query("sub_exists", _EXISTS.format(customer="customer", orders="orders", lineitem="lineitem"))
def sub_exists(t: Tables) -> DataFrame:
    return t.sql(_EXISTS, "customer", "orders", "lineitem")


@query("sub_any", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT min(c_acctbal) FROM customer WHERE c_nationkey = s_nationkey)")
def sub_any(t: Tables) -> DataFrame:
    """> ANY, rewritten to EXISTS."""
    return run_sql(t, "SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = s_nationkey)")


@query("sub_all", "SELECT p_partkey FROM part WHERE p_retailprice >= (SELECT max(p_retailprice) FROM part)")
def sub_all(t: Tables) -> DataFrame:
    """>= ALL, rewritten to NOT EXISTS."""
    return run_sql(t, "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part)")


@query("sub_equal_any", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AND n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def sub_equal_any(t: Tables) -> DataFrame:
    return run_sql(t, "SELECT n_name FROM nation WHERE n_nationkey = SOME (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AND n_regionkey <> ALL (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")


@query("dialect_fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 2")
def dialect_fetch_first(t: Tables) -> DataFrame:
    return run_sql(t, "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 2 ROWS FETCH NEXT 5 ROWS ONLY")


@query("dialect_top", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3")
def dialect_top(t: Tables) -> DataFrame:
    return run_sql(t, "SELECT TOP 3 o_orderkey FROM orders ORDER BY o_orderkey DESC")


@query("dialect_escapes", "SELECT event_id, ts + INTERVAL 3 MONTH AS later, upper(event_type) AS kind FROM events ORDER BY event_id LIMIT 10")
def dialect_escapes(t: Tables) -> DataFrame:
    return run_sql(t, "SELECT event_id, {fn TIMESTAMPADD(SQL_TSI_MONTH, 3, ts)} AS later, {fn UCASE(event_type)} AS kind FROM events ORDER BY event_id {limit 10}")


@query("dialect_time_span", "SELECT o_orderkey, o_orderdate::DATE + 3 AS d3, (o_orderdate::DATE - INTERVAL 2 MONTH)::DATE AS m2, (o_orderdate::DATE + INTERVAL 1 YEAR)::DATE AS y1 FROM orders")
def dialect_time_span(t: Tables) -> DataFrame:
    return run_sql(t, "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 3 DAYS AS d3, CAST(o_orderdate AS DATE) - 2 MONTHS AS m2, CAST(o_orderdate AS DATE) + 1 YEAR AS y1 FROM orders")


@query("dialect_sysdummy", "SELECT 42 AS answer, 'it''s -- {fn x}' AS text")
def dialect_sysdummy(t: Tables) -> DataFrame:
    """Quoted text stays as it is."""
    return run_sql(t, "SELECT 42 AS answer, 'it''s -- {fn x}' AS text FROM SYSIBM.SYSDUMMY1")


@query("dialect_hints", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 450000")
def dialect_hints(t: Tables) -> DataFrame:
    return run_sql(t, "SELECT c_name, o_orderkey FROM customer --x-properties joinStrategy=SORTMERGE, useSpark=true\nJOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 450000")
