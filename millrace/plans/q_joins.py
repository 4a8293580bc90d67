"""Joins of every kind, by column, by predicate and by strategy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.operators.joins import bounded_broadcast, cogroup, cogroup_counts, nearest_before, range_join
from millrace.plans.sqlfront import run_sql
from millrace.registry import Registry

registry = Registry()
query = registry.query


@query("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(t: Tables) -> DataFrame:
    c = t.customer.where("c_mktsegment = 'BUILDING'")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("join_inner_residual", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice > 0.4 * o_totalprice")
def join_inner_residual(t: Tables) -> DataFrame:
    """Equal keys and a further restriction on matched pairs."""
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_extendedprice") > 0.4 * F.col("o_totalprice"))
    return t.lineitem.join(t.orders, on).select("l_orderkey", "l_linenumber")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def join_left(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderstatus = 'F'")
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000")
def join_right(t: Tables) -> DataFrame:
    o = t.orders.where("o_totalprice > 400000")
    return o.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query(
    "join_full",
    "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON s_suppkey = c_custkey",
)
def join_full(t: Tables) -> DataFrame:
    s, c = t.supplier.where("s_acctbal > 0"), t.customer.where("c_acctbal > 5000")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey"), "full").select("s_suppkey", "c_custkey")


@query("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi_exists(t: Tables) -> DataFrame:
    o = t.orders.where("o_totalprice > 300000")
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti_not_exists(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    """The cross join operator itself, on two tables of fixed size."""
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query(
    "join_theta_range",
    """SELECT p_partkey, band FROM part JOIN (VALUES ('cheap', 0.0::DOUBLE, 950.0::DOUBLE), ('fair', 940.0::DOUBLE, 1000.0::DOUBLE), ('dear', 1000.0::DOUBLE, 1e9::DOUBLE)) b(band, low, high)
ON p_retailprice >= low AND p_retailprice < high""",
)
def join_theta_range(t: Tables) -> DataFrame:
    """A predicate without equality against a table of three rows: a broadcast nested loop."""
    bands = t.spark.createDataFrame([("cheap", 0.0, 950.0), ("fair", 940.0, 1000.0), ("dear", 1000.0, 1e9)], "band string, low double, high double")
    on = (F.col("p_retailprice") >= F.col("low")) & (F.col("p_retailprice") < F.col("high"))
    return t.part.join(F.broadcast(bands), on).select("p_partkey", "band")


@query(
    "join_range_bucketed",
    """SELECT a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b ON a.event_type = 'error' AND b.event_type = 'click'
AND b.ts >= a.ts - INTERVAL 10 MINUTE AND b.ts <= a.ts AND a.user_id = b.user_id""",
)
def join_range_bucketed(t: Tables) -> DataFrame:
    """Interval condition turned into an equality on time buckets, so that both sides are shuffled and neither is copied."""
    e = t.events
    left = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("until"), (F.col("ts") - F.expr("INTERVAL 10 MINUTES")).alias("since"))
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts")
    return range_join(left, right, keys=["user_id"], low="since", high="until", point="ts", width_s=600).select("error_id", "click_id")


@query(
    "join_as_of",
    """SELECT c.event_id, e.event_id AS last_error FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id, ts) e ON c.user_id = e.user_id AND c.ts >= e.ts""",
)
def join_as_of(t: Tables) -> DataFrame:
    """The latest error at or before each click of the same user (an extension: Spark and the reference lack it)."""
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    errors = t.events.where("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_error"))
    return nearest_before(clicks, errors, keys=["user_id"], at="ts", values=["last_error"]).select("event_id", "last_error")


@query("join_natural_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def join_natural_using(t: Tables) -> DataFrame:
    return t.nation.withColumnRenamed("n_regionkey", "k").join(t.region.withColumnRenamed("r_regionkey", "k"), ["k"]).select("k", "n_name", "r_name")


@query("join_self", "SELECT a.s_suppkey AS first, b.s_suppkey AS second FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    return a.join(b, F.expr("a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")).select(F.col("a.s_suppkey").alias("first"), F.col("b.s_suppkey").alias("second"))


_IN_ON = "SELECT c_custkey, o_orderkey FROM {c} LEFT JOIN {o} ON c_custkey = o_custkey AND o_orderkey IN (SELECT l_orderkey FROM {l} WHERE l_quantity >= 50)"


@query("join_subquery_in_on", _IN_ON.format(c="customer", o="orders", l="lineitem"))
def join_subquery_in_on(t: Tables) -> DataFrame:
    return t.spark.sql(_IN_ON, c=t.customer, o=t.orders, l=t.lineitem)


@query("join_not_exists_on", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join_not_exists_on(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'")
    o = t.orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return o.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


_NATIONS = "(SELECT n_nationkey AS a, n_regionkey AS ra FROM nation WHERE n_nationkey < 20) AS x"
_SUPPLIERS = "(SELECT s_suppkey AS s, s_nationkey AS b FROM supplier WHERE s_nationkey > 3) AS y"
_NULLABLE = "(SELECT CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey END FROM region)"


def _on(kind: str, flags: str, condition: str) -> str:
    """The twin of a join with a sub-query in ON: the sub-query's answer is a column of the side that it refers to."""
    x, y = _NATIONS.replace(" AS x", ""), _SUPPLIERS.replace(" AS y", "")
    return f"SELECT a, ra, s, b FROM (SELECT *, {flags.split('|')[0]} FROM {x}) x {kind} JOIN (SELECT *, {flags.split('|')[1]} FROM {y}) y ON a = b AND {condition}"


def _on_query(t: Tables, kind: str, condition: str) -> DataFrame:
    return run_sql(t, f"SELECT a, ra, s, b FROM {_NATIONS} {kind} JOIN {_SUPPLIERS} ON a = b AND {condition}")


@query("join_on_in_right", _on("RIGHT", "true AS f|b IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AS g", "g"))
def join_on_in_right(t: Tables) -> DataFrame:
    """IN in the ON of a RIGHT join, about the side that is kept: rows for which it fails stay, without a partner."""
    return _on_query(t, "RIGHT", "b IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")


@query("join_on_exists_full", _on("FULL", "EXISTS (SELECT 1 FROM region WHERE r_regionkey = ra AND r_regionkey > 1) AS f|true AS g", "f"))
def join_on_exists_full(t: Tables) -> DataFrame:
    return _on_query(t, "FULL", "EXISTS (SELECT 1 FROM region WHERE r_regionkey = ra AND r_regionkey > 1)")


@query("join_on_not_in", _on("FULL", f"coalesce(ra NOT IN {_NULLABLE}, false) AS f|coalesce(b NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 9), false) AS g", "f AND g"))
def join_on_not_in(t: Tables) -> DataFrame:
    """NOT IN over values with a null is never true, in the ON of a FULL join too."""
    return _on_query(t, "FULL", f"ra NOT IN {_NULLABLE} AND b NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 9)")


@query("join_on_not_in_left", _on("LEFT", "true AS f|coalesce(b NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 9), false) AS g", "g"))
def join_on_not_in_left(t: Tables) -> DataFrame:
    return _on_query(t, "LEFT OUTER", "b NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 9)")


@query("join_on_any", _on("LEFT", "a < (SELECT max(r_regionkey) * 3 FROM region) AS f|true AS g", "f"))
def join_on_any(t: Tables) -> DataFrame:
    return _on_query(t, "LEFT", "a < ANY (SELECT r_regionkey * 3 FROM region)")


@query("join_on_all", _on("RIGHT", "true AS f|b > (SELECT max(r_regionkey) FROM region) AS g", "g"))
def join_on_all(t: Tables) -> DataFrame:
    return _on_query(t, "RIGHT", "b > ALL (SELECT r_regionkey FROM region)")


@query("join_anti_nested_loop", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM region WHERE s_nationkey BETWEEN r_regionkey * 6 AND r_regionkey * 6 + 2)")
def join_anti_nested_loop(t: Tables) -> DataFrame:
    """An anti join without an equality: against a table of checked size."""
    return t.supplier.join(bounded_broadcast(t.region), F.expr("s_nationkey BETWEEN r_regionkey * 6 AND r_regionkey * 6 + 2"), "left_anti").select("s_suppkey")


_ONE_ROW = "SELECT o_orderkey, (SELECT c_name FROM {c} WHERE c_custkey = o_custkey) AS name, (SELECT max(r_name) FROM {r}) AS last_region FROM {o}"


@query("join_one_row", _ONE_ROW.format(c="customer", o="orders", r="region"))
def join_one_row(t: Tables) -> DataFrame:
    """A join with the one row at most that a sub-query gives; two rows are an error."""
    return t.spark.sql(_ONE_ROW, c=t.customer, o=t.orders, r=t.region)


_BOTH_SIDES = "SELECT c_custkey, o_orderkey FROM {c} JOIN {o} ON c_custkey = o_custkey AND EXISTS (SELECT 1 FROM {n} WHERE n_nationkey = c_nationkey AND n_regionkey < o_totalprice / 100000)"


@query("join_on_exists_both_sides", _BOTH_SIDES.format(c="customer", o="orders", n="nation"))
def join_on_exists_both_sides(t: Tables) -> DataFrame:
    """A sub-query in the ON of an inner join that refers to both sides: run_sql makes it a condition of WHERE."""
    return run_sql(t, _BOTH_SIDES.format(c="customer", o="orders", n="nation"))


@query("join_cogroup_frames", "SELECT coalesce(s_nationkey, c_nationkey) AS nationkey, coalesce(s.best, -1.0) AS best_supplier, coalesce(c.best, -1.0) AS best_customer FROM (SELECT s_nationkey, max(s_acctbal) AS best FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey, max(c_acctbal) AS best FROM customer GROUP BY 1) c ON s_nationkey = c_nationkey")
def join_cogroup_frames(t: Tables) -> DataFrame:
    """Any function of the two groups of a key; both sides are combined per key before they meet."""
    best = lambda df, p: df.groupBy(F.col(f"{p}_nationkey").alias("nationkey")).agg(F.max(f"{p}_acctbal").alias("best"))
    one = lambda f: float(f["best"].iloc[0]) if len(f) else -1.0

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        key = (a if len(a) else b)["nationkey"].iloc[0]
        return pd.DataFrame({"nationkey": [key], "best_supplier": [one(a)], "best_customer": [one(b)]})

    return cogroup(best(t.supplier, "s"), best(t.customer, "c"), ["nationkey"], both, "nationkey int, best_supplier double, best_customer double")


@query("join_broadcast_hint", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_broadcast_hint(t: Tables) -> DataFrame:
    """A build side is only broadcast if its files are small enough; see bounded_broadcast."""
    return t.supplier.join(bounded_broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("join_merge_hint", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_merge_hint(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("join_shuffle_hash_hint", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_shuffle_hash_hint(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("join_nested_loop", "SELECT n_name, count(*) AS n FROM nation JOIN supplier ON n_nationkey <> s_nationkey AND s_acctbal < n_nationkey * 100 GROUP BY n_name")
def join_nested_loop(t: Tables) -> DataFrame:
    on = (F.col("n_nationkey") != F.col("s_nationkey")) & (F.col("s_acctbal") < F.col("n_nationkey") * 100)
    return t.supplier.join(F.broadcast(t.nation), on).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))  # nation has 25 rows


@query("join_outer_nested_loop", "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey > r_regionkey AND n_nationkey < 5")
def join_outer_nested_loop(t: Tables) -> DataFrame:
    return t.region.join(F.broadcast(t.nation), F.expr("n_regionkey > r_regionkey AND n_nationkey < 5"), "left").select("r_name", "n_name")


_LATERAL = "SELECT c_custkey, o_orderkey FROM {c} JOIN LATERAL (SELECT o_orderkey FROM {o} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) x ON true"


@query("join_lateral", _LATERAL.format(c="customer", o="orders"))
def join_lateral(t: Tables) -> DataFrame:
    return t.spark.sql(_LATERAL.replace("ON true", ""), c=t.customer, o=t.orders)


@query(
    "join_cogroup",
    """SELECT coalesce(a.k, b.k) AS nationkey, coalesce(a.n, 0) AS n_suppliers, coalesce(b.n, 0) AS n_customers
FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k""",
)
def join_cogroup(t: Tables) -> DataFrame:
    return cogroup_counts(t.supplier, "s_nationkey", t.customer, "c_nationkey", "nationkey", "n_suppliers", "n_customers")


@query("join_subtract_by_key", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def join_subtract_by_key(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query(
    "join_multiway",
    """SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def join_multiway(t: Tables) -> DataFrame:
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    )
