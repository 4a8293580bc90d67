"""Window functions with row and range frames. Null order, frame and integer type are stated everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.registry import Registry

registry = Registry()
query = registry.query
FIRST, HERE, LAST = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing
SQL_ORDER = "PARTITION BY o_custkey ORDER BY o_orderdate ASC NULLS LAST, o_orderkey ASC NULLS LAST"


def by_customer() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey").asc_nulls_last())


ROWS_TO_HERE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("win_row_number", f"SELECT o_orderkey, row_number() OVER ({SQL_ORDER}) AS rn FROM orders")
def win_row_number(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.row_number().over(by_customer()).cast("bigint").alias("rn"))


@query(
    "win_rank_dense",
    """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC NULLS FIRST) AS r, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC NULLS FIRST) AS d FROM lineitem""",
)
def win_rank_dense(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc_nulls_first())
    return t.lineitem.select("l_orderkey", "l_linenumber", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d"))


_NULLED = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END"


@query(
    "win_first_last_ignore_nulls",
    f"""SELECT o_orderkey, first_value({_NULLED} IGNORE NULLS) OVER ({SQL_ORDER} {ROWS_TO_HERE}) AS first_known, last_value({_NULLED} IGNORE NULLS) OVER ({SQL_ORDER} {ROWS_TO_HERE}) AS last_known,
first_value({_NULLED}) OVER ({SQL_ORDER} {ROWS_TO_HERE}) AS first_any, last_value(o_orderkey) OVER ({SQL_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS final FROM orders""",
)
def win_first_last_ignore_nulls(t: Tables) -> DataFrame:
    price = F.expr(_NULLED)
    to_here, from_here = by_customer().rowsBetween(FIRST, HERE), by_customer().rowsBetween(HERE, LAST)
    return t.orders.select(
        "o_orderkey", F.first(price, ignorenulls=True).over(to_here).alias("first_known"), F.last(price, ignorenulls=True).over(to_here).alias("last_known"),
        F.first(price).over(to_here).alias("first_any"), F.last("o_orderkey").over(from_here).alias("final"),
    )


@query("win_lead_lag_default", f"SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER ({SQL_ORDER}) AS before_, lead(o_totalprice, 2) OVER ({SQL_ORDER}) AS after2, lead(o_totalprice, 2, 0.0::DOUBLE) OVER ({SQL_ORDER}) AS after2_or_0 FROM orders")
def win_lead_lag_default(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", F.lag("o_orderkey", 1, -1).over(by_customer()).alias("before_"), F.lead("o_totalprice", 2).over(by_customer()).alias("after2"), F.lead("o_totalprice", 2, 0.0).over(by_customer()).alias("after2_or_0")
    )


@query("win_rows_frame", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({SQL_ORDER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS near, count(*) OVER ({SQL_ORDER} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS later FROM orders")
def win_rows_frame(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(by_customer().rowsBetween(-2, 1)), 2).alias("near"), F.count(F.lit(1)).over(by_customer().rowsBetween(1, 3)).alias("later"))


@query(
    "win_range_frame",
    """SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate ASC NULLS LAST RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here FROM lineitem""",
)
def win_range_frame(t: Tables) -> DataFrame:
    """Peers, rows of one date, share a frame."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_shipdate").asc_nulls_last())
    return t.lineitem.select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w.rangeBetween(FIRST, HERE)).alias("so_far"), F.sum("l_quantity").over(w.rangeBetween(HERE, LAST)).alias("from_here"))


@query("win_range_offset", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM lineitem")
def win_range_offset(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity").rangeBetween(-5, 5)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("near"))


@query("win_running_sum", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({SQL_ORDER} {ROWS_TO_HERE}), 2) AS so_far, min(o_totalprice) OVER ({SQL_ORDER} {ROWS_TO_HERE}) AS low, max(o_totalprice) OVER ({SQL_ORDER} {ROWS_TO_HERE}) AS high FROM orders")
def win_running_sum(t: Tables) -> DataFrame:
    w = by_customer().rowsBetween(FIRST, HERE)
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("so_far"), F.min("o_totalprice").over(w).alias("low"), F.max("o_totalprice").over(w).alias("high"))


@query("win_moving_avg", f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({SQL_ORDER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS mean FROM orders")
def win_moving_avg(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(by_customer().rowsBetween(-3, HERE)), 4).alias("mean"))


@query("win_whole_partition", "SELECT s_suppkey, round(s_acctbal / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 8) AS share, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier")
def win_whole_partition(t: Tables) -> DataFrame:
    """Without an order the frame is the whole partition."""
    w = Window.partitionBy("s_nationkey")
    return t.supplier.select("s_suppkey", F.round(F.col("s_acctbal") / F.sum(F.abs("s_acctbal")).over(w), 8).alias("share"), F.count(F.lit(1)).over(w).alias("n"))


@query("win_string_agg", "SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS names FROM nation")
def win_string_agg(t: Tables) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(FIRST, HERE)
    return t.nation.select("n_nationkey", F.array_join(F.collect_list("n_name").over(w), ",").alias("names"))


@query(
    "win_ntile_percent",
    """SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)::INTEGER AS quarter, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 9) AS pr,
round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 9) AS cd, nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS second FROM customer""",
)
def win_ntile_percent(t: Tables) -> DataFrame:
    """An extension beyond the dialect's list of window functions."""
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return t.customer.select("c_custkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), F.nth_value("c_custkey", 2).over(w).alias("second"))


@query("win_over_aggregate", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS r, sum(count(*)) OVER (PARTITION BY o_orderstatus)::BIGINT AS total FROM orders GROUP BY 1, 2")
def win_over_aggregate(t: Tables) -> DataFrame:
    """Windows over grouped results."""
    d = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("o_orderstatus")
    return d.select("o_orderstatus", "o_orderpriority", "n", F.rank().over(w.orderBy(F.desc("n"))).cast("bigint").alias("r"), F.sum("n").over(w).alias("total"))


@query(
    "win_sessionize",
    """SELECT event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)""",
)
def win_sessionize(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    return t.events.withColumn("fresh", gap).select("event_id", F.sum("fresh").over(w.rowsBetween(FIRST, HERE)).alias("session"))
