"""TPC-H-shaped queries over the columns that the test tables have."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.registry import Registry

registry = Registry()
query = registry.query
c = F.col


def volume() -> F.Column:
    return c("l_extendedprice") * (1 - c("l_discount"))


def ts(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


@query(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
def tpch_q1(t: Tables) -> DataFrame:
    return (
        t.lineitem.where(c("l_shipdate") <= ts("1998-09-02"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(volume()), 2).alias("sum_disc_price"),
            F.round(F.sum(volume() * (1 + c("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
            F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy(c("l_returnflag").asc_nulls_last(), c("l_linestatus").asc_nulls_last())
    )


@query(
    "tpch_q3",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
def tpch_q3(t: Tables) -> DataFrame:
    o = t.orders.where(c("o_orderdate") < ts("1995-03-15")).join(t.customer.where("c_mktsegment = 'BUILDING'"), c("o_custkey") == c("c_custkey"))
    d = t.lineitem.where(c("l_shipdate") > ts("1995-03-15")).join(o, c("l_orderkey") == c("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(volume()), 2).alias("revenue"))
    return d.orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query(
    "tpch_q5",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""",
)
def tpch_q5(t: Tables) -> DataFrame:
    n = t.nation.join(t.region.where("r_name = 'ASIA'"), c("n_regionkey") == c("r_regionkey"))
    o = t.orders.where((c("o_orderdate") >= ts("1994-01-01")) & (c("o_orderdate") < ts("1997-01-01"))).join(t.customer, c("o_custkey") == c("c_custkey"))
    d = t.lineitem.join(o, c("l_orderkey") == c("o_orderkey")).join(t.supplier, (c("l_suppkey") == c("s_suppkey")) & (c("c_nationkey") == c("s_nationkey"))).join(n, c("s_nationkey") == c("n_nationkey"))
    return d.groupBy("n_name").agg(F.round(F.sum(volume()), 2).alias("revenue"))


@query(
    "tpch_q6",
    "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
)
def tpch_q6(t: Tables) -> DataFrame:
    d = t.lineitem.where((c("l_shipdate") >= ts("1994-01-01")) & (c("l_shipdate") < ts("1995-01-01")) & c("l_discount").between(0.05, 0.07) & (c("l_quantity") < 24))
    return d.agg(F.round(F.sum(c("l_extendedprice") * c("l_discount")), 2).alias("revenue"))


@query(
    "tpch_q7",
    """SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate)::INTEGER AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1, 2, 3""",
)
def tpch_q7(t: Tables) -> DataFrame:
    pair = t.nation.where("n_name IN ('NATION_1', 'NATION_2')")
    s = t.supplier.join(pair.select(c("n_nationkey").alias("sk"), c("n_name").alias("supp_nation")), c("s_nationkey") == c("sk"))
    k = t.customer.join(pair.select(c("n_nationkey").alias("ck"), c("n_name").alias("cust_nation")), c("c_nationkey") == c("ck"))
    d = t.lineitem.where(c("l_shipdate").between(ts("1995-01-01"), ts("1996-12-31"))).join(s, c("l_suppkey") == c("s_suppkey")).join(t.orders, c("l_orderkey") == c("o_orderkey")).join(k, c("o_custkey") == c("c_custkey"))
    return d.where("supp_nation <> cust_nation").groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year")).agg(F.round(F.sum(volume()), 2).alias("revenue"))


@query(
    "tpch_q8",
    """SELECT year(o_orderdate)::INTEGER AS o_year, round(sum(CASE WHEN n2.n_name = 'NATION_2' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 8) AS mkt_share
FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND p_type = 'ECONOMY' GROUP BY 1""",
)
def tpch_q8(t: Tables) -> DataFrame:
    america = t.nation.join(t.region.where("r_name = 'AMERICA'"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("ck"))
    o = t.orders.where(c("o_orderdate").between(ts("1995-01-01"), ts("1996-12-31"))).join(t.customer, c("o_custkey") == c("c_custkey")).join(america, c("c_nationkey") == c("ck"))
    d = t.lineitem.join(t.part.where("p_type = 'ECONOMY'"), c("l_partkey") == c("p_partkey")).join(o, c("l_orderkey") == c("o_orderkey")).join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(t.nation, c("s_nationkey") == c("n_nationkey"))
    share = F.sum(F.when(c("n_name") == "NATION_2", volume()).otherwise(0.0)) / F.sum(volume())
    return d.groupBy(F.year("o_orderdate").alias("o_year")).agg(F.round(share, 8).alias("mkt_share"))


@query(
    "tpch_q10",
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
AND o_orderdate >= TIMESTAMP '1993-10-01' AND o_orderdate < TIMESTAMP '1994-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
def tpch_q10(t: Tables) -> DataFrame:
    o = t.orders.where((c("o_orderdate") >= ts("1993-10-01")) & (c("o_orderdate") < ts("1994-01-01")))
    d = t.lineitem.where("l_returnflag = 'R'").join(o, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    d = d.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(F.round(F.sum(volume()), 2).alias("revenue"))
    return d.orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("tpch_q12_shape", "SELECT o_orderpriority, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_returnflag <> 'R') AS kept FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate > o_orderdate GROUP BY 1")
def tpch_q12_shape(t: Tables) -> DataFrame:
    """Q12 with the return flag in place of the ship mode."""
    d = t.lineitem.join(t.orders, (c("l_orderkey") == c("o_orderkey")) & (c("l_shipdate") > c("o_orderdate")))
    return d.groupBy("o_orderpriority").agg(F.count(F.when(c("l_returnflag") == "R", 1)).alias("returned"), F.count(F.when(c("l_returnflag") != "R", 1)).alias("kept"))


@query("tpch_q13_shape", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) GROUP BY c_count")
def tpch_q13_shape(t: Tables) -> DataFrame:
    """Q13 with the priority in place of the comment. Orders are counted before they meet the customers."""
    per = t.orders.where("o_orderpriority <> '5-LOW'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    d = t.customer.join(per, c("c_custkey") == c("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("c_count"))
    return d.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist"))


@query(
    "tpch_q14",
    """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 8) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'""",
)
def tpch_q14(t: Tables) -> DataFrame:
    d = t.lineitem.where((c("l_shipdate") >= ts("1995-09-01")) & (c("l_shipdate") < ts("1995-10-01"))).join(t.part, c("l_partkey") == c("p_partkey"))
    return d.agg(F.round(100.0 * F.sum(F.when(c("p_type").startswith("PROMO"), volume()).otherwise(0.0)) / F.sum(volume()), 8).alias("promo_revenue"))


_Q15 = """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY 1)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)"""


@query("tpch_q15", _Q15)
def tpch_q15(t: Tables) -> DataFrame:
    d = t.lineitem.where((c("l_shipdate") >= ts("1996-01-01")) & (c("l_shipdate") < ts("1996-04-01"))).groupBy("l_suppkey").agg(F.round(F.sum(volume()), 2).alias("total_revenue"))
    best = d.agg(F.max("total_revenue")).scalar()
    return d.where(c("total_revenue") == best).join(t.supplier, c("l_suppkey") == c("s_suppkey")).select("s_suppkey", "s_name", "total_revenue")


@query("tpch_q17_shape", "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem l, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity < (SELECT 0.2 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)")
def tpch_q17_shape(t: Tables) -> DataFrame:
    """Q17 without the container. The average is a window over the lines of the brand's parts only: lineitem is read once."""
    d = t.lineitem.join(t.part.where("p_brand = 'Brand#2'"), c("l_partkey") == c("p_partkey")).withColumn("mean", F.avg("l_quantity").over(Window.partitionBy("l_partkey")))
    return d.where("l_quantity < 0.2 * mean").agg(F.round(F.sum("l_extendedprice") / 7.0, 4).alias("avg_yearly"))


@query(
    "tpch_q18",
    """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY ALL ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
)
def tpch_q18(t: Tables) -> DataFrame:
    """The sum per order decides and is the output: lineitem is aggregated once."""
    big = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")).where("qty > 250")
    d = big.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey"))
    return d.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "qty").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


@query(
    "tpch_q19_shape",
    """SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))""",
)
def tpch_q19_shape(t: Tables) -> DataFrame:
    arm = lambda b, lo, hi, size: (c("p_brand") == b) & c("l_quantity").between(lo, hi) & c("p_size").between(1, size)
    d = t.lineitem.join(t.part, (c("l_partkey") == c("p_partkey")) & (arm("Brand#1", 1, 11, 5) | arm("Brand#2", 10, 20, 10) | arm("Brand#3", 20, 30, 15)))
    return d.agg(F.round(F.sum(volume()), 2).alias("revenue"))


@query(
    "tpch_q22_shape",
    """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (1, 3, 5, 7, 9, 11, 13))
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey""",
)
def tpch_q22_shape(t: Tables) -> DataFrame:
    k = t.customer.where("c_nationkey IN (1, 3, 5, 7, 9, 11, 13)")
    rich = k.where(c("c_acctbal") > k.where("c_acctbal > 0").agg(F.avg("c_acctbal")).scalar())
    return rich.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("numcust"), F.round(F.sum("c_acctbal"), 2).alias("totacctbal"))


@query(
    "tpch_q4_shape",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""",
)
def tpch_q4_shape(t: Tables) -> DataFrame:
    """Q4 with the return flag in the place of the late receipt."""
    o = t.orders.where((c("o_orderdate") >= ts("1995-01-01")) & (c("o_orderdate") < ts("1996-01-01")))
    return o.join(t.lineitem.where("l_returnflag = 'R'"), c("o_orderkey") == c("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))


@query(
    "tpch_q9_shape",
    """SELECT n_name AS nation, year(o_orderdate)::INTEGER AS o_year, round(sum(l_extendedprice * (1 - l_discount) - 0.5 * p_retailprice * l_quantity), 2) AS sum_profit FROM part, supplier, lineitem, orders, nation
WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%' GROUP BY 1, 2""",
)
def tpch_q9_shape(t: Tables) -> DataFrame:
    """Q9, half the retail price standing for the supply cost."""
    d = t.lineitem.join(t.part.where(c("p_name").like("%ring%")), c("l_partkey") == c("p_partkey")).join(t.orders, c("l_orderkey") == c("o_orderkey"))
    d = d.join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(t.nation, c("s_nationkey") == c("n_nationkey"))
    profit = volume() - 0.5 * c("p_retailprice") * c("l_quantity")
    return d.groupBy(c("n_name").alias("nation"), F.year("o_orderdate").alias("o_year")).agg(F.round(F.sum(profit), 2).alias("sum_profit"))


@query(
    "tpch_q16_shape",
    """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'ECON%' AND p_size IN (1, 4, 9, 14, 23, 36, 45, 49)
AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2, 3""",
)
def tpch_q16_shape(t: Tables) -> DataFrame:
    """Q16 with the lines as the suppliers of a part."""
    p = t.part.where((c("p_brand") != "Brand#4") & ~c("p_type").like("ECON%") & c("p_size").isin(1, 4, 9, 14, 23, 36, 45, 49))
    d = t.lineitem.join(p, c("l_partkey") == c("p_partkey")).join(t.supplier.where("s_acctbal < 0"), c("l_suppkey") == c("s_suppkey"), "left_anti")
    return d.groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("l_suppkey").alias("supplier_cnt"))


@query(
    "tpch_q20_shape",
    """SELECT s_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 1 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_suppkey, l_partkey HAVING sum(l_quantity) > 40)""",
)
def tpch_q20_shape(t: Tables) -> DataFrame:
    """Q20 with the quantity shipped in the place of the stock."""
    small = t.part.where(c("p_name").like("small%"))
    d = t.lineitem.where((c("l_shipdate") >= ts("1996-01-01")) & (c("l_shipdate") < ts("1997-01-01"))).join(small, c("l_partkey") == c("p_partkey"), "left_semi")
    much = d.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q")).where("q > 40")
    s = t.supplier.join(t.nation.where("n_regionkey = 1"), c("s_nationkey") == c("n_nationkey"))
    return s.join(much, c("s_suppkey") == c("l_suppkey"), "left_semi").select("s_name")


@query(
    "tpch_q21_shape",
    """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name""",
)
def tpch_q21_shape(t: Tables) -> DataFrame:
    """Q21: lines that alone of their order's suppliers were returned. The suppliers of an order, and those returned, are
    counted in one aggregation in the place of the two self-joins."""
    flag = F.when(c("l_returnflag") == "R", c("l_suppkey"))
    per = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"), F.min(flag).alias("r_lo"), F.max(flag).alias("r_hi"))
    alone = per.where("lo < hi AND r_lo = r_hi").select(c("l_orderkey").alias("k"), "r_lo")
    f = t.orders.where("o_orderstatus = 'F'").join(alone, c("o_orderkey") == c("k"))
    d = t.lineitem.where("l_returnflag = 'R'").join(f, (c("l_orderkey") == c("k")) & (c("l_suppkey") == c("r_lo"))).join(t.supplier, c("l_suppkey") == c("s_suppkey"))
    return d.groupBy("s_name").agg(F.count(F.lit(1)).alias("numwait"))
