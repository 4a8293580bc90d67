"""INSERT, UPDATE, DELETE, upsert and constraint checks, as the tables' new content or their violations."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Tables
from millrace.operators import dml
from millrace.plans.changes import change_by_sql
from millrace.plans.sqlfront import run_sql
from millrace.registry import Registry
from millrace.sources.adapter import ChangeableSource
from millrace.sources.table import ChangeableTable, ForeignKey, Trigger, Violation
from millrace.sources.writers import scratch

registry = Registry()
query = registry.query
c = F.col


@query("dml_insert_select", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, NULL FROM region")
def dml_insert_select(t: Tables) -> DataFrame:
    """INSERT INTO nation (n_nationkey, n_name) SELECT ...: the column left out takes null."""
    return dml.insert_rows(t.nation, t.region.select((c("r_regionkey") + 100).alias("n_nationkey"), c("r_name").alias("n_name")))


@query("dml_insert_default", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 200 + r_regionkey, upper(r_name || '!'), 7 FROM region")
def dml_insert_default(t: Tables) -> DataFrame:
    """A default for a column left out, and a generated column."""
    rows = t.region.select((c("r_regionkey") + 200).alias("n_nationkey"), F.concat("r_name", F.lit("!")).alias("n_name"))
    return dml.insert_rows(t.nation, rows, {"n_regionkey": F.lit(7)}, {"n_name": F.upper("n_name")})


@query("dml_update_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update_case(t: Tables) -> DataFrame:
    return dml.update_rows(t.customer, c("c_acctbal") < 0, c_acctbal=F.lit(0.0), c_mktsegment=F.lit("DEBT")).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("dml_update_from", "SELECT s_suppkey, coalesce(c_acctbal, s_acctbal) AS s_acctbal FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_mktsegment = 'BUILDING'")
def dml_update_from(t: Tables) -> DataFrame:
    source = t.customer.where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("s_suppkey"), c("c_acctbal").alias("s_acctbal"))
    return dml.update_from(t.supplier, source, ["s_suppkey"], ["s_acctbal"]).select("s_suppkey", "s_acctbal")


@query("dml_delete_not", "SELECT doc_id, store_nbr FROM documents WHERE NOT (store_nbr > 3000) OR store_nbr IS NULL")
def dml_delete_not(t: Tables) -> DataFrame:
    """DELETE WHERE store_nbr > 3000: rows for which the condition is unknown stay."""
    return dml.delete_rows(t.documents.select("doc_id", "store_nbr"), c("store_nbr") > 3000)


@query(
    "dml_upsert",
    """SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey * 10 FROM region)
UNION ALL SELECT r_regionkey * 10, r_name, r_regionkey FROM region""",
)
def dml_upsert(t: Tables) -> DataFrame:
    source = t.region.select((c("r_regionkey") * 10).alias("n_nationkey"), c("r_name").alias("n_name"), c("r_regionkey").alias("n_regionkey"))
    return dml.upsert(t.nation, source, ["n_nationkey"])


@query("dml_normalize", "SELECT c_custkey::INTEGER AS id, rpad(left(c_mktsegment, 10), 12, ' ') AS segment, c_acctbal::DECIMAL(15,2)::DOUBLE AS balance FROM customer")
def dml_normalize(t: Tables) -> DataFrame:
    """Source columns coerced to the target's types, lengths and nullability."""
    target = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("segment", T.CharType(12), True), T.StructField("balance", T.DecimalType(15, 2), True)])
    d = dml.normalize(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), target)
    return d.withColumn("balance", c("balance").cast("double"))


@query("constraint_fk_check", "SELECT DISTINCT transaction_header_key FROM t_detail WHERE transaction_header_key NOT IN (SELECT transaction_header_key FROM t_header WHERE transaction_header_key IS NOT NULL)")
def constraint_fk_check(t: Tables) -> DataFrame:
    return dml.missing_parents(t.t_detail, "transaction_header_key", t.t_header, "transaction_header_key")


@query("constraint_unique_check", "SELECT transaction_header_key, count(*) AS n FROM t_header WHERE transaction_header_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def constraint_unique_check(t: Tables) -> DataFrame:
    return dml.duplicate_keys(t.t_header, ["transaction_header_key"])


@query("constraint_check_null", "SELECT doc_id, 'null' AS violation FROM documents WHERE text IS NULL UNION ALL SELECT doc_id, 'check' FROM documents WHERE NOT (n_chars > 10)")
def constraint_check_null(t: Tables) -> DataFrame:
    d = t.documents
    nulls = dml.null_violations(d, ["text"]).select("doc_id", F.lit("null").alias("violation"))
    return nulls.unionAll(dml.check_violations(d, c("n_chars") > 10).select("doc_id", F.lit("check").alias("violation")))


@query(
    "dml_stored_table",
    """SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name || '!') ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 AND n_nationkey > 4
UNION ALL SELECT n_nationkey, 'new', 9 FROM nation WHERE n_nationkey <= 4""",
)
def dml_stored_table(t: Tables) -> DataFrame:
    """INSERT, UPDATE, DELETE and upsert of a stored table, each a version of it."""
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType(), False), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())])
    table = ChangeableTable.create(t.spark, scratch(t.spark, "table"), schema, ["n_nationkey"])
    table.insert(t.nation)
    table.update(c("n_regionkey") == 2, n_name=F.upper(F.concat("n_name", F.lit("!"))))
    table.delete(c("n_regionkey") == 1)
    table.upsert(t.nation.where("n_nationkey <= 4").select("n_nationkey", F.lit("new").alias("n_name"), F.lit(9).alias("n_regionkey")))
    return table.read()


@query("table_by_format", "SELECT event_id, ts, event_type, value FROM events UNION ALL SELECT event_id + 1000000, ts, event_type, NULL FROM events WHERE event_type = 'error'")
def table_by_format(t: Tables) -> DataFrame:
    """A changeable table written and read as a data source, as an adapter does."""
    t.spark.dataSource.register(ChangeableSource)
    d = t.events.select("event_id", "ts", "event_type", "value")
    table = ChangeableTable.create(t.spark, scratch(t.spark, "table"), d.schema)
    write = lambda rows, mode: rows.write.format("changeable").mode(mode).save(table.path)
    write(t.events.limit(5).select(*d.columns), "append")
    write(d, "overwrite")
    write(d.where("event_type = 'error'").select((c("event_id") + 1_000_000).alias("event_id"), "ts", "event_type", F.lit(None).cast("double").alias("value")), "append")
    return t.spark.read.format("changeable").load(table.path)


@query("table_time_travel", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_time_travel(t: Tables) -> DataFrame:
    """A version before later changes."""
    table = ChangeableTable.create(t.spark, scratch(t.spark, "table"), t.nation.schema)
    first = table.insert(t.nation)
    table.delete(c("n_regionkey") > 0)
    return table.read(first)


@query(
    "constraint_fk_enforced",
    """SELECT 'order of nobody' AS attempt, true AS refused UNION ALL SELECT 'customer with orders goes', true UNION ALL SELECT 'key without value', true UNION ALL SELECT 'customer without orders goes', false
UNION ALL SELECT 'rows kept', (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) IS NULL""",
)
def constraint_fk_enforced(t: Tables) -> DataFrame:
    """Foreign and primary keys hold on write: which attempts are refused."""
    key = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])
    customers = ChangeableTable.create(t.spark, scratch(t.spark, "table"), key, primary=["c_custkey"])
    reference = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType())])
    orders = ChangeableTable.create(t.spark, scratch(t.spark, "table"), reference, primary=["o_orderkey"], references=[ForeignKey(["o_custkey"], customers.path, ["c_custkey"])])
    customers.insert(t.customer.select("c_custkey", "c_name"))
    orders.insert(t.orders.select("o_orderkey", "o_custkey"))
    with_orders = t.orders.agg(F.min("o_custkey")).scalar()
    nobody = t.spark.createDataFrame([(-1, -1)], "o_orderkey bigint, o_custkey bigint")
    nameless = t.spark.createDataFrame([(None, "x")], "c_custkey bigint, c_name string")
    busy = orders.read().select(c("o_custkey").alias("k")).distinct()
    idle = lambda how: lambda rows: rows.join(busy, c("c_custkey") == c("k"), how)
    attempts = {
        "order of nobody": lambda: orders.insert(nobody), "customer with orders goes": lambda: customers.delete(c("c_custkey") == with_orders), "key without value": lambda: customers.insert(nameless),
        "customer without orders goes": lambda: customers.change("delete", idle("left_anti"), idle("left_semi")),
    }
    out = []
    for name, attempt in attempts.items():
        try:
            attempt()
            out.append((name, False))
        except (Violation, PySparkException):
            out.append((name, True))
    left = customers.read().join(busy, c("c_custkey") == c("k"), "full").where("k IS NULL OR c_custkey IS NULL")
    out.append(("rows kept", not left.isEmpty()))
    return t.spark.createDataFrame(out, "attempt string, refused boolean")


@query(
    "trigger_statement",
    """SELECT 'raised' AS what, s_nationkey AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier WHERE s_acctbal < 0 GROUP BY 2
UNION ALL SELECT 'gone', s_nationkey, count(*), round(sum(s_acctbal), 2) FROM supplier WHERE s_nationkey = 3 AND s_acctbal >= 0 GROUP BY 2""",
)
def trigger_statement(t: Tables) -> DataFrame:
    """Statement triggers with transition tables and WHEN, which fill a log; one whose condition fails does nothing."""
    kind = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_nationkey", T.IntegerType()), T.StructField("s_acctbal", T.DoubleType())])
    log_kind = T.StructType([T.StructField("what", T.StringType()), T.StructField("nation", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
    table = ChangeableTable.create(t.spark, scratch(t.spark, "table"), kind, primary=["s_suppkey"])
    log = ChangeableTable.create(t.spark, scratch(t.spark, "table"), log_kind)
    per = "SELECT '{what}' AS what, s_nationkey AS nation, count(*) AS n, sum(s_acctbal) AS total FROM {{old_rows}} GROUP BY s_nationkey"
    table.add_trigger(Trigger("raised", "UPDATE", per.format(what="raised"), log.path, when="(SELECT count(*) FROM {new_rows} WHERE s_acctbal = 0) > 0", columns=["s_acctbal"]))
    table.add_trigger(Trigger("never", "UPDATE", per.format(what="never"), log.path, when="(SELECT max(s_acctbal) FROM {new_rows}) > 0"))
    table.add_trigger(Trigger("gone", "DELETE", per.format(what="gone"), log.path))
    table.insert(t.supplier.select(*kind.names))
    table.update(c("s_acctbal") < 0, s_acctbal=F.lit(0.0))
    table.delete((c("s_nationkey") == 3) & (c("s_acctbal") > 0))
    return log.read().withColumn("total", F.round("total", 2))


_STOCK = [
    "INSERT INTO stock (k, what) SELECT p_partkey, p_name FROM part",
    "UPDATE stock SET n = (k + 1) * 1.5, what = upper(what) WHERE k IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "DELETE FROM stock WHERE n IS NULL AND what LIKE 'small%'",
    """MERGE INTO stock s USING (SELECT DISTINCT s_suppkey * 7 AS k, s_name FROM supplier) u ON s.k = u.k
WHEN MATCHED THEN UPDATE SET what = u.s_name, n = -1 WHEN NOT MATCHED THEN INSERT (k, what) VALUES (u.k, 'new')""",
]


@query(
    "dml_sql_text",
    """WITH raised AS (SELECT p_partkey AS k, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS hit, p_name FROM part),
updated AS (SELECT k, CASE WHEN hit THEN upper(p_name) ELSE p_name END AS what, CASE WHEN hit THEN (k + 1) * 1.5 END::DOUBLE AS n FROM raised WHERE hit OR NOT starts_with(p_name, 'small')),
u AS (SELECT DISTINCT s_suppkey * 7 AS k, s_name FROM supplier)
SELECT coalesce(s.k, u.k) AS k, CASE WHEN s.k IS NULL THEN 'new' WHEN u.k IS NULL THEN what ELSE s_name END AS what, CASE WHEN u.k IS NULL THEN n WHEN s.k IS NOT NULL THEN -1 END::DOUBLE AS n FROM updated s FULL JOIN u ON s.k = u.k""",
)
def dml_sql_text(t: Tables) -> DataFrame:
    """INSERT, UPDATE, DELETE and MERGE as SQL texts, with sub-queries over other tables."""
    kind = T.StructType([T.StructField("k", T.LongType()), T.StructField("what", T.StringType()), T.StructField("n", T.DoubleType())])
    own = Tables(t.spark, t.folder)
    own.attach("stock", ChangeableTable.create(t.spark, scratch(t.spark, "table"), kind, primary=["k"]))
    for text in _STOCK:
        change_by_sql(own, text)
    return run_sql(own, "SELECT k, what, n FROM stock")
