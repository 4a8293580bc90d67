"""Queries of the general data-processing problems 1, 2 and 4 over the retail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.catalog import Tables
from millrace.operators.balance import heavy_keys, key_counts
from millrace.operators.features import entity_features
from millrace.operators.orphans import orphan_counts, orphan_references
from millrace.registry import Registry

registry = Registry()
query = registry.query

#: Number of categories in category_sub, a fixed table; only the SQL twin needs it in advance.
N_CATEGORIES = 360


def _features_sql(n: int = N_CATEGORIES) -> str:
    width = max(3, len(str(n - 1)))
    columns = ["coalesce(lines[{i}], 0) AS lines_{i:0{w}d}", "coalesce(purchases[{i}], 0) AS purchases_{i:0{w}d}", "days[{i}]::INTEGER AS days_{i:0{w}d}"]
    wide = ",\n".join(c.format(i=i, w=width) for c in columns for i in range(n))
    return f"""
WITH types AS (SELECT sbc_id, row_number() OVER (ORDER BY sbc_id) - 1 AS idx FROM (SELECT DISTINCT sbc_id FROM category_sub WHERE sbc_id IS NOT NULL)),
lines AS (SELECT customer_master_id, transaction_header_key, transaction_detail_key, original_sku_category_id, max(transaction_dt) AS dt
          FROM t_detail WHERE customer_master_id IS NOT NULL GROUP BY ALL),
cells AS (SELECT customer_master_id, coalesce(idx, -1) AS idx, count(*) AS lines, count(DISTINCT transaction_header_key) AS purchases, DATE '2025-12-31' - max(dt) AS days
          FROM lines LEFT JOIN types ON sbc_id = original_sku_category_id GROUP BY customer_master_id, idx),
vectors AS (SELECT customer_master_id, map_from_entries(list((idx, lines))) AS lines, map_from_entries(list((idx, purchases))) AS purchases, map_from_entries(list((idx, days))) AS days
            FROM cells GROUP BY customer_master_id)
SELECT customer_master_id, {wide}
FROM vectors"""


@query("p1_features", _features_sql())
def p1_features(t: Tables) -> DataFrame:
    """Lines, purchases and days since the last line of each of 360 categories, per customer."""
    return entity_features(
        t.t_detail, t.category_sub, type_id="sbc_id", entity="customer_master_id", kind="original_sku_category_id",
        at="transaction_dt", record="transaction_detail_key", basket="transaction_header_key", as_of="2025-12-31",
    )


KEY_FIELDS = ["store_nbr", "customer_master_id"]


@query(
    "p2_counts",
    """
SELECT 'store_nbr' AS field_name, store_nbr::BIGINT AS key_value, count(*) AS n_rows, count(DISTINCT transaction_header_key) AS n_purchases
FROM t_header WHERE store_nbr IS NOT NULL GROUP BY store_nbr
UNION ALL
SELECT 'customer_master_id', customer_master_id, count(*), count(DISTINCT transaction_header_key)
FROM t_header WHERE customer_master_id IS NOT NULL GROUP BY customer_master_id""",
)
def p2_counts(t: Tables) -> DataFrame:
    """Rows and different purchases of every store and every customer."""
    return key_counts(t.t_header, KEY_FIELDS, "transaction_header_key")


@query(
    "p2_found",
    """
SELECT 'store_nbr' AS field_name, store_nbr::BIGINT AS key_value FROM t_header WHERE store_nbr IS NOT NULL
GROUP BY store_nbr HAVING count(*) * 50 >= (SELECT count(*) FROM t_header)
UNION ALL
SELECT 'customer_master_id', customer_master_id FROM t_header WHERE customer_master_id IS NOT NULL
GROUP BY customer_master_id HAVING count(*) * 50 >= (SELECT count(*) FROM t_header)""",
)
def p2_found(t: Tables) -> DataFrame:
    """Stores and customers that hold at least 2 % of the rows of t_header."""
    return heavy_keys(t.t_header, KEY_FIELDS, share=50)


def _orphans(t: Tables) -> DataFrame:
    lines = orphan_references(
        t.t_detail, t.t_header, table_name="t_detail", record="transaction_detail_key", reference="transaction_header_key", loaded="load_ts",
        period="transaction_dt", parent_key="transaction_header_key", parent_loaded="load_ts", parent_deleted="deleted_ts",
    )
    purchases = orphan_references(
        t.t_header, t.customers, table_name="t_header", record="transaction_header_key", reference="customer_master_id", loaded="load_ts",
        period="transaction_dt", parent_key="customer_master_id", parent_loaded="load_ts", parent_deleted="deleted_ts",
    )
    return lines.unionAll(purchases)


_ORPHANS_SQL = """
WITH header AS (SELECT transaction_header_key AS k, min(customer_master_id) AS ref, min(load_ts) AS loaded, min(deleted_ts) AS gone, min(transaction_dt) AS dt FROM t_header WHERE transaction_header_key IS NOT NULL GROUP BY 1),
detail AS (SELECT transaction_detail_key AS k, min(transaction_header_key) AS ref, min(load_ts) AS loaded, min(transaction_dt) AS dt FROM t_detail WHERE transaction_detail_key IS NOT NULL GROUP BY 1),
person AS (SELECT customer_master_id AS k, min(load_ts) AS loaded, min(deleted_ts) AS gone FROM customers WHERE customer_master_id IS NOT NULL GROUP BY 1),
found AS (
SELECT 't_detail' AS table_name, d.k AS record_key, CASE WHEN h.k IS NULL THEN 'missing' WHEN h.gone <= d.loaded THEN 'deleted' WHEN h.loaded > d.loaded THEN 'late' END AS kind, d.dt
FROM detail d LEFT JOIN header h ON d.ref = h.k WHERE d.ref IS NOT NULL
UNION ALL
SELECT 't_header', h.k, CASE WHEN c.k IS NULL THEN 'missing' WHEN c.gone <= h.loaded THEN 'deleted' WHEN c.loaded > h.loaded THEN 'late' END, h.dt
FROM header h LEFT JOIN person c ON h.ref = c.k WHERE h.ref IS NOT NULL)
"""


@query("p4_counts", _ORPHANS_SQL + "SELECT table_name, kind, date_trunc('month', dt)::DATE AS month, count(*) AS n_records FROM found WHERE kind IS NOT NULL GROUP BY ALL")
def p4_counts(t: Tables) -> DataFrame:
    """Number of orphan references per table, kind and month."""
    return orphan_counts(_orphans(t))


@query("p4_found", _ORPHANS_SQL + "SELECT table_name, record_key, kind FROM found WHERE kind IS NOT NULL")
def p4_found(t: Tables) -> DataFrame:
    """Lines without a purchase and purchases without a customer, with the kind."""
    return _orphans(t).select("table_name", "record_key", "kind")
