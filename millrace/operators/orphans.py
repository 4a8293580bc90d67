"""References to records that do not exist, or not yet, or no more (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_references(
    child: DataFrame, parent: DataFrame, *, table_name: str, record: str, reference: str, loaded: str, period: str, parent_key: str, parent_loaded: str, parent_deleted: str
) -> DataFrame:
    """Records of child whose reference has no parent, a parent deleted by the record's load, or one loaded later.

    Columns: table_name, record_key, kind ("missing", "deleted", "late", the first that holds), period. Copies of a
    record and of a parent count as one: the earliest load, the earliest non-null deletion and the earliest period hold.
    All copies of a record carry the same reference; a null reference or record key is no case. A null load time of a
    record is taken as before everything that is loaded, so it is late wherever the parent has a load time. Empty inputs give
    no rows, an empty parent makes every reference missing.

    Distinct references, combined before they move, meet the parent's keys in an anti-join (missing) and an inner join
    that keeps the parents which can be too late or deleted for at least one record. Only these suspects, few, are
    joined back to the child's rows; a hot one is left to the adaptive skew join, which splits the child's side.
    """
    rows = child.select(
        F.col(record).cast("bigint").alias("record_key"), F.col(reference).cast("bigint").alias("reference"),
        F.col(loaded).alias("loaded"), F.col(period).alias("period"),
    ).where("record_key IS NOT NULL AND reference IS NOT NULL")
    references = rows.groupBy("reference").agg(
        F.max("loaded").alias("latest"), F.min("loaded").alias("earliest"), F.max(F.col("loaded").isNull()).alias("undated")
    )
    parents = (
        parent.select(F.col(parent_key).cast("bigint").alias("reference"), F.col(parent_loaded).alias("there_from"), F.col(parent_deleted).alias("gone_from"))
        .where("reference IS NOT NULL")
        .groupBy("reference")
        .agg(F.min("there_from").alias("there_from"), F.min("gone_from").alias("gone_from"))
    )
    missing = references.join(parents, "reference", "left_anti").select(
        "reference", F.lit(True).alias("absent"), F.lit(None).cast(parents.schema["there_from"].dataType).alias("there_from"), F.lit(None).cast(parents.schema["gone_from"].dataType).alias("gone_from")
    )
    timed = (
        references.join(parents, "reference")
        .where("gone_from <= latest OR there_from > earliest OR (undated AND there_from IS NOT NULL)")
        .select("reference", F.lit(False).alias("absent"), "there_from", "gone_from")
    )
    # Gathered anew: only a join of two shuffled sides is split where it is skewed, and the union keeps its parts' order.
    suspects = missing.unionAll(timed).hint("rebalance")
    kind = (
        F.when(F.col("absent"), "missing")
        .when(F.col("gone_from") <= F.col("loaded"), "deleted")
        .when((F.col("there_from") > F.col("loaded")) | (F.col("loaded").isNull() & F.col("there_from").isNotNull()), "late")
    )
    return (
        rows.join(suspects, "reference")
        .groupBy("record_key")
        .agg(F.min("loaded").alias("loaded"), F.min("period").alias("period"), F.max("absent").alias("absent"), F.min("there_from").alias("there_from"), F.min("gone_from").alias("gone_from"))
        .select(F.lit(table_name).alias("table_name"), "record_key", kind.alias("kind"), "period")
        .where("kind IS NOT NULL")
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Number of orphans per table, kind and month of the period: table_name, kind, month (first day, null if none)."""
    return orphans.groupBy("table_name", "kind", F.to_date(F.date_trunc("month", "period")).alias("month")).agg(F.count(F.lit(1)).alias("n_records"))
