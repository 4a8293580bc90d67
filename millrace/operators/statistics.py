"""Column statistics, as the optimizer of a database collects them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["column_name", "n_rows", "n_null", "n_distinct", "low", "high", "avg_width"]


def column_statistics(df: DataFrame, columns: list[str] | None = None, exact: bool = False, error: float = 0.02) -> DataFrame:
    """A row per column: rows, nulls, distinct values (approximate unless exact), lowest, highest (as text) and mean width.

    One aggregation for all columns, partial in each task and merged, turned into rows afterwards.
    """
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.AtomicType, T.NumericType))]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        col = F.col(c)
        distinct = F.count_distinct(col) if exact else F.approx_count_distinct(col, error)
        aggs += [F.count(col).alias(f"c{i}"), distinct.alias(f"d{i}"), F.min(col).cast("string").alias(f"l{i}"), F.max(col).cast("string").alias(f"h{i}"), F.avg(F.length(col.cast("string"))).alias(f"w{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("n_null"), F.col(f"d{i}").alias("n_distinct"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), F.col(f"w{i}").alias("avg_width")) for i, c in enumerate(names)))
    return one.select(F.inline(rows))


def quantiles(df: DataFrame, column: str, points: list[float], accuracy: int = 10_000) -> DataFrame:
    """point and value: approximate quantiles from mergeable summaries."""
    q = df.agg(F.percentile_approx(column, points, accuracy).alias("q"))
    return q.select(F.posexplode("q").alias("i", "value")).select(F.element_at(F.array(*map(F.lit, points)), F.col("i") + 1).alias("point"), "value")


def frequencies(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values (null is one), a report of k rows; ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(k)


def selectivity(df: DataFrame, predicate) -> DataFrame:
    """n_rows, n_match and their ratio for a predicate."""
    d = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(predicate, 1)).alias("n_match"))
    return d.withColumn("selectivity", F.when(F.col("n_rows") > 0, F.col("n_match") / F.col("n_rows")))


def analyze_table(spark: SparkSession, table: str, columns: list[str] | None = None) -> None:
    """COLLECT STATISTICS into the catalog, where the cost-based optimizer finds them."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else " FOR ALL COLUMNS"))
