"""Join operators that Spark does not have, and a broadcast that checks the size first."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest estimated size of a broadcast side.
BROADCAST_BYTES = 10 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df; of files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is at most limit bytes by estimate, else df: the join is then left to Catalyst."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def range_join(left: DataFrame, right: DataFrame, *, keys: list[str], low: str, high: str, point: str, width_s: int) -> DataFrame:
    """Rows of left and right with equal keys and low <= point <= high (timestamps).

    left is repeated once per bucket of width_s seconds that its interval touches, right has one bucket; the join is then
    an equality. Choose width_s near the usual interval. Null keys and times match nothing; keys come from left.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width_s * 1_000_000))
    spread = left.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    placed = right.withColumn("_bucket", bucket(point))
    joined = spread.join(placed, [*keys, "_bucket"])
    return joined.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_bucket")


def nearest_before(left: DataFrame, right: DataFrame, *, keys: list[str], at: str, values: list[str], width_s: int = 86_400) -> DataFrame:
    """Each row of left with the values of the latest row of right of the same keys at or before it (null if none).

    One union and one window per key and range of width_s seconds, so that a hot key is many tasks' work; the last values
    of each range, one row per key and range, are carried over to the ranges after it. Of right rows with one time, any
    may win; make (keys, at) unique in right where that matters. Rows of left with null keys are kept and match null keys;
    those with a null time get no values, and right rows with a null time are never the latest.
    """
    own = [c for c in left.columns if c not in keys and c != at]
    kind = lambda df, cs: df.select(F.struct(*cs).alias("x")).schema["x"].dataType
    both = left.select(*keys, at, F.lit(1).alias("_side"), F.struct(*own).alias("_own"), F.lit(None).cast(kind(right, values)).alias("_value")).unionAll(
        right.where(F.col(at).isNotNull()).select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(kind(left, own)).alias("_own"), F.struct(*values).alias("_value"))
    )
    both = both.withColumn("_range", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (width_s * 1_000_000)))
    # what each range ends with, and what the ranges before it ended with
    last = both.groupBy(*keys, "_range").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.col(at))).alias("_value"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), F.last("_value", ignorenulls=True).over(earlier).alias("_carried"))
    here = Window.partitionBy(*keys, "_range").orderBy(F.col(at), "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_value", F.last("_value", ignorenulls=True).over(here)).where("_side = 1")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_range") == F.col("_r"))
    found = seen.join(carried, same, "left").withColumn("_value", F.coalesce("_value", "_carried"))
    return found.select(*keys, at, *(F.col(f"_own.{c}") for c in own), *(F.col(f"_value.{v}") for v in values))


def cogroup(left: DataFrame, right: DataFrame, keys: list[str], f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over the rows of left and right with equal keys, for keys of either side (null is one), as Arrow-backed frames.

    A group must fit into a task: combine or count a side with hot keys before, as cogroup_counts does.
    """
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(f, schema)


def cogroup_counts(left: DataFrame, left_key: str, right: DataFrame, right_key: str, key: str, left_n: str, right_n: str) -> DataFrame:
    """Rows of each side per key, for keys of either side. Both sides are counted before they meet."""
    one = left.groupBy(F.col(left_key).alias(key)).agg(F.count(F.lit(1)).alias(left_n))
    other = right.groupBy(F.col(right_key).alias(key)).agg(F.count(F.lit(1)).alias(right_n))
    return one.join(other, key, "full").na.fill(0, [left_n, right_n])
