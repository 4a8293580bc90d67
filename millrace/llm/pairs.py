"""Items that appear together (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.arrowops import columns_of, group_starts, local_aggregate, whole_groups
from millrace.session import ensure_checkpoint_dir

#: Pairs a task holds before it combines them.
STEP_PAIRS = 1 << 21

COUNTS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def _batch(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[low : low + 100_000]) for x in (a, b, n)], names=COUNTS.names)


def _combined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    at = group_starts(a, b)
    return a[at], b[at], np.add.reduceat(n, at)


def pair_counts(df: DataFrame, basket: str, item: str) -> DataFrame:
    """a, b, n: baskets that hold items a < b; n with a = b is the baskets that hold a, and of a row with nulls all baskets.

    Items repeated in a basket and copies of rows count once; rows without basket or item are left out. A basket's items
    meet by position difference, a vector at a time, and are combined in the task: a basket of any size needs memory
    for its items and STEP_PAIRS pairs, not for all its pairs.
    """
    rows = df.select(F.col(basket).cast("bigint").alias("basket"), F.col(item).cast("bigint").alias("item"))
    rows = local_aggregate(rows.where("basket IS NOT NULL AND item IS NOT NULL"), ["basket", "item"]).repartition("basket").sortWithinPartitions("basket", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["basket"]):
            yield from count(*columns_of(table, ["basket", "item"]))

    def count(basket: np.ndarray, item: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = group_starts(basket, item)
        basket, item = basket[at], item[at]
        first = group_starts(basket)
        left = np.repeat(np.append(first[1:], len(basket)), np.diff(np.append(first, len(basket)))) - np.arange(len(basket))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([len(first)])], names=COUNTS.names)
        held, size, place, shift = [], 0, np.arange(len(item)), 0
        dictionary, code = np.unique(item, return_inverse=True)
        wide = len(dictionary)
        while len(place):
            for low in range(0, len(place), STEP_PAIRS):
                part = place[low : low + STEP_PAIRS]
                key, n = np.unique(code[part] * wide + code[part + shift], return_counts=True)
                held.append((dictionary[key // wide], dictionary[key % wide], n))
                size += len(key)
                if size > STEP_PAIRS:
                    held = [_combined(held)]
                    size = len(held[0][0])
                    if size > STEP_PAIRS // 2:
                        yield from _batch(*held[0])
                        held, size = [], 0
            shift += 1
            place = place[left[place] > shift]
        if held:
            yield from _batch(*_combined(held))

    return rows.mapInArrow(run, COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n"))


def pair_statistics(df: DataFrame, basket: str, item: str, a: str = "item_a", b: str = "item_b") -> DataFrame:
    """For every two items a < b of a common basket: n_both, n_a, n_b, n_baskets, lift and pmi (natural logarithm).

    lift = n_both * n_baskets / (n_a * n_b), the ratio to the number expected by chance. No rows for empty input. The
    counts, from which pairs, marginals and total are taken, are made once, into a checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    counts = pair_counts(df, basket, item).checkpoint()
    single = counts.where("a = b")
    total = counts.where("a IS NULL").agg(F.sum("n").alias("n_baskets")).scalar()
    joined = (
        counts.where("a < b").withColumnRenamed("n", "n_both")
        .join(single.select("a", F.col("n").alias("n_a")), "a")
        .join(single.select("b", F.col("n").alias("n_b")), "b")
        .withColumn("n_baskets", total)
    )
    lift = (F.col("n_both").cast("double") / F.col("n_a")) * (F.col("n_baskets").cast("double") / F.col("n_b"))
    return joined.select(
        F.col("a").alias(a), F.col("b").alias(b), "n_both", "n_a", "n_b", "n_baskets", lift.alias("lift"), F.log(lift).alias("pmi")
    )


def frequent_pairs(df: DataFrame, basket: str, item: str, a: str, b: str, *, least: int = 5, per: int = 1000, times: int = 4) -> DataFrame:
    """a < b in at least `least` baskets and in one of `per` baskets, together at least `times` as often as by chance."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  exact beyond 64 bits
    chance = wide("n_both") * wide("n_baskets") >= F.lit(times) * wide("n_a") * wide("n_b")
    stats = pair_statistics(df, basket, item, a, b)
    return stats.where((F.col("n_both") >= least) & (wide("n_both") * per >= wide("n_baskets")) & chance).select(a, b)
