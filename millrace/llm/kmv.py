"""Distinct counts from the k smallest hashes of each group (problem 5).

A sketch is the sorted list of a group's k smallest different hashes; a group with fewer has all of them and is counted
exactly. Sketches of parts merge by keeping the k smallest again, so days add up to months and stores to chains.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.arrowops import group_starts, ints, wide_rows

#: Hashes per sketch: a relative standard error of 1 / sqrt(K - 2), 1.6 %.
K = 4096
#: Standard deviations between an estimate and its bounds: about 95 % of estimates lie within.
Z = 2.0
#: Hashes are in [0, 2 ** HASH_BITS).
HASH_BITS = 63
#: Stands for a null group value.
NULL = -(1 << 62)
#: Hashes that a task holds before it keeps the k smallest of each group.
STEP = 1 << 21
#: Parts in which a group's sketches are merged before they meet.
SALTS = 16


def mixed(ids: np.ndarray) -> np.ndarray:
    """A 63-bit hash of 64-bit integers (the finaliser of the splitmix generator)."""
    z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _schema(keys: list[str]) -> T.StructType:
    return T.StructType([*(T.StructField(k, T.LongType()) for k in keys), T.StructField("hashes", T.ArrayType(T.LongType(), False))])


def _smallest(columns: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k smallest different values of the last column for equal values of the others, sorted."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    at = group_starts(*columns)
    columns = [c[at] for c in columns]
    first = group_starts(*columns[:-1]) if len(columns) > 1 else np.zeros(min(1, len(columns[0])), np.int64)
    nth = np.arange(len(columns[0])) - np.repeat(first, np.diff(np.append(first, len(columns[0]))))
    return [c[nth < k] for c in columns]


def _sketches(parts: Iterator[list[np.ndarray]], keys: list[str], k: int) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    size = limit = 0
    for part in parts:
        held.append(part)
        size += len(part[-1])
        if size > max(STEP, 2 * limit):
            held = [_smallest([np.concatenate(c) for c in zip(*held)], k)]
            size = limit = len(held[0][-1])
    if not size:
        return
    columns = _smallest([np.concatenate(c) for c in zip(*held)], k)
    first = group_starts(*columns[:-1]) if keys else np.zeros(1, np.int64)
    offsets = pa.array(np.append(first, len(columns[-1])).astype(np.int32))
    out = [pa.array(c[first], mask=c[first] == NULL) for c in columns[:-1]]
    batch = pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(offsets, pa.array(columns[-1]))], names=[*keys, "hashes"])
    for low in range(0, batch.num_rows, 2000):
        yield batch.slice(low, 2000)


def merge_sketches(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One sketch per group of keys (integers; null is a group). Merged in each task, in SALTS parts, then whole: no task
    ever holds more than its parts' k smallest hashes, however many sketches a group has."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for b in batches:
            if b.num_rows:
                sizes = b.column("hashes").value_lengths().to_numpy(zero_copy_only=False)
                yield [*(np.repeat(ints(b.column(n), NULL), sizes) for n in keys), b.column("hashes").flatten().to_numpy(zero_copy_only=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sketches(parts(batches), keys, k)

    schema = _schema(keys)
    here = wide_rows(sketches).select(*keys, "hashes").mapInArrow(run, schema)
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    some = here.withColumn("salt", salt).repartition(*keys, "salt").drop("salt").mapInArrow(run, schema)
    return (some.repartition(*keys) if keys else some.coalesce(1)).mapInArrow(run, schema)


def build_sketches(df: DataFrame, keys: dict[str, Column], identifier: Column, k: int = K) -> DataFrame:
    """A sketch of the different non-null identifiers per group. keys: integer columns by name; null is a group.

    identifier: an integer column, or any other, which is then hashed to 64 bits first. Groups without an identifier
    have no sketch.
    """
    names = list(keys)
    kind = df.select(identifier.alias("x")).schema[0].dataType
    number = identifier if isinstance(kind, T.IntegralType) else F.when(identifier.isNotNull(), F.xxhash64(identifier))
    rows = df.select(*(c.cast("bigint").alias(n) for n, c in keys.items()), number.cast("bigint").alias("id")).where("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sketches(([*(ints(b.column(n), NULL) for n in names), mixed(ints(b.column("id")))] for b in batches), names, k)

    return merge_sketches(rows.mapInArrow(run, _schema(names)), names, k)


def estimates(sketches: DataFrame, k: int = K) -> DataFrame:
    """The columns without hashes, with estimate, lower and upper bound, and is_exact (fewer than k identifiers)."""
    n, largest = F.size("hashes"), F.element_at("hashes", -1)
    exact = n < k
    estimate = F.when(exact, n.cast("double")).otherwise(F.lit((k - 1) * 2.0**HASH_BITS) / largest.cast("double"))
    spread = Z / math.sqrt(k - 2)
    out = sketches.withColumns({"estimate": estimate, "is_exact": exact})
    return out.withColumns({
        "lower": F.when(exact, F.col("estimate")).otherwise(F.greatest(F.lit(float(k)), F.col("estimate") * F.lit(1 / (1 + spread)))),
        "upper": F.when(exact, F.col("estimate")).otherwise(F.col("estimate") * F.lit(1 / (1 - spread))),
    }).drop("hashes")


def set_estimates(pairs: DataFrame, left: str, right: str, k: int = K) -> DataFrame:
    """Union, intersection and left-only differences of two sketches in a row, each with bounds, in place of both.

    The k smallest hashes of the union are a random sample of it; the share of them in both, or in left only, times the
    union's estimate is the result. Bounds: Wilson's interval of the share times the bounds of the union. Exact where the
    union has fewer than k. A null sketch is an empty set.
    """
    empty = F.array().cast("array<bigint>")
    a, b = F.coalesce(F.col(left), empty), F.coalesce(F.col(right), empty)
    rows = pairs.withColumns({"_a": a, "_b": b})
    rows = rows.withColumn("hashes", F.slice(F.array_sort(F.array_union("_a", "_b")), 1, k))
    rows = rows.withColumns({
        "_n": F.size("hashes").cast("double"),
        "_both": F.size(F.array_intersect("hashes", F.array_intersect("_a", "_b"))).cast("double"),
        "_left": F.size(F.array_except(F.array_intersect("hashes", "_a"), F.col("_b"))).cast("double"),
    })
    rows = estimates(rows, k)
    out = [F.col("estimate").alias("union_estimate"), F.col("lower").alias("union_lower"), F.col("upper").alias("union_upper"), "is_exact"]
    for name, count in (("intersection", "_both"), ("difference", "_left")):
        share = F.when(F.col("_n") > 0, F.col(count) / F.col("_n")).otherwise(0.0)
        centre = (share + Z * Z / 2 / F.col("_n")) / (1 + Z * Z / F.col("_n"))
        half = Z / (1 + Z * Z / F.col("_n")) * F.sqrt(share * (1 - share) / F.col("_n") + Z * Z / 4 / F.col("_n") / F.col("_n"))
        low, high = F.greatest(F.lit(0.0), centre - half) * F.col("lower"), F.least(F.lit(1.0), centre + half) * F.col("upper")
        out += [
            F.when(F.col("is_exact"), F.col(count)).otherwise(share * F.col("estimate")).alias(f"{name}_estimate"),
            F.when(F.col("is_exact"), F.col(count)).otherwise(low).alias(f"{name}_lower"),
            F.when(F.col("is_exact"), F.col(count)).otherwise(high).alias(f"{name}_upper"),
        ]
    keep = [c for c in pairs.columns if c not in (left, right)]
    return rows.select(*keep, *out)
