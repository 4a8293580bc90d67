"""Per-key results where a few keys hold most records (problem 2).

Work is split as the input is, or by record, never by key. Each task encodes the keys it sees as dense codes and counts
them with bincount into accumulator arrays; the arrays are cut into blocks of keys, and the blocks of all tasks are
summed. However hot a key is, it is one number per task when it moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.arrowops import columns_of, group_starts, ints, local_aggregate, narrow_rows, whole_groups

#: Key slices that accumulator arrays are cut into; the slices are summed independently.
BLOCKS = 4096
#: Rows a task counts at once.
STEP_ROWS = 1 << 20
#: Keys that a task's accumulators hold before they are sent; bounds its memory.
MOST_KEYS = 1 << 22

ARRAYS = T.StructType(
    [T.StructField("field_name", T.StringType()), T.StructField("block", T.IntegerType())]
    + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("keys", "rows", "purchases")]
)
RESULT = T.StructType(
    [T.StructField("field_name", T.StringType()), T.StructField("key_value", T.LongType()), T.StructField("n_rows", T.LongType()), T.StructField("n_purchases", T.LongType())]
)


def _block(keys: np.ndarray) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BLOCKS.bit_length() + 1)).astype(np.int32)


class Accumulator:
    """Sums of rows and purchases by key: a growing dictionary of keys and dense arrays by code."""

    def __init__(self) -> None:
        self.keys, self.sums = np.empty(0, np.int64), np.empty((2, 0), np.int64)

    def add(self, keys: np.ndarray, rows: np.ndarray, purchases: np.ndarray) -> None:
        both = np.concatenate((self.keys, keys))
        dictionary, code = np.unique(both, return_inverse=True)
        sums = np.zeros((2, len(dictionary)), np.int64)
        for total, old, new in zip(sums, self.sums, (rows, purchases)):
            total[code[: len(self.keys)]] = old
            new_code = code[len(self.keys) :]
            if len(new) and (high := int(new.max(initial=0))) * len(new) < 1 << 52:  # bincount sums in doubles: exact below 2^53
                total += np.bincount(new_code, new if high > 1 or new.min() != 1 else None, len(dictionary)).astype(np.int64)
            else:
                np.add.at(total, new_code, new)
        self.keys, self.sums = dictionary, sums


def _emit(field: str, held: Accumulator) -> Iterator[pa.RecordBatch]:
    """The arrays by block; keys as differences to the one before in the block, which compress well."""
    if not len(held.keys):
        return
    block = _block(held.keys)
    order = np.argsort(block, kind="stable")
    block = block[order]
    starts = group_starts(block)
    keys = held.keys[order]
    steps = np.diff(keys, prepend=0)
    steps[starts] = keys[starts]
    offsets = pa.array(np.append(starts, len(block)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (steps, *(x[order] for x in held.sums))]
    yield pa.RecordBatch.from_arrays([pa.array([field] * len(starts)), pa.array(block[starts]), *lists], names=ARRAYS.names)


def _accumulated(parts: Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Accumulator arrays of a task. parts: per field keys, rows and purchases."""
    sums = [Accumulator() for _ in fields]
    for part in parts:
        for i, (keys, rows, purchases) in enumerate(part):
            sums[i].add(keys, rows, purchases)
            if len(sums[i].keys) > MOST_KEYS:
                yield from _emit(fields[i], sums[i])
                sums[i] = Accumulator()
    for name, held in zip(fields, sums):
        yield from _emit(name, held)


def _summed(arrays: DataFrame) -> DataFrame:
    """The blocks of all tasks, summed: RESULT."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Accumulator] = {}
        for b in batches:
            sizes = b.column("keys").value_lengths().to_numpy(zero_copy_only=False)
            code = b.column("field_name").dictionary_encode()
            steps, rows, purchases = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("keys", "rows", "purchases"))
            starts = np.cumsum(sizes) - sizes
            keys = np.cumsum(steps)
            keys -= np.repeat(keys[starts] - steps[starts], sizes)
            field = np.repeat(code.indices.to_numpy(), sizes)
            for i, name in enumerate(code.dictionary.to_pylist()):
                own = field == i
                sums.setdefault(name, Accumulator()).add(keys[own], rows[own], purchases[own])
        for name, held in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(held.keys), pa.string()), pa.array(held.keys), *map(pa.array, held.sums)], names=RESULT.names)

    return arrays.repartition("field_name", "block").mapInArrow(reduce, RESULT)


def row_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """The columns of key_counts with n_rows only (n_purchases is 0): counted on the input splits as they are read, so
    that nothing but the arrays moves."""
    keys = df.select(*(F.col(f).cast("bigint").alias(f"key_{i}") for i, f in enumerate(fields)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        held: list[pa.RecordBatch] = []
        size = 0

        def part() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            values = [c.combine_chunks().drop_null().to_numpy() for c in pa.Table.from_batches(held).columns]
            return [(v, np.ones(len(v), np.int64), np.zeros(len(v), np.int64)) for v in values]

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= STEP_ROWS:
                yield part()
                held, size = [], 0
        if held:
            yield part()

    return _summed(narrow_rows(keys).mapInArrow(lambda batches: _accumulated(parts(batches), fields), ARRAYS))


def key_counts(df: DataFrame, fields: list[str], record: str) -> DataFrame:
    """Rows and different records of every non-null value of each field: field_name, key_value, n_rows, n_purchases.

    All rows count in n_rows, copies too. n_purchases counts different non-null values of record. Null field values are
    no keys. Fields must be integers. An empty df gives no rows; other columns are not read.

    Records meet in one task each, after copies were combined where they are read: a row per record moves, whatever keys
    are hot. Rows without a record are spread by their keys.
    """
    names = [f"key_{i}" for i in range(len(fields))]
    keys = [F.col(f).cast("bigint").alias(n) for f, n in zip(fields, names)]
    rows = local_aggregate(df.select(F.col(record).cast("bigint").alias("record"), *keys, F.lit(1).cast("bigint").alias("rows")), ["record", *names], {"rows": "sum"})
    alone = [F.when(F.col("record").isNull(), F.col(n)) for n in names]
    split = rows.repartition("record", *alone).sortWithinPartitions("record")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        for table in whole_groups(batches, ["record"], STEP_ROWS, together=False):
            part = []
            for n in names:
                own = table.filter(table[n].is_valid())
                key, rec, many = columns_of(own, [n, "record", "rows"])
                known = own["record"].is_valid().to_numpy()
                order = np.lexsort((key, rec, known))
                first = np.zeros(len(key), np.int64)
                first[order[group_starts(known[order], rec[order], key[order])]] = 1
                part.append((key, many, first * known))
            yield part

    return _summed(narrow_rows(split).mapInArrow(lambda batches: _accumulated(parts(batches), fields), ARRAYS))


def heavy_keys(df: DataFrame, fields: list[str], share: int = 50) -> DataFrame:
    """field_name, key_value of every value that at least one in `share` rows of df holds (null is no value, but its
    rows count). At most `share` values per field can be heavy."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return row_counts(df, fields).where(F.col("n_rows") * share >= total).select("field_name", "key_value")
