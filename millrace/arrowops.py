"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows that a task gathers before it combines them; bounds the memory of local_aggregate.
FLUSH_ROWS = 1 << 19

_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_OFF, _DEFAULT = 2**31 - 1, 64 << 20


def _limit_bytes(spark: SparkSession, on: bool) -> None:
    if spark.conf.get(_BYTES_PER_BATCH).rstrip("b") in (str(_OFF), str(_DEFAULT)):  # another value is the user's own
        spark.conf.set(_BYTES_PER_BATCH, str(_DEFAULT if on else _OFF))


def narrow_rows(df: DataFrame) -> DataFrame:
    """df, for an operator whose rows have a small bounded size (a few numbers, or lists of at most some hundred).

    While Arrow batches are limited by bytes, Spark measures the batch again for every row that goes to Python, which
    costs ten times what the row does. For such rows the limit of rows a batch suffices, and that of bytes is
    switched off in the session; wide_rows switches it on again. A value of the user's own stays.
    """
    _limit_bytes(df.sparkSession, False)
    return df


def wide_rows(df: DataFrame) -> DataFrame:
    """df, for an operator whose rows may be of any size, as texts: batches are limited by bytes."""
    _limit_bytes(df.sparkSession, True)
    return df


def subset_schema(df: DataFrame, columns: Iterable[str]) -> T.StructType:
    by_name = {f.name: f for f in df.schema.fields}
    return T.StructType([T.StructField(c, by_name[c].dataType, True) for c in columns])


def local_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, str] | None = None) -> DataFrame:
    """Combine equal keys inside each task, without a shuffle.

    For narrow rows, see narrow_rows. Spark only combines before a shuffle on exactly the grouping keys. This is for a shuffle on fewer columns: a
    hot group of copies shrinks to a row per FLUSH_ROWS rows before anything moves, however many rows it has.
    aggs: pyarrow's aggregation by column ("sum", "max", "min"); the results keep the columns' names. Null keys
    are kept as keys. The result is partial: equal keys of different tasks stay apart.
    """
    aggs = aggs or {}
    columns = [*keys, *aggs]
    pairs = list(aggs.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            out = table.group_by(keys, use_threads=False).aggregate(pairs)
            out = out.select([*keys, *(f"{c}_{f}" for c, f in pairs)]).rename_columns(columns)
            yield from out.to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= FLUSH_ROWS:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    return narrow_rows(df).select(*columns).mapInArrow(run, subset_schema(df, columns))


def ints(column: pa.Array, null: int = 0) -> np.ndarray:
    """An integer or date column as int64; null where it is null."""
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    column = column.cast(pa.int64())
    if column.null_count:
        column = column.fill_null(null)
    return column.to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = FLUSH_ROWS, together: bool = True) -> Iterator[pa.Table]:
    """The rows of a task that are sorted by keys, in tables of about `rows` rows that split no group of equal keys;
    rows whose first key is null stay together only if asked for.

    With the sort left to Spark, which spills, a task of any size needs memory for one table, or for one group where that
    is larger. Null is a key.
    """
    held: list[pa.RecordBatch] = []
    n, least = 0, rows
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(n, bool)
        if not together and not table[keys[0]][n - 1].is_valid:
            last[:] = False
        for k in keys:
            column, value = table[k], table[k][n - 1]
            same = pc.equal(column, value).fill_null(False) if value.is_valid else pc.is_null(column)
            last &= same.to_numpy()
        if cut := n - int(last.sum()):
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), n - cut
        least = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def columns_of(table: pa.Table, names: list[str], null: int = 0) -> list[np.ndarray]:
    """Columns as int64; null where they are null."""
    return [ints(table[n].combine_chunks() if table[n].num_chunks != 1 else table[n].chunk(0), null) for n in names]


def group_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Positions at which any of the columns, sorted together, changes; 0 is one of them."""
    n = len(sorted_columns[0])
    if not n:
        return np.empty(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for c in sorted_columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)
