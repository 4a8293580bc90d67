"""Per-entity feature table from events (problem 1).

Event types are encoded as indices 0..n-1. Copies of a line are combined where they are read, the lines of a purchase meet
in one task, and each task turns its purchases into one sparse vector per entity: the indices it saw with lines,
purchases and latest day of each. Such vectors merge by adding and by taking the maximum; they move to the entity's
task, where they are merged and expanded into columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.arrowops import columns_of, group_starts, local_aggregate, narrow_rows, whole_groups

#: More types than this are refused: each one becomes three columns, and the dictionary is broadcast.
MAX_TYPES = 5000
#: Cells of a block of dense vectors while they are expanded.
BLOCK_CELLS = 1 << 20
#: Lines that a task turns into vectors at once.
LINES = 1 << 19
#: Cells of sparse vectors that are merged at once.
MERGE_CELLS = 1 << 20
#: Cells of a sparse vector; an entity with more gets several, so that a row's size is bounded.
VECTOR_CELLS = 128
#: Stands for "no type" among indices and for "no day" among days.
NO_TYPE, NO_DAY = -1, -(1 << 31)

VECTOR = T.StructType(
    [T.StructField("entity", T.LongType())]
    + [T.StructField(n, T.ArrayType(k, False)) for n, k in (("idx", T.IntegerType()), ("lines", T.LongType()), ("purchases", T.LongType()), ("last", T.IntegerType()))]
)
Cells = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _type_values(types: DataFrame, type_id: str) -> list:
    ids = types.select(F.col(type_id).alias("type_id")).where("type_id IS NOT NULL").distinct()
    values = sorted(r[0] for r in ids.limit(MAX_TYPES + 1).collect())  # bounded: one more than is allowed
    if len(values) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types")
    return values


def type_dictionary(types: DataFrame, type_id: str) -> DataFrame:
    """type_id (distinct, not null) with idx, its place in ascending order from 0."""
    return _dictionary(types, type_id, _type_values(types, type_id))


def _dictionary(types: DataFrame, type_id: str, values: list) -> DataFrame:
    schema = T.StructType([T.StructField("type_id", types.schema[type_id].dataType), T.StructField("idx", T.IntegerType())])
    return types.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], schema)


def _vectors(cells: Cells) -> Iterator[pa.RecordBatch]:
    """Sparse vectors of at most VECTOR_CELLS cells, which are sorted by entity and idx. idx NO_TYPE says only that the entity is there."""
    entity = cells[0]
    starts = group_starts(entity)
    if (sizes := np.diff(np.append(starts, len(entity)))).max(initial=0) > VECTOR_CELLS:
        rows = -(-sizes // VECTOR_CELLS)
        nth = np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows)
        starts = np.repeat(starts, rows) + nth * VECTOR_CELLS
    offsets = pa.array(np.append(starts, len(entity)).astype(np.int32))
    kinds = (np.int32, np.int64, np.int64, np.int32)
    arrays = [pa.array(entity[starts]), *(pa.ListArray.from_arrays(offsets, pa.array(v.astype(k, copy=False))) for v, k in zip(cells[1:], kinds))]
    whole = pa.RecordBatch.from_arrays(arrays, names=VECTOR.names)
    for at in range(0, whole.num_rows, 20_000):
        yield whole.slice(at, 20_000)


def _merged(cells: Cells) -> Cells:
    """Cells sorted by entity and idx, equal ones merged."""
    order = np.lexsort((cells[1], cells[0]))
    e, i, n, p, d = (x[order] for x in cells)
    at = group_starts(e, i)
    return e[at], i[at], np.add.reduceat(n, at), np.add.reduceat(p, at), np.maximum.reduceat(d, at)


def sparse_vectors(events: DataFrame, types: DataFrame, *, entity: str, kind: str, at: str, record: str, basket: str) -> DataFrame:
    """Partial sparse vectors (entity, idx[], lines[], purchases[], last[]), merged by merge_vectors.

    Rows of the same record are copies and count once; a record whose copies differ in entity, kind or basket counts
    once under each. Rows without entity are left out. Rows without a known kind only make sure that the entity gets a
    row. Purchases are different baskets (null is none), last is the latest day as days since 1970-01-01.
    """
    return _sparse_vectors(events, type_dictionary(types, "type_id" if "type_id" in types.columns else types.columns[0]), entity, kind, at, record, basket)


def _sparse_vectors(events: DataFrame, dictionary: DataFrame, entity: str, kind: str, at: str, record: str, basket: str) -> DataFrame:
    rows = events.select(
        F.col(entity).cast("bigint").alias("entity"),
        F.col(kind).alias("type_id"),
        F.col(basket).cast("bigint").alias("basket"),
        F.col(record).cast("bigint").alias("record"),
        F.col(at).cast("date").alias("at"),
    ).where("entity IS NOT NULL")
    known = lambda c: F.when(F.col("idx").isNotNull(), F.col(c)).alias(c)
    rows = rows.join(F.broadcast(dictionary), "type_id", "left").select("entity", F.coalesce("idx", F.lit(NO_TYPE)).alias("idx"), known("basket"), known("record"), known("at"))
    # A hot entity's rows are spread by their baskets, those without one by their records; copies shrink before they move.
    keys = ["entity", "basket", "idx", "record"]
    rows = local_aggregate(rows, keys, {"at": "max"}).repartition("entity", "basket", F.when(F.col("basket").isNull(), F.col("record"))).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the purchase and type that the rows so far ended with: it counts once
        for table in whole_groups(batches, keys, LINES):
            e, b, i, r = columns_of(table, keys)
            (d,) = columns_of(table, ["at"], NO_DAY)
            bn, rn = (table[c].is_null().to_numpy() for c in ("basket", "record"))
            line = group_starts(e, bn, b, i, rn, r)
            d = np.maximum.reduceat(d, line)
            e, b, bn, i = e[line], b[line], bn[line], i[line]
            cell = group_starts(e, bn, b, i)
            bought = (~bn[cell]).astype(np.int64)
            if before == (e[0], b[0], i[0]):
                bought[0] = 0
            before = None if bn[-1] else (e[-1], b[-1], i[-1])
            lines = np.diff(np.append(cell, len(line)))
            yield from _vectors(_merged((e[cell], i[cell], lines, bought, np.maximum.reduceat(d, cell))))

    return narrow_rows(rows).mapInArrow(run, VECTOR)


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[Cells]:
    """Cells of vectors sorted by entity, merged, some whole entities at a time; an entity of any number of vectors is
    merged as they come."""
    held: list[Cells] = []
    size, least = 0, MERGE_CELLS
    for b in batches:
        vector_sizes = np.asarray(pc.list_value_length(b.column("idx")))
        held.append((np.repeat(b.column("entity").to_numpy(), vector_sizes), *(pc.list_flatten(b.column(c)).to_numpy() for c in VECTOR.names[1:])))
        size += len(held[-1][0])
        if size >= least:
            cells = _merged(tuple(map(np.concatenate, zip(*held))))
            last = np.searchsorted(cells[0], cells[0][-1])
            if last:
                yield tuple(c[:last] for c in cells)
            held = [tuple(c[last:] for c in cells)]
            size = len(held[0][0])
            least = max(MERGE_CELLS, 2 * size)
    if size:
        yield _merged(tuple(map(np.concatenate, zip(*held))))


def _by_entity(vectors: DataFrame) -> DataFrame:
    return narrow_rows(vectors).repartition("entity").sortWithinPartitions("entity")


def merge_vectors(vectors: DataFrame) -> DataFrame:
    """One vector per entity (several if it has more than VECTOR_CELLS cells). Purchases add up, so vectors that are merged must not share a purchase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _flat(batches):
            yield from _vectors(cells)

    return _by_entity(vectors).mapInArrow(run, VECTOR)


def expand_vectors(vectors: DataFrame, n_types: int, as_of: str, entity: str = "entity") -> DataFrame:
    """One row per entity: lines_000.., purchases_000.. (0 where nothing was bought) and days_000.. (null there).

    days: from the last day to as_of; below zero if it is later.
    """
    width = max(3, len(str(n_types - 1)))
    names = [f"{k}_{i:0{width}d}" for k in ("lines", "purchases", "days") for i in range(n_types)]
    kinds = [(T.LongType(), False)] * (2 * n_types) + [(T.IntegerType(), True)] * n_types
    schema = T.StructType([T.StructField(entity, T.LongType())] + [T.StructField(n, *k) for n, k in zip(names, kinds)])
    end = int(np.datetime64(as_of, "D").astype(np.int64))
    block = max(1, BLOCK_CELLS // max(1, n_types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _flat(batches):
            yield from dense(*cells)

    def dense(e: np.ndarray, i: np.ndarray, n: np.ndarray, p: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = group_starts(e)
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(e))))
        for low in range(0, len(first), block):
            high = min(low + block, len(first))
            a, b = np.searchsorted(row, (low, high))
            known = np.flatnonzero(i[a:b] >= 0) + a
            cell = (i[known], row[known] - low)
            counts = np.zeros((2, n_types, high - low), np.int64)
            counts[0][cell], counts[1][cell] = n[known], p[known]
            days, bought = np.zeros((n_types, high - low), np.int32), np.zeros((n_types, high - low), bool)
            dated = known[d[known] != NO_DAY]
            cell = (i[dated], row[dated] - low)
            days[cell], bought[cell] = end - d[dated], True
            arrays = [pa.array(e[first[low:high]])]
            arrays += [pa.array(column) for matrix in counts for column in matrix]
            arrays += [pa.array(column, mask=~there) for column, there in zip(days, bought)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return _by_entity(vectors).mapInArrow(run, schema)


def entity_features(events: DataFrame, types: DataFrame, *, type_id: str, entity: str, kind: str, at: str, record: str, basket: str, as_of: str) -> DataFrame:
    """One row per entity of events, with lines, purchases and days since the last one for each type.

    types.type_id holds the types (at most MAX_TYPES; null and repeated ids are ignored); the number in a column's
    name is the type's place in ascending order, see type_dictionary. An entity all of whose rows lack a known type
    gets a row of zeros. Empty events give no row, with the same columns. Other columns of the inputs are not read.
    """
    values = _type_values(types, type_id)
    vectors = _sparse_vectors(events, _dictionary(types, type_id, values), entity, kind, at, record, basket)
    return expand_vectors(vectors, len(values), as_of, entity)
