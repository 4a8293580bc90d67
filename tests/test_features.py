"""Problem 1: features per entity, against a plain version on small tables."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.operators import features
from millrace.operators.features import entity_features, expand_vectors, merge_vectors, sparse_vectors
from tests.conftest import rows

ARGS = {"entity": "e", "kind": "k", "at": "d", "record": "r", "basket": "b"}
SCHEMA = "e bigint, k int, d date, r bigint, b bigint, idx string, lines int"
AS_OF = dt.date(2025, 12, 31)


def plain(data, types):
    lines, out = {}, {}
    for e, k, d, r, b, *_ in data:
        if e is None:
            continue
        out.setdefault(e, defaultdict(lambda: [0, set(), None]))
        if k in types:
            lines[(e, k, b, r)] = max([x for x in (lines.get((e, k, b, r)), d) if x is not None], default=None)
    for (e, k, b, _), d in lines.items():
        cell = out[e][k]
        cell[0] += 1
        if b is not None:
            cell[1].add(b)
        if d is not None:
            cell[2] = d if cell[2] is None else max(cell[2], d)
    return sorted(
        [(e, *(cells[k][0] if k in cells else 0 for k in types), *(len(cells[k][1]) if k in cells else 0 for k in types),
          *((AS_OF - cells[k][2]).days if k in cells and cells[k][2] else None for k in types)) for e, cells in out.items()], key=repr
    )


def sample(n, seed, hot=0.5):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, dt.date(2025, 1, 1) + dt.timedelta(rng.randrange(400)), dt.date(2099, 12, 31)])
    data = [(1 if rng.random() < hot else rng.choice([None, 2, 3, -9]), rng.choice([None, 10, 20, 30, 99]), day(), rng.choice([None, *range(n)]), rng.choice([None, *range(8)]), "x", 5) for _ in range(n)]
    return data + rng.choices(data, k=n // 3)


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    data, types = sample(300, seed), [10, 20, 30]
    kinds = spark.createDataFrame([(20,), (10,), (30,), (30,), (None,)], "t int")
    got = entity_features(spark.createDataFrame(data, SCHEMA).repartition(5), kinds, type_id="t", as_of="2025-12-31", **ARGS)
    assert got.columns == ["e"] + [f"{k}_{i:03d}" for k in ("lines", "purchases", "days") for i in range(3)]
    assert rows(got) == plain(data, types)


def test_purchases_that_are_cut(spark, monkeypatch):
    """A purchase whose lines come in several tables, and whose types repeat, counts once per type."""
    monkeypatch.setattr(features, "LINES", 7)
    data = sample(300, 5, hot=0.9) + [(1, 10, AS_OF, 1000 + i, 3, "", 0) for i in range(60)]
    kinds = spark.createDataFrame([(10,), (20,), (30,)], "t int")
    got = entity_features(spark.createDataFrame(data, SCHEMA).repartition(3), kinds, type_id="t", as_of="2025-12-31", **ARGS)
    assert rows(got) == plain(data, [10, 20, 30])


def test_vectors_of_bounded_size(monkeypatch):
    """An entity with many types gets several vectors, and one with many vectors is merged as they come."""
    monkeypatch.setattr(features, "VECTOR_CELLS", 3)
    monkeypatch.setattr(features, "MERGE_CELLS", 10)
    e, i = np.repeat([1, 2, 3], [7, 3, 1]), np.r_[np.arange(7), np.arange(3), 5]
    cells = (e, i, np.ones(11, np.int64), np.ones(11, np.int64), i.astype(np.int64))
    (batch,) = features._vectors(cells)
    assert [len(x) for x in batch.column("idx").to_pylist()] == [3, 3, 1, 3, 1] and batch.column("entity").to_pylist() == [1, 1, 1, 2, 3]
    parts = list(features._flat(iter([batch.slice(0, 3)] * 20 + [batch.slice(3, 1)] * 2 + [batch.slice(4)])))
    merged = [np.concatenate(c) for c in zip(*parts)]
    assert len(parts) > 1 and merged[0].tolist() == e.tolist() and merged[1].tolist() == i.tolist()
    assert merged[2].tolist() == [20] * 7 + [2] * 3 + [1] and merged[4].tolist() == i.tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    kinds = spark.createDataFrame([(7,)], "t int")
    got = entity_features(none, kinds, type_id="t", as_of="2025-12-31", **ARGS)
    assert got.columns == ["e", "lines_000", "purchases_000", "days_000"] and got.count() == 0
    one = spark.createDataFrame([(1, 7, AS_OF, 1, 1, "", 0)], SCHEMA)
    assert rows(entity_features(one, spark.createDataFrame([], "t int"), type_id="t", as_of="2025-12-31", **ARGS)) == [(1,)]


def test_partial_vectors_merge(spark):
    """Vectors of disjoint purchases add up to those of all."""
    data = [(1, 10, AS_OF, i, i % 4, "", 0) for i in range(20)] + [(2, 20, AS_OF, 100 + i, i, "", 0) for i in range(5)]
    types = spark.createDataFrame([(10,), (20,)], "type_id int")
    parts = [sparse_vectors(spark.createDataFrame([r for r in data if r[4] % 2 == k], SCHEMA), types, **ARGS) for k in (0, 1)]
    merged = merge_vectors(parts[0].unionAll(parts[1]))
    assert merged.count() == 2
    assert rows(expand_vectors(merged, 2, "2025-12-31")) == [(1, 20, 0, 4, 0, 0, None), (2, 0, 5, 0, 5, None, 0)]


def test_too_many_types(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_TYPES", 2)
    with pytest.raises(ValueError):
        entity_features(spark.createDataFrame([], SCHEMA), spark.range(3), type_id="id", as_of="2025-12-31", **ARGS)
