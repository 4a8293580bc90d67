"""Problem 2: counts per key under skew."""

import random
from collections import Counter

import numpy as np

from millrace.operators import balance
from millrace.operators.balance import Accumulator, heavy_keys, key_counts, row_counts
from tests.conftest import rows

SCHEMA = "store smallint, person bigint, h bigint, keys int, field string"


def sample(n, seed):
    rng = random.Random(seed)
    data = [(rng.choice([1, 1, 1, 2, None, -5]), rng.choice([7, 7, None, -(2**62), *range(50)]), rng.choice([None, *range(n // 2)]), 0, "f") for _ in range(n)]
    return data + [data[0]] * (n // 2)  # a group of copies holds a third of all rows


def plain(data):
    out = []
    for i, name in enumerate(("store", "person")):
        n = Counter(r[i] for r in data if r[i] is not None)
        out += [(name, k, c, len({r[2] for r in data if r[i] == k and r[2] is not None})) for k, c in n.items()]
    return sorted(out, key=repr)


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(balance, "STEP_ROWS", 50)
    data = sample(400, 1)
    assert rows(key_counts(spark.createDataFrame(data, SCHEMA).repartition(6), ["store", "person"], "h")) == plain(data)


def test_heavy_keys(spark):
    data = sample(400, 2)
    want = sorted(((name, k) for name, k, n, _ in plain(data) if n * 50 >= len(data)), key=repr)
    assert rows(heavy_keys(spark.createDataFrame(data, SCHEMA), ["store", "person"])) == want


def test_empty_and_null(spark):
    assert key_counts(spark.createDataFrame([], SCHEMA), ["store", "person"], "h").count() == 0
    assert heavy_keys(spark.createDataFrame([(None, None, None, 0, "")], SCHEMA), ["store"]).count() == 0


def test_accumulator_is_exact_beyond_doubles():
    a = Accumulator()
    for _ in range(2):
        a.add(np.array([5, 5, 9]), np.array([2**53, 1, 3]), np.array([1, 1, 0]))
    assert a.keys.tolist() == [5, 9] and a.sums.tolist() == [[2**54 + 2, 6], [4, 0]]


def test_heavy_keys_move_no_records(spark):
    """Rows are counted on the input splits: nothing is exchanged before the arrays are."""
    df = spark.range(20_000).selectExpr("cast(if(id % 100 = 0, id, 1) as bigint) AS person", "id AS h")
    plan = row_counts(df, ["person"])._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "block" in moved[0] and "person" not in moved[0]


def test_purchases_move_once(spark):
    df = spark.range(20_000).selectExpr("cast(id % 7 as bigint) AS store", "cast(if(id % 100 = 0, id, 1) as bigint) AS person", "id AS h")
    plan = key_counts(df, ["store", "person"], "h")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_arrays_are_sent_before_they_grow(spark, monkeypatch):
    monkeypatch.setattr(balance, "MOST_KEYS", 10)
    monkeypatch.setattr(balance, "STEP_ROWS", 20)
    data = sample(300, 3)
    parts = balance._accumulated(iter([[(np.arange(i, i + 8), np.ones(8, np.int64), np.zeros(8, np.int64))] for i in range(0, 40, 4)]), ["f"])
    assert len(list(parts)) > 1
    assert rows(key_counts(spark.createDataFrame(data, SCHEMA).repartition(3), ["store", "person"], "h")) == plain(data)


def test_extreme_keys(spark):
    data = [(None, k, 1, 0, "") for k in (-(2**63), 2**63 - 1, 0, -1, 2**63 - 1)]
    assert rows(key_counts(spark.createDataFrame(data, SCHEMA), ["person"], "h")) == plain([(None, *r[1:]) for r in data])
