"""Problem 3: pairs of items in baskets."""

import math
import random
from collections import Counter
from itertools import combinations

from millrace.llm import pairs
from millrace.llm.pairs import frequent_pairs, pair_statistics
from tests.conftest import rows

SCHEMA = "b bigint, i int, n bigint, a string"


def sample(n, seed):
    rng = random.Random(seed)
    data = [(rng.choice([None, 0, 0, 0, *range(n // 4)]), rng.choice([None, *range(-2, 12)]), 1, "") for _ in range(n)]
    return data + [data[1]] * (n // 2)


def plain(data):
    baskets = {}
    for b, i, *_ in data:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    one, two = Counter(i for s in baskets.values() for i in s), Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {(a, b): (n, one[a], one[b], len(baskets)) for (a, b), n in two.items()}


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(pairs, "STEP_PAIRS", 40)
    for seed in range(3):
        data = sample(300, seed)
        got = {(r.item_a, r.item_b): r for r in pair_statistics(spark.createDataFrame(data, SCHEMA).repartition(5), "b", "i").collect()}
        want = plain(data)
        assert {k: (r.n_both, r.n_a, r.n_b, r.n_baskets) for k, r in got.items()} == want
        for k, (n, a, b, total) in want.items():
            assert math.isclose(got[k].lift, n * total / a / b) and math.isclose(got[k].pmi, math.log(n * total / a / b), abs_tol=1e-12)


def test_frequent(spark):
    data = sample(400, 9)
    want = sorted((k for k, (n, a, b, total) in plain(data).items() if n >= 2 and n * 1000 >= total and n * total >= 1 * a * b), key=repr)
    assert rows(frequent_pairs(spark.createDataFrame(data, SCHEMA), "b", "i", "x", "y", least=2, times=1)) == want


def test_empty_and_single(spark):
    for data in ([], [(1, 1, 0, "")], [(None, 1, 0, ""), (1, None, 0, "")]):
        assert pair_statistics(spark.createDataFrame(data, SCHEMA), "b", "i").count() == 0
