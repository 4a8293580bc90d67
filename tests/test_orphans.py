"""Problem 4: orphan references."""

import datetime as dt
import random

from millrace.operators.orphans import orphan_counts, orphan_references
from tests.conftest import rows

CHILD, PARENT = "r bigint, f bigint, load timestamp_ntz, d date, kind string", "k bigint, load timestamp_ntz, gone timestamp_ntz, reference int"
ARGS = {"table_name": "c", "record": "r", "reference": "f", "loaded": "load", "period": "d", "parent_key": "k", "parent_loaded": "load", "parent_deleted": "gone"}


def at(h):
    return None if h is None else dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)


def plain(children, parents):
    low = lambda values: min((v for v in values if v is not None), default=None)
    out = []
    for r in {c[0] for c in children if c[0] is not None and c[1] is not None}:
        own = [c for c in children if c[0] == r]
        load, ref = low(c[2] for c in own), own[0][1]
        there = [p for p in parents if p[0] == ref]
        gone, since = low(p[2] for p in there), low(p[1] for p in there)
        kind = None
        if not there:
            kind = "missing"
        elif gone is not None and load is not None and gone <= load:
            kind = "deleted"
        elif since is not None and (load is None or since > load):
            kind = "late"
        if kind:
            out.append(("c", r, kind))
    return sorted(out, key=repr)


def test_against_plain(spark):
    for seed in range(4):
        rng = random.Random(seed)
        ref = {r: rng.choice([None, 1, 1, 1, *range(2, 12)]) for r in range(60)}  # 1 is hot
        children = [(r, ref[r], at(rng.choice([None, *range(30)])), dt.date(2025, rng.randrange(1, 13), 1), "x") for r in [*range(60), *rng.choices(range(60), k=30)]] + [(None, 3, at(1), None, "x")]
        parents = [(rng.choice([None, *range(1, 9)]), at(rng.choice([None, *range(30)])), at(rng.choice([None, None, *range(30)])), 1) for _ in range(14)]
        got = orphan_references(spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT), **ARGS)
        assert rows(got, "table_name", "record_key", "kind") == plain(children, parents)


def test_empty_tables(spark):
    none_c, none_p = spark.createDataFrame([], CHILD), spark.createDataFrame([], PARENT)
    one = spark.createDataFrame([(1, 2, at(0), dt.date(2025, 3, 9), "x"), (2, None, at(0), None, "x")], CHILD)
    assert orphan_references(none_c, none_p, **ARGS).count() == 0
    missing = orphan_references(one, none_p, **ARGS)
    assert rows(missing) == [("c", 1, "missing", dt.date(2025, 3, 9))]
    assert rows(orphan_counts(missing)) == [("c", "missing", dt.date(2025, 3, 1), 1)]


def test_equal_times(spark):
    """Deleted at the load is deleted; loaded at the same time is not late."""
    child = spark.createDataFrame([(1, 1, at(5), None, ""), (2, 2, at(5), None, ""), (3, 3, at(5), None, "")], CHILD)
    parent = spark.createDataFrame([(1, at(0), at(5), 0), (2, at(5), None, 0), (3, at(6), at(9), 0)], PARENT)
    assert rows(orphan_references(child, parent, **ARGS), "record_key", "kind") == [(1, "deleted"), (3, "late")]


def test_a_hot_reference_is_split(spark):
    """A missing reference that most records share: the join back splits its rows over several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    child = spark.range(0, 40_000, 1, 8).selectExpr("id AS r", "if(id % 10 = 0, id, -1) AS f", "timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS load", "date'2025-01-01' AS d", "'x' AS kind")
    parent = spark.range(1000).selectExpr("id * 10 AS k", "timestamp_ntz'2024-01-01 00:00:00' AS load", "cast(null AS timestamp_ntz) AS gone", "0 AS reference")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = orphan_references(child, parent, **ARGS)
        assert got.count() == 36_000 + 3_000
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
