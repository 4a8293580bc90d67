"""Problem 5: distinct counts from the k smallest hashes."""

import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import kmv
from tests.conftest import rows

SCHEMA = "g int, id bigint, hashes string, estimate int"


def test_small_groups_are_exact(spark, monkeypatch):
    monkeypatch.setattr(kmv, "STEP", 20)
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 1, 2]), rng.choice([None, *range(-20, 20)]), "", 0) for _ in range(500)]
    got = kmv.estimates(kmv.build_sketches(spark.createDataFrame(data, SCHEMA).repartition(6), {"g": F.col("g")}, F.col("id")))
    want = sorted(((g, float(len({x for h, x, *_ in data if h == g and x is not None}))) for g in {None, 1, 2}), key=repr)
    assert rows(got, "g", "estimate") == want and all(r.is_exact and r.lower == r.upper == r.estimate for r in got.collect())


def test_kept_hashes_are_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(kmv, "STEP", 200)
    df = spark.range(5000).selectExpr("id % 3 AS g", "id % 2100 AS id")
    for r in kmv.build_sketches(df.repartition(7), {"g": F.col("g")}, F.col("id"), k=64).collect():
        ids = np.array([i for i in range(2100) if any(j % 3 == r.g for j in range(i, 5000, 2100))])
        assert r.hashes == sorted(kmv.mixed(ids).tolist())[:64]


def test_bounds_hold_and_merge(spark):
    """Parts merged give the sketch of the whole; about 95 % of the bounds hold."""
    df = spark.range(200_000).selectExpr("id % 20 AS g", "id * 7919 AS id")
    fine = kmv.build_sketches(df, {"g": F.col("g")}, F.col("id"), k=256)
    est = kmv.estimates(fine, 256).collect()
    assert sum(r.lower <= 10_000 <= r.upper for r in est) >= 17
    whole = kmv.build_sketches(df, {}, F.col("id"), k=256).collect()
    assert kmv.merge_sketches(fine, [], 256).collect() == whole


def test_set_operations(spark):
    a, b = spark.range(0, 30_000), spark.range(20_000, 60_000)
    sk = lambda d, n, k: kmv.build_sketches(d.withColumn("k", F.lit(1)), {"k": F.col("k")}, F.col("id"), k).withColumnRenamed("hashes", n)
    r = kmv.set_estimates(sk(a, "x", 1024).join(sk(b, "y", 1024), "k"), "x", "y", 1024).first()
    for name, true in (("union", 60_000), ("intersection", 10_000), ("difference", 20_000)):
        assert r[f"{name}_lower"] <= true <= r[f"{name}_upper"]
    small = kmv.set_estimates(sk(spark.range(5), "x", 64).join(sk(spark.range(3, 9), "y", 64), "k"), "x", "y", 64).first()
    assert (small.union_estimate, small.intersection_estimate, small.difference_estimate, small.is_exact) == (9.0, 2.0, 3.0, True)
    none = kmv.set_estimates(spark.createDataFrame([(1, None, None)], "k int, x array<bigint>, y array<bigint>"), "x", "y").first()
    assert none.union_estimate == none.intersection_estimate == none.difference_upper == 0.0


def test_other_types_and_empty(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "s string")
    assert kmv.estimates(kmv.build_sketches(df, {}, F.col("s"))).first().estimate == 2.0
    assert kmv.build_sketches(df.limit(0), {}, F.col("s")).count() == 0
