"""Watermarks: late rows, closed windows, bounded state."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.streaming import events as E
from tests.conftest import rows

SCHEMA = "ts timestamp_ntz, k string, v double, id bigint"
START = dt.datetime(2025, 1, 1)


def event(minute, k="a", v=1.0, i=0):
    return (START + dt.timedelta(minutes=minute) if minute is not None else None, k, v, i)


def windows(s):
    return E.tumbling(s, "ts", "10 minutes", ["k"], [F.count(F.lit(1)).alias("n")])


def test_late_rows_are_dropped(spark):
    """A row counts as long as its window is not closed by the watermark, and not after."""
    parts = [[event(m) for m in (1, 12, 47)], [event(2), event(31), event(44)], [event(8), event(None), event(58, None)]]
    got = E.replayed([spark.createDataFrame(p, SCHEMA) for p in parts], "ts", "5 minutes", windows)
    at = lambda m: START + dt.timedelta(minutes=m)
    assert rows(got) == sorted([(at(0), "a", 1), (at(10), "a", 1), (at(40), "a", 2), (at(50), None, 1)], key=repr)


def test_state_is_forgotten(spark):
    parts = [spark.createDataFrame([event(60 * h + m, str(h), 1.0, 100 * h + m) for m in range(0, 60, 5)], SCHEMA) for h in range(6)]
    for build in (windows, lambda s: E.deduplicated(s, ["id"]), lambda s: E.sessions(s, "ts", "7 minutes", ["k"], [F.count(F.lit(1)).alias("n")])):
        progress = []
        got = E.replayed(parts, "ts", "10 minutes", build, progress=progress)
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
        assert max(kept) <= 40 and kept[-1] <= 3  # of 72 events; at the end only the closing row
        assert got.where("id IS NOT NULL" if "id" in got.columns else "k IS NOT NULL").count() in (72, 36, 6)


def test_running_totals_forget_idle_keys(spark):
    parts = [[event(0, "a", 1.0), event(1, "b", 2.0)], [event(30, "b", 3.0), event(90, "c", 1.0)], [event(91, "c", 1.0)], [event(92, "a", 5.0), event(93, "b", 1.0)]]
    progress = []
    build = lambda s: E.running_totals(s, "k", "v", "ts", dt.timedelta(minutes=20))
    got = E.replayed([spark.createDataFrame(p, SCHEMA) for p in parts], "ts", "5 minutes", build, "update", progress)
    last = {r.k: (r.n, r.total) for r in got.where("k IS NOT NULL").orderBy("batch").collect()}
    assert last == {"a": (1, 5.0), "b": (1, 1.0), "c": (2, 2.0)}  # a and b began anew


def test_events_delivered_again(spark):
    first = [event(m, "a", 1.0, m) for m in range(20)]
    got = E.replayed([spark.createDataFrame(p, SCHEMA) for p in (first, first[15:] + [event(25, "a", 1.0, 25)])], "ts", "30 minutes", lambda s: E.deduplicated(s, ["id"]).select("id"))
    assert rows(got.where("id IS NOT NULL")) == sorted([(i,) for i in [*range(20), 25]], key=repr)


def test_many_files(spark, tmp_path, monkeypatch):
    """More files than a batch takes: the closing row comes after all of them."""
    for h in range(4):
        spark.createDataFrame([event(60 * h + m, "a") for m in (1, 2, 15)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{h}")
    path, source = f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/*")
    want = rows(E.drained(path, source, "ts", "1 minute", windows))
    monkeypatch.setattr(E, "MAX_FILES", 1)
    assert rows(E.drained(path, source, "ts", "1 minute", windows)) == want and len(want) == 8
