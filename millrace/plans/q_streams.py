"""Streaming queries over events, run to the end of what is there; each has a batch twin in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.registry import Registry
from millrace.streaming import events as E

registry = Registry()
query = registry.query


def _aggs() -> list:
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")]


def _drained(t: Tables, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    return E.drained(f"{t.folder}/events.parquet*", t.events, "ts", "10 minutes", build, mode)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t: Tables) -> DataFrame:
    return _drained(t, lambda s: E.tumbling(s, "ts", "1 hour", ["event_type"], _aggs()))


@query(
    "stream_sliding",
    """SELECT start_ - INTERVAL (30 * k) MINUTE AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS start_ FROM events), (VALUES (0), (1)) v(k) GROUP BY 1, 2""",
)
def stream_sliding(t: Tables) -> DataFrame:
    return _drained(t, lambda s: E.tumbling(s, "ts", "1 hour", ["event_type"], _aggs(), "30 minutes"))


@query(
    "stream_session",
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM marked)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 20 MINUTE AS session_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM numbered GROUP BY user_id, s""",
)
def stream_session(t: Tables) -> DataFrame:
    return _drained(t, lambda s: E.sessions(s, "ts", "20 minutes", ["user_id"], _aggs()))


@query(
    "stream_late_rows",
    """WITH late AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events WHERE event_id % 10 = 0),
early AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events WHERE event_id % 10 <> 0),
seen AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS watermark FROM early)
SELECT window_start, event_type, count(*) AS n FROM (SELECT * FROM early UNION ALL SELECT late.* FROM late, seen WHERE window_start + INTERVAL 1 HOUR > watermark) GROUP BY 1, 2""",
)
def stream_late_rows(t: Tables) -> DataFrame:
    """A tenth of the events arrive after all others: they count only in windows that the watermark has not closed."""
    parts = [t.events.where("event_id % 10 <> 0"), t.events.where("event_id % 10 = 0")]
    return E.replayed(parts, "ts", "10 minutes", lambda s: E.tumbling(s, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]))


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Events that are delivered twice, each once."""
    twice = lambda s: s.select("ts", "event_id", "user_id", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return _drained(t, lambda s: E.deduplicated(twice(s), ["event_id"]).select("event_id", "user_id", "event_type")).where("event_id IS NOT NULL")


@query("stream_static_join", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_static_join(t: Tables) -> DataFrame:
    """A stream against a table."""
    return _drained(t, lambda s: s.where("event_type = 'purchase'").join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


@query("stream_stateful", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_stateful(t: Tables) -> DataFrame:
    """A custom stateful operator; the last total of each key is kept."""
    updates = _drained(t, lambda s: E.running_totals(s, "event_type", "value", "ts", dt.timedelta(days=400)), "update").where("event_type IS NOT NULL")
    last = updates.groupBy("event_type").agg(F.max_by(F.struct("n", "total"), "n").alias("x"))
    return last.select("event_type", "x.n", F.round("x.total", 4).alias("total"))


@query("events_windowed_batch", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_windowed_batch(t: Tables) -> DataFrame:
    """The same windows over a table."""
    return E.tumbling(t.events, "ts", "1 hour", ["event_type"], _aggs())
