"""Structured Streaming over files of events: windows, sessions, de-duplication, sinks (an extension of the dialect).

State is bounded by the watermark throughout: windows and sessions are given out once they are closed (append mode), keys
and custom state are forgotten after it, and rows that come later than it allows are dropped.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources.writers import scratch


#: Files of a batch.
MAX_FILES = 100


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = MAX_FILES) -> DataFrame:
    """Parquet files below path (or matching it) as a stream; event times as timestamps, as watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def timed(stream: DataFrame, at: str, delay: str) -> DataFrame:
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def tumbling(stream: DataFrame, at: str, size: str, keys: list[str], aggs: list, slide: str | None = None) -> DataFrame:
    """Aggregates per window of `size` (sliding by `slide`) and keys: window_start, keys, aggs."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    grouped = stream.groupBy(w.alias("w"), *keys).agg(*aggs)
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, *grouped.columns[1 + len(keys) :])


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], aggs: list) -> DataFrame:
    """Aggregates per session of keys: events less than `gap` apart."""
    w = F.session_window(at, gap)
    grouped = stream.groupBy(w.alias("w"), *keys).agg(*aggs)
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), *keys, *grouped.columns[1 + len(keys) :])


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key; copies that come within the watermark are dropped, after it the key is forgotten."""
    return stream.dropDuplicatesWithinWatermark(keys)


#: A time beyond all events: a row of it moves the watermark past every open window.
END = dt.datetime(2200, 1, 1)


def _folder(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    return path


def _run(stream: DataFrame, out: str, mode: str, progress: list[dict] | None) -> None:
    """All that is there now, written by foreachBatch: a batch that is run again after a failure writes the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if progress is not None and query.lastProgress:
        progress += [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def drained(path: str, source: DataFrame, at: str, delay: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", progress: list[dict] | None = None) -> DataFrame:
    """The result of build(stream) over the files of path, to the end: a last row beyond all events closes what is open.

    source: a DataFrame of the same files. stream has the event time `at` as a timestamp with a watermark of `delay`.
    In update mode the result has every update, with its batch. progress gets the progress of each batch.
    """
    spark = source.sparkSession
    out = scratch(spark, "stream")
    closing = _folder(spark, f"{out}/closing")
    stream = file_stream(spark, path, source.schema).unionByName(file_stream(spark, closing, source.schema))
    result = build(timed(stream, at, delay))
    if len(source.inputFiles()) > MAX_FILES:  # else all files come in one batch, and the last row may come with them
        _run(result, out, mode, progress)
    _close(spark, source, at, closing)
    _run(result, out, mode, progress)
    return _result(result, out, mode)


def replayed(parts: list[DataFrame], at: str, delay: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", progress: list[dict] | None = None) -> DataFrame:
    """As drained, but the rows of each part arrive after those of the parts before it."""
    spark = parts[0].sparkSession
    out = scratch(spark, "replay")
    arrived = _folder(spark, f"{out}/arrived")
    result = build(timed(file_stream(spark, f"{arrived}/*", parts[0].schema), at, delay))
    for i, part in enumerate(parts):
        part.write.parquet(f"{arrived}/{i:06d}")
        _run(result, out, mode, progress)
    _close(spark, parts[0], at, f"{arrived}/last")
    _run(result, out, mode, progress)
    return _result(result, out, mode)


def _close(spark: SparkSession, source: DataFrame, at: str, folder: str) -> None:
    last = [F.lit(END if f.name == at else None).cast(f.dataType).alias(f.name) for f in source.schema.fields]
    spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(folder)


def _result(stream: DataFrame, out: str, mode: str) -> DataFrame:
    schema = T.StructType([*stream.schema.fields, *([T.StructField("batch", T.LongType())] if mode == "update" else [])])
    return stream.sparkSession.read.schema(schema).parquet(f"{out}/result").select(*schema.names)


def running_totals(stream: DataFrame, key: str, value: str, at: str, idle: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """A custom stateful operator: number and sum of each key so far, given out once per batch that touches it.

    A key's state is forgotten once the watermark is `idle` beyond its last event; rows with a null key make a group.
    """
    kind = stream.schema[key].dataType.simpleString()
    out, state = f"`{key}` {kind}, n bigint, total double", "n bigint, total double, last bigint"
    wait = int(idle.total_seconds() * 1000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        n, total, last = held.get if held.exists else (0, 0.0, 0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame[value].sum())
            if pd.notna(latest := frame[at].max()):
                last = max(last, int(latest.timestamp() * 1000))
        held.update((n, total, last))
        held.setTimeoutTimestamp(max(last + wait, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return stream.select(key, value, at).groupBy(key).applyInPandasWithState(step, out, state, "update", GroupStateTimeout.EventTimeTimeout)


def into_table(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Micro-batches into any batch sink, as an adapter's insert does."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
