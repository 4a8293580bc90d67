"""User-defined functions, aggregates, table functions and types: all vectorised or declarative."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scalar_function(f: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """CREATE FUNCTION of a scalar function that takes and gives whole Arrow batches."""
    return F.pandas_udf(f, returns)


def register(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str) -> None:
    """Make a vectorised function known to SQL."""
    spark.udf.register(name, F.pandas_udf(f, returns))


def aggregate(df: DataFrame, keys: list[str], value: str, *, init: Callable, accumulate: Callable, merge: Callable, terminate: Callable, name: str, returns: str) -> DataFrame:
    """CREATE AGGREGATE with init, accumulate (state, values), merge and terminate.

    Each task accumulates its share of a group into one state; only states move, so that a hot group is no burden. States
    are pickled. Null values are left out; a group without values has the terminated initial state.
    """
    import pickle

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "state binary"])
    out = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"`{name}` {returns}"])

    def states(frame: pd.DataFrame, fold: Callable) -> dict:
        groups = frame.groupby(keys, dropna=False, sort=False) if keys else [((), frame)]
        return {k if isinstance(k, tuple) else (k,): fold(g) for k, g in groups}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}
        for frame in batches:
            for k, s in states(frame, lambda g: accumulate(init(), g[value].dropna())).items():
                k = tuple(None if pd.isna(x) else x for x in k)
                held[k] = merge(held[k], s) if k in held else s
        if held:
            yield pd.DataFrame([(*k, pickle.dumps(s)) for k, s in held.items()], columns=[*keys, "state"])

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}
        for frame in batches:
            for *k, s in frame[[*keys, "state"]].itertuples(index=False):
                k, s = tuple(None if pd.isna(x) else x for x in k), pickle.loads(s)
                held[k] = merge(held[k], s) if k in held else s
        if held or not keys:
            yield pd.DataFrame([(*k, terminate(s)) for k, s in (held or {(): init()}).items()], columns=[*keys, name])

    parts = df.select(*keys, value).mapInPandas(partial, schema)
    return (parts.repartition(*keys) if keys else parts.coalesce(1)).mapInPandas(final, out)


@F.udtf(returnType="word string, place int")
class Words:
    """Table function: the words of a text with their place from 1."""

    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        for i, word in enumerate((text or "").split(), 1):
            yield word, i


def word_table(df: DataFrame, column: str) -> DataFrame:
    """The table function as built-in expressions, for large inputs: word and place of each row's text."""
    words = F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda w: w != "")
    return df.select("*", F.posexplode(words).alias("_p", "word")).withColumn("place", F.col("_p") + 1).drop("_p")


def arrow_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    """An Arrow table, or any iterator of rows made into one, as a row source."""
    return spark.createDataFrame(table)
