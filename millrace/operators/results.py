"""Results: materialised, scrollable, in batches, explained."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from millrace.functions.misc import with_sequence
from millrace.session import ensure_checkpoint_dir

#: EXPLAIN's kinds by the plan they show.
EXPLAIN = {"logical": "logical", "analyzed": "analyzed", "optimized": "optimizedPlan", "executed": "executedPlan"}


def materialized(df: DataFrame) -> DataFrame:
    """df computed once, into a checkpoint in the shared folder: it outlives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def result_batches(df: DataFrame, size: int = 1000) -> Iterator[list[Row]]:
    """The rows in lists of `size`, a partition at a time (the next one is computed meanwhile): the driver holds two."""
    held: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


class ScrollResult:
    """A scroll-insensitive result: materialised rows with numbers from 1, read in any order of places."""

    def __init__(self, df: DataFrame, order: list[Column]):
        self.rows = materialized(with_sequence(df, "_place", order))
        self.n = self.rows.count()
        self.at = 0

    def absolute(self, n: int) -> Row | None:
        """The n-th row, from the end for n < 0; None before the first and after the last."""
        self.at = max(0, min(n if n >= 0 else self.n + 1 + n, self.n + 1))
        return self.rows.where(F.col("_place") == self.at).drop("_place").first()

    def relative(self, n: int) -> Row | None:
        return self.absolute(max(0, self.at + n))

    def next(self) -> Row | None:
        return self.relative(1)

    def previous(self) -> Row | None:
        return self.relative(-1)


def explained(df: DataFrame, kind: str = "executed") -> str:
    """A plan as text: logical, analyzed, optimized or executed."""
    return getattr(df._jdf.queryExecution(), EXPLAIN[kind.lower()])().toString()
