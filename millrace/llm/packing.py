"""Packing of texts into containers of fixed capacity (problem 7).

Sizes are counted in one pass; everything after it works on the histogram of sizes, which has at most `capacity`
entries however large the corpus is. Patterns of few larger texts are enumerated by class of size; non-negative least
squares fit their repeat counts to the number of texts of each class and their free space to what the small texts need.
The counts are rounded down and the rest is fitted again, until nothing is placed any more; what is left, the small texts
above all, is packed best-fit into the patterns' free space, the largest sizes first. The n-th text of each size then
looks up its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.arrowops import narrow_rows, wide_rows
from millrace.llm.text_encoding import text_encoder
from millrace.llm.vocabulary import default_path
from millrace.session import ensure_checkpoint_dir

CAPACITY = 2048
#: Classes of sizes that patterns are made of, and the part of a container below which a text is in no pattern but fills up
#: what the patterns leave free. Each of these is tried, the plan with the fewest containers is used.
SETTINGS = [(64, 3), (64, 8), (128, 3)]


@lru_cache(maxsize=4)
def patterns_of(classes: int, least: int) -> np.ndarray:
    """Uses of each class (a column per pattern) by every set of classes, repeats allowed, from `least` on that add up to
    at most `classes`."""
    out: list[list[int]] = []

    def extend(chosen: list[int], room: int) -> None:
        for c in range(chosen[-1] if chosen else least, room + 1):
            out.append([*chosen, c])
            extend(out[-1], room - c)

    extend([], classes)
    uses = np.zeros((classes + 1, len(out)))
    for p, chosen in enumerate(out):
        for c in chosen:
            uses[c, p] += 1
    return uses


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method: at most as many entries are positive as a has rows."""
    n = a.shape[1]
    x, used, refused = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    least = tolerance * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    while True:
        gain = a.T @ (b - a @ x)
        gain[used | refused] = -np.inf
        best = int(gain.argmax()) if n else 0
        if not n or gain[best] <= least or used.sum() >= len(b):
            return x
        used[best] = True
        while used.any():
            own = np.flatnonzero(used)
            free = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (free > 0).all():
                x[:] = 0
                x[own] = free
                break
            # go towards it as far as no entry falls below zero; the entries that reach zero are used no longer
            old, low = x[own], free <= 0
            steps = np.full(len(own), np.inf)
            steps[low] = old[low] / np.maximum(old[low] - free[low], 1e-300)
            step = steps.min()
            x[own] = np.maximum(0, old + step * (free - old))
            gone = own[low & (steps <= step)]
            x[gone], used[gone] = 0, False
        if used[best]:
            refused[:] = False
        else:
            refused[best] = True  # it came back to zero at once, by rounding


class Plan:
    """Slots of containers: texts first.. of a size go to containers base.., `many` to each, from `offset` on."""

    def __init__(self, capacity: int):
        self.capacity, self.n_containers, self.from_patterns = capacity, 0, 0
        self.slots: list[tuple[int, int, int, int, int]] = []  # size, first, base, many, offset
        self.taken: dict[int, int] = {}

    def put(self, size: int, base: int, containers: int, many: int, offset: int) -> None:
        first = self.taken.get(size, 0)
        self.slots.append((size, first, base, many, offset))
        self.taken[size] = first + containers * many


def plan_containers(counts: dict[int, int], capacity: int) -> Plan:
    """Places for counts[size] texts of each size from 1 to capacity."""
    plans = [_plan(counts, capacity, *s) for s in SETTINGS]
    return min(plans, key=lambda p: (p.n_containers, -p.from_patterns))


def _plan(counts: dict[int, int], capacity: int, most_classes: int, part: int) -> Plan:
    plan = Plan(capacity)
    left = dict(counts)
    if full := left.pop(capacity, 0):
        plan.put(capacity, 0, full, 1, 0)
        plan.n_containers = full

    # open: containers with room, as room -> list of (base, containers)
    open_: dict[int, list[tuple[int, int]]] = {}
    step = -(-capacity // most_classes)
    classes = capacity // step
    least = max(1, classes // part)
    uses = patterns_of(classes, least)
    in_class: dict[int, list[int]] = {}
    for size in sorted(left, reverse=True):
        if least <= (c := -(-size // step)) <= classes:
            in_class.setdefault(c, []).append(size)
    small = sum(size * n for size, n in left.items() if not least <= -(-size // step) <= classes)

    placed = True
    while placed:
        placed = False
        number = np.array([sum(left[s] for s in in_class.get(c, ())) for c in range(classes + 1)])
        tokens = np.array([sum(s * left[s] for s in in_class.get(c, ())) for c in range(classes + 1)])
        mean = np.divide(tokens, number, out=np.arange(classes + 1) * float(step), where=number > 0)
        able = np.flatnonzero((uses <= number[:, None]).all(0))
        gap = capacity - mean @ uses[:, able]
        # A row per class and one for the small texts, in containers' worth of tokens.
        a, b = np.vstack((uses[:, able] * mean[:, None], gap)) / capacity, np.append(tokens, max(small, 0)) / capacity
        repeats = np.floor(non_negative_least_squares(a[np.r_[number > 0, True]], b[np.r_[number > 0, True]]) + 1e-6).astype(np.int64)
        for p in np.argsort(-repeats, kind="stable").tolist():
            if repeats[p] <= 0:
                break
            parts = np.repeat(np.arange(classes + 1), uses[:, able[p]].astype(int)).tolist()
            times = min([int(repeats[p]), *(sum(left[s] for s in in_class[c]) // parts.count(c) for c in parts)])
            while times > 0:  # several sizes of a class are used up one after the other
                sizes: list[int] = []
                for c in parts:
                    sizes.append(next(s for s in in_class[c] if left[s] > sizes.count(s)))
                now = min(times, *(left[s] // sizes.count(s) for s in sizes))
                offset = 0
                for s in sizes:
                    plan.put(s, plan.n_containers, now, 1, offset)
                    left[s] -= now
                    offset += s
                if offset < capacity:
                    open_.setdefault(capacity - offset, []).append((plan.n_containers, now))
                small -= now * (capacity - offset)
                plan.n_containers += now
                times -= now
                placed = True
    plan.from_patterns = plan.n_containers

    rooms = 0
    for r in open_:
        rooms |= 1 << r
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            fitting = rooms >> size
            if not fitting:
                many = capacity // size
                new = max(1, n // many)
                open_.setdefault(capacity, []).append((plan.n_containers, new))
                rooms |= 1 << capacity
                plan.n_containers += new
                continue
            room = size + (fitting & -fitting).bit_length() - 1
            base, containers = open_[room].pop()
            many = min(room // size, n)
            used = min(containers, n // many)
            plan.put(size, base, used, many, capacity - room)
            n -= used * many
            if used < containers:
                open_[room].append((base + used, containers - used))
            if not open_[room]:
                del open_[room]
                rooms &= ~(1 << room)
            if rest := room - many * size:
                open_.setdefault(rest, []).append((base, used))
                rooms |= 1 << rest
    return plan


def text_parts(documents: DataFrame, *, key: str, text: str, capacity: int, path: str) -> DataFrame:
    """key, start_token, n_tokens of the parts of each text (one part, unless it is larger than capacity), with the task
    (part) that made it and its number among the task's parts of the size (nth). Texts without tokens: one part of 0."""
    schema = T.StructType([documents.schema[key], *(T.StructField(n, T.LongType()) for n in ("start_token", "n_tokens", "part", "nth"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = text_encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            tokens = encoder.lengths(b.column(1))
            pieces = np.maximum(1, -(-tokens // capacity))
            row = np.repeat(np.arange(len(tokens)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            size = np.minimum(capacity, tokens[row] - start)
            order = np.argsort(size, kind="stable")
            many = np.bincount(size, minlength=capacity + 1)
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.repeat(np.cumsum(many) - many, many)
            nth += seen[size]
            seen += many
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *map(pa.array, (start, size, np.full(len(size), part), nth))], names=schema.names)

    return wide_rows(documents).select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def pack_texts(documents: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """container_id, key, start_token, n_tokens and position (of the first token in its container), a row per part.

    A text of at most `capacity` tokens is one part; a larger one is cut into full containers and a rest, packed as any
    other part. Every token is in exactly one container. Null and empty texts have no tokens: one row with n_tokens 0
    and a null container. Repeated keys are packed as often as they occur. An empty table gives no rows.
    The sizes are counted once, into a checkpoint; only the histogram comes to the driver.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    parts = text_parts(documents, key=key, text=text, capacity=capacity, path=path or default_path()).checkpoint()
    by_task = parts.where("n_tokens > 0").groupBy("part", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in by_task.groupBy("n_tokens").agg(F.sum("n")).collect()}  # at most `capacity` rows
    plan = plan_containers(counts, capacity)
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("part", "n_tokens", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = parts.join(offsets, ["part", "n_tokens"], "left").select(key, "start_token", "n_tokens", (F.col("nth") + F.col("before")).alias("nth"))

    # The plan's size depends on the capacity, not on the corpus: a fit has at most a pattern per class and one more.
    slots = np.array(sorted(plan.slots), np.int64).reshape(-1, 5)
    size_at = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
    longest = int(np.diff(size_at).max(initial=0))
    schema = T.StructType([T.StructField("container_id", T.LongType()), documents.schema[key], *(T.StructField(n, T.LongType()) for n in ("start_token", "n_tokens", "position"))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("n_tokens").to_numpy(zero_copy_only=False)
            nth = b.column("nth").fill_null(0).to_numpy(zero_copy_only=False)
            none = size == 0
            low, high = size_at[size], size_at[size + 1] - 1
            for _ in range(longest.bit_length()):  # the last slot of the size that begins at or before nth
                middle = (low + high + 1) // 2
                up = slots[np.minimum(middle, len(slots) - 1), 1] <= nth if len(slots) else none
                low, high = np.where(up, middle, low), np.where(up, high, middle - 1)
                high = np.maximum(high, low)
            slot = slots[np.minimum(low, len(slots) - 1)] if len(slots) else np.zeros((len(size), 5), np.int64)
            many = np.maximum(1, slot[:, 3])
            behind = nth - slot[:, 1]
            container, position = slot[:, 2] + behind // many, slot[:, 4] + behind % many * size
            yield pa.RecordBatch.from_arrays(
                [pa.array(container, mask=none), b.column(key), b.column("start_token"), b.column("n_tokens"), pa.array(position, mask=none)], names=schema.names
            )

    return narrow_rows(numbered).mapInArrow(place, schema)  # the texts have been read


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, n_parts, n_tokens and n_unused of each container."""
    each = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_tokens").alias("n_tokens"))
    return each.withColumn("n_unused", capacity - F.col("n_tokens"))


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_containers, n_tokens and unused_share of the containers' capacity (null without containers)."""
    return containers(packed, capacity).select(F.col("n_tokens").alias("n")).agg(
        F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        (1 - F.sum("n") / F.nullif(F.count(F.lit(1)), F.lit(0)) / capacity).alias("unused_share"),
    )
