"""Repetition inside single texts (problem 8).

Rule statistics of every text are counted on whole Arrow columns. An isolation forest, grown on one half of a bounded
sample of labelled rows, scores every text by how few random splits set it apart; the threshold beyond which a text is a
candidate is calibrated on the other half, to a stated recall. What the threshold misses is found by a second filter,
the least score that a case can have in these trees, and an exact check of the rule follows on both.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.arrowops import group_starts, narrow_rows, wide_rows
from millrace.llm.text_encoding import SpanHashes, code_points, same_spans
from millrace.llm.vocabulary import marked
from millrace.session import ensure_checkpoint_dir

#: Consecutive units that must come again.
UNITS = 6
#: A text is repetitive from so many units on, of which repeated / units >= SHARE.
LEAST_UNITS, SHARE = 20, (2, 5)
#: Labelled rows, those of the smallest hashes of the key: one half grows the forest, the other calibrates its threshold.
SAMPLE_ROWS = 4096
#: Share of the held-out labelled cases that must reach the threshold.
RECALL = 0.98
#: Trees, and rows that each tree is grown on.
TREES, TREE_ROWS = 64, 256
CHUNK_BYTES = 1 << 20

_WORD, _SINGLE, _BREAK, _END = 1, 2, 1, 2
COUNTS = ["units", "repeated", "distinct_units", "line_chars", "repeated_line_chars", "sentence_chars", "repeated_sentence_chars"]
SHARES = ["repeated_share", "same_unit_share", "repeated_line_share", "repeated_sentence_share"]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind of unit, lower-case form, that as a random 64-bit number, and end of line or sentence."""
    n = 0x110000
    kind = np.where(marked(r"[\p{L}\p{N}]"), _WORD, 0).astype(np.uint8)
    kind[0x3040:0x3100], kind[0x3400:0xA000] = _SINGLE, _SINGLE
    lower = np.arange(n, dtype=np.uint64)
    for c in np.flatnonzero(kind).tolist():
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    z = (lower + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    stop = np.zeros(n, np.uint8)
    stop[[ord(c) for c in ".!?。！？"]] = _END
    stop[[10, 13, 0x85, 0x2028, 0x2029]] = _BREAK
    return kind, lower.astype(np.int32), z ^ (z >> np.uint64(31)), stop


def _final_sigma(text: str) -> str:
    """Capital sigma's lower case depends on its place in the word; words with it are lowered whole."""
    return re.sub(r"[^\W_]*Σ[^\W_]*", lambda m: m.group().lower() if len(m.group().lower()) == len(m.group()) else m.group(), text)


def _groups(key: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], content: Callable[[int], object]) -> tuple[np.ndarray, np.ndarray]:
    """For items of one chunk: the number of each one's group of equal items, and whether an equal one came earlier.

    key: a 64-bit hash, equal for equal items. same(i, j) says of pairs whether they are equal, content gives an item
    itself. Items of equal hashes are compared, so that the groups are exact.
    """
    n = len(key)
    group, again = np.empty(n, np.int64), np.ones(n, bool)
    if not n:
        return group, again
    order = np.argsort(key)
    starts = group_starts(key[order])
    sizes = np.diff(np.append(starts, n))
    group[order] = np.repeat(np.arange(len(starts)), sizes)
    again[np.minimum.reduceat(order, starts)] = False
    later = np.ones(n, bool)
    later[starts] = False
    later = np.flatnonzero(later)
    if len(differ := later[~same(order[later], order[later - 1])]):
        names: dict[object, int] = {}
        for g in np.unique(group[order[differ]]).tolist():
            for i in np.sort(order[starts[g] : starts[g] + sizes[g]]).tolist():
                many = len(names)
                group[i] = len(starts) + names.setdefault((g, content(i)), many)
                again[i] = len(names) == many
    return group, again


def _span_groups(text: np.ndarray, start: np.ndarray, end: np.ndarray, points: np.ndarray, hashes: SpanHashes) -> tuple[np.ndarray, np.ndarray]:
    """_groups of the spans of points, by text."""

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = end[a] - start[a]
        out = (text[a] == text[b]) & (size == end[b] - start[b])
        of = np.flatnonzero(out)
        out[of] = same_spans(points, start[a[of]], points, start[b[of]], size[of])
        return out

    key = hashes.of(start, end) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _groups(key, same, lambda i: (int(text[i]), points[start[i] : end[i]].tobytes()))


def _segments(cut: np.ndarray, points: np.ndarray, hashes: SpanHashes, points_text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters in segments between cuts, per text, and those of segments that came earlier in it. Cuts belong to none."""
    inside = ~cut
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    # a segment does not reach over the border of a text
    border = np.flatnonzero(np.diff(points_text)) + 1
    border = border[inside[border] & inside[border - 1]]
    start, end = np.sort(np.r_[start, border]), np.sort(np.r_[end, border])
    size = end - start
    start, end, size = start[size > 0], end[size > 0], size[size > 0]
    text = points_text[start]
    _, again = _span_groups(text, start, end, points, hashes)
    return np.bincount(text, size, n_texts).astype(np.int64), np.bincount(text[again], size[again], n_texts).astype(np.int64)


def statistics(texts: pa.Array) -> Iterator[np.ndarray]:
    """COUNTS for consecutive rows, as matrices of seven rows. All are 0 for null and empty texts.

    units: single characters of U+3040-U+30FF and U+3400-U+9FFF, and longest runs of other letters and digits, lowered.
    repeated: units that belong to six in a row which, in the same order, also start at an earlier unit; each unit of
    them counts once. Units, sequences, lines and sentences are found by hashes and compared exactly. Lines end at line breaks, sentences also
    at .!? and their wide forms; a repeated one came earlier in the text.
    """
    n = len(texts)
    texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if pc.any(sigma := pc.match_substring(texts, "Σ")).as_py():
        texts = pc.replace_with_mask(texts, sigma, pa.array([_final_sigma(t) for t in texts.filter(sigma).to_pylist()], pa.string()))
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32, n + 1 + texts.offset)[texts.offset :].astype(np.int64) if offsets else np.zeros(n + 1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK_BYTES, "right")) - 1))
        yield _statistics(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
        low = high


def _statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    out = np.zeros((len(COUNTS), n), np.int64)
    if not len(data):
        return out
    kinds, lowers, mixes, stops = _tables()
    at, points = code_points(data)
    sizes = np.diff(np.searchsorted(at, bounds))
    text = np.repeat(np.arange(n), sizes)
    kind, hashes, stop, points = kinds[points], SpanHashes(mixes[points]), stops[points], lowers[points]

    begins = kind > 0
    begins[1:] &= (kind[1:] == _SINGLE) | (kind[:-1] != kind[1:]) | (text[1:] != text[:-1])
    start = np.flatnonzero(begins)
    if len(start):
        # a run ends where its kind or its text does, or the next unit begins
        gap = np.append(np.flatnonzero((kind[1:] != kind[:-1]) | (text[1:] != text[:-1])) + 1, len(kind))
        end = np.minimum(np.append(start[1:], len(kind)), gap[np.searchsorted(gap, start, "right")])
        of = text[start]
        unit, again = _span_groups(of, start, end, points, hashes)
        out[0] = np.bincount(of, minlength=n)
        out[2] = np.bincount(of[~again], minlength=n)
        several = len(unit) - UNITS + 1
        if several > 0:
            same = np.flatnonzero(of[:several] == of[UNITS - 1 :])
            gram = np.zeros(len(same), np.uint64)
            for k in range(UNITS):
                gram = (gram ^ unit[same + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                gram ^= gram >> np.uint64(29)

            def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return np.logical_and.reduce([unit[same[a] + k] == unit[same[b] + k] for k in range(UNITS)])

            hit = same[_groups(gram, equal, lambda i: unit[same[i] : same[i] + UNITS].tobytes())[1]]
            change = np.zeros(len(unit) + 1, np.int32)
            change[hit] += 1
            np.add.at(change, hit + UNITS, -1)
            out[1] = np.bincount(of[np.cumsum(change[:-1]) > 0], minlength=n)
    out[3], out[4] = _segments(stop == _BREAK, points, hashes, text, n)
    out[5], out[6] = _segments(stop > 0, points, hashes, text, n)
    return out


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def repetition(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, COUNTS and SHARES of every row of documents, in one pass without a shuffle; see statistics.

    Shares are 0 where there is nothing to share. same_unit_share: units that came earlier. Null and empty texts have
    zeros. Repeated and null keys keep their rows; an empty table gives none; other columns are not read.
    """
    schema = T.StructType([documents.schema[key], *(T.StructField(c, T.LongType(), False) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = list(statistics(b.column(1)))
            if parts:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, np.concatenate(parts, 1))], names=schema.names)

    counts = wide_rows(documents).select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return counts.withColumns({
        "repeated_share": _share("repeated", "units"), "same_unit_share": F.when(F.col("units") > 0, 1 - F.col("distinct_units") / F.col("units")).otherwise(0.0),
        "repeated_line_share": _share("repeated_line_chars", "line_chars"), "repeated_sentence_share": _share("repeated_sentence_chars", "sentence_chars"),
    })


def _unsplit(n: float) -> float:
    """Mean depth that n rows would still be split by (of an unsuccessful search in a binary tree)."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class IsolationForest:
    """Trees as arrays, one row per tree: feature and value that a node splits at, its children, and its depth (with the
    mean depth of what was left unsplit) where it is a leaf (feature -1)."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    rows: int
    #: From this score on a row is a candidate; the share of the held-out cases that are, and how many there were.
    threshold: float = 0.0
    recall: float = 1.0
    held_out: int = 0
    #: The least score that a case can have.
    bound: float = 0.0

    @classmethod
    def grow(cls, x: np.ndarray, seed: int = 7, trees: int = TREES, rows: int = TREE_ROWS) -> IsolationForest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        limit = max(1, int(np.ceil(np.log2(max(2, rows)))))
        grown = []
        for _ in range(trees):
            nodes: list[list[float]] = []
            todo = [(rng.choice(len(x), rows, replace=False), 0, -1, 0)]
            while todo:
                own, depth, parent, side = todo.pop()
                if parent >= 0:
                    nodes[parent][2 + side] = len(nodes)
                low, high = (x[own].min(0), x[own].max(0)) if len(own) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
                wide = np.flatnonzero(high > low)
                if depth >= limit or len(own) < 2 or not len(wide):
                    nodes.append([-1, 0.0, 0, 0, depth + _unsplit(len(own))])
                    continue
                f = int(rng.choice(wide))
                cut = float(rng.uniform(low[f], high[f]))
                nodes.append([f, cut, 0, 0, 0.0])
                todo += [(own[x[own, f] < cut], depth + 1, len(nodes) - 1, 0), (own[x[own, f] >= cut], depth + 1, len(nodes) - 1, 1)]
            grown.append(nodes)
        out = np.zeros((5, len(grown), max(map(len, grown))))
        for i, nodes in enumerate(grown):
            out[:, i, : len(nodes)] = np.array(nodes).T
        return cls(out[0].astype(np.int64), out[1], out[2].astype(np.int64), out[3].astype(np.int64), out[4], rows)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean depth / expected depth): towards 1 for rows that few splits set apart."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for f, v, left, right, depth in zip(self.feature, self.value, self.left, self.right, self.depth):
            node = np.zeros(len(x), np.int64)
            while True:
                at = f[node]
                if (at < 0).all():
                    break
                step = np.where(x[row, np.maximum(at, 0)] < v[node], left[node], right[node])
                node = np.where(at < 0, node, step)
            total += depth[node]
        return self._score(total)

    def _score(self, total: np.ndarray | float) -> np.ndarray:
        return np.exp2(-(total / len(self.feature)) / max(_unsplit(self.rows), 1e-9))

    def least_score(self, feature: int, least: float) -> float:
        """A bound below the score of every possible row whose feature is at least `least`: the deepest leaf of each tree
        that such a row can reach."""
        total = 0.0
        for f, v, left, right, depth in zip(self.feature, self.value, self.left, self.right, self.depth):
            deepest, todo = 0.0, [0]
            while todo:
                node = todo.pop()
                if f[node] < 0:
                    deepest = max(deepest, depth[node])
                    continue
                todo.append(int(right[node]))
                if f[node] != feature or v[node] > least:
                    todo.append(int(left[node]))
            total += deepest
        return float(self._score(total))

    def calibrated(self, x: np.ndarray, labels: np.ndarray, recall: float, bound: float) -> IsolationForest:
        """Set the threshold to the highest score that `recall` of the labelled cases in x, rows that the trees were not
        grown on, reach. Without such cases it is the bound."""
        own = np.sort(self.scores(x[labels]))
        self.bound, self.held_out = bound - 1e-9, len(own)
        self.threshold = float(own[int((1 - recall) * len(own))]) - 1e-9 if len(own) else self.bound
        self.recall = float((own >= self.threshold).mean()) if len(own) else 1.0
        return self


def is_case(units: str = "units", repeated: str = "repeated") -> Column:
    """The rule: at least LEAST_UNITS units of which at least SHARE are repeated."""
    return (F.col(units) >= LEAST_UNITS) & (F.col(repeated) * SHARE[1] >= F.col(units) * SHARE[0])


def fit_forest(stats: DataFrame, key: str, rows: int = SAMPLE_ROWS, label: Column | None = None, recall: float = RECALL) -> IsolationForest | None:
    """The forest of a sample of at most `rows` different rows, those of the smallest hashes; None without rows.

    label: a boolean column over stats, null being false; the rule itself unless given. Every second row of the sample
    grows the trees, the others calibrate the threshold. Rows whose hash is beyond what about twice the sample needs are
    left out in the tasks, and copies combined, so that what reaches the driver is bounded by the sample and not by the
    number of tasks.
    """
    n = stats.count()
    labelled = stats.withColumn("_label", F.coalesce(is_case() if label is None else label, F.lit(False)))
    hashed = labelled.withColumn("_hash", F.xxhash64(F.col(key).cast("string"), *COUNTS))
    near = hashed.where(F.shiftrightunsigned("_hash", 1) < min(2**63 - 1, (2 * rows << 63) // n)) if n > rows else hashed
    near = near.groupBy("_hash").agg(*(F.first(c).alias(c) for c in ("_label", *SHARES)))
    sample = near.orderBy("_hash").limit(rows).select("_label", *SHARES).collect()  # bounded by rows
    if not sample:
        return None
    m = np.array([tuple(r) for r in sample], float)
    labels, x = m[:, 0] > 0, m[:, 1:]
    forest = IsolationForest.grow(x[::2])
    return forest.calibrated(x[1::2], labels[1::2], recall, forest.least_score(SHARES.index("repeated_share"), SHARE[0] / SHARE[1]))


def anomalies(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, label: Column | None = None, recall: float = RECALL
) -> DataFrame:
    """The columns of repetition with score, is_candidate (score at or above the threshold calibrated to `recall`) and
    is_possible (score at or above the least that a case by the rule can have). See fit_forest for label.

    The statistics are counted once, into a checkpoint; the sample for the forest is taken from it. An empty table gives
    no rows.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    stats = repetition(documents, key=key, text=text).checkpoint()
    schema = T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType()), *(T.StructField(c, T.BooleanType()) for c in ("is_candidate", "is_possible"))])
    forest = fit_forest(stats, key, rows, label, recall)
    if forest is None:
        return stats.withColumns({"score": F.lit(None).cast("double"), "is_candidate": F.lit(None).cast("boolean"), "is_possible": F.lit(None).cast("boolean")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = forest.scores(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in SHARES], 1))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (score, score >= forest.threshold, score >= forest.bound))], names=schema.names)

    return narrow_rows(stats).mapInArrow(run, schema)  # the texts have been read


def repeated_texts(documents: DataFrame, *, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """key of the texts of at least 20 units of which at least two fifths are repeated: candidates of the forest, and rows
    below its threshold that could be cases by the second filter, checked exactly."""
    scored = anomalies(documents, key=key, text=text, rows=rows)
    return scored.where((F.col("is_candidate") | F.col("is_possible")) & is_case()).select(key)
