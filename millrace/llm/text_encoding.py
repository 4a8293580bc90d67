"""Splitting of texts into the pieces of byte_bpe_50k's pattern, for whole Arrow columns, and their encoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from millrace.llm.intmap import IntMap
from millrace.llm.prefix_bpe import PrefixEncoder
from millrace.llm.vocabulary import CONTRACTIONS, LETTER, OTHER, SPACE, character_classes, vocabulary

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20
#: Ids that a worker remembers for pieces, and an eighth of the pieces' bytes; forgotten all at once beyond it.
MAX_REMEMBERED = 1 << 23

_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20250101).integers(1, 2**64, 256, dtype=np.uint64)


class SpanHashes:
    """64-bit hashes of values[start:end], equal for equal spans; values are uint64 and should be mixed.

    Different spans may have equal hashes, and some texts are made to (Thue-Morse words collide for every base): whoever
    uses the hashes compares the spans, see same_spans.
    """

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(max(20, (len(values) + 1).bit_length()))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """See SpanHashes."""
    return SpanHashes(values).of(starts, ends)


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Boolean per pair of spans of one size: whether a[a_start:a_start+size] equals b[b_start:b_start+size]."""
    out = np.ones(len(sizes), bool)
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):  # some spans at a time, so that what they are spread to stays small
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK_BYTES, "right")))
        size = sizes[low:high]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        differ = np.flatnonzero(a[np.repeat(a_starts[low:high], size) + place] != b[np.repeat(b_starts[low:high], size) + place])
        if len(differ):
            out[low + np.searchsorted(np.cumsum(size), differ, "right")] = False
        low = high
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: the place of each character's first byte and the characters' code points."""
    if not (data & 0x80).any():
        return np.arange(len(data)), data.astype(np.int32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    point = lead.astype(np.int32)
    rest = np.append(data, np.zeros(3, np.uint8))
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        of = np.flatnonzero((lead >= low) & (lead < high))
        if len(of):
            p = (lead[of] & mask).astype(np.int32)
            for k in range(1, more + 1):
                p = p << 6 | (rest[at[of] + k] & 0x3F)
            point[of] = p
    return at, point


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Places at which a piece of the pattern begins. text_starts: places at which texts begin, ascending, distinct.

    The pieces are runs of one class of characters. A blank before a run belongs to it; other white space stays with
    the white space before it, but for the last character if a run follows. An apostrophe of its own takes the
    contractions' letters from the run after it.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = character_classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    begins[text_starts] = True
    begins[n] = True
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[text_starts] = True
    first_of_text[n] = True
    run = np.flatnonzero(begins)
    start, end = run[:-1], run[1:]
    what = kind[start]

    space = (what == SPACE) & ~first_of_text[end]
    last = end[space] - 1
    begins[last] = True
    blank = points[last] == 32
    begins[end[space][blank]] = False
    attached = np.zeros(n + 1, bool)
    attached[end[space][blank]] = True

    quote = np.flatnonzero((what[:-1] == OTHER) & (end[:-1] - start[:-1] == 1) & (points[start[:-1]] == 39) & (what[1:] == LETTER))
    quote = quote[~attached[start[quote]] & ~first_of_text[end[quote]]]
    if len(quote):
        low, high = end[quote], end[quote + 1]
        for letters in CONTRACTIONS:
            size = len(letters)
            fits = high - low >= size
            for k, c in enumerate(letters):
                fits[fits] = points[low[fits] + k] == ord(c)
            begins[low[fits]] = False
            begins[low[fits] + size] = True
    return np.flatnonzero(begins[:n])


class TextEncoder:
    """Encodes Arrow string columns; remembers the ids of pieces by their bytes. They are looked up by a 64-bit hash, and
    the bytes found there are compared; pieces whose hash belongs to another piece are looked up by their bytes alone."""

    def __init__(self, path: str):
        self.encoder = PrefixEncoder(vocabulary(path))
        self._forget()

    def _forget(self) -> None:
        self.known, self.clashing = IntMap(1 << 16), {}
        self.n_known = self.n_ids = self.n_bytes = 0
        self.ids, self.bytes = np.empty(1 << 16, np.int32), np.empty(1 << 18, np.uint8)
        self.at, self.count, self.byte_at, self.size = (np.empty(1 << 14, np.int64) for _ in range(4))

    def _room(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            new = np.empty(max(size, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _remember(self, data: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Encode the pieces data[low:low+size] and remember them; their numbers."""
        begin = np.cumsum(size) - size
        text = data[np.repeat(low - begin, size) + np.arange(int(size.sum()))]
        ids, counts = self.encoder.encode(text, begin)
        n = self.n_known + len(low)
        for name, used in (("ids", self.n_ids + len(ids)), ("bytes", self.n_bytes + len(text)), ("at", n), ("count", n), ("byte_at", n), ("size", n)):
            self._room(name, used)
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.bytes[self.n_bytes : self.n_bytes + len(text)] = text
        own = slice(self.n_known, n)
        self.at[own], self.count[own] = self.n_ids + np.cumsum(counts) - counts, counts
        self.byte_at[own], self.size[own] = self.n_bytes + begin, size
        self.n_known, self.n_ids, self.n_bytes = n, self.n_ids + len(ids), self.n_bytes + len(text)
        return np.arange(own.start, own.stop, dtype=np.int32)

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number under which each piece is remembered."""
        sizes = np.diff(np.append(starts, len(data)))
        keys = span_hashes(_byte_values()[data], starts, starts + sizes)
        known = self.known.get(keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            distinct, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            number = self._remember(data, starts[new[first]], sizes[new[first]])
            self.known.put(distinct, number)
            known[new] = number[inverse]
        same = self.size[known] == sizes
        if same.all():  # the usual case: pieces follow each other, so data is compared as a whole
            differ = np.flatnonzero(data != self.bytes[np.repeat(self.byte_at[known] - starts, sizes) + np.arange(len(data))])
            same[np.searchsorted(starts, differ, "right") - 1] = False
        else:
            of = np.flatnonzero(same)
            same[of] = same_spans(data, starts[of], self.bytes, self.byte_at[known[of]], sizes[of])
        for i in np.flatnonzero(~same).tolist():
            piece = data[starts[i] : starts[i] + sizes[i]].tobytes()
            if (number := self.clashing.get(piece)) is None:
                number = self.clashing[piece] = int(self._remember(data, starts[i : i + 1], sizes[i : i + 1])[0])
            known[i] = number
        return known

    def chunks(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For consecutive rows: the number of ids of each row and, per piece, its number; see ids_of."""
        n = len(column)
        if pa.types.is_large_string(column.type):
            width = np.int64
        else:
            column, width = column.cast(pa.string()), np.int32
        if column.null_count:
            column = column.fill_null("")
        _, offsets, values = column.buffers()
        bounds = np.frombuffer(offsets, width, n + 1 + column.offset)[column.offset :].astype(np.int64) if offsets else np.zeros(n + 1, np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK_BYTES, "right")) - 1)
            high = min(high, n)
            part, text = data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
            yield self._chunk(part, text)
            low = high

    def _chunk(self, data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if max(self.n_ids, self.n_bytes // 8) > MAX_REMEMBERED:
            self._forget()
        if not len(data):
            return np.zeros(len(text) - 1, np.int64), np.empty(0, np.int32)
        at, points = code_points(data)
        text_points = np.searchsorted(at, text)
        begin = np.unique(text_points[:-1][text_points[:-1] < len(at)])
        starts = at[piece_starts(points, begin)]
        pieces = self._pieces(data, starts)
        sums = np.append(0, np.cumsum(self.count[pieces]))
        return np.diff(sums[np.searchsorted(starts, text)]), pieces

    def ids_of(self, pieces: np.ndarray) -> np.ndarray:
        counts = self.count[pieces]
        stop = np.cumsum(counts)
        return self.ids[np.repeat(self.at[pieces] - (stop - counts), counts) + np.arange(int(stop[-1]) if len(stop) else 0)]

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Number of ids per row; 0 for null and empty texts."""
        parts = [n for n, _ in self.chunks(column)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, pa.ListArray]]:
        """For consecutive rows: their number and the lists of their ids, never null."""
        for counts, pieces in self.chunks(column):
            offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
            yield len(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.ids_of(pieces)))


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder per worker and vocabulary."""
    return TextEncoder(path)
