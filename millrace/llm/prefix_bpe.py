"""Exact byte-pair encoding by dynamic programming over prefixes.

The encoding of every byte prefix of a piece ends in one token, which is unique: token t may follow the encoding of
the shorter prefix, ending in u, exactly if the pair (u, t) keeps its border under the merges. Storing that last token
per prefix gives the encoding of any prefix by walking back, lets a text be continued from where it ended, and lets an
edit stop as soon as the stored tokens agree again. All distinct pieces of a batch are stepped through together.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.intmap import IntMap
from millrace.llm.vocabulary import Vocabulary

_NEVER = np.int32(2**31 - 1)
#: Slices of fewer candidates are stepped through one by one.
_FEW = 24
#: Remembered answers about pairs of tokens; forgotten all at once beyond it.
MAX_PAIRS = 1 << 20


class PrefixEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._pairs = IntMap(1 << 16)
        self._lists = {k: getattr(vocabulary, k).tolist() for k in ("rank", "left", "right", "length", "token_at")}
        self._one: dict[int, bool] = {}

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of token a's bytes and token b's bytes, joined, is just a, b."""
        keys = Vocabulary.pair_key(a, b)
        known = self._pairs.get(keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            distinct, inverse = np.unique(keys[new], return_inverse=True)
            answer = self._holds((distinct >> np.uint64(32)).astype(np.int32), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int32))
            if self._pairs.size > MAX_PAIRS:
                self._pairs = IntMap(1 << 16)
            self._pairs.put(distinct, answer)
            known[new] = answer[inverse]
        return known == 1

    def _holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges inside a and b, the last one first; a merge across the border that would have come before
        the parts at the border were used up breaks the pair. Of equal merges the left one comes first."""
        v = self.v
        out = np.ones(len(a), bool)
        row = np.arange(len(a))
        used_a, used_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(row):
            made = v.merge.get(Vocabulary.pair_key(a, b))
            rank = np.where(made >= 0, v.rank[made], _NEVER)
            broken = (rank < used_a) & (rank <= used_b) & (made >= 0)
            out[row[broken]] = False
            rank_a, rank_b = v.rank[a], v.rank[b]
            on = ~broken & ((rank_a >= 0) | (rank_b >= 0))
            row, a, b, used_a, used_b, rank_a, rank_b = (x[on] for x in (row, a, b, used_a, used_b, rank_a, rank_b))
            undo = rank_a > rank_b
            used_a, used_b = np.where(undo, rank_a, used_a), np.where(undo, used_b, rank_b)
            a, b = np.where(undo, v.right[a], a), np.where(undo, b, v.left[b])
        return out

    def holds_one(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self._one.get(key)) is None:
            if len(self._one) > MAX_PAIRS:
                self._one.clear()
            known = self._one[key] = bool(self.holds(np.array([a], np.int32), np.array([b], np.int32))[0])
        return known

    def _matches(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every token at every place. ends: the end of the piece of each byte."""
        at, node = np.arange(len(data)), np.zeros(len(data), np.int32)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        depth = 0
        while len(at):
            key = (node.astype(np.uint64) << np.uint64(8)) | data[at + depth].astype(np.uint64)
            node = self.v.child.get(key)
            depth += 1
            alive = node >= 0
            at, node = at[alive], node[alive]
            token = self.v.token_at[node]
            hit = token >= 0
            found.append((at[hit], depth, token[hit]))
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
        start = np.concatenate([f[0] for f in found])
        length = np.repeat([f[1] for f in found], [len(f[0]) for f in found])
        return start, length, np.concatenate([f[2] for f in found])

    def last_tokens(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each byte, the last token of the encoding of its piece up to and with it. Pieces follow each other."""
        sizes = np.diff(np.append(starts, len(data)))
        begin = np.repeat(starts, sizes)
        start, length, token = self._matches(data, begin + np.repeat(sizes, sizes))
        end = start + length - 1
        order = np.lexsort((-length, end))
        start, end, token = start[order], end[order], token[order]
        first = np.r_[0, np.flatnonzero(end[1:] != end[:-1]) + 1]
        nth = np.arange(len(end)) - np.repeat(first, np.diff(np.append(first, len(end))))
        step = (end - begin[end]) * (int(nth.max()) + 1) + nth  # prefixes by size, for each the longest last token first
        order = np.argsort(step, kind="stable")
        start, end, token, step = start[order], end[order], token[order], step[order]
        whole = start == begin[start]
        cuts = np.append(np.flatnonzero(np.r_[True, step[1:] != step[:-1]]), len(step))
        last = np.full(len(data), -1, np.int32)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if high - low < _FEW:
                for s, e, t, w in zip(start[low:high].tolist(), end[low:high].tolist(), token[low:high].tolist(), whole[low:high].tolist()):
                    if last[e] < 0 and (w or self.holds_one(int(last[s - 1]), t)):
                        last[e] = t
                continue
            open_ = np.flatnonzero(last[end[low:high]] < 0) + low
            if not len(open_):
                continue
            valid = whole[open_].copy()
            ask = open_[~valid]
            valid[~valid] = self.holds(last[start[ask] - 1], token[ask])
            last[end[open_[valid]]] = token[open_[valid]]
        return last

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and their number per piece."""
        last = self.last_tokens(data, starts)
        ends = np.append(starts[1:], len(data))
        piece, at = np.arange(len(starts)), ends.copy()
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(piece) >= _FEW:
            token = last[at - 1]
            steps.append((piece, token))
            at = at - self.v.length[token]
            more = at > starts[piece]
            piece, at = piece[more], at[more]
        counts = np.zeros(len(starts), np.int64)
        for p, _ in steps:
            counts[p] += 1
        rest: list[tuple[int, list[int]]] = []
        for p, position in zip(piece.tolist(), at.tolist()):
            tail = []
            while position > starts[p]:
                tail.append(int(last[position - 1]))
                position -= self._lists["length"][tail[-1]]
            rest.append((p, tail))
            counts[p] += len(tail)
        stop = np.cumsum(counts)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        for k, (p, token) in enumerate(steps):
            out[stop[p] - 1 - k] = token
        for p, tail in rest:
            low = int(stop[p] - counts[p])
            out[low : low + len(tail)] = tail[::-1]
        return out, counts

    def extend(self, data: bytes, last: list[int]) -> None:
        """Continue last, the last tokens of a beginning of data, to all of data."""
        v, token_at, children = self.v, self._lists["token_at"], self.v.children
        size = len(data)
        last += [-1] * (size - len(last))
        known = next((i for i, t in enumerate(last) if t < 0), size)
        longest = int(v.length.max())
        # tokens that end beyond what is known start at most `longest` before it
        ending: list[list[tuple[int, int]]] = [[] for _ in range(size - known)]
        for s in range(max(0, known - longest + 1), size):
            node = 0
            for e in range(s, size):
                node = children.get(node << 8 | data[e], -1)
                if node < 0:
                    break
                if e >= known and (t := token_at[node]) >= 0:
                    ending[e - known].append((s, t))
        for e in range(known, size):
            for s, t in ending[e - known]:
                if s == 0 or self.holds_one(last[s - 1], t):
                    last[e] = t
                    break

    def walk(self, last: list[int]) -> list[int]:
        """The ids of the whole piece from its last tokens."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= self._lists["length"][last[at - 1]]
        return out[::-1]
