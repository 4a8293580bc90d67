"""A hash map from 64-bit keys to 32-bit numbers whose lookups and inserts take whole arrays."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """Open addressing with linear probing; at most half full. The key 0 is stored as any other."""

    def __init__(self, capacity: int = 1024):
        self._room(max(16, 1 << (2 * capacity - 1).bit_length()))
        self.size = 0

    def _room(self, slots: int) -> None:
        self.slots, self.shift = slots, np.uint64(64 - (slots.bit_length() - 1))
        self.keys, self.values = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is not there."""
        at = self._home(keys)
        out = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (self.slots - 1)
            found = self.values[at]
            out[open_] = found
            more = (self.keys[at] != keys[open_]) & (found >= 0)
            open_, at = open_[more], at[more]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert keys that are distinct and not there yet; values must not be negative."""
        if 2 * (self.size + len(keys)) > self.slots:
            full = self.values >= 0
            old_keys, old_values = self.keys[full], self.values[full]
            self._room(1 << (4 * (self.size + len(keys)) - 1).bit_length())
            self._place(old_keys, old_values)
        self._place(keys, values)
        self.size += len(keys)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        at, values = self._home(keys), values.astype(np.int32, copy=False)
        while len(keys):
            free = np.flatnonzero(self.values[at] < 0)
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]  # of rivals for a slot, the last one stays
            lost = (self.keys[at] != keys) | (self.values[at] != values)
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & (self.slots - 1)
