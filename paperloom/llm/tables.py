"""Hash tables over flat numpy arrays, looked up for whole arrays at once."""
from __future__ import annotations

import numpy as np


class Table:
    """int64 keys (0 or more) to int32 values (0 or more); -1 where a key is missing. Built once, then only read."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, (len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slots, mask = self._slot(keys), (1 << self.bits) - 1
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] < 0
            _, first = np.unique(slots[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], values[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            todo = todo[left[todo]]
            taken = self.keys[slots[todo]] >= 0
            slots[todo[taken]] = (slots[todo[taken]] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out
