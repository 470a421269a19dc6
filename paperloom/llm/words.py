"""Words and hashes of whole Arrow batches, on flat numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. Separators are ASCII, so words can be cut on UTF-8 bytes. Work goes through a batch in
blocks of about ``BLOCK`` bytes, so memory follows the block (or the longest single text), not the batch.
"""
from __future__ import annotations

import ctypes
import pickle
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession

BLOCK = 1 << 22
SLICE = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)


def once(key: tuple, make: Callable):
    """One value per worker process: this code travels by value, so its own globals would live for one task only."""
    store = sys.__dict__.setdefault("_paperloom_llm", {})
    if key not in store:
        store[key] = make()
    return store[key]


def share(spark: SparkSession, value) -> Callable:
    """A broadcast of ``value`` with the code of its classes, so that executors need no copy of this package."""
    packed, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get():
        if not held:
            held.append(pickle.loads(packed.value))
        return held[0]

    return get


def lean() -> None:
    """Let a worker give large arrays back to the system as soon as they are freed; workers live on between tasks."""

    def settle() -> bool:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return bool(ctypes.CDLL(None).mallopt(-3, 1 << 20))  # glibc: arrays over 1 MB are mapped on their own
        except (OSError, AttributeError):
            return False

    once(("lean",), settle)


@dataclass
class Block:
    """Rows ``first .. first + n`` of a batch: their bytes, the rows' byte offsets, and the words' byte spans."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_offsets))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, lower: bool = False) -> Iterator[Block]:
    data, offsets = flat(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        part = data[offsets[row] : offsets[last]]
        yield cut(row, LOWER[part] if lower else part, offsets[row : last + 1] - offsets[row])
        row = last


def cut(first: int, data: np.ndarray, offsets: np.ndarray) -> Block:
    inside = ~SEPARATOR[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    before[offsets[filled]] = False
    after[offsets[filled + 1] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Block(first, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE + 1 if n <= SLICE else n + 1

    def make() -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE))

    return once(("powers",), make) if n <= SLICE else make()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are ordered and do not overlap: differences of a running polynomial, mixed."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        s = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, s + SLICE, "right")))
        part = data[s : ends[j - 1]]
        power, inverse = _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * power[: len(part)], out=total[1:])
        a, b = starts[i:j] - s, ends[i:j] - s
        out[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` consecutive words, at the first one's place; windows over row ends are not told apart."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0xD1342543DE82EF95) + hashes[k : k + n])
    return total


def in_row(word_offsets: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Whether a window of ``size`` words that starts at a word ends in the same row."""
    lengths = np.diff(word_offsets)
    last = np.repeat(word_offsets[1:], lengths)
    return (np.arange(n_words) + size <= last)[: max(0, n_words - size + 1)]


def covered(starts: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Which words the windows at ``starts`` cover."""
    change = np.zeros(n_words + 1, np.int32)
    change[starts] += 1
    change[np.minimum(starts + size, n_words)] -= 1
    return np.cumsum(change[:-1]) > 0


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out, filled = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets) > 0
    if filled.any():
        out[filled] = np.add.reduceat(values, offsets[:-1][filled], dtype=np.int64)
    return out
