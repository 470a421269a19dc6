"""A key's rows of a micro-batch in order, however many there are (W-02, W-06)."""
from __future__ import annotations

import pickle
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessorHandle

# what runs in Python workers travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 512  # rows that are stored and read at once
TOGETHER = 200_000  # rows that are sorted at once, about


class KeyOrder:
    """An external sort in state.

    Rows arrive as frames of bounded size in no order. One frame is sorted as it is. Several are each sorted and laid down in
    chunks in a map state, which RocksDB keeps on disk; the chunks' first keys stay in memory. Ranges of the order that hold
    about ``TOGETHER`` rows are then read back one after the other and sorted. Memory follows one range plus one chunk of each
    frame, not the key's rows. Nothing of it is left in the state when a micro-batch is done. Rows of a later micro-batch come
    after those of an earlier one: a late row is applied on arrival.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, time: str, row_id: str) -> None:
        self.chunks = handle.getMapState(name, "run bigint, chunk bigint", "data binary")
        self.time, self.row_id = time, row_id

    def _keys(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return frame[self.time].to_numpy().astype("int64"), frame[self.row_id].to_numpy().astype("int64")

    def frames(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = [self.time, self.row_id]
        rows = iter(rows)
        first = next(rows, None)
        second = next(rows, None)
        if first is None:
            return
        if second is None:
            yield first.sort_values(by, ignore_index=True)
            return
        heads: list[list[tuple[int, int]]] = []

        def lay_down(frame: pd.DataFrame) -> None:
            frame = frame.sort_values(by, ignore_index=True)
            times, ids = self._keys(frame)
            columns = {c: frame[c].to_numpy() for c in frame.columns}
            run, own = len(heads), []
            for chunk, at in enumerate(range(0, len(frame), CHUNK)):
                own.append((int(times[at]), int(ids[at])))
                self.chunks.updateValue((run, chunk), (pickle.dumps({c: v[at : at + CHUNK] for c, v in columns.items()}, 5),))
            heads.append(own)

        lay_down(first)
        del first
        lay_down(second)
        del second
        for frame in rows:
            lay_down(frame)
        every = max(1, TOGETHER // CHUNK)
        borders = sorted(h for own in heads for h in own)[every::every]
        for low, high in zip([None, *borders], [*borders, None]):
            if low is not None and low == high:
                continue
            parts = []
            for run, own in enumerate(heads):
                # from the chunk that may hold the border's key to the last that begins before the next border
                a = 0 if low is None else max(0, bisect_left(own, low) - 1)
                b = len(own) if high is None else bisect_left(own, high)
                for chunk in range(a, b):
                    part = pd.DataFrame(pickle.loads(self.chunks.getValue((run, chunk))[0]))
                    times, ids = self._keys(part)
                    keep = np.ones(len(part), bool)
                    if low is not None:
                        keep &= (times > low[0]) | ((times == low[0]) & (ids >= low[1]))
                    if high is not None:
                        keep &= (times < high[0]) | ((times == high[0]) & (ids < high[1]))
                    if keep.any():
                        parts.append(part[keep])
            if parts:
                yield pd.concat(parts, ignore_index=True).sort_values(by, ignore_index=True)
        for run, own in enumerate(heads):
            for chunk in range(len(own)):
                self.chunks.removeKey((run, chunk))
