"""Duplicate task requests on a stream (T-02)."""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom import rules
from paperloom.operators.tasks import NEVER
from paperloom.streaming.ordered import KeyOrder

# what runs in Python workers travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class DuplicateRequests(StatefulProcessor):
    """Keeps the last accepted request of one title and creator, as long as it can refuse another.

    Requests of a micro-batch are put in order in state (``KeyOrder``). One that comes in a later micro-batch than a newer one
    is judged on arrival: it is refused only by what was accepted before its own time.
    """

    def __init__(self, seconds: int) -> None:
        self.width = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")
        self.order = KeyOrder(handle, "unordered", "at", "request_id")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0]) if self.last.exists() else NEVER
        for frame in self.order.frames(rows):
            at, free = frame["at"].to_numpy().astype("int64"), ~frame["stored"].to_numpy().astype(bool)
            duplicate = np.ones(len(at), bool)
            place = np.flatnonzero(free)
            times = at[place]
            i = 0
            while i < len(times):
                t = int(times[i])
                if last <= t <= last + self.width:  # all up to the end of the window are refused at once
                    i = int(np.searchsorted(times, last + self.width, "right"))
                    continue
                duplicate[place[i]] = False
                last = max(last, t)
                i += 1
            yield pd.DataFrame({"request_id": frame["request_id"].to_numpy(), "duplicate": duplicate})
        if last != NEVER:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.width) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def duplicate_request_stream(requests: DataFrame, tasks: DataFrame, seconds: int = rules.DUPLICATE_TASK_SECONDS, delay: str = "1 hour") -> DataFrame:
    """T-02 on a stream of request_id, title, created_by, created_at: (request_id, duplicate) in the order of arrival.

    ``tasks`` are the stored ones, read anew by every micro-batch, folded to the first and last open one per window of a
    title and creator. Requests without title, creator or time are never duplicates and keep no state.
    """
    key, width = ["title", "created_by"], seconds * 1_000_000
    micros = F.unix_micros("created_at")
    held = tasks.filter((F.col("status") == "open") & F.col("created_by").isNotNull())
    slots = held.groupBy(*key, F.floor(micros / width).alias("_slot")).agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"))
    same = slots.select(*key, "_slot", "_first")
    before = slots.select(*key, (F.col("_slot") + 1).alias("_slot"), "_last")
    timed = requests.select("request_id", *key, F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", delay)
    whole = F.coalesce(F.col("title").isNotNull() & F.col("created_by").isNotNull() & F.col("created_at").isNotNull(), F.lit(False))
    probe = timed.filter(whole).withColumns({"at": micros, "_slot": F.floor(micros / width)})
    probe = probe.join(same, [*key, "_slot"], "left").join(before, [*key, "_slot"], "left")
    stored = F.coalesce((F.col("_first") <= F.col("at")) | (F.col("_last") >= F.col("at") - width), F.lit(False))
    judged = probe.select("request_id", *key, "created_at", "at", stored.alias("stored")).groupBy(*key).transformWithStateInPandas(
        DuplicateRequests(seconds), "request_id bigint, duplicate boolean", "Append", "EventTime"
    )
    return judged.union(timed.filter(~whole).select("request_id", F.lit(False).alias("duplicate")))
