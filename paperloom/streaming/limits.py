"""Rate limit and inactivity (W-02, W-05)."""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom import rules
from paperloom.operators.skew import previous
from paperloom.streaming.ordered import KeyOrder


def mark_limited(
    messages: DataFrame, seconds: int = rules.RATE_WINDOW_SECONDS, most: int = rules.RATE_MAX_MESSAGES, key: str = "phone", ts: str = "ts",
    row_id: str = "event_id",
) -> DataFrame:
    """W-02: add ``in_window`` (this message and the key's earlier ones less than ``seconds`` old) and ``limited``.

    Refused messages count as well. A window never reaches past the time slot before a message's own, so each message is
    handed to its slot and the next, and the work of one busy phone is spread over its slots.
    """
    micros, width = F.unix_micros(ts), seconds * 1_000_000
    own = F.floor(micros / width).cast("long")
    rows = messages.withColumns({"_at": micros, "_own": own}).withColumn("_slot", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    before = Window.partitionBy(key, "_slot").orderBy("_at").rangeBetween(-(width - 1), -1)
    same = Window.partitionBy(key, "_slot", "_at").orderBy(row_id)
    counted = rows.withColumn("in_window", F.count(F.lit(1)).over(before) + F.row_number().over(same))
    return counted.filter(F.col("_slot") == F.col("_own")).withColumn("limited", F.col("in_window") > most).drop("_at", "_own", "_slot")


# what runs in Python workers travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


PACKED = 1 << 16  # arrival times in one entry of the state


class RateLimiter(StatefulProcessor):
    """Keeps the arrival times of one phone that still lie in the window, packed into entries of bounded size.

    A phone's rows of a micro-batch are put in order in state (``KeyOrder``) and judged range by range on arrays: what is
    in memory follows a range and the window, not the micro-batch. A row older than the state (late, from an earlier time
    than a former micro-batch) counts against what is still kept, as a message judged on arrival.
    """

    def __init__(self, seconds: int, most: int) -> None:
        self.width, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "times binary")
        self.order = KeyOrder(handle, "unordered", "at", "event_id")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = [np.frombuffer(t, np.int64) for (t,) in self.recent.get()] if self.recent.exists() else []
        before = np.sort(np.concatenate(stored)) if stored else np.zeros(0, np.int64)
        own = np.zeros(0, np.int64)  # of this micro-batch, in the window of its newest row
        for frame in self.order.frames(rows):
            at = frame["at"].to_numpy().astype("int64")
            reach = np.concatenate((own, at))
            edge = at - self.width
            counts = len(before) - np.searchsorted(before, edge, "right") + len(own) + np.arange(1, len(at) + 1) - np.searchsorted(reach, edge, "right")
            own = reach[np.searchsorted(reach, at[-1] - self.width, "right") :]
            yield pd.DataFrame({"phone": key[0], "event_id": frame["event_id"].to_numpy(), "in_window": counts, "limited": counts > self.most})
        kept = np.sort(np.concatenate((before[np.searchsorted(before, own[-1] - self.width, "right") :], own)))
        self.recent.put([(kept[i : i + PACKED].tobytes(),) for i in range(0, len(kept), PACKED)])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(kept[-1] + self.width) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A phone that has been silent for a window leaves no state behind."""
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited_stream(
    stream: DataFrame, seconds: int = rules.RATE_WINDOW_SECONDS, most: int = rules.RATE_MAX_MESSAGES, delay: str = "1 hour"
) -> DataFrame:
    """W-02 on a stream of phone, event_id, ts: each message is judged on arrival; ``delay`` is how late one may arrive."""
    timed = stream.select("phone", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    keyed = timed.withColumn("at", F.unix_micros("ts"))
    return keyed.groupBy("phone").transformWithStateInPandas(
        RateLimiter(seconds, most), "phone string, event_id bigint, in_window bigint, limited boolean", "Append", "EventTime"
    )


def mark_inactive(
    messages: DataFrame, minutes: int = rules.INACTIVITY_MINUTES, key: str = "member_id", ts: str = "ts", row_id: str = "event_id",
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """W-05: add ``timed_out``: more than ``minutes`` since the member's message before (false for the first one)."""
    linked = previous(messages, key, ts, row_id, [ts], "_before", bucket_seconds)
    gap = F.unix_micros(ts) - F.unix_micros(F.col(f"_before.{ts}"))
    return linked.withColumn("timed_out", F.coalesce(gap > minutes * 60_000_000, F.lit(False))).drop("_before")
