"""Conversation state, pending confirmations and task signals (W-03, W-04, W-06)."""
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
from paperloom.functions.regex import first_match
from paperloom.operators.skew import HOT_ROWS, carry, lookup, previous
from paperloom.streaming.ordered import KeyOrder

# what runs in Python workers travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOWNGRADE_SIGNALS = list(rules.DOWNGRADE_SIGNALS)
FIELDS = ["last_intent", "last_entity_type", "last_entity_id", "last_action", "context"]
STATE_SCHEMA = (
    "member_id bigint, last_intent string, last_entity_type string, last_entity_id bigint, last_action string, context string, "
    "pending_confirmation boolean, pending_action string, updated_at timestamp"
)


def latest_state(updates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """W-03: the state per member after all updates: non-NULL fields overwrite, a clear resets everything.

    ``updates``: update_id, member_id, ts, kind (update/clear), the fields, pending_confirmation, pending_action. The pending
    flag only changes when it is set or comes with an action. Every field is a partial aggregate.
    """
    order = F.struct("ts", "update_id")
    clears = updates.groupBy("member_id").agg(
        F.max(F.when(F.col("kind") == "clear", order)).alias("_cleared"), F.count(F.lit(1)).alias("copies")
    )
    rows = lookup(updates, clears, ["member_id"], "copies", "update_id", hot_rows)
    live = (F.col("kind") == "update") & (F.col("_cleared").isNull() | (order > F.col("_cleared")))
    latest = lambda c, cond: F.max_by(c, F.when(live & cond, order))
    touches_pending = F.coalesce("pending_confirmation", F.lit(False)) | F.col("pending_action").isNotNull()
    return rows.groupBy("member_id").agg(
        *[latest(F.col(c), F.col(c).isNotNull()).alias(c) for c in FIELDS],
        F.coalesce(latest(F.coalesce("pending_confirmation", F.lit(False)), touches_pending), F.lit(False)).alias("pending_confirmation"),
        latest(F.col("pending_action"), F.col("pending_action").isNotNull()).alias("pending_action"),
        F.max("ts").alias("updated_at"),
    )


class ConversationState(StatefulProcessor):
    """One member's state row; emits it after every micro-batch that touched it.

    Frames need no order: of each frame only the newest clear and the newest value of each field are kept, so memory does
    not follow the rows. Rows of a later micro-batch come after those of an earlier one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE_SCHEMA.replace("member_id bigint, ", ""))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [*FIELDS, "pending_confirmation", "pending_action", "updated_at"]
        now = dict(zip(names, self.state.get())) if self.state.exists() else dict.fromkeys(names) | {"pending_confirmation": False}
        cleared, newest, last = None, {}, None
        for frame in rows:
            frame = frame.sort_values(["ts", "update_id"], ignore_index=True)
            place = lambda i: (frame["ts"].iat[i], frame["update_id"].iat[i])
            last = place(-1) if last is None else max(last, place(-1))
            clear = frame["kind"] == "clear"
            if clear.any():
                at = place(int(np.flatnonzero(clear.to_numpy())[-1]))
                cleared = at if cleared is None else max(cleared, at)
            flag, action = frame["pending_confirmation"].fillna(False).astype(bool), frame["pending_action"]
            given = {c: (frame[c].notna(), frame[c]) for c in FIELDS}
            given |= {"pending_confirmation": (flag | action.notna(), flag), "pending_action": (action.notna(), action)}
            for c, (there, values) in given.items():
                found = np.flatnonzero((there & ~clear).to_numpy())
                if len(found):
                    i = int(found[-1])
                    if c not in newest or newest[c][0] < place(i):
                        newest[c] = (place(i), values.iat[i])
        if cleared is not None:
            now = dict.fromkeys(names) | {"pending_confirmation": False}
        for c, (at, value) in newest.items():
            if cleared is None or at > cleared:
                now[c] = value
        now["pending_confirmation"], now["updated_at"] = bool(now["pending_confirmation"]), last[0]
        if now["last_entity_id"] is not None:
            now["last_entity_id"] = int(now["last_entity_id"])
        self.state.update(tuple(now[n] for n in names))
        out = pd.DataFrame([{"member_id": key[0], **now}])
        out["last_entity_id"] = out["last_entity_id"].astype("Int64")
        yield out

    def close(self) -> None:
        pass


def state_stream(updates: DataFrame) -> DataFrame:
    """W-03 on a stream; the newest row per member is its state."""
    return updates.groupBy("member_id").transformWithStateInPandas(ConversationState(), STATE_SCHEMA, "Append", "None")


def resolve_pending(events: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """W-04: what each resolve event returns: the action set just before it, once; NULL when nothing is pending.

    ``events``: event_id, member_id, ts, kind (set/resolve), action.
    """
    linked = previous(events, "member_id", "ts", "event_id", ["kind", "action"], "_before", bucket_seconds)
    returned = F.when(F.col("_before.kind") == "set", F.col("_before.action"))
    return linked.filter(F.col("kind") == "resolve").withColumn("resolved_action", returned).drop("_before", "action")


def task_signals(messages: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """W-06: add ``signal`` (the member's signal after each message) and ``downgrade``.

    ``messages``: event_id, member_id, ts, tool_used, completion, detected (intent of this message), intent_group (recorded for it).
    A topic shift compares the detected intent with the group recorded for the message before. Chat after a completed tool
    turns that signal into post_tool_chat and keeps it until the next explicit one.
    """
    linked = previous(messages, "member_id", "ts", "event_id", ["intent_group"], "_before", bucket_seconds)
    shifted = F.col("_before.intent_group") != F.col("detected")
    explicit = first_match(
        [
            (F.coalesce(shifted, F.lit(False)), F.lit("topic_shift")), (F.col("completion"), F.lit("user_done")),
            (F.col("tool_used"), F.lit("tool_completed")),
        ]
    )
    marked = linked.withColumn("_explicit", explicit).drop("_before")
    known = carry(marked, "member_id", "ts", "event_id", F.col("_explicit"), "_last", bucket_seconds, include_current=False)
    after = F.when(F.col("_last") == "tool_completed", F.lit("post_tool_chat")).otherwise(F.col("_last"))
    signal = F.coalesce("_explicit", after)
    return known.withColumns({"signal": signal, "downgrade": F.coalesce(signal.isin(DOWNGRADE_SIGNALS), F.lit(False))}).drop("_explicit", "_last")


class SignalTracker(StatefulProcessor):
    """One member's last signal and intent group; a downgrade of a raised tier clears both.

    The member's rows of a micro-batch are put in order in state (``KeyOrder``); memory follows a range of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("signals", "signal string, intent_group string")
        self.order = KeyOrder(handle, "unordered", "ts", "event_id")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        signal, group = self.state.get() if self.state.exists() else (None, None)
        for frame in self.order.frames(rows):
            signals, downs = [], []
            columns = [frame[c].tolist() for c in ("tool_used", "completion", "detected", "intent_group", "raised_tier")]
            for tool_used, completion, detected, intent_group, raised_tier in zip(*columns):
                if tool_used:
                    signal = "tool_completed"
                elif signal == "tool_completed":
                    signal = "post_tool_chat"
                if completion:
                    signal = "user_done"
                if group is not None and group != detected:
                    signal = "topic_shift"
                group = intent_group
                down = signal in DOWNGRADE_SIGNALS
                signals.append(signal)
                downs.append(down)
                if down and raised_tier:
                    signal, group = None, None
            yield pd.DataFrame({"event_id": frame["event_id"].to_numpy(), "member_id": key[0], "signal": pd.Series(signals, dtype=object), "downgrade": downs})
        self.state.update((signal, group))

    def close(self) -> None:
        pass


def signal_stream(messages: DataFrame) -> DataFrame:
    """W-06 on a stream; needs the columns of ``task_signals`` and raised_tier (the member runs on a raised tier)."""
    return messages.groupBy("member_id").transformWithStateInPandas(
        SignalTracker(), "event_id bigint, member_id bigint, signal string, downgrade boolean", "Append", "None"
    )
