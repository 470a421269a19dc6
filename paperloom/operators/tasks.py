"""Tasks, change events and recurring patterns (T-*).

A change is a row of a change table; the newest change per key wins. ``as_of`` is always a parameter.
"""
from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from paperloom import rules
from paperloom.functions.regex import first_match
from paperloom.functions.scalars import advance_date
from paperloom.operators.reports import audit_rows

# what runs in Python workers travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def create_tasks(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T-01: new task rows and their audit rows. ``requests``: task_id, title, created_by, created_at and optional task columns."""
    tasks = requests.withColumns(
        {"status": F.lit("open"), "priority": F.coalesce("priority", F.lit("normal")), "completed_at": F.lit(None).cast("timestamp")}
    )
    audit = audit_rows(tasks, F.col("created_by"), "task_created", "task", F.col("task_id"), F.struct("title"), F.col("created_at"))
    return tasks, audit


SLOTS = 64  # slots of a block: a run of requests is folded block by block


def _stored_times(tasks: DataFrame, key: list[str], width: int, span: int) -> DataFrame:
    """(key, _block, _task): creation times of open tasks, of each window the first and the last, in every block they reach.

    No request lies between two windows' ends without one of these being the nearest before it or within ``width``.
    """
    micros = F.unix_micros("created_at")
    held = tasks.filter((F.col("status") == "open") & F.col("title").isNotNull() & F.col("created_by").isNotNull() & F.col("created_at").isNotNull())
    ends = held.groupBy(*key, F.floor(micros / width).alias("_slot")).agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"))
    times = ends.select(*key, F.explode(F.array("_first", "_last")).alias("_task"))
    block = lambda t: F.floor(t / span)
    return times.select(*key, "_task", F.explode(F.array_distinct(F.array(block(F.col("_task")), block(F.col("_task") + width)))).alias("_block"))


def block_summary(times: np.ndarray, width: int) -> list[tuple[int, int | None]]:
    """What a block of requests makes of the last accepted time before it: rows (from, last accepted after it).

    ``times``: the block's requests that no stored task refuses, in order. A row holds for incoming times from its first
    value on, up to the next row's; the second value is None where the block accepts nothing.
    """
    n = len(times)
    after = np.searchsorted(times, times + width, "right")  # the next that may be accepted
    last = np.where(after < n, after, np.arange(n))
    while True:  # follow all at once, in doubling steps, to the end of the block
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    reach = min(n, int(np.searchsorted(times, times[0] + width, "right")) + 1)
    starts = [NEVER, *(times[: reach - 1] - width).tolist()]
    ends: list[int | None] = times[last[:reach]].tolist()
    if reach == n:
        starts.append(int(times[-1]) - width)
        ends.append(None)
    return [(s, e) for i, (s, e) in enumerate(zip(starts, ends)) if not i or e != ends[i - 1]]


NEVER = -(1 << 62)


@F.pandas_udf(ArrayType(StructType([StructField("since", LongType()), StructField("last", LongType())])))
def _summaries(times: pd.Series, width: pd.Series) -> pd.Series:
    rows = lambda t, w: [{"since": s, "last": e} for s, e in block_summary(np.asarray(t, np.int64), int(w))]
    return pd.Series([None if t is None else rows(t, w) for t, w in zip(times, width)], dtype=object)


def mark_duplicate_requests(
    requests: DataFrame, tasks: DataFrame, seconds: int = rules.DUPLICATE_TASK_SECONDS, row_id: str = "request_id", slots: int = SLOTS
) -> DataFrame:
    """T-02: add ``duplicate``: an open task with the same title and creator was created within ``seconds`` before.

    An accepted request is such a task for the requests after it; a refused one is not. No pairs are formed, and no run of
    requests meets in one task: requests of a title and creator fold block by block, ``slots`` windows each, in time order.
    A block accepts at most one request a window, and two stored tasks a window tell whether one is near, so what it
    remembers is bounded. Only a block with a free request in its
    first window can depend on the block before. Of these, and of what lies in front of them, short summaries ("given the
    last accepted time before, which is the last after") are combined along the key; then they fold like the others.
    """
    key = ["title", "created_by"]
    width = seconds * 1_000_000
    span = width * slots
    whole = F.coalesce(F.col("title").isNotNull() & F.col("created_by").isNotNull() & F.col("created_at").isNotNull(), F.lit(False))
    at = F.unix_micros("created_at")
    rest = [c for c in requests.columns if c not in (*key, row_id)]
    asked = requests.filter(whole).select(*key, F.floor(at / span).alias("_block"), F.struct(at.alias("_at"), row_id, *rest).alias("_request"))
    events = asked.withColumn("_task", F.lit(None).cast("long")).unionByName(_stored_times(tasks, key, width, span), allowMissingColumns=True)
    blocks = events.groupBy(*key, "_block").agg(F.array_sort(F.collect_list("_request")).alias("_rows"), F.collect_list("_task").alias("_tasks"))
    blocks = blocks.filter(F.size("_rows") > 0)
    stored = lambda at: F.exists("_tasks", lambda t: (t <= at) & (t >= at - width))
    blocks = blocks.withColumn("_free", F.filter(F.transform("_rows", lambda r: r["_at"]), lambda at: ~stored(at)))
    depends = F.coalesce(F.try_element_at("_free", F.lit(1)) <= F.col("_block") * span + width, F.lit(False))

    def fold(before: Column) -> Column:
        start = F.struct(before.cast("long").alias("last"), F.array().cast("array<bigint>").alias("taken"))
        late = lambda acc, at: acc["last"].isNull() | (acc["last"] < at - width)
        step = lambda acc, at: F.when(late(acc, at), F.struct(at.alias("last"), F.array_append(acc["taken"], at).alias("taken"))).otherwise(acc)
        return F.aggregate("_free", start, step)

    # what stands in a block's last window, and the summaries of the blocks that depend on it
    tail = F.when(F.element_at("_free", -1) >= (F.col("_block") + 1) * span - width, fold(F.lit(None))["last"])
    ends = blocks.filter(F.size("_free") > 0).select(*key, "_block", F.when(~depends, tail).alias("last"), F.when(depends, F.col("_free")).alias("_times"))
    ends = ends.filter(F.col("last").isNotNull() | F.col("_times").isNotNull())
    steps = ends.select(*key, F.struct("_block", "last", _summaries("_times", F.lit(width)).alias("summary")).alias("s"))
    steps = steps.groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("_steps"))

    def along(acc: Column, step: Column) -> Column:
        before = F.when(acc["block"] == step["_block"] - 1, acc["last"])
        passed = F.element_at(F.filter(step["summary"], lambda s: s["since"] <= F.coalesce(before, F.lit(NEVER))), -1)["last"]
        known = F.array_append(acc["known"], F.struct(step["_block"].alias("_block"), before.alias("_before")))
        return F.when(
            step["summary"].isNull(), F.struct(step["_block"].alias("block"), step["last"].alias("last"), acc["known"].alias("known"))
        ).otherwise(F.struct(step["_block"].alias("block"), passed.alias("last"), known.alias("known")))

    start = F.struct(
        F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("last"),
        F.array().cast("array<struct<_block: bigint, _before: bigint>>").alias("known"),
    )
    known = steps.filter(F.exists("_steps", lambda s: s["summary"].isNotNull())).select(*key, F.explode(F.aggregate("_steps", start, along)["known"]).alias("k"))
    folded = blocks.join(known.select(*key, "k._block", "k._before"), [*key, "_block"], "left").select(*key, "_rows", fold(F.col("_before"))["taken"].alias("_taken"))
    # of several requests at an accepted time the first is the one; a stored task that refuses one refuses all of them
    first = lambda r, i: (i == 0) | (F.try_element_at("_rows", i)["_at"] != r["_at"])
    accepted = lambda r, i: F.array_contains("_taken", r["_at"]) & first(r, i)
    marked = F.transform("_rows", lambda r, i: F.struct(r.alias("row"), (~accepted(r, i)).alias("duplicate")))
    out = folded.select(*key, F.explode(marked).alias("m")).select(*key, "m.row.*", "m.duplicate").select(*requests.columns, "duplicate")
    return out.unionByName(requests.filter(~whole).withColumn("duplicate", F.lit(False)))


def priority_rank(priority: Column) -> Column:
    return first_match([(priority == p, F.lit(r)) for p, r in rules.PRIORITY_ORDER.items()], F.lit(rules.UNKNOWN_PRIORITY_RANK))


def list_tasks(tasks: DataFrame, status: str = "open", assigned_to: int | None = None, category: str | None = None) -> DataFrame:
    """T-03: by urgency, then due date with undated tasks last."""
    found = tasks.filter(F.col("status") == status)
    if assigned_to is not None:
        found = found.filter(F.col("assigned_to") == assigned_to)
    if category is not None:
        found = found.filter(F.col("category") == category)
    return found.orderBy(priority_rank(F.col("priority")), F.col("due_date").asc_nulls_last(), "task_id")


def update_status(tasks: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T-04: apply all changes of a batch; the newest status stays, completion time is that of the first ``done``.

    ``changes``: change_id, task_id, new_status, actor_id, changed_at. Also returns one audit row per change.
    """
    known = changes.filter(F.col("new_status").isNotNull())
    folded = known.groupBy("task_id").agg(
        F.max_by("new_status", F.struct("changed_at", "change_id")).alias("_new"), F.min(F.when(F.col("new_status") == "done", F.col("changed_at"))).alias("_done")
    )
    joined = tasks.join(folded, "task_id", "left")
    updated = joined.withColumns({"status": F.coalesce("_new", "status"), "completed_at": F.coalesce("completed_at", "_done")}).drop("_new", "_done")
    applied = known.join(tasks.select("task_id", "created_by"), "task_id")
    audit = audit_rows(applied, F.col("created_by"), "task_status_updated", "task", F.col("task_id"), F.struct("new_status"), F.col("changed_at"))
    return updated, audit


def reassign(tasks: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T-05: apply all reassignments of a batch; one audit row each, with the assignee before and after it."""
    known = changes.filter(F.col("new_assignee").isNotNull())
    newest = known.groupBy("task_id").agg(F.max_by("new_assignee", F.struct("changed_at", "change_id")).alias("_new"))
    updated = tasks.join(newest, "task_id", "left").withColumn("assigned_to", F.coalesce("_new", "assigned_to")).drop("_new")
    before = F.lag("new_assignee").over(Window.partitionBy("task_id").orderBy("changed_at", "change_id"))
    applied = known.withColumn("_before", before).join(tasks.select("task_id", "assigned_to"), "task_id")
    details = F.struct(
        F.coalesce("_before", "assigned_to").cast("string").alias("previous_assignee"), F.col("new_assignee").cast("string").alias("new_assignee")
    )
    audit = audit_rows(applied, F.col("actor_id"), "task_reassigned", "task", F.col("task_id"), details, F.col("changed_at"))
    return updated, audit


def archive_many(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """T-06: archive the listed tasks that are still open; ``archived`` marks them (count it for the reply)."""
    chosen = ids.select("task_id").distinct().withColumn("_hit", F.lit(True))
    joined = tasks.join(chosen, "task_id", "left")
    hit = F.coalesce(F.col("_hit") & (F.col("status") == "open"), F.lit(False))
    return joined.withColumns({"archived": hit, "status": F.when(hit, F.lit("archived")).otherwise(F.col("status"))}).drop("_hit")


def clean_up(tasks: DataFrame) -> DataFrame:
    """T-08: archive blank titles, open tasks without creator, and all but the newest open task per (title, assignee).

    The newest task of a group is a partial aggregate joined back by task id, so a title used by very many tasks is never
    sorted in one place.
    """
    blank = F.trim(F.coalesce("title", F.lit(""))) == ""
    orphan = F.col("created_by").isNull() & (F.col("status") == "open")
    first = tasks.withColumn("status", F.when(blank | orphan, F.lit("archived")).otherwise(F.col("status")))
    keepers = (
        first.filter(F.col("status") == "open").groupBy(F.lower("title").alias("t"), "assigned_to")
        .agg(F.max_by("task_id", F.struct("created_at", "task_id")).alias("task_id")).select("task_id", F.lit(True).alias("_keep"))
    )
    joined = first.join(keepers, "task_id", "left")
    extra = (F.col("status") == "open") & F.col("_keep").isNull()
    return joined.withColumn("status", F.when(extra, F.lit("archived")).otherwise(F.col("status"))).drop("_keep")


def due_patterns(patterns: DataFrame, as_of: Column) -> DataFrame:
    """T-09."""
    return patterns.filter(F.col("is_active") & (F.date_sub("next_due_date", F.col("auto_create_days_before")) <= as_of))


def generate_tasks(patterns: DataFrame, as_of: Column, run_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T-11: (tasks, updated patterns, audit). Every due pattern yields one task and advances one period per run.

    A task's id is the pattern id with the due day, so running a day twice creates nothing new under an upsert.
    """
    due = due_patterns(patterns, as_of)
    day = F.date_format("next_due_date", "yyyyMMdd").cast("long")
    tasks = due.select(
        (F.col("pattern_id") * 100_000_000 + day).alias("task_id"), "title", F.col("assigned_to").alias("created_by"), "assigned_to",
        F.lit("open").alias("status"), F.lit("normal").alias("priority"), F.col("next_due_date").alias("due_date"), "category",
        F.col("pattern_id").alias("recurring_pattern_id"), run_at.alias("created_at"),
    )
    is_due = F.col("is_active") & (F.date_sub("next_due_date", F.col("auto_create_days_before")) <= as_of)
    updated = patterns.withColumn(
        "next_due_date", F.when(is_due, advance_date(F.col("next_due_date"), F.col("frequency"))).otherwise(F.col("next_due_date"))
    )
    created = audit_rows(tasks, F.col("created_by"), "task_created", "task", F.col("task_id"), F.struct("title"), run_at)
    generated = audit_rows(
        tasks, F.col("created_by"), "recurring_task_generated", "recurring_pattern", F.col("recurring_pattern_id"),
        F.struct(F.col("title").alias("task_title"), F.col("task_id").cast("string").alias("task_id")), run_at,
    )
    return tasks, updated, created.unionByName(generated)


def list_patterns(patterns: DataFrame, is_active: bool = True) -> DataFrame:
    """T-13."""
    return patterns.filter(F.col("is_active") == is_active)


def create_patterns(requests: DataFrame) -> DataFrame:
    """T-13: new pattern rows with their defaults."""
    return requests.withColumns({"auto_create_days_before": F.coalesce("auto_create_days_before", F.lit(7)), "is_active": F.lit(True)})


def deactivate_patterns(patterns: DataFrame, ids: DataFrame) -> DataFrame:
    """T-13."""
    off = ids.select("pattern_id").distinct().withColumn("_off", F.lit(True))
    joined = patterns.join(off, "pattern_id", "left")
    return joined.withColumn("is_active", F.when(F.col("_off"), F.lit(False)).otherwise(F.col("is_active"))).drop("_off")


def domain_violations(columns: dict[str, str]) -> Column:
    """T-14: array of the columns whose value lies outside its domain; NULL values pass."""
    return F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).isin(rules.ENUM_DOMAINS[d]), F.lit(c)) for c, d in columns.items()])
    )


def split_valid(df: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """T-14: (valid rows, quarantined rows with their violations)."""
    checked = df.withColumn("violations", domain_violations(columns))
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def run_report(tasks: DataFrame, members: DataFrame) -> DataFrame:
    """T-15: the created tasks with the assignee's phone ('' where there is none)."""
    phones = members.select(F.col("member_id").alias("assigned_to"), F.col("phone").alias("_phone"))
    return tasks.join(phones, "assigned_to", "left").select(
        "task_id", "title", F.coalesce(F.date_format("due_date", "yyyy-MM-dd"), F.lit("")).alias("due_date"), F.coalesce("_phone", F.lit("")).alias("phone")
    )


def run_summary(report: DataFrame) -> DataFrame:
    """T-15."""
    return report.agg(F.count(F.lit(1)).alias("tasks_created"), F.count_if(F.col("phone") != "").alias("notifiable"))
