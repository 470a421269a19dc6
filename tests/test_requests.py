from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import tasks as T

START = dt.datetime(2026, 1, 1)


def plain(requests, tasks, seconds):
    """One request after the other."""
    stored = defaultdict(list)
    for title, who, status, at in tasks:
        if status == "open" and who is not None:
            stored[title, who].append(at)
    last, out = {}, {}
    for i, title, who, at in sorted(requests, key=lambda r: (r[3] or START, r[0])):
        if title is None or who is None or at is None:
            out[i] = False
            continue
        seen = [*stored[title, who], *([last[title, who]] if (title, who) in last else [])]
        out[i] = any(at - dt.timedelta(seconds=seconds) <= t <= at for t in seen)
        if not out[i]:
            last[title, who] = at
    return out


def run(spark, requests, tasks, seconds, slots):
    asked = spark.createDataFrame(requests, "request_id bigint, title string, created_by bigint, created_at timestamp")
    held = spark.createDataFrame(tasks, "title string, created_by bigint, status string, created_at timestamp")
    return {r["request_id"]: r["duplicate"] for r in T.mark_duplicate_requests(asked, held, seconds, slots=slots).collect()}


@pytest.mark.parametrize("slots", [2, 3, 64])
@pytest.mark.parametrize("spread", [40, 400, 4000])
def test_equal_to_one_after_the_other(spark, slots, spread):
    rng = random.Random(spread)
    at = lambda: START + dt.timedelta(seconds=rng.randrange(spread))
    requests = [(i, rng.choice(["a", "b"]), rng.choice([1, 2]), at()) for i in range(400)]
    requests += [(1000, None, 1, at()), (1001, "a", None, at()), (1002, "a", 1, None), (1003, "", 1, at())]
    tasks = [(rng.choice(["a", "b"]), rng.choice([1, None]), rng.choice(["open", "done"]), at()) for _ in range(spread // 100)]
    assert run(spark, requests, tasks, 10, slots) == plain(requests, tasks, 10)


def test_no_requests(spark):
    assert run(spark, [], [("a", 1, "open", START)], 10, 4) == {}


def test_summary_of_a_block():
    rng = random.Random(1)
    for _ in range(300):
        times = np.array(sorted(rng.randrange(200) for _ in range(rng.randrange(1, 30))))
        rows = T.block_summary(times, 10)
        for before in [T.NEVER, *range(int(times[0]) - 15, int(times[0]))]:
            last, accepted = before, None
            for t in times.tolist():
                if last < t - 10:
                    last = accepted = t
            assert [e for s, e in rows if s <= before][-1] == accepted
        assert len(rows) <= len(times) + 1


def test_a_long_run_of_one_key(spark):
    """Dense requests over many blocks: each block is folded by itself, the result is that of one pass."""
    asked = spark.range(60_000).select(
        F.col("id").alias("request_id"), F.lit("a").alias("title"), F.lit(1).cast("long").alias("created_by"),
        F.timestamp_micros(F.lit(1_767_225_600_000_000) + F.pmod(F.xxhash64("id"), F.lit(20_000)) * 1_000_000).alias("created_at"),
    )
    tasks = spark.createDataFrame([], "title string, created_by bigint, status string, created_at timestamp")
    got = {r["request_id"] for r in T.mark_duplicate_requests(asked, tasks, 17, slots=8).filter(~F.col("duplicate")).collect()}
    last, right = None, set()
    for at, i in sorted((r["created_at"], r["request_id"]) for r in asked.collect()):
        if last is None or last < at - dt.timedelta(seconds=17):
            right.add(i)
            last = at
    assert got == right and len(got) > 1000


def test_stream_over_micro_batches(spark):
    """In time order over several files the stream equals one pass; a late request is refused by what came before its time."""
    from paperloom.session import shared_folder
    from paperloom.streaming import jobs
    from paperloom.streaming.requests import duplicate_request_stream

    rng = random.Random(9)
    schema = "request_id bigint, title string, created_by bigint, created_at timestamp"
    times = sorted(rng.randrange(3000) for _ in range(300))
    requests = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, None]), START + dt.timedelta(seconds=t)) for i, t in enumerate(times)]
    held = [("a", 1, "open", START + dt.timedelta(seconds=s)) for s in (100, 1500)] + [("b", 2, "done", START)]
    folder = shared_folder(spark, "requests")
    for part in range(3):
        rows = requests[100 * part : 100 * part + 100]
        spark.createDataFrame(rows[::-1], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    tasks = spark.createDataFrame(held, "title string, created_by bigint, status string, created_at timestamp")
    jobs.use_rocksdb(spark)
    got = {r["request_id"]: r["duplicate"] for r in jobs.run_to_files(duplicate_request_stream(stream, tasks, 60), "requests").collect()}
    assert got == plain(requests, held, 60)
