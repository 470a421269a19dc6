from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from paperloom.session import shared_folder
from paperloom.streaming import intake, jobs, limits, state
from paperloom.suite.streams import _signals, _updates


def write(spark, rows, schema, folder, part):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{part}")


def test_rate_limit_boundaries(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(i, "p", start + dt.timedelta(seconds=s)) for i, s in enumerate([0, 0, 30, 59, 60, 61, 200])]
    df = spark.createDataFrame(rows, "event_id bigint, phone string, ts timestamp")
    got = {r["event_id"]: (r["in_window"], r["limited"]) for r in limits.mark_limited(df, 60, 3).collect()}
    # exactly sixty seconds ago is outside
    assert [got[i] for i in range(7)] == [(1, False), (2, False), (3, False), (4, True), (3, False), (4, True), (1, False)]


def test_stream_state_survives_micro_batches(spark):
    """Several files, one per micro-batch: the stateful streams must agree with their batch forms."""
    jobs.use_rocksdb(spark)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = shared_folder(spark, "split")
    ranked = events.orderBy("ts", "event_id")
    ranked.filter(F.col("event_id") < 400).coalesce(1).write.mode("append").parquet(folder)
    ranked.filter(F.col("event_id") >= 400).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    in_order = events.agg(F.max(F.when(F.col("event_id") < 400, F.col("ts"))) <= F.min(F.when(F.col("event_id") >= 400, F.col("ts")))).first()[0]
    assert in_order  # ids follow time, so the two files are in time order
    batch = {r["event_id"]: (r["signal"], r["downgrade"]) for r in state.task_signals(_signals(events)).collect()}
    live = {r["event_id"]: (r["signal"], r["downgrade"]) for r in jobs.run_to_files(state.signal_stream(_signals(stream)), "signals").collect()}
    assert live == batch
    columns = ["member_id", *state.FIELDS, "pending_confirmation", "pending_action"]
    emitted = jobs.run_to_files(state.state_stream(_updates(stream)), "state")
    newest = emitted.groupBy("member_id").agg(F.max_by(F.struct(*columns[1:]), "updated_at").alias("s")).select("member_id", "s.*")
    assert {tuple(r) for r in newest.collect()} == {tuple(r) for r in state.latest_state(_updates(events)).select(*columns).collect()}


def test_downgrade_of_a_raised_tier_clears_the_signals(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(0, 1, start, True, False, "tasks", "tasks", True), (1, 1, start + dt.timedelta(seconds=1), False, False, "tasks", "tasks", True),
            (2, 1, start + dt.timedelta(seconds=2), False, False, "memory", "memory", True)]
    folder = shared_folder(spark, "tier")
    schema = "event_id bigint, member_id bigint, ts timestamp, tool_used boolean, completion boolean, detected string, intent_group string, raised_tier boolean"
    write(spark, rows, schema, folder, "a")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/a")
    jobs.use_rocksdb(spark)
    got = {r["event_id"]: (r["signal"], r["downgrade"]) for r in jobs.run_to_files(state.signal_stream(stream), "tier").collect()}
    assert got == {0: ("tool_completed", False), 1: ("post_tool_chat", True), 2: (None, False)}


def test_ingest_stream_over_starts(spark):
    """Several files, a second start of the same run, another run on the same catalog, and a batch that was cut off."""
    folder, path, checkpoint = shared_folder(spark, "files"), shared_folder(spark, "catalog"), shared_folder(spark, "ingest")
    schema = "doc_id bigint, uploaded_by bigint, file_hash string"
    add = lambda rows, to: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(to)
    add([(1, 1, "a"), (2, 1, "a"), (3, 2, "a"), (4, 1, "")], folder)
    read = lambda at: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    stored = lambda: sorted(r["doc_id"] for r in intake.read_catalog(spark, path).collect())
    intake.ingest_stream(read(folder), path, checkpoint).awaitTermination()
    assert stored() == [1, 3, 4]
    add([(5, 1, "a"), (6, 1, "b"), (7, 1, "")], folder)
    run = spark.read.schema("run string").json(f"{checkpoint}-run").first()["run"]
    add([(6, 1, "b"), (99, 1, "z")], f"{path}/run={run}/batch=1")  # left behind by a batch that did not finish
    intake.ingest_stream(read(folder), path, checkpoint).awaitTermination()
    assert stored() == [1, 3, 4, 6, 7]
    other = shared_folder(spark, "files")
    add([(8, 1, "b"), (9, 3, "b")], other)
    intake.ingest_stream(read(other), path, shared_folder(spark, "ingest")).awaitTermination()
    assert stored() == [1, 3, 4, 6, 7, 9]
    intake.ingest_stream(read(folder), path, checkpoint).awaitTermination()
    assert stored() == [1, 3, 4, 6, 7, 9]


def test_order_across_small_frames(spark):
    """More rows of a key than fit into one frame, out of order: the streams equal their batch forms."""
    start, folder = dt.datetime(2026, 1, 1), shared_folder(spark, "frames")
    rows = [(i, 1, "p", start + dt.timedelta(seconds=100 * i), i % 3 == 0, i % 5 == 0, "ab"[i % 2], "ab"[i % 7 % 2], False) for i in range(60)]
    schema = "event_id bigint, member_id bigint, phone string, ts timestamp, tool_used boolean, completion boolean, detected string, intent_group string, raised_tier boolean"
    events = spark.createDataFrame(rows[::-1], schema)
    events.coalesce(1).write.parquet(f"{folder}/a")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/a")
    jobs.use_rocksdb(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        limited = {r["event_id"]: (r["in_window"], r["limited"]) for r in jobs.run_to_files(limits.limited_stream(stream, 250, 2), "limits").collect()}
        signals = {r["event_id"]: (r["signal"], r["downgrade"]) for r in jobs.run_to_files(state.signal_stream(stream), "signals").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert limited == {r["event_id"]: (r["in_window"], r["limited"]) for r in limits.mark_limited(events, 250, 2).collect()}
    assert signals == {r["event_id"]: (r["signal"], r["downgrade"]) for r in state.task_signals(events).collect()}


def test_one_key_with_many_rows_in_a_micro_batch(spark, monkeypatch):
    """Frames in no order, sorted through the state in many ranges, with equal times: the streams equal their batch forms."""
    from paperloom.streaming import ordered

    monkeypatch.setattr(ordered, "CHUNK", 32)
    monkeypatch.setattr(ordered, "TOGETHER", 1000)
    k = F.col("event_id")
    events = spark.range(20_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("member_id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(9000)) * 1_000_000).alias("ts"),
    ).select(
        "*", F.col("member_id").cast("string").alias("phone"), (k % 3 == 0).alias("tool_used"), (k % 17 == 0).alias("completion"),
        F.when(k % 4 == 0, F.lit("a")).otherwise(F.lit("b")).alias("detected"), F.when(k % 5 == 0, F.lit("a")).otherwise(F.lit("b")).alias("intent_group"),
        F.lit(False).alias("raised_tier"), F.lit("x").alias("event_type"), F.lit("p").alias("props"), F.col("member_id").alias("user_id"),
    )
    folder = shared_folder(spark, "hot")
    events.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{folder}/a")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/a")
    jobs.use_rocksdb(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        limited = {r["event_id"]: (r["in_window"], r["limited"]) for r in jobs.run_to_files(limits.limited_stream(stream, 60, 20), "limits").collect()}
        signals = {r["event_id"]: (r["signal"], r["downgrade"]) for r in jobs.run_to_files(state.signal_stream(stream), "signals").collect()}
        states = {tuple(r) for r in jobs.run_to_files(state.state_stream(_updates(stream)), "state").drop("updated_at").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert limited == {r["event_id"]: (r["in_window"], r["limited"]) for r in limits.mark_limited(events, 60, 20).collect()}
    assert signals == {r["event_id"]: (r["signal"], r["downgrade"]) for r in state.task_signals(events).collect()}
    assert states == {tuple(r) for r in state.latest_state(_updates(events)).drop("updated_at").collect()}


def test_rate_limit_over_micro_batches(spark):
    """The window reaches into the micro-batch before; a message that comes late is judged on arrival."""
    start, folder = dt.datetime(2026, 1, 1), shared_folder(spark, "batches")
    schema = "event_id bigint, phone string, ts timestamp"
    at = lambda s: start + dt.timedelta(seconds=s)
    write(spark, [(1, "p", at(0)), (2, "p", at(50)), (3, "p", at(100))], schema, folder, "a.parquet")
    write(spark, [(4, "p", at(110)), (5, "p", at(70)), (6, "p", at(400))], schema, folder, "b.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    jobs.use_rocksdb(spark)
    got = {r["event_id"]: r["in_window"] for r in jobs.run_to_files(limits.limited_stream(stream, 60, 2), "limits").collect()}
    # 5 is late: both messages that are kept (50 and 100) count; for 4 the one at 50 is gone, 5 counts
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 1}
