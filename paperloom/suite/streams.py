"""Streaming jobs and their batch forms (W-*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import tasks as T
from paperloom.plans.daily import run_daily
from paperloom.session import shared_folder
from paperloom.streaming import intake, jobs, limits, requests, state
from paperloom.suite.household import AS_OF_DAY, _DUE, _DUPLICATE_REQUESTS, _NEXT, _requests
from paperloom.suite.intake import _PAYLOAD_SQL, payload_events
from paperloom.suite.registry import query
from paperloom.suite.shapes import load, load_stream, table


@query(
    "w01_message_stream",
    f"""SELECT k, phone, nullif(message_text, '') AS message_text FROM ({_PAYLOAD_SQL}) WHERE role = 'user' AND phone <> '' AND (coalesce(message_text, '') <> '' OR media)""",
)
def w01(spark, sf):
    raw = payload_events(jobs.stream_table(spark, sf, "conversations"))
    return jobs.run_to_files(intake.accepted_messages(raw).select("k", "phone", "message_text"), "messages")


_LIMIT_SQL = """SELECT event_id, count(*) AS in_window, count(*) > 3 AS limited FROM (
    SELECT a.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts - INTERVAL 6 HOUR AND (b.ts, b.event_id) <= (a.ts, a.event_id)) GROUP BY 1"""
_HOURS = 6 * 3600


@query("w02_rate_limit", _LIMIT_SQL)
def w02(spark, sf):
    # the given events are sparse: six hours and three messages instead of a minute and twenty
    return limits.mark_limited(load(spark, sf, "activity"), _HOURS, 3).select("event_id", "in_window", "limited")


@query(
    "w02_rate_limit_default",
    """SELECT event_id, count(*) > 20 AS limited FROM (SELECT a.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts - INTERVAL 60 SECOND AND (b.ts, b.event_id) <= (a.ts, a.event_id)) GROUP BY 1""",
)
def w02_default(spark, sf):
    return limits.mark_limited(load(spark, sf, "activity")).select("event_id", "limited")


@query("w02_rate_limit_stream", _LIMIT_SQL)
def w02_stream(spark, sf):
    jobs.use_rocksdb(spark)
    events = jobs.stream_table(spark, sf, "events").select(
        F.concat(F.lit("9725"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("phone"), "event_id", "ts"
    )
    return jobs.run_to_files(limits.limited_stream(events, _HOURS, 3), "limits").drop("phone")


def _updates(events):
    """Events as state updates; one in 41 clears, some set a pending action."""
    c, k = F.col, F.col("event_id")
    keep = lambda n, v: F.when(k % n != 0, v)
    return events.select(
        k.alias("update_id"), c("user_id").alias("member_id"), c("ts").cast("timestamp").alias("ts"),
        F.when(k % 41 == 0, F.lit("clear")).otherwise(F.lit("update")).alias("kind"), keep(2, c("event_type")).alias("last_intent"),
        keep(3, F.lit("document")).alias("last_entity_type"), keep(5, k).alias("last_entity_id"), keep(7, F.concat(F.lit("a"), k.cast("string"))).alias("last_action"),
        F.when(k % 19 == 0, c("props")).alias("context"), (k % 4 == 0).alias("pending_confirmation"),
        F.when(k % 8 == 0, F.concat(F.lit("act"), k.cast("string"))).alias("pending_action"),
    )


_STATE_SQL = """WITH u AS (SELECT *, (ts, event_id) AS o, max(CASE WHEN event_id % 41 = 0 THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS cleared FROM events),
    l AS (SELECT * FROM u WHERE event_id % 41 <> 0 AND (cleared IS NULL OR o > cleared))
  SELECT e.member_id, last_intent, last_entity_type, last_entity_id, last_action, context, coalesce(pending_confirmation, false) AS pending_confirmation, pending_action FROM (SELECT DISTINCT user_id AS member_id FROM events) e LEFT JOIN (
    SELECT user_id, max_by(event_type, o) FILTER (event_id % 2 <> 0) AS last_intent, max_by('document', o) FILTER (event_id % 3 <> 0) AS last_entity_type, max_by(event_id, o) FILTER (event_id % 5 <> 0) AS last_entity_id,
      max_by('a' || event_id, o) FILTER (event_id % 7 <> 0) AS last_action, max_by(props, o) FILTER (event_id % 19 = 0) AS context, max_by(event_id % 4 = 0, o) FILTER (event_id % 4 = 0) AS pending_confirmation,
      max_by('act' || event_id, o) FILTER (event_id % 8 = 0) AS pending_action FROM l GROUP BY 1) ON user_id = e.member_id"""
_STATE_COLUMNS = ["member_id", *state.FIELDS, "pending_confirmation", "pending_action"]


@query("w03_conversation_state", _STATE_SQL)
def w03(spark, sf):
    # a low limit sends busy members through the path for hot keys
    return state.latest_state(_updates(table(spark, sf, "events")), hot_rows=70).select(*_STATE_COLUMNS)


@query("w03_conversation_state_stream", _STATE_SQL)
def w03_stream(spark, sf):
    jobs.use_rocksdb(spark)
    emitted = jobs.run_to_files(state.state_stream(_updates(jobs.stream_table(spark, sf, "events"))), "state")
    newest = emitted.groupBy("member_id").agg(F.max_by(F.struct(*_STATE_COLUMNS[1:]), "updated_at").alias("s"))
    return newest.select("member_id", "s.*")


@query(
    "w04_resolve_pending",
    """SELECT event_id, CASE WHEN before_kind THEN before_action END AS resolved_action FROM (
      SELECT event_id, event_type, lag(event_type = 'click') OVER w AS before_kind, lag('act' || event_id) OVER w AS before_action FROM events WHERE event_type IN ('click', 'view')
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view'""",
)
def w04(spark, sf):
    c = F.col
    events = load(spark, sf, "activity").filter(c("event_type").isin("click", "view")).select(
        "event_id", "member_id", "ts", F.when(c("event_type") == "click", F.lit("set")).otherwise(F.lit("resolve")).alias("kind"),
        F.when(c("event_type") == "click", F.concat(F.lit("act"), c("event_id").cast("string"))).alias("action"),
    )
    return state.resolve_pending(events).select("event_id", "resolved_action")


@query(
    "w05_inactivity",
    """SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 10 MINUTE, false) AS timed_out FROM events""",
)
def w05(spark, sf):
    return limits.mark_inactive(load(spark, sf, "activity")).select("event_id", "timed_out")


@query(
    "w05_quiet_sessions",
    """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 2 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS messages FROM n GROUP BY user_id, no HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def w05_sessions(spark, sf):
    stream = jobs.quiet_sessions(jobs.stream_table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", "2 hours")
    closed = jobs.run_to_files(stream, "sessions")
    return closed.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "messages")


def _signals(events):
    c, k = F.col, F.col("event_id")
    groups = F.create_map(*[F.lit(x) for pair in {"click": "tasks", "view": "documents", "purchase": "memory", "signup": "recurring", "error": "chat"}.items() for x in pair])
    group = F.element_at(groups, c("event_type"))
    return events.select(
        "event_id", c("user_id").alias("member_id"), c("ts").cast("timestamp").alias("ts"), (k % 3 == 0).alias("tool_used"), (k % 17 == 0).alias("completion"),
        F.when(k % 4 == 0, group).otherwise(F.lit("tasks")).alias("detected"), F.when(k % 5 == 0, group).otherwise(F.lit("tasks")).alias("intent_group"),
        F.lit(False).alias("raised_tier"),
    )


_GROUP = "CASE event_type WHEN 'click' THEN 'tasks' WHEN 'view' THEN 'documents' WHEN 'purchase' THEN 'memory' WHEN 'signup' THEN 'recurring' ELSE 'chat' END"
_SIGNAL_SQL = f"""WITH e AS (SELECT *, CASE WHEN before <> CASE WHEN event_id % 4 = 0 THEN g ELSE 'tasks' END THEN 'topic_shift' WHEN event_id % 17 = 0 THEN 'user_done' WHEN event_id % 3 = 0 THEN 'tool_completed' END AS explicit FROM (
      SELECT *, lag(CASE WHEN event_id % 5 = 0 THEN g ELSE 'tasks' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, {_GROUP} AS g FROM events))),
    s AS (SELECT event_id, coalesce(explicit, CASE last_value(explicit IGNORE NULLS) OVER w WHEN 'tool_completed' THEN 'post_tool_chat' ELSE last_value(explicit IGNORE NULLS) OVER w END) AS signal FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT event_id, signal, coalesce(signal IN ('post_tool_chat', 'user_done', 'topic_shift'), false) AS downgrade FROM s"""


@query("w06_task_signals", _SIGNAL_SQL)
def w06(spark, sf):
    return state.task_signals(_signals(table(spark, sf, "events"))).select("event_id", "signal", "downgrade")


@query("w06_task_signals_stream", _SIGNAL_SQL)
def w06_stream(spark, sf):
    jobs.use_rocksdb(spark)
    return jobs.run_to_files(state.signal_stream(_signals(jobs.stream_table(spark, sf, "events"))), "signals").drop("member_id")


@query(
    "w07_ingest_stream",
    """SELECT coalesce(min(doc_id) FILTER (WHERE doc_id % 2 = 0), min(doc_id)) AS doc_id, sha256(text) AS file_hash FROM documents GROUP BY doc_id % 3, sha256(text)""",
)
def w07(spark, sf):
    """Two runs on one catalog: the second reads everything and finds what the first has stored."""
    docs = jobs.stream_table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3).alias("uploaded_by"), F.sha2("text", 256).alias("file_hash"))
    path = shared_folder(spark, "catalog")
    intake.ingest_stream(docs.filter(F.col("doc_id") % 2 == 0), path, shared_folder(spark, "ingest")).awaitTermination()
    intake.ingest_stream(docs, path, shared_folder(spark, "ingest")).awaitTermination()
    return intake.read_catalog(spark, path).select("doc_id", "file_hash")


@query(
    "w08_daily_run",
    f"""SELECT 'tasks' AS part, count(*) AS n FROM px_patterns WHERE {_DUE} UNION ALL SELECT 'audit', 2 * count(*) FROM px_patterns WHERE {_DUE}
    UNION ALL SELECT 'advanced', count(*) FROM px_patterns WHERE {_DUE} AND {_NEXT} <> next_due_date UNION ALL SELECT 'notifiable', count(phone) FROM px_patterns LEFT JOIN px_members ON member_id = assigned_to WHERE {_DUE}""",
    ("patterns", "members"),
)
def w08(spark, sf):
    patterns = load(spark, sf, "patterns")
    base = shared_folder(spark, "daily")
    run_daily(patterns, load(spark, sf, "members"), AS_OF_DAY, base)
    read = lambda name: spark.read.parquet(f"{base}/{name}")
    moved = read("recurring_patterns").join(patterns.select("pattern_id", F.col("next_due_date").alias("before")), "pattern_id").filter(F.col("before") != F.col("next_due_date"))
    count = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    notifiable = T.run_summary(read("run_report")).select(F.lit("notifiable").alias("part"), F.col("notifiable").alias("n"))
    return count(read("tasks"), "tasks").unionByName(count(read("audit_log"), "audit")).unionByName(count(moved, "advanced")).unionByName(notifiable)


@query(
    "w09_daily_counts",
    """SELECT CAST(ts AS DATE) AS day, event_type AS kind, count(*) AS n FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
)
def w09(spark, sf):
    return jobs.run_to_files(jobs.daily_counts(jobs.stream_table(spark, sf, "events"), "ts", F.col("event_type")), "daily-counts")


@query("t02_duplicate_requests_stream", _DUPLICATE_REQUESTS, ("tasks",))
def t02_stream(spark, sf):
    jobs.use_rocksdb(spark)
    asked = _requests(load_stream(spark, sf, "tasks"))
    return jobs.run_to_files(requests.duplicate_request_stream(asked, load(spark, sf, "tasks"), 8 * 86400), "requests")
