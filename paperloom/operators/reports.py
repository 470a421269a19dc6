"""Reports over the activity tables and append-only logs (R-*)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.regex import strip


def audit_rows(
    rows: DataFrame, actor: Column, action: str, resource_type: str, resource_id: Column, details: Column, at: Column
) -> DataFrame:
    """R-10: audit rows with the details as JSON."""
    return rows.select(
        actor.alias("actor_id"), F.lit(action).alias("action"), F.lit(resource_type).alias("resource_type"), resource_id.alias("resource_id"),
        F.to_json(details).alias("details"), at.alias("created_at"),
    )


def conversation_rows(exchanges: DataFrame) -> DataFrame:
    """R-10: exchanges as stored; an empty reply is stored as the error reply."""
    empty = strip(F.coalesce("message_out", F.lit(""))) == ""
    return exchanges.select(
        "message_id", "member_id", "ts", "message_in", F.when(empty, F.lit(rules.ERROR_REPLY)).otherwise(F.col("message_out")).alias("message_out"), "intent"
    )


def activity_counts(conversations: DataFrame, tasks: DataFrame, bugs: DataFrame, as_of: Column) -> DataFrame:
    """R-01 + R-02: (metric, value) of the day of ``as_of`` and of what is open; one conditional pass per table."""
    day = F.date_trunc("day", as_of)

    def rows(df: DataFrame, **metrics: Column) -> DataFrame:
        totals = df.agg(*[F.count_if(cond).alias(name) for name, cond in metrics.items()])
        pairs = ", ".join(f"'{name}', {name}" for name in metrics)
        return totals.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, value)")

    talked = rows(
        conversations, conversations_today=F.col("ts") >= day,
        errors_today=(F.col("ts") >= day) & F.col("message_out").contains(rules.ERROR_REPLY),
    )
    done = rows(tasks, tasks_today=F.col("created_at") >= day, open_tasks=F.col("status") == "open")
    broken = rows(bugs, bugs_today=F.col("created_at") >= day, open_bugs=F.col("status") == "open")
    return talked.unionByName(done).unionByName(broken)


def recent_conversations(conversations: DataFrame, members: DataFrame, limit: int = 20) -> DataFrame:
    """R-03: the newest exchanges with the member's name; the names are joined to the chosen rows only."""
    page = conversations.orderBy(F.col("ts").desc_nulls_first(), "message_id").limit(limit)
    return page.join(members.select("member_id", F.col("name").alias("member_name")), "member_id", "left")


def open_bugs(bugs: DataFrame, members: DataFrame) -> DataFrame:
    """R-04: open reports with the reporter's name, newest first."""
    found = bugs.filter(F.col("status") == "open")
    named = found.join(members.select(F.col("member_id").alias("reported_by"), F.col("name").alias("reporter_name")), "reported_by", "left")
    return named.orderBy(F.col("created_at").desc_nulls_first(), "bug_id")


def active_members(members: DataFrame) -> DataFrame:
    """R-05."""
    return members.filter("is_active").select("member_id", "name", "role", "phone", "is_active")


def morning_briefing(
    members: DataFrame, tasks: DataFrame, patterns: DataFrame, documents: DataFrame, bugs: DataFrame, as_of: Column
) -> DataFrame:
    """R-06: one row per member. Counts fold per member before the join; household-wide figures are scalar subqueries."""
    open_tasks = tasks.filter(F.col("status") == "open").groupBy(F.col("assigned_to").alias("member_id")).agg(F.count(F.lit(1)).alias("open_tasks"))
    recent = documents.filter(F.col("created_at") >= F.timestamp_add("DAY", F.lit(-7), as_of)).groupBy(
        F.col("uploaded_by").alias("member_id")
    ).agg(F.count(F.lit(1)).alias("recent_documents"))
    active = patterns.filter("is_active")
    count = active.agg(F.count(F.lit(1))).scalar()
    upcoming = active.agg(F.min_by(F.struct("title", "next_due_date"), F.struct("next_due_date", "pattern_id"))).scalar()
    broken = bugs.agg(F.count_if(F.col("status") == "open")).scalar()
    rows = members.join(open_tasks, "member_id", "left").join(recent, "member_id", "left").withColumn("_next", upcoming)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "member_id", zero("open_tasks"), count.alias("active_patterns"), zero("recent_documents"),
        F.when(F.col("role") == "parent", broken).alias("open_bugs"), F.col("_next.title").alias("next_title"),
        F.datediff(F.col("_next.next_due_date"), F.to_date(as_of)).alias("next_in_days"),
    )


def conversation_history(conversations: DataFrame, depth: int = rules.HISTORY_DEPTH) -> DataFrame:
    """R-07: per member the last exchanges as user/assistant turns, oldest first (``position``).

    Exchanges without an intent drop out like those with a skipped one.
    """
    usable = conversations.filter(
        F.col("message_in").isNotNull() & F.col("message_out").isNotNull() & ~F.col("intent").isin(rules.HISTORY_SKIP_INTENTS)
    )
    rank = F.row_number().over(Window.partitionBy("member_id").orderBy(F.col("ts").desc_nulls_first(), F.col("message_id")))
    last = usable.withColumn("_rank", rank).filter(F.col("_rank") <= depth)
    turn = lambda role, text, place: F.struct(F.lit(role).alias("role"), strip(F.col(text)).alias("text"), (-F.col("_rank") * 2 + place).alias("position"))
    turns = last.select("member_id", "message_id", F.explode(F.array(turn("user", "message_in", 0), turn("assistant", "message_out", 1))).alias("t"))
    return turns.select("member_id", "message_id", "t.*").filter(F.col("text") != "")


def tool_runs(calls: DataFrame) -> DataFrame:
    """R-08: per run the calls, the distinct tools, and whether it was a multi-tool run. ``calls``: run_id, tool.

    Calls fold per (run, tool) first, which keeps the distinct count cheap for a very long run.
    """
    per_tool = calls.groupBy("run_id", "tool").agg(F.count(F.lit(1)).alias("n"))
    runs = per_tool.groupBy("run_id").agg(F.sum("n").alias("calls"), F.count(F.lit(1)).alias("tools"))
    return runs.withColumn("multi_tool", (F.col("tools") > 1) | (F.col("calls") > 2))


def report_bugs(reports: DataFrame) -> DataFrame:
    """R-09: new bug rows. ``reports``: bug_id, reported_by, description, created_at."""
    return reports.withColumns({"description": strip(F.col("description")), "status": F.lit("open"), "priority": F.lit("normal")})


def memory_context(loaded: DataFrame) -> DataFrame:
    """R-11: the loaded memories of a member as one text block, in load order (at most the load limit per member)."""
    lines = F.array_sort(F.collect_list(F.struct("position", "content")))["content"]
    return loaded.groupBy("member_id").agg(F.array_join(F.transform(lines, lambda c: F.concat(F.lit("- "), c)), "\n").alias("context"))
