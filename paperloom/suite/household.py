"""Tasks, recurring patterns, memories, facts and reports (T-*, P-*, R-*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.scalars import advance_date, first_due_date
from paperloom.operators import memory as P
from paperloom.operators import reports as R
from paperloom.operators import tasks as T
from paperloom.suite.registry import query
from paperloom.suite.shapes import load, table

AS_OF_DAY = "1998-12-15"


def _day():
    return F.lit(AS_OF_DAY).cast("date")


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_STAMP = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


@query(
    "t01_create_tasks",
    f"""SELECT message_id AS task_id, 'open' AS status, 'normal' AS priority, member_id AS actor_id, 'task_created' AS action, '{{"title":"' || intent || '"}}' AS details
    FROM px_messages WHERE intent IS NOT NULL""",
    ("messages",),
)
def t01(spark, sf):
    requests = load(spark, sf, "messages").filter(F.col("intent").isNotNull()).select(
        F.col("message_id").alias("task_id"), F.col("intent").alias("title"), F.col("member_id").alias("created_by"), F.col("ts").alias("created_at"),
        F.lit(None).cast("string").alias("priority"),
    )
    tasks, audit = T.create_tasks(requests)
    joined = tasks.join(audit.select(F.col("resource_id").alias("task_id"), "actor_id", "action", "details"), "task_id")
    return joined.select("task_id", "status", "priority", "actor_id", "action", "details")


_REQUESTS = """SELECT task_id * 2 + n AS request_id, title, created_by, created_at + (100000 + n * 432000) * INTERVAL 1 SECOND AS created_at FROM px_tasks CROSS JOIN (VALUES (0), (1)) v(n)"""


def _requests(tasks):
    again = tasks.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    return again.select(
        (F.col("task_id") * 2 + F.col("n")).alias("request_id"), "title", "created_by",
        F.timestamp_add("SECOND", (F.lit(100000) + F.col("n") * 432000).cast("int"), F.col("created_at")).alias("created_at"),
    )


_DUPLICATE_REQUESTS = f"""WITH RECURSIVE q AS MATERIALIZED ({_REQUESTS}), s AS MATERIALIZED (
      SELECT q.*, EXISTS (SELECT 1 FROM px_tasks t WHERE t.title = q.title AND t.created_by = q.created_by AND t.status = 'open' AND t.created_at <= q.created_at
        AND t.created_at >= q.created_at - INTERVAL 8 DAY) AS stored, row_number() OVER (PARTITION BY title, created_by ORDER BY created_at, request_id) AS rn FROM q WHERE created_by IS NOT NULL),
    g AS (SELECT s.*, stored AS duplicate, CASE WHEN NOT stored THEN created_at END AS taken FROM s WHERE rn = 1
      UNION ALL SELECT s.*, s.stored OR coalesce(g.taken >= s.created_at - INTERVAL 8 DAY, false),
        CASE WHEN s.stored OR coalesce(g.taken >= s.created_at - INTERVAL 8 DAY, false) THEN g.taken ELSE s.created_at END
      FROM g JOIN s ON s.title = g.title AND s.created_by = g.created_by AND s.rn = g.rn + 1)
    SELECT request_id, duplicate FROM g UNION ALL SELECT request_id, false FROM q WHERE created_by IS NULL"""


@query("t02_duplicate_requests", _DUPLICATE_REQUESTS, ("tasks",))
def t02(spark, sf):
    """Every task's title is asked for again, twice, five days apart."""
    tasks = load(spark, sf, "tasks")
    return T.mark_duplicate_requests(_requests(tasks), tasks, seconds=8 * 86400).select("request_id", "duplicate")


@query(
    "t03_list_tasks",
    "SELECT task_id, priority, due_date FROM px_tasks WHERE status = 'open' AND assigned_to = 7 AND category = 'car'",
    ("tasks",),
)
def t03(spark, sf):
    return T.list_tasks(load(spark, sf, "tasks"), "open", 7, "car").select("task_id", "priority", "due_date")


@query(
    "t03_list_tasks_order",
    """SELECT task_id, row_number() OVER (ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 WHEN 'low' THEN 3 ELSE 99 END, due_date NULLS LAST, task_id) AS position
    FROM px_tasks WHERE status = 'done' AND assigned_to = 3 QUALIFY position <= 40""",
    ("tasks",),
)
def t03_order(spark, sf):
    page = T.list_tasks(load(spark, sf, "tasks"), "done", 3).limit(40)
    ids = page.agg(F.collect_list("task_id").alias("ids"))  # forty ids, in list order
    return ids.select(F.posexplode("ids").alias("p", "task_id")).select("task_id", (F.col("p") + 1).cast("long").alias("position"))


@query(
    "t04_update_status",
    """WITH c AS (SELECT task_id, max_by(new_status, (changed_at, change_id)) AS s, min(CASE WHEN new_status = 'done' THEN changed_at END) AS d, count(*) AS n FROM px_task_changes GROUP BY 1)
    SELECT task_id, coalesce(s, status) AS status, strftime(coalesce(completed_at, d), '%Y-%m-%d %H:%M:%S') AS completed_at, coalesce(n, 0) AS audited
    FROM px_tasks LEFT JOIN c USING (task_id)""",
    ("tasks", "task_changes"),
)
def t04(spark, sf):
    updated, audit = T.update_status(load(spark, sf, "tasks"), load(spark, sf, "task_changes"))
    rows = audit.groupBy(F.col("resource_id").alias("task_id")).agg(F.count(F.lit(1)).alias("n"))
    return updated.join(rows, "task_id", "left").select("task_id", "status", _stamp("completed_at"), F.coalesce("n", F.lit(0)).cast("long").alias("audited"))


@query(
    "t05_reassign",
    """SELECT task_id, last_value(new_assignee) OVER (PARTITION BY task_id ORDER BY changed_at, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS assigned_to, actor_id,
      '{"previous_assignee":"' || coalesce(lag(new_assignee) OVER (PARTITION BY task_id ORDER BY changed_at, change_id), assigned_to) || '","new_assignee":"' || new_assignee || '"}' AS details
    FROM px_tasks JOIN px_task_changes USING (task_id)""",
    ("tasks", "task_changes"),
)
def t05(spark, sf):
    updated, audit = T.reassign(load(spark, sf, "tasks"), load(spark, sf, "task_changes"))
    return audit.select(F.col("resource_id").alias("task_id"), "actor_id", "details").join(updated.select("task_id", "assigned_to"), "task_id")


@query(
    "t06_archive_many",
    "SELECT task_id, status = 'open' AND hit AS archived, CASE WHEN status = 'open' AND hit THEN 'archived' ELSE status END AS status FROM (SELECT *, task_id % 3 = 0 AS hit FROM px_tasks)",
    ("tasks",),
)
def t06(spark, sf):
    return T.archive_many(load(spark, sf, "tasks"), load(spark, sf, "task_changes")).select("task_id", "archived", "status")


@query(
    "t08_clean_up",
    """WITH a AS (SELECT *, CASE WHEN trim(title) = '' OR (created_by IS NULL AND status = 'open') THEN 'archived' ELSE status END AS s FROM px_tasks)
    SELECT task_id, CASE WHEN s = 'open' AND row_number() OVER (PARTITION BY s = 'open', lower(title), assigned_to ORDER BY created_at DESC, task_id DESC) > 1 THEN 'archived' ELSE s END AS status FROM a""",
    ("tasks",),
)
def t08(spark, sf):
    return T.clean_up(load(spark, sf, "tasks")).select("task_id", "status")


_DUE = f"px_patterns.is_active AND next_due_date - auto_create_days_before <= DATE '{AS_OF_DAY}'"
_NEXT = """CASE frequency WHEN 'daily' THEN next_due_date + 1 WHEN 'weekly' THEN next_due_date + 7 WHEN 'monthly' THEN CAST(next_due_date + INTERVAL 1 MONTH AS DATE)
      WHEN 'yearly' THEN CAST(next_due_date + INTERVAL 1 YEAR AS DATE) ELSE next_due_date END"""


@query("t09_due_patterns", f"SELECT pattern_id, next_due_date FROM px_patterns WHERE {_DUE}", ("patterns",))
def t09(spark, sf):
    return T.due_patterns(load(spark, sf, "patterns"), _day()).select("pattern_id", "next_due_date")


@query("t10_advance_date", f"SELECT pattern_id, {_NEXT} AS advanced FROM px_patterns", ("patterns",))
def t10(spark, sf):
    return load(spark, sf, "patterns").select("pattern_id", advance_date(F.col("next_due_date"), F.col("frequency")).alias("advanced"))


@query(
    "t11_generate_tasks",
    f"""SELECT pattern_id, {_DUE} AS due, CASE WHEN {_DUE} THEN {_NEXT} ELSE next_due_date END AS next_due_date, CASE WHEN {_DUE} THEN next_due_date END AS task_due,
      CASE WHEN {_DUE} THEN 2 ELSE 0 END AS audits FROM px_patterns""",
    ("patterns",),
)
def t11(spark, sf):
    tasks, updated, audit = T.generate_tasks(load(spark, sf, "patterns"), _day(), F.lit(AS_OF_DAY).cast("timestamp"))
    made = tasks.select(F.col("recurring_pattern_id").alias("pattern_id"), F.col("due_date").alias("task_due"), F.lit(True).alias("due"), "task_id")
    counts = audit.select(
        F.when(F.col("resource_type") == "task", F.floor(F.col("resource_id") / 100_000_000)).otherwise(F.col("resource_id")).alias("pattern_id")
    ).groupBy("pattern_id").agg(F.count(F.lit(1)).cast("int").alias("audits"))
    rows = updated.join(made, "pattern_id", "left").join(counts, "pattern_id", "left")
    return rows.select("pattern_id", F.coalesce("due", F.lit(False)).alias("due"), "next_due_date", "task_due", F.coalesce("audits", F.lit(0)).alias("audits"))


@query(
    "t12_first_due_date",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN d + 1 WHEN doc_id % 4 = 1 THEN d + 7
      ELSE CAST(m AS DATE) + CAST(least(CASE WHEN doc_id % 32 = 0 THEN day(d) ELSE doc_id % 32 END, day(last_day(m))) - 1 AS INTEGER) END AS first_due
    FROM (SELECT doc_id, true_date AS d, date_trunc('month', true_date + CASE doc_id % 4 WHEN 3 THEN INTERVAL 1 YEAR ELSE INTERVAL 1 MONTH END) AS m FROM px_documents)""",
    ("documents",),
)
def t12(spark, sf):
    k = F.col("doc_id")
    frequency = F.element_at(F.array(*[F.lit(x) for x in ("daily", "weekly", "monthly", "yearly")]), (k % 4 + 1).cast("int"))
    day = F.when(k % 32 != 0, (k % 32).cast("int"))
    return load(spark, sf, "documents").select("doc_id", first_due_date(F.col("true_date"), frequency, day).alias("first_due"))


@query(
    "t13_patterns",
    "SELECT pattern_id, is_active AND pattern_id % 10 <> 0 AS is_active, CASE WHEN pattern_id % 2 = 0 THEN 7 ELSE auto_create_days_before END AS days FROM px_patterns WHERE is_active AND pattern_id % 10 <> 0",
    ("patterns",),
)
def t13(spark, sf):
    patterns = load(spark, sf, "patterns")
    active = T.list_patterns(T.deactivate_patterns(patterns, patterns.filter(F.col("pattern_id") % 10 == 0)))
    made = T.create_patterns(patterns.withColumn("auto_create_days_before", F.when(F.col("pattern_id") % 2 != 0, F.col("auto_create_days_before"))))
    return active.select("pattern_id", "is_active").join(made.select("pattern_id", F.col("auto_create_days_before").alias("days")), "pattern_id")


@query(
    "t14_domain_checks",
    "SELECT violations, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN priority = 'someday' THEN 'priority' END) AS violations FROM px_tasks) GROUP BY 1",
    ("tasks",),
)
def t14(spark, sf):
    valid, bad = T.split_valid(load(spark, sf, "tasks"), {"status": "task_status", "priority": "task_priority"})
    rows = valid.select(F.lit("").alias("violations")).unionByName(bad.select(F.array_join("violations", ",").alias("violations")))
    return rows.groupBy("violations").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t14_source_quarantine",
    "SELECT source, count(*) AS n FROM px_memories WHERE source = 'nudge' GROUP BY 1 UNION ALL SELECT source, count(*) FROM px_documents WHERE source = 'api' GROUP BY 1",
    ("memories", "documents"),
)
def t14_sources(spark, sf):
    _, memories = T.split_valid(load(spark, sf, "memories").select("source"), {"source": "memory_source"})
    _, documents = T.split_valid(load(spark, sf, "documents").select("source"), {"source": "document_source"})
    return memories.unionByName(documents).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t15_run_report",
    f"SELECT title, strftime(next_due_date, '%Y-%m-%d') AS due_date, coalesce(phone, '') AS phone FROM px_patterns LEFT JOIN px_members ON member_id = assigned_to WHERE {_DUE}",
    ("patterns", "members"),
)
def t15(spark, sf):
    tasks, _, _ = T.generate_tasks(load(spark, sf, "patterns"), _day(), F.lit(AS_OF_DAY).cast("timestamp"))
    return T.run_report(tasks, load(spark, sf, "members")).drop("task_id")


@query(
    "t15_run_summary",
    f"SELECT count(*) AS tasks_created, count(phone) AS notifiable FROM px_patterns LEFT JOIN px_members ON member_id = assigned_to WHERE {_DUE}",
    ("patterns", "members"),
)
def t15_summary(spark, sf):
    tasks, _, _ = T.generate_tasks(load(spark, sf, "patterns"), _day(), F.lit(AS_OF_DAY).cast("timestamp"))
    return T.run_summary(T.run_report(tasks, load(spark, sf, "members")))


# --- memories and facts -------------------------------------------------------------------------

_GLOBAL = " OR ".join(f"contains(lower(content), lower('{p}'))" for p, kind in rules.MEMORY_EXCLUSIONS if kind == "keyword")
_EXCLUDED = f"({_GLOBAL} OR (member_id % 4 = 0 AND regexp_matches(content, 'tea [0-9]*7$')) OR (member_id % 10 = 3 AND contains(content, 'sunday')))"


def _rules_with_own(spark, sf):
    """The seeded rules, own rules of every tenth and fourth user, a broken regex and an inactive rule."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("member_id")).distinct()
    own = lambda cond, pattern, kind, active=True: users.filter(cond).select(
        F.lit(pattern).alias("pattern"), F.lit(kind).alias("exclusion_type"), "member_id", F.lit(active).alias("is_active")
    )
    m = F.col("member_id")
    return (
        P.default_rules(spark).unionByName(own(m % 4 == 0, "tea [0-9]*7$", "regex")).unionByName(own(m % 10 == 3, "sunday", "keyword"))
        .unionByName(own(m == 1, "(broken", "regex")).unionByName(own(m == 2, "green", "keyword", False))
    )


@query("p01_exclusion", f"SELECT memory_id, {_EXCLUDED} AS excluded FROM px_memories", ("memories",))
def p01(spark, sf):
    return P.mark_excluded(load(spark, sf, "memories"), _rules_with_own(spark, sf), "memory_id").select("memory_id", "excluded")


@query(
    "p01_exclusion_many_rules",
    "SELECT memory_id, EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 9 = 0 AND contains(content, ' ' || o_orderkey)) AS excluded FROM px_memories",
    ("memories",),
)
def p01_many(spark, sf):
    """Every ninth order's number is a global rule: they are filed by a piece of their text."""
    numbers = table(spark, sf, "orders").filter(F.col("o_orderkey") % 9 == 0)
    rule_table = numbers.select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("pattern"), F.lit("keyword").alias("exclusion_type"), F.lit(None).cast("long").alias("member_id"),
        F.lit(True).alias("is_active"),
    )
    return P.mark_excluded(load(spark, sf, "memories"), rule_table, "memory_id").select("memory_id", "excluded")


_CATEGORY = "CASE category WHEN 'task' THEN 'context' WHEN 'reminder' THEN 'context' WHEN 'note' THEN 'fact' WHEN 'mystery' THEN 'context' ELSE category END"
_EXPIRES = "CASE memory_type WHEN 'short' THEN created_at + INTERVAL 7 DAY WHEN 'medium' THEN created_at + INTERVAL 90 DAY WHEN 'long' THEN created_at + INTERVAL 365 DAY END"


@query(
    "p02_save_memories",
    f"SELECT memory_id, {_CATEGORY} AS category, strftime({_EXPIRES}, '%Y-%m-%d %H:%M:%S') AS expires_at FROM px_memories WHERE NOT {_EXCLUDED}",
    ("memories",),
)
def p02(spark, sf):
    return P.save_memories(load(spark, sf, "memories"), _rules_with_own(spark, sf)).select("memory_id", "category", _stamp("expires_at"))


_AS_OF = "2024-01-25 00:00:00"
_WITH_EXPIRY = f"SELECT *, {_EXPIRES} AS expires_at FROM px_memories"
_LIVE = f"""SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY last_accessed_at DESC NULLS LAST, created_at DESC NULLS FIRST, memory_id) AS position
    FROM ({_WITH_EXPIRY}) WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '{_AS_OF}')"""


def _memories(spark, sf):
    return load(spark, sf, "memories").withColumn("expires_at", P.expiry(F.col("created_at"), F.col("memory_type")))


def _now():
    return F.lit(_AS_OF).cast("timestamp")


@query("p03_load_memories", f"SELECT member_id, memory_id, CAST(position AS INTEGER) AS position FROM ({_LIVE}) WHERE position <= 20", ("memories",))
def p03(spark, sf):
    return P.load_memories(_memories(spark, sf), _now()).select("member_id", "memory_id", "position")


@query(
    "p04_touch_memories",
    f"""SELECT m.memory_id, CAST(CASE WHEN l.memory_id IS NULL THEN m.access_count ELSE m.access_count + 1 END AS INTEGER) AS access_count,
      strftime(CASE WHEN l.memory_id IS NULL THEN m.last_accessed_at ELSE TIMESTAMP '{_AS_OF}' END, '%Y-%m-%d %H:%M:%S') AS last_accessed_at
    FROM px_memories m LEFT JOIN (SELECT memory_id FROM ({_LIVE}) WHERE position <= 20) l ON l.memory_id = m.memory_id""",
    ("memories",),
)
def p04(spark, sf):
    memories = _memories(spark, sf)
    touched = P.touch_memories(memories, P.load_memories(memories, _now()), _now())
    return touched.select("memory_id", "access_count", _stamp("last_accessed_at"))


@query("p05_drop_expired", f"SELECT memory_id FROM ({_WITH_EXPIRY}) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{_AS_OF}'", ("memories",))
def p05(spark, sf):
    return P.drop_expired(_memories(spark, sf), _now()).select("memory_id")


@query("p05_expired_count", f"SELECT count(*) AS deleted FROM ({_WITH_EXPIRY}) WHERE expires_at <= TIMESTAMP '{_AS_OF}'", ("memories",))
def p05_count(spark, sf):
    return P.expired_count(_memories(spark, sf), _now())


@query(
    "p06_nudge",
    f"""WITH m AS (SELECT *, message_in AS content FROM px_messages WHERE {' OR '.join(f"contains(message_in, '{p}') OR contains(lower(message_in), '{p}')" for p in rules.NUDGE_PHRASES)})
    SELECT message_id, left(trim(content), 500) AS content, strftime(ts + INTERVAL 365 DAY, '%Y-%m-%d %H:%M:%S') AS expires_at, 'nudge' AS source FROM m WHERE NOT ({_GLOBAL})""",
    ("messages",),
)
def p06(spark, sf):
    return P.nudge_memories(load(spark, sf, "messages"), P.default_rules(spark)).select("message_id", "content", _stamp("expires_at"), "source")


_FACT_CATEGORY = "CASE fact_key WHEN 'building_code' THEN 'household_access' WHEN 'health_note' THEN 'health' WHEN 'financial_salary' THEN 'financial' ELSE 'basic_personal' END"


def _versions(spark, sf):
    facts = load(spark, sf, "member_facts")
    versions = P.fact_versions(facts.withColumn("category", F.lit(None).cast("string")))
    return versions.drop("is_active").join(facts.select("fact_id", "is_active"), "fact_id")


@query("p07_fact_versions", f"SELECT fact_id, {_FACT_CATEGORY} AS category, true AS is_active FROM px_member_facts", ("member_facts",))
def p07(spark, sf):
    facts = load(spark, sf, "member_facts").withColumn("category", F.lit(None).cast("string"))
    return P.fact_versions(facts).select("fact_id", "category", "is_active")


@query(
    "p08_latest_person_facts",
    "SELECT subject_member_id, fact_key, max_by(fact_value, (created_at, fact_id)) AS fact_value FROM px_member_facts WHERE is_active AND subject_member_id IS NOT NULL GROUP BY ALL",
    ("member_facts",),
)
def p08(spark, sf):
    return P.latest_person_facts(_versions(spark, sf)).select("subject_member_id", "fact_key", "fact_value")


@query(
    "p08_latest_household_facts",
    "SELECT location_key, fact_key, max_by(fact_value, (created_at, fact_id)) AS fact_value FROM px_member_facts WHERE is_active AND location_key IS NOT NULL GROUP BY ALL",
    ("member_facts",),
)
def p08_household(spark, sf):
    return P.latest_household_facts(_versions(spark, sf)).select("location_key", "fact_key", "fact_value")


_LATEST = f"SELECT subject_member_id, fact_key, {_FACT_CATEGORY} AS category, max_by(fact_value, (created_at, fact_id)) AS fact_value FROM px_member_facts WHERE is_active AND subject_member_id IS NOT NULL GROUP BY ALL"


@query(
    "p09_fact_answers",
    f"""WITH l AS ({_LATEST}), r AS (SELECT request_id, request_id % 150 AS actor_id, list_value('birth_date', 'id_number', 'financial_salary', 'health_note')[1 + request_id % 4] AS fact_key,
        request_id % 3 AS form, (request_id * 11) % 170 AS other FROM px_requests),
      t AS (SELECT r.*, CASE form WHEN 0 THEN actor_id WHEN 1 THEN NULL ELSE n.member_id END AS target_id FROM r LEFT JOIN px_members n ON n.name = 'Customer#' || lpad(CAST(other AS VARCHAR), 9, '0') AND n.is_active)
    SELECT request_id, CASE WHEN form = 1 THEN NULL ELSE coalesce(target_id, actor_id) END AS target_id,
      CASE WHEN form = 1 THEN 'unknown_person' WHEN fact_value IS NULL THEN 'no_fact' WHEN category IN ('financial', 'health') AND role <> 'parent' THEN 'denied' ELSE 'answered' END AS outcome,
      CASE WHEN form <> 1 AND NOT (category IN ('financial', 'health') AND role <> 'parent') THEN fact_value END AS answer
    FROM t LEFT JOIN l ON l.subject_member_id = CASE WHEN form = 1 THEN NULL ELSE coalesce(target_id, actor_id) END AND l.fact_key = t.fact_key LEFT JOIN px_members a ON a.member_id = actor_id""",
    ("requests", "members", "member_facts"),
)
def p09(spark, sf):
    k = F.col("request_id")
    keys = F.array(*[F.lit(x) for x in ("birth_date", "id_number", "financial_salary", "health_note")])
    # a name is one word here, as in the household: customer names carry no digits mark
    name = F.concat(F.lit("Customer"), F.lpad(((k * 11) % 170).cast("string"), 9, "0"))
    question = F.when(k % 3 == 0, F.lit("what is my id")).when(k % 3 == 1, F.lit("the number of Nobody")).otherwise(F.concat(F.lit("when was "), name, F.lit(" born")))
    requests = load(spark, sf, "requests").select("request_id", (k % 150).alias("actor_id"), question.alias("question"), F.element_at(keys, (k % 4 + 1).cast("int")).alias("fact_key"))
    members = load(spark, sf, "members").withColumn("name", F.replace("name", F.lit("#"), F.lit("")))
    return P.answer_fact_questions(requests, members, _versions(spark, sf))


@query(
    "p09_location_answers",
    """WITH l AS (SELECT location_key, max_by(fact_value, (created_at, fact_id)) AS v FROM px_member_facts WHERE is_active AND location_key IS NOT NULL GROUP BY 1)
    SELECT request_id, CASE WHEN v IS NULL THEN 'no_fact' ELSE 'answered' END AS outcome, v AS answer FROM px_requests LEFT JOIN l ON location_key = 'house ' || (request_id % 12)""",
    ("requests", "member_facts"),
)
def p09_locations(spark, sf):
    k = F.col("request_id")
    requests = load(spark, sf, "requests").select("request_id", (k % 150).alias("actor_id"), F.concat(F.lit(" House "), (k % 12).cast("string")).alias("question"))
    return P.answer_location_questions(requests, load(spark, sf, "members"), _versions(spark, sf))


# --- reports ------------------------------------------------------------------------------------


def _bugs(spark, sf):
    """Error events as bug reports."""
    c = F.col
    errors = table(spark, sf, "events").filter(c("event_type") == "error")
    status = F.element_at(F.array(*[F.lit(s) for s in ("open", "fixed", "duplicate")]), (c("event_id") % 3 + 1).cast("int"))
    return errors.select(
        c("event_id").alias("bug_id"), c("user_id").alias("reported_by"), F.concat(F.lit(" error "), c("event_id").cast("string")).alias("description"),
        status.alias("status"), c("ts").cast("timestamp").alias("created_at"),
    )


_BUGS = "SELECT event_id AS bug_id, user_id AS reported_by, list_value('open', 'fixed', 'duplicate')[1 + event_id % 3] AS status, ts AS created_at FROM events WHERE event_type = 'error'"
_REPORT_DAY = "2024-01-10"
_TASK_SHIFT = 8230  # days from the orders' time to that of the conversations, so that some tasks are of the report day


@query(
    "r01_activity_counts",
    f"""SELECT 'conversations_today' AS metric, count(*) AS value FROM px_messages WHERE ts >= DATE '{_REPORT_DAY}'
    UNION ALL SELECT 'errors_today', count(*) FROM px_messages WHERE ts >= DATE '{_REPORT_DAY}' AND contains(message_out, '{rules.ERROR_REPLY}')
    UNION ALL SELECT 'tasks_today', count(*) FROM px_tasks WHERE created_at + INTERVAL {_TASK_SHIFT} DAY >= DATE '{_REPORT_DAY}' UNION ALL SELECT 'open_tasks', count(*) FROM px_tasks WHERE status = 'open'
    UNION ALL SELECT 'bugs_today', count(*) FROM ({_BUGS}) WHERE created_at >= DATE '{_REPORT_DAY}' UNION ALL SELECT 'open_bugs', count(*) FROM ({_BUGS}) WHERE status = 'open'""",
    ("messages", "tasks"),
)
def r01(spark, sf):
    tasks = load(spark, sf, "tasks").withColumn("created_at", F.timestamp_add("DAY", F.lit(_TASK_SHIFT), F.col("created_at")))
    return R.activity_counts(load(spark, sf, "messages"), tasks, _bugs(spark, sf), F.lit(f"{_REPORT_DAY} 15:00:00").cast("timestamp"))


@query(
    "r02_open_items",
    f"SELECT 'open_bugs' AS metric, count(*) AS value FROM ({_BUGS}) WHERE status = 'open' UNION ALL SELECT 'open_tasks', count(*) FROM px_tasks WHERE status = 'open'",
    ("tasks",),
)
def r02(spark, sf):
    counts = R.activity_counts(load(spark, sf, "messages"), load(spark, sf, "tasks"), _bugs(spark, sf), F.lit(_REPORT_DAY).cast("timestamp"))
    return counts.filter(F.col("metric").isin("open_tasks", "open_bugs"))


@query(
    "r03_recent_conversations",
    "SELECT message_id, name AS member_name, intent FROM (SELECT * FROM px_messages ORDER BY ts DESC NULLS FIRST, message_id LIMIT 20) LEFT JOIN px_members USING (member_id)",
    ("messages", "members"),
)
def r03(spark, sf):
    return R.recent_conversations(load(spark, sf, "messages"), load(spark, sf, "members")).select("message_id", "member_name", "intent")


@query(
    "r04_open_bugs",
    f"SELECT bug_id, name AS reporter_name FROM ({_BUGS}) LEFT JOIN px_members ON member_id = reported_by WHERE status = 'open'",
    ("members",),
)
def r04(spark, sf):
    return R.open_bugs(_bugs(spark, sf), load(spark, sf, "members")).select("bug_id", "reporter_name")


@query("r05_active_members", "SELECT member_id, name, role, phone, is_active FROM px_members WHERE is_active", ("members",))
def r05(spark, sf):
    return R.active_members(load(spark, sf, "members"))


@query(
    "r06_morning_briefing",
    f"""SELECT m.member_id, coalesce(t.n, 0) AS open_tasks, (SELECT count(*) FROM px_patterns WHERE is_active) AS active_patterns, coalesce(d.n, 0) AS recent_documents,
      CASE WHEN role = 'parent' THEN (SELECT count(*) FROM ({_BUGS}) WHERE status = 'open') END AS open_bugs,
      (SELECT title FROM px_patterns WHERE is_active ORDER BY next_due_date, pattern_id LIMIT 1) AS next_title,
      CAST((SELECT min(next_due_date) FROM px_patterns WHERE is_active) - DATE '{AS_OF_DAY}' AS INTEGER) AS next_in_days
    FROM px_members m LEFT JOIN (SELECT assigned_to, count(*) AS n FROM px_tasks WHERE status = 'open' GROUP BY 1) t ON t.assigned_to = m.member_id
      LEFT JOIN (SELECT uploaded_by, count(*) AS n FROM px_documents WHERE created_at >= TIMESTAMP '{AS_OF_DAY}' - INTERVAL 7 DAY GROUP BY 1) d ON d.uploaded_by = m.member_id""",
    ("members", "tasks", "patterns", "documents"),
)
def r06(spark, sf):
    get = lambda n: load(spark, sf, n)
    return R.morning_briefing(get("members"), get("tasks"), get("patterns"), get("documents"), _bugs(spark, sf), F.lit(AS_OF_DAY).cast("timestamp"))


@query(
    "r07_conversation_history",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY ts DESC NULLS FIRST, message_id) AS rn FROM px_messages
        WHERE message_in IS NOT NULL AND message_out IS NOT NULL AND intent NOT IN ('agent.None', 'agent.chat', 'agent.none'))
    SELECT member_id, message_id, 'user' AS role, regexp_replace(message_in, '^\\s+|\\s+$', '', 'g') AS text, CAST(-2 * rn AS INTEGER) AS position FROM r WHERE rn <= 4 AND trim(message_in) <> ''
    UNION ALL SELECT member_id, message_id, 'assistant', regexp_replace(message_out, '^\\s+|\\s+$', '', 'g'), CAST(1 - 2 * rn AS INTEGER) FROM r WHERE rn <= 4 AND trim(message_out) <> ''""",
    ("messages",),
)
def r07(spark, sf):
    return R.conversation_history(load(spark, sf, "messages"))


@query(
    "r08_tool_runs",
    """SELECT user_id * 1000 + event_id % 700 AS run_id, count(*) AS calls, count(DISTINCT event_type) AS tools, count(DISTINCT event_type) > 1 OR count(*) > 2 AS multi_tool FROM events GROUP BY 1""",
)
def r08(spark, sf):
    calls = table(spark, sf, "events").select((F.col("user_id") * 1000 + F.col("event_id") % 700).alias("run_id"), F.col("event_type").alias("tool"))
    return R.tool_runs(calls)


@query("r09_report_bugs", f"SELECT bug_id, 'error ' || bug_id AS description, 'open' AS status, 'normal' AS priority FROM ({_BUGS})")
def r09(spark, sf):
    return R.report_bugs(_bugs(spark, sf)).select("bug_id", "description", "status", "priority")


@query(
    "r10_audit_rows",
    """SELECT member_id AS actor_id, 'message' AS action, message_id AS resource_id, '{"intent":"' || intent || '"}' AS details FROM px_messages WHERE intent IS NOT NULL""",
    ("messages",),
)
def r10(spark, sf):
    rows = load(spark, sf, "messages").filter(F.col("intent").isNotNull())
    audit = R.audit_rows(rows, F.col("member_id"), "message", "conversation", F.col("message_id"), F.struct("intent"), F.col("ts"))
    return audit.select("actor_id", "action", "resource_id", "details")


@query(
    "r10_conversation_rows",
    f"SELECT message_id, coalesce(message_out, '{rules.ERROR_REPLY}') AS message_out FROM px_messages",
    ("messages",),
)
def r10_conversations(spark, sf):
    return R.conversation_rows(load(spark, sf, "messages")).select("message_id", "message_out")


@query(
    "r11_memory_context",
    f"SELECT member_id, string_agg('- ' || content, chr(10) ORDER BY position) AS context FROM ({_LIVE}) WHERE position <= 20 GROUP BY 1",
    ("memories",),
)
def r11(spark, sf):
    return R.memory_context(P.load_memories(_memories(spark, sf), _now()))
