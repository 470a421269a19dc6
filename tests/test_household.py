from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.operators import access as A
from paperloom.operators import catalog as Q
from paperloom.operators import memory as P
from paperloom.operators import tasks as T
from paperloom.operators.classify import parse_command
from paperloom.operators.skew import carry, previous


def test_unknown_role_and_missing_level_are_refused_before_reading(spark):
    docs = spark.createDataFrame([], "doc_id bigint")
    for role in ("stranger", ""):
        with pytest.raises(A.AccessDenied):
            A.project_documents(docs, role)
    with pytest.raises(A.AccessDenied):
        Q.list_policies(docs, "finance_agent", F.current_date())
    with pytest.raises(A.AccessDenied):
        Q.list_contracts(docs, "orchestrator", F.current_date())
    assert not A.check_access("orchestrator", "documents", "write") and A.check_access("librarian", "documents", "read_write")


def test_categories_by_role(spark):
    rows = spark.createDataFrame([(r, c) for r in ("parent", "child") for c in ("basic_personal", "household_access", "financial", "health", "odd")], "r string, c string")
    got = [x[0] for x in rows.select(A.may_read_category(F.col("r"), F.col("c"))).collect()]
    assert got == [True, True, True, True, False, True, True, False, False, False]


def test_assignees(spark):
    members = spark.createDataFrame([(1, "Dana", True), (2, "Daniel", True), (3, "Noa Bar", True), (4, "Noa Gal", True), (5, "Ron", False), (6, "dana ", True)], "member_id bigint, name string, is_active boolean")
    asked = ["לDaniel", "noa", "bar", "Ron", " ", None, "Dana", "של  Noa   Gal", "an"]
    requests = spark.createDataFrame([(i, p) for i, p in enumerate(asked)], "request_id int, person string")
    got = {r["request_id"]: (r["outcome"], r["member_id"]) for r in A.resolve_assignees(requests, members).collect()}
    assert [got[i] for i in range(9)] == [
        ("exact", 2), ("ambiguous", None), ("partial", 3), ("not_found", None), ("unspecified", None), ("unspecified", None), ("ambiguous", None), ("exact", 4), ("ambiguous", None)
    ]


def test_exclusion_rules(spark):
    rows = [(1, 7, "My PASSWORD is x"), (2, 7, "tea 17"), (3, 8, "tea 17"), (4, 8, "credentials"), (5, None, "plain"), (None, 8, "my password"), (6, 9, "nothing"), (6, 9, "my password"), (7, 9, "coffee"), (8, 10, "a]b"), (9, 10, "\u0663 cups")]
    contents = spark.createDataFrame(rows, "memory_id bigint, member_id bigint, content string")
    own = [("tea [0-9]+7$", "regex", 7, True), ("(broken", "regex", None, True), ("plain", "keyword", None, False), ("(?P<a_b>cof)(?P<c>f)ee(?P=c)?", "regex", 9, True), ("[]x[]b", "regex", 10, True), (r"^\d cups\Z", "regex", 10, True), (r"\p{L}+", "regex", 10, True)]
    expected = {(1, 7): [True], (2, 7): [True], (3, 8): [False], (4, 8): [False], (5, None): [False], (None, 8): [True], (6, 9): [False, True], (7, 9): [True], (8, 10): [True], (9, 10): [True]}
    for more in ([], [(f"never{i} [0-9]{{3}}", "regex", i % 3 or None, True) for i in range(700)]):
        table = P.default_rules(spark).unionByName(spark.createDataFrame(own + more, "pattern string, exclusion_type string, member_id bigint, is_active boolean"))
        got = {}
        for r in P.mark_excluded(contents, table, "memory_id").collect():
            got.setdefault((r["memory_id"], r["member_id"]), []).append(r["excluded"])
        assert {k: sorted(v) for k, v in got.items()} == expected


def test_duplicate_requests_against_pairs(spark):
    base = dt.datetime(2026, 1, 1)
    tasks = [(i, f"t{i % 3}", 1, "open" if i % 4 else "done", base + dt.timedelta(seconds=97 * i)) for i in range(40)]
    requests = [(i, f"t{i % 3}", 1, base + dt.timedelta(seconds=131 * i)) for i in range(40)]
    t = spark.createDataFrame(tasks, "task_id bigint, title string, created_by bigint, status string, created_at timestamp")
    r = spark.createDataFrame(requests, "request_id bigint, title string, created_by bigint, created_at timestamp")
    got = {x["request_id"]: x["duplicate"] for x in T.mark_duplicate_requests(r, t).collect()}
    stored = [(ti, c) for _, ti, _, s, c in tasks if s == "open"]
    for rid, title, _, at in requests:  # one after the other, as they come
        hit = any(ti == title and at - dt.timedelta(seconds=300) <= c <= at for ti, c in stored)
        assert got[rid] == hit
        if not hit:
            stored.append((title, at))


def test_changes_of_one_task_in_one_batch(spark):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    tasks = spark.createDataFrame([(1, 5, 3, "open", None), (2, 5, None, "open", None)], "task_id bigint, created_by bigint, assigned_to bigint, status string, completed_at timestamp")
    changes = spark.createDataFrame(
        [(10, 1, "done", None, 9, at(1)), (11, 1, "archived", 4, 9, at(2)), (12, 1, None, 6, 8, at(3)), (13, 7, "done", 1, 9, at(1)), (14, 2, None, 6, 8, at(3))],
        "change_id bigint, task_id bigint, new_status string, new_assignee bigint, actor_id bigint, changed_at timestamp",
    )
    updated, audit = T.update_status(tasks, changes)
    assert {r["task_id"]: (r["status"], r["completed_at"]) for r in updated.collect()} == {1: ("archived", at(1)), 2: ("open", None)}
    assert sorted((r["resource_id"], r["details"]) for r in audit.collect()) == [(1, '{"new_status":"archived"}'), (1, '{"new_status":"done"}')]
    updated, audit = T.reassign(tasks, changes)
    assert {r["task_id"]: r["assigned_to"] for r in updated.collect()} == {1: 6, 2: 6}
    assert sorted((r["resource_id"], r["actor_id"], r["details"]) for r in audit.collect()) == [
        (1, 8, '{"previous_assignee":"4","new_assignee":"6"}'), (1, 9, '{"previous_assignee":"3","new_assignee":"4"}'), (2, 8, '{"new_assignee":"6"}')
    ]


def test_carry_equals_a_walk_in_time_order(spark):
    """One member holds most rows; the walk crosses many time buckets."""
    rows = [(i, 1 if i % 4 else 2, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=(i * 37) % 500, hours=i % 60), f"v{i}" if i % 5 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, member_id bigint, ts timestamp, v string")
    got = {r["event_id"]: (r["before"], r["upto"], r["link"]) for r in previous(
        carry(carry(df, "member_id", "ts", "event_id", F.col("v"), "before", 7200, False), "member_id", "ts", "event_id", F.col("v"), "upto", 7200, True),
        "member_id", "ts", "event_id", ["event_id"], "link", 7200).select("event_id", "before", "upto", F.col("link.event_id").alias("link")).collect()}
    last: dict[int, str | None] = {}
    link: dict[int, int] = {}
    for event_id, member, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        before = last.get(member)
        upto = v if v is not None else before
        assert got[event_id] == (before, upto, link.get(member))
        last[member], link[member] = upto, event_id


def test_commands(one):
    ask = lambda text: one(parse_command, text)
    assert ask("  משימה חדשה: לקנות חלב ")["params"] == {"title": "לקנות חלב"}
    assert (ask("כן")["action"], ask("Cancel")["action"], ask("done 3")["params"]) == ("confirm", "cancel", {"index": "3"})
    assert (ask("משימה לדנה - לצבוע")["action"], ask("משימה לדנה - לצבוע")["params"]) == ("create", {"assignee_name": "דנה", "title": "לצבוע"})
    assert ask("מסמכים עם תגית #tax-2025")["params"] == {"tag": "tax-2025"}
    assert ask("show latest 12 documents")["params"] == {"limit": "12"}
    assert ask("just chatting") is None and ask("paid it")  is None
    assert (ask("my ID please")["skill"], ask("my ID please")["action"]) == ("fact", "store_or_query_id")


def test_enum_domains_quarantine(spark):
    rows = spark.createDataFrame([("nudge", "fact"), ("manual", "fact"), (None, "odd")], "source string, category string")
    valid, bad = T.split_valid(rows, {"source": "memory_source", "category": "memory_category"})
    assert valid.count() == 1 and sorted(r["violations"][0] for r in bad.collect()) == ["category", "source"]
