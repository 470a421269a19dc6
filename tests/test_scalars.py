from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions.regex import group_numbers


def table(spark, cases, build, kind="string"):
    """Evaluate every case in one job; returns the results in order."""
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r["r"] for r in rows.select("i", build(F.col("x")).alias("r")).orderBy("i").collect()]


def test_amounts(spark):
    got = table(spark, ["1,234.56", " 12 ", "1234", "", "abc", None, "-5.5"], S.parse_amount)
    assert got == [Decimal("1234.56"), Decimal("12.00"), Decimal("1234.00"), None, None, None, Decimal("-5.50")]


def test_integers(spark):
    assert table(spark, [" 12 ", "12.0", "x", "", "-3"], S.parse_int) == [12, None, None, None, -3]


def test_dates(spark):
    cases = ["2026-03-15", "20260315", "15/03/2026", "15.3.2026", "1/2/24", "31/02/2026", "2026-13-01", "n/a", "", "2024-3-1", "15-03-2026", "2024"]
    day = dt.date(2026, 3, 15)
    assert table(spark, cases, S.parse_date) == [day, day, day, day, dt.date(24, 2, 1), None, None, None, None, None, None, None]


def test_pay_period(spark):
    got = table(spark, ["2026-03", "03/2026", "3.2026", "2026-13", "03-26", "March"], S.pay_period)
    assert [tuple(r) for r in got] == [(2026, 3), (2026, 3), (2026, 3), (2026, None), (None, None), (None, None)]


def test_tags(spark):
    assert table(spark, ["#Tax-2025", " HOME ", "", None], S.normalize_tag) == ["tax-2025", "home", "", ""]
    assert table(spark, [["#Tax", "tax", "INSURANCE", " "], None], S.normalize_tags, "array<string>") == [["tax", "insurance"], []]
    rows = spark.createDataFrame([(["tax", "home"], ["#Tax", "insurance"])], "a array<string>, b array<string>")
    assert rows.select(S.merge_tags(F.col("a"), F.col("b")).alias("r")).first()["r"] == ["tax", "home", "insurance"]


@pytest.mark.parametrize("size,chunks", [(0, [0]), (3000, [3000]), (3001, [3000, 301]), (5600, [3000, 2900, 200])])
def test_chunks(one, size, chunks):
    assert [len(c) for c in one(S.chunk_text, "x" * size)] == chunks


def test_phones(spark):
    raw = ["+972-50-123-4567@c.us", "972501234567@lid", "0501234567", "", "abc"]
    assert table(spark, raw, S.normalize_phone) == ["972501234567", "972501234567", "0501234567", "", ""]
    assert table(spark, raw[:3], S.canonical_phone) == ["972501234567"] * 3
    found = table(spark, ["972501234567@c.us", "abc"], S.phone_candidates)
    assert set(found[0]) >= {"972501234567", "+972501234567", "0501234567", "+0501234567"} and found[1] == []
    assert table(spark, ["972501234567", "0501234567", "97250123", "1234567890", "972-501-2345"], S.valid_phone) == [True, True, False, False, False]


def test_recurring_dates(spark):
    rows = spark.createDataFrame(
        [(dt.date(2026, 3, 18), "daily"), (dt.date(2026, 3, 18), "weekly"), (dt.date(2026, 3, 31), "monthly"), (dt.date(2026, 1, 15), "monthly"),
         (dt.date(2028, 2, 29), "yearly"), (dt.date(2026, 3, 18), "never")], "d date, f string")
    got = [r["r"] for r in rows.select(S.advance_date(F.col("d"), F.col("f")).alias("r")).collect()]
    assert got == [dt.date(2026, 3, 19), dt.date(2026, 3, 25), dt.date(2026, 4, 30), dt.date(2026, 2, 15), dt.date(2029, 2, 28), dt.date(2026, 3, 18)]


def test_statements(one):
    assert tuple(one(S.birth_statement, "יוסי נולד ב12.03.2011")) == ("יוסי", "12.03.2011")
    assert tuple(one(S.id_statement, "Dana id 123456")) == ("Dana", "123456")
    assert tuple(one(S.building_code_statement, "Ahuza קוד כניסה 4321")) == ("Ahuza", "4321")
    assert tuple(one(S.birth_statement, "nothing")) == (None, None)


def test_local_time_follows_daylight_saving(one):
    summer = one(lambda x: S.local_time_parts(x.cast("timestamp")), "2026-07-31 21:30:00")
    assert (summer["today_date"], summer["time"], summer["hour"], summer["tomorrow_date"]) == ("2026-08-01", "00:30", 0, "2026-08-02")
    assert summer["today_display"] == "יום שבת, 1 באוגוסט 2026"


def test_task_changes(one):
    got = one(S.task_changes, "כותרת לצבוע קיר עד 2024-01-15 דחוף")
    assert (got["due_date"], got["priority"], got["title"]) == (dt.date(2024, 1, 15), "urgent", "לצבוע קיר")


def test_group_numbers():
    assert group_numbers(r"^(a|b)\s*(?P<one>\d+)(?:x)?(?P<two>[(]+)$") == {"one": 2, "two": 3}
