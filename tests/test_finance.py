from __future__ import annotations

import contextlib
import datetime as dt
import io
import random
import statistics
from decimal import Decimal

from pyspark.sql import functions as F

from paperloom.operators import finance as Z

DOCS = "doc_id bigint, doc_type string, year bigint, amount decimal(18,2)"
BALANCES = "account string, day date, doc_id bigint, balance decimal(18,2)"
DAY = dt.date(2026, 1, 1)


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_sums_after_any_changes_equal_a_recount(spark):
    rng = random.Random(2)
    new = lambda i: (i, rng.choice(["a", "b", None]), rng.choice([2020, 2021, None]), rng.choice([Decimal("1.50"), Decimal("-7.25"), None]))
    held = {i: new(i) for i in range(40)}
    keys = ["doc_type", "year"]
    frame = lambda r: spark.createDataFrame(list(r), DOCS)
    sums = Z.sums_of(frame(held.values()), keys)
    for _ in range(3):
        gone = rng.sample(sorted(held), 8)
        before = [held.pop(i) for i in gone]
        after = [new(i) for i in gone[:4]] + [new(rng.randrange(1000, 9000)) for _ in range(3)]
        held |= {r[0]: r for r in after}
        sums = Z.add_sums(sums, Z.sum_delta(frame(before), frame(after), keys), keys)
    assert rows(sums) == rows(Z.sums_of(frame(held.values()), keys))
    nothing = Z.add_sums(sums, Z.sum_delta(frame(held.values()), frame([]), keys), keys)
    assert nothing.collect() == []


def test_latest_balance_that_is_taken_back(spark):
    at = lambda n: DAY + dt.timedelta(days=n)
    old = [("x", at(1), 1, Decimal(10)), ("x", at(3), 2, Decimal(20)), ("y", at(2), 3, Decimal(5)), ("z", at(1), 4, Decimal(1)), ("n", None, 9, Decimal(1)), (None, at(1), 10, Decimal(3))]
    frame = lambda r: spark.createDataFrame(r, BALANCES)
    before, after = [old[1], old[3]], [("y", at(2), 5, Decimal(6)), ("w", at(0), 6, Decimal(2)), ("x", at(0), 7, Decimal(99))]
    kept = [r for r in old if r not in before] + after
    got = Z.refresh_latest(Z.latest_balances(frame(old)), frame(before), frame(after), frame(kept))
    assert rows(got) == rows(Z.latest_balances(frame(kept)))
    assert {r["account"]: int(r["balance"]) for r in got.collect()} == {"x": 10, "y": 6, "w": 2, None: 3}


def test_report_fills_missing_months(spark):
    rows_in = [("a", dt.date(2025, 11, 3), 100), ("a", dt.date(2026, 2, 1), 50), ("b", dt.date(2026, 1, 9), 10), (None, dt.date(2026, 1, 2), 5), ("c", None, 7)]
    got = {(r["account"], r["is_total"], r["month"].isoformat()[:7]): r for r in Z.monthly_report(spark.createDataFrame(rows_in, "account string, day date, amount int")).collect()}
    value = lambda a, m, t=False: tuple(None if x is None else float(x) for x in (got[a, t, m]["amount"], got[a, t, m]["previous"], got[a, t, m]["change"], got[a, t, m]["change_pct"]))
    assert value("a", "2025-11") == (100, None, None, None) and value("a", "2025-12") == (0, 100, -100, -100)
    assert value("a", "2026-01") == (0, 0, 0, None) and value("a", "2026-02") == (50, 0, 50, None)
    assert value("b", "2026-02") == (0, 10, -10, -100) and value(None, "2026-01") == (5, None, None, None)
    assert value(None, "2025-11", True) == (100, None, None, None) and value(None, "2026-01", True) == (15, 0, 15, None) and value(None, "2026-02", True) == (50, 15, 35, 233.33)
    assert len(got) == 4 + 2 + 2 + 4
    assert Z.monthly_report(spark.createDataFrame([], "account string, day date, amount decimal(18,2)")).collect() == []


def test_validity_is_an_equality_join(spark):
    rng = random.Random(3)
    day = lambda: DAY + dt.timedelta(days=rng.randrange(-400, 400))
    agreements = [(i, i % 4, rng.choice([None, day()]), rng.choice([None, day(), day()])) for i in range(120)]
    days = sorted({day() for _ in range(15)})
    left = spark.createDataFrame(agreements, "document_id bigint, household bigint, start_date date, end_date date")
    right = spark.createDataFrame([(d,) for d in days], "as_of date")
    held = {(i, d) for i, _, s, e in agreements for d in days if (s is None or s <= d) and (e is None or d <= e)}
    for bins in (7, 92):
        got = Z.in_force(left, right, bins)
        found = [(r["document_id"], r["as_of"]) for r in got.collect()]
        assert set(found) == held and len(found) == len(held)
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    soon = {(r["document_id"], r["as_of"]) for r in Z.expiring(left, right).collect()}
    assert soon == {(i, d) for i, d in held if (e := agreements[i][3]) is not None and (e - d).days <= 30}
    assert Z.in_force(left, right.limit(0)).collect() == [] and Z.in_force(left.limit(0), right).collect() == []


def test_spikes_against_each_vendors_own_days(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["v", "v", "w", None]), rng.choice([None, *[DAY + dt.timedelta(days=rng.randrange(30))] * 20]), rng.choice([Decimal(rng.randrange(1000)) / 7, Decimal(5000), None])) for i in range(300)]
    data = [(i, v, d, None if a is None else a.quantize(Decimal("0.01"))) for i, v, d, a in data]
    frame = spark.createDataFrame(data, "transaction_id bigint, vendor string, day date, amount decimal(18,2)")
    got = {r["transaction_id"]: r for r in Z.spending_spikes(frame, 10, 1.0, 3, hot_rows=5).collect()}
    assert len(got) == 300
    for i, v, d, a in data:
        seen = [float(y) for _, w, x, y in data if v is not None and w == v and d is not None and x is not None and y is not None and 1 <= (d - x).days <= 10]
        assert got[i]["n_before"] == len(seen)
        if len(seen) > 1:
            limit = statistics.mean(seen) + statistics.stdev(seen)
            assert got[i]["spike"] == (len(seen) >= 3 and a is not None and float(a) > limit)
            assert abs(got[i]["deviation_before"] - statistics.stdev(seen)) < 1e-6 * (1 + statistics.stdev(seen))
        else:
            assert not got[i]["spike"]
    # the trailing frame runs over days, not over transactions
    assert "Window" in plan(Z.spending_spikes(frame))
