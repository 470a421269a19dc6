from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare

NAMES = [
    "s06_year_tag", "s16_mask_pii", "i06_duplicates", "i12_message_ids", "x02_best_candidate", "c02_class_policy", "f06_merge_chunk_facts", "m02_promote_facts",
    "q09_recent_documents", "a05_member_permission", "t08_clean_up", "p04_touch_memories", "r06_morning_briefing", "w06_task_signals", "w09_daily_counts",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = duck.execute(entry.oracle_sql()[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, got.fetchall(), [c[0] for c in got.description]) is None


def test_every_query_has_sql():
    assert {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"} == set()


def test_entry(spark):
    rows = {r["metric"]: r["value"] for r in entry.entry(spark).collect()}
    assert rows["total_documents"] == sum(v for k, v in rows.items() if k.startswith("type:")) == 1500
