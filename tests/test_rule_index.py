from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.operators import memory as P
from paperloom.operators import rule_index as R

RULES = "pattern string, exclusion_type string, member_id bigint, is_active boolean"


@pytest.mark.parametrize(
    "pattern, literal",
    [
        ("password", "password"), ("pass(word)?s", "pass"), ("a|bcde", ""), ("(abcd|x)efgh", "efgh"), ("abcd?efg", "abc"), ("abcd+e", "abcd"), ("ab{0,3}cdef", "cdef"),
        (r"\d{3}-\d{4} total", " total"), (r"a\.b\-cd", "a.b-cd"), ("[abcd]efg", "efg"), ("[]a]bcde", "bcde"), ("[^]a]bcde", "bcde"), ("(?i)secret", ""), ("(?P<n>abcd)ef", "ef"),
        (r"(ab)\1cdef", ""), (r"\x41bcd", ""), ("x{", ""), ("a.*bcdef", "bcdef"), ("^start$", "start"), ("", ""), ("ab*?cdef", "cdef"), ("(a)?bcd", "bcd"), (r"\bword\b", "word"),
    ],
)
def test_required_literals(pattern, literal):
    assert R.required_literal(pattern) == literal


def test_literals_are_required():
    """Whatever a random pattern matches holds its literal."""
    rng = random.Random(4)
    atoms = ["a", "b", "ab", "ca", "[ab]", "(ab|c)", "(a)", ".", "a?", "b+", "c*", "a{0,2}", "b{2}", r"\w", r"\.", "|", "^", "(?:bc)", "ab?", "ca+?"]
    texts = ["".join(rng.choice("abc.") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    checked = 0
    for _ in range(1500):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 7)))
        literal = R.required_literal(pattern)
        for t in texts:
            if literal and (m := re.search(pattern, t)):
                checked += 1
                assert literal in m[0], (pattern, t)
    assert checked > 1000


def test_pieces(spark, one):
    for text in ["", "abc", "abcd", "abcdabcd", "ünï çödé", "🙂🙂🙂🙂🙂x"]:
        right = {text[i : i + 4] for i in range(len(text) - 3)}
        assert sorted(one(R.pieces, text)) == sorted(right)
    long = "x" * 300_000 + "needle"
    assert "eedl" in one(R.pieces, long)


def many(spark, n):
    i = F.col("id")
    word = lambda c: F.concat(F.lit("kw"), F.conv(c.cast("string"), 10, 36), F.lit("Zq"))
    return spark.range(n).select(
        F.when(i % 5 == 4, F.concat(word(i), F.lit(" [0-9]+$"))).when(i % 500 == 3, F.concat(F.lit("[0-9]"), F.lit("{2}x"), (i % 7).cast("string"))).otherwise(word(i)).alias("pattern"),
        F.when((i % 5 == 4) | (i % 500 == 3), F.lit("regex")).otherwise(F.lit("keyword")).alias("exclusion_type"),
        F.when(i % 3 == 0, (i % 11).cast("long")).alias("member_id"), (i % 17 != 0).alias("is_active"),
    )


def contents(spark, n):
    i = F.col("id")
    text = F.concat(F.lit("note "), F.when(i % 4 == 0, F.concat(F.lit("KW"), F.conv((i * 7 % 5000).cast("string"), 10, 36), F.lit("zq 12"))).otherwise(F.lit("nothing")), F.when(i % 9 == 0, F.lit(" 77x3")).otherwise(F.lit("")))
    rows = spark.range(n).select(i.alias("memory_id"), F.when(i % 13 != 0, i % 11).alias("member_id"), F.when(i % 101 != 0, F.when(i % 3 == 0, F.lit("same kw1Zq for a third")).otherwise(text)).alias("content"))
    return rows.unionByName(rows.filter("memory_id = 4").withColumn("content", F.lit("Kw4zQ ΟΔΟΣ İx")))


def test_index_equals_arrays(spark):
    table, rows = many(spark, 3000).unionByName(spark.createDataFrame([("ΟΔΟΣ", "keyword", None, True), ("(bad", "regex", None, True), ("", "keyword", 3, True), (None, "keyword", None, True)], RULES)), contents(spark, 2000)
    by = lambda few: sorted(tuple(r) for r in P.mark_excluded(rows, table, "memory_id", few=few).select("memory_id", F.coalesce("member_id", F.lit(-1)), F.coalesce("content", F.lit("~")), "excluded").collect())
    arrays = by(10**9)
    assert by(0) == arrays and by(300) == arrays
    assert 0 < sum(r[3] for r in arrays) < len(arrays)


def test_a_hundred_thousand_rules(spark):
    """No array of all rules: the largest array in the plan's data is that of rules without a literal."""
    table, rows = many(spark, 100_000), contents(spark, 20_000)
    filed, loose = R.file_rules(P._usable(table).cache())
    assert loose.count() <= 300
    crowd = filed.groupBy("scope", "piece").count().agg(F.max("count")).first()[0]
    assert crowd < 3000
    marked = P.mark_excluded(rows, table, "memory_id")
    got = marked.groupBy("excluded").count().collect()
    assert {r["excluded"] for r in got} == {True, False} and sum(r["count"] for r in got) == 20_001


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_numbers_share_no_piece(spark):
    """Dense numbers as rules: each is filed under a piece that few others have, and no exploded side is broadcast."""
    rules = spark.range(100_000, 900_000, 9).select(
        F.concat(F.lit(" "), F.col("id").cast("string")).alias("pattern"), F.lit("keyword").alias("exclusion_type"), F.lit(None).cast("long").alias("member_id"), F.lit(True).alias("is_active")
    )
    filed, _ = R.file_rules(P._usable(rules))
    assert filed.groupBy("piece").count().agg(F.max("count")).first()[0] <= 4
    rows = spark.range(100_000, 901_000, 500).select(F.col("id").alias("memory_id"), (F.col("id") % 7).alias("member_id"), F.concat(F.lit("note "), F.col("id").cast("string"), F.lit("x")).alias("content"))
    marked = P.mark_excluded(rows, rules, "memory_id")
    assert "BroadcastHashJoin" not in plan_of(marked)
    assert {r.memory_id for r in marked.filter("excluded").collect()} == {i for i in range(100_000, 900_000, 500) if (i - 100_000) % 9 == 0}


def test_hardly_any_piece_leaves_its_task(spark):
    """The filter lets through all filed pieces and few others; texts too long to go along are judged as in arrays."""
    filed = spark.range(100_000, 140_000).select(F.lit("*").alias("_scope"), F.concat(F.lit(" "), F.col("id").cast("string")).alias("piece"))
    words = 1 << 14
    word, bits = R._place(F.col("_scope"), F.col("piece"), words)
    passed = lambda rows: rows.filter(F.element_at(R._filter_words(filed, words), word).bitwiseAND(bits) == bits).count()
    assert passed(filed) == 40_000
    assert passed(spark.range(200_000, 240_000).select(F.lit("*").alias("_scope"), F.concat(F.lit(" "), F.col("id").cast("string")).alias("piece"))) < 2_000
    table = many(spark, 3000)
    rows = contents(spark, 1000).withColumn("content", F.concat(F.when(F.col("memory_id") % 2 == 0, F.repeat(F.lit("long "), 100)).otherwise(F.lit("")), "content"))
    by = lambda few: sorted(tuple(r) for r in P.mark_excluded(rows, table, "memory_id", few=few).select("memory_id", F.coalesce("content", F.lit("~")), "excluded").collect())
    assert by(0) == by(10**9)
