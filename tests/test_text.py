from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions import regex
from paperloom.functions.pii import mask_pii, masked_text, restore_pii
from paperloom.functions.quality import quality_band, quality_score
from paperloom.operators import extract


def mask(one, text):
    r = one(masked_text, text)
    return r["text"], [(x["original"], x["placeholder"], x["pattern_type"]) for x in r["records"]]


@pytest.mark.parametrize(
    "text,placeholder,kind",
    [
        ("מספר ת.ז. 123456789 בבקשה", "[ת.ז._1]", "israeli_id"), ("התקשר אליי 0521234567", "[טלפון_1]", "phone"),
        ("כרטיס אשראי 4580 1234 5678 9012", "[כרטיס_1]", "credit_card"), ("שלח מייל ל-user@example.com", "[אימייל_1]", "email"),
        ("חשבון בנק 12-123456", "[חשבון בנק_1]", "bank_account"),
    ],
)
def test_each_mask(one, text, placeholder, kind):
    cleaned, records = mask(one, text)
    assert placeholder in cleaned and [r[2] for r in records] == [kind]


def test_phone_patterns_share_a_counter(one):
    cleaned, records = mask(one, "0541112222, 972521234567 ו-+972531234567")
    assert sorted(r[1] for r in records) == ["[טלפון_1]", "[טלפון_2]", "[טלפון_3]"]
    assert not re.search("[0-9]{9}", cleaned)


def test_short_numbers_stay(one):
    assert mask(one, "קוד 1234 ומספר 56789") == ("קוד 1234 ומספר 56789", [])


def test_id_needs_word_edges(one):
    assert mask(one, "א123456789, a123456789, 1234567890x")[1] == []


def test_restore_is_the_inverse(spark):
    texts = ["ת.ז. 123456789 טלפון 0521234567 מייל test@mail.com", "x@y.co x@y.co 123456789", "plain", ""]
    rows = mask_pii(spark.createDataFrame([(t,) for t in texts], "text string"))
    back = rows.select("text", restore_pii(F.col("masked"), F.col("pii_records")).alias("r")).collect()
    assert all(r["text"] == r["r"] for r in back)


def plain_score(text: str) -> float:
    """The score written out directly, for comparison."""
    t = text.strip()
    if not t:
        return 0.0
    hebrew = sum("֐" <= c <= "׿" for c in t)
    letters = sum(c.isalpha() for c in t)
    share = hebrew / letters if letters else 0.0
    words = t.split()
    mean = sum(map(len, words)) / len(words)
    noise = sum(map(len, re.findall("[bcdfghjklmnpqrstvwxyz]{5,}", t, re.I))) / len(t)
    lines = t.count("\n") + 1
    tiers = [
        1.0 if share >= 0.4 else 0.6 if share >= 0.2 else 0.3 if share >= 0.05 else 0.1,
        1.0 if 2.5 <= mean <= 10 else 0.5 if 1.5 <= mean <= 15 else 0.1,
        1.0 if noise < 0.05 else 0.5 if noise < 0.15 else 0.1,
        1.0 if lines >= 3 else 0.7 if lines == 2 else 0.6 if len(t) < 100 else 0.3,
    ]
    return sum(a * b for a, b in zip(tiers, rules.QUALITY_WEIGHTS))


def test_quality_against_plain_python(spark):
    texts = [
        "שלום עולם\nזהו מסמך בדיקה\nעם מספר שורות של טקסט עברי", "xkjhdf bcdfghjklmnp qrstvwxyz bcdfghjklmnpqrst vwxyz bcdfghjklmnpqrstvwxyz",
        "", "   \t\n  ", "12345 678", "a b c d", "שלום world", "x" * 200, "One line.\nTwo lines here", "é" * 30 + " שלום",
    ]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", quality_score(F.col("x")).alias("q")).orderBy("i").collect()
    for row, text in zip(got, texts):
        assert row["q"] == pytest.approx(plain_score(text)), text
        assert 0.0 <= row["q"] <= 1.0
    assert got[0]["q"] >= 0.5 > got[1]["q"] and got[2]["q"] == got[3]["q"] == 0.0


@pytest.mark.parametrize("score,band", [(0.0, "LOW"), (0.29, "LOW"), (0.299, "LOW"), (0.3, "BORDERLINE"), (0.49, "BORDERLINE"), (0.5, "GOOD"), (1.0, "GOOD")])
def test_bands(one, score, band):
    assert one(quality_band, score, "double") == band


def test_texts_have_more_tasks_than_cores(spark, tmp_path):
    """A table of few bytes a row is dealt to several tasks per core once it has several partitions."""
    from paperloom.session import spread

    cores = spark.sparkContext.defaultParallelism
    spark.range(cores * 2).repartition(cores).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t")).repartition(cores)
    assert spread(scan).rdd.getNumPartitions() == cores and spread(scan, 8).rdd.getNumPartitions() == 8 * cores


def test_offsets_of_the_first_match(spark, one):
    """The text before a match is cut by a pattern that is compiled once, not by a split per row."""
    from paperloom.functions.regex import dialect
    from paperloom.operators.extract import _before_first, amount_facts, date_fact
    from paperloom import rules

    for pattern in [dialect(p, ignore_case=False) for p in rules.DATE_PATTERNS] + [dialect(rules.AMOUNT_PATTERN)]:
        for text in ("é🙂\n on 03/04/2021 and 2020-01-02, 5 March 2020", "x\nTotal: NIS 1,200.50 or $3", "2021-03-04"):
            both = one(lambda x: F.struct(x.rlike(pattern).alias("hit"), _before_first(x, pattern).alias("a"), F.element_at(F.split(x, pattern, 2), 1).alias("b")), text)
            assert not both.hit or both.a == both.b
    plan = spark.range(1).select(date_fact(F.col("id").cast("string")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_patterns_without_letter_case_are_not_folded_and_keep_their_matches(spark):
    assert regex.dialect(r"מספר\s+חשבון\s*\n?\s*(\d+)").startswith("(?d)") and regex.dialect(r"issue\s+date").startswith("(?iud)")
    assert regex.dialect(r"\x41").startswith("(?iud)") and regex.dialect("é").startswith("(?iud)")
    # alternatives may begin or end without a digit: the edges stay as they are
    assert regex.WORD_EDGE in regex.dialect(r"\b(\d{1}|a\d{2})\b") and regex.WORD_EDGE not in regex.dialect(r"\b(\d{5,})\b")
    texts = ["12345", "x12345", "12345x", "_12345", "٣12345", "12345٣", "a 12345, 67890", "é12345 99999", "1234", "שלום12345 54321"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(regex.capture(F.col("t"), r"\b(\d{5,})\b").alias("n")).collect()
    assert [r.n for r in rows] == ["12345", None, None, None, None, None, "12345", "99999", None, "54321"]


def test_a_value_inside_of_a_lambda_is_computed_once(spark):
    nested = regex.let(F.col("t"), lambda t: regex.first_group(t, [r"a(\d+)"]))
    frame = spark.createDataFrame([("xa12",), ("a",), (None,)], "t string").select(nested.alias("n"))
    assert [r.n for r in frame.collect()] == ["12", None, None]
    assert frame._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_extract(") == 1


def test_amounts_whose_first_hits_have_no_digits(spark):
    texts = ["NIS , and then 5 USD", "niſ 3", "nis 7", "NİS 8", "ıls 9", "€ ,, $ 4.50 x", "ILS", None, "sum 1,200.5 שקל"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t"), extract.amount_facts(F.col("t")).alias("f")).collect()
    assert [r.f[0].fact_value if r.f else None for r in got] == ["5", "3", "7", "8", "9", "4.50", None, None, "1200.5"]
    assert [r.f[1].fact_value for r in got if r.f][0] == "USD"
