from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators import canonical as M
from paperloom.operators import classify as C
from paperloom.operators import extract as X
from paperloom.operators import ingest, routing
from paperloom.plans.documents import build_library
from paperloom.sources.files import extension

BILL = """
    חשבון לתקופה: 01/03/2026 01/02/2026
    עם חשמל ירוק של
    מספר צרכן אלקטרה פאוור: 377035968
    חשבונית מס/קבלה (מקור) 55940425
    תאריך עריכת החשבון: 01/03/2026
    חיוב ₪ 208.37 צריכה מאלקטרה פאוור
    """


@pytest.mark.parametrize(
    "text,name,category",
    [
        ("Electra Power monthly bill", "electra_bill.pdf", "electricity_bill"), ("invoice total $200", "doc.pdf", "invoice"),
        ("receipt for purchase", "doc.pdf", "receipt"), ("rental agreement signed", "agreement.docx", "contract"),
        ("bank statement january 2026", "statement.pdf", "bank_statement"), ("credit card statement", "doc.pdf", "credit_card_statement"),
        ("insurance policy renewal", "doc.pdf", "insurance"), ("warranty certificate 2 years", "doc.pdf", "warranty"),
        ("official government notice", "doc.pdf", "official_letter"), ("monthly payslip pay stub", "salary_slip.png", "salary_slip"),
        ("תלוש שכר חודשי ברוטו נטו", "salary.pdf", "salary_slip"), ("mentions a credit card", "insurance.pdf", "insurance"), ("", "x.pdf", "other"),
    ],
)
def test_keyword_classes(spark, text, name, category):
    row = spark.createDataFrame([(text, name)], "t string, n string").select(C.classify_keywords(F.col("t"), F.col("n")).alias("c")).first()["c"]
    assert row["category"] == category and row["category"] in rules.CATEGORIES
    assert row["confidence"] == (0.0 if category == "other" else 0.9 if any(k in name for _, ks in rules.KEYWORD_RULES for k in ks) else 0.8)


@pytest.mark.parametrize(
    "text,facts",
    [
        ("תאריך חשבונית: 15/03/2026 סכום לתשלום", {"source_date": "15/03/2026"}), ("Invoice date: 2026-03-15", {"source_date": "2026-03-15"}),
        ('סה"כ לתשלום: ₪ 428.50', {"amount": "428.50", "currency": "ILS"}), ("Total: $1,200.00", {"amount": "1200.00", "currency": "USD"}),
        ("no date here at all", {}), ("3 מרץ 2026", {"source_date": "3 מרץ 2026"}), ("pay 12 usd now", {"amount": "12", "currency": "ILS"}),
        ("$, then €7", {"amount": "7", "currency": "EUR"}), ("$, x €7", {"amount": "7", "currency": "USD"}), ("2026-01-02 before 3/4/25", {"source_date": "3/4/25"}), ("  ", {}),
    ],
)
def test_regex_facts(one, text, facts):
    got = one(X.regex_facts, text)
    assert {f["fact_key"]: f["fact_value"] for f in got} == facts
    assert all(f["fact_key"] in rules.FACT_KEYS and len(f["source_excerpt"]) <= 250 for f in got)


def test_excerpt_counts_characters_not_code_units(one):
    text = "😀" * 40 + " on 2026-03-15 " + "y" * 50
    assert one(X.date_fact, text)["source_excerpt"] == "😀" * 26 + " on 2026-03-15 " + "y" * 29


def test_issuer(spark):
    rows = spark.createDataFrame([(BILL, "55863951.pdf"), ("מספר צרכן אלקטרה צריכה מאלקטרה", "a.pdf")], "t string, n string")
    first, second = [r["r"] for r in rows.select(C.resolve_issuer(F.col("t"), F.col("n")).alias("r")).collect()]
    assert first["doc_type"] == "electricity_bill" and first["routing_key"] == "utility_bill:electricity:electra_power"
    assert first["metadata"]["issuer_account_number"] == "377035968" and first["metadata"]["issuer_bill_number"] == "55940425"
    assert second is None


def test_library_of_one_bill(spark):
    raw = spark.createDataFrame(
        [(1, 7, "whatsapp", "bill.pdf", BILL, dt.datetime(2026, 3, 2)), (2, 7, "email", "note.pdf", "", None)],
        "doc_id bigint, uploaded_by bigint, source string, filename string, raw_text string, created_at timestamp",
    )
    library = build_library(raw)
    bill = library["utility_bills"].collect()
    assert len(bill) == 1 and bill[0]["provider_slug"] == "electra_power" and bill[0]["service_type"] == "electricity"
    assert (bill[0]["period_end"], bill[0]["period_start"], float(bill[0]["amount_due"])) == (dt.date(2026, 3, 1), dt.date(2026, 2, 1), 208.37)
    docs = {r["doc_id"]: r for r in library["documents"].collect()}
    assert docs[1]["review_state"] == "auto_verified" and docs[2]["review_state"] == "needs_review"
    assert docs[2]["failed_signals"] == ["classification_confidence=0.00<0.5", "text_extraction_empty", "no_facts_and_no_summary"]
    assert library["document_facts"].filter("document_id = 2").count() == 0


def test_in_row_promotion_equals_the_join(spark):
    facts = [(1, 0, "amount", "abc", 0.9), (1, 1, "amount", "1,000", 0.9), (1, 2, "amount", "7", 0.9), (1, 3, "source_date", "15/03/2026", 0.5), (1, 4, "counterparty", " ACME ", 0.6)]
    docs = spark.createDataFrame([(1, None, None, "ILS", None), (2, "V", None, None, None)], "doc_id bigint, vendor string, amount decimal(18,2), currency string, doc_date date")
    rows = spark.createDataFrame(facts, "document_id bigint, fact_seq bigint, fact_key string, fact_value string, confidence double")
    joined = {r["doc_id"]: r for r in M.promote_facts(docs, rows).collect()}
    packed = rows.groupBy(F.col("document_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("fact_seq", "fact_key", "fact_value", "confidence"))).alias("facts"))
    in_row = {r["doc_id"]: r for r in M.promote_in_row(docs.join(packed, "doc_id", "left")).collect()}
    for column in ("vendor", "amount", "currency", "doc_date"):
        assert [joined[i][column] for i in (1, 2)] == [in_row[i][column] for i in (1, 2)]
    assert joined[1]["vendor"] == "ACME" and float(joined[1]["amount"]) == 1000.0 and joined[1]["doc_date"] is None


def test_chunk_merge_keeps_first_confidence_of_a_repeated_value(spark):
    items = [(1, 0, "contract", "parties", "A", 0.4, "e0"), (1, 1, "contract", "parties", "A", 0.9, "e1"), (1, 2, "contract", "parties", "B", 0.5, "e2"),
             (1, 3, "contract", "amount", "5", 0.5, "e3"), (1, 4, "contract", "amount", "6", 0.5, "e4"), (1, 5, "contract", "nonsense", "x", 1.0, "")]
    rows = spark.createDataFrame(items, "document_id bigint, fact_seq bigint, fact_type string, fact_key string, fact_value string, confidence double, source_excerpt string")
    got = {r["fact_key"]: (r["fact_value"], r["confidence"], r["source_excerpt"]) for r in X.merge_chunk_facts(rows).collect()}
    assert got == {"parties": ("A; B", 0.5, "e0"), "amount": ("5", 0.5, "e3")}


def test_salary_payload_and_choice(spark):
    good = 'x {"employee_name": " Dana ", "pay_month": "2026-01", "gross_salary": 10, "net_salary": "8.5", "income_tax": "n/a", "confidence": 3} y'
    weak = '{"gross_salary": 1, "confidence": 0.2}'
    rows = spark.createDataFrame([(good, weak), (weak, good), (weak, "none"), ("none", weak), ("none", "none")], "a string, b string")
    got = [r["r"] for r in rows.select(X.better_payload(X.salary_payload(F.col("a")), X.salary_payload(F.col("b"))).alias("r")).collect()]
    assert [r["model"] for r in got] == [rules.SALARY_PASS_LABELS[i] for i in (0, 1, 0, 1, 0)]
    p = got[0]["payload"]
    assert (p["employee_name"], p["gross_salary"], p["net_salary"], p["income_tax"], p["confidence"]) == ("Dana", 10.0, 8.5, None, 1.0)
    assert got[4]["payload"] is None


def test_review_of_salary(spark):
    rows = spark.createDataFrame([((10000.0, 7800.0, 0.91),), ((10000.0, 0.0, 0.91),), ((None, None, 0.1),)], "p struct<gross_salary:double,net_salary:double,confidence:double>")
    got = rows.select(M.salary_review_state(F.col("p")).alias("s"), M.salary_review_reason(F.col("p")).alias("r")).collect()
    assert [tuple(r) for r in got] == [
        ("auto_verified", None), ("needs_review", "missing_net_salary"), ("needs_review", "low_confidence,missing_gross_salary,missing_net_salary")
    ]


def test_employee_address_takes_a_name_with_pattern_characters(spark):
    text = "שם: A.(B) 12 דירה 3\n רחוב הרצל 5\n חיפה"
    rows = spark.createDataFrame([(text, "A.(B)"), (text, "Nobody"), (text, None)], "t string, n string")
    assert [r[0] for r in rows.select(M.employee_address(F.col("t"), F.col("n"))).collect()] == ["רחוב הרצל 5", None, None]


def test_display_names(spark):
    rows = spark.createDataFrame(
        [("invoice", "ACME", dt.date(2026, 3, 1)), ("invoice", None, dt.date(2026, 3, 1)), ("invoice", " ", None), ("invoice", "ACME", None), ("other", "ACME", dt.date(2026, 3, 1)),
         ("salary_slip", None, None), (None, None, None)], "t string, v string, d date")
    got = [r[0] for r in rows.select(M.display_name(F.col("t"), F.col("v"), F.col("d"))).collect()]
    assert got == ["חשבונית ACME מרץ 2026", "חשבונית מרץ 2026", "חשבונית", "חשבונית ACME", "מסמך 2026-03-01", "מסמך", "מסמך"]


def test_copies_of_one_file_by_one_uploader(spark):
    """A third of all rows share one content; the hot path must give the same owners as the plain one."""
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("uploaded_by"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit("")).otherwise((F.col("id") % 700).cast("string")).alias("file_hash")
    )
    catalog = spark.createDataFrame([(9001, 1, "5")], "doc_id bigint, uploaded_by bigint, file_hash string")
    plain = ingest.split_duplicates(rows, catalog).collect()
    hot = ingest.split_duplicates(rows, catalog, hot_rows=100).collect()
    assert {(r["doc_id"], r["existing_id"]) for r in plain} == {(r["doc_id"], r["existing_id"]) for r in hot}
    seen: dict[str, int] = {"5": 9001}
    for r in sorted(hot, key=lambda r: r["doc_id"]):
        expected = None if r["file_hash"] == "" else seen.setdefault(r["file_hash"], r["doc_id"])
        assert r["existing_id"] == (None if expected == r["doc_id"] else expected)


def test_extension_and_route(spark):
    rows = spark.createDataFrame([("a/b.PDF",), (".hidden",), ("x.tar.gz",), ("noext",), ("dir.v1/file",)], "p string")
    assert [r[0] for r in rows.select(extension(F.col("p"))).collect()] == [".pdf", "", ".gz", "", ""]
    routes = spark.createDataFrame([("other", "x.pdf"), ("other", "PaySlip.docx"), ("recipe", "x.png"), ("other", "x.docx"), ("contract", "x")], "t string, p string")
    got = [r[0][0] + ">" + r[0][1] for r in routes.select(routing.route(F.col("t"), F.col("p"))).collect()]
    assert got == ["google_docai>tesseract", "google_docai>bedrock_vision", "google_docai>bedrock_vision", "tesseract>bedrock_vision", "google_docai>bedrock_vision"]
