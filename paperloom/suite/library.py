"""The whole document plan, from raw text to catalog, typed tables and statistics."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import catalog as Q
from paperloom.plans.documents import build_library
from paperloom.suite.classification import _KEYWORDS
from paperloom.suite.extraction import CHOSEN
from paperloom.suite.registry import query
from paperloom.suite.shapes import load

RAW = ["doc_id", "uploaded_by", "source", "filename", "raw_text", "created_at"]

_READ = f"""SELECT *, CASE WHEN by_name IS NOT NULL THEN by_name WHEN sheet THEN 'other' WHEN by_text IS NOT NULL THEN by_text ELSE 'other' END AS category,
    CASE WHEN by_name IS NOT NULL THEN 0.9 WHEN sheet THEN 0.3 WHEN by_text IS NOT NULL THEN 0.8 ELSE 0.0 END AS conf, doc_id % 11 <> 0 AS has_text FROM ({_KEYWORDS})"""
# a document without text has no facts either; a salary slip without a model's answers has none and waits for review
_STATE = "CASE WHEN conf >= 0.5 AND has_text AND category <> 'salary_slip' THEN 'auto_verified' ELSE 'needs_review' END"
_FACTS = "has_text AND category <> 'salary_slip'"


@query(
    "library_stats",
    f"""WITH r AS ({_READ}) SELECT 'total_documents' AS metric, count(*) AS value FROM r UNION ALL SELECT 'needs_review', count(*) FROM r WHERE {_STATE} = 'needs_review'
    UNION ALL SELECT 'type:' || category, count(*) FROM r GROUP BY category UNION ALL SELECT 'document_facts', 3 * count(*) FROM r WHERE {_FACTS} UNION ALL SELECT 'utility_bills', 0 UNION ALL SELECT 'salary_slips', count(*) FROM r WHERE category = 'salary_slip'
    UNION ALL SELECT 'contracts', count(*) FROM r WHERE has_text AND category = 'contract' UNION ALL SELECT 'insurance_policies', count(*) FROM r WHERE has_text AND category = 'insurance'""",
    ("documents",),
)
def library_stats(spark, sf):
    library = build_library(load(spark, sf, "documents").select(*RAW))
    return Q.library_stats(library.pop("documents"), library, "librarian")


@query(
    "library_documents",
    f"""WITH r AS ({_READ}) SELECT doc_id, category AS doc_type, CAST(CASE WHEN {_FACTS} THEN true_amount END AS DOUBLE) AS amount, CASE WHEN {_FACTS} THEN true_date END AS doc_date,
      CASE WHEN {_FACTS} THEN 'ILS' END AS currency, {_STATE} AS review_state,
      concat_ws('|', category, {_STATE}, CASE WHEN {_FACTS} THEN CAST(year(true_date) AS VARCHAR) ELSE nullif('', '') END) AS tags FROM r""",
    ("documents",),
)
def library_documents(spark, sf):
    docs = build_library(load(spark, sf, "documents").select(*RAW))["documents"]
    return docs.select(
        "doc_id", "doc_type", F.col("amount").cast("double").alias("amount"), "doc_date", "currency", "review_state", F.array_join("tags", "|").alias("tags")
    )


@query(
    "library_bills",
    """SELECT doc_id AS document_id, true_service AS service_type, true_account AS account_number, true_bill AS bill_number, true_issue_date AS issue_date, true_start AS period_start, true_end AS period_end
    FROM px_bills WHERE true_service IS NOT NULL""",
    ("bills",),
)
def library_bills(spark, sf):
    raw = load(spark, sf, "bills").select("doc_id", "uploaded_by", "source", "filename", "raw_text", F.lit(None).cast("timestamp").alias("created_at"))
    return build_library(raw)["utility_bills"].select(
        "document_id", "service_type", "account_number", "bill_number", "issue_date", "period_start", "period_end"
    )


@query(
    "library_bill_documents",
    """SELECT doc_id, CASE WHEN true_service IS NOT NULL THEN true_issue_date END AS billed_date, true_service IS NOT NULL AS named FROM px_bills""",
    ("bills",),
)
def library_bill_documents(spark, sf):
    """What a bill writes back into its own document."""
    raw = load(spark, sf, "bills").select("doc_id", "uploaded_by", "source", "filename", "raw_text", F.lit(None).cast("timestamp").alias("created_at"))
    library = build_library(raw)
    bills = library["utility_bills"].select(F.col("document_id").alias("doc_id"), "issue_date", "provider_name")
    docs = library["documents"].join(bills, "doc_id", "left")
    return docs.select("doc_id", F.col("issue_date").alias("billed_date"), F.coalesce(F.col("vendor") == F.col("provider_name"), F.lit(False)).alias("named"))


@query(
    "library_salary_slips",
    f"""SELECT doc_id AS document_id, CASE WHEN valid THEN true_employee END AS employee_name, CASE WHEN valid THEN true_employer END AS employer_name,
      CASE WHEN valid THEN true_gross END AS gross_salary, CASE WHEN valid AND has_net THEN true_net END AS net_salary,
      CASE WHEN valid AND conf >= 0.6 AND has_net THEN 'auto_verified' ELSE 'needs_review' END AS review_state, CAST(doc_id % 77 AS VARCHAR) AS department
    FROM ({CHOSEN})""",
    ("slips",),
)
def library_salary_slips(spark, sf):
    raw = load(spark, sf, "slips").select(
        "doc_id", "uploaded_by", "source", F.concat(F.lit("scan"), F.col("doc_id"), F.lit(".pdf")).alias("filename"), "raw_text",
        F.lit(None).cast("timestamp").alias("created_at"), "first_answer", "second_answer",
    )
    slips = build_library(raw, slip_answers=("first_answer", "second_answer"))["salary_slips"]
    number = lambda c: F.col(c).cast("double").alias(c)
    return slips.select("document_id", "employee_name", "employer_name", number("gross_salary"), number("net_salary"), "review_state", "department")


def _fact_answers(docs):
    """A model's answer about every document: a list of facts, of which every fifth is cut off."""
    k, word = F.col("doc_id"), lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    fact = lambda key, value: F.struct(F.lit(key).alias("fact_key"), value.alias("fact_value"), F.lit("0.7").alias("confidence"), F.lit("").alias("source_excerpt"))
    end = F.date_format(F.date_add("true_date", 365), "yyyy-MM-dd")
    facts = F.to_json(
        F.array(
            fact("contract_type", word("type ", k % 4)), fact("counterparty", word("Party ", k % 50)), fact("contract_end_date", end), fact("amount", F.lit("1.00")),
            fact("policy_number", word("P-", k)), fact("insurance_type", word("kind ", k % 3)), fact("coverage_limit", word(k % 1000, ".50")),
        )
    )
    answer = F.when(k % 5 == 0, F.substring(facts, 1, 40)).otherwise(F.concat(F.lit("Here:\n"), facts))
    return docs.select(k.alias("document_id"), F.lit(0).alias("chunk_id"), answer.alias("answer"))


def _answered_library(spark, sf):
    docs = load(spark, sf, "documents")
    return build_library(docs.select(*RAW), fact_answers=_fact_answers(docs))


_ANSWERED = "doc_id % 5 <> 0"


@query(
    "library_contracts",
    f"""WITH r AS ({_READ}) SELECT doc_id AS document_id, CASE WHEN {_ANSWERED} THEN 'type ' || (doc_id % 4) END AS contract_type, CASE WHEN {_ANSWERED} THEN 'Party ' || (doc_id % 50) END AS counterparty,
      true_date AS contract_date, CASE WHEN {_ANSWERED} THEN true_date + 365 END AS end_date, CAST(true_amount AS DOUBLE) AS amount FROM r WHERE has_text AND category = 'contract'""",
    ("documents",),
)
def library_contracts(spark, sf):
    rows = _answered_library(spark, sf)["contracts"]
    return rows.select("document_id", "contract_type", "counterparty", "contract_date", "end_date", F.col("amount").cast("double").alias("amount"))


@query(
    "library_policies",
    f"""WITH r AS ({_READ}) SELECT doc_id AS document_id, CASE WHEN {_ANSWERED} THEN 'kind ' || (doc_id % 3) END AS insurance_type, CASE WHEN {_ANSWERED} THEN 'P-' || doc_id END AS policy_number,
      CASE WHEN {_ANSWERED} THEN 'Party ' || (doc_id % 50) END AS insurer, CASE WHEN {_ANSWERED} THEN (doc_id % 1000) + 0.5::DOUBLE END AS coverage_limit, true_date AS policy_date
    FROM r WHERE has_text AND category = 'insurance'""",
    ("documents",),
)
def library_policies(spark, sf):
    rows = _answered_library(spark, sf)["insurance_policies"]
    return rows.select("document_id", "insurance_type", "policy_number", "insurer", F.col("coverage_limit").cast("double").alias("coverage_limit"), "policy_date")


@query(
    "library_outcome",
    f"""WITH r AS ({_READ}) SELECT doc_id, CASE WHEN has_text AND NOT {_ANSWERED} THEN 'partial' ELSE 'complete' END AS result, CASE WHEN has_text AND NOT {_ANSWERED} THEN 2 ELSE 3 END AS steps_ok,
      CASE WHEN has_text AND NOT {_ANSWERED} THEN 'fact_extraction' ELSE '' END AS failed FROM r WHERE category IN ('contract', 'insurance')""",
    ("documents",),
)
def library_outcome(spark, sf):
    docs = _answered_library(spark, sf)["documents"].filter(F.col("doc_type").isin("contract", "insurance"))
    return docs.select("doc_id", "outcome.result", "outcome.steps_ok", "outcome.failed")
