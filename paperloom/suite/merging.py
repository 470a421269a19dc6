"""Merging, promotion and the typed tables (M-*)."""
from __future__ import annotations

from pyspark.sql import functions as F


from paperloom.operators import canonical as M
from paperloom.operators import classify as C
from paperloom.session import cut_lineage
from paperloom.sources.tables import upsert
from paperloom.suite.extraction import CHOSEN, chosen_payloads
from paperloom.suite.intake import NAME_SQL
from paperloom.suite.registry import query
from paperloom.suite.shapes import load

_DAY = lambda c: f"CAST(try_strptime({c}, ['%Y-%m-%d', '%d/%m/%Y', '%d.%m.%Y']) AS DATE)"
_MONEY = lambda c: f"TRY_CAST(replace({c}, ',', '') AS DECIMAL(18,2))"
_LAST = lambda k: f"max_by(fact_value, fact_seq) FILTER (fact_key = '{k}' AND fact_value <> '') AS {k}"


def _map_sql(keys):
    return f"SELECT document_id, {', '.join(_LAST(k) for k in keys)} FROM px_facts WHERE fact_value <> '' GROUP BY 1"


@query(
    "m01_fact_map",
    "SELECT document_id, amount, currency, source_date, parties, recipe_name FROM ("
    + _map_sql(["amount", "currency", "source_date", "parties", "recipe_name"])
    + ") WHERE coalesce(amount, currency, source_date, parties, recipe_name) IS NOT NULL",
    ("facts",),
)
def m01(spark, sf):
    return M.fact_map(load(spark, sf, "facts"), ["amount", "currency", "source_date", "parties", "recipe_name"])


@query(
    "m02_promote_facts",
    f"""WITH p AS (SELECT document_id,
        min_by(fact_value, fact_seq) FILTER (fact_key = 'counterparty' AND trim(fact_value) <> '') AS vendor2,
        min_by({_MONEY('fact_value')}, fact_seq) FILTER (fact_key = 'amount' AND {_MONEY('fact_value')} IS NOT NULL) AS amount2,
        min_by(fact_value, fact_seq) FILTER (fact_key = 'currency' AND fact_value <> '') AS currency2,
        min_by({_DAY('fact_value')}, fact_seq) FILTER (fact_key = 'source_date' AND {_DAY('fact_value')} IS NOT NULL) AS day2
      FROM px_facts WHERE confidence >= 0.6 GROUP BY 1)
    SELECT doc_id, coalesce(vendor, vendor2) AS vendor, CAST(coalesce(amount, amount2) AS DOUBLE) AS amount, coalesce(currency, currency2) AS currency, coalesce(doc_date, day2) AS doc_date
    FROM px_documents LEFT JOIN p ON document_id = doc_id""",
    ("documents", "facts"),
)
def m02(spark, sf):
    promoted = M.promote_facts(load(spark, sf, "documents"), load(spark, sf, "facts"))
    return promoted.select("doc_id", "vendor", F.col("amount").cast("double").alias("amount"), "currency", "doc_date")


@query(
    "m03_promote_employer",
    f"SELECT doc_id, coalesce(vendor, CASE WHEN valid AND conf >= 0.8 THEN true_employer END) AS vendor FROM ({CHOSEN})",
    ("slips",),
)
def m03(spark, sf):
    from paperloom.operators.extract import payload_facts

    slips = chosen_payloads(spark, sf)
    return M.promote_employer(slips.select("doc_id", "vendor"), payload_facts(slips)).select("doc_id", "vendor")


def _bill_documents(spark, sf):
    # stored once, as a pipeline stores its documents between classification and the typed tables
    docs = cut_lineage(C.resolve_or_classify(load(spark, sf, "bills")), "classified")
    return docs.withColumns(
        {
            "issuer_metadata": F.col("issuer.metadata"), "amount": F.col("true_total"), "currency": F.lit(None).cast("string"),
            "review_state": F.lit("auto_verified"), "vendor": F.lit("old vendor"), "doc_date": F.lit(None).cast("date"),
        }
    )


_BILL_FACTS = f"SELECT document_id, {_LAST('amount')}, {_LAST('currency')} FROM px_facts GROUP BY 1"
_BILLS = f"""SELECT doc_id, doc_id % 4 IN (0, 2) AS power, doc_id % 4 = 1 AS water, doc_id % 4 = 3 AS other, b.*, f.amount AS f_amount, f.currency AS f_currency
    FROM px_bills b LEFT JOIN ({_BILL_FACTS}) f ON document_id = doc_id"""
_NAME = "CASE WHEN power THEN 'אלקטרה פאוור' WHEN water THEN 'מי רעננה' ELSE '' END"


@query(
    "m04_utility_bills",
    f"""SELECT doc_id AS document_id, CASE WHEN power THEN 'electra_power' WHEN water THEN 'mei_raanana' ELSE '' END AS provider_slug, {_NAME} AS provider_name, coalesce(true_service, '') AS service_type,
      true_account AS account_number, CASE WHEN other THEN true_account ELSE true_bill END AS bill_number, true_issue_date AS issue_date,
      CASE WHEN NOT other THEN true_start END AS period_start, CASE WHEN NOT other THEN true_end END AS period_end,
      CAST(CASE WHEN f_amount IS NOT NULL THEN {_MONEY('f_amount')} ELSE true_total END AS DOUBLE) AS amount_due, coalesce(f_currency, 'ILS') AS currency,
      CASE WHEN other THEN 0.0::DOUBLE ELSE 0.95::DOUBLE END AS extraction_confidence, CASE WHEN other THEN 'unknown_provider' END AS review_reason,
      CAST(CASE WHEN power THEN true_total END AS DOUBLE) AS total_with_vat, CASE WHEN power THEN true_due END AS payment_due_date,
      CASE WHEN power THEN 'ביתי ' || plan END AS tariff_plan, CASE WHEN power THEN CAST(contract_no AS VARCHAR) END AS contract_number
    FROM ({_BILLS})""",
    ("bills", "facts"),
)
def m04(spark, sf):
    bills = M.utility_bills(_bill_documents(spark, sf), load(spark, sf, "facts"))
    return bills.select(
        "document_id", "provider_slug", "provider_name", "service_type", "account_number", "bill_number", "issue_date", "period_start", "period_end",
        F.col("amount_due").cast("double").alias("amount_due"), "currency", "extraction_confidence", "review_reason",
        F.col("total_with_vat").cast("double").alias("total_with_vat"), "payment_due_date", "tariff_plan", "contract_number",
    )


@query(
    "m05_bill_upsert",
    "SELECT provider_slug, origin, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 IN (0, 2) THEN 'electra_power' WHEN doc_id % 4 = 1 THEN 'mei_raanana' ELSE 'stored before' END AS provider_slug, CASE WHEN doc_id % 4 = 3 THEN 'old' ELSE 'new' END AS origin FROM px_bills) GROUP BY ALL",
    ("bills",),
)
def m05_upsert(spark, sf):
    docs = _bill_documents(spark, sf)
    new = M.storable_bills(M.utility_bills(docs, load(spark, sf, "facts"))).select("document_id", "provider_slug", F.lit("new").alias("origin"))
    old = docs.select(F.col("doc_id").alias("document_id"), F.lit("stored before").alias("provider_slug"), F.lit("old").alias("origin"))
    return upsert(old, new, ["document_id"]).groupBy("provider_slug", "origin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m05_bill_write_back",
    f"""SELECT doc_id, CASE WHEN other THEN 'old vendor' ELSE {_NAME} END AS vendor, CASE WHEN NOT other THEN true_issue_date END AS doc_date,
      CAST(true_total AS DOUBLE) AS amount, CASE WHEN NOT other THEN coalesce(f_currency, 'ILS') END AS currency FROM ({_BILLS})""",
    ("bills", "facts"),
)
def m05_write_back(spark, sf):
    docs = _bill_documents(spark, sf)
    bills = M.storable_bills(M.utility_bills(docs, load(spark, sf, "facts")))
    back = M.write_back_bills(docs.select("doc_id", "vendor", "doc_date", "amount", "currency"), bills)
    return back.select("doc_id", "vendor", "doc_date", F.col("amount").cast("double").alias("amount"), "currency")


@query(
    "m06_salary_slips",
    f"""SELECT doc_id AS document_id, CASE WHEN valid THEN true_employee END AS employee_name, CASE WHEN valid THEN true_employer ELSE vendor END AS employer_name,
      CASE WHEN valid AND doc_id % 4 <> 0 THEN CAST(true_year AS INTEGER) END AS pay_year, CASE WHEN valid AND doc_id % 4 <> 0 THEN CAST(true_month AS INTEGER) END AS pay_month,
      CASE WHEN valid THEN true_gross END AS gross_salary, CASE WHEN valid AND has_net THEN true_net END AS net_salary,
      CASE WHEN valid THEN true_tax END AS income_tax, CASE WHEN valid THEN conf ELSE 0.0::DOUBLE END AS extraction_confidence,
      nullif(concat_ws(',', CASE WHEN NOT valid OR conf < 0.6 THEN 'low_confidence' END, CASE WHEN NOT valid THEN 'missing_gross_salary' END, CASE WHEN NOT valid OR NOT has_net THEN 'missing_net_salary' END), '') AS review_reason,
      CAST(20000000 + doc_id AS VARCHAR) AS employee_id, CAST(doc_id % 77 AS VARCHAR) AS department, true_start AS job_start_date, (doc_id % 100)::DOUBLE AS job_percentage,
      (doc_id % 30000)::DOUBLE AS gross_for_tax, 'הפניקס' AS pension_fund_name
    FROM ({CHOSEN})""",
    ("slips",),
)
def m06(spark, sf):
    from paperloom.operators.extract import payload_facts

    docs = chosen_payloads(spark, sf).withColumns({"currency": F.lit(None).cast("string"), "review_state": F.lit("pending")})
    slips = M.salary_slips(docs, payload_facts(docs))
    number = lambda c: F.col(c).cast("double").alias(c)
    return slips.select(
        "document_id", "employee_name", "employer_name", "pay_year", "pay_month", number("gross_salary"), number("net_salary"), number("income_tax"),
        "extraction_confidence", "review_reason", "employee_id", "department", "job_start_date", number("job_percentage"), number("gross_for_tax"), "pension_fund_name",
    )


@query(
    "m07_contracts",
    f"""SELECT doc_id AS document_id, f.contract_type, coalesce(f.counterparty, vendor) AS counterparty, f.parties, {_DAY('f.source_date')} AS contract_date, {_DAY('f.period_start')} AS start_date,
      {_DAY('coalesce(f.contract_end_date, f.period_end)')} AS end_date, CAST({_MONEY('f.amount')} AS DOUBLE) AS amount, coalesce(f.currency, d.currency, 'ILS') AS currency, f.obligations, f.governing_law, review_state
    FROM px_documents d JOIN ({_map_sql(M._CONTRACT_KEYS)}) f ON document_id = doc_id WHERE doc_type = 'contract'""",
    ("documents", "facts"),
)
def m07(spark, sf):
    rows = M.contracts(load(spark, sf, "documents"), load(spark, sf, "facts"))
    return rows.select(
        "document_id", "contract_type", "counterparty", "parties", "contract_date", "start_date", "end_date", F.col("amount").cast("double").alias("amount"),
        "currency", "obligations", "governing_law", "review_state",
    )


@query(
    "m08_insurance_policies",
    f"""SELECT doc_id AS document_id, f.insurance_type, coalesce(f.counterparty, vendor) AS insurer, f.policy_number, f.insured_name, CAST({_MONEY('f.coverage_limit')} AS DOUBLE) AS coverage_limit,
      CAST({_MONEY('f.premium_amount')} AS DOUBLE) AS premium_amount, coalesce(f.currency, d.currency, 'ILS') AS premium_currency, CAST({_MONEY('f.deductible_amount')} AS DOUBLE) AS deductible_amount,
      {_DAY('f.source_date')} AS policy_date, {_DAY('f.period_start')} AS start_date, {_DAY('f.period_end')} AS end_date
    FROM px_documents d JOIN ({_map_sql(M._POLICY_KEYS)}) f ON document_id = doc_id WHERE doc_type = 'insurance'""",
    ("documents", "facts"),
)
def m08(spark, sf):
    rows = M.insurance_policies(load(spark, sf, "documents"), load(spark, sf, "facts"))
    number = lambda c: F.col(c).cast("double").alias(c)
    return rows.select(
        "document_id", "insurance_type", "insurer", "policy_number", "insured_name", number("coverage_limit"), number("premium_amount"), "premium_currency",
        number("deductible_amount"), "policy_date", "start_date", "end_date",
    )


@query(
    "m09_review_state",
    """WITH s AS (SELECT doc_id, confidence, confidence >= 0.5 AS a, doc_id % 7 IN (4, 5) OR doc_id % 11 <> 0 AS b, coalesce(n, 0) >= 1 OR ai_summary IS NOT NULL AS c
      FROM px_documents LEFT JOIN (SELECT document_id, count(*) AS n FROM px_facts GROUP BY 1) ON document_id = doc_id)
    SELECT doc_id, CASE WHEN a AND b AND c THEN 'auto_verified' ELSE 'needs_review' END AS state,
      concat_ws(',', CASE WHEN NOT a THEN 'classification_confidence=' || printf('%.2f', confidence) || '<0.5' END, CASE WHEN NOT b THEN 'text_extraction_empty' END, CASE WHEN NOT c THEN 'no_facts_and_no_summary' END) AS failed FROM s""",
    ("documents", "facts"),
)
def m09(spark, sf):
    from paperloom.sources.files import extension, text_expected

    counts = load(spark, sf, "facts").groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    docs = load(spark, sf, "documents").join(counts, "doc_id", "left")
    state = M.review(F.col("confidence"), text_expected(extension(F.col("filename"))), F.col("raw_text"), F.col("n"), F.col("ai_summary"))
    return docs.select("doc_id", state.alias("r")).select("doc_id", F.col("r.review_state").alias("state"), F.array_join("r.failed_signals", ",").alias("failed"))


@query(
    "m10_salary_review",
    f"""SELECT doc_id, CASE WHEN valid AND conf >= 0.6 AND has_net THEN 'auto_verified' ELSE 'needs_review' END AS state,
      nullif(concat_ws(',', CASE WHEN NOT valid OR conf < 0.6 THEN 'low_confidence' END, CASE WHEN NOT valid THEN 'missing_gross_salary' END, CASE WHEN NOT valid OR NOT has_net THEN 'missing_net_salary' END), '') AS reason FROM ({CHOSEN})""",
    ("slips",),
)
def m10(spark, sf):
    p = F.col("payload")
    return chosen_payloads(spark, sf).select("doc_id", M.salary_review_state(p).alias("state"), M.salary_review_reason(p).alias("reason"))


@query(
    "m11_utility_review",
    """SELECT o_orderkey AS doc_id, nullif(concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'unknown_provider' END, CASE WHEN o_orderkey % 3 = 0 THEN 'missing_account_number' END,
      CASE WHEN o_orderkey % 5 = 0 THEN 'missing_bill_number' END), '') AS reason FROM orders""",
)
def m11(spark, sf):
    from paperloom.suite.shapes import table

    k = F.col("o_orderkey")
    unless = lambda n: F.when(k % n != 0, F.lit("x"))
    return table(spark, sf, "orders").select(k.alias("doc_id"), M.utility_review_reason(unless(2), unless(3), unless(5)).alias("reason"))


@query(
    "m12_auto_tags",
    """SELECT doc_id, array_to_string(list_filter(all_tags, lambda t, i: t <> '' AND NOT list_contains(all_tags[:i - 1], t)), '|') AS tags FROM (
      SELECT doc_id, list_transform(list_filter(list_concat(tags, [doc_type, vendor, review_state, CAST(year(true_date) AS VARCHAR)], types), lambda t: t IS NOT NULL),
        lambda t: regexp_replace(lower(trim(t)), '^#', '')) AS all_tags
      FROM px_documents LEFT JOIN (SELECT document_id, list(DISTINCT fact_type) FILTER (fact_type IN ('contract', 'invoice')) AS types FROM px_facts GROUP BY 1) ON document_id = doc_id)""",
    ("documents", "facts"),
)
def m12(spark, sf):
    types = load(spark, sf, "facts").groupBy(F.col("document_id").alias("doc_id")).agg(F.collect_set("fact_type").alias("types"))
    docs = load(spark, sf, "documents").join(types, "doc_id", "left")
    c = F.col
    tags = M.auto_tags(c("tags"), c("doc_type"), c("vendor"), c("review_state"), c("true_date"), c("filename"), c("types"))
    return docs.select("doc_id", F.array_join(tags, "|").alias("tags"))


@query("m13_display_name", f"SELECT doc_id, {NAME_SQL} AS name FROM px_documents", ("documents",))
def m13(spark, sf):
    c = F.col
    return load(spark, sf, "documents").select("doc_id", M.display_name(c("doc_type"), c("vendor"), c("doc_date")).alias("name"))


@query(
    "m13_name_with_fallbacks",
    f"""WITH f AS (SELECT document_id, min_by(fact_value, fact_seq) FILTER (fact_key = 'counterparty' AND fact_value <> '') AS party,
        min_by(CAST(try_strptime(fact_value, '%Y-%m-%d') AS DATE), fact_seq) FILTER (fact_key = 'source_date' AND try_strptime(fact_value, '%Y-%m-%d') IS NOT NULL) AS day,
        count(*) FILTER (fact_key = 'recipe_name' AND fact_value <> '') AS n, min_by(fact_value, fact_seq) FILTER (fact_key = 'recipe_name' AND fact_value <> '') AS dish FROM px_facts GROUP BY 1)
    SELECT doc_id, {NAME_SQL} AS name FROM (
      SELECT doc_id, doc_type, coalesce(vendor, party, CASE WHEN doc_type = 'recipe' AND n = 1 THEN dish END) AS vendor, coalesce(doc_date, day) AS doc_date FROM px_documents LEFT JOIN f ON document_id = doc_id)""",
    ("documents", "facts"),
)
def m13_fallbacks(spark, sf):
    named = M.name_documents(load(spark, sf, "documents"), load(spark, sf, "facts"))
    return named.select("doc_id", F.col("display_name").alias("name"))


@query(
    "m14_merge_metadata",
    "SELECT doc_id, 'a=' || doc_id || ',b=' || doc_type || ',c=' || review_state AS merged FROM px_documents",
    ("documents",),
)
def m14(spark, sf):
    c = F.col
    old = F.create_map(F.lit("a"), c("doc_id").cast("string"), F.lit("b"), F.lit("old"))
    new = F.create_map(F.lit("b"), c("doc_type"), F.lit("c"), c("review_state"))
    entries = F.array_sort(F.map_entries(M.merge_metadata(old, new)))
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("merged"))


@query(
    "m15_outcome",
    """SELECT result, steps_ok, failed, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 OR vendor IS NULL THEN 'partial' ELSE 'complete' END AS result,
      CAST(3 - (doc_id % 11 = 0)::INT - (vendor IS NULL)::INT AS INTEGER) AS steps_ok, concat_ws(',', CASE WHEN doc_id % 11 = 0 THEN 'text_extraction' END, CASE WHEN vendor IS NULL THEN 'fact_promotion' END) AS failed
      FROM px_documents) GROUP BY ALL""",
    ("documents",),
)
def m15(spark, sf):
    steps = {"text_extraction": F.trim("raw_text") == "", "classification": F.lit(False), "fact_promotion": F.col("vendor").isNull()}
    rows = load(spark, sf, "documents").select(M.outcome(steps).alias("o"))
    return rows.groupBy("o.result", "o.steps_ok", "o.failed").agg(F.count(F.lit(1)).alias("n"))


