"""Merging and promoting facts, and the four typed tables (M-01 ... M-15)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.regex import capture, contains_any, first_group, let, literal_array, literal_map, non_blank, strip
from paperloom.functions.scalars import (
    MONEY, QUANTITY, merge_tags, normalize_tag, parse_amount, parse_date, parse_iso_date, pay_period, year_tag,
)
from paperloom.operators.extract import FACT


def fact_map(facts: DataFrame, keys: list[str]) -> DataFrame:
    """M-01: one row per document with a column per key: the last non-empty value wins."""
    value = F.col("fact_value")
    return facts.filter(F.col("fact_key").isin(keys) & (value != "")).groupBy("document_id").agg(
        *[F.max_by(value, F.when(F.col("fact_key") == k, F.col("fact_seq"))).alias(k) for k in keys]
    )


def row_facts(keys: list[str], facts: str = "facts") -> Column:
    """M-01 inside the row: struct of the last non-empty value per key of an array of facts; no shuffle."""
    value = lambda k: F.try_element_at(F.filter(facts, lambda f: (f["fact_key"] == k) & (f["fact_value"] != "")), F.lit(-1))["fact_value"]
    return F.struct(*[value(k).alias(k) for k in keys])


def no_facts() -> Column:
    return F.array().cast(f"array<{FACT}>")


def employer_in_row(facts: Column, threshold: float = rules.SALARY_PROMOTE_CONFIDENCE) -> Column:
    """M-03 for a slip that carries its facts: the first confident employer name."""
    sure = F.filter(facts, lambda f: (f["fact_key"] == "employer_name") & (f["confidence"] >= threshold) & (strip(f["fact_value"]) != ""))
    return strip(F.get(sure, F.lit(0))["fact_value"])


def names_in_row(doc_type: Column, vendor: Column, doc_date: Column, facts: Column) -> tuple[Column, Column]:
    """M-13's vendor and date for a document that carries its facts: the first usable fact fills a gap."""
    of = lambda key: F.filter(facts, lambda f: (f["fact_key"] == key) & (strip(f["fact_value"]) != ""))
    party = F.get(F.filter(facts, lambda f: (f["fact_key"] == "counterparty") & (f["fact_value"] != "")), F.lit(0))["fact_value"]
    days = F.filter(F.transform(of("source_date"), lambda f: parse_iso_date(f["fact_value"])), lambda d: d.isNotNull())
    recipes = of("recipe_name")
    lone = F.when((doc_type == "recipe") & (F.size(recipes) == 1), F.get(recipes, F.lit(0))["fact_value"])
    return F.coalesce(F.nullif(vendor, F.lit("")), party, lone, vendor), F.coalesce(doc_date, F.get(days, F.lit(0)))


def promote_in_row(documents: DataFrame, facts: str | Column = "facts", threshold: float = rules.PROMOTE_CONFIDENCE) -> DataFrame:
    """M-02 for documents that still carry their facts as an array: the same rule without a join."""
    parse = {
        "vendor": lambda v: non_blank(strip(v)), "currency": lambda v: non_blank(strip(v)), "amount": lambda v: parse_amount(strip(v)),
        "doc_date": parse_date,
    }

    def first(key: str, column: str) -> Column:
        sure = F.filter(facts, lambda f: (f["fact_key"] == key) & (f["confidence"] >= threshold))
        return F.get(F.filter(F.transform(sure, lambda f: parse[column](f["fact_value"])), lambda v: v.isNotNull()), F.lit(0))

    return documents.withColumns({c: F.coalesce(c, first(k, c)) for k, c in rules.PROMOTION_MAP.items()})


def promote_facts(documents: DataFrame, facts: DataFrame, threshold: float = rules.PROMOTE_CONFIDENCE) -> DataFrame:
    """M-02: fill empty document columns from confident facts; the first fact that parses wins.

    Facts are folded per document before the join, so a document with very many facts costs one row there.
    """
    value = strip(F.col("fact_value"))
    parsed = {"vendor": non_blank(value), "amount": parse_amount(value), "currency": non_blank(value), "doc_date": parse_date(value)}
    column_of = rules.PROMOTION_MAP
    first = [
        F.min_by(parsed[c], F.when((F.col("fact_key") == k) & parsed[c].isNotNull(), F.col("fact_seq"))).alias(f"_{c}")
        for k, c in column_of.items()
    ]
    usable = facts.filter(F.col("fact_key").isin(list(column_of)) & (F.col("confidence") >= threshold))
    best = usable.groupBy(F.col("document_id").alias("doc_id")).agg(*first)
    joined = documents.join(best, "doc_id", "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in column_of.values()}).drop(*[f"_{c}" for c in column_of.values()])


def promote_employer(documents: DataFrame, facts: DataFrame, threshold: float = rules.SALARY_PROMOTE_CONFIDENCE) -> DataFrame:
    """M-03: on salary slips only a confident employer name becomes the vendor."""
    value = strip(F.col("fact_value"))
    usable = facts.filter(
        (F.col("fact_type") == "salary_slip") & (F.col("fact_key") == "employer_name") & (F.col("confidence") >= threshold) & (value != "")
    )
    best = usable.groupBy(F.col("document_id").alias("doc_id")).agg(F.min_by(value, "fact_seq").alias("_employer"))
    return documents.join(best, "doc_id", "left").withColumn(
        "vendor", F.coalesce(F.nullif("vendor", F.lit("")), "_employer", "vendor")
    ).drop("_employer")


def _typed(text: Column, fields: dict[str, tuple[str, list[str]]]) -> list[Column]:
    kinds = {
        "money": lambda c: parse_amount(c, MONEY), "quantity": lambda c: parse_amount(c, QUANTITY), "date": parse_date, "text": lambda c: c,
    }
    return [kinds[kind](first_group(text, patterns)).alias(name) for name, (kind, patterns) in fields.items()]


def _reasons(*cases: tuple[Column, str]) -> Column:
    """Comma list of the reasons that hold; NULL when none does."""
    return non_blank(F.concat_ws(",", *[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in cases]))


def utility_bills(documents: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """M-04: utility-bill rows; only bills of a known provider and service (M-05) are returned.

    ``documents``: doc_id, uploaded_by, source, raw_text, issuer_metadata (map), amount, currency, class_confidence, review_state.
    """
    if facts is None:
        own = row_facts(["amount", "currency"])
        known = documents.withColumns({"_amount": own["amount"], "_currency": own["currency"]})
    else:
        money = fact_map(facts, ["amount", "currency"]).select(
            F.col("document_id").alias("doc_id"), F.col("amount").alias("_amount"), F.col("currency").alias("_currency")
        )
        known = documents.join(money, "doc_id", "left")
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    meta = lambda k: non_blank(strip(F.try_element_at(F.col("issuer_metadata"), F.lit(k))))
    rows = known.withColumns(
        {
            "provider_slug": F.coalesce(meta("provider_slug"), F.lit("")),
            "provider_name": F.coalesce(meta("provider_name"), F.lit("")),
            "service_type": F.coalesce(meta("service_type"), F.lit("")),
            "account_number": F.coalesce(meta("issuer_account_number"), first_group(text, rules.UTILITY_ACCOUNT_PATTERNS)),
            "bill_number": F.coalesce(meta("issuer_bill_number"), first_group(text, rules.UTILITY_BILL_PATTERNS)),
            "issue_date": parse_date(F.coalesce(meta("issuer_issue_date"), first_group(text, rules.UTILITY_ISSUE_DATE_PATTERNS))),
            "period_start": F.coalesce(parse_date(meta("issuer_period_start")), parse_date(capture(text, rules.ELECTRICITY_PERIOD, 2))),
            "period_end": F.coalesce(parse_date(meta("issuer_period_end")), parse_date(capture(text, rules.ELECTRICITY_PERIOD, 1))),
            "amount_due": F.when(F.col("_amount").isNotNull(), parse_amount(F.col("_amount"))).otherwise(F.col("amount")),
        }
    )
    return rows.select(
        F.col("doc_id").alias("document_id"), F.col("uploaded_by").alias("member_id"), "provider_slug", "provider_name", "service_type",
        "account_number", "bill_number", "issue_date", "period_start", "period_end", "amount_due",
        F.coalesce("_currency", F.nullif("currency", F.lit("")), F.lit(rules.DEFAULT_CURRENCY)).alias("currency"),
        F.coalesce("class_confidence", F.lit(0.0)).alias("extraction_confidence"), "review_state",
        utility_review_reason(F.col("provider_slug"), F.col("account_number"), F.col("bill_number")).alias("review_reason"),
        F.col("source").alias("source_channel"), *_typed(text, rules.UTILITY_EXTENDED),
    )


def utility_review_reason(slug: Column, account: Column, bill: Column) -> Column:
    """M-11."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return _reasons((blank(slug), "unknown_provider"), (blank(account), "missing_account_number"), (blank(bill), "missing_bill_number"))


def storable_bills(bills: DataFrame) -> DataFrame:
    """M-05: a bill without provider or service is not stored."""
    return bills.filter((F.col("provider_slug") != "") & (F.col("service_type") != ""))


def write_back_bills(documents: DataFrame, bills: DataFrame) -> DataFrame:
    """M-05: the provider's name replaces the vendor; date, amount and currency only fill gaps."""
    b = bills.select(
        F.col("document_id").alias("doc_id"), F.nullif("provider_name", F.lit("")).alias("_name"), F.col("issue_date").alias("_issued"),
        F.col("amount_due").alias("_due"), F.col("currency").alias("_cur"),
    )
    joined = documents.join(b, "doc_id", "left")
    return joined.withColumns(
        {
            "vendor": F.coalesce("_name", "vendor"), "doc_date": F.coalesce("doc_date", "_issued"), "amount": F.coalesce("amount", "_due"),
            "currency": F.coalesce(F.nullif("currency", F.lit("")), "_cur", "currency"),
        }
    ).drop("_name", "_issued", "_due", "_cur")


def salary_review_reason(payload: Column) -> Column:
    """M-10: reasons; a zero salary counts as missing."""
    missing = lambda k: F.coalesce(payload[k], F.lit(0.0)) == 0
    unsure = F.coalesce(payload["confidence"], F.lit(0.0)) < rules.SALARY_STRONG_CONFIDENCE
    return _reasons((unsure, "low_confidence"), (missing("gross_salary"), "missing_gross_salary"), (missing("net_salary"), "missing_net_salary"))


def salary_review_state(payload: Column) -> Column:
    """M-10."""
    return F.when(salary_review_reason(payload).isNull(), F.lit("auto_verified")).otherwise(F.lit("needs_review"))


def employee_address(text: Column, employee: Column) -> Column:
    """The address line that follows the employee's name and house number, up to a known town.

    The pattern differs by row and is compiled for each; a text without any of the towns, which have no letter case, is left alone.
    """
    towns = rules.EMPLOYEE_ADDRESS_TAIL[rules.EMPLOYEE_ADDRESS_TAIL.rindex("(?:") + 3 : -1].split("|")
    quoted = F.concat(F.lit("(?iud)\\Q"), F.replace(employee, F.lit("\\E"), F.lit("")), F.lit("\\E" + rules.EMPLOYEE_ADDRESS_TAIL))
    found = F.call_function("regexp_extract", text, quoted, F.lit(1))
    return F.when((F.coalesce(employee, F.lit("")) != "") & contains_any(text, towns), non_blank(strip(found)))


def salary_slips(documents: DataFrame, facts: DataFrame | None) -> DataFrame:
    """M-06: salary-slip rows: the structured payload first, facts second, extended fields from the text. Without a fact
    table the documents' own ``facts`` arrays are read.

    ``documents``: doc_id, uploaded_by, source, raw_text, vendor, currency, review_state, payload (struct or NULL).
    """
    keys = [*rules.SALARY_KEYS, "currency"]
    if facts is None:
        own = row_facts(keys)
        joined = documents.withColumns({f"_{k}": own[k] for k in keys})
    else:
        known = fact_map(facts, keys).select(F.col("document_id").alias("doc_id"), *[F.col(k).alias(f"_{k}") for k in keys])
        joined = documents.join(known, "doc_id", "left")
    p = F.col("payload")
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    present = lambda k: F.nullif(p[k], F.lit("")) if k in rules.SALARY_TEXT_KEYS else F.when(p[k] != 0, p[k])
    money = lambda k: F.coalesce(present(k).cast(MONEY), parse_amount(F.col(f"_{k}"))).alias(k)
    rows = joined.withColumns(
        {
            "employee_name": F.coalesce(present("employee_name"), F.col("_employee_name")),
            "_period": pay_period(F.coalesce(present("pay_month"), F.col("_pay_month"))),
        }
    )
    return rows.select(
        F.col("doc_id").alias("document_id"), F.col("uploaded_by").alias("member_id"), "employee_name",
        F.coalesce(present("employer_name"), "_employer_name", "vendor").alias("employer_name"),
        F.col("_period.pay_year").alias("pay_year"), F.col("_period.pay_month").alias("pay_month"),
        F.coalesce("_currency", F.nullif("currency", F.lit("")), F.lit(rules.DEFAULT_CURRENCY)).alias("currency"),
        *[money(k) for k in rules.SALARY_MONEY_KEYS],
        F.coalesce(p["confidence"], F.lit(0.0)).alias("extraction_confidence"), "review_state",
        salary_review_reason(p).alias("review_reason"), F.col("source").alias("source_channel"),
        *_typed(text, rules.SALARY_EXTENDED), employee_address(text, F.col("employee_name")).alias("employee_address"),
    )


_CONTRACT_KEYS = [
    "contract_type", "counterparty", "parties", "source_date", "period_start", "period_end", "contract_end_date", "amount", "currency",
    "obligations", "renewal_terms", "penalty_clause", "termination_clause", "governing_law", "document_reference",
]
_POLICY_KEYS = [
    "insurance_type", "counterparty", "policy_number", "insured_name", "beneficiary", "coverage_description", "coverage_limit",
    "premium_amount", "currency", "deductible_amount", "source_date", "period_start", "period_end",
]


def _with_fact_map(documents: DataFrame, facts: DataFrame | None, doc_type: str, keys: list[str]) -> DataFrame:
    """Documents of one type that have any non-empty fact, with their fact map as ``f``.

    A row exists as soon as any fact has a value, even one that fills no column here. Without a fact table the documents'
    own ``facts`` arrays are read.
    """
    value = F.col("fact_value")
    if facts is None:
        own = documents.filter((F.col("doc_type") == doc_type) & F.exists("facts", lambda f: f["fact_value"] != ""))
        return own.withColumn("f", row_facts(keys))
    folded = facts.filter(value != "").groupBy(F.col("document_id").alias("doc_id")).agg(
        *[F.max_by(value, F.when(F.col("fact_key") == k, F.col("fact_seq"))).alias(k) for k in keys]
    )
    folded = folded.select("doc_id", F.struct(*keys).alias("f"))
    return documents.filter(F.col("doc_type") == doc_type).join(folded, "doc_id")


def contracts(documents: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """M-07: contract rows; none for a document without facts."""
    f = lambda k: F.col(f"f.{k}")
    return _with_fact_map(documents, facts, "contract", _CONTRACT_KEYS).select(
        F.col("doc_id").alias("document_id"), "uploaded_by", "source", f("contract_type").alias("contract_type"),
        F.coalesce(f("counterparty"), F.col("vendor")).alias("counterparty"), f("parties").alias("parties"),
        parse_date(f("source_date")).alias("contract_date"), parse_date(f("period_start")).alias("start_date"),
        parse_date(F.coalesce(f("contract_end_date"), f("period_end"))).alias("end_date"), parse_amount(f("amount")).alias("amount"),
        F.coalesce(f("currency"), F.nullif("currency", F.lit("")), F.lit(rules.DEFAULT_CURRENCY)).alias("currency"),
        *[f(k).alias(k) for k in ["obligations", "renewal_terms", "penalty_clause", "termination_clause", "governing_law", "document_reference"]],
        "confidence", "review_state",
    )


def insurance_policies(documents: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """M-08: policy rows; none for a document without facts."""
    f = lambda k: F.col(f"f.{k}")
    return _with_fact_map(documents, facts, "insurance", _POLICY_KEYS).select(
        F.col("doc_id").alias("document_id"), "uploaded_by", "source", f("insurance_type").alias("insurance_type"),
        F.coalesce(f("counterparty"), F.col("vendor")).alias("insurer"),
        *[f(k).alias(k) for k in ["policy_number", "insured_name", "beneficiary", "coverage_description"]],
        parse_amount(f("coverage_limit")).alias("coverage_limit"), parse_amount(f("premium_amount")).alias("premium_amount"),
        F.coalesce(f("currency"), F.nullif("currency", F.lit("")), F.lit(rules.DEFAULT_CURRENCY)).alias("premium_currency"),
        parse_amount(f("deductible_amount")).alias("deductible_amount"), parse_date(f("source_date")).alias("policy_date"),
        parse_date(f("period_start")).alias("start_date"), parse_date(f("period_end")).alias("end_date"), "confidence", "review_state",
    )


def review(confidence: Column, text_expected: Column, text: Column, fact_count: Column, summary: Column) -> Column:
    """M-09: struct(review_state, failed_signals)."""
    sure = F.coalesce(confidence, F.lit(0.0)) >= rules.REVIEW_CONFIDENCE
    has_text = ~text_expected | (strip(F.coalesce(text, F.lit(""))) != "")
    informed = (F.coalesce(fact_count, F.lit(0)) >= 1) | (F.coalesce(summary, F.lit("")) != "")
    failed = F.array_compact(
        F.array(
            F.when(
                ~sure,
                F.concat(F.lit("classification_confidence="), F.format_number(F.coalesce(confidence, F.lit(0.0)), 2), F.lit(f"<{rules.REVIEW_CONFIDENCE}")),
            ),
            F.when(~has_text, F.lit("text_extraction_empty")),
            F.when(~informed, F.lit("no_facts_and_no_summary")),
        )
    )
    state = F.when(sure & has_text & informed, F.lit("auto_verified")).otherwise(F.lit("needs_review"))
    return F.struct(state.alias("review_state"), failed.alias("failed_signals"))


def auto_tags(
    existing: Column, doc_type: Column, vendor: Column, review_state: Column, doc_date: Column, filename: Column, fact_types: Column
) -> Column:
    """M-12: tags from the document's own columns, merged behind the existing ones."""
    own = F.array_compact(F.array(doc_type, vendor, review_state, year_tag(doc_date, filename)))
    typed = F.filter(F.transform(fact_types, normalize_tag), lambda t: t.isin(rules.AUTO_TAG_FACT_TYPES))
    additions = F.concat(own, F.coalesce(typed, F.array().cast("array<string>")))
    return merge_tags(F.coalesce(existing, F.array().cast("array<string>")), additions)


def display_name(doc_type: Column, vendor: Column, doc_date: Column) -> Column:
    """M-13: label, vendor, month and year, as far as they are known; never empty."""
    labels = literal_map({k: v for k, v in rules.DOC_TYPE_LABELS.items() if k != "other"})
    label = F.try_element_at(labels, doc_type)
    month = F.concat_ws(" ", F.element_at(literal_array(rules.HEBREW_MONTHS), F.month(doc_date)), F.year(doc_date).cast("string"))
    named = F.concat_ws(
        " ", label, F.when(strip(vendor) != "", vendor), F.when(doc_date.isNotNull(), month)
    )
    generic = F.concat_ws(" ", F.lit(rules.GENERIC_LABEL), F.date_format(doc_date, "yyyy-MM-dd"))
    return F.when(label.isNull(), generic).otherwise(named)


def name_documents(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """M-13: display names; vendor and date fall back to the first usable fact, a lone recipe names its document."""
    value = F.col("fact_value")
    at = lambda cond: F.when(cond, F.col("fact_seq"))
    recipe = (F.col("fact_key") == "recipe_name") & (strip(value) != "")
    folded = facts.groupBy(F.col("document_id").alias("doc_id")).agg(
        F.min_by(value, at((F.col("fact_key") == "counterparty") & (value != ""))).alias("_party"),
        F.min_by(parse_iso_date(value), at((F.col("fact_key") == "source_date") & parse_iso_date(value).isNotNull())).alias("_day"),
        F.count_if(recipe).alias("_recipes"), F.min_by(value, at(recipe)).alias("_recipe"),
    )
    joined = documents.join(folded, "doc_id", "left")
    lone = F.when((F.col("doc_type") == "recipe") & (F.col("_recipes") == 1), F.col("_recipe"))
    vendor = F.coalesce(F.nullif("vendor", F.lit("")), "_party", lone, "vendor")
    return joined.withColumn("display_name", display_name(F.col("doc_type"), vendor, F.coalesce("doc_date", "_day"))).drop(
        "_party", "_day", "_recipes", "_recipe"
    )


def merge_metadata(old: Column, new: Column) -> Column:
    """M-14: later keys replace earlier ones."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return let(new, lambda n: F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(n, k)), n))


def outcome(steps: dict[str, Column]) -> Column:
    """M-15: struct(result, steps_ok, steps_total, failed) from one boolean per step (true = it failed)."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in steps.items()]))
    return let(
        failed,
        lambda f: F.struct(
            F.when(F.size(f) == 0, F.lit("complete")).otherwise(F.lit("partial")).alias("result"),
            (F.lit(len(steps)) - F.size(f)).alias("steps_ok"), F.lit(len(steps)).alias("steps_total"),
            F.array_join(f, ",").alias("failed"),
        ),
    )

