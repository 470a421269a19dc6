"""Classification and rule matching (C-*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators import classify as C
from paperloom.suite.registry import query
from paperloom.suite.shapes import load

# file-name words per category, then text words per phrase of the document shape
_BY_NAME = """CASE doc_type WHEN 'invoice' THEN 'invoice' WHEN 'receipt' THEN 'receipt' WHEN 'contract' THEN 'contract' WHEN 'insurance' THEN 'insurance'
  WHEN 'warranty' THEN 'warranty' WHEN 'official_letter' THEN 'official_letter' WHEN 'recipe' THEN 'recipe' END"""
_BY_TEXT = """CASE doc_id % 7 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'contract' WHEN 3 THEN 'insurance' WHEN 5 THEN 'recipe' END"""
_KEYWORDS = f"""SELECT *, {_BY_NAME} AS by_name, CASE WHEN doc_id % 11 <> 0 THEN {_BY_TEXT} END AS by_text, doc_id % 7 = 4 AS sheet FROM px_documents"""


@query(
    "c01_keyword_class",
    f"""SELECT doc_id, coalesce(by_name, by_text, 'other') AS category,
      CASE WHEN by_name IS NOT NULL THEN 0.9::DOUBLE WHEN by_text IS NOT NULL THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM ({_KEYWORDS})""",
    ("documents",),
)
def c01(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", C.classify_keywords(F.col("raw_text"), F.col("filename")).alias("c"))
    return rows.select("doc_id", "c.category", "c.confidence")


_PARSED = """CASE WHEN doc_id % 6 IN (0, 1) OR true_category = 'poem' THEN 'other' ELSE true_category END AS answer_category,
  CASE WHEN doc_id % 6 IN (0, 1) OR true_category = 'poem' THEN 0.0::DOUBLE ELSE true_confidence END AS answer_confidence"""


@query(
    "c02_class_policy",
    f"""SELECT doc_id, CASE WHEN by_name IS NOT NULL THEN by_name WHEN sheet THEN 'other' WHEN by_text IS NOT NULL THEN by_text ELSE answer_category END AS category,
      CASE WHEN by_name IS NOT NULL THEN 0.9::DOUBLE WHEN sheet THEN 0.3::DOUBLE WHEN by_text IS NOT NULL THEN 0.8::DOUBLE ELSE answer_confidence END AS confidence
    FROM ({_KEYWORDS}) JOIN (SELECT doc_id, {_PARSED} FROM px_class_answers) USING (doc_id)""",
    ("documents", "class_answers"),
)
def c02(spark, sf):
    docs = load(spark, sf, "documents").join(load(spark, sf, "class_answers").select("doc_id", "answer"), "doc_id")
    return C.classify_documents(docs, "answer").select("doc_id", "class.category", "class.confidence")


@query("c03_class_answer", f"SELECT doc_id, answer_category AS category, answer_confidence AS confidence FROM (SELECT doc_id, {_PARSED} FROM px_class_answers)", ("class_answers",))
def c03(spark, sf):
    rows = load(spark, sf, "class_answers").select("doc_id", C.parse_class_answer(F.col("answer")).alias("c"))
    return rows.select("doc_id", "c.category", "c.confidence")


@query(
    "c04_resolve_issuer",
    """SELECT doc_id, CASE true_service WHEN 'electricity' THEN 'electricity_bill' WHEN 'water' THEN 'water_bill' END AS doc_type,
      CASE WHEN true_service IS NOT NULL THEN 0.95::DOUBLE END AS confidence, CASE WHEN true_service IS NOT NULL THEN 'utility_bill' END AS record_type,
      CASE true_service WHEN 'electricity' THEN 'utility_bill:electricity:electra_power' WHEN 'water' THEN 'utility_bill:water:mei_raanana' END AS routing_key FROM px_bills""",
    ("bills",),
)
def c04(spark, sf):
    rows = load(spark, sf, "bills").select("doc_id", C.resolve_issuer(F.col("raw_text"), F.col("filename")).alias("r"))
    return rows.select("doc_id", "r.doc_type", "r.confidence", "r.record_type", "r.routing_key")


@query(
    "c05_electricity_metadata",
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN true_account END AS account, true_bill AS bill,
      CASE WHEN doc_id % 4 IN (0, 2) THEN strftime(true_issue_date, '%d/%m/%Y') END AS issued,
      CASE WHEN doc_id % 4 IN (0, 2) THEN strftime(true_end, '%d/%m/%Y') END AS period_end,
      CASE WHEN doc_id % 4 IN (0, 2) THEN strftime(true_start, '%d/%m/%Y') END AS period_start FROM px_bills""",
    ("bills",),
)
def c05(spark, sf):
    rows = load(spark, sf, "bills").select("doc_id", C.electricity_metadata(F.col("raw_text"), F.col("filename")).alias("m"))
    m = lambda k: F.col("m")[k]
    return rows.select(
        "doc_id", m("issuer_account_number").alias("account"), m("issuer_bill_number").alias("bill"), m("issuer_issue_date").alias("issued"),
        m("issuer_period_end").alias("period_end"), m("issuer_period_start").alias("period_start"),
    )


@query(
    "c06_water_metadata",
    """SELECT doc_id, CASE WHEN w THEN true_account END AS account, CASE WHEN w THEN true_bill END AS bill, CASE WHEN w THEN strftime(true_issue_date, '%d/%m/%Y') END AS issued,
      CASE WHEN w THEN strftime(true_start, '%d/%m/%Y') END AS period_start, CASE WHEN w THEN strftime(true_end, '%d/%m/%Y') END AS period_end,
      CASE WHEN w THEN cubic || '.5' END AS cubic, CASE WHEN w THEN CAST(people AS VARCHAR) END AS people, CASE WHEN w THEN ': מגורים' END AS property_type,
      CASE WHEN w THEN strftime(true_due, '%d/%m/%Y') END AS due FROM (SELECT *, doc_id % 4 IN (1, 2) AS w FROM px_bills)""",
    ("bills",),
)
def c06(spark, sf):
    rows = load(spark, sf, "bills").select("doc_id", C.water_metadata(F.col("raw_text")).alias("m"))
    m = lambda k: F.col("m")[k]
    return rows.select(
        "doc_id", m("issuer_account_number").alias("account"), m("issuer_bill_number").alias("bill"), m("issuer_issue_date").alias("issued"),
        m("issuer_period_start").alias("period_start"), m("issuer_period_end").alias("period_end"), m("water_consumption_m3").alias("cubic"),
        m("household_size").alias("people"), m("property_type").alias("property_type"), m("payment_due_date").alias("due"),
    )


@query(
    "c07_resolve_or_classify",
    """SELECT doc_id, CASE true_service WHEN 'electricity' THEN 'electricity_bill' WHEN 'water' THEN 'water_bill' ELSE 'other' END AS category,
      CASE WHEN true_service IS NOT NULL THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS class_confidence,
      CASE WHEN true_service IS NOT NULL THEN 'resolver' END AS routing_source FROM px_bills""",
    ("bills",),
)
def c07(spark, sf):
    return C.resolve_or_classify(load(spark, sf, "bills")).select("doc_id", "category", "class_confidence", "routing_source")


_INTENT_CASE = " ".join(f"WHEN regexp_matches(m, '{p}') THEN '{g}'" for g, p in rules.INTENT_PATTERNS)


@query(
    "c08_message_intent",
    f"""SELECT message_id, CASE {_INTENT_CASE} WHEN message_id % 2 = 0 THEN 'documents' ELSE 'chat' END AS detected
    FROM (SELECT message_id, lower(message_in) AS m FROM px_messages)""",
    ("messages",),
)
def c08(spark, sf):
    last = F.when(F.col("message_id") % 2 == 0, F.lit("document"))
    return load(spark, sf, "messages").select("message_id", C.message_intent(F.col("message_in"), last).alias("detected"))


def _command_sql() -> str:
    quote = lambda p: p.replace("'", "''").replace(r"\b", "")
    cases = [f"WHEN regexp_matches(m, '{rules.CANCEL_COMMAND}', 'i') THEN 'system.cancel'", f"WHEN regexp_matches(m, '{rules.CONFIRM_COMMAND}', 'i') THEN 'system.confirm'"]
    cases += [f"WHEN regexp_matches(m, '{quote(p)}', 'i') THEN '{skill}.{action}'" for skill, p, action in rules.COMMAND_PATTERNS if "ID" not in p]
    titles = [p for _, p, _ in rules.COMMAND_PATTERNS if p.startswith(("^משימה חדשה", "^תזכורת חדשה"))]
    title = ", ".join(f"nullif(regexp_extract(m, '{quote(p)}', 1, 'i'), '')" for p in titles)
    return f"""SELECT message_id, command, CASE WHEN command IN ('task.create', 'recurring.create') THEN coalesce({title}) END AS title,
      CASE command WHEN 'document.recent_feed' THEN '7' END AS wanted, CASE WHEN command = 'task.delete' AND regexp_full_match(m, '.*[0-9]') THEN '12' WHEN command = 'task.update' THEN '3' END AS position
    FROM (SELECT message_id, m, CASE {' '.join(cases)} END AS command FROM (SELECT message_id, trim(message_in) AS m FROM px_messages))"""


@query("c09_parse_command", _command_sql(), ("messages",))
def c09(spark, sf):
    rows = load(spark, sf, "messages").select("message_id", C.parse_command(F.col("message_in")).alias("c"))
    p = lambda k: F.try_element_at(F.col("c.params"), F.lit(k))
    return rows.select(
        "message_id", F.concat_ws(".", F.nullif(F.col("c.skill"), F.lit("")), F.col("c.action")).alias("_c"), p("title").alias("title"),
        p("limit").alias("wanted"), p("index").alias("position"),
    ).select("message_id", F.nullif("_c", F.lit("")).alias("command"), "title", "wanted", "position")


@query(
    "c10_escalation",
    """SELECT message_id, CASE WHEN message_id_lead = 14 THEN 'deep_analysis' END AS trigger, CASE WHEN message_id_lead = 14 THEN 'powerful' END AS tier,
      CASE WHEN message_id_lead = 13 AND member_id % 2 = 0 THEN 'dev_plan' END AS request,
      message_in = 'כן' AS confirm, message_in = 'לא' AS decline, message_in = 'תודה' AS completion
    FROM (SELECT *, ((message_id // 100) * 7 + message_id % 100) % 20 AS message_id_lead FROM px_messages)""",
    ("messages",),
)
def c10(spark, sf):
    m = F.col("message_in")
    rows = load(spark, sf, "messages").select(
        "message_id", C.escalation(m).alias("e"), C.feature_request(m, F.col("member_id") % 2 == 0).alias("request"), C.reply_flags(m).alias("f")
    )
    return rows.select("message_id", "e.trigger", "e.tier", "request", "f.confirm", "f.decline", "f.completion")


@query(
    "c12_worth_remembering",
    "SELECT message_id, " + " OR ".join(f"contains(message_in, '{p}') OR contains(lower(message_in), '{p}')" for p in rules.NUDGE_PHRASES) + " AS worth FROM px_messages",
    ("messages",),
)
def c12(spark, sf):
    return load(spark, sf, "messages").select("message_id", C.worth_remembering(F.col("message_in")).alias("worth"))


@query(
    "c13_question_field",
    "SELECT message_id, CASE " + " ".join(f"WHEN contains(lower(message_in), '{w}') THEN '{f}'" for w, f in rules.QUESTION_FIELDS) + " END AS field FROM px_messages",
    ("messages",),
)
def c13(spark, sf):
    return load(spark, sf, "messages").select("message_id", C.question_field(F.col("message_in")).alias("field"))
