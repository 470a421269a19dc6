"""Catalog search and retrieval (Q-*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import canonical as M
from paperloom.operators import catalog as Q
from paperloom.suite.merging import _DAY, _MONEY, _map_sql
from paperloom.suite.registry import query
from paperloom.suite.shapes import load

_NEWEST = "ORDER BY created_at DESC NULLS FIRST, doc_id"


def _docs(spark, sf):
    return load(spark, sf, "documents")


@query(
    "q01_list_documents_full",
    f"""SELECT doc_id, doc_type, vendor, CAST(amount AS DOUBLE) AS amount, review_state, filename, raw_text, ai_summary, confidence, source FROM px_documents
    WHERE review_state = 'needs_review' AND vendor ILIKE '%customer#0000001%' {_NEWEST} LIMIT 50 OFFSET 10""",
    ("documents",),
)
def q01(spark, sf):
    page = Q.list_documents(_docs(spark, sf), "librarian", vendor="customer#0000001", review_state="needs_review", limit=50, offset=10)
    return page.select("doc_id", "doc_type", "vendor", F.col("amount").cast("double").alias("amount"), "review_state", "filename", "raw_text", "ai_summary", "confidence", "source")


@query(
    "q01_list_documents_metadata",
    f"SELECT doc_id, doc_type, vendor, currency, doc_date, display_name, review_state FROM px_documents WHERE doc_type = 'contract' AND list_contains(tags, '#Tax') {_NEWEST} LIMIT 200",
    ("documents",),
)
def q01_metadata(spark, sf):
    page = Q.list_documents(_docs(spark, sf), "orchestrator", doc_type="contract", tag="#Tax", limit=500)
    return page.drop("amount", "tags", "created_at")


@query("q02_document_by_id", "SELECT doc_id, doc_type, raw_text FROM px_documents WHERE doc_id = 77", ("documents",))
def q02(spark, sf):
    return Q.document_by_id(_docs(spark, sf), "finance_agent", 77).select("doc_id", "doc_type", "raw_text")


@query(
    "q03_search_facts",
    """SELECT document_id, fact_seq, fact_type, fact_key, fact_value, confidence FROM px_facts WHERE fact_key = 'parties' AND fact_value ILIKE '%PARTIES 1%'
    ORDER BY created_at DESC NULLS FIRST, document_id, fact_seq LIMIT 50""",
    ("facts",),
)
def q03(spark, sf):
    return Q.search_facts(load(spark, sf, "facts"), "librarian", fact_key="parties", query_text="PARTIES 1").drop("source_excerpt", "created_at")


@query(
    "q04_salary_slips",
    """SELECT doc_id AS document_id, true_employer AS employer_name, CAST(true_year AS INTEGER) AS pay_year, CAST(true_month AS INTEGER) AS pay_month FROM px_slips
    WHERE true_employer ILIKE '%employer 3%' ORDER BY true_year DESC NULLS FIRST, true_month DESC NULLS FIRST, doc_id LIMIT 50""",
    ("slips",),
)
def q04(spark, sf):
    slips = load(spark, sf, "slips").select(
        F.col("doc_id").alias("document_id"), F.col("true_employer").alias("employer_name"), F.col("true_year").alias("pay_year"), F.col("true_month").alias("pay_month")
    )
    return Q.list_salary_slips(slips, "finance_agent", employer="employer 3")


@query(
    "q04_salary_slips_of_year",
    """SELECT doc_id AS document_id, CAST(true_month AS INTEGER) AS pay_month FROM px_slips WHERE true_year = 1997 ORDER BY true_year DESC, true_month DESC, doc_id LIMIT 30""",
    ("slips",),
)
def q04_year(spark, sf):
    slips = load(spark, sf, "slips").select(F.col("doc_id").alias("document_id"), F.col("true_year").alias("pay_year"), F.col("true_month").alias("pay_month"))
    return Q.list_salary_slips(slips, "librarian", year=1997, limit=30).drop("pay_year")


@query(
    "q05_utility_bills",
    """SELECT doc_id AS document_id, issue_date FROM (SELECT doc_id, true_service, CASE WHEN doc_id % 50 <> 1 THEN true_issue_date END AS issue_date FROM px_bills)
    WHERE true_service = 'water' ORDER BY issue_date DESC NULLS FIRST, doc_id LIMIT 50""",
    ("bills",),
)
def q05(spark, sf):
    bills = load(spark, sf, "bills").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 50 != 1, F.col("true_issue_date")).alias("issue_date"),
        F.col("true_service").alias("service_type"), F.when(F.col("true_service") == "water", F.lit("מי רעננה")).alias("provider_name"),
    )
    return Q.list_utility_bills(bills, "finance_agent", service_type="water", provider="רעננה").select("document_id", "issue_date")


_CONTRACT_END = f"{_DAY('coalesce(f.contract_end_date, f.period_end)')}"


@query(
    "q06_contracts",
    f"""SELECT doc_id AS document_id, {_DAY('f.source_date')} AS contract_date, {_CONTRACT_END} AS end_date FROM px_documents JOIN ({_map_sql(['source_date', 'contract_end_date', 'period_end'])}) f ON document_id = doc_id
    WHERE doc_type = 'contract' AND ({_CONTRACT_END} IS NULL OR {_CONTRACT_END} >= DATE '1998-06-01') ORDER BY 2 DESC NULLS FIRST, doc_id LIMIT 100""",
    ("documents", "facts"),
)
def q06(spark, sf):
    rows = M.contracts(_docs(spark, sf), load(spark, sf, "facts"))
    return Q.list_contracts(rows, "librarian", F.lit("1998-06-01").cast("date"), active_only=True, limit=100).select("document_id", "contract_date", "end_date")


@query(
    "q07_insurance_policies",
    f"""SELECT doc_id AS document_id, f.insurance_type, {_DAY('f.source_date')} AS policy_date, CAST({_MONEY('f.premium_amount')} AS DOUBLE) AS premium_amount
    FROM px_documents JOIN ({_map_sql(M._POLICY_KEYS)}) f ON document_id = doc_id WHERE doc_type = 'insurance' AND ({_DAY('f.period_end')} IS NULL OR {_DAY('f.period_end')} >= DATE '1998-06-01')
    ORDER BY policy_date DESC NULLS FIRST, doc_id LIMIT 100""",
    ("documents", "facts"),
)
def q07(spark, sf):
    rows = M.insurance_policies(_docs(spark, sf), load(spark, sf, "facts"))
    page = Q.list_policies(rows, "insurance_agent", F.lit("1998-06-01").cast("date"), active_only=True, limit=100)
    return page.select("document_id", "insurance_type", "policy_date", F.col("premium_amount").cast("double").alias("premium_amount"))


@query(
    "q08_library_stats",
    """SELECT 'total_documents' AS metric, count(*) AS value FROM px_documents UNION ALL SELECT 'needs_review', count(*) FROM px_documents WHERE review_state = 'needs_review'
    UNION ALL SELECT 'type:' || doc_type, count(*) FROM px_documents GROUP BY doc_type
    UNION ALL SELECT 'facts', count(*) FROM px_facts UNION ALL SELECT 'salary_slips', count(*) FROM px_slips""",
    ("documents", "facts", "slips"),
)
def q08(spark, sf):
    return Q.library_stats(_docs(spark, sf), {"facts": load(spark, sf, "facts"), "salary_slips": load(spark, sf, "slips")}, "orchestrator")


@query(
    "q09_recent_documents",
    f"SELECT uploaded_by, doc_id, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY uploaded_by {_NEWEST}) AS position FROM px_documents) WHERE position <= 10",
    ("documents",),
)
def q09(spark, sf):
    return Q.recent_documents(_docs(spark, sf), 10).select("uploaded_by", "doc_id", "position")


@query(
    "q10_search_documents",
    f"""SELECT doc_id, created_at::VARCHAR AS created_at FROM px_documents WHERE uploaded_by = 7 AND (filename ILIKE '%1998%' OR display_name ILIKE '%1998%' OR raw_text ILIKE '%1998%') AND review_state = 'auto_verified' {_NEWEST} LIMIT 20""",
    ("documents",),
)
def q10(spark, sf):
    found = Q.search_documents(_docs(spark, sf), 7, keyword="1998", review_state="auto_verified")
    return found.select("doc_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(
    "q10_search_documents_by_vendor",
    f"""SELECT doc_id FROM px_documents WHERE uploaded_by = 3 AND doc_type = 'warranty' AND vendor ILIKE '%CUSTOMER#%' {_NEWEST} LIMIT 20""",
    ("documents",),
)
def q10_vendor(spark, sf):
    return Q.search_documents(_docs(spark, sf), 3, doc_type="warranty", vendor="CUSTOMER#").select("doc_id")


@query(
    "q11_search_by_name",
    f"""SELECT doc_id, CASE WHEN count(*) OVER () = 1 THEN 'single' ELSE 'many' END AS outcome FROM (
      SELECT doc_id FROM px_documents WHERE uploaded_by = 5 AND (filename ILIKE '%invoice%' OR display_name ILIKE '%invoice%') {_NEWEST} LIMIT 10)""",
    ("documents",),
)
def q11(spark, sf):
    return Q.search_by_name(_docs(spark, sf), 5, " invoice ").select("doc_id", "outcome")


@query(
    "q12_view_recent_invoices",
    f"SELECT doc_id FROM px_documents WHERE uploaded_by = 2 AND doc_type = 'invoice' {_NEWEST} LIMIT 10",
    ("documents",),
)
def q12(spark, sf):
    return Q.view(_docs(spark, sf), 2, "recent_invoices").select("doc_id")


@query(
    "q12_view_needs_review",
    f"SELECT doc_id FROM px_documents WHERE uploaded_by = 2 AND review_state = 'needs_review' {_NEWEST} LIMIT 20",
    ("documents",),
)
def q12_review(spark, sf):
    return Q.view(_docs(spark, sf), 2, "needs_review").select("doc_id")


@query(
    "q13_resolve_references",
    f"""WITH r AS (SELECT uploaded_by, string_agg(doc_id, ',' ORDER BY position) AS recent, first(doc_id ORDER BY position) AS newest FROM (
        SELECT *, row_number() OVER (PARTITION BY uploaded_by {_NEWEST}) AS position FROM px_documents) WHERE position <= 5 GROUP BY 1),
      q AS (SELECT message_id AS question_id, message_id % 25 AS member_id, message_id % 3 = 0 AS recency, message_id % 4 = 0 AS held, message_id AS n FROM px_messages)
    SELECT question_id, member_id, CASE WHEN d.doc_id IS NOT NULL THEN 'state' WHEN recent IS NULL THEN 'none' WHEN recency THEN 'newest' ELSE 'candidates' END AS how,
      CASE WHEN d.doc_id IS NOT NULL THEN CAST(d.doc_id AS VARCHAR) WHEN recent IS NULL THEN '' WHEN recency THEN CAST(newest AS VARCHAR) ELSE recent END AS doc_ids
    FROM q LEFT JOIN r ON uploaded_by = member_id LEFT JOIN px_documents d ON d.uploaded_by = member_id AND d.doc_id = member_id * 20 + 40 AND member_id % 2 = 0""",
    ("documents", "messages"),
)
def q13(spark, sf):
    k = F.col("message_id")
    questions = load(spark, sf, "messages").select(
        k.alias("question_id"), (k % 25).alias("member_id"), F.when(k % 3 == 0, F.lit("The LATEST one")).otherwise(F.lit("that one")).alias("question")
    )
    members = questions.select("member_id").distinct()
    state = members.select(
        "member_id", F.when(F.col("member_id") % 2 == 0, F.lit("document")).otherwise(F.lit("task")).alias("last_entity_type"),
        (F.col("member_id") * 20 + 40).alias("last_entity_id"),
    )
    found = Q.resolve_references(questions, _docs(spark, sf), state)
    return found.select("question_id", "member_id", "how", F.array_join("doc_ids", ",").alias("doc_ids"))


_QUESTIONS = ["What is the amount?", "who is the vendor", "תאריך סיום", "parties please", "איזה מתכונים יש", "איך מכינים את זה", "מצרכים", "hello there"]
_FIRST = "SELECT document_id, fact_key, min(fact_seq) AS seq, min_by(fact_value, fact_seq) AS value, min_by(confidence, fact_seq) AS confidence FROM px_facts GROUP BY ALL"


@query(
    "q14_answer_questions",
    f"""WITH q AS (SELECT doc_id AS question_id, *, list_value({', '.join("'" + t + "'" for t in _QUESTIONS)})[1 + doc_id % 8] AS question FROM px_documents),
      f AS ({_FIRST}), hit AS (SELECT doc_id, min_by(value, seq) AS value, min_by(f.confidence, seq) AS confidence, min_by(fact_key, seq) AS fact_key FROM q JOIN f ON document_id = doc_id
        WHERE contains(lower(question), fact_key) OR contains(fact_key, lower(question)) GROUP BY 1),
      p AS (SELECT document_id, value, confidence FROM f WHERE fact_key = 'period_end'),
      r AS (SELECT document_id, count(*) FILTER (fact_key = 'recipe_name') AS n, string_agg(fact_value, ', ' ORDER BY fact_seq) FILTER (fact_key = 'recipe_name') AS dishes,
        min_by(fact_value, fact_seq) FILTER (fact_key = 'instructions') AS howto, min_by(fact_value, fact_seq) FILTER (fact_key = 'ingredients') AS parts FROM px_facts WHERE fact_type = 'recipe' GROUP BY 1),
      a AS (SELECT question_id, CASE doc_id % 8 WHEN 0 THEN CASE WHEN amount IS NOT NULL THEN ['db_field', CAST(amount AS VARCHAR), '1.0', 'amount'] END
          WHEN 1 THEN CASE WHEN vendor IS NOT NULL THEN ['db_field', vendor, '1.0', 'vendor'] END
          WHEN 2 THEN CASE WHEN doc_date IS NOT NULL THEN ['db_field', CAST(doc_date AS VARCHAR), '1.0', 'doc_date'] END END AS field_answer,
        CASE WHEN hit.fact_key IS NOT NULL THEN ['document_fact', hit.value, CAST(hit.confidence AS VARCHAR), hit.fact_key] END AS fact_answer,
        CASE WHEN doc_type = 'recipe' AND doc_id % 8 IN (4, 5, 6) THEN CASE WHEN r.document_id IS NULL THEN ['not_found', 'לא נמצאו מתכונים במסמך הזה', '0.0', NULL]
          WHEN doc_id % 8 = 4 AND n > 0 THEN ['document_fact', 'יש ' || n || ' מתכונים ב' || coalesce(display_name, '') || ': ' || dishes, '0.9', 'recipe_name']
          WHEN doc_id % 8 = 5 AND howto IS NOT NULL THEN ['document_fact', howto, '0.8', 'instructions'] WHEN doc_id % 8 = 6 AND parts IS NOT NULL THEN ['document_fact', parts, '0.8', 'ingredients']
          WHEN n > 0 THEN ['document_fact', 'נמצאו ' || n || ' מתכונים ב' || coalesce(display_name, '') || ': ' || dishes, '0.8', 'recipe_name'] END END AS recipe_answer
        FROM q LEFT JOIN hit USING (doc_id) LEFT JOIN r ON r.document_id = doc_id)
    SELECT question_id, v[1] AS source, v[2] AS answer_text, CAST(v[3] AS DOUBLE) AS confidence, v[4] AS field_used
    FROM (SELECT question_id, coalesce(field_answer, fact_answer, recipe_answer, ['not_found', 'המידע הזה לא זמין במסמך', '0.0', NULL]) AS v FROM a)""",
    ("documents", "facts"),
)
def q14(spark, sf):
    texts = F.array(*[F.lit(t) for t in _QUESTIONS])
    docs = _docs(spark, sf)
    questions = docs.select(F.col("doc_id").alias("question_id"), "doc_id", F.element_at(texts, (F.col("doc_id") % 8 + 1).cast("int")).alias("question"))
    return Q.answer_questions(questions, docs, load(spark, sf, "facts")).drop("doc_id")


@query(
    "q15_list_recipes",
    """SELECT fact_value AS recipe_name, document_id, coalesce(display_name, '') AS display_name FROM px_facts JOIN px_documents ON doc_id = document_id
    WHERE uploaded_by = 4 AND fact_type = 'recipe' AND fact_key = 'recipe_name'""",
    ("documents", "facts"),
)
def q15(spark, sf):
    return Q.list_recipes(load(spark, sf, "facts"), _docs(spark, sf), 4)


@query(
    "q16_search_recipes",
    """WITH m AS (SELECT f.*, coalesce(display_name, '') AS display_name FROM px_facts f JOIN px_documents ON doc_id = document_id WHERE uploaded_by = 4 AND f.fact_type = 'recipe'),
      n AS (SELECT document_id, min_by(fact_value, fact_seq) AS first_name FROM px_facts WHERE fact_type = 'recipe' AND fact_key = 'recipe_name' GROUP BY 1),
      b AS (SELECT document_id, fact_value AS recipe_name, display_name, 0 AS rank FROM m WHERE fact_key = 'recipe_name' AND fact_value ILIKE '%e%'
        UNION ALL SELECT document_id, coalesce(nullif(source_excerpt, ''), first_name), display_name, 1 FROM m LEFT JOIN n USING (document_id) WHERE fact_key = 'ingredients' AND fact_value ILIKE '%e%')
    SELECT recipe_name, document_id, display_name, CASE min(rank) WHEN 0 THEN 'name' ELSE 'ingredient' END AS match_type FROM b WHERE coalesce(recipe_name, '') <> '' GROUP BY ALL""",
    ("documents", "facts"),
)
def q16(spark, sf):
    return Q.search_recipes(load(spark, sf, "facts"), _docs(spark, sf), 4, " E ")


@query(
    "q17_recipe_details",
    """WITH one AS (SELECT document_id, fact_value AS recipe_name, coalesce(nullif(source_excerpt, ''), fact_value) AS e, coalesce(display_name, '') AS display_name FROM px_facts f JOIN px_documents ON doc_id = document_id
        WHERE uploaded_by = 4 AND f.fact_type = 'recipe' AND fact_key = 'recipe_name' AND fact_value ILIKE '%soup%' ORDER BY document_id, fact_seq LIMIT 1)
    SELECT one.document_id, display_name, recipe_name, max_by(fact_value, fact_seq) FILTER (source_excerpt = e AND fact_key = 'ingredients') AS ingredients, max_by(fact_value, fact_seq) FILTER (source_excerpt = e AND fact_key = 'instructions') AS instructions,
      max_by(fact_value, fact_seq) FILTER (source_excerpt = e AND fact_key = 'servings') AS servings, max_by(fact_value, fact_seq) FILTER (source_excerpt = e AND fact_key = 'prep_time') AS prep_time
    FROM one LEFT JOIN (SELECT * FROM px_facts WHERE fact_type = 'recipe') p ON p.document_id = one.document_id GROUP BY ALL""",
    ("documents", "facts"),
)
def q17(spark, sf):
    return Q.recipe_details(load(spark, sf, "facts"), _docs(spark, sf), 4, "soup")


@query(
    "q18_document_recipes",
    "SELECT fact_value AS recipe_name, document_id FROM px_facts JOIN px_documents ON doc_id = document_id WHERE document_id = 11178 AND uploaded_by = 0 AND fact_type = 'recipe' AND fact_key = 'recipe_name'",
    ("documents", "facts"),
)
def q18(spark, sf):
    return Q.document_recipes(load(spark, sf, "facts"), _docs(spark, sf), 0, 11178)


@query(
    "q19_fallback_search",
    f"SELECT doc_id, 'קבלה' AS term FROM px_documents WHERE uploaded_by = 9 AND raw_text ILIKE '%קבלה%' {_NEWEST} LIMIT 20",
    ("documents",),
)
def q19(spark, sf):
    # the first word of the list ("document") is in no text, the second ("receipt") is
    return Q.fallback_search(_docs(spark, sf), 9, "מה יש במסמך או בקבלה").select("doc_id", "term")


@query(
    "q19_fallback_search_rest",
    f"SELECT doc_id, 'Statement of' AS term FROM px_documents WHERE uploaded_by = 9 AND raw_text ILIKE '%statement of%' {_NEWEST} LIMIT 20",
    ("documents",),
)
def q19_rest(spark, sf):
    return Q.fallback_search(_docs(spark, sf), 9, "איפה Statement of").select("doc_id", "term")


@query(
    "q21_tags",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN base || '|' || 'urgent' ELSE '#Tax| ' || seg || '|#' || y || '|' END AS added,
      CASE WHEN doc_id % 3 = 0 THEN lower(seg) || '|' || y ELSE '#Tax| ' || seg || '|#' || y || '|' END AS removed, '#tax, #' || lower(seg) || ', #' || y AS shown
    FROM (SELECT doc_id, trim(tags[2]) AS seg, CAST(year(true_date) AS VARCHAR) AS y, 'tax|' || lower(trim(tags[2])) || '|' || CAST(year(true_date) AS VARCHAR) AS base FROM px_documents)""",
    ("documents",),
)
def q21(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "tags")
    marked = docs.filter(F.col("doc_id") % 3 == 0).select("doc_id")
    added = Q.add_tag(docs, marked.withColumn("tag", F.lit("#Urgent"))).select("doc_id", F.array_join("tags", "|").alias("added"))
    removed = Q.remove_tag(docs, marked.withColumn("tag", F.lit("TAX"))).select("doc_id", F.array_join("tags", "|").alias("removed"))
    return added.join(removed, "doc_id").join(Q.show_tags(docs), "doc_id")


@query(
    "q21_tag_search",
    f"SELECT doc_id FROM px_documents WHERE uploaded_by = 8 AND list_contains(list_transform(tags, lambda t: t), '#1998') {_NEWEST} LIMIT 20",
    ("documents",),
)
def q21_search(spark, sf):
    docs = _docs(spark, sf).withColumn("tags", F.transform("tags", lambda t: F.regexp_replace(t, "^#", "")))
    return Q.search_documents(docs, 8, tag="#1998").select("doc_id")


@query(
    "q22_type_word_search",
    f"SELECT doc_id FROM px_documents WHERE uploaded_by = 1 AND doc_type = 'bank_statement' {_NEWEST} LIMIT 20",
    ("documents",),
)
def q22(spark, sf):
    return Q.search_by_type_word(_docs(spark, sf), 1, "דפי חשבון").select("doc_id")


