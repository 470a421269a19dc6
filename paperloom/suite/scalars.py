"""Scalar functions (S-*) over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions import scalars as S
from paperloom.functions.regex import first_group
from paperloom.suite.registry import query
from paperloom.suite.shapes import load, table


@query(
    "s01_parse_amount",
    """SELECT document_id, fact_seq, CAST(TRY_CAST(replace(fact_value, ',', '') AS DECIMAL(18,2)) AS DOUBLE) AS amount
    FROM px_facts""",
    ("facts",),
)
def s01(spark, sf):
    return load(spark, sf, "facts").select(
        "document_id", "fact_seq", S.parse_amount(F.col("fact_value")).cast("double").alias("amount")
    )


@query(
    "s02_parse_int",
    """SELECT note_id, CASE WHEN note_id % 4 = 0 THEN CAST(note_id AS INTEGER) END AS number FROM px_notes""",
    ("notes",),
)
def s02(spark, sf):
    return load(spark, sf, "notes").select("note_id", S.parse_int(F.col("number_text")).alias("number"))


@query(
    "s03_parse_date",
    """SELECT document_id, fact_seq,
      CAST(try_strptime(fact_value, ['%Y-%m-%d', '%d/%m/%Y', '%d.%m.%Y']) AS DATE) AS day FROM px_facts""",
    ("facts",),
)
def s03(spark, sf):
    return load(spark, sf, "facts").select("document_id", "fact_seq", S.parse_date(F.col("fact_value")).alias("day"))


@query(
    "s04_pay_period",
    """SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN CAST(true_year AS INTEGER) END AS pay_year,
      CASE WHEN doc_id % 4 <> 0 THEN CAST(true_month AS INTEGER) END AS pay_month FROM px_slips""",
    ("slips",),
)
def s04(spark, sf):
    slips = load(spark, sf, "slips").select("doc_id", S.pay_period(F.col("true_pay_month")).alias("p"))
    return slips.select("doc_id", "p.pay_year", "p.pay_month")


@query(
    "s05_first_group",
    """SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN true_account END AS account FROM px_bills""",
    ("bills",),
)
def s05(spark, sf):
    return load(spark, sf, "bills").select("doc_id", first_group(F.col("raw_text"), rules.UTILITY_ACCOUNT_PATTERNS).alias("account"))


@query(
    "s06_year_tag",
    """SELECT doc_id, CAST(year(true_date) AS VARCHAR) AS tag_from_date,
      CASE WHEN doc_id % 6 <> 0 THEN CAST(year(true_date) AS VARCHAR) ELSE coalesce(
        list_extract(list_filter(string_split_regex(replace(replace(filename, '.', ' '), '-', ' '), '\\s+'),
          lambda t: regexp_full_match(t, '(19|20)[0-9]{2}')), 1), '') END AS tag
    FROM px_documents""",
    ("documents",),
)
def s06(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id",
        S.year_tag(F.col("true_date"), F.col("filename")).alias("tag_from_date"),
        S.year_tag(F.col("doc_date"), F.col("filename")).alias("tag"),
    )


@query(
    "s07_normalize_tag",
    """SELECT doc_id, regexp_replace(lower(trim(tags[2])), '^#', '') AS second, regexp_replace(lower(trim(tags[3])), '^#', '') AS third
    FROM px_documents""",
    ("documents",),
)
def s07(spark, sf):
    tags = F.col("tags")
    return load(spark, sf, "documents").select(
        "doc_id", S.normalize_tag(tags[1]).alias("second"), S.normalize_tag(tags[2]).alias("third")
    )


@query(
    "s08_normalize_tags",
    """SELECT doc_id, concat('tax|', lower(trim(tags[2])), '|', CAST(year(true_date) AS VARCHAR)) AS tags FROM px_documents""",
    ("documents",),
)
def s08(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.array_join(S.normalize_tags(F.col("tags")), "|").alias("tags"))


@query(
    "s09_merge_tags",
    """SELECT doc_id, concat('tax|', lower(trim(tags[2])), '|', CAST(year(true_date) AS VARCHAR), '|', doc_type) AS tags FROM px_documents""",
    ("documents",),
)
def s09(spark, sf):
    additions = F.array(F.lit("#TAX"), F.col("doc_type"), F.lit(" "))
    return load(spark, sf, "documents").select("doc_id", F.array_join(S.merge_tags(F.col("tags"), additions), "|").alias("tags"))


@query(
    "s10_chunk_text",
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(length(chunk) AS INTEGER) AS chars, md5(chunk) AS digest
    FROM (
      SELECT doc_id, i, substring(text, i * 2700 + 1, 3000) AS chunk
      FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 3000 THEN 1 ELSE CAST(ceil(length(text) / 2700.0) AS BIGINT) END)) AS i
            FROM documents))""",
)
def s10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(S.chunk_text(F.col("text"))).alias("chunk_no", "chunk"))
    return docs.select("doc_id", "chunk_no", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


@query("s11_excerpt", "SELECT doc_id, substring(text, 1, 250) AS excerpt FROM documents")
def s11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.excerpt(F.col("text")).alias("excerpt"))


@query(
    "s12_normalize_phone",
    """SELECT request_id, CASE request_id % 3 WHEN 1 THEN '05' ELSE '9725' END || lpad(CAST(request_id % 1300 AS VARCHAR), 8, '0') AS phone FROM px_requests""",
    ("requests",),
)
def s12(spark, sf):
    return load(spark, sf, "requests").select("request_id", S.normalize_phone(F.col("phone")).alias("phone"))


@query(
    "s13_canonical_phone",
    """SELECT request_id, '9725' || lpad(CAST(request_id % 1300 AS VARCHAR), 8, '0') AS phone FROM px_requests""",
    ("requests",),
)
def s13(spark, sf):
    return load(spark, sf, "requests").select("request_id", S.canonical_phone(F.col("phone")).alias("phone"))


@query(
    "s14_phone_candidates",
    """SELECT request_id, CASE request_id % 3
        WHEN 0 THEN concat_ws('|', phone, '9725' || n, '+9725' || n, '05' || n, '+05' || n)
        WHEN 1 THEN concat_ws('|', '05' || n, '+05' || n, '9725' || n, '+9725' || n)
        ELSE concat_ws('|', phone, '9725' || n, '+9725' || n, '05' || n, '+05' || n) END AS spellings
    FROM (SELECT *, lpad(CAST(request_id % 1300 AS VARCHAR), 8, '0') AS n FROM px_requests)""",
    ("requests",),
)
def s14(spark, sf):
    return load(spark, sf, "requests").select("request_id", F.array_join(S.phone_candidates(F.col("phone")), "|").alias("spellings"))


@query(
    "s15_valid_phone",
    """SELECT request_id, request_id % 3 = 1 AS raw_ok, true AS normalized_ok FROM px_requests""",
    ("requests",),
)
def s15(spark, sf):
    return load(spark, sf, "requests").select(
        "request_id",
        S.valid_phone(F.col("phone")).alias("raw_ok"),
        S.valid_phone(S.normalize_phone(F.col("phone"))).alias("normalized_ok"),
    )


@query(
    "s19_audit_text",
    """SELECT message_id, CASE WHEN message_id % 2 = 0 THEN left(message_in, 187) || '[PII removed]' ELSE left(message_in, 200) END AS audit_text
    FROM px_messages""",
    ("messages",),
)
def s19(spark, sf):
    return load(spark, sf, "messages").select(
        "message_id", S.audit_text(F.col("message_in"), F.col("message_id") % 2 == 0).alias("audit_text")
    )


@query(
    "s20_normalize_name",
    """SELECT request_id,
      CASE WHEN request_id % 4 = 3 THEN 'anyone' ELSE lower(trim(person)) END AS name,
      CASE request_id % 4 WHEN 1 THEN substring(lower(trim(person)), 2) ELSE lower(trim(person)) END AS member_name
    FROM px_requests""",
    ("requests",),
)
def s20(spark, sf):
    person = F.col("person")
    return load(spark, sf, "requests").select(
        "request_id",
        S.normalize_name(person, {"nobody": "anyone"}).alias("name"),
        S.normalize_member_name(person).alias("member_name"),
    )


@query(
    "s21_fact_category",
    """SELECT fact_id, CASE fact_key WHEN 'building_code' THEN 'household_access' WHEN 'health_note' THEN 'health'
      WHEN 'financial_salary' THEN 'financial' ELSE 'basic_personal' END AS category FROM px_member_facts""",
    ("member_facts",),
)
def s21(spark, sf):
    return load(spark, sf, "member_facts").select("fact_id", S.fact_category(F.col("fact_key")).alias("category"))


_MONTHS = ", ".join(f"'{m}'" for m in rules.HEBREW_MONTHS)
_DAYS = ", ".join(f"'{d}'" for d in rules.HEBREW_WEEKDAYS)


@query(
    "s22_local_time_parts",
    f"""SELECT event_id, strftime(local, '%Y-%m-%d') AS today_date,
      'יום ' || [{_DAYS}][isodow(local)] AS today_day,
      'יום ' || [{_DAYS}][isodow(local)] || ', ' || day(local) || ' ב' || [{_MONTHS}][month(local)] || ' ' || year(local) AS today_display,
      strftime(next, '%Y-%m-%d') AS tomorrow_date,
      'יום ' || [{_DAYS}][isodow(next)] || ', ' || day(next) || ' ב' || [{_MONTHS}][month(next)] || ' ' || year(next) AS tomorrow_display,
      strftime(local, '%H:%M') AS time, CAST(hour(local) AS INTEGER) AS hour
    FROM (SELECT event_id, ts + INTERVAL 2 HOUR AS local, ts + INTERVAL 26 HOUR AS next FROM events)""",
)
def s22(spark, sf):
    # the events lie in January, when the display zone is two hours ahead of UTC
    parts = table(spark, sf, "events").select("event_id", S.local_time_parts(F.col("ts").cast("timestamp")).alias("p"))
    return parts.select("event_id", "p.*")


@query(
    "s24_assignee_shorthand",
    """SELECT note_id, CASE note_id % 4 WHEN 0 THEN 'דנה' || note_id WHEN 1 THEN 'Noa' || note_id END AS assignee,
      CASE note_id % 4 WHEN 0 THEN 'Fix door ' || note_id WHEN 1 THEN 'call' ELSE title END AS title FROM px_notes""",
    ("notes",),
)
def s24(spark, sf):
    found = load(spark, sf, "notes").select("note_id", S.assignee_shorthand(F.col("title")).alias("p"))
    return found.select("note_id", "p.assignee", "p.title")


@query(
    "s25_task_changes",
    """SELECT note_id, CASE WHEN note_id % 5 < 2 THEN day END AS due_date,
      CASE note_id % 5 WHEN 0 THEN 'urgent' WHEN 1 THEN 'low' WHEN 2 THEN 'high' END AS priority,
      CASE note_id % 5 WHEN 1 THEN 'Paint wall ' || note_id WHEN 3 THEN 'שם ' || note_id END AS title FROM px_notes""",
    ("notes",),
)
def s25(spark, sf):
    found = load(spark, sf, "notes").select("note_id", S.task_changes(F.col("changes")).alias("p"))
    return found.select("note_id", "p.*")


@query(
    "s26_recurring_request",
    """SELECT note_id, CASE note_id % 5 WHEN 0 THEN 'ארנונה ' || note_id WHEN 1 THEN 'gym ' || note_id
        WHEN 2 THEN 'rent ב-' || (1 + note_id % 28) || ' בחודש' WHEN 3 THEN 'tax ' || note_id ELSE 'walk ' || note_id END AS title,
      CASE note_id % 5 WHEN 1 THEN 'weekly' WHEN 3 THEN 'yearly' ELSE 'monthly' END AS frequency,
      CAST(CASE note_id % 5 WHEN 0 THEN 1 + note_id % 31 WHEN 2 THEN 1 + note_id % 28 END AS INTEGER) AS day_of_month FROM px_notes""",
    ("notes",),
)
def s26(spark, sf):
    found = load(spark, sf, "notes").select("note_id", S.recurring_request(F.col("recurring")).alias("p"))
    return found.select("note_id", "p.*")


@query(
    "s27_statements",
    """SELECT note_id, CASE note_id % 6 WHEN 0 THEN 'Dana' || note_id WHEN 1 THEN 'יוסי' END AS born_name,
      CASE note_id % 6 WHEN 0 THEN strftime(day, '%d/%m/%Y') WHEN 1 THEN strftime(day, '%d.%m.%Y') END AS birth_date,
      CASE note_id % 6 WHEN 2 THEN 'Noa' || note_id END AS id_name,
      CASE note_id % 6 WHEN 2 THEN CAST(200000 + note_id AS VARCHAR) END AS id_number,
      CASE note_id % 6 WHEN 3 THEN 'Ahuza ' || note_id WHEN 4 THEN 'רחוב הרצל' END AS location,
      CASE WHEN note_id % 6 IN (3, 4) THEN CAST(1000 + note_id AS VARCHAR) END AS code FROM px_notes""",
    ("notes",),
)
def s27(spark, sf):
    text = F.col("statement")
    found = load(spark, sf, "notes").select(
        "note_id",
        S.birth_statement(text).alias("b"), S.id_statement(text).alias("i"), S.building_code_statement(text).alias("c"),
    )
    return found.select(
        "note_id", F.col("b.name").alias("born_name"), "b.birth_date", F.col("i.name").alias("id_name"), "i.id_number",
        "c.location", "c.code",
    )
