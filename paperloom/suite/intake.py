"""Sources, ingestion and extractor routing (I-*, X-01 ... X-06, X-09)."""
from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators import ingest, routing
from paperloom.sources import extractors
from paperloom.sources import files as S
from paperloom.sources import tables as T
from paperloom.sources.messages import parse_messages
from paperloom.suite.registry import query
from paperloom.suite.shapes import load, table

# the extractors below travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_UUID = "2e7797c9-1b2c-4d5e-8f90-4f0d9a81554e_"


def _corpus_files(spark, sf):
    """The real corpus as files: a path and bytes per document."""
    docs = table(spark, sf, "documents")
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit(_UUID)).otherwise(F.lit("")), F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".TXT"))
    return docs.select("doc_id", F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), name).alias("path"), F.encode("text", "UTF-8").alias("content"))


@query(
    "i01_file_intake",
    """SELECT doc_id, 'doc ' || doc_id || '.TXT' AS filename, '.txt' AS extension, 'other' AS file_class, sha256(text) AS file_hash,
      'other' AS doc_type, 'pending' AS review_state, 0.0::DOUBLE AS confidence, 0 AS n_tags FROM documents""",
)
def i01(spark, sf):
    stubs = S.document_stubs(_corpus_files(spark, sf))
    return stubs.select(
        "doc_id", "filename", "extension", "file_class", "file_hash", "doc_type", "review_state", "confidence", F.size("tags").alias("n_tags")
    )


_TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]


@query(
    "i01_binary_files",
    f"""SELECT t || '.parquet' AS filename, '.parquet' AS extension, 'other' AS file_class, true AS has_bytes, true AS hashed
    FROM (VALUES {", ".join(f"('{t}')" for t in _TABLES)}) v(t)""",
)
def i01_files(spark, sf):
    """The table files themselves, read as binary files."""
    stubs = S.document_stubs(S.read_files(spark, sf, "*.parquet"))
    hashed = F.length("file_hash") == 64
    return stubs.select("filename", "extension", "file_class", (F.col("length") > 0).alias("has_bytes"), hashed.alias("hashed"))


@query(
    "i02_strip_uuid_prefix",
    "SELECT doc_id, 'doc ' || doc_id || '.TXT' AS filename FROM documents",
)
def i02(spark, sf):
    return _corpus_files(spark, sf).select("doc_id", S.strip_uuid_prefix(S.base_name(F.col("path"))).alias("filename"))


@query(
    "i03_file_class",
    """SELECT file_class, count(*) AS n FROM (
      SELECT CASE doc_id % 7 WHEN 2 THEN 'image' WHEN 6 THEN 'image' WHEN 4 THEN 'spreadsheet' WHEN 5 THEN 'other' ELSE 'extractable' END AS file_class
      FROM px_documents) GROUP BY 1""",
    ("documents",),
)
def i03(spark, sf):
    docs = load(spark, sf, "documents").select(S.file_class(S.extension(F.col("filename"))).alias("file_class"))
    return docs.groupBy("file_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "i04_sniff_extension",
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 9 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.pdf' WHEN 3 THEN '.bmp' WHEN 4 THEN '.tiff'
        WHEN 5 THEN '.tiff' WHEN 6 THEN '.heic' ELSE '' END AS sniffed,
      CASE o_orderkey % 2 WHEN 0 THEN '.docx' ELSE CASE o_orderkey % 9 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.pdf' WHEN 3 THEN '.bmp'
        WHEN 4 THEN '.tiff' WHEN 5 THEN '.tiff' WHEN 6 THEN '.heic' ELSE '.bin' END END AS resolved
    FROM orders""",
)
def i04(spark, sf):
    heads = ["FFD8FFE0", "89504E470D0A1A0A", "255044462D", "424D3610", "49492A0008", "4D4D002A00", "0000001866747970", "7465787400", "00"]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    body = F.hex(F.encode(F.col("o_orderpriority"), "UTF-8"))
    files = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.unhex(F.concat(head, body)).alias("content"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(".docx")).otherwise(F.lit(".bin"))).alias("name"),
    )
    return files.select("doc_id", S.sniff_extension(F.col("content")).alias("sniffed"), S.resolved_extension(F.col("name"), F.col("content")).alias("resolved"))


@query("i05_content_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def i05(spark, sf):
    return _corpus_files(spark, sf).select("doc_id", S.content_hash(F.col("content")).alias("file_hash"))


def _batch_and_catalog(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 3).alias("uploaded_by"), F.sha2("text", 256).alias("file_hash"), "source"
    )
    stored = F.col("source").isin("src1", "src2", "src3")
    key = ["doc_id", "uploaded_by", "file_hash"]
    return docs.filter(~stored).select(*key), docs.filter(stored).select(*key)


_DUPLICATES = """
  d AS (SELECT doc_id, doc_id % 3 AS uploaded_by, sha256(text) AS h, source IN ('src1', 'src2', 'src3') AS stored FROM documents),
  owned AS (SELECT *, first_value(doc_id) OVER (PARTITION BY uploaded_by, h ORDER BY stored DESC, doc_id) AS owner,
              first_value(stored) OVER (PARTITION BY uploaded_by, h ORDER BY stored DESC, doc_id) AS owner_stored FROM d)"""


@query(
    "i06_duplicates",
    f"WITH {_DUPLICATES} SELECT doc_id, CASE WHEN owner <> doc_id THEN owner END AS existing_id FROM owned WHERE NOT stored",
)
def i06(spark, sf):
    incoming, catalog = _batch_and_catalog(spark, sf)
    return ingest.split_duplicates(incoming, catalog).select("doc_id", "existing_id")


@query("i06_new_documents", f"WITH {_DUPLICATES} SELECT doc_id, uploaded_by FROM owned WHERE NOT stored AND owner = doc_id")
def i06_new(spark, sf):
    incoming, catalog = _batch_and_catalog(spark, sf)
    # a low limit sends the copied contents through the path for hot keys
    return ingest.new_documents(incoming, catalog, hot_rows=2).select("doc_id", "uploaded_by")


@query(
    "i07_storage_layout",
    """SELECT CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month, count(*) AS n FROM px_documents GROUP BY ALL""",
    ("documents",),
)
def i07(spark, sf):
    from paperloom.session import shared_folder

    path = shared_folder(spark, "library")
    S.write_by_month(load(spark, sf, "documents").select("doc_id", "created_at"), path)
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "i08_text_intake",
    """SELECT message_id, CASE WHEN message_id % 3 = 0 THEN 'note ' || message_id ELSE 'text_' || strftime(ts, '%Y-%m-%d') || '.txt' END AS filename,
      CASE WHEN message_id % 3 = 0 THEN 'note ' || message_id ELSE 'recipe_' || strftime(ts, '%Y-%m-%d') || '.txt' END AS final_name,
      'text_message' AS source, 'pending' AS review_state FROM px_messages WHERE trim(message_in) <> ''""",
    ("messages",),
)
def i08(spark, sf):
    texts = load(spark, sf, "messages").select(
        "message_id", "ts", F.col("message_in").alias("raw_text"),
        F.when(F.col("message_id") % 3 == 0, F.concat(F.lit("note "), F.col("message_id").cast("string"))).alias("title"),
    )
    first = ingest.text_documents(texts, F.col("ts"))
    final = ingest.text_documents(texts, F.col("ts"), F.lit("recipe")).select("message_id", F.col("filename").alias("final_name"))
    return first.join(final, "message_id").select("message_id", "filename", "final_name", "source", "review_state")


def payload_events(turns):
    """Conversation turns as message events; ids, senders and texts sit on different paths."""
    c = F.col
    k = c("conv_id") * 100 + c("turn")
    phone = F.lpad((c("conv_id") % 900).cast("string"), 8, "0")
    body = c("text")
    blank, none = F.lit(" "), F.lit(None).cast("string")
    caption = F.struct(body.alias("caption"))
    level = F.struct(F.struct(caption.alias("videoMessage")).alias("message"))
    # the text stands in a conversation field, one, three or five levels down, or in a list
    nested = F.struct(
        F.when(k % 10 == 0, body).when(k % 10 == 5, blank).alias("conversation"), F.when(k % 10 == 1, F.struct(body.alias("text"))).alias("extendedTextMessage"),
        F.when(k % 10 == 2, level).alias("ephemeralMessage"), F.when((k % 10 > 3) & (k % 2 == 0), F.struct(level.alias("inner"), none.alias("x"))).alias("deeper"),
        F.when((k % 10 == 3) | ((k % 10 >= 5) & (k % 2 == 1)), F.array(blank, body)).alias("parts"),
    )
    data = F.struct(
        F.struct(
            F.when(k % 4 == 0, F.concat(F.lit("9725"), phone, F.lit("@s.net"))).alias("remoteJidAlt"),
            F.when(k % 4 == 1, F.concat(F.lit("05"), phone)).alias("participantPn"),
            F.when(k % 5 == 0, F.lit(" key ")).alias("id"),
        ).alias("key"),
        F.when(k % 3 == 0, F.struct(F.concat(F.lit("ser"), k.cast("string")).alias("_serialized"), F.lit("key").alias("id"))).alias("id"),
        F.when(k % 3 == 2, nested).alias("message"),
    )
    payload = F.struct(
        F.concat(F.lit("m"), k.cast("string")).alias("id"),
        (c("role") == "assistant").alias("fromMe"),
        F.when(k % 7 != 0, F.concat(F.lit("12345"), (k % 10).cast("string"), F.lit("@lid"))).alias("from"),
        F.when(k % 3 == 0, body).when(k % 3 == 1, F.lit("  ")).alias("body"),
        F.when(k % 3 == 1, F.when(k % 11 != 0, body)).alias("caption"),
        (k % 13 == 0).alias("hasMedia"),
        data.alias("_data"),
    )
    event = F.when(c("role") == "system", F.lit("session.status")).otherwise(F.lit("message"))
    return turns.select(k.alias("k"), F.to_json(F.struct(event.alias("event"), payload.alias("payload"))).alias("body"))


def _payloads(spark, sf):
    return payload_events(table(spark, sf, "conversations"))


_PAYLOAD_SQL = """
  SELECT conv_id * 100 + turn AS k, role, text, lpad(CAST(conv_id % 900 AS VARCHAR), 8, '0') AS p,
    CASE WHEN (conv_id * 100 + turn) % 3 = 1 AND (conv_id * 100 + turn) % 11 = 0 THEN NULL
         ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS message_text,
    CASE (conv_id * 100 + turn) % 4 WHEN 0 THEN '9725' || lpad(CAST(conv_id % 900 AS VARCHAR), 8, '0') WHEN 1 THEN '05' || lpad(CAST(conv_id % 900 AS VARCHAR), 8, '0')
      ELSE CASE WHEN (conv_id * 100 + turn) % 7 <> 0 THEN '12345' || ((conv_id * 100 + turn) % 10) ELSE '' END END AS phone,
    (conv_id * 100 + turn) % 13 = 0 AS media
  FROM conversations"""


@query(
    "i09_message_intake",
    f"""SELECT k, CASE WHEN role = 'system' THEN 'non-message event' WHEN role = 'assistant' THEN 'echo' WHEN phone = '' THEN 'missing sender'
      WHEN coalesce(message_text, '') = '' AND NOT media THEN 'non-text message' END AS reason FROM ({_PAYLOAD_SQL})""",
)
def i09(spark, sf):
    return parse_messages(_payloads(spark, sf)).select("k", "reason")


@query("i10_sender_phone", f"SELECT k, phone FROM ({_PAYLOAD_SQL})")
def i10(spark, sf):
    return parse_messages(_payloads(spark, sf)).select("k", "phone")


@query("i11_message_text", f"SELECT k, nullif(message_text, '') AS message_text FROM ({_PAYLOAD_SQL})")
def i11(spark, sf):
    return parse_messages(_payloads(spark, sf)).select("k", "message_text")


@query(
    "i12_message_ids",
    f"""SELECT k, concat_ws('|', 'm' || k, CASE WHEN k % 3 = 0 THEN 'ser' || k || '|key' WHEN k % 5 = 0 THEN 'key' END) AS ids FROM ({_PAYLOAD_SQL})""",
)
def i12(spark, sf):
    return parse_messages(_payloads(spark, sf)).select("k", F.array_join("message_ids", "|").alias("ids"))


@query(
    "i13_reprocess_plan",
    "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'skip_no_file' ELSE 'reprocess' END AS plan FROM px_documents WHERE doc_type = 'invoice'",
    ("documents",),
)
def i13_plan(spark, sf):
    docs = load(spark, sf, "documents").withColumn("file_path", F.when(F.col("doc_id") % 8 != 0, F.concat(F.lit("/store/"), F.col("filename"))))
    return ingest.reprocess_plan(docs, F.col("doc_type") == "invoice").select("doc_id", "plan")


@query(
    "i13_reprocess_facts",
    """SELECT fact_type, CASE WHEN document_id % 13 = 3 THEN 'rerun' ELSE 'kept' END AS origin, count(*) AS n FROM px_facts GROUP BY ALL""",
    ("facts",),
)
def i13_replace(spark, sf):
    facts = load(spark, sf, "facts")
    docs = load(spark, sf, "documents").filter(F.col("doc_type") == "invoice")
    ids = docs.select(F.col("doc_id").alias("document_id"))
    fresh = facts.join(ids, "document_id", "left_semi").withColumn("origin", F.lit("rerun"))
    kept = facts.withColumn("origin", F.lit("kept"))
    return ingest.replace_rows(kept, ids, fresh, "document_id").groupBy("fact_type", "origin").agg(F.count(F.lit(1)).alias("n"))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.DOC_TYPE_LABELS.items() if k != "other")
_MONTHS = ", ".join(f"'{m}'" for m in rules.HEBREW_MONTHS)
NAME_SQL = f"""CASE WHEN doc_type IN ('other', 'salary_slip') THEN concat_ws(' ', 'מסמך', strftime(doc_date, '%Y-%m-%d'))
      ELSE concat_ws(' ', CASE doc_type {_LABELS} END, vendor, [{_MONTHS}][month(doc_date)], CAST(year(doc_date) AS VARCHAR)) END"""


@query(
    "i14_backfill_names",
    f"SELECT doc_id, display_name IS NULL AS backfilled, coalesce(display_name, {NAME_SQL}) AS display_name FROM px_documents",
    ("documents",),
)
def i14(spark, sf):
    return ingest.backfill_display_names(load(spark, sf, "documents")).select("doc_id", "backfilled", "display_name")


@query(
    "i14_backfill_counts",
    "SELECT count(*) FILTER (display_name IS NULL) AS total, count(*) FILTER (display_name IS NULL) AS success, 0::BIGINT AS failed FROM px_documents",
    ("documents",),
)
def i14_counts(spark, sf):
    return ingest.backfill_counts(ingest.backfill_display_names(load(spark, sf, "documents")))


@query(
    "i15_cascade_delete",
    """SELECT 'documents' AS table_name, count(*) AS n FROM px_documents WHERE doc_type <> 'electricity_bill'
    UNION ALL SELECT 'facts', count(*) FROM px_facts WHERE document_id NOT IN (SELECT doc_id FROM px_documents WHERE doc_type = 'electricity_bill')
    UNION ALL SELECT 'bills', count(*) FROM px_bills WHERE doc_id NOT IN (SELECT doc_id FROM px_documents WHERE doc_type = 'electricity_bill')""",
    ("documents", "facts", "bills"),
)
def i15(spark, sf):
    docs, facts = load(spark, sf, "documents"), load(spark, sf, "facts")
    bills = load(spark, sf, "bills").select(F.col("doc_id").alias("document_id"))
    parent, left = T.delete_cascade(docs, {"facts": facts, "bills": bills}, F.col("doc_type") == "electricity_bill", "doc_id", "document_id")
    count = lambda df, name: df.select(F.lit(name).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    return count(parent, "documents").unionByName(count(left["facts"], "facts")).unionByName(count(left["bills"], "bills"))


@query("i17_scan", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice >= 250000 GROUP BY 1")
def i17(spark, sf):
    orders = T.read_table(spark, f"{sf}/orders.parquet").filter(F.col("o_totalprice") >= 250000)
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("i17_point_lookup", "SELECT l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 77")
def i17_point(spark, sf):
    return T.read_table(spark, f"{sf}/lineitem.parquet").filter(F.col("l_orderkey") == 77).select("l_partkey", "l_quantity")


@query(
    "i18_ingest_status",
    """SELECT status, count(*) AS n, CAST(sum(facts_count) AS BIGINT) AS facts FROM (
      SELECT CASE WHEN doc_id % 19 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'duplicate' ELSE 'processed' END AS status,
        CASE WHEN doc_id % 19 <> 0 AND doc_id % 5 <> 0 THEN coalesce(n, 0) ELSE 0 END AS facts_count
      FROM px_documents LEFT JOIN (SELECT document_id, count(*) AS n FROM px_facts GROUP BY 1) f ON document_id = doc_id) GROUP BY 1""",
    ("documents", "facts"),
)
def i18(spark, sf):
    batch = load(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") - 1).alias("existing_id"), (F.col("doc_id") % 19 == 0).alias("failed")
    )
    status = ingest.ingest_status(batch, load(spark, sf, "facts"))
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("facts_count").alias("facts"))


# --- extractor routing --------------------------------------------------------------------------


@query(
    "x01_route",
    """SELECT doc_id, CASE WHEN doc_type IN ('salary_slip', 'invoice', 'receipt', 'bank_statement', 'credit_card_statement', 'electricity_bill', 'contract', 'insurance')
        OR doc_id % 7 IN (2, 6) THEN 'google_docai,bedrock_vision,tesseract'
      WHEN doc_id % 7 IN (0, 1) THEN 'google_docai,tesseract,bedrock_vision' ELSE 'tesseract,bedrock_vision,google_docai' END AS route FROM px_documents""",
    ("documents",),
)
def x01(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.array_join(routing.route(F.col("doc_type"), F.col("filename")), ",").alias("route"))


def _candidates(spark, sf):
    """Line items as extractor results: the line number is the priority, the discount the confidence."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat(F.lit("extractor "), F.col("l_suppkey").cast("string")).alias("processor"),
        (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("priority"),
        F.when(F.col("l_quantity") % 9 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("text "), F.col("l_partkey").cast("string"))).alias("raw_text"),
        (F.round(F.col("l_discount") * 100) / 200).alias("confidence"),
    )


@query(
    "x02_best_candidate",
    """WITH c AS (SELECT l_orderkey AS doc_id, 'extractor ' || l_suppkey AS processor, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 1000 + l_suppkey AS priority,
        'text ' || l_partkey AS raw_text, round(l_discount * 100) / 200 AS confidence FROM lineitem WHERE l_quantity % 9 <> 0),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence < 0.4,
          CASE WHEN confidence >= 0.4 THEN priority END, confidence DESC, priority) AS rn FROM c)
    SELECT o_orderkey AS doc_id, coalesce(processor, 'fallthrough') AS processor, coalesce(raw_text, '') AS raw_text, coalesce(confidence, 0.0::DOUBLE) AS confidence,
      CASE WHEN confidence >= 0.4 THEN 'accepted' WHEN confidence IS NOT NULL THEN 'best_effort' ELSE 'all_failed' END AS outcome
    FROM orders LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) ON doc_id = o_orderkey""",
)
def x02(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return routing.best_candidate(_candidates(spark, sf), docs)


class _Strict(extractors.PlainText):
    """Plain text only where the file name says so."""

    def process(self, file):
        if not file.path.endswith(".txt"):
            raise ValueError("not a text file")
        return super().process(file)


def _page_files(spark, sf):
    """Web pages as files: two of three under a markup name, the others as text; every eleventh is empty."""
    k = F.col("page_id")
    name = F.concat(F.lit("/in/page"), k.cast("string"), F.when(k % 3 == 0, F.lit(".txt")).otherwise(F.lit(".html")))
    body = F.when(k % 11 == 0, F.lit(" ")).when(k % 5 == 0, F.lit("no tags here")).otherwise(F.col("html"))
    return table(spark, sf, "pages").select(k.alias("doc_id"), name.alias("path"), F.lit("other").alias("doc_type"), F.encode(body, "UTF-8").alias("content"))


_PAGE_CASES = """SELECT page_id AS doc_id, page_id % 3 = 0 AS plain_file, CASE WHEN page_id % 11 = 0 THEN ' ' WHEN page_id % 5 = 0 THEN 'no tags here' ELSE html END AS body FROM pages"""


@query(
    "x02_extractors",
    f"""SELECT doc_id, CASE WHEN trim(body) = '' THEN 'all_failed' WHEN regexp_matches(body, '<[a-zA-Z/!]') THEN 'accepted' WHEN plain_file THEN 'accepted' ELSE 'all_failed' END AS outcome,
      CASE WHEN trim(body) = '' THEN 'fallthrough' WHEN regexp_matches(body, '<[a-zA-Z/!]') THEN 'bedrock_vision' WHEN plain_file THEN 'tesseract' ELSE 'fallthrough' END AS processor,
      CASE WHEN trim(body) = '' THEN 0.0::DOUBLE WHEN regexp_matches(body, '<[a-zA-Z/!]') THEN 0.8::DOUBLE WHEN plain_file THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence
    FROM ({_PAGE_CASES})""",
)
def x02_extractors(spark, sf):
    """Two registered extractors under the names of the route: text files first, then markup."""
    registered = {"tesseract": _Strict(), "bedrock_vision": extractors.Markup()}
    return extractors.extract_texts(_page_files(spark, sf), registered).select("doc_id", "outcome", "processor", "confidence")


@query(
    "x02_extractor_tries",
    f"""WITH c AS (SELECT *, regexp_matches(body, '<[a-zA-Z/!]') AS marked, trim(body) <> '' AS filled FROM ({_PAGE_CASES}))
    SELECT processor, failed, count(*) AS n FROM (
      SELECT 'tesseract' AS processor, NOT plain_file AS failed FROM c
      UNION ALL SELECT 'bedrock_vision', NOT marked FROM c WHERE NOT (plain_file AND filled AND NOT marked)) GROUP BY ALL""",
)
def x02_tries(spark, sf):
    """The second extractor sees only what the first could not read."""
    registered = {"tesseract": _Strict(), "bedrock_vision": extractors.Markup()}
    tries = extractors.candidates(_page_files(spark, sf), registered)
    return tries.groupBy("processor", F.col("error").isNotNull().alias("failed")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x03_quality_fallback",
    """SELECT doc_id, CASE WHEN alt THEN 'alt ' || doc_id ELSE 'first ' || doc_id END AS raw_text, CASE WHEN alt THEN s2 ELSE s1 END AS text_quality,
      CASE WHEN alt THEN 'vision' ELSE 'ocr_preprocessed' END AS extraction_method
    FROM (SELECT *, has_alt AND CASE WHEN s1 >= 0.5 THEN false WHEN s1 >= 0.3 THEN s2 > s1 ELSE image END AS alt FROM (
      SELECT o_orderkey AS doc_id, (o_orderkey % 10)::DOUBLE / 10 AS s1, (o_custkey % 10)::DOUBLE / 10 AS s2, o_orderkey % 3 = 0 AS image, o_orderkey % 8 <> 0 AS has_alt FROM orders))""",
)
def x03(spark, sf):
    k = F.col("o_orderkey")
    pairs = table(spark, sf, "orders").select(
        k.alias("doc_id"), F.concat(F.lit("first "), k.cast("string")).alias("primary_text"), ((k % 10).cast("double") / 10).alias("primary_score"),
        F.when(k % 8 != 0, F.concat(F.lit("alt "), k.cast("string"))).alias("alt_text"), ((F.col("o_custkey") % 10).cast("double") / 10).alias("alt_score"),
        (k % 3 == 0).alias("is_image"),
    )
    return routing.quality_fallback(pairs)


@query(
    "x04_merge_batches",
    """WITH b AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 1000 + l_suppkey AS batch_no,
        CASE WHEN l_quantity % 5 = 0 THEN '' ELSE 'page ' || l_partkey END AS raw_text, 'k' || (l_partkey % 3) AS ek,
        CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'v' || l_suppkey END AS ev, (round(l_discount * 100) * 10)::BIGINT AS conf, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'l' || (l_suppkey % 5) END AS lang FROM lineitem),
      e AS (SELECT doc_id, string_agg(ek || '=' || ev, ',' ORDER BY ek) AS entities FROM (
        SELECT doc_id, ek, min_by(ev, batch_no) AS ev FROM b WHERE ev <> '' GROUP BY ALL) GROUP BY 1)
    SELECT b.doc_id, coalesce(string_agg(nullif(raw_text, ''), chr(10) || chr(10) ORDER BY batch_no), '') AS raw_text, string_agg('t' || batch_no, ',' ORDER BY batch_no) AS tables, any_value(entities) AS entities,
      CASE WHEN count(*) FILTER (conf <> 0) = 0 THEN 0.0::DOUBLE ELSE sum(conf)::DOUBLE / count(*) FILTER (conf <> 0) END AS confidence, count(*) * 2 AS page_count,
      min_by(lang, batch_no) FILTER (lang <> '') AS lang
    FROM b LEFT JOIN e ON e.doc_id = b.doc_id GROUP BY b.doc_id""",
)
def x04(spark, sf):
    c = F.col
    batches = table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("doc_id"), (c("l_linenumber").cast("long") * 100_000_000 + c("l_partkey") * 1000 + c("l_suppkey")).alias("batch_no"),
        F.when(c("l_quantity") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("page "), c("l_partkey").cast("string"))).alias("raw_text"),
        F.create_map(F.concat(F.lit("k"), (c("l_partkey") % 3).cast("string")), F.when(c("l_suppkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), c("l_suppkey").cast("string")))).alias("entities"),
        F.array(F.round(c("l_discount") * 100) * 10, F.lit(0.0)).alias("page_confidences"), F.lit(2).alias("page_count"),
        F.when(c("l_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("l"), (c("l_suppkey") % 5).cast("string"))).alias("lang"),
    )
    batches = batches.withColumn("tables", F.array(F.array(F.array(F.concat(F.lit("t"), c("batch_no").cast("string"))))))
    merged = routing.merge_batches(batches)
    entries = F.array_sort(F.map_entries("entities"))
    return merged.select(
        "doc_id", "raw_text", F.array_join(F.flatten(F.flatten("tables")), ",").alias("tables"),
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("entities"), "confidence", "page_count", "lang",
    )


@query(
    "x05_page_batches",
    """SELECT o_orderkey AS doc_id, CAST(b AS INTEGER) AS batch_no, CAST(b * 15 AS INTEGER) AS first_page, CAST(least(15, pages - b * 15) AS INTEGER) AS pages_in_batch
    FROM (SELECT o_orderkey, 1 + o_custkey % 70 AS pages, unnest(range(0, CAST(ceil((1 + o_custkey % 70) / 15.0) AS BIGINT))) AS b FROM orders)""",
)
def x05(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (1 + F.col("o_custkey") % 70).alias("page_count"))
    return routing.batch_ranges(docs).select("doc_id", "batch_no", "first_page", "pages_in_batch")


@query(
    "x06_cell_text",
    "SELECT doc_id, trim(substring(text, 1, 7) || substring(text, 11, 5)) AS cell, '' AS no_segments FROM documents",
)
def x06(spark, sf):
    segment = lambda a, b: F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return table(spark, sf, "documents").select(
        "doc_id", routing.cell_text(F.col("text"), F.array(segment(None, 7), segment(10, 15))).alias("cell"),
        routing.cell_text(F.col("text"), none).alias("no_segments"),
    )


@query(
    "x09_extraction_metadata",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 10) >= 5 THEN 'GOOD' WHEN (o_orderkey % 10) >= 3 THEN 'BORDERLINE' ELSE 'LOW' END AS band,
      CASE WHEN o_orderkey % 4 = 0 THEN 'legacy' ELSE 'p' || (o_orderkey % 4) END AS processor FROM orders""",
)
def x09(spark, sf):
    k = F.col("o_orderkey")
    meta = routing.extraction_metadata(
        (k % 10).cast("double") / 10, F.when(k % 3 == 0, F.lit("google_docai")).otherwise(F.lit("ocr_preprocessed")),
        F.when(k % 4 != 0, F.concat(F.lit("p"), (k % 4).cast("string"))), F.lit(None).cast("int"),
    )
    rows = table(spark, sf, "orders").select(k.alias("doc_id"), meta.alias("meta"))
    return rows.select("doc_id", F.get_json_object("meta", "$.quality_band").alias("band"), F.get_json_object("meta", "$.processor_name").alias("processor"))
