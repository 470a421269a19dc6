"""The stored library: versioned tables, reprocessing (I-13) and the hash index (I-06, W-07)."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.plans import reprocess as R
from paperloom.plans.stream import library_stream
from paperloom.session import shared_folder
from paperloom.sources import hash_index as H
from paperloom.sources import versions
from paperloom.suite.intake import _DUPLICATES, _batch_and_catalog
from paperloom.suite.library import _FACTS, _READ, _STATE
from paperloom.suite.registry import query
from paperloom.suite.shapes import load, load_stream

# The first extraction of every third document read nothing; every eighth document has no file and cannot be read again.
_READ_AT = {
    "before": _READ.replace("doc_id % 11 <> 0", "(doc_id % 11 <> 0 AND doc_id % 3 <> 1)"),
    "after": _READ.replace("doc_id % 11 <> 0", "(doc_id % 11 <> 0 AND (doc_id % 3 <> 1 OR doc_id % 8 <> 0))"),
}


def _reprocessed(spark, sf):
    """A library whose unread documents are read again: the versions before and after, and the plan's rows."""
    docs = load(spark, sf, "documents").withColumn("file_path", F.when(F.col("doc_id") % 8 != 0, F.concat(F.lit("/store/"), F.col("filename"))))
    unread = F.col("doc_id") % 3 == 1
    first = docs.withColumn("raw_text", F.when(~unread, F.col("raw_text")).otherwise(F.lit(""))).select(*R.INPUT)
    root = shared_folder(spark, "library")
    before = R.store_documents(R.create_library(spark, root, first, buckets=16), first)
    after, plan = R.reprocess(spark, root, unread, docs.filter(unread).select("doc_id", "raw_text"))
    return before, after, plan


@query(
    "i13_reprocessed_documents",
    f"""WITH a AS ({_READ_AT['after']}), b AS ({_READ_AT['before']}),
    x AS (SELECT doc_id, category AS doc_type, CAST(CASE WHEN {_FACTS} THEN true_amount END AS DOUBLE) AS amount, CASE WHEN {_FACTS} THEN true_date END AS doc_date, {_STATE} AS review_state FROM a),
    y AS (SELECT doc_id, category AS type_before, {_STATE} AS state_before FROM b)
    SELECT *, CASE WHEN doc_id % 3 <> 1 THEN 'not chosen' WHEN doc_id % 8 = 0 THEN 'skip_no_file' ELSE 'reprocess' END AS plan FROM x JOIN y USING (doc_id)""",
    ("documents",),
)
def i13_documents(spark, sf):
    before, after, plan = _reprocessed(spark, sf)
    old = before.read("documents").select("doc_id", F.col("doc_type").alias("type_before"), F.col("review_state").alias("state_before"))
    new = after.read("documents").select("doc_id", "doc_type", F.col("amount").cast("double").alias("amount"), "doc_date", "review_state")
    return new.join(old, "doc_id").join(plan, "doc_id", "left").withColumn("plan", F.coalesce("plan", F.lit("not chosen")))


@query(
    "i13_reprocessed_facts",
    f"""WITH a AS ({_READ_AT['after']}) SELECT doc_id AS document_id, pos AS fact_seq, category AS fact_type, key AS fact_key,
      CASE key WHEN 'source_date' THEN strftime(true_date, '%d/%m/%Y') WHEN 'amount' THEN CAST(true_amount AS VARCHAR) ELSE 'ILS' END AS fact_value
    FROM (SELECT * FROM a WHERE {_FACTS}), (VALUES (0::BIGINT, 'source_date'), (1::BIGINT, 'amount'), (2::BIGINT, 'currency')) k(pos, key)""",
    ("documents",),
)
def i13_facts(spark, sf):
    return _reprocessed(spark, sf)[1].read("document_facts").select("document_id", "fact_seq", "fact_type", "fact_key", "fact_value")


@query(
    "i13_reprocessed_tables",
    f"""WITH a AS ({_READ_AT['after']}), b AS ({_READ_AT['before']}), t AS (
      SELECT 'documents' AS table_name, true AS old, count(*) AS n FROM b UNION ALL SELECT 'documents', false, count(*) FROM a
      UNION ALL SELECT 'document_facts', true, 3 * count(*) FROM b WHERE {_FACTS} UNION ALL SELECT 'document_facts', false, 3 * count(*) FROM a WHERE {_FACTS}
      UNION ALL SELECT 'utility_bills', true, 0 UNION ALL SELECT 'utility_bills', false, 0
      UNION ALL SELECT 'salary_slips', true, count(*) FROM b WHERE category = 'salary_slip' UNION ALL SELECT 'salary_slips', false, count(*) FROM a WHERE category = 'salary_slip'
      UNION ALL SELECT 'contracts', true, count(*) FROM b WHERE has_text AND category = 'contract' UNION ALL SELECT 'contracts', false, count(*) FROM a WHERE has_text AND category = 'contract'
      UNION ALL SELECT 'insurance_policies', true, count(*) FROM b WHERE has_text AND category = 'insurance' UNION ALL SELECT 'insurance_policies', false, count(*) FROM a WHERE has_text AND category = 'insurance')
    SELECT table_name, sum(n) FILTER (old)::BIGINT AS n_before, sum(n) FILTER (NOT old)::BIGINT AS n_after FROM t GROUP BY 1""",
    ("documents",),
)
def i13_tables(spark, sf):
    """All six tables by the two versions: the older one stays readable as it was."""
    before, after, _ = _reprocessed(spark, sf)
    count = lambda v, t, name: v.read(t).agg(F.count(F.lit(1)).alias(name)).withColumn("table_name", F.lit(t))
    rows = [count(before, t, "n_before").join(count(after, t, "n_after"), "table_name") for t in after.tables()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("table_name", "n_before", "n_after")


def _indexed(spark, sf):
    """A catalog of the stored documents, with its index, and the batch that comes in."""
    incoming, held = _batch_and_catalog(spark, sf)
    root = shared_folder(spark, "catalog")
    H.create_catalog(spark, root, held.schema, buckets=16, blocks=256)
    return H.add_documents(spark, root, held), incoming


@query(
    "i06_indexed_duplicates",
    f"""WITH {_DUPLICATES}, kept AS (SELECT * FROM owned WHERE NOT stored OR owner = doc_id)
    SELECT doc_id, CASE WHEN owner <> doc_id THEN owner END AS existing_id FROM kept WHERE NOT stored""",
)
def i06_indexed(spark, sf):
    version, incoming = _indexed(spark, sf)
    return H.judge(version, incoming)[0].select("doc_id", "existing_id")


@query(
    "i06_index_possible",
    """WITH d AS (SELECT DISTINCT doc_id % 3 AS uploaded_by, sha256(text) AS h, source IN ('src1', 'src2', 'src3') AS stored FROM documents)
    SELECT count(*) AS known, count(*) AS known_possible FROM (SELECT uploaded_by, h FROM d WHERE stored INTERSECT SELECT uploaded_by, h FROM d WHERE NOT stored)""",
)
def i06_possible(spark, sf):
    """No stored key is ruled out by the filters."""
    version, incoming = _indexed(spark, sf)
    keys = incoming.select(*H.KEY).distinct()
    known = keys.join(version.read("hashes"), H.KEY, "left_semi")
    possible = H.possible_keys(version, keys, versions.touched(keys, H.KEY, version.buckets))
    marked = known.select(*H.KEY).join(possible.withColumn("_possible", F.lit(True)), H.KEY, "left")
    return marked.agg(F.count(F.lit(1)).alias("known"), F.count("_possible").alias("known_possible"))


@query(
    "library_stream",
    f"""WITH r AS ({_READ}), k AS (SELECT *, min(doc_id) FILTER (NOT has_text) OVER (PARTITION BY uploaded_by) AS first_blank FROM r)
    SELECT doc_id, category AS doc_type, {_STATE} AS review_state, CASE WHEN {_FACTS} THEN 3 ELSE 0 END::BIGINT AS n_facts, 'complete' AS result FROM k WHERE has_text OR doc_id = first_blank""",
    ("documents",),
)
def library_stream_query(spark, sf):
    """The plan over a stream, in two runs on one library: blank texts are copies of each other, the second run brings nothing new."""
    docs = load_stream(spark, sf, "documents").withColumns({"file_path": F.lit(None).cast("string"), "file_hash": F.sha2("raw_text", 256)})
    docs = docs.select(*R.INPUT, "file_hash")
    root = shared_folder(spark, "library")
    for part in (docs, docs.filter(F.col("doc_id") % 20 == 0)):
        library_stream(part, root, shared_folder(spark, "ingest"), buckets=8, blocks=256).awaitTermination()
    library = versions.latest(spark, root)
    facts = library.read("document_facts").groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = library.read("documents").select("doc_id", "doc_type", "review_state", "outcome.result").join(facts, "doc_id", "left")
    return rows.select("doc_id", "doc_type", "review_state", F.coalesce("n", F.lit(0)).alias("n_facts"), "result")
