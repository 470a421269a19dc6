"""From raw document texts to the catalog and its typed tables.

The whole way is row by row until the typed tables: facts stay in their document's row as an array, so there is no
shuffle before the final reports. One write in the middle keeps the regex work from being repeated for every table
that is built on it, and gives a place to resume from when executors are lost.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.quality import quality_score
from paperloom.operators import canonical as M
from paperloom.operators.classify import resolve_or_classify
from paperloom.operators.extract import (
    FACT, answer_items, better_payload, extraction_plan, fact_rows, merge_chunk_facts, payload_fact_array, payload_metadata, recipe_facts, regex_facts, salary_payload,
    single_answer_facts,
)
from paperloom.operators.routing import extraction_metadata
from paperloom.session import cut_lineage
from paperloom.sources.files import extension, text_expected


SLIP = "salary_slip"


def read_texts(documents: DataFrame, answer: str | None = None, slip_answers: tuple[str, str] | None = None) -> DataFrame:
    """Class, issuer, text quality, salary payload and facts of every text; written once.

    ``documents``: doc_id, uploaded_by, source, filename, raw_text, created_at (+ a model's class answer, + a model's two
    answers about salary slips). A slip's facts are those of its payload; all other texts have the pattern facts.
    """
    classed = resolve_or_classify(documents, answer)
    slip = F.col("category") == SLIP
    first, second = slip_answers or (None, None)
    reply = lambda c: salary_payload(F.when(slip, F.col(c)) if c else F.lit(None).cast("string"))
    chosen = better_payload(reply(first), reply(second))
    # a step of its own, so that the answers are parsed once
    read = classed.withColumn("_chosen", chosen).withColumns({"payload": F.col("_chosen.payload"), "payload_model": F.col("_chosen.model")}).drop("_chosen")
    facts = F.when(slip, payload_fact_array(F.col("payload"))).otherwise(regex_facts(F.when(~slip, F.col("raw_text"))))
    read = read.withColumns({"facts": facts, "text_quality": quality_score(F.col("raw_text"))})
    return cut_lineage(read, "texts", "zstd")


def add_model_facts(read: DataFrame, answers: DataFrame) -> DataFrame:
    """F-04 ... F-07 on top of ``read_texts``: what a model answered joins the facts that patterns found; written once.

    ``answers``: document_id, chunk_id, answer, to the questions of ``extraction_plan``. A document's mode decides how its
    answers are read: recipes; chunks, merged by confidence; or one list of facts. Keys that patterns found stay as they
    are, poor or blank texts and salary slips take no answers. ``answers_unread`` marks documents that should have facts from
    answers and have none.
    """
    found = F.transform("facts", lambda f: f["fact_key"])
    asked = read.filter(F.col("category") != SLIP).select("doc_id", F.col("category").alias("doc_type"), "raw_text", "text_quality", found.alias("found_keys"))
    modes = extraction_plan(asked).filter(F.col("chunk_id") == 0).select("doc_id", "mode").join(asked.select("doc_id", "doc_type", "found_keys"), "doc_id")
    given = answers.select(F.col("document_id").alias("doc_id"), "chunk_id", "answer").join(modes, "doc_id").withColumnRenamed("doc_id", "document_id")
    given = given.withColumn("fact_type", F.col("doc_type"))
    known = given.select("document_id", F.explode("found_keys").alias("fact_key")).distinct()
    items = lambda mode: answer_items(given.filter(F.col("mode") == mode))
    merged = merge_chunk_facts(items("chunked")).join(known, ["document_id", "fact_key"], "left_anti")
    recipes = recipe_facts(given.filter(F.col("mode") == "recipe").select("document_id", "answer"))
    columns = ["document_id", "fact_seq", "fact_key", "fact_value", "confidence", "source_excerpt"]
    rows = single_answer_facts(items("single"), known).select(*columns).unionByName(merged.select(*columns)).unionByName(recipes.select(*columns))
    gathered = F.array_sort(F.collect_list(F.struct("fact_seq", "fact_key", "fact_value", "confidence", "source_excerpt")))
    per_document = rows.groupBy(F.col("document_id").alias("doc_id")).agg(gathered.alias("_new"))
    wanted = given.filter(F.col("mode").isin("single", "chunked", "recipe")).select(F.col("document_id").alias("doc_id")).distinct().withColumn("_wanted", F.lit(True))
    joined = read.join(per_document, "doc_id", "left").join(wanted, "doc_id", "left")
    plain = F.transform("_new", lambda f: F.struct(f["fact_key"], f["fact_value"], f["confidence"], f["source_excerpt"])).cast(f"array<{FACT}>")
    facts = F.concat("facts", F.coalesce(plain, F.array().cast(f"array<{FACT}>")))
    out = joined.withColumns({"facts": facts, "answers_unread": F.coalesce("_wanted", F.lit(False)) & F.col("_new").isNull()}).drop("_new", "_wanted")
    return cut_lineage(out, "model-facts", "zstd")


def catalog_documents(read: DataFrame) -> DataFrame:
    """Promotion, name, review state and tags on top of ``read_texts``; how the text was read (X-09) and how the steps went (M-15).

    Optional columns of ``read``: processor, extraction_method, tables_count (of the extractor) and extraction_error.
    """
    optional = lambda name, kind: F.col(name) if name in read.columns else F.lit(None).cast(kind)
    metadata = extraction_metadata(F.col("text_quality"), optional("extraction_method", "string"), optional("processor", "string"), optional("tables_count", "int"))
    steps = {
        "text_extraction": optional("extraction_error", "string").isNotNull(), "classification": F.col("category").isNull(),
        "fact_extraction": optional("answers_unread", "boolean"),
    }
    read = read.withColumns({"processing_metadata": metadata, "outcome": M.outcome(steps)})
    none = lambda kind: F.lit(None).cast(kind)
    start = read.withColumns(
        {
            "doc_type": F.col("category"), "confidence": F.col("class_confidence"), "vendor": none("string"), "amount": none(M.MONEY),
            "currency": none("string"), "doc_date": none("date"), "ai_summary": none("string"),
        }
    )
    c, slip = F.col, F.col("doc_type") == SLIP
    general = M.review(c("confidence"), text_expected(extension(c("filename"))), c("raw_text"), F.size("facts"), c("ai_summary"))
    docs = M.promote_in_row(start, F.when(slip, M.no_facts()).otherwise(c("facts"))).withColumn("_r", general)
    docs = docs.withColumn("vendor", F.when(slip, M.employer_in_row(c("facts"))).otherwise(c("vendor")))
    vendor, day = M.names_in_row(c("doc_type"), c("vendor"), c("doc_date"), c("facts"))
    docs = docs.withColumns(
        {
            "display_name": M.display_name(c("doc_type"), vendor, day),
            "review_state": F.when(slip, M.salary_review_state(c("payload"))).otherwise(c("_r.review_state")),
            "failed_signals": F.when(slip, F.array().cast("array<string>")).otherwise(c("_r.failed_signals")), "issuer_metadata": c("issuer.metadata"),
            "extraction_metadata": payload_metadata(c("payload"), c("payload_model")),
        }
    )
    return docs.withColumn(
        "tags", M.auto_tags(F.lit(None).cast("array<string>"), c("doc_type"), c("vendor"), c("review_state"), c("doc_date"), c("filename"), F.array(c("doc_type")))
    ).drop("_r", "issuer", "category", "payload_model")


def build_library(
    documents: DataFrame, answer: str | None = None, slip_answers: tuple[str, str] | None = None, fact_answers: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The catalog, the fact table and the typed tables of a batch of texts.

    ``fact_answers``: a model's answers about facts (``add_model_facts``). Bills fill gaps of their own documents; only
    documents of bill types are joined for that.
    """
    read = read_texts(documents, answer, slip_answers)
    docs = catalog_documents(read if fact_answers is None else add_model_facts(read, fact_answers))
    is_bill = F.col("doc_type").isin("electricity_bill", "water_bill")
    billed = docs.filter(is_bill)
    bills = M.storable_bills(M.utility_bills(billed))
    slips = docs.filter(F.col("doc_type") == SLIP)
    return {
        "documents": docs.filter(~is_bill).unionByName(M.write_back_bills(billed, bills).select(*docs.columns)).drop("payload"),
        "document_facts": fact_rows(docs),
        "utility_bills": bills,
        "salary_slips": M.salary_slips(slips, None),
        "contracts": M.contracts(docs),
        "insurance_policies": M.insurance_policies(docs),
    }
