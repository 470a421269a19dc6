"""Extractor routing, candidate selection and page merging (X-01 ... X-06, X-09)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.quality import quality_band
from paperloom.functions.regex import contains_any, first_match, let, literal_array, strip
from paperloom.sources.files import base_name, extension


def route(doc_type: Column, path: Column) -> Column:
    """X-01: extractors in the order they should be tried."""
    suffix = extension(path)
    structured = (
        doc_type.isin(rules.STRUCTURED_DOC_TYPES)
        | contains_any(F.lower(base_name(path)), rules.STRUCTURED_FILENAME_HINTS)
        | suffix.isin(rules.IMAGE_EXTENSIONS)
    )
    return first_match(
        [(F.coalesce(structured, F.lit(False)), literal_array(rules.ROUTE_STRUCTURED)), (suffix == ".pdf", literal_array(rules.ROUTE_PDF))],
        literal_array(rules.ROUTE_DEFAULT),
    )


def best_candidate(candidates: DataFrame, documents: DataFrame, min_confidence: float = rules.EXTRACTOR_ACCEPT) -> DataFrame:
    """X-02: the first extractor with text and enough confidence, else the most confident, else a fall-through.

    ``candidates``: doc_id, processor, priority, raw_text, confidence. Only the winner's row is kept by
    the partial aggregate.
    """
    usable = candidates.filter(strip(F.coalesce(F.col("raw_text"), F.lit(""))) != "")
    row = F.struct("processor", "raw_text", "confidence")
    best = usable.groupBy("doc_id").agg(
        F.min_by(row, F.when(F.col("confidence") >= min_confidence, F.col("priority"))).alias("accepted"),
        F.max_by(row, F.struct(F.col("confidence"), -F.col("priority"))).alias("strongest"),
    )
    won = F.coalesce("accepted", "strongest")
    return documents.select("doc_id").join(best, "doc_id", "left").select(
        "doc_id",
        F.coalesce(won["processor"], F.lit("fallthrough")).alias("processor"),
        F.coalesce(won["raw_text"], F.lit("")).alias("raw_text"),
        F.coalesce(won["confidence"], F.lit(0.0)).alias("confidence"),
        first_match(
            [(F.col("accepted").isNotNull(), F.lit("accepted")), (won.isNotNull(), F.lit("best_effort"))], F.lit("all_failed")
        ).alias("outcome"),
    )


def quality_fallback(pairs: DataFrame) -> DataFrame:
    """X-03: keep, compare or replace the primary text by its quality band.

    ``pairs``: doc_id, primary_text, primary_score, alt_text, alt_score, is_image.
    """
    band = quality_band(F.col("primary_score"))
    has_alt = strip(F.coalesce(F.col("alt_text"), F.lit(""))) != ""
    use_alt = first_match(
        [
            (band == "GOOD", F.lit(False)),
            (band == "BORDERLINE", has_alt & (F.col("alt_score") > F.col("primary_score"))),
        ],
        has_alt & F.col("is_image"),
    )
    return pairs.withColumn("_alt", F.coalesce(use_alt, F.lit(False))).select(
        "doc_id",
        F.when(F.col("_alt"), F.col("alt_text")).otherwise(F.col("primary_text")).alias("raw_text"),
        F.when(F.col("_alt"), F.col("alt_score")).otherwise(F.col("primary_score")).alias("text_quality"),
        F.when(F.col("_alt"), F.lit("vision")).otherwise(F.lit("ocr_preprocessed")).alias("extraction_method"),
    )


def page_batch(page_no: Column) -> Column:
    """X-05: batch of a zero-based page."""
    return F.floor(page_no / rules.PAGES_PER_BATCH).cast("int")


def batch_ranges(documents: DataFrame, pages: str = "page_count") -> DataFrame:
    """X-05: one row per batch with its first page and page count."""
    size = rules.PAGES_PER_BATCH
    batches = F.greatest(F.ceil(F.col(pages) / size).cast("int"), F.lit(1))
    rows = documents.withColumn("batch_no", F.explode(F.sequence(F.lit(0), batches - 1)))
    first = F.col("batch_no") * size
    return rows.withColumns({"first_page": first, "pages_in_batch": F.least(F.lit(size), F.col(pages) - first).cast("int")})


def merge_batches(batches: DataFrame) -> DataFrame:
    """X-04: one result per document from its page batches.

    ``batches``: doc_id, batch_no, raw_text, tables (array), entities (map), page_confidences (array), page_count, lang.
    One aggregation: a document's batches are few and its text is one string by definition; of each entity the first value stays.
    """
    has_text = F.coalesce(F.col("raw_text"), F.lit("")) != ""
    real = F.filter(F.col("page_confidences"), lambda c: c.isNotNull() & (c != 0))
    merged = batches.withColumns({"_sum": F.aggregate(real, F.lit(0.0), lambda a, c: a + c), "_n": F.size(real)}).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("batch_no", F.when(has_text, F.col("raw_text")).alias("text"), "tables", F.map_entries("entities").alias("entries")))).alias("parts"),
        F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.sum("page_count").alias("page_count"),
        F.min_by("lang", F.when(F.coalesce(F.col("lang"), F.lit("")) != "", F.col("batch_no"))).alias("lang"),
    )
    filled = lambda e: (e["key"] != "") & (F.coalesce(e["value"], F.lit("")) != "")
    entries = F.filter(F.flatten(F.filter(F.col("parts.entries"), lambda x: x.isNotNull())), filled)

    def first_of_each(e: Column) -> Column:
        keys = F.array_sort(F.array_distinct(F.transform(e, lambda x: x["key"])))
        return F.when(F.size(e) > 0, F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(e, lambda x: x["key"] == k)[0]["value"])))

    return merged.select(
        "doc_id",
        F.array_join(F.col("parts.text"), "\n\n").alias("raw_text"),
        F.flatten(F.col("parts.tables")).alias("tables"),
        let(entries, first_of_each).alias("entities"),
        F.when(F.col("_n") > 0, F.col("_sum") / F.greatest(F.col("_n"), F.lit(1))).otherwise(F.lit(0.0)).alias("confidence"),
        "page_count", "lang",
    )


def cell_text(full_text: Column, segments: Column) -> Column:
    """X-06: the text a table cell points at; ``segments`` = array<struct<start,end>> of offsets."""
    parts = F.transform(
        segments, lambda s: F.substring(full_text, F.coalesce(s["start"], F.lit(0)) + 1, s["end"] - F.coalesce(s["start"], F.lit(0)))
    )
    return F.coalesce(strip(F.array_join(parts, "")), F.lit(""))


def extraction_metadata(quality: Column, method: Column, processor: Column, tables: Column) -> Column:
    """X-09: metadata kept beside the text; one method is always trusted."""
    band = F.when(method == rules.ALWAYS_GOOD_METHOD, F.lit("GOOD")).otherwise(quality_band(quality))
    return F.to_json(
        F.struct(
            quality.alias("text_quality_score"), method.alias("extraction_method"), band.alias("quality_band"),
            F.coalesce(processor, F.lit("legacy")).alias("processor_name"),
            F.coalesce(tables, F.lit(0)).alias("processor_tables_count"),
        )
    )
