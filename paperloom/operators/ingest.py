"""Duplicates, text intake, reprocessing and ingest status (I-06, I-08, I-13, I-14, I-18)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.regex import strip
from paperloom.operators.canonical import display_name
from paperloom.operators.skew import HOT_ROWS, lookup


def split_duplicates(incoming: DataFrame, catalog: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """I-06: add ``existing_id``, NULL for a new document, else the id the same uploader already has.

    Both inputs carry doc_id, uploaded_by, file_hash. Stored documents own their content; inside the batch
    the lowest id does. The owner is a partial aggregate, so a much-copied file never gathers in one task.
    An empty hash never counts as a copy.
    """
    key = ["uploaded_by", "file_hash"]
    pick = lambda df, rank: df.filter(F.col("file_hash") != "").select(*key, F.lit(rank).alias("rank"), "doc_id")
    owners = (
        pick(catalog, 0).unionByName(pick(incoming, 1)).groupBy(*key)
        .agg(F.min(F.struct("rank", "doc_id")).alias("owner"), F.count(F.lit(1)).alias("copies"))
        .select(*key, F.col("owner.rank").alias("owner_rank"), F.col("owner.doc_id").alias("owner_id"), "copies")
    )
    found = lookup(incoming, owners, key, "copies", "doc_id", hot_rows)
    own = F.col("owner_id").isNull() | ((F.col("owner_rank") == 1) & (F.col("owner_id") == F.col("doc_id")))
    return found.withColumn("existing_id", F.when(~own, F.col("owner_id"))).drop("owner_rank", "owner_id")


def new_documents(incoming: DataFrame, catalog: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """I-06: only what is to be stored."""
    return split_duplicates(incoming, catalog, hot_rows).filter(F.col("existing_id").isNull()).drop("existing_id")


def text_documents(texts: DataFrame, on_day: Column, category: Column | None = None) -> DataFrame:
    """I-08: free text + optional title -> document rows; blank texts are refused.

    The default name carries the day, and after classification the category.
    """
    day = F.date_format(on_day, "yyyy-MM-dd")
    word = F.lit("text") if category is None else category
    default = F.concat(word, F.lit("_"), day, F.lit(".txt"))
    return texts.filter(strip(F.coalesce(F.col("raw_text"), F.lit(""))) != "").withColumns(
        {
            "filename": F.coalesce(F.nullif(F.col("title"), F.lit("")), default),
            "source": F.lit("text_message"),
            "doc_type": F.lit("other") if category is None else category,
            "review_state": F.lit("pending"),
            "confidence": F.lit(0.0),
        }
    )


def reprocess_plan(documents: DataFrame, only: Column | None = None) -> DataFrame:
    """I-13 dry run: which documents would be rerun and which lack a file."""
    chosen = documents if only is None else documents.filter(only)
    has_file = F.coalesce(F.col("file_path"), F.lit("")) != ""
    return chosen.withColumn("plan", F.when(has_file, F.lit("reprocess")).otherwise(F.lit("skip_no_file")))


def replace_rows(table: DataFrame, rerun_ids: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """I-13: a document's old rows leave, whatever the rerun produced comes in."""
    return table.join(rerun_ids.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def backfill_display_names(documents: DataFrame) -> DataFrame:
    """I-14: fill only missing names; ``backfilled`` marks the rows that changed."""
    missing = F.col("display_name").isNull()
    name = display_name(F.col("doc_type"), F.col("vendor"), F.col("doc_date"))
    return documents.withColumns(
        {"backfilled": missing, "display_name": F.when(missing, name).otherwise(F.col("display_name"))}
    )


def backfill_counts(backfilled: DataFrame) -> DataFrame:
    """I-14: total / success / failed."""
    done = F.col("backfilled") & F.col("display_name").isNotNull()
    return backfilled.agg(
        F.count_if("backfilled").alias("total"), F.count_if(done).alias("success"),
        F.count_if(F.col("backfilled") & F.col("display_name").isNull()).alias("failed"),
    )


def ingest_status(batch: DataFrame, facts: DataFrame) -> DataFrame:
    """I-18: processed / duplicate / failed per document with the number of facts stored for it.

    ``batch`` carries doc_id, existing_id and failed (boolean).
    """
    counts = facts.groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    status = (
        F.when(F.col("failed"), F.lit("failed"))
        .when(F.col("existing_id").isNotNull(), F.lit("duplicate"))
        .otherwise(F.lit("processed"))
    )
    joined = batch.join(counts, "doc_id", "left")
    return joined.select(
        "doc_id", status.alias("status"), F.coalesce("existing_id", "doc_id").alias("document_id"),
        F.when(status == "processed", F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("facts_count"),
    )
