"""The library as stored, versioned tables, and its reprocessing (I-13)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.ingest import reprocess_plan
from paperloom.plans.documents import build_library
from paperloom.session import passing_tables
from paperloom.sources import versions

INPUT = ["doc_id", "uploaded_by", "source", "filename", "file_path", "raw_text", "created_at"]
Build = Callable[[DataFrame], dict[str, DataFrame]]


def table_key(name: str) -> list[str]:
    return ["doc_id"] if name == "documents" else ["document_id"]


def create_library(spark: SparkSession, root: str, empty: DataFrame, build: Build = build_library, buckets: int = 64) -> versions.Version:
    """An empty library with the tables that ``build`` makes of documents like ``empty`` (its rows are not read)."""
    with passing_tables():
        tables = build(empty.limit(0))
    return versions.create(spark, root, {n: (t.schema, table_key(n)) for n, t in tables.items()}, buckets)


def store_documents(base: versions.Version, documents: DataFrame, build: Build = build_library, marker: tuple[str, int] | None = None) -> versions.Version:
    """Run the plan over new documents and add all its tables in one version. A ``marker`` that is in already: nothing runs.

    What the plan wrote on its way goes when the version stands.
    """
    if marker and base.applied(marker):
        return base
    with passing_tables():
        return versions.commit(base, [versions.Change(n, t) for n, t in build(documents).items()], marker=marker)


def reprocess(
    spark: SparkSession, root: str, only: Column | None = None, texts: DataFrame | None = None, build: Build = build_library, attempts: int = 5
) -> tuple[versions.Version, DataFrame]:
    """I-13: rerun the plan over the chosen stored documents and replace all that they left in any table, in one version.

    ``only`` chooses among stored documents (all by default); those without a file stay as they are. ``texts`` (doc_id,
    raw_text, ...) are what a new extraction read; a chosen document without a row there is rerun on its stored text, and
    further columns (a model's answers) go to the plan. Readers see the old library until all tables are written, and the
    old one stays if the job dies before. If another writer changed the same buckets meanwhile, the work is done again on
    the newer version. Returns the version and the plan's rows: doc_id, plan (reprocess or skip_no_file).
    """
    for attempt in range(attempts):
        base = versions.latest(spark, root)
        plan = reprocess_plan(base.read("documents"), only)
        rerun = plan.filter(F.col("plan") == "reprocess").select(*INPUT)
        if texts is not None:
            read = texts.withColumnRenamed("raw_text", "_read").withColumn("_found", F.lit(True))
            joined = rerun.join(read, "doc_id", "left")
            rerun = joined.withColumn("raw_text", F.when(F.col("_found"), F.col("_read")).otherwise(F.col("raw_text"))).drop("_read", "_found")
        try:
            with passing_tables():
                after = versions.replace_keys(base, rerun, "doc_id", build(rerun))
            return after, plan.select("doc_id", "plan")
        except versions.Conflict:
            if attempt + 1 == attempts:
                raise
    raise AssertionError("unreachable")
