"""The document plan as a stream: duplicates go, the plan runs, all tables and the hash index change in one version.

I-01/I-08 make the rows that come in, I-06 looks them up in the library's hash index, the plan builds its tables with metadata
(X-09) and outcome (M-15), and one commit marked with run and batch number adds them all.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.documents import build_library
from paperloom.plans.reprocess import Build, table_key
from paperloom.session import cut_lineage, drop_table, passing_tables
from paperloom.sources import hash_index, versions
from paperloom.sources.versions import Change, Conflict, Version
from paperloom.streaming.intake import run_key


def create_streamed_library(spark: SparkSession, root: str, like: DataFrame, build: Build = build_library, buckets: int = 64, blocks: int = 4096) -> Version:
    """An empty library with the tables that ``build`` makes of documents like ``like``, and a hash index over (uploader, file_hash)."""
    with passing_tables():
        tables = build(spark.createDataFrame([], like.schema))
    schemas = {n: (t.schema, table_key(n)) for n, t in tables.items()}
    index = {"hashes": (hash_index.KEYS_SCHEMA, hash_index.KEY), "filters": (hash_index.FILTER_SCHEMA, ["=bucket"])}
    return versions.create(spark, root, schemas | index, buckets, {"blocks": blocks})


def ingest_batch(spark: SparkSession, root: str, batch: DataFrame, marker: tuple[str, int] | None = None, build: Build = build_library, attempts: int = 10) -> Version:
    """Add a batch of documents to the library, without those that it holds or that come twice; all tables or none.

    If another writer stored hashes of the same buckets meanwhile, the batch is judged and built again. A batch that is run
    again after a failure, at whatever point, counts once: nothing that it wrote is seen before its commit.
    """
    for attempt in range(attempts):
        version = versions.latest(spark, root)
        if marker and version.applied(marker):
            return version
        judged, buckets = hash_index.judge(version, batch)
        fresh = cut_lineage(judged.filter(F.col("existing_id").isNull()).drop("existing_id"), "fresh-documents")
        try:
            with passing_tables():
                changes = [Change(n, t) for n, t in build(fresh).items()] + hash_index.index_changes(version, fresh)
                return versions.commit(version, changes, reads={"hashes": buckets, "filters": buckets}, marker=marker)
        except Conflict:
            if attempt + 1 == attempts:
                raise
        finally:
            drop_table(fresh)
    raise AssertionError("unreachable")


def library_stream(
    stream: DataFrame, root: str, checkpoint: str, build: Build = build_library, trigger: dict | None = None, buckets: int = 64, blocks: int = 4096
):
    """Run the plan over a stream of documents (doc_id, uploaded_by, file_hash and the plan's columns); the started query.

    ``checkpoint`` names the run, as in ``ingest_stream``; several runs may feed one library at the same time.
    """
    spark = stream.sparkSession
    run = run_key(spark, checkpoint)
    create_streamed_library(spark, root, stream, build, buckets, blocks)

    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch.sparkSession, root, batch, (run, batch_id), build)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
