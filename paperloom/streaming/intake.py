"""Message and document intake as streams (W-01, W-07)."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources import hash_index, versions
from paperloom.sources.messages import parse_messages


def accepted_messages(raw: DataFrame, body: str = "body") -> DataFrame:
    """W-01: parsed messages of a stream of JSON events, without the refused ones."""
    return parse_messages(raw, body).filter(F.col("reason").isNull()).drop("reason")


def run_key(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to; made on its first start, kept beside it from then on."""
    path = f"{checkpoint.rstrip('/')}-run"
    spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.mode("ignore").json(path)
    return spark.read.schema("run string").json(path).first()["run"]


def ingest_stream(stream: DataFrame, catalog_path: str, checkpoint: str, trigger: dict | None = None, buckets: int = 64, blocks: int = 4096):
    """W-07: append the documents that are neither in the catalog nor earlier in the stream; returns the started query.

    ``checkpoint`` names the run: starting again with it goes on where it stopped, another one is another run on the same
    catalog, also at the same time. Each micro-batch is one version of the catalog, marked with its run and number, so a
    batch that is run again after a failure counts once. The catalog's index, not stream state, remembers the hashes, so no
    watermark can forget a document; a batch reads only the index buckets of its own hashes. ``buckets`` and ``blocks``
    size a catalog that is made here; one that is there keeps its own.
    """
    spark = stream.sparkSession
    run = run_key(spark, checkpoint)
    hash_index.create_catalog(spark, catalog_path, stream.schema, buckets, blocks)

    def store(batch: DataFrame, batch_id: int) -> None:
        hash_index.add_documents(batch.sparkSession, catalog_path, batch, (run, batch_id))

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_catalog(spark: SparkSession, catalog_path: str) -> DataFrame:
    return versions.latest(spark, catalog_path).read("documents")
