from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.session import shared_folder
from paperloom.sources import hash_index as H
from paperloom.sources import versions as V
from paperloom.streaming import intake

SCHEMA = "doc_id bigint, uploaded_by bigint, file_hash string, note string"


def catalog(spark, buckets=16, blocks=64):
    root = shared_folder(spark, "catalog")
    H.create_catalog(spark, root, StructType.fromDDL(SCHEMA), buckets, blocks)
    return root


def rows(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def stored(spark, root):
    return sorted(r["doc_id"] for r in V.latest(spark, root).read("documents").collect())


def test_batches_against_the_index(spark):
    root = catalog(spark)
    H.add_documents(spark, root, rows(spark, [(1, 1, "a", "x"), (2, 1, "a", None), (3, 2, "a", None), (4, 1, "", None), (5, 1, None, None), (6, None, "a", None)]))
    assert stored(spark, root) == [1, 3, 4, 5, 6]
    H.add_documents(spark, root, rows(spark, [(7, 1, "a", None), (8, 1, "", None), (9, 2, "b", None), (10, 2, "b", None)]), ("run", 0))
    assert stored(spark, root) == [1, 3, 4, 5, 6, 8, 9]
    H.add_documents(spark, root, rows(spark, [(77, 9, "zz", None)]), ("run", 0))  # the same batch once more
    assert stored(spark, root) == [1, 3, 4, 5, 6, 8, 9]
    H.add_documents(spark, root, rows(spark, []))
    judged, _ = H.judge(V.latest(spark, root), rows(spark, [(20, 1, "a", None), (21, 2, "a", None), (22, 3, "a", None)]))
    assert {r["doc_id"]: r["existing_id"] for r in judged.collect()} == {20: 1, 21: 3, 22: None}


def test_only_own_buckets_are_read_and_filters_miss_nothing(spark):
    root = catalog(spark, buckets=32, blocks=64)
    known = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("uploaded_by"), F.sha2(F.col("id").cast("string"), 256).alias("file_hash"), F.lit("").alias("note"))
    version = H.add_documents(spark, root, known)
    everything = set(range(32))
    keys = known.select(*H.KEY)
    assert H.possible_keys(version, keys, everything).count() == 20_000
    other = spark.range(20_000).select((F.col("id") % 5).alias("uploaded_by"), F.sha2(F.concat(F.lit("n"), F.col("id").cast("string")), 256).alias("file_hash"))
    assert H.possible_keys(version, other, everything).count() < 20_000 * 0.03
    # a small batch: its filters and hashes come from its own buckets' folders only
    few = known.limit(0).unionByName(known.filter("doc_id in (11, 4711)")).select(*H.KEY)
    buckets = V.touched(few, H.KEY, 32)
    found = H.stored_keys(version, few, buckets)
    assert {r["doc_id"] for r in found.collect()} == {11, 4711}
    read = {f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert read == {str(b) for b in buckets} and len(buckets) <= 2
    before = H.filter_load(version)
    grown = H.grow_filters(version, 256)
    assert H.filter_load(grown) < before / 2
    assert H.possible_keys(grown, keys, everything).count() == 20_000 and H.possible_keys(grown, other, everything).count() < 100
    assert H.add_documents(spark, root, known.limit(300)).read("documents").count() == 20_000


def test_a_second_writer_between_reading_and_writing(spark, monkeypatch):
    """The other run stores the same document after this one has looked it up: only one copy stays."""
    root, real, done = catalog(spark), V.commit, []

    def late(base, *args, **kwargs):
        if not done:
            done.append(True)
            H.add_documents(spark, root, rows(spark, [(50, 1, "a", "other run")]), ("other", 0))
        return real(base, *args, **kwargs)

    monkeypatch.setattr(V, "commit", late)
    H.add_documents(spark, root, rows(spark, [(1, 1, "a", None), (2, 1, "b", None)]), ("one", 0))
    assert stored(spark, root) == [2, 50]


def test_two_streams_side_by_side(spark):
    """Two runs over the same contents at the same time keep one copy of each."""
    root, folders = shared_folder(spark, "catalog"), []
    for run in range(2):
        folder = shared_folder(spark, "files")
        folders.append(folder)
        for part in range(2):
            rows(spark, [(1000 * run + i, i % 3, f"h{i % 40}", None) for i in range(60 * part, 60 * part + 60)]).coalesce(1).write.mode("append").parquet(folder)
    read = lambda at: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)
    H.create_catalog(spark, root, StructType.fromDDL(SCHEMA), 4, 64)
    start = lambda at: intake.ingest_stream(read(at), root, shared_folder(spark, "ingest")).awaitTermination()
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(start, folders))
    kept = V.latest(spark, root).read("documents")
    assert kept.count() == kept.select(*H.KEY).distinct().count() == 120
    assert V.latest(spark, root).manifest["applied"].keys() and len(V.latest(spark, root).manifest["applied"]) == 2


@pytest.mark.parametrize("hash_value", ["same"])
def test_one_content_in_most_rows(spark, hash_value):
    root = catalog(spark)
    many = spark.range(50_000).select("id", F.lit(1).cast("long").alias("u"), F.when(F.col("id") % 3 != 0, F.lit(hash_value)).otherwise(F.col("id").cast("string")).alias("h"), F.lit("").alias("n"))
    version = H.add_documents(spark, root, many.toDF("doc_id", "uploaded_by", "file_hash", "note"))
    assert version.read("documents").count() == 16_667 + 1
