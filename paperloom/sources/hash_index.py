"""A catalog of documents with an index of content hashes (I-06, W-07).

Three versioned tables: the documents, their (uploader, hash) keys, and Bloom filters over these keys. Keys and filters lie
in the bucket that the key hashes to. A filter is split into blocks of four 64-bit words; a key sets one bit in each half of
each word of one block, so filters are built by ``bit_or`` and probed by an equality join on (bucket, block). They take about
a fortieth of the room of the keys. A batch reads the filters of its own buckets; only keys that a filter lets through (stored
ones and about one in a hundred others) are looked up, and only in their own buckets' keys.

A commit fails if another writer added keys to one of the batch's buckets meanwhile; the batch is then judged again, so of
two writers that bring the same document one stores it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from paperloom.operators.ingest import split_duplicates
from paperloom.sources import versions
from paperloom.sources.versions import Change, Conflict, Version

KEY = ["uploaded_by", "file_hash"]
WORDS = [f"w{i}" for i in range(4)]
KEYS_SCHEMA = StructType([StructField("doc_id", LongType()), StructField("uploaded_by", LongType()), StructField("file_hash", StringType())])
FILTER_SCHEMA = StructType([StructField("bucket", IntegerType()), *[StructField(n, LongType()) for n in ("block", *WORDS)]])


def create_catalog(spark: SparkSession, root: str, schema: StructType, buckets: int = 64, blocks: int = 4096) -> Version:
    """An empty catalog of documents that have doc_id, uploaded_by, file_hash; ``blocks`` of 256 bits per bucket's filter.

    At 25 keys a block (``filter_load`` about 0.5) one key in a hundred passes by chance; ``grow_filters`` makes room.
    """
    tables = {"documents": (schema, ["doc_id"]), "hashes": (KEYS_SCHEMA, KEY), "filters": (FILTER_SCHEMA, ["=bucket"])}
    return versions.create(spark, root, tables, buckets, {"blocks": blocks})


def _places(version: Version, blocks: int) -> dict[str, Column]:
    """A key's bucket, its block, and the bits that it sets there."""
    bits = F.xxhash64(*KEY, F.lit(2))
    bit = lambda i: F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    words = {w: one(bit(2 * i)).bitwiseOR(one(bit(2 * i + 1) + 32)) for i, w in enumerate(WORDS)}
    return {"bucket": versions.bucket_of(KEY, version.buckets), "block": F.pmod(F.xxhash64(*KEY, F.lit(1)), F.lit(blocks)), **words}


def _distinct_keys(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("file_hash") != "").select(*[F.col(f.name).cast(f.dataType) for f in KEYS_SCHEMA if f.name in KEY]).distinct()


def _filter_rows(version: Version, keys: DataFrame, blocks: int) -> DataFrame:
    placed = keys.select(*[c.alias(n) for n, c in _places(version, blocks).items()])
    return placed.groupBy("bucket", "block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def possible_keys(version: Version, keys: DataFrame, buckets: set[int]) -> DataFrame:
    """The keys that the filters do not rule out; all stored ones are among them. ``buckets``: those of the keys."""
    blocks = version.properties["blocks"]
    filters = version.read("filters", buckets).groupBy("bucket", "block").agg(*[F.bit_or(w).alias(f"f{w}") for w in WORDS])
    placed = keys.withColumns(_places(version, blocks)).join(filters, ["bucket", "block"])
    for w in WORDS:
        placed = placed.filter(F.col(w).bitwiseAND(F.col(f"f{w}")) == F.col(w))
    return placed.select(*KEY)


def stored_keys(version: Version, keys: DataFrame, buckets: set[int]) -> DataFrame:
    """The index rows of the keys: only buckets that a filter points to are read."""
    possible = possible_keys(version, keys, buckets)
    return version.read("hashes", versions.touched(possible, KEY, version.buckets)).join(possible, KEY, "left_semi")


def judge(version: Version, batch: DataFrame) -> tuple[DataFrame, set[int]]:
    """I-06 against the index: the batch with ``existing_id``, and the buckets that decided it."""
    keys = _distinct_keys(batch)
    buckets = versions.touched(keys, KEY, version.buckets)
    return split_duplicates(batch, stored_keys(version, keys, buckets)), buckets


def index_changes(version: Version, fresh: DataFrame) -> list[Change]:
    """What new documents add to the index."""
    named = fresh.filter(F.col("file_hash") != "")
    return [Change("hashes", named), Change("filters", _filter_rows(version, _distinct_keys(named), version.properties["blocks"]))]


def add_documents(spark: SparkSession, root: str, batch: DataFrame, marker: tuple[str, int] | None = None, attempts: int = 10) -> Version:
    """Store the documents of a batch that neither the catalog nor an earlier row of the batch holds. ``marker``: see ``commit``."""
    batch = batch.persist()  # judged, indexed and written: recomputed where an executor is lost
    try:
        for attempt in range(attempts):
            version = versions.latest(spark, root)
            if marker and version.applied(marker):
                return version
            judged, buckets = judge(version, batch)
            fresh = judged.filter(F.col("existing_id").isNull()).drop("existing_id")
            try:
                return versions.commit(version, [Change("documents", fresh), *index_changes(version, fresh)], reads={"hashes": buckets, "filters": buckets}, marker=marker)
            except Conflict:
                if attempt + 1 == attempts:
                    raise
        raise AssertionError("unreachable")
    finally:
        batch.unpersist()


def filter_load(version: Version) -> float:
    """The share of set bits among all bits of the filters."""
    folded = version.read("filters").groupBy("bucket", "block").agg(*[F.bit_or(w).alias(w) for w in WORDS])
    bits = folded.agg(F.sum(sum(F.bit_count(w) for w in WORDS)).alias("n")).first()["n"] or 0
    return bits / (version.buckets * version.properties["blocks"] * 64 * len(WORDS))


def grow_filters(version: Version, blocks: int) -> Version:
    """Filters of another size, made anew from the keys; the small rows that batches left are folded with it."""
    rows = _filter_rows(version, version.read("hashes").select(*KEY).distinct(), blocks)
    everything = set(range(version.buckets))
    return versions.commit(version, [Change("filters", rows, everything)], reads={"hashes": everything}, properties={"blocks": blocks})
