"""Near-duplicates by SimHash over word shingles, linked with BK-trees.

Fingerprint: texts are lower-cased (A-Z), cut into words, and each 3-word shingle (or the whole of a shorter text) votes
with the bits of its XXH64; no words give zero. Equal fingerprints are one node; nodes link within ``RADIUS`` bits.

Two numbers that differ in at most r bits agree on one of r + 1 bit blocks. So each distinct fingerprint goes to r + 1
shards, one per block and block value, and only shards with two or more members are searched. A shard of more than
``SHARD`` members is split by hash into parts; every part's BK-tree is sent to all other parts of the shard, so no task
holds more than two parts and no pair is lost. In a tree a child hangs below its parent under the integer Hamming
distance between them; a query at distance d follows the edges d - r ... d + r only. A search reports links as a forest
(a member and its group's first member), never as pairs, so a group of copies costs rows in proportion to its size.

Null text counts as empty. A null doc_id takes part but is never a component's name, except where there is no other
(then it is null). Repeated rows are answered one by one. Only doc_id and text are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.components import components
from paperloom.llm.frames import append, documents
from paperloom.session import cut_lineage

SEED = 42
SIZE = 3
RADIUS = 2
SHARD = 4096
VOTES = 1 << 16


def shingle_spans(block: W.Block, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The text with one space between words, and the byte spans and rows of all shingles in it."""
    inside = ~W.SEPARATOR[block.data]
    mask = inside.copy()
    ends = block.ends[block.ends < len(mask)]
    mask[ends] = True
    place = np.concatenate(([0], np.cumsum(mask)))
    joined = np.where(inside, block.data, np.uint8(32))[mask].tobytes()
    starts, ends = place[block.starts], place[block.ends]
    first, last = block.word_offsets[:-1], block.word_offsets[1:]
    long = np.flatnonzero(W.in_row(block.word_offsets, size, len(starts)))
    short = np.flatnonzero((last > first) & (last - first < size))
    rows = np.concatenate((block.word_rows()[long], short))
    begin = np.concatenate((starts[long], starts[first[short]]))
    end = np.concatenate((ends[long + size - 1], ends[last[short] - 1]))
    order = np.argsort(rows, kind="stable")
    return joined, begin[order], end[order], rows[order]


def simhash(block: W.Block, size: int = SIZE) -> np.ndarray:
    text, begin, end, rows = shingle_spans(block, size)
    digest = xxhash.xxh64_intdigest
    votes, totals = np.zeros((block.n, 64), np.int64), np.bincount(rows, minlength=block.n)
    for i in range(0, len(rows), VOTES):
        part = rows[i : i + VOTES]
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(begin[i : i + VOTES].tolist(), end[i : i + VOTES].tolist())], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        votes[part[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    set_bits = np.packbits(2 * votes > totals[:, None], axis=1, bitorder="little")
    return set_bits.view(np.int64).reshape(-1)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as c0, c1, ... with ``fingerprint`` (64 bits in a long)."""

    def compute(batch: pa.RecordBatch, at: int) -> dict:
        return {"fingerprint": np.concatenate([simhash(b) for b in W.blocks(batch.column(at), lower=True)])}

    return append(docs, compute, "fingerprint long", text)


def bk_tree(members: np.ndarray) -> np.ndarray:
    """child[node, distance]: the child of a node under an edge, or -1; node 0 is the root."""
    child = np.full((len(members), 65), -1, np.int32)
    values = [int(x) for x in members]
    below: list[dict[int, int]] = [{} for _ in values]
    for i in range(1, len(values)):
        at = 0
        while (nxt := below[at].get(d := (values[at] ^ values[i]).bit_count())) is not None:
            at = nxt
        below[at][d] = i
        child[at, d] = i
    return child


def search(members: np.ndarray, child: np.ndarray, queries: np.ndarray, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query index, member index) of all within the radius, by blocks of queries, level by level of the tree."""
    for i in range(0, len(queries), block):
        query = np.arange(i, min(i + block, len(queries)))
        node = np.zeros(len(query), np.int64)
        found_q, found_n = [], []
        while len(query):
            distance = np.bitwise_count(queries[query] ^ members[node]).astype(np.int64)
            near = distance <= radius
            found_q.append(query[near])
            found_n.append(node[near])
            next_q, next_n = [], []
            for edge in range(-radius, radius + 1):
                e = distance + edge
                ok = (e >= 1) & (e <= 64)
                below = child[node[ok], e[ok]]
                next_q.append(query[ok][below >= 0])
                next_n.append(below[below >= 0].astype(np.int64))
            query, node = np.concatenate(next_q), np.concatenate(next_n)
        yield np.concatenate(found_q), np.concatenate(found_n)


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i]; a label is the least index of its group."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(labels, high, low)
        while (nxt := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = nxt


def shard_links(tree: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between a tree's members and the queries, as (member, its group's first member)."""
    both = tree if tree is queries else np.concatenate((tree, queries))
    labels, shift = np.arange(len(both)), 0 if tree is queries else len(tree)
    for q, n in search(tree, bk_tree(tree), queries, radius):
        merge(labels, q + shift, n)
    moved = np.flatnonzero(labels != np.arange(len(both)))
    return both[moved].view(np.int64), both[labels[moved]].view(np.int64)


def _search_shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            a, b = [], []
            for tree, queries in zip(batch.column("tree"), batch.column("queries")):
                tree = tree.values.to_numpy().view(np.uint64)
                queries = queries.values.to_numpy().view(np.uint64) if queries.is_valid else tree
                x, y = shard_links(tree, queries, radius)
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): a forest over the values of ``fingerprint`` (distinct) that joins all within the radius of each other."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    values = [
        F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("fingerprint"), F.lit(64 - high)), F.lit(64 - high + low))
        for low, high in zip(cuts, cuts[1:])
    ]
    keys = distinct.select("fingerprint", F.posexplode(F.array(*values)).alias("block", "value"))
    sizes = cut_lineage(keys.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard), "shards")
    parts = keys.join(sizes, ["block", "value"], "left").select(
        "block", "value", "fingerprint", F.ceil(F.coalesce("n", F.lit(1)) / shard).alias("parts")
    )
    placed = parts.withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")))
    trees = placed.groupBy("block", "value", "part", "parts").agg(F.collect_list("fingerprint").alias("tree"))
    trees = cut_lineage(trees.where((F.size("tree") > 1) | (F.col("parts") > 1)), "trees")
    own = trees.select("tree", F.lit(None).cast("array<bigint>").alias("queries"))
    split = trees.where("parts > 1")
    other = split.select("block", "value", F.col("part").alias("other"), F.col("tree").alias("queries"))
    across = split.join(other, ["block", "value"]).where("part < other").select("tree", "queries")
    todo = own.union(across).repartition(distinct.sparkSession.sparkContext.defaultParallelism * 4)
    return todo.mapInArrow(_search_shards(radius), "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, component_id, root) from (doc_id, fingerprint): the least doc_id reachable from each fingerprint, and the group
    itself (unrelated groups can share a component_id if rows share a doc_id)."""
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(names, "root").select("fingerprint", "component_id", "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    found = fingerprints(docs.select("doc_id", "text"))
    prints = cut_lineage(found.select(F.col("c0").alias("doc_id"), "fingerprint"), "simhash")
    names = cut_lineage(groups(prints, radius), "components")
    return prints.join(names, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group: the one that names it. Rows without doc_id all stay.

    Of several texts of a group under that doc_id the one with the least fingerprint stays, of repeated rows one. Unrelated
    texts that share a doc_id are groups of their own, and each keeps its row.
    """
    digest = F.xxhash64("text")
    found = fingerprints(docs.select("doc_id", "text", digest.alias("digest")))
    prints = cut_lineage(found.select(F.col("c0").alias("doc_id"), F.col("c2").alias("digest"), "fingerprint"), "simhash")
    names = cut_lineage(groups(prints, radius), "components")
    namers = prints.join(names, "fingerprint").where("doc_id = component_id")
    first = namers.groupBy("root").agg(F.min(F.struct("fingerprint", "doc_id", "digest")).alias("f"))
    first = cut_lineage(first.select(F.col("f.doc_id").alias("first_id"), F.col("f.digest").alias("first_digest")).distinct(), "first")
    mark = "digest"
    while mark in docs.columns:
        mark += "_"
    kept = docs.join(first, (docs["doc_id"] == first["first_id"]) & (F.xxhash64(docs["text"]) == first["first_digest"]), "left_semi")
    kept = kept.withColumn(mark, digest).dropDuplicates(["doc_id", mark]).drop(mark)
    return kept.unionAll(docs.where(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
