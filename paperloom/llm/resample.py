"""Importance resampling towards a target distribution, with an exact distributed quickselect.

Features are runs of ``RUN`` consecutive words, hashed into ``BUCKETS``. Two counts (all documents, all target texts) give
each bucket's gain, an array of fixed size; a document's weight is the floored mean of its features' gains, scored on
arrays. Noise from a hash of the doc_id turns the weights into scores whose highest are a sample without replacement.

The draw is the k highest composite keys (score, doc_id, n_features, row). No order of all documents is made: each round
takes random keys of the range that is left as pivots, counts exactly the rows before, at and after every pivot in one
pass, and goes on in the part that holds the k-th key, until that key is a pivot itself. Only the winners are then sorted
(by range, distributed) and ranked: place inside a range plus the sizes of the ranges before it.

Null text: no words. No features: weight 0. Fewer than ``LEAST`` words: scored, never drawn. A row without doc_id has no
hash: score and rank are null, and it does not count among the N. Ties go to the smaller doc_id; rows that share it to
fewer features, then by their place in the written table of scores (``row``), so repeated rows have one rank each. An
empty table gives no rows. Only doc_id and text are read; ``resample`` returns its own columns, so no names can clash.
"""
from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.frames import documents
from paperloom.llm.pieces import row_blocks
from paperloom.session import cut_lineage

BUCKETS = 10_000
RUN = 1
SHARE = 10  # per cent of the documents that count
LEAST = 20
SEED = 2024
PIVOTS = 16
BLOCK = 8 << 20

INSIDE = np.ones(256, bool)  # bytes of words once A-Z are lower-case: digits, letters, all of other alphabets
INSIDE[0x00:0x30] = INSIDE[0x3A:0x61] = INSIDE[0x7B:0x80] = False


def crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> np.uint32(1)) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


CRC = crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span, all spans one byte further at a time."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    base, sizes = starts[order], lengths[order]
    value = np.full(len(base), 0xFFFFFFFF, np.uint32)
    n, k = len(base), 0
    while n > 48:
        value[:n] = CRC[(value[:n] ^ data[base[:n] + k]) & np.uint32(255)] ^ (value[:n] >> np.uint32(8))
        k += 1
        n = int(np.searchsorted(-sizes, -k, "left"))
    out = np.empty(len(base), np.uint32)
    value ^= np.uint32(0xFFFFFFFF)
    for i in range(n):  # few long ones are left
        value[i] = zlib.crc32(data[base[i] : base[i] + sizes[i]].tobytes())
    out[order] = value
    return out


def buckets(texts: pa.Array, run: int = RUN, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, the texts' offsets among the features, and the texts' word counts."""
    data, offsets = W.flat(texts)
    data = W.LOWER[data]
    inside = INSIDE[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    # a word ends with its text, even if the next text begins inside a word
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut - 1] & inside[cut]] if len(cut) else cut
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    rows = np.searchsorted(starts, offsets)
    n_words = np.diff(rows)
    if run == 1:
        place = np.append(0, np.cumsum(ends - starts))
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data[inside].tobytes()))
        coded = found.dictionary_encode()
        distinct, spans = W.flat(coded.dictionary)
        return (crc32(distinct, spans[:-1], spans[1:]) % np.uint32(n_buckets)).astype(np.int64)[coded.indices.to_numpy()], rows, n_words
    # words joined by one blank; shorter runs first, each by its place in the text
    lengths = ends - starts
    place = np.append(0, np.cumsum(lengths + 1))
    joined = np.full(place[-1], 32, np.uint8)
    filled = np.ones(len(joined), bool)
    filled[place[1:] - 1] = False
    joined[filled] = data[inside]
    last = np.repeat(rows[1:], n_words)
    parts, owners = [], []
    for size in range(1, run + 1):
        first = np.flatnonzero(np.arange(len(starts)) + size <= last)
        parts.append(crc32(joined, place[first], place[first + size] - 1) % np.uint32(n_buckets))
        owners.append(np.searchsorted(rows, first, "right") - 1)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts).astype(np.int64)[order], np.append(0, np.cumsum(np.bincount(owner, minlength=len(n_words)))), n_words


def bucket_counts(texts: DataFrame, text: str = "text", run: int = RUN, n_buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: added up in every task, then over tasks; one array of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for part in row_blocks(batch.column(0), BLOCK):
                total += np.bincount(buckets(part, run, n_buckets)[0], minlength=n_buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    rows = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(n_buckets, np.int64)
    for r in rows:
        total[r.bucket] = r.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: a thousand times the log of its smoothed share in the target over that in the corpus, floored."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, run: int = RUN, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    values = W.share(docs.sparkSession, gain)

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        gain = values()
        for batch in batches:
            done = 0
            for part in row_blocks(batch.column("text"), BLOCK):
                found, rows, n_words = buckets(part, run, len(gain))
                n = np.diff(rows)
                weight = W.row_sums(gain[found], rows) // np.maximum(n, 1)
                ids = batch.column("doc_id").slice(done, len(part))
                done += len(part)
                score = [None if d is None else w + noise(d, seed) for d, w in zip(ids.to_pylist(), weight.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(n_words), pa.array(n), pa.array(weight), pa.array(score, pa.int64())],
                    names=["doc_id", "n_words", "n_features", "weight", "score"],
                )

    fields = "doc_id long, n_words long, n_features long, weight long, score long"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run_batches, fields)


def _literal(row: tuple):
    return F.struct(*[F.lit(x).cast("long").alias(f"k{i}") for i, x in enumerate(row)])


def select_kth(rows: DataFrame, key: list[str], k: int, pivots: int = PIVOTS, seed: int = 0) -> tuple | None:
    """The k-th smallest key (from 1) of rows whose ``key`` columns are longs, all different and not null.

    Each round collects a few random keys and one count per part between them, never a share of the rows.
    """
    total = rows.count()
    if not 1 <= k <= total:
        return None
    whole = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
    low = high = None
    chance, count = random.Random(seed), total
    while True:
        inside = rows
        if low is not None:  # the first column alone prunes row groups
            inside = inside.filter((F.col(key[0]) >= low[0]) & (whole > _literal(low)))
        if high is not None:
            inside = inside.filter((F.col(key[0]) <= high[0]) & (whole < _literal(high)))
        if count <= pivots:
            taken = sorted(tuple(r) for r in inside.select(*key).collect())
            return taken[k - 1]
        # a random sample of about `pivots` keys: rows whose hash under a fresh salt is small
        salt, modulus = chance.getrandbits(62), 1 << 40
        picked = F.pmod(F.xxhash64(*key, F.lit(salt)), F.lit(modulus)) < F.lit(max(1, modulus * pivots // count))
        marks = sorted(tuple(r) for r in inside.filter(picked).select(*key).collect())
        if not marks:
            continue
        part = sum((whole > _literal(m)).cast("int") + (whole >= _literal(m)).cast("int") for m in marks)
        sizes = {r.part: r.n for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        before = 0
        for p in range(2 * len(marks) + 1):
            here = sizes.get(p, 0)
            if k <= before + here:
                break
            before += here
        if p % 2:
            return marks[p // 2]
        k, count = k - before, here
        low, high = (marks[p // 2 - 1] if p else low), (marks[p // 2] if p // 2 < len(marks) else high)


def ranked(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``rows`` with their rank by ``key`` from 1: sorted by range, each range counted, places added up."""
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_id", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered, "resample-winners")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row per task
    start = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return ordered.withColumn("_part", part).join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + place + 1).drop("_part", "_start", "_id")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, run: int = RUN, n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    gain = gains(bucket_counts(docs, run=run, n_buckets=n_buckets), bucket_counts(target, run=run, n_buckets=n_buckets))
    table = scored(docs, gain, run, seed).withColumns({"order": -F.col("score"), "row": F.monotonically_increasing_id()})
    table = cut_lineage(table, "resample-scores")
    counts = (F.col("n_words") >= least) & F.col("score").isNotNull()
    key = ["order", "doc_id", "n_features", "row"]
    able = table.filter(counts)
    last = select_kth(able.select(*key), key, share * able.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return table.select(*columns, none)
    drawn = F.coalesce(counts & (F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)]) <= _literal(last)), F.lit(False))
    winners = ranked(table.filter(drawn).select(*columns, "order", "row"), key, "rank")
    return winners.select(*columns, "rank").unionAll(table.filter(~drawn).select(*columns, none))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = """
WITH RECURSIVE steps AS (
  SELECT n::BIGINT AS n, n::BIGINT AS v, 0 AS i FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM steps WHERE i < 8
), crc AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE i = 8),
texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
split AS (
  SELECT side, doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts
), words AS (SELECT side, r, unnest(w) AS word FROM split),
bytes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, crc
), counted AS (SELECT side, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY side, bucket),
gain AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (a.s + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (a.t + 10000)::DOUBLE))) AS g
  FROM (SELECT DISTINCT bucket FROM hashed) b
  CROSS JOIN (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted) a
  LEFT JOIN counted s ON s.side = 0 AND s.bucket = b.bucket LEFT JOIN counted t ON t.side = 1 AND t.bucket = b.bucket
), weighed AS (
  SELECT r, floor(sum(g) / count(*))::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::BIGINT), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (r) WHERE side = 0
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= floor(10 * (SELECT count(*) FROM scored WHERE n_features >= 20 AND score IS NOT NULL) / 100) THEN place END AS rank
FROM (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC NULLS LAST, doc_id, n_features) AS place FROM scored)
"""
