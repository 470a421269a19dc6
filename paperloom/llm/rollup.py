"""Token counts kept up to date by signed deltas.

A store is a folder of committed batches. A batch of changes (inserts, deletes, revised counts of a document under a
tokenizer version) is turned into signed deltas against what the store says of the same documents, and written as two
tables: the documents' new entries and the batch's deltas, summed by (source, lang, tokenizer). Totals are the sum of all
deltas; they never reread documents. ``commit`` is idempotent by batch id: a batch counts from the moment its deltas
stand complete (Spark's _SUCCESS, written last); a committed batch is left alone, an unfinished one is written anew.
Batches count in the order of their ids, in whatever order they come: of a document that a batch with a greater id has
settled already, a late batch changes no total. Entries lie in buckets of documents, and a batch reads only its own ones.
``compact`` folds committed deltas into one table, which names the batches that it holds.

The last change of a document (by ``seq``; ties: the greater count, a delete last) within a batch wins. An insert of a
known document is a revision; a revision of an unknown one is an insert; a delete of an unknown one does nothing. A
change of source or language moves the count. Null doc_id, source, lang and tokenizer are values like any other; a null
count is 0. Only the columns named here are read.
"""
from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.frames import append, documents
from paperloom.llm.pieces import row_blocks
from paperloom.session import cut_lineage, shared_folder

TOKENIZER = "byte_bpe_50k.tiktoken"
VERSION = "byte_bpe_50k/1"
BLOCK = 4 << 20
BUCKETS = 64
KEYS = ("source", "lang", "tokenizer")
ENTRY = "doc_id long, tokenizer string, source string, lang string, n_tokens long, present boolean"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def load(path: str):
    def make():
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return W.once(("tiktoken", path), make)


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` as c0, c1, ... with ``n_tokens`` of the whole text (null text: 0)."""
    path = path or public_tokenizers.path(TOKENIZER)

    def compute(batch: pa.RecordBatch, at: int) -> dict:
        encode = load(path).encode_ordinary
        counts = [len(encode(t)) if t else 0 for part in row_blocks(batch.column(at), BLOCK) for t in part.to_pylist()]
        return {"n_tokens": np.array(counts, np.int64)}

    return append(docs, compute, "n_tokens long", text)


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(context._jsc.hadoopConfiguration()), path

    def committed(self) -> list[int]:
        """Ids of the batches whose deltas stand complete."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.folder}/deltas")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.folder}/deltas"))]
        return sorted(int(n[6:]) for n in names if fs.exists(path(f"{self.folder}/deltas/{n}/_SUCCESS")))

    def _tables(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}")  # folder names are columns
        return reader.parquet(*[f"{self.folder}/{kind}/batch={b}" for b in batches])

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """(doc_id, tokenizer, source, lang, n_tokens, present, batch): the newest entry of each document and tokenizer."""
        batches = [b for b in self.committed() if b >= 0]
        rows = self._tables("entries", f"{ENTRY}, bucket int, batch long", batches)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets)) if buckets else rows.limit(0)
        newest = rows.groupBy("doc_id", "tokenizer")
        return newest.agg(F.max_by(F.struct("source", "lang", "n_tokens", "present", "batch"), "batch").alias("e")).select("doc_id", "tokenizer", "e.*")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply (op, seq, doc_id, source, lang, tokenizer, n_tokens) once under the id ``batch``; whether it was new."""
        if batch < 0:
            raise ValueError("batch ids start at 0")
        if batch in self.committed():
            return False
        count = F.coalesce("n_tokens", F.lit(0))
        # present first: on a tie of seq the delete is last
        order = F.struct(F.col("seq"), F.col("op") == "delete", count, F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
        state = F.struct("source", "lang", count.alias("n_tokens"), (F.col("op") != "delete").alias("present"))
        last = changes.groupBy("doc_id", "tokenizer").agg(F.max_by(state, order).alias("e")).select("doc_id", "tokenizer", "e.*")
        fresh = last.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
        names = [n.split()[0] for n in ENTRY.split(", ")]
        fresh.select(*names, "bucket").hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/entries/batch={batch}")
        fresh = self._tables("entries", f"{ENTRY}, bucket int", [batch])
        own = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
        known = self.entries(own).withColumnsRenamed({c: f"old_{c}" for c in ("doc_id", "tokenizer", "source", "lang", "n_tokens", "present", "batch")})
        both = fresh.join(known, F.col("old_doc_id").eqNullSafe(F.col("doc_id")) & F.col("old_tokenizer").eqNullSafe(F.col("tokenizer")), "left")
        both = both.where(F.col("old_batch").isNull() | (F.col("old_batch") < batch))  # others are settled by a later batch
        signed = lambda there, sign, *columns: F.when(there, F.struct(*[F.col(c).alias(k) for c, k in zip(columns, KEYS)], F.lit(sign).alias("d"), (F.col(columns[3]) * sign).alias("t")))
        plus = signed(F.col("present"), 1, "source", "lang", "tokenizer", "n_tokens")
        minus = signed(F.col("old_present"), -1, "old_source", "old_lang", "old_tokenizer", "old_n_tokens")
        rows = both.select(F.explode(F.array_compact(F.array(plus, minus))).alias("s")).select("s.*")
        deltas = rows.groupBy(*KEYS).agg(F.sum("d").cast("long").alias("n_docs"), F.sum("t").cast("long").alias("n_tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        return True

    def _fold(self) -> tuple[int, set[int]]:
        """The newest fold (0: none) and the batches that it holds."""
        fold = min([0, *self.committed()])
        return fold, {r.held for r in self._tables("folded", "held long", [fold] if fold else []).collect()}

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of the documents present."""
        fold, held = self._fold()
        rows = self._tables("deltas", DELTA, ([fold] if fold else []) + [b for b in self.committed() if b >= 0 and b not in held])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Fold the deltas of all committed batches; later totals read the fold and the batches that it does not hold."""
        fold, held = self._fold()
        done = [b for b in self.committed() if b >= 0]
        if set(done) - held:
            folded = self.spark.createDataFrame([(b,) for b in done], "held long").coalesce(1)
            folded.write.mode("overwrite").parquet(f"{self.folder}/folded/batch={fold - 1}")
            self.totals().write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={fold - 1}")


def changes(docs: DataFrame, op: str, seq: int) -> DataFrame:
    return docs.select(F.lit(op).alias("op"), F.lit(seq).alias("seq"), "doc_id", "source", "lang", F.lit(VERSION).alias("tokenizer"), "n_tokens")


def without_repeated_lines(text: F.Column) -> F.Column:
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


def history(docs: DataFrame) -> list[tuple[int, DataFrame]]:
    """A corpus's life as batches: all documents come, exact copies of earlier ones go, texts with repeated lines are revised.

    The second and third batch are delivered twice, as after a failure.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    counted = count_tokens(docs.select("doc_id", "source", "lang", digest, "text")).select(
        F.col("c0").alias("doc_id"), F.col("c1").alias("source"), F.col("c2").alias("lang"), F.col("c3").alias("digest"), "n_tokens"
    )
    counted = cut_lineage(counted, "rollup-counts")
    # a table of its own, so that the join can split a text with very many copies
    first = cut_lineage(counted.groupBy("digest").agg(F.min("doc_id").alias("first")), "rollup-first")
    copies = cut_lineage(counted.join(first, "digest").where(F.col("doc_id") > F.col("first")).drop("first", "digest"), "rollup-copies")
    shorter = docs.select("doc_id", "source", "lang", without_repeated_lines(F.col("text")).alias("text"), F.length("text").alias("was")).where(F.length("text") < F.col("was"))
    revised = count_tokens(shorter.select("doc_id", "source", "lang", "text")).select(
        F.col("c0").alias("doc_id"), F.col("c1").alias("source"), F.col("c2").alias("lang"), "n_tokens"
    )
    revised = revised.join(copies.select("doc_id"), "doc_id", "left_anti")
    load, drop, revise = changes(counted, "insert", 0), changes(copies, "delete", 0), changes(revised, "revise", 0)
    return [(0, load), (1, drop), (1, drop), (2, revise), (2, revise)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals after the batches of ``history``."""
    store = Rollup(spark, shared_folder(spark, "rollup"))
    for batch, rows in history(documents(spark, sf_dir)):
        store.commit(batch, rows)
    return store.totals()
