"""Language identification with a string kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

Kernel: the blended spectrum of 2- to 4-grams of lower-cased words with their edges, by presence in the whole text:
k(x, z) = |x & z| / sqrt(|x| |z|), counted over the n-grams of the landmarks. Landmarks and training texts are bounded
samples of the labelled training documents, the ``LANDMARKS`` and ``TRAINING`` distinct texts of each language with the
least text hash. With K_mm between landmarks and k(x) from a text to them, phi(x) = k(x) K_mm^(-1/2) and ridge
regression of +-1 targets gives scores phi(x) B = k(x) A, one column per language. Every text of the table is scored: a
block's presence matrix times the landmark matrix times A.

Prediction uses the text only. Null text or one without a letter is ``und`` with score 0, as is everything if nothing
was learned. The score is the softmax of the winning column. Null doc_id: predicted, not held out, not learned from.
Empty and repeated rows, very long texts and further columns need nothing special.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.frames import append, documents
from paperloom.llm.packing import distinct_words
from paperloom.llm.pieces import row_blocks
from paperloom.session import cut_lineage

LANDMARKS = 32
TRAINING = 500
ORDERS = (2, 3, 4)
RIDGE = 1e-2
SHARPNESS = 4.0
BLOCK = 2 << 20
ROWS = 64
SALTS = 64
UNKNOWN = "und"


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word with an edge mark on both sides, and the index of the word of each."""
    text = "\x01" + "\x01".join(w.replace("\x01", "\x02") if "\x01" in w else w for w in words).lower() + "\x01"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = points == 1
    word = np.cumsum(edge) - 1
    codes, owner = [], []
    for n in ORDERS:
        k = len(points) - n + 1
        if k <= 0:
            continue
        whole = np.ones(k, bool)
        for i in range(1, n - 1):
            whole &= ~edge[i : i + k]
        code = np.full(k, n, np.uint64)
        for i in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + points[i : i + k]
        codes.append(W.mix(code[whole]))
        owner.append(word[:k][whole])
    return np.concatenate(codes), np.concatenate(owner)


def presence(texts: pa.Array, grams: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of rows: which of the sorted ``grams`` each text holds, as 0/1 floats."""
    for part in row_blocks(texts, BLOCK):
        words, codes, rows = distinct_words(part)
        if words:
            found, owner = word_grams(words)
            at = np.minimum(np.searchsorted(grams, found), max(0, len(grams) - 1))
            known = grams[at] == found if len(grams) else np.zeros(len(found), bool)
            at, owner = at[known], owner[known]
            order = np.argsort(owner, kind="stable")
            features, width = at[order], np.bincount(owner, minlength=len(words))
            start = np.cumsum(width) - width
        for a in range(0, len(part), ROWS):
            b = min(a + ROWS, len(part))
            block = np.zeros((b - a, len(grams)), np.float32)
            if words and rows[b] > rows[a]:
                lengths = np.diff(rows[a : b + 1])
                pairs = np.unique(np.repeat(np.arange(b - a), lengths) * np.int64(len(words)) + codes[rows[a] : rows[b]])
                row, code = np.divmod(pairs, len(words))
                own = width[code]
                shift = np.repeat(start[code] - (np.cumsum(own) - own), own)
                block[np.repeat(row, own), features[shift + np.arange(own.sum())]] = 1
            yield block


def kernel(texts: pa.Array, grams: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """k(x, z) of every text and landmark; ``landmarks``: a column per landmark, divided by the root of its size."""
    out = [np.zeros((0, landmarks.shape[1]), np.float32)]
    for block in presence(texts, grams):
        out.append((block @ landmarks) / np.sqrt(np.maximum(block.sum(1, keepdims=True), 1)))
    return np.concatenate(out)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; ASCII settles nearly all."""
    found = [np.zeros(0, bool)]
    for part in row_blocks(texts, BLOCK):
        data, offsets = W.flat(part)
        low = data | 32
        out = W.row_sums((low >= 97) & (low <= 122), offsets) > 0
        for i in np.flatnonzero(~out & (W.row_sums(data >= 128, offsets) > 0)).tolist():
            out[i] = any(c.isalpha() for c in part[i].as_py())
        found.append(out)
    return np.concatenate(found)


def _sample(labelled: DataFrame, each: int) -> DataFrame:
    """(lang, order, text): of each language, the ``each`` distinct texts of least hash. Only hashes are sorted."""
    hashes = labelled.select("lang", F.xxhash64("text").alias("h")).distinct()
    least = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    parts = hashes.withColumn("salt", F.pmod("h", F.lit(SALTS))).withColumn("order", least("lang", "salt")).where(F.col("order") <= each)
    first = parts.select("lang", "h", least("lang").alias("order")).where(F.col("order") <= each)  # of SALTS * each rows at most
    picked = cut_lineage(first, "langid-sample")
    rows = labelled.withColumn("h", F.xxhash64("text")).join(picked, ["lang", "h"])
    return rows.groupBy("lang", "h", "order").agg(F.first("text").alias("text")).select("lang", "order", "text")


def train(labelled: DataFrame, landmarks: int = LANDMARKS, training: int = TRAINING) -> dict | None:
    """The model from (text, lang) rows; None if no row has a language and a letter."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = cut_lineage(_sample(labelled, training), "langid-texts")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            letters = has_letter(batch.column("text"))
            sets = [np.unique(word_grams(w)[0]) if (w := distinct_words(pa.array([t]))[0]) else np.zeros(0, np.uint64) for t in batch.column("text").to_pylist()]
            out = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), out], names=["lang", "order", "grams"]).filter(pa.array(letters))

    rows = sample.where(F.col("order") <= landmarks).mapInArrow(gather, "lang string, order int, grams array<long>").collect()
    rows.sort(key=lambda r: (r["lang"], r["order"]))
    if not rows:
        return None
    sets = [np.array(r["grams"], np.int64).view(np.uint64) for r in rows]
    grams, seen = np.unique(np.concatenate(sets), return_counts=True)
    grams = grams[seen > 1] if (seen > 1).any() else grams
    marks = np.stack([np.isin(grams, s) for s in sets], axis=1).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(0), 1))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            k = kernel(batch.column("text"), grams, marks)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(k.astype(np.float64)), pa.list_(pa.float64()))], names=["lang", "k"])

    found = sample.mapInArrow(rate, "lang string, k array<double>").collect()
    names = sorted({r["lang"] for r in found})
    k = np.array([r["k"] for r in found])
    targets = np.where(np.array([r["lang"] for r in found])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    value, vector = np.linalg.eigh(marks.T.astype(np.float64) @ marks)
    root = (vector / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    phi = k @ root
    weights = np.linalg.solve(phi.T @ phi + RIDGE * len(k) / len(names) * np.eye(phi.shape[1]), phi.T @ targets)
    return {"grams": grams, "marks": marks, "weights": (root @ weights).astype(np.float32), "names": names}


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` as c0, c1, ... with ``lang_pred`` and ``score``."""
    if model is None:
        columns = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        return columns.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks and languages

    def compute(batch: pa.RecordBatch, at: int) -> dict:
        m, texts = shared.value, batch.column(at)
        score = (kernel(texts, m["grams"], m["marks"]) @ m["weights"]).astype(np.float64) * SHARPNESS
        best = score.argmax(1)
        top = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
        known = has_letter(texts)
        return {
            "lang_pred": pa.array([m["names"][b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], pa.string()),
            "score": np.where(known, top, 0.0),
        }

    return append(docs, compute, "lang_pred string, score double", text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs.where(~held_out).select("text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select(
        F.col("c0").alias("doc_id"), F.coalesce(F.crc32(F.col("c0").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
