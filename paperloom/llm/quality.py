"""Quality rules with thresholds that adapt to each language and source.

Fixed rules (``base_failed``) come first. The others compare a document with its own (language, source) group: per
group and measure a mergeable quantile sketch gives the quartiles, and a document is rejected beyond the quartile plus
``REACH`` times the quartile distance (at least a floor, so that a uniform group does not reject small deviations).

The sketch is a log-linear histogram of a whole number: exact below 128, then 64 buckets per power of two, so a
quantile is off by less than 1/64. Sketches merge by adding counts, which Spark does before the shuffle; a hot source
sends one row per bucket and task. Groups below ``MIN_DOCS`` use the merged sketch of their language, then of all.

Null text: no words, fails the base rules. Null language or source: a group of its own. Repeated rows: each is judged.
Only the text, language and source columns are read; further columns, whatever their names, pass through unchanged.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.frames import append, documents, restore
from paperloom.session import cut_lineage

MIN_DOCS = 200
REACH = 4
LOWEST_WORDS = 50
# Measure: (its value from the counts, smallest quartile distance, whether too low counts as well)
MEASURES = {
    "word_length": ("100 * word_chars div n_words", 75, True),
    "symbols": ("1000 * n_symbols div n_words", 50, False),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 150, False),
    "repeats": ("1000 * n_repeat_words div n_words", 75, False),
}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _distinct_per_row(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=n)


def _measure(block: W.Block) -> dict[str, np.ndarray]:
    data, offsets, n_words = block.data, block.offsets, len(block.starts)
    inside = ~W.SEPARATOR[data]
    out = {
        "n_words": np.diff(block.word_offsets),
        "word_chars": W.row_sums(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": W.row_sums(_SYMBOL[data], offsets),
    }
    # lines: a row's start and what follows each line feed
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], feeds)), kind="stable")
    filled = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends = starts[filled], ends[filled]
    rows = np.searchsorted(offsets, starts, "right") - 1
    lines = np.bincount(rows, minlength=block.n)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - _distinct_per_row(rows, W.hash_spans(data, starts, ends), block.n)
    # words in 3-word windows that occur again in the text
    hashes = W.grams(W.hash_spans(data, block.starts, block.ends), 3)
    at = np.flatnonzero(W.in_row(block.word_offsets, 3, n_words))
    rows = block.word_rows()
    keys = W.mix(hashes[at] + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # one key for row and window
    order = np.argsort(keys)
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    out["n_repeat_words"] = W.row_sums(W.covered(at[again], 3, n_words), block.word_offsets)
    return out


def _compute(batch: pa.RecordBatch, at: int) -> dict:
    parts = [_measure(b) for b in W.blocks(batch.column(at))]
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) for k in parts[0]}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as c0, c1, ... with the counts, ``base_failed`` and the value of each measure (null without words)."""
    found = append(docs, _compute, COUNTS, text)
    failed = (F.col("n_words") < LOWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    values = {f"m_{k}": F.when(F.col("n_words") > 0, F.expr(v[0])) for k, v in MEASURES.items()}
    return found.withColumns({"base_failed": failed} | values)


def bucket(value: F.Column) -> F.Column:
    """The lowest number of the sketch's bucket that holds ``value``: its seven leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def limits(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """One row per (lang, source): ``low_*`` and ``high_*`` of each measure, from the sketches of unfailed documents."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"m_{k}").alias("value")) for k in MEASURES])
    good = measured.where(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(values))
    sketch = good.groupBy("lang", "source", "measure", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    sketch = cut_lineage(sketch, "quality-sketch")

    def quartiles(*keys: str) -> DataFrame:
        from pyspark.sql import Window

        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "measure")
        ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
        return ranked.groupBy(*keys, "measure").agg(at(1).alias("q1"), at(3).alias("q3"), F.first("total").alias("total"))

    fine, broad, whole = quartiles("lang", "source"), quartiles("lang"), quartiles()
    groups = measured.select(F.col(lang).alias("lang"), F.col(source).alias("source")).distinct()
    rows = groups.select("lang", "source", F.explode(F.array(*[F.lit(k) for k in MEASURES])).alias("measure"))
    f, b, w = fine.alias("f"), broad.alias("b"), whole.alias("w")
    same = lambda k, t: F.col(f"g.{k}").eqNullSafe(F.col(f"{t}.{k}"))
    joined = (
        rows.alias("g")
        .join(f, same("lang", "f") & same("source", "f") & same("measure", "f"), "left")
        .join(b, same("lang", "b") & same("measure", "b"), "left")
        .join(w, same("measure", "w"), "left")
    )
    enough = lambda t: F.col(f"{t}.total") >= MIN_DOCS
    pick = lambda q: F.when(enough("f"), F.col(f"f.{q}")).when(enough("b"), F.col(f"b.{q}")).otherwise(F.col(f"w.{q}"))
    chosen = joined.select("g.lang", "g.source", "g.measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    floor = F.lit(None).cast("long")
    for k, (_, least, _low) in MEASURES.items():
        floor = F.when(F.col("measure") == k, least).otherwise(floor)
    margin = REACH * F.greatest(F.col("q3") - F.col("q1"), floor)
    ends = chosen.withColumns({"low": F.col("q1") - margin, "high": F.col("q3") + margin})
    columns = []
    for k, (_, _least, low) in MEASURES.items():
        columns += [F.max(F.when(F.col("measure") == k, F.col("low"))).alias(f"low_{k}")] if low else []
        columns += [F.max(F.when(F.col("measure") == k, F.col("high"))).alias(f"high_{k}")]
    return cut_lineage(ends.groupBy("lang", "source").agg(*columns), "quality-limits")


def verdict(measured: DataFrame, bounds: DataFrame, lang: str, source: str) -> DataFrame:
    """``measured`` with ``kept``. The bounds are joined by Spark's own choice: broadcast only if their size allows it."""
    b = bounds.withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    joined = measured.join(b, F.col(lang).eqNullSafe(F.col("b_lang")) & F.col(source).eqNullSafe(F.col("b_source")), "left")
    fits = ~F.col("base_failed")
    for k, (_, _least, low) in MEASURES.items():
        fits &= F.coalesce(F.col(f"m_{k}") <= F.col(f"high_{k}"), F.lit(True))
        fits &= F.coalesce(F.col(f"m_{k}") >= F.col(f"low_{k}"), F.lit(True)) if low else F.lit(True)
    return joined.withColumn("kept", fits)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Every row of ``docs`` (columns c0, c1, ...) with its counts, ``base_failed`` and ``kept``.

    ``docs`` is read twice: for the sketches, and for the verdicts, which needs no copy of the texts.
    """
    at = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    narrow = docs.select(text, lang, source)
    bounds = limits(measure(narrow.toDF("text", "lang", "source")), "c1", "c2")
    return verdict(measure(docs, text), bounds, at[lang], at[source])


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    return restore(docs.columns, judge(docs).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    measured = cut_lineage(measure(docs).drop("c1"), "quality-counts")
    judged = verdict(measured, limits(measured, "c2", "c3"), "c2", "c3")
    return judged.select(
        F.col("c0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    value = lambda v: v.replace(" div ", " // ")
    measures = ", ".join(f"CASE WHEN n_words > 0 THEN {value(v[0])} END AS m_{k}" for k, v in MEASURES.items())
    melted = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, m_{k} AS v FROM s WHERE NOT base_failed" for k in MEASURES)

    def quartiles(keys: str) -> str:
        part = f"PARTITION BY {keys}measure"
        return f"""SELECT {keys}measure, min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q3,
          max(total) AS total FROM (SELECT {keys}measure, bucket, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS total
          FROM (SELECT {keys}measure, bucket, sum(n) AS n FROM k GROUP BY ALL)) GROUP BY ALL"""

    floor = " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in MEASURES.items())
    checks = []
    for k, v in MEASURES.items():
        of = lambda e, k=k: f"(SELECT {e} FROM p WHERE p.measure = '{k}' AND p.lang IS NOT DISTINCT FROM s.lang AND p.source IS NOT DISTINCT FROM s.source)"
        checks.append(f"coalesce(m_{k} <= {of('q3 + margin')}, true)")
        if v[2]:
            checks.append(f"coalesce(m_{k} >= {of('q1 - margin')}, true)")
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    g AS (SELECT *, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri FROM w),
    r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
      SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM (SELECT doc_id, unnest(tri) AS t, unnest(range(1, len(tri) + 1)) AS i FROM g)) WHERE c > 1)
      GROUP BY 1),
    c AS (SELECT g.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM g LEFT JOIN r ON g.doc_id = r.doc_id),
    s AS (SELECT *, n_words < {LOWEST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {measures} FROM c),
    k AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 7, 0)::BIGINT) << greatest(length(bin(v)) - 7, 0)::BIGINT AS bucket, count(*) AS n FROM ({melted}) GROUP BY ALL),
    f AS ({quartiles("lang, source, ")}), b AS ({quartiles("lang, ")}), a AS ({quartiles("")}),
    p AS (SELECT *, {REACH} * greatest(q3 - q1, CASE measure {floor} END) AS margin FROM (
      SELECT e.lang, e.source, e.measure, CASE WHEN f.total >= {MIN_DOCS} THEN f.q1 WHEN b.total >= {MIN_DOCS} THEN b.q1 ELSE a.q1 END AS q1,
        CASE WHEN f.total >= {MIN_DOCS} THEN f.q3 WHEN b.total >= {MIN_DOCS} THEN b.q3 ELSE a.q3 END AS q3
      FROM (SELECT DISTINCT lang, source, unnest({list(MEASURES)}) AS measure FROM s) e
      LEFT JOIN f ON e.lang IS NOT DISTINCT FROM f.lang AND e.source IS NOT DISTINCT FROM f.source AND e.measure = f.measure
      LEFT JOIN b ON e.lang IS NOT DISTINCT FROM b.lang AND e.measure = b.measure LEFT JOIN a ON e.measure = a.measure))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(checks)} AS kept FROM s"""


ORACLE = _oracle()
