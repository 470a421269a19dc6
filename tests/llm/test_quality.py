from __future__ import annotations

import duckdb
import pyarrow.parquet as pq

from paperloom.llm import quality
from tests.llm import brute
from tools.check import compare

TEXTS = [
    None, "", " \n\t", "a", "word " * 49, "word " * 60, "a b c d\na b c d\n\n \nx", " ".join(f"w{i}" for i in range(70)), "é ñ#$ " * 50 + "<>\r\n\x0b|",
    "one two three " * 2 + " ".join(f"v{i}" for i in range(60)), "x" * 300_000, "same line here\n" * 5 + " ".join(f"u{i}" for i in range(90)), "a b c" + " a b" * 3,
]


def test_counts_equal_brute_force(spark, sf):
    texts = TEXTS + [t * 2 if t else t for t in TEXTS] + pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.c0: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.measure(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute.quality(text), text


def test_thresholds_follow_the_group(spark):
    plain = [(i, " ".join(f"{'ab' * (2 + i % 2)}{i}x{k}" for k in range(60)), "en", "s1") for i in range(300)]
    long = [(1000 + i, " ".join(f"{'abcdefgh' * 4}{i}x{k}" for k in range(60)), "xx", "s2") for i in range(300)]
    odd = [(5000, long[0][1], "en", "s1"), (5001, " ".join(f"w{k}###" for k in range(60)), "en", "s1"), (5002, plain[0][1], None, None), (None, plain[1][1], "en", "s1")]
    docs = spark.createDataFrame([(*r, "mine") for r in plain + long + odd + odd[:1]], "doc_id long, text string, lang string, source string, kept string")
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5000 not in ids and 5001 not in ids
    assert {5002, None} <= set(ids) and len(ids) == 602 and set(kept.select("kept").distinct().toPandas()["kept"]) == {"mine"}
    assert quality.keep(docs.limit(0)).count() == 0


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df, got = quality.query(spark, sf), duck.execute(quality.ORACLE)
    assert compare([tuple(r) for r in df.collect()], df.columns, got.fetchall(), [c[0] for c in got.description]) is None
