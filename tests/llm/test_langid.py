from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from paperloom.llm import langid


def grams(text):
    out = set()
    for w in text.lower().split():
        w = f"\x01{w}\x01"
        out |= {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1) if "\x01" not in w[i + 1 : i + n - 1]}
    return out


def test_kernel_is_the_presence_kernel():
    texts = ["the cat sat", "the dog", "Ünï the", "", None, "cat cat cat"]
    sets = [grams(t or "") for t in texts]
    code = lambda s: np.unique(langid.word_grams(s.split())[0])
    for t, s in zip(texts, sets):
        if t:
            assert len(code(t)) == len(s)
    known = np.unique(np.concatenate([code(texts[0]), code(texts[1])]))
    vocabulary = sets[0] | sets[1]
    marks = np.stack([np.isin(known, code(texts[0])), np.isin(known, code(texts[1]))], axis=1).astype(np.float32)
    marks /= np.sqrt(marks.sum(0))
    got = langid.kernel(pa.array(texts), known, marks)
    for i, s in enumerate(sets):
        own = s & vocabulary
        for j in (0, 1):
            assert abs(got[i, j] - (len(own & sets[j]) / (len(own) * len(sets[j])) ** 0.5 if own else 0)) < 1e-5


def test_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = langid.query(spark, sf).collect()
    assert len(got) == len(truth)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == truth[r.doc_id]["lang"])
    assert np.mean(right) > 0.9


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 456 !!", "en"), (None, "hello the world of the words", None), (5, "the cat and the dog of the house", "en"),
            (6, "der hund und die katze im haus", "de"), (6, "der hund und die katze im haus", "de"), (7, "the " * 200_000, "en"), (8, "日本語", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.train(docs.select("text", "lang"))
    got = [(r.c0, r.lang_pred, r.score) for r in langid.predict(docs, model).collect()]
    assert len(got) == len(rows)
    named = dict((a, b) for a, b, _ in got)
    assert named[1] == named[2] == named[3] == "und" and named[5] == named[7] == "en" and named[6] == "de" and named[8] in ("de", "en") and named[None] == "en"
    assert all(0 <= s <= 1 for _, _, s in got)
    nothing = langid.train(docs.limit(0).select("text", "lang"))
    assert nothing is None and {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
