from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paperloom.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, run=1):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, run + 1) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target, run=1):
    own = [(d, *features(t, run)) for d, t in docs]
    s, t = Counter(b for _, f, _ in own for b in f), Counter(b for x in target for b in features(x, run)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    rows = []
    for i, (d, f, n) in enumerate(own):
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(f), weight, score, None, n])
    able = sorted((r for r in rows if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for place, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    target = pq.read_table(f"{sf}/benchmark.parquet")["text"].to_pylist()
    assert rows_of(resample.query(spark, sf)) == brute(docs, target)


def odd_documents():
    rng = random.Random(7)
    words = ["alpha", "Beta", "γάμμα", "9", "x1y", "ÀÉ", "中文", "z{z", "q" * 300]
    docs = [(rng.choice([i, i, i, 5]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(None, None), (None, "a " * 40), (900, None), (901, ""), (902, "...---..."), (903, "w " * 30000)] + [(5, "same words here " * 10)] * 40
    return docs, ["alpha beta alpha", None, "", "中文 9 x1y", "A-B_C"]


@pytest.mark.parametrize("run", [1, 2])
def test_odd_rows(spark, run):
    docs, target = odd_documents()
    extra = [(d, t, d, "x", 1) for d, t in docs]
    got = resample.resample(
        spark.createDataFrame(extra, "doc_id long, text string, score long, rank string, row int"), spark.createDataFrame([(t,) for t in target], "text string"), run=run
    )
    found, right = rows_of(got), brute(docs, target, run)
    assert found == right
    drawn = sorted(r[4] for r in found if r[4] is not None)
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) > 20


def test_no_rows(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resample(docs, target).collect() == []
    few = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.rank for r in resample.resample(few, target).collect()] == [None, None]


def test_quickselect_finds_every_place(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), rng.randrange(-5, 5), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "a long, b long, c long").repartition(8).cache()
    ordered = sorted(rows)
    for k in (1, 2, 17, 999, 1500, 2000):
        assert resample.select_kth(frame, ["a", "b", "c"], k, pivots=5, seed=k) == ordered[k - 1]
    assert resample.select_kth(frame, ["a", "b", "c"], 0) is None and resample.select_kth(frame, ["a", "b", "c"], 2001) is None


def test_checksums():
    rng = random.Random(3)
    spans = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 9, 40, 500]))) for _ in range(400)]
    ends = np.cumsum([len(s) for s in spans])
    data = np.frombuffer(b"".join(spans), np.uint8)
    assert resample.crc32(data, np.append(0, ends[:-1]), ends).tolist() == [zlib.crc32(s) for s in spans]
    assert [x.tolist() for x in resample.buckets(pa.array([None, ""]))] == [[], [0, 0, 0], [0, 0]]
