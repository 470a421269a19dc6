from __future__ import annotations

import hashlib
import random

import pyarrow.parquet as pq

from paperloom.llm import fingerprint


def check(rows, texts):
    """rows against (doc_id, text) in a list; repeated rows by count."""
    order = sorted(((d, t or "") for d, t in texts), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(rows) == len(texts)
    unique = len({d for d, _ in texts}) == len(texts)
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    by_text = {}
    for i, (d, text) in enumerate(order):
        r = next(x for x in found[d] if x.n_chars == len(text))
        by_text.setdefault(text, set()).add(r.fingerprint)
        if unique:
            following = order[(i + 1) % len(order)]
            k = len(text) // 3
            edited = text[: len(text) - k] + following[1][:k]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            other = found[following[0]][0]
            like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
            assert r.near_edited == like(r.fingerprint, r.edited_fingerprint) and r.near_next == like(r.fingerprint, other.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_query(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    rows = fingerprint.query(spark, sf).collect()
    check(rows, texts)
    prints = {int(r.fingerprint, 16) for r in rows}
    for r in rows:
        own = int(r.fingerprint, 16)
        assert r.n_near == (sum(0 < (own ^ x).bit_count() <= 3 for x in prints) if r.doc_id % 20 == 0 else None)
    gain = [r.near_edited - r.near_next for r in rows]
    assert sum(g > 0 for g in gain) > 0.8 * len(gain)


def hexed(df):
    from pyspark.sql import functions as F

    spelt = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0").alias(c)
    return df.withColumns({c: spelt(c) for c in ("fingerprint", "edited_fingerprint")}).collect()


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, " \t "), (40, "é 🙂 one"), (5, "one two three four " * 20_000), (6, "ab"), (7, "abc"), (-8, "same words here again"), (9, "same words here again"), (None, "last of all")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, fingerprint int")
    rows = hexed(fingerprint.compared(docs.select("doc_id", "text")))
    check(rows, texts)
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {"0" * 16}
    repeated = texts + texts[3:6]
    check(hexed(fingerprint.compared(spark.createDataFrame(repeated, "doc_id long, text string"))), repeated)
    assert fingerprint.compared(docs.select("doc_id", "text").limit(0)).count() == 0
    one = hexed(fingerprint.compared(spark.createDataFrame(texts[3:4], "doc_id long, text string")))
    check(one, texts[3:4])


def test_tables_find_all_within_the_radius(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base:
        for n in (1, 2, 3, 4, 5):
            for _ in range(4):
                values.add(b ^ sum(1 << k for k in rng.sample(range(64), n)))
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    want = {s: sum(0 < (v ^ x).bit_count() <= 3 for x in values) for s, v in signed.items()}
    for pack in (1024, 3):
        got = {r.fingerprint: r.n_near for r in fingerprint.count_near(frame, frame, pack=pack).collect()}
        assert got == want


def test_signed_votes(spark):
    text = "alpha beta gamma delta epsilon zeta"
    from pyspark.sql import functions as F

    w = text.split()
    runs = [(w[i], w[i + 1], w[i + 2]) for i in range(4)]
    hashes = [r.h for r in spark.createDataFrame(runs, "a string, b string, c string").select(F.xxhash64("a", "b", "c").alias("h")).collect()]
    weights = [sum(map(len, r)) for r in runs]
    want = sum(1 << k for k in range(64) if sum(n if h >> k & 1 else -n for h, n in zip(hashes, weights)) > 0)
    got = fingerprint.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().fingerprint
    assert got & (2**64 - 1) == want
