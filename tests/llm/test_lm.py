from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from paperloom.llm import lm
from tests.llm import brute


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens(text):
    return [*brute.words((text or "").translate(brute.LOWER)), None]


def check(rows, texts):
    learned = Counter(t for d, text in texts if d is not None and not held(d) for t in tokens(text))
    n, v = sum(learned.values()), len(learned)
    want = Counter()
    for d, text in texts:
        own = tokens(text)
        base = sum(math.log10((learned[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        want[(d, d is not None and held(d), len(own), sum(learned[t] > 0 for t in own), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_counts_base_score_and_gain_on_held_out_texts(spark, sf):
    rows = lm.query(spark, sf).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()])
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "The the THE x"), (3, "The the THE x"), (None, "unseen words the"), (5, "é ñ\x00 the " * 3000), (6, " \n\t ")]
    docs = spark.createDataFrame([(*t, "k") for t in texts], "doc_id long, text string, score string")
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    check(lm.score(docs.select("doc_id", "text"), fold != 0, fold == 0).collect(), texts)
    assert lm.score(docs.select("doc_id", "text").limit(0), fold != 0, fold == 0).count() == 0
    nothing = lm.score(docs.select("doc_id", "text"), F.lit(False), F.lit(True)).collect()
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in nothing)


def test_predictive_probabilities_sum_to_one():
    texts = pa.array(["the cat sat on the mat", "the dog sat", "a cat and a dog and the cat", "on and on the"])
    x = lm.encode_chunk(texts, np.array([True] * 4))
    word = np.repeat(np.arange(len(x["word"])), np.diff(x["places"]))
    n = len(x["word"])
    contexts = sorted(set(x["ending"].tolist()))
    # every word at every ending, so that unseen pairs are summed as well
    grid = [(w, e) for w in range(n) for e in contexts]
    seen = {(w, e): c for w, e, c in zip(word.tolist(), x["ending"].tolist(), x["counts"].tolist())}
    dishes = lm.Dishes(np.array([w for w, _ in grid]), np.array([e for _, e in grid]), np.array([seen.get(g, 0) for g in grid]), x["word"])
    base = 1 / (n + 1)
    c2 = np.bincount(dishes.ending, dishes.c2, lm.ENDINGS)
    at = lm.Totals((20.0, c2.reshape(256, 256).sum(1), c2), (10.0, c2.reshape(256, 256).sum(1) * 0.5, c2 * 0.5))
    for sweep in range(4):
        dishes.sweep(at, base, sweep)
        assert (dishes.t2 <= dishes.c2).all() and ((dishes.t2 > 0) == (dishes.c2 > 0)).all() and (dishes.t1 <= dishes.c1).all() and (dishes.t0 <= dishes.c0).all()
        by = lambda i, v, k: np.bincount(i, v, k)
        own = lm.Totals(
            (dishes.c0.sum(), by(dishes.byte, dishes.c1, 256), by(dishes.ending, dishes.c2, lm.ENDINGS)), (dishes.t0.sum(), by(dishes.byte, dishes.t1, 256), by(dishes.ending, dishes.t2, lm.ENDINGS))
        )
        p0, _, p2 = dishes.chances(own, base)
        s, d, c, t = lm.STRENGTH, lm.DISCOUNT, own.customers, own.tables
        unknown0 = (s[0] + d[0] * t[0]) / (s[0] + c[0]) * base
        assert abs(p0.sum() + unknown0 - 1) < 1e-9
        for e in contexts:
            b = e >> 8
            unknown = (s[2] + d[2] * t[2][e]) / (s[2] + c[2][e]) * (s[1] + d[1] * t[1][b]) / (s[1] + c[1][b]) * unknown0
            assert abs(p2[dishes.ending == e].sum() + unknown - 1) < 1e-9


def test_seating_follows_the_restaurant():
    """Mean tables of a dish against customers that sit down one by one."""
    rng, m = np.random.default_rng(0), 4000
    for c, parent, others in ((5, 0.3, 4), (40, 0.01, 300), (300, 0.2, 50)):
        keys = rng.integers(0, 2**64, m, dtype=np.uint64)
        got = lm.seat(np.full(m, c), np.full(m, parent), np.full(m, others), 0.7, 5.0, keys).mean()
        t = np.ones(m)
        for k in range(1, c):
            new = (5.0 + 0.7 * (others + t)) * parent
            t += rng.random(m) < new / (new + k - 0.7 * t)
        assert abs(got - t.mean()) < 0.04 * t.mean() + 0.05, (c, got, t.mean())


def test_binomial_draws():
    rng = np.random.default_rng(1)
    for n, p in ((1, 0.3), (7, 0.2), (50, 0.9), (400, 0.01), (5000, 0.4), (100_000, 0.00001)):
        got = lm.binomial(np.full(20000, n), np.full(20000, p), rng.integers(0, 2**64, 20000, dtype=np.uint64), 3)
        assert abs(got.mean() - n * p) < 5 * (n * p * (1 - p) / 20000) ** 0.5 and abs(got.var() / (n * p * (1 - p)) - 1) < 0.1


def test_previous_words_with_one_ending_are_told_apart(spark):
    """``cat`` and ``hat`` end alike; only the whole word says what follows. The parts that words are dealt over do not matter."""
    from pyspark.sql import functions as F

    texts = [(n, "cat sat hat fell") for n in range(40)] + [(100, "cat sat"), (101, "hat sat"), (102, "cat fell"), (103, "hat fell")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    learn, before, found = F.col("doc_id") < 100, spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("3", before):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found.append({r.doc_id: r.score for r in lm.score(docs, learn, ~learn).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    own = found[0]  # first and last tokens cancel out
    assert own[100] + own[103] > own[101] + own[102] + 1


def test_whole_word_contexts_sum_to_one():
    texts = pa.array(["the cat sat on the mat", "the bat sat", "a cat and a bat and the cat", "on and on the", "a cat sat"])
    x = lm.encode_chunk(texts, np.array([True] * 5))
    contexts, n = np.unique(x["context"]), len(x["word"])
    word = np.repeat(np.arange(n), np.diff(x["places"]))
    seen = {(w, u): c for w, u, c in zip(word.tolist(), x["context"].tolist(), x["counts"].tolist())}
    grid = [(w, i) for w in range(n) for i in range(len(contexts))]
    counts = np.array([seen.get((w, int(contexts[i])), 0) for w, i in grid])
    pairs, base = lm.Pairs(np.array([w for w, _ in grid]), np.array([i for _, i in grid]), counts, contexts, x["word"]), 1 / (n + 1)
    cut = lambda v: (v[lm.ENDINGS + 256], v[lm.ENDINGS : lm.ENDINGS + 256], v[: lm.ENDINGS])
    d, s = lm.DISCOUNT, lm.STRENGTH
    for sweep in range(4):
        at, (customers, tables) = lm.Totals(*map(cut, pairs.by_ending())), pairs.by_context()
        assert (pairs.t3 <= pairs.c3).all() and ((pairs.t3 > 0) == (pairs.c3 > 0)).all() and pairs.dishes.c2.sum() == pairs.t3.sum()
        chance = pairs.chances(at, customers, tables, base)
        for i, u in enumerate(contexts):
            e = int(u >> np.uint64(48))
            unknown = base * (s[3] + d[3] * tables[i]) / (s[3] + customers[i])
            for level, place in ((2, e), (1, e >> 8), (0, None)):
                c, t = (at.customers[level], at.tables[level]) if place is None else (at.customers[level][place], at.tables[level][place])
                unknown *= (s[level] + d[level] * t) / (s[level] + c)
            assert abs(chance[pairs.at == i].sum() + unknown - 1) < 1e-9
        pairs.sweep(at, tables, base, sweep)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for values in ([], [0], [0] * 5, [7, 300, 2], [2**64 - 1, 0, 5], rng.integers(0, 2**64, 1000, dtype=np.uint64), rng.integers(0, 90_000, 1000)):
        values = np.array(values, np.uint64)
        assert lm.unpack(lm.pack(values)).tolist() == values.tolist()
        assert lm.unpack_steps(lm.pack_steps(values)).tolist() == values.tolist()


def test_chunks_on_disk_hold_no_entries(spark, tmp_path):
    """A chunk's (previous word, word) entries are nearly as many as its tokens, and hashes do not compress: a token takes a few bytes without them."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in range(3000)]
    texts = [(i, " ".join(words[n] for n in rng.integers(0, 3000, 2000).tolist())) for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(1)
    lm.encode(docs, F.lit(True), F.lit(False)).write.parquet(f"{tmp_path}/chunks", compression="zstd")
    size = sum(f.stat().st_size for f in (tmp_path / "chunks").glob("*.parquet"))
    assert size < 3 * 50 * 2001


def test_passes_shuffle_totals_only_and_leave_no_table(spark, monkeypatch):
    """The parts' dishes are grouped where they lie: one side of a pass has no exchange by part, and its rows keep all pairs."""
    from pyspark.sql import functions as F

    plans, made = [], lm._kept_by_part

    def kept(merged, parts):
        seats, name = made(merged, parts)
        grouped = seats.groupBy("part").applyInArrow(lambda rows: rows.select(["part"]), "part int")
        plans.append(grouped._jdf.queryExecution().executedPlan().toString())
        rows = [lm._pairs(pa.table({c: pa.array([r[c]], pa.binary()) for c in ("keys", "contexts", "pairs", "customers")})) for r in seats.collect()]
        assert sum(int(x.c3.sum()) for x in rows) == 40 * 5 and sum(len(x.c3) for x in rows) == 6
        return seats, name

    monkeypatch.setattr(lm, "_kept_by_part", kept)
    docs = spark.createDataFrame([(n, "cat sat hat fell") for n in range(40)] + [(50, "fell")], "doc_id long, text string")
    assert lm.score(docs, F.col("doc_id") < 50, F.col("doc_id") >= 50).count() == 41
    assert len(plans) == 1 and "Exchange" not in plans[0]
    assert not spark.sql("SHOW TABLES LIKE 'lm_seats*'").collect()
