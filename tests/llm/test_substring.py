from __future__ import annotations

import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from paperloom.llm import substring
from tests.llm import brute
from tools.check import compare


def expected(rows, size=13):
    """[(words, kept words)] of (doc_id, text) rows."""
    first, out = {}, []
    for d, text in rows:
        w = brute.words(text)
        for i in range(len(w) - size + 1):
            if d is not None:
                t = tuple(w[i : i + size])
                first[t] = min(d, first.get(t, d))
    for d, text in rows:
        w = brute.words(text)
        gone = {i + k for i in range(len(w) - size + 1) if d is not None and first[tuple(w[i : i + size])] < d for k in range(size)}
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def made():
    rng = random.Random(6)
    passages = [[f"p{k}w{rng.randrange(50)}" for _ in range(rng.choice([12, 13, 14, 40, 90]))] for k in range(30)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, " ".join(passages[3])), (None, " ".join(passages[3] * 2)), (4, "few words"), (4, "few words"), (1000, "z " * 40_000)]
    for d in range(10, 150):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(30))]
        rows.append((d, rng.choice(["  ", "\n", " \r\n"]).join(parts) + rng.choice(["", " ", "\n"])))
    return rows + rows[20:24] + [(500 + i, t) for i, (_, t) in enumerate(rows[30:36])]


def test_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n_words int").repartition(3)
    want = expected(rows)
    got = {r.c2: r for r in substring.dedup(docs).collect()}
    assert len(got) == len(rows)
    for i, (n, kept) in enumerate(want):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, n - len(kept), " ".join(kept)), rows[i]
        w = brute.words(rows[i][1])
        gone = {k for a, b in r.removed for k in range(a, b)}
        assert [x for k, x in enumerate(w) if k not in gone] == kept and all(b - a >= 13 for a, b in r.removed)
    kept = substring.keep_rest(docs)
    assert kept.columns == docs.columns
    rest = {r.n_words: r.text for r in kept.collect()}
    for i, (n, own) in enumerate(want):
        if n and not own:
            assert i not in rest
        else:
            assert rest[i] == (rows[i][1] if len(own) == n else " ".join(own))
    assert substring.dedup(docs.limit(0)).count() == 0


def test_query_equals_brute_force_and_sql(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    df = substring.query(spark, sf)
    found = [tuple(r) for r in df.collect()]
    counts = {r[0]: r[1:3] for r in found}
    assert [counts[d] for d, _ in rows] == [(n, n - len(k)) for n, k in expected(rows)]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = duck.execute(substring.ORACLE)
    assert compare(found, df.columns, got.fetchall(), [c[0] for c in got.description]) is None


def test_an_index_block_of_copies_is_small():
    """Every window of two chunks occurs twice: a worker needs little memory for the block, and answers for the later chunk only."""
    n = substring.INDEX_BYTES // 12
    keys = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    table = pa.Table.from_batches([substring._entries(c, keys[0], keys[1], np.full(n, 10 * c), 1) for c in (1, 2)])
    tracemalloc.start()
    found = substring._index(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
    assert found["chunk"].to_pylist() == [2] and set(substring._joined(found, "least", np.int64).tolist()) == {10}
    assert np.array_equal(substring._joined(found, "keys", np.uint64), np.sort(keys[0]))
