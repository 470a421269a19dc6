from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from paperloom.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)


def check(rows, texts, capacity):
    """rows: (doc_id, piece, start, length, crc, sequence, offset); texts by doc_id."""
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[(doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(r[:5] for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r[3] for r in rows) // capacity)


def test_query(spark, sf):
    rows = [tuple(r) for r in packing.query(spark, sf).collect()]
    texts = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    used, least = check(rows, texts, 4096)
    assert used <= least * 1.01 + 1


def test_odd_texts_and_repeated_rows(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "A b\x0bc  d\r\n"), (5, "İstanbul ΣΑΣ é ́x don't we'll"), (6, "<|endoftext|>a <|startoftext|>"), (7, "word " * 9000), (8, "x y　z" * 30)]
    docs = spark.createDataFrame([(*t, "p") for t in texts], "doc_id long, text string, piece string")
    rows = [tuple(r) for r in packing.packed(docs, capacity=64).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    check(rows, texts, 64)
    assert packing.packed(docs.limit(0)).count() == 0
    whole = {(r.doc_id, r.piece): r for r in packing.packed(docs, with_ids=True).collect()}
    assert list(whole[(6, 0)].ids) == [*Tokenizer.from_file(PATH).encode(texts[5][1], add_special_tokens=False).ids, 1]


def test_plan_is_close_to_the_bound():
    rng = random.Random(2)
    for lengths in (
        [min(4096, int(rng.lognormvariate(6, 1))+1) for _ in range(20000)], [rng.randrange(1000, 2100) for _ in range(3000)], [2049] * 50 + [2047] * 50, [1] * 5000, [4096] * 7,
        [1366] * 300, [3000] * 10 + [500] * 30, [], [rng.randrange(257, 4097) for _ in range(5000)],
    ):
        groups = packing.plan(Counter(lengths))
        placed = Counter()
        for n, contents in groups:
            assert sum(a * b for a, b in contents) <= 4096
            for length, copies in contents:
                placed[length] += n * copies
        assert placed == Counter(lengths)
        bound = max(-(-sum(lengths) // 4096), sum(x > 2048 for x in lengths))
        print(len(lengths), sum(n for n, _ in groups), bound, len(groups))


def test_knapsack_is_exact():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randrange(1, 14)
        values = np.array([0.0] + [rng.random() * k for k in range(1, n + 1)])
        best = [0.0] * (n + 1)
        for c in range(1, n + 1):
            best[c] = max(best[c - 1], *(best[c - k] + values[k] for k in range(1, c + 1)))
        got, taken = packing.knapsack(values)
        assert abs(got - best[n]) < 1e-9 and sum(k * v for k, v in taken.items()) <= n and abs(sum(values[k] * v for k, v in taken.items()) - got) < 1e-9


def test_words_together_equal_words_alone():
    """Many words in one call give each word the ids that it has alone, whatever they hold."""
    library, rng = Tokenizer.from_file(PATH), random.Random(8)
    letters = ["a", "B", "é", "e\u0301", "\u0301", "İ", "ß", "Σ", "中", "🙂", "'s", "'LL", "1", "½", "-", "...", "\xa0", "\u3000", "\x00", "<|endoftext|>", "\u200d", "ﬁ", "ñ", "क्ष"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    own = packing.load(PATH)
    for word, ids in zip(words, packing.encode_words(own, words), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode(word, add_special_tokens=False).ids, word
    assert packing.encode_words(own, []) == []
