from __future__ import annotations

import hashlib
import os
import random
import time

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq

from paperloom.llm import bpe

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

PATH = public_tokenizers.path(bpe.MODEL)
ODD = [
    "", " ", "   ", "a  b", "a\tb\nc", " lead", "trail ", "Ünï cödé", "中文 字", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "|><|endoftext|>x",
    "  <|endoftext|>  x", "I'm you're he'll we've it's don't I'd", "'s's 'S ''s !'s 1's x'lls\n's \n 's", "'re'r 'l 'll'", "a\r\n\r\nb \n c\n\n", "x y　 z  w", "é ﬁ ① ²³ ½ ٣",
    "\x00a\x00\x1f\x85", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "the" * 300, "=" * 777, "0123456789" * 9, "🙂🙂🙂 é 👩‍👩‍👧", "\n\n\n  \n", "x" * 5000, "é" * 999 + " " * 700, "ingingtionation" * 50, "'",
]


def random_texts(n):
    rng = random.Random(5)
    alphabets = ["abc ", "etaoin shrdlu", "ab", "  \nxy", "éèaß ñ", "'stmdrevl ", "a'1! \t", "thertioningeds ", "aA", "=-_", "中文的一是"]
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 200))) for _ in range(n)] + [
        "".join(rng.choice(a) for _ in range(400)) for a in alphabets for _ in range(30)
    ]


def test_ids_and_text_equal_the_library(sf):
    library, own = Tokenizer.from_file(PATH), bpe.load(PATH)
    texts = ODD + random_texts(500) + pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()
    expected = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for text, ids, right in zip(texts, bpe.encode(own, pa.array(texts)), expected, strict=True):
        assert ids.tolist() == right, text
        assert own.decode(ids.tolist()) == library.decode(right, skip_special_tokens=False)


def test_every_token_and_every_pair_test():
    """Each token's own bytes, and random pairs side by side: the pair test agrees with the library's merges."""
    library, own = Tokenizer.from_file(PATH), bpe.load(PATH)
    rng = random.Random(2)
    words = [t.decode() for t in own.text if t.isascii() and t.isalpha()]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(3000)]
    ids = {w: library.token_to_id(w) for w in words}
    import numpy as np

    got = own.compatible(np.array([ids[a] for a, _ in pairs], np.int32), np.array([ids[b] for _, b in pairs], np.int32))
    right = [library.encode(a + b, add_special_tokens=False).ids == [ids[a], ids[b]] for a, b in pairs]
    assert got.tolist() == right
    assert [i.tolist() for i in bpe.encode(own, pa.array(words))] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_all_classes_of_code_points():
    library, own = Tokenizer.from_file(PATH), bpe.load(PATH)
    rng = random.Random(3)
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [rng.randrange(0x10000, 0x110000) for _ in range(2000)]
    texts = ["a" + chr(p) + "1 " + chr(p) + chr(p) + "! " for p in points]
    for got, right in zip(bpe.encode(own, pa.array(texts)), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == right.ids


def test_decoding_of_any_ids():
    library, own = Tokenizer.from_file(PATH), bpe.load(PATH)
    rng = random.Random(1)
    for _ in range(500):
        ids = [rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), ids


def test_long_words_take_time_in_proportion():
    library, own = Tokenizer.from_file(PATH), bpe.load(PATH)
    rng = random.Random(4)
    bpe.encode(own, pa.array(["warm" * 100]))
    for text in (" " * 200_000, "-" * 200_000, "7" * 200_000, "".join(rng.choice("etaoinshr") for _ in range(200_000)), "é" * 100_000):
        began = time.time()
        got = bpe.encode(own, pa.array([text, "x"]))[0].tolist()
        assert time.time() - began < 20
        assert got == library.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, "a b", "x"), (None, None, None), (3, "", "y"), (3, "", "y"), (4, "Zürich " * 9000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.c0, r.c2): (list(r.ids), r.decoded) for r in bpe.encoded(docs).collect()}
    library = Tokenizer.from_file(PATH)
    assert bpe.encoded(docs).count() == 5
    for doc_id, text, extra in rows:
        assert got[(doc_id, extra)] == (library.encode(text or "", add_special_tokens=False).ids, text or "")
    assert bpe.encoded(docs.limit(0)).count() == 0


def test_query(spark, sf):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: tuple(r)[1:] for r in bpe.query(spark, sf).collect()}
    for r in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[r["doc_id"]] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
