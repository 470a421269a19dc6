from __future__ import annotations

import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece

from paperloom.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)
ODD = [
    "", " ", "   ", "a  b", "a\tb\nc", " lead", "trail ", "Ünï cödé", "中文 字", "<s> x</s> <unk> <0x41>", "a▁b ▁▁ c", "ﬁ ①", "\x00a\x00", "a\xa0b　c",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "abababababababab" * 40, "the" * 300, "=" * 77, "0123456789" * 9, "🙂🙂🙂 é", "\n\n\n  \n", "x" * 5000, "é" * 999 + " " * 70, "ingingtionation" * 50,
]


def random_texts(n):
    rng = random.Random(5)
    alphabets = ["abc ", "etaoin shrdlu", "ab", "  \nxy", "éèaß ñ", "a▁ b", "thertioningeds "]
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 200))) for _ in range(n)] + [
        "".join(rng.choice(a) for _ in range(400)) for a in alphabets for _ in range(40)
    ]


def test_ids_and_text_equal_the_library(sf):
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.load(PATH)
    texts = ODD + random_texts(400) + pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()
    for text, ids in zip(texts, pieces.encode(own, pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())


def test_decoding_of_any_ids():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.load(PATH)
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(3, 32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_rows(spark):
    rows = [(1, "a b", "x"), (None, None, None), (3, "", "y"), (3, "", "y"), (4, "Zürich " * 9000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.c0, r.c2): (list(r.ids), r.decoded) for r in pieces.encoded(docs).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert pieces.encoded(docs).count() == 5
    for doc_id, text, extra in rows:
        assert got[(doc_id, extra)] == (library.encode(text or ""), text or "")
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_query(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: tuple(r)[1:] for r in pieces.query(spark, sf).collect()}
    for r in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        ids = library.encode(r["text"] or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[r["doc_id"]] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_long_segments_take_time_in_proportion(monkeypatch):
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.load(PATH)
    rng = random.Random(3)
    texts = [c * 100_000 for c in " \t\n-=_7ax"] + ["".join(rng.choice(a) for _ in range(100_000)) for a in ("etaoinshr", "中文的一是了", "ab", "0123456789")]
    began = time.time()
    got = pieces.encode(own, pa.array(texts))
    assert time.time() - began < 60
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == library.encode(text), text[:10]
    # the queue alone gives what rounds give
    monkeypatch.setattr(pieces, "LONG", 0)
    texts = ODD + random_texts(200)
    for text, ids in zip(texts, pieces.encode(own, pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text), text
