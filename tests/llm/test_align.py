from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from paperloom.llm import align, bpe, pieces

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

PATHS = public_tokenizers.path(bpe.MODEL), public_tokenizers.path(pieces.MODEL)
ODD = [
    None, "", " ", "  ", "a  b", "a\tb\nc", " lead", "trail ", " both  ", "Ünï cödé", "中文 字 體", "<|endoftext|> x<|endoftext|>", "<s> x</s> <unk> <0x41>", "a▁b", "▁", "x ▁ y",
    "ﬁ ①", "\x00a\x00", "a\xa0b　c", "a \xa0 b", "a\xa0 b", "a 　b", "x y   z", "🙂🙂🙂 é 👩‍👩‍👧 x", "𐍈𐍉 𐍊", "\n\n\n  \n", "x\n y", "x \ny", "x\r\n\r\n y", "é" * 99 + " " * 70, "it's I'd 'tis ' s",
    "۩ ༼ つ ◕_◕ ༽つ", "नमस्ते दुनिया", "สวัสดี ชาวโลก", "\U0010ffff ", "a  b", "= == === ====", "0 00 000 0000",
]


def slow(texts):
    """Whole texts through both libraries, byte ends from the tokens' bytes alone."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = bpe.byte_letters()
    spell_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for text in texts:
        groups, links = [], []
        if text:
            data = (" " + text).encode()
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if b"".join(map(spell_a, x)) == data and b"".join(map(spell_b, y)) == data:
                i = j = at_a = at_b = 0
                own_a, own_b = [], []
                while i < len(x) or j < len(y):
                    if at_a <= at_b:
                        own_a.append(x[i])
                        at_a += len(spell_a(x[i]))
                        i += 1
                    else:
                        own_b.append(y[j])
                        at_b += len(spell_b(y[j]))
                        j += 1
                    if at_a == at_b:
                        groups.append((own_a, own_b))
                        links.append((own_a[-1], own_b[-1]))
                        own_a, own_b = [], []
        count.update(links)
        found.append((groups, links))
    most = defaultdict(int)
    for (x, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for groups, links in found:
        names = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(names.encode()).hexdigest() if groups else "",
        ))
    return out


def random_texts(n):
    rng = random.Random(5)
    alphabets = ["abc ", "etaoin shrdlu", "  \nxy", "éèaß ñ ", "'stmdrevl ", "中文🙂𐍈 ", "thertioningeds ", "\xa0 　a", "नमस्ते ", "=-_ "]
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 200))) for _ in range(n)] + [
        "".join(rng.choice(a) for _ in range(300)) for a in alphabets for _ in range(20)
    ]


@pytest.mark.parametrize("block", [align.BLOCK, 2000])
def test_rows_equal_whole_texts(spark, block, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", block)
    texts = ODD + random_texts(200) + ["same text twice"] * 3
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, links long, n_a string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in align.alignment(docs).collect()}
    assert [got[i] for i in range(len(texts))] == slow(texts)


def test_query(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r)[1:] for r in align.query(spark, sf).collect()}
    assert got == dict(zip((r["doc_id"] for r in rows), slow([r["text"] for r in rows])))


def test_ids_ends_and_cuts(spark):
    texts = [t for t in ODD if t and "▁" not in t] + random_texts(20)
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "cuts long, text string, a_ids string")
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    rows = {r.c0: r for r in align.aligned(docs).collect()}
    for i, text in enumerate(texts):
        r, data = rows[i], (" " + text).encode()
        assert r.a_ids == a.encode(" " + text, add_special_tokens=False).ids and r.b_ids == b.encode(text)
        assert r.cuts == sorted(set(r.a_ends) & set(r.b_ends)) and r.a_ends[-1] == r.b_ends[-1] == len(data)
        own = pieces.load(PATHS[1])
        for at, j, token in zip([0, *r.b_ends], r.b_ends, r.b_ids):
            assert data[at:j] == own.text[token]
    nothing = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert [tuple(r) for r in align.aligned(nothing).select("a_ids", "cuts").collect()] == [([], []), ([], [])]


def test_no_rows_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment(empty).collect() == [] and align.aligned(empty).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    got = [tuple(r) for r in align.alignment(docs).collect()]
    assert sorted(map(str, got)) == sorted(str((d, *s)) for d, s in zip([None, None, 1], slow(["a b", "a b", None])))


def test_linked_pairs_are_bounded_by_the_vocabularies():
    pairs = align.load(*PATHS).pairs
    assert pairs.size < 1_000_000
    assert (pairs.of(pairs.table.keys[pairs.table.keys >= 0] // pairs.n_b, pairs.table.keys[pairs.table.keys >= 0] % pairs.n_b) >= 0).all()


def test_long_texts():
    both = align.load(*PATHS)
    texts = ["word " * 100_000, " " * 50_000, "x" * 50_000, "é" * 20_000]
    codes, rows, spans, good = align.block(both, pa.array(texts))
    assert good.all() and len(rows) == 5
