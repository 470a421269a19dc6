"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a word ends in exactly one token, so one number per prefix is the whole program:

* A suffix automaton of the vocabulary (the tokens' trie with links to the longest proper suffix that is in the trie)
  reads the word byte by byte. Its state, and the chain of shorter tokens behind it, list all tokens that end there.
* Such a token is the prefix's last one if it is compatible with the last token of the prefix before it: undoing the
  merges of both from the latest to the earliest, no pair across their border may have a merge that comes first (an equal
  merge counts for the place further left).
* Following the last tokens backwards from the word's end gives the ids.

Words are what the tokenizer's own pattern cuts (letters, digits, other signs, white space, English contractions), found
here on arrays of code points; what class a code point has is asked of the tokenizer itself, once per code point. All
distinct words of a block go through the program at once, one byte position at a time; when few words are left, their rest
goes byte by byte, so a text without spaces costs time in proportion to its length. Special tokens in a text become their
ids, as the library does. Decoding spells the ids' bytes; bytes that are not UTF-8 become U+FFFD.

Null text is empty: no ids, an empty text. Empty table: no rows. Repeated rows are encoded each; no order matters, so there
are no ties. Texts are encoded whole; memory follows ``BLOCK`` bytes of text, or the longest one. Only doc_id and text are
read; other columns go through ``encoded`` under positional names.
"""
from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.frames import append, documents
from paperloom.llm.pieces import row_blocks
from paperloom.llm.tables import Table

MODEL = "byte_bpe_50k.json"
BLOCK = 8 << 20
FEW = 48  # words that are left: from here on byte by byte
MEMO = 1 << 20  # pairs whose compatibility is remembered byte by byte
LETTER, DIGIT, SIGN, WHITE = 1, 2, 3, 4


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """The tokens of a byte-level vocabulary as bytes, and its merges."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and spec["normalizer"] is None
        if model["type"] != "BPE" or model["dropout"] or model.get("ignore_merges") or not plain:
            raise ValueError("a byte-level model with the usual pattern, without normalisation or dropout is needed")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with rules of their own are not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters, vocabulary = byte_letters(), model["vocab"]
        self.ids = list(vocabulary.values())
        self.size = 1 + max([*self.ids, *self.special.values()])
        self.text = [b""] * self.size
        for name, i in vocabulary.items():
            self.text[i] = bytes(letters[c] for c in name)
        for name, i in self.special.items():
            self.text[i] = name.encode()
        self.width = np.array([len(t) for t in self.text], np.int32)
        self.text_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.text_start = np.cumsum(self.width, dtype=np.int64) - self.width
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = np.array([[vocabulary[a], vocabulary[b], vocabulary[a + b]] for a, b in pairs], np.int64).reshape(-1, 3)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, in a row."""
        length = self.width[ids].astype(np.int64)
        return self.text_bytes[np.repeat(self.text_start[ids] - (np.cumsum(length) - length), length) + np.arange(length.sum())]

    def decode(self, ids: list[int]) -> str:
        return self.spell(np.array(ids, np.int64)).tobytes().decode(errors="replace")


class BytePairs(ByteVocabulary):
    """The merges as arrays, the tokens' suffix automaton, and the pattern's classes."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.rank, self.left, self.right = (np.full(self.size, -1, np.int32) for _ in range(3))
        ends, ranks = self.merges, np.arange(len(self.merges), dtype=np.int32)
        if len(np.unique(ends[:, 2])) != len(ends) or (np.bincount(ends[:, 2], minlength=self.size) + (self.width == 1))[self.ids].min() < 1:
            raise ValueError("every token must be a byte or come from one merge")
        self.rank[ends[:, 2]], self.left[ends[:, 2]], self.right[ends[:, 2]] = ranks, ends[:, 0], ends[:, 1]
        self.pairs = Table(ends[:, 0] * self.size + ends[:, 1], ranks)
        merged = np.flatnonzero(self.rank >= 0)
        whole = np.zeros(self.size, bool)  # tokens that their own bytes are encoded as: no others can come out
        whole[[i for i in self.ids if self.width[i] == 1]] = True
        fits = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        for i, ok in sorted(zip(merged.tolist(), fits.tolist()), key=lambda x: self.rank[x[0]]):
            whole[i] = ok and whole[self.left[i]] and whole[self.right[i]]
        self._automaton(np.flatnonzero(whole).tolist())
        self.classes = np.zeros(0x110000, np.uint8)
        self.scalars = None

    def _automaton(self, tokens: list[int]) -> None:
        children, own = [{}], [-1]
        for i in tokens:
            node = 0
            for b in self.text[i]:
                to = children[node].get(b)
                if to is None:
                    to = children[node][b] = len(children)
                    children.append({})
                    own.append(-1)
                node = to
            own[node] = i
        if len(children[0]) < 256:
            raise ValueError("every byte must be a token")
        link, best, shorter = [0] * len(children), own[:], [-1] * self.size
        level = list(children[0].values())
        while level:
            for node in level:
                under = best[link[node]] if link[node] else -1
                if own[node] >= 0:
                    shorter[own[node]] = under
                else:
                    best[node] = under
                for b, to in children[node].items():
                    at = link[node]
                    while at and b not in children[at]:
                        at = link[at]
                    link[to] = children[at].get(b, 0)
            level = [to for node in level for to in children[node].values()]
        self.link, self.best, self.shorter = np.array(link, np.int32), np.array(best, np.int32), np.array(shorter, np.int32)
        keys = [node * 256 + b for node, c in enumerate(children) for b in c]
        self.edges = Table(np.array(keys, np.int64), np.array([to for c in children for to in c.values()], np.int32))

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the tokens ``a`` and ``b`` stay apart when their bytes stand side by side (up to the merge ``limit``)."""
        ok, todo = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), self.size, np.int32) if limit is None else limit
        while len(todo):
            found = self.pairs.get(a.astype(np.int64) * self.size + b)
            clash = (found >= 0) & (found < limit)
            ok[todo[clash]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = ~clash & ((rank_a >= 0) | (rank_b >= 0))
            todo, a, b, rank_a, rank_b = todo[go], a[go], b[go], rank_a[go], rank_b[go]
            undo_a = rank_a > rank_b  # equal merges: the left one was made first
            limit = np.where(undo_a, rank_a, rank_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self.edges.get(node.astype(np.int64) * 256 + byte)
        todo = np.flatnonzero(out < 0)
        at = node[todo]
        while len(todo):
            at = self.link[at]
            to = self.edges.get(at.astype(np.int64) * 256 + byte[todo])
            out[todo] = to
            more = to < 0
            todo, at = todo[more], at[more]
        return out

    def last_tokens(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For every byte of words (``starts``: n + 1 offsets, none empty) the last token of the prefix that it ends."""
        last = np.empty(len(data), np.int32)
        lengths = np.diff(starts)
        order = np.argsort(-lengths, kind="stable")
        base, sizes = starts[:-1][order], lengths[order]
        left = len(base) - np.searchsorted(sizes[::-1], np.arange(sizes[0] + 1 if len(sizes) else 1), "right")
        node = np.zeros(len(base), np.int32)
        k = 0
        while k < len(left) and left[k] >= FEW:
            n = left[k]
            place = base[:n] + k
            node = self._step(node[:n], data[place])
            token, todo = self.best[node], np.arange(n)
            while len(todo):
                width = self.width[token]
                fits = width == k + 1
                after = np.flatnonzero(~fits)
                fits[after] = self.compatible(last[place[todo[after]] - width[after]], token[after])
                last[place[todo[fits]]] = token[fits]
                todo, token = todo[~fits], self.shorter[token[~fits]]
            k += 1
        if k < len(left):
            for w in range(left[k]):
                self._rest(data, last, int(base[w]), int(base[w] + sizes[w]), k, int(node[w]))
        return last

    def _rest(self, data: np.ndarray, last: np.ndarray, start: int, end: int, k: int, node: int) -> None:
        """The same for one word, from its byte ``k`` on, in plain numbers."""
        if self.scalars is None:
            filled = self.edges.keys >= 0
            edges = dict(zip(self.edges.keys[filled].tolist(), self.edges.values[filled].tolist()))
            self.scalars = edges, self.link.tolist(), self.best.tolist(), self.shorter.tolist(), self.width.tolist(), {}
        edges, link, best, shorter, widths, memo = self.scalars
        if len(memo) > MEMO:
            memo.clear()
        text, found = data[start:end].tobytes(), last[start : start + k].tolist()
        for place in range(k, end - start):
            byte = text[place]
            to = edges.get(node * 256 + byte)
            while to is None:
                node = link[node]
                to = edges.get(node * 256 + byte)
            node, token = to, best[to]
            while True:
                before = place - widths[token]
                if before < 0:
                    break
                key = found[before] * self.size + token
                fits = memo.get(key)
                if fits is None:
                    fits = memo[key] = bool(self.compatible(np.array([found[before]], np.int32), np.array([token], np.int32))[0])
                if fits:
                    break
                token = shorter[token]
            found.append(token)
        last[start + k : end] = found[k:]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct words (none empty)."""
        data, starts = W.flat(words)
        n = len(starts) - 1
        last = self.last_tokens(data, starts)
        # from each word's end backwards, all words at once
        who, at, rounds = np.arange(n), starts[1:] - 1, []
        while len(who) >= FEW:
            token = last[at]
            rounds.append((who, token))
            at = at - self.width[token]
            more = at >= starts[who]
            who, at = who[more], at[more]
        for w, place in zip(who.tolist(), at.tolist()):
            own, first = [], int(starts[w])
            while place >= first:
                own.append(int(last[place]))
                place -= int(self.width[own[-1]])
            rounds.append((np.full(len(own), w), np.array(own, np.int32)))
        whose = np.concatenate([r[0] for r in rounds] or [np.zeros(0, np.int64)])
        tokens = np.concatenate([r[1] for r in rounds] or [np.zeros(0, np.int32)])
        counts = np.bincount(whose, minlength=n)
        tokens = tokens[::-1][np.argsort(whose[::-1], kind="stable")]
        for name, i in self.special.items():
            w = pc.index(words, pa.scalar(name, words.type)).as_py()
            if w >= 0:
                a = int(counts[:w].sum())
                tokens = np.concatenate((tokens[:a], np.array([i], np.int32), tokens[a + counts[w] :]))
                counts[w] = 1
        return tokens.astype(np.int64), np.append(0, np.cumsum(counts))

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """Letter, digit, sign or white space by the tokenizer's own pattern."""
        kinds = self.classes[points]
        if not kinds.all():
            for p in np.unique(points[kinds == 0]).tolist():
                one = [len(self.cutter.pre_tokenize_str(s + chr(p) + s)) == 1 for s in "a1!"]
                self.classes[p] = one.index(True) + 1 if any(one) else WHITE
            kinds = self.classes[points]
        return kinds

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts in a row, and the texts' offsets among them."""
        data, offsets = W.flat(texts)
        if not len(data):
            return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        inside = []
        for name in self.special:
            mark = name.encode()
            at = raw.find(mark)
            while at >= 0:
                if not border[at + 1 : at + len(mark)].any():
                    inside.append((at, at + len(mark)))
                    at = raw.find(mark, at + len(mark))
                else:
                    at = raw.find(mark, at + 1)
        for a, b in inside:
            border[[a, b]] = True
        start = cuts(points, self.kinds(points), border[heads])
        for a, b in inside:
            i, j = np.searchsorted(heads, (a, b))
            start[i + 1 : j] = False
        starts = heads[start]
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(raw))
        return found, np.searchsorted(starts, offsets)


def cuts(points: np.ndarray, kinds: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Which characters begin a word. ``border``: characters that begin a text (or a part between special tokens)."""
    white, blank = kinds == WHITE, points == 32
    before = np.append(np.uint8(0), kinds[:-1])
    before[border] = 0
    joined = np.append(False, blank[:-1]) & ~border  # a blank goes with the run that follows
    start = np.where(white, before != WHITE, (kinds != before) & ~joined)
    start |= white & np.append(~white[1:] & ~border[1:], False)  # the last of a run of white space stands alone or joins
    mark = np.flatnonzero(start & (points == 39))
    padded = np.append(points, np.zeros(3, points.dtype))
    ends = np.append(border, np.ones(3, bool))
    one, two = padded[mark + 1], padded[mark + 2]
    short = np.isin(one, [ord(c) for c in "stmd"]) & ~ends[mark + 1]
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    pair &= ~ends[mark + 1] & ~ends[mark + 2]
    start[mark[short | pair] + 1] = False
    after = np.concatenate((mark[short] + 2, mark[pair] + 3))
    start[after[after < len(start)]] = True
    return start


def load(path: str) -> BytePairs:
    return W.once(("byte pairs", path), lambda: BytePairs(path))


def encode_rows(model: BytePairs, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each text's words, the texts' offsets, and the ids and id offsets of each distinct word."""
    found, rows = model.words(texts)
    distinct = found.dictionary_encode()
    ids, places = model.encode_words(distinct.dictionary)
    return distinct.indices.to_numpy(), rows, ids, places


def encode(model: BytePairs, texts: pa.Array) -> list[np.ndarray]:
    """The ids of each text."""
    codes, rows, ids, places = encode_rows(model, texts)
    return [np.concatenate([ids[places[c] : places[c + 1]] for c in codes[a:b]] or [np.zeros(0, np.int64)]) for a, b in zip(rows, rows[1:])]


def _digests(model: BytePairs, texts: pa.Array) -> tuple[list, list, list]:
    codes, rows, ids, places = encode_rows(model, texts)
    names, place = list(map(str, ids.tolist())), places.tolist()
    listed = [",".join(names[a:b]).encode() for a, b in zip(place, place[1:])]
    spelt = model.spell(ids).tobytes()
    width = np.append(0, np.cumsum(model.width[ids], dtype=np.int64))[places].tolist()
    words = [spelt[a:b] for a, b in zip(width, width[1:])]
    id_hashes, text_hashes = [], []
    for a, b in zip(rows.tolist(), rows[1:].tolist()):
        own = codes[a:b].tolist()
        id_hashes.append(hashlib.sha256(b",".join([listed[c] for c in own])).hexdigest())
        text_hashes.append(hashlib.sha256(b"".join([words[c] for c in own]).decode(errors="replace").encode()).hexdigest())
    return W.row_sums(np.diff(places)[codes], rows).tolist(), id_hashes, text_hashes


def encoded(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` as c0, c1, ... with ``ids`` of the whole text and ``decoded``, the text that they give."""
    path = path or public_tokenizers.path(MODEL)

    def compute(batch: pa.RecordBatch, at: int) -> dict:
        model = load(path)
        ids = [i for part in row_blocks(batch.column(at), BLOCK) for i in encode(model, part)]
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([model.decode(i) for i in ids], pa.string())}

    return append(docs, compute, "ids array<int>, decoded string", text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(MODEL)

    def compute(batch: pa.RecordBatch, at: int) -> dict:
        model = load(path)
        parts = [_digests(model, part) for part in row_blocks(batch.column(at), BLOCK)]
        return {k: sum((p[i] for p in parts), []) for i, k in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return append(docs, compute, "n_tokens long, ids_sha256 string, decoded_sha256 string").select(
        F.col("c0").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256"
    )
