"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Encoding: a space becomes U+2581 and a text gets one in front. No piece of the vocabulary holds U+2581 after another
character (checked on loading), so a text falls into segments (spaces and what follows them) that merge on their own,
and each distinct segment of a block is encoded once. All segments lie in flat numpy arrays of symbols. Each round takes
every segment's lowest pair rank (best score) by a segmented minimum, merges its leftmost non-overlapping occurrences at
once, and compacts; segments without a pair leave. The library merges one occurrence at a time: merging several at once
differs only if a merge makes a pair of equal or lower rank, so such segments (seen beforehand) merge their leftmost
occurrence only in that round. A segment of over ``LONG`` symbols (runs of spaces, text without spaces) merges by a queue of
pairs, in time in proportion to its length but for a logarithm. Characters outside the vocabulary become byte pieces.

Decoding: ids to bytes through flat tables, minus the space in front. Null text is empty: no ids, an empty text. Texts
are encoded whole; memory follows ``BLOCK`` bytes of text, or the longest one. Only doc_id and text are read.
"""
from __future__ import annotations

import codecs
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.frames import append, documents

MODEL = "piece_bpe_32k.model"
BLOCK = 12 << 20
SPACE = "▁"
NONE = np.uint32(0xFFFFFFFF)
LONG = 512  # symbols of a segment that merges by a queue instead of rounds
MEMO = 1 << 20  # pairs that the queue remembers


class Pieces:
    """A model's vocabulary as arrays: symbols of characters, and a hash table from symbol pairs to merged symbols."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:-1], 16)] = i
        normal = [i for i in range(n) if not special[i] and not model.is_byte(i)]
        if any(model.is_unused(i) for i in normal) or any(SPACE in names[i].lstrip(SPACE) for i in normal):
            raise ValueError("pieces that are unused or hold a space inside are not supported")
        if (self.byte_ids < 0).any() or "".join(model.encode("ﬁ ①  x", out_type=str))[:3] != SPACE + "ﬁ" + SPACE:
            raise ValueError("a model with byte fallback and without normalisation is needed")
        self.text = [b"" if special[i] else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.text[model.unk_id()] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids):
            self.text[i] = bytes([b])
        symbol = {names[i]: i for i in normal}
        scores = np.array([model.get_score(i) for i in range(n)])
        # equal scores are equal ranks: the leftmost pair goes first
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.uint32)
        for i in normal:
            for c in names[i]:
                symbol.setdefault(c, len(symbol) + n)
        self.size = max(symbol.values()) + 1
        self.vocabulary = n
        points = sorted((ord(c), s) for c, s in symbol.items() if len(c) == 1)
        self.points, self.point_symbols = (np.array(x, np.int64) for x in zip(*points))
        keys, merged = [], []
        for i in normal:
            name = names[i]
            for k in range(1, len(name)):
                a, b = symbol.get(name[:k]), symbol.get(name[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(i)
        self.known: dict[int, tuple[int, int]] = {}
        self.bits = max(16, (len(keys) * 6).bit_length())
        self.keys, self.merged = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for key, i, slot in zip(keys, merged, self._slot(np.array(keys, np.int64)).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.merged[slot] = key, i
        self.text_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.text_length = np.array([len(t) for t in self.text])
        self.text_start = np.cumsum(self.text_length) - self.text_length

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to, or -1. Negative symbols are characters outside the vocabulary."""
        out = np.full(len(left), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo].astype(np.int64) * self.size + right[todo]
        slot = self._slot(key)
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            out[todo[hit]] = self.merged[slot[hit]]
            more = ~hit & (there >= 0)
            todo, key, slot = todo[more], key[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        return np.where(pairs >= 0, self.rank[pairs], NONE)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, self.point_symbols[at], -points - 1).astype(np.int32)

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all segments (starts: n + 1 offsets, none empty) until no pair remains; their symbols and offsets."""
        n = len(starts) - 1
        owner = np.arange(n)
        done_owner, done_symbols = [], []
        lengths = np.diff(starts)
        if n and lengths.max() > LONG:
            for w in np.flatnonzero(lengths > LONG).tolist():
                found = self.merge_long(symbols[starts[w] : starts[w + 1]])
                done_owner.append(np.full(len(found), w))
                done_symbols.append(found)
            short = lengths <= LONG
            symbols, owner = symbols[np.repeat(short, lengths)], owner[short]
            starts = np.append(0, np.cumsum(lengths[short]))
        while len(symbols):
            first = starts[:-1]
            word = np.repeat(np.arange(len(first)), np.diff(starts))
            pairs = self.pair(symbols[:-1], symbols[1:])
            pairs[word[:-1] != word[1:]] = -1
            rank = np.append(self.ranks(pairs), NONE)
            least = np.minimum.reduceat(rank, first)
            live = least != NONE
            if not live.all():
                over = ~live[word]
                done_owner.append(owner[word[over]])
                done_symbols.append(symbols[over])
                symbols, rank, pairs, word = symbols[~over], rank[~over], np.append(pairs, -1)[~over], word[~over]
                lengths = np.diff(starts)[live]
                starts = np.concatenate(([0], np.cumsum(lengths)))
                owner, least = owner[live], least[live]
                word = np.repeat(np.arange(len(lengths)), lengths)
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least[word])
            fresh = np.ones(len(at), bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            run = np.arange(len(at))
            at = at[(run - np.maximum.accumulate(np.where(fresh, run, 0))) % 2 == 0]
            at = self._safe(symbols, word, pairs, at, least)
            symbols[at] = pairs[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            lengths = np.diff(starts) - np.bincount(word[at], minlength=len(starts) - 1)
            symbols, starts = symbols[keep], np.concatenate(([0], np.cumsum(lengths)))
        if not done_owner:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        whose, found = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(whose, kind="stable")
        return found[order], np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=n))))

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One long segment: a queue of pairs by rank and place. Rounds would look at all of it for each rank that occurs."""
        n = len(symbols)
        ranks = self.ranks(self.pair(symbols[:-1], symbols[1:]))
        at = np.flatnonzero(ranks != NONE)
        queue = ((ranks[at].astype(np.int64) << 32) + at).tolist()
        heapq.heapify(queue)
        own, after, before = symbols.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
        if len(self.known) > MEMO:
            self.known.clear()
        known, size = self.known, self.size

        def offer(a: int, b: int) -> tuple[int, int]:
            """The symbol that a pair merges to and its rank; (-1, -1) for none."""
            if own[a] < 0 or own[b] < 0:
                return -1, -1
            key = own[a] * size + own[b]
            found = known.get(key)
            if found is None:
                merged = int(self.pair(np.array([own[a]], np.int32), np.array([own[b]], np.int32))[0])
                found = known[key] = (merged, int(self.rank[merged]) if merged >= 0 else -1)
            return found

        gone = bytearray(n)
        while queue:
            rank, a = divmod(heapq.heappop(queue), 1 << 32)
            b = -1 if gone[a] else after[a]
            if b < 0:
                continue
            merged, now = offer(a, b)
            if now != rank:
                continue  # one of the two has merged since
            own[a], gone[b], after[a] = merged, 1, after[b]
            if after[b] >= 0:
                before[after[b]] = a
                rank = offer(a, after[a])[1]
                if rank >= 0:
                    heapq.heappush(queue, (rank << 32) + a)
            if before[a] >= 0:
                rank = offer(before[a], a)[1]
                if rank >= 0:
                    heapq.heappush(queue, (rank << 32) + before[a])
        return np.array([s for s, out in zip(own, gone) if not out], np.int32)

    def _safe(self, symbols: np.ndarray, word: np.ndarray, pairs: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """``at`` without the later merges of a segment in which one of several would make a pair that goes before them."""
        several = np.flatnonzero(np.bincount(word[at], minlength=len(least))[word[at]] > 1)
        if not len(several):
            return at
        x = at[several]
        new, w, last = pairs[x], word[x], len(symbols) - 1
        left, right = np.maximum(x - 1, 0), np.minimum(x + 2, last)
        merged = np.full(len(symbols), -1, np.int32)
        merged[x] = pairs[x]
        before, after = np.maximum(x - 2, 0), right
        tries = [
            (symbols[left], new, (x >= 1) & (word[left] == w)),
            (new, symbols[right], (x + 2 <= last) & (word[right] == w)),
            (merged[before], new, (x >= 2) & (word[before] == w)),
            (new, merged[after], (x + 2 <= last) & (word[after] == w)),
        ]
        clash = np.zeros(len(x), bool)
        for a, b, ok in tries:
            found = np.where(ok, self.pair(a, b), -1)
            clash |= self.ranks(found) <= least[w]
        bad = np.zeros(len(least), bool)
        bad[w[clash]] = True
        drop = bad[word[at]]
        drop[1:] &= word[at[1:]] == word[at[:-1]]
        drop[:1] = False
        return at[~drop]

    def ids(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: those outside the vocabulary to the ids of their bytes."""
        known = (symbols >= 0) & (symbols < self.vocabulary)
        if known.all():
            return symbols.astype(np.int64), starts
        points = dict(zip(self.point_symbols.tolist(), self.points.tolist()))
        raw = {s: self.byte_ids[list(chr(points[s] if s >= 0 else -s - 1).encode())] for s in np.unique(symbols[~known]).tolist()}
        width = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(~known)
        width[odd] = [len(raw[s]) for s in symbols[odd].tolist()]
        place = np.concatenate(([0], np.cumsum(width)))
        out = np.empty(place[-1], np.int64)
        out[place[:-1][known]] = symbols[known]
        for i in odd.tolist():
            out[place[i] : place[i + 1]] = raw[int(symbols[i])]
        return out, place[starts]

    def encode_segments(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct segments (spaces not yet replaced, none empty)."""
        data, offsets = W.flat(segments)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        points = np.frombuffer(data.tobytes().decode().replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        return self.ids(*self.merge(self.symbols(points), chars))

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, in a row."""
        length = self.text_length[ids]
        shift = np.repeat(self.text_start[ids] - (np.cumsum(length) - length), length)
        return self.text_bytes[shift + np.arange(length.sum())]

    def decode(self, ids: list[int]) -> str:
        text = self.spell(np.array(ids, np.int64)).tobytes()
        return to_text(text[1:] if text[:1] == b" " else text)


def load(path: str) -> Pieces:
    return W.once(("pieces", path), lambda: Pieces(path))


def to_text(data: bytes) -> str:
    """UTF-8 to text; each byte that fits nowhere becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        codecs.register_error("one_by_one", lambda e: ("\ufffd", e.start + 1))
        return data.decode("utf-8", "one_by_one")


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The segments of all texts in a row, each text with a space in front, and the texts' offsets among them."""
    texts = pc.replace_substring(texts.fill_null(""), SPACE, " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    data, offsets = W.flat(texts)
    space = data == 32
    head = space.copy()
    head[1:] &= ~space[:-1]
    filled = offsets[:-1][np.diff(offsets) > 0]
    head[filled] = True
    starts = np.flatnonzero(head)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data.tobytes()))
    return found, np.searchsorted(starts, offsets)


def row_blocks(texts: pa.Array, size: int) -> list[pa.Array]:
    """``texts`` in slices of about ``size`` bytes."""
    _, offsets = W.flat(texts)
    out, row = [], 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        out.append(texts.slice(row, last - row))
        row = last
    return out


def encode_rows(model: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each text's segments, the texts' offsets, and the ids and id offsets of each distinct segment."""
    found, rows = segments(texts)
    distinct = found.dictionary_encode()
    ids, places = model.encode_segments(distinct.dictionary)
    return distinct.indices.to_numpy(), rows, ids, places


def encode(model: Pieces, texts: pa.Array) -> list[np.ndarray]:
    """The ids of each text."""
    codes, rows, ids, places = encode_rows(model, texts)
    return [np.concatenate([ids[places[c] : places[c + 1]] for c in codes[a:b]] or [np.zeros(0, np.int64)]) for a, b in zip(rows, rows[1:])]


def _digests(model: Pieces, texts: pa.Array) -> tuple[list, list, list]:
    codes, rows, ids, places = encode_rows(model, texts)
    names = list(map(str, ids.tolist()))
    place = places.tolist()
    listed = [",".join(names[a:b]).encode() for a, b in zip(place, place[1:])]
    spelt, width = model.spell(ids).tobytes(), np.concatenate(([0], np.cumsum(model.text_length[ids])))[places].tolist()
    words = [spelt[a:b] for a, b in zip(width, width[1:])]
    counts = W.row_sums(np.diff(places)[codes], rows).tolist()
    id_hashes, text_hashes = [], []
    for a, b in zip(rows.tolist(), rows[1:].tolist()):
        own = codes[a:b].tolist()
        id_hashes.append(hashlib.sha256(b",".join([listed[c] for c in own])).hexdigest())
        text = b"".join([words[c] for c in own])
        text = text[1:] if text[:1] == b" " else text
        text_hashes.append(hashlib.sha256(to_text(text).encode()).hexdigest())
    return counts, id_hashes, text_hashes


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
