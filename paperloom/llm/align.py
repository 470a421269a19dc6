"""Alignment of two tokenizers' tokens on byte offsets.

Both libraries encode and give spans: character offsets on one side (A), spans of the piece messages on the other (B: byte
offsets of ``return_type="proto"``, the library's successor of its immutable messages). These are the coarse cuts. They are
not exact where a character's bytes fall into several tokens: such tokens of A share the character's offsets, byte pieces of
B have empty spans but for the last. There the decoded bytes of the tokens since the last sure cut give the exact ends.

A space stands in front of every text. Neither tokenizer joins over a space that follows something else than a space and
precedes no white space, so texts fall into units there, each distinct unit of a block is encoded once (many to a call; a
worker keeps what it met first), and both tokenizers end a token with each unit. Offsets where both end cut a text into groups; the two tokens that end there are
a link. One of the two is a suffix of the other, so the vocabularies alone bound the number of linked id pairs (``Pairs``):
counts of pairs are arrays of that fixed size, added up per task, then over tasks, and go to all tasks by broadcast.

Null and empty texts, and texts that hold U+2581 (its bytes are lost in B's pieces) have no tokens: zeros and an empty
string. Equal counts tie: each is the highest. Repeated rows count each. An empty table gives no rows. Texts are encoded
whole; memory follows ``BLOCK`` bytes of text, or the longest one. Only doc_id and text are read; ``aligned`` returns other
columns under positional names, so names cannot clash.
"""
from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, pieces
from paperloom.llm import words as W
from paperloom.llm.frames import append, documents
from paperloom.llm.pieces import row_blocks
from paperloom.llm.tables import Table
from paperloom.session import cut_lineage

BLOCK = 4 << 20
CACHED = 400_000  # units whose spans a worker keeps
TOGETHER = 256  # units to a string
AT_ONCE = 16  # strings to a call
MARK = "▁"
MARK_BYTES = MARK.encode()
# What may follow the space that begins a unit: no white space of any kind, judged by the first byte alone.
FOLLOWS = np.zeros(256, bool)
FOLLOWS[33:127] = FOLLOWS[0xC3:0xF5] = True
FOLLOWS[[0xE1, 0xE2, 0xE3]] = False


class Both:
    """The two tokenizers, their tokens' bytes, and all id pairs that can be linked."""

    def __init__(self, path_a: str, path_b: str):
        from tokenizers import Tokenizer

        a, b = bpe.ByteVocabulary(path_a), pieces.load(path_b)
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.a.post_processor is not None or self.a.truncation or self.a.padding:
            raise ValueError("a tokenizer without post-processor, truncation and padding is needed")
        self.width_a, self.width_b = a.width.astype(np.int64), b.text_length.astype(np.int64)
        self.bytes_a, self.bytes_b = (a.text_bytes, a.text_start), (b.text_bytes, b.text_start)
        self.is_byte = np.zeros(len(b.text), bool)
        self.is_byte[b.byte_ids] = True
        self.pairs = Pairs([x if i not in a.special.values() else b"" for i, x in enumerate(a.text)], b.text)
        self.known: dict[str, int] = {}
        self.bank: Spans | None = None
        self.names_a = [np.array([f"{i}{end}".encode() for i in range(len(a.text))], object) for end in ",|"]
        self.names_b = [np.array([f"{i}{end}".encode() for i in range(len(b.text))], object) for end in ",;"]

    def spans_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, exact byte ends (counted through all texts), and token counts of the texts."""
        ids, ends, sure, counts, shift = [], [], [], [], 0
        for text, e in zip(texts, self.a.encode_batch(texts, add_special_tokens=False)):
            own = e.ids
            span = np.fromiter(chain.from_iterable(e.offsets), np.int32, 2 * len(own))
            data = text.encode()
            if len(data) == len(text):
                place = span[1::2]
            else:
                place = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))[span[1::2]]
            ids += own
            sure.append(np.append(span[2::2] >= span[1:-1:2], True)[: len(own)])
            ends.append(place + shift)
            counts.append(len(own))
            shift += len(data)
        ids = np.array(ids, np.int32)
        return ids, refine(np.concatenate(ends).astype(np.int32), np.concatenate(sure), self.width_a[ids]), np.array(counts)

    def spans_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for texts that begin with the space that this side adds by itself."""
        ids, ends, counts, shifts, shift = [], [], [], [], 0
        for text, message in zip(texts, self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)):
            pieces_of = list(message.pieces)
            ids += [p.id for p in pieces_of]
            ends += [p.end for p in pieces_of]
            counts.append(len(pieces_of))
            shifts.append(shift + 1)
            shift += len(text.encode())
        ids, ends = np.array(ids, np.int32), np.array(ends, np.int32)
        first = np.zeros(len(ids), bool)
        first[(np.cumsum(counts) - counts)[np.array(counts) > 0]] = True
        empty = ends == np.where(first, 0, np.append(np.int32(0), ends[:-1]))  # spans follow one another: this one ends where it begins
        return ids, refine((ends + np.repeat(shifts, counts)).astype(np.int32), ~(self.is_byte[ids] & empty), self.width_b[ids]), np.array(counts)

    @staticmethod
    def spell(table: tuple[np.ndarray, np.ndarray], width: np.ndarray, ids: np.ndarray) -> np.ndarray:
        length = width[ids]
        return table[0][np.repeat(table[1][ids] - (np.cumsum(length) - length), length) + np.arange(length.sum())]

    def same_bytes(self, data: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> bool:
        return np.array_equal(self.spell(self.bytes_a, self.width_a, ids_a), data) and np.array_equal(self.spell(self.bytes_b, self.width_b, ids_b), data)


class Pairs:
    """All (A id, B id) whose tokens can end together: one's bytes end with the other's. ``of`` numbers them from 0."""

    def __init__(self, text_a: list[bytes], text_b: list[bytes]):
        by_a, by_b = defaultdict(list), defaultdict(list)
        for texts, by in ((text_a, by_a), (text_b, by_b)):
            for i, x in enumerate(texts):
                if x:
                    by[x].append(i)
        n = self.n_b = len(text_b)
        keys = {a * n + b for a, x in enumerate(text_a) for k in range(len(x)) for b in by_b.get(x[k:], ())}
        keys |= {a * n + b for b, x in enumerate(text_b) for k in range(len(x)) for a in by_a.get(x[k:], ())}
        keys = np.array(sorted(keys), np.int64)
        self.size, self.b_of = len(keys), keys % n
        self.table = Table(keys, np.arange(len(keys), dtype=np.int32))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.table.get(a.astype(np.int64) * self.n_b + b)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Which pairs have the highest count of their B id."""
        most = np.zeros(self.n_b, np.int64)
        np.maximum.at(most, self.b_of, counts)
        return counts == most[self.b_of]


def refine(ends: np.ndarray, sure: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Byte ends: as given where ``sure``, otherwise the last sure end plus the decoded bytes since."""
    if sure.all():
        return ends
    total, place = np.cumsum(width), np.arange(len(ends))
    last = np.maximum.accumulate(np.where(sure, place, -1))
    known, decoded = np.where(last >= 0, ends[last], 0), np.where(last >= 0, total[last], 0)
    return np.where(sure, ends, known + total - decoded).astype(ends.dtype)


def load(path_a: str, path_b: str) -> Both:
    return W.once(("both", path_a, path_b), lambda: Both(path_a, path_b))


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts in a row, each text with a space in front (empty ones none), and the texts' offsets."""
    texts = texts.fill_null("")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    data, offsets = W.flat(texts)
    head = np.zeros(len(data), bool)
    head[1:-1] = (data[1:-1] == 32) & (data[:-2] != 32) & FOLLOWS[data[2:]]
    at = np.flatnonzero(head)
    at = at[at >= 3]
    head[at[(data[at - 3] == MARK_BYTES[0]) & (data[at - 2] == MARK_BYTES[1]) & (data[at - 1] == MARK_BYTES[2])]] = False
    filled = np.flatnonzero(np.diff(offsets))
    head[offsets[filled + 1] - 1] = False  # a space at a text's end: what follows is another text
    head[offsets[filled]] = True
    starts = np.flatnonzero(head)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data.tobytes()))
    return found, np.searchsorted(starts, offsets)


@dataclass
class Spans:
    """Both sides' ids and byte ends (from the unit's start) of distinct units, and which units came out whole."""

    a: np.ndarray
    a_ends: np.ndarray
    a_places: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    b_places: np.ndarray
    starts: np.ndarray
    whole: np.ndarray


def pick(s: Spans, units: np.ndarray) -> Spans:
    """The spans of chosen units, in their order."""
    (a_at, a_places), (b_at, b_places) = gather(s.a_places, units), gather(s.b_places, units)
    sizes = np.diff(s.starts)[units]
    return Spans(s.a[a_at], s.a_ends[a_at], a_places, s.b[b_at], s.b_ends[b_at], b_places, np.append(0, np.cumsum(sizes)), s.whole[units])


def joined(x: Spans, y: Spans) -> Spans:
    both = lambda name: np.concatenate((getattr(x, name), getattr(y, name)))
    after = lambda name: np.concatenate((getattr(x, name), getattr(x, name)[-1] + getattr(y, name)[1:]))
    return Spans(both("a"), both("a_ends"), after("a_places"), both("b"), both("b_ends"), after("b_places"), after("starts"), both("whole"))


def encode_units(both: Both, distinct: pa.Array) -> Spans:
    """The spans of distinct units. A worker keeps those of the first ``CACHED`` units that it meets."""
    texts = distinct.to_pylist()
    place = np.fromiter((both.known.get(t, -1) for t in texts), np.int64, len(texts))
    new = np.flatnonzero(place < 0)
    fresh = _encode(both, distinct.take(pa.array(new)))
    seen = np.flatnonzero(place >= 0)
    found = fresh if not len(seen) else joined(pick(both.bank, place[seen]), fresh)
    room = min(CACHED - len(both.known), len(new))
    if room > 0:
        both.known.update((texts[i], len(both.known)) for i in new[:room].tolist())
        more = pick(fresh, np.arange(room))
        both.bank = more if both.bank is None else joined(both.bank, more)
    del texts
    return pick(found, np.argsort(np.concatenate((seen, new))))


def _encode(both: Both, distinct: pa.Array) -> Spans:
    data, starts = W.flat(distinct)
    n, sizes = len(starts) - 1, np.diff(starts)
    second = data[np.minimum(starts[:-1] + 1, len(data) - 1)] if n else data
    regular = (sizes > 1) & FOLLOWS[second] & (data[starts[1:] - 1] != 32) & ~pc.match_substring(distinct, MARK).to_numpy(zero_copy_only=False)
    order = np.concatenate((np.flatnonzero(regular), np.flatnonzero(~regular)))
    text = distinct.take(pa.array(order))
    data, starts = W.flat(text)
    many = int(regular.sum())
    edges = np.unique(np.concatenate((np.arange(0, many, TOGETHER), np.arange(many, n + 1))))
    raw = data.tobytes()
    whole = np.ones(n, bool)
    parts = []
    for k in range(0, len(edges) - 1, AT_ONCE):
        own = edges[k : k + AT_ONCE + 1]
        some = [raw[starts[i] : starts[j]].decode() for i, j in zip(own, own[1:])]
        first, last = starts[own[0]], starts[own[-1]]
        a, a_ends, a_counts = both.spans_a(some)
        b, b_ends, b_counts = both.spans_b(some)
        if not both.same_bytes(data[first:last], a, b):
            keep_a, keep_b, i, j = np.ones(len(a), bool), np.ones(len(b), bool), 0, 0
            for s, (x, y) in enumerate(zip(a_counts, b_counts)):
                if not both.same_bytes(data[starts[own[s]] : starts[own[s + 1]]], a[i : i + x], b[j : j + y]):
                    if own[s + 1] - own[s] > 1:
                        raise ValueError("the tokenizers join over unit borders")
                    whole[own[s]] = keep_a[i : i + x] = keep_b[j : j + y] = False
                i, j = i + x, j + y
            a, a_ends, b, b_ends = a[keep_a], a_ends[keep_a], b[keep_b], b_ends[keep_b]
        parts.append((a, a_ends + np.int32(first), b, b_ends + np.int32(first)))
    a, a_ends, b, b_ends = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int32)]) for i in range(4))
    del parts, raw, text
    back = np.argsort(order)  # units in the order of the dictionary again
    a_places, b_places = np.searchsorted(a_ends, starts, "right"), np.searchsorted(b_ends, starts, "right")
    if not np.array_equal(a_ends[a_places[1:][whole] - 1], starts[1:][whole]) or not np.array_equal(b_ends[b_places[1:][whole] - 1], starts[1:][whole]):
        raise ValueError("a unit does not end with a token of both sides")
    base = starts[:-1].astype(np.int32)
    a_ends, b_ends = a_ends - np.repeat(base, np.diff(a_places)), b_ends - np.repeat(base, np.diff(b_places))
    return pick(Spans(a, a_ends, a_places, b, b_ends, b_places, starts, whole), back)


def gather(places: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the items of the runs ``codes`` lie (``places``: the runs' offsets), one run after the other, and their offsets."""
    length = np.diff(places)[codes]
    total = np.append(0, np.cumsum(length))
    return np.repeat(places[codes] - total[:-1], length) + np.arange(total[-1]), total


def grouped(s: Spans) -> tuple[np.ndarray, ...]:
    """Indexes of the A and B tokens that end together, by unit, and the units' offsets among these links."""
    n = len(s.starts) - 1
    a_global = s.a_ends + np.repeat(s.starts[:-1], np.diff(s.a_places))
    b_global = s.b_ends + np.repeat(s.starts[:-1], np.diff(s.b_places))
    ends = np.zeros(s.starts[-1] + 1, bool)
    ends[a_global] = True
    in_b = np.flatnonzero(ends[b_global])
    in_a = np.searchsorted(a_global, b_global[in_b])
    return in_a, in_b, np.searchsorted(in_b, s.b_places) if n else np.zeros(1, np.int64)


def listed(both: Both, s: Spans, in_a: np.ndarray, in_b: np.ndarray) -> list[bytes]:
    """Each unit's groups as ``a1,a2|b1;a3|b2;``, with a semicolon at the end."""
    n_a, n_b = len(s.a), len(s.b)
    of_a, of_b = np.searchsorted(in_a, np.arange(n_a)), np.searchsorted(in_b, np.arange(n_b))
    before_b, through_a = np.append(0, in_b + 1), in_a + 1
    out = np.empty(n_a + n_b, object)
    last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    last_a[in_a] = last_b[in_b] = 1
    for last, names, ids, places in ((last_a, both.names_a, s.a, np.arange(n_a) + before_b[of_a]), (last_b, both.names_b, s.b, np.arange(n_b) + through_a[of_b])):
        out[places[last == 0]], out[places[last == 1]] = names[0][ids[last == 0]], names[1][ids[last == 1]]
    flat, place = out.tolist(), (s.a_places + s.b_places).tolist()
    return [b"".join(flat[i:j]) for i, j in zip(place, place[1:])]


def block(both: Both, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Spans, np.ndarray]:
    """Codes of the texts' units, the texts' offsets among them, the distinct units' spans, and which texts have tokens."""
    found, rows = units(texts)
    coded = found.dictionary_encode()
    codes, spans = coded.indices.to_numpy(), encode_units(both, coded.dictionary)
    good = (np.diff(rows) > 0) & (W.row_sums(~spans.whole[codes], rows) == 0)
    keep = np.repeat(good, np.diff(rows))
    return codes[keep], np.append(0, np.cumsum(np.where(good, np.diff(rows), 0))), spans, good


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` as c0, c1, ... with both sides' ids and byte ends (of space + text) and the offsets where both end."""
    path_a, path_b = path_a or public_tokenizers.path(bpe.MODEL), path_b or public_tokenizers.path(pieces.MODEL)
    names = ("a_ids", "a_ends", "b_ids", "b_ends", "cuts")

    def compute(batch: pa.RecordBatch, at: int) -> dict:
        both, out = load(path_a, path_b), {n: [] for n in names}
        for part in row_blocks(batch.column(at), BLOCK):
            codes, rows, s, _ = block(both, part)
            _, in_b, places = grouped(s)
            sizes = np.diff(s.starts)[codes]
            shift = np.cumsum(sizes) - sizes
            for place, columns in ((s.a_places, {"a_ids": s.a, "a_ends": s.a_ends}), (s.b_places, {"b_ids": s.b, "b_ends": s.b_ends}), (places, {"cuts": s.b_ends[in_b]})):
                index, total = gather(place, codes)
                for name, values in columns.items():
                    flat = values[index] + (0 if name.endswith("ids") else np.repeat(shift, np.diff(total)))
                    for i, j in zip(rows, rows[1:]):
                        own = flat[total[i] : total[j]]
                        out[name].append(own if name.endswith("ids") or i == j else own - shift[i])
        return {n: pa.array(v, pa.list_(pa.int32())) for n, v in out.items()}

    return append(docs, compute, ", ".join(f"{n} array<int>" for n in names), text)


def links(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links): ``links`` holds each link's pair by its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        both = load(path_a, path_b)
        for batch in batches:
            done = 0
            for part in row_blocks(batch.column("text"), BLOCK):
                codes, rows, s, good = block(both, part)
                in_a, in_b, places = grouped(s)
                names = listed(both, s, in_a, in_b)
                pairs = both.pairs.of(s.a[in_a], s.b[in_b])
                if len(pairs) and pairs.min() < 0:
                    raise ValueError("linked tokens of which neither ends with the other")
                index, total = gather(places, codes)
                digests = [hashlib.sha256(b"".join([names[c] for c in codes[i:j].tolist()])[:-1]).hexdigest() if ok else "" for ok, i, j in zip(good, rows, rows[1:])]
                n_a, n_b = W.row_sums(np.diff(s.a_places)[codes], rows), W.row_sums(np.diff(s.b_places)[codes], rows)
                columns = [
                    batch.column("doc_id").slice(done, len(part)), pa.array(n_a), pa.array(n_b), pa.array(np.diff(total[rows])), pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(total[rows].astype(np.int32)), pa.array(pairs[index])),
                ]
                done += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>")


def pair_counts(table: DataFrame, size: int) -> np.ndarray:
    """How many links of all texts each pair has: ``size`` numbers, added up in every task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["pair", "n"])

    found = table.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[found["pair"].to_numpy()] = found["n"].to_numpy()
    return total


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    path_a, path_b = path_a or public_tokenizers.path(bpe.MODEL), path_b or public_tokenizers.path(pieces.MODEL)
    table = cut_lineage(links(docs, path_a, path_b, text, key), "align-links", "zstd")
    pairs = load(path_a, path_b).pairs
    counts = pair_counts(table, pairs.size)
    values = W.share(docs.sparkSession, (counts, pairs.best(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        counts, best = values()
        for batch in batches:
            found = batch.column("links")
            own, rows = found.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(found).to_numpy()))
            new = [pa.array(np.diff(rows)), pa.array(W.row_sums(best[own].astype(np.int64), rows)), pa.array(W.row_sums(counts[own], rows))]
            kept = [batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"])

    kind = dict(table.dtypes)["doc_id"]
    out = table.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir))
