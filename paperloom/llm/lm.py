"""Scoring texts with a hierarchical Pitman-Yor language model.

Restaurants: one per previous word (or a text's start). Its parent is that of the word's last two bytes, whose parent is that of
its last byte, whose parent is the root over all words; the root's base measure is uniform over the vocabulary and one unknown
word. Customers are all training tokens.

Seating is sampled by Gibbs. A dish's customers at one restaurant leave and take seats again one after another, given all
other dishes' tables and the parent's probability; tables become the parent's customers. Up to ``EXACT`` customers of a
dish draw one by one, later ones in blocks of an eighth of those seated, at the probability of the block's middle. Draws
come from hashes of (word, restaurant, sweep, step), so a task that runs again draws the same. Dishes are spread by word:
all dishes of a word sit in one task, and the tasks of a pass share the table totals of the pass before. Passes: totals
of the first seating, one table a dish; totals after some sweeps; totals of each kept sample; probabilities, averaged over the
samples with exactly those totals.

Texts are encoded in chunks of ``BLOCK`` bytes, kept as numbers of the chunk's words. A chunk sends one row per part of the
words (counts by previous word), which pre-aggregates the corpus before its only shuffle by word. The parts' dishes are written
once, in a table bucketed by part, so that the passes shuffle totals only; it also keeps which dish each entry of a chunk is, and so
a chunk gets the probabilities of its (previous word, word) pairs back in its own order. What is kept or sent is packed in byte planes.
Words are known by 64-bit hashes; a previous word by 48 bits of its hash beside its ending. Previous words are as many as the
vocabulary, so their totals are added up in a shuffle by previous word, and each part of the words gets back those it asked
for. The driver holds totals by ending only.

Null text is empty: the end token only. Null doc_id: scored, neither held out nor learned from. Repeated rows: all learned
from and scored. Long texts: memory follows the longest. Only doc_id and text are read.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.frames import documents
from paperloom.llm.pieces import row_blocks
from paperloom.session import SHUFFLE_CLEANUP, cut_lineage, drop_table, shared_folder

BLOCK = 12 << 20
ENDINGS = 1 << 16
BURN_IN = 2
SAMPLES = 3
EXACT = 8
DISCOUNT = (0.6, 0.7, 0.8, 0.7)  # root, last byte, last two bytes, previous word
STRENGTH = (10.0, 5.0, 5.0, 2.0)
PART = 3 << 20  # tokens whose words are seated at once, on average
PLACES = 258 * 256  # of totals: two-byte endings, last bytes, then the root and the number of known words
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64((32 << 8 | 32) << 48 | 0x14057B7EF767)  # the context at a text's start; no word ends in spaces
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def ending_of(context: np.ndarray) -> np.ndarray:
    return (context >> np.uint64(48)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 below 2^64, compressed byte plane by byte plane."""
    values = np.ascontiguousarray(values.astype("<u8", copy=False))
    planes = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T[:planes])
    return len(values).to_bytes(8, "little") + bytes([planes]) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n, planes = int.from_bytes(packed[:8], "little"), packed[8]
    out = np.zeros((n, 8), np.uint8)
    if planes:
        out[:, :planes] = np.frombuffer(pa.Codec("zstd").decompress(packed[9:], n * planes), np.uint8).reshape(planes, n).T
    return out.reshape(-1).view("<u8")


def pack_steps(values: np.ndarray) -> bytes:
    """Mostly ascending numbers by their differences, modulo 2^64."""
    values = values.astype(np.uint64, copy=False)
    return pack(np.concatenate((values[:1], values[1:] - values[:-1])))


def unpack_steps(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=np.uint64)


def encode_words(texts: pa.Array) -> dict:
    """Tokens of a chunk as indices into its distinct words, which are ordered by hash; each word's ending as a context."""
    data, offsets = W.flat(texts)
    block = W.cut(0, W.LOWER[data], offsets)
    lengths = np.diff(block.word_offsets) + 1
    is_word = np.ones(int(lengths.sum()), bool)
    is_word[np.cumsum(lengths) - 1] = False
    hashes = np.full(len(is_word), END)
    hashes[is_word] = W.hash_spans(block.data, block.starts, block.ends)
    word, token = np.unique(hashes, return_inverse=True)
    ending = np.zeros(len(word), np.uint16)
    if len(block.starts):
        last = block.data[block.ends - 1].astype(np.uint16)
        before = np.where(block.ends - block.starts > 1, block.data[np.maximum(block.ends - 2, 0)], 32).astype(np.uint16)
        ending[token[is_word]] = last << 8 | before
    return {"lengths": lengths, "token": token, "word": word, "word_ending": ending}


def previous(token: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each token's context: 0 for a text's start, else the word before and 1."""
    before = np.empty(len(token), np.int64)
    before[1:] = token[:-1] + 1
    before[np.cumsum(lengths) - lengths] = 0
    return before


def contexts_of(word: np.ndarray, ending: np.ndarray) -> np.ndarray:
    return np.concatenate(([START], ending.astype(np.uint64) << np.uint64(48) | word >> np.uint64(16)))


def entries(x: dict, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct (word, previous word) pairs in this order: offsets by word, contexts, and training tokens."""
    n, lengths = len(x["word"]), x["lengths"]
    keys = (x["token"] * np.int64(n + 1) + previous(x["token"], lengths)) << 1 | np.repeat(learn, lengths)
    keys.sort()
    pair = keys >> 1
    heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)])
    counts = np.add.reduceat(keys & 1, heads) if len(heads) else keys
    pair = pair[heads]
    return np.searchsorted(pair, np.arange(n + 1) * (n + 1)), contexts_of(x["word"], x["word_ending"])[pair % (n + 1)], counts


def encode_chunk(texts: pa.Array, learn: np.ndarray) -> dict:
    """A chunk's tokens, words and (word, previous word) pairs, ordered by word."""
    x = encode_words(texts)
    places, context, counts = entries(x, learn)
    return x | {"places": places, "context": context, "ending": ending_of(context).astype(np.uint16), "counts": counts}


def encode(docs: DataFrame, learn: F.Column, held_out: F.Column) -> DataFrame:
    """One row per chunk: its documents, their tokens, its words, and the numbers of its training tokens and of all its tokens."""
    kind = dict(docs.dtypes)["doc_id"]
    plain = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(held_out, F.lit(False)).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            row = 0
            for texts in row_blocks(batch.column("text"), BLOCK):
                part = batch.slice(row, len(texts))
                row += len(texts)
                x = encode_words(texts)
                learned = int(x["lengths"][part.column("learn").to_numpy(zero_copy_only=False)].sum())
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk], pa.int64()), one(part.column("doc_id")), one(part.column("held_out")), one(part.column("learn")),
                        *(pa.array([v], pa.binary()) for v in (pack(x["lengths"]), pack(x["token"]), pack_steps(x["word"]), pack(x["word_ending"]))),
                        pa.array([learned], pa.int64()), pa.array([len(x["token"])], pa.int64()),
                    ],
                    names=["chunk", "doc_ids", "held_out", "learn", "lengths", "token", "word", "ending", "tokens", "size"],
                )
                chunk += 1

    return plain.mapInArrow(
        run,
        f"chunk long, doc_ids array<{kind}>, held_out array<boolean>, learn array<boolean>, lengths binary, token binary, word binary, ending binary, tokens long, size long",
    )


def _times(constant: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(constant) * n & (1 << 64) - 1)


def draw(key: np.ndarray, step: int) -> np.ndarray:
    return (W.mix(key + _times(_GOLD, step + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
    """Draws by inversion; beyond a variance of 30 by the normal distribution."""
    u = draw(key, step)
    out = (u < p).astype(np.int64)  # n = 1
    if n.max(initial=0) <= 1:
        return out
    spread = n * p * (1 - p)
    small = np.flatnonzero((n > 1) & (spread <= 30))
    if len(small):
        # count the rarer outcome, so that the first probability does not vanish
        m, flip = n[small].astype(float), p[small] > 0.5
        q = np.where(flip, 1 - p[small], p[small])
        term = (1 - q) ** m
        total, k, v = term.copy(), np.zeros(len(small)), u[small]
        go = (v > total) & (k < m)
        while go.any():
            k[go] += 1
            term[go] *= (m[go] - k[go] + 1) / k[go] * q[go] / (1 - q[go])
            total[go] += term[go]
            go &= (v > total) & (k < m) & (term > 1e-18)
        out[small] = np.where(flip, m - k, k).astype(np.int64)
    large = np.flatnonzero((n > 1) & (spread > 30))
    if len(large):
        second = draw(key[large] ^ np.uint64(0xA5A5A5A5A5A5A5A5), step)
        normal = np.sqrt(-2 * np.log(np.maximum(u[large], 1e-300))) * np.cos(2 * np.pi * second)
        out[large] = np.clip(np.rint(n[large] * p[large] + np.sqrt(spread[large]) * normal), 0, n[large]).astype(np.int64)
    return out


def seat(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, strength: float, key: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers sat down anew; ``others``: the restaurant's tables with other dishes."""
    tables = (customers > 0).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    seated, step = np.ones(len(live), np.int64), 0
    while len(live):
        block = np.minimum(np.maximum(1, seated // EXACT), customers[live] - seated)
        middle, at = (block - 1) / 2, tables[live].astype(float)
        for _ in range(2 if middle.any() else 1):  # the second time with the tables expected in the middle of the block
            new = (strength + discount * (others[live] + at)) * parent[live]
            chance = new / (new + seated + middle - discount * at)
            at = tables[live] + middle * chance
        tables[live] += binomial(block, chance, key[live], step)
        seated += block
        more = seated < customers[live]
        live, seated, step = live[more], seated[more], step + 1
    return tables


class Totals:
    """Customers and tables of the restaurants by ending: arrays for last two bytes and last byte, numbers for the root."""

    def __init__(self, customers: tuple, tables: tuple):
        self.customers, self.tables = customers, tables


def probability(level: int, customers, tables, all_customers, all_tables, parent):
    d, s = DISCOUNT[level], STRENGTH[level]
    return (np.maximum(customers - d * tables, 0) + (s + d * all_tables) * parent) / (s + all_customers)


class Dishes:
    """The dishes of some whole words: (word, ending) and (word, last byte) pairs, and the words."""

    def __init__(self, word: np.ndarray, ending: np.ndarray, customers: np.ndarray, keys: np.ndarray):
        """word: index per dish, ascending; ending; training tokens; keys: the hash of each word."""
        self.word, self.ending, self.c2, self.keys = word, ending, customers, keys
        fine = word * 256 + (ending >> 8)
        self.fine, self.up = np.unique(fine, return_inverse=True)
        self.byte, self.of = self.fine % 256, self.fine // 256
        self.k2 = W.mix(keys[word] + ending.astype(np.uint64) * _GOLD)
        self.k1 = W.mix(keys[self.of] ^ (self.byte.astype(np.uint64) + np.uint64(1 << 40)))
        self.t2, self.c1, self.t1, self.c0, self.t0 = self._start()

    def _start(self) -> tuple:
        t2 = (self.c2 > 0).astype(np.int64)
        c1 = np.bincount(self.up, t2, len(self.fine)).astype(np.int64)
        t1 = (c1 > 0).astype(np.int64)
        c0 = np.bincount(self.of, t1, len(self.keys)).astype(np.int64)
        return t2, c1, t1, c0, (c0 > 0).astype(np.int64)

    def chances(self, at: Totals, base: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p0 = probability(0, self.c0, self.t0, at.customers[0], at.tables[0], base)
        p1 = probability(1, self.c1, self.t1, at.customers[1][self.byte], at.tables[1][self.byte], p0[self.of])
        p2 = probability(2, self.c2, self.t2, at.customers[2][self.ending], at.tables[2][self.ending], p1[self.up])
        return p0, p1, p2

    def sweep(self, at: Totals, base: float, number: int, above: tuple | None = None) -> None:
        """``above``: the chances at the root and by last byte, if they are known."""
        shift = _times(np.uint64(0xD6E8FEB86659FD93), number + 1)
        p0, p1 = above or self.chances(at, base)[:2]
        less = lambda all_tables, own: np.maximum(all_tables - own, 0)
        self.t2 = seat(self.c2, p1[self.up], less(at.tables[2][self.ending], self.t2), DISCOUNT[2], STRENGTH[2], self.k2 + shift)
        self.c1 = np.bincount(self.up, self.t2, len(self.fine)).astype(np.int64)
        self.t1 = seat(self.c1, p0[self.of], less(at.tables[1][self.byte], self.t1), DISCOUNT[1], STRENGTH[1], self.k1 + shift)
        self.c0 = np.bincount(self.of, self.t1, len(self.keys)).astype(np.int64)
        self.t0 = seat(self.c0, np.full(len(self.keys), base), less(at.tables[0], self.t0), DISCOUNT[0], STRENGTH[0], self.keys + shift)


class Pairs:
    """The dishes of some whole words at the restaurants of previous words, over the ``Dishes`` that their tables are served from."""

    def __init__(self, word: np.ndarray, at: np.ndarray, customers: np.ndarray, contexts: np.ndarray, keys: np.ndarray):
        """word: index per pair, ascending; at: its context, ascending in a word; training tokens; the contexts, ascending; the words' hashes."""
        self.at, self.c3, self.contexts, self.word = at, customers, contexts, word
        self.t3 = (customers > 0).astype(np.int64)
        below = word * np.int64(ENDINGS) + ending_of(contexts)[at]
        heads = np.concatenate(([True], below[1:] != below[:-1]))[: len(below)]
        self.up = np.cumsum(heads) - 1
        first = np.flatnonzero(heads)
        self.dishes = Dishes(word[first], below[first] % ENDINGS, np.bincount(self.up, self.t3, len(first)).astype(np.int64), keys)
        self.live = np.flatnonzero(customers > 1)  # a lone customer always has a table
        self.k3 = W.mix(keys[word[self.live]] ^ W.mix(contexts[at[self.live]]))

    def sweep(self, at: Totals, tables: np.ndarray, base: float, number: int) -> None:
        """``tables``: of each context's restaurant."""
        live, shift = self.live, _times(np.uint64(0xD6E8FEB86659FD93), number + 1)
        p0, p1, p2 = self.dishes.chances(at, base)
        parent = p2[self.up[live]]
        others = np.maximum(tables[self.at[live]] - self.t3[live], 0)
        self.t3[live] = seat(self.c3[live], parent, others, DISCOUNT[3], STRENGTH[3], self.k3 + shift)
        self.dishes.c2 = np.bincount(self.up, self.t3, len(self.dishes.c2)).astype(np.int64)
        self.dishes.sweep(at, base, number, (p0, p1))

    def chances(self, at: Totals, customers: np.ndarray, tables: np.ndarray, base: float) -> np.ndarray:
        return probability(3, self.c3, self.t3, customers[self.at], tables[self.at], self.dishes.chances(at, base)[2][self.up])

    def by_context(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.contexts)
        return np.bincount(self.at, self.c3, n).astype(np.int64), np.bincount(self.at, self.t3, n).astype(np.int64)

    def by_ending(self) -> np.ndarray:
        """Customers and tables by place; the number of known words behind the root."""
        d, out = self.dishes, np.zeros((2, PLACES))
        for own, (two, one, root) in zip(out, ((d.c2, d.c1, d.c0), (d.t2, d.t1, d.t0))):
            own[:ENDINGS], own[ENDINGS : ENDINGS + 256], own[ENDINGS + 256] = np.bincount(d.ending, two, ENDINGS), np.bincount(d.byte, one, 256), root.sum()
        out[0, ENDINGS + 257] = (d.c0 > 0).sum()
        return out


def _turn(context: np.ndarray) -> np.ndarray:
    """A context with its hash before its ending: the order of the words' hashes."""
    return context << np.uint64(16) | context >> np.uint64(48)


def _asked(chunks: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, words, sizes, contexts, counts): a chunk's distinct words in the part and their entries, in the chunk's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, token = (unpack(batch.column(c)[i].as_py()).astype(np.int64) for c in ("lengths", "token"))
                x = {"lengths": lengths, "token": token, "word": unpack_steps(batch.column("word")[i].as_py()), "word_ending": unpack(batch.column("ending")[i].as_py())}
                places, context, counts = entries(x, batch.column("learn")[i].values.to_numpy(zero_copy_only=False))
                at = ((x["word"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ascending, as the hashes
                found = np.unique(at)
                cuts = list(zip(np.searchsorted(at, found), np.searchsorted(at, found, "right")))
                sizes, blob = np.diff(places), lambda f, v: pa.array([f(v(a, b)) for a, b in cuts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.astype(np.int32)), pa.array([batch.column("chunk")[i].as_py()] * len(found), pa.int64()), blob(pack_steps, lambda a, b: x["word"][a:b]),
                        blob(pack, lambda a, b: sizes[a:b]), blob(pack, lambda a, b: context[places[a] : places[b]]), blob(pack, lambda a, b: counts[places[a] : places[b]]),
                    ],
                    names=["part", "chunk", "words", "sizes", "contexts", "counts"],
                )

    return chunks.select("chunk", "lengths", "learn", "token", "word", "ending").mapInArrow(
        run, "part int, chunk long, words binary, sizes binary, contexts binary, counts binary"
    )


def _all(rows: pa.Table, column: str, read=unpack) -> tuple[np.ndarray, np.ndarray]:
    """The rows' numbers after one another, and the rows' offsets."""
    values = [read(x.as_py()) for x in rows.column(column)]
    return np.concatenate(values), np.concatenate(([0], np.cumsum([len(x) for x in values])))


SEATS = "part int, keys binary, contexts binary, pairs binary, customers binary, chunks array<long>, entries array<binary>, words array<binary>"


def _merge(rows: pa.Table) -> pa.Table:
    """A part's words, contexts and (word, context) pairs with their customers, each ascending; of each chunk's entries and
    words those that they are, pairs being numbered by word and turned context there."""
    W.lean()
    words, word_ends = _all(rows, "words", unpack_steps)
    keys, row_word = np.unique(words, return_inverse=True)
    context, ends = _all(rows, "contexts")
    turned, at = np.unique(_turn(context), return_inverse=True)
    n = len(turned)
    pair, entry_pair = np.unique(np.repeat(row_word, _all(rows, "sizes")[0].astype(np.int64)) * np.int64(n) + at, return_inverse=True)
    customers = np.bincount(entry_pair, _all(rows, "counts")[0], len(pair)).astype(np.int64)
    contexts = turned >> np.uint64(16) | turned << np.uint64(48)
    order, rank = np.argsort(contexts), np.empty(n, np.int64)
    rank[order] = np.arange(n)
    pair = pair - pair % n + rank[pair % n]
    by_pair = np.argsort(pair)
    blobs = [pack_steps(keys), pack_steps(contexts[order]), pack_steps(pair[by_pair]), pack(customers[by_pair])]
    cut = lambda values, at: pa.array([[pack_steps(values[a:b]) for a, b in zip(at[:-1], at[1:])]], pa.list_(pa.binary()))
    return pa.table(
        [
            rows.column("part").combine_chunks()[:1], *(pa.array([x], pa.binary()) for x in blobs), pa.array([rows.column("chunk").to_pylist()], pa.list_(pa.int64())),
            cut(entry_pair, ends), cut(row_word, word_ends),
        ],
        names=["part", "keys", "contexts", "pairs", "customers", "chunks", "entries", "words"],
    )


def _kept_by_part(merged: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """``merged`` as a table bucketed by part, which groups by part without another shuffle, and the table's name."""
    spark = merged.sparkSession
    name, path = f"lm_seats_{uuid.uuid4().hex}", shared_folder(spark, "lm-seats")
    spark.sql(f"CREATE TABLE {name} ({SEATS}) USING parquet CLUSTERED BY (part) INTO {parts} BUCKETS LOCATION '{path}'")
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        merged.write.insertInto(name)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.table(name), name


def _pairs(table: pa.Table) -> Pairs:
    """The pairs of a part's row."""
    one = {c: table.column(c)[0].as_py() for c in ("keys", "contexts", "pairs", "customers")}
    contexts, pair = unpack_steps(one["contexts"]), unpack_steps(one["pairs"]).astype(np.int64)
    return Pairs(pair // len(contexts), pair % len(contexts), unpack(one["customers"]).astype(np.int64), contexts, unpack_steps(one["keys"]))


def _by_bucket(contexts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts' order by bucket, and the buckets' offsets in it."""
    bucket = ((contexts & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def _given(reply: pa.Table, contexts: np.ndarray, parts: int) -> np.ndarray:
    """What the shuffle by previous word gave back for the contexts: customers, then the tables of each sample."""
    reply = reply.sort_by("bucket")
    order, _ = _by_bucket(contexts, parts)
    rows = [unpack(x.as_py()).astype(np.int64) for x in reply.column("sums")]
    kept = reply.column("kept")[0].as_py() if len(reply) else 1
    out = np.empty((1 + kept, len(contexts)), np.int64)
    out[:, order] = np.concatenate([x.reshape(1 + kept, -1) for x in rows], axis=1)
    return out


SENT = "bucket int, part int, kept int, contexts binary, sums binary"


def _add_up(rows: pa.Table) -> pa.Table:
    """A bucket's totals: by place (buckets below zero) one row of sums; by previous word every part's own contexts' sums."""
    W.lean()
    sums = [unpack(x.as_py()).astype(np.int64) for x in rows.column("sums")]
    if rows.column("bucket")[0].as_py() < 0:
        return rows.slice(0, 1).set_column(4, "sums", pa.array([pack(np.sum(sums, axis=0))], pa.binary()))
    contexts = [unpack_steps(x.as_py()) for x in rows.column("contexts")]
    kept = rows.column("kept")[0].as_py()
    at = np.unique(np.concatenate(contexts), return_inverse=True)[1]
    flat = np.concatenate([x.reshape(1 + kept, -1) for x in sums], axis=1)
    totals = np.stack([np.bincount(at, x).astype(np.int64)[at] for x in flat])
    ends = np.cumsum([len(x) for x in contexts])
    own = [pack(totals[:, end - len(x) : end].reshape(-1)) for x, end in zip(contexts, ends)]
    return rows.set_column(3, "contexts", pa.nulls(len(rows), pa.binary())).set_column(4, "sums", pa.array(own, pa.binary()))


def _seating(seats: DataFrame, before: DataFrame | None, at: Totals | None, base: float, kept: int, parts: int) -> tuple[DataFrame, list[Totals], int]:
    """Totals of the last ``kept`` sweeps by previous word (one row per part and bucket) and by ending, and the number of
    known words; without totals ``before``: those of the first seating."""
    shared = W.share(seats.sparkSession, at)

    def send(part: int, pairs: Pairs, samples: list) -> pa.Table:
        order, places = _by_bucket(pairs.contexts, parts)
        own = np.stack([pairs.by_context()[0], *(tables for tables, _ in samples)])[:, order]
        contexts = pairs.contexts[order]
        cuts = list(zip(places[:-1], places[1:]))
        ending = np.stack([x for _, x in samples]).astype(np.int64).reshape(len(samples), 2, -1, 256)
        blocks = np.flatnonzero(ending.any(axis=(0, 1, 3)))
        return pa.table(
            {
                "bucket": pa.array([*range(parts), *(-1 - blocks).tolist()], pa.int32()), "part": pa.array([part] * (parts + len(blocks)), pa.int32()),
                "kept": pa.array([len(samples)] * (parts + len(blocks)), pa.int32()),
                "contexts": pa.array([pack_steps(contexts[a:b]) for a, b in cuts] + [None] * len(blocks), pa.binary()),
                "sums": pa.array([pack(own[:, a:b].reshape(-1)) for a, b in cuts] + [pack(ending[:, :, b].reshape(-1)) for b in blocks], pa.binary()),
            }
        )

    def first(rows: pa.Table) -> pa.Table:
        W.lean()
        pairs = _pairs(rows)
        return send(rows.column("part")[0].as_py(), pairs, [(pairs.by_context()[1], pairs.by_ending())])

    def again(rows: pa.Table, reply: pa.Table) -> pa.Table:
        W.lean()
        pairs, samples = _pairs(rows), []
        tables = _given(reply, pairs.contexts, parts)[1]
        for sweep in range(BURN_IN + kept):
            pairs.sweep(shared(), tables, base, sweep)
            if sweep >= BURN_IN:
                samples.append((pairs.by_context()[1], pairs.by_ending()))
        return send(rows.column("part")[0].as_py(), pairs, samples)

    own = seats.select("part", "keys", "contexts", "pairs", "customers").groupBy("part")
    sent = own.applyInArrow(first, SENT) if before is None else own.cogroup(_replies(before, parts)).applyInArrow(again, SENT)
    found = cut_lineage(sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_add_up, SENT), "lm-totals", "uncompressed")
    sums = np.zeros((kept, 2, PLACES // 256, 256))
    for r in found.filter("bucket < 0").select("bucket", "sums").collect():  # places only, a fixed number
        sums[:, :, -1 - r["bucket"]] = unpack(r["sums"]).reshape(kept, 2, 256)
    sums = sums.reshape(kept, 2, PLACES)
    cut = lambda x: (x[ENDINGS + 256], x[ENDINGS : ENDINGS + 256], x[:ENDINGS])
    return found, [Totals(cut(c), cut(t)) for c, t in sums], int(sums[0, 0, ENDINGS + 257])


def _replies(totals: DataFrame, parts: int):
    return totals.filter("bucket >= 0").select("part", "bucket", "kept", "sums").repartition(parts, "part").groupBy("part")


def _answers(seats: DataFrame, before: DataFrame, start: Totals, totals: DataFrame, samples: list[Totals], base: float, parts: int) -> DataFrame:
    """(chunk, part, known, chances): training tokens of a chunk's words, and the averaged probability of each of its entries."""
    shared = W.share(seats.sparkSession, (start, samples))

    def run(rows: pa.Table, reply: pa.Table) -> pa.Table:
        W.lean()
        first, kept = shared()
        pairs = _pairs(rows)
        old = pc.equal(reply.column("old"), True)
        tables = _given(reply.filter(old), pairs.contexts, parts)[1]
        given = _given(reply.filter(pc.invert(old)), pairs.contexts, parts)
        total = np.zeros(len(pairs.c3))
        for sweep in range(BURN_IN + len(kept)):
            pairs.sweep(first, tables, base, sweep)
            if sweep >= BURN_IN:
                total += pairs.chances(kept[sweep - BURN_IN], given[0], given[1 + sweep - BURN_IN], base)
        known = np.bincount(pairs.word, pairs.c3, len(pairs.dishes.keys)).astype(np.int64)
        rank = np.empty(len(pairs.contexts), np.int64)
        rank[np.argsort(_turn(pairs.contexts))] = np.arange(len(rank))
        chance = (total / len(kept)).astype(np.float32)[np.argsort(pairs.word * len(rank) + rank[pairs.at])].view(np.uint32)
        row = {c: rows.column(c)[0].as_py() for c in ("part", "chunks", "entries", "words")}
        number = lambda x: unpack_steps(x).astype(np.int64)
        return pa.table(
            [
                pa.array(row["chunks"], pa.int64()), pa.array([row["part"]] * len(row["chunks"]), pa.int32()),
                pa.array([pack(known[number(x)]) for x in row["words"]], pa.binary()), pa.array([pack(chance[number(x)]) for x in row["entries"]], pa.binary()),
            ],
            names=["chunk", "part", "known", "chances"],
        )

    both = before.withColumn("old", F.lit(True)).unionByName(totals.withColumn("old", F.lit(False))).filter("bucket >= 0")
    replies = both.select("part", "bucket", "kept", "sums", "old").repartition(parts, "part").groupBy("part")
    return seats.groupBy("part").cogroup(replies).applyInArrow(run, "chunk long, part int, known binary, chances binary")


def score(docs: DataFrame, learn: F.Column, held_out: F.Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    spark = docs.sparkSession
    chunks = cut_lineage(encode(docs, learn, held_out), "lm-chunks", "zstd")
    sizes = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    tokens, parts = sizes["tokens"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes["size"] // PART))
    seats, table = _kept_by_part(_asked(chunks, parts).repartition(parts, "part").groupBy("part").applyInArrow(_merge, SEATS), parts)
    first, (rough,), known = _seating(seats, None, None, 1.0, 1, parts)
    base = 1 / (known + 1)
    before, (start,), _ = _seating(seats, first, rough, base, 1, parts)
    drop_table(first)
    totals, samples, _ = _seating(seats, before, start, base, SAMPLES, parts)
    answers = cut_lineage(_answers(seats, before, start, totals, samples, base, parts), "lm-answers", "uncompressed")
    for done in (before, totals, seats):
        drop_table(done)
    spark.sql(f"DROP TABLE {table}")

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        W.lean()
        right = right.sort_by("part")
        chances = _all(right, "chances")[0].astype(np.uint32).view(np.float32)
        count = _all(right, "known")[0].astype(np.int64)
        logs = np.log10(np.maximum(chances.astype(np.float64), 1e-300))
        flat = np.log10((count + 0.1) / (tokens + 0.1 * (known + 1)))
        row = left.slice(0, 1).combine_chunks()
        lengths, word = (unpack(row.column(c)[0].as_py()).astype(np.int64) for c in ("lengths", "token"))
        pair = np.unique(word * np.int64(len(count) + 1) + previous(word, lengths), return_inverse=True)[1]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        summed = lambda values: np.add.reduceat(values, offsets[:-1])  # noqa: E731  every text has its end token
        return pa.table(
            {
                "doc_id": row.column("doc_ids").chunk(0).flatten(), "held_out": row.column("held_out").chunk(0).flatten(), "n_tokens": lengths,
                "n_known": summed((count[word] > 0).astype(np.int64)), "base_score": summed(flat[word]), "score": summed(logs[pair]),
            }
        )

    own = chunks.select("chunk", "doc_ids", "held_out", "lengths", "token")
    rated = own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return rated.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    return score(documents(spark, sf_dir).select("doc_id", "text"), fold != 0, fold == 0)
