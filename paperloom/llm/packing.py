"""Best-fit packing of token sequences through a configuration linear program.

Documents are tokenized (each distinct word of a block once: the tokenizer drops white space and never joins over it) and
only longer ones are cut into pieces of ``CAPACITY``. What the plan needs is the histogram of piece lengths, at most
``CAPACITY`` numbers however large the corpus. On it the driver solves the configuration linear program: minimise the
number of sequences so that the chosen configurations (multisets of lengths that fit) cover every length's count.
Multiplicative weights price the lengths; each round's best configuration comes from a knapsack dynamic program over
lengths rounded up to ``GRAIN``. The fractional solution is rounded down, short lengths are left out of the program, and
these together with what rounding left over go best-fit, longest first, into the room that the configurations leave.

Pieces take places by their rank among the pieces of their length: counted per task while tokenizing, plus the counts of
earlier tasks, so no length is ever gathered or sorted. Null text: the end id only. Repeated rows: packed each. Only
doc_id and text are read.
"""
from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.frames import documents
from paperloom.llm.pieces import row_blocks
from paperloom.session import cut_lineage

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END = 1
BLOCK = 12 << 20
CACHED = 300_000  # words whose ids a worker keeps
TOGETHER = 128  # words to a text
GRAIN = 16  # lengths are rounded up to this in the program
SHORT = 16  # lengths up to capacity / SHORT fill gaps instead
STEP = 0.3
ROUNDS = 2500
PIECES = "piece int, start long, length long, ids_crc32 long, part int, place long"


def load(path: str):
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return W.once(("tokenizer", path), make)


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of all texts, each word's code, and the texts' offsets among the words."""
    data, offsets = W.flat(texts)
    block = W.cut(0, data, offsets)
    place = np.append(0, np.cumsum(block.ends - block.starts))
    found = pa.LargeStringArray.from_buffers(len(block.starts), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data[~W.SEPARATOR[data]].tobytes()))
    coded = found.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), block.word_offsets


def encode_words(tokenizer, words: list[str]) -> list[bytes]:
    """Each word's ids as 32-bit numbers. Many words go to the library as one text, which costs half of a call per word: white
    space is dropped and never joined over, and the tokens' character offsets tell whose they are."""
    out: list[bytes] = []
    texts = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
    for own, e in zip(texts, tokenizer.encode_batch([" ".join(t) for t in texts], add_special_tokens=False)):
        firsts = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
        ends = np.cumsum([len(w) + 1 for w in own])
        places = (4 * np.append(0, np.searchsorted(firsts, ends, "left"))).tolist()
        ids = np.array(e.ids, np.uint32).tobytes()
        out += [ids[a:b] for a, b in zip(places, places[1:])]
    return out


def token_ids(tokenizer, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in a row, each followed by ``end``, and the texts' offsets."""
    words, codes, rows = distinct_words(texts)
    known = W.once(("words", tokenizer), dict)
    lists = [known.get(w) for w in words]
    new = [i for i, x in enumerate(lists) if x is None]
    for k in range(0, len(new), 20_000):
        part = new[k : k + 20_000]
        for i, ids in zip(part, encode_words(tokenizer, [words[i] for i in part])):
            lists[i] = ids
    for i in new[: max(0, CACHED - len(known))]:
        known[words[i]] = lists[i]
    width = np.array([len(x) // 4 for x in lists], np.int64)
    ids = np.frombuffer(b"".join(lists), np.uint32)
    own = width[codes]
    total = np.append(0, np.cumsum(own))
    flat = ids[np.repeat((np.cumsum(width) - width)[codes] - total[:-1], own) + np.arange(total[-1])] if len(codes) else ids
    offsets = total[rows] + np.arange(len(rows))
    out = np.full(offsets[-1], end, np.uint32)
    inner = np.ones(len(out), bool)
    inner[offsets[1:] - 1] = False
    out[inner] = flat
    return out, offsets


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place[, ids]): ``place`` counts the pieces of a length in a task."""
    path = path or public_tokenizers.path(TOKENIZER)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            done = 0
            for texts in row_blocks(batch.column("text"), BLOCK):
                ids, offsets = token_ids(load(path), texts)
                count = -(-np.diff(offsets) // capacity)
                row = np.repeat(np.arange(len(texts)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(np.diff(offsets)[row] - start, capacity)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
                heads = np.flatnonzero(first)
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(ranked)) - np.repeat(heads, np.diff(np.append(heads, len(ranked)))) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                at = (offsets[row] + start).tolist()
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist())]
                columns = [
                    batch.column("doc_id").take(pa.array(row + done)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                    pa.array(np.full(len(row), part, np.int32)), pa.array(place),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                done += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, {PIECES}" + ", ids array<int>" * with_ids)


def knapsack(values: np.ndarray) -> tuple[float, dict[int, int]]:
    """The most valuable multiset of sizes 1 ... n (values[size]) of total size n at most: its value, size -> copies."""
    n = len(values) - 1
    best, choice = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for c in range(1, n + 1):
        gains = best[c - 1 :: -1] + values[1 : c + 1]
        k = int(gains.argmax())
        best[c], choice[c] = (gains[k], k + 1) if gains[k] > best[c - 1] else (best[c - 1], 0)
    taken: dict[int, int] = defaultdict(int)
    c = n
    while c:
        taken[int(choice[c])] += 1
        c -= int(choice[c]) or 1
    taken.pop(0, None)
    return float(best[n]), dict(taken)


def configurations(demand: np.ndarray, step: float = STEP, rounds: int = ROUNDS) -> dict[tuple, float]:
    """A fractional cover of ``demand`` (by size) with configurations of total size len(demand) - 1: configuration -> times."""
    sizes = np.flatnonzero(demand)
    times: dict[tuple, float] = defaultdict(float)
    if not len(sizes):
        return {}
    weight, covered = np.ones(len(demand)), np.zeros(len(demand))
    goal = max(1.0, np.log(len(sizes)) / step)
    for _ in range(rounds):
        values = np.zeros(len(demand))
        values[sizes] = weight[sizes] / demand[sizes]
        _, taken = knapsack(values)
        often = min(demand[s] / k for s, k in taken.items())
        times[tuple(sorted(taken.items(), reverse=True))] += often
        for s, k in taken.items():
            share = often * k / demand[s]
            covered[s] += share
            weight[s] *= np.exp(-step * share)
        if covered[sizes].min() >= goal:
            break
    least = covered[sizes].min() or 1.0
    return {c: x / least for c, x in times.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple]]:
    """Groups of equal sequences: (how many, ((length, copies), ...)); every piece of the histogram has one place."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    demand = np.zeros(capacity // GRAIN + 1)
    sized = -(-np.arange(capacity + 1) // GRAIN)
    for length in range(capacity // SHORT + 1, capacity + 1):
        if sized[length] < len(demand):
            demand[sized[length]] += left[length]
    open_bins: dict[int, list] = defaultdict(list)  # room left -> [how many, contents]
    current = {s: min(capacity, s * GRAIN) for s in range(len(demand))}  # next length to hand out of a size

    def hand_out(size: int) -> tuple[int, int]:
        while sized[current[size]] == size and not left[current[size]]:
            current[size] -= 1
        length = current[size]
        return (length, int(left[length])) if sized[length] == size and length > capacity // SHORT else (0, 0)

    for taken, x in sorted(configurations(demand).items(), key=lambda t: -t[1]):
        copies = int(min([x, *(demand[s] // k for s, k in taken)]))
        for s, k in taken:
            demand[s] -= copies * k
        while copies:
            contents, n = [], copies
            for s, k in taken:  # as many sequences as get the same exact lengths; a size may change length within one
                need = k
                while need:
                    length, there = hand_out(s)
                    if there >= need * n or there >= need:
                        n = min(n, there // need)
                        use = need
                    else:
                        n, use = 1, there
                    contents.append((length, use))
                    left[length] -= use
                    need -= use
            for length, use in contents:  # one copy of each is taken so far
                left[length] -= use * (n - 1)
            open_bins[capacity - sum(a * b for a, b in contents)].append((n, tuple(contents)))
            copies -= n
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity) if open_bins.get(r)), 0)
            if not room:
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    open_bins[capacity - each * length].append((full, ((length, each),)))
                if rest:
                    open_bins[capacity - rest * length].append((1, ((length, rest),)))
                break
            count, contents = open_bins[room].pop()
            each = min(room // length, n)
            used = min(count, n // each)
            if used < count:
                open_bins[room].append((count - used, contents))
            open_bins[room - each * length].append((used, (*contents, (length, each))))
            n -= used * each
    return [group for room in sorted(open_bins) for group in open_bins[room]]


def _places(groups: list[tuple[int, tuple]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (first rank, sequence of it, copies per sequence, offset) by length, and each length's first row."""
    rows: dict[int, list] = defaultdict(list)
    rank, sequence = np.zeros(capacity + 1, np.int64), 0
    for count, contents in groups:
        offset = 0
        for length, copies in contents:
            rows[length].append((rank[length], sequence, copies, offset))
            rank[length] += count * copies
            offset += length * copies
        sequence += count
    table = [r for length in range(capacity + 1) for r in rows[length]]
    heads = np.cumsum([0] + [len(rows[length]) for length in range(capacity + 1)])
    return np.array(table, np.int64).reshape(-1, 4), heads


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (from ``pieces``, read several times: give a written table) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    counts = cut_lineage(found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(_places(plan(histogram, capacity), capacity))  # bounded by the plan, not by the rows
    ranked = found.join(shifts.hint("merge"), ["part", "length"]).withColumn("sequence_id", F.col("place") + F.col("shift")).drop("shift", "place", "part")
    schema = ranked.withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        table, heads = shared.value
        # one increasing key for (length, first rank), so that one search finds every row
        lengths = np.repeat(np.arange(capacity + 1), np.diff(heads))
        keys = lengths.astype(np.float64) * 2.0**40 + table[:, 0] if len(table) else np.zeros(0)
        for batch in batches:
            rank, length = batch.column("sequence_id").to_numpy(), batch.column("length").to_numpy()
            row = np.searchsorted(keys, length.astype(np.float64) * 2.0**40 + rank, "right") - 1
            first, sequence, copies, offset = table[row].T
            nth = rank - first
            at = batch.schema.get_field_index("sequence_id")
            out = batch.set_column(at, "sequence_id", pa.array(sequence + nth // copies))
            yield out.append_column("offset", pa.array(offset + length * (nth % copies)))

    return ranked.mapInArrow(run, schema)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(cut_lineage(pieces(docs, path, capacity, with_ids), "packing-pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
