"""Repeated passages, by an anchored exact index of word windows over the whole corpus.

Every window of ``SIZE`` words that starts in an earlier document (smaller doc_id) as well is a hit. Hits that overlap or
touch are joined to one factor, whose words go. This is not a Lempel-Ziv parse: no place in a reference is kept, so the
hits of one factor may come from different documents. The words removed are those of all hits, exact to the word. The
index is cut into blocks by hash; each window's hash names the one block that can hold it.

Not every window is looked up. A window's anchor is the least hash of its ``GRAM``-word grams, so equal windows have equal
anchors, and a run of windows shares one. Round 1 indexes the anchors (about a fifth of the words) and keeps those that
occur in two documents or more. Round 2 indexes the windows with such an anchor, by 128 bits, and answers with the least
doc_id of each. Both rounds work on chunks of ``BLOCK`` bytes of text: a chunk sends each block one row with its
distinct hashes, packed, so a passage of a million documents costs a block one entry per chunk. Blocks grow in number
with the corpus, not in size, and are small enough for a worker even if every window occurs twice. Chunks are stored in
small row groups, since readers hold a whole one.

Null text has no words. A null doc_id is neither earlier nor later than any: nothing of it goes, and nothing goes because
of it. Rows with equal doc_id do not count as earlier than each other. Texts are judged on the input. Long texts: memory
follows the longest. Further columns, whatever their names, pass through.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.frames import documents, restore
from paperloom.llm.pieces import row_blocks
from paperloom.session import cut_lineage, drop_table

SIZE = 13
GRAM = 4
BLOCK = 2 << 20
INDEX_BYTES = 8 << 20  # of text; where all of it comes twice, each of its words is an entry of 25 bytes in round 2
INDEX_BLOCKS = 64
# a row holds up to ``BLOCK`` bytes of text: the writer looks at its size after each, not after a hundred
SMALL_GROUPS = {"parquet.block.size": str(4 * BLOCK), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
ENTRIES = "part int, chunk long, keys binary, seconds binary, least binary, many binary"


def chunks(docs: DataFrame, text: str) -> DataFrame:
    """One row per chunk: its number, and each column of ``docs`` as an array."""
    at = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    fields = ", ".join(f"c{i} array<{kind}>" for i, (_, kind) in enumerate(docs.dtypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            row = 0
            for texts in row_blocks(batch.column(at), BLOCK):
                part = batch.slice(row, len(texts))
                row += len(texts)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays([c])) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists], names=["chunk", *batch.schema.names])
                chunk += 1

    return plain.mapInArrow(run, f"chunk long, {fields}")


class Windows:
    """A chunk's words, and its windows: first word, hash, anchor and document."""

    def __init__(self, texts: pa.Array, ids: pa.Array):
        data, offsets = W.flat(texts)
        self.block = W.cut(0, data, offsets)
        hashes = W.hash_spans(data, self.block.starts, self.block.ends)
        grams = W.grams(hashes, GRAM)
        n = max(0, len(hashes) - SIZE + 1)
        anchor = grams[:n].copy()
        for k in range(1, SIZE - GRAM + 1):
            np.minimum(anchor, grams[k : k + n], out=anchor)
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        rows = self.block.word_rows()[:n]
        self.at = np.flatnonzero(W.in_row(self.block.word_offsets, SIZE, len(hashes)) & named[rows])
        self.anchor, self.doc, self.hashes = anchor[self.at], ids[rows[self.at]], hashes

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the chosen windows, in two halves."""
        first, second = W.grams(self.hashes, SIZE), W.grams(W.mix(self.hashes ^ _SECOND), SIZE)
        return first[self.at[chosen]], second[self.at[chosen]]


def _grouped(keys: np.ndarray, seconds: np.ndarray | None, *columns: np.ndarray) -> tuple:
    """Order by key (and second half), the heads of equal keys, and the columns in that order."""
    order = np.argsort(keys, kind="stable") if seconds is None else np.lexsort((seconds, keys))
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if seconds is not None:
        seconds = seconds[order]
        new[1:] |= seconds[1:] != seconds[:-1]
    return order, np.flatnonzero(new), keys, seconds, *(c[order] for c in columns)


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value for each stretch between two cuts, which cover ``values``."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, end to end, and how many each row has; copied only where they lie in several batches."""
    parts, counts = [], []
    for a in table.column(name).chunks:
        offsets = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_binary(a.type) else np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
        counts.append(np.diff(offsets) // np.dtype(kind).itemsize)
        if offsets[-1] > offsets[0]:
            parts.append(np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind))
    values = parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, kind), *parts])
    return values, np.concatenate([np.zeros(0, np.int64), *counts])


def _entries(chunk: int, keys: np.ndarray, seconds: np.ndarray | None, docs: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row per index block: the chunk's distinct keys in it, with their least doc_id and whether another one has them too."""
    _, heads, keys, seconds, docs = _grouped(keys, seconds, docs)
    least, most = (np.minimum.reduceat(docs, heads), np.maximum.reduceat(docs, heads)) if len(heads) else (docs, docs)
    keys, seconds = keys[heads], None if seconds is None else seconds[heads]
    part = ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)  # keys ascend, so parts do
    cuts = np.searchsorted(part, np.arange(parts + 1))
    used = np.flatnonzero(np.diff(cuts))
    of = lambda v: _packed(v, np.append(cuts[used], len(keys)))
    return pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), chunk, np.int64)), of(keys), of(seconds) if seconds is not None else pa.nulls(len(used), pa.binary()), of(least), of((least < most).astype(np.uint8))],
        names=["part", "chunk", "keys", "seconds", "least", "many"],
    )


def _index(table: pa.Table) -> pa.Table:
    """One index block: to each chunk those of its keys that an earlier or later document holds, with the least doc_id."""
    W.lean()
    keys, counts = _unpacked(table, "keys", np.uint64)
    seconds = _unpacked(table, "seconds", np.uint64)[0]
    chunks = table.column("chunk").to_numpy()
    row = np.repeat(np.arange(len(chunks), dtype=np.int32), counts)
    _, heads, keys, seconds, row, least, many = _grouped(keys, seconds if len(seconds) else None, row, _unpacked(table, "least", np.int64)[0], _unpacked(table, "many", np.uint8)[0])
    sizes = np.diff(np.append(heads, len(keys)))
    first = np.minimum.reduceat(least, heads)
    # anchors: wherever two documents meet; windows: only for chunks that hold a later document
    if seconds is None:
        hit = np.flatnonzero(np.repeat((first < np.maximum.reduceat(least, heads)) | (np.maximum.reduceat(many, heads) > 0), sizes))
    else:
        first = np.repeat(first, sizes)
        hit = np.flatnonzero((first < least) | (many > 0))
    order = hit[np.argsort(chunks[row[hit]], kind="stable")]
    names, cuts = np.unique(chunks[row[order]], return_index=True)
    cuts = np.append(cuts, len(order))
    of = lambda v: _packed(v[order], cuts)
    nothing = pa.nulls(len(names), pa.binary())
    return pa.table({"chunk": pa.array(names, pa.int64()), "keys": of(keys), "seconds": nothing if seconds is None else of(seconds), "least": nothing if seconds is None else of(first)})


FOUND = "chunk long, keys binary, seconds binary, least binary"


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return _unpacked(table, name, kind)[0]


def factors(found: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(first word, end) of each run of found windows that overlap or touch, from their first words, by row."""
    if not len(found):
        return np.zeros((0, 2), np.int64)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] > found[:-1] + SIZE) | (rows[1:] != rows[:-1])  # a factor that ends where the next starts grows on
    heads = np.flatnonzero(new)
    return np.stack([found[heads], found[np.append(heads[1:], len(found)) - 1] + SIZE], axis=1)


def _cut(windows: Windows, answers: pa.Table) -> dict:
    """The texts without their factors, and what was removed."""
    keys, seconds, least = (_joined(answers, n, t) for n, t in (("keys", np.uint64), ("seconds", np.uint64), ("least", np.int64)))
    order, _, keys, seconds, least = _grouped(keys, seconds, least)
    block, n = windows.block, len(windows.block.starts)
    hit = np.zeros(len(windows.at), bool)
    if len(keys):
        first, second = windows.keys(np.arange(len(windows.at)))
        place = np.searchsorted(keys, first)
        todo = np.arange(len(first))
        while len(todo):  # equal first halves, if any, lie side by side
            p = np.minimum(place[todo], len(keys) - 1)
            same = (place[todo] < len(keys)) & (keys[p] == first[todo])
            match = same & (seconds[p] == second[todo])
            hit[todo[match]] = least[p[match]] < windows.doc[todo[match]]
            todo = todo[same & ~match]
            place[todo] += 1
    starts = windows.at[hit]
    rows = block.word_rows()
    spans = factors(starts, rows[starts])
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, spans[:, 0], 1)
    np.add.at(change, spans[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    kept = np.flatnonzero(~gone)
    # bytes of kept words, and one space after each but the last kept of a row
    edge = np.zeros(len(block.data) + 1, np.int32)
    edge[block.starts[kept]] += 1
    edge[block.ends[kept]] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    own = rows[kept]
    follow = kept[:-1][own[1:] == own[:-1]] if len(kept) else kept
    mask, data = inside, block.data.copy()
    mask[block.ends[follow]] = True
    data[block.ends[follow]] = 32
    places = np.concatenate(([0], np.cumsum(mask)))[block.offsets]
    texts = pa.LargeStringArray.from_buffers(block.n, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data[mask].tobytes())).cast(pa.string())
    own = rows[spans[:, 0]]
    local = spans - block.word_offsets[own][:, None]
    offsets = np.searchsorted(own, np.arange(block.n + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(local[:, 0].astype(np.int32)), pa.array(local[:, 1].astype(np.int32))], names=["start", "end"])
    return {
        "n_words": pa.array(np.diff(block.word_offsets).astype(np.int64)), "n_removed": pa.array(W.row_sums(gone, block.word_offsets)), "kept_text": texts,
        "removed": pa.ListArray.from_arrays(pa.array(offsets), pairs),
    }


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` as c0, c1, ... with n_words, n_removed, kept_text (kept words, one space between) and removed (word spans)."""
    spark, names = docs.sparkSession, docs.columns
    at, of = f"c{names.index(text)}", f"c{names.index(key)}"
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(INDEX_BLOCKS, -(-size // INDEX_BYTES))
    stored = cut_lineage(chunks(docs, text), "substring-chunks", "zstd", SMALL_GROUPS, 2 * BLOCK)

    def windows(row: pa.Table | pa.RecordBatch, i: int = 0) -> Windows:
        return Windows(pa.array(row.column(at)[i].values), row.column(of)[i].values)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                w = windows(batch, i)
                new = np.ones(len(w.anchor), bool)
                new[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1])
                yield _entries(chunk, w.anchor[new], None, w.doc[new], parts)

    shared = stored.select("chunk", at, of).mapInArrow(anchors, ENTRIES).groupBy("part").applyInArrow(_index, FOUND)
    shared = cut_lineage(shared, "substring-anchors", "zstd", batch_bytes=2 * BLOCK)

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        W.lean()
        w = windows(left)
        chosen = np.flatnonzero(np.isin(w.anchor, _joined(right, "keys", np.uint64)))
        first, second = w.keys(chosen)
        return pa.Table.from_batches([_entries(left.column("chunk")[0].as_py(), first, second, w.doc[chosen], parts)])

    asked = stored.select("chunk", at, of).groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(candidates, ENTRIES)
    answers = cut_lineage(asked.groupBy("part").applyInArrow(_index, FOUND), "substring-windows", "zstd", batch_bytes=2 * BLOCK)
    drop_table(shared)
    columns = [f"c{i}" for i in range(len(names))]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        W.lean()
        found = _cut(windows(left), right)
        return pa.table({c: left.column(c).combine_chunks().flatten() for c in columns} | found)

    fields = ", ".join(f"{c} {kind}" for c, (_, kind) in zip(columns, docs.dtypes))
    return stored.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        cut, f"{fields}, n_words long, n_removed long, kept_text string, removed array<struct<start: int, end: int>>"
    )


def keep_rest(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages: changed texts become their kept words, those with no word left go."""
    found, names = dedup(docs), docs.columns
    text = F.col(f"c{names.index('text')}")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(text)}
    if "n_chars" in names:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"c{names.index('n_chars')}"))
    return restore(names, found.where(~changed | (F.col("n_removed") < F.col("n_words"))), new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("c0").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  g AS (SELECT doc_id, unnest(range(1, len(ws) - {SIZE - 2})) AS i, ws FROM w WHERE len(ws) >= {SIZE}),
  s AS (SELECT doc_id, i, array_to_string(ws[i:i + {SIZE - 1}], ' ') AS t FROM g),
  m AS (SELECT t, min(doc_id) AS least FROM s GROUP BY t),
  r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SIZE})) AS p FROM s JOIN m USING (t) WHERE least < doc_id),
  q AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(array_to_string(list_filter(ws, lambda x, k: NOT list_contains(coalesce(gone, []::BIGINT[]), k)), ' ')) AS kept_sha256
  FROM w LEFT JOIN q ON w.doc_id = q.doc_id"""
