from __future__ import annotations

import base64
import random
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import tiktoken

from paperloom.llm import rollup
from paperloom.session import shared_folder

SCHEMA = "op string, seq int, doc_id long, source string, lang string, tokenizer string, n_tokens long"


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def play(state, rows):
    last = {}
    for op, seq, d, source, lang, tok, n in rows:
        rank = (seq, op == "delete", n or 0, source or "", lang or "")
        if (d, tok) not in last or rank > last[(d, tok)][0]:
            last[(d, tok)] = (rank, op, source, lang, n or 0)
    for (d, tok), (_, op, source, lang, n) in last.items():
        state.pop((d, tok), None)
        if op != "delete":
            state[(d, tok)] = (source, lang, n)


def summed(state):
    docs, tokens = Counter(), Counter()
    for (_, tok), (source, lang, n) in state.items():
        docs[(source, lang, tok)] += 1
        tokens[(source, lang, tok)] += n
    return {k: (docs[k], tokens[k]) for k in docs}


def test_random_batches(spark):
    rng = random.Random(7)
    store, state = rollup.Rollup(spark, shared_folder(spark, "rollup-test")), {}
    assert totals(store) == {}
    for batch in range(5):
        rows = [
            (rng.choice(["insert", "delete", "revise"]), rng.randrange(3), rng.choice([None, *range(12)]), rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["t/1", "t/2"]), rng.choice([None, 0, 5, 70]))
            for _ in range(25)
        ]
        frame = spark.createDataFrame(rows, SCHEMA)
        assert store.commit(batch, frame)
        play(state, rows)
        assert totals(store) == summed(state)
        assert not store.commit(batch, frame) and totals(store) == summed(state)
        if batch == 2:
            store.compact()
            assert totals(store) == summed(state)
    assert store.commit(9, spark.createDataFrame([], SCHEMA)) and totals(store) == summed(state)


def test_an_unfinished_batch_is_written_anew(spark):
    store = rollup.Rollup(spark, shared_folder(spark, "rollup-test"))
    rows = spark.createDataFrame([("insert", 0, 1, "a", "en", "t", 4)], SCHEMA)
    rows.selectExpr("doc_id").write.parquet(f"{store.folder}/deltas/batch=0")
    fs, path = store._fs()
    fs.delete(path(f"{store.folder}/deltas/batch=0/_SUCCESS"), False)
    assert store.committed() == []
    assert store.commit(0, rows) and totals(store) == {("a", "en", "t"): (1, 4)}


def test_query(spark, sf):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(rollup.TOKENIZER), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    first = {}
    for r in rows:
        first[r["text"]] = min(r["doc_id"], first.get(r["text"], r["doc_id"]))
    state = {}
    for r in rows:
        if first[r["text"]] == r["doc_id"]:
            text = "\n".join(dict.fromkeys((r["text"] or "").split("\n")))
            state[(r["doc_id"], rollup.VERSION)] = (r["source"], r["lang"], len(encode(text)))
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.query(spark, sf).collect()}
    assert got == summed(state)


def test_batches_in_any_order(spark):
    """Late batches, also after a compaction: the totals are those of all batches in the order of their ids."""
    rng = random.Random(11)
    store, committed = rollup.Rollup(spark, shared_folder(spark, "rollup-test")), {}
    for step, batch in enumerate([3, 0, 5, 1, 2, 4]):
        rows = [
            (rng.choice(["insert", "delete", "revise"]), 0, rng.choice([None, *range(15)]), rng.choice(["a", "b", None]), "en", "t", rng.choice([None, 10, 20, 30]))
            for _ in range(12)
        ]
        assert store.commit(batch, spark.createDataFrame(rows, SCHEMA))
        committed[batch] = rows
        state = {}
        for b in sorted(committed):
            play(state, committed[b])
        assert totals(store) == summed(state)
        if step in (2, 4):
            store.compact()
            assert totals(store) == summed(state)
    store.compact()
    assert totals(store) == summed(state) and all(n >= 0 and t >= 0 for n, t in totals(store).values())


def test_a_small_batch_reads_its_own_buckets(spark):
    store = rollup.Rollup(spark, shared_folder(spark, "rollup-test"))
    many = spark.range(500).selectExpr("'insert' op", "0 seq", "id doc_id", "'a' source", "'en' lang", "'t' tokenizer", "1L n_tokens", "'extra' present")
    assert store.commit(0, many) and totals(store) == {("a", "en", "t"): (500, 500)}
    plan = store.entries([3, 9])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and store.entries([3, 9]).count() < 60
    assert store.commit(1, spark.createDataFrame([("delete", 0, 7, None, None, "t", None)], SCHEMA)) and totals(store) == {("a", "en", "t"): (499, 499)}
