from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq

from paperloom.llm import neardup
from paperloom.llm.components import components
from tests.llm import brute


def hexed(df):
    return sorted(((r.doc_id, f"{r.fingerprint & (2**64 - 1):016x}", r.component_id) for r in df.collect()), key=str)


def test_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    rows += [(900_000, None), (900_001, ""), (900_002, " \n"), (None, None), (None, rows[0][1]), rows[3], (900_003, "one"), (900_004, "One  two"), (900_005, "ONE two")]
    rows += [(900_010 + k, rows[5][1] + f" tail{k}") for k in range(4)] + [(None, "nobody else has this text")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, fingerprint int")
    assert hexed(neardup.near_duplicates(docs)) == sorted(brute.near_components(rows), key=str)
    empty = neardup.near_duplicates(docs.limit(0))
    assert empty.count() == 0 and neardup.keep_first(docs.limit(0)).count() == 0


def test_split_shards_lose_no_link(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(15)} | {(1 << k) for k in range(64)} | {0}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    found = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    whole = {tuple(r) for r in components(neardup.links(found)).collect()}
    split = {tuple(r) for r in components(neardup.links(found, shard=5)).collect()}
    label = {v: v for v in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert whole == split == {(v, r) for v, r in label.items() if v != r}


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    members = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64) & np.uint64(0xFFFF))
    found = {(int(a), int(b)) for q, n in neardup.search(members, neardup.bk_tree(members), members, 2, 50) for a, b in zip(q, n)}
    assert found == {(i, j) for i in range(len(members)) for j in range(len(members)) if int(members[i] ^ members[j]).bit_count() <= 2}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(3, text), (2, text), (2, text), (9, "other words here"), (None, text)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, component_id string")
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 9), (True, None)]


def test_unrelated_texts_that_share_a_doc_id_all_stay(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(80)) for c in "abc")
    # 5 names two groups; in a third group it is not the least; 7 has two spellings of one text and a copy
    rows = [(5, one, "x"), (5, two, "x"), (8, one, "x"), (9, two, "x"), (4, three, "x"), (5, three, "x"), (7, "Some other Words", "x"), (7, "some other words", "x"), (7, "some other words", "x"), (1, None, "x"), (1, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first_id string").withColumnRenamed("first_id", "digest").selectExpr("*", "1 AS first_id", "2 AS root")
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    assert found == sorted([(5, one), (5, two), (4, three), (7, "some other words"), (1, "")])
