from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from paperloom.llm import packing, pii, quality
from paperloom.llm.frames import documents
from tests.llm import brute
from tests.llm.test_packing import PATH
from tests.llm.test_substring import expected


def test_stages_equal_brute_force(spark, sf):
    docs = documents(spark, sf)
    source = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "personal_data", "best_fit_packing"]

    good = stages["quality_rules"](spark, docs, sf)
    kept = {r.doc_id for r in quality.query(spark, sf).where("kept").collect()}
    rows = {r.doc_id: r for r in good.collect()}
    assert good.columns == docs.columns and set(rows) == kept and all(rows[d].asDict() == source[d] for d in kept)

    unique = stages["near_duplicates"](spark, good, sf)
    groups = brute.near_components([(d, source[d]["text"]) for d in sorted(kept)])
    firsts = sorted({c for _, _, c in groups})
    found = {r.doc_id: r for r in unique.collect()}
    assert unique.columns == docs.columns and sorted(found) == firsts and all(found[d].asDict() == source[d] for d in firsts)

    fresh = stages["repeated_passages"](spark, unique, sf)
    want = {}
    for d, (n, own) in zip(firsts, expected([(d, source[d]["text"]) for d in firsts])):
        if own or not n:
            want[d] = source[d]["text"] if len(own) == n else " ".join(own)
    found = {r.doc_id: r for r in fresh.collect()}
    assert fresh.columns == docs.columns and {d: r.text for d, r in found.items()} == want and all(r.n_chars == len(r.text) for r in found.values())

    clean = stages["personal_data"](spark, fresh, sf)
    models = pii.train(pii.examples(fresh))
    found = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and len(found) == len(want)
    for d, text in want.items():
        assert found[d].text == pii.redacted(text, pii.find(text, models)[1]) and found[d].n_chars == len(found[d].text) and not pii.base_spans(found[d].text)

    packed = stages["best_fit_packing"](spark, clean, sf).collect()
    assert {r.doc_id for r in packed} == set(want)


def test_run(spark, sf):
    rows = entry.queries()["pipeline"](spark, sf).collect()
    assert rows and "pipeline" not in entry.oracle_sql()
    ends = Counter()
    for r in rows:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= packing.CAPACITY


def test_last_stage_gives_the_training_sequences(spark, sf):
    docs = documents(spark, sf)
    rows = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, sf).collect()
    tokenizer, own, filled = Tokenizer.from_file(PATH), {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        own.setdefault(r.doc_id, []).extend(r.ids)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in docs.collect():
        assert own[r.doc_id] == [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14))


def test_no_rows(spark, sf):
    docs = documents(spark, sf).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
