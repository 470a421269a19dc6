from __future__ import annotations

import hashlib
import random

import pytest

from paperloom.sources import files as S


def test_stubs_of_files_hold_no_file_in_memory(spark, tmp_path):
    """Hash and leading bytes come from streams: no content is read, whatever a file's size, and the stubs are those of the content."""
    made = {"a b.bin": b"\x89PNG\r\n\x1a\n" + random.Random(5).randbytes(300_000), "scan": b"%PDF-1.7 x", "short.TXT": b"\xff", "ü%20.docx": b"\n" * 70_000, "left.out": b"1"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "10")
    try:
        stubs = S.document_stubs(S.read_files(spark, str(tmp_path), "*[!t]"))
        facts = stubs.drop("content")
        assert "content" not in facts._jdf.queryExecution().executedPlan().toString().partition("ReadSchema")[2]
        got = {r.filename: r for r in facts.collect()}
        with pytest.raises(Exception, match="(?i)max length|exceeds"):
            stubs.collect()
    finally:
        spark.conf.unset(limit)
    assert {n: (r.file_hash, r.length) for n, r in got.items()} == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in made.items() if not n.endswith("t")}
    assert {n: r.extension for n, r in got.items()} == {"a b.bin": ".png", "scan": ".pdf", "short.TXT": ".txt", "ü%20.docx": ".docx"}
    files = S.read_files(spark, str(tmp_path)).select("path", "content")
    plain = {r.filename: (r.extension, r.file_hash) for r in S.document_stubs(files).collect()}
    assert {n: (r.extension, r.file_hash) for n, r in got.items()} == {n: v for n, v in plain.items() if not n.endswith("t")}
