from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.plans import reprocess as R
from paperloom.plans import stream as S
from paperloom.plans.documents import build_library
from paperloom.session import shared_folder
from paperloom.sources import versions as V

SCHEMA = "doc_id bigint, uploaded_by bigint, source string, filename string, file_path string, raw_text string, created_at timestamp, file_hash string"


def docs(spark, ids, text="Invoice {} Date: 05/03/2024 Total: NIS 12.50"):
    rows = [(i, 1, "email", f"invoice_{i}.pdf", f"/f/{i}", text.format(i), dt.datetime(2024, 1, 1), f"h{i % 50}") for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


def counts(version):
    return {t: version.read(t).count() for t in ("documents", "document_facts", "hashes")}


def test_a_batch_that_is_killed_between_two_tables_is_complete_after_a_restart(spark, monkeypatch):
    folder, root, checkpoint = shared_folder(spark, "files"), shared_folder(spark, "library"), shared_folder(spark, "ingest")
    docs(spark, range(6)).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    start = lambda: S.library_stream(read(), root, checkpoint, buckets=4, blocks=64).awaitTermination()
    start()
    assert counts(V.latest(spark, root)) == {"documents": 6, "document_facts": 18, "hashes": 6}
    docs(spark, [*range(4, 10), 60]).coalesce(1).write.mode("append").parquet(folder)  # 60 has the hash of 10, 4 and 5 are known
    real, written = V._write, []

    def dies(version, change, files):
        if len(written) == 2:
            raise RuntimeError("killed")
        written.append(change.table)
        return real(version, change, files)

    monkeypatch.setattr(V, "_write", dies)
    with pytest.raises(Exception, match="killed"):
        start()
    assert counts(V.latest(spark, root)) == {"documents": 6, "document_facts": 18, "hashes": 6}  # two tables were written, none is seen
    monkeypatch.setattr(V, "_write", real)
    start()
    assert counts(V.latest(spark, root)) == {"documents": 11, "document_facts": 33, "hashes": 11}
    start()
    assert counts(V.latest(spark, root)) == {"documents": 11, "document_facts": 33, "hashes": 11}


def test_reprocessing_keeps_other_documents_and_wins_against_a_writer_of_other_buckets(spark, monkeypatch):
    root = shared_folder(spark, "library")
    blank = docs(spark, range(8), " ").select(*R.INPUT).withColumn("file_path", F.when(F.col("doc_id") != 3, F.col("file_path")))
    version = R.store_documents(R.create_library(spark, root, blank, buckets=32), blank, marker=("load", 0))
    assert R.store_documents(version, blank, marker=("load", 0)).number == version.number
    real, done = V.commit, []

    def beside(base, *args, **kwargs):
        if not done:
            done.append(1)
            R.store_documents(V.latest(spark, root), docs(spark, [500]).select(*R.INPUT))
        return real(base, *args, **kwargs)

    monkeypatch.setattr(V, "commit", beside)
    texts = docs(spark, [2, 3]).select("doc_id", "raw_text")
    after, plan = R.reprocess(spark, root, F.col("doc_id").isin(2, 3, 5), texts)
    assert {r["doc_id"]: r["plan"] for r in plan.collect()} == {2: "reprocess", 3: "skip_no_file", 5: "reprocess"}
    found = {r["doc_id"]: r["amount"] for r in after.read("documents").collect()}
    assert len(found) == 9 and float(found[2]) == 12.5 and found[3] is None and found[5] is None and float(found[500]) == 12.5
    assert {r["document_id"] for r in after.read("document_facts").collect()} == {2, 500}


def test_model_answers_by_mode(spark):
    long = "Contract between A and B. Date: 05/03/2024 Total: NIS 12.50\n" + "plain words of an agreement here.\n" * 150
    rows = [(1, "contract_1.pdf", long), (2, "contract_2.pdf", long[:300]), (3, "recipe_3.pdf", "מתכון לעוגה " + "קמח סוכר ביצים\n" * 5), (4, "contract_4.pdf", " "), (5, "contract_5.pdf", long[:300])]
    given = spark.createDataFrame([(i, 1, "email", f, t, dt.datetime(2024, 1, 1)) for i, f, t in rows], "doc_id bigint, uploaded_by bigint, source string, filename string, raw_text string, created_at timestamp")
    fact = lambda k, v, c: '{"fact_key": "%s", "fact_value": "%s", "confidence": %s}' % (k, v, c)
    answers = [
        (1, 0, f"[{fact('counterparty', 'weak', 0.4)}, {fact('obligations', 'one', 0.5)}]"), (1, 1, f"[{fact('counterparty', 'strong', 0.9)}, {fact('obligations', 'two', 0.6)}]"),
        (2, 0, f"[{fact('counterparty', 'first', 0.4)}, {fact('counterparty', 'second', 0.9)}, {fact('amount', '99', 0.9)}, {fact('nonsense', 'x', 1)}]"),
        (3, 0, '[{"recipe_name": "cake", "ingredients": "flour"}]'), (4, 0, f"[{fact('counterparty', 'ghost', 0.9)}]"), (5, 0, "[{"), (77, 0, "[]"),
    ]
    library = build_library(given, fact_answers=spark.createDataFrame(answers, "document_id bigint, chunk_id int, answer string"))
    facts = {}
    for r in library["document_facts"].collect():
        facts.setdefault(r["document_id"], {})[r["fact_key"]] = r["fact_value"]
    assert facts[1]["counterparty"] == "strong" and facts[1]["obligations"] == "one; two" and facts[1]["amount"] == "12.50"
    assert facts[2]["counterparty"] == "first" and facts[2]["amount"] == "12.50" and "nonsense" not in facts[2]
    assert facts[3]["recipe_name"] == "cake" and facts[3]["ingredients"] == "flour" and 4 not in facts
    outcomes = {r["doc_id"]: (r["outcome"]["result"], r["outcome"]["failed"]) for r in library["documents"].collect()}
    assert outcomes[5] == ("partial", "fact_extraction") and all(outcomes[i] == ("complete", "") for i in (1, 2, 3, 4))
    assert {r["document_id"]: r["counterparty"] for r in library["contracts"].collect()} == {1: "strong", 2: "first", 5: None}


def test_stored_library_leaves_no_steps_behind(spark, tmp_path, monkeypatch):
    """What the plan writes on its way, for new documents and for those that are read again, is gone when the version stands."""
    made = []

    def folder(_, purpose):
        made.append(tmp_path / f"{purpose}-{len(made)}")
        return str(made[-1])

    monkeypatch.setattr("paperloom.session.shared_folder", folder)
    kind = "doc_id long, uploaded_by long, source string, filename string, file_path string, raw_text string, created_at timestamp"
    docs = spark.createDataFrame([(i, 1, "email", f"a{i}.pdf", f"/store/{i}", f"Invoice {i} Date: 01/02/2024 Total: NIS 12.50", None) for i in range(8)], kind)
    root, cleanup = str(tmp_path / "library"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(cleanup)
    before = R.store_documents(R.create_library(spark, root, docs, buckets=2), docs)
    after, plan = R.reprocess(spark, root, F.col("doc_id") % 2 == 0)
    assert len(made) >= 2 and not any(f.exists() for f in made)
    assert before.read("documents").count() == after.read("documents").count() == 8
    assert sorted(r.doc_id for r in plan.collect()) == [0, 2, 4, 6]
    assert spark.conf.get(cleanup) == was
