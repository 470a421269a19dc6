from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.sources import extractors as X

SCHEMA = "doc_id bigint, path string, doc_type string, content binary"


class Broken(X.Extractor):
    def process_batch(self, files):
        return []


class Absent(X.Extractor):
    def available(self):
        return False

    def process(self, file):
        raise AssertionError("must not be called")


class Counting(X.Extractor):
    """Gives text for files that say so, and shows how many it got at once."""

    def process_batch(self, files):
        assert len(files) <= 2
        return [X.Extraction(f.content.decode(), 0.7, "counted", 3, "en", {"k": "v"}, [[["a", "b"]]]) if f.content.startswith(b"ok") else KeyError("x") for f in files]


def files(spark):
    rows = [(1, "/a.txt", "other", bytearray(b"ok one")), (2, "/b.txt", None, bytearray(b"bad")), (3, "/c.html", "other", bytearray(b"<p>A &amp;  b</p><script>x</script>")), (4, None, None, None), (5, "/e.txt", "other", bytearray(b"\xff\xfe"))]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_tries_in_order(spark):
    order = F.array(F.lit("absent"), F.lit("unknown"), F.lit("broken"), F.lit("counting"), F.lit("markup"), F.lit("plain"))
    used = {"absent": Absent(), "broken": Broken(), "counting": Counting(), "markup": X.Markup(), "plain": X.PlainText()}
    tries = {(r["doc_id"], r["processor"]): r for r in X.candidates(files(spark), used, order, batch=2).collect()}
    assert {k[1] for k in tries} == {"broken", "counting", "markup", "plain"}
    assert all(tries[i, "broken"]["error"] == "ValueError: 0 results for 2 files" or i == 5 for i in range(1, 6))
    first = tries[1, "counting"]
    assert (first["raw_text"], first["page_count"], first["entities"], first["tables"], first["error"]) == ("ok one", 3, {"k": "v"}, [[["a", "b"]]], None)
    assert (1, "markup") not in tries and tries[2, "counting"]["error"].startswith("KeyError")
    assert tries[3, "markup"]["raw_text"] == "A & b" and (3, "plain") not in tries
    assert tries[5, "plain"]["error"].startswith("UnicodeDecodeError")
    best = {r["doc_id"]: (r["processor"], r["outcome"]) for r in X.extract_texts(files(spark), used, order).collect()}
    assert best[1][1] == "accepted" and best[3] == ("markup", "accepted") and best[2] == ("plain", "accepted")
    assert best[4] == best[5] == ("fallthrough", "all_failed")


def test_no_files_and_no_extractors(spark):
    assert X.extract_texts(files(spark).limit(0), {"plain": X.PlainText()}).collect() == []
    assert {r["outcome"] for r in X.extract_texts(files(spark), {}).collect()} == {"all_failed"}
