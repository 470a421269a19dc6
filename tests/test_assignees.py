from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import access as A

MEMBERS = [(1, "Dana Levi", True), (2, "Noa Levi", True), (3, "Noa", True), (4, "Omer", False), (5, "dana cohen", True), (6, None, True)]
ASKED = {1: "Noa", 2: "levi", 3: "cohen", 4: "omer", 5: " ", 6: None, 7: "ana l", 8: "DANA LEVI", 9: "nobody of that name"}


def test_names_by_substrings_without_broadcast(spark):
    """Substrings of all lengths that are asked for; their table is never broadcast, however small the members' file is."""
    members = spark.createDataFrame(MEMBERS, "member_id long, name string, is_active boolean")
    found = A.resolve_assignees(spark.createDataFrame(list(ASKED.items()), "request_id long, person string"), members)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.request_id: (r.member_id, r.outcome) for r in found.collect()} == {
        1: (3, "exact"), 2: (None, "ambiguous"), 3: (5, "partial"), 4: (None, "not_found"), 5: (None, "unspecified"), 6: (None, "unspecified"), 7: (1, "partial"),
        8: (1, "exact"), 9: (None, "not_found"),
    }


def test_only_lengths_that_are_asked_for(spark):
    lengths = F.array(F.lit(2), F.lit(30), F.lit(0))
    assert sorted(spark.range(1).select(A._substrings(F.lit("abab"), lengths).alias("s")).first()["s"]) == ["ab", "ba"]
