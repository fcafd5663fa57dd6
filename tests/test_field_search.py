"""Sprints over sets of fields, with swarms that are dropped while they run."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.field_search import FieldSearch
from tidemark.operators.search import Choice, Range, best


@pytest.mark.parametrize("slow", [False, True])
def test_sprints_expand_and_drop_sets(spark, slow):
    """a is good, b helps it, c is poor; while c's second generation runs (for a minute), a's first result puts it out."""
    calls = {}

    @F.udf("double")
    def waits(x, seconds):
        time.sleep(seconds)
        return x

    def score(fields, candidates):
        n = calls[fields] = calls.get(fields, 0) + 1
        error = F.lit(10.0 if "a" not in fields else 2.0) - (1.0 if "b" in fields else 0.0) + (F.abs(F.col("a__x") - 5) / 10 if "a" in fields else 0)
        if fields == ("c",):
            error = F.lit(9.9)
        if slow and (fields, n) in ((("a",), 1), (("c",), 2)):
            error = waits(error, F.lit(6.0 if fields == ("a",) else 60.0))
        return candidates.coalesce(1).select("candidate", error.alias("error")) if not slow else candidates.coalesce(1).select("candidate", F.when(F.col("candidate") == 0, error).otherwise(F.lit(9.95) if fields == ("c",) else error if fields != ("a",) else F.lit(2.5)).alias("error"))

    variables = {"a": {"x": Range(0, 10)}, "b": {"m": Choice((1, 2))}, "c": {"m": Choice((1, 2, 3, 4, 5))}}
    search = FieldSearch(variables, base=10.5, particles=3, generations=3, sprints=3, window=5)
    began = time.time()
    found = search.run(spark, score)
    assert time.time() - began < 55
    rows = found.collect()
    assert {r["fields"] for r in rows if r["sprint"] == 0} <= {"a", "b", "c"} and "a,b" in {r["fields"] for r in rows if r["sprint"] == 1}
    top = found.orderBy("error", "candidate").first()
    assert top["fields"] in ("a,b", "a,b,c") and best(found).first()["candidate"] == top["candidate"]
    events = {(e["sprint"], e["fields"], e["event"]) for e in search.log}
    if slow:
        assert (0, "c", "cancelled") in events
    assert not any(e["event"] == "failed" for e in search.log)


def test_a_score_that_fails_fails_the_search(spark):
    def score(fields, candidates):
        raise ValueError("no score")

    with pytest.raises(ValueError, match="no score"):
        FieldSearch({"a": {"x": Range(0, 1)}}, 1.0, 2, 1).run(spark, score)
