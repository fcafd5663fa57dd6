"""Results that must not depend on how rows are dealt, on reused exchanges or on adaptive plans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import maths, text
from tidemark.operators import knn, knn_join, profile, ranking


@pytest.fixture(params=[True, False])
def plans(spark, request):
    names = ["spark.sql.exchange.reuse", "spark.sql.adaptive.enabled"]
    for n in names:
        spark.conf.set(n, str(request.param).lower())
    yield
    for n in names:
        spark.conf.unset(n)


def test_numeric_profiles_of_columns_together(spark, plans, monkeypatch):
    """Places in sorted lists, found in several rounds of brackets; heavy ties, far tails, missing values."""
    monkeypatch.setattr(profile, "FEW", 40)
    monkeypatch.setattr(profile, "PARTS", 8)
    rng = np.random.default_rng(1)
    columns = {"a": rng.permutation(3000) * 1.5, "b": np.round(rng.standard_normal(3000) * 3), "c": 10.0 ** rng.uniform(-200, 200, 3000), "d": np.where(rng.random(3000) < 0.6, 7.0, rng.random(3000))}
    rows = [tuple(None if rng.random() < 0.05 else float(v[i]) for v in columns.values()) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(7)
    got = {r["field"]: r for r in profile.numeric_profiles(df, list(columns)).collect()}
    for i, c in enumerate(columns):
        x = sorted(r[i] for r in rows if r[i] is not None)
        r, n = got[c], len(x)
        assert (r["n"], r["distinct"], r["min"], r["max"], r["median"], r["p1"], r["p99"]) == (n, len(set(x)), x[0], x[-1], x[int(n * 0.5)], x[int(n * 0.01)], x[int(n * 0.99)])
        assert r["mean"] == pytest.approx(sum(x) / n) and r["mean_step"] == pytest.approx((x[-1] - x[0]) / (len(set(x)) - 1))
    assert profile.numeric_profiles(df.limit(0), ["a"]).count() == 0


def test_places_and_running_sums(spark, plans):
    df = spark.range(0, 4000, 1, 9).select(F.pmod(F.xxhash64("id"), F.lit(70)).alias("x"), "id")
    got = [(r["x"], r["id"]) for r in ranking.with_places(df, [F.desc("x"), F.col("id")]).orderBy("place").collect()]
    assert got == sorted(((r["x"], r["id"]) for r in df.collect()), key=lambda r: (-r[0], r[1]))


def test_roc_over_all_rows_and_by_group(spark, plans):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(rng.random() < s / 30), float(s)) for g, s in zip(rng.integers(0, 3, 900), rng.integers(0, 30, 900))]
    df = spark.createDataFrame(rows, "g long, truth int, score double")
    area = lambda some: np.mean([(p > q) + (p == q) / 2 for _, a, p in some if a for _, b, q in some if not b])
    assert maths.auc(df, "truth", "score").first()["auc"] == pytest.approx(area(rows))
    for r in maths.auc(df, "truth", "score", ["g"]).collect():
        assert r["auc"] == pytest.approx(area([x for x in rows if x[0] == r["g"]]))
    curve = {r["threshold"]: (r["fpr"], r["tpr"]) for r in maths.roc_curve(df, "truth", "score").collect()}
    for t, (fpr, tpr) in curve.items():
        for want, kind in ((fpr, 0), (tpr, 1)):
            own = [s for _, a, s in rows if a == kind]
            assert want == pytest.approx(sum(s >= t for s in own) / len(own))


@pytest.mark.parametrize("norm", [2.0, 1.0, 3.0, 0.5])
def test_neighbours_equal_brute_force(spark, monkeypatch, norm):
    """Many cells and blocks, a vector that a third of the rows share, ties, parts that are left out, fewer rows than k."""
    monkeypatch.setattr(knn_join, "EACH", 20)
    monkeypatch.setattr(knn_join, "BLOCK", 30)
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((400, 3)) * rng.integers(1, 5, (400, 1)), 1)
    x[:130] = [0.5, 0.5, -1.0]
    part = [None if i % 3 else int(i) // 9 for i in range(400)]
    p = spark.createDataFrame([(i, x[i].tolist(), i % 5, part[i]) for i in range(400)], "row_id long, vector array<double>, category int, part long")
    q = p.where("row_id % 4 = 0").withColumnRenamed("row_id", "query_id").drop("category")
    want = {}
    for i in range(0, 400, 4):
        gap = np.zeros(400)
        for d in range(3):
            gap += np.abs(x[i, d] - x[:, d]) ** norm
        far = gap ** (1 / norm)
        order = sorted((float(far[j]), j) for j in range(400) if part[i] is None or part[i] != part[j])[:6]
        want[i] = [(j, round(d, 9)) for d, j in order]
    for rows in (p.repartition(3), p.orderBy(F.desc("row_id"))):
        got = {}
        for r in knn.neighbours(q, rows, 6, norm).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["row_id"], round(r["distance"], 9)))
        assert {k: [d for _, d in v] for k, v in got.items()} == {k: [d for _, d in v] for k, v in want.items()}
        if norm in (1.0, 2.0):
            assert got == want
    few = knn.neighbours(q.limit(1), p.where("row_id in (1, 2, 5)"), 6, norm)
    assert few.count() == 3 and knn.neighbours(q, p.limit(0), 6).count() == 0


def test_ties_go_to_the_smaller_row(spark):
    """Whatever the order of rows."""
    p = spark.createDataFrame([(r, v, 0, None) for r, v in [(9, [1.0, 0.0]), (4, [0.0, 1.0]), (1, [-1.0, 0.0]), (7, [0.0, -1.0])]], "row_id long, vector array<double>, category int, part long").coalesce(1)
    q = spark.createDataFrame([(0, [0.0, 0.0], None)], "query_id long, vector array<double>, part long")
    for norm in (1.0, 2.0):
        assert [r["row_id"] for r in knn.neighbours(q, p, 2, norm).orderBy("rank").collect()] == [1, 4]


def test_json_of_a_schema(spark):
    said = {'{"k": 1}': True, '{"k": 1, "z": "more"}': True, "{}": True, '{"k": null}': True, "no json": False, '{"k": "x"}': False, "": False, " ": False, '{"k": 1': False, None: None}
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert {r["s"]: r["ok"] for r in df.select("s", text.is_json_of(F.col("s"), "k long").alias("ok")).collect()} == said


def test_bits_as_text(spark):
    df = spark.createDataFrame([([0, 3, 4],), ([],), ([4, 1, 1, 9, -2],), (None,)], "b array<int>")
    assert [r[0] for r in df.select(text.format_bits(F.col("b"), 6)).collect()] == ["100110", "000000", "010010", None]
