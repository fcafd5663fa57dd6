"""Groups of several inputs, and prototypes that keep apart, against loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import groups, knn_learn


def four(spark):
    """A key that most rows have, keys that some inputs lack, a null key, an empty input."""
    rng = np.random.default_rng(1)
    rows = {n: [(None if k == 7 else "hot" if h else f"k{k}", int(i)) for i, (k, h) in enumerate(zip(rng.integers(0, 12, size), rng.random(size) < 0.6))] for n, size in (("a", 700), ("b", 90), ("c", 5), ("d", 0))}
    return rows, {n: spark.createDataFrame(r, "k string, i long").repartition(3) for n, r in rows.items()}


def test_aligned_equals_a_loop(spark):
    rows, inputs = four(spark)
    got = {r["k"]: (r["n_a"], r["n_b"], r["n_c"], r["n_d"], r["s"], r["m"]) for r in groups.aligned(inputs, ["k"], {"a": lambda c: [F.sum(c("i")).alias("s")], "b": lambda c: [F.max(c("i")).alias("m")]}).collect()}
    of = lambda n, k: [i for x, i in rows[n] if x == k]
    assert got == {k: (*(len(of(n, k)) for n in "abcd"), sum(of("a", k)) if of("a", k) else None, max(of("b", k), default=None)) for k in {x for r in rows.values() for x, _ in r}}


def test_merged_streams_each_key_once(spark):
    """Input after input, each in its order, in batches; a consumer that stops early leaves the next key whole."""
    rows, inputs = four(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:

        def consume(key, parts):
            seen = []
            for name, batch in parts:
                assert batch.num_rows <= 50
                seen += [f"{name}{i}" for i in batch.column("i").to_pylist()]
                if key == ("k3",):
                    break
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([",".join(seen)])], names=["k", "seen"])

        got = {r["k"]: r["seen"] for r in groups.merged(inputs, ["k"], {n: ["i"] for n in inputs}, consume, "k string, seen string").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {k: ",".join(f"{n}{i}" for n in "abcd" for x, i in sorted(rows[n], key=lambda r: r[1]) if x == k) for k in {x for r in rows.values() for x, _ in r}}
    assert got.keys() == want.keys() and all(got[k] == want[k] for k in want if k != "k3") and want["k3"].startswith(got["k3"])


@pytest.mark.parametrize("norm", [1.0, 2.0])
def test_prototypes_that_keep_apart_equal_the_sequential_rule(spark, monkeypatch, norm):
    """Many cells; a chain of near vectors that runs through them, a close group, copies, ties; prototypes that are there already."""
    monkeypatch.setattr(knn_learn, "EACH", 25)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.stack([np.linspace(0, 30, 150), np.zeros(150)], 1), rng.normal(0, 0.01, (120, 2)) + [5, 5], np.tile([9.0, 9.0], (40, 1)), rng.uniform(0, 30, (190, 2))])
    x = x[rng.permutation(500)] if norm == 1 else x
    df = spark.createDataFrame([(i, v.tolist(), i % 3, None) for i, v in enumerate(x)], "row_id long, vector array<double>, category int, part long").repartition(5)
    far = (lambda a, b: float(np.abs(a - b).sum())) if norm == 1 else (lambda a, b: float(np.sqrt(((a - b) ** 2).sum())))
    for old, threshold in (([], 0.3), (list(range(100)), 1.1)):
        kept = list(old)
        for i in range(len(old), 500):
            if np.count_nonzero(x[i]) >= 1 and all(far(x[i], x[j]) >= threshold for j in kept):
                kept.append(i)
        stored = df.where(F.col("row_id") < len(old)) if old else None
        got = knn_learn.apart(df.where(F.col("row_id") >= len(old)), threshold, norm, 1, stored)
        assert got.columns == df.columns and sorted(r["row_id"] for r in got.collect()) == kept
    assert knn_learn.apart(df, 0.0).count() == 500 and knn_learn.apart(df.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        knn_learn.apart(df, 1.0, 0.5)


@pytest.mark.parametrize("first", [7, 60, 4096])
def test_blocks_and_cells_equal_the_sequential_rule(spark, monkeypatch, first):
    """Half of the vectors are covered by the first few, the others are in nobody's reach; blocks alone, or cells after them."""
    monkeypatch.setattr(knn_learn, "EACH", 25)
    monkeypatch.setattr(knn_learn, "FIRST", first)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.1, (250, 3)), rng.uniform(5, 25, (150, 3))])[rng.permutation(400)]
    df = spark.createDataFrame([(i, v.tolist(), 0, None) for i, v in enumerate(x)], "row_id long, vector array<double>, category int, part long").repartition(4)
    for old in (0, 5, 100):
        kept = list(range(old))
        for i in range(old, 400):
            if all(np.sqrt(((x[i] - x[j]) ** 2).sum()) >= 0.6 for j in kept):
                kept.append(i)
        got = knn_learn.apart(df.where(F.col("row_id") >= old), 0.6, stored=df.where(F.col("row_id") < old) if old else None)
        assert sorted(r["row_id"] for r in got.collect()) == kept


def test_covered_vectors_pass_through_no_cell(spark, monkeypatch):
    """Where a few prototypes cover all vectors, blocks decide everything: copies for cells grew with vectors times cells."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist(), 0, None) for i, v in enumerate(rng.normal(0, 0.1, (900, 3)))], "row_id long, vector array<double>, category int, part long")
    monkeypatch.setattr(knn_learn, "FIRST", 100)
    monkeypatch.setattr(knn_learn, "EACH", 1)
    written, names = knn_learn.written, []
    monkeypatch.setattr(knn_learn, "written", lambda d, name: names.append(name) or written(d, name))
    assert 1 < knn_learn.apart(df, 0.3).count() < 100
    assert names.count("state") == 1 and "block" in names
