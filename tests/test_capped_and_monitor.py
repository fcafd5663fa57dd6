"""Capped learning and monitored states, against loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import knn_learn, monitor, pooling
from tidemark.spec import StreamSpec
from tidemark.streaming import prototypes

NEW = "k string, row_id long, vector array<double>, category int, part long"


def by_hand(rows, most, threshold, norm, least, replace):
    """The rule as a loop over (row_id, vector, category): {row_id: (category, used)}."""
    kept = []
    for row_id, v, category in rows:
        gaps = [sum(abs(a - b) ** norm for a, b in zip(v, p["v"], strict=True)) ** (1 / norm) for p in kept]
        add = True
        if replace and any(p["v"] == v for p in kept):
            p = next(p for p in kept if p["v"] == v)
            p["category"], p["used"], add = category, row_id, False
        if threshold > 0 and kept:
            add = min(gaps) >= threshold
            if not add:
                kept[gaps.index(min(gaps))]["used"] = row_id
        if add and sum(x != 0 for x in v) >= least:
            kept.append({"id": row_id, "v": v, "category": category, "used": row_id})
            if len(kept) > most:
                kept.remove(min(kept, key=lambda p: p["used"]))
    return {p["id"]: (p["category"], p["used"]) for p in kept}


def vectors():
    rng = np.random.default_rng(8)
    return [(f"k{int(i % 10 < 3)}", int(i), rng.integers(0, 5, 2).astype(float).tolist(), int(rng.integers(3)), None) for i in range(400)]


CASES = [(6, 1.5, 2.0, 0, False), (6, 1.5, 1.0, 2, True), (4, 0.0, 2.0, 1, True), (5, 0.0, 2.0, 2, False), (100, 2.5, 2.0, 1, False), (1, 1.0, 2.0, 0, False)]


@pytest.mark.parametrize("most, threshold, norm, least, replace", CASES)
def test_capped_equals_the_loop(spark, most, threshold, norm, least, replace):
    rows = vectors()
    df = spark.createDataFrame([*rows, ("k0", 1000, None, 1, None)], NEW).repartition(7)
    got = knn_learn.capped(df, most, threshold, norm, least, replace, ("k",))
    of = {k: {r["row_id"]: (r["category"], r["used"]) for r in got.where(F.col("k") == k).collect()} for k in ("k0", "k1")}
    assert of == {k: by_hand([(i, v, c) for x, i, v, c, _ in rows if x == k], most, threshold, norm, least, replace) for k in of}
    whole = knn_learn.capped(df.drop("k"), most, threshold, norm, least, replace)
    assert {r["row_id"]: (r["category"], r["used"]) for r in whole.collect()} == by_hand([(i, v, c) for _, i, v, c, _ in rows], most, threshold, norm, least, replace)
    assert knn_learn.capped(df.limit(0), most, threshold, norm, least, replace, ("k",)).count() == 0


def test_a_cap_of_nothing_is_refused(spark):
    with pytest.raises(ValueError):
        knn_learn.capped(spark.createDataFrame(vectors(), NEW), 0)


@pytest.mark.parametrize("most, threshold, norm, least, replace", CASES[:3])
def test_streamed_prototypes_equal_the_batch_form(spark, tmp_path, most, threshold, norm, least, replace):
    """Three micro-batches, the stream stopped after each and taken up again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = spark.createDataFrame(vectors(), NEW)
    for at in range(3):
        df.where(F.floor(F.col("row_id") / 150) == at).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = prototypes.capped(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["k"], most, threshold, norm, least, replace)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    held = prototypes.held(spark, f"{tmp_path}/check", ["k"])
    rows = lambda d: sorted((r["k"], r["row_id"], tuple(r["vector"]), r["category"], r["part"], r["used"]) for r in d.collect())
    assert rows(held) == rows(knn_learn.capped(df, most, threshold, norm, least, replace, ("k",)))
    log = spark.read.parquet(f"{tmp_path}/out")
    assert log.count() == 400 and {r["row_id"] for r in held.collect()} <= {r["row_id"] for r in log.where("stored").collect()}


def test_monitored_states_equal_the_loop(spark):
    """Missing arrays, resets, records without a label; the second stream is one record."""
    rng = np.random.default_rng(3)
    some = lambda n, of: sorted(map(int, rng.choice(of, n, replace=False)))
    rows = [("a", i, None if i == 7 else some(4, 12), None if i == 3 else some(9, 36), int(i % 6 == 0), None if i % 5 == 0 else f"s{i % 3}") for i in range(40)] + [("b", 0, some(4, 12), some(9, 36), 0, "s0")]
    df = spark.createDataFrame(rows, "k string, i long, active array<int>, predictive array<int>, begins int, label string")
    done = monitor.traces(monitor.predicted(df, StreamSpec(("k",), "i", (), reset="begins"), "predictive"), "active", "predicted", 3)
    got = {(r["k"], r["i"]): [list(r[t]) for t in monitor.TRACES] for r in done.collect()}
    want, cells, before = {}, {}, []
    for k, i, active, predictive, begins, label in rows:
        said = [] if begins or k == "b" else before
        on = active or []
        hit, miss = [c for c in said if c // 3 in on], [c for c in said if c // 3 not in on]
        want[k, i] = [hit, miss, sorted({c // 3 for c in hit}), sorted({c // 3 for c in miss}), [c for c in on if c not in {h // 3 for h in hit}]]
        if label:
            cells.setdefault(label, set()).update(hit)
        before = predictive or []
    assert got == want
    sizes = {t: [len(w[j]) for (k, i), w in want.items() if not (k == "a" and i % 6 == 0)] for j, t in enumerate(monitor.TRACES)}
    for r in monitor.metrics(done, reset="begins").collect():
        of = sizes[r["trace"]]
        assert (r["n"], r["min"], r["max"], r["sum"]) == (len(of), min(of), max(of), sum(of)) and np.isclose([r["mean"], r["stdev"]], [np.mean(of), np.std(of)]).all()
    stand = monitor.sequence_cells(done, "label", 3)
    assert {(r["label"], r["column"], r["cell"]) for r in stand.collect()} == {(s, c // 3, c) for s, of in cells.items() for c in of}
    assert monitor.sequences_per_cell(stand).first()["sum"] == sum(map(len, cells.values()))
    assert {r["k"]: r["n"] for r in monitor.metrics(done, monitor.TRACES[:1], keys=("k",)).collect()} == {"a": 40, "b": 1}


def test_winners():
    assert pooling.winners(100, density=0.02) == 2 and pooling.winners(100, per_area=10) == 10
    assert pooling.winners(100, per_area=10, area=25) == 40 and pooling.winners(100, per_area=10, area=4) == 50  # half of an area at most
