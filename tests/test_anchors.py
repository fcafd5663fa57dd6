"""Windows in an order in which time goes back, against a loop over the records."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import anchors, records
from tidemark.spec import Interval, StreamSpec

ORIGIN = dt.datetime(2020, 1, 1)


def looped(times, forced, length, start=None, anchor=-1, number=0):
    """(start, anchor, opens) of each record."""
    out = []
    for i, t in enumerate(times):
        old = start, anchor
        if start is None or t < start or forced[i]:
            start, anchor = t, number + i
        else:
            start += (t - start) // length * length
        out.append((start, anchor, (start, anchor) != old))
    return out


def a_stream(rng, n, step, back):
    times = np.cumsum(rng.integers(0, step, n)) - np.where(rng.random(n) < back, rng.integers(0, 6 * step, n), 0)
    return times - np.where(rng.random(n) < back / 10, rng.integers(0, 40 * step, n), 0), rng.random(n) < 0.02


@pytest.mark.parametrize("back", [0.0, 0.05, 0.5])
def test_functions_of_stretches_say_what_a_loop_says(back):
    rng = np.random.default_rng(int(back * 100))
    for n in (1, 2, 3, 30, 500):
        for length in (1, 7, 50, 4000):
            times, forced = a_stream(rng, n, 10, back)
            own = anchors.Stretch(times.astype(np.int64), forced, 0, length)
            ends, top = own.function(), int(times.max())
            assert own.anchored_at(0) == looped(times, forced, length)[-1][:2]
            for start in {int(times[0]) - int(x) for x in rng.integers(0, 3 * length + 3, 12)} | {int(times[0]) + 1}:
                want = looped(times, forced, length, start, -7)
                if times[0] < start:
                    got = own.anchored_at(0)
                else:
                    got = next(((s, a) for lo, hi, s, a in ends if lo <= start % length < hi), (start + (top - start) // length * length, -7))
                assert got == want[-1][:2]
                assert list(zip(*(x.tolist() for x in own.run(start, -7)))) == want
            assert list(zip(*(x.tolist() for x in own.run(None, 0)))) == looped(times, forced, length)


@pytest.fixture
def many_parts(spark):
    """Small parts stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_windows_over_many_parts_of_one_hot_stream(spark, many_parts):
    """Most records are of one stream; it goes over many parts."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key, n in ((None, 40), ("hot", 3000), ("z", 100)):
        times, forced = a_stream(rng, n, 600, 0.02)
        rows += [(key, ORIGIN + dt.timedelta(seconds=int(t)), i, int(f), float(i)) for i, (t, f) in enumerate(zip(times, forced))]
        of = looped(times.tolist(), forced, 7200)
        firsts = [of[a][0] for _, a, _ in of]  # an anchor's own window starts at its record
        want |= {(key, i): (s, o, int(forced[i] or i == 0 or (o and s != firsts[i]))) for i, (s, a, o) in enumerate(of)}
    rows.append(("z", None, 10_000, 0, 0.0))
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long, own int, x double").repartition(7)
    spec = StreamSpec(("k",), "ts", ("i",), reset="own")
    done = anchors.with_windows(df, spec, Interval.of(hours=2), F.col("own") != 0)
    got = {(r["k"], r["i"]): (round((r["_start"] - ORIGIN).total_seconds()), r["_opens"]) for r in done.collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    assert done.select((F.col("_anchor") / 2**anchors.PLACES).cast("int").alias("part")).distinct().count() > 4
    assert {(r["k"], r["i"]): r["_reset"] for r in records.auto_reset_in_order(df, spec, Interval.of(hours=2)).collect()} == {k: v[2] for k, v in want.items()}
    assert anchors.with_windows(df.limit(0), spec, Interval.of(hours=2)).count() == 0
