"""Structured Streaming operators against their batch forms."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.aggregate import aggregate, aggregate_in_order
from tidemark.spec import Aggregation, Interval, StreamSpec
from tidemark.streaming import stateful

START = dt.datetime(2020, 1, 1)
SPEC = StreamSpec(("k",), "ts", ("i",))


@pytest.fixture
def folder(spark, tmp_path):
    """Three files of records, in time order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(k, START + dt.timedelta(minutes=(37 + 11 * k) * i), i, float(i) if i % 7 else None) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, i long, x double")
    for part in range(3):
        df.where(F.floor(F.col("i") / 20) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df, f"{tmp_path}/in", f"{tmp_path}"


def read(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(out, tmp, name="check"):
    out.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/{name}").trigger(availableNow=True).start().awaitTermination()


def windows_of(df):
    return {(r["k"], r["start"]): (r["n"], r["n_values"], r["sum"]) for r in df.collect()}


def batch_form(df):
    whole = aggregate(df.withColumns({"n": F.lit(1.0), "v": F.col("x").isNotNull().cast("double")}), SPEC, Aggregation(Interval.of(hours=5), (("n", "sum"), ("v", "sum"), ("x", lambda x, order: F.sum(x)))))
    return {(r["k"], r["ts"]): (r["n"], r["v"], r["x"] or 0.0) for r in whole.collect()}


def test_anchored_sums_equal_the_batch_form(spark, folder):
    """Windows that closed and those that are open are together the grouped aggregation's, also after a restart and with records that came meanwhile."""
    df, path, tmp = folder
    out = stateful.anchored_sums(read(spark, df, path), SPEC, Interval.of(hours=5), "x")
    run(out, tmp)
    closed = windows_of(spark.read.parquet(f"{tmp}/out"))
    still = windows_of(stateful.open_windows(spark, f"{tmp}/check", SPEC))
    assert len(still) == 3 and not closed.keys() & still.keys() and closed | still == batch_form(df)
    more = spark.createDataFrame([(k, START + dt.timedelta(days=9, hours=3 * i), 100 + i, 1.0) for k in range(2) for i in range(4)] + [(9, START, 0, 2.0), (9, None, 1, 2.0)], df.schema)
    more.coalesce(1).write.mode("append").parquet(path)
    run(out, tmp)
    got = windows_of(spark.read.parquet(f"{tmp}/out")) | windows_of(stateful.open_windows(spark, f"{tmp}/check", SPEC))
    assert got == batch_form(df.union(more.where("ts is not null")))


def test_steps_back_anchor_anew_between_and_within_micro_batches(spark, tmp_path):
    """As the batch form in record order has it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = iter(range(100))
    for hours in ([10, 11, 3, 4, 8], [5, 20, 19], [12, 13, 1, 30]):
        spark.createDataFrame([(1, START + dt.timedelta(hours=h), next(at), 1.0) for h in hours][::-1], "k long, ts timestamp, i long, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.read.parquet(f"{tmp_path}/in")
    run(stateful.anchored_sums(read(spark, files, f"{tmp_path}/in"), SPEC, Interval.of(hours=4), "x"), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").union(stateful.open_windows(spark, f"{tmp_path}/check", SPEC))
    want = aggregate_in_order(files.select("k", "ts", "i", "x"), SPEC, Aggregation(Interval.of(hours=4), (("x", lambda x, order: F.sum(x)),)))
    assert sorted((r["start"], r["n"]) for r in got.collect()) == sorted((r["ts"], r["x"]) for r in want.collect())


def test_timers_close_the_windows_of_idle_keys(spark, tmp_path):
    """Key 1 stops; key 2's records move the watermark on. What comes later for key 1 anchors anew."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in ([(1, 0), (1, 1), (2, 0)], [(2, 9)], [(2, 10)], [(1, 30), (2, 31)]):
        spark.createDataFrame([(k, START + dt.timedelta(hours=h), h, 1.0) for k, h in part], "k long, ts timestamp, i long, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.read.parquet(f"{tmp_path}/in")
    stream = read(spark, files, f"{tmp_path}/in").withWatermark("ts", "1 hour")
    run(stateful.anchored_sums(stream, SPEC, Interval.of(hours=4), "x", Interval.of(hours=6)), tmp_path)
    got = sorted((r["k"], (r["start"] - START).total_seconds() // 3600, r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got[0] == (1, 0, 2) and (2, 8, 2) in got
    still = {r["k"]: (r["start"] - START).total_seconds() // 3600 for r in stateful.open_windows(spark, f"{tmp_path}/check", SPEC).collect()}
    assert still.get(1, 30) == 30  # not 28: it anchored anew


def test_session_windows(spark, folder):
    df, path, tmp = folder
    out = stateful.session_windows(read(spark, df, path), "ts", ["k"], "1 hour", "40 minutes", "x")
    run(out, tmp)
    want = {(r["k"], r["start"]): r["n"] for r in df.groupBy("k", F.session_window("ts", "40 minutes").alias("w")).agg(F.count("*").alias("n")).select("k", "w.start", "n").collect()}
    got = {(r["k"], r["start"]): r["n"] for r in spark.read.parquet(f"{tmp}/out").collect()}
    assert got and all(want[key] == n for key, n in got.items())


def test_watermarked_windows(spark, folder):
    df, path, tmp = folder
    out = stateful.watermarked_windows(read(spark, df, path), "ts", ["k"], "1 hour", "6 hours", "x")
    out.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp}/check").trigger(availableNow=True).start().awaitTermination()
    want = {(r["k"], r["start"]): r["n"] for r in df.groupBy("k", F.window("ts", "6 hours")).agg(F.count("*").alias("n")).select("k", "window.start", "n").collect()}
    got = {(r["k"], r["start"]): r["n"] for r in spark.table("windows").collect()}
    assert got and all(want[key] == n for key, n in got.items())


def test_tee_and_periodic_calls(spark, folder):
    df, path, tmp = folder
    seen, called = [], []
    stateful.tee(read(spark, df, path), f"{tmp}/saved", lambda batch, n: seen.append((n, batch.count()))).option("checkpointLocation", f"{tmp}/c1").trigger(availableNow=True).start().awaitTermination()
    assert [n for _, n in seen] == [60, 60, 60] and spark.read.parquet(f"{tmp}/saved").count() == 180
    for want in ([50, 100, 150], [50, 100, 150, 200]):  # started again, it goes on counting
        stateful.every(read(spark, df, path), 50, called.append, f"{tmp}/counts").option("checkpointLocation", f"{tmp}/c2").trigger(availableNow=True).start().awaitTermination()
        assert called == want
        df.limit(30).coalesce(1).write.mode("append").parquet(path)


def test_likelihoods_in_state_equal_the_batch_form(spark, tmp_path):
    """Several settings: blocks shorter than an average, histories that begin later than the stream, a wait beyond the history."""
    import numpy as np
    from tidemark.operators.anomaly import online_likelihoods
    from tidemark.streaming.likelihood import Fitting, Moments

    rng = np.random.default_rng(5)
    raw = rng.random(400) ** 3
    df = spark.createDataFrame([(1, START + dt.timedelta(minutes=i), i, float(x)) for i, x in enumerate(raw)], "k long, ts timestamp, i long, raw double").cache()
    for setting in (dict(learning=20, samples=10, history=40, every=5, average=10), dict(learning=50, samples=20, history=60, every=8, average=4), dict(learning=3, samples=4, history=100, every=30, average=1), dict(learning=90, samples=10, history=64, every=16, average=7)):
        want = [r["likelihood"] for r in online_likelihoods(df, SPEC, "raw", **setting).orderBy("i").collect()]
        moments, parts = Moments(Fitting(**setting)), []
        for lo, hi in ((0, 1), (1, 7), (7, 130), (130, 131), (131, 400)):
            parts.append(moments.add(raw[lo:hi]))
            moments = Moments(Fitting(**setting), moments.state())
        said = np.concatenate(parts)
        with np.errstate(invalid="ignore"):
            from math import erfc

            tail = [None if np.isnan(m) else (lambda t: t if a >= m else 1 - t)(erfc(abs(a - m) / d / 1.4142) / 2) for a, m, d, *_ in said]
        got = [0.5 if t is None else 1 - (1e-3 if t <= 1e-5 and i and tail[i - 1] is not None and tail[i - 1] <= 1e-5 else t) for i, t in enumerate(tail)]
        assert np.abs(np.array(got) - np.array(want)).max() < 1e-6
        assert len(moments.m1) <= setting["history"] // Fitting(**setting).block + setting["every"] // Fitting(**setting).block + 1


def test_models_are_exported_and_asked_with_frozen_counts(spark, folder):
    from tidemark.streaming import models

    df, path, tmp = folder
    df = df.withColumns({"v": (F.col("i") % 5 % 3).cast("string"), "learns": F.col("i") < 40})
    df.coalesce(1).write.parquet(f"{tmp}/values")
    run(models.two_grams(read(spark, df, f"{tmp}/values"), SPEC, "v", "learns"), tmp, "models")
    counts = {}
    for k in range(3):
        v = [i % 5 % 3 for i in range(60)]
        for i in range(1, 40):
            key = (k, str(v[i - 1]), str(v[i]))
            counts[key] = counts.get(key, 0) + 1
    held = models.learnt(spark, f"{tmp}/models", SPEC)
    assert {(r["k"], r["value"], r["follower"]): r["n"] for r in held.collect()} == counts
    asked = models.inferred(df.where("i >= 40"), SPEC, "v", held)
    streamed = {(r["k"], r["i"]): r["prediction"] for r in spark.read.parquet(f"{tmp}/out").collect()}
    assert all(r["prediction"] == streamed[r["k"], r["i"]] for r in asked.where("i > 40").collect())


def test_rows_of_a_key_are_ordered_as_frames_are():
    """Several frames, ties, missing and text order columns."""
    import numpy as np
    import pandas as pd

    from tidemark.streaming.stateful import in_order

    rng = np.random.default_rng(3)
    df = pd.DataFrame({"ts": pd.to_datetime(rng.integers(0, 5, 40), unit="h"), "id": rng.integers(0, 4, 40).astype(float), "name": [f"n{i % 3}" for i in range(40)], "x": range(40)})
    df.loc[3, "ts"], df.loc[7, "id"] = pd.NaT, np.nan
    for order in (["ts", "id"], ["name", "ts"], []):
        want = df.sort_values(order, kind="stable") if order else df
        got = in_order(iter([df[:25], df[25:]]), order)
        assert list(got) == list(df.columns) and got["x"].tolist() == want["x"].tolist() and got["name"].tolist() == want["name"].tolist()
    assert in_order(iter([df]), ["ts"])["x"].tolist() == df.sort_values("ts", kind="stable")["x"].tolist()
