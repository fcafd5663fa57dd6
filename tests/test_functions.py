"""Laws and literal values of encoders, metrics, models and search."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import encoders, maths, sdr, text, trees
from tidemark.operators import anomaly, metrics, models, ranking, search, windows
from tidemark.spec import StreamSpec

SPEC = StreamSpec(("k",), "i")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def stream(spark, rows, kinds):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], f"k long, i long, {kinds}")


def values(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def test_scalar_literals(spark):
    """Days of a week around the end, and a range by resolution."""
    week = encoders.Scalar(3, 1, 8, periodic=True, n=14)
    days = [one(spark, text.format_bits(week.encode(F.lit(float(d))), 14).alias("b"))["b"] for d in (1, 2, 3, 8)]
    assert days == ["11000000000001", "01110000000000", "00011100000000", "11000000000001"]
    by_step = encoders.Scalar(5, 1, 10, resolution=1)
    assert by_step.width == 14 and [list(one(spark, by_step.encode(F.lit(x)).alias("b"))["b"]) for x in (1, 10, 99)] == [[0, 1, 2, 3, 4], [9, 10, 11, 12, 13], [9, 10, 11, 12, 13]]
    strict = encoders.Scalar(5, 1, 10, resolution=1, clip=False)
    with pytest.raises(Exception, match="out of the encoder's range"):
        one(spark, strict.encode(F.lit(11.0)))
    for wrong in ({"w": 4, "n": 9}, {"w": 5}, {"w": 5, "n": 9, "radius": 2}, {"w": 5, "n": 3}):
        with pytest.raises(ValueError):
            encoders.Scalar(wrong.pop("w"), 0, 1, **wrong)


def test_distributed_overlaps_follow_the_law():
    e = encoders.Distributed(1.0)
    table = [set(b) for b in e.table()]
    for i in range(0, 1000, 7):
        for j in [*range(max(0, i - 25), min(1000, i + 26)), (i * 37) % 1000]:
            least, most = encoders.expected_overlap(i, j, e.w)
            assert least <= len(table[i] & table[j]) <= most, (i, j)


def test_encoders_without_sql_are_deterministic_and_near(spark):
    """Near coordinates share bits, far ones few; a category's bits are its own."""
    bits = lambda x, y: set(one(spark, encoders.coordinate([F.lit(x), F.lit(y)], 3, 15, 500).alias("b"))["b"])
    a, near, far = bits(10, 10), bits(11, 10), bits(90, 90)
    assert a == bits(10, 10) and len(a & near) > 6 and len(a & far) < 4
    table = {r["c"]: set(r["bits"]) for r in encoders.category_table(spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "c string"), "c", 200, 9).collect()}
    assert set(table) == {"x", "y"} and all(len(b) == 9 for b in table.values()) and len(table["x"] & table["y"]) < 4


def test_encoders_of_ones_own(spark):
    class Parity:
        width = 2

        def encode(self, x):
            return F.array((x % 2).cast("int"))

    encoders.register("parity", Parity)
    multi = encoders.Multi.of({"b": {"fieldname": "id", "type": "parity"}, "a": {"fieldname": "id", "type": "scalar", "w": 3, "low": 0, "high": 10, "n": 13}, "x:y": {"fieldname": "q", "type": "none"}, "c": None})
    assert multi.width == 15 and multi.describe(13) == ("b", 0) and multi.describe(4) == ("a", 4)
    assert list(spark.range(5, 6).select(multi.encode().alias("b")).first()["b"]) == [5, 6, 7, 14]
    with pytest.raises(ValueError):
        encoders.Multi.of({"a": {"fieldname": "x", "type": "nothing"}})
    with pytest.raises(Exception, match="don't fit"):
        one(spark, encoders.PassThrough(5, 2).encode(F.array(F.lit(1), F.lit(7))))


def test_text_errors(spark):
    for wrong in (text.parse_bool(F.lit("maybe")), text.parse_bits(F.lit("012")), text.parse_timestamp(F.lit("yesterday"))):
        with pytest.raises(Exception, match="no (boolean|bits|timestamp)"):
            one(spark, wrong)
    row = one(spark, text.format_timestamp(text.parse_timestamp(F.lit("7/2/10 0:00")), fraction=False).alias("t"), text.parse_timestamp(F.lit(None).cast("string")).alias("n"), text.unescape(text.escape(F.lit("a,b\\n\n\t"))).alias("u"))
    assert row["t"] == "2010-07-02 00:00:00" and row["n"] is None and row["u"] == "a,b\\n\n\t"


def test_sparse_arrays(spark):
    a = F.array(*map(F.lit, range(0, 40, 2)))
    row = one(spark, sdr.with_noise(a, 100, 0.25, "s").alias("n"), sdr.dense(F.array(F.lit(1)), 3).alias("d"), sdr.sparse(F.array(F.lit(0), F.lit(5))).alias("s"))
    assert len(row["n"]) == 20 and len(set(row["n"]) & set(range(0, 40, 2))) == 15 and list(row["d"]) == [0, 1, 0] and list(row["s"]) == [1]
    m = one(spark, sdr.match(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3), F.lit(4))).alias("m"))["m"]
    assert (m["hits"], m["extra"], m["missing"]) == (0.5, 1.0, 0.5)


def test_tails(spark):
    """The tail against math.erfc over its whole range."""
    z = np.linspace(0, 25, 500)
    got = [r["p"] for r in spark.createDataFrame([(float(v),) for v in z], "z double").select("z", maths.erfc(F.col("z")).alias("p")).orderBy("z").collect()]
    assert max(abs(g / math.erfc(v) - 1) for g, v in zip(got, z)) < 1e-9
    tail = lambda x: one(spark, maths.tail_probability(F.lit(x), F.lit(0.0), F.lit(1.0)).alias("p"))["p"]
    assert [round(tail(x), 4) for x in (0.0, 0.3, 1.0)] == [0.5, 0.3821, 0.1587]


def test_metric_literals(spark):
    df = stream(spark, [(9.0, 0.0), (4.0, 13.0), (5.0, 8.0), (6.0, 3.0)], "t double, p double")
    last = lambda d, m: values(metrics.with_metric(d, SPEC, m, "m"), "m")[-1]
    assert last(df, metrics.Metric("rmse", "t", "p")) == pytest.approx(6.71, abs=0.01) and last(df, metrics.Metric("aae", "t", "p")) == 6.0
    assert last(df, metrics.Metric("nrmse", "t", "p")) == pytest.approx(3.5856858280031814)
    wide = stream(spark, [(9.0, 0.0), (4.0, 13.0), (4.0, 4.0), (100.0, 6.0), (44.0, 7.0)], "t double, p double")
    assert last(wide, metrics.Metric("rmse", "t", "p", window=3)) == pytest.approx(58.324, abs=1e-3)
    steps = stream(spark, [(float(i // 4 + 1),) for i in range(1000)], "t double")
    assert last(steps, metrics.Metric("trivial", "t")) == pytest.approx(0.25, abs=0.01)
    assert last(df, metrics.Metric("aae", "t", "p", most=2)) == 9.0
    auc = stream(spark, [(1, 0.9), (0, 0.1), (1, 0.1), (0, 0.5)], "t int, p double")
    assert values(metrics.with_metric(auc, SPEC, metrics.Metric("neg_auc", "t", "p", window=4), "m"), "m") == [-0.5, -1.0, -0.75, -0.625]
    with pytest.raises(ValueError):
        metrics.with_metric(df, SPEC, metrics.Metric("nothing", "t", "p"))


def test_metrics_together_and_their_log(spark):
    df = stream(spark, [(float(i), float(i)) for i in range(6)], "t double, p double")
    ms = [metrics.Metric("aae", "t", "p"), metrics.Metric("rmse", "t", "p", window=2)]
    done = metrics.with_metrics(df, SPEC, ms, {"p": 2})
    assert values(done, ms[0].label) == [None, None, 2.0, 2.0, 2.0, 2.0] and ms[1].label == "rmse:steps=1:window=2:field=t"
    (last,) = metrics.as_json(done, SPEC, [m.label for m in ms]).collect()
    assert last["record"] == 6 and '"aae:steps=1:field=t":2.0' in last["metrics"]
    log = metrics.prediction_log(done, SPEC, ["t"], {"p": "t"}, [ms[0].label]).orderBy("i").collect()
    assert log[0]["p"] == "" and log[3]["p"] == "1.0" and log[3]["p.actual"] == "3.0" and log[3]["reset"] == 0


def test_prediction_extent(spark):
    """How many of the next inputs an output holds: to the first that it doesn't, or a reset."""
    inputs, outputs, resets = [[1], [2], [3], [4], [5]], [[1, 2, 3], [3], [4, 5], [5], []], [1, 0, 0, 0, 1]
    df = stream(spark, list(zip(inputs, outputs, resets)), "a array<int>, b array<int>, r int")
    spec = StreamSpec(("k",), "i", reset="r")
    assert values(windows.prediction_extent(df, spec, "a", "b", 10), "extent") == [2, 1, 1, 0, 0]
    assert values(windows.prediction_extent(df, spec, "a", "b", 1), "extent") == [1, 1, 1, 0, 0]


def test_saturation(spark):
    bits = [r * 60 + c for r in range(60) for c in range(60) if (15 <= r < 45 and 15 <= c < 45) or (r < 15 and 15 <= c < 30) or (r >= 45 and 15 <= c < 30 and r % 2)]
    boxes = spark.createDataFrame([(bits,)], "b array<int>").select(windows.saturation("b", 60, 60).alias("s")).first()["s"]
    got = {(s["row"], s["column"]): (round(s["share"], 3), s["inner"]) for s in boxes}
    assert got[1, 1] == (1.0, False) and got[3, 1] == (round(8 * 15 / 225, 3), False) and len(got) == 6
    cross = [r * 45 + c for r in range(45) for c in range(45) if 15 <= r < 30 or 15 <= c < 30]
    inner = spark.createDataFrame([(cross,)], "b array<int>").select(windows.saturation("b", 45, 45).alias("s")).first()["s"]
    assert [(s["row"], s["column"]) for s in inner if s["inner"]] == [(1, 1)]


def test_average_of_a_fit():
    assert [anomaly.valid_fit(f) for f in ({}, {"distribution": {"name": "normal", "mean": 1, "variance": 2, "stdev": 1.4}, "movingAverage": {"windowSize": 10, "historicalValues": [], "total": 0.0}}, {"distribution": {"mean": 1}, "movingAverage": {}})] == [False, True, False]


def test_experiments(spark, tmp_path):
    df = stream(spark, [(float(i),) for i in range(10)], "x double")
    path = tmp_path / "e.json"
    path.write_text('{"model": "previous_value", "predictedField": "x", "steps": 3, "metrics": [{"metric": "aae", "window": 4}], "tasks": [["learn", 2], ["infer", 1]]}')
    e = models.load(spark, f"file://{path}", SPEC)
    done = e.run(df)
    assert values(done, "prediction") == [None] * 3 + [float(i) for i in range(7)] and values(done, e.metrics[0].label)[-1] == 3.0 and values(done, "phase")[:4] == ["learn", "learn", "infer", "learn"]
    for wrong in ({"model": "nothing", "predictedField": "x"}, {"model": "two_gram", "predictedField": "x", "more": 1}):
        with pytest.raises(ValueError):
            models.Experiment.of(wrong, SPEC)
    flat = models.anomaly_params(stream(spark, [(5.0,)] * 3, "x double"), "x", low=5.0, high=5.0)
    assert flat["value"]["resolution"] == pytest.approx(1.4 / 130)


def test_swarm(spark, tmp_path):
    """The swarm comes nearer to a known best; it stops when nothing gets better; the registry keeps the last of each candidate."""
    score = lambda c: c.select("candidate", (F.abs(F.col("x") - 7) + F.when(F.col("c") == "good", 0).otherwise(5)).alias("error"))
    told = []
    swarm = search.Swarm({"x": search.Range(0, 10), "c": search.Choice(("good", "bad"))}, particles=6, generations=8)
    found = swarm.run(spark, score, told=lambda g, e: told.append(e))
    assert told == sorted(told, reverse=True) and told[-1] < 1 and found.count() == 48
    flat = search.Swarm({"x": search.Range(0, 10)}, particles=3, generations=20, patience=2).run(spark, lambda c: c.select("candidate", F.lit(1.0).alias("error")))
    assert flat.agg(F.max("generation")).first()[0] == 2
    refused = search.Swarm({"x": search.Range(0, 10)}, particles=3, generations=1).run(spark, lambda c: c.select("candidate", F.lit(1.0).alias("error")), keep=lambda p: False)
    assert {r["error"] for r in refused.collect()} == {float("inf")}
    for _ in range(2):
        search.register(found, f"{tmp_path}/runs", "job")
    assert search.registered(spark, f"{tmp_path}/runs").count() == 48


def test_search_decisions(spark):
    assert search.apart(0, 10, [0, 10]) == 5.0 and search.apart(3, 3, [1]) == 3
    bests = {"a": [5.0, 4.0, 3.0], "b": [9.0, 8.0, 7.0], "c": [5.0, 5.0, 5.0]}
    assert search.ended(bests, 2) == {"b", "c"}
    results = spark.createDataFrame([("x", 8.0), ("y", 9.99), ("z", 9.0), ("x,z", 7.0)], "fields string, error double")
    assert search.next_sets(results, "fields", [("x",), ("y",), ("z",)], 10.0, least=1.0, branches=1) == [("x", "z")]
    assert search.useless({"x": 8.0, "y": 9.0, "x,z": 7.0, "x,y,z": 7.5}, "x,z") == {"x", "y"}
    v = search.EncoderVariable("f", "scalar", {"w": 21, "low": 0, "high": 1}, {"n": search.Range(22, 100, 1, whole=True)})
    assert list(v.variables("e")) == ["e.n"] and v.definition("e", {"e.n": 50}) == {"fieldname": "f", "type": "scalar", "w": 21, "low": 0, "high": 1, "n": 50}
    made = search.generated({"includedFields": [{"fieldName": "t", "fieldType": "datetime"}, {"fieldName": "x", "fieldType": "float", "minValue": 0, "maxValue": 9}], "inferenceArgs": {"predictedField": "x", "predictionSteps": [1, 5]}, "swarmSize": "small"})
    assert made["particles"] == 3 and made["metrics"] == [("alt_mape", "x", 1), ("alt_mape", "x", 5)] and set(made["encoders"]) == {"t", "x"}


def test_a_search_from_its_description(spark):
    description = {"includedFields": [{"fieldName": "t", "fieldType": "datetime"}, {"fieldName": "x", "fieldType": "float", "minValue": 0, "maxValue": 9}], "inferenceArgs": {"predictedField": "x"}, "swarmSize": "small"}
    found, best = search.run_description(spark, description, lambda c: c.select("candidate", (F.abs(F.col("x__n") - 300) + F.col("t__time_of_day")).cast("double").alias("error")))
    top = found.orderBy("error").first()
    assert best["x"]["n"] == top["x__n"] and best["t"]["time_of_day"] == top["t__time_of_day"] and best["x"]["fieldname"] == "x" and encoders.Multi.of({"x": best["x"]}).width == top["x__n"]


def test_nested_settings():
    tree = {"a": {"b": 1, "c": {"d": [2]}}, "e": 3}
    assert trees.merged(tree, {"a": {"b": 9, "f": {}}, "g": {"h": 1}}) == {"a": {"b": 9, "c": {"d": [2]}, "f": {}}, "e": 3, "g": {"h": 1}} and tree["a"]["b"] == 1
    assert trees.get(tree, "a.c.d") == [2] and trees.get(tree, "a.x.d", 0) == 0 and trees.with_value(tree, "a.x.y", 5)["a"]["x"] == {"y": 5}
    assert trees.mapped({"a": {"b": 1}, "c": 2}, lambda v: v + 1) == {"a": {"b": 2}, "c": 3}
    assert trees.differences(tree, {"a": {"b": 2}, "e": 3, "z": 1}) == {"only_first": ["a.c.d"], "only_second": ["z"], "different": ["a.b"]}


def test_draws(spark):
    """A sample of a range: as many of each stream as asked for, from the range alone, in order, the same again; every place about as often."""
    df = spark.range(4000).select((F.col("id") % 200).alias("k"), F.floor(F.col("id") / 200).alias("i"))
    some = ranking.sample_range(df, SPEC, 4, 5, 15).collect()
    assert len(some) == 800 and {r["i"] for r in some} == set(range(5, 15)) and sorted(map(tuple, some)) == sorted(map(tuple, ranking.sample_range(df, SPEC, 4, 5, 15).collect()))
    other = ranking.sample_range(df, SPEC, 4, 5, 15, seed=1).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, some))
