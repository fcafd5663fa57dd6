"""Record files, streams of records and generators, against literal values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate as agg
from tidemark.operators import records
from tidemark.sources import generators
from tidemark.sources.records import Field, out_of_order, read_fields, read_records, read_stream, spec_of, write_records
from tidemark.spec import Aggregation, Interval, StreamSpec

FIELDS = [Field("name", "string"), Field("at", "datetime", "T"), Field("n", "int"), Field("x", "float"), Field("begins", "int", "R"), Field("sid", "string", "S"), Field("kinds", "list", "C"), Field("on", "bool")]


def t(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def rows(spark):
    values = [
        ("a, \"b\"\n\\c\td", t("2014-01-01T10:00:00.000123"), 1, 0.5, 1, "s1", [1, 2], True),
        ("", None, None, None, 0, "s1", None, None),
        ("name", t("2014-01-02T00:00:00"), -3, 1e-9, 0, "s2", [7], False),
    ]
    return spark.createDataFrame(values, "name string, at timestamp, n long, x double, begins long, sid string, kinds array<int>, on boolean").withColumn("i", F.monotonically_increasing_id())


def test_csv_round_trip(spark, rows, tmp_path):
    """Three header rows, escapes, every type, missing values; the special flags come back as roles."""
    path = f"{tmp_path}/stream"
    write_records(rows, FIELDS, ["i"], path)
    assert read_fields(spark, path) == FIELDS
    back = read_records(spark, path)
    got = [tuple(r)[:-1] for r in back.orderBy("rec_idx").collect()]
    want = [tuple(r)[:-1] for r in rows.orderBy("i").collect()]
    want[1] = (None, *want[1][1:])  # an empty text is a missing one in a file
    assert got == want
    spec = spec_of(back)
    assert (spec.ts, spec.reset, spec.sequence, spec.category) == ("at", "begins", "sid", "kinds")


def test_records_that_look_like_a_header(spark, tmp_path):
    """The header goes by its place: an equal line, a line of commas and an empty line are records."""
    (tmp_path / "a.csv").write_text("a,b\nint,string\n,\n1,a\n,\n2,b\n\n")
    got = [(r["a"], r["b"]) for r in read_records(spark, f"{tmp_path}/a.csv").orderBy("rec_idx").collect()]
    assert got == [(1, "a"), (None, None), (2, "b"), (None, None)]
    with pytest.raises(ValueError):
        (tmp_path / "b.csv").write_text("a\nint\n")
        read_fields(spark, f"{tmp_path}/b.csv")
    for wrong in (("x", "number", ""), ("x", "string", "T"), ("x", "int", "Q")):
        with pytest.raises(ValueError):
            Field(*wrong)


def test_stream_definition(spark, tmp_path):
    """Row range, filter and aggregation of a definition, on the gap case: empty windows are not emitted, windows start at the first record."""
    lines = [("2009-04-03 19:05:06", 129.3), ("2009-04-04 15:19:12", 46.6), ("2009-04-07 02:54:04", 30.32), ("2009-04-07 06:27:12", 84.52), ("2009-04-07 06:42:21", 21.1), ("2009-04-09 01:01:14", 29.24), ("2009-04-09 06:47:42", 99.76), ("2009-04-11 18:06:11", 29.66), ("2009-04-11 18:12:53", 148.32), ("2009-04-11 19:15:08", 61.03), ("2009-04-15 19:25:40", 53.14)]
    (tmp_path / "gap.csv").write_text("ts,amount\ndatetime,float\nT,\n" + "".join(f"{a}.000000,{b}\n" for a, b in lines))
    definition = {"streams": [{"source": f"{tmp_path}/gap.csv", "columns": ["ts", "amount"]}], "aggregation": {"fields": [["amount", "sum"]], "hours": 24}}
    got = [(str(r["ts"]), round(r["amount"], 2)) for r in read_stream(spark, definition).orderBy("ts").collect()]
    assert got == [("2009-04-03 19:05:06", 175.9), ("2009-04-06 19:05:06", 135.94), ("2009-04-08 19:05:06", 129.0), ("2009-04-10 19:05:06", 177.98), ("2009-04-11 19:05:06", 61.03), ("2009-04-15 19:05:06", 53.14)]
    part = read_stream(spark, {"streams": [{"source": f"{tmp_path}/gap.csv", "first_record": 2, "last_record": 6}], "filter": {"amount": {"type": "number", "min": 30, "max": None}}})
    assert sorted(r["amount"] for r in part.collect()) == [30.32, 84.52]


def test_weighted_mean_and_legacy_division(spark):
    """wmean and mean of whole numbers: with true division, and floored; no weight: no mean."""
    values = [(10, 1), (5, 2), (1, 100), (2, 4), (4, 1), (4, 0), (5, 0), (6, 0)]
    df = spark.createDataFrame([(1, t("2010-01-01T00:00:00") + dt.timedelta(days=i), a, b) for i, (a, b) in enumerate(values)], "k long, ts timestamp, a long, b long")
    spec, how = StreamSpec(("k",), "ts"), Aggregation(Interval.of(days=2), (("a", "wmean:b"), ("b", "mean")))
    of = lambda legacy: [(r["a"] and round(r["a"], 3), r["b"]) for r in agg.aggregate(df, spec, how, legacy).orderBy("ts").collect()]
    assert of(False) == [(6.667, 1.5), (1.038, 52.0), (4.0, 0.5), (None, 0.0)]
    assert of(True) == [(6, 1), (1, 52), (4, 0), (None, 0)]


def test_time_that_goes_back(spark):
    """In record order: a step back closes the window and anchors anew."""
    at = ["2020-01-01 00:00", "2020-01-01 05:00", "2020-01-02 01:00", "2020-01-01 12:00", "2020-01-01 13:00", "2020-01-02 13:00"]
    df = spark.createDataFrame([(1, t(x), i, 1.0 + i) for i, x in enumerate(at)], "k long, ts timestamp, i long, x double")
    spec = StreamSpec(("k",), "ts", ("i",))
    got = [(str(r["ts"])[5:16], r["x"]) for r in agg.aggregate_in_order(df, spec, Aggregation(Interval.of(days=1), (("x", lambda x, order: F.sum(x)),))).orderBy("i").collect()]
    assert got == [("01-01 00:00", 3.0), ("01-02 00:00", 3.0), ("01-01 12:00", 9.0), ("01-02 12:00", 6.0)]
    assert [r["i"] for r in out_of_order(df, spec).collect()] == [3]


def test_intervals():
    assert Interval.of(years=1, months=2).months == 14 and Interval.of(weeks=1, days=1, hours=1, minutes=1, seconds=1.5, milliseconds=500).seconds == 694862.0
    assert Interval.of(days=1).over(Interval.of(hours=6)) == 4 and Interval.of(years=1).over(Interval.of(months=3)) == 4 and not Interval()
    for wrong in (lambda: Interval.of(fortnights=1), lambda: Interval.of(months=1).micros, lambda: Interval.of(months=1).over(Interval.of(days=1))):
        with pytest.raises(ValueError):
            wrong()


def test_names_of_data_sets(spark, tmp_path):
    assert agg.dataset_name("a/b/gym.csv", Interval.of(months=3)) == "agg_gym_months_3" and agg.dataset_name("x", Interval.of(hours=1)) == "agg_x_seconds_3600"
    df = spark.createDataFrame([(1, t("2020-01-01T00:00:00"), 2.0), (1, t("2020-01-01T01:00:00"), 3.0)], "k long, ts timestamp, x double")
    made = [agg.generate_dataset(df.where(F.col("x") < n), StreamSpec(("k",), "ts"), Aggregation(Interval.of(days=1), (("x", "sum"),)), str(tmp_path), "s.csv") for n in (9, 2.5)]
    assert made[0] == made[1] and [r["x"] for r in spark.read.parquet(made[0]).collect()] == [5.0]  # the second call finds it there


SPEC = StreamSpec(("k",), "ts", ("i",), reset="r")


@pytest.fixture(scope="module")
def stream(spark):
    rows = [(k, t("2020-01-01T00:00:00") + dt.timedelta(hours=i), i, int(i % 4 == 0), float(i * i)) for k in (1, 2) for i in range(10)]
    return spark.createDataFrame(rows, "k long, ts timestamp, i long, r int, x double")


def test_filter_chain(stream):
    """A delta takes the first record of each sequence, a range some more; resets are those of any filter."""
    chain = records.chain(stream, SPEC, [lambda d, s: records.delta(d, s, "x"), lambda d, s: d.where("delta < 12")])
    got = [(r["i"], r["delta"], r["_reset"]) for r in chain.where("k = 1").orderBy("i").collect()]
    assert got == [(1, 1.0, 1), (2, 3.0, 0), (3, 5.0, 0), (5, 9.0, 1), (6, 11.0, 0)]


def test_sensor(stream):
    from tidemark.functions.encoders import Multi

    encoders = Multi.of({"x": {"fieldname": "x", "type": "scalar", "w": 3, "low": 0, "high": 100, "n": 13}})
    sensor = records.Sensor(SPEC, encoders, (lambda d, s: records.auto_reset(d, s, Interval.of(hours=3)), lambda d, s: d.where("i <> 5")), Interval.of(hours=1))
    got = {r["i"]: r for r in sensor.sense(stream).where("k = 2").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 6, 7, 8, 9] and list(got[7]["bits"]) == [5, 6, 7]
    assert [i for i in got if got[i]["_reset"]] == [0, 3, 4, 7, 8]  # each 4th record's own, and three hours after each
    assert got[9]["_time_index"] - got[0]["_time_index"] == 9


def test_bookmark(stream):
    """What comes after a bookmark, and a stream that it doesn't know."""
    mark = records.bookmark(stream.where("k = 1 and i < 6"), SPEC)
    assert sorted((r["k"], r["i"]) for r in records.after(stream, SPEC, mark).collect()) == [(1, i) for i in range(6, 10)] + [(2, i) for i in range(10)]


def test_projection_and_names(stream):
    assert records.project(stream, ["x", "k"]).columns == ["x", "k"] and records.project(stream, ["*"]).columns == stream.columns
    with pytest.raises(ValueError):
        records.project(stream, ["nothing"])
    assert records.matching(["x.*", "ab"], ["xy", "ax", "abc"]) == ["xy", "abc"] and records.matching([], ["a"]) is None
    both = records.filter_records(stream, {"x": {"type": "number", "min": 4, "max": 50}, "i": {"type": "category", "acceptValues": [2, 5, 9]}})
    assert sorted({r["i"] for r in both.collect()}) == [2, 5]


def test_record_meta_without_flags(spark, stream):
    """No flags: one sequence, no resets. A sequence id: a reset where it changes. A category and a learning flag."""
    bare = records.with_record_meta(stream, StreamSpec(("k",), "ts", ("i",))).collect()
    assert {(r["_reset"], r["_sequence"], r["_learning"], r["_time_index"]) for r in bare} == {(0, 0, True, None)}
    df = stream.withColumns({"s": F.floor(F.col("i") / 3), "c": F.col("i") % 2, "l": F.col("i") % 5})
    rows = records.with_record_meta(df, StreamSpec(("k",), "ts", ("i",), sequence="s", category="c", learning="l")).where("k = 1").orderBy("i").collect()
    assert [r["_reset"] for r in rows] == [1, 0, 0, 1, 0, 0, 1, 0, 0, 1] and len({r["_sequence"] for r in rows}) == 4
    assert [list(r["_category"]) for r in rows[:2]] == [[0], [1]] and [r["_learning"] for r in rows] == [False, True, True, True, True] * 2


def test_planted_copies_keep_their_pace(stream):
    df = generators.respaced(generators.copy(stream, StreamSpec(("k",), "ts", ("i",)), 2, 3, 4), StreamSpec(("k",), "ts", ("i",)), "rec_idx")
    got = [(r["i"], str(r["ts"])[11:16]) for r in df.where("k = 1").orderBy("rec_idx").collect()]
    assert [i for i, _ in got] == [0, 1, 2, 3, 2, 3, 4, 5, 6, 7, 8, 9] and [h for _, h in got] == [f"{h:02d}:00" for h in range(12)]


def test_sequences_of_patterns(spark):
    numbers = generators.sequence_numbers(3, 4, shared=(1, 3))
    assert len(numbers) == 15 and numbers[4] is None and numbers[1:3] == numbers[6:8] == [1, 2] and len(set(numbers) - {None}) == 8
    rows = generators.sequence(spark, numbers, 100, 7).orderBy("rec_idx").collect()
    assert [r["reset"] for r in rows] == [0, 0, 0, 0, 1] * 3 and rows[4]["bits"] is None and rows[1]["bits"] == rows[6]["bits"] and rows[0]["bits"] != rows[5]["bits"]
    noisy = generators.sequence(spark, numbers, 100, 7, noise=0.3).orderBy("rec_idx").collect()
    assert all(len(a["bits"]) == 7 and len(set(a["bits"]) & set(b["bits"])) == 5 for a, b in zip(rows, noisy) if a["bits"])
    names = generators.records(spark, 2000, {"c": generators.random_category(["a", "b"]), "g": generators.gaussian(5.0, 2.0)}).agg(F.avg((F.col("c") == "a").cast("int")).alias("a"), F.avg("g").alias("m"), F.stddev("g").alias("s")).first()
    assert abs(names["a"] - 0.5) < 0.05 and abs(names["m"] - 5) < 0.2 and abs(names["s"] - 2) < 0.2


def test_a_table_from_a_function(spark):
    df = generators.from_function(spark, lambda part: ((part, i, f"{part}/{i}") for i in range(part * 10_001)), "part long, i long, s string", 3)
    assert df.groupBy("part").count().orderBy("part").collect() == [(1, 10_001), (2, 20_002)] and df.where("part = 2").agg(F.max("i")).first()[0] == 20_001


def test_profiles(spark, tmp_path):
    from tidemark.operators import profile

    df = spark.createDataFrame([(i, "ab"[i % 2], t("2020-01-06T00:00:00") + dt.timedelta(hours=i), None) for i in range(10)], "n long, s string, d timestamp, b binary")
    said = {(r["field"], r["statistic"]): r["value"] for r in profile.profile(df).collect()}
    assert said["n", "n"] == "10" and said["n", "mean"] == "4.5" and said["s", "a"] == "5" and said["d", "time_of_day"] == "true" and said["d", "weekend"] == "false"
    rough = {r["field"]: r for r in profile.entries(df.drop("b"), error=0.05).collect()}
    assert rough["s"]["distinct"] == 2 and rough["n"]["total"] == 10
    first = profile.cached(profile.field_ranges(df), f"{tmp_path}/stats")
    assert profile.cached(profile.field_ranges(df.limit(1)), f"{tmp_path}/stats").collect() == first.collect()
    with pytest.raises(ValueError):
        profile.profile(df.select("b"))
