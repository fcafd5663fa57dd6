"""A record file that grows: read in ranges, appended to, read as a stream that resumes."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from tidemark.sources import lines
from tidemark.sources.records import Field, append_records, read_growing, read_records, write_records

FIELDS = [Field("name", "string"), Field("ts", "datetime", "T"), Field("x", "float"), Field("r", "int", "R")]
HEAD = "name,ts,x,r\nstring,datetime,float,int\n,T,,R\n"


def line(i):
    return f"n{i},2020-01-01 {i // 60 % 24:02}:{i % 60:02}:00.000000,{'' if i % 7 == 0 else i / 2},{i % 2}"


def test_ranges_hold_each_line_once(tmp_path, monkeypatch):
    path = f"{tmp_path}/f.csv"
    body = [line(i) for i in range(200)] + ["", '"a,b",,,', "é" * 50]
    open(path, "w", encoding="utf-8", newline="").write(HEAD + "\r\n".join(body))  # the last line isn't ended
    head, first = lines.header(path)
    assert head == HEAD.split("\n")[:3] and first == len(HEAD)
    for chunk in (7, 64, 1 << 20):
        monkeypatch.setattr(lines, "CHUNK", chunk)
        assert lines.ended(path, first) == lines.size(path) - len("é".encode()) * 50
        for step in (1, 13, 100, 1 << 20):
            got = [v for a in range(first, lines.size(path), step) for b in lines.lines_between(path, a, min(a + step, lines.size(path)), first) for v in b.to_pylist()]
            assert [v["value"] for v in got] == body and [v["rec_idx"] for v in got] == sorted({v["rec_idx"] for v in got})


def test_growing_equals_reading_at_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/f.csv"
    open(path, "w").write(HEAD + "\n".join(map(line, range(500))) + "\n")
    both = [read_growing(spark, path), read_records(spark, path)]
    a, b = (df.orderBy("rec_idx").drop("rec_idx").collect() for df in both)
    assert a == b and len(a) == 500 and both[0].schema["ts"].metadata["special"] == "T"


def test_a_stream_resumes_at_its_offset(spark, tmp_path):
    path = f"{tmp_path}/f.csv"
    open(path, "w").write(HEAD + "\n".join(map(line, range(40))) + "\n" + "half a li")

    def run():
        out = read_growing(spark, path, stream=True)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").orderBy("rec_idx").collect()

    assert [r["name"] for r in run()] == [f"n{i}" for i in range(40)]
    assert len(run()) == 40  # nothing new: a line that isn't ended waits
    open(path, "a").write("ne,,,\n" + "\n".join(map(line, range(40, 60))) + "\n")
    got = run()
    assert [r["name"] for r in got] == [f"n{i}" for i in range(40)] + ["half a line"] + [f"n{i}" for i in range(40, 60)] and got[-1]["x"] == 29.5


def test_appending_keeps_one_header_and_the_order(spark, tmp_path):
    path = f"{tmp_path}/folder"
    of = lambda lo, hi: spark.createDataFrame([(f"m,{i}", dt.datetime(2021, 1, 1, i // 60, i % 60), float(i), 0) for i in range(lo, hi)], "name string, ts timestamp, x double, r int").repartition(4)
    write_records(of(0, 300), FIELDS, ["ts"], path)
    append_records(of(300, 330), FIELDS, ["ts"], path)
    append_records(of(330, 331), FIELDS, ["ts"], path)
    append_records(of(0, 0), FIELDS, ["ts"], path)
    got = read_records(spark, path).orderBy("rec_idx").collect()
    assert [(r["name"], r["x"]) for r in got] == [(f"m,{i}", float(i)) for i in range(331)]
    assert not [n for n in os.listdir(path) if n.startswith("_new")]
    with pytest.raises(ValueError):
        append_records(of(0, 1), FIELDS[:2], ["ts"], path)
