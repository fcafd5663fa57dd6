"""A record file that grows, as a Spark data source: the lines after its three header lines, each with its byte offset.

In batch the file is read in byte ranges, a task each; a range's lines are those
that begin in it. As a stream its offset is a place in the file, so a query that is
started again goes on where it stopped; a line that isn't ended yet waits. Records
have no line breaks inside (they are escaped), so a break ends a record. Files are
opened by pyarrow's file systems: local or shared paths, hdfs, s3 and gs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "value string, rec_idx long"
#: Bytes of a range, of what is read at once, and of the block in which a file's header has to be.
RANGE, CHUNK, HEAD = 64 << 20, 1 << 20, 1 << 20


def _opened(path: str):
    system, own = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else FileSystem.from_uri("file://" + path)
    return system, own


def size(path: str) -> int:
    system, own = _opened(path)
    return system.get_file_info(own).size


def header(path: str) -> tuple[list[str], int]:
    """The three header lines, and where the first record begins: the file's first block is all that is read."""
    system, own = _opened(path)
    with system.open_input_file(own) as f:
        block = f.read(HEAD)
    lines = block.split(b"\n", 3)
    if len(lines) < 4:
        raise ValueError(f"no three header lines: {path}")
    return [x.decode().rstrip("\r") for x in lines[:3]], sum(len(x) + 1 for x in lines[:3])


def ended(path: str, since: int) -> int:
    """The place after the last line break; `since` if there is none after it."""
    system, own = _opened(path)
    end = system.get_file_info(own).size
    with system.open_input_file(own) as f:
        while end > since:
            start = max(since, end - CHUNK)
            f.seek(start)
            if (at := f.read(end - start).rfind(b"\n")) >= 0:
                return start + at + 1
            end = start
    return since


def lines_between(path: str, start: int, end: int, first: int) -> Iterator[pa.RecordBatch]:
    """The lines that begin in [start, end); first: where the first record begins. A line may end beyond."""
    system, own = _opened(path)
    with system.open_input_file(own) as f:
        at = start if start == first else start - 1  # a line begins here if a break is just before
        f.seek(at)
        skip, rest = start != first, b""
        while at < end or rest:
            block = f.read(CHUNK)
            data = rest + block
            if skip:
                cut = data.find(b"\n")
                if cut < 0:
                    if not block:
                        return
                    at, rest = at + len(data), b""
                    continue
                at, data, skip = at + cut + 1, data[cut + 1 :], False
            values, places = [], []
            *whole, rest = data.split(b"\n")
            if not block and rest:
                whole, rest = [*whole, rest], b""
            for line in whole:
                if at >= end:
                    rest = b""
                    break
                values.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                places.append(at)
                at += len(line) + 1
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(places, pa.int64())], names=["value", "rec_idx"])
            if at >= end or not block:
                return


@dataclass
class Range(InputPartition):
    start: int
    end: int


class _Ranges:
    def __init__(self, path: str):
        self.path, self.first = path, header(path)[1]

    def ranges(self, start: int, end: int) -> list[Range]:
        return [Range(a, min(a + RANGE, end)) for a in range(start, end, RANGE)] or [Range(start, start)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start < partition.end:
            yield from lines_between(self.path, partition.start, partition.end, self.first)


class LinesReader(_Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges(self.first, size(self.path))


class LinesStream(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": self.first}

    def latestOffset(self) -> dict:
        return {"at": ended(self.path, self.first)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start["at"], end["at"])

    def commit(self, end: dict) -> None:
        pass


class RecordLines(DataSource):
    """spark.dataSource.register(RecordLines); spark.read or readStream .format("record_lines").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "record_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options["path"])

    def streamReader(self, schema: StructType) -> LinesStream:
        return LinesStream(self.options["path"])

