"""Windows anchored at records, in an order in which time may go back.

A record before the open window closes it and anchors anew; one beyond it moves
the window on by whole lengths. Each window thus depends on the one before, but a
stretch of records is a function of the window that is open when it begins, and
such functions can be taken down for all stretches at once:

1. records are range-split by key and order and written with their part's number;
2. each part's first and last stream is taken down as a function of the start of
   the incoming window (only a part's first stream can have begun before it);
3. the functions are applied one after another, two numbers a part;
4. each part, given its incoming window, is run on its own.

So a stream with most of all records is many tasks' work.

The function: the first record moves the incoming window to within one length
before it, so all that is left of it is its phase, its start modulo the length.
A window of a given phase lives on until a record comes before it, which is a drop
in time that crosses a point of that phase: a drop of a length or more ends all
phases, another one those in a circular interval. Whatever phase ends at a record,
what follows is the same, as that record anchors. What is left over lives on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import written
from tidemark.spec import Interval, StreamSpec, micros

#: A record's number: its part, then its place in it.
PLACES = 40


class Stretch:
    """Consecutive records of one stream: times in microseconds, which of them anchor whatever is open, and the number of the first."""

    def __init__(self, times: np.ndarray, forced: np.ndarray, number: int, length: int):
        self.times, self.forced, self.number, self.length = times, forced, number, length
        self._after: dict[int, tuple[int, int]] = {}

    def _next(self, i: int, start: int) -> tuple[int, int]:
        """Where the next record that anchors is, the window that starts at `start` being open before record i; the start of the window open before it (at the end: place len)."""
        top, step = start, 64
        while i < len(self.times):
            t = self.times[i : i + step]
            before = np.maximum.accumulate(np.concatenate([[top], t]))
            opened = start + (before[:-1] - start) // self.length * self.length
            if (ends := (t < opened) | self.forced[i : i + step]).any():
                k = int(np.argmax(ends))
                return i + k, int(opened[k])
            i, top, step = i + len(t), int(before[-1]), min(2 * step, 1 << 16)
        return len(self.times), start + (top - start) // self.length * self.length

    def anchored_at(self, i: int) -> tuple[int, int]:
        """The window open at the end and the number of its anchor, record i having anchored."""
        chain = []
        while i not in self._after:
            chain.append(i)
            j, start = self._next(i + 1, int(self.times[i]))
            if j == len(self.times):
                self._after[i] = start, self.number + i
            else:
                i = j
        for k in chain:
            self._after[k] = self._after[i]
        return self._after[i]

    def function(self) -> list[tuple[int, int, int, int]]:
        """(from, to, start, anchor): phases that end, and the window open at the end then."""
        t, length = self.times, self.length
        if self.forced[0]:
            return [(0, length, *self.anchored_at(0))]
        top = np.maximum.accumulate(t)
        drops = np.flatnonzero((t[1:] < top[:-1]) | self.forced[1:]) + 1
        alive, out = [(0, length)], []
        for i in drops.tolist():
            low, high = int(t[i]), int(top[i - 1])
            if self.forced[i] or high - low >= length:
                gone = [(0, length)]
            else:
                a, b = (low + 1) % length, (high + 1) % length  # points in (low, high]
                gone = [(a, b)] if a < b else [(a, length), (0, b)]
            left = []
            for lo, hi in alive:
                at = lo
                for a, b in sorted(gone):
                    a, b = max(a, at), min(b, hi)
                    if a < b:
                        if at < a:
                            left.append((at, a))
                        out.append((a, b, *self.anchored_at(i)))
                        at = b
                if at < hi:
                    left.append((at, hi))
            alive = left
            if not alive:
                break
        return out

    def run(self, start: int | None, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each record its window's start, the anchor's number, and whether it is the window's first. start: of the incoming window, if there is one."""
        n, length = len(self.times), self.length
        starts, anchors = np.empty(n, np.int64), np.empty(n, np.int64)
        i, before = 0, start
        if start is None or self.times[0] < start or self.forced[0]:
            start, anchor = int(self.times[0]), self.number
        while i < n:
            j, _ = self._next(i + 1 if anchor == self.number + i else i, start)
            top = np.maximum.accumulate(np.maximum(self.times[i:j], start))
            starts[i:j] = start + (top - start) // length * length
            anchors[i:j] = anchor
            if j < n:
                start, anchor = int(self.times[j]), self.number + j
            i = j
        old = np.concatenate([[np.iinfo(np.int64).min if before is None else before], starts[:-1]])
        first = (starts != old) | np.concatenate([[before is None or anchors[0] == self.number], anchors[1:] != anchors[:-1]])
        return starts, anchors, first


def _streams(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[int, tuple, int, pa.RecordBatch]]:
    """(part, key, the number in its part of the first record, records): batches cut where the part or the key changes."""
    part, place = None, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_part", *keys)]
        names = list(zip(*columns, strict=True))
        lo = 0
        for hi in range(1, len(names) + 1):
            if hi == len(names) or names[hi] != names[lo]:
                own, *key = names[lo]
                if own != part:
                    part, place = own, 0
                yield own, tuple(key), place, batch.slice(lo, hi - lo)
                place += hi - lo
                lo = hi


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("_us").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("_forced").to_numpy(zero_copy_only=False).astype(bool)


def _taken_down(length: int, keys: list[str]):
    """A part's first stream as a function, and its last (if another) as the window open at its end. A stream's times and marks are held, 9 bytes a record of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part, held, is_first):
            times, forced = (np.concatenate(a) for a in zip(*(_columns(b) for b in held[1]), strict=True))
            own = Stretch(times, forced, (part << PLACES) | held[0], length)
            ends = own.function() if is_first else []
            start, anchor = own.anchored_at(0)
            return [part, is_first, held[1][0].slice(0, 1), int(times[0]), int(times.max()), start, anchor, [{"lo": a, "hi": b, "start": s, "anchor": n} for a, b, s, n in ends]]

        def given(row) -> pa.RecordBatch:
            part, is_first, record, low, top, start, anchor, ends = row
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("lo", "hi", "start", "anchor")]))
            of = [pa.array([part], pa.int64()), pa.array([is_first]), *(record.column(k) for k in keys), *(pa.array([x], pa.int64()) for x in (low, top, start, anchor)), pa.array([ends], kind)]
            return pa.RecordBatch.from_arrays(of, names=["_part", "_first", *keys, "_low", "_top", "_start", "_anchor", "_ends"])

        part, key, held, is_first = None, None, None, True
        for own, k, place, batch in _streams(batches, keys):
            if (own, k) != (part, key):
                if held and (is_first or own != part):
                    yield given(rows(part, held, is_first))
                is_first = own != part
                part, key, held = own, k, (place, [])
            held[1].append(batch)
        if held:
            yield given(rows(part, held, is_first))

    return run


def _incoming(taken: DataFrame, keys: list[str], length: int) -> dict[int, tuple[int, int]]:
    """The window open as each part begins, if its first stream began before it. The parts' functions come one at a time."""
    out, key, state = {}, None, None
    for r in taken.orderBy("_part", F.desc("_first")).toLocalIterator():
        own = tuple(r[k] for k in keys)
        if not r["_first"] or own != key:
            key, state = own, (r["_start"], r["_anchor"])
            continue
        out[r["_part"]] = state
        start, anchor = state
        if r["_low"] < start:
            state = r["_start"], r["_anchor"]
            continue
        ended = next(((e["start"], e["anchor"]) for e in r["_ends"] if e["lo"] <= start % length < e["hi"]), None)
        state = ended or (start + (r["_top"] - start) // length * length, anchor)
    return out


def with_windows(df: DataFrame, spec: StreamSpec, period: Interval, forced: Column | None = None) -> DataFrame:
    """df's records that have a time, with _start (of the window, a timestamp), _anchor (the number of the record that anchored it: windows of one stream are the same if both are), _opens (the first record of its window), _anchors (a record that anchored) and _first (its stream's first). The order is spec.order's alone; forced: records that anchor whatever is open."""
    keys, length, columns = list(spec.keys), period.micros, df.columns
    order = [*keys, *spec.order, "_us"]
    own = df.withColumns({"_us": micros(spec.ts), "_forced": F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)}).where("_us is not null")
    parts = written(own.repartitionByRange(*order).withColumn("_part", F.spark_partition_id().cast("long")), "parts")
    kinds = dict(own.dtypes)
    in_order = lambda d: d.repartition("_part").sortWithinPartitions("_part", *order)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = f"_part long, _first boolean, {head}, _low long, _top long, _start long, _anchor long, _ends array<struct<lo: long, hi: long, start: long, anchor: long>>"
    taken = in_order(parts.select("_part", *dict.fromkeys(order), "_forced")).mapInArrow(_taken_down(length, keys), schema)
    begin = df.sparkSession.sparkContext.broadcast(_incoming(taken, keys, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, state = None, None, None
        for own, k, place, batch in _streams(batches, keys):
            if own != part:
                state = begin.value.get(own)
            elif k != key:
                state = None
            begins = state is None
            part, key = own, k
            stretch = Stretch(*_columns(batch), (own << PLACES) | place, length)
            starts, anchors, opens = stretch.run(*(state or (None, 0)))
            state = int(starts[-1]), int(anchors[-1])
            kept, number = [batch.column(c) for c in columns], stretch.number + np.arange(len(starts))
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (starts, anchors, opens, anchors == number, begins & (number == number[0])))], names=[*columns, "_start", "_anchor", "_opens", "_anchors", "_first"])

    out = in_order(parts).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", _start long, _anchor long, _opens boolean, _anchors boolean, _first boolean")
    return out.withColumn("_start", F.timestamp_micros("_start"))
