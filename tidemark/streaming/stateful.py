"""Structured Streaming: anchored windows in typed keyed state with timers, watermarked and session windows, tees and periodic callbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.anchors import Stretch
from tidemark.spec import Interval, StreamSpec


def in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> dict[str, np.ndarray]:
    """A key's rows of a micro-batch as columns, stably sorted by `order` (missing last). Keys are many and their rows few, so no frame is made on the way."""
    frames = list(rows)
    got = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    by = [got[c] for c in reversed(order)]
    if any(c.dtype.kind not in "biufM" for c in by):
        got = got.sort_values(order, kind="stable")
        return {c: got[c].to_numpy() for c in got.columns}
    at = np.lexsort([c.to_numpy() for c in by]) if by else slice(None)
    return {c: got[c].to_numpy()[at] for c in got.columns}


STATE = "start long, n long, held long, sum double"


class AnchoredSums(StatefulProcessor):
    """Counts and sums of windows anchored at each key's first record. The state is four numbers: the open window's start, its records, its values, their sum.

    A record beyond the open window closes it; so does one from before it, which
    anchors anew, wherever in a micro-batch it stands (records are taken in their
    order). A key that has been idle for long enough has its window closed by a
    timer; its next record then anchors.
    """

    def __init__(self, keys: list[str], order: list[str], length: int, idle: int | None, by_event: bool):
        self.keys, self.order, self.length, self.idle, self.by_event = keys, order, length, idle, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, *open_window = self.state.get() if self.state.exists() else (None, 0, 0, 0.0)
        got = pd.concat(list(rows), ignore_index=True)  # a key's rows of a micro-batch
        got = got.sort_values(self.order, kind="stable") if self.order else got
        us, x = got["us"].to_numpy(np.int64), got["x"].to_numpy(np.float64)
        starts, _, opens = Stretch(us, np.zeros(len(us), bool), 0, self.length).run(start, -1)
        begins = np.flatnonzero(opens | (np.arange(len(us)) == 0))
        counts = np.diff(np.append(begins, len(us)))
        held, sums = np.add.reduceat((~np.isnan(x)).astype(np.int64), begins), np.add.reduceat(np.nan_to_num(x), begins)
        windows = [list(w) for w in zip(starts[begins].tolist(), counts.tolist(), held.tolist(), sums.tolist(), strict=True)]
        if start is not None:
            if opens[0]:
                windows.insert(0, [start, *open_window])
            else:
                windows[0][1:] = [a + b for a, b in zip(windows[0][1:], open_window, strict=True)]
        self.state.update(tuple(windows[-1]))
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            now = int(us.max()) // 1000 if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.idle)
        yield self._given(key, windows[:-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            window = self.state.get()
            self.state.clear()
            yield self._given(key, [window])

    def _given(self, key, windows) -> pd.DataFrame:
        return pd.DataFrame([(*key, *w) for w in windows], columns=[*self.keys, "start_us", "n", "n_values", "sum"])

    def close(self) -> None:
        pass


def anchored_sums(df: DataFrame, spec: StreamSpec, period: Interval, column: str, idle: Interval | None = None, by_event: bool = True) -> DataFrame:
    """Over a streaming DataFrame: keys, start (of a window that closed), n, n_values, sum. The batch form is operators.aggregate; what is still open is in `open_windows`.

    idle: a key without records for so long has its window closed: by event time
    (df needs a watermark, which other keys' records move on) or by the clock.
    Records without a time are left out.
    """
    kinds = dict(df.dtypes)
    order = [c for c in spec.order if c not in (*spec.keys, "us", "x")]
    own = df.select(*spec.keys, *order, F.unix_micros(F.col(spec.ts).cast("timestamp")).alias("us"), F.col(column).cast("double").alias("x")).where("us is not null")
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in spec.keys) + ", start_us long, n long, n_values long, sum double"
    processor = AnchoredSums(list(spec.keys), order, period.micros, None if idle is None else idle.micros // 1000, by_event)
    mode = "None" if idle is None else "EventTime" if by_event else "ProcessingTime"
    done = own.groupBy(*spec.keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode=mode)
    return done.select(*spec.keys, F.timestamp_micros("start_us").alias("start"), "n", "n_values", "sum")


def open_windows(spark: SparkSession, checkpoint: str, spec: StreamSpec) -> DataFrame:
    """The windows that anchored_sums has open, read from the stream's checkpoint: keys, start, n, n_values, sum. With what the stream has given out they are the batch form; the stream itself goes on from them."""
    held = spark.read.format("statestore").option("stateVarName", "window").load(checkpoint)
    return held.select(*[F.col("key")[k].alias(k) for k in spec.keys], F.timestamp_micros(F.col("value.start")).alias("start"), F.col("value.n").alias("n"), F.col("value.held").alias("n_values"), F.col("value.sum").alias("sum"))


def session_windows(df: DataFrame, ts: str, keys: list[str], late: str, gap: str, value: str) -> DataFrame:
    """Sessions that end after a gap, with a watermark: keys, start, end, n, sum."""
    return df.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("sum")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "sum")


def watermarked_windows(df: DataFrame, ts: str, keys: list[str], late: str, length: str, value: str) -> DataFrame:
    """Epoch-aligned windows with a watermark: what plain Spark gives, for streams that don't need anchors."""
    return df.withWatermark(ts, late).groupBy(*keys, F.window(ts, length)).agg(F.count("*").alias("n"), F.sum(value).alias("sum")).select(*keys, "window.start", "n", "sum")


def tee(df: DataFrame, path: str, then: Callable[[DataFrame, int], None] = lambda batch, number: None) -> DataStreamWriter:
    """A writer that saves every micro-batch as Parquet under its number before `then` gets it; a batch that is run again replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        then(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={number}"), number)

    return df.writeStream.foreachBatch(each)


def every(df: DataFrame, n: int, call: Callable[[int], None], path: str) -> DataStreamWriter:
    """A writer that calls with the number of records so far whenever n more have come; only counts reach the driver. They are kept under path by the batch's number: a stream that is started again goes on counting, and a batch that is run again calls with the same numbers."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("n long").parquet(f"{path}/batch={number - 1}").first()["n"] if number else 0
        after = before + batch.count()
        spark.range(1).select(F.lit(after).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        for k in range(before // n + 1, after // n + 1):
            call(k * n)

    return df.writeStream.foreachBatch(each)
