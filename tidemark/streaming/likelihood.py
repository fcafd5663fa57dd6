"""Anomaly likelihoods as records come, in keyed state that is saved and taken up again.

What operators.anomaly.online_likelihoods says of a whole table, said micro-batch
by micro-batch: each record is judged under the last fit, and fits are renewed
every so many records over the history before. The state of a key holds moments,
not records: a ring of blocks that make up the history, each with the sums
of its averaged scores and of their squares, and with what the first
averages would lack if the history began with the block (an average of a history
that begins later than the stream has fewer terms at its start). Blocks are as
long as the greatest length that divides the history and the steps of the fits,
so a history always begins with one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.functions.maths import log_likelihood, tail_probability
from tidemark.operators.anomaly import LEAST_MEAN, LEAST_VARIANCE, RED, YELLOW
from tidemark.spec import StreamSpec
from tidemark.streaming.stateful import in_order

#: n: records so far; recent: the last raw scores; m1, m2: each block's sums; c1, c2: their corrections; mean, dev: of the last fit; before_*: how the last record was judged.
STATE = "n long, recent array<double>, m1 array<double>, m2 array<double>, c1 array<double>, c2 array<double>, mean double, dev double, before_avg double, before_mean double, before_dev double"

#: The score on its way to the processor (a name that begins with an underscore wouldn't arrive).
RAW = "raw_score_of_record"


@dataclass(frozen=True, slots=True)
class Fitting:
    """When fits are made, and over what."""

    learning: int = 288
    samples: int = 100
    history: int = 8640
    every: int = 100
    average: int = 10

    def __post_init__(self):
        if self.history < self.average:
            raise ValueError("the history is shorter than an average")

    @property
    def wait(self) -> int:
        return self.learning + self.samples

    @property
    def block(self) -> int:
        return math.gcd(self.every, self.history, max(0, self.wait - self.history))

    def next_due(self, n: int) -> int:
        """The first record from n on before which a fit is made."""
        return self.wait if n <= self.wait else -(-n // self.every) * self.every


class Moments:
    """A key's state. `add` takes raw scores in order and says how each is judged: its average, mean and deviation (NaN before the first fit)."""

    def __init__(self, fitting: Fitting, state: tuple | None = None):
        self.of = fitting
        self.n, self.recent, self.m1, self.m2, self.c1, self.c2, self.mean, self.dev, *self.before = state or (0, [], [], [], [], [], None, None, None, None, None)
        self.recent, self.m1, self.m2, self.c1, self.c2 = (list(x) for x in (self.recent, self.m1, self.m2, self.c1, self.c2))

    def state(self) -> tuple:
        return self.n, self.recent, self.m1, self.m2, self.c1, self.c2, self.mean, self.dev, *self.before

    def _fit(self) -> None:
        """Over the blocks at hand, which are the history before record n."""
        f = self.of
        begin = max(0, self.n - f.history)
        keep = -(-(self.n - begin) // f.block)
        self.m1, self.m2, self.c1, self.c2 = (x[-keep:] for x in (self.m1, self.m2, self.c1, self.c2))
        k = self.n - begin - min(self.n - begin, max(0, f.learning - begin))
        if k <= 0:
            self.mean, self.dev = 0.5, math.sqrt(1e6)
            return
        m1, m2 = sum(self.m1) + (self.c1[0] if begin else 0.0), sum(self.m2) + (self.c2[0] if begin else 0.0)
        self.mean, self.dev = max(m1 / k, LEAST_MEAN), math.sqrt(max(m2 / k - (m1 / k) ** 2, LEAST_VARIANCE))

    def _take(self, raw: np.ndarray) -> np.ndarray:
        """The averages of some records between two fits; they go into their blocks."""
        f = self.of
        have = len(self.recent)
        both = np.concatenate([self.recent, raw])
        sums = np.concatenate([[0.0], np.cumsum(both)])
        at = np.arange(have, len(both))
        low = np.maximum(at + 1 - f.average, 0)
        avg = (sums[at + 1] - sums[low]) / (at + 1 - low)
        number = self.n + np.arange(len(raw))
        counts = number >= f.learning
        block = number // f.block
        first = self.n // f.block - (len(self.m1) - 1 if self.n % f.block else len(self.m1))  # the number of the ring's first block
        for _ in range(int(block[-1]) - first + 1 - len(self.m1)):
            for x in (self.m1, self.m2, self.c1, self.c2):
                x.append(0.0)
        for x, values in ((self.m1, avg), (self.m2, avg * avg)):
            for b, v in zip(block[counts].tolist(), values[counts].tolist(), strict=True):
                x[b - first] += v
        # what an average lacks in a history that begins with a block: only that history's own records are terms
        for b in range(max(first, int(number[0] - f.average + 2) // f.block), int(block[-1]) + 1):
            begin = b * f.block
            own = np.flatnonzero(counts & (number >= begin) & (number < begin + f.average - 1))
            if begin and len(own):
                j = at[own]
                start = j - (number[own] - begin)
                partial = (sums[j + 1] - sums[start]) / (number[own] - begin + 1)
                self.c1[b - first] += float((partial - avg[own]).sum())
                self.c2[b - first] += float((partial * partial - avg[own] * avg[own]).sum())
        self.recent = both[max(0, len(both) - max(1, f.average - 1)) :].tolist()
        self.n += len(raw)
        return avg

    def add(self, raw: np.ndarray) -> np.ndarray:
        """Rows of average, mean, deviation, and the three of the record before."""
        out, i = np.full((len(raw), 6), np.nan), 0
        while i < len(raw):
            due = self.of.next_due(self.n)
            if due == self.n:
                self._fit()
                due = self.of.next_due(self.n + 1)
            j = min(len(raw), i + due - self.n)
            out[i:j, 0] = self._take(raw[i:j])
            if self.mean is not None:
                out[i:j, 1], out[i:j, 2] = self.mean, self.dev
            i = j
        out[1:, 3:] = out[:-1, :3]
        out[0, 3:] = [np.nan if x is None else x for x in self.before]
        self.before = [None if np.isnan(x) else float(x) for x in out[-1, :3]]
        return out


class Likelihoods(StatefulProcessor):
    def __init__(self, keys: list[str], order: list[str], fitting: Fitting):
        self.keys, self.order, self.fitting = keys, order, fitting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = in_order(rows, self.order)
        moments = Moments(self.fitting, tuple(self.state.get()) if self.state.exists() else None)
        said = moments.add(got[RAW].astype(np.float64))
        self.state.update(moments.state())
        yield pd.DataFrame(got | dict(zip(("_avg", "_mean", "_dev", "_avg0", "_mean0", "_dev0"), said.T, strict=True)))

    def close(self) -> None:
        pass


def likelihoods(df: DataFrame, spec: StreamSpec, raw: str, fitting: Fitting = Fitting()) -> DataFrame:
    """Over a streaming DataFrame: keys, time and order columns, raw, likelihood and log_likelihood of each record. Records of a micro-batch are taken in their order; later micro-batches come later."""
    kinds = dict(df.dtypes)
    named = list(dict.fromkeys([*spec.keys, spec.ts, *spec.order]))
    own = df.select(*named, F.col(raw).cast("double").alias(RAW)).where(F.col(RAW).isNotNull())
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in named) + f", {RAW} double, _avg double, _mean double, _dev double, _avg0 double, _mean0 double, _dev0 double"
    processor = Likelihoods(list(spec.keys), [spec.ts, *spec.order], fitting)
    said = own.groupBy(*spec.keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode="None")

    def tail(n: str):
        avg, mean, dev = (F.nanvl(F.col(c + n), F.lit(None).cast("double")) for c in ("_avg", "_mean", "_dev"))
        t = tail_probability(avg, mean, dev)
        return F.when(mean.isNotNull(), F.when(avg >= mean, t).otherwise(1 - t))

    again = (tail("") <= RED) & F.coalesce(tail("0") <= RED, F.lit(False))
    likelihood = F.coalesce(1 - F.when(again, YELLOW).otherwise(tail("")), F.lit(0.5))
    done = said.select(*named, F.col(RAW).alias(raw), likelihood.alias("likelihood"))
    return done.withColumn("log_likelihood", log_likelihood(F.col("likelihood")))


def fits(spark: SparkSession, checkpoint: str, spec: StreamSpec) -> DataFrame:
    """The last fit of each key, read from the stream's checkpoint: keys, n (records so far), mean, stdev."""
    held = spark.read.format("statestore").option("stateVarName", "moments").load(checkpoint)
    return held.select(*[F.col("key")[k].alias(k) for k in spec.keys], F.col("value.n").alias("n"), F.col("value.mean").alias("mean"), F.col("value.dev").alias("stdev"))
