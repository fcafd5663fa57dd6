"""Two-gram models in keyed state: learnt as records come, exported, and asked with their counts left alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.spec import StreamSpec
from tidemark.streaming.stateful import in_order

#: Columns on their way to the processor (a name that begins with an underscore wouldn't arrive).
VALUE, LEARNS = "model_value", "model_learns"


class TwoGrams(StatefulProcessor):
    """Of each key: the last value, and for each value that was followed, its followers with their counts. Followers that aren't asked for or added to within ttl_ms are forgotten, if it is set."""

    def __init__(self, keys: list[str], order: list[str], ttl_ms: int | None):
        self.keys, self.order, self.ttl = keys, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string")
        self.counts = handle.getMapState("counts", "value string", "followers array<string>, n array<long>", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = in_order(rows, self.order)
        before = self.last.get()[0] if self.last.exists() else None
        held: dict[str, dict[str, int]] = {}
        changed, said = set(), []
        for value, learns in zip(got[VALUE].tolist(), got[LEARNS].tolist(), strict=True):
            value = value if isinstance(value, str) else None
            guess = None
            if before is not None:
                if before not in held:
                    held[before] = dict(zip(*self.counts.getValue((before,)), strict=True)) if self.counts.containsKey((before,)) else {}
                of = held[before]
                if of:
                    guess = min(of, key=lambda v: (-of[v], v))
                if learns and value is not None:
                    of[value] = of.get(value, 0) + 1
                    changed.add(before)
            said.append(guess)
            before = value
        for value in changed:
            self.counts.updateValue((value,), (list(held[value]), list(held[value].values())))
        if before is None:
            self.last.clear()
        else:
            self.last.update((before,))
        yield pd.DataFrame({c: v for c, v in got.items() if c not in (VALUE, LEARNS)} | {"prediction": np.array(said, object)})

    def close(self) -> None:
        pass


def two_grams(df: DataFrame, spec: StreamSpec, column: str, learns: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Over a streaming DataFrame: keys, time and order columns, and prediction: what has followed the value before most often so far (the least on a tie), as text. learns: a boolean column; records where it isn't true are predicted, but leave the counts alone. With a ttl the stream's mode of time is the clock."""
    kinds = dict(df.dtypes)
    named = list(dict.fromkeys([*spec.keys, spec.ts, *spec.order]))
    own = df.select(*named, F.col(column).cast("string").alias(VALUE), (F.coalesce(F.col(learns), F.lit(False)) if learns else F.lit(True)).alias(LEARNS))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in named) + ", prediction string"
    processor = TwoGrams(list(spec.keys), [spec.ts, *spec.order], ttl_ms)
    return own.groupBy(*spec.keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def learnt(spark: SparkSession, checkpoint: str, spec: StreamSpec) -> DataFrame:
    """The counts of a stream's models, read from its checkpoint: keys, value, follower, n."""
    held = spark.read.format("statestore").option("stateVarName", "counts").load(checkpoint)
    pairs = F.explode(F.arrays_zip(F.col("user_map_value.followers").alias("follower"), F.col("user_map_value.n").alias("n")))
    return held.select(*[F.col("key")[k].alias(k) for k in spec.keys], F.col("user_map_key.value").alias("value"), pairs.alias("p")).select(*spec.keys, "value", "p.follower", "p.n")


def inferred(df: DataFrame, spec: StreamSpec, column: str, counts: DataFrame) -> DataFrame:
    """df with prediction, by counts (keys, value, follower, n) that stay as they are."""
    best = F.min(F.struct((-F.col("n")).alias("n"), "follower"))["follower"]
    leaders = counts.groupBy(*spec.keys, F.col("value").alias("_before")).agg(best.alias("prediction"))
    df = df.withColumn("_before", F.lag(F.col(column).cast("string")).over(Window.partitionBy(*spec.keys).orderBy(spec.ts, *spec.order)))
    return df.join(leaders, [*spec.keys, "_before"], "left").drop("_before")
