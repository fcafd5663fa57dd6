"""Capped KNN learning in keyed state: prototypes are stored, used and let go as records come, and read from the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.knn_learn import Recent

HELD = "row_id array<long>, used array<long>, category array<long>, part array<long>, x array<double>"


class Prototypes(StatefulProcessor):
    """Of each key: at most so many prototypes with the row_ids that were last of use to them."""

    def __init__(self, *learning):
        self.learning = learning

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True).sort_values("row_id", kind="stable")  # a key's rows of a micro-batch
        known = Recent(*self.learning)
        if self.held.exists():
            ids, used, categories, parts, x = self.held.get()
            known.rows, known.used, known.x = list(zip(ids, categories, parts, strict=True)), list(used), np.array(x, float).reshape(len(ids), -1)
        whole = lambda v: None if pd.isna(v) else int(v)
        stored = [
            known.learn(np.asarray(v, float), int(row_id), (int(row_id), whole(category), whole(part)))
            for row_id, v, category, part in zip(got["row_id"], got["vector"], got["category"], got["part"], strict=True)
        ]
        if known.rows:
            ids, categories, parts = (list(c) for c in zip(*known.rows, strict=True))
            self.held.update((ids, known.used, categories, parts, known.x.ravel().tolist()))
        yield got.drop(columns=["vector", "category", "part"]).assign(stored=stored)

    def close(self) -> None:
        pass


def capped(df: DataFrame, keys: list[str], most: int, threshold: float = 0.0, norm: float = 2.0, least_bits: int = 0, replace: bool = False) -> DataFrame:
    """Over a streaming DataFrame (keys, row_id, vector, category, part): keys, row_id and stored, whether the vector was stored when it came. The rule is knn_learn.capped's; row_ids grow from one micro-batch to the next. Rows without a vector are left out."""
    kinds = dict(df.dtypes)
    own = df.where("vector is not null").select(*keys, F.col("row_id").cast("long"), F.col("vector").cast("array<double>"), F.col("category").cast("long"), F.col("part").cast("long"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", row_id long, stored boolean"
    processor = Prototypes(most, threshold, norm, least_bits, replace)
    return own.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode="None")


def held(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """The prototypes that a stream holds, read from its checkpoint: keys, row_id, vector, category, part, used."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint).select(*[F.col("key")[k].alias(k) for k in keys], "value.*")
    width = (F.size("x") / F.size("row_id")).cast("int")
    each = F.transform("row_id", lambda r, i: F.struct(r.alias("row_id"), F.slice("x", i * width + 1, width).alias("vector"), F.get("category", i).alias("category"), F.get("part", i).alias("part"), F.get("used", i).alias("used")))
    return state.select(*keys, F.explode(each).alias("p")).select(*keys, "p.*")
