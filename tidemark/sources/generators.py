"""Synthetic records and planted anomalies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.sdr import with_noise
from tidemark.spec import StreamSpec, micros


def records(spark: SparkSession, n: int, fields: dict[str, Column]) -> DataFrame:
    """n rows with rec_idx; fields are expressions over it."""
    return spark.range(n).withColumnRenamed("id", "rec_idx").withColumns(fields)


def sine(period: float = 20.0, amplitude: float = 1.0, offset: float = 0.0) -> Column:
    return offset + amplitude * F.sin(F.col("rec_idx") * (2 * math.pi / period))


def gaussian(mean: float = 0.0, stdev: float = 1.0, seed: int = 42) -> Column:
    return mean + stdev * F.randn(seed)


def random_category(names: list[str], seed: int = 42) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(F.lit(seed), "rec_idx"), F.lit(len(names))) + 1).cast("int"))


def pattern(number: Column, n: int, w: int, seed: int = 42) -> Column:
    """w of n bits for a pattern's number, by hashed order; null for null (a reset)."""
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.struct(F.xxhash64(F.lit(seed), number, b).alias("h"), b.cast("int").alias("b"))))
    return F.when(number.isNotNull(), F.array_sort(F.transform(F.slice(ranked, 1, w), lambda s: s["b"])))


def _at(spec: StreamSpec) -> Column:
    return F.row_number().over(spec.records()) - 1


def add(df: DataFrame, spec: StreamSpec, column: str, start: int, stop: int, value: float) -> DataFrame:
    """value more on records start to stop (inclusive) of each stream."""
    return df.withColumn("_at", _at(spec)).withColumn(column, F.when(F.col("_at").between(start, stop), F.col(column) + value).otherwise(F.col(column))).drop("_at")


def scale(df: DataFrame, spec: StreamSpec, column: str, start: int, stop: int, factor: float) -> DataFrame:
    return df.withColumn("_at", _at(spec)).withColumn(column, F.when(F.col("_at").between(start, stop), F.col(column) * factor).otherwise(F.col(column))).drop("_at")


def respaced(df: DataFrame, spec: StreamSpec, by: str) -> DataFrame:
    """Times anew in the order of `by`: from the stream's first time on, a step apart that is that of its first two times."""
    whole = Window.partitionBy(*spec.keys)
    place = F.row_number().over(whole.orderBy(by)) - 1
    df = df.withColumn("_us", micros(spec.ts)).withColumn("_second", F.row_number().over(spec.records()))
    df = df.withColumns({"_t0": F.min("_us").over(whole), "_t1": F.min(F.when(F.col("_second") == 2, F.col("_us"))).over(whole)})
    step = F.coalesce(F.col("_t1") - F.col("_t0"), F.lit(0))
    return df.withColumn(spec.ts, F.timestamp_micros(F.col("_t0") + place * step)).drop("_us", "_second", "_t0", "_t1")


def copy(df: DataFrame, spec: StreamSpec, start: int, stop: int, to: int, name: str = "rec_idx") -> DataFrame:
    """Records start to stop once more before record `to`; name counts the new order."""
    df = df.withColumn(name, _at(spec).cast("long"))
    n = stop - start + 1
    again = df.where(F.col(name).between(start, stop)).withColumn(name, F.col(name) - start + to)
    return df.withColumn(name, F.when(F.col(name) >= to, F.col(name) + n).otherwise(F.col(name))).unionByName(again)


def sequence(spark: SparkSession, numbers: list[int | None], n: int, w: int, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """A sequence of patterns: rec_idx, number (null: a reset), reset, bits; a share of each pattern's bits is moved by noise."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "rec_idx long, number int")
    return in_patterns(rows, n, w, noise, seed)


def in_patterns(rows: DataFrame, n: int, w: int, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """rows (rec_idx, number), with reset and bits."""
    rows = rows.withColumns({"reset": F.col("number").isNull().cast("int"), "bits": pattern(F.col("number"), n, w, seed)})
    return rows.withColumn("bits", with_noise("bits", n, noise, F.concat(F.lit(f"{seed}/"), F.col("rec_idx").cast("string")))) if noise else rows


def sequence_numbers(count: int, length: int, shared: tuple[int, int] | None = None) -> list[int | None]:
    """Numbers of `count` sequences of `length` different patterns, a reset after each; the patterns at places shared[0] to shared[1] are the same ones in all."""
    same = range(*shared) if shared else ()
    first = length if shared else 0
    out: list[int | None] = []
    for k in range(count):
        out += [i if i in same else first + k * length + i for i in range(length)] + [None]
    return out


def from_function(spark: SparkSession, make: Callable[[int], Iterator[tuple]], schema: str, parts: int | DataFrame) -> DataFrame:
    """A table of what make(part) yields (rows as tuples): for a number of parts, each in a task of its own; or for the parts that a table's column `part` names. A part that is lost is made again."""
    names = spark.createDataFrame([], schema).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch["part"].tolist():
                rows = make(part)
                while some := list(islice(rows, 10_000)):
                    yield pd.DataFrame(some, columns=names)

    asked = spark.range(parts, numPartitions=parts).withColumnRenamed("id", "part") if isinstance(parts, int) else parts.select("part")
    return asked.mapInPandas(run, schema)
