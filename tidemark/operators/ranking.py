"""Sorts, top-k and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written
from tidemark.spec import StreamSpec


def sort_records(df: DataFrame, keys: list[str], tie: list[str], fields: list[str] | None = None) -> DataFrame:
    """Ascending by keys, records of equal keys in their own order (tie); Spark's range sort spills by itself."""
    return (df.select(*fields) if fields else df).orderBy(*keys, *tie)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def argmax_all(values: str) -> Column:
    """All places (from 0) of an array's greatest value."""
    return F.transform(F.filter(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] == F.array_max(values)), lambda s: s["i"])


def likely(predictions: str, least: float, most: int) -> Column:
    """Of a map value -> probability: those of at least `least` (or the best one alone), the `most` likeliest."""
    entries = F.map_entries(predictions)
    best = F.array_max(F.map_values(predictions))
    kept = F.filter(entries, lambda e: (e["value"] >= least) | (e["value"] == best))
    ordered = F.array_sort(kept, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.slice(ordered, 1, most)


def sample_range(df: DataFrame, spec: StreamSpec, n: int, start: int = 0, stop: int | None = None, seed: int = 42) -> DataFrame:
    """n records of [start, stop) of each stream, chosen by a seeded hash of stream and place."""
    df = df.withColumn("_at", F.row_number().over(spec.records()) - 1).where(F.col("_at") >= start)
    df = df if stop is None else df.where(F.col("_at") < stop)
    draw = Window.partitionBy(*spec.keys).orderBy(F.xxhash64(F.lit(seed), *spec.keys, "_at"), "_at")
    return df.withColumn("_draw", F.row_number().over(draw)).where(F.col("_draw") <= n).drop("_draw", "_at")


def pick(distribution: str, draw: str | Column) -> Column:
    """The place in an array of weights that a uniform draw falls on."""
    draw = F.col(draw) if isinstance(draw, str) else draw
    total = F.aggregate(distribution, F.lit(0.0), lambda a, x: a + x)
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.when(s["sum"] + x <= draw * total, s["i"] + 1).otherwise(s["i"]).alias("i"))
    return F.aggregate(distribution, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i")), step)["i"]


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums, each row's own part in them, along a total order over all rows; with the sums over all rows, too (<name>_all). Range partitions are numbered as they are written, so that sums and rows agree; each is summed up, and each runs over its own rows."""
    parts = written(df.withColumns(sums).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    of = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = of.select("_part", *[F.coalesce(F.sum(f"_{c}").over(whole), F.lit(0)).alias(f"_{c}") for c in sums], *[F.sum(f"_{c}").over(Window.partitionBy(F.lit(0))).alias(f"{c}_all") for c in sums])
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({c: F.sum(c).over(w) for c in sums}).join(F.broadcast(before), "_part")
    return out.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_part", *[f"_{c}" for c in sums])


def with_places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in a total order over all rows."""
    return running(df, order, {name: F.lit(1).cast("long")}).drop(f"{name}_all")
