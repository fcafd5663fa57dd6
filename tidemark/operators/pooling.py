"""Inference over frozen learned state as joins: overlaps, inhibition, segment activity, softmax."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_pattern(records: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `make` says of records (rec, bits), said once for each distinct pattern and given to all its records: a state is met by patterns, not by records. What it makes has a rec."""
    patterns = records.groupBy("bits").agg(F.min("rec").alias("_first"))
    said = make(patterns.select(F.col("_first").alias("rec"), "bits"))
    return records.select("rec", "bits").join(patterns, "bits").select("rec", "_first").join(said.withColumnRenamed("rec", "_first"), "_first").drop("_first")


def overlaps(records: DataFrame, synapses: DataFrame, connected: float = 0.1) -> DataFrame:
    """records (rec, bits), synapses (column, input, permanence) -> rec, column, overlap."""
    on = records.select("rec", F.explode("bits").alias("input"))
    return on.join(synapses.where(F.col("permanence") >= connected).select("column", "input"), "input").groupBy("rec", "column").agg(F.count("*").alias("overlap"))


def inhibited(over: DataFrame, k: int, stimulus: int = 1) -> DataFrame:
    """The k columns of most overlap for each record; of equal ones the higher column."""
    w = Window.partitionBy("rec").orderBy(F.desc("overlap"), F.desc("column"))
    return over.where(F.col("overlap") >= stimulus).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def winners(columns: int, density: float = 0.0, per_area: float = 0.0, area: int | None = None) -> int:
    """How many columns of all may win: by their density, or by how many of an area of columns may (half of it at most)."""
    if density <= 0:
        density = min(per_area / min(columns, area or columns), 0.5)
    return int(density * columns)


def segment_activity(active: DataFrame, synapses: DataFrame, connected: float = 0.5) -> DataFrame:
    """active (rec, cell), synapses (segment, cell, permanence) -> rec, segment, potential, connected."""
    hit = active.join(synapses, "cell")
    return hit.groupBy("rec", "segment").agg(F.count("*").alias("potential"), F.count_if(F.col("permanence") > connected - 1e-5).alias("connected"))


def predictive_cells(activity: DataFrame, segments: DataFrame, threshold: int) -> DataFrame:
    """rec, cell: the owners (segments: segment, cell) of segments whose connected activity reaches the threshold."""
    return activity.where(F.col("connected") >= threshold).join(segments, "segment").select("rec", "cell").distinct()


def softmax(records: DataFrame, weights: DataFrame) -> DataFrame:
    """records (rec, bits), weights (bit, bucket, weight) -> rec, bucket, p."""
    on = records.select("rec", F.explode("bits").alias("bit"))
    z = on.join(weights, "bit").groupBy("rec", "bucket").agg(F.sum("weight").alias("z"))
    w = Window.partitionBy("rec")
    e = F.exp(F.col("z") - F.max("z").over(w))
    return z.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).select("rec", "bucket", "p")


def best(distribution: DataFrame) -> DataFrame:
    """rec, bucket, p of the likeliest bucket (the least on a tie)."""
    return distribution.groupBy("rec").agg(F.max(F.struct("p", (-F.col("bucket")).alias("b"))).alias("m")).select("rec", (-F.col("m.b")).alias("bucket"), F.col("m.p").alias("p"))


def state_differences(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Of two tables of learned state: the keys of rows that only one has or whose other columns differ, with which: only_first, only_second or different."""
    values = [c for c in one.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = pack(one, "_a").join(pack(two, "_b"), keys, "full_outer")
    kind = F.when(F.col("_b").isNull(), "only_first").when(F.col("_a").isNull(), "only_second").when(~F.col("_a").eqNullSafe(F.col("_b")), "different")
    return both.select(*keys, kind.alias("kind")).where("kind is not null")
