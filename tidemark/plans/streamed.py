"""Queries that run as streams: the table comes in two halves, the stream is stopped between them and takes its state up again; what it gave out is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.catalog import EVENTS, query, table
from tidemark.plans.scoring import ONLINE, PHASED, _likelihood_sql
from tidemark.shared import shared_folder
from tidemark.spec import Interval, micros
from tidemark.streaming import likelihood, models, stateful


def in_halves(spark: SparkSession, df: DataFrame, first: Column, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """What `run` of the stream gave out, and its checkpoint. first: whether a record is in the first half."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for half in (first, ~first):
        df.where(half).write.mode("append").parquet(f"{base}/in")
        out = run(spark.readStream.schema(df.schema).parquet(f"{base}/in"))
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out"), f"{base}/state"


def _middle(df: DataFrame) -> Column:
    """Records before the mean time."""
    return F.col("ts") < F.timestamp_micros(F.lit(df.agg(F.avg(micros("ts")).cast("long")).first()[0]))


@query(_likelihood_sql(ONLINE, "n >= 30"))
def likelihood_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") / 500).alias("raw"))
    fitting = likelihood.Fitting(learning=20, samples=10, history=40, every=5)
    done, _ = in_halves(spark, df, _middle(df), lambda s: likelihood.likelihoods(s, EVENTS, "raw", fitting))
    return done.select("event_id", F.round("likelihood", 6).alias("likelihood"), F.round("log_likelihood", 5).alias("log_likelihood"))


@query(f"{PHASED} SELECT event_id, guess AS prediction FROM g")
def two_gram_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.models import phases

    df = phases(table(spark, sf_dir, "events"), EVENTS, [("learn", 5), ("infer", 2)]).select("user_id", "ts", "event_id", "event_type", (F.col("phase") == "learn").alias("learns"))
    done, _ = in_halves(spark, df, _middle(df), lambda s: models.two_grams(s, EVENTS, "event_type", "learns"))
    return done.select("event_id", "prediction")


@query(
    """WITH t AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 86400000000 AS k, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0 FROM events)
    SELECT user_id, t0 + k * 86400000000 AS w, count(*) AS n, round(sum(value), 4) AS total FROM t GROUP BY user_id, t0, k"""
)
def agg_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows anchored at each user's first record: those that closed, and those that are open at the end."""
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    done, state = in_halves(spark, df, _middle(df), lambda s: stateful.anchored_sums(s, EVENTS, Interval.of(days=1), "value"))
    done = done.unionByName(stateful.open_windows(spark, state, EVENTS))
    return done.select("user_id", micros("start").alias("w"), "n", F.round("sum", 4).alias("total"))
