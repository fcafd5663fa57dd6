"""Anomaly scores: raw, averaged, thresholded, and likelihoods in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import log_likelihood, tail_probability
from tidemark.functions.sdr import raw_anomaly
from tidemark.operators.windows import moving_average
from tidemark.spec import StreamSpec

#: Floors of a fit, and the least variance of a metric that has one.
LEAST_MEAN, LEAST_VARIANCE, FLAT = 0.03, 0.0003, 1.5e-5
#: The tail at which a record is red, and what it is for the reds that follow it.
RED, YELLOW = 1e-5, 1e-3


def with_raw_score(df: DataFrame, spec: StreamSpec, active: str, predicted: str | None = None) -> DataFrame:
    """Each record's share of unpredicted columns; predicted: what the previous record foresaw (its own active columns if none is named)."""
    return df.withColumn("raw_score", raw_anomaly(F.col(active), F.lag(predicted or active).over(spec.records())))


def score(mode: str, raw: Column, likelihood: Column) -> Column:
    """pure, likelihood (1 less it) or weighted."""
    return {"pure": raw, "likelihood": 1 - likelihood, "weighted": raw * (1 - likelihood)}[mode]


def thresholded(s: Column, threshold: float) -> Column:
    return (s >= threshold).cast("double")


def fit(df: DataFrame, keys: list[str], column: str, metric: str | None = None) -> DataFrame:
    """mean, variance and stdev a key, floored; a metric that hardly varies gives the null distribution."""
    flat = F.coalesce(F.var_pop(metric) < FLAT, F.lit(False)) if metric else F.lit(False)
    mean, variance = F.greatest(F.avg(column), F.lit(LEAST_MEAN)), F.greatest(F.var_pop(column), F.lit(LEAST_VARIANCE))
    done = df.groupBy(*keys).agg(F.when(flat, 0.5).otherwise(mean).alias("mean"), F.when(flat, 1e6).otherwise(variance).alias("variance"))
    return done.withColumn("stdev", F.sqrt("variance"))


def batch_likelihoods(df: DataFrame, spec: StreamSpec, raw: str, average: int = 10, metric: str | None = None, skip: int = 0) -> DataFrame:
    """likelihood and log_likelihood of every record under one fit a stream to its averaged scores (after the first `skip`); runs of red become yellow."""
    df = df.withColumns({"_avg": moving_average(spec, raw, average), "_at": F.row_number().over(spec.records())})
    fits = fit(df.where(F.col("_at") > skip), list(spec.keys), "_avg", metric)
    df = df.join(fits, list(spec.keys), "left").withColumns({"_mean": F.coalesce("mean", F.lit(0.5)), "_dev": F.coalesce("stdev", F.lit(1e3))})
    return _judged(df.drop("mean", "variance", "stdev"), spec, F.lit(True)).drop("_at")


def _judged(df: DataFrame, spec: StreamSpec, ready: Column) -> DataFrame:
    """likelihood and log_likelihood from _avg, _mean and _dev: 0.5 until ready; of a run of red records all but the first are yellow."""
    tail = tail_probability("_avg", F.col("_mean"), F.col("_dev"))
    df = df.withColumn("_tail", F.when(ready, F.when(F.col("_avg") >= F.col("_mean"), tail).otherwise(1 - tail)))
    again = (F.col("_tail") <= RED) & F.coalesce(F.lag("_tail").over(spec.records()) <= RED, F.lit(False))
    df = df.withColumn("likelihood", F.coalesce(1 - F.when(again, YELLOW).otherwise(F.col("_tail")), F.lit(0.5)))
    return df.withColumn("log_likelihood", log_likelihood(F.col("likelihood"))).drop("_avg", "_tail", "_mean", "_dev")


def skipped(n: int | Column, window: int, learning: int) -> Column:
    """How many of the n records so far a fit leaves out: those of the learning period that are still in the window."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(n, F.greatest(F.lit(0), F.lit(learning) - F.greatest(F.lit(0), n - window)))


def online_likelihoods(df: DataFrame, spec: StreamSpec, raw: str, learning: int = 288, samples: int = 100, history: int = 8640, every: int = 100, average: int = 10) -> DataFrame:
    """likelihood and log_likelihood as each record comes: 0.5 for the first learning + samples records; then under the last fit, which is renewed every `every` records over the `history` records before (less those of the learning period).

    All are window aggregates. The averages that a fit takes are those of its own history: at its start they have fewer terms.
    """
    w, wait = spec.records(), learning + samples
    if history < average:
        raise ValueError("the history is shorter than an average")
    df = df.withColumns({"_n": (F.row_number().over(w) - 1).cast("long"), "_avg": moving_average(spec, raw, average)})
    # sums over a history are differences of running sums, the learning period's left out of them
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    learnt = F.when(F.col("_n") >= learning, F.col("_avg"))
    df = df.withColumns({"_r1": F.coalesce(F.sum(learnt).over(past), F.lit(0.0)), "_r2": F.coalesce(F.sum(learnt * learnt).over(past), F.lit(0.0)), "_rk": F.count("_avg").over(past)})
    over = lambda c: F.col(c) - F.coalesce(F.lag(c, history).over(w), F.lit(0))
    skip = skipped(F.col("_n"), history, learning)
    # a fit happens where the first is due, and at each multiple of `every` after it
    due = (F.col("_n") == wait) | ((F.col("_n") > wait) & (F.col("_n") % every == 0))
    sums = {"_m1": over("_r1"), "_m2": over("_r2"), "_k": over("_rk")}
    df = df.withColumns(sums | {"_skip": skip}).drop("_r1", "_r2", "_rk")
    # the averages at the start of a history that begins later than the stream: only its own records are terms
    m1, m2, terms = F.col("_m1"), F.col("_m2"), F.lit(0.0)
    for i in range(average - 1):
        terms = terms + F.lag(raw, history - i).over(w)
        partial, usual, counts = terms / (i + 1), F.lag("_avg", history - i).over(w), (F.col("_n") > history) & (F.col("_skip") <= i)
        m1 = m1 + F.when(counts, partial - usual).otherwise(0.0)
        m2 = m2 + F.when(counts, partial * partial - usual * usual).otherwise(0.0)
    k = F.col("_k") - F.col("_skip")
    mean = F.when(k > 0, F.greatest(m1 / k, F.lit(LEAST_MEAN))).otherwise(0.5)
    variance = F.when(k > 0, F.greatest(m2 / k - F.pow(m1 / k, 2), F.lit(LEAST_VARIANCE))).otherwise(1e6)
    df = df.withColumn("_fit", F.when(due, F.struct(mean.alias("mean"), F.sqrt(variance).alias("dev"))))
    last = F.last("_fit", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_fit", last).withColumns({"_mean": F.col("_fit.mean"), "_dev": F.col("_fit.dev")})
    return _judged(df, spec, F.col("_n") >= wait).drop("_n", "_fit", "_skip", *sums)


def valid_fit(fit: dict) -> bool:
    """Whether a fit that was stored has all its parts: name, mean, variance and stdev of the distribution, and the averaging window and its last values."""
    parts = fit.get("distribution"), fit.get("movingAverage")
    if not all(isinstance(p, dict) for p in parts):
        return False
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return all(number(parts[0].get(k)) for k in ("mean", "variance", "stdev")) and "name" in parts[0] and number(parts[1].get("windowSize")) and isinstance(parts[1].get("historicalValues"), list) and number(parts[1].get("total"))


def labelled(df: DataFrame, spec: StreamSpec, labels: DataFrame, at: str = "rec_idx") -> DataFrame:
    """labels: the names of all ranges (keys, start, stop, label; stop excluded) that a record's place is in, sorted. The ranges are joined by key; a stream has few."""
    names = df.join(labels, list(spec.keys)).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop"))).groupBy(*spec.keys, at).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return df.join(names, [*spec.keys, at], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def without_labels(labels: DataFrame, start: int, stop: int, label: str | None = None) -> DataFrame:
    """Ranges less those that lie in start to stop and have the label (any label if none is named)."""
    inside = (F.col("start") >= start) & (F.col("stop") <= stop)
    return labels.where(~(inside if label is None else inside & (F.col("label") == label)))
