"""Models over streams: each is a function from records to records with predictions."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import Metric, prediction_log, with_metrics, with_two_gram
from tidemark.spec import StreamSpec


def previous_value(df: DataFrame, spec: StreamSpec, column: str, steps: tuple[int, ...] = (1,)) -> DataFrame:
    """Predicts the present value for each step ahead, with probability 1."""
    return df.withColumn("predictions", F.create_map(*[x for s in steps for x in (F.lit(s), F.create_map(F.col(column), F.lit(1.0)))]))


def two_gram(df: DataFrame, spec: StreamSpec, column: str, learns: Column | None = None) -> DataFrame:
    """prediction for this record: the most frequent follower so far of the value before. learns: which records are learnt from."""
    return with_two_gram(df, spec, column, "prediction", learns)


MODELS = {"previous_value": previous_value, "two_gram": two_gram}


def create(name: str):
    """A model by its name."""
    if name not in MODELS:
        raise ValueError(f"no such model: {name}")
    return MODELS[name]


def classified(df: DataFrame, scores: str) -> DataFrame:
    """df with category (the most probable, the least on a tie) and confidences (steps 0 -> category -> probability), from a map of category -> score whose values are made to sum to 1."""
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + v)
    shares = F.transform_values(scores, lambda k, v: F.try_divide(v, total))
    ranked = F.array_sort(F.map_entries(shares), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    return df.withColumns({"category": F.get(ranked, F.lit(0))["key"], "confidences": F.create_map(F.lit(0), shares)})


#: What an anomaly model of one metric is set up with: buckets over its range, the least resolution, the padding of the range on either side.
BUCKETS, LEAST_RESOLUTION, PADDING = 130, 0.001, 0.2


def anomaly_params(df: DataFrame, column: str, low: float | None = None, high: float | None = None, least: float = LEAST_RESOLUTION) -> dict:
    """Encoder parameters of an anomaly model of a metric and its time of day: the range is given, or comes from one aggregation (a standard deviation beyond the extremes)."""
    if low is None or high is None:
        row = df.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.stddev_pop(column).alias("s")).first()
        spread = row["s"] or 1.0
        low, high = row["a"] - spread if low is None else low, row["b"] + spread if high is None else high
    high = low + 1 if low == high else high
    pad = abs(high - low) * PADDING
    return {"value": {"fieldname": column, "type": "distributed", "resolution": max(least, (high - low + 2 * pad) / BUCKETS)}, "time_of_day": {"fieldname": "timestamp", "type": "date", "time_of_day": 21}}


@dataclass(frozen=True, slots=True)
class Experiment:
    """A model over a stream with its metrics. steps: how far ahead its predictions are (they are moved to the records that they are about)."""

    model: str
    column: str
    spec: StreamSpec
    steps: int = 1
    metrics: tuple[Metric, ...] = ()
    cycle: tuple[tuple[str, int], ...] = ()

    @classmethod
    def of(cls, description: dict, spec: StreamSpec) -> Experiment:
        """From {model, predictedField, steps, metrics: [{metric, window, ...}], tasks: [[phase, records], ...]}; an unknown entry is an error."""
        known = {"model", "predictedField", "steps", "metrics", "tasks"}
        if unknown := description.keys() - known:
            raise ValueError(f"unknown entries: {sorted(unknown)}")
        create(description["model"])
        column = description["predictedField"]
        metrics = tuple(Metric(m["metric"], column, "prediction", m.get("window"), **{k: v for k, v in m.items() if k not in ("metric", "window")}) for m in description.get("metrics", ()))
        return cls(description["model"], column, spec, description.get("steps", 1), metrics, tuple(map(tuple, description.get("tasks", ()))))

    def run(self, df: DataFrame) -> DataFrame:
        """df with prediction (for each record, made `steps` before it), phase if there is a cycle, and a column for each metric's label. Records of the phase `infer` are predicted, but not learnt from."""
        df = phases(df, self.spec, list(self.cycle)) if self.cycle else df
        if self.model == "two_gram":
            if self.steps != 1:
                raise ValueError("two_gram predicts one step")
            df = two_gram(df, self.spec, self.column, F.col("phase") != "infer" if self.cycle else None)
        else:
            df = with_metrics(df.withColumn("prediction", F.col(self.column)), self.spec, [], {"prediction": self.steps})
        return with_metrics(df, self.spec, list(self.metrics))

    def log(self, done: DataFrame, inputs: list[str]) -> DataFrame:
        return prediction_log(done, self.spec, inputs, {"prediction": self.column}, [m.label for m in self.metrics])


def load(spark: SparkSession, path: str, spec: StreamSpec) -> Experiment:
    """An experiment's JSON description, read by Spark from wherever it can read."""
    return Experiment.of(json.loads(spark.read.text(path, wholetext=True).first()["value"]), spec)


def phases(df: DataFrame, spec: StreamSpec, cycle: list[tuple[str, int]]) -> DataFrame:
    """phase of each record: (name, records) pairs, over and over."""
    total = sum(n for _, n in cycle)
    at = F.pmod(F.row_number().over(spec.records()) - 1, F.lit(total))
    out, upto = None, 0
    for name, n in cycle:
        upto += n
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return df.withColumn("phase", out)
