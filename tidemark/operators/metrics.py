"""Error metrics of predictions that are aligned with their truth: running, or over the last `window` records.

A record without truth or prediction counts in no metric; its row repeats the
value so far. All are window aggregates in record order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import shift_inferences
from tidemark.spec import StreamSpec


@dataclass(frozen=True, slots=True)
class Metric:
    """most: only the first so many records with a truth (and a prediction, if one is named) count. name: one of ERRORS, or trivial, moving_mean, moving_mode, two_gram, neg_auc, multi_step, pass_through."""

    name: str
    truth: str
    prediction: str = ""
    window: int | None = None
    steps: int = 1
    error: str = "aae"
    most: int | None = None
    params: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        said = {"window": self.window, "steps": self.steps, "most": self.most, **self.params}
        return ":".join([self.name, *(f"{k}={v!r}" for k, v in sorted(said.items()) if v is not None), f"field={self.truth}"])


def _frame(spec: StreamSpec, window: int | None):
    return spec.records().rowsBetween(Window.unboundedPreceding if window is None else -(window - 1), 0)


def error(name: str, truth: Column, prediction: Column, w, whole) -> Column:
    """One error metric over the frame w; whole: from the stream's first record on."""
    both = truth.isNotNull() & prediction.isNotNull()
    e = F.when(both, truth - prediction) if name not in ("acc", "avg_err") else None
    of = {
        "rmse": lambda: F.sqrt(F.avg(e * e).over(w)),
        "nrmse": lambda: F.try_divide(F.sqrt(F.avg(e * e).over(w)), F.stddev_pop(F.when(both, truth)).over(whole)),
        "aae": lambda: F.avg(F.abs(e)).over(w),
        "alt_mape": lambda: F.coalesce(100 * F.try_divide(F.sum(F.abs(e)).over(w), F.sum(F.when(both, F.abs(truth))).over(w)), F.lit(0.0)),
        "mape": lambda: 100 * F.avg(F.try_divide(F.abs(e), F.abs(truth))).over(w),
        "acc": lambda: F.avg(F.when(both, (truth == prediction).cast("double"))).over(w),
        "avg_err": lambda: F.avg(F.when(both, (truth != prediction).cast("double"))).over(w),
    }
    return of[name]()


ERRORS = ("rmse", "nrmse", "aae", "alt_mape", "mape", "acc", "avg_err")


def with_metric(df: DataFrame, spec: StreamSpec, m: Metric, name: str | None = None) -> DataFrame:
    """df with one more column, the metric's value after each record."""
    name = name or m.name
    if m.most is not None:
        counts = F.col(m.truth).isNotNull() & (F.col(m.prediction).isNotNull() if m.prediction else F.lit(True))
        some = df.withColumn("_counted", F.sum(counts.cast("long")).over(_frame(spec, None)))
        within = lambda c: F.when(F.col("_counted") <= m.most, F.col(c))
        some = some.withColumns({"_truth": within(m.truth), "_said": within(m.prediction) if m.prediction else F.lit(None)})
        own = replace(m, truth="_truth", prediction="_said" if m.prediction else "", most=None, window=None)
        if m.window is not None:
            raise ValueError("a metric of the first records has no window")
        return with_metric(some, spec, own, name).drop("_counted", "_truth", "_said")
    w, whole, rows = _frame(spec, m.window), _frame(spec, None), spec.records()
    truth = F.col(m.truth)
    if m.name in ERRORS:
        return df.withColumn(name, error(m.name, truth, F.col(m.prediction), w, whole))
    if m.name == "trivial":
        df = df.withColumn("_guess", F.lag(m.truth, m.steps).over(rows))
    elif m.name == "moving_mean":
        size = m.params.get("mean_window", 10)
        df = df.withColumn("_guess", F.avg(m.truth).over(rows.rowsBetween(-size - m.steps + 1, -m.steps)))
    elif m.name == "moving_mode":
        size = m.params.get("mode_window", 100)
        df = df.withColumn("_guess", F.mode(truth, True).over(rows.rowsBetween(-size - m.steps + 1, -m.steps)))
    elif m.name == "two_gram":
        df = with_two_gram(df, spec, m.truth, "_guess")
    elif m.name == "pass_through":
        return df.withColumn(name, F.avg(m.prediction).over(w))
    elif m.name == "neg_auc":
        return with_neg_auc(df, spec, m, name)
    elif m.name == "multi_step":  # prediction: map of value -> probability
        best = F.array_max(F.transform(F.map_entries(m.prediction), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("v"))))["v"]
        df = df.withColumn("_guess", best)
    elif m.name == "multi_step_probability":
        each = F.aggregate(F.map_entries(m.prediction), F.lit(0.0), lambda s, e: s + e["value"] * F.abs(truth - e["key"]))
        return df.withColumn(name, F.avg(F.when(truth.isNotNull(), each)).over(w))
    elif m.name == "negative_log_likelihood":  # prediction: map of bucket -> probability
        p = F.coalesce(F.try_element_at(F.col(m.prediction), truth), 1 - F.aggregate(F.map_values(m.prediction), F.lit(0.0), lambda s, v: s + v))
        return df.withColumn(name, F.avg(-F.log(F.greatest(p, F.lit(1e-5)))).over(w))
    else:
        raise ValueError(f"no such metric: {m.name}")
    return df.withColumn(name, error(m.error, truth, F.col("_guess"), w, whole)).drop("_guess")


def with_metrics(df: DataFrame, spec: StreamSpec, metrics: list[Metric], shift: dict[str, int] | None = None) -> DataFrame:
    """df with a column for each metric, named by its label. shift: predictions that are about a later record are first moved there, by so many records."""
    if shift:
        df = shift_inferences(df, spec, shift)
    for m in metrics:
        df = with_metric(df, spec, m, m.label)
    return df


def as_json(df: DataFrame, spec: StreamSpec, labels: list[str], every: int | None = None) -> DataFrame:
    """Keys, record and metrics (JSON of label -> value): of every so many-th record of a stream, or of its last one."""
    values = F.to_json(F.create_map(*[x for c in labels for x in (F.lit(c), F.col(f"`{c}`").cast("double"))]))
    df = df.withColumn("record", F.row_number().over(spec.records()).cast("long"))
    if every is None:
        return df.groupBy(*spec.keys).agg(F.max("record").alias("record"), F.max_by(values, "record").alias("metrics"))
    return df.where(F.col("record") % every == 0).select(*spec.keys, "record", values.alias("metrics"))


def prediction_log(df: DataFrame, spec: StreamSpec, inputs: list[str], predictions: dict[str, str], labels: list[str] = ()) -> DataFrame:
    """What a log of predictions holds: keys and order, reset, the inputs by name, for each prediction (name -> column of the truth) its actual and its own value, then the metrics; all as text, missing as empty."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    reset = F.coalesce((F.col(spec.reset) != 0).cast("int"), F.lit(0)) if spec.reset else F.lit(0)
    said = [x for name, truth in predictions.items() for x in (text(truth).alias(f"{name}.actual"), text(name).alias(name))]
    own = [c for c in dict.fromkeys((*spec.keys, spec.ts, *spec.order)) if c not in inputs]
    return df.select(*own, reset.alias("reset"), *[text(c).alias(c) for c in sorted(inputs)], *said, *[text(c).alias(c) for c in labels])


def with_two_gram(df: DataFrame, spec: StreamSpec, column: str, name: str, learns: Column | None = None) -> DataFrame:
    """What has followed the previous value most often so far (the least on a tie); null if nothing has. learns: the records that count; the others are predicted alone."""
    w = spec.records()
    df = df.withColumns({"_prev": F.lag(column).over(w), "_at": F.row_number().over(w)})
    keys = list(spec.keys)
    counts = F.coalesce(learns, F.lit(False)) if learns is not None else F.lit(True)
    seen = df.where(F.col("_prev").isNotNull() & F.col(column).isNotNull() & counts).select(*keys, "_prev", F.col(column).alias("_next"), "_at")
    n = F.row_number().over(Window.partitionBy(*keys, "_prev", "_next").orderBy("_at"))
    counted = seen.withColumn("_n", n)
    # after each pair, the leader among the previous value's followers: the greatest count so far, the least value of those
    lead = F.max(F.struct(F.col("_n").alias("n"))).over(Window.partitionBy(*keys, "_prev").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))["n"]
    counted = counted.withColumn("_lead", lead)
    leaders = counted.where(F.col("_n") == F.col("_lead"))
    best = F.min("_next").over(Window.partitionBy(*keys, "_prev", "_lead").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    leaders = leaders.withColumn("_best", best).select(*keys, "_prev", "_at", "_best")
    # as of: the last leader before a record, by a union in record order
    asked = df.select(*keys, "_prev", "_at", F.lit(None).cast(dict(df.dtypes)[column]).alias("_best"), F.lit(0).alias("_told"))
    told = leaders.withColumn("_told", F.lit(1))
    both = asked.unionByName(told)
    before = F.last("_best", True).over(Window.partitionBy(*keys, "_prev").orderBy("_at", "_told").rowsBetween(Window.unboundedPreceding, -1))
    guess = both.withColumn("_guess2", before).where("_told = 0 and _prev is not null").select(*keys, "_at", F.col("_guess2").alias(name))
    return df.join(guess, [*keys, "_at"], "left").drop("_prev", "_at")


def with_neg_auc(df: DataFrame, spec: StreamSpec, m: Metric, name: str) -> DataFrame:
    """Minus the area under the ROC curve over the window: one pass over its records in the order of their scores, each positive winning against the negatives below it and half of those beside it."""
    if m.window is None:
        return _running_neg_auc(df, spec, m, name)
    both = F.col(m.truth).isNotNull() & F.col(m.prediction).isNotNull()
    held = F.collect_list(F.when(both, F.struct(F.col(m.prediction).cast("double").alias("p"), F.col(m.truth).cast("int").alias("t")))).over(_frame(spec, m.window))
    start = F.struct(F.lit(None).cast("double").alias("p"), F.lit(0).alias("below"), F.lit(0).alias("beside"), F.lit(0).alias("pos"), F.lit(0.0).alias("won"))

    def step(s: Column, x: Column) -> Column:
        same = s["p"].eqNullSafe(x["p"])
        below, beside = F.when(same, s["below"]).otherwise(s["below"] + s["beside"]), F.when(same, s["beside"]).otherwise(0)  # of equal scores the negatives come first
        return F.struct(x["p"].alias("p"), below.alias("below"), (beside + (x["t"] == 0).cast("int")).alias("beside"), (s["pos"] + (x["t"] == 1).cast("int")).alias("pos"), (s["won"] + F.when(x["t"] == 1, below + 0.5 * beside).otherwise(0.0)).alias("won"))

    df = df.withColumn("_auc", F.aggregate(F.array_sort(held), start, step))
    n = F.col("_auc.pos") * (F.col("_auc.below") + F.col("_auc.beside"))
    return df.withColumn(name, F.when(n > 0, -F.col("_auc.won") / n).otherwise(-0.5)).drop("_auc")


class Ranks:
    """How many records of lower and of equal score there are, over numbered scores: a binary indexed tree for each kind of record."""

    def __init__(self, scores: int):
        self.tree = np.zeros((2, scores + 1), np.int64)

    def add(self, kind: int, at: int) -> None:
        tree, i = self.tree[kind], at + 1
        while i < len(tree):
            tree[i] += 1
            i += i & -i

    def upto(self, kind: int, n: int) -> int:
        """Records among the n lowest scores."""
        tree, total = self.tree[kind], 0
        while n:
            total += int(tree[n])
            n &= n - 1
        return total


def _running_neg_auc(df: DataFrame, spec: StreamSpec, m: Metric, name: str) -> DataFrame:
    """Minus the area over all records so far. Each record's score is numbered within its stream first; a stream's records then pass in order, and each adds the pairs that it wins or loses, found in a tree over the numbers. The tree holds two numbers a distinct score; records aren't held."""
    keys = list(spec.keys)
    t, p = F.col(m.truth).cast("int"), F.col(m.prediction).cast("double")
    own = df.withColumn("_score", F.when(t.isNotNull() & p.isNotNull(), p)).withColumn("_truth", t)
    own = own.withColumn("_at", F.when(F.col("_score").isNotNull(), F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("_score").asc_nulls_last())) - 1))
    own = own.withColumn("_all", F.coalesce(F.max("_at").over(Window.partitionBy(*keys)) + 1, F.lit(0)))
    columns, schema = df.columns, ", ".join(f"`{c}` {k}" for c, k in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ranks, n, won = None, None, [0, 0], 0.0
        for batch in batches:
            out = []
            for *k, at, truth, scores in zip(*(batch.column(c).to_pylist() for c in (*keys, "_at", "_truth", "_all")), strict=True):
                if k != key:
                    key, ranks, n, won = k, Ranks(scores), [0, 0], 0.0
                if at is not None and truth in (0, 1):
                    below = ranks.upto(1 - truth, at)
                    beside = ranks.upto(1 - truth, at + 1) - below
                    won += below + beside / 2 if truth else n[1] - below - beside / 2
                    ranks.add(truth, at)
                    n[truth] += 1
                out.append(-won / (n[0] * n[1]) if n[0] and n[1] else -0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.float64())], names=[*columns, name])

    in_order = own.repartition(*keys).sortWithinPartitions(*keys, spec.ts, *spec.order)
    return in_order.mapInArrow(run, f"{schema}, `{name}` double")


def multi(parts: dict[str, float], window: int | None = None, spec: StreamSpec | None = None) -> Column:
    """A weighted sum of metric columns, averaged over a window if one is given."""
    total = sum((F.col(c) * weight for c, weight in parts.items()), F.lit(0.0))
    return F.avg(total).over(_frame(spec, window)) if window else total


def custom(expression: str, truth: str, prediction: str, spec: StreamSpec, window: int | None = None) -> Column:
    """A mean of a SQL expression over groundTruth and prediction."""
    value = F.expr(expression.replace("groundTruth", f"`{truth}`").replace("prediction", f"`{prediction}`"))
    return F.avg(value).over(_frame(spec, window))


def final_values(df: DataFrame, spec: StreamSpec, names: list[str]) -> DataFrame:
    """The metrics' last values: keys and a column each."""
    return df.groupBy(*spec.keys).agg(*[F.max_by(n, spec.first_by).alias(n) for n in names])
