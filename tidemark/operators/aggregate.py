"""Time windows anchored at the first record of each sequence.

Window k of a sequence is [t0 + k P, t0 + (k+1) P), t0 its first record's time;
empty windows aren't emitted and the time of a row is its window's start. One
grouped aggregation, partial on the map side, with a window function only for
the anchors (and for sequence numbers where resets or sequence ids part them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.anchors import with_windows
from tidemark.spec import Aggregation, Interval, StreamSpec, micros

Aggregate = Callable[[Column, Column], Column]

#: Functions by name, of the column and the record order. Missing values are skipped; `sum` counts each as the mean.
FUNCTIONS: dict[str, Aggregate] = {
    "first": lambda x, order: F.min_by(x, F.when(x.isNotNull(), order)),
    "last": lambda x, order: F.max_by(x, F.when(x.isNotNull(), order)),
    "sum": lambda x, order: F.avg(x) * F.count(F.lit(1)),
    "mean": lambda x, order: F.avg(x),
    "min": lambda x, order: F.min(x),
    "max": lambda x, order: F.max(x),
    "mode": lambda x, order: F.mode(x, True),
}


def function(name: str | Aggregate, column: str, order: Column) -> Column:
    """A function by name, `wmean:<weights>`, or any (column, order) -> aggregate."""
    if callable(name):
        return name(F.col(column), order)
    if name.startswith("wmean:"):
        x, w = F.col(column), F.col(name.partition(":")[2])
        both = x.isNotNull() & w.isNotNull()
        return F.try_divide(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))
    return FUNCTIONS[name](F.col(column), order)


def sequences(df: DataFrame, spec: StreamSpec, name: str = "_seq") -> DataFrame:
    """Number a stream's sequences: a reset (not on its first record) or another sequence id begins one."""
    if not (spec.reset or spec.sequence):
        return df.withColumn(name, F.lit(0).cast("long"))
    w = spec.records()
    begins = F.lit(False)
    if spec.reset:
        begins = begins | (F.coalesce(F.col(spec.reset) != 0, F.lit(False)) & (F.row_number().over(w) > 1))
    if spec.sequence:
        begins = begins | (~F.col(spec.sequence).eqNullSafe(F.lag(spec.sequence).over(w)) & (F.row_number().over(w) > 1))
    return df.withColumn(name, F.sum(begins.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def bucket(ts: str, anchor: Column, period: Interval) -> Column:
    """Which window of a sequence a record is in."""
    if not period.months:
        return F.floor((micros(ts) - micros(anchor)) / period.micros)
    months = lambda c: F.year(c) * 12 + F.month(c)
    guess = F.floor((months(F.col(ts)) - months(anchor)) / period.months).cast("int")
    over = start_of(anchor, guess, period) > F.col(ts)
    return (guess - over.cast("int")).cast("long")


def start_of(anchor: Column, k: Column, period: Interval) -> Column:
    if period.months:
        return anchor + F.make_ym_interval(F.lit(0), (k * period.months).cast("int"))
    return F.timestamp_micros(micros(anchor) + (k * period.micros).cast("long"))


def aggregate(df: DataFrame, spec: StreamSpec, agg: Aggregation, legacy_int_division: bool = False) -> DataFrame:
    """Keys, sequence, window start (in spec.ts), and the aggregated columns, in the order of the input.

    Without a period the records pass as they are. legacy_int_division: means of whole numbers are floored.
    """
    if not agg.period:
        return df
    named, kinds = dict(agg.fields), dict(df.dtypes)
    df = sequences(df, spec)
    anchor = F.min(spec.ts).over(Window.partitionBy(*spec.keys, "_seq"))
    df = df.withColumn("_anchor", anchor).withColumn("_bucket", bucket(spec.ts, F.col("_anchor"), agg.period))
    out = []
    for c in kinds:
        if c in (*spec.keys, spec.ts):
            continue
        said = named.get(c, "first")
        value = function(said, c, spec.first_by)
        if legacy_int_division and isinstance(said, str) and said.startswith(("mean", "wmean")) and kinds[c] in ("int", "bigint"):
            value = F.floor(value)
        out.append(value.alias(c))
    done = df.groupBy(*spec.keys, "_seq", "_anchor", "_bucket").agg(*(out or [F.count(F.lit(1)).alias("_n")]))
    done = done.withColumn(spec.ts, start_of(F.col("_anchor"), F.col("_bucket"), agg.period))
    return done.select(*[c for c in kinds if c in done.columns], "_seq")


def aggregate_in_order(df: DataFrame, spec: StreamSpec, agg: Aggregation) -> DataFrame:
    """For records whose time goes back (spec.order alone is the order): a step back closes the window and anchors anew. Keys, window start (in spec.ts), _anchor (the number of the record that anchored the window), and the aggregated columns; records without a time are left out.

    Windows are assigned part by part (operators.anchors), so one stream is many
    tasks' work; then it is one grouped aggregation.
    """
    named = dict(agg.fields)
    order = F.struct(*spec.order)
    out = [function(named.get(c, "first"), c, order).alias(c) for c in df.columns if c not in (*spec.keys, spec.ts)]
    done = with_windows(df, spec, agg.period).groupBy(*spec.keys, "_anchor", "_start").agg(*(out or [F.count(F.lit(1)).alias("_n")]))
    done = done.withColumn(spec.ts, F.col("_start").cast(df.schema[spec.ts].dataType))
    return done.select(*[c for c in df.columns if c in done.columns], "_anchor")


def dataset_name(source: str, period: Interval) -> str:
    """The name of an aggregated data set: of its source and period."""
    length = f"months_{period.months}" if period.months else f"seconds_{period.seconds:g}"
    return f"agg_{source.rstrip('/').rpartition('/')[2].rpartition('.')[0] or source}_{length}"


def generate_dataset(df: DataFrame, spec: StreamSpec, agg: Aggregation, folder: str, source: str) -> str:
    """Aggregate and write once: a data set of that name that is there stays."""
    path = f"{folder.rstrip('/')}/{dataset_name(source, agg.period)}"
    aggregate(df, spec, agg).write.mode("ignore").parquet(path)
    return path
