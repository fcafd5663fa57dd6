"""Record streams: derived metadata, filters, resets, deltas, row ranges. All are window or row expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.anchors import with_windows
from tidemark.spec import Interval, StreamSpec, micros


def with_index(df: DataFrame, spec: StreamSpec, name: str = "rec_idx") -> DataFrame:
    """The record's place in its stream, from 0."""
    return df.withColumn(name, (F.row_number().over(spec.records()) - 1).cast("long"))


def with_record_meta(df: DataFrame, spec: StreamSpec, period: Interval | None = None) -> DataFrame:
    """_reset, _sequence, _category, _learning and _time_index.

    _reset: the reset flag as 0 or 1, without one, a change of the sequence id
    (a stream's first record counts as one). _sequence: resets so far less one,
    or a hash of the sequence id, or 0. _time_index: whole periods since the
    year 0 (months) or 0001-01-01 (seconds); null without a period.
    """
    w = spec.records()
    if spec.reset:
        reset = F.coalesce((F.col(spec.reset) != 0).cast("int"), F.lit(0))
    elif spec.sequence:
        before = F.lag(spec.sequence).over(w)
        reset = (F.row_number().over(w).eqNullSafe(1) | ~before.eqNullSafe(F.col(spec.sequence))).cast("int")
    else:
        reset = F.lit(0)
    df = df.withColumn("_reset", reset)
    if spec.sequence:
        sequence = F.xxhash64(spec.sequence)
    elif spec.reset:
        sequence = F.sum("_reset").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    else:
        sequence = F.lit(0)
    df = df.withColumn("_sequence", sequence.cast("long"))
    category = F.lit(None).cast("array<long>")
    if spec.category:
        kind = dict(df.dtypes)[spec.category]
        category = F.col(spec.category) if kind.startswith("array") else F.array(F.col(spec.category).cast("long"))
    learning = F.col(spec.learning).cast("boolean") if spec.learning else F.lit(True)
    return df.withColumns({"_category": category, "_learning": learning, "_time_index": time_index(spec.ts, period)})


#: Microseconds from 0001-01-01 to 1970-01-01.
EPOCH_OFFSET = 719162 * 86_400_000_000


def time_index(ts: str, period: Interval | None) -> Column:
    if not period:
        return F.lit(None).cast("long")
    if period.months:
        return F.floor((F.year(ts) * 12 + F.month(ts) - 1) / period.months).cast("long")
    return F.floor((micros(ts) + EPOCH_OFFSET) / period.micros).cast("long")


def in_range(column: str, low=None, high=None) -> Column:
    """low <= x <= high, either open; a missing value never passes."""
    return F.coalesce(reduce(lambda a, b: a & b, [F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None), F.col(column).isNotNull()), F.lit(False))


def accepted(column: str, values: list) -> Column:
    return F.coalesce(F.col(column).isin(values), F.lit(False))


def filter_records(df: DataFrame, conditions: dict[str, dict]) -> DataFrame:
    """conditions: column -> {type: number, min, max} or {type: category, acceptValues}; all have to hold."""
    for column, c in conditions.items():
        df = df.where(accepted(column, c["acceptValues"]) if c["type"] == "category" else in_range(column, c.get("min"), c.get("max")))
    return df


def contains_any(df: DataFrame, substrings: dict[str, list[str]]) -> DataFrame:
    """Records in which any of the columns has any of its substrings (case counts)."""
    tests = [F.coalesce(F.col(c).contains(s), F.lit(False)) for c, some in substrings.items() for s in some]
    return df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def matching(patterns: list[str], names: list[str]) -> list[str] | None:
    """The names that any pattern matches from their start; None without patterns."""
    return [n for n in names if any(re.match(p, n) for p in patterns)] if patterns else None


def auto_reset(df: DataFrame, spec: StreamSpec, every: Interval) -> DataFrame:
    """_reset = 1 on the first record of each stretch of `every` since the stream's first record; explicit resets (spec.reset) stay and anchor anew.

    Time must not go back within a stream; auto_reset_in_order is for streams in which it does.
    """
    w = spec.records()
    own = F.coalesce((F.col(spec.reset) != 0).cast("int"), F.lit(0)) if spec.reset else F.lit(0)
    df = df.withColumn("_own", own).withColumn("_block", F.sum("_own").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = spec.records("_block")
    stretch = F.floor((micros(spec.ts) - F.min(micros(spec.ts)).over(Window.partitionBy(*spec.keys, "_block"))) / every.micros)
    df = df.withColumn("_stretch", stretch)
    turned = F.coalesce(F.col("_stretch") != F.lag("_stretch").over(within), F.lit(False))
    first = F.row_number().over(w) == 1
    return df.withColumn("_reset", (turned | (F.col("_own") == 1) | first).cast("int")).drop("_own", "_block", "_stretch")


def auto_reset_in_order(df: DataFrame, spec: StreamSpec, every: Interval) -> DataFrame:
    """The same in spec.order's order alone, of records that have a time. A record from before the stretch at hand anchors anew without a reset of its own; explicit resets anchor, too."""
    forced = F.coalesce(F.col(spec.reset) != 0, F.lit(False)) if spec.reset else F.lit(False)
    done = with_windows(df, spec, every, forced)
    # a stretch that its anchor begins has a reset only as the stream's first record or by its own; the later ones of an anchor have one each
    return done.withColumn("_reset", (forced | F.col("_first") | (F.col("_opens") & ~F.col("_anchors"))).cast("int")).drop("_start", "_anchor", "_opens", "_anchors", "_first")


def delta(df: DataFrame, spec: StreamSpec, column: str, name: str = "delta") -> DataFrame:
    """x less the sequence's previous x; a sequence's first record goes, and its successor bears the reset. Needs _reset (with_record_meta)."""
    df = df.withColumn("_block", F.sum("_reset").over(spec.records().rowsBetween(Window.unboundedPreceding, 0)))
    w = spec.records("_block")
    value = micros(column) / 1e6 if dict(df.dtypes)[column].startswith("timestamp") else F.col(column)
    df = df.withColumns({name: value - F.lag(value).over(w), "_at": F.row_number().over(w)})
    return df.where("_at > 1").withColumn("_reset", (F.col("_at") == 2).cast("int")).drop("_at", "_block")


def row_range(df: DataFrame, spec: StreamSpec, first: int = 0, last: int | None = None) -> DataFrame:
    """Records first (inclusive) to last (exclusive) of each stream."""
    df = with_index(df, spec, "_at").where(F.col("_at") >= first)
    return (df if last is None else df.where(F.col("_at") < last)).drop("_at")


def last_records(df: DataFrame, spec: StreamSpec, n: int) -> DataFrame:
    """The last n records of each stream."""
    back = Window.partitionBy(*spec.keys).orderBy(*[F.desc(c) for c in (spec.ts, *spec.order)])
    return df.withColumn("_at", F.row_number().over(back)).where(F.col("_at") <= n).drop("_at")


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """['*']: all; an unknown column is an error."""
    if columns == ["*"]:
        return df
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*columns)


def align(left: DataFrame, right: DataFrame, keys: list[str], of_left: list[Column], of_right: list[Column]) -> DataFrame:
    """Both sides' records of equal keys, side by side: keys and the aggregates of each side, null where a side has none. Each side is aggregated first, so that a key is one row however often it comes."""
    return left.groupBy(*keys).agg(*of_left).join(right.groupBy(*keys).agg(*of_right), keys, "full_outer")


def bookmark(df: DataFrame, spec: StreamSpec) -> DataFrame:
    """How far a stream has been read: keys, and upto, its last record's time and order."""
    return df.groupBy(*spec.keys).agg(F.max(spec.first_by).alias("upto"))


def after(df: DataFrame, spec: StreamSpec, mark: DataFrame) -> DataFrame:
    """The records that come after a bookmark; streams that it doesn't name are read whole."""
    return df.join(mark, list(spec.keys), "left").where(F.col("upto").isNull() | (spec.first_by > F.col("upto"))).drop("upto")


def chain(df: DataFrame, spec: StreamSpec, filters: list[Callable[[DataFrame, StreamSpec], DataFrame]]) -> DataFrame:
    """Filters one after another. Each takes and gives records; a record passes if all pass it, and its _reset is set if any of them, or the record before all filters, sets it."""
    df = df if "_reset" in df.columns else with_record_meta(df, spec)
    for f in filters:
        df = f(df.withColumn("_before", F.col("_reset")), spec).withColumn("_reset", F.greatest("_before", "_reset")).drop("_before")
    return df


@dataclass(frozen=True, slots=True)
class Sensor:
    """Records to encoded records: derived metadata, a chain of filters, then the encoders' bits (encoders: an object with encode())."""

    spec: StreamSpec
    encoders: object
    filters: tuple[Callable[[DataFrame, StreamSpec], DataFrame], ...] = ()
    period: Interval | None = None

    def sense(self, df: DataFrame, bits: str = "bits") -> DataFrame:
        """df's records that pass, with _reset, _sequence, _category, _learning, _time_index and their bits."""
        df = with_record_meta(df, self.spec, self.period)
        return chain(df, self.spec, list(self.filters)).withColumn(bits, self.encoders.encode())
