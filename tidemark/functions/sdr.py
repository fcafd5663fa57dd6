"""Sparse binary arrays: sorted arrays of the places that are on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def shifted(bits: Column, by: int | Column) -> Column:
    return F.transform(bits, lambda b: b + by)


def concat(*parts: tuple[Column, int]) -> Column:
    """(bits, width) parts side by side."""
    out, at = [], 0
    for bits, width in parts:
        out.append(shifted(F.coalesce(bits, F.array().cast("array<int>")), at))
        at += width
    return F.concat(*out)


def dense(bits: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains(bits, i).cast("int"))


def sparse(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())


def match(actual: Column, predicted: Column) -> Column:
    """Hits, extra and missing bits, as shares of the actual ones."""
    n = F.size(actual)
    hits = overlap(actual, predicted)
    return F.struct(F.try_divide(hits, n).alias("hits"), F.try_divide(F.size(predicted) - hits, n).alias("extra"), F.try_divide(n - hits, n).alias("missing"))


def transitions(active: Column, predicted: Column) -> Column:
    """Predicted and active, predicted but inactive, active but unpredicted."""
    return F.struct(F.array_intersect(predicted, active).alias("predicted_active"), F.array_except(predicted, active).alias("predicted_inactive"), F.array_except(active, predicted).alias("unpredicted_active"))


def with_noise(bits: Column | str, width: int, share: float, seed: str | Column) -> Column:
    """A share of the on bits off and as many others on, chosen by a seeded hash."""
    seed, bits = F.lit(seed) if isinstance(seed, str) else seed, F.col(bits) if isinstance(bits, str) else bits
    n = F.floor(F.size(bits) * share).cast("int")
    by_hash = lambda a: F.transform(F.array_sort(F.transform(a, lambda b: F.struct(F.xxhash64(seed, b).alias("h"), b.alias("b")))), lambda s: s["b"])
    off = F.array_except(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i.cast("int")), bits)
    return F.array_sort(F.concat(F.slice(by_hash(bits), n + 1, F.size(bits)), F.slice(by_hash(off), F.lit(1), n)))


def raw_anomaly(active: Column, predicted: Column) -> Column:
    """The share of active columns that weren't predicted; none active: 0."""
    n = F.size(active)
    return F.when(n > 0, (n - overlap(active, F.coalesce(predicted, F.array().cast("array<int>")))) / n).otherwise(0.0)


def column_of(cell: Column, per_column: int) -> Column:
    """The column that a cell is in."""
    return F.floor(cell / per_column).cast("int")


def cells_of(column: Column, per_column: int) -> Column:
    """The cells of a column, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(per_column - 1)), lambda i: (column * per_column + i).cast("int"))


def columns_of(cells: Column, per_column: int) -> Column:
    """The columns of an array of cells, in order."""
    return F.array_sort(F.array_distinct(F.transform(cells, lambda c: column_of(c, per_column))))


def learned_only(active: Column, learned: Column) -> Column:
    """Active columns less those that never learned."""
    return F.array_sort(F.array_intersect(active, learned))
