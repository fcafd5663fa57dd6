"""Window-shaped operators over record order: moving statistics, shifts, regressions, runs, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.spec import StreamSpec


def _frame(spec: StreamSpec, size: int | None, *within: str):
    return spec.records(*within).rowsBetween(Window.unboundedPreceding if size is None else -(size - 1), 0)


def moving_average(spec: StreamSpec, column: str, size: int) -> Column:
    """Mean of the last `size` values, of fewer at the start."""
    return F.avg(column).over(_frame(spec, size))


def moving_mode(spec: StreamSpec, column: str, size: int) -> Column:
    """Most frequent of the previous `size` values (the least on a tie); null on the first record."""
    return F.mode(F.col(column), True).over(spec.records().rowsBetween(-size, -1))


def shifted(spec: StreamSpec, column: str, steps: int) -> Column:
    """The value of `steps` records ago."""
    return F.lag(column, steps).over(spec.records())


def shift_inferences(df: DataFrame, spec: StreamSpec, delays: dict[str, int]) -> DataFrame:
    """Move each inference to the record that it is about: null until there is one."""
    return df.withColumns({c: shifted(spec, c, n) for c, n in delays.items()})


def running_range(spec: StreamSpec, column: str) -> tuple[Column, Column]:
    """Least and greatest value so far, at least 1 apart on the first record: the range of an adaptive encoder."""
    w = _frame(spec, None)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return low, F.when(high > low, high).otherwise(low + 1)


def regression_slope(spec: StreamSpec, y: str | Column, x: str | Column, size: int) -> Column:
    """Slope of y over x in the last `size` records; null until the window is full."""
    w = _frame(spec, size)
    full = (F.count(F.lit(1)).over(w) == size) & (F.lit(size) >= 2)
    return F.when(full, F.regr_slope(y, x).over(w))


def exponential_change(spec: StreamSpec, y: str, x: str, size: int) -> Column:
    """exp of the slope of ln y, less 1; not a number where a y of the window is 0 or less."""
    ln = F.when(F.col(y) > 0, F.log(F.col(y))).when(F.col(y).isNotNull(), float("nan"))
    return F.exp(regression_slope(spec, ln, x, size)) - 1


def average_change(df: DataFrame, spec: StreamSpec, y: str, size: int) -> DataFrame:
    """change and abs_change: mean of (y - previous) / previous over the last `size` steps, signed and absolute."""
    before = F.lag(y).over(spec.records())
    df = df.withColumn("_change", F.try_divide(F.col(y) - before, before))
    w = _frame(spec, size)
    return df.withColumns({"change": F.avg("_change").over(w), "abs_change": F.avg(F.abs("_change")).over(w)}).drop("_change")


def run_lengths(df: DataFrame, spec: StreamSpec, bits: str) -> DataFrame:
    """Keys, bit, began, length: stretches of records in which a bit (of an array column) is on."""
    df = df.withColumn("_at", F.row_number().over(spec.records()))
    on = df.select(*spec.keys, "_at", F.explode(bits).alias("bit"))
    island = F.col("_at") - F.row_number().over(Window.partitionBy(*spec.keys, "bit").orderBy("_at"))
    return on.withColumn("_island", island).groupBy(*spec.keys, "bit", "_island").agg(F.min("_at").cast("long").alias("began"), F.count("*").alias("length")).drop("_island")


def stability(spec: StreamSpec, bits: str, steps: int = 1) -> Column:
    """Share of the bits that are also on in each of the `steps` records before."""
    w = spec.records()
    common = F.col(bits)
    for k in range(1, steps + 1):
        common = F.array_intersect(common, F.lag(bits, k).over(w))
    return F.try_divide(F.size(common), F.size(bits))


def cumulative(spec: StreamSpec, column: str) -> Column:
    return F.sum(column).over(_frame(spec, None))


def last_values(spec: StreamSpec, column: str, size: int) -> Column:
    """The last `size` values, oldest first."""
    return F.collect_list(column).over(_frame(spec, size))


def prediction_extent(df: DataFrame, spec: StreamSpec, inputs: str, outputs: str, most: int, share: float = 1.0) -> DataFrame:
    """df with extent: of how many of the next inputs in a row (`most` at most, none beyond a reset) each record's output holds at least a share of the bits."""
    df = df.withColumn("_block", F.sum(F.coalesce((F.col(spec.reset) != 0).cast("int"), F.lit(0))).over(_frame(spec, None)) if spec.reset else F.lit(0))
    ahead = F.collect_list(inputs).over(spec.records("_block").rowsBetween(1, most))
    held = lambda x: F.size(F.array_intersect(x, outputs)) >= share * F.size(x)
    step = lambda s, x: F.struct((s["n"] + (s["on"] & held(x)).cast("int")).alias("n"), (s["on"] & held(x)).alias("on"))
    return df.withColumn("extent", F.aggregate(ahead, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step)["n"]).drop("_block")


def saturation(bits: str, height: int, width: int, box: int = 15) -> Column:
    """Shares of on bits in the boxes of a level of height x width bits (those that have any), as an array of structs (row, column, share, inner); inner: the boxes above, below, left and right have some, too. Bits beyond the last whole box belong to none."""
    rows, columns = height // box, width // box
    at = F.transform(bits, lambda b: F.floor(F.floor(b / width) / box) * columns + F.floor(b % width / box))
    inside = F.zip_with(bits, at, lambda b, k: F.when((F.floor(b / width) < rows * box) & (b % width < columns * box), k))
    inside = F.filter(inside, lambda k: k.isNotNull())
    box_of = lambda k: F.struct(F.floor(k / columns).alias("row"), (k % columns).alias("column"), (F.size(F.filter(inside, lambda o: o == k)) / (box * box)).alias("share"), _surrounded(inside, k, columns).alias("inner"))
    return F.transform(F.array_sort(F.array_distinct(inside)), box_of)


def _surrounded(boxes: Column, k: Column, columns: int) -> Column:
    there = lambda o, ok: ok & F.array_contains(boxes, o)
    return there(k - columns, k >= columns) & F.array_contains(boxes, k + columns) & there(k - 1, k % columns > 0) & there(k + 1, k % columns < columns - 1)
