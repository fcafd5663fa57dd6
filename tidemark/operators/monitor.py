"""What a predicting state did, record by record: traces of predicted and active cells and columns, metrics over them, and the cells that stand for each sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sdr import column_of, columns_of
from tidemark.spec import StreamSpec

TRACES = ("predicted_active_cells", "predicted_inactive_cells", "predicted_active_columns", "predicted_inactive_columns", "unpredicted_active_columns")


def _none() -> Column:
    return F.array().cast("array<int>")


def predicted(df: DataFrame, spec: StreamSpec, predictive: str, name: str = "predicted") -> DataFrame:
    """df with the cells that the record before predicted (predictive: the cells that each record predicts). The first record of a stream and one with a reset were predicted nothing."""
    before = F.coalesce(F.lag(predictive).over(spec.records()), _none())
    begins = F.coalesce(F.col(spec.reset) != 0, F.lit(False)) if spec.reset else F.lit(False)
    return df.withColumn(name, F.when(begins, _none()).otherwise(before))


def traces(df: DataFrame, active: str, predicted: str, per_column: int) -> DataFrame:
    """df with the five TRACES, as sorted arrays: of the predicted cells (predicted) and their columns those whose column is active (active: columns) and those whose isn't, and the active columns that no cell predicted. A missing array is one of nothing."""
    on, said = F.coalesce(active, _none()), F.coalesce(predicted, _none())
    held = lambda c: F.array_contains(on, column_of(c, per_column))
    df = df.withColumns({TRACES[0]: F.array_sort(F.filter(said, held)), TRACES[1]: F.array_sort(F.filter(said, lambda c: ~held(c)))})
    df = df.withColumns({TRACES[2]: columns_of(F.col(TRACES[0]), per_column), TRACES[3]: columns_of(F.col(TRACES[1]), per_column)})
    return df.withColumn(TRACES[4], F.array_sort(F.array_except(on, TRACES[2])))


def _metric(n: Column) -> Column:
    return F.struct(F.count(n).alias("n"), F.min(n).alias("min"), F.max(n).alias("max"), F.sum(n).alias("sum"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("stdev"))


def metrics(df: DataFrame, names: tuple[str, ...] = TRACES, reset: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each trace (and keys): keys, trace, n, min, max, sum, mean, stdev (of the whole trace) of how many a record has; records with a reset don't count. One pass for all traces."""
    rows = df.where(F.coalesce(F.col(reset) == 0, F.lit(True))) if reset else df
    each = F.array(*[F.struct(F.lit(name).alias("trace"), _metric(F.size(name)).alias("m")) for name in names])
    return rows.groupBy(*keys).agg(each.alias("all")).select(*keys, F.explode("all").alias("s")).select(*keys, "s.trace", "s.m.*")


def sequence_cells(df: DataFrame, label: str, per_column: int) -> DataFrame:
    """The cells that stand for each sequence: label, column, cell, of all that were predicted and active in records of the label; records without a label have no part."""
    cells = df.where(F.col(label).isNotNull()).select(label, F.explode(TRACES[0]).alias("cell")).distinct()
    return cells.select(label, column_of(F.col("cell"), per_column).alias("column"), "cell")


def cells_per_column(cells: DataFrame, label: str) -> DataFrame:
    """One row, as of metrics: how many cells a sequence has in a column."""
    return cells.groupBy(label, "column").agg(F.count("*").alias("of")).agg(_metric(F.col("of")).alias("m")).select(F.lit("cells_per_column").alias("trace"), "m.*")


def sequences_per_cell(cells: DataFrame) -> DataFrame:
    """One row, as of metrics: how many sequences a cell stands for."""
    return cells.groupBy("cell").agg(F.count("*").alias("of")).agg(_metric(F.col("of")).alias("m")).select(F.lit("sequences_per_cell").alias("trace"), "m.*")
