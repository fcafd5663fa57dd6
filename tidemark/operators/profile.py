"""Field statistics: one aggregation pass over all rows; distinct-value statistics by grouping values first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written

NUMBERS = ("int", "bigint", "float", "double", "smallint", "tinyint")


def field_ranges(df: DataFrame) -> DataFrame:
    """A row for each numeric column: field, min, max, sum, n, average; missing values are skipped."""
    cols = [c for c, kind in df.dtypes if kind in NUMBERS]
    each = [F.struct(F.lit(c).alias("field"), *[f(F.col(c)).cast("double").alias(n) for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("average", F.avg))], F.count(c).alias("n")) for c in cols]
    return df.agg(F.array(*each).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """value and n."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


#: Distinct values among which a place is looked up at last, and the parts that more of them are cut into.
FEW, PARTS = 65_536, 64
PLACES = {"median": 0.5, "p1": 0.01, "p99": 0.99}


def numeric_profiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: field, n, distinct, min, max, mean, the values at places int(p n) of the sorted list (median, p1, p99), and the mean step between distinct values.

    One scan counts the values of all columns. Each place is then bracketed by
    quantile sketches of the distinct values, and the counts in the sketch's
    parts are exact, so the part that holds the place is known; it is cut
    again until few values are left. Nothing depends on how rows are dealt.
    """
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns])
    counts = df.select(F.explode(each).alias("s")).where("s.x is not null").groupBy("s.field", "s.x").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    total = counts.groupBy("field").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    rows = total.collect()  # a row a column
    asked = {(r["field"], name): (int(r["n"] * p), r["min"], r["max"], 0, r["distinct"]) for r in rows for name, p in PLACES.items()}
    found = _at(counts, asked)
    out = [(r["field"], r["n"], r["distinct"], r["min"], r["max"], r["mean"], *(found[r["field"], name] for name in PLACES), (r["max"] - r["min"]) / (r["distinct"] - 1) if r["distinct"] > 1 else None) for r in rows]
    return df.sparkSession.createDataFrame(out, "field string, n long, distinct long, min double, max double, mean double, median double, p1 double, p99 double, mean_step double")


def _at(counts: DataFrame, asked: dict) -> dict:
    """The value at each asked place. asked: (field, name) -> place, least and greatest value it can be, values before the least, distinct values between."""
    spark = counts.sparkSession

    def between(some: dict) -> DataFrame:
        bounds = spark.createDataFrame([(f, name, at, lo, hi, before) for (f, name), (at, lo, hi, before, _) in some.items()], "field string, name string, at long, lo double, hi double, before long")
        return counts.join(F.broadcast(bounds), "field").where(F.col("x").between(F.col("lo"), F.col("hi")))

    while many := {key: v for key, v in asked.items() if v[4] > FEW}:
        rows = between(many)
        cuts = rows.groupBy("field", "name").agg(F.percentile_approx("x", [i / PARTS for i in range(1, PARTS)], 20 * PARTS).alias("cuts"))
        part = F.size(F.filter("cuts", lambda c: c < F.col("x")))
        sums = rows.join(F.broadcast(cuts), ["field", "name"]).groupBy("field", "name", part.alias("part")).agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("d"))
        before = {key: v[3] for key, v in many.items()}
        for r in sums.orderBy("field", "name", "part").collect():  # PARTS rows a place at most
            key = r["field"], r["name"]
            if before[key] <= many[key][0] < before[key] + r["n"]:
                asked[key] = many[key][0], r["lo"], r["hi"], before[key], r["d"]
            before[key] += r["n"]
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("field", "name").orderBy("x"))
    rows = between(asked).withColumn("upto", upto).where("upto > at").groupBy("field", "name").agg(F.min("x").alias("x"))
    return {(r["field"], r["name"]): r["x"] for r in rows.collect()}


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    """numeric_profiles of one column, without its name."""
    return numeric_profiles(df, [column]).drop("field")


def string_profile(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The `top` most frequent values, with their counts (the least value first on a tie)."""
    return category_counts(df, column).orderBy(F.desc("n"), "value").limit(top)


def varying_date_parts(df: DataFrame, column: str) -> DataFrame:
    """Which parts of a date vary: a boolean each."""
    parts = {"season": F.quarter(column), "day_of_week": F.dayofweek(column), "weekend": F.weekday(column) > 4, "time_of_day": F.hour(column)}
    return df.agg(*[(F.min(e) != F.max(e)).alias(n) for n, e in parts.items()])


def entries(df: DataFrame, error: float | None = None) -> DataFrame:
    """A row for each column: field, total, n (not missing), distinct. Exact distinct counts expand each row by the number of columns; with a relative error they are sketches, in one pass."""
    distinct = F.count_distinct if error is None else lambda c: F.approx_count_distinct(c, error)
    each = [F.struct(F.lit(c).alias("field"), F.count(F.lit(1)).alias("total"), F.count(c).alias("n"), distinct(c).alias("distinct")) for c, _ in df.dtypes]
    return df.agg(F.array(*each).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def profile(df: DataFrame, top: int = 5) -> DataFrame:
    """Every column by its kind: field, kind, statistic, value (text). Numbers: of numeric_profile; text: `value` and its count for the most frequent ones; dates: whether each part varies."""
    out = None
    numbers = [c for c, kind in df.dtypes if kind in NUMBERS]
    if numbers:
        own = numeric_profiles(df, numbers)
        each = F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("string").alias("value")) for n in own.columns if n != "field"])
        out = own.select("field", F.lit("number").alias("kind"), F.explode(each).alias("s")).select("field", "kind", "s.statistic", "s.value")
    for c, kind in df.dtypes:
        if kind in NUMBERS:
            continue
        if kind.startswith(("timestamp", "date")):
            own, name = varying_date_parts(df, c), "date"
        elif kind == "string":
            own, name = string_profile(df, c, top), "text"
            own = own.select(F.lit(c).alias("field"), F.lit(name).alias("kind"), F.col("value").alias("statistic"), F.col("n").cast("string").alias("value"))
            out = own if out is None else out.unionByName(own)
            continue
        else:
            continue
        names = own.columns
        rows = own.select(F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("string").alias("value")) for n in names])).alias("s"))
        own = rows.select(F.lit(c).alias("field"), F.lit(name).alias("kind"), "s.statistic", "s.value")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no column has a kind that is profiled")
    return out


def cached(df: DataFrame, path: str) -> DataFrame:
    """Statistics that are computed once: written where they aren't yet, then read."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trace_summary(df: DataFrame, keys: list[str], trace: str) -> DataFrame:
    """Of a trace of numbers, by keys: n, min, max, sum, mean, stdev (of the whole trace)."""
    return df.groupBy(*keys).agg(F.count(trace).alias("n"), F.min(trace).alias("min"), F.max(trace).alias("max"), F.sum(trace).alias("sum"), F.avg(trace).alias("mean"), F.stddev_pop(trace).alias("stdev"))


def joint_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """A joint histogram with its conditional probabilities: a, b, n, p_b_given_a, p_a_given_b."""
    n = df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (a, b)])).groupBy(a, b).agg(F.count("*").alias("n"))
    share = lambda c: F.col("n") / F.sum("n").over(Window.partitionBy(c))
    return n.withColumns({"p_b_given_a": share(a), "p_a_given_b": share(b)})
