"""Entropy, log-space arithmetic, densities, ROC, topology, likelihood scales."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import running


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy (nats) of a column's values: one row."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))


def array_entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def log_sum_exp(a: Column, b: Column) -> Column:
    """log(exp a + exp b) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_diff_exp(a: Column, b: Column) -> Column:
    """log(exp a - exp b) for a > b."""
    return a + F.log1p(-F.exp(b - a))


def log_normalised(x: Column) -> Column:
    """An array of logs less the log of their sum."""
    top = F.array_max(x)
    total = top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    return F.transform(x, lambda v: v - total)


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.transform(x, lambda v: F.exp(v - top) / total)


def _judged(df: DataFrame, truth: str, score: str, by: list[str] | None) -> DataFrame:
    """A row a distinct score: by, score, p and q (its true and false rows), p_upto and q_upto (those of no lower score), p_all and q_all. Rows are counted by score first; without `by` the running sums go by range partitions."""
    by = by or []
    counts = df.groupBy(*by, score).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum(1 - F.col(truth).cast("long")).alias("q"))
    if not by:
        return running(counts, [F.desc(score)], {"p_upto": F.col("p"), "q_upto": F.col("q")}).withColumnsRenamed({"p_upto_all": "p_all", "q_upto_all": "q_all"})
    w, whole = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    return counts.withColumns({"p_upto": F.sum("p").over(w), "q_upto": F.sum("q").over(w), "p_all": F.sum("p").over(whole), "q_all": F.sum("q").over(whole)})


def roc_curve(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """fpr and tpr at each distinct score, from the highest down."""
    rows = _judged(df, truth, score, by)
    return rows.select(*(by or []), F.col(score).alias("threshold"), (F.col("q_upto") / F.col("q_all")).alias("fpr"), (F.col("p_upto") / F.col("p_all")).alias("tpr"))


def area(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Trapezoids under a curve that starts at (0, 0)."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(x, y)
    part = (F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0.0))) * (F.col(y) + F.coalesce(F.lag(y).over(w), F.lit(0.0))) / 2
    return df.select(*by, part.alias("part")).groupBy(*by).agg(F.sum("part").alias("auc"))


def auc(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """The area under the ROC curve: each score's false rows lie below all true rows of higher scores and half of its own."""
    part = F.col("q") * (F.col("p_upto") - F.col("p") / 2) / (F.col("p_all") * F.col("q_all"))
    return _judged(df, truth, score, by).groupBy(*(by or [])).agg(F.sum(part).alias("auc"))


def log_likelihood(p: Column) -> Column:
    """A likelihood on a log scale from 0 to 1."""
    return F.log(F.lit(1.0000000001) - p) / -23.02585084720009


def _erfc_coefficients(degree: int = 24) -> list[float]:
    """Of log(erfc(z) exp(z^2) / t) as a polynomial in 2 t - 1, t = 2 / (2 + z): fitted at Chebyshev points to math.erfc, beyond its reach to the asymptotic series."""
    y = np.cos(np.pi * (np.arange(200) + 0.5) / 200)
    t = (y + 1) / 2
    g = []
    for z in 2 / t - 2:
        if z < 20:
            g.append(math.log(math.erfc(z)) + z * z)
        else:
            u = 1 / (2 * z * z)
            g.append(math.log((1 - u * (1 - 3 * u * (1 - 5 * u * (1 - 7 * u)))) / (z * math.sqrt(math.pi))))
    return np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebfit(y, np.array(g) - np.log(t), degree)).tolist()


def erfc(z: Column) -> Column:
    """The complementary error function of z >= 0 as one polynomial: nothing leaves the JVM. Relative error below 1e-11."""
    t = 2 / (2 + z)
    y = 2 * t - 1
    out = F.lit(0.0)
    for c in reversed(_erfc_coefficients()):
        out = out * y + c
    return t * F.exp(out - z * z)


def tail_probability(x: str | Column, mean: Column, stdev: Column) -> Column:
    """Gaussian tail above x, mirrored below the mean; 1.4142 stands for the root of 2."""
    x = F.col(x) if isinstance(x, str) else x
    return erfc(F.abs(x - mean) / stdev / 1.4142) / 2


#: Lanczos coefficients (g = 7) of the gamma function.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x >= 0.5."""
    x = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (x + i)
    t = x + 7.5
    return math.log(math.sqrt(2 * math.pi)) + (x + 0.5) * F.log(t) - t + F.log(total)


def choose(n: Column, k: Column) -> Column:
    """n over k, 0 outside 0..n; exact to 2**53."""
    return F.when((k >= 0) & (k <= n), F.round(F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)))).otherwise(0.0)


def log_density(kind: str, x: Column, **p: Column | float) -> Column:
    """ln of a density (mass) at x: normal (mean, stdev), uniform (low, high), gamma (shape, rate), beta (a, b), poisson (rate), binomial (n, p), geometric (p); -infinity outside."""
    p = {k: F.lit(v) if not isinstance(v, Column) else v for k, v in p.items()}
    never = F.lit(float("-inf"))
    if kind == "normal":
        return -0.5 * F.pow((x - p["mean"]) / p["stdev"], 2) - F.log(p["stdev"]) - 0.5 * math.log(2 * math.pi)
    if kind == "uniform":
        return F.when(x.between(p["low"], p["high"]), -F.log(p["high"] - p["low"])).otherwise(never)
    if kind == "gamma":
        return F.when(x > 0, p["shape"] * F.log(p["rate"]) - log_gamma(p["shape"]) + (p["shape"] - 1) * F.log(x) - p["rate"] * x).otherwise(never)
    if kind == "beta":
        norm = log_gamma(p["a"] + p["b"]) - log_gamma(p["a"]) - log_gamma(p["b"])
        return F.when((x > 0) & (x < 1), norm + (p["a"] - 1) * F.log(x) + (p["b"] - 1) * F.log1p(-x)).otherwise(never)
    if kind == "poisson":
        return F.when(x >= 0, x * F.log(p["rate"]) - p["rate"] - log_gamma(x + 1.0)).otherwise(never)
    if kind == "binomial":
        norm = log_gamma(p["n"] + 1.0) - log_gamma(x + 1.0) - log_gamma(p["n"] - x + 1.0)
        return F.when(x.between(0, p["n"]), norm + x * F.log(p["p"]) + (p["n"] - x) * F.log1p(-p["p"])).otherwise(never)
    if kind == "geometric":
        return F.when(x >= 0, F.log(p["p"]) + x * F.log1p(-p["p"])).otherwise(never)
    raise ValueError(f"no such density: {kind}")


def normal_cdf(x: Column, mean: float | Column, stdev: float | Column) -> Column:
    z = (x - mean) / (stdev * math.sqrt(2))
    half = erfc(F.abs(z)) / 2
    return F.when(z > 0, 1 - half).otherwise(half)


def log_normal_density(vector: str, mean: list[float], covariance: list[list[float]]) -> Column:
    """ln of the multivariate normal density: the whitening matrix is made once, a row is a few products."""
    lower = np.linalg.cholesky(np.array(covariance, float))
    white, n = np.linalg.inv(lower), len(mean)
    less = [F.get(vector, F.lit(i)).cast("double") - float(m) for i, m in enumerate(mean)]
    parts = [sum((less[j] * float(white[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(n)]
    return -0.5 * sum((p * p for p in parts), F.lit(0.0)) - float(np.log(np.diag(lower)).sum() + n / 2 * math.log(2 * math.pi))


def any_of(x: Column) -> Column:
    return F.exists(x, lambda v: v)


def all_of(x: Column) -> Column:
    return F.forall(x, lambda v: v)


def product(x: Column) -> Column:
    """Of an array's values; 1 for none."""
    return F.aggregate(x, F.lit(1.0), lambda a, v: a * v)


def differential_entropy(mass: Column, areas: Column | None = None) -> Column:
    """Of bins' probabilities and areas (1 each if none are given), in nats."""
    if areas is None:
        return array_entropy(mass)
    each = F.zip_with(mass, areas, lambda m, a: F.when(m > 0, -m * F.log(m / a)).otherwise(0.0))
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)


def combinations(column: str, names: tuple[str, str]) -> Column:
    """All unordered pairs of an array's values, each by its place, as an array of structs."""
    n = F.size(column)
    at = lambda i: F.get(column, i)
    pair = lambda i, j: F.struct(at(i).alias(names[0]), at(j).alias(names[1]))
    return F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: pair(i, j))))).otherwise(F.array())


def fuzzy_centres(df: DataFrame, column: str, centres: list[float], rounds: int = 5, power: float = 1.5, fixed: int | None = None) -> list[float]:
    """Fuzzy k-means of numbers: each round is one aggregation over all rows, the driver holds the centres alone; `fixed` is the place of a centre that stays."""
    x = F.col(column).cast("double")
    for _ in range(rounds):
        near = [F.pow(F.greatest(F.abs(x - c), F.lit(1e-12)), F.lit(-1 / (power - 1))) for c in centres]
        total = sum(near, F.lit(0.0))
        row = df.where(x.isNotNull()).agg(*[f for w in near for u in [F.pow(w / total, F.lit(power))] for f in (F.sum(u * x), F.sum(u))]).first()
        moved = [row[2 * i] / row[2 * i + 1] if row[2 * i + 1] else c for i, c in enumerate(centres)]
        centres = [c if i == fixed else m for i, (c, m) in enumerate(zip(centres, moved, strict=True))]
    return centres


def coordinates(index: Column, dims: list[int]) -> Column:
    """Row-major index to coordinates."""
    out, rest = [], index
    for i, d in enumerate(dims):
        size = math.prod(dims[i + 1 :])
        out.append(F.floor(rest / size).cast("long"))
        rest = rest % size
    return F.array(*out)


def index_of(coords: Column, dims: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for i, d in enumerate(dims):
        out = out * d + coords[i]
    return out


def _span(at: Column, radius: int, size: int, wrap: bool) -> Column:
    """Coordinates within radius of one, in a dimension of a size."""
    if wrap:
        return F.array_distinct(F.transform(F.sequence(at - radius, at - radius + min(2 * radius, size - 1)), lambda v: F.pmod(v, F.lit(size))))
    return F.sequence(F.greatest(at - radius, F.lit(0)), F.least(at + radius, F.lit(size - 1)))


def _deeper(indices: Column, span: Column, size: int) -> Column:
    """Row-major indices with each coordinate of one more dimension."""
    return F.flatten(F.transform(indices, lambda a: F.transform(span, lambda v: a * size + v)))


def neighbourhood(centre: Column, radius: int, dims: list[int], wrap: bool = False) -> Column:
    """Indices within radius in each dimension: clipped at the edges, or around them."""
    c = coordinates(centre, dims)
    out = F.array(F.lit(0).cast("long"))
    for i, d in enumerate(dims):
        out = _deeper(out, _span(c[i], radius, d, wrap), d)
    return F.array_sort(out)


def one_hot(at: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == at).cast("int"))
