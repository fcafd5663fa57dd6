"""Exact nearest neighbours of any number of queries: a join by Voronoi cells.

Prototypes go to the cell of their nearest pivot (pivots are a bounded sample).
A query first meets its own cell, which bounds the distance of its k-th
neighbour; it then goes to those other cells alone that can hold something as
near, by the triangle inequality: a prototype of pivot p whose distances to p lie
in [low, high] is no nearer than d(q, p) - high, low - d(q, p), or half of what p
is farther than the query's own pivot. Large cells are dealt in blocks, so what a
task holds has a bound however many prototypes share a vector. Nothing but the
pivots and a few numbers a cell passes through the driver.

Distances are added up from the first component to the last, so they don't depend
on how rows are dealt, and ties go to the smaller row_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written

#: Pivots at most, and their bytes; prototypes for each pivot, about; prototypes in a block, about; queries that meet a block at once.
PIVOTS, PIVOT_BYTES, EACH, BLOCK, TOGETHER = 1024, 16 << 20, 4096, 8192, 256
#: What rounding can be, in parts of the numbers at hand.
ROOM = 1e-9


def stacked(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray, norm: float) -> np.ndarray:
    """Of each a to each b."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = np.abs(a[:, d, None] - b[None, :, d])
        total += gap * gap if norm == 2 else gap if norm == 1 else gap**norm
    return np.sqrt(total) if norm == 2 else total if norm == 1 else total ** (1 / norm)


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, left_out: np.ndarray, k: int, norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest, smaller id first on a tie. Norm 2: a matrix product finds them, with room for its rounding, and only what it finds is measured exactly."""
    if norm == 2:
        far = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0.0))
        room = 1e-5 * (np.sqrt((q * q).sum(1)) + np.sqrt((x * x).sum(1).max()))
    else:
        far, room = distances(q, x, norm), np.zeros(len(q))
    far[left_out] = np.inf
    cut = np.partition(far, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.finfo(float).max)
    a, b = np.nonzero((far <= (cut + room)[:, None]) & np.isfinite(far))
    if norm == 2:
        total = np.zeros(len(a))
        for d in range(q.shape[1]):
            total += (q[a, d] - x[b, d]) ** 2
        exact = np.sqrt(total)
    else:
        exact = far[a, b]
    order = np.lexsort((ids[b], exact, a))
    a, b, exact = a[order], b[order], exact[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], exact[keep]


def _meet(k: int, norm: float):
    """Over rows (cell, block, asks, id, vector, category, part) sorted so that a block's prototypes come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, stack = None, [], None
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "block", "asks")], axis=1)
            cuts = (np.flatnonzero((np.diff(names, axis=0) != 0).any(1)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if lo == hi:
                    continue
                if (own := (names[lo, 0], names[lo, 1])) != at:
                    at, held, stack = own, [], None
                if not names[lo, 2]:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if not held:
                    continue
                if stack is None:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    stack = stacked(whole.column("vector"))
                    rows, parts = whole.column("id"), np.array(whole.column("part").to_pylist(), object)
                    ids = rows.to_numpy(zero_copy_only=False)
                for i in range(lo, hi, TOGETHER):
                    some = batch.slice(i, min(hi, i + TOGETHER) - i)
                    mine = np.array(some.column("part").to_pylist(), object)
                    left_out = (mine[:, None] == parts[None]) & (mine != None)[:, None]  # noqa: E711  of objects
                    a, b, far = nearest(stacked(some.column("vector")), stack, ids, left_out, k, norm)
                    of = pa.array(b)
                    yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(a)), rows.take(of), whole.column("category").take(of), pa.array(far)], names=["query_id", "row_id", "category", "distance"])

    return run


class Cells:
    """The pivots with what is known of their cells: least and greatest distance to the pivot, blocks."""

    def __init__(self, pivots: np.ndarray, norm: float):
        self.pivots, self.norm = pivots, norm
        self.low = self.high = self.blocks = np.zeros(len(pivots))

    def know(self, rows) -> None:
        self.low, self.high, self.blocks = np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf), np.zeros(len(self.pivots), np.int64)
        for r in rows:
            self.low[r["cell"]], self.high[r["cell"]], self.blocks[r["cell"]] = r["low"], r["high"], -(-r["n"] // BLOCK)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = distances(x, self.pivots, self.norm)
        return far.argmin(1), far

    def others(self, x: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The home cell, and what other cells each query has to go to."""
        home, far = self.home(x)
        known = np.isfinite(self.high)
        least = np.maximum(np.maximum(far - self.high, self.low - far), (far - far.min(1)[:, None]) / 2)
        room = ROOM * (far + np.where(known, np.abs(self.high), 0.0) + 1)
        may = known & ((least - room <= bound[:, None]) if self.norm >= 1 else np.ones_like(far, bool))  # below 1 there is no triangle inequality
        may[np.arange(len(x)), home] = False
        return home, may


def neighbours(queries: DataFrame, prototypes: DataFrame, k: int, norm: float = 2.0) -> DataFrame:
    """queries (query_id, vector, part), prototypes (row_id, vector, category, part) -> query_id, row_id, category, distance, rank: the k nearest of each query (fewer, if there are fewer).

    Prototypes of the query's own part are left out (part null: none are). Rows
    without a vector take no part; vectors are of one length.
    """
    spark = queries.sparkSession
    kinds = {"q": dict(queries.dtypes)["query_id"], "r": dict(prototypes.dtypes)["row_id"], "c": dict(prototypes.dtypes)["category"], "p": dict(prototypes.dtypes)["part"]}
    out = f"query_id {kinds['q']}, row_id {kinds['r']}, category {kinds['c']}, distance double"
    vector = F.col("vector").cast("array<double>")
    prototypes = prototypes.where("vector is not null").select("row_id", vector.alias("vector"), "category", "part")
    queries = queries.where("vector is not null").select("query_id", vector.alias("vector"), "part")
    n = prototypes.count()
    if not n:
        return spark.createDataFrame([], f"{out}, rank int")
    size = len(prototypes.select("vector").first()["vector"]) or 1
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * size), n // EACH))
    sample = prototypes.select("vector", F.xxhash64("row_id").alias("_h")).orderBy("_h").limit(most).select("vector").distinct().toArrow()
    cells = Cells(stacked(sample.column("vector").combine_chunks()), norm)
    given = spark.sparkContext.broadcast(cells)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, far = given.value.home(stacked(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int64)), pa.array(far[np.arange(len(home)), home])], names=[*batch.schema.names, "cell", "far"])

    at_home = written(prototypes.mapInArrow(dealt, f"row_id {kinds['r']}, vector array<double>, category {kinds['c']}, part {kinds['p']}, cell long, far double"), "cells")
    cells.know(at_home.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).collect())
    known = spark.sparkContext.broadcast(cells)
    blocks = F.get(F.lit(cells.blocks.tolist()), F.col("cell").cast("int"))
    points = at_home.select("cell", F.pmod(F.xxhash64("row_id"), blocks).alias("block"), F.lit(False).alias("asks"), F.col("row_id").alias("id"), "vector", "category", "part")

    def sent(first: bool):
        """A row for each block that a query goes to: those of its own cell, or of the others that can matter."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = known.value
            for whole in batches:
                for i in range(0, whole.num_rows, TOGETHER):
                    batch = whole.slice(i, TOGETHER)
                    x = stacked(batch.column("vector"))
                    home, may = c.others(x, np.zeros(len(x)) if first else batch.column("bound").to_numpy())
                    if first:
                        may = np.zeros_like(may)
                        may[np.arange(len(x)), home] = True
                    q, cell = np.nonzero(may)
                    times = c.blocks[cell]
                    q, cell = np.repeat(q, times), np.repeat(cell, times)
                    block = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                    take = pa.array(q)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(block), pa.array(np.ones(len(q), bool)), *(batch.column(c).take(take) for c in ("id", "vector", "part"))], names=["cell", "block", "asks", "id", "vector", "part"])

        return run

    def met(asking: DataFrame, first: bool) -> DataFrame:
        going = asking.mapInArrow(sent(first), f"cell long, block long, asks boolean, id {kinds['q']}, vector array<double>, part {kinds['p']}")
        both = points.unionByName(going.withColumn("category", F.lit(None).cast(kinds["c"])))
        found = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "asks").mapInArrow(_meet(k, norm), out)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "row_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    asking = queries.withColumnRenamed("query_id", "id")
    own = written(met(asking, True), "own-cell")
    bound = own.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("bound"))
    asking = asking.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "row_id"))
    return own.unionByName(met(asking, False)).withColumn("rank", place).where(F.col("rank") <= k)
