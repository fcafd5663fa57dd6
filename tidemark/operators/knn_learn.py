"""Learning prototypes that keep apart: in order of row_id, a vector is stored if no stored one is nearer than a threshold.

That is the order-first maximal independent set of the graph of near pairs, of
which no pair is ever listed. What is stored of the first vectors rests on these
alone: a block of the first open ones is decided by one task, and all others that
are near to what it stores are dropped where they lie, as matrix work. As long as
blocks drop most of what is open they go on, so where prototypes cover the space
the work grows with the vectors and not with their square. What is left is near to
nothing that is stored, and is decided in cells.

Prototypes go to the cell of their nearest pivot and,
so that a cell sees all that its own members can be near to, to every other cell
whose pivot is not farther by more than twice the threshold. A cell takes its
vectors in order and decides what it can: its own member is dropped if a stored one
is near, stored if nothing earlier that is near is open, and open otherwise. What
has been decided is told to all cells, and the next round decides more, until
nothing is open; rounds grow with the number of cells that a chain of near
vectors runs through. A cell holds its stored and open vectors, never the dropped
ones, so a group of near copies costs one comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.knn_join import EACH, PIVOT_BYTES, PIVOTS, ROOM, distances, stacked
from tidemark.shared import written

OPEN, STORED, DROPPED = 0, 1, 2
#: Vectors of a block that one task decides, and their bytes, at most.
FIRST, FIRST_BYTES = 4096, 8 << 20
#: Vectors that are held against those of a block at once.
ROWS = 1024


class Held:
    """The vectors of a cell that later ones are compared with, in arrays that grow by doubling."""

    def __init__(self, size: int):
        self.x, self.open, self.n = np.empty((64, size)), np.empty(64, bool), 0

    def add(self, v: np.ndarray, is_open: bool) -> None:
        if self.n == len(self.x):
            self.x, self.open = np.concatenate([self.x, np.empty_like(self.x)]), np.concatenate([self.open, np.empty_like(self.open)])
        self.x[self.n], self.open[self.n] = v, is_open
        self.n += 1

    def near(self, v: np.ndarray, threshold: float, norm: float) -> tuple[bool, bool]:
        """Whether a stored one is nearer than the threshold, and whether an open one is."""
        near = distances(v[None], self.x[: self.n], norm)[0] < threshold
        return bool((near & ~self.open[: self.n]).any()), bool((near & self.open[: self.n]).any())


def apart(new: DataFrame, threshold: float, norm: float = 2.0, least_bits: int = 0, stored: DataFrame | None = None) -> DataFrame:
    """new (row_id, vector, category, part) -> those that are learnt, in order of row_id, each at least `threshold` away from all that are stored before it (0: all are); with stored: prototypes that are there already, whose row_ids come before, and which stay. least_bits: vectors with fewer values that aren't 0 aren't learnt. norm: 1 or more, as the triangle inequality has to hold.

    Rows without a vector aren't learnt; vectors are of one length. Of the rows of
    one row_id and vector one stays.
    """
    if norm < 1:
        raise ValueError("below 1 there is no triangle inequality")
    columns, spark, kind = new.columns, new.sparkSession, dict(new.dtypes)["row_id"]
    vector = F.col("vector").cast("array<double>")
    new = new.where("vector is not null").where(F.size(F.filter("vector", lambda v: v != 0)) >= least_bits)
    old = stored.where("vector is not null").select(*columns) if stored is not None else new.limit(0)
    if threshold <= 0:
        return old.unionByName(new)
    both = old.withColumn("status", F.lit(STORED)).unionByName(new.withColumn("status", F.lit(OPEN)))
    # of equal vectors only the first can be stored
    first = both.groupBy(vector.alias("vector")).agg(F.min(F.struct((-F.col("status")).alias("_s"), "row_id")).alias("_f"))
    state = written(first.select("_f.row_id", "vector", (-F.col("_f._s")).alias("status")), "state")
    schema = f"row_id {kind}, vector array<double>, status int"
    if not state.limit(1).count():
        return both.select(*columns)
    size = len(state.select("vector").first()["vector"]) or 1
    state, early = _covered(state, threshold, norm, max(1, min(FIRST, FIRST_BYTES // (8 * size))), schema)
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * size), state.count() // EACH))
    pivots = stacked(state.select("vector").orderBy(F.xxhash64("row_id")).limit(most).toArrow().column("vector").combine_chunks())
    given = spark.sparkContext.broadcast(pivots)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(stacked(batch.column("vector")), given.value, norm)
            home = far.argmin(1)
            row, cell = np.nonzero(far <= (far.min(1) + 2 * threshold)[:, None] * (1 + ROOM) + ROOM)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cell == home[row]), *(c.take(take) for c in batch.columns)], names=["cell", "home", *batch.schema.names])

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            x, out = stacked(batch.column("vector")), []
            for i, (cell, home, status) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "home", "status")), strict=True)):
                if cell != at:
                    at, held = cell, Held(x.shape[1])
                if status == STORED:
                    held.add(x[i], False)
                    said = STORED
                else:
                    by_stored, by_open = held.near(x[i], threshold, norm)
                    said = DROPPED if by_stored else OPEN if by_open or not home else STORED
                    if said != DROPPED:
                        held.add(x[i], said == OPEN)
                if home:
                    out.append((i, said))
            if out:
                of = batch.take(pa.array([i for i, _ in out]))
                yield pa.RecordBatch.from_arrays([of.column("row_id"), of.column("vector"), pa.array([s for _, s in out], pa.int32())], names=["row_id", "vector", "status"])

    while state.where(F.col("status") == OPEN).limit(1).count():
        # stored ones first: nothing open that is near to one comes before it in order, or it wouldn't be stored yet
        cells = state.mapInArrow(dealt, f"cell long, home boolean, {schema}").repartition("cell").sortWithinPartitions("cell", F.col("status") != STORED, "row_id", "vector")
        state = written(cells.mapInArrow(decided, schema).where(F.col("status") != DROPPED), "state")
    learnt = written(early.unionByName(state).select("row_id", F.col("vector").alias("_v")), "learnt")
    own = new.withColumn("_v", vector).join(learnt, ["row_id", "_v"], "left_semi").dropDuplicates(["row_id", "vector"])
    return old.unionByName(own.select(*columns))


def _covered(state: DataFrame, threshold: float, norm: float, most: int, schema: str) -> tuple[DataFrame, DataFrame]:
    """state (row_id, vector, status) -> the state that cells go on from, and the rows that are stored and that nothing open is near to.

    Stored ones from before drop what is near to them first, a block at a time, if
    they are few; then blocks of the first open ones are decided and drop others, as
    long as half of the rest goes with each.
    """
    spark, is_open = state.sparkSession, F.col("status") == OPEN
    before = state.where(~is_open)
    if before.limit(most + 1).count() > most:
        return state, before.limit(0)
    early, rest = before, state.where(is_open)
    block = before
    left = rest.count()
    while left:
        kept = block.toArrow().column("vector").combine_chunks()  # `most` vectors at most
        if len(kept):
            rest = written(rest.mapInArrow(_far_from(spark.sparkContext.broadcast(stacked(kept)), threshold, norm), schema), "rest")
            had, left = left, rest.count()
            if not left or block is not before and 2 * left > had:
                break
        first = written(rest.orderBy("row_id", "vector").limit(most), "first")
        block = written(first.repartition(1).sortWithinPartitions("row_id", "vector").mapInArrow(_sequential(threshold, norm), schema), "block")
        early = early.unionByName(block)
        rest = rest.join(F.broadcast(first.select("vector")), "vector", "left_anti").select("row_id", "vector", "status")
        left -= first.count()
    return rest, early


def _far_from(kept: Broadcast, threshold: float, norm: float):
    """The rows that are near to none of the kept vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column("vector"))
            far = [distances(x[i : i + ROWS], kept.value, norm).min(1) >= threshold for i in range(0, len(x), ROWS)]
            if far:
                yield batch.filter(pa.array(np.concatenate(far)))

    return run


def _sequential(threshold: float, norm: float):
    """The rows that are stored, of one task's in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x, learnt = stacked(batch.column("vector")), []
            held = held or Held(x.shape[1])
            for i in range(len(x)):
                if not held.near(x[i], threshold, norm)[0]:
                    held.add(x[i], False)
                    learnt.append(i)
            stored = batch.take(pa.array(learnt, pa.int64()))
            yield stored.set_column(2, "status", pa.array([STORED] * len(learnt), pa.int32()))

    return run


class Recent:
    """The prototypes of one classifier: `most` at most, of which the one goes that has been of no use for the longest."""

    def __init__(self, most: int, threshold: float, norm: float, least_bits: int, replace: bool):
        self.most, self.threshold, self.norm, self.least_bits, self.replace = most, threshold, norm, least_bits, replace
        self.x, self.used, self.rows = np.empty((0, 0)), [], []

    def learn(self, v: np.ndarray, row_id: int, row: tuple) -> bool:
        """Whether the vector is stored. row: (row_id, category, part)."""
        adds = True
        if self.rows:
            if self.replace and len(same := np.flatnonzero((self.x == v).all(1))):
                at = int(same[0])
                self.rows[at], self.used[at], adds = (self.rows[at][0], row[1], self.rows[at][2]), row_id, False
            if self.threshold > 0:
                far = distances(v[None], self.x, self.norm)[0]
                at = int(far.argmin())
                adds = bool(far[at] >= self.threshold)
                if not adds:
                    self.used[at] = row_id
        if not adds or np.count_nonzero(v) < self.least_bits:
            return False
        self.x = np.concatenate([self.x, v[None]]) if self.rows else v[None]
        self.used.append(row_id)
        self.rows.append(row)
        if len(self.rows) > self.most:
            gone = int(np.argmin(self.used))
            self.x = np.delete(self.x, gone, 0)
            del self.used[gone], self.rows[gone]
        return True


def capped(new: DataFrame, most: int, threshold: float = 0.0, norm: float = 2.0, least_bits: int = 0, replace: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """new (keys, row_id, vector, category, part) -> the prototypes that each key's classifier holds in the end, with used, the row_id that was last of use to each.

    Vectors come in order of row_id. One that is nearer to a stored one than the
    threshold isn't stored, but its nearest (the first on a tie) counts as used;
    replace: one that equals a stored one gives it its category. Of more than `most`
    the least recently used goes.

    Without a threshold and replacement these are the latest `most` of a key, which
    a window finds, cut down before its exchange. Otherwise each vector rests on the
    one before: a classifier is one task's pass, which holds `most` vectors.
    """
    if most < 1:
        raise ValueError("at least one prototype has to stay")
    keys, kinds = list(keys), dict(new.dtypes)
    vector = F.col("vector").cast("array<double>")
    rows = new.where("vector is not null").select(*keys, "row_id", vector.alias("vector"), "category", "part")
    if threshold <= 0 and not replace:
        latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("row_id")))
        rows = rows.where(F.size(F.filter("vector", lambda v: v != 0)) >= least_bits)
        return rows.withColumn("_at", latest).where(F.col("_at") <= most).drop("_at").withColumn("used", F.col("row_id"))
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"row_id {kinds['row_id']}", "vector array<double>", f"category {kinds['category']}", f"part {kinds['part']}", f"used {kinds['row_id']}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kind = None, None, None

        def told() -> pa.RecordBatch:
            ids, categories, parts = zip(*held.rows, strict=True)
            own = [pa.array([k] * len(ids), kind.field(i).type) for i, k in enumerate(at)]
            rest = [pa.array(v, kind.field(n).type) for v, n in ((ids, "row_id"), (held.x.tolist(), "vector"), (categories, "category"), (parts, "part"), (held.used, "row_id"))]
            return pa.RecordBatch.from_arrays([*own, *rest], names=[*keys, "row_id", "vector", "category", "part", "used"])

        for batch in batches:
            kind, x = batch.schema, stacked(batch.column("vector"))
            of = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(x)
            for i, (key, *row) in enumerate(zip(of, *(batch.column(c).to_pylist() for c in ("row_id", "category", "part")), strict=True)):
                if key != at:
                    if held and held.rows:
                        yield told()
                    at, held = key, Recent(most, threshold, norm, least_bits, replace)
                held.learn(x[i], row[0], tuple(row))
        if held and held.rows:
            yield told()

    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    return dealt.sortWithinPartitions(*keys, "row_id").mapInArrow(run, schema)
