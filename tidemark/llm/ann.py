"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue for all its trees.

Equal vectors are one point, whose few smallest ids stand for all its copies,
so copies can't crowd a leaf however many there are. The trees are fitted on a
bounded sample of the points: a node splits its sample at the median of the
projection on the difference of two random members. Every point is then dealt
to its leaf in each tree. A query takes leaves from one queue over all trees,
least sum of crossed margins first, and meets all points of those leaves in the
tasks that hold them, where inner products are exact; the best few of each leaf
are merged by query. A query brings a bound with it: the sampled members of its
first leaves give a score that its k-th neighbour reaches at least, and only
points that reach it go out.

Inner products are largest where distances are least once every vector gets one
more component that makes all equally long, so norms may differ.

How many leaves a query takes is calibrated: some sampled queries are answered
by brute force (one pass over the points), and the least number that finds
`recall` of their neighbours holds for all queries. Where vectors have structure
a few leaves do; isotropic noise, in which no index prunes, needs most of them.

Odd input: vectors that are null, empty, zero, or hold null or non-finite
components take no part; shorter vectors are as if zeros followed; rows with a
null id take no part; rows that repeat an id with its vector count once, and an
id with several vectors is a candidate with each; fewer candidates than k are
all given; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let_go, written

#: Trees; points that a leaf should hold, about; sampled points that a leaf holds at least, so that any one leaf has enough of them.
TREES, LEAF, LEAST = 2, 1024, 64
#: The sample that trees are fitted on, at most: vectors and bytes.
SAMPLE, SAMPLE_BYTES = 131_072, 32 << 20
#: Leaves whose sampled members give a query its bound.
FIRST = 4
#: Queries that are answered by brute force to calibrate, and the share of their neighbours that has to be found.
ASKED, RECALL = 192, 0.95


class Forest:
    """Trees as arrays: node i of a tree splits at place `threshold[i]` of direction[i]; children below zero are leaves."""

    def __init__(self, sample: np.ndarray, norm: float, trees: int, leaf: int, seed: int = 13):
        self.norm, rng = norm, np.random.default_rng(seed)
        points = self.lifted(sample)
        self.trees = [self._fit(points, leaf, rng) for _ in range(trees)]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that gives all the same length."""
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0.0))[:, None]], axis=1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries, as long as the points are; their own further component is 0."""
        q = q.astype(np.float64)
        return np.concatenate([q * (self.norm / np.sqrt((q * q).sum(1)))[:, None], np.zeros((len(q), 1))], axis=1)

    @staticmethod
    def _fit(points: np.ndarray, leaf: int, rng: np.random.Generator):
        directions, thresholds, children, leaves = [], [], [], 0

        def node(own: np.ndarray) -> int:
            nonlocal leaves
            for _ in range(4 if len(own) > leaf else 0):  # points that project to one place are parted by another direction
                a, b = points[rng.choice(own, 2, replace=False)]
                if not (length := np.linalg.norm(a - b)):
                    continue
                p = points[own] @ ((a - b) / length)
                at = np.median(p)
                left = p < at
                if min(left.sum(), (~left).sum()) * 4 >= len(own):
                    me = len(directions)
                    directions.append((a - b) / length)
                    thresholds.append(at)
                    children.append(None)
                    children[me] = (node(own[left]), node(own[~left]))
                    return me
            leaves += 1
            return -leaves

        root = node(np.arange(len(points)))
        wide = points.shape[1]
        return root, np.array(directions).reshape(-1, wide), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), leaves

    @property
    def leaves(self) -> int:
        return sum(t[4] for t in self.trees)

    def dealt(self, x: np.ndarray) -> np.ndarray:
        """Each point's leaf in each tree, numbered over all trees."""
        x, out, before = self.lifted(x), [], 0
        for root, directions, thresholds, children, leaves in self.trees:
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                own = at[inner]
                right = (x[inner] * directions[own]).sum(1) >= thresholds[own]
                at[inner] = children[own, right.astype(int)]
            out.append(before - at - 1)
            before += leaves
        return np.stack(out, axis=1)

    def search(self, q: np.ndarray, most: int) -> Iterator[list[int]]:
        """For each query the first `most` leaves, in the order in which the shared queue gives them."""
        for i in range(0, len(q), 128):
            some = self.asked(q[i : i + 128])
            margins = [(some @ d.T - t).tolist() for _, d, t, _, _ in self.trees]
            children = [c.tolist() for *_, c, _ in self.trees]
            before = np.cumsum([0, *(t[4] for t in self.trees)]).tolist()
            for j in range(len(some)):
                own = [m[j] for m in margins]
                queue = [(0.0, k, t[0]) for k, t in enumerate(self.trees)]
                found: list[int] = []
                while queue and len(found) < most:
                    cost, k, at = heapq.heappop(queue)
                    while at >= 0:
                        m = own[k][at]
                        left, right = children[k][at]
                        heapq.heappush(queue, (cost + abs(m), k, left if m >= 0 else right))
                        at = right if m >= 0 else left
                    found.append(before[k] - at - 1)
                yield found


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of q[i] and x[i], added up from the first component to the last."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score): of each query the k points of the largest inner product, smaller id first on a tie. One matrix product finds them, with room for its rounding; the scores are exact."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    s = q @ x.T
    if len(x) > k:
        cut = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
        room = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)).max()
        a, b = np.nonzero(s >= (cut - room)[:, None])
    else:
        a, b = (m.ravel() for m in np.indices(s.shape))
    score = exact(q[a], x[b])
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, a)
    own = np.arange(len(a)) - first < k
    return a[own], b[own], score[own]


class Bounds:
    """The sample by leaf: what a query's k-th neighbour scores at least, from the members of its first leaves."""

    def __init__(self, forest: Forest, sample: np.ndarray):
        at = forest.dealt(sample)
        self.sample, self.members = sample, np.argsort(at.ravel(), kind="stable") // at.shape[1]
        self.ends = np.cumsum(np.bincount(at.ravel(), minlength=forest.leaves))

    def least(self, q: np.ndarray, leaves: list[int], k: int) -> float:
        """Over distinct members; less what a matrix product's rounding can be. Without k of them there is no bound."""
        some = [self.members[self.ends[c - 1] if c else 0 : self.ends[c]] for c in leaves[:FIRST]]
        x = self.sample[np.unique(np.concatenate(some))].astype(np.float64)
        if len(x) < k:
            return -np.inf
        q = q.astype(np.float64)
        return float(np.partition(x @ q, len(x) - k)[len(x) - k]) - 1e-12 * float(np.sqrt(q @ q) * np.sqrt((x * x).sum(1).max()))


def _stacked(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, asks: Column) -> DataFrame:
    """vec_id, embedding, asks: the rows that take part, their vectors of one length, a negative zero as zero."""
    x = F.col("embedding")
    right = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    own = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & right).withColumn("asks", F.coalesce(asks, F.lit(False)))
    size = own.agg(F.max(F.size("embedding"))).first()[0] or 1
    kind = own.schema["embedding"].dataType.elementType.simpleString()
    zero = F.lit(0.0).cast(kind)
    padded = F.concat("embedding", F.array_repeat(zero, F.lit(size) - F.size("embedding")))
    return own.withColumn("embedding", F.transform(padded, lambda v: F.when(v == 0, zero).otherwise(v)))


def points(own: DataFrame, k: int) -> DataFrame:
    """usable rows -> a row a distinct vector: point (its smallest id), ids (its k + 1 smallest), asks (whether any of its ids does), embedding. A task sends k + 1 ids of a vector at most."""
    few = own.withColumn("_at", F.dense_rank().over(Window.partitionBy("embedding", "asks").orderBy("vec_id"))).where(F.col("_at") <= k + 1)
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    some = few.groupBy("embedding").agg(ids.alias("ids"), F.max("asks").alias("asks"))
    return some.select(F.element_at("ids", 1).alias("point"), "ids", "asks", "embedding")


def _fitted(pts: DataFrame, n: int, trees: int, leaf: int) -> tuple[Forest, np.ndarray]:
    """The forest, and the sample (in hash order) that it is fitted on."""
    norm = pts.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))).alias("m")).first()["m"]
    size = len(pts.select("embedding").first()["embedding"])
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (4 * size)))
    share = pts if n <= most else pts.where(F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    sample = _stacked(share.select("point", "embedding").orderBy(F.xxhash64("point"), "point").limit(most).select("embedding").toArrow().column("embedding").combine_chunks()).astype(np.float32)
    return Forest(sample, norm, trees, max(LEAST, int(leaf * len(sample) / n)) if n > most else leaf), sample


def _brute(pts: DataFrame, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of the k nearest points of a bounded set of queries: each task keeps k a query."""
    given = pts.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            x, ids = _stacked(batch.column("embedding")), batch.column("point").to_numpy(zero_copy_only=False)
            a, b, score = nearest(given.value, x, ids, k)
            new = [a, score, ids[b], x[b]]
            best = new if best is None else [np.concatenate([o, n]) for o, n in zip(best, new, strict=True)]
            order = np.lexsort((best[2], -best[1], best[0]))
            best = [v[order] for v in best]
            keep = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
            best = [v[keep] for v in best]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int32()), pa.array(best[1]), pa.array(best[2], pa.int64()), pa.array(list(best[3].astype(np.float64)), pa.list_(pa.float64()))], names=["asked", "score", "point", "embedding"])

    rows = pts.select(F.col("point").cast("long").alias("point"), "embedding").mapInArrow(run, "asked int, score double, point long, embedding array<double>")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "point"))
    got = rows.withColumn("_at", rank).where(F.col("_at") <= k).select("asked", "embedding").toArrow()
    return got.column("asked").to_numpy(), _stacked(got.column("embedding").combine_chunks())


def calibrated(pts: DataFrame, forest: Forest, queries: np.ndarray, k: int, recall: float) -> int:
    """The least number of leaves a query with which `recall` of the sampled queries' neighbours are found."""
    asked, found = _brute(pts, queries, k)
    if not len(asked):
        return forest.leaves
    order = [{leaf: at for at, leaf in enumerate(own)} for own in forest.search(queries, forest.leaves)]
    at = np.sort([min(order[a][leaf] for leaf in leaves) for a, leaves in zip(asked.tolist(), forest.dealt(found).tolist(), strict=True)])
    return int(at[max(0, int(np.ceil(recall * len(at))) - 1)]) + 1


def search(vectors: DataFrame, asks: Column, k: int, recall: float = RECALL, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vectors (vec_id, embedding); asks: which rows are queries -> query_id, rank (from 1), vec_id, score: the k nearest found, without the query's own id."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["vec_id"]
    own = usable(vectors, asks)
    pts = written(points(own, k), "points")
    if not (n := pts.count()):
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    forest, sample = _fitted(pts, n, trees, leaf)
    leaves = calibrated(pts, forest, sample[:: max(1, len(sample) // ASKED)][:ASKED], k, recall)
    given = spark.sparkContext.broadcast((forest, Bounds(forest, sample)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each leaf of a point, and one for each leaf that a query takes."""
        let_go()
        forest, bounds = given.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                x = _stacked(some.column("embedding"))
                at = forest.dealt(x)
                asking = np.flatnonzero(some.column("asks").to_numpy(zero_copy_only=False))
                taken = list(forest.search(x[asking], leaves))
                least = [bounds.least(v, t, k + 1) for v, t in zip(x[asking], taken, strict=True)]
                least = np.concatenate([np.zeros(at.size), np.repeat(least, list(map(len, taken)))])
                rows = np.concatenate([np.repeat(np.arange(len(x)), at.shape[1]), np.repeat(asking, list(map(len, taken)))])
                cell = np.concatenate([at.ravel(), np.array([c for t in taken for c in t], np.int64)])
                take = pa.array(rows.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.arange(len(rows)) >= at.size), *(some.column(c).take(take) for c in ("point", "ids", "embedding")), pa.array(least, pa.float64())], names=["cell", "asks", "point", "ids", "embedding", "least"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cell by cell: its points first, then its queries, a batch at a time."""
        let_go()
        cell, held, stack = None, [], None
        for batch in batches:
            cells, asking, x = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool), _stacked(batch.column("embedding"))
            least = batch.column("least").to_numpy()
            cuts = (np.flatnonzero((np.diff(cells) != 0) | (np.diff(asking.astype(np.int8)) != 0)) + 1).tolist() if len(cells) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    cell, held, stack = cells[lo], [], None
                names = batch.slice(lo, hi - lo)
                if not asking[lo]:
                    held.append((x[lo:hi], names.column("point"), names.column("ids")))
                    continue
                if stack is None and held:
                    stack = np.concatenate([h[0] for h in held])
                    point, ids = (pa.concat_arrays([h[j] for h in held]) for j in (1, 2))
                    order = point.to_numpy(zero_copy_only=False)
                for i in range(lo, hi if held else lo, 500):
                    a, b, score = nearest(x[i : min(hi, i + 500)], stack, order, k + 1)
                    may = score >= least[i + a]
                    a, b, score = a[may], b[may], score[may]
                    of = pa.array(b)
                    yield pa.RecordBatch.from_arrays([names.column("point").take(pa.array(a + (i - lo))), point.take(of), ids.take(of), pa.array(score)], names=["asks", "point", "ids", "score"])

    dealt = pts.select("point", "ids", "embedding", "asks").mapInArrow(deal, f"cell long, asks boolean, point {kind}, ids array<{kind}>, embedding {pts.schema['embedding'].dataType.simpleString()}, least double")
    met = dealt.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(meet, f"asks {kind}, point {kind}, ids array<{kind}>, score double")
    # of each asking point the k + 1 nearest; one that several trees found has one place, and its ids are all its copies that can matter
    place = F.dense_rank().over(Window.partitionBy("asks").orderBy(F.desc("score"), "point"))
    best = met.withColumn("_at", place).where(F.col("_at") <= k + 1)
    nearer = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    each = best.select("asks", F.transform("ids", lambda i: F.struct("score", i.alias("id"))).alias("each"))
    near = F.slice(F.array_sort(F.flatten(F.collect_set("each")), nearer), 1, k + 1)
    answers = each.groupBy("asks").agg(near.alias("near")).join(pts.where("asks").select(F.col("point").alias("asks"), "embedding"), "asks").select("embedding", "near")
    queries = own.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    others = F.slice(F.filter("near", lambda s: s["id"] != F.col("query_id")), 1, k)
    out = queries.join(answers, "embedding").select("query_id", F.posexplode(others).alias("_at", "_of"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_of.id").alias("vec_id"), F.col("_of.score").alias("score"))
