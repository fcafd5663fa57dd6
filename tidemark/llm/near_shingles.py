"""Near duplicates by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First SimHash with pivot distance tables (`simhash`) finds the sets whose
fingerprints differ in two bits or fewer, and the exact sets verify what it links.
At a similarity of 0.8 two 64-bit fingerprints differ in ten bits on average,
where no two quarters are sure to be equal and differences of pivot distances
discard nothing; so for wider pairs further cells come after it. Such a cell is
named by ROWS minima of the set's hashes under fixed permutations (BANDS
cells a text; two texts at 0.8 share none once in 500). In a cell, pairs whose
sizes or SimHash fingerprints (of the set, more than BITS bits apart) rule the
similarity out are discarded, and the exact sets verify the survivors.

Texts with equal sets are one class from the start. First each class of a cell
is held against the cell's least class, which links a group of copies of any
size by one pair each. Then, in rounds, cells that hold several components are
tested again: one member outside the cell's largest component against all of
other components, less the pairs that were tested before. Rounds go on until
one finds nothing. Every round's pairs
grow with the rows, never with a cell's square.

What this loses (texts that share no cell, that are ruled out by fingerprints,
or that lead none of the cells that they share) a last step finds: all shingles
have one order, and two sets at the similarity share one of their first ones
(of n all but the similarity's share, and one more). Every pair of texts that
shares one of these and is in different components by then, and that sizes
and places leave open, is verified. So the components are those of all pairs.
Shingles that a sample of the texts shows to be frequent come last in the
order, so that few pairs share a first one; the result doesn't depend on it.

Odd input: null and empty texts have the empty set and are one class, alike
among themselves only; a text of fewer words than a shingle is one shingle; rows
with a null id are linked like any other, but go and stay with no one
(`without_near_duplicates` keeps them); repeated rows each get a row; other
columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm import simhash
from tidemark.llm.common import as_bytes, let_go, only, passing, removed, small_batches, without, written
from tidemark.llm.components import components
from tidemark.llm.dedup import perhaps_in

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 5
#: Differing fingerprint bits that are still tested; at 0.8 ten are expected, over 20 come once in 3,000.
BITS = 20
#: Pairs that one copy of a leading class's set serves.
SHARE = 512
#: Shingles whose bits and minima are taken at once.
CHUNK = 1 << 16
#: Frequent shingles, which come last in the order, at most; one of SAMPLED texts is looked at, and SEEN of these must have it.
OFTEN, SAMPLED, SEEN = 1 << 17, 16, 3
#: The permutations: h -> (h ^ mask) * odd.
MASKS, ODDS = (np.array([xxhash.xxh64_intdigest(f"{name} {i}") | low for i in range(BANDS * ROWS)], np.uint64) for name, low in (("mask", 0), ("odd", 1)))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - shingle + 1)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends - 1)[-n:].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)), np.uint64, n))


def sketch(h: np.ndarray) -> tuple[int, np.ndarray]:
    """SimHash of a set of hashes, and its minima under the permutations (the empty set: zero, and the greatest value)."""
    ones, least = np.zeros(64, np.int64), np.full(len(ODDS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), CHUNK):
        some = h[i : i + CHUNK]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        for k, (mask, odd) in enumerate(zip(MASKS, ODDS, strict=True)):
            least[k] = min(least[k], ((some ^ mask) * odd).min())
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0]), least


def frequent(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Shingles that many texts have, in order: of a sample of the texts, as only the work depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for text in as_bytes(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, shingle).view(np.int64))], names=["token"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    counts = small_batches(some).mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    return np.sort(counts.orderBy(F.desc("n"), "token").limit(OFTEN).toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def first_ones(h: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's hashes (in order) by the order of all shingles: frequent ones last. A set as similar as that shares one of them, and has it among its own first ones."""
    if len(often) and len(h):
        late = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
        h = np.concatenate([h[~late], h[late]])
    return h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


def sketches(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, often: np.ndarray | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, cls (digest of the set), n (its size), fp, cells, first_ones."""
    given = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if often is None else often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        often = given.value
        for batch in batches:
            cls, n, fps, cells, firsts = [], [], [], [], []
            for text in as_bytes(batch, "text"):
                h = shingles(text, shingle)
                fp, least = sketch(h)
                cls.append(xxhash.xxh3_128_digest(h.tobytes()))
                n.append(len(h))
                fps.append(fp)
                cells.append([xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)])
                firsts.append(first_ones(h, often, similarity).view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)])
            firsts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            flat = np.array(cells, np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), lists, firsts], names=["doc_id", "cls", "n", "fp", "cells", "first_ones"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, cls binary, n long, fp long, cells array<long>, first_ones array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """wanted (node, cls, first: an id that the class has) -> node, held (the set's hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            sets = [shingles(t, shingle).tobytes() for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["cls", "held"])

    # A bitmap of fixed size is broadcast, so that only texts of (nearly all) wanted ids are read into sets, and no text moves.
    rows = perhaps_in(docs.select("doc_id", "text"), wanted.select(F.col("first").alias("doc_id"))).select("text")
    held = small_batches(rows).mapInArrow(run, "cls binary, held binary").join(wanted.select("node", "cls"), "cls")
    return held.groupBy("cls").agg(F.first("node").alias("node"), F.first("held").alias("held")).drop("cls")


def _alike(similarity: float):
    """Whether two sets of hashes are as similar as that."""

    @arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return alike


@passing
def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of nodes, a written table without repetitions, those that are similar by their exact sets. A node with many pairs has a copy of its set for each SHARE of them."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(classes.join(nodes, "node", "left_semi").select("node", "cls", "first"), "wanted")
    sets = written(_sets(docs, wanted, shingle), "sets")
    copies = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("copies")), "copies")
    left = sets.join(copies, F.col("node") == F.col("a")).select("a", F.col("held").alias("ha"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    right = sets.select(F.col("node").alias("b"), F.col("held").alias("hb"))
    dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), "copies").alias("copy"))
    return written(dealt.join(right, "b").join(left, ["a", "copy"]).where(_alike(similarity)("ha", "hb")).select("a", "b"), "links")


@passing
def _by_pivots(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links among classes whose fingerprints are equal, or are linked by the pivot distance tables."""
    leads = written(classes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    equal = classes.join(leads, "fp").where("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    of = lambda name: leads.select(F.col("fp").alias(name), F.col("lead").alias(f"_{name}"))
    near = simhash.near_links(leads.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return _verified(docs, classes, written(equal.unionByName(near).distinct(), "pairs"), shingle, similarity)


@passing
def near_links(docs: DataFrame, classes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between classes (node, cls, first, n, fp, cells, first_ones), enough to connect all that are similar."""
    links = _by_pivots(docs, classes, shingle, similarity)
    known: list[DataFrame] = []
    cells = classes.select(F.explode("cells").alias("cell"), "node", "n", "fp")
    shared = cells.groupBy("cell").agg(F.min("node").alias("lead"), F.count("*").alias("size")).where("size > 1")
    cells = written(cells.join(shared.select("cell", "lead"), "cell"), "cells")
    links = written(links.unionByName(_tested(docs, classes, cells.where("lead <> node"), shingle, similarity, known)), "links")
    while True:
        # A root is a bijective hash of a node, so one that isn't linked is its own hash.
        roots = components(links)
        rows = cells.select("cell", "node", "n", "fp").join(roots, "node", "left").withColumn("root", F.coalesce("root", F.xxhash64("node")))
        mixed = written(_mixed(rows), "mixed")
        removed(cells)
        cells = mixed
        found = _tested(docs, classes, cells.where("root <> lead_root"), shingle, similarity, known)
        if not found.limit(1).count():
            removed(cells)
            return written(links.unionByName(_others(docs, classes, roots, shingle, similarity, known)), "links")
        links = written(links.unionByName(found), "links")


def _others(docs: DataFrame, classes: DataFrame, roots: DataFrame, shingle: int, similarity: float, known: list[DataFrame]) -> DataFrame:
    """All links between different components (roots: node, root) of classes."""
    tokens = classes.select("node", F.posexplode("first_ones").alias("place", "token"))
    tokens = tokens.withColumn("size", F.count("*").over(Window.partitionBy("token"))).where("size > 1").drop("size")
    of = classes.select("node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", F.xxhash64("node")))
    tokens = written(tokens.join(of, "node"), "tokens")
    # Of any two members in different components one at least is outside the token's largest component.
    per = tokens.groupBy("token", "root").agg(F.count("*").alias("size"))
    top = per.groupBy("token").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    mixed = written(tokens.join(top.select("token", F.col("top.root").alias("top")), "token"), "mixed")
    removed(tokens)
    outside = mixed.where("root <> top").select("token", *[F.col(c).alias(f"{c}_") for c in ("node", "place", "n", "root")])
    sizes = F.least("n", "n_") >= F.lit(similarity) * F.greatest("n", "n_") - 1e-6
    apart = (F.col("root") != F.col("root_")) & ((F.col("root") == F.col("top")) | (F.col("node_") < F.col("node")))
    pairs = outside.join(mixed, "token").where(apart & sizes).withColumn("turned", F.col("node_") > F.col("node"))
    own = lambda c: F.when(F.col("turned"), F.col(c)).otherwise(F.col(f"{c}_"))  # noqa: E731  of the lesser node
    other = lambda c: F.when(F.col("turned"), F.col(f"{c}_")).otherwise(F.col(c))
    pairs = pairs.select(own("node").alias("a"), other("node").alias("b"), own("n").alias("n"), other("n").alias("m"), own("place").alias("i"), other("place").alias("j"))
    pairs = pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("common"), F.max("i").alias("i"), F.max("j").alias("j"))
    # Common shingles that aren't among both sets' first ones come after the last that is, and after the first ones of one set.
    later = lambda c: F.ceil(F.lit(similarity) * F.col(c) - 1e-9) - 1
    most = F.col("common") + F.least(F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1, F.greatest(later("n"), later("m")))
    pairs = pairs.where(most >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-6).select("a", "b")
    pairs = written(_untested(pairs, known), "pairs")
    removed(mixed)
    return _verified(docs, classes, pairs, shingle, similarity) if pairs.limit(1).count() else pairs


def _untested(pairs: DataFrame, known: list[DataFrame]) -> DataFrame:
    """pairs (a, b) less the known ones (low, high)."""
    if not known:
        return pairs
    before, low, high = functools.reduce(DataFrame.unionByName, known), F.least("a", "b"), F.greatest("a", "b")
    return pairs.join(before, (low == before["low"]) & (high == before["high"]), "left_anti")


def _mixed(rows: DataFrame) -> DataFrame:
    """rows (cell, node, n, fp, root) of cells with several components, with a lead: the least member, by a hash of cell and node, of all but the cell's largest component."""
    per = rows.groupBy("cell", "root").agg(F.count("*").alias("n"), F.min(F.xxhash64("cell", "node")).alias("key"), F.min_by("node", F.xxhash64("cell", "node")).alias("lead"))
    top = per.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    others = per.join(top, "cell").where(F.col("root") != F.col("top.root"))
    of = others.groupBy("cell").agg(F.min_by(F.struct("lead", "root"), "key").alias("by"))
    return rows.join(of.select("cell", F.col("by.lead").alias("lead"), F.col("by.root").alias("lead_root")), "cell")


def _tested(docs: DataFrame, classes: DataFrame, rows: DataFrame, shingle: int, similarity: float, known: list[DataFrame]) -> DataFrame:
    """The links among rows (node, n, fp, lead): of each with its lead, if sizes and fingerprints leave it open and the sets bear it out.

    known: the pairs (low, high) that earlier rounds have tested, which no sets are sent out for again; this round's are added.
    """
    pairs = rows.groupBy("lead", "node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"))
    leads = classes.select(F.col("node").alias("lead"), F.col("n").alias("m"), F.col("fp").alias("gp"))
    open_ = (F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("gp"))) <= BITS)
    pairs = pairs.join(leads, "lead").where(open_).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = written(_untested(pairs, known), "pairs")
    known.append(pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")))
    return _verified(docs, classes, pairs, shingle, similarity) if pairs.limit(1).count() else pairs


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, component_id (the smallest doc_id reachable over links)."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity is over 0 and at most 1")
    docs = only(docs, "doc_id", "text")
    rows = written(sketches(docs, shingle, similarity, frequent(docs, shingle)), "sketches")
    classes = rows.groupBy("cls").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "cells", "first_ones")])
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(near_links(docs, classes, shingle, similarity))
    linked = written(classes.select("cls", "node", "first").join(roots, "node", "left").select("cls", "first", F.coalesce("root", F.xxhash64("node")).alias("root")), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "cls").join(linked.join(least, "root").select("cls", "component_id"), "cls").select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with all their columns, less every document but the first of its component; rows without an id stay."""
    return without(docs, lambda: near_duplicates(docs, shingle, similarity).where("doc_id <> component_id").select("doc_id").distinct())
