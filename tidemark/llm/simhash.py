"""SimHash near-deduplication with pivot distance tables.

Fingerprints: 64-bit SimHash over word shingles. Equal fingerprints are one
class from the start. Every class has its Hamming distances to 65 reference
fingerprints: zero, and 16 in each quarter of the word (the quarter's Walsh
patterns and all of its bits). The distance to a quarter's reference less the
distance to zero depends on that quarter's bits alone. Fingerprints that differ
in two bits or fewer agree on two quarters at least, and so in all of their
coordinates: classes with equal coordinates there share a cell (six cells a
class, no near pair is lost). Pairs in a cell are discarded if any coordinates
differ by more than the distance allowed, and the survivors are verified.

A cell of more than CELL classes is split by further reference fingerprints:
its members may differ in the other two quarters alone, which are four octets,
of which two agree again; then four nibbles. After these three tables two
members of a cell can differ in eight bits, so no cell has more than 256, and
all cells come through the same comparison.

Odd input: null and empty texts have the fingerprint zero and are linked like
any other; a null id is in no component's minimum (a component of null ids has
a null id); repeated rows each get a row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, fold, let_go, only, removed, small_batches, without, written
from tidemark.llm.components import components

SHINGLE = 3
DISTANCE = 2
CELL = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


#: Widths of the parts that the three tables' references are in.
WIDTHS = (16, 8, 4)


def references(width: int) -> list[int]:
    """Zero; then of each part of the word `width` patterns: those of its bits whose place has an odd number of ones in common with j (1 to width - 1), and all of its bits."""
    own = [sum(1 << i for i in range(width) if (i & j).bit_count() % 2) for j in range(1, width)] + [(1 << width) - 1]
    return [0] + [pattern << width * q for q in range(64 // width) for pattern in own]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - shingle + 1)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends - 1)[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def distances(width: int) -> Column:
    """The Hamming distances of fp to the references, as an array."""
    signed = [p - (1 << 64) if p >> 63 else p for p in references(width)]
    return F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p).cast("long"))).cast("tinyint") for p in signed])


def _split(rows: DataFrame, width: int) -> DataFrame:
    """rows (cell, fp, left: the four parts in which its members may differ) -> six rows for each: for every two of the parts the cell of those that agree there, and what is left of the other two, halved."""
    coordinates = lambda q: [F.col("far")[k] - F.col("far")[0] for k in range(1 + width * q, 1 + width * (q + 1))]
    named = F.array(*[F.xxhash64(*coordinates(q)) for q in range(64 // width)])
    part = lambda i: F.get("left", F.lit(i))
    six = []
    for i in range(4):
        for j in range(i + 1, 4):
            c, d = ({0, 1, 2, 3} - {i, j})
            halves = F.array(*[part(k) * 2 + h for k in (c, d) for h in (0, 1)])
            six.append(F.struct(F.xxhash64("cell", F.lit(4 * i + j), F.get("named", part(i)), F.get("named", part(j))).alias("cell"), halves.alias("left")))
    rows = rows.withColumn("far", distances(width)).withColumn("named", named)
    return rows.select("fp", F.explode(F.array(*six)).alias("s")).select("s.cell", "fp", "s.left")


def _linked(fp: np.ndarray, far: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning links of one cell: fp (n), far (n, pivots)."""
    a, b = np.triu_indices(len(fp), 1)
    near = np.ones(len(a), bool)
    for i in range(0, len(a), 512):
        near[i : i + 512] = np.abs(far[a[i : i + 512]] - far[b[i : i + 512]]).max(1) <= distance
    a, b = a[near], b[near]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
    root, out = list(range(len(fp))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
        if (p := find(x)) != (q := find(y)):
            root[q] = p
            out.append((x, y))
    return out


def _compare(distance: int, pivots: int):
    """Over rows (cell, fp, far) sorted by cell: the links of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _whole_cells(batches, held):
            cell, fp = batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            far = batch.column("far").flatten().to_numpy().reshape(-1, pivots)
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            links = [(fp[s + x], fp[s + y]) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if e - s > 1 for x, y in _linked(fp[s:e], far[s:e], distance)]
            out = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return run


def _whole_cells(batches: Iterator[pa.RecordBatch], held: list) -> Iterator[pa.RecordBatch]:
    """Batches cut where a cell ends; a cell holds 256 rows at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        cell = batch.column("cell").to_numpy()
        others = np.flatnonzero(cell != cell[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        held[:] = [batch.slice(cut)]
        if cut:
            yield batch.slice(0, cut)
    if held:
        yield held[0]


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp), enough to connect all that are within distance (2 at most) of each other."""
    if not 0 <= distance <= 2:
        raise ValueError("two of four parts are only sure to agree at a distance of two or less")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, out = fps.repartition(tasks).select(F.lit(0).cast("long").alias("cell"), "fp", F.array(*map(F.lit, range(4))).alias("left")), None
    for width in WIDTHS:
        cells = written(_split(rows, width), "cells")
        shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        members = written(cells.join(shared, "cell"), "members")
        removed(cells)
        last = width == WIDTHS[-1]
        few = members if last else members.where(F.col("n") <= CELL)
        few = few.repartition("cell").sortWithinPartitions("cell").select("cell", "fp", distances(width).alias("far"))
        links = few.mapInArrow(_compare(distance, len(references(width))), "a long, b long")
        out = links if out is None else out.unionByName(links)
        rows = members.where(F.col("n") > CELL).select("cell", "fp", "left")
        if last or not rows.limit(1).count():
            return out.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (hex), component_id (the smallest doc_id reachable over links)."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(near_links(classes.select("fp"), distance))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", F.xxhash64("fp")).alias("root"))
    linked = written(linked, "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = linked.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", fold(F.col("fp")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with all their columns, less every document but the first of its component; rows without an id stay."""
    return without(docs, lambda: near_duplicates(only(docs, "doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct())
