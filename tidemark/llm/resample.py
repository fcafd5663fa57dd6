"""Target-distribution importance resampling over hashed n-gram buckets.

A document's features are its runs of 1 to `longest` consecutive words, hashed
into buckets. A bucket's gain is the logarithm of its share in the target over
its share in the raw documents; a document's weight is the sum of its features'
gains, and the documents of the highest weight plus Gumbel noise are drawn,
which is drawing without replacement in proportion to exp(weight).

In a partition texts are gathered into shards of bounded size. A shard's words
become ids, and its suffixes are sorted by their first `longest` ids: equal
n-grams lie next to each other, so for each n the runs of the array whose common
prefix (LCP) is n or more are the distinct n-grams. Each run is hashed once, and
its bucket is scattered to all its places. Suffixes are sorted no deeper, as no
feature is longer.

Two passes read the texts and move nothing but a number a bucket and task, then
a few numbers a document. Places in the draw come from range partitions that are
written once, with a count each: no task sees all rows.

Words: A-Z lower-cased, runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. Odd input:
a null or empty text has no words and no features, weight 0, and isn't drawn
while `least_words` is over 0; a null id is hashed as empty text and comes after
other ids on a tie; repeated rows are documents each; an empty target makes all
gains follow the raw counts alone; empty documents give an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, let_go, small_batches, written
from tidemark.llm.decontam import words

BUCKETS = 10_000
#: A shard is closed at so many words; only one longer document makes a longer one.
SHARD_WORDS = 250_000


class Shard:
    """Some documents' words as ids, and the array of their suffixes, sorted by `longest` ids. A free id follows each document, so no feature runs over its end."""

    def __init__(self, texts: list[list[bytes]], longest: int):
        known: dict[bytes, int] = {}
        self.lengths = np.array([len(t) for t in texts], np.int64)
        ids: list[int] = []
        for t in texts:
            ids += [known.setdefault(w, len(known)) for w in t]
            ids.append(-1)
        self.known, self.longest = list(known), longest
        self.ids = np.array(ids, np.int64)
        self.begins = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.suffixes = self._sorted()
        self.lcp = self._common()

    def _at(self, places: np.ndarray) -> np.ndarray:
        """Ids at places; beyond the end: -1."""
        return np.where(places < len(self.ids), self.ids[np.minimum(places, len(self.ids) - 1)], -1) if len(self.ids) else np.zeros(0, np.int64)

    def _sorted(self) -> np.ndarray:
        """By doubling: ranks by the first k ids give ranks by 2 k, until k covers the longest feature."""
        rank, order, k = self.ids + 1, np.argsort(self.ids, kind="stable"), 1
        while k < self.longest and len(rank):
            behind = np.concatenate([rank[k:], np.zeros(min(k, len(rank)), np.int64)])
            both = rank * (len(rank) + 2) + behind
            order = np.argsort(both, kind="stable")
            rank = np.empty_like(rank)
            rank[order] = np.concatenate([[1], 1 + np.cumsum(np.diff(both[order]) != 0)])
            k *= 2
        return order

    def _common(self) -> np.ndarray:
        """Of each suffix with the one before it: equal leading ids, `longest` at most, none across a document's end."""
        lcp, same = np.zeros(len(self.suffixes), np.int64), np.ones(max(0, len(self.suffixes) - 1), bool)
        for k in range(self.longest):
            a = self._at(self.suffixes + k)
            same = same & (a[1:] == a[:-1]) & (a[1:] >= 0)
            lcp[1:] += same
        return lcp

    def buckets(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a feature of n words starts, and its bucket."""
        whole = np.ones(len(self.suffixes), bool)
        for k in range(n):
            whole &= self._at(self.suffixes + k) >= 0
        places, lcp = self.suffixes[whole], self.lcp[whole]
        heads = np.flatnonzero(lcp < n)  # equal n-grams are neighbours, so a run's first has another one before it
        of_run = np.fromiter((zlib.crc32(b" ".join([self.known[i] for i in self.ids[p : p + n].tolist()])) % buckets for p in places[heads].tolist()), np.int64, len(heads))
        return places, np.repeat(of_run, np.diff(np.append(heads, len(places))))

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, side="right") - 1


def _shards(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[list, Shard]]:
    """(ids, shard): what the batches hold, shard by shard."""
    ids, texts, n = [], [], 0
    for batch in batches:
        own = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * batch.num_rows
        for doc, text in zip(own, as_bytes(batch, "text"), strict=True):
            ids.append(doc)
            texts.append(w := words(text))
            n += len(w) + 1
            if n >= SHARD_WORDS:
                yield ids, Shard(texts, longest)
                ids, texts, n = [], [], 0
    if ids:
        yield ids, Shard(texts, longest)


def bucket_counts(df: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all rows of df (text). A task gives each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(buckets, np.int64)
        for _, shard in _shards(batches, longest):
            for n in range(1, longest + 1):
                total += np.bincount(shard.buckets(n, buckets)[1], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return small_batches(df.select("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Of each bucket floor(1000 ln ((t + 1) (S + buckets) / ((s + 1) (T + buckets)))). The driver gets a number a bucket and side, whatever the input's size."""
    both = []
    for df in (raw, target):
        n = [0] * buckets
        for r in bucket_counts(df, longest, buckets).collect():
            n[r["bucket"]] = r["n"]
        both.append(n)
    all_s, all_t = map(sum, both)
    return [math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets)))) for s, t in zip(*both, strict=True)]


def weights(docs: DataFrame, gain: list[int], longest: int = 1) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_features, weight."""
    kind, spark = dict(docs.dtypes)["doc_id"], docs.sparkSession
    given = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        of = np.array(given.value, np.int64)
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field("doc_id").type

        def whole() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for ids, shard in _shards(whole(), longest):
            n, weight = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for k in range(1, longest + 1):
                places, bucket = shard.buckets(k, len(of))
                doc = shard.document(places)
                n += np.bincount(doc, minlength=len(ids))
                np.add.at(weight, doc, of[bucket])
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(x, pa.int64()) for x in (shard.lengths, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with its place (rank) in a total order, from 1. Range partitions are numbered as they are written, each is counted, and each ranks its own rows."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    return parts.withColumn("_at", place).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at")).select(*df.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank. rank is the place among the drawn: `percent` in a hundred of the documents with `least_words` words, highest score first, smaller doc_id first on a tie; null for the others."""
    scored = weights(docs, gains(docs, target, longest, buckets), longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "scored")
    may = F.col("n_words") >= least_words
    drawn = scored.where(may).count() * percent // 100
    placed = ranked(scored.where(may), [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = placed.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
