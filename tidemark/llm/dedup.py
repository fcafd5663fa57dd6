"""Exact deduplication against immutable snapshots.

Publishing a snapshot writes its distinct digests, dealt to buckets by hash, and
with each bucket a static binary-fuse filter (about 9 bits a key, one false
positive in 256); later batches read both. Digests of a new batch are grouped on their own first; one row a distinct
digest goes to its bucket's filter. What the filter refuses is new. What it
admits joins the snapshot's exact digests, and the two representatives' bytes
are compared. Rows of a digest are pre-aggregated before each shuffle, so a
group that holds a third of all rows moves as one row a task.

Results for odd input: a null text is empty; a null id stands after all others
(it represents a group only where no other id does); of repeated rows of one
id and text exactly one is kept; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, only, without, written

#: Keys that one filter holds on average; a bucket's filter is built and read in one task.
KEYS_A_BUCKET = 250_000
LEAST_BUCKETS = 64
#: Bits of the bitmap of ids whose texts are compared (8 MB in all, 4 KB a row): the table that is broadcast has this size at most.
ID_BITS, ROW_BITS = 1 << 26, 1 << 15


def normal(text: Column) -> Column:
    """Each run of white space as one space. A lone space stays as it is, so only other runs are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


class FuseFilter:
    """A static 3-wise binary fuse filter of 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
        h = keys.astype(np.uint64) + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots of each key, in consecutive segments."""
        first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
        out = np.empty((3, len(h)), np.int64)
        out[0] = first
        for i, shift in ((1, 18), (2, 0)):
            out[i] = (first + np.uint64(i * segment)) ^ ((h >> np.uint64(shift)) & np.uint64(segment - 1))
        return out

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
        segments = max(1, -(-room // segment))
        for seed in range(1, 200):
            h = cls._mixed(keys, seed * 0x9E3779B9)
            slots = cls._slots(h, segment, segments)
            order = cls._peeled(slots, (segments + 2) * segment)
            if order is not None:
                break
            if seed % 10 == 0:  # tiny sets sometimes need more room
                segments += max(1, segments // 8)
        else:
            raise ValueError("keys repeat")
        table = np.zeros((segments + 2) * segment, np.uint8)
        prints = cls._prints(h)
        for which, at in reversed(order):  # keys peeled in one round touch none of each other's slots
            s = slots[:, which]
            table[at] = prints[which] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]] ^ table[at]
        return cls(seed * 0x9E3779B9, segment, segments, table)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @staticmethod
    def _peeled(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, their lone slots); None if a core is left. Each round takes all slots that hold one key."""
        n = slots.shape[1]
        count = np.bincount(slots.ravel(), minlength=size)
        mask = np.zeros(size, np.int64)  # xor of the keys in a slot
        for row in slots:
            np.bitwise_xor.at(mask, row, np.arange(n))
        rounds, left, lone = [], n, np.flatnonzero(count == 1)
        while len(lone):
            keys, first = np.unique(mask[lone], return_index=True)
            at = lone[first]
            rounds.append((keys, at))
            left -= len(keys)
            touched = slots[:, keys].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(mask, touched, np.tile(keys, 3))
            touched = np.unique(touched)
            lone = touched[count[touched] == 1]
        return rounds if left == 0 else None

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.int64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = self._mixed(keys.view(np.uint64) if keys.dtype == np.int64 else keys, self.seed)
        s = self._slots(h, self.segment, self.segments)
        return self._prints(h) == self.table[s[0]] ^ self.table[s[1]] ^ self.table[s[2]]


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(np.unique(rows["key"].to_numpy(np.int64)).view(np.uint64))
    return pd.DataFrame([(key[0], f.seed, f.segment, f.segments, f.table.tobytes())], columns=["bucket", "seed", "segment", "segments", "filter"])


def _screen(key: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if rows.empty or filters.empty:
        return rows[["digest"]].iloc[:0]
    x = filters.iloc[0]
    f = FuseFilter(int(x["seed"]), int(x["segment"]), int(x["segments"]), np.frombuffer(x["filter"], np.uint8))
    return rows.loc[f.holds(rows["key"].to_numpy(np.int64)), ["digest"]]


def snapshot_filters(digests: DataFrame) -> DataFrame:
    """A snapshot's filters, a row a bucket: bucket, seed, segment, segments, filter. digests: distinct (bucket, key)."""
    return digests.select("bucket", "key").groupBy("bucket").applyInPandas(_build, "bucket long, seed long, segment long, segments long, filter binary")


@dataclass(frozen=True, slots=True)
class Snapshot:
    """A published snapshot, read from its folder: its distinct digests (digest, first, n, key, bucket), the filter of each of its buckets, their number."""

    digests: DataFrame
    filters: DataFrame
    buckets: int


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """rows (doc_id, old, digest, row) -> a row for each digest: its first row, how many it has, its filter key and bucket."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", (~F.col("old")).alias("new"), "row")).alias("first")
    parts = rows.groupBy("digest").agg(first, F.count("*").alias("n")).withColumn("key", F.xxhash64("digest"))
    return parts.withColumn("bucket", F.pmod("key", F.lit(buckets)))


def digests(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """docs (doc_id, text) -> doc_id, old, digest, row, written."""
    docs = docs.select("doc_id", "text", F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    return written(docs.select("doc_id", "old", F.unhex(F.sha2(normal(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "dedup-rows")


def publish(rows: DataFrame, folder: str) -> Snapshot:
    """Write the snapshot of some rows' digests: once, as it never changes. Its filters are built here and nowhere else."""
    buckets = max(LEAST_BUCKETS, -(-rows.count() // KEYS_A_BUCKET))
    _grouped(rows, buckets).write.parquet(f"{folder}/digests")
    snapshot_filters(rows.sparkSession.read.parquet(f"{folder}/digests")).withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/filters")
    return opened(rows.sparkSession, folder)


def opened(spark: SparkSession, folder: str) -> Snapshot:
    """A snapshot that was published."""
    filters = spark.read.parquet(f"{folder}/filters")
    return Snapshot(spark.read.parquet(f"{folder}/digests"), filters.drop("buckets"), filters.agg(F.max("buckets")).first()[0] or LEAST_BUCKETS)


def screened(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The digests of incoming (bucket, key, digest) that the snapshot's filters admit."""
    return incoming.select("bucket", "key", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_screen, "digest binary")


def perhaps_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less most rows whose doc_id is not in ids (doc_id): those whose bit is clear in a bitmap of the ids' hashes."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    row, bit = F.floor(place / ROW_BITS).alias("_row"), (place % ROW_BITS)
    marks = ids.select(row, bit.alias("_bit")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, _in_byte) & 1") == 1
    marked = docs.withColumn("_row", row).join(F.broadcast(marks), "_row")
    return marked.withColumn("_byte", byte).withColumn("_in_byte", (bit % 8).cast("int")).where(is_set).select(*docs.columns)


def exact_dedup(docs: DataFrame, in_snapshot: Column, snapshot: Snapshot | None = None) -> DataFrame:
    """Decide every row of docs (doc_id, text): which row of its group of equal texts stays.

    in_snapshot marks the rows of the published, immutable snapshot; the others
    are the new batch. snapshot: what `publish` made of the marked rows; without
    it, it is published to the shared folder first. Of equal texts the row with
    the smallest doc_id stays. Returns doc_id, keep_id, group_size, kept,
    text_sha256, a row for each row.
    """
    docs = docs.select("doc_id", "text", F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    rows = digests(docs, F.col("old"))
    snapshot = snapshot or publish(rows.where("old"), new_folder(docs.sparkSession, "snapshot"))
    old, new = snapshot.digests, written(_grouped(rows.where("not old"), snapshot.buckets), "dedup-new")
    parts = new.withColumn("old", F.lit(False)).unionByName(old.withColumn("old", F.lit(True)))

    admitted = screened(new, snapshot.filters)
    both = (
        admitted.join(new.select("digest", F.col("first").alias("new"), F.col("n").alias("new_n")), "digest")
        .join(old.select("digest", F.col("first").alias("known"), F.col("n").alias("known_n")), "digest")
        .select("digest", F.least("new", "known").alias("all_first"), (F.col("new_n") + F.col("known_n")).alias("all_n"), F.array("new.doc_id", "known.doc_id").alias("ids"))
    )
    both = written(both, "dedup-both")
    ids = both.select("digest", F.explode("ids").alias("doc_id")).where("doc_id is not null").distinct()
    texts = perhaps_in(docs, ids).join(ids, "doc_id").select("digest", normal(F.col("text")).alias("text")).where(F.unhex(F.sha2("text", 256)) == F.col("digest"))
    differ = texts.groupBy("digest").agg((F.min("text") != F.max("text")).alias("differ")).where("differ").select("digest")
    same = both.drop("ids").join(differ, "digest", "left_anti")

    groups = parts.select("digest", "old", "first", "n").join(same, "digest", "left")
    groups = groups.select("digest", "old", F.coalesce("all_first", "first").alias("stays"), F.coalesce("all_n", "n").alias("group_size"))
    return rows.join(groups, ["digest", "old"]).select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", ((F.col("row") == F.col("stays.row")) & (F.col("old") != F.col("stays.new"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with all their columns, less the rows whose text an earlier id has.

    doc_id names a document: rows without one stay, and repeated rows of one id stay together.
    """
    said = lambda: exact_dedup(only(docs, "doc_id", "text"), halves())
    return without(docs, lambda: said().groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept and doc_id is not null"))


def halves() -> Column:
    """A snapshot for tables that say nothing of batches: the half of the ids whose hash is even."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
