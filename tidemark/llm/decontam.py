"""Benchmark decontamination over a distributed positional inverted index.

`build_index` stores the postings of every token of the training documents,
document-partitioned: a shard holds some documents' terms (64-bit hashes,
sorted) with their position lists. `phrase_hits` takes the test phrases in
blocks of bounded size, orders each phrase's terms from the rarest in the whole
index, and intersects offset-adjusted position lists shard by shard, so
nothing is shuffled but per-document results. `proximity_hits` looks around the
rarest term for all the others within a span.

Words: A-Z lower-cased, runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. Odd input:
a null or empty text has no words and no hits, in documents as in items; equal
phrases of several items count for each item; repeated document rows each get
a row; empty tables give empty results or no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, let_go, small_batches, without, written

WINDOW = 13
#: A shard is closed at so many words, so one row of the index stays at a few MB; only a longer document makes a longer row.
SHARD_WORDS = 250_000
#: Test items are matched in blocks of about so many bytes of text; a block is what the driver and each worker hold.
BLOCK_BYTES = 16_000_000
#: Other bytes than digits, lower-case letters and those of non-ASCII characters part words.
_TO_SPACE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

INDEX = "shard long, doc_ids array<{id}>, n_words array<int>, terms binary, offsets binary, positions binary"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split()


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _shard(number: int, ids: list, texts: list[list[bytes]], schema: pa.Schema) -> pa.RecordBatch:
    """Postings of some documents. A free position follows each document, so no phrase runs over its end."""
    known: dict[bytes, int] = {}
    seq: list[int] = []
    for t in texts:
        seq += [known.setdefault(w, len(known)) for w in t]
    n_words = np.array([len(t) for t in texts], np.int64)
    positions = np.arange(len(seq)) + np.repeat(np.arange(len(texts)), n_words)
    term = np.array(seq, np.int32)
    hashes = np.fromiter(map(_hash, known), np.uint64, len(known))
    by_hash = np.argsort(hashes)
    place = np.empty(len(known), np.int32)
    place[by_hash] = np.arange(len(known), dtype=np.int32)
    term = place[term] if len(term) else term
    order = np.argsort(term, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(known)))]).astype(np.int32)
    row = [[number], [ids], [n_words.astype(np.int32)], [hashes[by_hash].tobytes()], [offsets.tobytes()], [positions[order].astype(np.int32).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text): a row a shard."""
    kind = dict(docs.dtypes)["doc_id"]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        number = TaskContext.get().partitionId() << 32
        ids, texts, n, schema = [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(id_type)), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("offsets", pa.binary()), ("positions", pa.binary())])
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text"), strict=True):
                ids.append(doc)
                texts.append(w := words(text))
                n += len(w) + 1
                if n >= SHARD_WORDS:
                    yield _shard(number, ids, texts, schema)
                    number, ids, texts, n = number + 1, [], [], 0
        if ids:
            yield _shard(number, ids, texts, schema)

    return written(small_batches(docs.select("doc_id", "text")).mapInArrow(shards, INDEX.format(id=kind)), "positional-index")


class Shard:
    """One row of the index, as arrays."""

    def __init__(self, terms: bytes, offsets: bytes, positions: bytes):
        self.terms, self.offsets, self.positions = np.frombuffer(terms, np.uint64), np.frombuffer(offsets, np.int32), np.frombuffer(positions, np.int32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each term's list is; -1: the shard has none."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def list(self, place: int) -> np.ndarray:
        return self.positions[self.offsets[place] : self.offsets[place + 1]]


def _within(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, wanted)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == wanted


def _starts(shard: Shard, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the phrase begins: the rarest term's list, cut down by each next rarer one's, all moved by the terms' offsets."""
    found = shard.list(at[order[0]]) - order[0]
    for k in order[1:]:
        if not len(found):
            break
        found = found[_within(shard.list(at[k]), found + k)]
    return found


def _near(shard: Shard, at: np.ndarray, order: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Smallest ranges of at most span words that hold every term of the phrase, each once at least; they start or end where they must."""
    distinct = list(dict.fromkeys(at[order]))
    lists = [shard.list(p) for p in distinct]
    anchors = lists[0]
    for other in lists[1:]:  # of the rarest term's places, those with each other term near enough
        lo = np.searchsorted(other, anchors - span + 1)
        anchors = anchors[(lo < len(other)) & (other[np.minimum(lo, len(other) - 1)] <= anchors + span - 1)]
        if not len(anchors):
            return []
    out = set()
    for a in anchors.tolist():
        near = sorted((int(p), i) for i, x in enumerate(lists) for p in x[np.searchsorted(x, a - span + 1) : np.searchsorted(x, a + span)])
        last: dict[int, int] = {}
        for p, i in near:
            last[i] = p
            if len(last) == len(lists) and p - (low := min(last.values())) < span and low <= a <= p:
                out.add((low, p + 1))
    return sorted(out)


class Phrases:
    """The distinct phrases of a block of test items, as arrays: phrase k is flat[starts[k] : starts[k] + lengths[k]], places among the terms."""

    def __init__(self, texts: list[bytes], window: int | None):
        terms: dict[bytes, int] = {}
        seqs = [np.array([terms.setdefault(x, len(terms)) for x in words(t)], np.int32) for t in texts]
        self.hashes = np.fromiter(map(_hash, terms), np.uint64, len(terms))
        lengths, flat, whose = [], [], []
        for n in sorted({min(window or len(q), len(q)) for q in seqs} - {0}):
            own = [(i, np.lib.stride_tricks.sliding_window_view(q, n)) for i, q in enumerate(seqs) if min(window or len(q), len(q)) == n]
            distinct, at = np.unique(np.concatenate([w for _, w in own]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([at.ravel() + sum(map(len, lengths)), np.repeat([i for i, _ in own], [len(w) for _, w in own])]), axis=1)
            lengths.append(np.full(len(distinct), n, np.int32))
            flat.append(distinct.ravel())
            whose.append(pairs)
        none = np.zeros(0, np.int32)
        self.lengths, self.flat = np.concatenate([none, *lengths]), np.concatenate([none, *flat])
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.phrase, self.item = np.concatenate([np.zeros((2, 0), np.int64), *whose], axis=1)  # sorted by phrase

    def __len__(self) -> int:
        return len(self.lengths)

    def terms(self, k: int) -> np.ndarray:
        return self.flat[self.starts[k] : self.starts[k] + self.lengths[k]]

    def items(self, k: int) -> np.ndarray:
        return self.item[slice(*np.searchsorted(self.phrase, [k, k + 1]))]

    def all_there(self, at: np.ndarray) -> np.ndarray:
        """The phrases of which a shard has every term: nearly all are out after one look at all of them at once."""
        return np.flatnonzero(np.minimum.reduceat(at[self.flat], self.starts) >= 0) if len(self) else np.zeros(0, np.int64)


def _hits(index: DataFrame, items: DataFrame, window: int | None, span: int | None) -> DataFrame:
    """shard, doc (its place in the shard), words (places hit), item_ids; a row for each document that a block of the items hits."""
    spark = index.sparkSession
    kind = dict(items.dtypes)["item_id"]
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    out = None
    for block in range(blocks := max(1, -(-size // BLOCK_BYTES))):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", F.col("text").cast("binary").alias("text")).toArrow()
        phrases, names = Phrases([t or b"" for t in own.column("text").to_pylist()], window), own.column("item_id").combine_chunks()
        if not len(phrases) and block < blocks - 1:
            continue
        given = spark.sparkContext.broadcast((phrases, names))

        def counts(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            hashes = given.value[0].hashes
            total = np.zeros(len(hashes), np.int64)
            for batch in batches:
                for terms, offsets in zip(batch.column("terms").to_pylist(), batch.column("offsets").to_pylist(), strict=True):
                    s = Shard(terms, offsets, b"")
                    at = s.places(hashes)
                    total += np.where(at >= 0, np.diff(s.offsets, append=0)[at] if len(s.offsets) else 0, 0)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["term", "n"])

        frequency = np.zeros(len(phrases.hashes), np.int64)
        for r in index.select("terms", "offsets").mapInArrow(counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            frequency[r["term"]] = r["n"]
        often = spark.sparkContext.broadcast(frequency)

        def match(batches: Iterator[pa.RecordBatch], given=given, often=often) -> Iterator[pa.RecordBatch]:
            phrases, names = given.value
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("shard", "n_words", "terms", "offsets", "positions")]
                for number, n_words, *lists in zip(*columns, strict=True):
                    s = Shard(*lists)
                    at = s.places(phrases.hashes)
                    ranges: list[tuple[int, int, int]] = []
                    for k in phrases.all_there(at).tolist():
                        p = phrases.terms(k)
                        rarest = np.argsort(often.value[p], kind="stable")
                        if span is None:
                            ranges += [(x, x + len(p), k) for x in _starts(s, at[p], rarest).tolist()]
                        else:
                            ranges += [(lo, hi, k) for lo, hi in _near(s, at[p], rarest, span)]
                    if not ranges:
                        continue
                    begins = np.concatenate([[0], np.cumsum(np.array(n_words, np.int64) + 1)])
                    per_doc: dict[int, tuple[set, set]] = {}
                    for lo, hi, k in ranges:
                        d = int(np.searchsorted(begins, lo, side="right")) - 1
                        if hi > begins[d + 1] - 1:
                            continue  # a proximity range that runs over a document's end
                        hit, found = per_doc.setdefault(d, (set(), set()))
                        hit.update(range(lo - int(begins[d]), hi - int(begins[d])))
                        found.update(phrases.items(k).tolist())
                    rows = sorted(per_doc.items())
                    item_ids = [names.take(pa.array(sorted(f), pa.int64())) for _, (_, f) in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(rows), pa.int64()), pa.array([d for d, _ in rows], pa.int32()), pa.array([sorted(h) for _, (h, _) in rows], pa.list_(pa.int32())), pa.ListArray.from_arrays(np.cumsum([0, *map(len, item_ids)]).astype(np.int32), pa.concat_arrays([names.slice(0, 0), *item_ids]))],
                        names=["shard", "doc", "words", "item_ids"],
                    )

        hits = index.select("shard", "n_words", "terms", "offsets", "positions").mapInArrow(match, f"shard long, doc int, words array<int>, item_ids array<{kind}>")
        out = hits if out is None else out.unionByName(hits)
    return out


def _per_document(index: DataFrame, hits: DataFrame) -> DataFrame:
    """Every document of the index: doc_id, n_words, words (places hit), item_ids (as strings, sorted)."""
    hits = hits.groupBy("shard", "doc").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("item_ids").cast("array<string>"))))).alias("item_ids"))
    docs = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words"))).select("shard", F.col("pos").alias("doc"), "col.doc_ids", "col.n_words")
    docs = docs.join(hits, ["shard", "doc"], "left")
    return docs.select(F.col("doc_ids").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.coalesce("words", F.array().cast("array<int>")).alias("words"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def phrase_hits(index: DataFrame, items: DataFrame, window: int | None = WINDOW) -> DataFrame:
    """Exact matches of every run of `window` words of the items (item_id, text); a shorter item, or window None: the whole item."""
    return _per_document(index, _hits(index, items, window, None))


def proximity_hits(index: DataFrame, items: DataFrame, span: int, window: int | None = WINDOW) -> DataFrame:
    """Places where all the terms of such a run are found, in any order, within `span` words of one document."""
    return _per_document(index, _hits(index, items, window, span))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a hit, and hit words are at least 1/share of all)."""
    d = phrase_hits(build_index(docs), items.select("item_id", "text"), window)
    n_hit = F.size("words").cast("long")
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with all their columns, less the contaminated ones; rows without an id stay."""
    return without(docs, lambda: contamination(docs.select("doc_id", "text"), items).where("contaminated and doc_id is not null").select("doc_id").distinct())
