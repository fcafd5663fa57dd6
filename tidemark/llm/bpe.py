"""Byte-level BPE encoding and decoding with a rank queue.

A pre-token's byte positions form a linked list. Every adjacent pair that can
merge stands in the bucket of its merge's rank; a three-level bitmap over the
ranks names the lowest occupied bucket by find-first-set. A bucket gives up its
positions from the left; an entry whose position no longer starts a pair of
that rank is stale and skipped. A bucket is put in order once, as it comes up:
no merge adds to the bucket that it comes from, since what it makes is longer.
If a merge makes a pair of a lower rank, that one is next, and the rest of the
bucket waits in order. A pre-token of n bytes takes O(n log n) steps,
however long it is. Many short new pre-tokens share one queue, and what they
merge to is kept in two bounded generations.

Odd input: a null text is empty and has no tokens; repeated rows each get a
row; empty tables give empty results; columns besides those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import as_bytes, held, small_batches

#: Pre-tokens that a worker remembers in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64
#: Characters of text that are split at once, and bytes of new pre-tokens that share a queue; a longer text is split step by step, a longer pre-token taken whole.
SPLIT, TOGETHER = 1 << 17, 1 << 15
#: Bits of a token in a pair.
SHIFT = 32


class Bpe:
    """One vocabulary: bytes -> rank. A token's id is its rank; two neighbours merge if their bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        top = max(ranks.values(), default=0) + 1
        self.words = [0] * ((top >> 6) + 1)  # the bitmap's levels: all zero between calls
        self.upper = [0] * ((top >> 12) + 1)
        #: Of each rank: its places in the two lists, its bits there and in the top word.
        self.place = [(r >> 6, r >> 12, 1 << (r & 63), 1 << (r >> 6 & 63), 1 << (r >> 12)) for r in range(top)]
        #: The ranks of single bytes (-1: none), and of what two tokens make together, by both.
        self.single = np.array([ranks.get(bytes([a]), -1) for a in range(256)], np.int64)
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None:
                    self.pairs[left << SHIFT | right] = rank
        #: Pre-token -> its packed ids. A full young generation becomes the old one, whose entries return as they are asked for.
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token. They share one queue; a free place, whose token is -1, parts two of them, so no pair spans them and none sees the others' merges."""
        get, words, upper, place = self.pairs.get, self.words, self.upper, self.place
        raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        n, free = len(raw), np.cumsum([0, *(len(p) + 1 for p in pieces)])
        token = self.single[raw]
        token[free] = 0
        if token.min() < 0:
            raise ValueError("a byte is no token")
        token[free] = -1
        token = token.tolist()  # of the bytes that start here; -1 where they belong to another place
        rank = [get(a << SHIFT | b, -1) for a, b in zip(token, token[1:])]  # of the pair that starts here
        rank.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: Positions by rank as they came, and what is left of interrupted buckets, the leftmost last.
        buckets: dict[int, list[int]] = {}
        waiting: dict[int, list[int]] = {}
        top = 0
        for p, r in enumerate(rank):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(p)
                else:
                    buckets[r] = [p]
                    w, i, bit, above, high = place[r]
                    words[w] |= bit
                    upper[i] |= above
                    top |= high
        while top:
            i = (top & -top).bit_length() - 1
            x = upper[i]
            w = i << 6 | (x & -x).bit_length() - 1
            x = words[w]
            r = w << 6 | (x & -x).bit_length() - 1
            bucket = buckets.pop(r, None)
            if bucket is None:
                bucket = waiting.pop(r)
            else:
                if r in waiting:
                    bucket += waiting.pop(r)
                bucket.sort(reverse=True)
            left, lower = r << SHIFT, r
            while bucket:
                p = bucket.pop()  # the leftmost
                if rank[p] != r:
                    continue
                q, o = after[p], before[p]
                e = after[p] = after[q]
                before[e] = p
                token[p], token[q], rank[q] = r, -1, -1
                rank[p] = new = get(left | token[e], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(p)
                    else:
                        buckets[new] = [p]
                        x, y, bit, above, high = place[new]
                        words[x] |= bit
                        upper[y] |= above
                        top |= high
                    if new < lower:
                        lower = new
                rank[o] = new = get(token[o] << SHIFT | r, -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(o)
                    else:
                        buckets[new] = [o]
                        x, y, bit, above, high = place[new]
                        words[x] |= bit
                        upper[y] |= above
                        top |= high
                    if new < lower:
                        lower = new
                if lower < r:
                    break
            if bucket:
                waiting[r] = bucket
            else:
                words[w] ^= 1 << (r & 63)
                if not words[w]:
                    upper[i] ^= 1 << (w & 63)
                    if not upper[i]:
                        top ^= 1 << i
        tokens = np.array(token, np.int64)
        starts = np.flatnonzero(tokens >= 0)
        packed = tokens[starts].astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(starts, free)).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, wanted: set[str]) -> list[str]:
        """See to it that `seen` has all that is wanted; returns what is too long to be remembered."""
        if len(self.seen) >= REMEMBERED:
            self.seen, self.old = {}, self.seen
        seen, some, size = self.seen, {}, 0

        def merged() -> None:
            seen.update(zip(some, self.merge(list(some.values())), strict=True))
            some.clear()

        new = wanted.difference(seen)
        for piece in new:
            if (ids := self.old.get(piece)) is not None:
                seen[piece] = ids
                continue
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                seen[piece] = whole.to_bytes(4, "little")
                continue
            if some and size + len(raw) > TOGETHER:
                merged()
                size = 0
            some[piece] = raw
            size += len(raw)
        merged()
        return [piece for piece in new if len(piece) > LONGEST]

    def _ids(self, parts: list[list[str]]) -> list[bytes]:
        """The packed ids of each list of pre-tokens."""
        long = self._learn(set().union(*parts))
        out = [b"".join(map(self.seen.__getitem__, part)) for part in parts]
        for piece in long:
            del self.seen[piece]
        return out

    def _long(self, text: str) -> bytes:
        """A long text's packed ids, some pre-tokens after the others."""
        found = self.pattern.finditer(text)
        return b"".join(self._ids([part])[0] for part in iter(lambda: [m[0] for m in islice(found, SPLIT >> 2)], []))

    def packed(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out, some, size = [], [], 0
        for text in texts:
            if size + len(text) > SPLIT:
                out += self._ids(list(map(self.pattern.findall, some)))
                some, size = [], 0
            if len(text) > SPLIT:
                out.append(self._long(text))
            else:
                some.append(text)
                size += len(text)
        return out + self._ids(list(map(self.pattern.findall, some)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], "<u4").tolist()


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _table(spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> Callable[[], Bpe]:
    """For tasks: one table a worker process and vocabulary, which is read from the broadcast only where it isn't held yet."""
    key, given = (len(ranks), hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), pattern), spark.sparkContext.broadcast(ranks)
    return lambda: held(key, lambda: Bpe(given.value, pattern))


def _encoded(batches: Iterator[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = bpe.packed([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (little-endian unsigned 32-bit integers, as binary)."""
    table = _table(docs.sparkSession, ranks, pattern)
    run = lambda batches: _encoded(batches, table())
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


#: Ids that are decoded at once.
CHUNK = 1 << 16


class Tokens:
    """All tokens' bytes end to end, so that ids decode as gathered slices. An id that is no token is an error."""

    def __init__(self, ranks: dict[bytes, int]):
        self.lengths = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        self.starts = np.zeros(len(self.lengths), np.int64)
        at = 0
        for token, rank in ranks.items():
            self.starts[rank], self.lengths[rank] = at, len(token)
            at += len(token)
        self.flat = np.frombuffer(b"".join(ranks), np.uint8)

    def decode(self, packed: bytes) -> bytes:
        ids, out = np.frombuffer(packed, "<u4"), []
        for s in range(0, len(ids), CHUNK):
            some = ids[s : s + CHUNK]
            n = self.lengths[some]
            if n.min() < 0:
                raise ValueError("an id is no token")
            before = np.cumsum(n) - n
            out.append(self.flat[np.repeat(self.starts[some] - before, n) + np.arange(int(n.sum()))].tobytes())
        return b"".join(out)


def _decoded(batches: Iterator[pa.RecordBatch], tokens: Tokens) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = list(map(tokens.decode, as_bytes(batch, "ids")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])
    pa.default_memory_pool().release_unused()


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, ids, decoded (bytes)."""
    given = encoded.sparkSession.sparkContext.broadcast(Tokens(ranks))
    run = lambda batches: _decoded(batches, given.value)
    return small_batches(encoded.select("doc_id", "ids")).mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """decode(encode(docs)) in one Python worker a task instead of two."""
    table, given = _table(docs.sparkSession, ranks, pattern), docs.sparkSession.sparkContext.broadcast(Tokens(ranks))
    run = lambda batches: _decoded(_encoded(batches, table()), given.value)
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, decoded binary")
