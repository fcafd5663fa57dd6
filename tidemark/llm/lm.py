"""Language-model scoring from a log-frequency Bloom filter.

All texts are tokenised once, into batches of some texts: a batch's distinct
words (64-bit hashes) and each token's place among them. A batch sends its
distinct unigrams and bigrams to hash segments, with their counts in what is
learned from. The segments' number follows the corpus, so no segment outgrows a
task and no hot n-gram a row. In its task a segment sums the counts and makes
its filter: an n-gram of quantised log frequency q goes into the filter q times,
as (n-gram, 1) to (n-gram, q); probing upwards until the first miss reads q
back. Every unigram and every bigram is held, whatever the corpus's size, by
bits of the segment's own, ENTRY_BITS an entry. There an n-gram is known by the
32 bits after the segment's: as a segment's n-grams are bounded, few share them
at any size (some 600,000 of 4 billion, far below the filter's own false
positives). The same task reads the levels of all that was sent, and they go
back to the batches with the unigrams' exact counts, which the base score uses.
So an n-gram moves once, and no filter or count is collected or broadcast: what
a machine holds is a segment or a batch.

A level stands for a range of counts. P(w|h) = (low c(h,w) + KAPPA * P(w)) /
(high c(h) + KAPPA) and P(w) = (low c(w) + 1) / (N + V + 1), low and high being
the range's ends, so that the probabilities after a history never sum to more
than 1 (false positives of the filter excepted).

Odd input: a null or empty text is its end token alone; a null id is not held
out and not learned from; repeated rows each get a row; without training rows
every count is zero; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, bucket3, small_batches, written

#: Strength of the unigrams in a bigram's probability.
KAPPA = 100.0
#: The filter's bits an entry, its probes, and the bytes of it that are broadcast: none at any size.
ENTRY_BITS, PROBES, BROADCAST = 8, 5, 0
#: Bytes of training text a segment.
SEGMENT_BYTES = 8 << 20
LEAST_SEGMENTS = 64
#: Tasks that gather the segments at most; their number follows the segments', so what one reads doesn't grow with the corpus.
MOST_TASKS = 1 << 15
#: Tokens of the texts that are a batch; a longer text is taken whole.
TOGETHER = 1 << 20
#: Words whose hashes a worker remembers.
REMEMBERED = 250_000

END = np.uint64(xxhash.xxh64_intdigest(b""))  # no word is empty
_ODD, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: The level of 2**62, more than any count.
TOP = 124


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_memo = _Hashes()


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words and its end."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) * np.uint64(3) + token)


def level(count: np.ndarray) -> np.ndarray:
    """Quantised log frequency: 1, 2 and 3 for these counts, then half octaves; 0 for none."""
    return np.where(count > 1, np.floor(2 * np.log2(np.maximum(count, 1)) + 1e-9), count > 0).astype(np.int64)


def low(q: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.where(q > 1, np.ceil(2.0 ** (q / 2) - 1e-6), q > 0).astype(np.float64)


def high(q: np.ndarray) -> np.ndarray:
    """The greatest count of a level."""
    return np.where(q > 0, low(q + 1) - 1, 0.0)


def _keys(h: np.ndarray, bits: int) -> np.ndarray:
    """The segment and the 32 bits after it."""
    return h >> np.uint64(32 - bits)


def _low(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Small numbers byte plane by byte plane: the upper ones are zero nearly everywhere, and compress."""
    return numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def _unpacked(planes: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Filter:
    """Segments of bits end to end. A key is the segment, then 32 bits of the n-gram."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.starts = np.cumsum(sizes, dtype=np.uint64) - sizes

    @classmethod
    def of(cls, segments: list[bytes]) -> Filter:
        return cls(np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) * 8 for s in segments], np.uint64))

    @classmethod
    def holding(cls, h: np.ndarray, n: np.ndarray, room: int) -> Filter:
        """One segment's filter of the n-grams h (below 2**32) of counts n, of room bits an entry."""
        q = level(n)
        bits = np.zeros(max(64, -(-int(q.sum()) * room // 64) * 64), np.uint8)
        for j in range(1, int(q.max(initial=0)) + 1):
            g, step = cls._hashed(h[q >= j], j)
            for _ in range(PROBES):
                bits[cls._scaled(g, np.uint64(len(bits)))] = 1
                g = g + step
        return cls.of([np.packbits(bits, bitorder="little").tobytes()])

    @staticmethod
    def _hashed(h: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The first probe of (n-gram, q), and the step to the next ones."""
        g = mixed(h + np.uint64(q * _ODD & MASK))
        return g, g << np.uint64(32) | g >> np.uint64(32) | np.uint64(1)

    @staticmethod
    def _scaled(g: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
        """The upper half of g as a place in a segment: a multiplication and a shift, as a division would take longer."""
        return (g >> np.uint64(32)) * size >> np.uint64(32)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probing ends at the first miss, and at TOP, the level of the greatest possible count."""
        segment = (keys >> np.uint64(32)).astype(np.int64)
        h, start, size = keys & np.uint64(0xFFFFFFFF), self.starts[segment], self.sizes[segment]
        q, left = np.zeros(len(keys), np.int64), np.flatnonzero(size)
        h, start, size = h[left], start[left], size[left]
        for j in range(1, TOP + 1):
            g, step = self._hashed(h, j)
            for _ in range(PROBES):  # most misses end at the first probes
                at = start + self._scaled(g, size)
                hit = np.flatnonzero(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                h, start, size, left, g, step = h[hit], start[hit], size[hit], left[hit], g[hit] + step[hit], step[hit]
            q[left] = j
            if not len(left):
                break
        return q


#: The ends of each level's range of counts.
_LOW, _HIGH = low(np.arange(TOP + 2)), high(np.arange(TOP + 2))


def log10_p(words: np.ndarray, which: np.ndarray, one: np.ndarray, two: np.ndarray, n: int, v: int, kappa: float) -> np.ndarray:
    """log10 P of each token of texts that are laid end to end; a token's history is the one before (a first token's: an end). The tokens are words[which]; one: the words' levels, two: those of each token's bigram."""
    least, most = _LOW[one], _HIGH[one]
    before = np.concatenate([np.flatnonzero(words == END), which[:-1]])
    both = np.minimum(_LOW[two], np.minimum(least[which], least[before]))
    return np.log10((both + kappa * (least[which] + 1) / (n + v + 1)) / (most[before] + kappa))


def _bigrams(words: np.ndarray, which: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of the bigrams of the tokens words[which], in order, and each token's place among them."""
    t = words[which]
    return np.unique(_keys(pairs(np.concatenate([[END], t[:-1]]), t), bits), return_inverse=True)


def batched(docs: DataFrame) -> DataFrame:
    """docs (text, learn, and others, the last of them row) -> a row a text: the others, n_tokens; and a row a batch: batch, words (the frequent ones first), which (each token's place there), lengths, rows, learn (a byte a text), size (bytes that are learned from). Written, so that a batch stays what it is."""
    others, together = [c for c in docs.columns if c not in ("text", "learn")], TOGETHER
    of_batch = {"batch": pa.int64(), "words": pa.binary(), "which": pa.binary(), "lengths": pa.binary(), "rows": pa.binary(), "learned": pa.binary(), "size": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[np.ndarray] = []
        rows: list[int] = []
        learned: list[bool] = []
        kinds: list[pa.DataType] = []
        held = size = 0

        def joint() -> pa.RecordBatch:
            distinct, which, times = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            values = [rows[0], distinct[order].tobytes(), _packed(rank[which]), np.array([len(t) for t in some], np.int64).tobytes(), np.array(rows, np.int64).tobytes(), np.array(learned, np.uint8).tobytes(), size]
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.nulls(1, pa.int64()), *(pa.array([x], k) for x, k in zip(values, of_batch.values(), strict=True))], names=[*others, "n_tokens", *of_batch])

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in others]
            lengths = []
            for text, row, learn in zip(as_bytes(batch, "text"), batch.column("row").to_pylist(), batch.column("learn").to_pylist(), strict=True):
                some.append(t := tokens(text))
                rows.append(row)
                learned.append(bool(learn))
                lengths.append(len(t))
                held, size = held + len(t), size + len(text) * bool(learn)
                if held >= together:
                    yield joint()
                    some, rows, learned, held, size = [], [], [], 0, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(lengths, pa.int64()), *(pa.nulls(len(lengths), k) for k in of_batch.values())], names=[*others, "n_tokens", *of_batch])
        if some:
            yield joint()

    kinds = "".join(f"`{c}` {kind}, " for c, kind in docs.select(*others).dtypes)
    return written(small_batches(docs).mapInArrow(run, kinds + "n_tokens long, batch long, words binary, which binary, lengths binary, rows binary, learned binary, size long"), "read")


def looked_up(batches: DataFrame, bits: int) -> DataFrame:
    """batches (see `batched`) -> for each batch and segment: batch, segment, known (exact counts of the batch's words there, by their hash), one and two (levels of its words and bigrams there); for each segment, without a batch: distinct and total (its unigrams' number, and that of all their occurrences)."""
    shift, room = np.uint64(64 - bits), ENTRY_BITS  # what a task uses is closed over: a worker has no changed module

    def sent(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("batch", "words", "which", "lengths", "learned")
        for batch in given:
            for number, words, which, lengths, learned in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                words, which = np.frombuffer(words, np.uint64), _unpacked(which)
                learn = np.repeat(np.frombuffer(learned, np.uint8), np.frombuffer(lengths, np.int64)).astype(np.float64)
                two, at = _bigrams(words, which, bits)
                order = np.argsort(words)
                one, one_n, two_n = words[order], np.bincount(which, learn, len(words))[order], np.bincount(at, learn, len(two))
                edges = np.arange((1 << bits) + 1, dtype=np.int64)
                a, b = (np.searchsorted(x, edges).tolist() for x in ((one >> shift).astype(np.int64), (two >> np.uint64(32)).astype(np.int64)))
                two = _low(two)
                own = [k for k in range(1 << bits) if a[k + 1] > a[k] or b[k + 1] > b[k]]
                cut = lambda x, e, made: pa.array([made(x[e[k] : e[k + 1]]) for k in own], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array([number] * len(own), pa.int64()), cut(one, a, np.ndarray.tobytes), cut(one_n, a, _packed), cut(two, b, np.ndarray.tobytes), cut(two_n, b, _packed)],
                    names=["segment", "batch", "one", "one_n", "two", "two_n"],
                )

    def summed(h: list[bytes], n: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes in order, their counts, the place among them of each that was sent, and where each batch's begin."""
        distinct, at = np.unique(np.frombuffer(b"".join(h), kind), return_inverse=True)
        counts = np.bincount(at, np.concatenate([np.zeros(0), *map(_unpacked, n)]), len(distinct)).astype(np.int64)
        return distinct, counts, at, np.cumsum([0, *(len(x) // np.dtype(kind).itemsize for x in h)])

    def answered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, one_n, one_at, a = summed(rows["one"], rows["one_n"], np.uint64)
        two, two_n, two_at, b = summed(rows["two"], rows["two_n"], np.uint32)
        low, there = _low(_keys(one, bits)), one_n > 0
        known = Filter.holding(np.concatenate([low[there], two[two_n > 0]]).astype(np.uint64), np.concatenate([one_n[there], two_n[two_n > 0]]), room)
        one_q, two_q = (known.levels(h.astype(np.uint64)).astype(np.uint8) for h in (low, two))
        spans = range(len(rows))
        told = pd.DataFrame(
            {
                "batch": rows["batch"].astype("Int64").to_numpy(), "known": [_packed(one_n[one_at[a[k] : a[k + 1]]], "<u8") for k in spans],
                "one": [one_q[one_at[a[k] : a[k + 1]]].tobytes() for k in spans], "two": [two_q[two_at[b[k] : b[k + 1]]].tobytes() for k in spans], "distinct": None, "total": None,
            }
        )
        sums = pd.DataFrame([[None, None, None, None, int(there.sum()), int(one_n.sum())]], columns=told.columns)
        out = pd.concat([told.astype(object), sums.astype(object)])
        out["segment"] = key[0]
        return out

    rows = small_batches(batches.select("batch", "words", "which", "lengths", "learned")).mapInArrow(sent, "segment long, batch long, one binary, one_n binary, two binary, two_n binary")
    rows = rows.repartition(min(1 << bits, MOST_TASKS), "segment").groupBy("segment")
    return written(rows.applyInPandas(answered, "batch long, segment long, known binary, one binary, two binary, distinct long, total long"), "told")


def answers(batches: DataFrame, told: DataFrame, bits: int, n: int, v: int, kappa: float) -> DataFrame:
    """batches and what was looked up for them -> row, n_known, base_score, score."""

    def answer(key: tuple, batch: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        (given,) = batch.itertuples()
        words, which, lengths = np.frombuffer(given.words, np.uint64), _unpacked(given.which), np.frombuffer(given.lengths, np.int64)
        told, order = told.sort_values("segment"), np.argsort(words)
        one, count = np.empty(len(words), np.uint8), np.empty(len(words), np.int64)
        one[order] = np.frombuffer(b"".join(told["one"]), np.uint8)
        count[order] = np.concatenate([_unpacked(x, "<u8") for x in told["known"]])
        two = np.frombuffer(b"".join(told["two"]), np.uint8)[_bigrams(words, which, bits)[1]]
        starts = np.cumsum(lengths) - lengths
        total = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "row": np.frombuffer(given.rows, np.int64), "n_known": total((count > 0)[which].astype(np.int64)),
            "base_score": total(np.log10(count + 1.0)[which]) - lengths * float(np.log10(n + v + 1)), "score": total(log10_p(words, which, one, two, n, v, kappa)),
        })

    told = told.where("batch is not null").select("batch", "segment", "known", "one", "two")
    batches = batches.select("batch", "words", "which", "lengths", "rows")
    return batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(answer, "row long, n_known long, base_score double, score double")


def scored(docs: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """docs (text, learn: whether it is learned from, and others): the others, n_tokens, n_known, train_tokens, base_score, score."""
    others = [c for c in docs.columns if c not in ("text", "learn")]
    both = batched(docs.withColumn("row", F.monotonically_increasing_id()))  # stays with the row, as what is read is written at once
    batches = both.where("batch is not null")
    size = batches.agg(F.sum("size")).first()[0] or 0
    bits = max(LEAST_SEGMENTS, size // SEGMENT_BYTES + 1).bit_length()
    told = looked_up(batches, bits)
    n, v = (x or 0 for x in told.where("batch is null").agg(F.sum("total"), F.sum("distinct")).first())
    done = answers(batches, told, bits, n, v, kappa)
    # Neither side is ever broadcast, whatever Spark takes its size for.
    seen = both.where("batch is null").select(*others, "n_tokens", "row").join(done.hint("merge"), "row")
    return seen.select(*others, "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, training: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """docs (text and others), by what training (text) says: the others, n_tokens, n_known, train_tokens, base_score, score."""
    both = docs.withColumn("learn", F.lit(False)).unionByName(training.select("text").withColumn("learn", F.lit(True)), allowMissingColumns=True)
    return scored(both.withColumn("_learn", F.col("learn")), kappa).where("not _learn").drop("_learn")


def score_documents(docs: DataFrame, by: int = 7, fold: int = 2) -> DataFrame:
    """docs (doc_id, text): doc_id, held_out (its fold, not learned from), and the scores."""
    held_out = bucket3("doc_id", by) == fold
    return scored(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text", F.coalesce(~held_out, F.lit(False)).alias("learn")))
