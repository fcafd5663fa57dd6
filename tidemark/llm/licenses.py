"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are word shingles of five; templates of fewer than six words
(names, tags) are met by shingles of three, so that they have to stand there as
they are, and such a match within a longer one of the same license is left out.
For a template of n shingles the
text is cut into windows of 2s shingles every s, s being the least width on a
scale of half octaves that lets a window hold the whole template. A band is
one of BANDS MinHash values (one row a band). A window that holds 0.8 of a
template has a Jaccard similarity of 0.8 / 3.2 = 0.25 at least, as 2s is at
most 3n for all but the shortest templates (and more for those), so it shares
a band with a probability of 1 - 0.75 ** 32 > 0.9998. The retrieved pairs are
verified: the template's distinct shingles in the text around the window,
within the template's own length and a quarter more, over all its shingles.
Versions are told apart there: each number of the template must stand in one of
the shingles found. Templates are a table (license, text).

Words: A-Z lower-cased, runs of digits, letters and non-ASCII characters. Odd
input: a null or empty text, or one of fewer than three words, has no matches;
repeated rows each give their matches; equal matches of neighbouring windows
are one; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, small_batches
from tidemark.llm.decontam import words

SHINGLE, CONTAINED, BANDS = 5, 0.8, 32
#: Words of a shingle of short templates, and of the shortest that isn't short.
SHORT, WHOLE = 3, 6
#: Words that are windowed at once; a longer text is taken whole.
TOGETHER = 200_000
REMEMBERED = 400_000

#: Bytes of templates at most: every worker holds all of them.
TEMPLATE_BYTES = 4 << 20


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_memo = _Hashes()


def hashes(text_words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, text_words), np.uint64, len(text_words))


def shingled(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` words, given the words' hashes in order."""
    n = max(len(w) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
        h ^= h >> np.uint64(29)
    return h


def scale(n: int) -> int:
    """The least s in 1, 2, 3, 4, 6, 8, 12, ... whose windows of 2s every s hold any n shingles in a row."""
    steps = sorted({1 << i for i in range(24)} | {3 << i for i in range(24)})
    return next(s for s in steps if s + 1 >= n)


_ODD = np.random.default_rng(5).integers(1, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _banded(h: np.ndarray, k: int) -> np.ndarray:
    return (h * _ODD[k] >> np.uint64(32)).astype(np.uint32)


class Templates:
    """Templates that are met by shingles of one size."""

    def __init__(self, templates: list[tuple[str, str]], size: int = SHINGLE):
        self.size, self.sets, self.lengths = size, [], []
        self.numbers: list[list[set[int]]] = []  # of each template: for each of its numbers, the places in its set of the shingles around it
        self.bands: dict[int, list[dict[int, list[int]]]] = {}  # by scale, then by band: a MinHash value's templates
        for i, (_, text) in enumerate(templates):
            own = words(text.encode())
            h = shingled(hashes(own), size)
            if not len(h):
                raise ValueError(f"a template has fewer than {size} words")
            self.sets.append(np.unique(h))
            around = lambda p, h=h, i=i: set(np.searchsorted(self.sets[i], h[max(p - size + 1, 0) : p + 1]).tolist())
            self.numbers.append([around(p) for p, w in enumerate(own) if w.isdigit()])
            self.lengths.append(len(h))
            bands = self.bands.setdefault(scale(len(h)), [{} for _ in range(BANDS)])
            for k in range(BANDS):
                bands[k].setdefault(int(_banded(h, k).min()), []).append(i)
        self.perhaps = {s: [self._table(b) for b in bands] for s, bands in self.bands.items()}

    @staticmethod
    def _table(values: dict[int, list[int]]) -> np.ndarray:
        out = np.zeros(1 << 16, bool)
        out[np.array(list(values), np.uint32) & 0xFFFF] = True
        return out

    def candidates(self, h: np.ndarray, crossing: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, width) of windows that share a band; shingles that cross texts never are a minimum."""
        found: set[tuple[int, int, int]] = set()
        for k in range(BANDS):
            v = _banded(h, k)
            v[crossing] = 0xFFFFFFFF
            for s, bands in self.bands.items():
                low = v if s == 1 else np.minimum.reduceat(v, np.arange(0, len(v), s))
                low = np.minimum(low, np.append(low[1:], np.uint32(0xFFFFFFFF)))
                for at in np.flatnonzero(self.perhaps[s][k][low & 0xFFFF]).tolist():
                    found.update((t, at * s, 2 * s) for t in bands[k].get(int(low[at]), ()))
        return found

    def verify(self, t: int, h: np.ndarray, lo: int, hi: int) -> tuple[float, int, int] | None:
        """The best containment of template t in h[lo:hi], within its length and a quarter more, with first and last shingle."""
        own, n = self.sets[t], self.lengths[t]
        at = np.searchsorted(own, h[lo:hi])
        at[at == len(own)] = 0
        places = np.flatnonzero(own[at] == h[lo:hi])
        best, begin, last = None, 0, {}
        reach = n + n // 4
        for end, p in enumerate(places.tolist()):
            last[int(at[p])] = p
            while places[begin] <= p - reach:
                q = int(places[begin])
                if last.get(int(at[q])) == q:
                    del last[int(at[q])]
                begin += 1
            share = len(last) / len(own)
            if (best is None or share > best[0]) and share >= CONTAINED and all(last.keys() & around for around in self.numbers[t]):
                best = (share, lo + min(last.values()), lo + p)
        return best

    def scan(self, w: np.ndarray, n_words: np.ndarray) -> list[list[tuple[int, float, int, int]]]:
        """Words' hashes of texts, one after another, and how many each text has -> of each text: (template, containment, first word, end word), in order."""
        h = shingled(w, self.size)
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in n_words]
        if not len(h):
            return out
        begins = np.concatenate([[0], np.cumsum(n_words)])
        of = np.repeat(np.arange(len(n_words)), n_words)
        crossing = of[: len(h)] != of[self.size - 1 :]
        seen: set[tuple[int, int, int]] = set()
        for t, at, width in sorted(self.candidates(h, crossing)):
            for d in sorted({int(of[at]), int(of[min(at + width, len(of) - 1)])} | set(of[at : at + width].tolist())):
                lo, hi = max(int(begins[d]), at - self.lengths[t]), min(int(begins[d + 1]) - self.size + 1, at + width + self.lengths[t])
                if hi > lo and (m := self.verify(t, h, lo, hi)) and (t, m[1], m[2]) not in seen:
                    seen.add((t, m[1], m[2]))
                    out[d].append((t, m[0], m[1] - int(begins[d]), m[2] - int(begins[d]) + self.size))
        return [sorted(x) for x in out]


class Wordings:
    """All templates, in their order: short ones by short shingles, giving way to longer matches of their license."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        self.short = [len(words(text.encode())) < WHOLE for _, text in templates]
        self.parts = [
            (own, Templates([templates[i] for i in own], size))
            for is_short, size in ((False, SHINGLE), (True, SHORT))
            if (own := [i for i, x in enumerate(self.short) if x == is_short])
        ]

    def scan(self, texts: list[list[bytes]]) -> list[list[tuple[int, float, int, int]]]:
        """Of each text: (template, containment, first word, end word), in order."""
        n_words = np.array([len(t) for t in texts], np.int64)
        w = np.fromiter((_memo[x] for t in texts for x in t), np.uint64, int(n_words.sum()))
        found: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        for own, part in self.parts:
            for matches, of_text in zip(found, part.scan(w, n_words), strict=True):
                matches += [(own[t], *rest) for t, *rest in of_text]
        return [sorted(self._longest(matches)) for matches in found]

    def _longest(self, matches: list[tuple[int, float, int, int]]) -> list[tuple[int, float, int, int]]:
        """Matches less the short ones that lie within longer ones of their license. Spans are taken by their beginnings: those that begin before it, and how far any of them goes."""
        if not any(self.short[t] for t, *_ in matches):
            return matches
        kept, reach = [], {}  # license: how far what began so far goes
        for t, share, first, end in sorted(matches, key=lambda m: (m[2], -m[3])):
            name = self.names[t]
            far, longest_here = reach.get(name, (-1, None))
            within = far >= end and (far > end or longest_here != (first, end))
            if not (self.short[t] and within):
                kept.append((t, share, first, end))
            if end > far:
                reach[name] = end, (first, end)
        return kept


MATCHES = "license string, template int, containment double, first_word int, end_word int"


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """docs (doc_id, text), templates (license, text) -> a row for each match: doc_id, license, template (its place in the order of license and text), containment, first_word, end_word."""
    rows = templates.select("license", "text")
    if (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > TEMPLATE_BYTES:
        raise ValueError("the templates are too long to be held by every worker")
    given = docs.sparkSession.sparkContext.broadcast(sorted(map(tuple, rows.collect())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Wordings(given.value)
        for batch in batches:
            texts, rows, at = as_bytes(batch, "text"), [], 0
            while at < len(texts):
                some, size = [], 0
                while at + len(some) < len(texts) and size < TOGETHER:
                    some.append(words(texts[at + len(some)]))
                    size += len(some[-1])
                rows += [(at + i, known.names[t], t, c, s, e) for i, found in enumerate(known.scan(some)) for t, c, s, e in found]
                at += len(some)
            place, name, template, share, first, end = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(place, pa.int32())), pa.array(name, pa.string()), pa.array(template, pa.int32()), pa.array(share, pa.float64()), pa.array(first, pa.int32()), pa.array(end, pa.int32())],
                names=["doc_id", "license", "template", "containment", "first_word", "end_word"],
            )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {MATCHES}")
