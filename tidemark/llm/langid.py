"""Language identification by error-correcting output codes.

Every language has a codeword. For each of its bits a binary classifier over
hashed byte n-grams tells the languages with a one from those with a zero: its
weights are log ratios of the two sides' n-gram distributions, counted over all
training documents. A text's bit scores are average log odds a n-gram, so
length doesn't matter. Decoding weighs each bit's logistic loss by how well
that bit's classifier separates the language in training, and takes the
nearest codeword; the lead over the runner-up flags ambiguity. A text whose
nearest codeword is no nearer than it would be to an undecided text (all bits
zero, a loss of ln 2) is in none of the learned languages: the stage rejects it.

Odd input: a text that is null or has no letter is `und` with score 0, as is
everything if no row is labelled; rows with a null id or label aren't learned
from and count as not held out; repeated rows each get a row; label and id are
never inputs of a prediction. The driver holds MOST languages x FEATURES numbers
at most; more labels than that are an error, as they are no languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm.common import as_bytes, bucket3, let_go, small_batches

#: Hashed n-gram features (a power of two), and bytes that are counted at once.
FEATURES, PIECE = 1 << 13, 1 << 19
#: How steep the loss is in average log odds, and how far the losses' differences stretch to probabilities.
STEEP, SHARP = 10.0, 4.0
#: Languages at most.
MOST = 512
#: The loss of an undecided text.
UNDECIDED = float(np.log(2))
#: A score lead under this flags the prediction as ambiguous.
LEAD = 0.2

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 0x20
_FOLD[0x30:0x3A] = 0x30
_FOLD[:0x21] = 0x20


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts (texts, FEATURES) of hashed byte bigrams and trigrams."""
    out = np.zeros((len(texts), FEATURES), np.float64)
    pieces = [(i, t[s : s + PIECE + 2]) for i, t in enumerate(texts) for s in range(0, max(len(t) - 2, 1), PIECE)]
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and end - at < 64 and (size == 0 or size + len(pieces[end][1]) <= PIECE):
            size += len(pieces[end][1])
            end += 1
        own = pieces[at:end]
        a = _FOLD[np.frombuffer(b"".join(p for _, p in own), np.uint8)]
        row = np.repeat(np.arange(len(own)), [len(p) for _, p in own])
        counts = np.zeros(len(own) * FEATURES, np.int64)
        for n in (2, 3):
            if len(a) < n:
                continue
            h = a[: len(a) - n + 1].copy()
            for k in range(1, n):
                h = h << 8 | a[k : len(a) - n + 1 + k]
            h = (h + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - 13)
            first = row[: len(h)]
            whole = first == row[n - 1 :]
            counts += np.bincount(first[whole] * FEATURES + h[whole], minlength=len(counts))
        np.add.at(out, [i for i, _ in own], counts.reshape(len(own), FEATURES))
        at = end
    return out


def codebook(n: int) -> np.ndarray:
    """n codewords of -1 and 1. Up to seven: all ways to part them in two; beyond, the best spread of some seeded draws."""
    if n <= 7:
        bits = [[1 if i == 0 or k >> (i - 1) & 1 else -1 for i in range(n)] for k in range(2 ** max(n - 1, 0) - 1)]
        return np.array(bits, np.float64).reshape(-1, n).T
    best, spread, rng = None, -1, np.random.default_rng(7)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        while len(same := np.flatnonzero(np.abs(code.sum(0)) == n)):  # a bit that parts nothing is drawn anew
            code[:, same] = rng.choice([-1.0, 1.0], (n, len(same)))
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]).min()
        if apart > spread:
            best, spread = code, apart
    return best


class Codes:
    """The trained classifiers; counts: languages x features."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codebook(len(languages))
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * FEATURES)
        ones = self.code.T > 0
        side = lambda m: np.log((m @ share + 1e-12) / np.maximum(m.sum(1, keepdims=True), 1))
        self.weights = (side(ones.astype(float)) - side((~ones).astype(float))).T  # features x bits
        apart = np.maximum(share @ self.weights * self.code, 1e-6)  # how sure each bit is of each language
        self.trust = apart / np.maximum(apart.sum(1, keepdims=True), 1e-12)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword's place, its score, its lead over the next one's, and its loss."""
        if len(self.languages) == 1:
            return np.zeros(len(counts), int), np.ones(len(counts)), np.ones(len(counts)), np.zeros(len(counts))
        bits = counts @ self.weights / np.maximum(counts.sum(1, keepdims=True), 1)
        loss = np.einsum("lb,nlb->nl", self.trust, np.logaddexp(0, -STEEP * bits[:, None, :] * self.code[None]))
        p = np.exp(-SHARP * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        two = np.sort(p, 1)[:, -2:]
        return p.argmax(1), two[:, 1], two[:, 1] - two[:, 0], loss.min(1)


def _has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def train(labelled: DataFrame) -> Codes | None:
    """From all rows of labelled (text, lang): n-gram counts a language, summed over the tasks. What the driver gets is languages x features numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = as_bytes(batch, "text"), batch.column("lang").to_pylist()
            for s in range(0, len(texts), 64):
                for lang, row in zip(langs[s : s + 64], ngram_counts(texts[s : s + 64]), strict=True):
                    total.setdefault(lang, np.zeros(FEATURES, np.int64))
                    total[lang] += row.astype(np.int64)
        for lang, row in total.items():
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(row[seen], pa.int64())], names=["lang", "feature", "n"])

    labelled = small_batches(labelled).where("text is not null and lang is not null").select("text", "lang")
    rows = labelled.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).limit(MOST * FEATURES + 1).toPandas()
    if rows.empty:
        return None
    if rows["lang"].nunique() > MOST:
        raise ValueError(f"more than {MOST} labels: these are no languages")
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), FEATURES))
    counts[np.searchsorted(languages, rows["lang"]), rows["feature"]] = rows["n"]
    return Codes(languages, counts)


NOTHING = {"lang_pred": "und", "score": 0.0, "lead": 0.0}


def predict(docs: DataFrame, codes: Codes | None, column: str = "said") -> DataFrame:
    """docs with one more column: a struct of lang_pred, score, lead, and rejected (no letter, or no codeword is nearer than to an undecided text; without codes, what has a letter isn't)."""
    given = docs.sparkSession.sparkContext.broadcast(codes)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("lead", pa.float64()), ("rejected", pa.bool_())])

    @arrow_udf("lang_pred string, score double, lead double, rejected boolean")
    def said(texts: pa.Array) -> pa.Array:
        codes, out = given.value, []
        texts = texts.to_pylist()
        for s in range(0, len(texts), 64):
            some = texts[s : s + 64]
            if codes is None:
                out += [NOTHING | {"rejected": not _has_letter(t)} for t in some]
                continue
            for t, which, score, lead, loss in zip(some, *codes.decode(ngram_counts([(t or "").encode() for t in some])), strict=True):
                out.append({"lang_pred": codes.languages[which], "score": float(score), "lead": float(lead), "rejected": bool(loss >= UNDECIDED)} if _has_letter(t) else NOTHING | {"rejected": True})
        return pa.array(out, kind)

    return small_batches(docs).withColumn(column, said("text"))


def fold_of(docs: DataFrame, by: int = 3) -> DataFrame:
    """docs' fold: crc32 of the id as text, modulo by."""
    return docs.withColumn("fold", bucket3("doc_id", by))


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out (fold 1 of 3, not learned from), lang_pred, score, ambiguous."""
    docs = fold_of(docs.select("doc_id", "text", "lang"))
    codes = train(docs.where("fold <> 1"))
    said = predict(docs.select("doc_id", "fold", "text"), codes)
    return said.select("doc_id", F.coalesce(F.col("fold") == 1, F.lit(False)).alias("held_out"), "said.lang_pred", "said.score", (F.col("said.lead") < LEAD).alias("ambiguous"))


def in_a_language(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """docs with all their columns, less those that the decoder rejects (and those in other languages than the wanted ones, if any are named). If no row is labelled, those with a letter stay."""
    own = "_".join(["said", *docs.columns])  # longer than any of them
    codes = train(fold_of(docs.select("doc_id", "text", "lang")).where("fold <> 1"))
    kept = predict(docs, codes, own).where(~F.col(f"`{own}`.rejected"))
    if wanted is not None and codes is not None:
        kept = kept.where(F.col(f"`{own}`.lang_pred").isin(wanted))
    return kept.select(*docs.columns)
