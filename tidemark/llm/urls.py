"""URL filters: rules first, then the likelihood ratio of two character models.

The longest rule that fits a URL's host and path decides. Every other URL is
judged by two smoothed variable-order Markov models over its bytes, one of
accepted and one of rejected URLs: a byte's probability under the longest
context falls back on shorter ones as evidence thins. The mean log-likelihood
difference a byte is held against a threshold calibrated on a fold that the
models haven't seen: the least that lets at most FALSE_REJECT of its accepted
URLs be blocked. No URL is judged by models that have counted it: the ids' hash
parts the URLs in two, and each half's models judge the other half. Labels are
an input; `weak_labels` makes some from rules and host words where there are
none. Counts are hashed into tables of fixed size, so the models' size doesn't
follow the data; counting covers every URL.

Odd input: a null URL, or one without `://`, has an empty host and path, no
rule, and is judged by what text it has (none: allow); a null id is in
the first half and never in the calibration fold; repeated rows each get a row; without rejected or
accepted training URLs the method allows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm.common import as_bytes, bucket3

#: Fixed values: (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: Parts of host names that mark a URL as rejected where no labels are given.
SEEDS = ["casino", "gambl", "malware", "phish", "pills", "porn", "spam", "viagra", "warez", "xxx"]

#: Longest context, hash bits of each order's table, weight of the shorter context.
ORDER, BITS, BACK = 5, 16, 4.0
FALSE_REJECT = 0.01
#: Bins of the calibration histogram, over differences from -SPAN to SPAN.
BINS, SPAN = 2000, 10.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of, start, said in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of the URLs laid end to end: its URL, and for each order the table places of context with byte, and of context."""
    pad = b"\x01" * ORDER
    a = np.frombuffer(b"".join(pad + u + b"\x02" for u in urls), np.uint8).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(u) + 1 for u in urls])
    which = np.repeat(np.arange(len(urls)), lengths)
    at = np.arange(len(which)) + ORDER * (which + 1)
    own, base = a[at], np.zeros(len(at), np.uint64)
    gram, context = np.empty((ORDER + 1, len(at)), np.int64), np.empty((ORDER + 1, len(at)), np.int64)
    odd = np.uint64(0x9E3779B97F4A7C15)

    def place(h: np.ndarray, k: int) -> np.ndarray:
        h = (h + np.uint64(k)) * odd
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)

    for k in range(ORDER + 1):
        if k:
            base = base * np.uint64(1_000_003) + a[at - k]
        context[k], gram[k] = place(base, k), place((base + own * np.uint64(0x100000001B3)) * odd + own, k)
    return which, gram, context


class Models:
    """Count tables (accepted, rejected) x (with byte, context) x order x place."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.threshold = counts, np.inf
        self.both = bool((counts[:, 1, 0].sum(-1) > 0).all())

    def ratio(self, urls: list[bytes]) -> np.ndarray:
        """Mean log-likelihood difference a byte, rejected less accepted."""
        if not urls:
            return np.zeros(0)
        which, gram, context = _grams(urls)
        log = []
        for own in self.counts:
            p = np.full(len(which), 1 / 257)
            for k in range(ORDER + 1):
                p = (own[0, k][gram[k]] + BACK * p) / (own[1, k][context[k]] + BACK)
            log.append(np.log(np.minimum(p, 1.0)))
        return np.bincount(which, log[1] - log[0], len(urls)) / np.bincount(which, minlength=len(urls))


def _some(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    urls = as_bytes(batch, "url")
    for s in range(0, len(urls), 2000):
        yield s, urls[s : s + 2000]


def train(labelled: DataFrame) -> Models:
    """labelled: url, rejected (boolean), calibrate (boolean)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, ORDER + 1, 1 << BITS), np.int64)
        for batch in batches:
            rejected = np.array(batch.column("rejected").to_pylist(), bool)
            for s, urls in _some(batch):
                which, gram, context = _grams(urls)
                side = rejected[s : s + 2000][which]
                for c in (0, 1):
                    for k in range(ORDER + 1):
                        total[c, 0, k] += np.bincount(gram[k][side == c], minlength=1 << BITS)
                        total[c, 1, k] += np.bincount(context[k][side == c], minlength=1 << BITS)
        flat = total.ravel()
        seen = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(flat[seen], pa.int64())], names=["place", "n"])

    rows = labelled.where("not calibrate").select("url", "rejected").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(2 * 2 * (ORDER + 1) << BITS, np.int64)
    counts[rows["place"].to_numpy(int)] = rows["n"].to_numpy(np.int64)
    models = Models(counts.reshape(2, 2, ORDER + 1, 1 << BITS))
    if models.both:
        accepted = with_ratio(labelled.where("calibrate and not rejected").select("url"), models)
        bins = F.floor((F.greatest(F.least("ratio", F.lit(SPAN)), F.lit(-SPAN)) + SPAN) * (BINS / (2 * SPAN))).cast("int")
        held = np.zeros(BINS + 1, np.int64)
        for r in accepted.groupBy(bins.alias("bin")).count().collect():
            held[r["bin"]] = r["count"]
        above = held[::-1].cumsum()[::-1]  # accepted URLs in this bin or higher
        low = np.flatnonzero(above <= FALSE_REJECT * held.sum())
        models.threshold = max(0.0, low[0] * (2 * SPAN / BINS) - SPAN) if len(low) else np.inf
    return models


def with_ratio(pages: DataFrame, models: Models) -> DataFrame:
    """pages with one more column, ratio."""
    given = pages.sparkSession.sparkContext.broadcast(models)

    @arrow_udf("double")
    def ratio(urls: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([urls], names=["url"])
        return pa.array(np.concatenate([np.zeros(0), *[given.value.ratio(u) for _, u in _some(batch)]]))

    return pages.withColumn("ratio", ratio("url"))


def weak_labels(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Labels where there are none: pages (page_id, url) -> page_id, url, rejected: what a rule says of it, else whether its host has a word of SEEDS."""
    host, path = parts(F.col("url"))
    verdict = ruled(host, path, rules)[1]
    return pages.select("page_id", "url", F.coalesce(verdict == "block", host.rlike("|".join(SEEDS))).alias("rejected"))


def halves(page_id: str) -> Column:
    """0 or 1 by the id's hash; 0 for a null id."""
    return F.pmod(F.xxhash64(F.lit("half"), page_id), F.lit(2)) * F.col(page_id).isNotNull().cast("int")


def with_verdict(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """pages (page_id, url, ...) with ratio and method (allow or block): each half by the models of the other half's labelled URLs (page_id, url, rejected)."""
    labelled = labelled.where("url is not null and rejected is not null").select("url", "rejected", halves("page_id").alias("half"), F.coalesce(bucket3("page_id", 5) == 0, F.lit(False)).alias("calibrate"))
    models = [train(labelled.where(F.col("half") != side)) for side in (0, 1)]
    given = pages.sparkSession.sparkContext.broadcast(models)

    @arrow_udf("double")
    def ratio(urls: pa.Array, half: pa.Array) -> pa.Array:
        batch, out = pa.RecordBatch.from_arrays([urls], names=["url"]), np.zeros(len(urls))
        side = half.to_numpy()
        for s, some in _some(batch):
            for h in (0, 1):
                at = np.flatnonzero(side[s : s + len(some)] == h)
                out[s + at] = given.value[h].ratio([some[i] for i in at])
        return pa.array(out)

    threshold = F.when(halves("page_id") == 0, F.lit(float(models[0].threshold))).otherwise(F.lit(float(models[1].threshold)))
    return pages.withColumn("ratio", ratio("url", halves("page_id").cast("int"))).withColumn("method", F.when(F.col("ratio") > threshold, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, ratio (null where a rule decides). labelled (page_id, url, rejected): what the method learns from; without it, weak labels."""
    host, path = parts(F.col("url"))
    pages = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    pages = pages.select("*", rule.alias("rule"), verdict.alias("ruled"))
    said = with_verdict(pages, weak_labels(pages, rules) if labelled is None else labelled)
    return said.select("page_id", "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict"), F.when(F.col("rule").isNull(), F.col("ratio")).alias("ratio"))
