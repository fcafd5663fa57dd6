"""Each operator against a brute-force version, an exact round trip, held-out accuracy or its SQL; odd input for all."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import plain_pii
from tests.oracle import differences
from tidemark.llm import bpe, chat, decontam, dedup, langid, license_texts, licenses, lm, pii, queries, simhash, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, None, "en", None, None),
    (2, "", None, "web", 0),
    (3, " \t\n ", "fr", "web", 4),
    (4, "une phrase simple, mais entière", "fr", "web", 10),
    (4, "une phrase simple, mais entière", "fr", "web", 10),
    (None, "a row without an id", "en", "web", 3),
    (6, "a row  without\tan id", "en", None, 3),
    (7, "ab" * 30_000, None, None, None),
    (8, "word " * 20_000, "en", "web", 5),
    (9, "\u00e9\u4e2d\U0001f600\x00<|endoftext|>", "xx", "web", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def fold(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def with_clashes(df):
    """Columns with names that operators might use themselves."""
    for c in ("fp", "row", "said", "words", "digest", "cell", "ids", "kinds", "fold", "shard", "_found", "_gaps", "bucket"):
        df = df.withColumn(c, F.lit("x"))
    return df


# BPE


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected_bpe(enc, rows):
    out = []
    for doc_id, text in rows:
        ids = enc.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_bpe_equals_tiktoken(spark, documents, odd, reference_encoding):
    for docs in (documents, odd):
        got = [tuple(r) for r in queries.bpe_digests(docs).collect()]
        assert sorted(got, key=str) == expected_bpe(reference_encoding, [(r["doc_id"], r["text"]) for r in docs.collect()])
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    apart = bpe.decode(bpe.encode(odd, ranks, public_tokenizers.PATTERN), ranks)
    assert sorted(map(tuple, apart.collect()), key=str) == sorted(map(tuple, bpe.round_trip(odd, ranks, public_tokenizers.PATTERN).collect()), key=str)


@pytest.mark.parametrize("bounds", [{}, {"SPLIT": 40, "TOGETHER": 8, "REMEMBERED": 5, "LONGEST": 4}])
def test_bpe_on_random_pieces(reference_encoding, monkeypatch, bounds):
    for name, bound in bounds.items():
        monkeypatch.setattr(bpe, name, bound)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ours, tokens = bpe.Bpe(ranks, public_tokenizers.PATTERN), bpe.Tokens(ranks)
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list("abcdehilmnorst  \n1é中😀"), rng.integers(1, 200)))
        assert ours.encode(text) == reference_encoding.encode_ordinary(text)
        assert tokens.decode(ours.packed([text])[0]) == text.encode()


# language ID


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    asked = [r for r in rows if r["held_out"] and r["lang"] and len(r["text"] or "") > 40]
    assert np.mean([r["lang_pred"] == r["lang"] for r in asked]) > 0.97
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_language_odd_input(spark, odd):
    said = {r["doc_id"]: r for r in langid.identify(with_clashes(odd)).collect()}
    assert [said[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and said[1]["score"] == 0
    assert said[4]["lang_pred"] in {"fr", "en", "xx"} and said[None]["held_out"] is False
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_stage_without_labels(spark, odd):
    """Nothing to learn from: what has a letter stays."""
    kept = langid.in_a_language(odd.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 4, 6, 7, 8, 9]


def test_language_stage_rejects_by_the_decoder(spark):
    """Texts that no learned language is like go (another script, code, a mixture); every document of a learned language stays; so do wanted languages alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = spark.createDataFrame([(10_000_000 + i, x * 30, None, None, None) for i, x in enumerate(["Привет мир ", "def f(x): return x+1\n", "La la the und der les "])], DOCS)
    both = docs.unionByName(noise)
    kept = {r["doc_id"] for r in langid.in_a_language(both).select("doc_id").collect()}
    rows = both.collect()
    train = [r for r in rows if r["text"] and r["lang"] and fold(r["doc_id"], 3) != 1]
    names = sorted({r["lang"] for r in train})
    counts = np.zeros((len(names), langid.FEATURES))
    for r in train:
        counts[names.index(r["lang"])] += langid.ngram_counts([r["text"].encode()])[0]
    codes = langid.Codes(names, counts)
    want = {r["doc_id"] for r in rows if r["text"] and any(map(str.isalpha, r["text"])) and codes.decode(langid.ngram_counts([r["text"].encode()]))[3][0] < np.log(2)}
    assert kept == want and not kept & {10_000_000, 10_000_001, 10_000_002}
    assert len(kept) >= 0.995 * sum(any(map(str.isalpha, r["text"] or "")) for r in docs.collect())
    only = {r["lang"] for r in langid.in_a_language(docs, ["fr"]).where("lang is not null and length(text) > 200").collect()}
    assert "fr" in only and len(only) == 1


def test_codewords_differ():
    for n in (1, 2, 5, 7, 8, 12, 100):
        code = langid.codebook(n)
        assert code.shape[0] == n and len(np.unique(code, axis=0)) == n and (n < 2 or (np.abs(code.sum(0)) < n).all())


# URL filters


def expected_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_rules(spark):
    odd = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTPS://A.Example.COM/en/7?x#y"), (5, "http://xexample.com/en/7"), (6, "http://com/en/"), (7, "http://a.org?/es/"), (8, "http://é.net/de/8"), (9, "http://b.example.net/de/8\n/x"), (9, "http://b.example.net/de/8\n/x"), (None, "http://ok.org/es/1"), (11, "http://my-casino-spam.biz/x")]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    got = urls.judge(with_clashes(pages)).collect()
    asked = {(r["page_id"]): r["url"] for r in pages.collect()}
    assert len(got) == pages.count()
    for r in got:
        host, path, rule, verdict = expected_url(asked[r["page_id"]])
        if r["page_id"] not in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11):  # ids that the table has, too
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block")
    for r in urls.judge(spark.createDataFrame(odd, "page_id long, url string")).collect():
        host, path, rule, verdict = expected_url(dict(odd)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert verdict is None or r["verdict"] == verdict
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_verdicts_are_those_of_the_other_half(spark):
    """Labels as input: bad paths are told from good ones, half by half, and each ratio is that of models of the other half's URLs."""
    rng = np.random.default_rng(4)
    word = lambda bad: "".join(rng.choice(list("qxzjk" if bad else "aeionrst"), 6))
    rows = [(i, f"http://site{i % 9}.info/{word(i % 4 == 0)}/{word(i % 4 == 0)}", i % 4 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, rejected boolean")
    got = {r["page_id"]: r for r in urls.judge(df, labelled=df).collect()}
    wrong = [i for i, _, bad in rows if (got[i]["verdict"] == "block") != bad]
    assert len(wrong) < 0.03 * len(rows)
    half = {r["page_id"]: r["h"] for r in df.select("page_id", urls.halves("page_id").alias("h")).collect()}
    counts = np.zeros((2, 2, urls.ORDER + 1, 1 << urls.BITS))
    for i, u, bad in rows:
        if half[i] == 1 and fold(i, 5) != 0:
            _, gram, context = urls._grams([u.encode()])
            for k in range(urls.ORDER + 1):
                np.add.at(counts[int(bad), 0, k], gram[k], 1)
                np.add.at(counts[int(bad), 1, k], context[k], 1)
    models = urls.Models(counts)
    some = [(i, u) for i, u, _ in rows if half[i] == 0][:200]
    assert [got[i]["ratio"] for i, _ in some] == pytest.approx(models.ratio([u.encode() for _, u in some]), abs=1e-9)


# language model


def test_lm_counts_and_base(spark, documents, odd):
    for docs in (documents, odd):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None]
        train = Counter(w for i, t in rows if i is not None and fold(i, 7) != 2 for w in tokens(t))
        n, v = sum(train.values()), len(train)
        got = lm.score_documents(with_clashes(docs)).collect()
        assert len(got) == len(rows)
        want = {i: (len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), sum(log10((train[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}
        for r in got:
            assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2] and r["base_score"] == pytest.approx(want[r["doc_id"]][2], rel=1e-9, abs=1e-6)
        assert {r["train_tokens"] for r in got} == {n}


def test_lm_beats_base_on_held_out(spark):
    rows = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert all(r["score"] <= 1e-9 for r in rows)


def test_lm_empty(spark, odd):
    assert lm.score_documents(odd.limit(0)).count() == 0


def test_filter_reads_levels_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 38, 5000, dtype=np.uint64))  # 64 segments
    n = rng.integers(1, 2000, len(keys))
    of = (keys >> np.uint64(32)).astype(int)
    f = lm.Filter.of([lm.Filter.holding(keys[of == i] & np.uint64(0xFFFFFFFF), n[of == i], lm.ENTRY_BITS).bits.tobytes() if i else b"" for i in range(64)])
    keys, n = keys[of > 0], n[of > 0]
    got, q = f.levels(keys), lm.level(n)
    assert (got >= q).all() and (got > q).mean() < 0.05 and (lm.low(q) <= n).all() and (n <= lm.high(q)).all()
    others = rng.integers(0, 1 << 38, 5000, dtype=np.uint64)
    assert (f.levels(others) > 0).mean() < 0.05 and not f.levels(others & np.uint64(0xFFFFFFFF)).any()


def test_probing_a_full_filter_ends():
    f = lm.Filter.of([b"\xff" * 8])
    assert f.levels(np.arange(5, dtype=np.uint64)).tolist() == [lm.TOP] * 5


def lm_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) + [None]


def exact_lm(rows):
    """P(word | history) of the whole training text from exact counts, at the filter's levels; the vocabulary; the counts after each history."""
    one, two = Counter(), Counter()
    for i, t in rows:
        if i is not None and fold(i, 7) != 2:
            one.update(lm_tokens(t))
            two.update(zip([None, *lm_tokens(t)], lm_tokens(t)))
    n, v = sum(one.values()), len(one)
    ends = {c: (float(lm.low(q)), float(lm.high(q))) for c in {0, *one.values(), *two.values()} for q in [lm.level(np.array(c))]}
    return lambda h, w: (min(ends[two[h, w]][0], ends[one[w]][0], ends[one[h]][0]) + lm.KAPPA * (ends[one[w]][0] + 1) / (n + v + 1)) / (ends[one[h]][1] + lm.KAPPA), one, two


def test_lm_probabilities_are_normalised(documents):
    """After any history the words of the vocabulary and one unknown sum to no more than 1, and to most of it."""
    p, one, _ = exact_lm([(r["doc_id"], r["text"] or "") for r in documents.collect()])
    for h in [None, "never seen", *[w for w, _ in one.most_common(5)], *list(one)[-5:]]:
        total = sum(p(h, w) for w in [*one, "never seen"])
        assert 0.4 < total <= 1 + 1e-9


def test_lm_scores_hold_every_bigram(spark, documents, odd, monkeypatch):
    """Broadcast or joined, with more segments or fewer: the scores of exact counts, at the filter's levels."""
    monkeypatch.setattr(lm, "ENTRY_BITS", 40)  # next to no false positives
    for docs, settings in ((documents, [{}, {"BROADCAST": 0}, {"BROADCAST": 0, "LEAST_SEGMENTS": 128, "TOGETHER": 20_000}, {"LEAST_SEGMENTS": 128, "TOGETHER": 20_000}]), (odd, [{}, {"BROADCAST": 0}])):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        p = exact_lm(rows)[0]
        want = {i: sum(log10(p(h, w)) for h, w in zip([None, *lm_tokens(t)], lm_tokens(t))) for i, t in rows}
        for setting in settings:
            with monkeypatch.context() as m:
                for name, x in setting.items():
                    m.setattr(lm, name, x)
                assert {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()} == pytest.approx(want, rel=1e-3), setting


def test_lm_holds_nothing_in_the_driver(spark, documents, monkeypatch):
    """No filter and no count is collected, and no side of a join is broadcast, however small Spark takes it for."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(self):
        raise AssertionError("collected")

    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(DataFrame, name, refused)
    done = lm.score_documents(documents)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert done.count() == documents.count() and "Broadcast" not in plan


def test_lm_learns_from_another_table(spark):
    """What is learned from is not scored, and what is scored is not learned from."""
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")
    got = {r["id"]: r for r in lm.score(docs, spark.createDataFrame([("a b a",), (None,)], "text string")).collect()}
    assert {i: (r["n_tokens"], r["n_known"], r["train_tokens"]) for i, r in got.items()} == {1: (3, 3, 5), 2: (2, 1, 5)}
    assert got[1]["base_score"] == pytest.approx(log10(3 / 9) + log10(2 / 9) + log10(3 / 9)) and got[2]["base_score"] == pytest.approx(log10(1 / 9) + log10(3 / 9))


# SimHash


def expected_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_components(fps):
    """fps: (id, fingerprint) -> id -> least id reachable, over all pairs."""
    ids, root = [i for i, _ in fps], {}
    for i in range(len(fps)):
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], f"{fps[i][1]:016x}", least.get(find(i))) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, documents, odd):
    for docs in (documents, odd):
        rows = [(r["doc_id"], expected_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
        got = [tuple(r) for r in simhash.near_duplicates(with_clashes(docs)).collect()]
        assert sorted(got, key=str) == sorted(expected_components(rows), key=str)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_links_of_crowded_cells(spark, monkeypatch):
    """Fingerprints around few centres, with a bound that sends most cells the other way."""
    rng = np.random.default_rng(5)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in rng.integers(0, 1 << 62, 6) for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = expected_components(list(enumerate(sorted(fps))))
    for cell in (1, 4, 64):
        monkeypatch.setattr(simhash, "CELL", cell)
        from tidemark.llm.components import components

        df = spark.createDataFrame([(s,) for s in signed], "fp long")
        roots = {r["node"]: r["root"] for r in components(simhash.near_links(df)).collect()}
        groups = {}
        for f, s in zip(fps, signed):
            groups.setdefault(roots.get(s, f"alone {s}"), set()).add(f)
        theirs = {}
        for _, f, c in want:
            theirs.setdefault(c, set()).add(int(f, 16))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_references_name_a_part():
    """Equal coordinates in a part are equal bits there: the distances to its references tell all its values apart."""
    for width in simhash.WIDTHS:
        refs = simhash.references(width)
        assert len(refs) == 65
        values = np.arange(1 << width, dtype=np.uint64)
        far = np.stack([np.bitwise_count(values ^ np.uint64(r & (1 << width) - 1)).astype(int) - np.bitwise_count(values) for r in refs[1 : width + 1]], 1)
        assert len(np.unique(far, axis=0)) == 1 << width


def test_simhash_links_within_a_quarter(spark):
    """All values of twelve bits: the densest cells there can be, through all three tables."""
    df = spark.range(1 << 12).select(F.col("id").alias("fp"))
    from tidemark.llm.components import components

    assert components(simhash.near_links(df)).select("root").distinct().count() == 1
    apart = spark.createDataFrame([(0b111 << 3 * i) for i in range(21)], "long").toDF("fp")
    assert simhash.near_links(apart).count() == 0


# exact dedup


def test_exact_dedup_equals_its_sql(spark):
    assert not differences(queries.op7_exact_dedup(spark, SF), queries.OP7_SQL, SF)


def test_exact_dedup_odd_input(spark, odd):
    got = dedup.exact_dedup(with_clashes(odd), dedup.halves()).collect()
    assert len(got) == len(ODD)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    assert [r["group_size"] for r in of[1] + of[2]] == [2, 2] and of[2][0]["keep_id"] == 1
    assert sorted(r["kept"] for r in of[4]) == [False, True]
    assert of[None][0]["keep_id"] == 6 and not of[None][0]["kept"] and of[6][0]["group_size"] == 2
    assert dedup.exact_dedup(odd.limit(0), dedup.halves()).count() == 0
    kept = dedup.without_copies(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, None, 6, 7, 8, 9}


def test_a_stored_snapshot_serves_later_batches(spark, documents, tmp_path):
    """Published once, read back, used for a batch that comes later: the decisions of one table that holds both."""
    docs = documents.select("doc_id", "text")
    whole = {tuple(r) for r in dedup.exact_dedup(docs, dedup.halves()).collect()}
    dedup.publish(dedup.digests(docs.where(dedup.halves()), F.lit(True)), f"file://{tmp_path}/snap")
    stored = dedup.opened(spark, f"file://{tmp_path}/snap")
    assert stored.filters.count() == stored.digests.select("bucket").distinct().count()
    built = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(dedup, "snapshot_filters", lambda *a: built.append(a))
        again = {tuple(r)[:3] for r in dedup.exact_dedup(docs, dedup.halves(), stored).collect()}
    assert again == {r[:3] for r in whole} and not built


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        f = dedup.FuseFilter.build(keys)
        assert f.holds(keys).all()
        if n >= 1000:
            assert f.holds(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 0.01 and len(f.table) < 1.5 * n + 2000


# chat


def test_chat_equals_its_sql(spark):
    assert not differences(queries.op8_chat_formatting(spark, SF), queries.OP8_SQL, SF)


@pytest.mark.parametrize("text", ["", "\\", "\\c1;", "<|turn|>", "a</s>[INST]\\\\c", "\\<|end|>\n", "é😀<|im_end|>"])
def test_chat_escapes_are_reversible(text):
    formatted, mask = chat.render_one([("user", text), ("assistant", text)])
    assert chat.unescape(chat.escape(text)) == text and chat._TURN.findall(formatted)[1][1] == chat.escape(text)
    assert [chat.unescape(formatted[s:e]) for s, e in mask] == [text]
    assert formatted.count("</s>") == 0


def test_chat_layouts(spark):
    records = [
        (1, '{"prompt": "p", "response": "r"}'), (2, '{"instruction": "i", "input": "x", "output": "o"}'), (3, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}'),
        (4, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": null}]}'), (5, '{"odd": 1}'), (6, "no json"), (7, None), (8, '{"messages": []}'),
    ]
    rows = chat.canonical_turns(spark.createDataFrame(records, "conv_id long, payload string")).collect()
    of = {}
    for r in rows:
        of.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert of[1] == [("user", "p"), ("assistant", "r")] and [r for r, _ in of[2]] == ["user", "user", "assistant"]
    assert of[3] == [("user", "a"), ("assistant", "b")] and of[4] == [("user", "a"), ("assistant", "")]
    assert [of[k][0] for k in (5, 6, 7, 8)] == [("unmapped", x) for x in ('{"odd": 1}', "no json", "", '{"messages": []}')]


@pytest.mark.parametrize("payload", ['{"messages": ["a"]}', '{"messages": "x"}', '{"messages": 5}', '{"messages": {}}', "[" * 100_000 + "]" * 100_000, '{"a":' * 100_000 + "1" + "}" * 100_000, '{"conv_id": 1, "turn": "x", "role": "user", "text": "t"}', '{"conv_id": 1, "turn": 1e400, "role": "user", "text": "t"}', '{"conv_id": 1, "turn": 99999999999999999999, "role": "user", "text": "t"}', '"x"', "5", "null", '{"\\ud800": 1}'])
def test_chat_takes_malformed_records(payload):
    assert chat.turns_of(payload)[1] == [(0, "unmapped", payload)]


def test_chat_values_that_are_no_text(spark):
    records = [(1, '{"id": 7, "source": "s", "prompt": [1], "response": "\\ud800x"}')]
    assert [(r["role"], r["text"]) for r in chat.canonical_turns(spark.createDataFrame(records, "conv_id long, payload string")).collect()] == [("user", "[1]"), ("assistant", "\ufffdx")]


def test_chat_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (None, 1, "assistant", "x" * 100_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.render(with_clashes(rows)))).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 100_000
    assert chat.digests(chat.read_back(chat.render(rows.limit(0)))).count() == 0


# licenses


def test_license_scan_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = licenses.scan(docs, license_table(spark)).collect()
    every = sorted(license_texts.templates())
    of = [decontam.words(text.encode()) for _, text in every]
    found = {(r["doc_id"], r["template"]) for r in rows if len(of[r["template"]]) > 5}
    sets = {}
    for t, w in enumerate(of):
        if len(w) > 5:
            numbers = [{tuple(w[i : i + 5]) for i in range(max(p - 4, 0), min(p, len(w) - 5) + 1)} for p, x in enumerate(w) if x.isdigit()]
            sets[t] = set(zip(*(w[i:] for i in range(5)))), len(w) - 4, numbers
    want, short = set(), set()
    for r in docs.collect():
        w = decontam.words((r["text"] or "").encode())
        shingles = list(zip(*(w[i:] for i in range(5))))
        for t, (own, n, numbers) in sets.items():
            at = [i for i, s in enumerate(shingles) if s in own]
            for i in at:
                held = {shingles[j] for j in at if i <= j < i + n + n // 4}
                if len(held) >= 0.8 * len(own) and all(held & around for around in numbers):
                    want.add((r["doc_id"], t))
        longer = [m for m in rows if m["doc_id"] == r["doc_id"]]
        for t, name in enumerate(of):
            for i in range(len(w) - len(name) + 1 if len(name) <= 5 else 0):
                end = i + len(name)
                if w[i:end] == name and not any(m["license"] == every[t][0] and m["first_word"] <= i and end <= m["end_word"] and (m["first_word"], m["end_word"]) != (i, end) for m in longer):
                    short.add((r["doc_id"], t, i, end))
    assert found == want and want
    assert {(r["doc_id"], r["template"], r["first_word"], r["end_word"]) for r in rows if len(of[r["template"]]) <= 5} == short and short


def license_table(spark):
    return spark.createDataFrame(license_texts.templates(), "license string, text string")


def test_license_wordings_that_the_data_lack(spark):
    """Whole licenses with small changes, versions told apart, none in plain prose."""
    of = dict(license_texts.TEXTS)
    notice = {n: t for n, t in license_texts.NOTICES}
    texts = {
        "MIT": "Copyright 2020 Someone. " + of["MIT"].replace("sublicense, and/or sell", "sublicense and sell").replace("AUTHORS", "WRITERS"), "ISC": of["ISC"].replace("fee is hereby", "charge is hereby"), "Zlib": of["Zlib"], "BSL-1.0": of["BSL-1.0"].lower(),
        "GPL-2.0": notice["GPL-2.0"].replace("useful", "of use"), "GPL-3.0": "x " * 300 + notice["GPL-3.0"], "LGPL-2.1": "The code is released under the GNU Lesser General Public License, version 2.1.", "AGPL-3.0": notice["AGPL-3.0"], "EPL-2.0": notice["EPL-2.0"],
        "CC-BY-SA-4.0": "Published under CC BY-SA 4.0!", "": "The license of this work is one that nobody has seen, version 3, or so they say.",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    found = {}
    for r in licenses.scan(docs, license_table(spark)).collect():
        found.setdefault(list(texts)[r["doc_id"]], set()).add(r["license"])
    assert all(name in found[name] for name in texts if name) and "" not in found
    assert not found["GPL-2.0"] & {"GPL-3.0", "LGPL-3.0"} and not found["GPL-3.0"] & {"GPL-2.0"} and found["LGPL-2.1"] == {"LGPL-2.1"} and found["CC-BY-SA-4.0"] == {"CC-BY-SA-4.0"}


def test_license_usual_wordings(spark):
    """Each as projects write it; none in prose about licenses."""
    texts = {
        "SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "You may use it under the MIT license.": "MIT", "Licensed under MIT, see LICENSE": "MIT",
        "This project is licensed under the Apache License 2.0.": "Apache-2.0", "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n 1. Definitions.": "Apache-2.0",
        "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>": "GPL-3.0", "Photo: someone, CC BY-SA 3.0": "CC-BY-SA-3.0", "License: GNU GPL v3": "GPL-3.0",
        "They asked which license would suit, and MIT or GPL were named; the Apache helicopter, version 2, flew by.": None, "A BSD clause, a creative commons room.": None, "the MIT": None,
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in licenses.scan(docs, license_table(spark)).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    for i, of in enumerate(texts.values()):
        assert found.get(i, set()) - {"GPL"} == ({of} if of else set()), (i, found.get(i))
    twice = spark.createDataFrame([(1, "Released under the MIT License. Or under the MIT license?")], "doc_id long, text string")
    spans = [(r["first_word"], r["end_word"]) for r in licenses.scan(twice, license_table(spark)).collect()]
    assert (0, 5) in spans and (7, 10) in spans and (2, 5) not in spans


def test_license_odd_input(spark, odd):
    place, mit = next((i, t) for i, (n, t) in enumerate(sorted(license_texts.templates())) if t == dict(license_texts.TEXTS)["MIT"])
    more = spark.createDataFrame([(50, mit.upper(), None, None, None), (50, mit.upper(), None, None, None), (51, "x " * 5000 + mit + " y" * 5000, None, None, None)], DOCS)
    got = licenses.scan(with_clashes(odd.unionByName(more)), license_table(spark)).collect()
    assert sorted(r["doc_id"] for r in got if r["template"] == place) == [50, 50, 51]
    assert licenses.scan(odd.limit(0), license_table(spark)).count() == 0 and licenses.scan(odd, license_table(spark).limit(0)).count() == 0


# decontamination


def expected_contamination(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths, out = {len(k) for k in wanted}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := wanted.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark, documents, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    some = [(r["item_id"], r["text"]) for r in items.collect()]
    kind = dict(items.dtypes)["item_id"]
    extra = [(some[0][0], some[0][1]), (some[1][0], None), (some[2][0], "phrase simple"), (None, "ab")]
    more = items.unionByName(spark.createDataFrame(extra, f"item_id {kind}, text string").where("item_id is not null"))
    for docs in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        for it in (items, more):
            got = [tuple(r) for r in decontam.contamination(with_clashes(docs), with_clashes(it)).collect()]
            assert sorted(got, key=str) == expected_contamination(rows, [(r["item_id"], r["text"]) for r in it.collect()])
    assert decontam.contamination(odd.limit(0), items).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(odd, items.limit(0)).collect()} == {0}


def test_decontamination_equals_its_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert not differences(queries.op10_benchmark_decontamination(spark, sf), queries.OP10_SQL, sf)


def test_decontamination_takes_any_kind_of_id(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five")], "doc_id long, text string")
    for kind, one in (("int", 7), ("long", 7), ("date", __import__("datetime").date(2024, 1, 5)), ("string", "q")):
        got = {r["doc_id"]: r for r in decontam.contamination(docs, spark.createDataFrame([(one, "two three"), (None, "five")], f"item_id {kind}, text string")).collect()}
        assert got[1]["n_hit"] == 2 and got[1]["items_sha256"] == hashlib.sha256(str(one).encode()).hexdigest() and got[2]["n_hit"] == 1


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x green y blue"), (2, "blue green red"), (3, "red " + "x " * 30 + "green blue"), (4, "red green"), (5, "blue")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "red green blue")], "item_id string, text string")
    got = {r["doc_id"]: r["words"] for r in decontam.proximity_hits(decontam.build_index(docs), items, 6, None).collect()}
    assert sorted(got[1]) == [0, 1, 2, 3, 4] and sorted(got[2]) == [0, 1, 2] and not got[3] and not got[4] and not got[5]


# PII


PERSONAL = [
    "write to jane.doe@example.com or JANE.DOE@example.com", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "born 1984-02-29, seen 31.12.1999 and 02/30/2001", "ssn 123-45-6789, not 000-12-3456",
    "from 192.168.0.1 not 300.1.1.1", "iban DE89 3704 0044 0532 0130 00", "call +44 20 7946 0958 now", "jane.doe@example.com again", None, "", "nothing here",
]


def test_pii_pseudonyms(spark):
    docs = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    done = pii.pseudonymised(docs, "key").cache()
    new = {r["doc_id"]: r for r in done.collect()}
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymised(done.select("doc_id", "text"), "key", back=True).collect()}
    assert [back[i] for i in range(len(PERSONAL))] == PERSONAL
    assert "jane.doe@" not in new[0]["text"] and re.search(r"\S+@example.com", new[7]["text"])[0] in new[0]["text"]
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", new[1]["text"])[0]
    digits = [int(c) for c in card if c.isdigit()][::-1]
    assert (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0 and card != "4111 1111 1111 1111"
    assert "4111-1111-1111-1112" in new[1]["text"] and "02/30/2001" in new[2]["text"] and "000-12-3456" in new[3]["text"] and "300.1.1.1" in new[4]["text"]
    assert list(new[2]["kinds"]) == ["date", "date"] and new[5]["kinds"] == ["iban"] and new[6]["kinds"] == ["phone"]
    assert new[8]["text"] is None and new[9]["text"] == "" and new[10]["text"] == "nothing here"
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs, "other key").collect()}
    assert other[0] != new[0]["text"]


def test_pii_equals_plain_python(spark, documents, odd):
    """Every document's text and kinds, found and permuted one by one."""
    more = spark.createDataFrame([(i, t) for i, t in enumerate([*PERSONAL, "GB82 WEST 1234 5698 7654 32", "a.b+c@x.org, 5500005555555559 and 378282246310005", "+49 30 901820 (0)", "999.1.1.1 1799-12-31 2199-12-31 2200-01-01 12/31/1999"])], "doc_id long, text string")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[0-9@]'")
    seen = set()
    for docs in (big, odd, more):
        for r in pii.pseudonymised(docs.select("doc_id", "text", F.col("text").alias("was")), "key").collect():
            text, kinds = plain_pii.pseudonymised(r["was"], "key")
            assert (r["text"], list(r["kinds"])) == (text, kinds), r["was"]
            seen.update(kinds)
    assert seen == {"email", "iban", "card", "ssn", "phone", "ip", "date"}


def test_pii_adjacent_values(spark):
    """A neighbour ends a phone or a card; a time may follow an ISO date."""
    phone = "+1 (826) 555-4081"
    rows = [
        (phone + " alone", ["phone"]), (phone + " 190.137.223.204", ["phone", "ip"]), (phone + " 123-45-6789", ["phone", "ssn"]), (phone + " 2024-01-05", ["phone", "date"]), (phone + " 31.12.1999", ["phone", "date"]),
        (phone + " 4111 1111 1111 1111", ["phone", "card"]), ("4111111111111111 12/27", ["card"]), ("4111 1111 1111 1111 190.137.223.204", ["card", "ip"]), ("at 2024-01-05T10:00", ["date"]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    done = pii.pseudonymised(docs, "key").cache()
    new = {r["doc_id"]: r for r in done.collect()}
    assert [list(new[i]["kinds"]) for i in range(len(rows))] == [k for _, k in rows]
    assert len({new[i]["text"][: len(phone)] for i in range(6)}) == 1 and not new[0]["text"].startswith(phone)
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymised(done.select("doc_id", "text"), "key", back=True).collect()} == {i: t for i, (t, _) in enumerate(rows)}


def test_pii_forms_that_are_seldom(spark):
    """What is found, by hand; all of it equal to plain Python, and undone by the key."""
    rows = [
        ("josé.núñez@example.com or иван7@example.org", ["email", "email"]), ("連絡先は foo@example.com", ["email"]), ("漢字" * 60 + "foo@example.com", ["email"]), ("é@example.com", ["email"]),
        ("number 123 45 6789.", ["ssn"]), ("123 45 6789 2020-02-03", ["ssn", "date"]), ("123-45-6789", ["ssn"]), ("000 45 6789", []), ("123 00 6789", []), ("123 45 0000", []), ("7 123 45 6789", []), ("123 45 6789 12", []), ("123 45-6789", []),
        ("+49 123 45 6789", ["phone"]), ("010.001.002.003", []), ("10.01.2.3", []), ("10.0.2.3", ["ip"]), ("0.0.0.0", ["ip"]), ("4111 1111 1111 1111", ["card"]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    done = pii.pseudonymised(docs, "key").cache()
    for r in done.collect():
        text, kinds = rows[r["doc_id"]]
        assert (r["text"], r["kinds"]) == plain_pii.pseudonymised(text, "key") and r["kinds"] == kinds, (text, r)
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymised(done.select("doc_id", "text"), "key", back=True).collect()} == {i: t for i, (t, _) in enumerate(rows)}
    new = {rows[r["doc_id"]][0]: r["text"] for r in done.collect()}
    assert new["123-45-6789"].replace("-", " ") in new["number 123 45 6789."] and "josé" not in new[rows[0][0]]


def test_pii_long_domains(spark):
    """Labels without end, after an @: no value, and no stack overflow."""
    texts = ["x@" + "a." * 3000 + "com", "x@" + "a." * 200_000 + "com", "x@" + "a" * 400_000, "a" * 400_000 + "@b.com", "1 " * 200_000, "+1" + "-12" * 100_000, "AB12" + " ABCD" * 100_000, "bob@sub.example.co.uk."]
    got = {r["doc_id"]: r for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    assert [got[i]["text"] for i in (0, 1, 2)] == texts[:3] and all(len(got[i]["text"]) == len(t) for i, t in enumerate(texts))
    assert got[7]["kinds"] == ["email"] and got[7]["text"].endswith("@sub.example.co.uk.") and not got[7]["text"].startswith("bob")


def test_pii_phone_separators_make_no_difference(spark):
    texts = ["+1 555-123-4567", "+1-555-123-4567", "+15551234567", "+1 (555) 123 4567"]
    new = [r["text"] for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    assert len({re.sub(r"\D", "", t) for t in new}) == 1 and new[2] != texts[2] and [re.sub(r"\d", "0", t) for t in new] == [re.sub(r"\d", "0", t) for t in texts]


def test_pii_is_a_permutation(spark):
    """All values of a small format map to different ones."""
    ips = spark.range(2000).select(F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(F.col("id") / 250).cast("string"), (F.col("id") % 250).cast("string")).alias("text"))
    dates = spark.range(2000).select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    for df in (ips, dates):
        assert pii.pseudonymised(df, "k").select("text").distinct().count() == 2000


def test_pii_odd_input(spark, odd):
    assert pii.pseudonymised(odd, "key").count() == len(ODD) and pii.pseudonymised(odd.limit(0), "key").count() == 0
    clash = pii.pseudonymised(with_clashes(odd), "key")
    assert {"_found", "_gaps"} <= set(clash.columns) and clash.count() == len(ODD)


def test_pii_plan_is_native(spark, documents, capsys):
    pii.pseudonymised(documents, "key").explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, documents, reference_encoding):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    spoken = {r["doc_id"] for r in langid.in_a_language(documents).select("doc_id").collect()}  # held against brute force above
    rows = [(i, t) for i, t in rows if i in spoken]
    first = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        first[key] = min(first.get(key, i), i)
    rows = [(i, t) for i, t in rows if i in set(first.values())]
    from tests.llm.test_near_shingles import plain_components

    stays = {i for i, c in plain_components(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in stays]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r[0] for r in expected_contamination(rows, items) if r[5]}
    rows = [(i, t) for i, t in rows if i not in gone]
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got, key=str) == expected_bpe(reference_encoding, rows) and gone


def test_stages_keep_columns_and_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
