"""Near duplicates by word shingles against all pairs; planted copies; odd input."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import SF, documents, odd, with_clashes  # noqa: F401
from tidemark.llm import near_shingles


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    both = len(a & b)
    return a == b or 5 * both >= 4 * (len(a) + len(b) - both)


def plain_components(rows):
    """rows (id, text) -> (id, least id reachable), over all pairs."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted([(doc_id, least.get(find(i))) for i, (doc_id, _) in enumerate(rows)], key=str)


def found(docs):
    return sorted([tuple(r) for r in near_shingles.near_duplicates(docs).collect()], key=str)


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


WORDS = [f"w{i}" for i in range(3000)]


def planted(seed):
    """Groups of copies with words changed here and there, chains of small steps, a passage that many texts share, and texts on their own."""
    rng, texts = random.Random(seed), []
    for size, n in ((40, 120), (3, 60), (2, 30), (2, 400)):
        base = prose(rng, n)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 50))):
                copy[rng.randrange(n)] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    chain = prose(rng, 100)
    for k in range(12):
        chain = chain[5:] + prose(rng, 5)
        texts.append(" ".join(chain))
    passage = prose(rng, 60)
    for _ in range(30):
        texts.append(" ".join(passage + prose(rng, rng.randint(8, 40))))
    texts += [" ".join(prose(rng, rng.randint(1, 80))) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_equal_all_pairs(spark, documents, odd):  # noqa: F811
    for docs in (documents, odd):
        assert found(with_clashes(docs)) == plain_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert found(odd.limit(0)) == []


@pytest.mark.parametrize("share", [512, 2])
def test_planted_copies(spark, monkeypatch, share):
    """A small bound shares out the leading sets."""
    monkeypatch.setattr(near_shingles, "SHARE", share)
    rows = planted(7)
    want = plain_components(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want
    sizes = Counter(c for _, c in want).values()
    assert max(sizes) >= 30 and len(sizes) >= 70


def test_every_pair_at_the_threshold(spark):
    """Pairs between 0.8 and 0.9 are found, pairs below it are left alone."""
    rng, rows, want = random.Random(3), [], {}
    for g in range(150):
        base = prose(rng, 104)
        other = list(base)
        cut = rng.choice([5, 7, 9, 10, 11, 12, 14, 20])
        other[-cut:] = prose(rng, cut)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        want[g] = similar(plain_set(rows[-1][1]), plain_set(rows[-2][1]))
    got = dict(found(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {g: got[2 * g + 1] == 2 * g for g in want} == want and 0 < sum(want.values()) < 150


def test_pairs_that_share_no_cell_or_differ_in_many_bits(spark):
    """Of pairs at 0.8, those that no cell holds or that fingerprints would rule out are found too."""
    rng, rows = random.Random(11), []
    while len(rows) < 6:
        n = rng.choice([30, 40, 60])
        base = prose(rng, n + 4)
        other = base[: -(n // 9)] + prose(rng, n // 9)
        texts = [" ".join(base), " ".join(other)]
        (fp, least), (gp, most) = (near_shingles.sketch(near_shingles.shingles(t.encode())) for t in texts)
        cells = (least == most).reshape(near_shingles.BANDS, -1).all(1).any()
        if similar(*map(plain_set, texts)) and not (cells and ((fp ^ gp) % 2**64).bit_count() <= near_shingles.BITS):
            rows += [(len(rows), texts[0]), (len(rows) + 1, texts[1])]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == [(i, i // 2 * 2) for i in range(6)]


def test_the_last_step_alone_finds_all(spark, monkeypatch):
    """Every link that neither pivots nor cells give, with frequent shingles in the order's end; a text that is frequent as a whole too."""
    none = lambda docs, classes, *_: classes.limit(0).selectExpr("node AS a", "node AS b")
    monkeypatch.setattr(near_shingles, "_by_pivots", none)
    monkeypatch.setattr(near_shingles, "_tested", none)
    monkeypatch.setattr(near_shingles, "SAMPLED", 2)
    rows = planted(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(near_shingles.frequent(docs)) > 100
    assert found(docs) == plain_components(rows)


def test_minima_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(60):
        h = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
        (_, a), (_, b) = near_shingles.sketch(h[:1080]), near_shingles.sketch(h[120:])  # 960 of 1200
        agree.append((a == b).mean())
    assert np.mean(agree) == pytest.approx(0.8, abs=0.03)


def test_stage_keeps_the_first_of_a_group_and_rows_without_an_id(spark):
    text = " ".join(WORDS[:60])
    rows = [(5, text), (3, text + " more"), (None, text), (9, "on its own")]
    out = near_shingles.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit(1)))
    assert sorted((str(r["doc_id"]) for r in out.collect())) == ["3", "9", "None"] and out.columns == ["doc_id", "text", "cls"]


def test_the_pivot_tables_link_before_any_cell(spark, monkeypatch):
    """Fingerprints two bits apart at most are linked by SimHash's pivot distance tables, and what they link is verified."""
    from tidemark.llm import near_shingles

    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"x{i}" for i in range(400)))], "doc_id long, text string")
    rows = near_shingles.sketches(docs)
    fp = {r["doc_id"]: r["fp"] for r in rows.collect()}
    assert (fp[1] ^ fp[2]).bit_count() <= 2
    monkeypatch.setattr(near_shingles, "_tested", lambda docs, classes, rows, *_: classes.limit(0).selectExpr("node AS a", "node AS b"))
    got = {r["doc_id"]: r["component_id"] for r in near_shingles.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_no_pair_is_tested_twice(spark, monkeypatch):
    """Cells that stay mixed keep their lead: later rounds send out no sets for the pairs that are known to differ."""
    rng, rounds, verified = random.Random(5), [], near_shingles._verified

    def seen(docs, classes, pairs, *rest):
        rounds.append([tuple(sorted(r)) for r in pairs.collect()])
        return verified(docs, classes, pairs, *rest)

    monkeypatch.setattr(near_shingles, "_verified", seen)
    monkeypatch.setattr(near_shingles, "_by_pivots", lambda docs, classes, *_: classes.limit(0).selectExpr("node AS a", "node AS b"))
    rows = []
    for _ in range(30):  # texts that share about two thirds: many cells, few links
        base = prose(rng, 150)
        rows += [" ".join(base[: 150 - (cut := rng.choice([20, 40, 45, 50]))] + prose(rng, cut)) for _ in range(6)]
    rows = list(enumerate(rows))
    found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    pairs = [p for some in rounds for p in some]
    assert len(rounds) > 1 and len(pairs) == len(set(pairs)) > 0


@pytest.mark.parametrize("stage", ["exact", "near", "clean"])
def test_a_stage_leaves_the_ids_alone_in_the_shared_folder(spark, stage):
    """What a stage has written to decide on its rows is gone before the next one runs: only the dropped ids are left, which its result reads."""
    import corpus_pipeline
    from tidemark.llm.common import scratch

    folder = scratch(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = getattr(corpus_pipeline, stage)(spark, docs, SF).count()
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["gone"] and 0 < n <= docs.count()


def test_what_a_failed_function_wrote_is_deleted(spark):
    from tidemark.llm.common import passing, scratch, written

    folder = scratch(spark).removeprefix("file://")
    before = set(os.listdir(folder))

    @passing
    def inner():
        written(spark.range(3), "spent")
        return written(spark.range(4), "kept")

    @passing
    def outer(fails):
        rows = inner()
        assert rows.count() == 4
        if fails:
            raise ValueError("no")
        return rows

    with pytest.raises(ValueError):
        outer(True)
    assert set(os.listdir(folder)) == before
    assert outer(False).count() == 4 and [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["kept"]


def test_wide_rows_are_written_in_small_pages_and_row_groups(spark):
    """A writer holds 16 MB and some of a task's rows, and a codec a page of one row, however few the rows are (a shard of the positional index is a row of megabytes)."""
    from tidemark.llm.common import written

    wide = spark.range(24, numPartitions=1).select("id", F.expr("array_join(transform(sequence(1, 20000), i -> sha2(cast(id * 20000 + i as string), 256)), '')").cast("binary").alias("wide"))
    out = written(wide, "wide")
    assert {(r[0], r[1]) for r in out.select("id", F.octet_length("wide")).collect()} == {(i, 20000 * 64) for i in range(24)}
    (file,) = out.inputFiles()
    jvm = spark._jvm.org.apache.parquet.hadoop
    reader = jvm.ParquetFileReader.open(jvm.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration()))
    try:
        blocks = list(reader.getFooter().getBlocks())
        assert len(blocks) > 1 and max(b.getTotalByteSize() for b in blocks) < 20 << 20
        assert all(reader.readOffsetIndex(b.getColumns()[1]).getPageCount() == b.getRowCount() for b in blocks)
    finally:
        reader.close()
