"""Importance resampling, conversation repair and nearest neighbours against brute-force versions; odd input for all."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, queries, repair, resample

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# importance resampling


def features(text, longest):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    held = [(d, *features(t, longest)) for d, t in docs]
    s = Counter(b % buckets for *_, f in held for b in f)
    t = Counter(b % buckets for x in target for b in features(x, longest)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for d, n, f in held:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b % buckets] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for i, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows_of(queries.op11_importance_resampling(spark, SF))
    assert got == brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in items.collect()])
    assert sum(r[4] is not None for r in got) > 10


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_of_longer_features_and_odd_input(spark, longest, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcde"), rng.integers(0, 60))) for _ in range(60)] + [None, "", " \t", "É" * 9, "word " * 3000, "A b-A_b9", "A b-A_b9"]
    rows = [(None if i == 7 else i if i != 9 else 8, t, "x", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string, rank string")
    target = spark.createDataFrame([(1, "a b a b c"), (2, None), (3, "")], "item_id long, text string")
    want = brute_resample([r[:2] for r in rows], ["a b a b c", None, ""], longest, 97, 25, 5)
    assert rows_of(resample.resample(docs, target, longest, 97, 25, 5)) == want
    monkeypatch.setattr(resample, "SHARD_WORDS", 10)
    assert resample.gains(docs, target, longest, 97) == resample.gains(docs.repartition(5), target, longest, 97)
    assert rows_of(resample.resample(docs, target.limit(0), longest, 97, 25, 5)) == brute_resample([r[:2] for r in rows], [], longest, 97, 25, 5)
    assert resample.resample(docs.limit(0), target, longest).count() == 0


def test_suffixes_are_sorted_and_runs_hold_all_repeats():
    rng = np.random.default_rng(5)
    texts = [[bytes([97 + x]) for x in rng.integers(0, 3, rng.integers(0, 40))] for _ in range(20)]
    for longest in (1, 2, 3, 5):
        shard = resample.Shard(texts, longest)
        windows = [tuple(shard._at(np.arange(p, p + longest)).tolist()) for p in shard.suffixes.tolist()]
        cut = [tuple(itertools.takewhile(lambda x: x >= 0, w)) for w in windows]
        assert len(shard.suffixes) == len(shard.ids)
        for n in range(1, longest + 1):
            places, bucket = shard.buckets(n, 1 << 31)
            want = {int(b) + i: zlib.crc32(b" ".join(t[i : i + n])) % (1 << 31) for b, t in zip(shard.begins, texts) for i in range(len(t) - n + 1)}
            assert dict(zip(places.tolist(), bucket.tolist())) == want
            heads = [c[:n] for c in cut if len(c) >= n]
            assert len([1 for a, b in zip([None, *heads], heads) if a != b]) == len(set(heads))  # equal n-grams are neighbours


def test_places_in_a_total_order(spark):
    df = spark.range(0, 5000, 1, 7).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("x"), "id")
    got = sorted((r["rank"], r["x"], r["id"]) for r in resample.ranked(df, [F.desc("x"), F.asc("id")]).collect())
    assert [g[1:] for g in got] == sorted(((r["x"], r["id"]) for r in df.collect()), key=lambda r: (-r[0], r[1])) and [g[0] for g in got] == list(range(1, 5001))


# conversation repair


def cheapest(rows):
    """rows of (initial, fault): edits tried in order of (cost, audit), with what they lead to; nothing of the grammar but its regular expression's states."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        for x in "ua":
            if (state, x) in after:
                heapq.heappush(queue, (cost + 2, audit + "I", i, after[state, x]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, initial) in after:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, after[state, initial]))
                for x in "ua":
                    if (state, x) in after:
                        heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, after[state, x]))


def every_way(rows, most):
    """The least (cost, audit) of all sequences of edits that leave a legal conversation and cost `most` at most."""
    best = None
    stack = [(0, "", 0, "")]
    while stack:
        cost, audit, i, roles = stack.pop()
        if cost > most:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        stack += [(cost + 2, audit + "I", i, roles + x) for x in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            stack.append((cost + 3, audit + "D", i + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                stack.append((cost + more, audit + "K", i + 1, roles + initial))
                stack += [(cost + 2 + more, audit + "R", i + 1, roles + x) for x in "ua"]
    return best


def parsed(rows):
    chart = repair.Earley()
    audit = "".join(chart.feed(initial, fault in ("blank", "duplicate"), fault == "truncated") for initial, fault in rows)
    cost, last = chart.end()
    return cost, audit + last


def test_parser_finds_the_cheapest_repair():
    rng = np.random.default_rng(1)
    for n in [*range(4)] * 12 + [12, 40, 200] * 5:
        rows = [(str(rng.choice(list("uuuaaast "))), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(n)]
        want = cheapest(rows)
        assert parsed(rows) == want
        if n < 4:
            assert want == every_way(rows, want[0])


def test_a_long_conversation_is_settled_as_it_comes():
    chart, out, open_rows = repair.Repair(), 0, 0
    for i in range(30_000):
        out += sum(1 for _ in chart.feed(i, "assistant" if i % 7 in (1, 3) else "user", f"text {i}.", "truncated" if i % 5 == 0 else None))
        open_rows = max(open_rows, len(chart.open))
    assert open_rows < 20 and out > 29_000


def test_grammars_of_ones_own():
    """A right-recursive grammar says the same; its items' origins are many."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 9):
        rows = [(str(rng.choice(list("uas"))), None) for _ in range(n)]
        chart = repair.Earley([("S", ""), ("S", "B"), ("S", "sB"), ("B", "ua"), ("B", "uaB")], slack=float("inf"))
        audit = "".join(chart.feed(initial, False, False) for initial, _ in rows)
        cost, last = chart.end()
        assert (cost, audit + last) == cheapest(rows)


def brute_structure(rows):
    """op12's rows from (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = by.setdefault(conv, [])
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        own += [row] * {0: 0, 3: 2}.get(k, 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(own, faults)])
        turns = [r[0] for r in own if r[0] is not None]
        left, lines, at = list(own), [], 0
        for e in audit:
            _, role, text = (None, None, "") if e == "I" else left.pop(0)
            if e == "D":
                continue
            role = role if e == "K" else ("user", "assistant")[at]
            at = at if role[0] == "s" else 1 - at
            lines.append(f"{role}:{text}")
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=str)


def test_repair_equals_brute_force(spark):
    own = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert rows_of(queries.op12_conversation_repair(spark, SF)) == brute_structure(own)


def test_repair_of_odd_conversations(spark):
    rng = np.random.default_rng(6)
    texts = [None, "", " \t", "yes.", "yes.", "no", "so  ", "what?\n", "x" * 50_000 + "!", "a.b"]
    rows = [(None if c == 3 else c, None if rng.random() < 0.1 else int(rng.integers(0, 9)), rng.choice(["user", "assistant", "system", "tool", "", None, "Übel"]), texts[rng.integers(len(texts))]) for c in range(60) for _ in range(rng.integers(1, 12))]
    rows += [(next(c for c in range(900, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "all rows go")]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, fault string, edit string")
    got = rows_of(repair.structure(repair.damaged(df), df))
    assert got == brute_structure(rows) and any(r[7] == "" for r in got)
    assert repair.structure(repair.damaged(df.limit(0)), df.limit(0)).count() == 0
    edits = [r.asDict() for r in repair.repaired(df).collect()]
    for conv in {r[0] for r in rows}:  # what is left is legal
        assert re.fullmatch("(s?(ua)+)?", "".join(e["role"][0] for e in edits if e["conv_id"] == conv and e["role"]))


# nearest neighbours


def brute_nearest(rows, by, k):
    good = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = []
    for i, v in good:
        if i % by == 0:
            scored = []
            for j, w in good:
                if j != i:
                    s = 0.0
                    for a, b in zip(v, w):
                        s += a * b
                    scored.append((-s, j))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_neighbours_are_exact_in_one_leaf(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(queries.op13_nearest_neighbours(spark, SF)) == brute_nearest(rows, 20, 20)


def test_neighbours_recall_over_many_leaves(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r["embedding"] for r in vectors.orderBy("vec_id").collect()], np.float64)
    found = {}
    for r in ann.search(vectors, F.col("vec_id") % 20 == 0, 20, leaf=64, trees=3).collect():
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-12
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = []
    for q, own in found.items():
        s = x @ x[q]
        s[q] = -9
        assert [r for r, _ in sorted(own)] == list(range(1, 21)) and q not in {v for _, v in own}
        hit.append(len(set(np.argsort(-s)[:20].tolist()) & {v for _, v in own}) / 20)
    assert len(found) == 100 and np.mean(hit) > 0.9


def test_structured_vectors_need_few_leaves(spark):
    """Ten close groups: the calibrated search takes a small part of the leaves."""
    rng = np.random.default_rng(7)
    x = (np.repeat(rng.standard_normal((40, 16)), 50, axis=0) + 0.05 * rng.standard_normal((2000, 16))).astype(np.float32)
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point long, embedding array<float>")
    forest = ann.Forest(x, float(np.sqrt((x * x).sum(1)).max()), 2, 64)
    assert ann.calibrated(pts, forest, x[::20], 20, 0.95) * 4 < forest.leaves


def test_neighbours_of_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    hot = [0.5, -0.25, 1.0]
    rows = [(i, hot) for i in range(400)]  # a vector that many rows share
    rows += [(400 + i, [float(np.float32(x)) for x in rng.standard_normal(3) * rng.integers(1, 4)]) for i in range(300)]
    rows += [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [1.0, None, 2.0]), (1060, [float("nan"), 1.0, 1.0]), (1080, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1100, [2.0]), (1120, [-0.0, 2.0, 0.0]), (1121, [0.0, 2.0, 0.0]), (1120, [-0.0, 2.0, 0.0]), (1140, [])]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<float>, point string, score string").repartition(5)
    for k in (1, 20):
        got = ann.search(df, F.col("vec_id") % 20 == 0, k, recall=1.0, leaf=32)
        want = brute_nearest([(i, [*v, 0.0, 0.0][:3] if v else v) for i, v in rows], 20, k)
        assert sorted((r[0], r[1], r[2], round(r[3], 12)) for r in got.collect()) == sorted((a, b, c, round(s, 12)) for a, b, c, s in want)
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    few = df.where("vec_id in (1120, 1121, 1100)")
    assert rows_of(ann.search(few, F.col("vec_id") % 20 == 0, 20)) == brute_nearest([(1100, [2.0, 0.0, 0.0]), (1120, [0.0, 2.0, 0.0]), (1121, [0.0, 2.0, 0.0])], 20, 20)


# chat formatting


def test_a_very_large_conversation_among_many(spark, monkeypatch):
    """What a task holds is bounded by size: small conversations go out around the large one, whole and in order."""
    monkeypatch.setattr(chat, "TOGETHER", 2000)
    rows = [(c, t, ("user", "assistant")[t % 2], f"<s>{c}/{t} " + "x\\" * (200_000 if c == 7 else 20)) for c in range(60) for t in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.canonical_turns(chat.as_records(turns)))).collect()}
    assert len(got) == 60
    for c in range(60):
        own = [r for r in rows if r[0] == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [r[2:] for r in own] and got[c]["loss"] == [r[3] for r in own if r[2] == "assistant"]
