"""Resampling, exact search and conversation repair against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quirework.llm import conversation_repair as repair
from quirework.llm import exact_search, resampling

# 11 resampling


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs_of(text, width):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def naive_resampling(docs, target, width, buckets, percent, least, seed):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for into, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for run in runs_of(text, width):
                into[bucket(run)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        runs = runs_of(text, width)
        weight = sum(gain[bucket(r)] for r in runs)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words_of(text)), len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, rows), key=repr)


def texts(rng, n):
    odd = [None, "", " ,;\x00", "Ünï ÇØDE xİy \U0001f600z", "A" * 300 + " b " + "é" * 90, "word " * 50_000, "x" * 200_000 + " tail end"]
    return odd + [" ".join(rng.choice(["alpha", "Beta", "gamma7", "de-lta", "ε", "zeta,eta"]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("width", [1, 3])
def test_resampling_equals_brute_force(spark, width):
    rng = random.Random(width)
    docs = [(None if k == 9 else k // 2 if k < 20 else k, t) for k, t in enumerate(texts(rng, 80))]
    docs += docs[20:30]  # repeated rows
    target = ["alpha beta gamma7", None, "", "zeta ETA alpha"]
    found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), width=width, buckets=97, percent=40, least_words=10, seed="s")
    assert sorted(map(tuple, found.collect()), key=repr) == naive_resampling(docs, target, width, 97, 40, 10, "s")


def test_word_runs_in_windows_are_those_of_the_whole():
    rng = random.Random(5)
    for width in (1, 2, 4):
        for _ in range(40):
            text = "".join(rng.choice("ab é,Z9 ") for _ in range(rng.randrange(1, 400)))
            found = [x for _, _, _, sums, _ in resampling._runs(pa.array([text]), width, limit=rng.choice([3, 10, 50])) for x in sums.tolist()]
            assert sorted(found) == sorted(zlib.crc32(r.encode()) for r in runs_of(text, width))
            assert sum(int(w.sum()) for *_, w in resampling._runs(pa.array([text]), width, limit=7)) == len(words_of(text))


def test_drawn_documents_are_whole(spark):
    docs = spark.createDataFrame([(k, f"alpha {k} " * 30, "kept", 1.5) for k in range(50)], "doc_id long, text string, rank string, weight double")
    found = resampling.resampled_documents(docs, spark.createDataFrame([("alpha",)], "text string"), percent=20)
    assert found.columns == docs.columns and found.count() == 10


# 12 exact search


def naive_top(rows, asked, k, scale):
    def ints(v):
        bad = v is None or any(x is None or not math.isfinite(x) for x in v)
        return None if bad else [math.floor(scale * x) for x in v]

    able = [(i, ints(v)) for i, v in rows if i is not None and ints(v) is not None]
    out = []
    for q in sorted({i for i, _ in able if i in asked}):
        mine = min((tuple(x for x in v) for i, v in rows if i == q and ints(v) is not None))
        mine = ints(mine)
        scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in able if i != q and len(v) == len(mine))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return out


def clustered(rng, n, size):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    return [[c + rng.gauss(0, 0.05) for c in rng.choice(centres)] for _ in range(n)]


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vectors = clustered(rng, 900, 5) + [[0.5] * 5] * 300 + [[0.0] * 5, [1.0, 2.0], [3.0, -1.0], [], []]
    rows = list(zip(rng.sample(range(5000), len(vectors)), vectors))
    rows += [(None, [1.0] * 5), (20, None), (40, [1.0, None, 1.0, 1.0, 1.0]), (60, [float("nan")] * 5), (80, [float("inf")] * 5), rows[0], rows[1], (rows[2][0], [0.25] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4) if len(rows[0]) == 3 else spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = {i for i, _ in rows if i is not None and i % 3 == 0}
    found = exact_search.exact_top_k(df, df.filter("vec_id % 3 = 0"), k=7, scale=16, block_bytes=9000)
    assert sorted(map(tuple, found.collect())) == naive_top(rows, asked, 7, 16)


@pytest.mark.parametrize("size", [1.0, 1e5, 1e7])
def test_trees_find_the_best_at_every_magnitude(size):
    """Products in floats of 32 and 64 bits and in whole numbers."""
    rng = np.random.default_rng(8)
    rows, asked = np.floor(rng.normal(size=(700, 4)) * size * 40), np.floor(rng.normal(size=(30, 4)) * size * 40)
    ids, names = rng.permutation(700), np.arange(5000, 5030)
    best = exact_search.Best(np.full(30, exact_search.NONE), np.full(30, exact_search.LAST_ID), 6)
    for a in range(0, 700, 350):
        exact_search.search(exact_search.Tree(ids[a : a + 350], rows[a : a + 350], 16), names, asked, best, np.arange(30))
    for q in range(30):
        exact = sorted((-sum(int(x) * int(y) for x, y in zip(asked[q], r)), int(i)) for r, i in zip(rows, ids))[:6]
        assert [(-s, i) for s, i in zip(best.score[q].tolist(), best.id[q].tolist())] == exact


def test_search_prunes_leaves():
    """Far clusters are not looked at."""
    rng = random.Random(4)
    rows = np.floor(np.array([[c + rng.gauss(0, 0.02) for c in centre] for centre in ([4, 0, 0], [0, 4, 0], [0, 0, 4], [-4, 0, 0]) for _ in range(500)]) * 64)
    tree, seen = exact_search.Tree(np.arange(2000), rows, 32), []
    best = exact_search.Best(np.full(1, exact_search.NONE), np.full(1, exact_search.LAST_ID), 5)
    inner = exact_search._found
    try:
        exact_search._found = lambda scores, *rest: (seen.append(scores.shape[1]), inner(scores, *rest))
        exact_search.search(tree, np.array([9999]), np.floor(np.array([[64.0, 0, 0]])), best, np.arange(1))
    finally:
        exact_search._found = inner
    assert sum(seen) <= 300


# 13 conversation repair


def naive_repair(rows):
    """Rows (turn, role, text, copies) of one conversation: forward, all cheapest strings by cost and audit."""
    def space(x):
        return " " if x is None else x

    rows = sorted(((t, space(r), space(x)) for t, r, x, n in rows for _ in range(n)), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    nexts = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    gives = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def inserted(now):
        now = dict(now)
        for _ in range(3):
            for q, (c, a, t) in list(now.items()):
                role, to = gives[q]
                new = (c + 2, a + "I", (*t, f"{role}:"))
                if to not in now or new[:2] < now[to][:2]:
                    now[to] = new
        return now

    now = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        then = {}
        for q, (c, a, t) in now.items():
            ways = [(q, (c + 3, a + "D", t))]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if q in nexts.get(role[:1], {}):
                    ways.append((nexts[role[:1]][q], (c + more, a + "K", (*t, f"{role}:{text}"))))
                ways.append((gives[q][1], (c + 2 + more, a + "R", (*t, f"{gives[q][0]}:{text}"))))
            for to, new in ways:
                if to not in then or new[:2] < then[to][:2]:
                    then[to] = new
        now = inserted(then)
    cost, audit, lines = min((now[q] for q in (0, 3) if q in now), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_rows(rng, n):
    return [
        (rng.choice([None, *range(n)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]), rng.choice(["Yes.", "No!", "what", "so? ", "", " \n", None, f"t{rng.randrange(9)}.", "é"]), rng.choice([0, 1, 1, 1, 1, 2, 5]))
        for _ in range(n)
    ]


def test_repair_equals_brute_force(spark):
    rng = random.Random(13)
    every = {c: random_rows(rng, rng.randrange(1, 14)) for c in [None, *range(300)]}
    rows = [(c, *r) for c, mine in every.items() for r in mine]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, copies long, cost string").repartition(7)
    got = {r[0]: tuple(r[1:]) for r in repair.repair_report(df).collect()}
    assert got == {c: naive_repair(mine) for c, mine in every.items()}


def test_a_conversation_over_many_ranges(spark):
    """A third of all rows, among them one that is there 3,000 times, and one very long text."""
    rng = random.Random(14)
    hot = [(k, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {k}.", "again.", "cut", " "]), 1) for k in range(9000)]
    hot += [(5, "user", "said.", 1)] * 3000 + [(77, "assistant", "very long " * 200_000, 1)]
    rest = {c: random_rows(rng, 5) for c in range(1, 2000)}
    rows = [(7_000, *r) for r in hot] + [(c, *r) for c, mine in rest.items() for r in mine]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long").repartition(9)
    got = {r[0]: tuple(r[1:]) for r in repair.repair_report(df).collect()}
    assert got[7_000] == naive_repair(hot)
    assert got == {7_000: got[7_000]} | {c: naive_repair(mine) for c, mine in rest.items()}


def test_repaired_rows_give_the_digest(spark):
    rng = random.Random(15)
    rows = [(c, *r) for c in range(60) for r in random_rows(rng, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long").repartition(5)
    lines = {}
    for r in sorted(repair.repaired_rows(repair.repair(df)).collect(), key=lambda r: (r.conv_id, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair.repair_report(df).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest()


def test_dropped_conversations_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 0), (2, None, None, None, 1)], "conv_id long, turn long, role string, text string, copies long")
    got = {r[0]: tuple(r[1:]) for r in repair.repair_report(df).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == {1: (0, 0, 0, 0, 0, 0, "", nothing), 2: (0, 1, 0, 0, 0, 3, "D", nothing)}
    assert repair.repair_report(df.limit(0)).count() == 0
