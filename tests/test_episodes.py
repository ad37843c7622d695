"""Episode packing against the fold it stands for."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quirework.operators import episodes


def folded(sizes, limit):
    """(chunks, bytes) of each episode."""
    out, held, n = [], 0, 0
    for b in sizes:
        if held > 0 and held + b > limit:
            out.append((n, held))
            held = n = 0
        held, n = held + b, n + 1
    return [*out, (n, held)] if n else out


def sizes_of(rng, n):
    kind = rng.randrange(5)
    one = {0: lambda: rng.randrange(30), 1: lambda: rng.choice([0, 0, 0, 99, 150]), 2: lambda: 1, 3: lambda: rng.choice([0, 3]), 4: lambda: rng.choice([100, 101, 0, 50])}[kind]
    return [one() for _ in range(n)]


def test_steps_compose_as_the_fold():
    """Tables of blocks, composed in any grouping, give the episode open at every border."""
    rng = random.Random(2)
    for _ in range(300):
        sizes, limit = sizes_of(rng, rng.randrange(2, 60)), 100
        cuts = sorted({0, len(sizes), *(rng.randrange(len(sizes)) for _ in range(5))})
        before = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        steps = []
        for a, b in zip(cuts, cuts[1:]):
            s = episodes._Segment(before[a:b], before[a:b] + np.array(sizes[a:b]), limit)
            last = s.last_starts()
            assert all(s.starts(i)[-1] == last[i] for i in range(s.n))
            if a == 0:
                steps.append(episodes.Step(np.array([episodes.NEVER]), s.before[last[:1]], last[:1], None, 0, -1))
            else:
                empty = int(s.breaks(s.before[:1])[0])
                zero = (int(s.before[last[empty]]), a + int(last[empty])) if empty < s.n else (0, -1)
                steps.append(episodes._short(s.after - limit, s.before[last], a + last, int(s.before[0]), *zero))
        starts, held = [], 0
        for i, b in enumerate(sizes):
            if i == 0 or (held > 0 and held + b > limit):
                starts.append(i)
                held = 0
            held += b
        whole = steps[0]
        for k, s in enumerate(steps[1:], 2):
            want = max(x for x in starts if x < cuts[k])
            whole = whole.then(s)
            assert whole.after(0, -1)[1] == want
            middle = rng.randrange(1, k)
            right = steps[middle]
            for t in steps[middle + 1 : k]:
                right = right.then(t)
            left = steps[0]
            for t in steps[1:middle]:
                left = left.then(t)
            assert left.then(right).after(0, -1)[1] == want


@pytest.mark.parametrize(("block_rows", "fan"), [(7, 3), (64, 256), (50_000, 256)])
def test_packing_equals_the_fold(spark, block_rows, fan):
    """One group holds a third of all chunks; others are empty, tiny or oversized."""
    rng = random.Random(block_rows)
    groups = {None: sizes_of(rng, 9), "hot": [b for _ in range(20) for b in sizes_of(rng, 15)]} | {f"g{k}": sizes_of(rng, rng.randrange(1, 20)) for k in range(50)}
    rows = [(g, k, None if b == 0 and k % 2 else "é" * (b // 2) + "x" * (b % 2)) for g, mine in groups.items() for k, b in enumerate(mine)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, n int, text string").repartition(6)
    got = {}
    for r in sorted(episodes.pack_episodes(df, "g", ["n"], "text", 100, block_rows, fan).collect(), key=lambda r: (r.g or "", r.episode)):
        assert r.episode == len(got.setdefault(r.g, []))
        got[r.g].append((r.chunks, r.bytes))
    assert got == {g: folded(mine, 100) for g, mine in groups.items()}


def test_no_chunks(spark):
    assert episodes.pack_episodes(spark.createDataFrame([], "g string, n int, text string"), "g", ["n"], "text").count() == 0
