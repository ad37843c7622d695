"""Builds that redo only what changed, and patterns applied to paths, against doing it all anew."""

from __future__ import annotations

import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from quirework.operators import incremental as J
from quirework.operators import skew as W
from quirework.plans import snapshots as Z
from quirework.session import shared_dir
from quirework.sources import discovery as S

FILES = "path string, source_type string, include_license boolean, content string"


def files(spark, state):
    return spark.createDataFrame([(p, "git", True, t) for p, t in state.items()], FILES).coalesce(2)


def chunks(spark, root):
    return sorted((r.path, r.ordinal, tuple(r.path_in_object or ()), r.content) for r in J.version_chunks(Z.view(spark, root)).collect())


def text(rng):
    return "\n".join(rng.choice(["# Head", "## Under", "words and words " * rng.randrange(9), "", "plain."]) for _ in range(rng.randrange(8)))


def test_builds_in_steps_equal_one_build(spark, tmp_path):
    """Edits, moves, copies, additions and deletions at random."""
    rng = random.Random(2)
    state = {f"d{k % 3}/f{k}.{rng.choice(['md', 'txt', 'rst', 'go'])}": text(rng) for k in range(30)}
    root = str(tmp_path / "steps")
    J.build(spark, root, files(spark, state), 60)
    for step in range(1):
        before = dict(state)
        for path in rng.sample(sorted(state), 20):
            kind = rng.randrange(4)
            if kind == 0:
                state[path] = text(rng)
            elif kind == 1:
                state[f"moved{step}/{path}"] = state.pop(path)
            elif kind == 2:
                state[f"copy{step}/{path}"] = state[path]
            else:
                del state[path]
        J.build(spark, root, files(spark, state), 60)
        whole = str(tmp_path / f"whole{step}")
        J.build(spark, whole, files(spark, state), 60)
        assert chunks(spark, root) == chunks(spark, whole)
        told = Z.view(spark, root).table("counts").first()
        taken = {p: t for p, t in state.items() if not p.endswith(".go")}
        assert told.carried == sum(before.get(p) == t for p, t in taken.items())
        assert told.carried + told.reused + told.created == len(taken)
        assert told.dropped == len([p for p in before if p not in state and not p.endswith(".go")])
    kept = chunks(spark, root)
    J.compacted(spark, root)
    assert chunks(spark, root) == kept
    used = {r.object_id for r in Z.view(spark, root).table("listing").collect()}
    assert {r.object_id for r in Z.view(spark, root).table("objects").collect()} == used


def test_unchanged_files_are_not_made_again(spark, tmp_path):
    """One part has what is new, and nothing else is made again."""
    state = {f"f{k}.md": f"# T{k}\ntext {k}" for k in range(40)}
    root = str(tmp_path / "r")
    hashed = files(spark, state).withColumn("hash", F.sha2("content", 256))
    J.build(spark, root, hashed)
    # the other contents differ too, but their hashes say that they don't
    changed = hashed.withColumn("hash", F.when(F.col("path") == "f7.md", "other").otherwise(F.col("hash"))).withColumn("content", F.concat("content", F.lit(" more")))
    J.build(spark, root, changed)
    v = Z.view(spark, root)
    assert tuple(v.table("counts").first()) == (39, 0, 1, 0, 1)
    assert v.table("chunks", only=["2"]).count() == 1 and len(chunks(spark, root)) == 40
    assert [c[0] for c in chunks(spark, root) if c[3].endswith("more")] == ["f7.md"]


def test_equal_contents_share_an_object(spark, tmp_path):
    root = str(tmp_path / "r")
    J.build(spark, root, files(spark, {"a.md": "same", "b.md": "same", "c.txt": "same", "d.md": None}))
    rows = {r.path: r.object_id for r in Z.view(spark, root).table("listing").collect()}
    assert rows["a.md"] == rows["b.md"] == rows["c.txt"] != rows["d.md"]
    assert [r[0] for r in chunks(spark, root) if r[3]] == ["a.md", "b.md", "c.txt"]
    J.build(spark, root, files(spark, {"x.md": "x"}).limit(0))
    assert chunks(spark, root) == [] and Z.view(spark, root).table("counts").first().dropped == 4


def naive_match(path, pattern):
    """Component by component, as the patterns are meant."""
    anchored, only_below = "/" in pattern.rstrip("/"), pattern.endswith("/")
    want, have = pattern.strip("/").split("/"), path.split("/")

    def one(p, name):
        return re.fullmatch("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", p)), name) is not None

    def fits(i, j):
        if i == len(want):
            return not only_below if j == len(have) else True
        if want[i] == "**":
            return (i + 1 == len(want) and j < len(have)) or any(fits(i + 1, k) for k in range(j, len(have) + 1) if i + 1 < len(want))
        return j < len(have) and one(want[i], have[j]) and fits(i + 1, j + 1)

    return any(fits(0, j) for j in ([0] if anchored else range(len(have))))


def test_patterns_meet_paths_as_a_matcher_of_components_says(spark):
    rng = random.Random(4)
    parts = ["a", "b", "a.md", "LICENSE", "x+y", "a.b.md", "c(1)", "d"]
    paths = sorted({"/".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(150)})
    patterns = ["*.md", "LICENSE*", "/a/**/*.md", "a/*", "/b/?/*", "x+y", "**/a.md", "a/**", "c(1)/", "/a", "*", "a.?.md", "d/**/b/*.md", "/b/", "a?md", "**"]
    found = S.matching(spark.createDataFrame([(r, p) for r in "rs" for p in paths], "repository string, path string"), spark.createDataFrame([("r", p) for p in [*patterns, "", "*.md"]], "repository string, pattern string"))
    got = sorted((r.path, r.pattern) for r in found.collect())
    assert got == sorted((path, p) for path in paths for p in patterns if naive_match(path, p)) and len(got) > 300


def test_files_are_those_below_the_package_folder(spark):
    packages = spark.createDataFrame([("r", "node", "x", "packages/x"), ("r", "node", "y", "packages/y"), ("r", "go", "m", "")], "repository string, ecosystem string, package string, folder string")
    paths = ["package.json", "go.mod", "packages/x/package.json", "packages/x/a.md", "packages/x/in/package.json", "packages/x/in/b.md", "packages/y/c.md", "packages/go.mod", "d.md"]
    tree = spark.createDataFrame([("r", p) for p in paths], "repository string, path string")
    manifests = spark.createDataFrame([("r", "package.json", "root"), ("r", "packages/x/package.json", "x"), ("r", "packages/x/in/package.json", "z")], "repository string, path string, name string")
    got = {}
    for r in S.files_of_packages(packages, tree, manifests).collect():
        got.setdefault(r.package, set()).add(r.path)
    assert got == {"x": {"packages/x/package.json", "packages/x/a.md"}, "y": {"packages/y/c.md"}, "m": {"package.json", "go.mod", "d.md"}}


def test_contents_are_written_twice_and_not_shuffled(spark, tmp_path, monkeypatch):
    """Once as objects and once as chunks, for all that is new; where keys are too many to be broadcast, contents meet them in one shuffle."""
    rng = random.Random(6)
    state = {f"f{k}.md": f"# T{k}\n" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(20_000)) for k in range(60)}
    state |= {f"copy{k}.md": state["f1.md"] for k in range(3)}
    moved = {f"in/{p}" if p.startswith("f2") else p: t + ("\n# more\nx" if p.startswith("f3") else "") for p, t in state.items()}
    size = sum(map(len, state.values()))

    def moves():
        summary = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(summary.apply(n).totalShuffleWrite() for n in range(summary.size()))

    def sizes(*folders):
        return {p: p.stat().st_size for d in folders for p in Path(d).rglob("*.parquet")}

    def built(name):
        root, shared = str(tmp_path / name), shared_dir(spark).removeprefix("file:")
        before, there = moves(), sizes(shared)
        J.build(spark, root, files(spark, state))
        shuffled, written = moves() - before, sum(n for p, n in sizes(shared, root).items() if p not in there)
        J.build(spark, root, files(spark, moved))
        return shuffled / size, written / size, chunks(spark, root), tuple(Z.view(spark, root).table("counts").first())

    shuffled, written, found, counts = built("few")
    assert shuffled < 0.2 and written < 2.8
    monkeypatch.setattr(W, "FEW_KEYS", 0)
    shuffled, _, again, counts_again = built("many")
    assert again == found and counts_again == counts
    assert 0.2 < shuffled < 2
