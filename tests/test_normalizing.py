"""Normalisers, dispatch, prompts and discovery of files on literal inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions.markdown import outline, sections
from quirework.operators import embedding as E
from quirework.operators import normalizing as N
from quirework.sources import discovery as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'int'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_outline_of_headings_code_and_links():
    text = "### Sponsor\nsee <https://auto.example/a>\n# Real *Title*\n## Install\n```go\n# not a heading\na < b\n```\n#### Deep `code`\nUnder\n-----\n[one](http://x/1 \"t\") [two][R] `[no](x)` ![i](i.png) \\[no](y)\n\n[r]: http://x/2\n~~~\n"
    got = outline(text)
    assert got["title"] == "Real Title"
    assert got["headings"] == ["Sponsor", "Real Title", "Real Title > Install", "Real Title > Install > Deep code", "Real Title > Under"]
    assert got["languages"] == ["go"]
    assert got["links"] == ["https://auto.example/a", "http://x/1", "http://x/2"]
    assert json.loads(got["code_blocks"]) == [
        {"index": 0, "language": "go", "content": "# not a heading\na < b\n", "section_path": ["Real Title", "Install"]},
        {"index": 1, "language": "", "content": "", "section_path": ["Real Title", "Under"]},
    ]
    assert "a \\u003c b" in got["code_blocks"]
    assert outline("```\nno title") == {"title": "", "headings": [], "languages": [], "links": [], "code_blocks": '[{"index":0,"language":"","content":"no title","section_path":null}]'}


def by_lines(text):
    """The rules of sections, line by line."""
    out, head, path, body, fence = [], "", (), [], None
    for line in [*text.split("\n"), None]:
        level = 0
        if line is not None:
            marker = line.strip()[:3] if line.strip()[:3] in ("```", "~~~") else None
            if marker:
                fence = marker if fence is None else None if fence == marker else fence
            elif fence is None and line.startswith("#"):
                level = len(line) - len(line.lstrip("#"))
                level = level if level <= 6 and line[level : level + 1] in (" ", "\t") and line[level:].strip() else 0
        if level or line is None:
            if head or "\n".join(body).strip():
                out.append((head, list(path) or None, "\n".join(body).strip()))
            if level:
                head, body = line, []
                path = (*path[: level - 1], line[level:].strip().rstrip("#").strip() or "#")
        else:
            body.append(line)
    return out


def test_sections_equal_the_rules_on_random_lines():
    import random

    rng = random.Random(3)
    lines = ["# a", "## b ##", "### c", "#no", "####### d", "```", "~~~ x", "  ```go", "text", "", " # e", "#\tf", "# #"]
    for _ in range(3000):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))
        assert list(sections(text)) == by_lines(text), text


def test_sections_of_very_long_texts_take_linear_time():
    for text in ("# " + "#" * 500_000 + "x", "```\n" * 250_000, "# a\n" * 250_000, "\n" * 1_000_000):
        assert sum(1 for _ in sections(text)) <= 250_000


def files(spark, *rows):
    return spark.createDataFrame([(p, s, i, c) for p, s, i, c in rows], "path string, source_type string, include_license boolean, content binary")


def test_files_are_taken_by_the_first_normaliser(spark):
    rows = [("a/CHANGELOG.md", None, None), ("History.TXT", "git", False), ("x.md", "github-releases", False), ("d/readme.MDX", "git", None), ("n.rst", None, None), ("LICENSE", None, None), ("LICENSE-MIT", None, True), ("license.txt", None, False), ("a.go", None, None), ("", None, None)]
    df = spark.createDataFrame(rows, "path string, source_type string, include_license boolean")
    got = [r.n for r in df.select(N.normalizer(F.col("path"), F.col("source_type"), F.col("include_license")).alias("n")).collect()]
    assert got == ["release-notes"] * 3 + ["markdown", "plaintext", None, "plaintext", "plaintext", None, None]
    kinds = spark.createDataFrame([(k,) for k in ("markdown", "text", "symbol_doc", "package_doc", "html")], "k string").select(N.chunker(F.col("k")).alias("c")).collect()
    assert [r.c for r in kinds] == ["sections", "sections", "symbols", "symbols", None]


def test_normalized_objects(spark):
    made = N.normalized(
        files(
            spark,
            ("docs/a.md", "git", None, b"intro\r\n# T\r\n[l](u)"), ("b.md", "git", None, b" \n"), ("c.txt", "git", None, "\u2003 hi \xa0\n".encode()), ("d.txt", "git", None, b"a\xff\xfe\xffb"),
            ("CHANGELOG.md", "git", None, b"# Changes\n## v1.2.3 (today)\n## 1.2.2"), ("changes.txt", "git", None, b"# v1.0.0"), ("notes", "github-releases", None, b"# 2.0.0"), ("e.txt", None, None, None), ("f.go", None, None, b"x"),
        )
    )
    got = {r.path: (r.normalizer, r.content_type, r.title, r.content, r.metadata) for r in made.collect()}
    assert got == {
        "docs/a.md": ("markdown", "markdown", "T", "intro\n# T\n[l](u)", {"headings": "T", "links": "u"}),
        "b.md": ("markdown", "markdown", "b.md", " \n", {"parse_warning": "true"}),
        "c.txt": ("plaintext", "text", "c.txt", "hi", {}),
        "d.txt": ("plaintext", "text", "d.txt", "a\ufffdb", {"invalid_utf8_replaced": "true"}),
        "CHANGELOG.md": ("release-notes", "markdown", "Changes", "# Changes\n## v1.2.3 (today)\n## 1.2.2", {"headings": "Changes|Changes > v1.2.3 (today)|Changes > 1.2.2", "content_type": "release_note", "release_version": "v1.2.3"}),
        "changes.txt": ("release-notes", "text", "changes.txt", "# v1.0.0", {"content_type": "release_note"}),
        "notes": ("release-notes", "markdown", "2.0.0", "# 2.0.0", {"headings": "2.0.0", "content_type": "release_note", "release_version": "2.0.0"}),
        "e.txt": ("plaintext", "text", "e.txt", "", {}),
    }


def test_promoted_metadata_is_whole(spark):
    got = one(spark, N.promoted(F.create_map(F.lit("symbol"), F.col("s")), ["symbol", "signature"]), s="S")
    assert got == {"symbol": "S", "signature": ""}


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [("https://h.example/o/r.git", "h.example", "o/r"), ("https://u:p@h.example:8443/o/r/", "h.example:8443", "o/r"), ("git@h.example:o/r.git", "h.example", "o/r"), ("ssh://git@h.example/o/r", "h.example", "o/r"), ("/srv/mirrors/r.git", "local", "srv/mirrors/r")],
)
def test_git_repository(spark, url, host, path):
    assert tuple(one(spark, T.git_repository(F.col("u")), u=url)) == (host, path)


def test_sizes_names_and_point_ids(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1536: "1.5 KiB", 1 << 20: "1.0 MiB", (1 << 31) - 1: "2.0 GiB"}
    assert {n: one(spark, T.byte_size(F.col("n")), n=n) for n in sizes} == sizes
    names = {"a/b.md": "b.md", "a/b/": "b", "": ".", "//": "/", "c": "c"}
    assert {p: one(spark, T.basename(F.col("p")), p=p) for p in names} == names
    a, b = (one(spark, T.point_id(F.lit(g), F.col("c")), c="chunk") for g in ("g1", "g2"))
    assert a != b and a[14] == "5" and a[19] in "89ab" and [len(x) for x in a.split("-")] == [8, 4, 4, 4, 12]


def test_prompts_and_identity(spark):
    assert one(spark, E.query_prompt(F.col("t"), F.lit("a {q}")), t="q: {q}|{q}") == "q: a {q}|a {q}"
    assert one(spark, E.query_prompt(F.col("t"), F.lit("a")), t="") == "a"
    assert one(spark, E.document_prompt(F.col("t"), F.lit(""), F.lit("x {title}")), t="title: {title} | text: {text}") == "title: none | text: x {title}"
    assert one(spark, E.document_prompt(F.col("t"), F.lit("{text}"), F.lit("x")), t="{title}-{text}") == "{text}-x"
    assert one(spark, E.model_identity(F.col("m"), F.lit(0), F.lit(""), F.lit("")), m="m") == "m"
    h = 2166136261
    for byte in b"{q}\0{text}":
        h = (h ^ byte) * 16777619 % 2**32
    assert one(spark, E.model_identity(F.col("m"), F.lit(256), F.lit("{q}"), F.lit("{text}")), m="m") == f"m [256d, prompts {h:08x}]"
    assert one(spark, E.truncated(F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("n")), n=2) == [1, 2]
    assert one(spark, E.truncated(F.array(F.lit(1)), F.col("n")), n=0) == [1]


def test_cached_vectors_and_misses(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "c")], "id int, text string")
    key = lambda t: E.cache_key(F.lit(t), "p", "m")
    cache = spark.range(1).select(F.explode(F.array(F.struct(key("a").alias("key"), F.array(F.lit(1.0)).alias("vector")), F.struct(key("c").alias("key"), F.array().cast("array<double>").alias("vector")))).alias("r")).select("r.*")
    have, missing = E.cached(texts, cache, "p", "m")
    assert [(r.id, r.vector) for r in have.collect()] == [(1, [1.0])]
    assert sorted(r.text for r in missing.collect()) == ["", "b", "c"]
    assert E.cached(texts, cache, "p", "other")[0].count() == 0


def test_vector_states_and_faults(spark):
    pointers = spark.createDataFrame([("g1",), ("g2",), ("g3",), ("g4",)], "generation string")
    replicas = spark.createDataFrame([("g1", "m"), ("g2", "old"), ("g3", None), ("g9", "old")], "generation string, embedding_model string")
    assert {r.generation: r.vectors for r in E.vector_state(pointers, replicas, "m").collect()} == {"g1": "current", "g2": "stale", "g3": "none", "g4": "no replica"}
    points = spark.createDataFrame([("g1", [1.0, 2.0], "v1"), ("g1", [1.0], "v1"), ("g2", [1.0, 1.0], "v\0"), ("g3", [1.0, 1.0], "v1"), ("g3", [1.0, 1.0], "v2")], "generation string, vector array<double>, version string")
    assert sorted(tuple(r) for r in E.point_faults(points, 2, ["version"]).select("fault", "generation", "points").collect()) == [("dimensions", "g1", 1), ("nul in metadata", "g2", 1), ("two kinds of metadata", "g3", 2)]
    assert sorted(r.generation for r in E.unindexed(pointers, points).collect()) == ["g4"]


def test_folders_of_packages(spark):
    packages = spark.createDataFrame([("r", "core"), ("r", "gone"), ("s", "any"), ("t", "root")], "repository string, package string")
    manifests = spark.createDataFrame([("r", "packages/core/package.json", "core"), ("r", "zz/core/package.json", "core"), ("r", "package.json", "mono"), ("t", "package.json", "root")], "repository string, path string, name string")
    got = {(r.repository, r.package): (r.folder, r.verified, r.ambiguous) for r in S.node_folders(packages, manifests).collect()}
    assert got == {("r", "core"): ("packages/core", True, False), ("r", "gone"): ("", False, True), ("s", "any"): ("", False, False), ("t", "root"): ("", True, False)}
    python = spark.createDataFrame([("r", "Typing-Extensions"), ("r", "twice"), ("r", "none")], "repository string, package string")
    tree = spark.createDataFrame([("r", p) for p in ("src/typing_extensions/__init__.py", "a/twice/__init__.py", "b/twice/__init__.py", "__init__.py", "x.py")], "repository string, path string")
    assert {r.package: (r.folder, r.verified) for r in S.python_folders(python, tree).collect()} == {"Typing-Extensions": ("src/typing_extensions", True), "twice": ("", False), "none": ("", False)}


def test_files_of_packages_stop_at_borders(spark):
    packages = spark.createDataFrame([("r", "go", "m"), ("n", "node", "core")], "repository string, ecosystem string, package string")
    paths = ["go.mod", "README.md", "sub/go.mod", "sub/a.md", "sub/deep/b.md", "vendor/c.md", "subway/d.md", "x/node_modules/e.md", "other/f.md"]
    tree = spark.createDataFrame([(r, p) for r in "rn" for p in paths], "repository string, path string")
    manifests = spark.createDataFrame([("n", "package.json", "mono"), ("n", "other/package.json", "other"), ("n", "subway/package.json", "core"), ("r", "other/package.json", "other")], "repository string, path string, name string")
    got = {}
    for r in S.files_of_packages(packages, tree, manifests).collect():
        got.setdefault(r.package, set()).add(r.path)
    assert got == {"m": {"go.mod", "README.md", "subway/d.md", "other/f.md"}, "core": {"go.mod", "README.md", "subway/d.md"}}


def test_patterns(spark):
    assert one(spark, S.sparse_patterns(F.col("e")), e="go") == [*S.DOCUMENTS, "*.go", "go.mod"]
    assert one(spark, S.sparse_patterns(F.col("e")), e="rust") == S.DOCUMENTS
    assert one(spark, S.below(F.array(F.lit("*.md")), F.col("f")), f="packages/a") == ["/packages/a/**/*.md"]
    assert one(spark, S.below(F.array(F.lit("*.md")), F.col("f")), f="") == ["*.md"]


def test_headings_in_html_quotes_and_lists():
    from quirework.functions.markdown import outline

    def heads(text):
        return outline(text)["headings"]

    assert outline("<div>\n# html\n\n# Real")["title"] == "Real"
    assert heads("<!-- # no\n# no\n-->\n# Yes") == ["Yes"]
    assert heads("<script>\n# no\n\n# still no\n</script>\n# Yes") == ["Yes"] and heads("<PRE>\n# no") == []
    assert heads("# A\n<custom-tag a='1'>\n# B") == ["A", "B"]  # within a paragraph or after a heading line it begins no block
    assert heads("<custom-tag a='1'>\n# B\n\n# C") == ["C"] and heads("a <b>x</b>\n# D") == ["D"]
    assert heads("> # Quoted\n> > ## Deep\n- # Item\n1. ## One") == ["Quoted", "Quoted > Deep", "Item", "Item > One"]
    assert outline("<p>\n[a](b)\n</p>\n\n[c](d)")["links"] == ["d"]
    assert heads("<?php\n# no\n?>\n<!DOCTYPE x>\n# Yes\n<![CDATA[\n# no\n]]>") == ["Yes"]
    assert heads("text\n</table\n# no\n\n# Yes") == ["Yes"]
