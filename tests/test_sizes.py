"""Steps whose memory or shuffle must not grow with more than the input."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quirework.functions.text import search_terms
from quirework.operators import callsites as K
from quirework.operators import documents as D
from quirework.operators import index as X
from quirework.operators import retrieval as R


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([("s", 1, "aa bb aa fooBar"), ("s", 2, None), (None, 3, "bb ?!")], "scope string, id int, text string")
    got = R.term_frequency(R.tokenized(docs, "scope", "id", "text"))
    assert "Exchange" not in _plan(got)
    want = [("None", 3, 1, "bb", 1), ("s", 1, 6, "aa", 2), ("s", 1, 6, "bar", 1), ("s", 1, 6, "bb", 1), ("s", 1, 6, "foo", 1), ("s", 1, 6, "foobar", 1)]
    assert sorted((str(r.scope), r.id, r.length, r.term, r.tf) for r in got.collect()) == want


def test_counts_of_lists_in_pieces(monkeypatch):
    monkeypatch.setattr(X, "COUNT_TERMS", 4)
    lists = [["b", "a", "b"], [], None, ["c"] * 9, ["a", "c"], ["b"]]
    (got,) = X._term_counts([pa.array(lists, pa.list_(pa.string()))])
    assert [{c["term"]: c["tf"] for c in x} for x in got.to_pylist()] == [{t: (x or []).count(t) for t in x or []} for x in lists]


def test_a_table_of_scores_is_a_tile():
    """4,000 queries with 10,000 points are 320 MB at once, more with what is made from them."""
    rng = np.random.default_rng(3)
    units, m = R._units(rng.normal(size=(4000, 4))), R._units(rng.normal(size=(10_000, 4)))
    found = R._Nearest(len(units), 3)
    tracemalloc.start()
    R._by_tiles(found, units, np.arange(len(units)), m, np.arange(len(m)), np.arange(len(m)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    q, score, ids = found.cut()
    assert peak < 120e6
    for n in (0, 1777, 3999):
        full = np.round(m @ units[n], R.DECIMALS)
        best = np.lexsort((np.arange(len(m)), -full))[:3]
        assert ids[q == n].tolist() == best.tolist() and np.allclose(score[q == n], full[best], atol=1e-6)


def test_sections_are_made_a_few_texts_at_a_time(monkeypatch):
    texts = ["x" * 20_000 + "\n# h\nb"] * 2000 + [None, ""]
    tracemalloc.start()
    got = D._sections(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and len(got) == 2002 and [s["ordinal"] for s in got[1999].as_py()] == [0, 1] and got[2001].as_py() == []


def test_a_position_asks_the_levels_that_ranges_have(spark, monkeypatch):
    """All uses are of one length: a position has one probe, not one of each of 15 levels."""
    seen = []
    monkeypatch.setattr(K, "join_back", lambda rows, summed, key: seen.append(summed) or rows.join(summed, key))
    uses = spark.createDataFrame([(u, "f", u, 0, u, 9) for u in range(20)], "use_id int, file string, line int, column int, end_line int, end_column int")
    sites = spark.createDataFrame([(7, "f", 3, 4), (8, "f", 3, 9)], "site_id int, file string, line int, column int")
    assert [tuple(r) for r in K.innermost(sites, uses).collect()] == [(7, 3)]
    assert seen[0]._jdf.queryExecution().analyzed().toString().count("shiftright(") == 3  # both ends of a range, one probe


def test_pooled_questions_pass_over_points_without_a_shuffle(spark, tmp_path):
    """Each block of questions read all postings and shuffled them; now only the best hits are. Ties, replaced and deleted points, empty and null texts."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(40)]
    texts = {n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randrange(30))) for n in range(150)} | {150: None, 151: "", 152: "w1 w1", 153: "w1 w1"}
    kind = "scope string, id string, text string"
    root = str(tmp_path / "index")
    X.upsert(spark, root, spark.createDataFrame([(f"s{n % 3}", f"d{n}", "w3 old" if n == 7 else t) for n, t in texts.items()], kind))
    X.upsert(spark, root, spark.createDataFrame([("s1", "d7", texts[7])], kind))
    X.delete(spark, root, spark.createDataFrame([("d9",), ("d30",)], "id string"))
    live = {f"d{n}": Counter((t or "").split()) for n, t in texts.items() if n not in (9, 30)}
    average = sum(c.total() for c in live.values()) / len(live)
    df = Counter(t for c in live.values() for t in c)
    want = []
    for q in (q for q in texts if q % 2 == 0):
        asked, scored = set((texts[q] or "").split()), []
        for d, c in live.items():
            hit = [math.log(1 + (len(live) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / average)) for t in asked & c.keys()]
            scored += [(-round(sum(hit), 6), d)] if hit else []
        want += [(q, d, -s, r + 1) for r, (s, d) in enumerate(sorted(scored)[:9])]
    rows = [(q, t) for q, t in texts.items() if q % 2 == 0]
    questions = spark.createDataFrame([*rows, rows[1]], "query_id int, text string")  # one stands twice
    for block_bytes in (None, 1500):
        got = R.bm25(X.opened(spark, root), questions, 9, pooled=True, **({"block_bytes": block_bytes} if block_bytes else {}))
        assert block_bytes is None or _plan(got).count("Exchange") == 1
        assert sorted((r.query_id, r.id, round(r.score, 6), r.rank) for r in got.collect()) == sorted(want)


def test_a_table_is_the_sum_of_dense_and_sparse_terms(monkeypatch):
    """Whatever share of the terms is dense, and however few cells are summed up at once."""
    rng = np.random.default_rng(8)
    fill = 1 / (np.arange(60) + 1)
    asks, has = rng.random((700, 60)) < fill, rng.random((60, 90)) < fill[rng.permutation(60)][:, None]
    has[:5] = False
    value = np.where(has, rng.random((60, 90)), 0)
    q, t = np.nonzero(asks)
    rows = pa.table({"query_id": q + 1000, "term": [f"t{n}" for n in t], "idf": t / 10})
    names, terms, idf, groups = R._packed(rows)
    number = {x: n for n, x in enumerate(terms.to_pylist())}
    code, docs = np.nonzero(has)
    known = [n for n, c in enumerate(code) if f"t{c}" in number]
    of = np.array([number[f"t{code[n]}"] for n in known])
    by = np.argsort(of, kind="stable")
    there, cuts = np.unique(of[by], return_index=True)
    docs, parts = docs[known][by], value[code[known], docs[known]][by]
    for dense, cells in ((0, 1 << 21), (0.02, 64), (0.02, 1 << 21), (2, 1), (2, 1000)):
        monkeypatch.setattr(R, "DENSE", dense)
        monkeypatch.setattr(R, "CELLS", cells)
        got = np.concatenate([R._table(there, np.append(cuts, len(of)), docs, parts, 90, g) for g in groups])
        assert np.allclose(got, asks[names.to_numpy() - 1000] @ value)
    assert len(groups) == 2 and all(idf[number[f"t{n}"]] == n / 10 for n in set(t))


def _most_rows(node, kinds: str) -> int:
    """The most rows that a node of some kinds in a plan has made."""
    below = node.children()
    mine = [int(node.metrics().apply("numOutputRows").value())] if any(k in node.nodeName() for k in kinds.split()) else []
    return max(mine + [_most_rows(below.apply(n), kinds) for n in range(below.size())], default=0)


def test_a_position_meets_arrays_of_ranges_and_no_row_a_range(spark, monkeypatch):
    """Each pair of a position and a range around it was a row, sorted to find the best. Crowded bins in several arrays, equal ranges, payloads."""
    uses = [(f"u{u:03}", "f", 100 - u % 90, 0, 100 + u % 90, 5, f"m{u % 7}" if u % 90 else "", "", f"s{u}") for u in range(300)] + [("u0", "f", 100, 0, 100, 5, "m3", "go", "best"), ("none", None, 1, 0, 9, 0, "m", "", "s")]
    sites = [(s, "f", 100 + s // 50, s % 2 * 7, "p", "") for s in range(200)] + [(900, None, 100, 0, "p", "")]
    uses = spark.createDataFrame(uses, "use_id string, file string, line int, column int, end_line int, end_column int, module string, ecosystem string, symbol string")
    sites = spark.createDataFrame(sites, "site_id int, file string, line int, column int, project string, text string")
    dependencies = spark.createDataFrame([("p", 2, "go", "m3", "v1"), ("p", 1, "js", "m3", "v2"), ("q", 0, "go", "m3", "v9")], "project string, ordinal int, ecosystem string, package string, version string")
    pointers = spark.createDataFrame([("go", "m3", "v1", "g1"), ("js", "m3", "v9", "g9")], "ecosystem string, package string, version string, generation string")
    found = {}
    for s in sites.filter("file is not null").collect():
        around = [((r.end_line - r.line) * K.COLUMNS + r.end_column - r.column, -(r.line * K.COLUMNS + r.column), r.use_id, r) for r in uses.filter("file = 'f'").collect() if (r.line, r.column) <= (s.line, s.column) < (r.end_line, r.end_column)]
        if around:
            found[s.site_id] = min(around)[3]
    joined = []
    monkeypatch.setattr(K, "join_back", lambda rows, summed, key: joined.append(summed) or rows.join(summed, key))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (1024, 7):
            monkeypatch.setattr(K, "USES", n)
            assert {r.site_id: r.use_id for r in K.innermost(sites, uses).collect()} == {s: u.use_id for s, u in found.items()}
            got = {r.site_id: (r.symbol, r.version, r.generation) for r in K.resolved_sites(sites, uses, dependencies, pointers).collect()}
            version = {"go": ("v1", "g1"), "": ("v2", None)}
            assert got == {s: (u.symbol, *(version[u.ecosystem] if u.module == "m3" else (None, None))) for s, u in found.items() if u.module}
        joined[0].collect()
        assert len(found) == 200 and _most_rows(joined[0]._jdf.queryExecution().executedPlan(), "Join") <= 40  # 8 positions, four levels at most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cells_are_summed_up_a_few_documents_at_a_time():
    """The cells of rare terms were up to 2,097,152 at once over all of a slice: here 63 MB."""
    rng = np.random.default_rng(4)
    asks, has = rng.random((512, 3000)) < 0.03, rng.random((3000, 1024)) < 0.05
    q, t = np.nonzero(asks)
    *_, groups = R._packed(pa.table({"query_id": np.append(np.arange(512), q), "term": ["first"] * 512 + [f"t{n:04}" for n in t], "idf": np.ones(512 + len(q))}))
    code, docs = np.nonzero(has)  # terms are numbered as they come
    number = {x: n for n, x in enumerate(dict.fromkeys(["first"] + [f"t{n:04}" for n in t]))}
    of = np.array([number[f"t{n:04}"] for n in code])
    by = np.argsort(of, kind="stable")
    there, cuts = np.unique(of[by], return_index=True)
    tracemalloc.start()
    got = R._table(there, np.append(cuts, len(of)), docs[by], np.ones(len(of)), 1024, groups[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and np.allclose(got, asks.astype(float) @ has)


def test_questions_and_documents_of_a_kind_are_scored_together(monkeypatch):
    """Questions of two languages that come in turn were in the same tables; the best are the same whatever the order and however few at a time."""
    rng = random.Random(6)
    words = [[f"{x}{n}" for n in range(60)] for x in "ab"]
    texts = [Counter(rng.choices(words[n % 2], [1 / (k + 1) for k in range(60)], k=rng.randrange(5, 40))) for n in range(300)]
    df = Counter(t for c in texts for t in c)
    idf = {t: math.log(1 + (300 - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    rows = pa.table({"query_id": [q for q in range(120) for _ in texts[q]], "term": [t for q in range(120) for t in texts[q]], "idf": [idf[t] for q in range(120) for t in texts[q]]})
    average = sum(c.total() for c in texts) / 300
    batch = pa.record_batch([pa.array(range(300)), pa.array([c.total() for c in texts]), pa.array([[{"term": t, "tf": n} for t, n in c.items()] for c in texts], pa.list_(pa.struct({"term": pa.string(), "tf": pa.int32()})))], ["id", "length", "counts"])
    want = set()
    for q in range(120):
        scored = [(-round(sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / average)) for t in texts[q].keys() & c.keys()), 6), d) for d, c in enumerate(texts)]
        want |= {(q, d, -s) for s, d in sorted(x for x in scored if x[0])[:7]}

    class Sent:
        value = None

    for kinds, questions, slice_docs, postings in ((16, 512, 1024, 1 << 22), (2, 60, 50, 700), (1, 7, 33, 1)):
        for name, n in (("KINDS", kinds), ("QUESTIONS", questions), ("SLICE_DOCS", slice_docs), ("POSTINGS", postings)):
            monkeypatch.setattr(R, name, n)
        Sent.value = R._sent(rows)
        found = [tuple(r.values()) for b in R._point_scores(Sent, 7, average)(iter([batch.slice(0, 1), batch.slice(1, 0), batch.slice(1)])) for r in b.to_pylist()]
        assert {(q, d, round(s, 6)) for q, d, s in found} == want and len(found) == len(want)
        if kinds == 2:
            (names, *_), *_ = Sent.value
            assert [len({q % 2 for q in names.to_pylist()[a : a + 60]}) for a in (0, 60)] == [1, 1]


def test_distinct_words_are_looked_up_once_and_give_the_terms_of_the_column(spark, monkeypatch):
    """Each word of a text was taken apart in the JVM, however often it stands there."""
    rng = random.Random(9)
    letters = ["a", "B", "é", "Σ", "İ", "ß", "ǅ", "Ⅳ", "٣", "7", "𐐡", "𐑉", "中", "-", ".", "_", "/", "z"]
    words = ["The", "HTTPServer", "fooBar.baz_QUX", "x", "a.b", "x" * 65, "İstanbul", "ΟΔΟΣ"] + ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(3000)]
    texts = [(n, " ".join(rng.choices(words, k=rng.randrange(60)))) for n in range(300)] + [(300, None), (301, ""), (302, "?!"), (303, "the " * 50)]
    docs = spark.createDataFrame([("s", n, t) for n, t in texts], "scope string, id int, text string").repartition(3)
    want = {r.id: (r.length, {c.term: c.tf for c in r.counts}) for r in X.counted(docs.select("scope", "id", search_terms(docs.text).alias("terms"))).collect()}
    asked = []
    real = X.terms_of_word
    monkeypatch.setattr(X, "terms_of_word", lambda w: asked.append(w) or real(w))
    got = {r.id: (r.length, {c.term: c.tf for c in r.counts}) for r in X.counted_texts(docs).collect()}
    assert got == want and len(want) == 304
    for most in (1 << 20, 4):
        monkeypatch.setattr(X, "COUNT_TERMS", most)
        (told,) = X._word_counts([pa.array([["ab", "The", "fooBar", "ab"], [], None, ["ab"], ["the"]], pa.list_(pa.string()))])
        assert told.to_pylist()[0] == {"length": 5, "counts": [{"term": t, "tf": n} for t, n in (("ab", 2), ("foobar", 1), ("foo", 1), ("bar", 1))]}
        assert [t["length"] for t in told.to_pylist()[1:]] == [0, 0, 1, 0]
        assert most == 4 or sorted(asked) == ["The", "ab", "fooBar", "the"]


def test_a_search_over_all_scopes_needs_no_postings(spark, tmp_path):
    """The postings of all points were written, shuffled and sorted to count in how many points a term is."""
    kind, root, whole = "scope string, id int, text string", str(tmp_path / "bare"), str(tmp_path / "whole")
    steps = [[("s", 1, "aa bb"), ("t", 2, "bb cc cc")], [("s", 3, None), ("s", 4, "?")], [("s", 1, "cc"), ("t", 5, "aa cc")]]
    questions = spark.createDataFrame([(1, "aa cc"), (2, "bb"), (3, "zz")], "query_id int, text string")

    def hits(at: str, **how) -> list:
        return sorted((r.query_id, r.id, r.score, r["rank"]) for r in R.bm25(X.opened(spark, at), questions, **how).collect())

    for n, rows in enumerate(steps):
        X.upsert(spark, whole, spark.createDataFrame(rows, kind))
        X.upsert(spark, root, spark.createDataFrame(rows, kind), postings=n == 1)
        assert hits(root, pooled=True) == hits(whole, pooled=True) != []
    assert "postings" not in {p.name.split("-")[0] for p in (tmp_path / "bare" / "data").iterdir() if any(f.suffix == ".parquet" for f in p.rglob("*"))}
    with pytest.raises(ValueError, match="postings"):
        R.bm25(X.opened(spark, root), questions)
    done = X.completed(spark, root)
    assert X.completed(spark, root).version == done.version  # nothing left to do
    assert hits(root) == hits(whole) != [] and hits(root, pooled=True) == hits(whole, pooled=True)
    X.upsert(spark, root, spark.createDataFrame([("t", 6, "bb")], kind), postings=False)
    X.upsert(spark, whole, spark.createDataFrame([("t", 6, "bb")], kind))
    X.merge(spark, root)
    assert hits(root) == hits(whole) and hits(root, pooled=True) == hits(whole, pooled=True)


def test_hits_are_shuffled_by_as_many_tasks_as_cores(spark, tmp_path, monkeypatch):
    """Each file's task shuffled its k best of each question, which grew with the square of the input."""
    root = str(tmp_path / "index")
    monkeypatch.setattr(X, "FILE_POINTS", 10)
    monkeypatch.setattr(R, "TASKS", 1)
    X.upsert(spark, root, spark.range(400).selectExpr("'s' AS scope", "id", "concat('aa w', id % 40) AS text").repartition(8))
    seen = []
    monkeypatch.setattr(R, "top_k", lambda hits, by, k: seen.append(hits) or hits)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        R.bm25(X.opened(spark, root), spark.createDataFrame([(1, "aa")], "query_id int, text string"), 5, pooled=True)
        assert seen[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
