"""Streams over files, run in steps from a checkpoint, against the batch; exports against a walk over modules."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from quirework.operators import exports as Y
from quirework.streaming import changes as C

BEGAN = datetime.datetime(2024, 1, 1)


def later(seconds):
    return BEGAN + datetime.timedelta(seconds=seconds)


def streamed(spark, tmp_path, schema, batches, run):
    """The rows that a stream has sent on after every batch of files was there, one run of it a batch."""
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = run(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()  # the next run starts from the checkpoint
    return spark.read.parquet(sink).collect()


END = later(100_000)


def test_bursts_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(1)
    schema = "project string, path string, at timestamp"
    rows = [(rng.choice("pq"), rng.choice(["go.mod", "go.sum", "package.json"]), later(rng.randrange(120) + k / 1000)) for k in range(60)]
    late = sorted(rows, key=lambda r: r[2])
    batches = [late[:25], late[28:40], late[25:28] + late[40:], [("p", "end", END), ("q", "end", END)], [("p", "end", END + datetime.timedelta(hours=9))]]
    found = streamed(spark, tmp_path, schema, batches, lambda s: C.debounced(s, "project", "at", "path", "3 seconds", "1 minute"))
    want = C.debounced(spark.createDataFrame(rows, schema), "project", "at", "path", "3 seconds").collect()
    got = [r for r in found if r.started < END]
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 8


def test_runs_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(2)
    schema = "project string, rebuild boolean, offline boolean, force boolean, resolve boolean, names array<string>, at timestamp"
    rows = sorted(((rng.choice("pq"), rng.random() < 0.3, rng.random() < 0.5, rng.random() < 0.2, rng.random() < 0.2, rng.choice([[], ["a"], ["b", "a"], ["c"]]), later(rng.randrange(200) + k / 1000)) for k in range(60)), key=lambda r: r[6])
    end = [(p, b, True, False, False, ["z"], END) for p in "pq" for b in (False, True)]
    batches = [rows[:20] + rows[22:24], rows[20:22] + rows[24:], end, [(*end[0][:6], END + datetime.timedelta(hours=9))]]
    found = streamed(spark, tmp_path, schema, batches, lambda s: C.coalesced(s, "at", "4 seconds", "2 minutes"))
    df = spark.createDataFrame(rows, schema)
    want = C.coalesced(df, "at", "4 seconds").collect()
    assert sorted(map(repr, (r for r in found if r.started < END))) == sorted(map(repr, want)) and len(want) > 10
    everything = C.coalesced(df, "at", "1 day").drop("started").collect()
    assert sorted(map(repr, everything)) == sorted(map(repr, C.merge_requests(df).collect()))  # one long wait is one run


def test_manifest_events_are_direct_children_of_the_root(spark):
    events = spark.createDataFrame([("p", "/r/go.mod", "write"), ("p", "/r/sub/go.mod", "write"), ("p", "/r/main.go", "write"), ("p", "/r/go.sum", "chmod"), ("q", "/r/go.mod", "write"), ("s", "/s/uv.lock", "rename")], "project string, path string, op string")
    roots = spark.createDataFrame([("p", "/r/"), ("s", "/s")], "project string, root string")
    assert sorted((r.project, r.path) for r in C.manifest_events(events, roots).collect()) == [("p", "/r/go.mod"), ("s", "/s/uv.lock")]


def naive_exports(definitions, imports, listed, hops):
    def defs(module, stub):
        out = {}
        for m, s, _, name, kind, signature, doc in sorted(definitions, key=lambda d: d[2]):
            if m == module and s == stub:
                out[name] = [kind, signature, doc]
        return out

    def borrowed(module):
        return {name: (source, original) for m, _, name, source, original in sorted(imports, key=lambda i: i[1]) if m == module}

    own = defs(Y.ENTRY, False)
    for name, (kind, signature, doc) in defs(Y.ENTRY, True).items():
        own[name] = [own[name][0], signature, own[name][2] or doc] if name in own else [kind, signature, doc]
    names = listed if listed is not None else [n for n in [*own, *borrowed(Y.ENTRY)] if not n.startswith("_") or n == "__init__"]
    out = []
    for name in dict.fromkeys(names):
        if name in own:
            out.append((name, *own[name], Y.ENTRY))
            continue
        at = borrowed(Y.ENTRY).get(name)
        for _ in range(hops):
            if at is None:
                break
            module = at[0] or at[1]
            if at[1] in defs(module, False):
                out.append((name, *defs(module, False)[at[1]], module))
                break
            at = borrowed(module).get(at[1])
    return out


def test_exports_equal_a_walk_over_the_modules(spark):
    """Several packages with stubs, lists, chains of imports and cycles, at one hop and more."""
    rng = random.Random(3)
    modules = [Y.ENTRY, "a", "b", "c"]
    packages = {}
    for p in range(40):
        definitions = [(rng.choice(modules), rng.random() < 0.3, k, rng.choice(["f", "g", "h", "a", "_x", "__init__"]), "function", f"s{k}", rng.choice(["", f"d{k}"])) for k in range(rng.randrange(9))]
        imports = [(rng.choice(modules), 100 + k, rng.choice(["f", "g", "k", "_y", "c"]), rng.choice([None, "a", "b", "c"]), rng.choice(["f", "g", "k", "a", "c"])) for k in range(rng.randrange(9))]
        packages[p] = (definitions, imports, rng.choice([None, None, ["g", "k", "f", "g", "nowhere"]]))
    d = spark.createDataFrame([(p, *r) for p, (rows, _, _) in packages.items() for r in rows], "package int, module string, stub boolean, ordinal int, name string, kind string, signature string, doc string")
    i = spark.createDataFrame([(p, *r) for p, (_, rows, _) in packages.items() for r in rows], "package int, module string, ordinal int, name string, source string, original string")
    n = spark.createDataFrame([(p, names) for p, (_, _, names) in packages.items() if names is not None], "package int, names array<string>")
    for hops in (1, 3):
        got = {p: [] for p in packages}
        for r in sorted(Y.exports(d, i, n, hops).collect(), key=lambda r: (r.package, r.position)):
            got[r.package].append((r.name, r.kind, r.signature, r.doc, r.found_in))
        assert got == {p: naive_exports(*rows, hops) for p, rows in packages.items()}
