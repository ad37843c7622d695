"""Lock files, project folders, tags and change lists on small literal inputs."""

from __future__ import annotations

import json

from quirework.sources import lockfiles as L
from quirework.sources import registry as S


def files(spark, **named):
    return spark.createDataFrame([("/p", f"/p/{k}", v) for k, v in named.items()], "root string, path string, content string")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_projects_are_found_below_the_root_only(spark):
    paths = ["/x/build/a/go.mod", "/x/build/a/vendor/go.mod", "/x/build/b/package.json", "/x/build/c/Cargo.toml", "/x/build/c/notes.txt", "/x/build/d/uv.lock"]
    kept = L.kept_files(spark.createDataFrame([(p, "") for p in paths], "path string, content string"), "/x/build")
    assert rows(kept, "root") == [("/x/build/a",), ("/x/build/b",), ("/x/build/c",), ("/x/build/d",)]
    assert rows(L.detected_projects(kept), "root", "ecosystem") == [("/x/build/a", "go"), ("/x/build/b", "node"), ("/x/build/c", "rust")]


def test_preferred_lock_file(spark):
    kept = L.preferred(files(spark, **{"uv.lock": "", "requirements.txt": "", "yarn.lock": "", "package-lock.json": ""}))
    assert rows(kept, "path") == [("/p/uv.lock",), ("/p/yarn.lock",)]


def test_go_module_list(spark):
    listed = "\n".join(
        json.dumps(m)
        for m in (
            {"Path": "me", "Main": True},
            {"Path": "a", "Version": "v1"},
            {"Path": "b", "Version": "v1", "Indirect": True, "Replace": {"Path": "c", "Version": "v2"}},
            {"Path": "d", "Version": "v3", "Replace": {"Path": "../d"}},
        )
    )
    got = rows(L.go_modules(files(spark, out=listed)), "name", "version", "direct", "resolved_by")
    assert got == [("a", "v1", True, "go-list"), ("b", "v2", False, "replace:c@v2"), ("d", "v3", True, "local:../d")]


def test_requirements(spark):
    text = "# pins\nFlask==2.0 ; python_version > '3'\nrequests>=1\n-r more.txt\n???\n\n"
    got = rows(L.requirements(files(spark, r=text)).na.fill(""), "line", "name", "version", "warning")
    assert got == [(1, "Flask", "2.0", ""), (2, "", "", "not an exact pin: requests"), (3, "", "", "include not followed: -r more.txt"), (4, "", "", "not recognised: ???")]


def test_npm_lock_and_its_errors(spark):
    good = {"lockfileVersion": 3, "packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "1.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0"}, "node_modules/l": {"resolved": "../l", "link": True}}}
    got = rows(L.npm_lock(files(spark, lock=json.dumps(good))), "name", "version", "direct", "resolved_by")
    assert got == [("@s/b", "2.0", False, "package-lock.json"), ("a", "1.0", True, "package-lock.json"), ("l", "", False, "package-lock.json:local:../l")]
    bad = files(spark, old=json.dumps({"lockfileVersion": 1, "packages": {}}), bare=json.dumps({"lockfileVersion": 3, "packages": {"node_modules/a": {"version": "1"}}}), junk="{")
    assert rows(L.npm_lock(bad), "path", "error") == [("/p/bare", "no root entry"), ("/p/junk", "no lock file"), ("/p/old", "lock file version 1")]


def test_locks_that_need_a_parser(spark):
    locks = {
        "poetry.lock": '[[package]]\nname = "a"\nversion = "1"\n[[package]]\nname = "g"\nversion = "2"\n[package.source]\ntype = "git"\nurl = "u"\nresolved_reference = "abc"\n',
        "uv.lock": '[[package]]\nname = "me"\nsource = { virtual = "." }\ndependencies = [{ name = "x" }]\n[[package]]\nname = "x"\nversion = "3"\n',
        "yarn.lock": '# v1\n"@s/y@^1", "@s/y@^2":\n  version "1.5"\n\nz@1:\n  version "1.0"\n',
        "bun.lock": '{ // comment\n "workspaces": {"": {"dependencies": {"k": "1"}}}, "packages": {"k": ["k@1.2", {}],}, }',
    }
    got = rows(L.parsed_locks(files(spark, **locks)), "path", "name", "version", "direct", "resolved_by")
    assert got == [
        ("/p/bun.lock", "k", "1.2", True, "bun.lock"),
        ("/p/poetry.lock", "a", "1", False, "poetry.lock"),
        ("/p/poetry.lock", "g", "2", False, "poetry.lock:git:u#abc"),
        ("/p/uv.lock", "x", "3", True, "uv.lock"),
        ("/p/yarn.lock", "@s/y", "1.5", False, "yarn.lock"),
        ("/p/yarn.lock", "z", "1.0", False, "yarn.lock"),
    ]
    broken = L.parsed_locks(files(spark, **{"poetry.lock": "= not toml"})).collect()
    assert len(broken) == 1 and broken[0].name is None and broken[0].error


def test_direct_marks_and_fingerprints(spark):
    deps = spark.createDataFrame([("/p", "node", "a", "1", False, "yarn.lock"), ("/p", "node", "b", "1", False, "yarn.lock")], "root string, ecosystem string, name string, version string, direct boolean, resolved_by string")
    marked = L.mark_direct(deps, L.declared(files(spark, **{"package.json": '{"devDependencies": {"b": "^1"}}'})))
    assert rows(marked, "name", "direct") == [("a", False), ("b", True)]
    prints = {L.resolution_fingerprint(d).first().fingerprint for d in (deps, deps.orderBy("name", ascending=False), marked)}
    assert len(prints) == 2


def test_change_lists(spark):
    lines = spark.createDataFrame([("A\tx",), ("M\ty",), ("D\tz",), ("R100\told\tnew",), ("T\tq",), ("",)], "value string")
    assert rows(L.git_changes(lines).na.fill(""), "status", "path", "old_path") == [("added", "x", ""), ("deleted", "z", ""), ("error", "q", ""), ("modified", "y", ""), ("renamed", "new", "old")]


def test_vanity_roots(spark):
    html = '<meta name="go-import" content="ex.org/m hg http://no"><meta name="go-import" content="ex.org/m git https://git.ex.org/m">'
    pages = spark.createDataFrame([("ex.org/m/sub", html), ("ex.org/moo", html), ("ex.org/m", "none")], "module string, html string")
    assert rows(S.vanity_roots(pages), "module", "root", "url") == [("ex.org/m/sub", "ex.org/m", "https://git.ex.org/m")]


def test_texts_with_braces_stay_whole(spark):
    listed = json.dumps({"Path": "a} {b", "Version": "v1"}, indent=1) + "\n" + json.dumps({"Path": "c", "Version": "v2"}, indent=1)
    assert rows(L.go_modules(files(spark, out=listed)), "name", "version") == [("a} {b", "v1"), ("c", "v2")]


def test_all_formats_come_as_one_table(spark):
    made = [
        ("/g", "/g/go.mod", ""), ("/q", "/q/requirements.txt", "a==1\nb>=2"), ("/n", "/n/package-lock.json", json.dumps({"lockfileVersion": 3, "packages": {"": {"dependencies": {"x": "1"}}, "node_modules/x": {"version": "1.0"}}})),
        ("/y", "/y/yarn.lock", '# yarn lockfile v1\n\n"own@^1":\n  version "1.2.3"\n\nother@^2:\n  version "2.0.0"\n'), ("/y", "/y/package.json", json.dumps({"dependencies": {"own": "^1"}})),
        ("/u", "/u/uv.lock", "[[package]]\nname = 'p'\nversion = '3'\nsource = { registry = 'r' }\n"), ("/u", "/u/requirements.txt", "ignored==1"), ("/z", "/z/poetry.lock", "not = [toml"),
    ]
    out = spark.createDataFrame([("/g", json.dumps({"Path": "m", "Version": "v1"})), ("/q", json.dumps({"Path": "stray", "Version": "v1"}))], "root string, content string")
    found = L.resolved(spark.createDataFrame(made, "root string, path string, content string"), out)
    assert tuple(found.columns) == L.RESOLVED
    got = {(r.root, r.name): (r.ecosystem, r.version, r.direct, r.resolved_by, r.error is None) for r in found.collect()}
    assert got == {
        ("/g", "m"): ("go", "v1", True, "go-list", True), ("/q", "a"): ("python", "1", True, "requirements.txt", True), ("/q", None): ("python", None, None, None, False), ("/n", "x"): ("node", "1.0", True, "package-lock.json", True),
        ("/y", "own"): ("node", "1.2.3", True, "yarn.lock", True), ("/y", "other"): ("node", "2.0.0", False, "yarn.lock", True), ("/u", "p"): ("python", "3", got[("/u", "p")][2], "uv.lock", True), ("/z", None): ("python", None, None, None, False),
    }
