"""Lockfiles to dependency tables: a row per dependency of each file.

Input is a DataFrame of files (root, path, content), as from :func:`project_files`.
Output has root, path, name, version, direct and resolved_by. What the formats hold as
JSON or lines is read by Spark; TOML, YAML and block formats are parsed per file by
small helpers. A file that doesn't parse gives one row with its error and no name.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # YAML lockfiles then give an error row
    yaml = None

# The files that make a folder a project and their ecosystem, lock files with their ecosystem and
# priority within it, and folders that are never entered.
PROJECTS = {
    "go.mod": "go", "pyproject.toml": "python", "requirements.txt": "python", "package.json": "node", "Cargo.toml": "rust",
    "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java",
}
MARKERS = {
    "go.mod": ("go", 1), "go.work": ("go", 1), "uv.lock": ("python", 1), "poetry.lock": ("python", 2), "requirements.txt": ("python", 3),
    "bun.lock": ("node", 1), "pnpm-lock.yaml": ("node", 2), "yarn.lock": ("node", 3), "package-lock.json": ("node", 4),
}
SKIPPED_FOLDERS = (".git", "node_modules", "vendor", "__pycache__", ".venv", "venv", "dist", "build", "target")
ROW = "array<struct<name: string, version: string, direct: boolean, resolved_by: string, error: string>>"
_ROW = pa.list_(pa.struct([("name", pa.string()), ("version", pa.string()), ("direct", pa.bool_()), ("resolved_by", pa.string()), ("error", pa.string())]))

Dependency = tuple[str, str, bool, str]


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """The marker and lock files below ``root`` as (root, path, content), read as binary files; only folders below ``root`` are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.decode("content", "UTF-8").alias("content"))
    return kept_files(files, root)


def kept_files(files: DataFrame, root: str) -> DataFrame:
    """Of listed files (path, content) the marker and lock files that are in no skipped folder below ``root``, with their folder as root."""
    plain = re.sub("^file:/+", "/", root.rstrip("/"))
    name = F.element_at(F.split("path", "/"), -1)
    below = F.split(F.element_at(F.split("path", re.escape(plain) + "/", 2), -1), "/")
    kept = files.filter(name.isin(*PROJECTS, *MARKERS)).filter(~F.arrays_overlap(below, F.lit(list(SKIPPED_FOLDERS))))
    return kept.withColumn("root", F.regexp_replace("path", "/[^/]*$", ""))


def detected_projects(files: DataFrame) -> DataFrame:
    """(root, ecosystem) of each folder with a file that makes it a project."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.create_map(*[F.lit(x) for pair in PROJECTS.items() for x in pair])[name]
    return files.select("root", kind.alias("ecosystem")).filter("ecosystem is not null").distinct()


def preferred(files: DataFrame) -> DataFrame:
    """Of each root and ecosystem the lockfile of the first priority."""
    name = F.element_at(F.split("path", "/"), -1)
    table = F.create_map(*[F.lit(x) for n, (_, p) in MARKERS.items() for x in (n, p)])
    kind = F.create_map(*[F.lit(x) for n, (e, _) in MARKERS.items() for x in (n, e)])
    ranked = files.withColumn("ecosystem", kind[name]).withColumn("priority", table[name]).filter("ecosystem is not null")
    w = Window.partitionBy("root", "ecosystem").orderBy("priority", "path")
    return ranked.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "priority")


def go_modules(output: DataFrame) -> DataFrame:
    """(root, name, version, direct, resolved_by) from captured module lists (root, content): JSON objects one after another.

    Objects begin on a line of their own, which no text within one does. The main module is
    dropped; a replacement gives its version, or is local if it has none.
    """
    kind = "array<struct<Path: string, Version: string, Main: boolean, Indirect: boolean, Replace: struct<Path: string, Version: string>>>"
    listed = F.concat(F.lit("["), F.regexp_replace(F.trim("content"), r"\}[ \t]*\r?\n\s*\{", "},{"), F.lit("]"))
    m = output.select("root", F.explode(F.from_json(listed, kind)).alias("m")).select("root", "m.*")
    other = F.coalesce("Replace.Version", F.lit(""))
    replaced = F.col("Replace").isNotNull()
    by = F.when(~replaced, "go-list").when(other == "", F.concat(F.lit("local:"), "Replace.Path")).otherwise(F.concat(F.lit("replace:"), "Replace.Path", F.lit("@"), "Replace.Version"))
    return m.filter(~F.coalesce("Main", F.lit(False))).select(
        "root", F.col("Path").alias("name"), F.when(replaced & (other != ""), other).otherwise(F.col("Version")).alias("version"), (~F.coalesce("Indirect", F.lit(False))).alias("direct"), by.alias("resolved_by")
    )


def requirements(files: DataFrame) -> DataFrame:
    """(root, line, name, version, warning): exact pins are dependencies, anything else a warning."""
    rows = files.select("root", F.posexplode(F.split("content", "\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    rows = rows.filter((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    name, version = (F.regexp_extract("raw", r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*==\s*([^\s;#]+)", k) for k in (1, 2))
    loose = F.regexp_extract("raw", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    include = F.col("raw").rlike(r"^(-r|--requirement) ")
    warning = F.when(include, F.concat(F.lit("include not followed: "), "raw")).when(name != "", None).when(loose != "", F.concat(F.lit("not an exact pin: "), loose)).otherwise(F.concat(F.lit("not recognised: "), "raw"))
    pinned = ~include & (name != "")
    return rows.select("root", "line", F.when(pinned, name).alias("name"), F.when(pinned, version).alias("version"), warning.alias("warning"))


def npm_lock(files: DataFrame) -> DataFrame:
    """Dependencies of package-lock.json, version 3. Names follow the last ``node_modules/``.

    A file that doesn't parse, of another version or without a root entry gives one row with its error and no name.
    """
    entry = "struct<version: string, resolved: string, link: boolean, dependencies: map<string,string>, devDependencies: map<string,string>>"
    lock = files.select("root", "path", F.from_json("content", f"lockfileVersion int, packages map<string,{entry}>").alias("l"))
    main = F.col("l.packages")[F.lit("")]
    version = F.col("l.lockfileVersion")
    error = F.when(version.isNull() & F.col("l.packages").isNull(), "no lock file").when(~version.eqNullSafe(3), F.concat(F.lit("lock file version "), F.coalesce(version.cast("string"), F.lit("missing")))).when(main.isNull(), "no root entry")
    lock = lock.withColumn("error", error)
    direct = F.array_union(*[F.coalesce(F.map_keys(main[c]), F.array().cast("array<string>")) for c in ("dependencies", "devDependencies")])
    rows = lock.filter("error is null").select("root", "path", direct.alias("own"), F.explode("l.packages").alias("key", "p")).filter(F.instr("key", "node_modules/") > 0)
    name = F.substring_index("key", "node_modules/", -1)
    by = F.when(F.coalesce("p.link", F.lit(False)), F.concat(F.lit("package-lock.json:local:"), F.coalesce("p.resolved", F.lit("")))).otherwise("package-lock.json")
    none = F.lit(None).cast("string")
    good = rows.select("root", "path", name.alias("name"), F.coalesce("p.version", F.lit("")).alias("version"), F.array_contains("own", name).alias("direct"), by.alias("resolved_by"), none.alias("error"))
    bad = lock.filter("error is not null").select("root", "path", none.alias("name"), none.alias("version"), F.lit(None).cast("boolean").alias("direct"), none.alias("resolved_by"), "error")
    return good.unionByName(bad)


def at_last(specifier: Column) -> tuple[Column, Column]:
    """Name and version around the last ``@``, which isn't the first character."""
    return F.regexp_extract(specifier, "^(.+)@([^@]*)$", 1), F.regexp_extract(specifier, "^(.+)@([^@]*)$", 2)


def _poetry(text: str) -> list[Dependency]:
    out = []
    for p in tomllib.loads(text).get("package", []):
        source = p.get("source") or {}
        kind, url = source.get("type"), source.get("url", "")
        by = {"git": f"poetry.lock:git:{url}#{source.get('resolved_reference') or source.get('reference', '')}", "directory": f"poetry.lock:local:{url}"}
        by |= {k: f"poetry.lock:{k}:{url}" for k in ("file", "url")}
        out.append((p["name"], p.get("version", ""), False, by.get(kind, "poetry.lock")))
    return out


def _uv(text: str) -> list[Dependency]:
    packages = tomllib.loads(text).get("package", [])
    own = {d["name"] for p in packages if (p.get("source") or {}).get("virtual") for d in p.get("dependencies", [])}
    out = []
    for p in packages:
        source = p.get("source") or {}
        if source.get("virtual"):
            continue
        local = next((source[k] for k in ("editable", "directory", "path") if source.get(k)), None)
        by = f"uv.lock:git:{source['git']}" if source.get("git") else f"uv.lock:local:{local}" if local else "uv.lock"
        out.append((p["name"], p.get("version", ""), p["name"] in own, by))
    return out


def _named(specifier: str) -> tuple[str, str]:
    name, _, version = specifier.rpartition("@")
    return name, version


def _pnpm(text: str) -> list[Dependency]:
    lock = yaml.safe_load(text) or {}
    own = {n for i in (lock.get("importers") or {}).values() for c in ("dependencies", "devDependencies") for n in (i or {}).get(c) or {}}
    out = []
    for key in lock.get("packages") or {}:
        name, version = _named(key.removeprefix("/").partition("(")[0])
        if not name:
            raise ValueError(f"no name and version in {key!r}")
        out.append((name, version, name in own, "pnpm-lock.yaml"))
    return out


def _yarn(text: str) -> list[Dependency]:
    found = []
    if "__metadata:" in text:
        for key, entry in yaml.safe_load(text).items():
            if key != "__metadata" and entry.get("linkType") != "soft":
                found.append((key, str(entry.get("version") or "")))
    else:  # blocks of a header and indented fields
        for block in re.finditer(r"^(?![ #])([^\n]*):\r?\n((?: [^\n]*\n?)*)", text, re.M):
            version = re.search(r'^ +version "?([^"\n]*?)"?\s*$', block[2], re.M)
            found.append((block[1], version[1] if version else ""))
    named = ((_named(key.split(",")[0].strip().strip('"'))[0], version) for key, version in found)
    return [(name, version, False, "yarn.lock") for name, version in named if name and version]


def plain_json(text: str) -> str:
    """JSON with comments to JSON: comments and trailing commas go, strings stay as they are."""
    piece = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    bare = piece.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def _bun(text: str) -> list[Dependency]:
    lock = json.loads(plain_json(text))
    own = {n for w in (lock.get("workspaces") or {}).values() for c in ("dependencies", "devDependencies") for n in w.get(c) or {}}
    out = []
    for entry in (lock.get("packages") or {}).values():
        if entry and isinstance(entry[0], str):
            name, version = _named(entry[0])
            if name and version:
                out.append((name, version, name in own, "bun.lock"))
    return out


PARSERS: dict[str, Callable[[str], list[Dependency]]] = {"poetry.lock": _poetry, "uv.lock": _uv, "pnpm-lock.yaml": _pnpm, "yarn.lock": _yarn, "bun.lock": _bun}


def _parsed(names: pa.Array, contents: pa.Array) -> pa.Array:
    rows = []
    for name, text in zip(names.to_pylist(), contents.to_pylist()):
        try:
            rows.append([dict(zip(("name", "version", "direct", "resolved_by"), d)) for d in PARSERS[name](text or "")])
        except Exception as error:  # a broken file is a row, not a failed job
            rows.append([{"error": f"{type(error).__name__}: {error}"[:200]}])
    return pa.array(rows, _ROW)


def parsed_locks(files: DataFrame) -> DataFrame:
    """Dependencies of the lockfiles that need a parser; yarn's direct ones follow from :func:`declared`."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.filter(name.isin(*PARSERS))
    return rows.select("root", "path", F.explode(F.arrow_udf(_parsed, ROW)(name, F.col("content"))).alias("d")).select("root", "path", "d.*")


RESOLVED = ("root", "ecosystem", "name", "version", "direct", "resolved_by", "error")


def resolved(files: DataFrame, go_output: DataFrame) -> DataFrame:
    """The dependencies of every project as one table (RESOLVED): of each root and ecosystem the lock file of the first priority.

    ``files``: root, path, content, ``package.json`` files among them; ``go_output``: root and the
    captured module list of Go projects. What can't be read is a row with its error and no name, so is each
    line of a requirements file that isn't an exact pin.
    """
    chosen = preferred(files)
    name = F.element_at(F.split("path", "/"), -1)
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, ecosystem: str, by: Column, direct: Column, error: Column) -> DataFrame:
        return df.select("root", F.lit(ecosystem).alias("ecosystem"), "name", "version", direct.alias("direct"), by.alias("resolved_by"), error.alias("error"))

    roots = chosen.filter("ecosystem = 'go'").select("root")
    go = rows(go_modules(go_output.join(roots, "root", "left_semi")), "go", F.col("resolved_by"), F.col("direct"), none)
    pins = requirements(chosen.filter(name == "requirements.txt"))
    pinned = F.col("name").isNotNull()
    required = rows(pins, "python", F.when(pinned, "requirements.txt"), F.when(pinned, F.lit(True)), F.col("warning"))
    npm = rows(npm_lock(chosen.filter(name == "package-lock.json")), "node", F.col("resolved_by"), F.col("direct"), F.col("error"))
    parsed = parsed_locks(chosen)
    own = declared(files.filter(name == "package.json")).withColumn("own", F.lit(True))
    marked = parsed.join(own, ["root", "name"], "left")
    direct = F.when(name == "yarn.lock", F.when(F.col("name").isNotNull(), F.coalesce("own", F.lit(False)))).otherwise(F.col("direct"))
    others = marked.join(chosen.select("path", "ecosystem"), "path").select("root", "ecosystem", "name", "version", direct.alias("direct"), "resolved_by", "error")
    out = go.unionByName(required).unionByName(npm).unionByName(others)
    return out.select(*RESOLVED)


def declared(packages: DataFrame) -> DataFrame:
    """(root, name) that package.json files (root, content) list as dependencies."""
    p = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    names = F.array_union(*[F.coalesce(F.map_keys(p[c]), F.array().cast("array<string>")) for c in ("dependencies", "devDependencies")])
    return packages.select("root", F.explode(names).alias("name")).distinct()


def mark_direct(dependencies: DataFrame, names: DataFrame) -> DataFrame:
    own = names.select("root", "name").distinct().withColumn("own", F.lit(True))
    return dependencies.join(own, ["root", "name"], "left").withColumn("direct", F.coalesce("own", F.lit(False))).drop("own")


def resolution_fingerprint(dependencies: DataFrame) -> DataFrame:
    """(root, fingerprint): a digest of a root's dependencies that doesn't depend on their order."""
    row = F.struct("ecosystem", "name", "version", "direct", "resolved_by")
    return dependencies.groupBy("root").agg(F.concat(F.lit("res_"), F.sha2(F.to_json(F.array_sort(F.collect_list(row))), 256)).alias("fingerprint"))


def git_changes(lines: DataFrame) -> DataFrame:
    """(status, path, old_path) from name-status lines (value): A, M, D and R###; any other code is an error row."""
    f = F.split("value", "\t")
    code = f[0]
    renamed = code.startswith("R")
    status = F.when(code == "A", "added").when(code == "M", "modified").when(code == "D", "deleted").when(renamed & (F.size(f) >= 3), "renamed").otherwise("error")
    return lines.filter("value <> ''").select(status.alias("status"), F.when(renamed, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("path"), F.when(renamed, F.get(f, F.lit(1))).alias("old_path"))


def listing_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(status, path) between two file listings (path, hash)."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return both.select(status.alias("status"), "path").filter("status is not null")
