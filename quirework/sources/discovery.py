"""Which files of a repository belong to a package: its folder, nested packages of others, and patterns to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import basename

# Folders without documents.
SKIPPED = [".git", "vendor", "node_modules", "dist", "build", ".venv", "venv", "__pycache__", "target"]
# What to fetch for every package, and for those of an ecosystem.
DOCUMENTS = ["*.md", "*.mdx", "*.txt", "*.rst", "LICENSE*", "license*"]
OF_ECOSYSTEM = {"go": ["*.go", "go.mod"], "node": ["package.json", "*.d.ts"], "python": ["*.py", "*.pyi"]}


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def sparse_patterns(ecosystem: Column) -> Column:
    own = F.lit(None).cast("array<string>")
    for name, values in OF_ECOSYSTEM.items():
        own = F.when(ecosystem == name, _strings(values)).otherwise(own)
    return F.concat(_strings(DOCUMENTS), F.coalesce(own, _strings([])))


def below(patterns: Column, folder: Column) -> Column:
    """Patterns for a folder of the repository alone; an empty one changes nothing."""
    return F.when(folder == "", patterns).otherwise(F.transform(patterns, lambda p: F.concat(F.lit("/"), folder, F.lit("/**/"), p)))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _ancestors(path: Column) -> Column:
    """The folders above a file, the root left out."""
    parts = F.split(_folder(path), "/")
    return F.when(_folder(path) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def node_folders(packages: DataFrame, manifests: DataFrame) -> DataFrame:
    """``packages`` (repository, package) with folder, verified, ambiguous, by the names in the repository's ``package.json``.

    ``manifests``: repository, path, name. The first by path of that name wins; if there
    are manifests but none of that name the package is ambiguous, which is a failure.
    """
    named = manifests.groupBy("repository", F.col("name").alias("package")).agg(F.min("path").alias("path"))
    any_ = manifests.select("repository", F.lit(True).alias("any")).distinct()
    found = packages.join(named, ["repository", "package"], "left").join(any_, "repository", "left")
    return found.select(*packages.columns, F.coalesce(_folder(F.col("path")), F.lit("")).alias("folder"), F.col("path").isNotNull().alias("verified"), (F.col("path").isNull() & F.col("any").isNotNull()).alias("ambiguous"))


def python_name(name: Column) -> Column:
    return F.translate(F.lower(name), "-.", "__")


def python_folders(packages: DataFrame, files: DataFrame) -> DataFrame:
    """``packages`` (repository, package) with folder, verified: the one folder of that name with an ``__init__.py``.

    ``files``: repository, path. None or several such folders: not verified, folder empty.
    """
    parents = files.filter((basename(F.col("path")) == "__init__.py") & F.contains("path", F.lit("/"))).select("repository", _folder(F.col("path")).alias("folder"))
    one = parents.groupBy("repository", python_name(basename(F.col("folder"))).alias("wanted")).agg(F.count("*").alias("n"), F.min("folder").alias("folder")).filter("n = 1").drop("n")
    found = packages.withColumn("wanted", python_name(F.col("package"))).join(one, ["repository", "wanted"], "left")
    return found.select(*packages.columns, F.coalesce("folder", F.lit("")).alias("folder"), F.col("folder").isNotNull().alias("verified"))


def files_of_packages(packages: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(repository, ecosystem, package, path): the files below a package's folder, without skipped folders and without those of nested packages.

    ``packages``: repository, ecosystem, package and, where it is known, folder (empty: the
    root); ``files``: repository, path; ``manifests``: repository, path, name of each
    ``package.json``. A folder further below with a ``go.mod`` is another module's; for Node
    also one whose ``package.json`` has another name. Files meet the packages of the
    folders above them, not all of their repository.
    """
    on = ["repository", "ecosystem", "package"]
    home = F.coalesce("folder", F.lit("")) if "folder" in packages.columns else F.lit("")
    homes = packages.select(*on, home.alias("home")).distinct()
    kept = files.filter(~F.arrays_overlap(F.split(F.concat(F.lit("/"), _folder(F.col("path"))), "/"), _strings(SKIPPED))).select("repository", "path")
    above_it = F.concat(_strings([""]), _ancestors(F.col("path")))
    each = kept.withColumn("home", F.explode(above_it)).join(homes, ["repository", "home"])
    modules = kept.filter(basename(F.col("path")) == "go.mod").select("repository", _folder(F.col("path")).alias("border"), F.lit("").alias("name"))
    foreign = manifests.select("repository", _folder(F.col("path")).alias("border"), "name").filter("name <> ''")
    borders = modules.unionByName(foreign).filter("border <> ''").groupBy("repository", "border").agg(F.max(F.col("name") == "").alias("module"), F.collect_set("name").alias("names"))
    inner = F.filter(_ancestors(F.col("path")), lambda f: F.length(f) > F.length("home"))
    crossed = each.withColumn("border", F.explode(inner)).join(borders, ["repository", "border"])
    other = F.exists("names", lambda n: (n != "") & (n != F.col("package")))
    beyond = crossed.filter(F.col("module") | ((F.col("ecosystem") == "node") & other)).select(*on, "path").distinct()
    return each.join(beyond, [*on, "path"], "left_anti").select(*on, "path")


def glob_regex(pattern: Column) -> Column:
    """A pattern as a regular expression for whole paths.

    ``*`` and ``?`` stay within a folder, ``**`` crosses folders. A pattern with a slash
    before its end starts at the root, another fits at any depth; one that ends in a slash, and
    any that names a folder, takes all that is below.
    """
    body = F.regexp_replace(F.regexp_replace(pattern, "^/", ""), "/$", "")
    anchored = F.regexp_replace(pattern, "/$", "").contains("/")
    out = F.regexp_replace(body, r"([.+^$()\[\]{}|\\])", r"\\$1")
    for glob, marker in ((r"^\*\*/", "\u0001"), (r"/\*\*/", "\u0002"), (r"/\*\*$", "\u0003"), (r"\*+", "[^/]*"), (r"\?", "[^/]")):
        out = F.regexp_replace(out, glob, marker)
    for marker, meant in (("\u0001", "(?:.*/)?"), ("\u0002", "/(?:.*/)?"), ("\u0003", "/.*")):
        out = F.replace(out, F.lit(marker), F.lit(meant))
    return F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), out, F.when(F.endswith(pattern, F.lit("/")), "/.*$").otherwise("(?:/.*)?$"))


def matching(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(repository, path, pattern): the patterns that take each file.

    ``files``: repository, path; ``patterns``: repository, pattern. A pattern is filed under
    the folder that its first wildcard leaves (the root for one that fits at any depth), and a
    path asks the folders above it, so that it meets only patterns that can fit.
    """
    asked = patterns.select("repository", "pattern").filter("pattern <> ''").distinct()
    body = F.regexp_replace("pattern", "^/", "")
    anchored = F.regexp_replace("pattern", "/$", "").contains("/")
    plain = _folder(F.regexp_replace(body, r"[*?].*$", ""))
    filed = asked.select("repository", "pattern", F.when(anchored, plain).otherwise("").alias("folder"), glob_regex(F.col("pattern")).alias("regex"))
    here = files.select("repository", "path").withColumn("folder", F.explode(F.concat(_strings([""]), _ancestors(F.col("path")))))
    return here.join(filed, ["repository", "folder"]).filter(F.rlike("path", F.col("regex"))).select("repository", "path", "pattern")
