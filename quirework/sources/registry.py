"""Source registries, refs and metadata tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layered(manifests: DataFrame) -> DataFrame:
    """Of manifests with one name (name, layer, ...) the one of the highest layer, and how many it overrides."""
    rest = [c for c in manifests.columns if c not in ("name", "layer")]
    best = manifests.groupBy("name").agg(F.max_by(F.struct("layer", *rest), "layer").alias("m"), (F.count("*") - 1).alias("overridden"))
    return best.select("name", *[F.col("m")[c].alias(c) for c in ("layer", *rest)], "overridden")


def match_index(manifests: DataFrame) -> DataFrame:
    """(ecosystem, package, name): which manifest serves a package; of several the first by name."""
    pairs = manifests.select("name", F.explode("ecosystems").alias("ecosystem"), "packages").select("name", "ecosystem", F.explode("packages").alias("package"))
    return pairs.groupBy("ecosystem", "package").agg(F.min("name").alias("name"))


def match(dependencies: DataFrame, index: DataFrame) -> DataFrame:
    """Dependencies with the manifest that serves them, null if none does."""
    return dependencies.join(index.withColumnRenamed("name", "manifest"), ["ecosystem", "package"], "left")


def first_ref(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """(key, ref, commit): the first of each key's candidate refs (an array) that exists."""
    rows = candidates.select("key", F.posexplode("candidates").alias("at", "ref"))
    return rows.join(refs.select("ref", "commit"), "ref").groupBy("key").agg(F.min_by(F.struct("ref", "commit"), "at").alias("r")).select("key", "r.ref", "r.commit")


def go_import(html: Column) -> Column:
    """The git go-import tags of a page as (root, url)."""
    found = F.regexp_extract_all(html, F.lit(r"<meta\s+name=[\"']go-import[\"']\s+content=[\"']([^\"']+)[\"']\s*/?>"), F.lit(1))
    split = F.transform(found, lambda x: F.split(F.trim(x), r"\s+"))
    return F.transform(F.filter(split, lambda x: (F.size(x) == 3) & (x[1] == "git")), lambda x: F.struct(x[0].alias("root"), x[2].alias("url")))


def vanity_roots(pages: DataFrame) -> DataFrame:
    """(module, root, url) of pages (module, html) with a git tag whose root is the module or an ancestor; the first counts."""
    tags = pages.select("module", F.posexplode(go_import(F.col("html"))).alias("at", "t")).select("module", "at", "t.root", "t.url")
    fit = tags.filter((F.col("module") == F.col("root")) | F.col("module").startswith(F.concat("root", F.lit("/"))))
    return fit.groupBy("module").agg(F.min_by(F.struct("root", "url"), "at").alias("r")).select("module", "r.root", "r.url")
