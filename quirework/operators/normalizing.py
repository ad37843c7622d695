"""From files to knowledge objects: which normaliser and chunker take a file, and what they make of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.markdown import outline
from quirework.functions.text import basename, stripped, unix_lines

# Names of release notes, whatever their case.
RELEASE_NOTES = "changelog.md changes.md releases.md history.md changelog.txt changes.txt releases.txt history.txt".split()
# What a chunk of each kind carries of its object, "" where that has none.
SECTION_METADATA = "heading_path section_path dependency version source_type".split()
SYMBOL_METADATA = "package symbol signature source_path version dependency source_type".split()

_OUTLINE = pa.struct([("title", pa.string()), ("headings", pa.list_(pa.string())), ("languages", pa.list_(pa.string())), ("links", pa.list_(pa.string())), ("code_blocks", pa.string())])
OUTLINE = "struct<title: string, headings: array<string>, languages: array<string>, links: array<string>, code_blocks: string>"


def _ends(path: Column, *suffixes: str) -> Column:
    lower = F.lower(path)
    found = F.lit(False)
    for s in suffixes:
        found = found | F.endswith(lower, F.lit(s))
    return found


def is_release_notes(path: Column, source_type: Column) -> Column:
    return F.coalesce(source_type == "github-releases", F.lit(False)) | F.lower(basename(path)).isin(RELEASE_NOTES)


def is_plain_text(path: Column, include_license: Column) -> Column:
    """Text files; licences only where the source asks for them."""
    return _ends(path, ".txt", ".rst") | (F.startswith(F.lower(basename(path)), F.lit("license")) & F.coalesce(include_license, F.lit(False)))


def normalizer(path: Column, source_type: Column, include_license: Column) -> Column:
    """The first that takes a file: release-notes, markdown, plaintext; null if none does."""
    return F.when(is_release_notes(path, source_type), "release-notes").when(_ends(path, ".md", ".mdx"), "markdown").when(is_plain_text(path, include_license), "plaintext")


def chunker(content_type: Column) -> Column:
    """sections or symbols; null has no chunks, though its object counts."""
    return F.when(content_type.isin("markdown", "text"), "sections").when(content_type.isin("symbol_doc", "package_doc"), "symbols")


def promoted(metadata: Column, names: list[str]) -> Column:
    """A map of exactly ``names``: what is missing in ``metadata`` is empty, not absent."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.coalesce(F.try_element_at(metadata, F.lit(n)), F.lit("")) for n in names]))


def valid_text(content: Column) -> Column:
    """The string with each run of bytes that are no UTF-8 as one U+FFFD (one that stood beside the run joins it)."""
    return F.when(F.is_valid_utf8(content), content).otherwise(F.regexp_replace(F.make_valid_utf8(content), "�+", "�"))


def _outlines(texts: pa.Array) -> pa.Array:
    return pa.array([outline(t or "") for t in texts.to_pylist()], _OUTLINE)


def _nonempty(pairs: dict[str, Column]) -> Column:
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values())), lambda _, v: v.isNotNull() & (v != ""))


def normalized(files: DataFrame) -> DataFrame:
    """Objects (the columns of ``files`` but ``content``, with normalizer, content_type, title, content, metadata).

    ``files``: path, source_type, include_license, content (string or binary) and what is to
    be carried along. Files that no normaliser takes are left out. Plain text is trimmed
    and its broken bytes are replaced and noted; Markdown keeps its text and notes its
    headings, languages, links and code; release notes also note the version of the
    first heading that leads with one. Null content is empty.
    """
    rest = [c for c in files.columns if c != "content"]
    raw = F.coalesce(F.col("content").cast("string"), F.lit(""))
    taken = files.withColumn("normalizer", normalizer(F.col("path"), F.col("source_type"), F.col("include_license"))).filter("normalizer is not null")
    as_markdown = _ends(F.col("path"), ".md", ".mdx") | ((F.col("normalizer") == "release-notes") & F.coalesce(F.col("source_type") == "github-releases", F.lit(False)))
    read = taken.select(*rest, "normalizer", as_markdown.alias("as_markdown"), F.is_valid_utf8(raw).alias("valid"), unix_lines(valid_text(raw)).alias("content"))
    seen = read.withColumn("o", F.arrow_udf(_outlines, OUTLINE)(F.when(F.col("as_markdown"), F.col("content"))))
    version = F.try_element_at(F.filter(F.transform(F.col("o.headings"), lambda h: F.regexp_extract(F.element_at(F.split(h, " > "), -1), r"^v?\d+\.\d+\.\d+", 0)), lambda v: v != ""), F.lit(1))
    noted = F.col("normalizer") == "release-notes"
    kept = F.when(F.col("as_markdown"), F.col("content")).otherwise(stripped(F.col("content")))
    markdown = F.col("as_markdown")
    metadata = _nonempty(
        {
            "headings": F.when(markdown, F.array_join("o.headings", "|")),
            "code_languages": F.when(markdown, F.array_join("o.languages", ",")),
            "links": F.when(markdown, F.array_join("o.links", ",")),
            "code_blocks": F.when(markdown, F.col("o.code_blocks")),
            "parse_warning": F.when(markdown & (stripped(F.col("content")) == ""), "true"),
            "invalid_utf8_replaced": F.when(~markdown & ~F.col("valid"), "true"),
            "content_type": F.when(noted, "release_note"),
            "release_version": F.when(noted & markdown, version),
        }
    )
    title = F.when(markdown & (F.col("o.title") != ""), F.col("o.title")).otherwise(basename(F.col("path")))
    return seen.select(*rest, "normalizer", F.when(markdown, "markdown").otherwise("text").alias("content_type"), title.alias("title"), kept.alias("content"), metadata.alias("metadata"))
