"""Column functions over texts, names and paths. All run inside the JVM; what Python says of one word is the same."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain words that are never search terms.
STOPWORDS = (
    "a an and are as at be by can do does for from how i if in into is it its me my of on or should so that the their "
    "then there these this to use was we what when where which who why will with you your"
).split()
_STOP = frozenset(STOPWORDS)
#: Bytes of the shortest and longest search term.
TERM_BYTES = (2, 64)
_CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def search_terms(text: Column) -> Column:
    """The search terms of a text, in order and with repeats; identifiers whole and in parts.

    A word is a run of letters, digits and ``. _ - /``. A plain one is a term unless it
    is a stop word. An identifier is a term, as are its parts between joiners and their
    camel-case parts. Terms are lower case. Null has none.
    """

    none = F.array().cast("array<string>")

    def of_part(part: Column, several: Column) -> Column:
        camel = F.transform(F.split(part, _CAMEL), F.lower)
        return F.concat(F.when(several, F.array(F.lower(part))).otherwise(none), F.when(F.size(camel) > 1, camel).otherwise(none))

    def of_identifier(word: Column) -> Column:
        parts = F.split(word, r"[._/\-]+")
        return F.concat(F.array(F.lower(word)), F.flatten(F.transform(parts, lambda p: of_part(p, F.size(parts) > 1))))

    def of_word(word: Column) -> Column:  # most words are plain and stop at the first test
        lower = F.lower(word)
        return F.when(word.rlike(r"[._/\-]|\p{Ll}\p{Lu}|\p{Lu}\p{Lu}\p{Ll}"), of_identifier(word)).when(lower.isin(STOPWORDS), none).otherwise(F.array(lower))

    return F.filter(F.flatten(F.transform(search_words(text), of_word)), lambda t: F.octet_length(t).between(*TERM_BYTES))


def search_words(text: Column) -> Column:
    """The words of a text, as they stand there."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{Nd}](?:[\p{L}\p{Nd}._/\-]*[\p{L}\p{Nd}])?"), F.lit(0))


def terms_of_word(word: str) -> list[str]:
    """What :func:`search_terms` makes of one word, for those that look up distinct words."""
    lower = word.lower()
    if word.isascii() and word.isalnum() and word[1:] == lower[1:]:  # most are plain
        terms = [] if lower in _STOP else [lower]
    else:
        parts = re.split(r"[._/\-]+", word)
        camels = [_camel_parts(p) for p in parts]
        if len(parts) == 1 and len(camels[0]) == 1:
            terms = [] if lower in _STOP else [lower]
        else:
            terms = [lower]
            for part, camel in zip(parts, camels):
                terms += [part.lower()] * (len(parts) > 1) + [c.lower() for c in camel] * (len(camel) > 1)
    return [t for t in terms if TERM_BYTES[0] <= len(t.encode()) <= TERM_BYTES[1]]


def _camel_parts(part: str) -> list[str]:
    case = [unicodedata.category(c) for c in part]
    back = [k if c < "\U00010000" else "" for c, k in zip(part, case)]  # the JVM's patterns don't look back at others
    cuts = [n for n in range(1, len(part)) if case[n] == "Lu" and (back[n - 1] == "Ll" or back[n - 1] == "Lu" and case[n + 1 : n + 2] == ["Ll"])]
    return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]


def word_set(text: Column) -> Column:
    """The distinct words of the lower-cased text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' word sets; 0 if both are empty."""
    x, y = word_set(a), word_set(b)
    common = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - common
    return F.when(either == 0, 0.0).otherwise(common / either)


def copies_phrase(question: Column, content: Column, words: int = 5) -> Column:
    """Whether the question holds a run of ``words`` words of the content."""
    asked, said = F.lower(question), F.filter(F.split(F.lower(content), r"(?U)\s+"), lambda w: w != "")
    runs = F.when(F.size(said) >= words, F.transform(F.sequence(F.lit(1), F.size(said) - words + 1), lambda k: F.array_join(F.slice(said, k, words), " "))).otherwise(F.array().cast("array<string>"))
    return F.exists(runs, lambda r: asked.contains(r))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def stripped(text: Column) -> Column:
    """The text without white space, of any script, around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plain_package_name(name: Column) -> Column:
    """A package name as registries compare it: lower case, runs of ``-_.`` as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[-_.]+", "-"), "^-|-$", "")


def trust_class(source_type: Column) -> Column:
    return F.when(source_type.isin("git", "godoc"), "repository").when(source_type.isin("website", "github-releases"), "official").otherwise("unknown")


def chunk_title(package: Column, symbol: Column, path: Column) -> Column:
    """The qualified symbol of an API entry, else the path; empty stands for unset."""
    pkg, sym, where = (F.coalesce(c, F.lit("")) for c in (package, symbol, path))
    return F.when(sym == "", where).when(pkg == "", sym).otherwise(F.concat_ws(".", pkg, sym))


def keyword_text(package: Column, symbol: Column, content: Column) -> Column:
    """What a keyword index reads: an API entry is led by its qualified symbol."""
    lead = chunk_title(package, symbol, F.lit(""))
    return F.when(lead == "", content).otherwise(F.concat(lead, F.lit("\n"), content))


def breadcrumb(dependency: Column, version: Column, section_path: Column, source_path: Column, symbol: Column) -> Column:
    """``dependency@version > section > ...``; without sections the source path and symbol of an API entry.

    A section path is a JSON array; one that doesn't parse leaves only the head.
    """
    sections, where, sym = (F.coalesce(c, F.lit("")) for c in (section_path, source_path, symbol))
    head = F.when(F.coalesce(version, F.lit("")) == "", dependency).otherwise(F.concat_ws("@", dependency, version))
    parsed = F.coalesce(F.from_json(sections, "array<string>"), F.array().cast("array<string>"))
    named = F.when(sym == "", F.array().cast("array<string>")).otherwise(F.filter(F.array(where, sym), lambda x: x != ""))
    path = F.when((sections != "") & (sections != "null"), parsed).otherwise(named)
    return F.concat_ws(" > ", F.array(head), path)


def ref_candidates(version: Column, ref: Column, templates: Column) -> Column:
    """The refs to try for a version, in order.

    Templates win. A pseudo-version names its commit; anything else fills the one template.
    """
    plain = F.regexp_replace(version, r"\+incompatible$", "")
    bare = F.regexp_replace(plain, "^v", "")
    commit = F.regexp_extract(plain, r"\d{14}-([0-9a-f]{12})$", 1)

    def fill(template: Column) -> Column:
        return F.replace(template, F.lit("${version}"), bare)

    single = F.when(commit != "", F.array(commit)).when(F.coalesce(ref, F.lit("")) != "", F.array(fill(ref))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(F.size(templates), F.lit(0)) > 0, F.transform(templates, fill)).otherwise(single)


def module_root(path: Column) -> Column:
    """The repository part of a ``github.com`` module path; null for other hosts."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) >= 3) & (parts[0] == "github.com"), F.array_join(F.slice(parts, 1, 3), "/"))


def module_subdir(path: Column, root: Column) -> Column:
    """Where a module lives in its repository: the path below the root, without a major version."""
    rest = F.regexp_replace(F.substring(path, F.length(root) + 1, F.length(path)), "^/", "")
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), rest), r"/v([2-9]|[1-9][0-9]+)$", ""), "^/", "")


def tag_template(subdir: Column) -> Column:
    return F.when(subdir == "", F.lit("v${version}")).otherwise(F.concat(subdir, F.lit("/v${version}")))


def path_prefixes(path: Column) -> Column:
    """The path and all its ancestors, at ``/`` boundaries."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the bytes of a text, as a long."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda k: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), k, F.lit(1))), 16, 10).cast("long"))
    # 16777619 = 2^24 + 403, in two parts so that no product passes 2^63
    step = lambda h, b: F.pmod(F.pmod(h.bitwiseXOR(b), F.lit(256)) * F.lit(1 << 24) + h.bitwiseXOR(b) * F.lit(403), F.lit(1 << 32))
    return F.when(F.octet_length(text) == 0, F.lit(2166136261).cast("long")).otherwise(F.aggregate(codes, F.lit(2166136261).cast("long"), step))


def tune_or_test(question_id: Column) -> Column:
    """The half a question belongs to, fixed by its id; ``dev-`` ids are always tune."""
    even = fnv1a32(question_id) % 2 == 0
    return F.when(question_id.startswith("dev-") | even, "tune").otherwise("test")


def identity(*fields: Column) -> Column:
    """A digest of fields that no other split of the same bytes shares: each is led by its length."""
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.sha2(reduce(lambda a, b: F.concat(a, b), [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)


def basename(path: Column) -> Column:
    """What follows the last slash, slashes at the end apart; ``/`` and the empty path are themselves."""
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", ".").when(bare == "", "/").otherwise(F.substring_index(bare, "/", -1))


def byte_size(n: Column) -> Column:
    """Bytes for reading: ``512 B``, ``1.5 KiB``, ``2.0 GiB``."""
    exponent = F.floor((F.length(F.bin(n.cast("bigint"))) - 1) / 10)
    unit = F.substring(F.lit("KMGTPE"), exponent.cast("int"), F.lit(1))
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(F.format_string("%.1f %siB", n / F.pow(F.lit(1024.0), exponent), unit))


def git_repository(url: Column) -> Column:
    """(host, path) of a repository: of a URL, of ``user@host:path``, else ``local`` and the path.

    The path is without ``.git`` and the slashes around it, so both spellings of a URL are equal.
    """
    standard, short = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)", r"^[^@]*@([^:]*):(?s:(.*))$"

    def path(p: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(p, r"\.git$", ""), "^/+|/+$", "")

    def found(shape: str) -> Column:
        return F.struct(F.regexp_extract(url, shape, 1).alias("host"), path(F.regexp_extract(url, shape, 2)).alias("path"))

    return F.when(url.rlike(standard), found(standard)).when(url.rlike(short), found(short)).otherwise(F.struct(F.lit("local").alias("host"), path(url).alias("path")))


def point_id(generation: Column, chunk: Column) -> Column:
    """The id of a chunk in a generation, in the shape of a UUID by name: equal chunks of two generations differ."""
    h = F.sha2(F.concat(generation, F.lit("\0"), chunk), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
