"""What a Markdown text holds: headings with their paths, fenced blocks and links.

Blocks are found by one pattern over the whole text, so the rest is a fold over few
headings. Small per-text helpers of the Arrow functions in ``operators``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import Any

_BLANK = " \t\f\r"
# A block of code runs to a line that begins with its own marker, or to the end.
_LOOSE = re.compile(
    r"""(?mx) ^[^\S\n]*(?P<fence>```|~~~)[^\n]*(?:\n(?![^\S\n]*(?P=fence))[^\n]*)*+(?:\n[^\n]*)?+
            | ^(?P<marks>\#{1,6})(?=[ \t\f\r])(?P<rest>[^\n]+)$"""
)
# The tags that begin a block of HTML, which ends before a blank line.
HTML_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
# By CommonMark: a fence is closed by one as long; a line of = or - makes a heading of the paragraph above it; a
# block of HTML runs to its end mark or to a blank line; a heading may stand in quotes and items of lists.
_STRICT = re.compile(
    r"""(?mx) ^[ ]{0,3}(?P<html><(?i:script|pre|style|textarea)(?=[\s>])(?s:.*?)(?:</(?i:script|pre|style|textarea)>[^\n]*|\Z) | <!--(?s:.*?)(?:-->[^\n]*|\Z) | <\?(?s:.*?)(?:\?>[^\n]*|\Z)
              | <!\[CDATA\[(?s:.*?)(?:\]\]>[^\n]*|\Z) | <![A-Za-z](?s:.*?)(?:>[^\n]*|\Z) | </?(?i:"""
    + "|".join(HTML_BLOCKS)
    + r""")(?=[\s/>])[^\n]*(?:\n(?![ \t]*(?:\n|\Z))[^\n]*)*+ | (?:(?<=\n\n)|(?<=\A))</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>\n]*)?/?>[ \t]*$(?:\n(?![ \t]*(?:\n|\Z))[^\n]*)*+)
            | ^[ ]{0,3}(?P<fence>(?P<mark>[`~])(?P=mark){2,})(?P<info>(?:(?<=~)[^\n]*|[^`\n]*))$
              (?P<code>(?:\n(?![ ]{0,3}(?P=fence)(?P=mark)*[ \t]*$)[^\n]*)*+)(?:\n[^\n]*)?+
            | ^(?:[ ]{0,3}(?:>[ ]?|[*+-][ ]{1,4}|\d{1,9}[.)][ ]{1,4}))*[ ]{0,3}(?P<marks>\#{1,6})(?P<rest>(?:[ \t][^\n]*)?)$
            | ^[ ]{0,3}(?P<above>[^\s\#>`~+*=-][^\n]*)\n[ ]{0,3}(?P<under>=+|-+)[ \t]*$"""
)
_INLINE = re.compile(
    r"""(?x) \\(?P<escaped>[!-/:-@\[-`{-~])
           | (?P<ticks>`+)(?P<code>(?s:.+?))(?<!`)(?P=ticks)(?!`)
           | <(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)>
           | (?P<image>!?)\[(?P<text>(?:[^\[\]\\]|\\.|!?\[[^\[\]]*\](?:\([^()]*\))?)*)\]
             (?:\(\s*(?:<(?P<wide>[^<>\n]*)>|(?P<to>[^\s()<]?(?:[^\s()]|\([^\s()]*\))*))(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*\)|\[(?P<label>[^\[\]]*)\])?"""
)
_DEFINED = re.compile(r"(?m)^ {0,3}\[([^\[\]\n]+)\]:[ \t]*\n?[ \t]*(?:<([^<>\n]*)>|(\S+))[^\n]*$")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_EMPHASIS = re.compile(r"(?<!\\)(\*{1,3}|(?<!\w)_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w*_)", re.S)


def _trail(levels_and_titles: Iterable[tuple[int, str]]) -> Iterator[tuple[str, ...]]:
    """The path after each heading, the empty one first; a heading too deep counts as one level down."""
    return accumulate(levels_and_titles, lambda above, h: (*above[: h[0] - 1], h[1]), initial=())


def _loose_title(rest: str) -> str:
    """What stands between the marks; a heading of blanks or of ``#`` alone keeps one of them."""
    bare = rest.strip(_BLANK)
    return bare.rstrip("#").rstrip(_BLANK) or bare[:1] or rest[-1]


def sections(text: str) -> Iterator[tuple[str, list[str] | None, str]]:
    """(heading line, path, body) of each section: one per ``#`` heading outside code, and what precedes the first.

    Without a heading the path is null; a section of nothing at all is left out.
    """
    found = [m for m in _LOOSE.finditer(text) if m["marks"] and (m["rest"].strip(_BLANK) or len(m["rest"]) > 1)]
    starts = [0, *(m.end() + 1 for m in found)]
    ends = [*(m.start() for m in found), len(text)]
    lines = ["", *(m[0] for m in found)]
    for line, path, start, end in zip(lines, _trail((len(m["marks"]), _loose_title(m["rest"])) for m in found), starts, ends):
        body = text[start:end].strip()
        if line or body:
            yield line, list(path) or None, body


def _label(name: str) -> str:
    return " ".join(name.split()).casefold()


def _plain(text: str, defined: dict[str, str]) -> str:
    """A heading's text without its markup: links by their words, autolinks and tags not at all."""

    def shown(m: re.Match) -> str:
        if m["code"] is not None:
            return m["code"]
        if m["escaped"]:
            return m[0]
        if m["auto"]:
            return ""
        is_link = m["to"] is not None or m["wide"] is not None or _label(m["label"] or m["text"]) in defined
        return _plain(m["text"], defined) if is_link else m[0]

    kept = _TAG.sub("", _INLINE.sub(shown, text))
    while (less := _EMPHASIS.sub(r"\2", kept)) != kept:
        kept = less
    return kept


def _links(text: str, defined: dict[str, str]) -> Iterator[str]:
    for m in _INLINE.finditer(text):
        if m["auto"]:
            yield m["auto"]
        elif m["text"] is not None and not m["image"]:
            to = m["wide"] if m["wide"] is not None else m["to"] if m["to"] is not None else defined.get(_label(m["label"] or m["text"]))
            if to is not None:
                yield to
            else:
                yield from _links(m["text"], defined)


def _as_json(blocks: list[dict[str, Any]]) -> str:
    written = json.dumps(blocks, separators=(",", ":"), ensure_ascii=False)
    for sign in "<>&\u2028\u2029":
        written = written.replace(sign, f"\\u{ord(sign):04x}")
    return written


def outline(text: str) -> dict[str, Any]:
    """title (of the first heading of level 1), headings (paths), languages (sorted), links (in order), code_blocks (JSON).

    Headings by ``#``, in quotes and items of lists too, or underlined; what blocks of HTML
    hold is neither heading nor link. Indented code is read as text.
    """
    code = [m for m in _STRICT.finditer(text) if m["fence"] or m["html"]]
    prose = "".join(text[a:b] for a, b in zip([0, *(m.end() for m in code)], [*(m.start() for m in code), len(text)]))
    defined: dict[str, str] = {}
    for m in _DEFINED.finditer(prose):
        defined.setdefault(_label(m[1]), m[2] if m[2] is not None else m[3])
    found = [m for m in _STRICT.finditer(text) if not m["html"]]
    heads = [None if m["fence"] else (len(m["marks"]), _atx_title(m["rest"])) if m["marks"] else (1 if m["under"][0] == "=" else 2, m["above"].strip()) for m in found]
    named = [h and (h[0], _plain(h[1], defined)) for h in heads]
    paths = list(_trail(h for h in named if h))
    upto = accumulate((h is not None for h in named), initial=0)
    blocks, languages = [], set()
    for m, n in zip(found, upto):
        if m["fence"]:
            language = (m["info"].split() or [""])[0]
            languages.add(language)
            body = text[m.end("info") + 1 : m.end("code") + 1] if m["code"] else ""
            blocks.append({"index": len(blocks), "language": language, "content": body, "section_path": list(paths[n]) or None})
    return {
        "title": next((title for level, title in filter(None, named) if level == 1 and title), ""),
        "headings": [" > ".join(p) for p in paths[1:]],
        "languages": sorted(languages - {""}),
        "links": list(_links(_DEFINED.sub("", prose), defined)),
        "code_blocks": _as_json(blocks) if blocks else None,
    }


def _atx_title(rest: str) -> str:
    bare = rest.strip(" \t")
    less = bare.rstrip("#")
    return less.rstrip(" \t") if not less or less != bare and less[-1] in " \t" else bare
